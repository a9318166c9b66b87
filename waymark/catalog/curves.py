"""Queries over published recall-cost curves, and over curves derived from ``lineitem`` and ``events``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.plans import curves, studies

from . import query, table

# Measured frontiers by workload and method, as recall in percent and logical reads
# per query at search widths 10, 20, 40, 80, 160 and 320.
WIDTHS = (10, 20, 40, 80, 160, 320)
FRONTIERS = """
coveo baseline 75.755997 45.3686 84.258003 55.9782 90.279999 74.765 94.75 112.2766 98.015999 190.3126 99.433998 346.356
coveo junction 80.594002 15.7112 86.386002 25.7638 92.274002 46.0972 95.867996 84.6768 98.339996 163.7728 99.477997 322.6892
coveo core 93.842003 14.0768 96.452003 22.819 97.896004 42.2948 98.903999 81.9864 99.449997 161.8464 99.653999 321.5164
pubmed baseline 23.73 44.428 34.209999 53.887 45.939999 70.982 58.060001 107.096 69.669998 183.725 79.639999 340.886
pubmed junction 25.440001 19.287 35.34 29.131 46.450001 47.338 58.080002 84.791 69.739998 163.371 79.629997 322.474
pubmed core 29.01 17.534 38.860001 26.811 49.919998 45.985 60.810001 84.975 71.68 164.07 80.480003 323.118
text2image baseline 39.049999 55.401 54.200001 67.348 68.440002 87.318 80.540001 126.589 88.449997 204.883 94.07 364.062
text2image junction 38.169998 30.929 53.860001 42.442 67.900002 61.601 79.830002 99.854 88.040001 177.747 93.760002 336.447
text2image core 41.599998 32.98 56.560001 43.046 70.580002 61.336 81.790001 98.585 89.779999 176.541 94.489998 333.902
bigann baseline 85.489998 47.793 93.93 55.73 97.25 72.805 98.970001 110.175 99.769997 188.123 99.959999 346.188
bigann junction 85.339996 27.925 94.019997 35.905 97.110001 52.715 98.959999 90.003 99.760002 167.869 99.959999 325.965
bigann core 85.379997 32.228 94.029999 40.193 97.290001 57.26 99.019997 94.82 99.790001 172.606 99.970001 330.484
"""


def rows() -> list[tuple[str, str, int, float, float]]:
    out = []
    for line in FRONTIERS.split("\n"):
        if line:
            workload, method, *v = line.split()
            out += [(workload, method, w, float(v[2 * k]), float(v[2 * k + 1])) for k, w in enumerate(WIDTHS)]
    return out


def published(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(rows(), "workload string, method string, width int, recall double, cost double")


VALUES = "p(workload, method, width, recall, cost) AS (VALUES " + ", ".join(f"('{w}', '{m}', {n}, CAST({r} AS DOUBLE), CAST({c} AS DOUBLE))" for w, m, n, r, c in rows()) + ")"
FRONT = f"{VALUES}, f AS (SELECT workload, method, recall, min(cost) AS cost FROM p GROUP BY workload, method, recall)"
SEGMENTS = f"{FRONT}, s AS (SELECT *, lead(recall) OVER w AS hi, lead(cost) OVER w AS hi_cost FROM f WINDOW w AS (PARTITION BY workload, method ORDER BY recall))"
COSTS = f"""{SEGMENTS}, t AS (SELECT workload, recall AS target FROM f WHERE method = 'core'),
c AS (SELECT s.workload, s.method, target, max(CASE WHEN abs(recall - target) <= 1e-7 THEN cost WHEN recall < target AND target < hi AND abs(hi - target) > 1e-7 THEN cost + (hi_cost - cost) * (target - recall) / (hi - recall) END) AS cost
FROM s JOIN t ON s.workload = t.workload GROUP BY s.workload, s.method, target)"""
SAVED = f"""{COSTS}, full_t AS (SELECT workload, target, max(cost) FILTER (WHERE method = 'baseline') AS ref FROM c GROUP BY workload, target HAVING count(cost) = 3),
g AS (SELECT c.workload, c.target, method, 100 * (1 - cost / ref) AS saving FROM c JOIN full_t ON c.workload = full_t.workload AND c.target = full_t.target)"""


@query(f"WITH {COSTS} SELECT workload, method, target, round(cost, 9) AS cost FROM c")
def interpolated_costs(spark, sf_dir):
    front = curves.frontier(published(spark), ["workload", "method"])
    targets = front.where("method = 'core'").select("workload", F.col("recall").alias("target"))
    return curves.interpolate(front, targets, ["workload", "method"], ["workload"]).select("workload", "method", "target", F.round("cost", 9).alias("cost"))


@query(f"WITH {SAVED} SELECT workload, method, count(*) AS targets, round(avg(saving), 6) AS saving FROM g GROUP BY workload, method")
def matched_savings(spark, sf_dir):
    """Mean read savings at the core method's recalls."""
    found = curves.matched(published(spark), ["workload"], "method", "core", "baseline")
    return curves.mean_savings(found, ["workload"], "method").withColumn("saving", F.round("saving", 6))


@query(f"WITH {SAVED} SELECT workload, method, min(target) AS low, max(target) AS high, count(*) AS anchors FROM g GROUP BY workload, method HAVING count(*) >= 3")
def component_ranges(spark, sf_dir):
    found = curves.matched(published(spark), ["workload"], "method", "core", "baseline")
    return found.groupBy("workload", "method").agg(F.min("target").alias("low"), F.max("target").alias("high"), F.count(F.lit(1)).alias("anchors")).where("anchors >= 3")


@query(f"WITH {SAVED} SELECT workload, target, round(max(saving) FILTER (WHERE method = 'core') - max(saving) FILTER (WHERE method = 'junction'), 6) AS gain FROM g GROUP BY workload, target")
def core_over_junction(spark, sf_dir):
    found = curves.matched(published(spark), ["workload"], "method", "core", "baseline")
    of = lambda m: F.max(F.when(F.col("method") == m, F.col("saving")))
    return found.groupBy("workload", "target").agg(F.round(of("core") - of("junction"), 6).alias("gain"))


@query(f"WITH {VALUES}, e AS (SELECT workload, method, min(recall) AS a, max(recall) AS b FROM p GROUP BY workload, method) SELECT workload, max(a) AS low, min(b) AS high FROM e GROUP BY workload")
def support_ranges(spark, sf_dir):
    return curves.support_range(published(spark), ["workload"], "method")


@query(f"""WITH {VALUES}, t AS (SELECT CAST(unnest([35, 45, 55, 65, 72, 75]) AS DOUBLE) AS target),
s AS (SELECT *, lead(recall) OVER w AS hi, lead(cost) OVER w AS hi_cost, row_number() OVER w AS n FROM p WINDOW w AS (PARTITION BY workload, method ORDER BY width))
SELECT workload, method, target, round(arg_min(cost + (target - recall) / (hi - recall) * (hi_cost - cost), n), 9) AS cost FROM s, t WHERE recall <= target AND target <= hi GROUP BY workload, method, target""")
def fixed_target_costs(spark, sf_dir):
    targets = spark.createDataFrame([(float(x),) for x in (35, 45, 55, 65, 72, 75)], "target double")
    return curves.interpolate_closed(curves.mono(published(spark), ["workload", "method"]), targets, ["workload", "method"]).withColumn("cost", F.round("cost", 9))


@query(f"WITH {VALUES} SELECT workload, method, CAST(width AS INTEGER) AS width, recall, cost FROM p a WHERE NOT EXISTS (SELECT 1 FROM p b WHERE b.workload = a.workload AND b.recall >= a.recall - 1e-8 AND b.cost <= a.cost + 1e-8 AND (b.recall > a.recall + 1e-8 OR b.cost < a.cost - 1e-8))")
def pareto_points(spark, sf_dir):
    """Of all methods' points together, those of each workload that none dominates."""
    return curves.pareto(published(spark), ["workload"]).select("workload", "method", "width", "recall", "cost")


#: A noisy curve for each line status and ship mode of quantity: recall from discounts, cost from tax.
NOISY = """n AS (SELECT l_returnflag || l_linestatus AS curve, CAST(l_quantity AS INTEGER) AS width, round(avg(l_discount) * 1000, 6) AS recall, round(avg(l_tax) * 1000, 6) AS cost FROM lineitem GROUP BY ALL)"""


def noisy(spark, sf_dir) -> DataFrame:
    key = [F.concat("l_returnflag", "l_linestatus").alias("curve"), F.col("l_quantity").cast("int").alias("width")]
    return table(spark, sf_dir, "lineitem").groupBy(*key).agg(F.round(F.avg("l_discount") * 1000, 6).alias("recall"), F.round(F.avg("l_tax") * 1000, 6).alias("cost"))


@query(f"WITH {NOISY}, b AS (SELECT *, max(recall) OVER (PARTITION BY curve ORDER BY width ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM n) SELECT curve, width, round(recall, 4) AS recall, round(cost, 4) AS cost FROM b WHERE best IS NULL OR recall + 1e-9 >= best")
def monotone_frontier(spark, sf_dir):
    return curves.mono(noisy(spark, sf_dir), ["curve"]).select("curve", "width", F.round("recall", 4).alias("recall"), F.round("cost", 4).alias("cost"))


@query(f"WITH {NOISY}, r AS (SELECT curve, round(recall, 1) AS recall, cost FROM n) SELECT curve, recall, round(min(cost), 4) AS cost FROM r GROUP BY curve, recall")
def recall_frontier(spark, sf_dir):
    tied = noisy(spark, sf_dir).withColumn("recall", F.round("recall", 1))
    return curves.frontier(tied, ["curve"]).withColumn("cost", F.round("cost", 4))


@query(f"WITH {NOISY} SELECT curve, width, round(recall, 4) AS recall, round(cost, 4) AS cost FROM n a WHERE NOT EXISTS (SELECT 1 FROM n b WHERE b.curve = a.curve AND b.recall >= a.recall - 1e-8 AND b.cost <= a.cost + 1e-8 AND (b.recall > a.recall + 1e-8 OR b.cost < a.cost - 1e-8))")
def pareto_noisy(spark, sf_dir):
    return curves.pareto(noisy(spark, sf_dir), ["curve"]).select("curve", "width", F.round("recall", 4).alias("recall"), F.round("cost", 4).alias("cost"))


@query("""SELECT event_type AS method, CAST(user_id % 6 AS INTEGER) AS width, round(avg(value), 4) AS mean_ios, round(quantile_cont(value, 0.5), 4) AS latency_us FROM events GROUP BY ALL""")
def replicate_aggregate(spark, sf_dir):
    """Mean of counted and median of timed quantities over repetitions."""
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("method"), (F.col("user_id") % 6).cast("int").alias("width"), F.col("value").alias("mean_ios"), F.col("value").alias("latency_us"))
    got = curves.replicated(e, ["method", "width"], ["mean_ios"], ["latency_us"])
    return got.select("method", "width", F.round("mean_ios", 4).alias("mean_ios"), F.round("latency_us", 4).alias("latency_us"))


RUNS = """l AS (SELECT l_linestatus AS arm, CAST(l_linenumber AS INTEGER) AS run, CAST(l_quantity AS INTEGER) // 10 AS width, avg(l_discount) AS d, count(*) AS n FROM lineitem WHERE l_linenumber <= 3 GROUP BY ALL),
x AS (SELECT arm, run, width * 10.0 + run * 0.25 AS recall, round(width * 5 + n / 1000.0, 3) AS cost FROM l)"""


@query(f"""WITH {RUNS}, y AS (SELECT * FROM x a WHERE NOT EXISTS (SELECT 1 FROM x b WHERE b.arm = a.arm AND b.run = a.run AND b.recall >= a.recall - 1e-8 AND b.cost <= a.cost + 1e-8 AND (b.recall > a.recall + 1e-8 OR b.cost < a.cost - 1e-8))),
s AS (SELECT *, lead(recall) OVER w AS hi, lead(cost) OVER w AS hi_cost FROM y WINDOW w AS (PARTITION BY arm, run ORDER BY recall)), t AS (SELECT CAST(unnest([15.0, 25.0, 35.0, 45.0, 50.5]) AS DOUBLE) AS target),
c AS (SELECT arm, run, target, max(CASE WHEN abs(recall - target) <= 1e-7 THEN cost WHEN recall < target AND target < hi AND abs(hi - target) > 1e-7 THEN cost + (hi_cost - cost) * (target - recall) / (hi - recall) END) AS cost FROM s, t GROUP BY arm, run, target),
w AS (SELECT target, arm, avg(cost) AS cost FROM c GROUP BY target, arm HAVING count(cost) = 3)
SELECT w.target, w.arm, round(w.cost, 6) AS cost, round(100 * (1 - w.cost / r.cost), 6) AS saving FROM w JOIN w r ON r.target = w.target AND r.arm = 'F'""")
def latency_savings(spark, sf_dir):
    """Pareto and interpolation per run; a target counts if all three runs of an arm support it."""
    l = table(spark, sf_dir, "lineitem").where("l_linenumber <= 3").groupBy(F.col("l_linestatus").alias("arm"), F.col("l_linenumber").cast("int").alias("run"), F.floor(F.col("l_quantity").cast("int") / 10).alias("width")).agg(F.count(F.lit(1)).alias("n"))
    x = l.select("arm", "run", (F.col("width") * 10.0 + F.col("run") * 0.25).alias("recall"), F.round(F.col("width") * 5 + F.col("n") / 1000.0, 3).alias("cost"))
    targets = spark.createDataFrame([(t,) for t in (15.0, 25.0, 35.0, 45.0, 50.5)], "target double")
    got = curves.latency_savings(x, "arm", {"F": 3, "O": 3}, targets, "F")
    return got.select("target", "arm", F.round("cost", 6).alias("cost"), F.round("saving", 6).alias("saving"))


@query("""WITH w(workload, ids, nlist, capacity, dim, itemsize) AS (VALUES ('pubmed', 14464, 512, 2048, 768, 4), ('coveo', 12169, 512, 2048, 50, 4), ('text2image', 14464, 512, 2048, 200, 4), ('bigann', 14464, 512, 2048, 128, 1)),
b AS (SELECT *, CAST(24 + 4 * nlist + 4 * (nlist + 1) + 4 * (ids - nlist) + 68 * nlist + 4 * capacity AS BIGINT) AS budget FROM w)
SELECT workload, scale, budget, budget * scale // (dim * itemsize + 256) AS cache_records, (budget * scale - 16) // (dim * 4 + 4) AS pool_records FROM b, (SELECT CAST(unnest([1, 4, 16]) AS BIGINT) AS scale)""")
def payload_budgets(spark, sf_dir):
    """Accounted bytes of the routing state, and what competitors can hold in 1, 4 and 16 times of it."""
    w = spark.createDataFrame([("pubmed", 14464, 512, 2048, 768, 4), ("coveo", 12169, 512, 2048, 50, 4), ("text2image", 14464, 512, 2048, 200, 4), ("bigann", 14464, 512, 2048, 128, 1)], "workload string, ids long, nlist long, capacity long, dim long, itemsize long")
    b = w.withColumn("budget", curves.payload_bytes(F.col("ids"), F.col("nlist"), F.col("capacity"))).withColumn("scale", F.explode(F.array(*[F.lit(x).cast("long") for x in (1, 4, 16)])))
    return b.select("workload", "scale", "budget", curves.cache_records(F.col("budget") * F.col("scale"), F.col("dim"), F.col("itemsize")).alias("cache_records"), curves.pool_records(F.col("budget"), F.col("scale"), F.col("dim")).alias("pool_records"))


@query(f"WITH {VALUES}, k AS (SELECT DISTINCT workload, method FROM p), g AS (SELECT workload, method, CAST(unnest([5, 10, 20, 40]) AS INTEGER) AS width FROM k) SELECT g.workload, g.method, g.width, coalesce(recall, 'NaN'::DOUBLE) AS recall, coalesce(cost, 'NaN'::DOUBLE) AS cost FROM g LEFT JOIN p ON p.workload = g.workload AND p.method = g.method AND p.width = g.width")
def plot_rows(spark, sf_dir):
    return curves.plot_rows(published(spark), ["workload", "method"], [5, 10, 20, 40])


@query(f"WITH {VALUES} SELECT CAST(count(*) AS BIGINT) AS violations FROM p WHERE abs(recall - round(recall, 1)) > 0.04")
def tolerance_violations(spark, sf_dir):
    """Cells that differ from their rounded copy by over a limit."""
    p = published(spark)
    return curves.within(p.select("workload", "method", "width", "recall"), p.select("workload", "method", "width", F.round("recall", 1).alias("recall")), ["workload", "method", "width"], ["recall"], 0.04).agg(F.count(F.lit(1)).alias("violations"))


@query(f"WITH {SEGMENTS}, t AS (SELECT CAST(unnest([30, 60, 90, 99]) AS DOUBLE) AS target), e AS (SELECT workload, method, min(recall) AS a, max(recall) AS b FROM p GROUP BY workload, method) SELECT e.workload, e.method, target, CASE WHEN target < a THEN 'below range' WHEN target > b THEN 'above range' END AS reason FROM e, t")
def support_reasons(spark, sf_dir):
    """Why a curve has no cost at a target."""
    targets = spark.createDataFrame([(float(x),) for x in (30, 60, 90, 99)], "target double")
    return studies.reasons(published(spark), ["workload", "method"], targets).drop("cost")


@query(f"WITH {VALUES} SELECT workload, CAST(width AS INTEGER) AS width, round(100 * (1 - max(cost) FILTER (WHERE method = 'core') / max(cost) FILTER (WHERE method = 'baseline')), 6) AS saving FROM p GROUP BY workload, width")
def paired_savings(spark, sf_dir):
    """Reads saved at equal width, pair by pair."""
    found = studies.paired_ratios(published(spark), ["workload", "width"], "method", "core", "baseline", "cost")
    return found.withColumn("saving", F.round("saving", 6))


@query(f"WITH {COSTS} SELECT workload, target FROM c GROUP BY workload, target HAVING count(cost) = 3")
def common_anchors(spark, sf_dir):
    return studies.common_anchors(published(spark), ["workload"], "method", "core")


@query(f"""WITH {SEGMENTS}, t AS (SELECT CAST(unnest([45, 80, 95, 98]) AS DOUBLE) AS target),
c AS (SELECT s.workload, s.method, target, max(CASE WHEN abs(recall - target) <= 1e-7 THEN cost WHEN recall < target AND target < hi AND abs(hi - target) > 1e-7 THEN cost + (hi_cost - cost) * (target - recall) / (hi - recall) END) AS cost FROM s, t GROUP BY s.workload, s.method, target),
g AS (SELECT workload, target FROM c GROUP BY workload, target HAVING count(cost) = 3)
SELECT c.workload, c.target, c.method, round(CASE WHEN g.target IS NOT NULL THEN c.cost END, 6) AS cost, round(CASE WHEN g.target IS NOT NULL THEN 100 * (1 - c.cost / r.cost) END, 6) AS saving
FROM c JOIN c r ON r.workload = c.workload AND r.target = c.target AND r.method = 'baseline' LEFT JOIN g ON g.workload = c.workload AND g.target = c.target""")
def fixed_target_savings(spark, sf_dir):
    """Savings at fixed recalls; null where a method does not reach the recall."""
    targets = spark.createDataFrame([(float(x),) for x in (45, 80, 95, 98)], "target double")
    got = studies.fixed_targets(published(spark), ["workload"], "method", "baseline", targets)
    return got.select("workload", "target", "method", F.round("cost", 6).alias("cost"), F.round("saving", 6).alias("saving"))


@query("""SELECT user_id % 7 AS condition, round(avg(value) FILTER (WHERE event_id % 4 = 0), 4) AS k1, round(avg(value) FILTER (WHERE event_id % 4 = 1), 4) AS k2, round(avg(value) FILTER (WHERE event_id % 4 = 2), 4) AS k4, round(avg(value) FILTER (WHERE event_id % 4 = 3), 4) AS k8 FROM events GROUP BY 1""")
def sensitivity_table(spark, sf_dir):
    e = table(spark, sf_dir, "events").select((F.col("user_id") % 7).alias("condition"), F.pow(F.lit(2), F.col("event_id") % 4).cast("int").alias("starts"), F.col("value").alias("saving"))
    got = studies.sensitivity(e, "condition", "starts", [1, 2, 4, 8])
    return got.select("condition", *[F.round(f"k{v}", 4).alias(f"k{v}") for v in (1, 2, 4, 8)])
