"""Matched-recall analytics: frontiers, interpolation without extrapolation, savings.

A curve is long form ``(curve..., width, recall, cost)``; ``curve`` columns name the method,
repetition, seed or workload that a row belongs to. The variants of the published studies differ in
their ties and tolerances and are kept apart by name.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.operators.kmeans import small

EXACT, LOOSE = 1e-8, 1e-7


def mono(points: DataFrame, curve: list[str], eps: float = 1e-9) -> DataFrame:
    """In width order, the points whose recall is not below what went before (up to ``eps``)."""
    before = F.max("recall").over(Window.partitionBy(*curve).orderBy("width").rowsBetween(Window.unboundedPreceding, -1))
    return points.withColumn("__best", before).where(F.col("__best").isNull() | (F.col("recall") + eps >= F.col("__best"))).drop("__best")


def frontier(points: DataFrame, curve: list[str], eps: float = EXACT) -> DataFrame:
    """In recall order, the cheapest of each run of recalls that lie within ``eps``: of equal costs the first."""
    w = Window.partitionBy(*curve).orderBy("recall", "cost")
    new = F.coalesce((F.col("recall") - F.lag("recall").over(w) > eps).cast("int"), F.lit(1))
    run = points.withColumn("__new", new).withColumn("__run", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    best = run.groupBy(*curve, "__run").agg(F.min_by(F.struct("recall", "cost"), F.struct("cost", "recall")).alias("p"))
    return best.select(*curve, "p.recall", "p.cost")


def pareto(points: DataFrame, curve: list[str], eps: float = EXACT) -> DataFrame:
    """The points that no other dominates: as good in both, and better in one by ``eps``."""
    b = points.select(*[F.col(c).alias(f"__{c}") for c in curve], F.col("recall").alias("__r"), F.col("cost").alias("__c"))
    same = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in curve], F.lit(True))
    worse = same & (F.col("__r") >= F.col("recall") - eps) & (F.col("__c") <= F.col("cost") + eps) & ((F.col("__r") > F.col("recall") + eps) | (F.col("__c") < F.col("cost") - eps))
    return points.join(b, worse, "left_anti")


def segments(points: DataFrame, curve: list[str], order: str = "recall") -> DataFrame:
    """``(curve, lo, lo_cost, hi, hi_cost)``: neighbouring points; the last has null ``hi``."""
    w = Window.partitionBy(*curve).orderBy(order)
    return points.select(*curve, F.col("recall").alias("lo"), F.col("cost").alias("lo_cost"), F.lead("recall").over(w).alias("hi"), F.lead("cost").over(w).alias("hi_cost"), F.row_number().over(w).alias("segment"))


def interpolate(points: DataFrame, targets: DataFrame, curve: list[str], on: list[str] | None = None, eps: float = LOOSE) -> DataFrame:
    """``targets(on..., target)`` with every matching curve's ``cost`` at the target.

    A point within ``eps`` of the target is returned as it is; outside a curve's range the cost is
    null, never extrapolated. Curves and targets meet on ``on`` (equal columns), then by range.
    """
    on = on or []
    s = segments(points, curve)
    t = F.col("target")
    hit = F.abs(F.col("lo") - t) <= eps
    inside = F.col("hi").isNotNull() & (F.col("lo") < t) & (t < F.col("hi")) & (F.abs(F.col("hi") - t) > eps)
    value = F.when(hit, F.col("lo_cost")).when(inside, F.col("lo_cost") + (F.col("hi_cost") - F.col("lo_cost")) * (t - F.col("lo")) / (F.col("hi") - F.col("lo")))
    pairs = s.join(targets, on) if on else s.join(small(targets), F.lit(True))
    keys = list(dict.fromkeys([*curve, *on, "target"]))
    return pairs.select(*keys, value.alias("v"), hit.alias("hit")).groupBy(*keys).agg(F.coalesce(F.max(F.when(F.col("hit"), F.col("v"))), F.max("v")).alias("cost"))


def interpolate_closed(points: DataFrame, targets: DataFrame, curve: list[str]) -> DataFrame:
    """In width order, the first segment with lo <= target <= hi; a degenerate one has weight 0."""
    s = segments(points.withColumnRenamed("width", "__w"), curve, "__w")
    t = F.col("target")
    pairs = s.join(small(targets), F.lit(True)).where(F.col("hi").isNotNull() & (F.col("lo") <= t) & (t <= F.col("hi")))
    weight = F.when(F.col("hi") == F.col("lo"), 0.0).otherwise((t - F.col("lo")) / F.when(F.col("hi") != F.col("lo"), F.col("hi") - F.col("lo")))
    value = F.col("lo_cost") + weight * (F.col("hi_cost") - F.col("lo_cost"))
    return pairs.withColumn("v", value).groupBy(*curve, "target").agg(F.min_by("v", "segment").alias("cost"))


def saving(test: Column, reference: Column) -> Column:
    """Percent saved against the reference; null where that is not positive."""
    return F.when(reference > 0, 100.0 * (1.0 - test / reference))


def extra(test: Column, reference: Column) -> Column:
    return F.when(reference > 0, 100.0 * (test / reference - 1.0))


def matched(points: DataFrame, group: list[str], method: str, anchor: str, reference: str, eps: float = LOOSE) -> DataFrame:
    """``(group, target, method, saving)`` at the anchor's recalls that **all** methods support.

    Recall grids of different anchors are never pooled: the anchor is a parameter.
    """
    curve = [*group, method]
    front = frontier(points, curve)
    targets = front.where(F.col(method) == anchor).select(*group, F.col("recall").alias("target"))
    costs = interpolate(front, targets, curve, group, eps)
    methods = front.groupBy(*group).agg(F.count_distinct(method).alias("n"))
    key = [*group, "target"]
    full = costs.groupBy(*key).agg(F.count("cost").alias("have"), F.max(F.when(F.col(method) == reference, F.col("cost"))).alias("ref"))
    full = (full.join(methods, group) if group else full.join(small(methods), F.lit(True))).where("have = n")
    return costs.join(full, key).select(*key, method, saving(F.col("cost"), F.col("ref")).alias("saving"))


def mean_savings(found: DataFrame, group: list[str], method: str, least: int = 1) -> DataFrame:
    """Equal-weight mean over targets; null where fewer than ``least`` are supported."""
    got = found.groupBy(*group, method).agg(F.count(F.lit(1)).alias("targets"), F.avg("saving").alias("mean"))
    return got.select(*group, method, "targets", F.when(F.col("targets") >= least, F.col("mean")).alias("saving"))


def replicated(rows: DataFrame, key: list[str], means: list[str], medians: list[str]) -> DataFrame:
    """Over repetitions, the mean of counted quantities and the median of timed ones."""
    return rows.groupBy(*key).agg(*[F.avg(c).alias(c) for c in means], *[F.percentile(c, F.lit(0.5)).alias(c) for c in medians])


def latency_savings(points: DataFrame, arm: str, runs: dict[str, int], anchor: DataFrame, reference: str, eps: float = LOOSE) -> DataFrame:
    """``(target, arm, cost, saving)``: Pareto per run, interpolate each, demand all of an arm's
    ``runs``, average absolute costs, then compare. Points have ``(arm, run, recall, cost)``."""
    costs = interpolate(frontier(pareto(points, [arm, "run"]), [arm, "run"]), anchor, [arm, "run"], [], eps)
    want = F.create_map(*[F.lit(x) for pair in runs.items() for x in pair])[F.col(arm)]
    whole = costs.groupBy("target", arm).agg(F.count("cost").alias("n"), F.avg("cost").alias("cost")).where(F.col("n") == want)
    ref = whole.where(F.col(arm) == reference).select("target", F.col("cost").alias("ref"))
    return whole.join(ref, "target").select("target", arm, "cost", saving(F.col("cost"), F.col("ref")).alias("saving"))


def support_range(points: DataFrame, group: list[str], method: str) -> DataFrame:
    """``(group, low, high)``: recalls that every method covers: the largest minimum to the least maximum."""
    ends = points.groupBy(*group, method).agg(F.min("recall").alias("a"), F.max("recall").alias("b"))
    return ends.groupBy(*group).agg(F.max("a").alias("low"), F.min("b").alias("high"))


def complete_grid(points: DataFrame, curve: list[str], widths: list[int]) -> DataFrame:
    """Curves whose widths are exactly the grid; others are an error."""
    got = points.groupBy(*curve).agg(F.array_sort(F.collect_list(F.col("width").cast("int"))).alias("w"))
    bad = got.where(F.col("w") != F.array(*[F.lit(x) for x in sorted(widths)]))
    if (row := bad.first()) is not None:
        raise ValueError(f"an incomplete grid: {row}")
    return points


def plot_rows(points: DataFrame, curve: list[str], widths: list[int]) -> DataFrame:
    """Every curve at every width, with NaN where it has no point."""
    grid = points.select(*curve).distinct().select(*curve, F.explode(F.array(*map(F.lit, widths))).alias("width"))
    nan = F.lit(float("nan"))
    return grid.join(points, [*curve, "width"], "left").select(*curve, "width", F.coalesce("recall", nan).alias("recall"), F.coalesce("cost", nan).alias("cost"))


def within(actual: DataFrame, expected: DataFrame, key: list[str], columns: list[str], limit: float) -> DataFrame:
    """Violations ``(key, column, actual, expected)``: missing on one side, over the limit, or not
    both NaN. An empty expected side is a violation of its own."""
    if expected.limit(1).count() == 0:
        raise ValueError("nothing to compare with")
    long = lambda df, name: df.select(*key, F.explode(F.map_from_arrays(F.array(*map(F.lit, columns)), F.array(*[F.col(c).cast("double") for c in columns]))).alias("column", name))
    both = long(actual, "actual").join(long(expected, "expected"), [*key, "column"], "full_outer")
    same = (F.isnan("actual") & F.isnan("expected")) | (F.abs(F.col("actual") - F.col("expected")) <= limit)
    return both.where(~F.coalesce(same, F.lit(False)))


def payload_bytes(ids: Column, nlist: Column, capacity: Column) -> Column:
    """Accounted routing bytes: directory (header, medoids, offsets, children), coarse codes and the
    code offsets of the medoids, and four bytes for each recent destination."""
    directory = 24 + 4 * nlist + 4 * (nlist + 1) + 4 * (ids - nlist)
    return directory + nlist * 68 + 4 * capacity


def cache_records(budget: Column, dim: Column, itemsize: Column) -> Column:
    return F.floor(budget / (dim * itemsize + 256)).cast("long")


def pool_records(budget: Column, scale: Column, dim: Column, header: int = 16) -> Column:
    return F.floor((budget * scale - header) / (dim * 4 + 4)).cast("long")


def report(value: Column, digits: int) -> Column:
    """A reported number: halves go to the even digit."""
    return F.bround(value, digits)


def nearest_ranks(latency: str, points: tuple[float, ...] = (0.5, 0.95, 0.99, 0.999)) -> list[Column]:
    """Exact latency quantiles, named by their per mille."""
    return [F.percentile(latency, F.lit(q)).alias(f"p{round(q * 1000)}") for q in points]
