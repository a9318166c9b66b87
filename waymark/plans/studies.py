"""Studies built from curves: paired runs, common anchors, memory scaling, native summaries, arms."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import curves


def reasons(points: DataFrame, curve: list[str], targets: DataFrame) -> DataFrame:
    """``(curve, target, cost, reason)``: every curve at every target, and why a cost is missing."""
    ends = points.groupBy(*curve).agg(F.min("recall").alias("a"), F.max("recall").alias("b"), F.count(F.lit(1)).alias("n"))
    costs = curves.interpolate(curves.frontier(points, curve), targets, curve)
    why = F.when(F.col("cost").isNotNull(), F.lit(None).cast("string")).when(F.col("n") < 2, "single point").when(F.col("target") < F.col("a"), "below range").when(F.col("target") > F.col("b"), "above range").otherwise("unsupported")
    return costs.join(ends, curve).select(*curve, "target", "cost", why.alias("reason"))


def paired_ratios(rows: DataFrame, pair: list[str], method: str, test: str, reference: str, column: str) -> DataFrame:
    """``(pair, saving)``: within each pair (a repetition, say) the saving of one method over another."""
    of = lambda m: F.max(F.when(F.col(method) == m, F.col(column)))
    return rows.groupBy(*pair).agg(curves.saving(of(test), of(reference)).alias("saving"))


def common_anchors(points: DataFrame, group: list[str], method: str, anchor: str, least: int = 3) -> DataFrame:
    """Targets of the anchor that every method supports; a group with fewer than ``least`` is an error."""
    curve = [*group, method]
    front = curves.frontier(points, curve)
    targets = front.where(F.col(method) == anchor).select(*group, F.col("recall").alias("target"))
    costs = curves.interpolate(front, targets, curve, group)
    n = points.select(method).distinct().count()
    common = costs.groupBy(*group, "target").agg(F.count("cost").alias("have")).where(F.col("have") == n).drop("have")
    per = targets.select(*group).distinct().join(common.groupBy(*group).count(), group, "left") if group else common.agg(F.count(F.lit(1)).alias("count"))
    if (row := per.where(F.coalesce("count", F.lit(0)) < least).first()) is not None:
        raise ValueError(f"fewer than {least} common anchors: {row.asDict()}")
    return common


def fixed_targets(points: DataFrame, group: list[str], method: str, reference: str, targets: DataFrame) -> DataFrame:
    """``(group, target, method, cost, saving)`` at fixed targets; outside the range that all methods
    cover both are null."""
    curve = [*group, method]
    costs = curves.interpolate(points.select(*curve, "recall", "cost"), targets, curve)
    span = curves.support_range(points, group, method)
    named = costs.join(span, group) if group else costs.join(curves.small(span), F.lit(True))
    inside = (F.col("target") >= F.col("low")) & (F.col("target") <= F.col("high"))
    held = named.withColumn("cost", F.when(inside, F.col("cost")))
    ref = held.where(F.col(method) == reference).select(*group, "target", F.col("cost").alias("ref"))
    return held.join(ref, [*group, "target"]).select(*group, "target", method, "cost", curves.saving(F.col("cost"), F.col("ref")).alias("saving"))


def memory_scaling(points: DataFrame, group: list[str], method: str, scale: str, core: str, anchors: DataFrame) -> DataFrame:
    """``(group, method, scale, targets, saving)``: what the core saves over a competitor with
    ``scale`` times its memory, at the core's recalls. ``anchors`` has ``(group, target)``."""
    curve = [*group, method, scale]
    costs = curves.interpolate(curves.frontier(points, curve), anchors, curve, group)
    own = costs.where(F.col(method) == core).select(*group, "target", F.col("cost").alias("core"))
    both = costs.where(F.col(method) != core).join(own, [*group, "target"]).where("cost IS NOT NULL AND core IS NOT NULL")
    return both.groupBy(*group, method, scale).agg(F.count(F.lit(1)).alias("targets"), F.avg(curves.saving(F.col("core"), F.col("cost"))).alias("saving"))


def native_summary(points: DataFrame, arm: str, rep: str, reference: str, reps: int) -> DataFrame:
    """``(target, arm, cost, saving, available)``: per repetition, costs at the recalls of the
    repetition's own reference; a target index is available if all repetitions support it."""
    curve = [arm, rep]
    front = curves.frontier(points, curve)
    from pyspark.sql import Window

    anchors = front.where(F.col(arm) == reference).withColumn("k", F.row_number().over(Window.partitionBy(rep).orderBy("recall"))).select(rep, "k", F.col("recall").alias("target"))
    costs = curves.interpolate(front, anchors.select(rep, "target"), curve, [rep]).join(anchors, [rep, "target"])
    ref = costs.where(F.col(arm) == reference).select(rep, "k", F.col("cost").alias("ref"))
    each = costs.join(ref, [rep, "k"]).withColumn("s", curves.saving(F.col("cost"), F.col("ref")))
    got = each.groupBy("k", arm).agg(F.avg("target").alias("target"), F.avg("cost").alias("cost"), F.avg("s").alias("saving"), (F.count("cost") == reps).alias("available"))
    return got.select("k", "target", arm, F.when(F.col("available"), F.col("cost")).alias("cost"), F.when(F.col("available"), F.col("saving")).alias("saving"), "available")


def sensitivity(rows: DataFrame, condition: str, starts: str, values: list[int], column: str = "saving") -> DataFrame:
    """One row per condition, one column per number of starts."""
    return rows.groupBy(condition).agg(*[F.avg(F.when(F.col(starts) == v, F.col(column))).alias(f"k{v}") for v in values])


def counter_summary(counters: DataFrame, key: list[str], queries: Column) -> DataFrame:
    """Over repetitions: mean counters, writes per query, and the accepted share of trials; 0 where
    nothing was tried."""
    share = lambda a, b: F.when(b == 0, 0.0).otherwise(a / b)
    return counters.groupBy(*key).agg(F.avg("writes").alias("writes"), F.avg("trials").alias("trials"), F.avg("accepts").alias("accepts"), F.avg(share(F.col("writes"), queries)).alias("writes_per_query"), share(F.sum("accepts"), F.sum("trials")).alias("accepted"))


def bucket_usage(starts: DataFrame, queries: DataFrame) -> DataFrame:
    """One row: percent of queries whose bucket holds anything, and mean starts a query."""
    n = queries.select("query").join(starts.groupBy("query").agg(F.count(F.lit(1)).alias("n")), "query", "left")
    held = F.coalesce("n", F.lit(0))
    return n.agg((F.avg((held > 0).cast("int")) * 100).alias("usage"), F.avg(held).alias("mean_starts"))


def score_deltas(rows: DataFrame, claimed: DataFrame, limit: float = 1e-8) -> DataFrame:
    """Violations of claimed deltas ``(workload, variant, target, delta)`` against ``sum`` in
    ``rows(workload, variant, target, saving)``; a repeated target is a violation too."""
    base = rows.where("variant = 'sum'").select("workload", "target", F.col("saving").alias("base"))
    real = rows.join(base, ["workload", "target"]).groupBy("workload", "variant", "target").agg(F.max(F.col("saving") - F.col("base")).alias("real"), F.count(F.lit(1)).alias("n"))
    both = real.join(claimed, ["workload", "variant", "target"], "full_outer")
    return both.where(~F.coalesce((F.col("n") == 1) & (F.abs(F.col("real") - F.col("delta")) <= limit), F.lit(False)))


@dataclass(frozen=True)
class Experiment:
    """A named grid of arms: what varies, over which values, and what is kept fixed."""

    name: str
    arms: dict[str, dict]
    fixed: dict = field(default_factory=dict)

    def streams(self, widths: tuple[int, ...], reps: int = 1) -> list[tuple[str, str, int, int, dict]]:
        """(stream, arm, rep, width, parameters); arms rotate by repetition, as interleaved runs do."""
        names = list(self.arms)
        out = []
        for rep in range(reps):
            for arm in names[rep % len(names) :] + names[: rep % len(names)]:
                out += [(f"{arm}/{rep}/{w}", arm, rep, w, {**self.fixed, **self.arms[arm]}) for w in widths]
        return out


CORE = {"junctions": True, "nprobe": 8, "recents": 8, "capacity": 2048}
#: The studied grids of entry policies.
EXPERIMENTS = {
    e.name: e
    for e in (
        Experiment("main", {"baseline": {}, "ivf": {"junctions": True, "nprobe": 8}, "core": CORE, "full": {**CORE, "exits": 10}}),
        Experiment("writes", {f"sample{d}": {"exits": 10, "every": d} for d in (1, 2, 4, 10)}, CORE),
        Experiment("starts", {f"k{k}": {"recents": k} for k in (1, 2, 4, 8)}, CORE),
        Experiment("history", {"fifo": {}, "lru": {"policy": "lru"}}, CORE),
        Experiment("capacity", {f"c{c}": {"capacity": c} for c in (256, 512, 1024, 2048, 4096)}, CORE),
        Experiment("probes", {f"r{r}": {"nprobe": r} for r in (1, 2, 4, 8)}, CORE),
    )
}


def streams_of(experiment: str, widths: tuple[int, ...], reps: int = 1, **search):
    """Arguments for the causal replay: stream name -> (routing, walk)."""
    from waymark.operators.search import Routing, Walk

    return {s: (Routing(**p), Walk(width=w, **search)) for s, _, _, w, p in EXPERIMENTS[experiment].streams(widths, reps)}
