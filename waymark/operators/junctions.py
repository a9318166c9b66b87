"""Junction learning from traversal traces: first positions, scores, rankings, budgets, overlaps.

A trace is long form ``(query, pos, id)`` with positions from 0; ``explode_traces`` makes it from
one row per query with an ``ids`` array.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.session import checkpoint

#: Orderings of (score, support): what each ranking sorts by before the id.
SCORES = ("sum", "count", "mean")


def explode_traces(traces: DataFrame) -> DataFrame:
    return traces.select(F.col("query"), F.posexplode("ids").alias("pos", "id"))


def check_contiguous(traces: DataFrame) -> DataFrame:
    """The traces, if their queries are 0..n-1 without gaps or repeats; otherwise an error."""
    n, low, high, distinct = traces.agg(F.count(F.lit(1)), F.min("query"), F.max("query"), F.count_distinct("query")).first()
    if n and (low != 0 or high != n - 1 or distinct != n):
        raise ValueError(f"queries are not 0..{n - 1}: {distinct} distinct from {low} to {high}")
    return traces


def first_positions(steps: DataFrame) -> DataFrame:
    """``(query, id, pos)``: where each query first expanded each vertex."""
    return steps.groupBy("query", "id").agg(F.min("pos").cast("long").alias("pos"))


def scored(steps: DataFrame, include_start: bool = False) -> DataFrame:
    """``(id, score, support)``: sum of first positions and number of queries.

    Starts (position 0) don't count for junctions; hot-cache rankings include them.
    """
    first = first_positions(steps)
    first = first if include_start else first.where("pos > 0")
    return first.groupBy("id").agg(F.sum("pos").cast("long").alias("score"), F.count(F.lit(1)).alias("support"))


def order_of(kind: str) -> list[Column]:
    if kind == "sum":
        return [F.desc("score"), F.desc("support"), F.asc("id")]
    if kind == "count":
        return [F.desc("support"), F.asc("id")]
    if kind == "mean":
        return [F.desc(F.col("score") / F.col("support")), F.desc("support"), F.asc("id")]
    if kind == "hot":
        return [F.desc("support"), F.desc("score"), F.asc("id")]
    raise ValueError(f"an unknown ranking: {kind}")


def dense_index(df: DataFrame, order: list[Column], name: str, start: int = 1) -> DataFrame:
    """Number all rows in a global order without gathering them in one task.

    Rows are dealt by range and written once; numbers are those within a part plus the sizes of the
    parts before, of which there are as many as shuffle partitions.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = checkpoint(df.repartitionByRange(parts, *order).withColumn("__part", F.spark_partition_id()))
    sizes = {r[0]: r[1] for r in dealt.groupBy("__part").count().collect()}
    base, total = {}, start - 1
    for part in sorted(sizes):
        base[part] = total
        total += sizes[part]
    offset = F.create_map(*[F.lit(x) for pair in base.items() for x in pair])[F.col("__part")] if base else F.lit(0)
    own = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    return dealt.withColumn(name, (offset + own).cast("long")).drop("__part")


def cumulated_share(df: DataFrame, order: str, value: str, name: str) -> DataFrame:
    """``df`` with the share of the total of ``value`` in the rows up to each by ``order``, which is distinct.

    As in ``dense_index``, a task sums its range and adds the sums of the ranges before.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = checkpoint(df.repartitionByRange(parts, order).withColumn("__part", F.spark_partition_id()))
    sums = {r[0]: r[1] for r in dealt.groupBy("__part").agg(F.sum(value)).collect()}
    base, total = {}, 0
    for part in sorted(sums):
        base[part] = total
        total += sums[part] or 0
    offset = F.create_map(*[F.lit(x) for pair in base.items() for x in pair])[F.col("__part")] if base else F.lit(0)
    own = F.sum(value).over(Window.partitionBy("__part").orderBy(order))
    return dealt.withColumn(name, (offset + own) / F.lit(total)).drop("__part")


def ranking(scores: DataFrame, kind: str = "sum") -> DataFrame:
    """``scores`` with ``rank`` from 1."""
    return dense_index(scores, order_of(kind), "rank")


def select_budget(ranked: DataFrame, budget: int, strict: bool = False) -> DataFrame:
    """The first ``budget`` ids; with ``strict`` too few eligible ids are an error, else all are taken."""
    if strict and (n := ranked.count()) < budget:
        raise ValueError(f"a budget of {budget} from {n} eligible ids")
    return ranked.where(F.col("rank") <= budget)


def budget_sweep(ranked: DataFrame, budgets: list[int]) -> DataFrame:
    """``(budget, rank, id)``: every prefix of one ranking; each row is repeated only where it belongs."""
    return ranked.select("rank", "id", F.explode(F.array(*map(F.lit, budgets))).alias("budget")).where(F.col("rank") <= F.col("budget")).select("budget", "rank", "id")


def overlap(a: DataFrame, b: DataFrame, budget: int) -> DataFrame:
    """One row: how many of the first ``budget`` ids two rankings share, and the share."""
    both = a.where(F.col("rank") <= budget).select("id").join(b.where(F.col("rank") <= budget).select("id"), "id")
    return both.agg(F.count(F.lit(1)).alias("shared")).withColumn("share", F.col("shared") / F.lit(float(budget)))


def upper_median(column: Column) -> Column:
    """The element ``n // 2`` of the sorted values."""
    values = F.array_sort(F.collect_list(column))
    return F.element_at(values, (F.size(values) / 2).cast("int") + 1)


def ordered_union(*parts: DataFrame) -> DataFrame:
    """``(id, ord)`` of ``(id, ord)`` parts in turn: the first occurrence of an id wins."""
    tagged = [p.select("id", F.struct(F.lit(k).alias("part"), F.col("ord")).alias("at")) for k, p in enumerate(parts)]
    out = tagged[0]
    for t in tagged[1:]:
        out = out.unionByName(t)
    return dense_index(out.groupBy("id").agg(F.min("at").alias("at")), [F.asc("at.part"), F.asc("at.ord"), F.asc("id")], "ord").select("id", "ord")
