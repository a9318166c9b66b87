"""Entry selection: directory probes, recent starts, hashed buckets, portals, pools and gates.

Candidate tables are long form ``(query, id, d, ...)`` with ``d`` a distance: smaller is nearer.
Ties are always broken as each policy states.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.functions import vec
from waymark.operators.junctions import dense_index
from waymark.operators.kmeans import small


def distance(a: Column, b: Column, metric: str = "ip") -> Column:
    return -vec.dot(a, b) if metric == "ip" else vec.l2sq(a, b)


def score_all(queries: DataFrame, few: DataFrame, metric: str = "ip") -> DataFrame:
    """Every query against a small checked table ``few(id, vec, ...)``: adds ``d``."""
    named = queries.select("query", F.col("vec").alias("__q"))
    return named.join(small(few), F.lit(True)).withColumn("d", distance(F.col("__q"), F.col("vec"), metric)).drop("__q", "vec")


def probe(queries: DataFrame, medoids: DataFrame, nprobe: int, metric: str = "ip") -> DataFrame:
    """``(query, cell, medoid_id, d, rank)``: the nearest regions by (distance, cell)."""
    scored = score_all(queries, medoids, metric).withColumnRenamed("id", "medoid_id")
    w = Window.partitionBy("query").orderBy("d", "cell")
    return scored.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= nprobe).select("query", "cell", "medoid_id", "d", "rank")


def winner(queries: DataFrame, probed: DataFrame, members: DataFrame, metric: str = "ip") -> DataFrame:
    """``(query, id, d)``: the nearest member of the probed cells by (distance, id).

    ``members(cell, id, vec)`` hold medoids and children. Only probed cells are scored.
    """
    pairs = probed.select("query", "cell").join(members, "cell").join(queries.select("query", F.col("vec").alias("__q")), "query")
    pairs = pairs.withColumn("d", distance(F.col("__q"), F.col("vec"), metric)).where(F.col("id") != F.col("query"))
    return pairs.groupBy("query").agg(F.min(F.struct("d", "id")).alias("best")).select("query", "best.id", "best.d")


def recent_starts(candidates: DataFrame, junction: DataFrame, k: int, pool: int = 10) -> DataFrame:
    """``(query, pos, id)``: of the ``pool`` nearest recent ids the first k, then without the junction.

    A junction among them is dropped and not replaced, so k - 1 starts may be left.
    """
    ranked = candidates.withColumn("pos", F.row_number().over(Window.partitionBy("query").orderBy("d", "id")).cast("long"))
    kept = ranked.where(F.col("pos") <= min(k, pool)).join(junction.select("query", F.col("id").alias("junction")), "query", "left")
    return kept.where(~F.col("id").eqNullSafe(F.col("junction"))).select("query", "pos", "id")


def bucket_starts(queries: DataFrame, table: DataFrame, base: DataFrame | None = None) -> DataFrame:
    """``(query, id)``: the ids of each query's hash bucket, with the base start if there is one."""
    own = queries.select("query", "bucket").join(table.select("bucket", "id"), "bucket").select("query", "id")
    return (own if base is None else own.unionByName(base.select("query", "id"))).distinct()


def portal(queries: DataFrame, portals: DataFrame, nprobe: int) -> DataFrame:
    """``(query, id, ip)``: top cells by inner product with their centres (an earlier cell wins a
    tie), then the best portal (an earlier cell in that order wins)."""
    centres = score_all(queries, portals.select("cell", F.col("center").alias("vec"), "id", "portal_vec"))
    coarse = centres.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy("d", "cell"))).where(F.col("rank") <= nprobe)
    fine = coarse.join(queries.select("query", F.col("vec").alias("__q")), "query").withColumn("ip", vec.dot(F.col("__q"), F.col("portal_vec")))
    return fine.groupBy("query").agg(F.min(F.struct((-F.col("ip")).alias("d"), "rank", "id")).alias("best")).select("query", "best.id", (-F.col("best.d")).alias("ip"))


def pool_entry(queries: DataFrame, pool: DataFrame, metric: str = "ip") -> DataFrame:
    """``(query, id, d)``: the best of a pool ``(pos, id, vec)``; the first of equals."""
    return score_all(queries, pool, metric).groupBy("query").agg(F.min(F.struct("d", "pos", "id")).alias("best")).select("query", "best.id", "best.d")


def waypoints(routed: DataFrame, table: DataFrame, most: int, more: DataFrame | None = None) -> DataFrame:
    """``(query, id)``: the routed portal and the first waypoints of its cell, without repeats."""
    own = routed.join(table.where(F.col("pos") < most).select("cell", F.col("id").alias("waypoint")), "cell").select("query", F.col("waypoint").alias("id"))
    out = routed.select("query", "id").unionByName(own)
    return (out if more is None else out.unionByName(more.select("query", "id"))).distinct()


def precedence(*starts: Column) -> Column:
    """The first start list that is neither null nor empty."""
    return F.coalesce(*[F.when(F.size(s) > 0, s) for s in starts])


def check_starts(df: DataFrame, column: str = "starts") -> DataFrame:
    """Start lists, of which one with a repeated id is an error."""
    bad = F.size(column) != F.size(F.array_distinct(column))
    return df.withColumn(column, F.when(bad, F.raise_error(F.lit("a start that occurs twice")).cast(df.schema[column].dataType)).otherwise(F.col(column)))


def diverse(candidates: DataFrame, novelty_of: str = "novelty", pool: int = 24, share: float = 0.35) -> DataFrame:
    """``(query, id)``: of the nearest ``pool`` the first whose novelty is at least ``share`` of the
    native best (or of 1, if that is less). Rows need ``native_best``; a candidate on a page that is
    already held has novelty -1."""
    ranked = candidates.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy("d", "id"))).where(F.col("rank") <= pool)
    fit = ranked.where(F.col(novelty_of) >= share * F.greatest(F.lit(1.0), F.col("native_best")))
    return fit.groupBy("query").agg(F.min_by("id", "rank").alias("id"))


def coverage(candidates: DataFrame, policy: int = 1) -> DataFrame:
    """``(query, id)``: among candidates within max(0.001, twice the best distance) the one of
    largest novelty (1), or of largest novelty per distance (2); ties by (d, id)."""
    best = F.min("d").over(Window.partitionBy("query"))
    near = candidates.withColumn("best", best).where(F.col("d") <= F.greatest(F.lit(0.001), 2 * F.col("best")))
    value = F.col("novelty") if policy == 1 else F.col("novelty") / F.greatest(F.col("d"), F.lit(1e-12))
    return near.groupBy("query").agg(F.min_by("id", F.struct((-value).alias("v"), "d", "id")).alias("id"))


def same_page(a: Column, b: Column, nodes_per_page: int) -> Column:
    return F.floor(a / nodes_per_page) == F.floor(b / nodes_per_page)


def gate_threshold(warmup: DataFrame, column: str, keep: int = 50) -> DataFrame:
    """One row: the order statistic above which ``keep`` percent of warm-up queries lie (50: index
    n/2, 25: index 3n/4). It is an element of the data, never interpolated."""
    at = {50: (1, 2), 25: (3, 4)}[keep]
    n = warmup.count()
    # No task holds more than its range of the order.
    ranked = dense_index(warmup.select(F.col(column).alias("value")), [F.asc("value")], "at", 0)
    return ranked.where(F.col("at") == n * at[0] // at[1]).agg(F.max("value").alias("threshold"))


def native_rank(d: Column, native: Column) -> Column:
    """1 + how many native starts are as near or nearer."""
    return F.lit(1) + F.size(F.filter(native, lambda x: x <= d))
