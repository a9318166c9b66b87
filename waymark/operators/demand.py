"""Demand streams: ordering, gaps, repeats, coverage, splits, windows, catalogues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.functions import vec

from .junctions import dense_index


def numbered(events: DataFrame, order: list[str], name: str = "query") -> DataFrame:
    """A dense index from 0 in a stable global order."""
    return dense_index(events, [F.asc(c) for c in order], name, start=0)


def gaps(events: DataFrame, key: list[str], order: list[str], at: Column) -> DataFrame:
    """``events`` with ``gap``: the step of ``at`` from the row before, null for the first."""
    return events.withColumn("gap", at - F.lag(at).over(Window.partitionBy(*key).orderBy(*order)))


def quantile_map(df: DataFrame, column: str, points: tuple[float, ...] = (0, 0.1, 0.25, 0.5, 0.75, 0.9, 0.99, 1)) -> DataFrame:
    """``(q, value)``: exact interpolated quantiles; no rows if there are no values."""
    got = df.agg(F.percentile(column, F.array(*map(F.lit, map(float, points)))).alias("v"))
    pairs = F.arrays_zip(F.array(*map(F.lit, map(float, points))).alias("q"), F.col("v").alias("value"))
    return got.where("v is not null").select(F.explode(pairs).alias("p")).select("p.q", "p.value")


def repeats(events: DataFrame, key: list[str], index: str) -> DataFrame:
    """``events`` with ``distance``: how far back the same key occurred, null at its first."""
    return events.withColumn("distance", F.col(index) - F.lag(index).over(Window.partitionBy(*key).orderBy(index)))


def mapped(rows: DataFrame, list_col: str, mapping: DataFrame, key: str = "key", id_col: str = "id") -> DataFrame:
    """``rows`` with ``ids``: list elements looked up in ``mapping(key, id)``; unmatched ones are
    dropped, the order of the list is kept."""
    each = rows.select("query", F.posexplode(list_col).alias("pos", key))
    found = each.join(mapping, key).groupBy("query").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", id_col))), lambda s: s[id_col]).alias("ids"))
    return rows.join(found, "query", "left").withColumn("ids", F.coalesce("ids", F.array().cast(found.schema["ids"].dataType)))


def coverage(found: Column, wanted: Column) -> Column:
    """A share, null where nothing was wanted."""
    return F.try_divide(found.cast("double"), wanted.cast("double"))


def split(rows: DataFrame, index: str, sizes: dict[str, int]) -> DataFrame:
    """``rows`` with ``split``: consecutive ranges of the index; rows beyond them are dropped."""
    name, start = F.lit(None).cast("string"), 0
    for k, n in sizes.items():
        name = F.when((F.col(index) >= start) & (F.col(index) < start + n), F.lit(k)).otherwise(name)
        start += n
    return rows.withColumn("split", name).where("split is not null")


def windows(rows: DataFrame, index: str, histories: list[int], measure: int) -> DataFrame:
    """Each row in each (history, role) it belongs to: ``warmup`` before the history's length,
    ``measured`` in the ``measure`` rows from there on."""
    each = rows.withColumn("history", F.explode(F.array(*map(F.lit, histories))))
    role = F.when(F.col(index) < F.col("history"), "warmup").when(F.col(index) < F.col("history") + measure, "measured")
    return each.withColumn("role", role).where("role is not null")


def locality_pool(n: int, pool: int, total: int, seed: int = 1) -> list[int]:
    """Replay order: permutations of a working set of ``pool`` of ``n`` rows, repeated up to ``total``.

    Permutations come from numpy's generator on the driver; ``total`` bounds them.
    """
    import numpy as np

    rng = np.random.default_rng(seed)
    rows = rng.permutation(n)[:pool]
    out: list[int] = []
    while len(out) < total:
        out += rng.permutation(rows).tolist()
    return out[:total]


def catalogue(raw: DataFrame, key: str = "product_sku_hash", literal: str = "description_vector", row: str = "source_row") -> DataFrame:
    """``(id, key, vec)`` in source order: rows without a vector or of zero norm are dropped, an
    empty or repeated key is an error, ids are dense."""
    parsed = raw.select(F.col(row), F.col(key).alias("key"), vec.parse_vector(F.col(literal)).alias("vec"))
    parsed = parsed.withColumn("key", F.when(F.trim(F.coalesce("key", F.lit(""))) == "", F.raise_error(F.lit("an empty key")).cast("string")).otherwise(F.col("key")))
    kept = parsed.where(F.col("vec").isNotNull()).where(vec.norm(F.col("vec")) > 0)
    if kept.groupBy("key").count().where("count > 1").limit(1).count():
        raise ValueError("a key that occurs twice")
    return dense_index(kept, [F.asc(row)], "id", start=0).select("id", "key", vec.normalize(F.col("vec")).alias("vec"))


def read_queries(raw: DataFrame, mapping: DataFrame, dim: int, row: str = "source_row") -> DataFrame:
    """Search events as ``query, timestamp_ms, session_id_hash, source_row, vec, clicked_product_ids,
    returned_product_ids``: rows without a vector are dropped, the rest is numbered by time and row."""
    v = raw.select("session_id_hash", F.col("server_timestamp_epoch_ms").cast("long").alias("timestamp_ms"), F.col(row).alias("source_row"), vec.parse_vector(F.col("query_vector"), dim).alias("vec"), vec.parse_list(F.col("clicked_skus_hash")).alias("clicked"), vec.parse_list(F.col("product_skus_hash")).alias("returned")).where("vec is not null")
    v = numbered(v.withColumn("vec", vec.normalize(F.col("vec"))), ["timestamp_ms", "source_row"])
    for kind in ("clicked", "returned"):
        v = mapped(v, kind, mapping.select("key", "id")).withColumnRenamed("ids", f"{kind}_product_ids").drop(kind)
    return v
