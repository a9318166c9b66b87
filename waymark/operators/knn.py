"""Exact nearest neighbours, ground truth and recall."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.session import checkpoint, ship

#: Bytes of query vectors that a pass over the base may carry to its tasks.
BLOCK_BYTES = 32 << 20


def matrix(column: pa.Array) -> np.ndarray:
    """A list column of equal lengths as a float64 matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def scores(q: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """Pairwise inner products, or negated squared distances: larger is nearer."""
    if metric == "ip":
        return q @ b.T
    return -((q * q).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (q @ b.T))


def slack(q: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How far apart, at most, rounding can put two equal ``scores`` of each row of ``q``: it grows with the norms."""
    largest = (b * b).sum(1).max(initial=0.0)
    return 8 * np.finfo(np.float64).eps * max(1, q.shape[1]) * ((q * q).sum(1)[:, None] + largest) + 1e-12


def _best(s: np.ndarray, k: int, margin: np.ndarray) -> np.ndarray:
    """Columns of the k best of each row, with all that rounding may have put behind the last."""
    if s.shape[1] <= k:
        return np.ones(s.shape, bool)
    last = -np.partition(-s, k - 1, axis=1)[:, k - 1 : k]
    return s >= last - margin


def nearest(queries: DataFrame, base: DataFrame, k: int, metric: str = "ip", id_col: str = "id", vec_col: str = "vec", block_bytes: int = BLOCK_BYTES, exclude_self: bool = True) -> DataFrame:
    """``(query, rank, id, score)``: the k nearest base rows of every query, ties by id.

    Queries are taken in blocks of at most ``block_bytes``, whose vectors go to the tasks of one
    pass over the base; the number of blocks comes from a count. With several blocks each pass is
    written out and its vectors are freed before the next, so that what the driver and the tasks hold
    is bounded at any size. Each task keeps its k best for each query, the rest is a partial top-k by
    window. Null vectors, and those of another length than the longest query's, have no neighbours and
    are none.
    """
    spark = ship(queries.sparkSession)
    q = queries.select(queries[id_col].cast("long").alias("id"), queries[vec_col].alias("vec"))
    b = base.select(base[id_col].cast("long").alias("id"), base[vec_col].alias("vec"))
    stats = q.agg(F.count(F.lit(1)), F.max(F.size("vec"))).first()
    n, dim = stats[0], stats[1] or 1
    q, b = (x.where(F.size("vec") == dim) for x in (q, b))
    blocks = max(1, -(-n * dim * 16 // block_bytes))
    passes = []
    for block in range(blocks):
        own = q if blocks == 1 else q.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == block)
        held = own.orderBy("id").toArrow()
        if not held.num_rows:
            continue
        sent = spark.sparkContext.broadcast((held.column("id").to_numpy(), matrix(held.column("vec"))))

        def part(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            qid, qv = sent.value
            for batch in batches:
                if not batch.num_rows:
                    continue
                ids, vecs = batch.column(0).to_numpy(zero_copy_only=False), matrix(batch.column(1))
                for at in range(0, len(qid), 512):
                    s = scores(qv[at : at + 512], vecs, metric)
                    if exclude_self:
                        s[qid[at : at + 512, None] == ids[None, :]] = -np.inf
                    i, j = np.nonzero(_best(s, k, slack(qv[at : at + 512], vecs)) & np.isfinite(s))
                    # Exact scores in element order, whatever the matrix product rounded.
                    a, c = qv[at + i], vecs[j]
                    terms = a * c if metric == "ip" else (a - c) ** 2
                    exact = np.zeros(len(i))
                    for d in range(terms.shape[1]):
                        exact += terms[:, d]
                    yield pa.RecordBatch.from_arrays([pa.array(qid[at + i]), pa.array(ids[j]), pa.array(exact)], ["query", "id", "score"])

        found = b.mapInArrow(part, "query long, id long, score double")
        if blocks > 1:
            found = checkpoint(found)
            sent.destroy()
        passes.append(found)
    if not passes:
        return spark.createDataFrame([], "query long, rank long, id long, score double")
    found = passes[0]
    for more in passes[1:]:
        found = found.unionByName(more)
    order = F.desc("score") if metric == "ip" else F.asc("score")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(order, "id")))
    return ranked.where(F.col("rank") <= k).select("query", F.col("rank").cast("long").alias("rank"), "id", "score")


def top_by(df: DataFrame, key: list[str] | str, order: list[Column], k: int, name: str = "rank") -> DataFrame:
    """The first k rows of each key in ``order``, numbered from 1; Spark limits each partition first."""
    key = [key] if isinstance(key, str) else key
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*key).orderBy(*order)).cast("long")).where(F.col(name) <= k)


def recall(result: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """``(query, recall)``: the percentage of a query's first k true neighbours among its first k results."""
    want = truth.where(F.col("rank") <= k).select("query", "id")
    got = result.where(F.col("rank") <= k).select("query", "id").distinct().withColumn("hit", F.lit(1))
    return want.join(got, ["query", "id"], "left").groupBy("query").agg((F.count("hit") * 100.0 / k).alias("recall"))
