"""Product quantisation: codebooks, codes, per-query tables and bulk distances."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.functions import vec
from waymark.session import ship

from .kmeans import lloyd
from .knn import matrix


def train(points: DataFrame, parts: int, size: int, iterations: int = 5, dim: int | None = None) -> np.ndarray:
    """Codebook (parts, size, width): per part the Lloyd centres from the first ids' subvectors."""
    dim = dim or len(points.select("vec").first()[0])
    width = dim // parts
    book = np.zeros((parts, size, width))
    for k in range(parts):
        sub = points.select("id", vec.subvector(F.col("vec"), k, width).alias("vec"))
        starts = sub.orderBy("id").limit(size).collect()
        first = points.sparkSession.createDataFrame([(j, [float(x) for x in r["vec"]]) for j, r in enumerate(starts)], "cell long, vec array<double>")
        centres, _ = lloyd(sub, first, iterations, "l2")
        for r in centres.collect():
            book[k, r["cell"]] = r["vec"]
    return book


def encode(points: DataFrame, book: np.ndarray) -> DataFrame:
    """``(id, code array<int>)``: in each part the nearest codeword, the first of equals."""
    sent = ship(points.sparkSession).sparkContext.broadcast(book)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size, width = sent.value.shape
        for batch in batches:
            x = matrix(batch.column(1)).reshape(batch.num_rows, parts, width)
            d = np.zeros((batch.num_rows, parts, size))
            for j in range(width):
                d += (x[:, :, None, j] - sent.value[None, :, :, j]) ** 2
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(d.argmin(axis=2).astype(np.int32)), pa.list_(pa.int32()))], ["id", "code"])

    return points.select("id", "vec").mapInArrow(run, "id long, code array<int>")


def tables(query: np.ndarray, book: np.ndarray, metric: str = "l2") -> np.ndarray:
    """A query's table (parts, size): partial distances to every codeword."""
    q = query.reshape(book.shape[0], 1, book.shape[2])
    return -(q * book).sum(axis=2) if metric == "ip" else ((q - book) ** 2).sum(axis=2)


def scan(queries: DataFrame, codes: DataFrame, book: np.ndarray, metric: str = "l2", k: int = 10, block_rows: int = 4096) -> DataFrame:
    """``(query, id, d)``: the k nearest codes of each query by table sums, per task; a final
    top-k is left to the caller. Queries are taken in hashed blocks of about ``block_rows``, a pass
    over the codes for each, so that what goes to the tasks is bounded at any number of them."""
    spark = ship(codes.sparkSession)
    named = queries.select("query", "vec")
    blocks = max(1, -(-named.count() // block_rows))
    passes = []
    for block in range(blocks):
        own = named if blocks == 1 else named.where(F.pmod(F.xxhash64("query"), F.lit(blocks)) == block)
        held = own.orderBy("query").toArrow()
        if not held.num_rows and (passes or block < blocks - 1):
            continue
        ids, vecs = held.column(0).to_numpy(), matrix(held.column(1))
        luts = np.stack([tables(v, book, metric) for v in vecs]) if len(vecs) else np.zeros((0, *book.shape[:2]))
        sent = spark.sparkContext.broadcast((ids, luts))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            names, table = sent.value
            for batch in batches:
                code = matrix(batch.column(1)).astype(np.int64)
                for q, lut in zip(names, table, strict=True):
                    d = np.zeros(len(code))
                    for j in range(code.shape[1]):
                        d += lut[j, code[:, j]]
                    keep = np.lexsort((batch.column(0).to_numpy(), d))[:k]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keep), q)), batch.column(0).take(pa.array(keep)), pa.array(d[keep])], ["query", "id", "d"])

        passes.append(codes.select("id", "code").mapInArrow(run, "query long, id long, d double"))
    return reduce(DataFrame.unionByName, passes)
