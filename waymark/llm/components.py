"""Connected components of an edge table by alternating star contractions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.session import checkpoint, ship

from .base import EACH, few, settled


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same components as stars: (vertex, root) with the smallest vertex as root."""
    names, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = flat[: len(a)], flat[len(a) :]
    label = np.arange(len(names))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        for end in (x, y):
            np.minimum.at(new, end, low)
            np.minimum.at(new, label[end], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = label != np.arange(len(names))
    return names[moved], names[label[moved]]


def _finish(edges: DataFrame) -> DataFrame:
    """``(v, root)`` of an edge table of one partition, whose rows one task holds."""
    ship(edges.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
        if held:
            v, root = forest(*(np.concatenate(side) for side in zip(*held, strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()), pa.array(root, pa.int64())], ["v", "root"])

    return checkpoint(edges.select("u", "v").mapInArrow(run, "v long, root long")).coalesce(1)


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """Point every neighbour of a vertex at the smallest vertex of its neighbourhood.

    A large star moves the larger neighbours only, a small star the smaller ones and the vertex.
    The minimum is a partial aggregate, so a vertex with very many neighbours costs no task more
    than its own rows, and the join back is one that Spark can split.
    """
    down = F.struct(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    up = F.struct(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
    # Exploded arrays, not unions: a union of single partitions would have to be exchanged again.
    both = edges.select(F.explode(F.array(down) if small else F.array(down, up)).alias("e")).select("e.*")
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    moved = both.join(least, "u")
    if small:
        ends = F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))
        out = moved.select(F.explode(ends).alias("e")).select("e.*")
    else:
        out = moved.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.where("u <> v").distinct()


def components(edges: DataFrame, most: int = 60, each: int = EACH) -> DataFrame:
    """``(v, root)`` for every vertex of ``edges(u, v)`` but the roots; a root is its component's minimum.

    Each round is written to the shared checkpoint folder, and read in as few partitions as its rows
    need. At most ``each`` edges are finished by one task, so that a small table is not exchanged over
    and over in hundreds of almost empty pieces. The loop ends there, or when a round leaves the edges
    as they were, or fails after ``most`` rounds rather than return a partial answer.
    """
    now, rows = settled(edges.where("u <> v").distinct())
    mark = None
    for _ in range(most):
        if rows <= each:
            return _finish(few(now, rows, each))
        now = checkpoint(_star(_star(now, small=False), small=True))
        found = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        rows = found[0]
        now = few(now, rows)
        if tuple(found) == mark:
            return now.select(F.col("u").alias("v"), F.col("v").alias("root"))
        mark = tuple(found)
    raise RuntimeError(f"components did not settle in {most} rounds")
