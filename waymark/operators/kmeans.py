"""Assignment to centres, Lloyd iterations with given starts, medoids and bucket statistics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waymark.functions import vec
from waymark.session import ship

from .knn import matrix, scores, slack

#: Centres that are sent to the tasks at most; a directory has 512.
MOST_CENTRES = 65_536


def small(df: DataFrame, most: int = MOST_CENTRES) -> DataFrame:
    """A side for broadcasting, after its size has been checked."""
    if df.limit(most + 1).count() > most:
        raise ValueError(f"over {most} rows to broadcast")
    return F.broadcast(df)


def centre_matrix(centres: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Cells and vectors of ``centres(cell, vec)``, in cell order; too many are an error."""
    held = centres.select(F.col("cell").cast("long"), "vec").orderBy("cell").limit(MOST_CENTRES + 1).toArrow()
    if held.num_rows > MOST_CENTRES:
        raise ValueError(f"over {MOST_CENTRES} centres")
    return held.column(0).to_numpy(), matrix(held.column(1))


def assign(points: DataFrame, centres: DataFrame, metric: str = "ip") -> DataFrame:
    """``(id, cell, score)`` of ``points(id, vec)``: the best centre, the first of equals.

    Centres go to the tasks (their number is checked); points are never shuffled.
    """
    sent = ship(points.sparkSession).sparkContext.broadcast(centre_matrix(centres))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, c = sent.value
        for batch in batches:
            if batch.num_rows and len(cells):
                x = matrix(batch.column(1))
                # Equal centres must tie exactly, so the few near-best are scored in element order.
                s = scores(x, c, metric)
                near = s >= s.max(axis=1, keepdims=True) - slack(x, c)
                i, j = np.nonzero(near)
                terms = x[i] * c[j] if metric == "ip" else -((x[i] - c[j]) ** 2)
                exact = np.zeros(len(i))
                for d in range(terms.shape[1]):
                    exact += terms[:, d]
                order = np.lexsort((j, -exact, i))
                first = order[np.unique(i[order], return_index=True)[1]]
                best = exact[first] if metric == "ip" else -exact[first]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cells[j[first]]), pa.array(best)], ["id", "cell", "score"])

    return points.select(F.col("id").cast("long"), "vec").mapInArrow(run, "id long, cell long, score double")


def sample_points(points: DataFrame, most: int, seed: int = 1) -> DataFrame:
    """About ``most`` of ``points(id, vec)``, by a hash of the id: the same ones in every run."""
    share = min(1.0, most / max(1, points.count()))
    return points.where(F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(1 << 30)) < int(share * (1 << 30)))


def means(points: DataFrame, cells: DataFrame, spherical: bool) -> DataFrame:
    """``(cell, vec)``: the mean of each cell's points, scaled to unit length if ``spherical``."""
    each = points.select("id", "vec").join(cells.select("id", "cell"), "id").select("cell", F.posexplode("vec").alias("pos", "x"))
    mean = each.groupBy("cell", "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    packed = mean.groupBy("cell").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("vec"))
    return packed.select("cell", vec.normalize(F.col("vec"), zero="keep").alias("vec")) if spherical else packed


def lloyd(points: DataFrame, starts: DataFrame, iterations: int = 5, metric: str = "ip") -> tuple[DataFrame, DataFrame]:
    """(centres, assignment) after the iterations and a last assignment.

    ``starts(cell, vec)`` are the initial centres. A cell that loses all its points takes the point
    of the smallest hash of (id, cell, round), instead of a random row.
    """
    spark = points.sparkSession
    centres = starts
    for k in range(iterations):
        moved = means(points, assign(points, centres, metric), metric == "ip")
        held = {int(r[0]): r[1] for r in moved.collect()}  # as many as there are centres
        cells, _ = centre_matrix(centres)
        for cell in map(int, cells):
            if cell not in held:
                row = points.orderBy(F.xxhash64("id", F.lit(cell), F.lit(k)), "id").select("vec").first()
                held[cell] = [float(x) for x in row[0]]
        centres = spark.createDataFrame(sorted(held.items()), "cell long, vec array<double>")
    return centres, assign(points, centres, metric)


def medoids(points: DataFrame, cells: DataFrame, centres: DataFrame, metric: str = "ip") -> DataFrame:
    """``(cell, id)``: the member nearest to its centre, ties by id."""
    joined = points.select("id", "vec").join(cells.select("id", "cell"), "id").join(centres.select("cell", F.col("vec").alias("centre")), "cell")
    away = -vec.dot(F.col("vec"), F.col("centre")) if metric == "ip" else vec.l2sq(F.col("vec"), F.col("centre"))
    return joined.select("cell", "id", away.alias("away")).groupBy("cell").agg(F.min_by("id", F.struct("away", "id")).alias("id"))


def check_medoids(found: DataFrame, nlist: int) -> DataFrame:
    """The medoids, if every one of ``nlist`` cells has one of its own."""
    n, distinct = found.agg(F.count(F.lit(1)), F.count_distinct("id")).first()
    if n != nlist:
        raise ValueError(f"{nlist - n} empty cells")
    if distinct != n:
        raise ValueError("a medoid of two cells")
    return found


def buckets(ranked: DataFrame, points: DataFrame, medoid: DataFrame, metric: str = "ip") -> DataFrame:
    """``(cell, medoid_id, pos, id)``: every ranked id in the bucket of its nearest medoid, in rank
    order and without the medoids themselves."""
    points = points.select("id", "vec")
    centres = medoid.join(points, "id").select("cell", "vec")
    cells = assign(ranked.select("id").join(points, "id").select("id", "vec"), centres, metric)
    inside = cells.join(ranked, "id").join(small(medoid.select("id")), "id", "left_anti")
    pos = (F.row_number().over(Window.partitionBy("cell").orderBy("rank", "id")) - 1).cast("long")
    return inside.join(small(medoid.select("cell", F.col("id").alias("medoid_id"))), "cell").select("cell", "medoid_id", pos.alias("pos"), "id")


def spread(values: DataFrame, column: str, quantiles: tuple[float, ...] = (0.5, 0.95)) -> DataFrame:
    """min, max, mean and exact interpolated quantiles of a column, as one row."""
    named = [F.percentile(column, F.lit(q)).alias(f"q{round(q * 1000)}") for q in quantiles]
    return values.agg(F.min(column).alias("low"), F.max(column).alias("high"), F.avg(column).alias("mean"), *named)
