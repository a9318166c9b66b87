"""Exact neighbours where rounding is large, in blocks, and with rows that have no usable vector."""

import numpy as np

from waymark.operators import kmeans, knn


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [float(x) for x in v]) for i, v in rows], "id long, vec array<double>").repartition(3)


def plain(q, b, k):
    out = {}
    for i, v in q:
        near = sorted((float(sum((x - y) ** 2 for x, y in zip(v, w, strict=True))), j) for j, w in b if j != i)
        out[i] = [j for _, j in near[:k]]
    return out


def test_near_ties_of_large_vectors(spark):
    """A common offset makes the expanded square lose nine digits; no neighbour is lost for it."""
    rng = np.random.default_rng(5)
    centre = rng.normal(size=16)
    points = [(i, 1e4 + centre + 1e-6 * rng.normal(size=16)) for i in range(240)]
    queries = points[::12]
    want = plain(queries, points, 10)
    for blocks in (knn.BLOCK_BYTES, 5 * 16 * 16):
        got = {}
        for r in knn.nearest(frame(spark, queries), frame(spark, points), 10, "l2", block_bytes=blocks).orderBy("query", "rank").collect():
            got.setdefault(r.query, []).append(r.id)
        assert got == want
    centres = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in points[:40]], "cell long, vec array<double>")
    cells = {r.id: r.cell for r in kmeans.assign(frame(spark, points), centres, "l2").collect()}
    assert cells == {i: min((float(sum((x - y) ** 2 for x, y in zip(v, w, strict=True))), c) for c, w in points[:40])[1] for i, v in points}


def test_rows_without_a_usable_vector(spark):
    points = [(0, [0, 0]), (1, [1, 0]), (2, None), (3, [1]), (4, [5, 5])]
    got = knn.nearest(frame(spark, points), frame(spark, points), 2, "l2").collect()
    assert sorted((r.query, r.rank, r.id) for r in got) == [(0, 1, 1), (0, 2, 4), (1, 1, 0), (1, 2, 4), (4, 1, 1), (4, 2, 0)]
