import os
import struct

import numpy as np
import pytest

from waymark.sources import binary as B
from waymark.sources import datasets


@pytest.fixture
def vectors(tmp_path):
    path = str(tmp_path / "v.fbin")
    x = np.arange(8, dtype="<f4").reshape(4, 2)
    with open(path, "wb") as f:
        f.write(struct.pack("<II", 4, 2) + x.tobytes())
    return path, x


@pytest.mark.parametrize("kind", ["float32", "uint8"])
def test_slices_keep_bytes(tmp_path, kind):
    item = B.KINDS[kind]
    x = np.arange(8).astype(item).reshape(4, 2)
    source, target = str(tmp_path / "a"), str(tmp_path / "b")
    open(source, "wb").write(struct.pack("<II", 4, 2) + x.tobytes())
    B.slice_vectors(source, target, 1, 2, item.itemsize)
    assert open(target, "rb").read() == struct.pack("<II", 2, 2) + x[1:3].tobytes()
    assert B.checked_shape(target, kind) == (2, 2)


@pytest.mark.parametrize("distances", [False, True])
def test_ground_truth_slices(tmp_path, distances):
    ids = np.arange(12).reshape(4, 3)
    dist = np.linspace(0, 1, 12).reshape(4, 3) if distances else None
    source, target = str(tmp_path / "a"), str(tmp_path / "b")
    B.write_truth(source, ids, dist)
    B.slice_truth(source, target, 2, 2)
    want = str(tmp_path / "c")
    B.write_truth(want, ids[2:], None if dist is None else dist[2:])
    assert open(target, "rb").read() == open(want, "rb").read()
    if not distances:
        with pytest.raises(ValueError, match="no distances"):
            B.slice_truth(source, target, 2, 2, require_distances=True)
        with pytest.raises(ValueError):
            B.check_truth(source, 3)


@pytest.mark.parametrize("raw", [b"", b"\1\0\0", struct.pack("<II", 0, 2), struct.pack("<II", 2, 0)])
def test_bad_headers(tmp_path, raw):
    path = str(tmp_path / "x")
    open(path, "wb").write(raw)
    with pytest.raises(ValueError):
        B.shape(path)


@pytest.mark.parametrize("span", [(-1, 1), (0, 0), (3, 2)])
def test_bad_ranges(vectors, tmp_path, span):
    with pytest.raises(ValueError):
        B.slice_vectors(vectors[0], str(tmp_path / "out"), *span)


def test_a_failed_write_leaves_the_old_file(tmp_path, vectors):
    cut, target = str(tmp_path / "cut"), str(tmp_path / "out")
    open(cut, "wb").write(open(vectors[0], "rb").read()[:-4])
    open(target, "wb").write(b"old")
    with pytest.raises(ValueError):
        B.slice_vectors(cut, target, 2, 2)
    assert open(target, "rb").read() == b"old" and sorted(os.listdir(tmp_path)) == ["cut", "out", "v.fbin"]
    with pytest.raises(ValueError, match="source"):
        B.slice_vectors(vectors[0], vectors[0], 0, 1)


def test_truncated_truth(tmp_path):
    path = str(tmp_path / "x")
    open(path, "wb").write(struct.pack("<II", 2, 2) + b"\0" * 20)
    with pytest.raises(ValueError):
        B.truth_shape(path)


def test_sources(spark, vectors, tmp_path):
    B.register(spark)
    path, x = vectors
    df = spark.read.format("xbin").option("path", path).option("rows", "3").load()
    assert df.rdd.getNumPartitions() == 2
    assert {r.id: r.vec for r in df.collect()} == {k: list(v) for k, v in enumerate(x.tolist())}
    part = spark.read.format("xbin").option("path", path).option("start", "1").option("end", "3").load()
    assert sorted(r.id for r in part.collect()) == [1, 2]
    truth = str(tmp_path / "gt")
    B.write_truth(truth, np.array([[5, 6], [7, 8]]), np.array([[0.5, 0.25], [1, 2]]))
    got = spark.read.format("groundtruth").option("path", truth).load().orderBy("query", "rank").collect()
    assert [tuple(r) for r in got] == [(0, 1, 5, 0.5), (0, 2, 6, 0.25), (1, 1, 7, 1.0), (1, 2, 8, 2.0)]
    back = str(tmp_path / "back")
    assert B.write_vectors(df, back) == 4 and open(back, "rb").read() == open(path, "rb").read()
    with pytest.raises(ValueError):
        B.write_vectors(df.where("id > 0"), back)


def test_routing_files(tmp_path):
    p = str(tmp_path / "f")
    B.write_ranked(p, [3, 9, 5])
    assert B.read_ranked(p) == [3, 9, 5]
    with pytest.raises(ValueError):
        B.write_ranked(p, [3, 3])
    with pytest.raises(ValueError):
        B.write_ranked(p, [1 << 32])
    cells = [(4, [1, 2]), (7, []), (9, [0])]
    B.write_directory(p, cells)
    assert B.read_directory(p, nlist=3, total=6, below=10) == cells
    with pytest.raises(ValueError):
        B.read_directory(p, nlist=4)
    with pytest.raises(ValueError):
        B.read_directory(p, below=9)
    with pytest.raises(ValueError):
        B.write_directory(p, [(4, [1]), (1, [])])
    raw = bytearray(open(p, "rb").read())
    raw[24 + 12 : 24 + 16] = struct.pack("<I", 1)  # the first offset
    open(p, "wb").write(raw)
    with pytest.raises(ValueError, match="offsets"):
        B.read_directory(p)
    B.write_buckets(p, 2, 3, 7, [[1, 2], [], [5], []])
    assert B.read_buckets(p, 2, 3, 7) == [[1, 2], [], [5], []]
    with pytest.raises(ValueError):
        B.read_buckets(p, 2, 3, 8)
    B.write_waypoints(p, [[1], [2, 3]])
    assert B.read_waypoints(p) == [[1], [2, 3]]
    c, v = np.ones((2, 3)), np.zeros((2, 3))
    B.write_portals(p, c, [4, 5], v)
    assert (B.read_portals(p)[0] == c).all() and B.read_portals(p)[1].tolist() == [4, 5]
    B.write_portals(p, c * np.nan, [4, 5], v)
    with pytest.raises(ValueError, match="finite"):
        B.read_portals(p)
    B.write_pool(p, [4, 5], v)
    assert B.read_pool(p)[0].tolist() == [4, 5]
    B.write_starts(p, np.array([[1, 2], [3, 3]]))
    with pytest.raises(ValueError):
        B.read_starts(p)
    open(p, "wb").write(b"\0" * 8 + struct.pack("<10Q", 100, 16, 42, *[0] * 7))
    assert B.graph_header(p, 100, 16)["medoid"] == 42
    with pytest.raises(ValueError):
        B.graph_header(p, 99)


def test_datasets(tmp_path, vectors):
    path, _ = vectors
    out = str(tmp_path / "crop")
    datasets.crop(path, out, 3)
    datasets.crop(path, out, 3)
    assert B.checked_shape(out) == (3, 2)
    raw = open(path, "rb").read()
    target = str(tmp_path / "got")
    with pytest.raises(ValueError):
        datasets.download(lambda a, n: raw[a : a + n] if a < 16 else b"", target, len(raw), 16)
    datasets.download(lambda a, n: raw[a : a + n], target, len(raw), 16)
    assert open(target, "rb").read() == raw
    truth = str(tmp_path / "gt")
    B.write_truth(truth, np.arange(40).reshape(4, 10), np.zeros((4, 10)))
    made = datasets.split_queries(path, truth, str(tmp_path), 2, 2)
    assert B.checked_shape(made["heldout"]) == (2, 2) and B.truth_shape(made["heldout_truth"]) == (2, 10, True)
    assert datasets.DATASETS["coveo"].index_params["chunks"] == 50
