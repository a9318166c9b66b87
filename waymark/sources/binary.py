"""Strict readers and writers of the binary vector, ground-truth and routing files.

Files are opened through ``pyarrow.fs``, so a path may be local or any store it knows; readers take
byte ranges, so that a large file is read by many tasks. Nothing is inferred: a magic, a header or a
length that is off is an error.
"""

from __future__ import annotations

import os
import struct
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from waymark.session import ship

#: The magics of the routing files.
RANKED, DIRECTORY, BUCKETS, PORTALS, WAYPOINTS, POOL = b"GIDST001", b"GHIVF001", b"GICAT001", b"GIPIP001", b"GIWPT001", b"GQSEV001"
CHUNK = 1 << 20
KINDS = {"float32": np.dtype("<f4"), "uint8": np.dtype("u1")}


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path else os.path.abspath(path))


def size_of(path: str) -> int:
    store, at = opened(path)
    info = store.get_file_info(at)
    if info.type != fs.FileType.File:
        raise FileNotFoundError(path)
    return info.size


def read_range(path: str, start: int, size: int) -> bytes:
    """Exactly ``size`` bytes, or an error."""
    store, at = opened(path)
    with store.open_input_file(at) as f:
        raw = f.read_at(size, start)
    if len(raw) != size:
        raise ValueError(f"{path}: {len(raw)} of {size} bytes at {start}")
    return raw


@contextmanager
def atomic(path: str) -> Iterator:
    """A local file that replaces ``path`` only when all was written; a failure leaves the old one."""
    folder = os.path.dirname(os.path.abspath(path))
    fd, temp = tempfile.mkstemp(dir=folder, prefix=".part-")
    try:
        with os.fdopen(fd, "wb") as out:
            yield out
        os.replace(temp, path)
    except BaseException:
        if os.path.exists(temp):
            os.unlink(temp)
        raise


def copy_bytes(source: str, out, start: int, size: int) -> None:
    """Copy a byte range in bounded chunks; a source that ends early is an error."""
    done = 0
    while done < size:
        part = read_range(source, start + done, min(CHUNK, size - done))
        out.write(part)
        done += len(part)


def shape(path: str) -> tuple[int, int]:
    """Rows and dimensions of a vector file, from its header only."""
    if size_of(path) < 8:
        raise ValueError(f"{path}: a short header")
    rows, dim = struct.unpack("<II", read_range(path, 0, 8))
    if not rows or not dim:
        raise ValueError(f"{path}: an empty shape {rows} x {dim}")
    return rows, dim


def checked_shape(path: str, kind: str = "float32", least: int = 1) -> tuple[int, int]:
    """The shape, if the file's length is what it says and it has ``least`` rows."""
    rows, dim = shape(path)
    if size_of(path) != 8 + rows * dim * KINDS[kind].itemsize:
        raise ValueError(f"{path}: not {rows} x {dim} of {kind}")
    if rows < least:
        raise ValueError(f"{path}: {rows} rows, not {least}")
    return rows, dim


def check_slice(source: str, target: str, start: int, count: int, rows: int) -> None:
    if os.path.abspath(source) == os.path.abspath(target):
        raise ValueError("the target is the source")
    if start < 0 or count <= 0 or start + count > rows:
        raise ValueError(f"rows {start} to {start + count} of {rows}")


def slice_vectors(source: str, target: str, start: int, count: int, itemsize: int = 4) -> None:
    """Write rows ``start`` to ``start + count`` byte by byte as they are."""
    rows, dim = shape(source)
    check_slice(source, target, start, count, rows)
    with atomic(target) as out:
        out.write(struct.pack("<II", count, dim))
        copy_bytes(source, out, 8 + start * dim * itemsize, count * dim * itemsize)


def truth_shape(path: str) -> tuple[int, int, bool]:
    """Queries, neighbours, and whether distances follow the ids; only the two exact lengths are legal."""
    queries, k = shape(path)
    size, block = size_of(path), queries * k * 4
    if size not in (8 + block, 8 + 2 * block):
        raise ValueError(f"{path}: neither ids nor ids and distances of {queries} x {k}")
    return queries, k, size == 8 + 2 * block


def slice_truth(source: str, target: str, start: int, count: int, require_distances: bool = False) -> None:
    queries, k, distances = truth_shape(source)
    if require_distances and not distances:
        raise ValueError(f"{source}: no distances")
    check_slice(source, target, start, count, queries)
    with atomic(target) as out:
        out.write(struct.pack("<II", count, k))
        for block in range(2 if distances else 1):
            copy_bytes(source, out, 8 + (block * queries + start) * k * 4, count * k * 4)


def check_truth(path: str, least: int = 10) -> tuple[int, int]:
    """A public ground truth: both blocks, at least ``least`` neighbours."""
    queries, k, distances = truth_shape(path)
    if not distances or k < least:
        raise ValueError(f"{path}: {k} neighbours, {'with' if distances else 'without'} distances")
    return queries, k


class RowRange(InputPartition):
    def __init__(self, start: int, count: int):
        super().__init__((start, count))
        self.start, self.count = start, count


class _Rows(DataSourceReader):
    """Row ranges of one file, ``rows`` option rows to a task."""

    def __init__(self, options: dict):
        self.path, self.kind = options["path"], options.get("kind", "float32")
        self.each = int(options.get("rows", 65_536))
        self.first, self.last = int(options.get("start", 0)), options.get("end")

    def bounds(self) -> tuple[int, int]:
        raise NotImplementedError

    def partitions(self) -> list[RowRange]:
        rows, _ = self.bounds()
        end = rows if self.last is None else min(rows, int(self.last))
        return [RowRange(a, min(self.each, end - a)) for a in range(self.first, end, self.each)]


class VectorReader(_Rows):
    def bounds(self) -> tuple[int, int]:
        return checked_shape(self.path, self.kind)

    def read(self, part: RowRange) -> Iterator[pa.RecordBatch]:
        _, dim = self.bounds()
        item = KINDS[self.kind]
        for at in range(part.start, part.start + part.count, 8192):
            n = min(8192, part.start + part.count - at)
            flat = np.frombuffer(read_range(self.path, 8 + at * dim * item.itemsize, n * dim * item.itemsize), item).astype(np.float32)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * dim), pa.array(flat))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(at, at + n, dtype=np.int64)), lists], ["id", "vec"])


class VectorSource(DataSource):
    """``spark.read.format("xbin")``: options ``path``, ``kind`` (float32, uint8), ``start``, ``end``,
    ``rows`` a task. The id is the row number."""

    @classmethod
    def name(cls) -> str:
        return "xbin"

    def schema(self) -> str:
        return "id long, vec array<float>"

    def reader(self, schema) -> VectorReader:
        return VectorReader(self.options)


class TruthReader(_Rows):
    def bounds(self) -> tuple[int, int]:
        return truth_shape(self.path)[:2]

    def read(self, part: RowRange) -> Iterator[pa.RecordBatch]:
        queries, k, distances = truth_shape(self.path)
        n = part.count * k
        ids = np.frombuffer(read_range(self.path, 8 + part.start * k * 4, n * 4), "<u4").astype(np.int64)
        dist = pa.nulls(n, pa.float32())
        if distances:
            dist = pa.array(np.frombuffer(read_range(self.path, 8 + (queries + part.start) * k * 4, n * 4), "<f4"))
        q = np.repeat(np.arange(part.start, part.start + part.count, dtype=np.int64), k)
        yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), part.count)), pa.array(ids), dist], ["query", "rank", "id", "dist"])


class TruthSource(DataSource):
    """``spark.read.format("groundtruth")``: ranks from 1; ``dist`` is null without a distance block."""

    @classmethod
    def name(cls) -> str:
        return "groundtruth"

    def schema(self) -> str:
        return "query long, rank int, id long, dist float"

    def reader(self, schema) -> TruthReader:
        return TruthReader(self.options)


def register(spark: SparkSession) -> SparkSession:
    """Make the formats known to the session."""
    ship(spark)
    for source in (VectorSource, TruthSource):
        spark.dataSource.register(source)
    return spark


def write_vectors(df: DataFrame, path: str, kind: str = "float32") -> int:
    """Write ``(id, vec)`` in id order as one file, atomically; ids must be 0..n-1.

    One file has one writer: rows come to the driver partition by partition, never all at once.
    """
    from pyspark.sql import functions as F

    n, low, high, distinct, dim, most = df.agg(F.count("*"), F.min("id"), F.max("id"), F.count_distinct("id"), F.min(F.size("vec")), F.max(F.size("vec"))).first()
    if not n or low != 0 or high != n - 1 or distinct != n or dim != most or not dim:
        raise ValueError("ids are not 0..n-1, or vectors differ in length")
    with atomic(path) as out:
        out.write(struct.pack("<II", n, dim))
        for row in df.orderBy("id").select("vec").toLocalIterator():
            out.write(np.asarray(row[0], KINDS[kind]).tobytes())
    return n


def write_truth(path: str, ids: np.ndarray, distances: np.ndarray | None = None) -> None:
    with atomic(path) as out:
        out.write(struct.pack("<II", *ids.shape) + np.ascontiguousarray(ids, "<u4").tobytes())
        if distances is not None:
            out.write(np.ascontiguousarray(distances, "<f4").tobytes())


# --- routing files: small by construction, so plain arrays -------------------------------------


def _body(path: str, magic: bytes, head: str) -> tuple[tuple, bytes]:
    raw = read_range(path, 0, size_of(path))
    n = 8 + struct.calcsize(head)
    if raw[:8] != magic or len(raw) < n:
        raise ValueError(f"{path}: not a {magic.decode()} file")
    return struct.unpack(head, raw[8:n]), raw[n:]


def _arrays(path: str, body: bytes, *specs: tuple[int, str]) -> list[np.ndarray]:
    if len(body) != sum(n * np.dtype(t).itemsize for n, t in specs):
        raise ValueError(f"{path}: {len(body)} bytes after the header")
    out, at = [], 0
    for n, t in specs:
        size = n * np.dtype(t).itemsize
        out.append(np.frombuffer(body[at : at + size], t))
        at += size
    return out


def _ids(ids) -> np.ndarray:
    ids = np.asarray(ids, np.int64)
    if len(ids) and (ids.min() < 0 or ids.max() >= 1 << 32):
        raise ValueError("ids beyond 32 bits")
    return ids.astype("<u4")


def _unique(ids: np.ndarray, what: str) -> np.ndarray:
    if not len(ids) or len(np.unique(ids)) != len(ids):
        raise ValueError(f"{what}: empty or repeated ids")
    return ids


def write_ranked(path: str, ids) -> None:
    ids = _unique(_ids(ids), path)
    with atomic(path) as out:
        out.write(RANKED + struct.pack("<II", len(ids), 0) + ids.tobytes())


def read_ranked(path: str) -> list[int]:
    (count, reserved), body = _body(path, RANKED, "<II")
    if reserved:
        raise ValueError(f"{path}: a reserved field that is set")
    return _unique(_arrays(path, body, (count, "<u4"))[0], path).tolist()


def check_csr(path: str, offsets: np.ndarray, total: int) -> None:
    if offsets[0] != 0 or offsets[-1] != total or (np.diff(offsets.astype(np.int64)) < 0).any():
        raise ValueError(f"{path}: offsets that do not rise from 0 to {total}")


def write_directory(path: str, cells: list[tuple[int, list[int]]]) -> None:
    """Cells as (medoid, children in order)."""
    medoids, children = _ids([m for m, _ in cells]), _ids([c for _, own in cells for c in own])
    _unique(np.concatenate([medoids, children]), path)
    offsets = np.cumsum([0, *(len(own) for _, own in cells)]).astype("<u4")
    with atomic(path) as out:
        out.write(DIRECTORY + struct.pack("<IIII", len(cells), len(children), len(cells) + len(children), 0) + medoids.tobytes() + offsets.tobytes() + children.tobytes())


def read_directory(path: str, nlist: int | None = None, total: int | None = None, below: int | None = None) -> list[tuple[int, list[int]]]:
    """Cells, after all structural checks; optional expected sizes and an upper bound of ids."""
    (n, m, both, reserved), body = _body(path, DIRECTORY, "<IIII")
    if reserved or both != n + m or not n or (nlist is not None and n != nlist) or (total is not None and both != total):
        raise ValueError(f"{path}: a header of {n} cells, {m} children, {both} in all")
    medoids, offsets, children = _arrays(path, body, (n, "<u4"), (n + 1, "<u4"), (m, "<u4"))
    check_csr(path, offsets, m)
    every = _unique(np.concatenate([medoids, children]), path)
    if below is not None and int(every.max()) >= below:
        raise ValueError(f"{path}: an id of {below} or more")
    return [(int(c), children[a:b].tolist()) for c, a, b in zip(medoids, offsets[:-1], offsets[1:], strict=True)]


def directory_rows(spark: SparkSession, cells: list[tuple[int, list[int]]]) -> DataFrame:
    """``(cell, id, is_medoid, pos)``."""
    rows = [(c, m, True, 0) for c, (m, _) in enumerate(cells)] + [(c, i, False, p) for c, (_, own) in enumerate(cells) for p, i in enumerate(own)]
    return spark.createDataFrame(rows, "cell long, id long, is_medoid boolean, pos long")


def write_buckets(path: str, hashes: int, capacity: int, seed: int, buckets: list[list[int]]) -> None:
    ids = _ids([i for own in buckets for i in own])
    offsets = np.cumsum([0, *map(len, buckets)]).astype("<u4")
    with atomic(path) as out:
        out.write(BUCKETS + struct.pack("<IIQII", hashes, capacity, seed, len(buckets), len(ids)) + offsets.tobytes() + ids.tobytes())


def read_buckets(path: str, hashes: int, capacity: int, seed: int) -> list[list[int]]:
    """The table, if it was written under the same configuration."""
    (h, c, s, n, total), body = _body(path, BUCKETS, "<IIQII")
    if (h, c, s) != (hashes, capacity, seed) or n != 1 << hashes:
        raise ValueError(f"{path}: a table of {h} hashes, capacity {c}, seed {s}")
    offsets, ids = _arrays(path, body, (n + 1, "<u4"), (total, "<u4"))
    check_csr(path, offsets, total)
    out = [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    if any(len(own) > capacity or len(set(own)) != len(own) for own in out):
        raise ValueError(f"{path}: a bucket over its capacity, or with a repeated id")
    return out


def write_waypoints(path: str, cells: list[list[int]]) -> None:
    ids, offsets = _ids([i for own in cells for i in own]), np.cumsum([0, *map(len, cells)]).astype("<u4")
    with atomic(path) as out:
        out.write(WAYPOINTS + struct.pack("<II", len(cells), len(ids)) + offsets.tobytes() + ids.tobytes())


def read_waypoints(path: str) -> list[list[int]]:
    (n, total), body = _body(path, WAYPOINTS, "<II")
    offsets, ids = _arrays(path, body, (n + 1, "<u4"), (total, "<u4"))
    check_csr(path, offsets, total)
    return [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]


def _finite(path: str, *arrays: np.ndarray) -> None:
    if not all(np.isfinite(a).all() for a in arrays):
        raise ValueError(f"{path}: a number that is not finite")


def write_portals(path: str, centers: np.ndarray, ids, vectors: np.ndarray) -> None:
    with atomic(path) as out:
        out.write(PORTALS + struct.pack("<II", *centers.shape) + centers.astype("<f4").tobytes() + _ids(ids).tobytes() + vectors.astype("<f4").tobytes())


def read_portals(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    (n, dim), body = _body(path, PORTALS, "<II")
    centers, ids, vectors = _arrays(path, body, (n * dim, "<f4"), (n, "<u4"), (n * dim, "<f4"))
    _finite(path, centers, vectors)
    return centers.reshape(n, dim), ids, vectors.reshape(n, dim)


def write_pool(path: str, ids, vectors: np.ndarray) -> None:
    with atomic(path) as out:
        out.write(POOL + struct.pack("<II", *vectors.shape) + _unique(_ids(ids), path).tobytes() + vectors.astype("<f4").tobytes())


def read_pool(path: str) -> tuple[np.ndarray, np.ndarray]:
    (n, dim), body = _body(path, POOL, "<II")
    ids, vectors = _arrays(path, body, (n, "<u4"), (n * dim, "<f4"))
    _finite(path, vectors)
    return _unique(ids, path), vectors.reshape(n, dim)


def write_starts(path: str, rows: np.ndarray) -> None:
    with atomic(path) as out:
        out.write(struct.pack("<II", *rows.shape) + np.ascontiguousarray(rows, "<u4").tobytes())


def read_starts(path: str, below: int | None = None) -> np.ndarray:
    """Start points (queries, starts): unique in each row."""
    rows, cols = shape(path)
    if size_of(path) != 8 + rows * cols * 4:
        raise ValueError(f"{path}: not {rows} x {cols}")
    found = np.frombuffer(read_range(path, 8, rows * cols * 4), "<u4").reshape(rows, cols)
    if any(len(set(r.tolist())) != cols for r in found) or (below is not None and int(found.max()) >= below):
        raise ValueError(f"{path}: a start that repeats in its row, or is out of range")
    return found


def graph_header(path: str, rows: int | None = None, dim: int | None = None) -> dict[str, int]:
    """Points, dimensions and medoid of an index file: little-endian 64-bit numbers from byte 8 on."""
    n, d, medoid = struct.unpack("<3Q", read_range(path, 8, 24))
    if (rows is not None and n != rows) or (dim is not None and d != dim) or medoid >= n:
        raise ValueError(f"{path}: an index of {n} x {d} with medoid {medoid}")
    return {"num_pts": n, "dims": d, "medoid": medoid}
