"""Best-two-fit packing of token sequences.

Documents become pieces of at most ``size`` tokens. How pieces pack depends on their lengths
alone, of which there are at most ``size``; so the plan is made from the histogram of lengths,
which is exact for the whole corpus and never larger than ``size`` rows. The plan fills one bin
at a time with the largest pieces that fit, then replaces its smallest piece by the two unpacked
ones that fill the expanded gap best, if they fill it better; a bin whose lengths are all still
there repeats, so each distinct bin is planned once with its multiplicity. Pieces then take the
places of their length in the order of a distributed rank.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waymark.session import checkpoint

from .base import map_texts, texts
from .wordbpe import default_path, encoder

SIZE, END = 2048, 0
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLACED = PIECES + ", sequence_id long, offset long"


def pieces(docs: DataFrame, path: str | None = None, size: int = SIZE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenise each text, end it with ``END`` and cut what is longer than ``size``.

    A null or empty text is one piece: the end token.
    """
    path = path or default_path()
    end = np.array([END], "<u4").tobytes()

    def run(ids: pa.Array, values: list[str | None]) -> pa.RecordBatch:
        rows: list[tuple[int, int, int, int, int]] = []
        for i, raw in enumerate(encoder(path).encode(values)):
            raw += end
            for k, at in enumerate(range(0, len(raw), 4 * size)):
                part = raw[at : at + 4 * size]
                rows.append((i, k, at // 4, len(part) // 4, zlib.crc32(part)))
        own, k, start, length, crc = (pa.array(c, pa.int64()) for c in zip(*rows, strict=True))
        return pa.RecordBatch.from_arrays([ids.take(own), k.cast(pa.int32()), start, length, crc], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return map_texts(texts(docs, id_col, text_col), run, PIECES)


def _best_pair(left: list[int], counts: Counter, gap: int) -> tuple[int, int, int]:
    """Two available lengths with the largest sum up to ``gap``: (sum, larger, smaller)."""
    best = (0, 0, 0)
    i, j = 0, bisect_right(left, gap) - 1
    while i <= j:
        total = left[i] + left[j]
        if total > gap or (i == j and counts[left[i]] < 2):
            j -= 1
            continue
        if total > best[0]:
            best = (total, left[j], left[i])
            if total == gap:
                break
        i += 1
    return best


def plan(histogram: dict[int, int], size: int = SIZE) -> list[tuple[list[int], int]]:
    """Bins as (lengths in order of their places, how many such bins), from length -> count."""
    counts = Counter({n: c for n, c in histogram.items() if c > 0})
    left = sorted(counts)
    out = []

    def take(n: int) -> None:
        counts[n] -= 1
        if not counts[n]:
            del left[bisect_left(left, n)]

    def give(n: int) -> None:
        if not counts[n]:
            insort(left, n)
        counts[n] += 1

    while left:
        chosen, gap = [], size
        while left and (k := bisect_right(left, gap)):
            n = left[k - 1]
            take(n)
            chosen.append(n)
            gap -= n
        if gap and len(chosen) > 1 and left:
            total, a, b = _best_pair(left, counts, gap + chosen[-1])
            if total > chosen[-1]:
                give(chosen.pop())
                for n in (a, b):
                    take(n)
                    chosen.append(n)
        use = Counter(chosen)
        more = min(counts[n] // c for n, c in use.items())
        for n, c in use.items():
            if more:
                counts[n] -= more * c
                if not counts[n]:
                    del left[bisect_left(left, n)]
        out.append((sorted(chosen, reverse=True), 1 + more))
    return out


def places(bins: list[tuple[list[int], int]]) -> dict[int, np.ndarray]:
    """For each length, rows (first rank, first sequence, uses in a bin, first offset) by rank."""
    found: dict[int, list[tuple[int, int, int, int]]] = {}
    ranks: Counter = Counter()
    sequence = 0
    for chosen, times in bins:
        offset = 0
        for n, uses in sorted(Counter(chosen).items(), reverse=True):
            found.setdefault(n, []).append((ranks[n], sequence, uses, offset))
            ranks[n] += uses * times
            offset += n * uses
        sequence += times
    return {n: np.array(v, np.int64) for n, v in found.items()}


def pack(parts: DataFrame, size: int = SIZE) -> DataFrame:
    """``parts`` (the columns of ``PIECES``) with ``sequence_id`` and ``offset``.

    A piece's rank among those of its length is its place within (length, salt) plus the sizes of
    the salts before; so a length that very many pieces share is ranked by as many tasks as there
    are salts. An empty table gives an empty result.
    """
    parts = checkpoint(parts)
    salts = max(8, int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    histogram = {r[0]: r[1] for r in parts.groupBy("length").count().collect()}
    table = places(plan(histogram, size))
    # The written part is in the hash so that repeated or null ids don't share a salt.
    salted = parts.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", F.spark_partition_id()), F.lit(salts)))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    base = salted.groupBy("length", "salt").count().select("length", "salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    own = Window.partitionBy("length", "salt").orderBy("doc_id", "piece")
    ranked = salted.join(base, ["length", "salt"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.row_number().over(own) - 1).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("length").to_numpy(zero_copy_only=False)
            rank = batch.column("rank").to_numpy(zero_copy_only=False)
            sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            for n in np.unique(length):
                rows = np.flatnonzero(length == n)
                first, seq, uses, at = table[int(n)][np.searchsorted(table[int(n)][:, 0], rank[rows], side="right") - 1].T
                step = rank[rows] - first
                sequence[rows] = seq + step // uses
                offset[rows] = at + step % uses * n
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(place, PLACED)


def packed(docs: DataFrame, path: str | None = None, size: int = SIZE) -> DataFrame:
    """Tokenise and pack all documents: the contract's columns.

    A null or empty text is one piece of one token; a null id, repeated rows and repeated ids are
    packed row by row; an empty table gives an empty result; other columns are not read. Texts are
    taken whole, a stretch at a time, and pieces of equal length take places in any order.
    """
    return pack(pieces(docs, path, size), size)
