"""What the corpus operators share: column selection, label samples, Arrow batches."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.session import checkpoint, ship

#: Rows of one slice that a Python operator works on at a time, and characters of text in it.
SLICE_ROWS, SLICE_CHARS = 2048, 1 << 20
#: Bytes that a memo of words may take, about what an entry takes beside its word, and the longest word kept.
MEMO_BYTES, ENTRY_BYTES, LONGEST = 24 << 20, 256, 64


class Memo(dict):
    """Word -> value, worked out once for each distinct word, and bounded by bytes.

    Words over ``LONGEST`` characters are worked out each time and never kept; once the entries take
    over ``MEMO_BYTES``, in the midst of a slice or not, all are forgotten.
    """

    def __init__(self, make: Callable[[str], Any]):
        super().__init__()
        self.make, self.held = make, 0

    def __missing__(self, word: str):
        value = self.make(word)
        if len(word) <= LONGEST:
            if self.held > MEMO_BYTES:
                self.clear()
                self.held = 0
            self.held += ENTRY_BYTES + 2 * len(word)
            self[word] = value
        return value


_held: dict[tuple, Any] = {}


def held(key: tuple, make: Callable[[], Any]):
    """The model or encoder ``key`` of this worker, which holds one at a time: the next one's turn frees the last."""
    if key not in _held:
        _held.clear()
        _held[key] = make()
    return _held[key]


def release() -> None:
    """Hand memory that a finished task has freed back to the system (where the C library can)."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


#: Narrow rows of one partition of a settled table, and narrow rows that may be broadcast.
EACH, MOST_IDS = 1 << 16, 1 << 18


def few(df: DataFrame, rows: int, each: int = EACH) -> DataFrame:
    """``df``, which has ``rows`` rows, in no more partitions than ``each`` rows apiece need; nothing is shuffled.

    Whatever is exchanged next writes its files once a partition, so hundreds of almost empty ones
    cost far more than their rows, and one partition needs no exchange at all.
    """
    return df.coalesce(max(1, -(-rows // each)))


def settled(df: DataFrame, each: int = EACH) -> tuple[DataFrame, int]:
    """A checkpoint of ``df`` in ``few`` partitions, and its rows."""
    done = checkpoint(df)
    rows = done.count()
    return few(done, rows, each), rows


def sent(df: DataFrame, rows: int) -> DataFrame:
    """Narrow rows, broadcast where they are at most ``MOST_IDS``: the wide side of a join then stays in place."""
    return F.broadcast(df) if rows <= MOST_IDS else df


def texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, text)`` only: other columns, whatever their names, never reach an operator."""
    return df.select(df[id_col].cast("long").alias("doc_id"), df[text_col].cast("string").alias("text"))


def remainder(doc_id: Column, folds: int) -> Column:
    """crc32 of the id's decimal text, modulo ``folds``."""
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(folds))


def slices(batch: pa.RecordBatch, chars: int = SLICE_CHARS) -> Iterator[tuple[pa.Array, list[str | None]]]:
    """Ids and texts of a batch in slices of bounded rows and characters."""
    ids, col = batch.column(0), batch.column(1)
    start, size = 0, 0
    out: list[str | None] = []
    for i in range(len(col)):
        t = col[i].as_py()
        out.append(t)
        size += len(t) if t else 0
        if len(out) >= SLICE_ROWS or size >= chars:
            yield ids.slice(start, len(out)), out
            start, size, out = i + 1, 0, []
    if out:
        yield ids.slice(start, len(out)), out


#: Bytes of input for each core below which a table is dealt out before a Python operator.
SMALL = 2 << 20


def spread(df: DataFrame) -> DataFrame:
    """A table of a few megabytes over all cores, where a scan would give it to one; others as they are.

    The size is the plan's estimate, so nothing is read for it.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(cores) if size < cores * SMALL else df


def map_texts(df: DataFrame, fn: Callable[[pa.Array, list[str | None]], pa.RecordBatch], schema: str, chars: int = SLICE_CHARS) -> DataFrame:
    """Apply ``fn(ids, texts)`` to slices of ``(doc_id, text)`` rows, in Arrow batches."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, values in slices(batch, chars):
                yield fn(ids, values)
        release()

    return spread(df).mapInArrow(run, schema)


#: Strata that a sample draws from at most: those with the most rows.
MOST_STRATA = 256


def sample(df: DataFrame, strata: Column, per_stratum: int | dict[str, int], seed: int) -> DataFrame:
    """About ``per_stratum`` rows of each stratum (or as many as it names), by a hash of ``doc_id``.

    The counts come from a narrow scan; the sample's expected size is ``per_stratum`` times the
    number of strata whatever the size of the table. Strata that a dict doesn't name, and those
    beyond the ``MOST_STRATA`` largest, are not sampled. A row is in or out by its id alone, so a
    recomputed task chooses the same rows.
    """
    named = isinstance(per_stratum, dict)
    wanted = per_stratum.get if named else lambda _: per_stratum
    keyed = df.withColumn("__stratum", strata.cast("string")).where(F.col("__stratum").isin(list(per_stratum)) if named else "__stratum is not null")
    counts = {r[0]: r[1] for r in keyed.groupBy("__stratum").count().orderBy(F.desc("count"), "__stratum").limit(MOST_STRATA).collect()}
    keyed = keyed.where(F.col("__stratum").isin(list(counts))) if len(counts) == MOST_STRATA else keyed
    if not counts:
        return keyed.limit(0)
    share = F.create_map(*[x for k, n in sorted(counts.items()) for x in (F.lit(k), F.lit(min(1.0, wanted(k) / n)))])
    point = F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id")), F.lit(1 << 30)) / float(1 << 30)
    return keyed.where(point < share[F.col("__stratum")])


def labelled(docs: DataFrame, labels: DataFrame, column: str, per_label: dict[str, int], max_chars: int, folds: int = 5, held_out: int = 0, seed: int = 7) -> list[tuple[int, str, int]]:
    """A bounded training sample ``(doc_id, text, label)`` in doc_id order.

    The labels are sampled before the join, so that the broadcast side has at most about
    ``sum(per_label)`` rows. Labels that ``per_label`` doesn't name (null, or anything but 0 and 1)
    teach nothing and are ignored, as are null and empty texts. Of a text over ``max_chars`` a part
    of that length is taken, which starts at a place given by its id.
    """
    named = labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels[column].cast("int").alias("label"))
    named = named.where(remainder(F.col("doc_id"), folds) != held_out)
    picked = sample(named, F.col("label"), per_label, seed).select("doc_id", "label")
    start = F.pmod(F.xxhash64("doc_id"), F.greatest(F.length("text") - max_chars, F.lit(1))).cast("int")
    part = F.substring(F.col("text"), start + 1, F.lit(max_chars))
    rows = texts(docs).where(F.length("text") > 0).join(F.broadcast(picked), "doc_id").select("doc_id", part.alias("text"), "label").collect()
    return sorted((r[0], r[1], r[2]) for r in rows)


def keep_rows(docs: DataFrame, keep: Callable[[list[str | None]], list[bool]], text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text ``keep`` accepts."""
    ship(docs.sparkSession)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pair = pa.RecordBatch.from_arrays([batch.column(at), batch.column(at)], ["id", "text"])
            mask = [k for _, values in slices(pair) for k in keep(values)]
            yield batch.filter(pa.array(mask, pa.bool_()))
        release()

    return spread(docs).mapInArrow(run, docs.schema)
