"""Causal histories: unique FIFO, LRU, regional and bucketed LRU, sampled exits.

State belongs to a stream (a method, repetition and search width; or any key) and is folded in the
stream's order: rows are dealt by stream, sorted, and pass through a generator that holds one
stream's bounded state. Memory is the capacity, never the stream. LRU contents have a closed form
(the most recent distinct ids), which is used where only the end state is wanted.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waymark.functions.hashing import mix64
from waymark.session import ship

EVENTS = "stream string, seq long, id long, hit boolean, evicted long, size int"


class UniqueFifo:
    """First in, first out, without refresh: an id that is present changes nothing."""

    def __init__(self, capacity: int):
        self.capacity, self.ring, self.held, self.next = capacity, [], set(), 0

    def push(self, item) -> tuple[bool, object]:
        """(was present, what was evicted)."""
        if item in self.held:
            return True, None
        self.held.add(item)
        if len(self.ring) < self.capacity:
            self.ring.append(item)
            return False, None
        gone, self.ring[self.next] = self.ring[self.next], item
        self.held.discard(gone)
        self.next = (self.next + 1) % self.capacity
        return False, gone

    def ids(self) -> list:
        return list(self.ring)

    def __len__(self) -> int:
        return len(self.ring)


class Lru:
    """Least recently used: a hit moves the id to the end."""

    def __init__(self, capacity: int):
        self.capacity, self.held = capacity, OrderedDict()

    def push(self, item) -> tuple[bool, object]:
        if item in self.held:
            self.held.move_to_end(item)
            return True, None
        gone = self.held.popitem(last=False)[0] if len(self.held) >= self.capacity else None
        self.held[item] = True
        return False, gone

    def ids(self) -> list:
        return list(self.held)

    def __len__(self) -> int:
        return len(self.held)


class Exits:
    """Up to ``slots`` exits of each hub, newest first.

    A winner that a hub already has changes nothing. A new one is written with chance 1/``every``,
    decided by the hash of (hub, winner, sequence): it goes first, and the oldest goes if the page
    is full. After a write, vacancies are filled from the query's ranked recent ids.
    """

    def __init__(self, slots: int, every: int):
        self.slots, self.every, self.pages = slots, every, {}

    def accepts(self, hub: int, winner: int, sequence: int) -> bool:
        if self.every <= 1:
            return True
        words = (np.array([x], np.int64).view(np.uint64) for x in (hub, winner, sequence))
        return int(mix64(*words)[0]) % self.every == 0

    def push(self, hub: int, winner: int, sequence: int, ranked: list[int] = ()) -> str:
        page = self.pages.setdefault(hub, [])
        if winner in page:
            return "duplicate"
        if not self.accepts(hub, winner, sequence):
            return "rejected"
        page = [winner, *page][: self.slots]
        for i in ranked:
            if len(page) >= self.slots:
                break
            if i not in page:
                page.append(i)
        self.pages[hub] = page
        return "accepted"


def ordered(events: DataFrame, order: list[str]) -> DataFrame:
    """``events(stream, id, ...)`` with ``seq`` from 0 in each stream."""
    return events.withColumn("seq", (F.row_number().over(Window.partitionBy("stream").orderBy(*order)) - 1).cast("long"))


def fold(events: DataFrame, state: Callable[[], object], step: Callable, schema: str, columns: list[str]) -> DataFrame:
    """Fold each stream in ``seq`` order: ``step(state, row tuple)`` gives an output row or None.

    ``columns`` begin with ``stream`` and ``seq``; a repeated sequence number is an error.
    """
    spark = ship(events.sparkSession)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    target = spark.createDataFrame([], schema).schema
    names = [f.name for f in target]
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(target)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, last = None, None, None
        for batch in batches:
            out = []
            for row in zip(*(batch.column(c).to_pylist() for c in columns), strict=True):
                if row[0] != now or held is None:
                    now, held, last = row[0], state(), None
                if last is not None and row[1] <= last:
                    raise ValueError(f"stream {now}: {row[1]} after {last}")
                last = row[1]
                if (made := step(held, row)) is not None:
                    out.append(dict(zip(names, made, strict=True)))
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return events.select(*columns).repartition(parts, "stream").sortWithinPartitions("stream", "seq").mapInArrow(run, schema)


def _replay(kind: type, events: DataFrame, capacity: int) -> DataFrame:
    def step(held, row):
        hit, gone = held.push(row[2])
        return row[0], row[1], row[2], hit, gone, len(held)

    return fold(events, lambda: kind(capacity), step, EVENTS, ["stream", "seq", "id"])


def fifo_replay(events: DataFrame, capacity: int) -> DataFrame:
    """What the unique FIFO of each stream did with each of its ids."""
    return _replay(UniqueFifo, events, capacity)


def lru_replay(events: DataFrame, capacity: int) -> DataFrame:
    return _replay(Lru, events, capacity)


def counters(replayed: DataFrame, warmup: int = 0) -> DataFrame:
    """Inserts, skips and evictions of each stream, in all and from sequence number ``warmup`` on."""
    late = F.col("seq") >= warmup
    count = lambda c: F.count(F.when(c, 1))
    return replayed.groupBy("stream").agg(
        count(~F.col("hit")).alias("inserts"),
        count(F.col("hit")).alias("skips"),
        count(F.col("evicted").isNotNull()).alias("evictions"),
        count(~F.col("hit") & late).alias("eval_inserts"),
        count(F.col("hit") & late).alias("eval_skips"),
        count(late).alias("eval_queries"),
    )


def lru_contents(events: DataFrame, capacity: int) -> DataFrame:
    """``(stream, pos, id)``: the ``capacity`` most recent distinct ids, oldest first.

    Latest occurrences are a partial aggregate; only ids, never events, meet in a stream's window.
    """
    last = events.groupBy("stream", "id").agg(F.max("seq").alias("seq"))
    kept = last.withColumn("back", F.row_number().over(Window.partitionBy("stream").orderBy(F.desc("seq")))).where(F.col("back") <= capacity)
    size = F.max("back").over(Window.partitionBy("stream"))
    return kept.select("stream", (size - F.col("back")).cast("long").alias("pos"), "id")


def exits_replay(events: DataFrame, slots: int, every: int) -> DataFrame:
    """``events(stream, seq, hub, winner, ranked)``: what became of each winner.

    Hubs don't see each other's exits, so rows are dealt by stream and hub.
    """

    def step(held: Exits, row):
        return row[0]["stream"], row[1], row[2], row[3], held.push(row[2], row[3], row[1], row[4] or []), len(held.pages[row[2]])

    dealt = events.withColumn("stream", F.struct("stream", "hub"))
    return fold(dealt, lambda: Exits(slots, every), step, "stream string, seq long, hub long, winner long, outcome string, slots int", ["stream", "seq", "hub", "winner", "ranked"])


def lifetimes(replayed: DataFrame) -> DataFrame:
    """``(stream, id, insert_seq, evict_seq)`` of a replay: an id is visible to queries after its
    insertion and up to its eviction (null: still there)."""
    starts = replayed.where(~F.col("hit")).select("stream", "id", F.col("seq").alias("insert_seq"))
    ends = replayed.where(F.col("evicted").isNotNull()).select("stream", F.col("evicted").alias("id"), F.col("seq").alias("evict_seq"))
    turn = lambda c: F.row_number().over(Window.partitionBy("stream", "id").orderBy(c)).alias("turn")
    return (
        starts.select("*", turn("insert_seq")).join(ends.select("*", turn("evict_seq")), ["stream", "id", "turn"], "left").select("stream", "id", "insert_seq", "evict_seq")
    )


def recent_overlap(events: DataFrame, capacities: list[int]) -> DataFrame:
    """``(stream, capacity, share)``: how many queries' id is among the preceding distinct ids, in percent.

    One pass with the largest capacity: an id's depth in the LRU order tells every smaller one.
    """
    most = max(capacities)

    def step(held: Lru, row):
        depth = None
        if row[2] in held.held:
            for k, i in enumerate(reversed(held.held)):
                if i == row[2]:
                    depth = k + 1
                    break
        held.push(row[2])
        return row[0], row[1], depth

    depth = fold(events, lambda: Lru(most), step, "stream string, seq long, depth int", ["stream", "seq", "id"])
    each = depth.select("stream", "depth", F.explode(F.array(*map(F.lit, capacities))).alias("capacity"))
    return each.groupBy("stream", "capacity").agg((F.count(F.when(F.col("depth") <= F.col("capacity"), 1)) * 100.0 / F.count(F.lit(1))).alias("share"))


def snapshot(replayed: DataFrame) -> DataFrame:
    """``(stream, id)``: what each stream holds after a replay, as a table that can be written."""
    return lifetimes(replayed).where("evict_seq IS NULL").select("stream", F.col("insert_seq").alias("seq"), "id")


def frozen_hits(events: DataFrame, held: DataFrame) -> DataFrame:
    """``events`` with ``hit`` against a snapshot that no query changes; streams may share none."""
    known = held.select("stream", "id").distinct().withColumn("__in", F.lit(True))
    return events.join(known, ["stream", "id"], "left").withColumn("hit", F.coalesce("__in", F.lit(False))).drop("__in")
