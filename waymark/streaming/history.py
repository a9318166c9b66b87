"""The causal histories as Structured Streaming operators.

A stream's key is the stream itself; its rows of a micro-batch are folded in sequence order, and the
bounded state (ring, cursor, counters) is kept by Spark between batches. Results equal the batch fold
row by row, provided batches come in order, which a sequence number that goes back would betray.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from waymark.operators.history import EVENTS, Lru, UniqueFifo
from waymark.session import ship

STATE = "ids array<long>, next int, last long"


def _restore(kind: type, capacity: int, state: GroupState):
    held, last = kind(capacity), -1
    if state.exists:
        ids, cursor, last = state.get
        if kind is UniqueFifo:
            held.ring, held.held, held.next = list(ids), set(ids), cursor
        else:
            for i in ids:
                held.push(i)
    return held, last


def _stream(kind: type, events: DataFrame, capacity: int) -> DataFrame:
    ship(events.sparkSession)

    def fold(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, last = _restore(kind, capacity, state)
        rows = pd.concat(list(parts)).sort_values("seq")
        out = []
        for seq, item in zip(rows["seq"].tolist(), rows["id"].tolist(), strict=True):
            if seq <= last:
                raise ValueError(f"stream {key[0]}: {seq} after {last}")
            last = seq
            hit, gone = held.push(item)
            out.append((key[0], seq, item, hit, gone, len(held)))
        state.update((held.ids(), getattr(held, "next", 0), last))
        frame = pd.DataFrame(out, columns=["stream", "seq", "id", "hit", "evicted", "size"])
        frame["evicted"] = frame["evicted"].astype("Int64")
        yield frame

    return events.select("stream", "seq", "id").groupBy("stream").applyInPandasWithState(fold, EVENTS, STATE, "append", GroupStateTimeout.NoTimeout)


def fifo_stream(events: DataFrame, capacity: int) -> DataFrame:
    """The unique FIFO of each stream over a streaming ``events(stream, seq, id)``."""
    return _stream(UniqueFifo, events, capacity)


def lru_stream(events: DataFrame, capacity: int) -> DataFrame:
    return _stream(Lru, events, capacity)
