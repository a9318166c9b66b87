"""Deterministic 64-bit mixing for sampled writes, and a pseudo-random id pool."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the mix: the multiplier of the sequence and two finalising ones.
GOLDEN, FIRST, SECOND = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB


def mix64(hub: np.ndarray, winner: np.ndarray, sequence: np.ndarray) -> np.ndarray:
    """One unsigned 64-bit word of each hub, winner and sequence; arithmetic wraps.

    The hub takes the upper half of the word, the winner the lower, the sequence is spread over both.
    """
    upper, lower, turn = (np.asarray(w, np.uint64) for w in (hub, winner, sequence))
    with np.errstate(over="ignore"):
        h = (upper << np.uint64(32)) ^ lower ^ (turn * np.uint64(GOLDEN))
        for shift, factor in ((30, FIRST), (27, SECOND)):
            h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
        return h ^ (h >> np.uint64(31))


def accepts(hub: Column, winner: Column, sequence: Column, every: int) -> Column:
    """A Bernoulli draw with chance 1/``every``, the same for the same hub, winner and sequence."""
    if every <= 1:
        return F.lit(True)

    @F.pandas_udf("boolean")
    def draw(h: pd.Series, w: pd.Series, s: pd.Series) -> pd.Series:
        # Ids go to the workers as signed longs; the mix reads their bits.
        return pd.Series(mix64(*(x.to_numpy(np.int64).view(np.uint64) for x in (h, w, s))) % np.uint64(every) == 0)

    return draw(hub.cast("long"), winner.cast("long"), sequence.cast("long"))


def pool_id(j: Column, n: Column | int) -> Column:
    """The j-th id of a fixed pseudo-random pool over ``n`` ids."""
    return F.pmod(j.cast("long") * F.lit(2654435761) + F.lit(1013904223), F.lit(n) if isinstance(n, int) else n)
