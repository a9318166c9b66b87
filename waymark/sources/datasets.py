"""Known public datasets, ranged downloads behind an opener, crops and splits."""

from __future__ import annotations

import os
import struct
from collections.abc import Callable
from dataclasses import dataclass

from .binary import KINDS, atomic, check_truth, checked_shape, copy_bytes, shape, slice_truth, slice_vectors


@dataclass(frozen=True)
class Dataset:
    """What a prepared dataset must be."""

    rows: int
    dim: int
    kind: str
    metric: str
    queries: int = 10_000

    @property
    def index_params(self) -> dict:
        """Fixed values of the graph build: degree, build width, code chunks."""
        return {"degree": 64, "build_width": 100, "chunks": min(64, self.dim), "metric": self.metric}


#: Shapes and metrics of the studied collections.
DATASETS = {
    "coveo": Dataset(31_950, 50, "float32", "inner_product", 30_000),
    "pubmed": Dataset(1_000_000, 768, "float32", "inner_product"),
    "text2image": Dataset(10_000_000, 200, "float32", "inner_product"),
    "bigann": Dataset(10_000_000, 128, "uint8", "squared_l2"),
}
#: Training, warm-up and measured queries.
SPLITS = {"coveo": (5_000, 20_000, 5_000), "pubmed": (5_000, 4_000, 1_000), "text2image": (5_000, 4_000, 1_000), "bigann": (5_000, 4_000, 1_000)}


def download(fetch: Callable[[int, int], bytes], target: str, size: int, chunk: int = 1 << 24) -> None:
    """Fetch ``size`` bytes by ranges into ``target``; it resumes its own part file, and checks the size.

    ``fetch(start, length)`` gives the bytes of a range; no network code lives here.
    """
    part = f"{target}.partial"
    done = os.path.getsize(part) if os.path.exists(part) else 0
    with open(part, "ab") as out:
        while done < size:
            raw = fetch(done, min(chunk, size - done))
            if not raw:
                break
            out.write(raw)
            done += len(raw)
    if done != size:
        raise ValueError(f"{target}: {done} of {size} bytes")
    os.replace(part, target)


def crop(source: str, target: str, rows: int, kind: str = "float32") -> None:
    """The first ``rows`` vectors under a header of their own; a target that is already so stays."""
    have, dim = shape(source)
    if os.path.exists(target) and shape(target) == (rows, dim) and os.path.getsize(target) == 8 + rows * dim * KINDS[kind].itemsize:
        return
    if rows > have:
        raise ValueError(f"{rows} of {have} rows")
    with atomic(target) as out:
        out.write(struct.pack("<II", rows, dim))
        copy_bytes(source, out, 8, rows * dim * KINDS[kind].itemsize)


def split_queries(queries: str, truth: str, folder: str, train: int = 5_000, held: int = 5_000, kind: str = "float32") -> dict[str, str]:
    """Training queries, and held-out queries with their ground truth, as files in ``folder``."""
    checked_shape(queries, kind, train + held)
    check_truth(truth)
    out = {name: os.path.join(folder, f"{name}.bin") for name in ("train", "heldout", "heldout_truth")}
    slice_vectors(queries, out["train"], 0, train, KINDS[kind].itemsize)
    slice_vectors(queries, out["heldout"], train, held, KINDS[kind].itemsize)
    slice_truth(truth, out["heldout_truth"], train, held, require_distances=True)
    return out
