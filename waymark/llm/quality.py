"""Document quality from a linear-chain conditional random field over lines.

Every line gets a label, good or bad, from features of itself and of its neighbours; a text's
quality is its lines' forward-backward marginals, weighted by their length, passed through a
logistic calibration. Labels exist only for documents: lines of good documents are good, and of a
bad document those that the current model finds worst, in a few rounds of refinement.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import labelled, map_texts, remainder, texts

#: Bounds of the training sample: rows of each label, and characters of a text.
TRAIN_ROWS, TRAIN_CHARS = {"0": 900, "1": 2100}, 1 << 16
FOLDS, HELD_OUT, THRESHOLD = 5, 0, 0.3
ROUNDS, STEPS, RATE, L2 = 3, 70, 0.4, 1e-4
SCHEMA = "doc_id long, score double"
OWN = 10
#: Bytes: 1 lower case and non-ASCII, 2 capitals, 3 digits, 4 space, 5 other marks.
KIND = np.full(256, 5, np.uint8)
KIND[128:] = 1
for _c in range(26):
    KIND[97 + _c], KIND[65 + _c] = 1, 2
KIND[48:58], KIND[[32, 9, 11, 12, 13]] = 3, 4
NAMES = ("bias", "capitals", "marks", "digits", "pipes or bars", "exclaimed", "repeated word", "distinct words", "word length", "length", "same line before")


def _repeats(line: bytes) -> tuple[float, float, float]:
    words = line.split()
    n = len(words)
    if n < 2:
        return 0.0, 1.0, float(len(line))
    return sum(map(bytes.__eq__, words, words[1:])) / (n - 1), len(set(words)) / n, len(line) / n


def lines_of(values: list[str | None]) -> tuple[list[bytes], np.ndarray]:
    """All lines of all texts, and how many each text has (at least one, if empty)."""
    parts = [(v or "").encode("utf-8", "replace").split(b"\n") for v in values]
    return [line for p in parts for line in p], np.array([len(p) for p in parts], np.int64)


def features(lines: list[bytes], counts: np.ndarray) -> np.ndarray:
    """Each line's own features, then those of the line before and of the line after it."""
    sizes = np.array([len(x) + 1 for x in lines])
    blob = np.frombuffer(b"\n".join(lines) + b"\n", np.uint8)
    starts = np.cumsum(sizes) - sizes
    kind = KIND[blob]
    share = lambda mask: np.add.reduceat(mask, starts, dtype=np.int64) / sizes
    own = np.zeros((len(lines), OWN + 1))
    own[:, 0] = 1
    own[:, 1] = share(kind == 2)
    own[:, 2] = share(kind == 5) * 4
    own[:, 3] = share(kind == 3)
    own[:, 4] = share(blob == 124) * 20
    own[:, 5] = share(blob == 33) * 10
    words = np.array([_repeats(x) for x in lines])
    own[:, 6] = words[:, 0] * 3
    own[:, 7] = 1 - words[:, 1]
    own[:, 8] = np.minimum(words[:, 2], 40) / 10
    own[:, 9] = np.log1p(sizes) / 5
    at = 0
    for n in counts:
        if n > 1:
            seen: set[bytes] = set()
            for i in range(at, at + n):
                line = lines[i]
                if len(line) > 20:
                    if line in seen:
                        own[i, 10] = 1
                    seen.add(line)
        at += n
    first = np.cumsum(counts) - counts
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:], after[:-1] = own[:-1], own[1:]
    before[first] = 0
    after[first + counts - 1] = 0
    return np.concatenate([own, before[:, 1:], after[:, 1:]], axis=1)


@dataclass
class Field:
    """Weights of the bad label, transition scores [from, to], and the calibration."""

    weights: np.ndarray
    moves: np.ndarray
    slope: float = 6.0
    middle: float = 0.5


def marginals(unary: np.ndarray, moves: np.ndarray, counts: np.ndarray, pairs: bool = False):
    """P(bad) of every line by forward-backward, all texts side by side; and pair marginals.

    ``unary`` is the score of bad (good has 0). Texts are ordered by their number of lines, so
    that step t works on the texts that still have a line t.
    """
    first = np.cumsum(counts) - counts
    order = np.argsort(-counts, kind="stable")
    sorted_counts, sorted_first = counts[order], first[order]
    steps = int(sorted_counts[0]) if len(counts) else 0
    alive = [int(np.searchsorted(-sorted_counts, -t, side="left")) for t in range(steps)]
    e = np.stack([np.zeros_like(unary), unary], axis=1)
    forward, backward = np.empty_like(e), np.zeros_like(e)
    norm = lambda m: m - np.logaddexp(m[:, :1], m[:, 1:])
    for t in range(steps):
        at = sorted_first[: alive[t]] + t
        if t:
            prev = forward[at - 1]
            into = np.logaddexp(prev[:, :1] + moves[0], prev[:, 1:] + moves[1])
            forward[at] = norm(e[at] + into)
        else:
            forward[at] = norm(e[at])
    for t in range(steps - 2, -1, -1):
        at = sorted_first[: alive[t + 1]] + t
        after = e[at + 1] + backward[at + 1]
        backward[at] = norm(np.logaddexp(moves[:, 0] + after[:, :1], moves[:, 1] + after[:, 1:]))
    both = norm(forward + backward)
    bad = np.exp(both[:, 1])
    if not pairs:
        return bad
    has_next = np.ones(len(unary), bool)
    has_next[first + counts - 1] = False
    i = np.flatnonzero(has_next)
    joint = forward[i][:, :, None] + moves[None] + (e[i + 1] + backward[i + 1])[:, None, :]
    joint -= joint.max(axis=(1, 2), keepdims=True)
    joint = np.exp(joint)
    joint /= joint.sum(axis=(1, 2), keepdims=True)
    return bad, i, joint


def fit(rows: list[tuple[int, str, int]]) -> Field:
    """Train on (id, text, quality) rows."""
    model = Field(np.zeros(1 + 3 * OWN), np.array([[0.5, 0.0], [0.0, 0.5]]))
    if not rows:
        return model
    lines, counts = lines_of([r[1] for r in rows])
    x = features(lines, counts)
    owner = np.repeat(np.arange(len(rows)), counts)
    bad_doc = np.array([r[2] == 0 for r in rows])
    size = np.array([len(line) + 1 for line in lines], float)
    y = bad_doc[owner].astype(float)
    first = np.cumsum(counts) - counts
    for round_ in range(ROUNDS):
        pair_i = np.flatnonzero(owner[:-1] == owner[1:])
        speed = np.zeros_like(model.weights)
        target = np.zeros((2, 2))
        np.add.at(target, (y[pair_i].astype(int), y[pair_i + 1].astype(int)), 1)
        for _ in range(STEPS):
            bad, i, joint = marginals(x @ model.weights, model.moves, counts, pairs=True)
            grad = x.T @ (y - bad) / len(y) - L2 * model.weights
            speed = 0.9 * speed + grad
            model.weights += RATE * speed
            if len(i):
                model.moves += 0.5 * RATE * ((target - joint.sum(axis=0)) / len(y) - L2 * model.moves)
        if round_ < ROUNDS - 1:
            # In a bad text the worst line stays bad, with every line that the model holds bad.
            single = 1 / (1 + np.exp(-(x[:, : OWN + 1] @ model.weights[: OWN + 1])))
            worst = np.maximum.reduceat(single, first)
            y = (bad_doc[owner] & ((bad > 0.5) & (single > 0.3) | (single >= worst[owner]))).astype(float)
    share = np.bincount(owner, marginals(x @ model.weights, model.moves, counts) * size) / np.bincount(owner, size)
    # Logistic calibration of the share of bad text.
    a, b = 6.0, -3.0
    t = (~bad_doc).astype(float)
    good = 1 - share
    for _ in range(400):
        p = 1 / (1 + np.exp(-(a * good + b)))
        w = np.maximum(p * (1 - p), 1e-4)
        h = np.array([[np.sum(w * good * good) + 1e-1, np.sum(w * good)], [np.sum(w * good), np.sum(w) + 1e-1]])
        g = np.array([np.sum((t - p) * good) - 1e-1 * a, np.sum(t - p) - 1e-1 * b])
        step = np.linalg.solve(h, g)
        a, b = a + step[0] * 0.5, b + step[1] * 0.5
    model.slope, model.middle = float(a), float(b)
    return model


def probabilities(model: Field, values: list[str | None]) -> np.ndarray:
    """Calibrated quality of each whole text; an empty text is one good empty line."""
    if not values:
        return np.zeros(0)
    lines, counts = lines_of(values)
    bad = marginals(features(lines, counts) @ model.weights, model.moves, counts)
    owner = np.repeat(np.arange(len(values)), counts)
    size = np.array([len(line) + 1 for line in lines], float)
    good = 1 - np.bincount(owner, bad * size, len(values)) / np.bincount(owner, size, len(values))
    return 1 / (1 + np.exp(-np.clip(model.slope * good + model.middle, -30, 30)))


def score(docs: DataFrame, model: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score`` of each row; null counts as an empty text."""

    def run(ids: pa.Array, values: list[str | None]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([ids, pa.array(probabilities(model, values), pa.float64())], ["doc_id", "score"])

    return map_texts(texts(docs, id_col, text_col), run, SCHEMA)


def predictions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Train on the learnable labelled rows, then score every row: the contract's columns.

    Null and empty texts are one good empty line; repeated rows give repeated rows; an empty table
    gives none. Without usable labels (none, or none of 0 and 1) all lines are as likely good as bad.
    Other columns, whatever their names, are not read. Whole texts are scored, however long.
    """
    out = score(docs, fit(labelled(docs, labels, "quality", TRAIN_ROWS, TRAIN_CHARS, FOLDS, HELD_OUT)))
    return out.select("doc_id", (remainder(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
