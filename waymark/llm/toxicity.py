"""Toxicity: gradient-boosted trees over dense lexical features, calibrated isotonically.

Features of a whole text: densities of a learned lexicon of words and of word beginnings, how near
its hits stand to second-person words, rates of capitals, of punctuation and of obfuscated words.
The lexicon, the trees and the calibration are learned from a bounded sample of labelled rows;
lexicon features of training rows come from the other half of the sample, so that the trees see
them as they are on unseen texts.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import base
from .base import keep_rows, labelled, map_texts, remainder, texts
from .trees import Boosted, boost, isotonic

#: Bounds of the training sample: rows of each label, and characters of a text.
TRAIN_ROWS, TRAIN_CHARS = {"1": 900, "0": 2700}, 1 << 16
FOLDS, HELD_OUT, THRESHOLD = 5, 0, 0.5
STEMS, NEAR = (4, 5, 6), 5
SCHEMA = "doc_id long, score double"
EDGES = ".,;:!?\"'()[]{}<>*$%&#|-_~`"
SECOND = frozenset("you your yours yourself u ur thou thee du dich dir dein deine deiner euch euer ihr tu te toi ton ta tes vous votre vos tú ti tus usted ustedes vosotros vuestro os".split())
LEET = str.maketrans("013457@$!", "oieastasi")


@dataclass(frozen=True)
class Lexicon:
    words: dict[str, float]
    stems: dict[str, float]


def _units(text: str) -> tuple[set[str], set[str]]:
    words = {w for t in text.lower().split() if (w := t.strip(EDGES))}
    return words, {w[:n] for w in words for n in STEMS if len(w) > n}


def count_units(rows: list[tuple[str, int]]) -> tuple[list[int], tuple]:
    """Documents of each label, and in how many of them each word and each beginning occurs."""
    totals = [0, 0]
    seen = ([Counter(), Counter()], [Counter(), Counter()])
    for text, label in rows:
        totals[label] += 1
        for kind, units in enumerate(_units(text)):
            seen[kind][label].update(units)
    return totals, seen


def learn_lexicon(totals: list[int], seen: tuple) -> Lexicon:
    """Words and beginnings whose documents are toxic far more often than chance allows."""
    if not all(totals):
        return Lexicon({}, {})
    base = totals[1] / sum(totals)
    chosen = []
    for clean, toxic in seen:
        size = len(clean.keys() | toxic.keys())
        least = 2 * math.log(size + 1) - 8
        kept = {}
        for unit, p in toxic.items():
            n = clean[unit]
            if p < 3 or p < 0.8 * (p + n):
                continue
            g = 2 * (p * math.log(p / ((p + n) * base)) + (n * math.log(n / ((p + n) * (1 - base))) if n else 0))
            if g >= least:
                kept[unit] = math.log((p + 0.5) / (totals[1] + 1)) - math.log((n + 0.5) / (totals[0] + 1))
        chosen.append(kept)
    return Lexicon(*chosen)


class Memo(base.Memo):
    """Token -> attributes (word weight, stem weight, second person) as one packed number.

    The weights are kept as ranks among the lexicon's distinct weights, so that a value is a small
    integer and the attributes of a whole text are array lookups.
    """

    def __init__(self, lexicon: Lexicon):
        super().__init__(self.code)
        self.weights = np.array(sorted({0.0, *lexicon.words.values(), *lexicon.stems.values()}), np.float32)
        rank = {float(w): k for k, w in enumerate(sorted({0.0, *lexicon.words.values(), *lexicon.stems.values()}))}
        self.words = {w: rank[v] for w, v in lexicon.words.items()}
        self.stems = {w: rank[v] for w, v in lexicon.stems.items()}
        self.zero = rank[0.0]

    def code(self, token: str) -> int:
        word, words, stems, zero = token.lower().strip(EDGES), self.words, self.stems, self.zero
        hit = words.get(word, zero)
        if hit == zero and not word.isalpha():
            hit = words.get(word.translate(LEET), zero)
        stem = max(stems.get(word[:4], zero), stems.get(word[:5], zero), stems.get(word[:6], zero))
        return hit << 33 | stem << 1 | (word in SECOND)

    def attributes(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(word weight, stem weight, whether second person) of packed attributes."""
        return self.weights[codes >> 33], self.weights[codes >> 1 & 0xFFFFFFFF], codes & 1


#: Classes of bytes: 1 letters (with all non-ASCII bytes), 2 capitals, 3 digits and signs used inside words, 4 marks.
KIND = np.array([4 if 32 < i < 127 else 0 for i in range(256)], np.uint8)
KIND[128:] = 1
for _c in b"abcdefghijklmnopqrstuvwxyz":
    KIND[_c], KIND[_c - 32] = 1, 2
for _c in b"0123456789@$*":
    KIND[_c] = 3
NAMES = ("word density", "word hits", "stem density", "stem hits", "heaviest", "near second person", "second person", "capitals", "marks", "obfuscated", "exclaimed", "words")


def _rates(values: list[str | None]) -> np.ndarray:
    """Shares of capitals, marks, signs between letters, and exclamation marks among a text's bytes."""
    raws = [(v or "").encode("utf-8", "replace") + b"\n" for v in values]
    sizes = np.array([len(r) for r in raws])
    blob = np.frombuffer(b"".join(raws), np.uint8)
    kind = KIND[blob]
    starts = np.cumsum(sizes) - sizes
    letter = (kind == 1) | (kind == 2)
    odd = np.zeros(len(blob), bool)
    odd[1:-1] = (kind[1:-1] == 3) & letter[:-2] & letter[2:]
    sums = [np.add.reduceat(m, starts, dtype=np.int64) for m in (kind == 2, kind >= 3, odd, blob == 33)]
    return np.stack(sums, axis=1) / sizes[:, None]


def features(values: list[str | None], memo: Memo) -> np.ndarray:
    """Dense features, one row per text; a text without words is all zeros."""
    codes, counts = [], []
    for v in values:
        tokens = v.split() if v else []
        codes.append(np.fromiter(map(memo.__getitem__, tokens), np.int64, len(tokens)))
        counts.append(len(tokens))
    counts = np.array(counts)
    out = np.zeros((len(values), len(NAMES)))
    if not counts.sum():
        return out
    code = np.concatenate(codes)
    owner = np.repeat(np.arange(len(values)), counts)
    total = lambda column: np.bincount(owner, column, len(values))
    hit, stem, second = memo.attributes(code)
    found = np.flatnonzero((hit > 0) | (stem > 0))
    places = np.flatnonzero(second)
    near = np.zeros(len(found), bool)
    if len(places):
        k = np.searchsorted(places, found)
        for j in (np.maximum(k - 1, 0), np.minimum(k, len(places) - 1)):
            near |= (owner[places[j]] == owner[found]) & (np.abs(places[j] - found) <= NEAR)
    n = np.maximum(counts, 1)
    words, stems = total(hit > 0), total(stem > 0)
    heaviest = np.zeros(len(values))
    np.maximum.at(heaviest, owner[found], np.maximum(hit, stem)[found])
    out[:, :7] = np.stack([words / n, words, stems / n, stems, heaviest, np.bincount(owner[found], near, len(values)), total(second) / n], axis=1)
    out[:, 7:11] = _rates(values)
    out[:, 11] = np.log1p(counts)
    return out


def fit(rows: list[tuple[int, str, int]]) -> tuple[Lexicon, Boosted]:
    """Lexicon, trees and calibration from (id, text, label) rows."""
    if not rows:
        return Lexicon({}, {}), Boosted(-4.0)
    half = np.array([k % 2 for k in range(len(rows))])
    y = np.array([r[2] for r in rows], float)
    order = np.argsort(y, kind="stable")  # halves with like shares of each label
    side = np.empty(len(rows), np.int64)
    side[order] = half
    x = np.zeros((len(rows), len(NAMES)))
    counted = [count_units([(r[1], r[2]) for r, k in zip(rows, side, strict=True) if k == s]) for s in (0, 1)]
    for s in (0, 1):
        lexicon = learn_lexicon(*counted[1 - s])
        own = np.flatnonzero(side == s)
        memo = Memo(lexicon)
        for at in range(0, len(own), 512):
            part = own[at : at + 512]
            x[part] = features([rows[i][1] for i in part], memo)
    # Calibration margins come from trees that were fitted on the other half.
    margin = np.empty(len(rows))
    for s in (0, 1):
        margin[side == s] = boost(x[side != s], y[side != s]).margin(x[side == s])
    model = boost(x, y)
    model.knots, model.levels = isotonic(margin, y)
    (first, seen), (second, more) = counted
    for kinds, others in zip(seen, more, strict=True):
        for mine, theirs in zip(kinds, others, strict=True):
            mine.update(theirs)
    return learn_lexicon([a + b for a, b in zip(first, second, strict=True)], seen), model


def score(docs: DataFrame, model: tuple[Lexicon, Boosted], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score`` for each row of ``docs``; null and empty texts are scored as having no words."""
    lexicon, trees = model
    memos: list[Memo] = []

    def run(ids: pa.Array, values: list[str | None]) -> pa.RecordBatch:
        if not memos:
            memos.append(Memo(lexicon))
        p = np.clip(trees.probability(features(values, memos[0])), 0, 1)
        return pa.RecordBatch.from_arrays([ids, pa.array(p, pa.float64())], ["doc_id", "score"])

    return map_texts(texts(docs, id_col, text_col), run, SCHEMA)


def clean(docs: DataFrame, model: tuple[Lexicon, Boosted], text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, unchanged, whose score is below ``threshold``; null and empty texts stay."""
    lexicon, trees = model
    memos: list[Memo] = []

    def keep(values: list[str | None]) -> list[bool]:
        if not memos:
            memos.append(Memo(lexicon))
        return [bool(p < threshold) or not v for v, p in zip(values, trees.probability(features(values, memos[0])), strict=True)]

    return keep_rows(docs, keep, text_col)


def train(docs: DataFrame, labels: DataFrame, rows: dict[str, int] | None = None) -> tuple[Lexicon, Boosted]:
    """Fit on the learnable labelled rows."""
    return fit(labelled(docs, labels, "toxic", rows or TRAIN_ROWS, TRAIN_CHARS, FOLDS, HELD_OUT))


def predictions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Train, then score every row: the contract's columns.

    Null and empty texts are scored as having no words; repeated rows give repeated rows; an empty
    table gives none. Without usable labels (none, or none of 0 and 1) every score is low and equal.
    Other columns, whatever their names, are not read. Whole texts are scored, however long.
    """
    out = score(docs, train(docs, labels))
    return out.select("doc_id", (remainder(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
