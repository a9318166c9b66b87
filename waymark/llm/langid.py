"""Language identification with a bidirectional gated recurrent network over bytes.

Every text is read whole, as UTF-8, in windows of ``WINDOW`` bytes (the state starts anew in each
window, so windows of all documents run side by side and a very long text needs no more memory
than a short one). At every byte position the forward and the backward state give a probability
for each language; a document's probabilities are their mean over all its positions. The network
is trained in numpy by backpropagation through time, on a bounded sample of labelled rows.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import keep_rows, map_texts, remainder, sample, texts

WINDOW = 512
#: Bounds of the training sample: documents of each language, and characters of each document.
TRAIN_DOCS, TRAIN_CHARS = 400, 512
#: Windows of each language in an epoch, and their bytes.
TRAIN_WINDOWS, TRAIN_WINDOW = 900, 128
HIDDEN, EPOCHS, BATCH, RATE, SEED = 10, 6, 128, 0.02, 11
FOLDS, HELD_OUT = 4, 2
LETTER = re.compile(r"[^\W\d_]")
SCHEMA = "doc_id long, lang_pred string, score double"


def has_letter(text: str | None) -> bool:
    """Word characters that are neither digits nor letters, such as fractions, don't count."""
    return bool(text) and any(m[0].isalpha() for m in LETTER.finditer(text))


def _direction(rng: np.random.Generator, hidden: int) -> dict[str, np.ndarray]:
    """Byte tables and recurrences of the reset gate, the update gate and the candidate."""
    net = {f"x{k}": rng.normal(0, 0.2, (256, hidden)).astype(np.float32) for k in "rzn"}
    return net | {f"u{k}": rng.normal(0, 0.3, (hidden, hidden)).astype(np.float32) for k in "rzn"}


def initial(n_langs: int, hidden: int = HIDDEN, seed: int = SEED) -> dict[str, np.ndarray]:
    """Untrained weights of both directions and of the output layer."""
    rng = np.random.default_rng(seed)
    net = {f"{d}.{k}": v for d in "fb" for k, v in _direction(rng, hidden).items()}
    net["o"] = rng.normal(0, 0.3, (2 * hidden, n_langs)).astype(np.float32)
    net["c"] = np.zeros(n_langs, np.float32)
    return net


def _gate(x: np.ndarray, h: np.ndarray, u: np.ndarray) -> np.ndarray:
    """The logistic function of x + h u, in place; x holds halved inputs, u is halved too."""
    x += h @ u
    np.tanh(x, out=x)
    x += 1.0
    x *= 0.5
    return x


def _states(net: dict, d: str, x: np.ndarray, keep: bool = False, alive: np.ndarray | None = None):
    """States (time, batch, hidden) of one direction over bytes x (time, batch).

    With ``alive``, only the first ``alive[t]`` sequences reach step t: columns are ordered by
    falling length, states beyond a sequence's end are zero, and neither direction sees padding.
    """
    xr, xz, ur, uz = (0.5 * net[f"{d}.{k}"] for k in ("xr", "xz", "ur", "uz"))
    xn, un = net[f"{d}.xn"], net[f"{d}.un"]
    steps, width = x.shape
    out = (np.empty if alive is None else np.zeros)((steps, width, un.shape[0]), un.dtype)
    before = np.zeros((width, un.shape[0]), un.dtype)
    kept = []
    for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
        n_alive = width if alive is None else alive[t]
        at, h = x[t, :n_alive], before[:n_alive]
        r, z, n = _gate(xr.take(at, 0), h, ur), _gate(xz.take(at, 0), h, uz), xn.take(at, 0)
        m = h @ un
        n += m * r
        np.tanh(n, out=n)
        if keep:
            kept.append((t, h, r, z, m, n))
        new = out[t, :n_alive]
        np.subtract(h, n, out=new)
        new *= z
        new += n
        before = out[t]
    return out, kept


def _softmax(logits: np.ndarray) -> np.ndarray:
    """Over the first axis, in place."""
    logits -= logits.max(axis=0)
    np.exp(logits, out=logits)
    logits /= logits.sum(axis=0)
    return logits


def _labels(net: dict, f: np.ndarray, b: np.ndarray) -> np.ndarray:
    hidden = f.shape[-1]
    logits = net["o"][:hidden].T @ f.reshape(-1, hidden).T
    logits += net["o"][hidden:].T @ b.reshape(-1, hidden).T
    logits += net["c"][:, None]
    return _softmax(logits).reshape(-1, *f.shape[:2])


def positions(net: dict, x: np.ndarray, alive: np.ndarray | None = None) -> np.ndarray:
    """Label probabilities (languages, time, batch) at every byte position."""
    return _labels(net, _states(net, "f", x, alive=alive)[0], _states(net, "b", x, alive=alive)[0])


def gradients(net: dict, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean cross-entropy over all positions and its gradient, by backpropagation through time."""
    steps, width = x.shape
    hidden = net["f.un"].shape[0]
    states = {d: _states(net, d, x, keep=True) for d in "fb"}
    p = _labels(net, states["f"][0], states["b"][0])
    loss = -float(np.log(p[y, :, np.arange(width)] + 1e-9).mean())
    p[y, :, np.arange(width)] -= 1
    p /= steps * width
    grad = {k: np.zeros_like(v) for k, v in net.items()}
    flat = p.reshape(len(net["c"]), -1)
    grad["c"] = flat.sum(1)
    order = np.argsort(x.ravel(), kind="stable")
    seen, starts = np.unique(x.ravel()[order], return_index=True)
    for i, d in enumerate("fb"):
        out, kept = states[d]
        part = slice(i * hidden, (i + 1) * hidden)
        grad["o"][part] = (flat @ out.reshape(-1, hidden)).T
        into = (flat.T @ net["o"][part].T).reshape(steps, width, hidden)
        carry = np.zeros((width, hidden), out.dtype)
        ur, uz, un = (net[f"{d}.{k}"] for k in ("ur", "uz", "un"))
        at = {k: np.empty((steps, width, hidden), out.dtype) for k in "rzn"}
        for t, h, r, z, m, n in reversed(kept):
            dh = into[t] + carry
            dn = dh * (1 - z) * (1 - n * n)
            dz = dh * (h - n) * z * (1 - z)
            dr = dn * m * r * (1 - r)
            dm = dn * r
            at["r"][t], at["z"][t], at["n"][t] = dr, dz, dn
            grad[f"{d}.ur"] += h.T @ dr
            grad[f"{d}.uz"] += h.T @ dz
            grad[f"{d}.un"] += h.T @ dm
            carry = dh * z + dr @ ur.T + dz @ uz.T + dm @ un.T
        for k, v in at.items():
            grad[f"{d}.x{k}"][seen] = np.add.reduceat(v.reshape(-1, hidden)[order], starts, axis=0)
    return loss, grad


def fit(rows: list[tuple[str, str]], hidden: int = HIDDEN, epochs: int = EPOCHS, seed: int = SEED) -> tuple[list[str], dict]:
    """Train on (text, language) rows with Adam; returns the languages and the weights."""
    langs = sorted({lang for _, lang in rows})
    net = initial(max(1, len(langs)), hidden, seed)
    windows, labels = [], []
    for text, lang in rows:
        raw = text.encode("utf-8", "replace")
        for at in range(0, len(raw), TRAIN_WINDOW):
            piece = raw[at : at + TRAIN_WINDOW]
            if len(piece) >= TRAIN_WINDOW // 4 or at == 0:
                windows.append(piece.ljust(TRAIN_WINDOW, b" "))
                labels.append(langs.index(lang))
    if len(langs) < 2 or not windows:
        return langs, net
    x = np.frombuffer(b"".join(windows), np.uint8).reshape(-1, TRAIN_WINDOW)
    y = np.array(labels)
    # Each language weighs the same, however many windows it has.
    rng = np.random.default_rng(seed)
    by = [np.flatnonzero(y == k) for k in range(len(langs))]
    each = min(TRAIN_WINDOWS, max(len(b) for b in by))
    m = {k: np.zeros_like(v) for k, v in net.items()}
    v = {k: np.zeros_like(a) for k, a in net.items()}
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(np.concatenate([rng.choice(b, each) for b in by]))
        for at in range(0, len(order), BATCH):
            pick = order[at : at + BATCH]
            _, grad = gradients(net, x[pick].T, y[pick])
            step += 1
            rate = RATE * (1 - 0.9 * epoch / epochs)
            for k, g in grad.items():
                np.clip(g, -1, 1, out=g)
                m[k] += 0.1 * (g - m[k])
                v[k] += 0.001 * (g * g - v[k])
                net[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return langs, net


def document_probabilities(net: dict, values: list[str | None], width: int = 1024) -> np.ndarray:
    """Mean position probabilities (documents, languages); a text without bytes gets zeros."""
    raws = [(v or "").encode("utf-8", "replace") for v in values]
    sizes = np.array([len(r) for r in raws])
    counts = -(-sizes // WINDOW)
    total = np.zeros((len(raws), len(net["c"])))
    if not counts.sum():
        return total
    blob = b"".join(r.ljust(int(n) * WINDOW, b" ") for r, n in zip(raws, counts, strict=True))
    x = np.frombuffer(blob, np.uint8).reshape(-1, WINDOW)
    owner = np.repeat(np.arange(len(raws)), counts)
    ends = np.full(len(x), WINDOW)
    some = counts > 0
    ends[np.cumsum(counts)[some] - 1] = (sizes - (counts - 1) * WINDOW)[some]
    # Windows of like length run together, so that short texts take short steps.
    order = np.argsort(-ends, kind="stable")
    sums = np.empty((len(x), total.shape[1]))
    for at in range(0, len(x), width):
        pick = order[at : at + width]
        longest = int(ends[pick[0]])
        if ends[pick[-1]] == longest:
            p = positions(net, np.ascontiguousarray(x[pick, :longest].T))
        else:
            inside = np.arange(longest)[:, None] < ends[pick][None, :]
            p = positions(net, np.ascontiguousarray(x[pick, :longest].T), inside.sum(axis=1)) * inside
        sums[pick] = p.sum(axis=1).T
    for k in range(total.shape[1]):
        total[:, k] = np.bincount(owner, sums[:, k], len(raws))
    return total / np.maximum(sizes, 1)[:, None]


def training_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = TRAIN_DOCS, fold=(FOLDS, HELD_OUT)) -> list[tuple[str, str]]:
    """A bounded sample of (text part, language) from the rows that may be learned from."""
    named = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"), docs[lang_col].cast("string").alias("lang"))
    if fold:
        named = named.where(remainder(F.col("doc_id"), fold[0]) != fold[1])
    size = F.length("text")
    start = F.pmod(F.xxhash64("doc_id"), F.greatest(size - TRAIN_CHARS, F.lit(1))).cast("int")
    part = F.substring(F.col("text"), start + 1, F.lit(TRAIN_CHARS))
    rows = sample(named, F.col("lang"), per_lang, SEED).where(F.col("text").isNotNull()).select("doc_id", part.alias("part"), "lang").collect()
    return [(r[1], r[2]) for r in sorted(rows, key=lambda r: (r[0] is None, r[0], r[1])) if r[1]]


def identify(docs: DataFrame, model: tuple[list[str], dict], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score``: one row per input row.

    A text that is null or holds no letter is ``und`` with score 0. With nothing learned every
    text is ``und``. Repeated rows give repeated results; a tie goes to the first language.
    """
    langs, net = model

    def label(ids: pa.Array, values: list[str | None]) -> pa.RecordBatch:
        known = [bool(langs) and has_letter(v) for v in values]
        p = document_probabilities(net, [v if k else None for v, k in zip(values, known, strict=True)])
        best = p.argmax(axis=1)
        names = [langs[b] if k else "und" for b, k in zip(best, known, strict=True)]
        return pa.RecordBatch.from_arrays([ids, pa.array(names, pa.string()), pa.array(np.clip(p.max(axis=1), 0, 1).round(5), pa.float64())], ["doc_id", "lang_pred", "score"])

    return map_texts(texts(docs, id_col, text_col), label, SCHEMA)


#: A best language whose mean probability is under this multiple of chance is no language found.
OVER_CHANCE = 1.2
#: No text over this goes. It is under chance for three languages or fewer, so there all lettered texts stay.
SURE = 0.3


def known(docs: DataFrame, model: tuple[list[str], dict], text_col: str = "text", over_chance: float = OVER_CHANCE) -> DataFrame:
    """The rows of ``docs``, unchanged, that are in one of the learned languages; texts without a letter go.

    Short texts and texts of two languages are often unsure and yet clean, so beside those without a
    letter only those go that the network tells hardly better than chance. With fewer than two
    languages there is nothing to tell apart, and every lettered text stays.
    """
    langs, net = model
    confident = min(over_chance / max(1, len(langs)), SURE) if len(langs) > 1 else 0.0

    def keep(values: list[str | None]) -> list[bool]:
        letters = [has_letter(v) for v in values]
        if not confident:
            return letters
        p = document_probabilities(net, [v if k else None for v, k in zip(values, letters, strict=True)]).max(axis=1)
        return [k and bool(x >= confident) for k, x in zip(letters, p, strict=True)]

    return keep_rows(docs, keep, text_col)


def predictions(docs: DataFrame) -> DataFrame:
    """Fit on the learnable rows of ``docs`` and predict every row: the contract's columns.

    Null texts and texts without a letter are ``und``; repeated rows give repeated rows; an empty table
    gives none. Languages beyond the ``base.MOST_STRATA`` most frequent are not learned. Other columns
    are not read. Whole texts are read, however long.
    """
    out = identify(docs, fit(training_rows(docs)))
    return out.select("doc_id", (remainder(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "lang_pred", "score")
