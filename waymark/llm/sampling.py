"""Sampled subword segmentations by forward filtering and backward sampling, and lossless decoding.

A text is a space, then the text, cut into segments (spaces and the word after them) that no piece
crosses, and worked on a stretch of segments at a time. Over the bytes of each distinct segment lies the lattice of all pieces; the forward pass
gives every node the total weight of the paths to it, and the backward pass draws an edge into
each node in proportion. Both passes run as arrays, the first over distinct segments, the second
over all occurrences. Draws come from a counter-based hash of the row's key, the occurrence and the
step, so a row gets the same segmentation wherever and with whatever neighbours it is processed.
A segment of any length is one lattice: a long one keeps its forward weights and has its edges made
again, some thousands of bytes at a time, on the way back.

The model file gives merge ranks rather than probabilities: a piece of rank r has the weight
``(r + RANK) ** -theta``; bytes have the weight of the last rank. Characters outside the vocabulary
are spelled in bytes, and so is a literal word-boundary sign, without which decoding would lose it.
"""

from __future__ import annotations

import re
import zlib
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .base import held, map_texts, texts
from .wordpiece import BEGIN, default_path

SEED, THETA, RANK = 20_240_501, 1.0, 10.0
#: Characters of a slice and of a stretch, nodes of the store, characters of a segment that it keeps, bytes of a long one's part.
SLICE, STRETCH, NODES, LONG, PART = 4 << 20, 1 << 20, 2_000_000, 200, 4096
#: Segments, which no piece crosses: spaces and what follows up to the next space; a line feed stands alone.
SEGMENT = re.compile(r" *[^ \n]+|\n| +")
#: Stand-ins for the three bytes of a literal boundary sign; they occur in no UTF-8 text.
LITERAL = bytes([0xF8, 0xF9, 0xFA])
SCHEMA = "doc_id long, pieces array<int>"
FACTS = "doc_id long, n_pieces long, ids_crc32 long, decoded_bytes long, lossless boolean"


class Model:
    """Trie over the bytes of all pieces, weights, and each piece's bytes."""

    def __init__(self, path: str, theta: float):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.bytes: list[bytes] = [b""] * n
        self.weight = np.zeros(n)
        self.byte_id = np.zeros(256, np.int32)
        nodes: list[dict[int, int]] = [{}]
        ends: dict[int, int] = {}
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                value = int(piece[3:5], 16)
                self.byte_id[value], self.bytes[i] = i, bytes([value])
                self.weight[i] = -theta * np.log(n + RANK)
            elif not (sp.is_control(i) or sp.is_unknown(i)):
                if "\n" in piece or BEGIN in piece.lstrip(BEGIN):
                    raise ValueError("a piece that crosses segments")
                self.bytes[i] = piece.replace(BEGIN, " ").encode()
                self.weight[i] = -theta * np.log(max(0.0, -sp.get_score(i)) + RANK)
                at = 0
                for b in piece.encode():
                    if b not in nodes[at]:
                        nodes[at][b] = len(nodes)
                        nodes.append({})
                    at = nodes[at][b]
                ends[at] = i
        for b, literal in zip(BEGIN.encode(), LITERAL, strict=True):
            self.byte_id[literal] = self.byte_id[b]
        self.step = np.zeros((len(nodes), 256), np.int32)
        for k, own in enumerate(nodes):
            for b, v in own.items():
                self.step[k, b] = v
        self.longest = max(len(p.replace(b" ", BEGIN.encode())) for p in self.bytes)
        self.piece = np.full(len(nodes), -1, np.int32)
        self.piece[list(ends)] = list(ends.values())
        self.store = Store()


def model(path: str, theta: float = THETA) -> Model:
    """One model for each worker process."""
    return held(("pieces", path, theta), lambda: Model(path, theta))


#: Bytes of a character, by its first byte; continuation bytes and stand-ins count as one.
SIZE = np.ones(256, np.int32)
SIZE[0xC0:0xE0], SIZE[0xE0:0xF0], SIZE[0xF0:0xF8] = 2, 3, 4


def raw_bytes(segment: str) -> bytes:
    """UTF-8 with boundary signs for spaces, and stand-ins for literal boundary signs."""
    if BEGIN in segment:
        return segment.replace(BEGIN, "\0\1\2").encode("utf-8", "replace").replace(b"\0\1\2", LITERAL).replace(b" ", BEGIN.encode())
    return segment.encode("utf-8", "replace").replace(b" ", BEGIN.encode())


def edges(m: Model, blob: np.ndarray, end: np.ndarray | int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, piece): all pieces that lie over ``blob`` and end by ``end``, and bytes where none does."""
    total = len(blob)
    # Every piece that starts at every byte, one byte deeper at a time.
    at, node = np.arange(total), np.zeros(total, np.int32)
    end = np.broadcast_to(end, (total,))
    starts, lengths, ids = [], [], []
    depth = 0
    while len(at):
        node = m.step[node, blob[at + depth]]
        depth += 1
        found = m.piece[node]
        hit = (node > 0) & (found >= 0)
        starts.append(at[hit]), lengths.append(np.full(int(hit.sum()), depth, np.int32)), ids.append(found[hit])
        alive = (node > 0) & (at + depth < end[at])
        at, node = at[alive], node[alive]
    start, length, piece = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (starts, lengths, ids))
    # Characters that no piece covers alone are spelled in bytes.
    char = (blob & 0xC0) != 0x80
    covered = np.zeros(total, bool)
    covered[start[length == SIZE[blob[start]]]] = True
    spelled = np.flatnonzero(char & ~covered)
    each = np.minimum(SIZE[blob[spelled]], end[spelled] - spelled)
    more = np.repeat(spelled, each) + (np.arange(int(each.sum())) - np.repeat(np.cumsum(each) - each, each))
    return np.concatenate([start, more]), np.concatenate([length, np.ones(len(more), np.int32)]), np.concatenate([piece, m.byte_id[blob[more]]])


class Lattice:
    """Lattices of many segments, filtered forward; ``draw`` samples backward.

    Nodes are the boundaries, one more than bytes in each segment; node t's edges, from its first on,
    have their sources, pieces, and the shares of t's weight that they and those before them carry.
    """

    def __init__(self, m: Model, segments: list[str]):
        raws = [raw_bytes(s) for s in segments]
        sizes = np.array([len(r) for r in raws], np.int64)
        total = int(sizes.sum())
        blob = np.frombuffer(b"".join(raws), np.uint8)
        owner = np.repeat(np.arange(len(raws)), sizes)
        first = np.cumsum(sizes) - sizes
        start, length, piece = edges(m, blob, (first + sizes)[owner])
        source = start + owner[start]
        target = source + length
        local = target - (first + np.arange(len(raws)))[owner[start]]
        order = np.lexsort((target, local))
        source, target, piece, local = source[order], target[order], piece[order], local[order]
        weight = m.weight[piece]
        alpha = np.full(total + len(raws), -np.inf)
        self.begin = first + np.arange(len(raws))
        self.end = self.begin + sizes
        alpha[self.begin] = 0.0
        cuts = np.searchsorted(local, np.arange(1, int(local[-1]) + 2 if len(local) else 1))
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if a == b:
                continue
            value = alpha[source[a:b]] + weight[a:b]
            t = target[a:b]
            groups = np.flatnonzero(np.diff(t, prepend=-1))
            high = np.maximum.reduceat(value, groups)
            high[np.isinf(high)] = 0.0
            with np.errstate(divide="ignore"):
                alpha[t[groups]] = high + np.log(np.add.reduceat(np.exp(value - np.repeat(high, np.diff(groups, append=b - a))), groups))
        live = np.isfinite(alpha[source])
        source, target, piece, weight = source[live], target[live], piece[live], weight[live]
        order = np.argsort(target, kind="stable")
        self.source, self.piece, target = source[order].astype(np.int32), piece[order].astype(np.int32), target[order]
        p = np.cumsum(np.exp(alpha[self.source] + weight[order] - alpha[target]))
        groups = np.flatnonzero(np.diff(target, prepend=-1))
        before = np.concatenate([[0.0], p])[groups]
        runs = np.diff(groups, append=len(target))
        self.share = p - np.repeat(before, runs)
        if len(groups):
            self.share[groups + runs - 1] = 1.0
        self.first = np.searchsorted(target, np.arange(len(alpha))).astype(np.int32)

    def draw(self, segment: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(pieces of all occurrences in order, how many each has); ``key`` seeds each occurrence."""
        at, begin = self.end[segment], self.begin[segment]
        counts = np.zeros(len(segment), np.int64)
        live = np.flatnonzero(at > begin)
        found = []
        step = 0
        while len(live):
            e = self.first[at[live]]
            u = uniform(key[live], step)
            # The few edges of a node are tried in turn; the last one's share is 1.
            on = np.flatnonzero(self.share[e] <= u)
            while len(on):
                e[on] += 1
                on = on[self.share[e[on]] <= u[on]]
            found.append((live, self.piece[e]))
            counts[live] += 1
            here = self.source[e]
            at[live] = here
            live = live[here > begin[live]]
            step += 1
        last = np.cumsum(counts) - 1
        out = np.empty(int(counts.sum()), np.int32)
        for k, (who, piece) in enumerate(found):
            out[last[who] - k] = piece
        return out, counts


def draw_long(m: Model, segment: str, key: np.ndarray) -> np.ndarray:
    """The pieces that ``Lattice.draw`` gives one segment, with 8 bytes held for each of its bytes."""
    blob = np.frombuffer(raw_bytes(segment), np.uint8)
    n = len(blob)
    alpha = np.full(n + 1, -np.inf)
    alpha[0] = 0.0

    def into(a: int, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sources and pieces of the edges into the nodes after ``a`` up to ``b``, and each node's first."""
        low = max(0, a - m.longest)
        while low and blob[low] & 0xC0 == 0x80:
            low -= 1
        part = blob[low : b + m.longest + 4]
        start, length, piece = edges(m, part, len(part))
        start, target = start + low, start + low + length
        inside = (target > a) & (target <= b)
        start, target, piece = start[inside], target[inside], piece[inside]
        order = np.argsort(target, kind="stable")
        return start[order], piece[order], np.searchsorted(target[order], np.arange(a + 1, b + 2))

    for a in range(0, n, PART):
        b = min(n, a + PART)
        source, piece, first = into(a, b)
        weight = m.weight[piece]
        for t in range(a + 1, b + 1):
            own = slice(first[t - a - 1], first[t - a])
            value = alpha[source[own]] + weight[own]
            high = value.max() if len(value) else -np.inf
            if high > -np.inf:
                alpha[t] = high + np.log(np.exp(value - high).sum())
    found, t, step = [], n, 0
    for a in reversed(range(0, n, PART)):
        source, piece, first = into(a, min(n, a + PART))
        while t > a:
            own = np.arange(first[t - a - 1], first[t - a])
            own = own[np.isfinite(alpha[source[own]])]
            share = np.cumsum(np.exp(alpha[source[own]] + m.weight[piece[own]] - alpha[t]))
            e = own[min(int(np.searchsorted(share, uniform(key, step)[0], side="right")), len(own) - 1)]
            found.append(piece[e])
            t, step = int(source[e]), step + 1
    return np.array(found[::-1], np.int32)


class Names(dict):
    """Segment -> its number, in the order of first sight."""

    def __missing__(self, segment: str) -> int:
        self[segment] = n = len(self)
        return n


class Store:
    """Lattices of the segments that a worker has met lately; forgotten beyond ``NODES`` nodes."""

    def __init__(self):
        self.names, self.lattice, self.room = Names(), None, {}

    def number(self, cut: list[list[str]]) -> list[np.ndarray]:
        if self.lattice is not None and len(self.lattice.first) > NODES:
            self.names, self.lattice, self.room = Names(), None, {}
        return [np.fromiter(map(self.names.__getitem__, c), np.int64, len(c)) for c in cut]

    def filtered(self, m: Model) -> Lattice:
        """The lattice of all numbered segments; only those that are new are filtered, and added in place."""
        known = 0 if self.lattice is None else len(self.lattice.begin)
        if len(self.names) > known:
            new, old = Lattice(m, list(islice(self.names, known, None))), self.lattice
            nodes, links = (len(old.first), len(old.source)) if old else (0, 0)
            for name, shift in (("begin", nodes), ("end", nodes), ("source", nodes), ("first", links), ("piece", 0), ("share", 0)):
                more = getattr(new, name)
                size = len(getattr(old, name)) if old else 0
                room = self.room.get(name)
                if room is None or len(room) < size + len(more):
                    room = np.empty(2 * (size + len(more)), more.dtype)
                    if old:
                        room[:size] = getattr(old, name)
                    self.room[name] = room
                room[size : size + len(more)] = more + more.dtype.type(shift) if shift else more
                setattr(new, name, room[: size + len(more)])
            self.lattice = new
        return self.lattice


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser of 64-bit words (splitmix)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def uniform(key: np.ndarray, step: int) -> np.ndarray:
    """Numbers in [0, 1), a step of each key's stream."""
    offset = np.uint64((step + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    # 20 bits less than a double has, so that adding a node's number loses none of them.
    return (mix(key + offset) >> np.uint64(32)).astype(np.float64) / 4294967296.0


def stretches(values: list[str | None]):
    """Lists of (row, first place, segments) of at most about ``STRETCH`` characters together."""
    waiting: list[tuple[int, int, list[str]]] = []
    size = 0
    for i, v in enumerate(values):
        if not v:
            continue
        if len(v) < STRETCH:
            waiting.append((i, 0, SEGMENT.findall(" " + v)))
            size += len(v)
        else:
            place = 0
            found = (x[0] for x in SEGMENT.finditer(" " + v))
            while part := list(islice(found, STRETCH >> 3)):
                waiting.append((i, place, part))
                place += len(part)
                yield waiting
                waiting, size = [], 0
        if size >= STRETCH:
            yield waiting
            waiting, size = [], 0
    if waiting:
        yield waiting


def encode(m: Model, values: list[str | None], row_keys: np.ndarray, seed: int = SEED) -> list[np.ndarray]:
    """A sampled segmentation of each whole text, as piece ids; null counts as empty."""
    out: list[list[np.ndarray]] = [[] for _ in values]
    base = mix(row_keys.astype(np.int64).view(np.uint64) ^ np.uint64(seed))
    for part in stretches(values):
        long = [[k for k, s in enumerate(cut) if len(s) > LONG] if max(map(len, cut)) > LONG else [] for _, _, cut in part]
        # A long segment leaves an empty one in its place.
        cuts = [[s if len(s) <= LONG else "" for s in cut] if own else cut for own, (_, _, cut) in zip(long, part, strict=True)]
        counts = np.array([len(c) for c in cuts], np.int64)
        flat = np.concatenate(m.store.number(cuts))
        place = np.arange(len(flat)) - np.repeat(np.cumsum(counts) - counts - np.array([p for _, p, _ in part]), counts)
        key = mix(np.repeat(base[[i for i, _, _ in part]], counts) + place.astype(np.uint64) * np.uint64(0xD1342543DE82EF95))
        ids, pieces = m.store.filtered(m).draw(flat, key)
        starts = np.concatenate([[0], np.cumsum(pieces)])
        at = 0
        for (i, _, cut), own, n in zip(part, long, counts.tolist(), strict=True):
            here = at
            for k in own:
                out[i] += [ids[starts[here] : starts[at + k]], draw_long(m, cut[k], key[at + k : at + k + 1])]
                here = at + k
            at += n
            out[i].append(ids[starts[here] : starts[at]])
    return [p[0] if len(p) == 1 else np.concatenate([np.zeros(0, np.int32), *p]) for p in out]


def decode(m: Model, ids: np.ndarray) -> bytes:
    """The text's UTF-8 bytes, from its piece ids."""
    return b"".join(map(m.bytes.__getitem__, ids.tolist()))[1:]


def _keys(ids: pa.Array) -> np.ndarray:
    return ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)


def segmentations(docs: DataFrame, path: str | None = None, theta: float = THETA, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, pieces``: a sampled segmentation of each row; null and empty texts have no pieces.

    Rows of equal id and text get equal pieces; a null id is the key 0.
    """
    path = path or default_path()

    def run(ids: pa.Array, values: list[str | None]) -> pa.RecordBatch:
        found = encode(model(path, theta), values, _keys(ids), seed)
        return pa.RecordBatch.from_arrays([ids, pa.array(found, pa.list_(pa.int32()))], ["doc_id", "pieces"])

    return map_texts(texts(docs, id_col, text_col), run, SCHEMA, SLICE)


def texts_of(pieces: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id, text`` from ``doc_id, pieces``; a null list gives a null text."""
    path = path or default_path()

    def run(batches):
        for batch in batches:
            values = [None if p is None else decode(model(path), np.array(p, np.int64)).decode("utf-8", "replace") for p in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.string())], ["doc_id", "text"])

    return pieces.select("doc_id", "pieces").mapInArrow(run, "doc_id long, text string")


def facts(docs: DataFrame, path: str | None = None, theta: float = THETA, seed: int = SEED) -> DataFrame:
    """Sample, decode again and compare: ``FACTS`` for each row.

    Null and empty texts have no pieces; a null id is the key 0; rows of equal id and text have equal
    facts; an empty table gives none; other columns are not read. Texts are sampled whole.
    """
    path = path or default_path()

    def run(ids: pa.Array, values: list[str | None]) -> pa.RecordBatch:
        m = model(path, theta)
        rows = []
        for v, found in zip(values, encode(m, values, _keys(ids), seed), strict=True):
            back = decode(m, found)
            rows.append((len(found), zlib.crc32(found.astype("<u4").tobytes()), len(back), back == (v or "").encode("utf-8", "replace")))
        n, crc, size, same = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(crc, pa.int64()), pa.array(size, pa.int64()), pa.array(same, pa.bool_())], ["doc_id", "n_pieces", "ids_crc32", "decoded_bytes", "lossless"])

    return map_texts(texts(docs), run, FACTS, SLICE)
