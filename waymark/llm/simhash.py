"""Near-duplicates by SimHash, joined within a Hamming radius through vantage-point trees.

A text's fingerprint has a bit set where over half of its shingles' hashes do. Two fingerprints
within the radius differ in at most half of it (rounded down) on one half of their bits; so there is
a tree over each half, which looks for pairs within that reach on its half, and every pair that meets
is compared over all bits. A node sends fingerprints within ``mu`` of its vantage point to one side
and the rest to the other. By the triangle inequality a pair within the reach that a node separates
has its inner member at ``mu - reach < d``, so inner fingerprints of that band also visit the outer
side, as guests; guests visit every side that their bound can't exclude. The tops of the trees deal
fingerprints to shards: a shard over its size is split again, round by round, by a tree grown from a
bounded sample of it. A shard goes on with its own tree down to small blocks, which are compared
exactly, and returns a spanning forest of its links: never all pairs of a group.

Why two halves: no function that moves by at most one a bit spreads wider over 64 random bits than a
standard deviation of 4, so about half of all guests lie within 3 of any balanced cut and go both
ways; within 1 of a cut over 32 bits lie a quarter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.session import checkpoint

from .base import map_texts, settled, texts
from .components import components, forest

WORDS, RADIUS, SEED = 3, 3, 42
#: Rows of a shard above which it is split, rows of all samples of a round, and the fewest for a split.
SHARD, SAMPLE, FEWEST = 65_536, 65_536, 64
#: The bits that a tree looks at: of the lower half, of the upper half, and all.
HALVES, ALL = (np.uint64(0xFFFFFFFF), np.uint64(0xFFFFFFFF00000000)), np.uint64(0xFFFFFFFFFFFFFFFF)
#: Comparisons of a block, and shingles that are summed at a time.
CELLS, SHINGLES = 1 << 16, 1 << 17


def _digests(words: list[bytes], size: int) -> bytes:
    if len(words) < size:
        return xxhash.xxh64_digest(b" ".join(words), SEED)
    digest, seed = xxhash.xxh64_digest, SEED
    return b"".join([digest(s, seed) for s in map(b" ".join, zip(*(words[k:] for k in range(size)), strict=False))])


def fingerprints(values: list[str | None], size: int = WORDS) -> np.ndarray:
    """Fingerprints as uint64; ASCII letters are lower-cased, words split at ASCII white space.

    A text with fewer words than a shingle is one shingle; without words its fingerprint is 0.
    Long texts are summed in parts, so memory is bounded by a part and not by the text.
    """
    counts = np.zeros((len(values), 64), np.int64)
    totals = np.zeros(len(values), np.int64)
    pending: list[bytes] = []
    owners: list[int] = []
    sizes: list[int] = []

    def flush() -> None:
        if pending:
            bits = np.unpackbits(np.frombuffer(b"".join(pending), np.uint8)).reshape(-1, 64)
            starts = np.cumsum(sizes) - sizes
            np.add.at(counts, owners, np.add.reduceat(bits, starts, axis=0, dtype=np.int32))
            np.add.at(totals, owners, sizes)
            pending.clear(), owners.clear(), sizes.clear()

    waiting = 0
    for i, value in enumerate(values):
        words = value.encode("utf-8", "replace").lower().split() if value else []
        if not words:
            continue
        for at in range(0, max(1, len(words) - size + 1), SHINGLES):
            part = _digests(words[at : at + SHINGLES + size - 1], size)
            pending.append(part), owners.append(i), sizes.append(len(part) // 8)
            waiting += len(part) // 8
            if waiting >= SHINGLES:
                flush()
                waiting = 0
    flush()
    return np.packbits(counts * 2 > totals[:, None], axis=1).view(">u8").ravel().astype(np.uint64)


def fingerprint_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = WORDS) -> DataFrame:
    """``(doc_id, fp)`` of each row, the 64 bits as a signed long."""

    def run(ids: pa.Array, values: list[str | None]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([ids, pa.array(fingerprints(values, size).view(np.int64))], ["doc_id", "fp"])

    return map_texts(texts(docs, id_col, text_col), run, "doc_id long, fp long")


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b)


def _cut(own: np.ndarray, mask: np.uint64, reach: int, rng: np.random.Generator) -> tuple[np.uint64, int] | None:
    """The vantage point and the distance, of a few, that send fewest fingerprints both ways for what they part."""
    best = None
    for v in own[rng.integers(len(own), size=4)]:
        mass = np.bincount(distance(own & mask, v & mask), minlength=65) / len(own)
        inner = np.cumsum(mass)
        for m in np.flatnonzero((inner > 0.1) & (inner < 0.9)).tolist() or [int(np.argmin(np.abs(inner - 0.5)))]:
            p = float(inner[m])
            if not 1e-9 < p < 1 - 1e-9:
                continue
            cost = np.log1p(mass[max(0, m - reach + 1) : m + reach + 1].sum()) / -(p * np.log(p) + (1 - p) * np.log(1 - p))
            # Lopsided cuts, which are taken only where no other is, come after all others.
            cost = (not 0.1 < p < 0.9, cost)
            if best is None or cost < best[0]:
                best = (cost, v, m)
    return best and best[1:]


Tree = tuple[np.ndarray, np.ndarray, np.ndarray]


def grow(points: np.ndarray, mask: np.uint64, reach: int, each: float, most: int) -> Tree:
    """A tree over a sample of which each point stands for ``each`` rows, down to leaves of ``most`` rows.

    Arrays of vantage points, distances and children (inner, outer); a child ``-1 - k`` is leaf k.
    """
    vantage, mu, child = [], [], []
    rng = np.random.default_rng(SEED)
    leaves = 0
    stack = [(points, -1, 0)]
    while stack:
        own, parent, side = stack.pop()
        cut = _cut(own, mask, reach, rng) if len(own) >= FEWEST and len(own) * each > most else None
        if cut is None:
            leaves += 1
            here = -leaves
        else:
            here = len(mu)
            vantage.append(cut[0]), mu.append(cut[1]), child.append([0, 0])
            inner = distance(own & mask, cut[0] & mask) <= cut[1]
            stack += [(own[inner], here, 0), (own[~inner], here, 1)]
        if parent >= 0:
            child[parent][side] = here
    return np.array(vantage, np.uint64), np.array(mu, np.int64), np.array(child, np.int64).reshape(-1, 2)


def deal(points: np.ndarray, home: np.ndarray, tree: Tree, mask: np.uint64, reach: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(leaf, index into points, is home): where each point lives or goes on as a guest, and where it visits."""
    vantage, mu, child = tree
    at, node = np.arange(len(points)), np.zeros(len(points), np.int64)
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    while len(at):
        d = distance(points[at] & mask, vantage[node] & mask).astype(np.int64)
        m = mu[node]
        inner = np.where(home, d <= m, d <= m + reach)
        outer = np.where(home, d > m, d > m - reach)
        visit = home & inner & (d > m - reach)
        at, node, home = (np.concatenate(p) for p in zip((at[inner], child[node[inner], 0], home[inner]), (at[outer], child[node[outer], 1], home[outer]), (at[visit], child[node[visit], 1], np.zeros(visit.sum(), bool)), strict=True))
        there = node < 0
        out.append((-1 - node[there], at[there], home[there]))
        at, node, home = at[~there], node[~there], home[~there]
    return tuple(np.concatenate(p) for p in zip(*out, strict=True)) if out else (node, at, home)


def _search(points: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links of a set that no vantage point splits well: breadth first, over what is left."""
    a, b = [], []
    left = points
    while len(left) > 1:
        root, left = left[0], left[1:]
        frontier = np.array([root], np.uint64)
        while len(frontier) and len(left):
            part, frontier = frontier[:64], frontier[64:]
            hit = (distance(part[:, None], left[None, :]) <= radius).any(axis=0)
            if hit.any():
                new = left[hit]
                a.append(np.full(len(new), root)), b.append(new)
                frontier, left = np.concatenate([frontier, new]), left[~hit]
    return (np.concatenate(a), np.concatenate(b)) if a else (points[:0], points[:0])


def links(home: np.ndarray, guest: np.ndarray, radius: int = RADIUS, mask: np.uint64 = ALL) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect all home-home and home-guest pairs within the radius whose halves ``mask`` are within reach.

    A set that no vantage point splits by its half goes on by all bits.
    """
    rng = np.random.default_rng(SEED)
    out: list[tuple[np.ndarray, np.ndarray]] = []
    stack = [(home, guest, mask)]
    while stack:
        h, g, mask = stack.pop()
        reach = radius if mask == ALL else radius // 2
        if not len(h) or len(h) + len(g) < 2:
            continue
        if len(h) * (len(h) + len(g)) <= CELLS:
            both = np.concatenate([h, g])
            i, j = np.nonzero(distance(h[:, None], both[None, :]) <= radius)
            far = i < j
            i, j = i[far], j[far]
            out.append((h[i], both[j]) if len(i) <= 4 * len(both) else _search(both, radius))
            continue
        v = h[rng.integers(len(h))] & mask
        dh, dg = distance(h & mask, v).astype(np.int64), distance(g & mask, v).astype(np.int64)
        m = int(np.median(dh))
        if dh.max() == m:
            m -= 1
        inner = dh <= m
        sides = [(h[inner], g[dg <= m + reach], mask), (h[~inner], np.concatenate([g[dg > m - reach], h[inner & (dh > m - reach)]]), mask)]
        if sum(len(x) * (len(x) + len(y)) for x, y, _ in sides) <= 0.97 * len(h) * (len(h) + len(g)):
            stack += sides
        elif mask != ALL:
            stack.append((h, g, ALL))
        else:
            out.append(_search(np.unique(np.concatenate([h, g])), radius))
    if not out:
        return home[:0], home[:0]
    return np.concatenate([x for x, _ in out]), np.concatenate([y for _, y in out])


def placed(points: DataFrame, radius: int, shard: int) -> DataFrame:
    """``shard, fp, home``: the distinct fingerprints ``points(fp)`` in shards, of each half's tree.

    An even shard belongs to the lower half, an odd one to the upper. Rounds go on until no shard that
    can be split has over ``shard`` rows; each round grows trees from ``SAMPLE`` fingerprints in all,
    whose choice changes the balance of the shards and never the result.
    """
    reach = radius // 2
    rows = points.select(F.explode(F.array(F.lit(0).cast("long"), F.lit(1).cast("long"))).alias("shard"), "fp", F.lit(True).alias("home"))
    whole: list[int] = []
    next_id = 1
    while True:
        large = rows.groupBy("shard").count().where(F.col("count") > shard).where(~F.col("shard").isin(whole))
        sizes = {r[0]: r[1] for r in large.orderBy(F.desc("count"), "shard").limit(SAMPLE // 1024).collect()}
        if not sizes:
            return rows
        share = min(1.0, SAMPLE / sum(sizes.values()))
        picked = rows.where(F.col("shard").isin(list(sizes)) & F.col("home")).where(F.pmod(F.xxhash64("fp"), F.lit(1 << 30)) < F.lit(int(share * (1 << 30))))
        held: dict[int, list[int]] = {}
        for s, fp in picked.select("shard", "fp").collect():
            held.setdefault(s, []).append(fp)
        trees: dict[int, tuple[Tree, int]] = {}
        for s, size in sorted(sizes.items()):
            own = np.sort(np.array(held.get(s, []), np.int64)).view(np.uint64)
            tree = grow(own, HALVES[s % 2], reach, size / max(1, len(own)), shard)
            if len(tree[1]):
                trees[s] = (tree, next_id)
                next_id += len(tree[1]) + 1
            else:
                whole.append(s)
        if trees:
            rows = checkpoint(split(rows, trees, reach))


def split(rows: DataFrame, trees: dict[int, tuple[Tree, int]], reach: int) -> DataFrame:
    """The rows of the shards that have a tree dealt to its leaves, which are numbered on from its number; others as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 8192):
                shard, fp, home = (c.to_numpy(zero_copy_only=False) for c in batch.slice(at, 8192).columns)
                fp, parts = fp.view(np.uint64), []
                for s in np.unique(shard):
                    i = np.flatnonzero(shard == s)
                    if int(s) in trees:
                        tree, first = trees[int(s)]
                        leaf, k, own = deal(fp[i], home[i], tree, HALVES[s % 2], reach)
                        parts.append((2 * (first + leaf) + s % 2, fp[i[k]], own))
                    else:
                        parts.append((shard[i], fp[i], home[i]))
                shard, fp, home = (np.concatenate(p) for p in zip(*parts, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(shard.astype(np.int64)), pa.array(fp.view(np.int64)), pa.array(home)], ["shard", "fp", "home"])

    return rows.select("shard", "fp", "home").mapInArrow(run, "shard long, fp long, home boolean")


def near(points: DataFrame, radius: int = RADIUS, shard: int = SHARD) -> DataFrame:
    """``(u, v)``: links that span every component of the distinct fingerprints ``points(fp)``."""

    def join(table: pa.Table) -> pa.Table:
        fp = table.column("fp").to_numpy().view(np.uint64)
        home = table.column("home").to_numpy()
        v, root = forest(*links(fp[home], fp[~home], radius, HALVES[table.column("shard")[0].as_py() % 2]))
        return pa.table({"u": v.view(np.int64), "v": root.view(np.int64)})

    return placed(points, radius, shard).groupBy("shard").applyInArrow(join, "u long, v long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """``doc_id, fingerprint, component_id``, a row for each row of ``docs``.

    Null and empty texts have fingerprint zero and link like any other. A component's id is the
    smallest doc_id in it; null ids are never chosen unless there is no other. Repeated rows give
    repeated rows, an empty table none; other columns, whatever their names, are not read. Texts are
    read whole, however long.
    """
    table = checkpoint(fingerprint_table(docs, id_col, text_col, size))
    return linked(table, radius).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def linked(table: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``doc_id, fp, component_id`` for each row of ``table(doc_id, fp)``."""
    points, _ = settled(table.groupBy("fp").agg(F.min("doc_id").alias("least")), SHARD // 4)
    roots = components(near(points.select("fp"), radius, SHARD)).select(F.col("v").alias("fp"), "root")
    named, _ = settled(points.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root")))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    found = named.join(least, "root").select("fp", "component_id")
    return table.join(found, "fp").select("doc_id", "fp", "component_id")
