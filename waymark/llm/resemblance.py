"""Near copies by the Jaccard similarity of five-word shingles, exact for every candidate pair.

Candidates come from three places. The vantage-point trees of operator 1 link texts whose five-word
fingerprints differ in at most three bits. A radius that holds all pairs of similarity 0.8 would be
12 of 64 bits or more, where a vantage point excludes next to nothing; so texts whose ``ROWS`` minima
agree in one of ``BANDS`` MinHash bands share a bucket (a pair of similarity s is missed with
probability (1 - s^ROWS)^BANDS, 3e-6 at 0.8), and each is compared with its bucket's representative.
What a bucket's representatives did not bring together is settled exactly by prefixes: two texts of
similarity 0.8 share one of their rarest fifth of shingles, so only texts that share such a shingle
and are still apart are compared. No group costs a square, and no bucket is cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.session import checkpoint, ship

from .base import few, map_texts, release, sent, settled, texts
from .components import components
from .simhash import _digests, linked

#: Words of a shingle, and the least similarity of a near copy in percent.
WORDS, LEAST = 5, 80
BANDS, ROWS, SEED, PART = 24, 4, 42, 4096
#: Orders in which buckets choose representatives, and counters of the sketch of shingle counts.
ORDERS, COUNTERS = 4, 1 << 18
#: Rows of a partition that hold a text, its shingles or its band keys, where their number is known.
WIDE = 1 << 13
_rng = np.random.default_rng(SEED)
_A = _rng.integers(0, 1 << 64, BANDS * ROWS, np.uint64) | np.uint64(1)
_B = _rng.integers(0, 1 << 64, BANDS * ROWS, np.uint64)


def hashes(text: str | None) -> np.ndarray:
    """Hashes of all shingles; words as operator 1 splits them, a shorter text is one shingle."""
    words = text.encode("utf-8", "replace").lower().split() if text else []
    return np.frombuffer(_digests(words, WORDS), ">u8").astype(np.uint64) if words else np.zeros(0, np.uint64)


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct hashes."""
    return np.unique(hashes(text))


def fingerprint(own: np.ndarray) -> int:
    """The bits that over half of the hashes have set, as a signed long."""
    votes = np.zeros(64, np.int64)
    for at in range(0, len(own), PART):
        votes += np.unpackbits(own[at : at + PART].astype(">u8").view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(own)).view(">i8")[0])


def band_keys(own: np.ndarray) -> list[int]:
    """A signed hash of each band's minima; texts are taken in parts, so memory is bounded."""
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(own), PART):
        np.minimum(low, (own[at : at + PART, None] * _A + _B).min(axis=0), out=low)
    raw = low.reshape(BANDS, ROWS)
    return [xxhash.xxh64_intdigest(r.tobytes(), k) - (1 << 63) for k, r in enumerate(raw)]


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether the Jaccard similarity of two shingle sets reaches the least."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both > 0 and 100 * both >= LEAST * (len(a) + len(b) - both)


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n, fp, keys)`` of the texts that have a word and an id: distinct shingles, fingerprint, band keys."""

    def run(ids: pa.Array, values: list[str | None]) -> pa.RecordBatch:
        n, fp, keys = [], [], []
        for v in values:
            own = hashes(v)
            fp.append(fingerprint(own))
            own = np.unique(own)
            n.append(len(own))
            keys.append(band_keys(own) if len(own) else [])
        return pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(fp, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "n", "fp", "keys"])

    return map_texts(texts(docs, id_col, text_col), run, "doc_id long, n long, fp long, keys array<long>").where("doc_id is not null and n > 0")


def _sized(a: str, b: str) -> Column:
    """Sets whose sizes differ more can't be alike."""
    return F.least(a, b) * 100 >= F.greatest(a, b) * LEAST


def _pairs(rows: DataFrame, a: str, b: str) -> DataFrame:
    return rows.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).where("u <> v").distinct()


def verified(held: DataFrame, pairs: DataFrame) -> DataFrame:
    """The distinct ``pairs(u, v)`` whose texts in ``held(doc_id, text)`` are alike by exact comparison."""
    ship(held.sparkSession)
    both = pairs.join(held.select(F.col("doc_id").alias("v"), F.col("text").alias("b")), "v").join(held.select(F.col("doc_id").alias("u"), F.col("text").alias("a")), "u")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: list[tuple[str | None, np.ndarray]] = [("", np.zeros(0, np.uint64))] * 2

        def own(side: int, text: str) -> np.ndarray:
            if text != last[side][0]:
                last[side] = (text, shingles(text))
            return last[side][1]

        for batch in batches:
            u, v, a, b = (batch.column(k) for k in range(4))
            keep = [alike(own(0, a[k].as_py()), own(1, b[k].as_py())) for k in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([u, v], ["u", "v"]).filter(pa.array(keep, pa.bool_()))
        release()

    return settled(both.select("u", "v", "a", "b").mapInArrow(run, "u long, v long"))[0]


def main_roots(rows: DataFrame, key: str) -> DataFrame:
    """``key, main`` for each key whose rows have several roots: the root of most of them."""
    count = rows.groupBy(key, "root").count()
    return count.groupBy(key).agg(F.max_by("root", F.struct("count", "root")).alias("main"), F.count(F.lit(1)).alias("roots")).where("roots > 1").select(key, "main")


def prefixes(mixed: DataFrame) -> DataFrame:
    """``(token, doc_id, root, n, at)``: the rarest shingles of each of ``mixed(doc_id, root, text)``, with their ranks.

    As many as no text of similarity 0.8 can do without one of. Any order that all texts share gives
    right results; rarity is read from a sketch of ``COUNTERS`` counts, which is all that goes to the
    driver.
    """

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                yield pa.RecordBatch.from_arrays([*part.columns[:2], pa.array([shingles(t.as_py()).view(np.int64) for t in part.column(2)], pa.list_(pa.int64()))], ["doc_id", "root", "tokens"])
        release()

    held, _ = settled(mixed.select("doc_id", "root", "text").mapInArrow(sets, "doc_id long, root long, tokens array<long>"), WIDE)
    slots = held.select(F.explode("tokens").alias("token")).select(F.pmod("token", F.lit(COUNTERS)).alias("slot"))
    sketch = np.zeros(COUNTERS, np.int32)
    for slot, n in slots.groupBy("slot").count().where("count > 1").collect():
        sketch[slot] = min(n, 2**31 - 1)

    def rarest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                found, sizes = [], []
                for tokens in part.column(2):
                    own = tokens.values.to_numpy(zero_copy_only=False)
                    own = own[np.lexsort((own, sketch[own % COUNTERS]))]
                    sizes.append(len(own))
                    found.append(own[: len(own) - -(-LEAST * len(own) // 100) + 1])
                uses = np.array([len(f) for f in found])
                row = np.repeat(np.arange(len(found)), uses)
                rank = np.arange(len(row)) - np.repeat(np.cumsum(uses) - uses, uses)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found)), part.column(0).take(pa.array(row)), part.column(1).take(pa.array(row)), pa.array(np.array(sizes, np.int64)[row]), pa.array(rank.astype(np.int64))], ["token", "doc_id", "root", "n", "at"])
        release()

    return settled(held.mapInArrow(rarest, "token long, doc_id long, root long, n long, at long"))[0]


def apart(rows: DataFrame) -> DataFrame:
    """Pairs of ``prefixes`` rows of different roots that share a token and can be alike by size and place."""
    known = rows.join(main_roots(rows, "token"), "token")
    a = known.where("root <> main").select("token", F.col("doc_id").alias("p"), F.col("n").alias("pn"), F.col("root").alias("pr"), F.col("at").alias("pa"))
    b = known.select("token", F.col("doc_id").alias("q"), F.col("n").alias("qn"), F.col("root").alias("qr"), F.col("at").alias("qa"))
    # Of the tokens that two texts share the first has all others behind it in both.
    most = F.least(F.col("pn") - F.col("pa"), F.col("qn") - F.col("qa"))
    return _pairs(a.join(b, "token").where("pr <> qr").where(most * (100 + LEAST) >= (F.col("pn") + F.col("qn")) * LEAST), "p", "q")


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, component_id)`` of every text that a near copy of smaller id is linked to; ids must be distinct.

    Texts without a word and rows without an id have no near copies. An empty table gives none.
    """
    sig, _ = settled(signatures(docs, id_col, text_col), WIDE)
    near = linked(sig.select("doc_id", "fp")).where("doc_id <> component_id")
    rows = sig.select("doc_id", "n", F.posexplode("keys").alias("band", "key"))
    buckets = rows.groupBy("key").agg(F.count(F.lit(1)).alias("held")).where("held > 1")
    met, _ = settled(rows.join(buckets, "key").select("key", "doc_id", "n", "held", F.xxhash64(F.col("band") % ORDERS, "doc_id").alias("order")))
    # The text that meets most others in its buckets is the middle of its group.
    middle = met.groupBy("doc_id").agg(F.sum("held").alias("meets"))
    own = F.struct(F.col("doc_id").alias("rep"), F.col("n").alias("rep_n"))
    reps = met.join(middle, "doc_id").groupBy("key").agg(F.max_by(own, F.struct("meets", "doc_id")).alias("first"), F.min_by(own, F.struct("order", "doc_id")).alias("second"))
    shared = met.join(reps, "key").select("doc_id", "n", F.explode(F.array_distinct(F.array("first", "second"))).alias("r")).select("doc_id", "n", "r.rep", "r.rep_n")
    shared, _ = settled(_pairs(shared.where(_sized("n", "rep_n")), "doc_id", "rep"))
    pairs, _ = settled(shared.union(_pairs(near, "doc_id", "component_id")).distinct())
    used, n_used = settled(met.select("doc_id").union(pairs.select("u")).union(pairs.select("v")).distinct())
    held = checkpoint(texts(docs, id_col, text_col).join(sent(used, n_used), "doc_id", "left_semi"))
    held = few(held, n_used, WIDE)
    found = verified(held, pairs)
    roots = components(found).withColumnRenamed("v", "doc_id")
    named, _ = settled(met.select("key", "doc_id").join(roots, "doc_id", "left").select("key", "doc_id", F.coalesce("root", "doc_id").alias("root")))
    mixed = named.join(main_roots(named, "key"), "key").select("doc_id", "root").distinct()
    rest = apart(prefixes(held.join(mixed, "doc_id")))
    more = verified(held, rest.join(pairs, ["u", "v"], "left_anti"))
    return components(found.unionByName(more)).select(F.col("v").alias("doc_id"), F.col("root").alias("component_id"))


def without_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, unchanged, but of each group of near copies only the one of the smallest id.

    Rows are told apart by their place, so a null or repeated id takes no other row with it; a null
    id stays only where its group has no other. ``docs`` must be a table's scan or a checkpoint,
    whose rows come in the same places each time they are read. Null texts, texts without a word and
    repeated rows of these all stay. An empty table gives an empty result.
    """
    row = F.monotonically_increasing_id()
    numbered = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text"), row.alias("row"))
    copies = near_copies(numbered, "row", "text").select(F.col("doc_id").alias("row"), F.col("component_id").alias("root"))
    roots = copies.select(F.col("root").alias("row"), "root").distinct()
    own, n_own = settled(copies.unionByName(roots))
    members = checkpoint(numbered.select("row", "id").join(sent(own, n_own), "row"))
    members = few(members, n_own)
    keep = members.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("keep"))
    go, n_go = settled(members.join(keep, "root").where("row <> keep.row").select(F.col("row").alias("__row")))
    # Sent to the texts, so that whole rows are not exchanged for the few that go.
    left = docs.select(F.struct("*").alias("__kept"), row.alias("__row")).join(sent(go, n_go), "__row", "left_anti")
    return left.select("__kept.*")
