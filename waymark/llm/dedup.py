"""Exact duplicates by a tree merge of sorted digest runs, in DataFrame operations only.

Every row falls into one of ``fan ** rounds`` runs by a hash of its id and carries the digest of
its whole text. In each round ``fan`` sibling runs exchange their digests and merge: the key is
(parent run, digest), equal digests collapse to one entry with the surviving identifier and the
number of rows, and what a round sends is what the round before has already merged. A digest that
a third of all rows share is thus spread over all runs at first and thins out by ``fan`` in each
round; no task ever sees more than one run's copies of it, nor ``fan`` entries in later rounds.
The way back down hands each entry its merged value along the same tree, so that joins meet
``fan`` children to a parent, never a hot key. Runs are merged sorted: an entry's state is a
struct, which Spark aggregates by sorting on (run, digest), spilling and merging sorted runs.

Identity is SHA-256 verified at every level by the byte length and an independent 64-bit hash of
the same bytes, which are part of the key: two texts are merged only if all three agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.session import checkpoint

#: Runs merged into one in a round: two, so that partitions meet in binomial rounds.
FAN = 2
KEY = ["__digest", "__bytes", "__check"]


def rounds_for(partitions: int, fan: int = FAN) -> int:
    """Rounds until one run is left, when the first runs are at least as many as partitions."""
    rounds = 1
    while fan**rounds < partitions:
        rounds += 1
    return rounds


def digested(docs: DataFrame, payload: list[Column], fan: int, rounds: int, id_col: str, text_col: str) -> DataFrame:
    """``payload`` with the id, the text's verified digest and the first run of each row."""
    data = F.encode(F.coalesce(docs[text_col].cast("string"), F.lit("")), "UTF-8")
    narrow = docs.select(*payload, docs[id_col].cast("long").alias("__id"), data.alias("__data"))
    return narrow.select(
        *narrow.columns[: len(payload)],
        "__id",
        F.unhex(F.sha2("__data", 256)).alias("__digest"),
        F.length("__data").cast("long").alias("__bytes"),
        F.xxhash64("__data").alias("__check"),
        F.pmod(F.xxhash64(F.coalesce("__id", F.lit(0)), F.lit(17)), F.lit(fan**rounds)).alias("__run"),
        F.monotonically_increasing_id().alias("__row"),
    )


def survivors(rows: DataFrame, fan: int, rounds: int, keep: str) -> DataFrame:
    """``__run``, the key, ``__best`` (a struct with ``id``) and ``__n`` for each entry of each first run.

    Every level is written to the shared checkpoint folder: the way down reads it again, and a
    lost executor costs no more than its part of one level.
    """
    best = {"max": F.max, "min": F.min}[keep]
    known = F.col("__id").isNotNull() if keep == "max" else F.col("__id").isNull()
    parent = F.floor(F.col("__run") / fan).cast("long")
    level = rows.groupBy("__run", *KEY).agg(best(F.struct(known.alias("has"), F.col("__id").alias("id"), F.col("__row").alias("row"))).alias("__best"), F.count(F.lit(1)).alias("__n"))
    levels = [checkpoint(level)]
    for _ in range(rounds):
        level = levels[-1].withColumn("__run", parent).groupBy("__run", *KEY).agg(best("__best").alias("__best"), F.sum("__n").alias("__n"))
        levels.append(checkpoint(level))
    merged = levels.pop()
    while levels:
        child = levels.pop().select(F.col("__run").alias("__child"), parent.alias("__run"), *KEY)
        merged = child.join(merged, ["__run", *KEY]).select(F.col("__child").alias("__run"), *KEY, "__best", "__n")
    return merged


def mark(docs: DataFrame, payload: list[Column] | None = None, id_col: str = "doc_id", text_col: str = "text", keep: str = "max", fan: int = FAN, rounds: int | None = None, single: bool = False) -> DataFrame:
    """Each row of ``docs`` as ``payload`` with ``keep_id``, ``group_size``, ``kept`` and ``text_sha256``.

    ``payload`` defaults to one struct ``row`` of all columns, so that no name can clash. Texts
    are equal when their bytes are; null counts as empty. Of equal texts the row with the largest
    id (``keep="max"``) or the smallest (``"min"``) stays. ``group_size`` counts rows. A null id
    never survives while its group has another; where all ids are null, all rows are kept under a
    null ``keep_id``. Repeated rows of the surviving id are all kept: the id names them; with
    ``single`` only one of them is, and one where all ids are null, told by its place in ``docs``,
    which must then be a table's scan or a checkpoint. An empty table gives an empty result.
    """
    payload = [F.struct("*").alias("row")] if payload is None else payload
    rounds = rounds or rounds_for(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), fan)
    rows = digested(docs, payload, fan, rounds, id_col, text_col)
    merged = survivors(digested(docs, [], fan, rounds, id_col, text_col), fan, rounds, keep)
    return rows.join(merged, ["__run", *KEY]).select(
        *rows.columns[: len(payload)],
        F.col("__best.id").alias("keep_id"),
        F.col("__n").cast("long").alias("group_size"),
        (F.col("__row") == F.col("__best.row") if single else F.col("__id").eqNullSafe(F.col("__best.id"))).alias("kept"),
        F.lower(F.hex("__digest")).alias("text_sha256"),
    )


def groups(docs: DataFrame) -> DataFrame:
    """The contract's columns; texts are digested at the scan and never shuffled."""
    return mark(docs, [docs["doc_id"].cast("long").alias("doc_id")])


SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, CAST(count(*) OVER w AS BIGINT) AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
