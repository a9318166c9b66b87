import random

import pandas as pd
import pytest

from waymark.operators import history as H
from waymark.streaming import history as S

NAMES = {c: k for k, c in enumerate("abc")}


def events(spark, items, stream="s"):
    return spark.createDataFrame([(stream, k, i) for k, i in enumerate(items)], "stream string, seq long, id long")


def test_fifo_and_lru_contents_differ():
    fifo, lru, seen = H.UniqueFifo(2), H.Lru(2), []
    for c in "abacab":
        fifo.push(c), lru.push(c)
        seen.append((sorted(fifo.ids()), lru.ids()))
    assert [s[0] for s in seen] == [["a"], ["a", "b"], ["a", "b"], ["b", "c"], ["a", "c"], ["a", "b"]]
    assert [s[1] for s in seen] == [["a"], ["a", "b"], ["b", "a"], ["a", "c"], ["c", "a"], ["a", "b"]]


def test_replay_counts(spark):
    got = H.counters(H.fifo_replay(events(spark, [0, 1, 0, 2, 0, 1]), 2), 3).first()
    assert (got.inserts, got.skips, got.evictions, got.eval_queries) == (5, 1, 3, 3)
    hits = H.lru_replay(events(spark, [0, 1, 0, 2, 0, 1]), 2).where("hit").select("seq").orderBy("seq").collect()
    assert [r[0] for r in hits] == [2, 4]


def slow_fifo(items, capacity):
    ring, at, out = [], 0, []
    for i in items:
        if i in ring:
            out.append((True, None))
        elif len(ring) < capacity:
            ring.append(i)
            out.append((False, None))
        else:
            out.append((False, ring[at]))
            ring[at] = i
            at = (at + 1) % capacity
    return out


def test_folds_and_closed_form_agree(spark):
    rng = random.Random(5)
    items = [int(rng.paretovariate(0.6)) % 90 for _ in range(1500)]
    df = events(spark, items).repartition(7)
    got = [(r.hit, r.evicted) for r in H.fifo_replay(df, 32).orderBy("seq").collect()]
    assert got == slow_fifo(items, 32)
    lru = H.Lru(32)
    for i in items:
        lru.push(i)
    assert [r.id for r in H.lru_contents(df, 32).orderBy("pos").collect()] == lru.ids()


def test_streams_do_not_mix_and_order_is_checked(spark):
    both = events(spark, [1, 1], "a").unionByName(events(spark, [1, 2], "b"))
    assert H.fifo_replay(both, 4).where("hit").count() == 1
    with pytest.raises(Exception, match="after"):
        H.fifo_replay(both.unionByName(events(spark, [9], "a")), 4).collect()


def test_exits():
    e = H.Exits(3, 1)
    assert e.push(7, 1, 0, [5, 1]) == "accepted" and e.pages[7] == [1, 5]
    assert e.push(7, 5, 1) == "duplicate" and e.push(7, 2, 2, [9]) == "accepted" and e.pages[7] == [2, 1, 5]
    assert e.push(7, 3, 3) == "accepted" and e.pages[7] == [3, 2, 1]
    half = H.Exits(3, 2)
    drawn = [half.accepts(h, w, 4) for h in range(40) for w in range(40)]
    assert 0.45 < sum(drawn) / len(drawn) < 0.55


@pytest.mark.parametrize("every", [1, 2, 4, 10])
def test_hash_matches_big_integers(spark, every):
    from pyspark.sql import functions as F

    from waymark.functions.hashing import FIRST, GOLDEN, SECOND, accepts

    mask = (1 << 64) - 1

    def slow(hub, winner, sequence):
        h = (((hub << 32) & mask) ^ (winner & mask)) ^ ((sequence * GOLDEN) & mask)
        h = ((h ^ (h >> 30)) * FIRST) & mask
        h = ((h ^ (h >> 27)) * SECOND) & mask
        return h ^ (h >> 31)

    df = spark.createDataFrame([(i, i * i - 5, i * 10**15) for i in range(60)], "a long, b long, c long")
    got = df.select("a", "b", "c", accepts(F.col("a"), F.col("b"), F.col("c"), every).alias("ok")).collect()
    assert [r.ok for r in got] == [every <= 1 or slow(r.a, r.b, r.c) % every == 0 for r in got]


def test_lifetimes_and_overlap(spark):
    replayed = H.fifo_replay(events(spark, [0, 1, 0, 2, 0, 1]), 2)
    spans = {(r.id, r.insert_seq, r.evict_seq) for r in H.lifetimes(replayed).collect()}
    assert spans == {(0, 0, 3), (1, 1, 4), (2, 3, 5), (0, 4, None), (1, 5, None)}
    share = {r.capacity: float(r.share) for r in H.recent_overlap(events(spark, [0, 1, 0, 2, 2, 1]), [1, 2, 3]).collect()}
    assert share == {1: pytest.approx(100 / 6), 2: pytest.approx(200 / 6), 3: pytest.approx(300 / 6)}


@pytest.mark.parametrize("kind", ["fifo", "lru"])
def test_streaming_equals_batch(spark, tmp_path, kind):
    rng = random.Random(9)
    rows = [(s, k, rng.randrange(40)) for s in ("x", "y") for k in range(400)]
    folder = tmp_path / "in"
    for part in range(4):
        frame = pd.DataFrame([r for r in rows if r[1] // 100 == part], columns=["stream", "seq", "id"]).sample(frac=1, random_state=part)
        spark.createDataFrame(frame, "stream string, seq long, id long").coalesce(1).write.mode("append").parquet(str(folder))
    live = spark.readStream.schema("stream string, seq long, id long").option("maxFilesPerTrigger", 1).parquet(str(folder))
    made = {"fifo": S.fifo_stream, "lru": S.lru_stream}[kind](live, 16)
    q = made.writeStream.format("memory").queryName(f"out_{kind}").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    batch = {"fifo": H.fifo_replay, "lru": H.lru_replay}[kind](spark.createDataFrame(rows, "stream string, seq long, id long"), 16)
    assert sorted(map(str, spark.table(f"out_{kind}").collect())) == sorted(map(str, batch.collect()))
