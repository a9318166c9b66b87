import hashlib

import pytest

from waymark.llm import dedup


def brute(rows, keep=max):
    out = []
    for i, t in rows:
        same = [j for j, u in rows if (u or "") == (t or "")]
        known = [j for j in same if j is not None]
        best = keep(known) if known else None
        out.append((i, best, len(same), i == best, hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=str)


def listed(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_odd_rows(spark, odd, none):
    rows = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    assert listed(dedup.groups(odd)) == brute(rows)
    assert listed(dedup.groups(none)) == []
    kept = dedup.mark(odd).where("kept").select("row.*")
    assert kept.columns == odd.columns
    assert sorted({r.doc_id for r in kept.collect()}) == sorted({r[0] for r in brute(rows) if r[3]})


@pytest.mark.parametrize(("fan", "rounds"), [(2, 1), (2, 5), (16, 2)])
@pytest.mark.parametrize("keep", ["max", "min"])
def test_every_tree_agrees(spark, fan, rounds, keep):
    rows = [(k, "hot" if k % 3 == 0 else f"t{k % 40}") for k in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = dedup.mark(df, [df["doc_id"]], keep=keep, fan=fan, rounds=rounds)
    assert listed(got) == brute(rows, {"max": max, "min": min}[keep])


def test_null_ids_only(spark):
    df = spark.createDataFrame([(None, "x"), (None, "x"), (None, "y")], "doc_id long, text string")
    got = listed(dedup.groups(df))
    assert [(r[0], r[1], r[2], r[3]) for r in got] == [(None, None, 1, True), (None, None, 2, True), (None, None, 2, True)]


def test_rounds():
    assert [dedup.rounds_for(n, 16) for n in (1, 16, 17, 256, 257, 4096)] == [1, 1, 2, 2, 3, 3]
    assert [dedup.rounds_for(n) for n in (1, 2, 3, 16, 17)] == [1, 1, 2, 4, 5]
