"""Near copies of the pipeline against all pairs compared by exact five-word similarity."""

import random

import corpus_pipeline
from waymark.llm import resemblance
from waymark.llm.components import components

from .test_simhash import union


def similarity(a, b):
    sets = []
    for t in (a, b):
        w = t.lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))})
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


def test_every_near_copy_of_the_stage_goes(spark):
    rng = random.Random(9)
    words = [f"w{k}" for k in range(400)]
    texts = []
    for _ in range(12):
        own = rng.choices(words, k=120)
        texts.append(own)
        for edits in (1, 1, 2, 3, 6):
            near = own[:]
            for _ in range(edits):
                near[rng.randrange(120)] = "changed"
            texts.append(near)
        texts.append(texts[-2][:60] + ["and", "more"] + texts[-2][60:])
    rows = [(k, " ".join(t)) for k, t in enumerate(texts)] + [(900, None), (901, " "), (None, " ".join(texts[0])), (902, "two words"), (903, "Two WORDS")]
    live = {i: t for i, t in rows if i is not None and t and t.strip()}
    pairs = [(a, b) for a in live for b in live if a < b and similarity(live[a], live[b]) >= 0.8]
    assert len(pairs) > 40
    roots = union(sorted(live), pairs)
    want = sorted([i for i in live if roots[i] == i] + [900, 901])
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()]
    # The null id is a copy of a text with an id, and so goes.
    assert None not in got and sorted(got) == want
    assert corpus_pipeline.drop_near_copies(spark, docs.limit(0), "").count() == 0


def test_rows_are_told_apart_by_their_place(spark):
    """A repeated or null id takes no other row with it, and clashing names pass through."""
    long = " ".join(f"w{k}" for k in range(60))
    rows = [(1, long, "a"), (1, "another text altogether, with the same id as the first", "b"), (2, long + " x", "c"), (None, long + " y", "d"), (None, None, "e"), (None, "only this one", "f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row string").selectExpr("*", "1 as id", "2 as key", "3 as root")
    got = corpus_pipeline.drop_near_copies(spark, docs, "")
    assert got.columns == docs.columns and sorted(r.row for r in got.collect()) == ["a", "b", "e", "f"]
    orphans = spark.createDataFrame([(None, long), (None, long + " x")], "doc_id long, text string")
    assert corpus_pipeline.drop_near_copies(spark, orphans, "").count() == 1


def tasks(spark, run):
    """The result of ``run``, and how many tasks of shuffled and other stages it took."""
    sc = spark.sparkContext
    sc.setJobGroup("counted", "")
    kept = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = run()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", kept)
        sc.setLocalProperty("spark.jobGroup.id", None)
    found = [sc.statusTracker().getJobInfo(j) for j in sc.statusTracker().getJobIdsForGroup("counted")]
    infos = [sc.statusTracker().getStageInfo(s) for job in found if job for s in job.stageIds]
    return out, sum(i.numCompletedTasks for i in infos if i)


def test_small_edge_tables_are_not_exchanged_in_every_round(spark):
    """A chain takes several rounds, and none of them deals its few rows over all partitions."""
    edges = spark.createDataFrame([(k, k + 1) for k in range(-9, 51)], "u long, v long")
    got, n = tasks(spark, lambda: components(edges).collect())
    assert {(r.v, r.root) for r in got} == {(k, -9) for k in range(-8, 52)}
    assert n < 60


def test_large_edge_tables_go_on_by_rounds(spark):
    """Rounds alone, and rounds up to a remainder that one task finishes, give the same roots."""
    rng = random.Random(2)
    edges = [(rng.randrange(-200, 200), rng.randrange(-200, 200)) for _ in range(150)] + [(k + 1, k) for k in range(300, 340)]
    table = spark.createDataFrame(edges, "u long, v long")
    roots = union(sorted({v for e in edges for v in e}), edges)
    want = sorted((v, r) for v, r in roots.items() if v != r)
    for each in (0, 175, 1 << 16):
        assert sorted((r.v, r.root) for r in components(table, each=each).collect()) == want


def test_texts_stay_in_place_when_few_rows_go(spark):
    """The last join sends the rows that go to the texts, and not both to hashed partitions."""
    long = " ".join(f"w{k}" for k in range(60))
    docs = spark.createDataFrame([(1, long), (2, long + " x"), (3, "something else")], "doc_id long, text string")
    left = corpus_pipeline.drop_near_copies(spark, docs, "")
    plan = left._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert sorted(r.doc_id for r in left.collect()) == [1, 3]


def test_pairs_that_no_representative_joins(spark, monkeypatch):
    """Many edits of one text, most of them apart: prefixes find what is left, without a square of pairs."""
    rng = random.Random(6)
    own = rng.choices([f"w{k}" for k in range(300)], k=140)
    texts = []
    for i in range(150):
        near = own[:]
        for _ in range(rng.randrange(2, 14)):
            near[rng.randrange(140)] = f"e{i}x{rng.randrange(9)}"
        texts.append(" ".join(near))
        if i % 10 == 0:
            texts.append(texts[-1] + f" tail{i}")
    pairs = [(a, b) for a in range(len(texts)) for b in range(a) if similarity(texts[a], texts[b]) >= 0.8]
    seen = []
    apart = resemblance.apart
    monkeypatch.setattr(resemblance, "apart", lambda rows: seen.append(apart(rows).count()) or apart(rows))
    roots = union(range(len(texts)), pairs)
    got = {r.doc_id: r.component_id for r in resemblance.near_copies(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {i: r for i, r in roots.items() if i != r} and len(pairs) > 15
    assert seen[0] < 5 * len(texts)


def test_a_bucket_of_one_key_is_compared_whole(spark, monkeypatch):
    """Where one bucket holds all texts, chains and strangers alike, no pair is lost."""
    rng = random.Random(5)
    chain = [rng.choices([f"c{k}" for k in range(300)], k=80)]
    for k in range(12):
        chain.append([*chain[-1][:-1]])
        chain[-1] = chain[-1][:-2] + [f"x{k}"]
    texts = [" ".join(t) for t in chain] + [" ".join(rng.choices([f"s{k}" for k in range(300)], k=80)) for _ in range(8)]
    rng.shuffle(texts)
    monkeypatch.setattr(resemblance, "signatures", lambda docs, i, t: docs.selectExpr("doc_id", "75L as n", "xxhash64(doc_id) as fp", "array(1L) as keys"))
    monkeypatch.setattr(resemblance, "_sized", lambda a, b: resemblance.F.lit(True))
    roots = union(range(len(texts)), [(a, b) for a in range(len(texts)) for b in range(a) if similarity(texts[a], texts[b]) >= 0.8])
    got = {r.doc_id: r.component_id for r in resemblance.near_copies(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {i: r for i, r in roots.items() if i != r}
