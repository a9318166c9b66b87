import numpy as np
import pytest
from pyspark.sql import functions as F

from waymark.operators import kmeans, knn, pq, routing, search


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(240, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return spark.createDataFrame([(i, [float(v) for v in r], i % 6) for i, r in enumerate(x)], "id long, vec array<double>, cell long").cache(), x


@pytest.fixture(scope="module")
def index(points):
    p, _ = points
    graph = search.knn_graph(p, 6)
    m = kmeans.medoids(p, p.select("id", "cell"), kmeans.means(p, p.select("id", "cell"), False))
    ranked = p.select("id", F.col("id").alias("rank"))
    rows = m.select("cell", "id", F.lit(True).alias("is_medoid"), F.lit(0).cast("long").alias("pos")).unionByName(kmeans.buckets(ranked, p, m).select("cell", "id", F.lit(False).alias("is_medoid"), "pos"))
    return search.load(p, graph, search.medoid(p), rows)


def test_neighbours_in_blocks_equal_brute_force(spark, points):
    p, x = points
    for metric in ("ip", "l2"):
        got = knn.nearest(p.where("id < 30"), p, 5, metric, block_bytes=1024).collect()
        s = x[:30] @ x.T if metric == "ip" else -((x[:30, None] - x[None]) ** 2).sum(2)
        s[np.arange(30), np.arange(30)] = -np.inf
        for q in range(30):
            assert [r.id for r in sorted(got, key=lambda r: r["rank"]) if r["query"] == q] == np.lexsort((np.arange(240), -s[q]))[:5].tolist()


def test_wide_search_is_exact(points, index):
    _, x = points
    for q in range(0, 240, 17):
        found, counts = search.beam_search(index, x[q], [index.medoid], search.Walk(width=240))
        assert index.ids[found].tolist() == np.lexsort((np.arange(240), -(x @ x[q])))[:10].tolist()
        assert counts["reads"] == len(set(counts["trace"])) == counts["hops"] <= 240
    narrow = search.beam_search(index, x[0], list(range(50)), search.Walk(width=10))[1]
    assert narrow["reads"] >= 10


def test_counters_of_caches_and_pages(points, index):
    _, x = points
    walk = search.Walk(width=20, cached=frozenset(range(120)), nodes_per_page=8)
    counts = search.beam_search(index, x[3], [index.medoid], walk)[1]
    assert counts["uncached_reads"] == sum(index.ids[r] >= 120 for r in counts["trace"])
    assert counts["page_reads"] == len({int(index.ids[r]) // 8 for r in counts["trace"]}) <= counts["reads"]


def test_a_junction_among_recents_is_dropped_not_replaced(index, points):
    _, x = points
    routing_ = search.Routing(junctions=True, nprobe=6, recents=2)
    _, hub, _, _ = search.route(index, x[5], routing_, search.Walk(), [], None)
    order = [r for r in np.argsort(-(index.vecs @ x[5])).tolist()]
    starts, hub, ranked, _ = search.route(index, x[5], routing_, search.Walk(), [hub, *order[-3:]], None)
    assert ranked[0] == hub and len(starts) == 2 and starts[0] == hub


def test_exit_admission(index, points):
    _, x = points
    far = int(np.argmin(index.vecs @ x[0]))
    offered = []

    def offer(r):
        offered.append(r)
        return [far] if len(offered) == 1 else []

    found, _ = search.beam_search(index, x[0], np.argsort(-(index.vecs @ x[0]))[:4].tolist(), search.Walk(width=4), offer)
    assert far not in found


def test_replay_is_causal_and_streams_are_apart(spark, points, index):
    p, _ = points
    q = p.where("id < 40").select(F.col("id").alias("query"), "vec")
    arms = {"base": (search.Routing(), search.Walk(width=12)), "core": (search.Routing(junctions=True, nprobe=2, recents=8, capacity=16, exits=4), search.Walk(width=12))}
    first = search.replay(q, index, arms).collect()
    again = search.replay(q.repartition(5), index, arms).collect()
    assert sorted(map(str, first)) == sorted(map(str, again))
    prefix = search.replay(q.where("query < 20"), index, arms).collect()
    assert {str(r) for r in prefix} <= {str(r) for r in first}
    truth = knn.nearest(p.where("id < 40"), p, 10, exclude_self=False)
    got = {r.stream: r for r in search.summary(spark.createDataFrame(first), truth, 10, 10).collect()}
    assert got["core"].queries == 30 and got["core"].recall > 50
    assert search.summary(spark.createDataFrame(first), None, 10).where("recall IS NOT NULL").count() == 0
    assert 60 < kmeans.sample_points(p, 100).count() < 140


def test_probe_and_winner_ties(spark):
    q = spark.createDataFrame([(100, [1.0, 0.0])], "query long, vec array<double>")
    m = spark.createDataFrame([(0, 7, [0.5, 0.0]), (1, 3, [0.5, 1.0]), (2, 9, [0.1, 0.0])], "cell long, id long, vec array<double>")
    probed = routing.probe(q, m, 2)
    assert [r.cell for r in probed.orderBy("rank").collect()] == [0, 1]
    assert routing.winner(q, probed, m).first().id == 3


def test_kmeans_and_quantisation(spark, points):
    p, x = points
    starts = p.where("id < 5").select(F.col("id").alias("cell"), "vec")
    centres, cells = kmeans.lloyd(p, starts, 4)
    c = x[:5].copy()
    for _ in range(4):
        a = (x @ c.T).argmax(1)
        c = np.stack([x[a == k].mean(0) for k in range(5)])
        c /= np.linalg.norm(c, axis=1, keepdims=True)
    assert [r.cell for r in cells.orderBy("id").collect()] == (x @ c.T).argmax(1).tolist()
    book = pq.train(p, 4, 8, 2)
    codes = pq.encode(p, book)
    d = pq.scan(p.where("id = 3").select(F.col("id").alias("query"), "vec"), codes, book, k=240).collect()
    code = {r.id: r.code for r in codes.collect()}
    for r in d[:20]:
        back = np.concatenate([book[j, code[r.id][j]] for j in range(4)])
        assert r.d == pytest.approx(((x[3] - back) ** 2).sum())
    with pytest.raises(ValueError):
        kmeans.check_medoids(spark.createDataFrame([(0, 1)], "cell long, id long"), 2)


def test_bfs_cache_and_gate(spark, points):
    g = spark.createDataFrame([(0, [2, 1]), (1, [3]), (2, [4]), (3, []), (4, [])], "id long, nbrs array<long>")
    assert search.bfs_cache(g, 0, 4) == [0, 1, 2, 3]
    d = spark.createDataFrame([(float(v),) for v in (4, 1, 3, 2)], "d double")
    assert routing.gate_threshold(d, "d").first()[0] == 3 and routing.gate_threshold(d, "d", 25).first()[0] == 4
    cand = spark.createDataFrame([(1, 5, 0.1, 0.2, 1.0), (1, 6, 0.2, 0.9, 1.0), (1, 7, 0.9, 2.0, 1.0)], "query long, id long, d double, novelty double, native_best double")
    assert routing.diverse(cand).first().id == 6
    assert routing.coverage(cand, 1).first().id == 6 and routing.coverage(cand, 2).first().id == 6
    with pytest.raises(Exception, match="twice"):
        routing.check_starts(spark.createDataFrame([([1, 1],)], "starts array<long>")).collect()
