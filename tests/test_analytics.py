import math
import random

import pytest
from pyspark.sql import functions as F

from waymark.operators import junctions as J
from waymark.plans import curves as C
from waymark.plans import evidence as E

TRACES = [(0, [7, 3, 3, 9]), (1, [7, 9, 3]), (2, [5]), (3, [9, 7, 5, 3])]


@pytest.fixture
def steps(spark):
    return J.explode_traces(J.check_contiguous(spark.createDataFrame(TRACES, "query long, ids array<long>")))


def test_scores_and_rankings(spark, steps):
    s = {r.id: (r.score, r.support) for r in J.scored(steps).collect()}
    assert s == {3: (6, 3), 9: (4, 2), 5: (2, 1), 7: (1, 1)}
    order = lambda kind, start=False: [r.id for r in J.ranking(J.scored(steps, start), kind).orderBy("rank").collect()]
    assert order("sum") == [3, 9, 5, 7] and order("count") == [3, 9, 5, 7] and order("mean") == [3, 9, 5, 7]
    assert order("hot", True) == [3, 9, 7, 5]
    ranked = J.ranking(J.scored(steps))
    assert J.select_budget(ranked, 9).count() == 4
    with pytest.raises(ValueError):
        J.select_budget(ranked, 9, strict=True)
    with pytest.raises(ValueError):
        J.check_contiguous(spark.createDataFrame([(0, [1]), (2, [1])], "query long, ids array<long>"))


def test_ordered_union(spark):
    part = lambda ids: spark.createDataFrame(list(enumerate(ids)), "ord long, id long")
    assert [r.id for r in J.ordered_union(part([5, 2]), part([2, 9, 5, 1])).orderBy("ord").collect()] == [5, 2, 9, 1]


def curve(spark, points, name="c"):
    return spark.createDataFrame([(name, k, float(r), float(c)) for k, (r, c) in enumerate(points)], "curve string, width int, recall double, cost double")


def pairs(df, order="recall"):
    return [(r.recall, r.cost) for r in df.orderBy(order).collect()]


def test_frontiers_differ(spark):
    df = curve(spark, [(10, 5), (10, 4), (12, 7), (11, 6)])
    assert pairs(C.frontier(df, ["curve"])) == [(10, 4), (11, 6), (12, 7)]
    assert pairs(C.mono(df, ["curve"]), "width") == [(10, 5), (10, 4), (12, 7)]
    assert pairs(C.pareto(curve(spark, [(10, 5), (11, 5), (12, 9), (9, 9)]), ["curve"])) == [(11, 5), (12, 9)]


def test_interpolation_never_extrapolates(spark):
    targets = spark.createDataFrame([(float(t),) for t in (15, 10, 20, 9, 21)], "target double")
    for f in (C.interpolate,):
        got = {r.target: r.cost for r in f(curve(spark, [(10, 100), (20, 200)]), targets, ["curve"]).collect()}
        assert got == {15: 150, 10: 100, 20: 200, 9: None, 21: None}
    closed = {r.target: r.cost for r in C.interpolate_closed(curve(spark, [(10, 100), (20, 200)]), targets, ["curve"]).collect()}
    assert closed == {15: 150, 10: 100, 20: 200}


def test_published_savings(spark):
    from waymark.catalog.curves import published

    got = {(r.workload, r.method): (r.targets, round(r.saving, 4)) for r in C.mean_savings(C.matched(published(spark), ["workload"], "method", "core", "baseline"), ["workload"], "method").collect()}
    want = {"coveo": (4, 27.0733, 80.1504), "pubmed": (5, 30.5393, 44.1277), "text2image": (5, 24.7145, 34.5673), "bigann": (4, 20.6798, 21.0260)}
    for w, (n, junction, core) in want.items():
        assert got[w, "junction"] == (n, junction) and got[w, "core"] == (n, core)


def test_payload_accounting(spark):
    row = spark.range(1).select(*[C.payload_bytes(F.lit(ids), F.lit(512), F.lit(2048)).alias(f"b{ids}") for ids in (14464, 12169)]).first()
    assert tuple(row) == (102940, 93760)


def test_grid_and_tolerance(spark):
    df = curve(spark, [(1, 1), (2, 2)])
    C.complete_grid(df, ["curve"], [0, 1])
    with pytest.raises(ValueError):
        C.complete_grid(df, ["curve"], [0, 1, 2])
    nan = curve(spark, [(math.nan, 1), (2, 2.5)])
    bad = C.within(nan, curve(spark, [(math.nan, 1), (2, 2)]), ["width"], ["recall", "cost"], 0.1).collect()
    assert [(r.width, r.column) for r in bad] == [(1, "cost")]
    with pytest.raises(ValueError):
        C.within(nan, nan.limit(0), ["width"], ["recall"], 1.0)


def test_evidence(spark):
    h = "0" * 64
    good = ("a" * 64, "results/x.json", 5, h)
    df = lambda *rows: spark.createDataFrame(list(rows), "original_zip_sha256 string, published_member string, sanitized_bytes long, sanitized_sha256 string")
    E.demand_none(E.manifest_violations(df(good)), "manifest")
    bad = [("A" * 64, *good[1:]), (good[0], "/x", 5, h), (good[0], "a/../x", 5, h), (good[0], "y", 0, h), (good[0], "z", 5, None)]
    assert {r.problem for r in E.manifest_violations(df(*bad)).collect()} == {"source digest", "path", "size", "digest"}
    with pytest.raises(ValueError, match="repeated"):
        E.demand_none(E.manifest_violations(df(good, good)), "manifest")
    members = spark.createDataFrame([("results/x.json", 5, "1" * 64, None), ("more", 1, h, None)], "member string, bytes long, sha256 string, problem string")
    assert {(r.member, r.problem) for r in E.archive_violations(df(good), members).collect()} == {("results/x.json", "digest"), ("more", "unlisted member")}
    cells = lambda v: E.cells(spark.createDataFrame([(0, v, "t")], "row long, a double, b string"), "f.csv", "row")
    assert E.cell_violations(cells(1.00005), cells(1.0)).count() == 0 and E.cell_violations(cells(1.001), cells(1.0)).first()["column"] == "a"
    assert E.cell_violations(cells(math.nan), cells(math.nan)).count() == 0
    with pytest.raises(ValueError):
        E.cell_violations(cells(1.0), cells(1.0).limit(0))
    sel = spark.createDataFrame([(1, 5), (2, 5), (9, 700)], "rank long, id long")
    assert {r.problem for r in E.selection_violations(sel, 8, 600).collect()} == {"range", "repeated"}


def test_windowed_top_n_with_ties(spark):
    from waymark.operators.knn import top_by

    rng = random.Random(3)
    rows = [(rng.randrange(20), rng.randrange(6), k) for k in range(1500)]
    got = top_by(spark.createDataFrame(rows, "q long, d long, id long"), "q", [F.asc("d"), F.asc("id")], 8).collect()
    for q in range(20):
        assert [(r.d, r.id) for r in sorted(got, key=lambda r: r.rank) if r.q == q] == sorted((d, i) for x, d, i in rows if x == q)[:8]
