import pytest
from pyspark.sql import functions as F

from waymark.__main__ import main
from waymark.operators import history as H
from waymark.plans import studies as T


def points(spark, rows):
    return spark.createDataFrame(rows, "method string, rep int, recall double, cost double")


ROWS = [("a", r, float(x), 10.0 * x + r) for r in (0, 1) for x in (1, 2, 3)] + [("b", r, float(x), 5.0 * x) for r in (0, 1) for x in (1, 3)]


def test_anchors_and_reasons(spark):
    p = points(spark, ROWS).where("rep = 0")
    assert sorted(r.target for r in T.common_anchors(p, [], "method", "a").collect()) == [1, 2, 3]
    with pytest.raises(ValueError):
        T.common_anchors(p.where("recall < 3 OR method = 'b'").where("recall > 1 OR method = 'a'"), [], "method", "a")
    targets = spark.createDataFrame([(0.5,), (2.0,), (9.0,)], "target double")
    got = {(r.method, r.target): (r.cost, r.reason) for r in T.reasons(p, ["method"], targets).collect()}
    assert got["b", 2.0] == (10.0, None) and got["a", 0.5] == (None, "below range") and got["a", 9.0] == (None, "above range")


def test_native_and_memory(spark):
    p = points(spark, ROWS)
    got = {(r.k, r.method): r for r in T.native_summary(p, "method", "rep", "a", 2).collect()}
    assert got[2, "b"].available and got[2, "b"].cost == 10 and got[2, "b"].saving == pytest.approx((50 + 100 * (1 - 10 / 21)) / 2)
    less = {(r.k, r.method): r for r in T.native_summary(p.where("NOT (method = 'b' AND rep = 1 AND recall = 3)"), "method", "rep", "a", 2).collect()}
    assert not less[2, "b"].available and less[2, "b"].cost is None
    m = p.where("rep = 0").withColumn("scale", F.lit(1)).withColumn("w", F.lit("x"))
    anchors = spark.createDataFrame([("x", 1.0), ("x", 2.0)], "w string, target double")
    row = T.memory_scaling(m, ["w"], "method", "scale", "b", anchors).first()
    assert (row.method, row.targets, row.saving) == ("a", 2, 50.0)


def test_counters_and_deltas(spark):
    c = spark.createDataFrame([("m", 10, 8, 4), ("m", 20, 0, 0)], "method string, writes long, trials long, accepts long")
    row = T.counter_summary(c, ["method"], F.lit(100.0)).first()
    assert row.writes == 15 and row.accepted == 0.5 and row.writes_per_query == pytest.approx(0.15)
    rows = spark.createDataFrame([("w", "sum", 1.0, 10.0), ("w", "mean", 1.0, 12.0)], "workload string, variant string, target double, saving double")
    claim = lambda d: spark.createDataFrame([("w", "sum", 1.0, 0.0), ("w", "mean", 1.0, d)], "workload string, variant string, target double, delta double")
    assert T.score_deltas(rows, claim(2.0)).count() == 0 and T.score_deltas(rows, claim(2.1)).count() == 1
    assert T.score_deltas(rows.unionByName(rows.where("variant = 'mean'")), claim(2.0)).count() == 1


def test_arms_rotate():
    e = T.EXPERIMENTS["main"]
    order = [arm for _, arm, rep, _, _ in e.streams((10,), 3)]
    assert order[:4] == ["baseline", "ivf", "core", "full"] and order[4:8] == ["ivf", "core", "full", "baseline"]
    assert T.streams_of("writes", (10,))["sample4/0/10"][0].every == 4


def test_snapshots(spark):
    ev = spark.createDataFrame([("s", k, i) for k, i in enumerate([0, 1, 0, 2, 0, 1])], "stream string, seq long, id long")
    held = H.snapshot(H.fifo_replay(ev, 2))
    assert sorted(r.id for r in held.collect()) == [0, 1]
    assert H.frozen_hits(ev, held).where("hit").count() == 5


def test_command_line(capsys, tmp_path):
    assert main(["list"]) == 0 and "query knn_ip_topk" in capsys.readouterr().out
    assert main(["run", "nothing"]) == 2
    assert main(["run", "knn_ip_topk", "--out", str(tmp_path / "x")]) == 0 and "would run" in capsys.readouterr().out
    assert not (tmp_path / "x").exists()
    assert main(["doctor", "--sf", str(tmp_path)]) == 1
