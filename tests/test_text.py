import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from waymark.functions import vec
from waymark.operators import demand
from waymark.sources import text as S


def test_vectors_and_lists(spark):
    df = spark.createDataFrame([("[1, 2]", "['a', 'b']"), (" ", None)], "v string, l string")
    got = df.select(vec.parse_vector(F.col("v"), 2), vec.parse_list(F.col("l"))).collect()
    assert [tuple(r) for r in got] == [([1.0, 2.0], ["a", "b"]), (None, [])]
    for bad in ("[1]", "[1, null]", "x", "[[1], [2]]"):
        with pytest.raises(Exception, match="not a vector"):
            spark.createDataFrame([(bad,)], "v string").select(vec.parse_vector(F.col("v"), 2)).collect()
    zero = spark.createDataFrame([([0.0, 0.0],)], "v array<double>")
    assert zero.select(vec.normalize(F.col("v"), zero="keep")).first()[0] == [0.0, 0.0]
    with pytest.raises(Exception, match="norm"):
        zero.select(vec.normalize(F.col("v"))).collect()


def test_catalogue_and_queries(spark, tmp_path):
    path = tmp_path / "c.csv"
    path.write_text('product_sku_hash,description_vector\nk1,"[3.0, 4.0]"\nk2,\nk3,"[0.0, 0.0]"\nk4,"[0.0, 2.0]"\n')
    raw = S.read_csv(spark, str(path), S.CATALOGUE, "source_row")
    got = demand.catalogue(raw).orderBy("id").collect()
    assert [(r.id, r.key, r.vec) for r in got] == [(0, "k1", [0.6, 0.8]), (1, "k4", [0.0, 1.0])]
    with pytest.raises(ValueError, match="twice"):
        demand.catalogue(raw.unionByName(raw))
    q = tmp_path / "q.csv"
    q.write_text("session_id_hash,query_vector,server_timestamp_epoch_ms,product_skus_hash,clicked_skus_hash\n" + "s,\"[1.0, 0.0]\",20,\"['k4', 'zz', 'k1']\",\"['k1']\"\ns,\"[0.0, 1.0]\",10,,\ns,,5,,\n")
    found = demand.read_queries(S.read_csv(spark, str(q), S.SEARCHES, "source_row"), demand.catalogue(raw), 2).orderBy("query").collect()
    assert [(r["query"], r.timestamp_ms, r.returned_product_ids, r.clicked_product_ids) for r in found] == [(0, 10, [], []), (1, 20, [1, 0], [0])]
    with pytest.raises(ValueError, match="no column"):
        S.read_csv(spark, str(path), S.SEARCHES)


def test_traces_and_counters(spark, tmp_path):
    path = tmp_path / "t.jsonl"
    path.write_text("".join(json.dumps({"query": k, "result_id": 1, "io_count": 2, "ids": [1, 2]}) + "\n" for k in range(3)))
    assert S.read_traces(spark, str(path)).count() == 3
    path.write_text('{"query": 1, "result_id": 1, "io_count": 2, "ids": []}\n')
    with pytest.raises(ValueError):
        S.read_traces(spark, str(path))
    lines = spark.createDataFrame([("noise",), ("x EXPERIENCE_STATS L=10 inserts=5",), ("EXPERIENCE_STATS L=20 inserts=7",)], "value string")
    got = S.check_grid(S.parse_counters(lines), [20, 10])
    assert {r.L: r.counters["inserts"] for r in got.collect()} == {10: 5, 20: 7}
    with pytest.raises(ValueError):
        S.check_grid(S.parse_counters(lines), [10, 20, 40])


def test_results_and_diagnostics(spark):
    doc = {"runs": [{"results": {"a": {"search_l": 10, "mean_latency": 2.5, "recall": 90}}}, {"search_l": 20, "mean_latency": 3}, {"search_l": 5}]}
    got = S.result_rows(spark.createDataFrame([(json.dumps(doc),), (None,)], "value string")).orderBy("search_l").collect()
    assert [(r.search_l, r.mean_latency, r.recall) for r in got] == [(10, 2.5, 90.0), (20, 3.0, None)]
    rows = spark.createDataFrame([(0, 10, 1.0), (1, 10, 2.0)], "query long, L int, ios double")
    S.check_diagnostics(rows, 2)
    for bad in (rows.limit(1), rows.withColumn("ios", -F.col("ios"))):
        with pytest.raises(ValueError):
            S.check_diagnostics(bad, 2)


def test_archives(spark, tmp_path):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        for name, raw in (("a/result.json", b"{}"), ("../x", b"1"), ("/y", b"2"), ("big", b"0" * 100)):
            z.writestr(name, raw)
    (tmp_path / "a.zip").write_bytes(buffer.getvalue())
    members = S.zip_members(spark, str(tmp_path / "a.zip"), 50)
    assert {r.member: r.problem for r in members.collect()} == {"a/result.json": None, "../x": "unsafe path", "/y": "unsafe path", "big": "too large"}
    assert S.one_member(members, "result.json") == b"{}"
    with pytest.raises(ValueError):
        S.one_member(members, "nothing")
    assert S.digests(spark, str(tmp_path / "a.zip")).first().bytes == len(buffer.getvalue())


def test_reports(spark, tmp_path):
    df = spark.createDataFrame([(1, 0.5), (2, None)], "a long, b double")
    S.write_table(df.orderBy("a"), str(tmp_path / "r.csv"), ["b", "a"])
    assert (tmp_path / "r.csv").read_text() == "b,a\n0.5,1\nnan,2\n"
    rows = [{"a": 1, "b": None}]
    assert S.markdown(rows, ["a", "b"]) == "| a | b |\n|---|---|\n| 1 | – |\n"
    assert "1 & -- \\\\" in S.latex(rows, ["a", "b"])


def test_windows_splits_pools(spark):
    rows = spark.range(12).withColumnRenamed("id", "query")
    got = {(r.history, r.role): r["count"] for r in demand.windows(rows, "query", [0, 4], 5).groupBy("history", "role").count().collect()}
    assert got == {(0, "measured"): 5, (4, "warmup"): 4, (4, "measured"): 5}
    assert demand.split(rows, "query", {"a": 5, "b": 3}).groupBy("split").count().orderBy("split").collect()[1][1] == 3
    pool = demand.locality_pool(100, 10, 35)
    assert len(pool) == 35 and len(set(pool)) == 10 and sorted(pool[:10]) == sorted(pool[10:20])


def test_flat_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(0, 10, 1.0), (0, 20, 2.0)], "query long, L int, ios double")
    S.write_diagnostics(rows, str(tmp_path / "d"))
    assert {p.name for p in (tmp_path / "d").iterdir() if p.is_dir()} == {"L=10", "L=20"}
    S.write_tsv(rows.select("query", "ios").coalesce(1), str(tmp_path / "t"))
    assert open(S.only_file(str(tmp_path / "t"), ".csv")).read().startswith("query\tios\n")
    with pytest.raises(ValueError):
        S.only_file(str(tmp_path / "t"), ".json")
