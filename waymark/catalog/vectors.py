"""Queries over ``embeddings``: distances, neighbours, directories, routing, quantisation, graphs.

Searches take every vector whose id is divisible by 20 as a query, against all vectors.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.functions import vec
from waymark.operators import history, junctions, kmeans, knn, pq, routing, search
from waymark.plans import studies
from waymark.session import checkpoint

from . import query, table

STRIDE, TOP, PLANES, DIM = 20, 10, 8, 64

#: SQL fragments: vectors in doubles, the queries, and the start of each label as its centre.
E = "e AS (SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS vec FROM embeddings)"
Q = f"{E}, q AS (SELECT id AS query, vec, label FROM e WHERE id % {STRIDE} = 0)"
STARTS = "starts AS (SELECT label AS cell, arg_min(vec, id) AS vec FROM e GROUP BY label)"
MEAN = "centre AS (SELECT label, list(m ORDER BY pos) AS c FROM (SELECT label, pos, avg(x) AS m FROM (SELECT label, unnest(vec) AS x, unnest(range(64)) AS pos FROM e) GROUP BY label, pos) GROUP BY label)"
MEDOID = f"{E}, {MEAN}, m AS (SELECT label AS cell, arg_max(id, list_dot_product(vec, c) - id * 1e-15) AS id FROM e JOIN centre USING (label) GROUP BY label)"
RANK = "(id * 2654435761) % 4294967296"
MEMBERS = f"""{MEDOID}, mv AS (SELECT cell, m.id, vec FROM m JOIN e ON m.id = e.id),
near AS (SELECT e.id, arg_min(mv.cell, (-list_dot_product(e.vec, mv.vec), mv.cell)) AS cell FROM e, mv GROUP BY e.id),
children AS (SELECT cell, id, CAST(row_number() OVER (PARTITION BY cell ORDER BY {RANK}, id) - 1 AS BIGINT) AS pos FROM near WHERE id NOT IN (SELECT id FROM m)),
members AS (SELECT cell, id FROM m UNION ALL SELECT cell, id FROM children)"""


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), F.col("label").cast("long").alias("cell"))


def searched(p: DataFrame) -> DataFrame:
    return p.where(F.col("id") % STRIDE == 0).select(F.col("id").alias("query"), "vec", "cell")


def as_points(q: DataFrame) -> DataFrame:
    return q.select(F.col("query").alias("id"), "vec")


def starts(p: DataFrame) -> DataFrame:
    return p.groupBy("cell").agg(F.min_by("vec", "id").alias("vec"))


def label_medoids(p: DataFrame) -> DataFrame:
    """One medoid per label: the member nearest to the label's mean."""
    cells = p.select("id", "cell")
    return kmeans.medoids(p.select("id", "vec"), cells, kmeans.means(p.select("id", "vec"), cells, False))


def ranked(p: DataFrame) -> DataFrame:
    return p.select("id", F.pmod(F.col("id") * 2654435761, F.lit(4294967296)).alias("rank"))


def directory(p: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(medoids with vectors, members with vectors)."""
    m = checkpoint(label_medoids(p))
    medoids = m.join(p.select("id", "vec"), "id").select("cell", "id", "vec")
    children = checkpoint(kmeans.buckets(ranked(p), p.select("id", "vec"), m))
    members = m.select("cell", "id").unionByName(children.select("cell", "id"))
    return medoids, members.join(p.select("id", "vec"), "id")


@query(f"""WITH {Q}, s AS (SELECT query, e.id, list_dot_product(q.vec, e.vec) AS score FROM q, e WHERE e.id <> query)
SELECT query, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS BIGINT) AS rank, id, score FROM s QUALIFY rank <= {TOP}""")
def knn_ip_topk(spark, sf_dir):
    p = points(spark, sf_dir)
    return knn.nearest(as_points(searched(p)), p, TOP)


@query(f"""WITH {Q}, s AS (SELECT query, e.id, list_sum(list_transform(range(1, 65), lambda i: (q.vec[i] - e.vec[i]) * (q.vec[i] - e.vec[i]))) AS d FROM q, e WHERE e.id <> query)
SELECT query, CAST(row_number() OVER (PARTITION BY query ORDER BY d, id) AS BIGINT) AS rank, id, round(d, 6) AS d FROM s QUALIFY rank <= {TOP}""")
def knn_l2_topk(spark, sf_dir):
    p = points(spark, sf_dir)
    return knn.nearest(as_points(searched(p)), p, TOP, "l2").select("query", "rank", "id", F.round("score", 6).alias("d"))


@query(f"WITH {E} SELECT id, round(sqrt(list_dot_product(vec, vec)), 9) AS norm, round(list_sum(list_transform(vec, lambda x: x / sqrt(list_dot_product(vec, vec)))), 6) AS unit_sum FROM e")
def vector_norms(spark, sf_dir):
    v = F.col("vec")
    unit = F.aggregate(vec.normalize(v), F.lit(0.0), lambda s, x: s + x)
    return points(spark, sf_dir).select("id", F.round(vec.norm(v), 9).alias("norm"), F.round(unit, 6).alias("unit_sum"))


@query(f"""WITH {E}, t AS (SELECT id, list_transform(vec, lambda x: CAST(round(x * 1000) AS BIGINT)) AS v FROM e)
SELECT id, CAST(len(v) AS INTEGER) AS dim, CAST(list_sum(v) AS BIGINT) AS total, CAST(v[1] AS BIGINT) AS first_value FROM t""")
def parsed_vectors(spark, sf_dir):
    literal = F.to_json(F.transform("vec", lambda x: F.round(x.cast("double") * 1000).cast("long")))
    v = vec.parse_vector(F.col("raw"), DIM)
    rows = points(spark, sf_dir).select("id", literal.alias("raw")).select("id", v.alias("v"))
    return rows.select("id", F.size("v").alias("dim"), F.aggregate("v", F.lit(0.0), lambda s, x: s + x).cast("long").alias("total"), F.element_at("v", 1).cast("long").alias("first_value"))


@query(f"""WITH {Q}, s AS (SELECT query, q.label = e.label AS same, e.id, list_dot_product(q.vec, e.vec) AS score FROM q, e WHERE e.id <> query),
t AS (SELECT query, id FROM s QUALIFY row_number() OVER (PARTITION BY query ORDER BY score DESC, id) <= {TOP}),
r AS (SELECT query, id FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY query ORDER BY score DESC, id) <= {TOP})
SELECT t.query, count(r.id) * 100.0 / {TOP} AS recall FROM t LEFT JOIN r ON t.query = r.query AND t.id = r.id GROUP BY t.query""")
def ground_truth_recall(spark, sf_dir):
    """Recall of a search that sees its own label only."""
    p = points(spark, sf_dir)
    q = searched(p)
    truth = knn.nearest(as_points(q), p, TOP)
    pairs = q.select("query", F.col("vec").alias("q"), "cell").join(p, "cell").where("id <> query")
    narrow = knn.top_by(pairs.select("query", "id", vec.dot(F.col("q"), F.col("vec")).alias("score")), "query", [F.desc("score"), F.asc("id")], TOP)
    return knn.recall(narrow, truth, TOP).select("query", F.col("recall").cast("double").alias("recall"))


@query(f"WITH {E}, {STARTS} SELECT id, CAST(arg_min(cell, (-list_dot_product(e.vec, starts.vec), cell)) AS BIGINT) AS cell, max(list_dot_product(e.vec, starts.vec)) AS score FROM e, starts GROUP BY id")
def centroid_assign_cosine(spark, sf_dir):
    p = points(spark, sf_dir)
    return kmeans.assign(p, starts(p))


@query(f"""WITH {E}, {STARTS}, d AS (SELECT id, cell, list_sum(list_transform(range(1, 65), lambda i: (e.vec[i] - starts.vec[i]) * (e.vec[i] - starts.vec[i]))) AS d FROM e, starts)
SELECT id, CAST(arg_min(cell, (d, cell)) AS BIGINT) AS cell, round(min(d), 6) AS score FROM d GROUP BY id""")
def centroid_assign_l2(spark, sf_dir):
    p = points(spark, sf_dir)
    return kmeans.assign(p, starts(p), "l2").withColumn("score", F.round("score", 6))


@query()
def lloyd_cells(spark, sf_dir):
    p = points(spark, sf_dir)
    return kmeans.lloyd(p.select("id", "vec"), starts(p), 3)[1].select("id", "cell")


@query(f"WITH {MEDOID} SELECT CAST(cell AS BIGINT) AS cell, id FROM m")
def medoid_per_label(spark, sf_dir):
    return label_medoids(points(spark, sf_dir))


@query(f"""WITH {E}, c AS (SELECT label, count(*) AS n FROM e GROUP BY label)
SELECT CAST(min(n) AS BIGINT) AS low, CAST(max(n) AS BIGINT) AS high, round(avg(n), 6) AS mean, round(quantile_cont(n, 0.5), 6) AS q500, round(quantile_cont(n, 0.95), 6) AS q950 FROM c""")
def bucket_stats(spark, sf_dir):
    counts = points(spark, sf_dir).groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
    found = kmeans.spread(counts, "n")
    return found.select("low", "high", *[F.round(c, 6).alias(c) for c in ("mean", "q500", "q950")])


@query(f"WITH {MEMBERS} SELECT CAST(children.cell AS BIGINT) AS cell, m.id AS medoid_id, pos, children.id FROM children JOIN m ON m.cell = children.cell")
def directory_children(spark, sf_dir):
    p = points(spark, sf_dir)
    return kmeans.buckets(ranked(p), p.select("id", "vec"), checkpoint(label_medoids(p)))


PROBE = f"""{MEMBERS}, q AS (SELECT id AS query, vec FROM e WHERE id % {STRIDE} = 0),
probe AS (SELECT query, mv.cell, mv.id AS medoid_id, -list_dot_product(q.vec, mv.vec) AS d,
          CAST(row_number() OVER (PARTITION BY query ORDER BY -list_dot_product(q.vec, mv.vec), mv.cell) AS BIGINT) AS rank FROM q, mv QUALIFY rank <= 3)"""


@query(f"WITH {PROBE} SELECT query, CAST(cell AS BIGINT) AS cell, medoid_id, d, rank FROM probe")
def directory_probe(spark, sf_dir):
    p = points(spark, sf_dir)
    medoids = checkpoint(label_medoids(p)).join(p.select("id", "vec"), "id")
    return routing.probe(searched(p), medoids, 3)


WINNER = f"""{PROBE}, win AS (SELECT probe.query, arg_min(e.id, (-list_dot_product(q.vec, e.vec), e.id)) AS id, min(-list_dot_product(q.vec, e.vec)) AS d
FROM probe JOIN members USING (cell) JOIN e ON e.id = members.id JOIN q ON q.query = probe.query WHERE e.id <> probe.query GROUP BY probe.query)"""


@query(f"WITH {WINNER} SELECT query, id, d FROM win")
def directory_winner(spark, sf_dir):
    p = points(spark, sf_dir)
    medoids, members = directory(p)
    return routing.winner(searched(p), routing.probe(searched(p), medoids, 3), members)


@query(f"""WITH {WINNER}, one AS (SELECT query, e.id, -list_dot_product(q.vec, e.vec) AS d FROM q, e WHERE e.id <> query QUALIFY row_number() OVER (PARTITION BY query ORDER BY -list_dot_product(q.vec, e.vec), e.id) = 1),
hist AS (SELECT a.query, b.id, max(b.query) AS seq FROM one a JOIN one b ON b.query < a.query GROUP BY a.query, b.id QUALIFY row_number() OVER (PARTITION BY a.query ORDER BY max(b.query) DESC) <= 16),
top AS (SELECT hist.query, e.id, CAST(row_number() OVER (PARTITION BY hist.query ORDER BY -list_dot_product(q.vec, e.vec), e.id) AS BIGINT) AS pos FROM hist JOIN e ON e.id = hist.id JOIN q ON q.query = hist.query)
SELECT top.query, pos, top.id FROM top LEFT JOIN win ON win.query = top.query WHERE pos <= 8 AND top.id IS DISTINCT FROM win.id""")
def recent_starts(spark, sf_dir):
    """The eight nearest of the last 16 distinct destinations before each query, less its junction."""
    p = points(spark, sf_dir)
    q = searched(p)
    medoids, members = directory(p)
    junction = routing.winner(q, routing.probe(q, medoids, 3), members)
    top = checkpoint(knn.nearest(as_points(q), p, 1).select("query", "id"))
    # One pass in the order of the queries, over ids alone; a query sees the state before its own turn.
    events = top.select(F.lit("all").alias("stream"), F.col("query").alias("seq"), "id")

    def step(held, row):
        before = list(held.held)
        held.push(row[2])
        return row[0], row[1], before

    seen = history.fold(events, lambda: history.Lru(16), step, "stream string, seq long, ids array<long>", ["stream", "seq", "id"])
    held = seen.select(F.col("seq").alias("query"), F.explode("ids").alias("id")).join(q.select("query", F.col("vec").alias("q")), "query")
    scored = held.join(p.select("id", "vec"), "id").select("query", "id", routing.distance(F.col("q"), F.col("vec")).alias("d"))
    return routing.recent_starts(scored, junction, 8)


def planes() -> list[list[float]]:
    return [vec.plane(b, DIM) for b in range(PLANES)]


def _bucket_sql(order: str) -> str:
    parts = [f"CASE WHEN list_dot_product(vec, [{', '.join(f'CAST({x!r} AS DOUBLE)' for x in p)}]) >= 0 THEN {1 << (PLANES - 1 - k if order == 'msb' else k)} ELSE 0 END" for k, p in enumerate(planes())]
    return f"CAST({' + '.join(parts)} AS INTEGER)"


@query(f"WITH {E} SELECT id, {_bucket_sql('msb')} AS msb, {_bucket_sql('lsb')} AS lsb FROM e")
def lsh_bucket(spark, sf_dir):
    v = F.col("vec")
    return points(spark, sf_dir).select("id", vec.lsh_bucket(v, planes()).alias("msb"), vec.lsh_bucket(v, planes(), "lsb").alias("lsb"))


@query(f"WITH {E}, b AS (SELECT id, {_bucket_sql('msb')} AS bucket FROM e) SELECT bucket, count(*) AS n FROM b GROUP BY bucket")
def lsh_bucket_sizes(spark, sf_dir):
    return points(spark, sf_dir).groupBy(vec.lsh_bucket(F.col("vec"), planes()).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {E}, b AS (SELECT id, {_bucket_sql('msb')} AS bucket FROM e),
t AS (SELECT bucket, id FROM b QUALIFY row_number() OVER (PARTITION BY bucket ORDER BY id DESC) <= 8)
SELECT b.id AS query, t.id FROM b JOIN t USING (bucket) WHERE b.id % {STRIDE} = 0""")
def lsh_starts(spark, sf_dir):
    """Bucket tables hold the eight latest ids of each bucket; a query starts from its bucket's."""
    p = points(spark, sf_dir).select("id", vec.lsh_bucket(F.col("vec"), planes()).alias("bucket"))
    held = knn.top_by(p, "bucket", [F.desc("id")], 8)
    return routing.bucket_starts(p.where(F.col("id") % STRIDE == 0).select(F.col("id").alias("query"), "bucket"), held)


PORTAL = f"""{Q}, {STARTS}, port AS (SELECT label AS cell, max(id) AS id, arg_max(vec, id) AS pvec FROM e GROUP BY label),
coarse AS (SELECT query, q.vec AS qv, starts.cell, CAST(row_number() OVER (PARTITION BY query ORDER BY -list_dot_product(q.vec, starts.vec), starts.cell) AS BIGINT) AS rank FROM q, starts QUALIFY rank <= 3),
route AS (SELECT query, arg_min(port.id, (-list_dot_product(qv, pvec), rank)) AS id, max(list_dot_product(qv, pvec)) AS ip FROM coarse JOIN port USING (cell) GROUP BY query)"""


def portals(p: DataFrame) -> DataFrame:
    return p.groupBy("cell").agg(F.min_by("vec", "id").alias("center"), F.max("id").alias("id"), F.max_by("vec", "id").alias("portal_vec"))


@query(f"WITH {PORTAL} SELECT query, id, ip FROM route")
def portal_route(spark, sf_dir):
    p = points(spark, sf_dir)
    return routing.portal(searched(p), portals(p), 3)


@query(f"""WITH {PORTAL}, way AS (SELECT label AS cell, id AS waypoint FROM e QUALIFY row_number() OVER (PARTITION BY label ORDER BY id) <= 4)
SELECT query, id FROM route UNION SELECT query, waypoint AS id FROM route JOIN port USING (id) JOIN way ON way.cell = port.cell""")
def waypoint_starts(spark, sf_dir):
    p = points(spark, sf_dir)
    gates = portals(p)
    routed = routing.portal(searched(p), gates, 3).join(gates.select("id", "cell"), "id")
    held = knn.top_by(p, "cell", [F.asc("id")], 4).select("cell", (F.col("rank") - 1).alias("pos"), "id")
    return routing.waypoints(routed, held, 4)


@query(f"""WITH {Q}, {STARTS}, pool AS (SELECT CAST(row_number() OVER (ORDER BY label) AS BIGINT) AS pos, min(id) AS id, arg_min(vec, id) AS vec FROM e GROUP BY label)
SELECT query, arg_min(pool.id, (-list_dot_product(q.vec, pool.vec), pos)) AS id, min(-list_dot_product(q.vec, pool.vec)) AS d FROM q, pool GROUP BY query""")
def pool_entry(spark, sf_dir):
    p = points(spark, sf_dir)
    pool = p.groupBy("cell").agg(F.min("id").alias("id"), F.min_by("vec", "id").alias("vec")).withColumnRenamed("cell", "pos")
    return routing.pool_entry(searched(p), pool)


@query(f"""WITH {Q}, {STARTS}, s AS (SELECT e.id, max(list_dot_product(e.vec, starts.vec)) AS support FROM e, starts GROUP BY e.id),
r AS (SELECT id, round(support, 9) AS support, row_number() OVER (ORDER BY support DESC, id) AS near, row_number() OVER (ORDER BY support, id) AS far, count(*) OVER () AS n FROM s)
SELECT id, support, near <= n // 2 AS is_near, far <= n // 2 AS is_far FROM r""")
def support_near_far(spark, sf_dir):
    """Each vector's support by the centres, and whether it is in the nearer or the farther half."""
    p = points(spark, sf_dir)
    support = kmeans.assign(p, starts(p)).select("id", F.col("score").alias("support"))
    near = junctions.dense_index(support, [F.desc("support"), F.asc("id")], "near")
    far = junctions.dense_index(near, [F.asc("support"), F.asc("id")], "far")
    half = p.count() // 2
    return far.select("id", F.round("support", 9).alias("support"), (F.col("near") <= half).alias("is_near"), (F.col("far") <= half).alias("is_far"))


CODES = """book AS (SELECT part, code, list_slice(vec, part * 8 + 1, part * 8 + 8) AS w FROM (SELECT CAST(row_number() OVER (ORDER BY id) - 1 AS INTEGER) AS code, vec FROM e QUALIFY code < 16), range(8) t(part)),
subs AS (SELECT id, part, list_slice(vec, part * 8 + 1, part * 8 + 8) AS s FROM e, range(8) t(part)),
dist AS (SELECT id, subs.part, code, list_sum(list_transform(range(1, 9), lambda i: (s[i] - w[i]) * (s[i] - w[i]))) AS d FROM subs JOIN book ON subs.part = book.part),
codes AS (SELECT id, part, CAST(arg_min(code, (round(d, 9), code)) AS INTEGER) AS code FROM dist GROUP BY id, part)"""


def first_book(p: DataFrame, parts: int = 8, size: int = 16) -> np.ndarray:
    """A codebook of the first ids' subvectors: deterministic, so that SQL can say it too."""
    rows = p.orderBy("id").limit(size).select("vec").collect()
    return np.array([r[0] for r in rows], np.float64).reshape(size, parts, -1).transpose(1, 0, 2)


@query(f"WITH {E}, {CODES} SELECT id, CAST(part AS INTEGER) AS part, code FROM codes")
def pq_codes(spark, sf_dir):
    p = points(spark, sf_dir)
    return pq.encode(p, first_book(p)).select("id", F.posexplode("code").alias("part", "code"))


@query(f"""WITH {Q}, {CODES}, lut AS (SELECT query, part, code, list_sum(list_transform(range(1, 9), lambda i: (q.vec[part * 8 + i] - w[i]) * (q.vec[part * 8 + i] - w[i]))) AS d FROM q, book),
s AS (SELECT query, codes.id, round(sum(d), 6) AS d FROM lut JOIN codes ON lut.part = codes.part AND lut.code = codes.code GROUP BY query, codes.id)
SELECT query, CAST(row_number() OVER (PARTITION BY query ORDER BY d, id) AS BIGINT) AS rank, id, d FROM s QUALIFY rank <= {TOP}""")
def pq_topk(spark, sf_dir):
    p = points(spark, sf_dir)
    book = first_book(p)
    found = pq.scan(searched(p), checkpoint(pq.encode(p, book)), book, k=2 * TOP).withColumn("d", F.round("d", 6))
    return knn.top_by(found, "query", [F.asc("d"), F.asc("id")], TOP).select("query", "rank", "id", "d")


@query(f"""WITH {Q}, s AS (SELECT query, e.id, list_dot_product(q.vec, e.vec) AS score FROM q, e WHERE e.id <> query),
t AS (SELECT query, id, -score AS d, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rk FROM s QUALIFY rk <= 24)
SELECT query, id AS diverse_id FROM t WHERE id // 8 <> query // 8 QUALIFY row_number() OVER (PARTITION BY query ORDER BY d, id) = 1""")
def diverse_entry(spark, sf_dir):
    """The nearest of 24 candidates that is on another page of eight than the query."""
    p = points(spark, sf_dir)
    found = knn.nearest(as_points(searched(p)), p, 24).select("query", "id", (-F.col("score")).alias("d"))
    novel = F.when(routing.same_page(F.col("id"), F.col("query"), 8), -1.0).otherwise(1.0)
    return routing.diverse(found.withColumn("novelty", novel).withColumn("native_best", F.lit(1.0))).select("query", F.col("id").alias("diverse_id"))


@query(f"""WITH {Q}, b AS (SELECT query, min(-list_dot_product(q.vec, e.vec)) AS d FROM q, e WHERE e.id <> query GROUP BY query),
r AS (SELECT query, d, row_number() OVER (ORDER BY d) AS rk, count(*) OVER () AS n FROM b), h AS (SELECT max(d) AS threshold FROM r WHERE rk = n // 2 + 1)
SELECT query, d >= threshold AS open FROM b, h""")
def activation_gate(spark, sf_dir):
    """Queries whose best distance reaches the median order statistic of all open the gate."""
    p = points(spark, sf_dir)
    best = checkpoint(knn.nearest(as_points(searched(p)), p, 1).select("query", (-F.col("score")).alias("d")))
    return best.join(F.broadcast(routing.gate_threshold(best, "d")), F.lit(True)).select("query", (F.col("d") >= F.col("threshold")).alias("open"))


GRAPH = 8


@query(f"""WITH {E}, s AS (SELECT a.id, b.id AS nbr, list_dot_product(a.vec, b.vec) AS s FROM e a, e b WHERE a.id <> b.id),
o AS (SELECT id, nbr, s FROM s QUALIFY row_number() OVER (PARTITION BY id ORDER BY s DESC, nbr) <= {GRAPH}),
u AS (SELECT id, nbr, s FROM o UNION SELECT nbr AS id, id AS nbr, s FROM o)
SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY s DESC, nbr) AS BIGINT) AS rank, nbr FROM u QUALIFY rank <= {2 * GRAPH}""")
def knn_graph_edges(spark, sf_dir):
    """The proximity graph that the searches walk; every vector is a node, so all are queried."""
    graph = search.knn_graph(points(spark, sf_dir), GRAPH)
    return graph.select("id", F.posexplode("nbrs").alias("rank", "nbr")).select("id", (F.col("rank") + 1).cast("long").alias("rank"), "nbr")


def index_of(p: DataFrame) -> search.Index:
    graph = checkpoint(search.knn_graph(p, GRAPH))
    m = checkpoint(label_medoids(p))
    children = kmeans.buckets(ranked(p), p.select("id", "vec"), m).select("cell", "id", F.lit(False).alias("is_medoid"), "pos")
    both = m.select("cell", "id", F.lit(True).alias("is_medoid"), F.lit(0).cast("long").alias("pos")).unionByName(children)
    return search.load(p, graph, search.medoid(p), both)


ARMS = {
    "baseline": search.Routing(),
    "junction": search.Routing(junctions=True, nprobe=3),
    "core": search.Routing(junctions=True, nprobe=3, recents=8, capacity=256),
    "full": search.Routing(junctions=True, nprobe=3, recents=8, capacity=256, exits=10),
}
WIDTHS = (10, 20, 40)


@query()
def arm_replay(spark, sf_dir):
    """Recall and reads of four entry policies at three search widths, replayed causally."""
    p = points(spark, sf_dir)
    q = searched(p)
    streams = {f"{arm}/{w}": (r, search.Walk(width=w)) for arm, r in ARMS.items() for w in WIDTHS}
    found = search.replay(q, index_of(p), streams)
    truth = knn.nearest(as_points(q), p, TOP, exclude_self=False)
    return search.summary(found, truth, TOP).withColumn("arm", F.split("stream", "/")[0]).withColumn("width", F.split("stream", "/")[1].cast("int")).drop("stream")


@query()
def search_traces(spark, sf_dir):
    """Traversal traces of a narrow teacher search, in expansion order."""
    p = points(spark, sf_dir)
    found = search.replay(searched(p), index_of(p), {"teacher": (search.Routing(), search.Walk(width=4, k=1))})
    return found.select("query", F.element_at("ids", 1).alias("result_id"), "reads", F.posexplode("trace").alias("pos", "id"))


@query(f"""WITH {E}, b AS (SELECT id, {_bucket_sql('msb')} AS bucket FROM e),
t AS (SELECT bucket, id FROM b JOIN (SELECT id, label FROM e) USING (id) WHERE label < 5 QUALIFY row_number() OVER (PARTITION BY bucket ORDER BY id DESC) <= 8),
n AS (SELECT b.id AS query, count(t.id) AS n FROM b LEFT JOIN t USING (bucket) WHERE b.id % {STRIDE} = 0 GROUP BY b.id)
SELECT round(avg(CAST(n > 0 AS INTEGER)) * 100, 6) AS usage, round(avg(n), 6) AS mean_starts FROM n""")
def lsh_usage(spark, sf_dir):
    """How many queries find anything in their bucket when vectors of five labels were destinations."""
    p = points(spark, sf_dir).select("id", "cell", vec.lsh_bucket(F.col("vec"), planes()).alias("bucket"))
    held = knn.top_by(p.where("cell < 5"), "bucket", [F.desc("id")], 8)
    q = p.where(F.col("id") % STRIDE == 0).select(F.col("id").alias("query"), "bucket")
    got = studies.bucket_usage(routing.bucket_starts(q, held), q)
    return got.select(F.round("usage", 6).alias("usage"), F.round("mean_starts", 6).alias("mean_starts"))


@query()
def write_sweep(spark, sf_dir):
    """Recall and reads when one in 1, 2, 4 or 10 new destinations is kept as an exit."""
    p = points(spark, sf_dir)
    q = searched(p)
    streams = studies.streams_of("writes", (20,))
    truth = knn.nearest(as_points(q), p, TOP, exclude_self=False)
    return search.summary(search.replay(q, index_of(p), streams), truth, TOP)
