"""Queries over ``events``: demand streams, traces, junction rankings and causal histories.

The traces are per user: the sequence of ``props.k`` in time order, so a vertex is a value of k.
The histories are per event type: the stream's destinations are user ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waymark.functions import hashing
from waymark.operators import demand, history, junctions, routing

from . import query, table

K = "CAST(json_extract(props, '$.k') AS BIGINT)"
STEPS = f"steps AS (SELECT user_id AS query, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT) AS pos, {K} AS id FROM events)"
FIRST = f"{STEPS}, firsts AS (SELECT query, id, min(pos) AS pos FROM steps GROUP BY query, id)"
SCORE = f"{FIRST}, s AS (SELECT id, CAST(sum(pos) AS BIGINT) AS score, count(*) AS support FROM firsts WHERE pos > 0 GROUP BY id)"
SEQ = "ev AS (SELECT event_type AS stream, CAST(row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS BIGINT) AS seq, user_id AS id FROM events)"
BUDGET, CAPACITY = 50, 32


def events(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events")


def steps(spark, sf_dir) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return events(spark, sf_dir).select(F.col("user_id").alias("query"), (F.row_number().over(w) - 1).cast("long").alias("pos"), F.get_json_object("props", "$.k").cast("long").alias("id"))


def streams(spark, sf_dir) -> DataFrame:
    named = events(spark, sf_dir).select(F.col("event_type").alias("stream"), "ts", "event_id", F.col("user_id").alias("id"))
    return history.ordered(named, ["ts", "event_id"]).select("stream", "seq", "id")


@query(f"WITH {FIRST} SELECT * FROM firsts")
def first_positions(spark, sf_dir):
    return junctions.first_positions(steps(spark, sf_dir))


def _rank(kind: str, order: str):
    sql = f"WITH {SCORE} SELECT CAST(row_number() OVER (ORDER BY {order}) AS BIGINT) AS rank, id, score, support FROM s"

    def build(spark, sf_dir):
        return junctions.ranking(junctions.scored(steps(spark, sf_dir)), kind).select("rank", "id", "score", "support")

    build.__name__ = f"junction_score_{kind}"
    query(sql)(build)


for _kind, _order in (("sum", "score DESC, support DESC, id"), ("count", "support DESC, id"), ("mean", "CAST(score AS DOUBLE) / support DESC, support DESC, id")):
    _rank(_kind, _order)


@query(f"""WITH {FIRST}, s AS (SELECT id, CAST(sum(pos) AS BIGINT) AS score, count(*) AS support FROM firsts GROUP BY id)
SELECT CAST(row_number() OVER (ORDER BY support DESC, score DESC, id) AS BIGINT) AS rank, id, score, support FROM s""")
def hot_cache_rank(spark, sf_dir):
    return junctions.ranking(junctions.scored(steps(spark, sf_dir), include_start=True), "hot").select("rank", "id", "score", "support")


@query(f"WITH {STEPS} SELECT id, count(*) AS visits, CAST(row_number() OVER (ORDER BY count(*) DESC, id) AS BIGINT) AS rank FROM steps GROUP BY id")
def visit_rank(spark, sf_dir):
    visits = steps(spark, sf_dir).groupBy("id").agg(F.count(F.lit(1)).alias("visits"))
    return junctions.dense_index(visits, [F.desc("visits"), F.asc("id")], "rank").select("id", "visits", "rank")


@query(f"""WITH {SCORE}, r AS (SELECT CAST(row_number() OVER (ORDER BY score DESC, support DESC, id) AS BIGINT) AS rank, id FROM s)
SELECT CAST(budget AS INTEGER) AS budget, rank, id FROM r, (VALUES (10), (20), (50)) b(budget) WHERE rank <= budget""")
def budget_sweep(spark, sf_dir):
    return junctions.budget_sweep(junctions.ranking(junctions.scored(steps(spark, sf_dir))), [10, 20, 50])


@query(f"""WITH {SCORE}, r AS (SELECT id, row_number() OVER (ORDER BY score DESC, support DESC, id) AS a, row_number() OVER (ORDER BY support DESC, id) AS b FROM s)
SELECT count(*) AS shared, count(*) / CAST({BUDGET} AS DOUBLE) AS share FROM r WHERE a <= {BUDGET} AND b <= {BUDGET}""")
def variant_overlap(spark, sf_dir):
    scores = junctions.scored(steps(spark, sf_dir))
    return junctions.overlap(junctions.ranking(scores, "sum"), junctions.ranking(scores, "count"), BUDGET)


@query(f"""WITH {SCORE}, r AS (SELECT support, row_number() OVER (ORDER BY score DESC, support DESC, id) AS rank FROM s), k AS (SELECT list_sort(list(support)) AS v FROM r WHERE rank <= {BUDGET})
SELECT v[-1] AS most, v[len(v) // 2 + 1] AS upper_median FROM k""")
def support_stats(spark, sf_dir):
    kept = junctions.select_budget(junctions.ranking(junctions.scored(steps(spark, sf_dir))), BUDGET)
    return kept.agg(F.max("support").alias("most"), junctions.upper_median(F.col("support")).alias("upper_median"))


@query(f"WITH {STEPS}, n AS (SELECT query, count(*) AS n FROM steps GROUP BY query) SELECT round(avg(n), 6) AS mean, round(quantile_cont(n, 0.5), 6) AS median, round(quantile_cont(n, 0.95), 6) AS p95 FROM n")
def trace_summary(spark, sf_dir):
    n = steps(spark, sf_dir).groupBy("query").agg(F.count(F.lit(1)).alias("n"))
    return n.agg(F.round(F.avg("n"), 6).alias("mean"), F.round(F.percentile("n", F.lit(0.5)), 6).alias("median"), F.round(F.percentile("n", F.lit(0.95)), 6).alias("p95"))


@query(f"""WITH {SCORE}, r AS (SELECT id, row_number() OVER (ORDER BY score DESC, support DESC, id) AS rank FROM s),
v AS (SELECT rank, count(*) AS n FROM steps JOIN r USING (id) WHERE pos > 0 GROUP BY rank)
SELECT CAST(rank AS BIGINT) AS rank, round(CAST(sum(n) OVER (ORDER BY rank) AS DOUBLE) / CAST(sum(n) OVER () AS DOUBLE), 9) AS share FROM v""")
def visit_share(spark, sf_dir):
    """How much of the traffic the first ranked vertices carry, cumulated over ranks."""
    s = steps(spark, sf_dir)
    ranked = junctions.ranking(junctions.scored(s)).select("id", "rank")
    visits = s.where("pos > 0").join(ranked, "id").groupBy("rank").agg(F.count(F.lit(1)).alias("n"))
    return junctions.cumulated_share(visits, "rank", "n", "share").select("rank", F.round("share", 9).alias("share"))


@query("SELECT event_id, CAST(row_number() OVER (ORDER BY ts, event_id) - 1 AS BIGINT) AS query FROM events")
def stable_order(spark, sf_dir):
    return demand.numbered(events(spark, sf_dir).select("event_id", "ts"), ["ts", "event_id"]).select("event_id", "query")


@query("""WITH g AS (SELECT CAST(epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS DOUBLE) / 1000 AS gap FROM events),
a AS (SELECT [0.0::DOUBLE, 0.1, 0.25, 0.5, 0.75, 0.9, 0.99, 1.0] AS q, quantile_cont(gap, [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 0.99, 1.0]) AS v FROM g)
SELECT unnest(q) AS q, round(unnest(v), 3) AS value FROM a""")
def interarrival_quantiles(spark, sf_dir):
    """Quantiles of the milliseconds between a user's consecutive events."""
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    e = demand.gaps(events(spark, sf_dir), ["user_id"], ["ts", "event_id"], micros).withColumn("gap", F.col("gap") / 1000.0)
    return demand.quantile_map(e, "gap").withColumn("value", F.round("value", 3))


@query(f"""WITH n AS (SELECT event_id, user_id, {K} AS k, CAST(row_number() OVER (ORDER BY ts, event_id) - 1 AS BIGINT) AS query FROM events)
SELECT query, CAST(query - lag(query) OVER (PARTITION BY user_id, k ORDER BY query) AS BIGINT) AS distance FROM n""")
def exact_repeats(spark, sf_dir):
    """How far back in the whole stream the same (user, k) occurred."""
    e = events(spark, sf_dir).select("event_id", "ts", "user_id", F.get_json_object("props", "$.k").cast("long").alias("k"))
    return demand.repeats(demand.numbered(e, ["ts", "event_id"]), ["user_id", "k"], "query").select("query", "distance")


@query("""SELECT user_id, count(DISTINCT event_type) AS kinds, count(*) AS n, round(CAST(count(*) FILTER (WHERE value > 100) AS DOUBLE) / nullif(count(*) FILTER (WHERE value > 50), 0), 9) AS share FROM events GROUP BY user_id""")
def session_coverage(spark, sf_dir):
    over = lambda x: F.count(F.when(F.col("value") > x, 1))
    return events(spark, sf_dir).groupBy("user_id").agg(F.count_distinct("event_type").alias("kinds"), F.count(F.lit(1)).alias("n"), F.round(demand.coverage(over(100), over(50)), 9).alias("share"))


@query("""WITH n AS (SELECT CAST(row_number() OVER (ORDER BY ts, event_id) - 1 AS BIGINT) AS query, value FROM events),
s AS (SELECT *, CASE WHEN query < 5000 THEN 'train' WHEN query < 9000 THEN 'warmup' WHEN query < 10000 THEN 'test' END AS split FROM n)
SELECT split, count(*) AS n, min(query) AS low, max(query) AS high FROM s WHERE split IS NOT NULL GROUP BY split""")
def split_counts(spark, sf_dir):
    e = demand.numbered(events(spark, sf_dir).select("ts", "event_id", "value"), ["ts", "event_id"])
    return demand.split(e, "query", {"train": 5000, "warmup": 4000, "test": 1000}).groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.min("query").alias("low"), F.max("query").alias("high"))


HISTORIES = [0, 250, 500, 1000, 2000, 3000, 4000]


@query(f"""WITH n AS (SELECT CAST(row_number() OVER (ORDER BY ts, event_id) - 1 AS BIGINT) AS query FROM events),
h AS (SELECT CAST(unnest({HISTORIES}) AS INTEGER) AS history),
w AS (SELECT history, CASE WHEN query < history THEN 'warmup' WHEN query < history + 500 THEN 'measured' END AS role FROM n, h)
SELECT history, role, count(*) AS n FROM w WHERE role IS NOT NULL GROUP BY history, role""")
def warmup_windows(spark, sf_dir):
    e = demand.numbered(events(spark, sf_dir).select("ts", "event_id"), ["ts", "event_id"])
    return demand.windows(e, "query", HISTORIES, 500).groupBy("history", "role").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH l AS (SELECT user_id AS query, list(event_type ORDER BY ts, event_id) AS names FROM events GROUP BY user_id),
m AS (SELECT event_type AS key, CAST(row_number() OVER (ORDER BY event_type) - 1 AS BIGINT) AS id FROM (SELECT DISTINCT event_type FROM events WHERE event_type <> 'view')),
x AS (SELECT query, unnest(names) AS key, unnest(range(len(names))) AS pos FROM l)
SELECT query, CAST(row_number() OVER (PARTITION BY query ORDER BY pos) - 1 AS BIGINT) AS place, m.id FROM x JOIN m USING (key)""")
def mapped_lists(spark, sf_dir):
    """List elements looked up in a dictionary that lacks one of them; the order of the list stays."""
    e = events(spark, sf_dir)
    lists = e.groupBy(F.col("user_id").alias("query")).agg(F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type"))), lambda s: s["event_type"]).alias("names"))
    keys = e.where("event_type <> 'view'").select(F.col("event_type").alias("key")).distinct()
    mapping = junctions.dense_index(keys, [F.asc("key")], "id", start=0)
    return demand.mapped(lists, "names", mapping).select("query", F.posexplode("ids").alias("place", "id")).withColumn("place", F.col("place").cast("long"))


@query(f"""WITH {SEQ}, l AS (SELECT stream, id, max(seq) AS seq FROM ev GROUP BY stream, id QUALIFY row_number() OVER (PARTITION BY stream ORDER BY max(seq) DESC) <= {CAPACITY})
SELECT stream, CAST(row_number() OVER (PARTITION BY stream ORDER BY seq) - 1 AS BIGINT) AS pos, id FROM l""")
def lru_contents(spark, sf_dir):
    return history.lru_contents(streams(spark, sf_dir), CAPACITY)


LRU = f"""{SEQ}, p AS (SELECT *, lag(seq) OVER (PARTITION BY stream, id ORDER BY seq) AS before FROM ev),
d AS (SELECT p.stream, p.seq, count(DISTINCT b.id) AS depth FROM p JOIN ev b ON b.stream = p.stream AND b.seq >= p.before AND b.seq < p.seq GROUP BY p.stream, p.seq)"""


@query(f"WITH {LRU} SELECT ev.stream, ev.seq, ev.id, coalesce(depth <= {CAPACITY}, false) AS hit FROM ev LEFT JOIN d ON d.stream = ev.stream AND d.seq = ev.seq")
def lru_hits(spark, sf_dir):
    return history.lru_replay(streams(spark, sf_dir), CAPACITY).select("stream", "seq", "id", "hit")


@query(f"""WITH {LRU}, c AS (SELECT CAST(unnest([16, 32, 64, 128]) AS INTEGER) AS capacity)
SELECT ev.stream, capacity, round(count(*) FILTER (WHERE depth <= capacity) * 100.0 / count(*), 9) AS share FROM ev CROSS JOIN c LEFT JOIN d ON d.stream = ev.stream AND d.seq = ev.seq GROUP BY ev.stream, capacity""")
def recent_overlap(spark, sf_dir):
    found = history.recent_overlap(streams(spark, sf_dir), [16, 32, 64, 128])
    return found.withColumn("share", F.round(F.col("share").cast("double"), 9))


@query("""WITH ev AS (SELECT event_type AS stream, CAST(row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS BIGINT) AS seq, user_id % 7 AS cell, user_id AS id FROM events),
l AS (SELECT stream, cell, id, max(seq) AS seq FROM ev GROUP BY stream, cell, id QUALIFY row_number() OVER (PARTITION BY stream ORDER BY max(seq) DESC) <= 32)
SELECT stream, cell, count(*) AS held, max(seq) AS latest FROM l GROUP BY stream, cell""")
def regional_lru(spark, sf_dir):
    """One capacity over all regions: the globally oldest (cell, id) leaves first."""
    s = streams(spark, sf_dir).withColumn("cell", F.col("id") % 7)
    pair = s.select("stream", "seq", F.struct("cell", "id").alias("id"))
    held = history.lru_contents(pair, CAPACITY).select("stream", "id.cell", "id.id")
    last = s.groupBy("stream", "id").agg(F.max("seq").alias("seq"))
    return held.join(last, ["stream", "id"]).groupBy("stream", "cell").agg(F.count(F.lit(1)).alias("held"), F.max("seq").alias("latest"))


@query("""WITH b AS (SELECT user_id % 16 AS bucket, user_id AS id, max(epoch_us(ts)) AS seen_at, max(event_id) AS e FROM events GROUP BY ALL)
SELECT CAST(bucket AS VARCHAR) AS stream, id FROM b QUALIFY row_number() OVER (PARTITION BY bucket ORDER BY seen_at DESC, e DESC) <= 8""")
def bucket_lru(spark, sf_dir):
    """A history of eight per hash bucket."""
    e = events(spark, sf_dir).select((F.col("user_id") % 16).cast("string").alias("stream"), "ts", "event_id", F.col("user_id").alias("id"))
    return history.lru_contents(history.ordered(e, ["ts", "event_id"]), 8).select("stream", "id")


FIFO = f"""{SEQ}, r(stream, seq, ring, nxt, hit, gone) AS (
SELECT stream, CAST(-1 AS BIGINT), CAST([] AS BIGINT[]), 0, false, CAST(NULL AS BIGINT) FROM (SELECT DISTINCT stream FROM ev)
UNION ALL SELECT r.stream, ev.seq,
 CASE WHEN list_contains(ring, id) THEN ring WHEN len(ring) < {CAPACITY} THEN list_append(ring, id) ELSE list_concat(list_append(list_slice(ring, 1, nxt), id), list_slice(ring, nxt + 2, {CAPACITY})) END,
 CASE WHEN list_contains(ring, id) OR len(ring) < {CAPACITY} THEN nxt ELSE (nxt + 1) % {CAPACITY} END,
 list_contains(ring, id), CASE WHEN list_contains(ring, id) OR len(ring) < {CAPACITY} THEN NULL ELSE ring[nxt + 1] END
FROM r JOIN ev ON ev.stream = r.stream AND ev.seq = r.seq + 1)"""


@query(f"WITH RECURSIVE {FIFO} SELECT stream, seq, hit, gone AS evicted FROM r WHERE seq >= 0")
def fifo_replay(spark, sf_dir):
    return history.fifo_replay(streams(spark, sf_dir), CAPACITY).select("stream", "seq", "hit", "evicted")


@query(f"""WITH RECURSIVE {FIFO} SELECT stream, count(*) FILTER (WHERE NOT hit) AS inserts, count(*) FILTER (WHERE hit) AS skips, count(gone) AS evictions,
count(*) FILTER (WHERE NOT hit AND seq >= 500) AS eval_inserts, count(*) FILTER (WHERE hit AND seq >= 500) AS eval_skips, count(*) FILTER (WHERE seq >= 500) AS eval_queries FROM r WHERE seq >= 0 GROUP BY stream""")
def fifo_counters(spark, sf_dir):
    return history.counters(history.fifo_replay(streams(spark, sf_dir), CAPACITY), 500)


@query(f"""WITH RECURSIVE {FIFO}, s AS (SELECT r.stream, ev.id, r.seq AS insert_seq FROM r JOIN ev ON ev.stream = r.stream AND ev.seq = r.seq WHERE NOT hit),
g AS (SELECT stream, gone AS id, seq FROM r WHERE gone IS NOT NULL)
SELECT s.stream, s.id, insert_seq, min(g.seq) AS evict_seq FROM s LEFT JOIN g ON g.stream = s.stream AND g.id = s.id AND g.seq > insert_seq GROUP BY s.stream, s.id, insert_seq""")
def history_lifetimes(spark, sf_dir):
    """From when to when each id is visible to later queries."""
    return history.lifetimes(history.fifo_replay(streams(spark, sf_dir), CAPACITY))


def _wrapped(x: str, factor: int) -> str:
    return f"CAST((CAST({x} AS UHUGEINT) * CAST({factor} AS UHUGEINT)) % CAST(18446744073709551616 AS UHUGEINT) AS UBIGINT)"


DRAW = f"""{SEQ}, w0 AS (SELECT stream, seq, id, id % 11 AS hub, xor(xor(CAST(id % 11 AS UBIGINT) << 32, CAST(id AS UBIGINT)), {_wrapped("seq", hashing.GOLDEN)}) AS h FROM ev),
w1 AS (SELECT * REPLACE ({_wrapped("xor(h, h >> 30)", hashing.FIRST)} AS h) FROM w0),
w2 AS (SELECT * REPLACE ({_wrapped("xor(h, h >> 27)", hashing.SECOND)} AS h) FROM w1),
drawn AS (SELECT stream, seq, id, hub, xor(h, h >> 31) % 2 = 0 AS accepted FROM w2)"""

SLOTS = 10
EXITS = f"""{DRAW}, turns AS (SELECT *, row_number() OVER (PARTITION BY stream, hub ORDER BY seq) AS turn FROM drawn),
p(stream, hub, turn, seq, winner, page, outcome) AS (
SELECT DISTINCT stream, hub, CAST(0 AS BIGINT), CAST(-1 AS BIGINT), CAST(NULL AS BIGINT), CAST([] AS BIGINT[]), '' FROM drawn
UNION ALL SELECT stream, hub, turn, seq, id, CASE WHEN outcome <> 'accepted' THEN page WHEN len(one) < {SLOTS} AND NOT list_contains(one, (id + 2) % 150) THEN list_append(one, (id + 2) % 150) ELSE one END, outcome
FROM (SELECT *, CASE WHEN len(head) < {SLOTS} AND NOT list_contains(head, (id + 1) % 150) THEN list_append(head, (id + 1) % 150) ELSE head END AS one
FROM (SELECT p.stream, p.hub, t.turn, t.seq, t.id, p.page, list_slice(list_prepend(t.id, p.page), 1, {SLOTS}) AS head,
CASE WHEN list_contains(p.page, t.id) THEN 'duplicate' WHEN t.accepted THEN 'accepted' ELSE 'rejected' END AS outcome
FROM p JOIN turns t ON t.stream = p.stream AND t.hub = p.hub AND t.turn = p.turn + 1)))"""


@query(f"WITH RECURSIVE {EXITS} SELECT stream, seq, hub, winner, outcome, CAST(len(page) AS INTEGER) AS slots FROM p WHERE turn > 0")
def exits_replay(spark, sf_dir):
    """Sampled exits of each hub; a hub is a user id modulo eleven."""
    s = streams(spark, sf_dir)
    return history.exits_replay(s.select("stream", "seq", (F.col("id") % 11).alias("hub"), F.col("id").alias("winner"), F.array((F.col("id") + 1) % 150, (F.col("id") + 2) % 150).alias("ranked")), SLOTS, 2)


@query(f"WITH {DRAW} SELECT stream, seq, accepted FROM drawn")
def sampled_writes(spark, sf_dir):
    """Which events a Bernoulli draw of one half accepts, by hash."""
    s = streams(spark, sf_dir)
    return s.select("stream", "seq", hashing.accepts(F.col("id") % 11, F.col("id"), F.col("seq"), 2).alias("accepted"))


@query("SELECT range AS j, (range * 2654435761 + 1013904223) % 10000000 AS id FROM range(512)")
def random_pool(spark, sf_dir):
    return spark.range(512).select(F.col("id").alias("j"), hashing.pool_id(F.col("id"), 10_000_000).alias("id"))


@query("""SELECT user_id, len(list_distinct(list(event_type))) AS n_starts, true AS unique_starts FROM events GROUP BY user_id""")
def start_points(spark, sf_dir):
    """Per-query start lists, checked to have no repeats; the first list that is not empty counts."""
    e = events(spark, sf_dir).groupBy("user_id").agg(F.collect_set("event_type").alias("own"))
    picked = routing.check_starts(e.withColumn("starts", routing.precedence(F.array().cast("array<string>"), F.col("own"))))
    return picked.select("user_id", F.size("starts").cast("long").alias("n_starts"), (F.size("starts") == F.size(F.array_distinct("starts"))).alias("unique_starts"))


@query(f"""WITH RECURSIVE {FIFO}, g AS (SELECT stream, gone AS id, seq FROM r WHERE gone IS NOT NULL),
s AS (SELECT r.stream, ev.id, r.seq FROM r JOIN ev ON ev.stream = r.stream AND ev.seq = r.seq WHERE NOT hit),
h AS (SELECT s.stream, s.id FROM s WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.stream = s.stream AND g.id = s.id AND g.seq > s.seq))
SELECT ev.stream, count(*) FILTER (WHERE h.id IS NOT NULL) AS hits, count(*) AS n FROM ev LEFT JOIN h ON h.stream = ev.stream AND h.id = ev.id GROUP BY ev.stream""")
def frozen_history(spark, sf_dir):
    """The whole stream again, against the history that it left behind, now frozen."""
    s = streams(spark, sf_dir)
    held = history.snapshot(history.fifo_replay(s, CAPACITY))
    return history.frozen_hits(s, held).groupBy("stream").agg(F.count(F.when(F.col("hit"), 1)).alias("hits"), F.count(F.lit(1)).alias("n"))
