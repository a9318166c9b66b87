"""Proximity graphs and bounded best-first search with learned and recent entries.

The graph, the vectors and the directory that a search walks are one bounded index (``MOST_BYTES``
is checked); parallelism is over (method, repetition, width) streams, and over queries where no
history couples them. A stream's queries pass through a generator in order, so that each sees only
destinations of queries that have completed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waymark.session import ship

from .history import Exits, Lru, UniqueFifo
from .knn import matrix, nearest

MOST_BYTES = 1 << 30
RESULT = "stream string, query long, ids array<long>, reads int, uncached_reads int, page_reads int, comparisons int, hops int, starts array<long>, trace array<long>"


@dataclass(frozen=True)
class Routing:
    """Entry policy: medoid, junction directory, recents; and what is kept after each query."""

    junctions: bool = False
    nprobe: int = 8
    recents: int = 0
    capacity: int = 2048
    policy: str = "fifo"
    exits: int = 0
    every: int = 2
    given: dict[int, list[int]] = field(default_factory=dict)


@dataclass(frozen=True)
class Walk:
    """Search parameters; the frontier holds ``width`` entries however many starts are offered."""

    width: int = 40
    beam: int = 8
    k: int = 10
    metric: str = "ip"
    nodes_per_page: int = 1
    cached: frozenset = frozenset()


@dataclass
class Index:
    """Vectors by row, their ids, adjacency by row, the medoid's row, and the directory by cell."""

    ids: np.ndarray
    vecs: np.ndarray
    near: list[np.ndarray]
    medoid: int
    medoids: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    cells: list[np.ndarray] = field(default_factory=list)

    def distances(self, q: np.ndarray, rows, metric: str) -> np.ndarray:
        x = self.vecs[rows]
        return -(x @ q) if metric == "ip" else ((x - q) ** 2).sum(axis=1)


def knn_graph(points: DataFrame, degree: int, metric: str = "ip", cap: int | None = None) -> DataFrame:
    """``(id, nbrs)``: each point's nearest ones and those whose nearest it is, the nearest
    ``cap`` of them (default: twice the degree)."""
    cap = cap or 2 * degree
    out = nearest(points, points, degree, metric).select(F.col("query").alias("id"), F.col("id").alias("nbr"), F.col("score").alias("s"))
    both = out.unionByName(out.select(F.col("nbr").alias("id"), F.col("id").alias("nbr"), "s")).distinct()
    order = F.desc("s") if metric == "ip" else F.asc("s")
    kept = both.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy(order, "nbr"))).where(F.col("rank") <= cap)
    return kept.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "nbr"))), lambda s: s["nbr"]).alias("nbrs"))


def medoid(points: DataFrame) -> int:
    """The point nearest to the mean vector, ties by id."""
    from waymark.functions import vec

    mean = points.select(F.posexplode("vec").alias("pos", "x")).groupBy("pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    centre = [r[1] for r in sorted(mean.collect())]
    away = vec.l2sq(F.col("vec"), F.array(*map(F.lit, centre)))
    return points.select("id", away.alias("d")).agg(F.min_by("id", F.struct("d", "id"))).first()[0]


def load(points: DataFrame, graph: DataFrame, entry: int, directory: DataFrame | None = None, most_bytes: int = MOST_BYTES) -> Index:
    """The index as arrays, if it is within ``most_bytes``. ``directory(cell, id, is_medoid, pos)``."""
    n, dim = points.agg(F.count(F.lit(1)), F.max(F.size("vec"))).first()
    if n * (dim or 1) * 8 > most_bytes:
        raise ValueError(f"an index of {n} x {dim} is over {most_bytes} bytes: split it into shards")
    held = points.select(F.col("id").cast("long"), "vec").orderBy("id").toArrow()
    ids, vecs = held.column(0).to_numpy(), matrix(held.column(1))
    rows = {int(i): k for k, i in enumerate(ids)}
    near = [np.zeros(0, np.int64)] * len(ids)
    for r in graph.collect():
        near[rows[r["id"]]] = np.array([rows[x] for x in r["nbrs"] if x in rows], np.int64)
    index = Index(ids, vecs, near, rows[entry])
    if directory is not None:
        cells: dict[int, list] = {}
        for r in directory.collect():
            cells.setdefault(r["cell"], []).append((not r["is_medoid"], r["pos"], rows[r["id"]]))
        members = [np.array([x[2] for x in sorted(cells[c])], np.int64) for c in sorted(cells)]
        index = replace(index, cells=members, medoids=np.array([m[0] for m in members], np.int64))
        if len(np.unique(np.concatenate(members))) != sum(map(len, members)):
            raise ValueError("an id that occurs twice in the directory")
    return index


def route(index: Index, q: np.ndarray, routing: Routing, walk: Walk, history: list[int], given: list[int] | None) -> tuple[list[int], int | None, list[int], int]:
    """(starts, junction, ranked recents, comparisons) as rows of the index."""
    compared, hub, starts = 0, None, []
    if routing.junctions and len(index.medoids):
        d = index.distances(q, index.medoids, walk.metric)
        cells = np.lexsort((np.arange(len(d)), d))[: routing.nprobe]
        rows = np.concatenate([index.cells[c] for c in cells])
        fine = index.distances(q, rows, walk.metric)
        hub = int(rows[np.lexsort((index.ids[rows], fine))[0]])
        compared += len(d) + len(rows)
        starts.append(hub)
    ranked: list[int] = []
    if routing.recents and history:
        rows = np.array(history, np.int64)
        d = index.distances(q, rows, walk.metric)
        ranked = rows[np.lexsort((index.ids[rows], d))[:10]].tolist()
        compared += len(rows)
        starts += [r for r in ranked[: min(routing.recents, 10)] if r != hub]
    if not starts:
        starts = list(dict.fromkeys(given)) if given else [index.medoid]
    return starts, hub, ranked, compared - len(starts)


def beam_search(index: Index, q: np.ndarray, starts: list[int], walk: Walk, offer=None) -> tuple[list[int], dict]:
    """Best-first search: (rows of the k best expanded or met, by exact distance then id), counters.

    ``offer(row)`` gives rows to admit when ``row`` is first expanded: one is admitted, and only
    then counts as seen, if there is room or it is no farther than the worst.
    """
    seen = set(starts)
    d = index.distances(q, np.array(starts, np.int64), walk.metric)
    frontier = sorted(zip(d.tolist(), index.ids[starts].tolist(), starts, strict=True))[: walk.width]
    expanded: set[int] = set()
    trace: list[int] = []
    compared = len(starts)
    while True:
        todo = [r for _, _, r in frontier if r not in expanded][: walk.beam]
        if not todo:
            break
        for r in todo:
            expanded.add(r)
            trace.append(r)
            more = offer(r) if offer else []
            if more:
                rows = np.array([x for x in more if x not in seen], np.int64)
                if len(rows):
                    compared += len(rows)
                    for x in sorted(zip(index.distances(q, rows, walk.metric).tolist(), index.ids[rows].tolist(), rows.tolist(), strict=True)):
                        if len(frontier) < walk.width or frontier[-1][0] >= x[0]:
                            seen.add(x[2])
                            frontier = sorted([*frontier, x])[: walk.width]
        fresh = [x for r in todo for x in index.near[r].tolist() if x not in seen and not seen.add(x)]
        if fresh:
            rows = np.array(fresh, np.int64)
            compared += len(rows)
            frontier = sorted(frontier + list(zip(index.distances(q, rows, walk.metric).tolist(), index.ids[rows].tolist(), fresh, strict=True)))[: walk.width]
    pages = {int(index.ids[r]) // walk.nodes_per_page for r in trace}
    return [r for _, _, r in frontier if r in expanded][: walk.k], {
        "reads": len(trace),
        "uncached_reads": sum(int(index.ids[r]) not in walk.cached for r in trace),
        "page_reads": len(pages),
        "comparisons": compared,
        "hops": len(trace),
        "trace": trace,
    }


class Replay:
    """One stream's state: history and exits, empty at its start."""

    def __init__(self, index: Index, routing: Routing, walk: Walk):
        self.index, self.routing, self.walk = index, routing, walk
        self.history = {"fifo": UniqueFifo, "lru": Lru}[routing.policy](routing.capacity)
        self.exits = Exits(routing.exits, routing.every) if routing.exits else None

    def query(self, number: int, q: np.ndarray) -> tuple:
        index, routing, walk = self.index, self.routing, self.walk
        starts, hub, ranked, compared = route(index, q, routing, walk, self.history.ids() if routing.recents else [], routing.given.get(number))
        offer = None
        if self.exits is not None and hub is not None:
            offer = lambda r: self.exits.pages.get(hub, []) if r == hub else []
        found, counts = beam_search(index, q, starts, walk, offer)
        # After completion only: the state never holds the running query's own result.
        if found:
            self.history.push(found[0])
            if self.exits is not None and hub is not None:
                self.exits.push(hub, found[0], number, ranked)
        ids = index.ids
        return ids[found].tolist(), counts["reads"], counts["uncached_reads"], counts["page_reads"], counts["comparisons"] + compared, counts["hops"], ids[starts].tolist(), ids[counts["trace"]].tolist()


def replay(queries: DataFrame, index: Index, streams: dict[str, tuple[Routing, Walk]], exclude_self: bool = True) -> DataFrame:
    """``RESULT`` rows of every query ``(query, vec)`` in every stream, each in query order.

    Streams run side by side; state is a stream's own and starts empty in each.
    """
    spark = ship(queries.sparkSession)
    sent = spark.sparkContext.broadcast((index, streams))
    named = spark.createDataFrame([(s,) for s in sorted(streams)], "stream string")
    rows = queries.select("query", "vec").join(F.broadcast(named), F.lit(True))
    parts = max(1, len(streams))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now, last = None, None, None
        arrow = pa.schema([("stream", pa.string()), ("query", pa.int64()), ("ids", pa.list_(pa.int64())), *((n, pa.int32()) for n in ("reads", "uncached_reads", "page_reads", "comparisons", "hops")), ("starts", pa.list_(pa.int64())), ("trace", pa.list_(pa.int64()))])
        idx, configs = sent.value
        for batch in batches:
            out = []
            vecs = matrix(batch.column(2)) if batch.num_rows else None
            for k, (stream, number) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                if stream != now or held is None:
                    now, held, last = stream, Replay(idx, *configs[stream]), None
                if last is not None and number <= last:
                    raise ValueError(f"stream {stream}: query {number} after {last}")
                last = number
                out.append(dict(zip(arrow.names, (stream, number, *held.query(number, vecs[k])), strict=True)))
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return rows.select("stream", "query", "vec").repartition(parts, "stream").sortWithinPartitions("stream", "query").mapInArrow(run, RESULT)


def summary(results: DataFrame, truth: DataFrame | None, k: int, warmup: int = 0) -> DataFrame:
    """Per stream over the measured suffix: recall, mean reads, comparisons and hops.

    Without a ground truth (a throughput run) the recall is null.
    """
    late = results.where(F.col("query") >= warmup)
    if truth is None:
        joined = late.withColumn("hit", F.lit(None).cast("double"))
    else:
        want = truth.where(F.col("rank") <= k).groupBy("query").agg(F.collect_set("id").alias("want"))
        joined = late.join(want, "query").withColumn("hit", F.size(F.array_intersect(F.slice("ids", 1, k), "want")) * 100.0 / k)
    return joined.groupBy("stream").agg(F.avg("hit").alias("recall"), F.avg("reads").alias("mean_ios"), F.avg("uncached_reads").alias("mean_uncached"), F.avg("page_reads").alias("mean_pages"), F.avg("comparisons").alias("mean_comparisons"), F.avg("hops").alias("mean_hops"), F.count(F.lit(1)).alias("queries"))


def bfs_cache(graph: DataFrame, entry: int, size: int) -> list[int]:
    """The first ``size`` ids of a breadth-first walk from the entry, level by level and by id.

    Each level is a join of the frontier with the graph; at most ``size`` ids are ever held.
    """
    spark = graph.sparkSession
    found, frontier = [entry], [entry]
    edges = graph.select("id", F.explode("nbrs").alias("nbr"))
    while frontier and len(found) < size:
        front = spark.createDataFrame([(i,) for i in frontier], "id long")
        seen = spark.createDataFrame([(i,) for i in found], "nbr long")
        fresh = edges.join(F.broadcast(front), "id").select("nbr").distinct().join(F.broadcast(seen), "nbr", "left_anti").orderBy("nbr").limit(size - len(found))
        frontier = [r[0] for r in fresh.collect()]
        found += frontier
    return found
