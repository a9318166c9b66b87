"""Text sources and sinks: traces, counters, results, archives, digests, tables."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waymark.operators.junctions import check_contiguous
from waymark.session import ship

from .binary import atomic

TRACE = "query long, result_id long, io_count int, ids array<long>"
#: Fixed value: the result id of a traced query that found nothing.
NO_RESULT = 4294967295
CATALOGUE = "product_sku_hash string, description_vector string"
SEARCHES = "session_id_hash string, query_vector string, server_timestamp_epoch_ms long, product_skus_hash string, clicked_skus_hash string"
DIAGNOSTICS = "query long, L int, ios double, total_us double, cpu_us double, cache_hits double"
METRICS = ("search_l", "recall", "mean_ios", "mean_latency", "qps", "mean_cpu_time", "mean_comparisons", "mean_hops", "cache_hit_percentage")


def read_traces(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of traversal traces; a malformed line or a gap in the queries is an error."""
    return check_contiguous(spark.read.schema(TRACE).option("mode", "FAILFAST").json(path))


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("error").json(path)


def write_tsv(df: DataFrame, path: str) -> None:
    """An id map or another flat table, tab-separated with a header."""
    df.write.mode("error").option("header", True).option("sep", "\t").csv(path)


def write_diagnostics(df: DataFrame, path: str) -> None:
    """Per-query rows of every width as CSV, one folder for each width."""
    df.write.mode("error").option("header", True).partitionBy("L").csv(path)


def only_file(folder: str, ending: str) -> str:
    """The one file of a folder whose name ends so; none or several is an error."""
    from pyarrow import fs

    from .binary import opened

    store, at = opened(folder)
    found = [f.path for f in store.get_file_info(fs.FileSelector(at)) if f.path.endswith(ending)]
    if len(found) != 1:
        raise ValueError(f"{folder}: {len(found)} files end with {ending}")
    return found[0]


def read_csv(spark: SparkSession, path: str, schema: str, row: str | None = None) -> DataFrame:
    """A CSV file with exactly these leading columns; ``row`` adds a number that rises with the
    place in the file (not dense)."""
    want = [f.name for f in T._parse_datatype_string(schema).fields]
    have = spark.read.option("header", True).csv(path).columns
    if missing := [c for c in want if c not in have]:
        raise ValueError(f"{path}: no column {', '.join(missing)}")
    # Every column is declared, and the header is enforced: columns are matched by name.
    full = T.StructType([T.StructField(c, T.StringType()) for c in have])
    raw = spark.read.schema(full).option("header", True).option("mode", "FAILFAST").option("multiLine", True).option("escape", '"').csv(path)
    typed = raw.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in T._parse_datatype_string(schema).fields])
    return typed.withColumn(row, F.monotonically_increasing_id()) if row else typed


def check_diagnostics(df: DataFrame, queries: int) -> DataFrame:
    """Per-query rows, if every width has queries 0..n-1 once and nothing is negative."""
    numeric = [c for c, t in df.dtypes if t in ("int", "bigint", "double", "float")]
    low = F.least(*[F.col(c).cast("double") for c in numeric])
    bad = df.groupBy("L").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("query").alias("d"), F.min("query").alias("a"), F.max("query").alias("b"), F.min(low).alias("low"))
    row = bad.where((F.col("n") != queries) | (F.col("d") != queries) | (F.col("a") != 0) | (F.col("b") != queries - 1) | (F.col("low") < 0)).first()
    if row is not None:
        raise ValueError(f"width {row['L']}: {row['n']} rows, queries {row['a']} to {row['b']}, least value {row['low']}")
    return df


def parse_counters(lines: DataFrame, column: str = "value", mark: str = "EXPERIENCE_STATS") -> DataFrame:
    """``(L, counters map<string,bigint>)`` from lines of ``mark k=v k=v``; other lines are skipped."""
    tail = F.regexp_extract(column, f"{mark} (.*)$", 1)
    text = F.str_to_map(F.trim(tail), F.lit(" "), F.lit("="))
    numbers = F.transform_values(text, lambda k, v: v.cast("bigint"))
    return lines.where(F.col(column).contains(mark)).select(F.element_at(numbers, "L").cast("int").alias("L"), numbers.alias("counters"))


def check_grid(counters: DataFrame, widths: list[int]) -> DataFrame:
    """The counters, if each width of the grid occurs exactly once."""
    got = sorted(r[0] for r in counters.select("L").limit(len(widths) + 1).collect())
    if got != sorted(widths):
        raise ValueError(f"widths {got}, not {sorted(widths)}")
    return counters


def result_rows(documents: DataFrame, column: str = "value") -> DataFrame:
    """Every object, at any depth of JSON documents, that has a search width and a mean latency."""
    ship(documents.sparkSession)

    def found(x) -> Iterator[dict]:
        if isinstance(x, dict):
            if "search_l" in x and "mean_latency" in x:
                yield x
            else:
                for v in x.values():
                    yield from found(v)
        elif isinstance(x, list):
            for v in x:
                yield from found(v)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import json

        schema = pa.schema([("search_l", pa.int32()), *((m, pa.float64()) for m in METRICS[1:])])
        for batch in batches:
            rows = [{m: None if r.get(m) is None else (int if m == "search_l" else float)(r[m]) for m in METRICS} for text in batch.column(0).to_pylist() if text for r in found(json.loads(text))]
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return documents.select(column).mapInArrow(run, "search_l int, " + ", ".join(f"{m} double" for m in METRICS[1:]))


def binary_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path)


def digests(spark: SparkSession, path: str) -> DataFrame:
    """``(path, bytes, sha256)`` of files."""
    return binary_files(spark, path).select("path", F.length("content").cast("long").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def zip_members(spark: SparkSession, path: str, most: int = 12 << 20) -> DataFrame:
    """``(archive, member, bytes, sha256, content, problem)`` of ZIP files.

    A member that is absolute, climbs out, occurs twice, is over ``most`` bytes or fails its checksum
    has its ``problem`` named, and no content.
    """
    import hashlib

    ship(spark)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for archive, content in zip(part["path"], part["content"], strict=True):
                rows, seen = [], set()
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for info in z.infolist():
                        if info.is_dir():
                            continue
                        name, problem, raw = info.filename, None, None
                        if name.startswith("/") or "\\" in name or ".." in name.split("/") or ":" in name.split("/")[0]:
                            problem = "unsafe path"
                        elif name in seen:
                            problem = "duplicate"
                        elif info.file_size > most:
                            problem = "too large"
                        else:
                            try:
                                raw = z.read(info)
                            except zipfile.BadZipFile:
                                problem = "checksum"
                        seen.add(name)
                        rows.append((archive, name, info.file_size, None if raw is None else hashlib.sha256(raw).hexdigest(), raw, problem))
                yield pd.DataFrame(rows, columns=["archive", "member", "bytes", "sha256", "content", "problem"])

    return binary_files(spark, path).select("path", "content").mapInPandas(run, "archive string, member string, bytes long, sha256 string, content binary, problem string")


def one_member(members: DataFrame, suffix: str) -> bytes:
    """The content of the only member whose name ends so; none or several is an error."""
    rows = members.where(F.col("member").endswith(suffix)).select("content", "problem").limit(2).collect()
    if len(rows) != 1 or rows[0][1]:
        raise ValueError(f"{len(rows)} members end with {suffix}" if not rows or not rows[0][1] else rows[0][1])
    return bytes(rows[0][0])


def write_table(df: DataFrame, path: str, columns: list[str], most: int = 100_000) -> None:
    """A small report as one CSV file with fixed columns and plain line ends, atomically."""
    rows = df.select(*columns).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"over {most} rows in a report")
    with atomic(path) as out:
        out.write(pd.DataFrame(rows, columns=columns).to_csv(index=False, lineterminator="\n", na_rep="nan").encode())


def markdown(rows: list[dict], columns: list[str]) -> str:
    lines = ["| " + " | ".join(columns) + " |", "|" + "---|" * len(columns)]
    return "\n".join(lines + ["| " + " | ".join("–" if r.get(c) is None else str(r[c]) for c in columns) + " |" for r in rows]) + "\n"


def latex(rows: list[dict], columns: list[str]) -> str:
    cell = lambda v: "--" if v is None else str(v).replace("\\", "\\textbackslash ").replace("%", "\\%").replace("_", "\\_").replace("&", "\\&")
    body = [" & ".join(cell(r.get(c)) for c in columns) + r" \\" for r in rows]
    return "\n".join([r"\begin{tabular}{" + "l" * len(columns) + "}", " & ".join(map(cell, columns)) + r" \\", r"\hline", *body, r"\end{tabular}"]) + "\n"
