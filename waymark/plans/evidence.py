"""Checks of manifests, archives, runs and tables against what they claim."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def is_hash(value: Column, size: int = 64) -> Column:
    """Lower-case hexadecimal of the given length."""
    return F.coalesce(value.rlike(f"^[0-9a-f]{{{size}}}$"), F.lit(False))


def is_safe_path(value: Column) -> Column:
    """Relative, without a climb, a backslash or a drive."""
    return F.coalesce(~value.startswith("/") & ~value.contains("\\") & ~value.rlike(r"(^|/)\.\.(/|$)") & ~value.rlike("^[^/]*:") & (F.length(value) > 0), F.lit(False))


def demand_none(violations: DataFrame, what: str) -> None:
    """Raise, naming the first violation, unless there is none."""
    if (row := violations.first()) is not None:
        raise ValueError(f"{what}: {row.asDict()}")


def manifest_violations(sources: DataFrame) -> DataFrame:
    """``(published_member, problem)`` of manifest rows ``(original_zip_sha256, published_member,
    sanitized_bytes, sanitized_sha256)``."""
    repeated = sources.groupBy("published_member").count().where("count > 1").select("published_member", F.lit("repeated").alias("problem"))
    problem = (
        F.when(~is_hash(F.col("original_zip_sha256")), "source digest")
        .when(~is_hash(F.col("sanitized_sha256")), "digest")
        .when(~is_safe_path(F.col("published_member")), "path")
        .when(F.coalesce(F.col("sanitized_bytes") <= 0, F.lit(True)), "size")
    )
    return sources.select("published_member", problem.alias("problem")).where("problem is not null").unionByName(repeated)


def archive_violations(sources: DataFrame, members: DataFrame) -> DataFrame:
    """``(member, problem)``: what the manifest and the archive don't agree on, in either direction."""
    claimed = sources.select(F.col("published_member").alias("member"), F.col("sanitized_bytes").alias("want_bytes"), F.col("sanitized_sha256").alias("want_sha"))
    both = claimed.join(members.select("member", "bytes", "sha256", F.col("problem").alias("bad")), "member", "full_outer")
    problem = (
        F.when(F.col("bad").isNotNull(), F.col("bad"))
        .when(F.col("bytes").isNull(), "missing member")
        .when(F.col("want_sha").isNull(), "unlisted member")
        .when(F.col("bytes") != F.col("want_bytes"), "length")
        .when(F.col("sha256") != F.col("want_sha"), "digest")
    )
    return both.select("member", problem.alias("problem")).where("problem is not null")


def baseline_violations(frozen: DataFrame, run: DataFrame, recall: float = 0.02, reads: float = 0.1) -> DataFrame:
    """Widths at which a new baseline is not the frozen one, within limits, or is missing."""
    b = frozen.select("width", F.col("recall").alias("want_recall"), F.col("mean_ios").alias("want_ios"))
    both = b.join(run.select("width", "recall", "mean_ios"), "width", "full_outer")
    same = (F.abs(F.col("recall") - F.col("want_recall")) <= recall) & (F.abs(F.col("mean_ios") - F.col("want_ios")) <= reads)
    return both.where(~F.coalesce(same, F.lit(False)))


def cell_violations(actual: DataFrame, expected: DataFrame, limit: float = 1.1e-4) -> DataFrame:
    """``(file, row, column, actual, expected)`` cells of two tables in long form that differ: numbers
    by more than ``limit`` (NaN equals NaN), other text at all, and cells that one side lacks. An empty
    expected side is an error: it proves nothing."""
    if expected.limit(1).count() == 0:
        raise ValueError("no reference cells")
    both = actual.select("file", "row", "column", F.col("value").alias("actual")).join(expected.select("file", "row", "column", F.col("value").alias("expected")), ["file", "row", "column"], "full_outer")
    a, b = F.expr("try_cast(actual AS double)"), F.expr("try_cast(expected AS double)")
    same = (F.col("actual") == F.col("expected")) | (F.isnan(a) & F.isnan(b)) | (F.abs(a - b) <= limit)
    return both.where(~F.coalesce(same, F.lit(False)))


def cells(df: DataFrame, file: str, row: str) -> DataFrame:
    """A table in long form ``(file, row, column, value)``."""
    names = [c for c in df.columns if c != row]
    pairs = F.explode(F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*[F.col(c).cast("string") for c in names]))).alias("column", "value")
    return df.select(F.lit(file).alias("file"), F.col(row).cast("long").alias("row"), pairs)


def cache_run_violations(rows: DataFrame) -> DataFrame:
    """Cached runs must show hits and no more reads than hops."""
    return rows.where((F.col("cache_hit_percentage") <= 0) | (F.col("mean_ios") > F.col("mean_hops") + 1e-9))


def selection_violations(selection: DataFrame, budget: int, points: int) -> DataFrame:
    """``(id, problem)`` of a ranked selection: ranks 1..budget, unique ids below the number of points."""
    odd = selection.select("id", F.when((F.col("id") < 0) | (F.col("id") >= points), "range").when((F.col("rank") < 1) | (F.col("rank") > budget), "rank").alias("problem")).where("problem is not null")
    twice = selection.groupBy("id").count().where("count > 1").select("id", F.lit("repeated").alias("problem"))
    return odd.unionByName(twice)
