"""Queries that apply the checks and predicates of the evidence layer to the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from waymark.plans import evidence

from . import query, table


@query(r"""SELECT page_id, sha256(url) AS sha256, regexp_matches(sha256(url), '^[0-9a-f]{64}$') AS hash_ok,
NOT starts_with(p, '/') AND NOT contains(p, '\') AND NOT regexp_matches(p, '(^|/)\.\.(/|$)') AND NOT regexp_matches(p, '^[^/]*:') AND len(p) > 0 AS path_ok
FROM (SELECT page_id, url, CASE WHEN page_id % 3 = 0 THEN '../' || page_id WHEN page_id % 3 = 1 THEN 'results/' || page_id ELSE url END AS p FROM pages)""")
def member_predicates(spark, sf_dir):
    p = table(spark, sf_dir, "pages").withColumn("p", F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("../"), "page_id")).when(F.col("page_id") % 3 == 1, F.concat(F.lit("results/"), "page_id")).otherwise(F.col("url")))
    digest = F.sha2(F.encode("url", "UTF-8"), 256)
    return p.select("page_id", digest.alias("sha256"), evidence.is_hash(digest).alias("hash_ok"), evidence.is_safe_path(F.col("p")).alias("path_ok"))


@query("""WITH s AS (SELECT page_id, 'm/' || page_id AS member, strlen(html) AS want, sha256(html) AS want_sha FROM pages WHERE url NOT LIKE '%.org/%'),
m AS (SELECT 'm/' || page_id AS member, strlen(html) + CASE WHEN page_id % 11 = 0 THEN 1 ELSE 0 END AS bytes, sha256(CASE WHEN page_id % 13 = 0 THEN html || 'x' ELSE html END) AS sha FROM pages WHERE url NOT LIKE 'https://m.%')
SELECT coalesce(s.member, m.member) AS member, CASE WHEN m.member IS NULL THEN 'missing member' WHEN s.member IS NULL THEN 'unlisted member' WHEN bytes <> want THEN 'length' WHEN sha <> want_sha THEN 'digest' END AS problem
FROM s FULL JOIN m ON s.member = m.member WHERE m.member IS NULL OR s.member IS NULL OR bytes <> want OR sha <> want_sha""")
def archive_violations(spark, sf_dir):
    """A manifest and an archive that differ in rows, lengths and digests, in known ways."""
    p = table(spark, sf_dir, "pages").select("page_id", "url", F.concat(F.lit("m/"), "page_id").alias("member"), F.encode("html", "UTF-8").alias("raw"))
    sources = p.where("url NOT LIKE '%.org/%'").select(F.col("member").alias("published_member"), F.length("raw").alias("sanitized_bytes"), F.sha2("raw", 256).alias("sanitized_sha256"))
    odd = F.when(F.col("page_id") % 13 == 0, F.concat("raw", F.encode(F.lit("x"), "UTF-8"))).otherwise(F.col("raw"))
    members = p.where("url NOT LIKE 'https://m.%'").select("member", (F.length("raw") + F.when(F.col("page_id") % 11 == 0, 1).otherwise(0)).alias("bytes"), F.sha2(odd, 256).alias("sha256"), F.lit(None).cast("string").alias("problem"))
    return evidence.archive_violations(sources, members)


@query("""WITH a AS (SELECT CAST(l_linenumber AS INTEGER) AS width, avg(l_quantity) AS recall, avg(l_tax) AS ios FROM lineitem GROUP BY 1), b AS (SELECT CAST(l_linenumber AS INTEGER) AS width, avg(l_quantity) AS recall, avg(l_tax) AS ios FROM lineitem WHERE l_returnflag = 'N' GROUP BY 1)
SELECT a.width FROM a JOIN b ON a.width = b.width WHERE abs(a.recall - b.recall) > 0.1 OR abs(a.ios - b.ios) > 0.1""")
def baseline_violations(spark, sf_dir):
    """Groups of a filtered run that leave the frozen run's limits."""
    l = table(spark, sf_dir, "lineitem").withColumn("width", F.col("l_linenumber").cast("int"))
    curve = lambda x: x.groupBy("width").agg(F.avg("l_quantity").alias("recall"), F.avg("l_tax").alias("mean_ios"))
    return evidence.baseline_violations(curve(l), curve(l.where("l_returnflag = 'N'")), 0.1, 0.1).select("width")
