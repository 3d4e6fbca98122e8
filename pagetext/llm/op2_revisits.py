"""WARC revisits: each not-modified record is resolved to the latest earlier full response of the
same canonical URL; validators are checked and permitted headers merged."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagetext.llm import urls

#: Headers that a 304 answer may renew in the stored response.
PERMITTED = ["cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary"]
STORED = ["record_id", "etag", "last_modified", "headers", "digest"]


def resolve_revisits(records: DataFrame, *, bucket_seconds: int = 3600) -> DataFrame:
    """One row for each revisit of records(record_id, kind, url, ts, etag, last_modified, headers,
    digest); kind is response or revisit, ts in seconds, headers a map with lower-case names.

    The response taken has the greatest ts below the revisit's own, ties by the greatest record_id;
    a response at the same second is not earlier. Status: resolved, validator_mismatch (ETags
    differ, W/ aside; Last-Modified counts where an ETag is missing on either side), no_validator,
    no_earlier_response. Headers of resolved rows are the response's, renewed by the permitted
    ones of the revisit; else null. URLs without `://` and null times have no earlier response.

    A URL's timeline is cut into buckets: the last response of each bucket is map-side combined and
    carried forward over the buckets alone, and rows are ordered within a bucket only, so a URL
    with very many captures is spread over its buckets."""
    named = records.select(urls.canonical(F.col("url")).alias("canonical"), F.expr(f"ts div {bucket_seconds}").alias("bucket"), F.col("ts").cast("bigint").alias("ts"), (F.col("kind") == "response").alias("full"), *STORED)
    known = F.col("canonical").isNotNull() & F.col("ts").isNotNull() & F.col("full").isNotNull()
    timed = named.where(known)
    answer = F.when(F.col("full"), F.struct(*STORED))
    ends = timed.groupBy("canonical", "bucket").agg(F.max_by(answer, F.when(F.col("full"), F.struct("ts", "record_id"))).alias("latest"))
    carried = ends.select("canonical", "bucket", F.last("latest", ignorenulls=True).over(Window.partitionBy("canonical").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)).alias("carry")).where("carry IS NOT NULL")
    within = Window.partitionBy("canonical", "bucket").orderBy("ts", "full", "record_id").rowsBetween(Window.unboundedPreceding, 0)
    found = timed.withColumn("inside", F.last(answer, ignorenulls=True).over(within)).where("NOT full").join(carried, ["canonical", "bucket"], "left").withColumn("answer", F.coalesce("inside", "carry")).drop("inside", "carry", "bucket", "full")
    lost = named.where(~F.coalesce(known, F.lit(False)) & ~F.coalesce("full", F.lit(False))).drop("bucket", "full").withColumn("answer", F.lit(None).cast(found.schema["answer"].dataType))
    got = found.unionByName(lost)
    bare = lambda c: F.regexp_replace(c, "^W/", "")
    same = F.coalesce(bare(F.col("etag")) == bare(F.col("answer.etag")), F.col("last_modified") == F.col("answer.last_modified"))
    status = F.when(F.col("answer").isNull(), "no_earlier_response").when(same, "resolved").when(~same, "validator_mismatch").otherwise("no_validator")
    none = F.create_map().cast("map<string,string>")
    renewed = F.map_filter(F.coalesce("headers", none), lambda k, _: k.isin(PERMITTED))
    merged = F.map_concat(F.map_filter(F.coalesce("answer.headers", none), lambda k, _: ~F.array_contains(F.map_keys(renewed), k)), renewed)
    return got.withColumn("status", status).select("record_id", "canonical", "ts", "status", F.col("answer.record_id").alias("refers_to"), F.when(F.col("status") == "resolved", F.col("answer.digest")).alias("digest"), F.when(F.col("status") == "resolved", merged).alias("headers"))


def captures(pages: DataFrame) -> DataFrame:
    """A capture log derived from pages(page_id, url, html): six visits a page, a day apart. Visits
    1 and, for every third page, 3 are full responses; the others are revisits under another
    scheme, with matching, outdated or missing ETags and headers that may and may not be merged."""
    p, k = F.col("page_id"), F.col("k")
    visits = pages.select("page_id", "url", F.md5(F.coalesce("html", F.lit(""))).alias("md5"), F.explode(F.sequence(F.lit(0), F.lit(5))).alias("k"))
    full = (k == 1) | ((k == 3) & (p % 3 == 0))
    mark = lambda n: F.concat(F.lit('"'), F.substring("md5", 1, 12), F.lit(f'-{n}"'))
    etag = F.when(k == 3, mark(2)).when(k == 5, F.lit(None)).when((k == 2) & (p % 2 == 0), F.concat(F.lit("W/"), mark(1))).otherwise(mark(1))
    modified = F.when((k == 5) & (p % 7 == 0), F.lit(None)).when((k == 3) | ((k == 5) & (p % 3 == 0)), F.concat(F.lit("m2-"), F.substring("md5", 13, 6))).otherwise(F.concat(F.lit("m1-"), F.substring("md5", 13, 6)))
    day = lambda n: F.concat(F.lit("day "), (k + n).cast("string"))
    headers = F.when(full, F.create_map(F.lit("content-type"), F.lit("text/html"), F.lit("content-length"), F.length("md5").cast("string"), F.lit("cache-control"), F.lit("max-age=60"), F.lit("date"), day(0))).otherwise(F.create_map(F.lit("content-length"), F.lit("0"), F.lit("expires"), day(9), F.lit("date"), day(0)))
    url = F.when(full, F.col("url")).otherwise(F.regexp_replace("url", "^https?://", "http://www."))
    return visits.where((k > 0) | (p % 5 == 0)).where((k != 3) | (p % 3 == 0)).select((p * 10 + k).alias("record_id"), F.when(full, "response").otherwise("revisit").alias("kind"), url.alias("url"), (k * 86400 + p % 86400).cast("bigint").alias("ts"), etag.alias("etag"), modified.alias("last_modified"), headers.alias("headers"), F.when(full, F.concat(F.lit("md5:"), F.col("md5"))).alias("digest"))


def op2_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resolve_revisits(captures(spark.read.parquet(f"{sf_dir}/pages.parquet")))
    lines = F.array_join(F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))), "; ")
    return found.withColumn("headers", lines)


ORACLE = f"""WITH v AS (SELECT page_id AS p, url AS raw, md5(coalesce(html, '')) AS m, k FROM pages, (SELECT unnest(range(6)) AS k) WHERE (k > 0 OR page_id % 5 = 0) AND (k <> 3 OR page_id % 3 = 0)),
r AS (SELECT p * 10 + k AS record_id, k = 1 OR (k = 3 AND p % 3 = 0) AS answered,
  CASE WHEN k = 1 OR (k = 3 AND p % 3 = 0) THEN raw ELSE regexp_replace(raw, '^https?://', 'http://www.') END AS url, CAST(k * 86400 + p % 86400 AS BIGINT) AS ts,
  CASE WHEN k = 3 THEN '"' || substr(m, 1, 12) || '-2"' WHEN k = 5 THEN NULL ELSE '"' || substr(m, 1, 12) || '-1"' END AS etag,
  CASE WHEN k = 5 AND p % 7 = 0 THEN NULL WHEN k = 3 OR (k = 5 AND p % 3 = 0) THEN 'm2-' || substr(m, 13, 6) ELSE 'm1-' || substr(m, 13, 6) END AS lm,
  'md5:' || m AS digest, k FROM v),
c AS (SELECT *, {urls.SQL_CANONICAL} AS canonical FROM r),
f AS (SELECT b.record_id, b.canonical, b.ts, b.etag, b.lm, b.k, a.record_id AS refers_to, a.etag AS aetag, a.lm AS alm, a.digest AS adigest
  FROM (SELECT * FROM c WHERE NOT answered) b LEFT JOIN (SELECT * FROM c WHERE answered) a ON a.canonical = b.canonical AND a.ts < b.ts
  QUALIFY row_number() OVER (PARTITION BY b.record_id ORDER BY a.ts DESC NULLS LAST, a.record_id DESC) = 1),
s AS (SELECT *, CASE WHEN refers_to IS NULL THEN 'no_earlier_response' WHEN coalesce(etag = aetag, lm = alm) THEN 'resolved' WHEN NOT coalesce(etag = aetag, lm = alm) THEN 'validator_mismatch' ELSE 'no_validator' END AS status FROM f)
SELECT record_id, canonical, ts, status, refers_to, CASE WHEN status = 'resolved' THEN adigest END AS digest,
  CASE WHEN status = 'resolved' THEN 'cache-control: max-age=60; content-length: 32; content-type: text/html; date: day ' || k || '; expires: day ' || (k + 9) END AS headers FROM s"""
