"""URL filter: a blocked Bloom filter of listed canonical URLs passes possible hits on to an exact
hash join. Column functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagetext.llm import urls
from pagetext.llm._store import stored

WORDS = 8  # a block is 8 words of 64 bits; a key sets one bit in each
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
#: Pages that mention one of these words are put on the list by the registered query.
#: Pages that mention one of these make up the list of the registered query: a fixture, not a part of the filter.
LISTING_TERMS = ["idiot", "moron", "worthless"]


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


def _bit(key: Column, i: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64(key, F.lit(17)), 6 * i).bitwiseAND(F.lit(63)).cast("int")


def blocked_bloom(keys: DataFrame, key: str, blocks: int) -> DataFrame:
    """(block, w0..w7): one row for each block that holds a key. Partial sums by bit_or, so the
    shuffle carries at most one row for each block and task."""
    one = F.lit(1).cast("bigint")
    sums = [F.bit_or(F.call_function("shiftleft", one, _bit(F.col(key), i))).alias(f"w{i}") for i in range(WORDS)]
    return keys.groupBy(_block(F.col(key), blocks).alias("block")).agg(*sums)


def in_block(key: Column, blocks: int) -> Column:
    """The block that a key's bits are in."""
    return _block(key, blocks)


def maybe_in(key: Column) -> Column:
    """Whether a row that has met its key's block of a blocked_bloom has all of the key's bits."""
    all_set = F.lit(True)
    for i in range(WORDS):
        all_set &= F.call_function("shiftright", F.col(f"w{i}"), _bit(key, i)).bitwiseAND(F.lit(1)) == 1
    return F.coalesce(all_set & key.isNotNull(), F.lit(False))


def listed_flag(pages: DataFrame, listed: DataFrame, *, bits_per_key: int = 12, broadcast_bytes: int = 32 << 20, salts: int = 8) -> DataFrame:
    """`pages` plus `listed`: whether the row's canonical URL is one of `listed.canonical`.

    pages needs a column `canonical`; other columns may have any names, and an own column `listed`
    gives way. Null canonical URLs are not listed; repeated rows stay; an empty list gives false
    everywhere.
    The filter takes bits_per_key bits for each distinct listed URL: it is broadcast only while
    that is at most broadcast_bytes, and joined by block beyond. Possible hits alone are shuffled
    to the exact join; each listed URL is copied `salts` times there, so that a URL with very many
    pages is met in several tasks. Misses never move.
    """
    keys = stored(listed.select("canonical").where("canonical IS NOT NULL").distinct())
    n = keys.count()
    blocks = max(1, -(-n * bits_per_key // (64 * WORDS)))
    bloom = blocked_bloom(keys, "canonical", blocks)
    if blocks * (WORDS + 1) * 8 <= broadcast_bytes:
        bloom = F.broadcast(bloom)
    names = [c for c in pages.columns if c != "listed"]
    page = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)]).alias("page")
    seen = pages.select(page, "canonical").withColumn("block", _block(F.col("canonical"), blocks)).join(bloom, "block", "left")
    maybe = maybe_in(F.col("canonical"))
    misses = seen.where(~maybe).select("page", F.lit(False).alias("listed"))
    copies = keys.select("canonical", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), F.lit(True).alias("listed"))
    hits = seen.where(maybe).select("page", "canonical", F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int").alias("salt"))
    exact = hits.join(copies.hint("shuffle_hash"), ["canonical", "salt"], "left").select("page", F.coalesce("listed", F.lit(False)).alias("listed"))
    return misses.union(exact).select(*[F.col(f"page.c{i}").alias(c) for i, c in enumerate(names)], "listed")


def url_filter(pages: DataFrame, listed: DataFrame, rules: list[tuple[str, str, str]], **how) -> DataFrame:
    """(page_id, host, path, rule, verdict, listed) for every row of pages(page_id, url).

    The verdict is the longest fitting rule's; else block for listed canonical URLs and allow for
    others. Null URLs and those without `://` have an empty host and path, no rule, and pass."""
    url = F.col("url")
    parts = pages.select("page_id", urls.host(url).alias("host"), urls.path(url).alias("path"), urls.canonical(url).alias("canonical"))
    flagged = listed_flag(parts, listed, **how)
    rule, verdict = urls.longest_rule(F.col("host"), F.col("path"), rules)
    return flagged.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"), "listed")


def listing(pages: DataFrame) -> DataFrame:
    """Canonical URLs of the pages that mention a listing term."""
    found = F.lit(False)
    for term in LISTING_TERMS:
        found |= F.coalesce(F.contains(F.col("html"), F.lit(term)), F.lit(False))
    return pages.where(found).select(urls.canonical(F.col("url")).alias("canonical"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return url_filter(pages, listing(pages), RULES)


def _sql() -> str:
    rule = verdict = "CASE"
    for h, p, v in sorted(RULES, key=lambda r: -len(r[0] + r[1])):
        fits = f" WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN "
        rule, verdict = rule + fits + f"'{h}{p}'", verdict + fits + f"'{v}'"
    terms = " OR ".join(f"contains(html, '{t}')" for t in LISTING_TERMS)
    return f"""WITH p AS (SELECT page_id, html, {urls.SQL_HOST} AS host, {urls.SQL_PATH} AS path, {urls.SQL_CANONICAL} AS canonical FROM pages),
l AS (SELECT DISTINCT canonical FROM p WHERE ({terms}) AND canonical IS NOT NULL)
SELECT page_id, host, path, {rule} END AS rule,
  coalesce({verdict} END, CASE WHEN l.canonical IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict, l.canonical IS NOT NULL AS listed
FROM p LEFT JOIN l ON p.canonical = l.canonical"""


ORACLE = _sql()
