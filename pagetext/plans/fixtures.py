"""Inputs of the registered queries, derived from the given tables; Spark and DuckDB both read these."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents pages conversations".split()

_ROWS = """WITH r AS (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey,
    l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate, l_returnflag, l_linestatus) AS rn
  FROM lineitem),
g AS (
  SELECT CAST(floor(l_orderkey / 32) AS BIGINT) AS page_id, CAST(l_orderkey % 32 AS INT) AS y, rn,
    l_partkey AS p, l_suppkey AS s, l_orderkey % 4 = 0 AS bridge, l_orderkey % 13 IN (5, 6) AS long_run
  FROM r)"""

SQL = {
    "f1_fragments": """WITH r AS (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey,
    l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate, l_returnflag, l_linestatus) AS rn
  FROM lineitem),
g AS (
  SELECT CAST(floor(l_orderkey / 4) AS BIGINT) AS page_id, (l_orderkey % 4) * 100 + rn AS frag_id,
    60 + (l_orderkey % 4) * 210 + (l_partkey * 7 + rn * 13) % 60 AS x1,
    60 + (l_orderkey % 3) * 400 + (rn - 1) * 44 + (l_suppkey * 5) % 26 AS y1,
    60 + (l_partkey * 11) % 120 AS w, 16 + l_partkey % 23 AS h, l_partkey, rn,
    (l_partkey * 37 + l_suppkey * 101 + rn * 59) % 1000 AS conf_milli
  FROM r)
SELECT page_id, frag_id, CAST(x1 AS DOUBLE) AS x1, CAST(y1 AS DOUBLE) AS y1,
  CAST(x1 + w AS DOUBLE) AS x2, CAST(y1 + h AS DOUBLE) AS y2,
  CASE WHEN l_partkey % 29 = 0 THEN 'A'
       ELSE upper(p_name) || CASE WHEN l_partkey % 11 = 0 THEN '-' ELSE '' END END AS text,
  CAST(conf_milli AS DOUBLE) / 1000 AS conf, 960 AS img_w,
  CASE WHEN page_id % 7 = 0 THEN 2000 ELSE 1500 END AS img_h,
  CASE page_id % 4 WHEN 0 THEN 'vi' WHEN 1 THEN 'ko' WHEN 2 THEN 'pt' ELSE 'es' END AS lang
FROM g JOIN part ON p_partkey = l_partkey""",
    "f2_borders": """WITH p AS (SELECT DISTINCT CAST(floor(o_orderkey / 4) AS BIGINT) AS page_id FROM orders)
SELECT page_id, 'h' AS axis, 150 + page_id % 40 AS pos FROM p WHERE page_id % 2 = 0
UNION ALL
SELECT page_id, 'v' AS axis, 262 + page_id % 20 AS pos FROM p WHERE page_id % 3 = 0""",
    "f3_two_outputs": """WITH r AS (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey,
    l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate, l_returnflag, l_linestatus) AS rn
  FROM lineitem),
g AS (
  SELECT CAST(floor(l_orderkey / 4) AS BIGINT) AS page_id, (l_orderkey % 4) * 100 + rn AS item_id,
    5 + (l_orderkey % 4) * 22 + l_partkey % 17 AS cx, 5 + (l_partkey * 3 + rn * 11) % 90 AS cy,
    p_name || ' ' || p_type || ' ' || p_brand AS t, l_partkey,
    CASE WHEN l_partkey % 7 = 0 THEN NULL WHEN l_partkey % 5 = 1 THEN CAST(0.25 AS DOUBLE) ELSE CAST(3 AS DOUBLE) END AS w
  FROM r JOIN part ON p_partkey = l_partkey),
m AS (SELECT *, CASE page_id % 4 WHEN 0 THEN 'percent' WHEN 1 THEN 'fraction' WHEN 2 THEN 'thousand'
        ELSE 'mixed' END AS scale, CASE WHEN page_id % 13 = 0 THEN 97 ELSE cx END AS ax FROM g),
k AS (SELECT *, CAST(CASE WHEN scale = 'fraction' OR (scale = 'mixed' AND item_id % 2 = 0) THEN 100
  WHEN scale = 'thousand' THEN 0.1 ELSE 1 END AS DOUBLE) AS f FROM m)
SELECT 'b' AS side, page_id, item_id, t AS text, 'percent' AS scale, CAST(cx AS DOUBLE) AS cx,
  CAST(cy AS DOUBLE) AS cy, CAST(l_partkey % 100 AS DOUBLE) / 100 AS conf, cx - w AS x1, cy - w / 2 AS y1,
  cx + w AS x2, cy + w / 2 AS y2 FROM k WHERE t NOT LIKE 'small %'
UNION ALL
SELECT 'a', page_id, item_id, replace(replace(t, 'o', 'ó'), 'e', 'è'), scale, CAST(ax AS DOUBLE) / f,
  CAST(cy AS DOUBLE) / f, CAST(NULL AS DOUBLE), (ax - w) / f, (cy - w / 2) / f, (ax + w) / f, (cy + w / 2) / f
FROM k WHERE t NOT LIKE 'cold %'""",
    "f4_calls": """SELECT event_id AS call_id, ts, user_id % 20 AS chapter_id,
  CASE event_id % 3 WHEN 0 THEN 'translate' WHEN 1 THEN 'ocr' ELSE 'vision-crop' END AS feature,
  CASE event_type WHEN 'purchase' THEN 'deepseek' WHEN 'error' THEN 'deepseek' WHEN 'signup' THEN 'deepl'
    ELSE 'gemini' END AS provider,
  CASE event_type WHEN 'purchase' THEN 'deepseek-v4-flash' WHEN 'error' THEN 'deepseek-v4-pro'
    WHEN 'signup' THEN 'deepl' WHEN 'click' THEN 'gemini-3.1-pro-preview'
    ELSE CASE WHEN event_id % 5 = 0 THEN 'unknown-model' ELSE 'gemini-2.5-flash' END END AS model,
  CASE WHEN event_type = 'signup' OR event_id % 17 = 0 THEN CAST(NULL AS BIGINT)
    ELSE CAST(floor(value * 100 + 0.5) AS BIGINT) * 10 END AS prompt_tokens,
  CASE WHEN event_type = 'signup' OR event_id % 17 = 0 THEN CAST(NULL AS BIGINT)
    ELSE event_id % 4000 END AS completion_tokens,
  CASE WHEN event_type IN ('purchase', 'error') AND event_id % 17 <> 0 AND event_id % 2 = 0
    THEN CAST(floor(value * 100 + 0.5) AS BIGINT) * 4 END AS cache_hit_tokens,
  event_id % 900 AS chars
FROM events""",
    "f5_cards": """SELECT CASE WHEN p_partkey % 17 = 0 THEN '_notes' ELSE p_brand END AS provider,
  CASE WHEN p_partkey % 19 = 0 THEN '_' ELSE '' END || p_type || '/' || p_partkey AS model, p_size AS card,
  p_retailprice / 1000 AS input, p_retailprice / 250 AS output,
  CASE WHEN p_partkey % 3 = 0 THEN p_retailprice / 50000 END AS cache_hit,
  CASE WHEN p_partkey % 7 = 0 THEN CAST(p_size * 1000 AS BIGINT) END AS threshold_tokens,
  CASE WHEN p_partkey % 7 = 0 THEN p_retailprice / 500 END AS input_above,
  CASE WHEN p_partkey % 7 = 0 THEN p_retailprice / 125 END AS output_above,
  CAST(NULL AS DOUBLE) AS per_million_chars
FROM part""",
    "f5_rates": """SELECT provider, model, CAST(input AS DOUBLE) AS input, CAST(output AS DOUBLE) AS output,
  CAST(cache_hit AS DOUBLE) AS cache_hit, CAST(threshold_tokens AS BIGINT) AS threshold_tokens,
  CAST(input_above AS DOUBLE) AS input_above, CAST(output_above AS DOUBLE) AS output_above,
  CAST(per_million_chars AS DOUBLE) AS per_million_chars
FROM (VALUES
  ('deepseek', 'deepseek-v4-flash', '0.14', '0.28', '0.0028', NULL, NULL, NULL, NULL),
  ('deepseek', 'deepseek-v4-pro', '0.435', '0.87', '0.003625', NULL, NULL, NULL, NULL),
  ('gemini', 'gemini-2.5-flash', '0.30', '2.50', NULL, NULL, NULL, NULL, NULL),
  ('gemini', 'gemini-3.1-pro-preview', '2.00', '12.00', NULL, '200000', '4.00', '18.00', NULL),
  ('deepl', 'deepl', NULL, NULL, NULL, NULL, NULL, NULL, '5.49'))
  AS t(provider, model, input, output, cache_hit, threshold_tokens, input_above, output_above, per_million_chars)""",
    "f6_replies": """WITH a AS (SELECT conv_id * 100 + turn AS reply_id, (conv_id + turn) % 6 AS shape FROM conversations
           WHERE role = 'assistant'),
b AS (SELECT *, '[{"i":0,"tl":"first ' || reply_id || '","t":"sfx"},{"i":"1","tl":"second","t":"bogus"},'
  || '{"i":"2x","tl":"bad index"},{"i":9,"tl":"out of range"},{"i":0,"tl":"last ' || reply_id
  || '","t":"sign"}]' AS items FROM a)
SELECT reply_id, shape, CASE shape
  WHEN 0 THEN '{"translations":' || items || '}'
  WHEN 1 THEN items
  WHEN 2 THEN '```json ' || '{"translations":' || items || '}' || ' ```'
  WHEN 3 THEN 'thinking about "translations" first. {"translations":' || items || '}'
  WHEN 4 THEN '{"model":{"name":"x"},"translations":' || items || '}'
  ELSE 'no json here at all' END AS body
FROM b""",
    "f6_bodies": """WITH a AS (SELECT conv_id * 100 + turn AS reply_id, (conv_id + turn) % 6 AS shape, length(text) AS n,
  '"' || replace(replace(replace(replace(replace(coalesce(text, ''), chr(92), chr(92) || chr(92)), '"', chr(92) || '"'),
    chr(10), chr(92) || 'n'), chr(13), chr(92) || 'r'), chr(9), chr(92) || 't') || '"' AS said FROM conversations WHERE role = 'assistant')
SELECT reply_id, CASE shape
  WHEN 0 THEN '{"candidates":[{"content":{"parts":[{"text":"so","thought":true},{"text":' || said || '}]}}],"usageMetadata":{"promptTokenCount":' || n || ',"candidatesTokenCount":' || (n % 97) || '}}'
  WHEN 1 THEN '{"choices":[{"message":{"content":' || said || '}}],"usage":{"prompt_tokens":' || (n % 1000) || ',"completion_tokens":' || n || '}}'
  WHEN 2 THEN '{"candidates":[{"content":{"parts":[{"text":' || said || ',"thought":true},{"text":" "}]}}]}'
  WHEN 3 THEN '{"candidates":[{"content":{"parts":[{"text":" "},{"text":' || said || '},{"text":"end"}]}}],"usageMetadata":{"promptTokenCount":' || n || '}}'
  WHEN 4 THEN '{"choices":[],"usage":{"prompt_tokens":' || n || '}}'
  ELSE said END AS body
FROM a""",
    "f7_urls": """SELECT page_id, url FROM pages
UNION ALL
SELECT 1000000 + n_nationkey, CASE n_nationkey % 8
  WHEN 0 THEN 'https://uploads.allowed.org/a.png' WHEN 1 THEN 'https://n1.allowed.network/a.png'
  WHEN 2 THEN 'https://allowed.org.evil.com/a.png' WHEN 3 THEN 'https://evilallowed.org/a.png'
  WHEN 4 THEN 'http://127.0.0.1:4567/page/0' WHEN 5 THEN 'http://127.0.0.1:4568/page/0'
  WHEN 6 THEN 'https://169.254.169.254/x' ELSE '' END
FROM nation""",
    "f8_regions": """SELECT o_custkey AS chapter_id, o_orderkey % 8 AS page_idx, o_orderkey AS region_id,
  CAST((o_orderkey * 7) % 90 AS DOUBLE) AS cx, CAST((o_orderkey * 13) % 90 AS DOUBLE) AS cy,
  CASE o_orderstatus WHEN 'F' THEN 'speech' WHEN 'O' THEN 'sfx' ELSE 'sign' END AS t,
  o_orderpriority AS text,
  CASE WHEN o_orderkey % 9 = 0 THEN '—' WHEN o_orderkey % 10 = 0 THEN ' ' ELSE 'tl ' || o_orderkey END AS tl,
  CASE WHEN o_custkey % 5 = 0 THEN 5 ELSE 6 END AS v, o_orderdate AS saved_at
FROM orders""",
    "f8_chapters": """SELECT c_custkey AS chapter_id, CASE WHEN c_custkey % 5 = 0 THEN '' ELSE c_name END AS title,
  CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE CAST(c_custkey % 90 AS STRING) END AS chapter,
  CASE WHEN c_custkey % 4 = 0 THEN c_mktsegment END AS chapter_title, CASE c_nationkey % 3 WHEN 0 THEN 'vi' WHEN 1 THEN 'ko' END AS source_lang,
  CASE WHEN c_nationkey % 4 = 0 THEN 'es' ELSE 'en' END AS target_lang, CASE WHEN c_custkey % 3 = 1 THEN 'm' || c_nationkey END AS manga_id
FROM customer WHERE c_acctbal >= 0""",
    "f8_fetched": """SELECT DISTINCT o_custkey AS chapter_id, o_orderkey % 8 AS page_idx,
  CASE WHEN (o_custkey * 11 + o_orderkey % 8) % 23 = 0 THEN 'HTTP ' || (400 + o_custkey % 9) END AS error
FROM orders WHERE (o_custkey + o_orderkey % 8) % 31 <> 0""",
    "f8_drafts": """SELECT o_custkey AS chapter_id, o_orderkey % 8 AS page_idx, o_orderkey AS region_id,
  'fixed ' || o_orderkey AS tl, o_orderpriority AS text, (o_orderkey % 6 = 0) AS deleted,
  CASE o_custkey % 3 WHEN 0 THEN 'same' WHEN 1 THEN 'stale' ELSE 'none' END AS signature_kind
FROM orders WHERE o_orderpriority = '1-URGENT'""",
    "f9_views": """SELECT event_id, ts, user_id AS reader_id, user_id % 12 AS chapter_id, 1 + user_id % 30 AS page_count,
  event_id % (1 + user_id % 30) AS page_idx, value / 500 AS visible, event_id AS seq,
  CASE event_type WHEN 'error' THEN 'error' WHEN 'signup' THEN 'skipped' WHEN 'view' THEN 'pending'
    ELSE 'done' END AS status,
  CASE event_id % 5 WHEN 0 THEN 'pt-br' WHEN 1 THEN 'zh-hk' WHEN 2 THEN 'ja' WHEN 3 THEN 'xx' ELSE 'es' END AS lang
FROM events""",
    "f10_feed": """SELECT c_custkey AS series_id, o_orderkey AS chapter_id, o_orderdate AS released,
  '{"id":"' || o_orderkey || '","attributes":{"chapter":'
  || CASE WHEN o_orderkey % 7 = 0 THEN 'null' ELSE '"' || o_orderkey % 100 || '"' END
  || ',"translatedLanguage":"vi"},"relationships":[{"type":"manga","id":"' || c_custkey
  || '","attributes":{"title":{' || CASE WHEN c_custkey % 2 = 0 THEN '"en":"' ELSE '"ja":"' END || c_name
  || '"}}},{"type":"scanlation_group","id":"g' || o_orderkey % 5 || '"'
  || CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE ',"attributes":{"name":"group"}' END || '}]}' AS body
FROM orders JOIN customer ON c_custkey = o_custkey""",
    "f11_glossary": """SELECT p_brand AS series_name, p_partkey AS pos, CASE WHEN p_partkey % 13 = 0 THEN '  ' ELSE p_name END AS src,
  p_type AS tl, CASE WHEN p_size % 2 = 0 THEN 'size ' || p_size ELSE '' END AS note
FROM part""",
    "f12_paths": """SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN '__MACOSX/' ELSE '' END || lang || '_' || source || '/'
  || CASE doc_id % 9 WHEN 0 THEN '.hidden.png' WHEN 1 THEN 'ComicInfo.xml' WHEN 2 THEN 'notes.txt'
     WHEN 3 THEN 'page' || doc_id || '.PNG' WHEN 4 THEN 'page' || doc_id || '.webp'
     ELSE 'page' || doc_id || '.jpg' END AS path
FROM documents""",
    "f13_mask_runs": f"""{_ROWS}
SELECT page_id, y, CAST(rn * 30 + CASE WHEN bridge THEN 0 ELSE p % 12 END AS INT) AS x0,
  CAST(rn * 30 + CASE WHEN bridge THEN 57 ELSE p % 12 + 2 + (s * 7 + p) % 15 END AS INT) AS x1
FROM g WHERE NOT (bridge AND rn % 2 = 0)""",
    "f13_boxes": f"""{_ROWS}
SELECT page_id, CAST(floor(y / 8) * 16 + rn AS INT) AS box_id, CAST(rn * 30 - 3 + min(p % 12) AS INT) AS x1,
  CAST(min(y) - 4 AS INT) AS y1, CAST(rn * 30 + 10 + max((p + s) % 24) AS INT) AS x2, CAST(max(y) + 6 AS INT) AS y2
FROM g GROUP BY page_id, CAST(floor(y / 8) * 16 + rn AS INT), rn""",
    "f14_ink_runs": f"""{_ROWS}
SELECT page_id, y, CAST(10 + min(p % 40) AS INT) AS x0, CAST(60 + max(p % 40 + s % 60) AS INT) AS x1,
  CASE WHEN page_id % 5 = 4 THEN 'light' ELSE 'dark' END AS level FROM g WHERE long_run GROUP BY page_id, y
UNION ALL
SELECT page_id, y, CAST(rn * 30 + p % 12 AS INT), CAST(rn * 30 + p % 12 + 2 + (s * 7 + p) % 15 AS INT),
  CASE WHEN p % 3 = 0 THEN 'light' ELSE 'dark' END FROM g WHERE NOT long_run""",
    "f14_bands": f"""{_ROWS}
SELECT page_id, CAST(20 + p % 50 AS INT) AS gx1, y AS gy1, CAST(22 + p % 50 + s % 60 AS INT) AS gx2,
  CAST(y + 1 + p % 9 AS INT) AS gy2, CASE WHEN p % 11 = 0 THEN NULL ELSE CAST((p * 5) % 256 AS INT) END AS tone, rn AS band_id
FROM g""",
    "f15_engine_text": """WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS text FROM documents)
SELECT doc_id, lang, 'truth' AS engine, text, CAST(0 AS BIGINT) AS millis, CAST(NULL AS STRING) AS error FROM d
UNION ALL SELECT doc_id, lang, 'light', replace(replace(replace(text, 'ä', 'a'), 'é', 'e'), 'ñ', 'n'),
  500 + doc_id % 300, NULL FROM d
UNION ALL SELECT doc_id, lang, 'heavy',
  CASE WHEN length(text) % 40 = 0 THEN '' ELSE substr(text, 1, CAST(length(text) - floor(length(text) / 10) AS INT)) END,
  3000 + doc_id % 900, CASE WHEN length(text) % 40 = 0 THEN 'out of memory' END FROM d""",
    "f16_tones": """SELECT l_orderkey AS region_id, CASE WHEN l_orderkey % 2 = 0 THEN 240 + l_partkey % 12
  ELSE (l_partkey * 5) % 256 END AS tone, count(*) AS n
FROM lineitem GROUP BY 1, 2""",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


BROADCAST_ROWS = 1 << 18  # of a joined table, some hundred bytes each once they are in the driver


def fixture(spark: SparkSession, sf_dir: str, name: str, bounded: bool = False) -> DataFrame:
    """The named input over the tables in sf_dir, which are passed by value: no view is registered. Where it is
    `bounded`, joined tables of more than BROADCAST_ROWS rows are not broadcast, however small their files are."""
    sql = SQL[name]
    used = {t: table(spark, sf_dir, t) for t in TABLES if t in sql.replace("(", " ").replace(")", " ").replace(",", " ").split()}
    if bounded:
        used = {t: df.hint("merge") if f"JOIN {t} " in sql and df.count() > BROADCAST_ROWS else df for t, df in used.items()}
    text = sql.replace("{", "{{").replace("}", "}}")
    for t in used:
        text = _braced(text, t)
    return spark.sql(text, **used)


def _braced(text: str, name: str) -> str:
    """{name} wherever the table is read."""
    for lead in ("FROM ", "JOIN "):
        for tail in ("\n", " ", ")", ","):
            text = text.replace(f"{lead}{name}{tail}", f"{lead}{{{name}}}{tail}")
        if text.endswith(f"{lead}{name}"):
            text = text[: -len(name)] + f"{{{name}}}"
    return text
