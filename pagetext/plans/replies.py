"""Queries over requests and replies, with their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagetext.operators import replies as op
from pagetext.plans.fixtures import SQL, fixture, table

REPLIES = SQL["f6_replies"]
SENTENCE = "[^.!?\\n]+"
SENT = f"""SELECT reply_id, CAST(i AS INT) AS i, text, CAST(10 + i * 20 % 80 AS DOUBLE) AS cx, CAST(90 - i * 7 % 80 AS DOUBLE) AS cy FROM (
  SELECT reply_id, unnest(range(len(parts))) AS i, unnest(parts) AS text FROM (SELECT conv_id * 100 + turn AS reply_id, regexp_extract_all(text, '{SENTENCE}') AS parts FROM conversations WHERE role = 'assistant'))"""
LANGS = ("ja", "vi", "pt")


def _sent(spark, d):
    """Every sentence of every reply."""
    said = table(spark, d, "conversations").where("role = 'assistant'")
    one = said.select((F.col("conv_id") * 100 + F.col("turn")).alias("reply_id"), F.posexplode(F.regexp_extract_all("text", F.lit(SENTENCE), F.lit(0))).alias("i", "text"))
    return one.select("*", (10 + F.col("i") * 20 % 80).cast("double").alias("cx"), (90 - F.col("i") * 7 % 80).cast("double").alias("cy"))


def _parsed(spark, d):
    return op.parse_items(fixture(spark, d, "f6_replies"))


def send_set(spark, d):
    return op.send_set(_sent(spark, d)).select("reply_id", "i", "noise", "sent")


def parse_items(spark, d):
    return _parsed(spark, d).select("reply_id", "strategy", F.size("items").alias("n"), "reason")


def quarantine(spark, d):
    return op.quarantine(_parsed(spark, d)).select("reply_id", "reason")


def apply_replies(spark, d):
    return op.apply_replies(_sent(spark, d), _parsed(spark, d)).select("reply_id", "i", "tl", "t")


def apply_positional(spark, d):
    texts = fixture(spark, d, "f6_replies").select("reply_id", F.array(F.lit("one"), F.concat(F.lit("two "), F.col("reply_id").cast("string"))).alias("texts"))
    return op.apply_positional(_sent(spark, d), texts).select("reply_id", "i", "tl")


def flow_diff(spark, d):
    regions = op.apply_replies(_sent(spark, d), _parsed(spark, d))
    issues = fixture(spark, d, "f6_replies").select("reply_id", F.explode(F.array(F.struct(F.lit(0).alias("n"), F.lit("third").alias("fix"), F.lit("tone").alias("why")), F.struct(F.lit(1).alias("n"), F.lit(" ").alias("fix"), F.lit("x").alias("why")), F.struct(F.lit(9).alias("n"), F.lit("z").alias("fix"), F.lit("x").alias("why"))))).select("reply_id", "col.*")
    return op.flow_diff(regions, issues)


def _lang(df):
    return df.withColumn("lang", F.element_at(F.array(*map(F.lit, LANGS)), (F.col("reply_id") % 3 + 1).cast("int")))


def build_requests(spark, d):
    hints = spark.createDataFrame([("ja", "Keep honorifics."), ("vi", "Mind pronouns.")], "lang string, hint string")
    pages = _sent(spark, d).where("reply_id % 2 = 0").select("reply_id").distinct().withColumn("block", F.lit("a → b"))
    built = op.build_requests(_lang(_sent(spark, d)), "Translate.", hints, pages)
    return built.select("reply_id", "instruction", "glossary", "expected", F.size(F.from_json("items", "array<struct<i:int>>")).alias("n_items"))


def glossary_block(spark, d):
    return op.glossary_block(fixture(spark, d, "f11_glossary"))


def reply_text(spark, d):
    return op.reply_text(fixture(spark, d, "f6_bodies")).drop("body")


def rescue_json(spark, d):
    replies = fixture(spark, d, "f6_replies").withColumn("answer", F.when(F.col("reply_id") % 3 == 0, "told").when(F.col("reply_id") % 3 == 1, " "))
    return op.rescue_json(replies, text="body").select("reply_id", "shape", "rescued")


QUERIES = {f.__name__: f for f in (send_set, parse_items, quarantine, apply_replies, apply_positional, flow_diff, build_requests, glossary_block, reply_text, rescue_json)}

_NOISE = "length(trim(text)) < 2 OR length(trim(text)) > 150"
_TOLD = f"""a AS (SELECT s.reply_id, s.i, s.text, s.cx, s.cy, r.shape <> 5 AND s.i IN (0, 1, 9) AS told FROM ({SENT}) s JOIN ({REPLIES}) r USING (reply_id)),
b AS (SELECT reply_id, i, cx, cy, CASE WHEN NOT told THEN '—' WHEN i = 0 THEN 'last ' || reply_id WHEN i = 9 THEN 'out of range' ELSE 'second' END AS tl, CASE WHEN NOT told THEN CASE WHEN {_NOISE} THEN 'sfx' ELSE 'speech' END WHEN i = 0 THEN 'sign' ELSE 'speech' END AS t FROM a)"""
ORACLES = {
    "send_set": f"WITH n AS (SELECT reply_id, i, {_NOISE} AS noise FROM ({SENT})) SELECT reply_id, i, noise, NOT noise OR sum(CASE WHEN noise THEN 0 ELSE 1 END) OVER (PARTITION BY reply_id) = 0 AS sent FROM n",
    "parse_items": f"SELECT reply_id, CASE WHEN shape IN (0, 1, 2, 4) THEN 1 WHEN shape = 3 THEN 2 END AS strategy, CASE WHEN shape < 5 THEN json_array_length(regexp_extract(body, '\\[.*\\]', 0)) END AS n, CASE WHEN shape = 5 THEN 'no JSON list' END AS reason FROM ({REPLIES})",
    "quarantine": f"SELECT reply_id, 'no JSON list' AS reason FROM ({REPLIES}) WHERE shape = 5",
    "apply_replies": f"WITH {_TOLD} SELECT reply_id, i, tl, t FROM b",
    "apply_positional": f"WITH p AS (SELECT reply_id, i, row_number() OVER (PARTITION BY reply_id ORDER BY i) AS k FROM ({SENT})) SELECT reply_id, i, CASE k WHEN 1 THEN 'one' WHEN 2 THEN 'two ' || reply_id ELSE '—' END AS tl FROM p",
    "flow_diff": f"WITH {_TOLD}, c AS (SELECT *, row_number() OVER (PARTITION BY reply_id ORDER BY cy, cx, i) AS k, count(*) OVER (PARTITION BY reply_id) AS n FROM b WHERE tl <> '—') SELECT reply_id, i, tl AS before, 'third' AS after, 'tone' AS why FROM c WHERE n >= 2 AND k = 1",
    "build_requests": f"""WITH n AS (SELECT reply_id, {_NOISE} AS noise FROM ({SENT})), m AS (SELECT reply_id, count(*) AS all_n, sum(CASE WHEN noise THEN 0 ELSE 1 END) AS real FROM n GROUP BY 1)
SELECT reply_id, 'Translate.' || CASE reply_id % 3 WHEN 0 THEN chr(10) || 'Keep honorifics.' WHEN 1 THEN chr(10) || 'Mind pronouns.' ELSE '' END AS instruction, CASE WHEN reply_id % 2 = 0 THEN 'a → b' ELSE '' END AS glossary, CAST(CASE WHEN real = 0 THEN all_n ELSE real END AS BIGINT) AS expected, CAST(CASE WHEN real = 0 THEN all_n ELSE real END AS INT) AS n_items FROM m""",
    "glossary_block": f"""WITH g AS ({SQL['f11_glossary']}) SELECT series_name, coalesce(string_agg(trim(src) || ' → ' || trim(tl) || CASE WHEN trim(note) <> '' THEN ' (' || trim(note) || ')' ELSE '' END, chr(10) ORDER BY pos) FILTER (trim(src) <> '' AND trim(tl) <> ''), '') AS block FROM g GROUP BY 1""",
    "rescue_json": f"SELECT reply_id, shape, CASE WHEN reply_id % 3 = 0 THEN NULL WHEN contains(body, '\"translations\"') THEN regexp_extract(body, '\\{{.*\\}}', 0) ELSE '' END AS rescued FROM ({REPLIES})",
    "reply_text": f"""WITH b AS (SELECT reply_id, CASE WHEN json_valid(body) THEN body END AS body FROM ({SQL['f6_bodies']})),
p AS (SELECT *, from_json(json_extract(body, '$.candidates[0].content.parts'), '[{{"text":"VARCHAR","thought":"BOOLEAN"}}]') AS parts FROM b)
SELECT reply_id, coalesce(list_filter(parts, lambda x: NOT coalesce(x.thought, false) AND trim(coalesce(x.text, '')) <> '')[1].text, parts[1].text, body ->> '$.choices[0].message.content') AS answer,
coalesce(CAST(body ->> '$.usageMetadata.promptTokenCount' AS BIGINT), CAST(body ->> '$.usage.prompt_tokens' AS BIGINT)) AS prompt_tokens,
coalesce(CAST(body ->> '$.usageMetadata.candidatesTokenCount' AS BIGINT), CAST(body ->> '$.usage.completion_tokens' AS BIGINT)) AS completion_tokens FROM p""",
}
