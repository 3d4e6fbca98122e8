"""Queries over chapters, files, caches and reading state, with their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagetext.operators import library as op
from pagetext.plans.fixtures import SQL, fixture

NOW, DAYS = "1998-07-01", 400


def _r(s, d):
    return fixture(s, d, "f8_regions")


def _drafts(s, d):
    drafts, base = fixture(s, d, "f8_drafts"), _r(s, d)
    signed = drafts.join(op.page_signature(base), ["chapter_id", "page_idx"], "left")
    return signed.withColumn("signature", F.when(F.col("signature_kind") == "same", F.col("signature")).when(F.col("signature_kind") == "stale", "0|"))


def _feed(s, d):
    f = fixture(s, d, "f10_feed")
    return op.chapter_feed(f.union(f.where("chapter_id % 3 = 0")))


def _paths(s, d):
    return fixture(s, d, "f12_paths")


def _names(s, d):
    return fixture(s, d, "f11_glossary")


READ_AT = "2024-03-01 12:00:00"


def route_pages(s, d):
    """Each mode, with and without a key."""
    views, out = fixture(s, d, "f9_views").select("event_id", "lang", (F.col("event_id") % 4 == 0).alias("cached")), None
    for mode in ("smart", "all", "off"):
        for key in (True, False):
            own = op.route_pages(views, "es", ("ja", "zh", "zh-hk", "ko"), mode, key).select("event_id", F.lit(mode).alias("mode"), F.lit(key).alias("has_key"), "route")
            out = own if out is None else out.union(own)
    return out


def _history(s, d):
    return fixture(s, d, "f9_views").withColumn("v", F.when(F.col("event_id") % 7 == 0, 0).when(F.col("event_id") % 2 == 0, 1)).withColumn("page_idx", F.when(F.col("event_id") % 11 != 0, F.col("page_idx")))


def chapter_ids(s, d):
    """UUIDs made of each url's digest, and keys of one part or three."""
    m = F.md5("url")
    made = F.concat_ws("-", F.substring(m, 1, 8), F.substring(m, 9, 4), F.substring(m, 13, 4), F.substring(m, 17, 4), F.substring(m, 21, 12))
    url = F.when(F.col("page_id") % 3 == 0, F.col("url")).otherwise(F.concat(F.lit("https://h/Chapter/"), made, F.lit("/1")))
    key = F.when(F.col("page_id") % 2 == 0, F.concat_ws(":", F.when(F.col("page_id") % 4 == 0, "shelf").otherwise("other"), F.lit("s1"), F.col("page_id").cast("string"))).otherwise(F.col("page_id").cast("string"))
    parts = op.split_composite_id(key, "shelf", "web")
    return fixture(s, d, "f7_urls").select("page_id", op.chapter_id(url).alias("uuid"), parts.alias("p")).select("page_id", "uuid", "p.*")


QUERIES = {
    "page_files": lambda s, d: op.page_files(_paths(s, d)).select("doc_id", "mime", "page_idx"),
    "eval_listing": lambda s, d: op.eval_listing(_paths(s, d)),
    "safe_names": lambda s, d: _paths(s, d).select("doc_id", op.safe_name(F.col("path")).alias("safe"), op.title_from_path(F.concat("path", F.lit(".cbz"))).alias("title")),
    "series_keys": lambda s, d: _names(s, d).select("pos", op.series_key(F.when(F.col("pos") % 3 == 0, F.col("pos")), F.concat("series_name", F.lit(" / "), "src")).alias("key")),
    "url_verdict": lambda s, d: op.url_verdict(fixture(s, d, "f7_urls"), ("allowed.org", "allowed.network"), "127.0.0.1:4567").select("page_id", "ok", "reason"),
    "payload_guard": lambda s, d: op.payload_guard(fixture(s, d, "f7_urls").select("page_id", F.when(F.col("page_id") % 7 == 0, F.concat(F.lit("!!"), "url")).otherwise(F.concat(F.lit("data:text/plain;base64,"), F.base64(F.encode("url", "UTF-8")))).alias("payload"))).select("page_id", "verdict", F.col("n_bytes").cast("bigint").alias("n_bytes")),
    "languages": lambda s, d: fixture(s, d, "f9_views").select("event_id", op.lang_base(F.col("lang")).alias("base"), op.lang_name(F.col("lang")).alias("name"), op.progress_pct(F.col("page_idx"), F.col("page_count")).alias("pct")),
    "chapter_meta": lambda s, d: op.chapter_meta(fixture(s, d, "f10_feed")).select("chapter_id", "title", "manga_id", "chapter", "language", F.array_join(F.transform("groups", lambda g: g["id"]), ",").alias("groups")),
    "chapter_feed": lambda s, d: _feed(s, d).select("series_id", "chapter_id", "n"),
    "adjacent": lambda s, d: op.adjacent(_feed(s, d)).select("series_id", "chapter_id", "prev_id", "next_id"),
    "next_n": lambda s, d: op.next_n(_feed(s, d), fixture(s, d, "f10_feed").where("chapter_id % 5 = 0").select("series_id", "chapter_id"), 3),
    "page_urls": lambda s, d: op.page_urls(fixture(s, d, "f10_feed").select("chapter_id", F.lit("https://h").alias("base"), F.md5(F.col("chapter_id").cast("string")).alias("hash"), F.array(*[F.lit(f"p{i}.png") for i in range(4)]).alias("full"), F.when(F.col("chapter_id") % 2 == 0, F.array(*[F.lit(f"s{i}.jpg") for i in range(4)])).alias("small")), True),
    "page_signature": lambda s, d: op.page_signature(_r(s, d)),
    "fresh_drafts": lambda s, d: op.fresh_drafts(_drafts(s, d), _r(s, d)).select("region_id", "fresh"),
    "effective_regions": lambda s, d: op.effective_regions(_r(s, d), _drafts(s, d)).select("region_id", "tl", "origin"),
    "drawable": lambda s, d: op.drawable(_r(s, d)).select("region_id"),
    "retain_ttl": lambda s, d: op.retain_ttl(_r(s, d).join(fixture(s, d, "f8_chapters").select("chapter_id", "target_lang"), "chapter_id", "left"), F.lit(NOW), DAYS, 6, "en").select("region_id"),
    "retain_newest": lambda s, d: op.retain_newest(_r(s, d), 3, "chapter_id", "saved_at", "region_id").select("region_id"),
    "chapter_list": lambda s, d: op.chapter_list(op.retain_ttl(_r(s, d), F.lit(NOW), DAYS, 6), fixture(s, d, "f8_chapters")).withColumn("saved_at", F.col("saved_at").cast("date").cast("string")),
    "cache_stats": lambda s, d: op.cache_stats(_r(s, d)),
    "export_manifest": lambda s, d: op.export_manifest(_r(s, d)),
    "export_status": lambda s, d: op.export_status(op.export_manifest(_r(s, d)), fixture(s, d, "f8_fetched")),
    "nearest_context": lambda s, d: op.nearest_context(_r(s, d).withColumn("page_idx", F.col("page_idx") % 2)).select("region_id", F.array_join("context", "|").alias("context")),
    "legend": lambda s, d: op.legend(_r(s, d), F.col("t") == "sign").select("region_id", "number"),
    "seed_boxes": lambda s, d: op.seed_boxes(_r(s, d)).select("region_id", "tl", "text"),
    "route_pages": route_pages,
    "status_summary": lambda s, d: op.status_summary(fixture(s, d, "f9_views"), fixture(s, d, "f4_calls").select("chapter_id", (F.col("chars") / 1000).alias("cost")), 60.0).withColumn("spent", F.round("spent", 6)),
    "recent": lambda s, d: op.recent(_history(s, d), F.lit(READ_AT)).select("chapter_id", "page_idx", "pct", "progress", "ago"),
    "latest": lambda s, d: op.latest(_history(s, d), F.lit(READ_AT)).select("chapter_id", "page_idx", "pct", "progress", "ago"),
    "target_codes": lambda s, d: fixture(s, d, "f9_views").select("event_id", op.target_code(op.lang_name(F.col("lang"))).alias("code")),
    "chapter_ids": chapter_ids,
    "dominant_page": lambda s, d: op.dominant_page(fixture(s, d, "f9_views")),
    "resolve_choice": lambda s, d: op.resolve_choice(fixture(s, d, "f9_views").select("event_id", "chapter_id", "lang"), fixture(s, d, "f9_views").where("chapter_id % 5 = 0").select("chapter_id").distinct().withColumn("override", F.lit("heavy")), s.createDataFrame([("ja", "vision"), ("es", "light")], "lang string, picked string"), "standard").select("event_id", "engine"),
}

R, D, V, FEED, PATHS = (f"({SQL[n]})" for n in ("f8_regions", "f8_drafts", "f9_views", "f10_feed", "f12_paths"))
_SIG = f"sig AS (SELECT chapter_id, page_idx, count(*) || '|' || string_agg(trim(text), '␟' ORDER BY region_id) AS signature FROM {R} GROUP BY 1, 2)"
_FRESH = f"fr AS (SELECT d.*, signature_kind <> 'stale' AND (signature_kind = 'none' OR sig.signature IS NOT NULL) AS fresh FROM {D} d LEFT JOIN sig USING (chapter_id, page_idx))"
_TOLD = "trim(coalesce(tl, '')) NOT IN ('', '—')"
_SLUG = "trim(regexp_replace(lower(trim(x)), '[^a-z0-9]+', '-', 'g'), '-')"
_ORDERED = f"o AS (SELECT series_id, chapter_id, row_number() OVER (PARTITION BY series_id ORDER BY released, chapter_id) AS n FROM {FEED})"
_NAME = "regexp_extract(path, '[^/]*$', 0)"
_TTL = f"SELECT * FROM {R} WHERE v >= 6 AND date_diff('day', CAST(saved_at AS TIMESTAMP), TIMESTAMP '{NOW}') <= {DAYS}"
_LANG = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in op.LANGUAGES.items())
_MIME = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in op.IMAGE_TYPES.items())

_CODES = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in op.TARGET_CODES.items())
_PCT = "CASE WHEN page_count > 1 THEN CAST(floor((page_idx + 1) * 100.0 / page_count + 0.5) AS INT) END"
_RECENT = f"""WITH l AS (SELECT chapter_id, ts, page_idx, page_count FROM {V} WHERE event_id % 7 <> 0 AND event_id % 11 <> 0 QUALIFY row_number() OVER (PARTITION BY chapter_id ORDER BY ts DESC, event_id DESC) = 1),
m AS (SELECT *, {_PCT} AS pct, CAST(floor((epoch_ms(TIMESTAMP '{READ_AT}') - epoch_us(ts) // 1000) / 60000) AS BIGINT) AS mi FROM l)
SELECT chapter_id, page_idx, pct, CASE WHEN pct IS NULL THEN '' ELSE 'page ' || (page_idx + 1) || '/' || page_count || ' (' || pct || '%)' END AS progress, CASE WHEN mi < 1 THEN 'just now' WHEN mi < 60 THEN mi || 'm ago' WHEN mi < 1440 THEN (mi // 60) || 'h ago' WHEN mi < 10080 THEN (mi // 1440) || 'd ago' ELSE strftime(ts, '%Y-%m-%d') END AS ago
FROM m ORDER BY ts DESC, chapter_id LIMIT {{n}}"""

ORACLES = {
    "page_files": f"""WITH k AS (SELECT doc_id, path, {_NAME} AS name, regexp_extract(path, '^(.*)/[^/]*$', 1) AS folder, CASE lower(regexp_extract(path, '\\.([A-Za-z0-9]+)$', 1)) {_MIME} END AS mime FROM {PATHS})
SELECT doc_id, mime, CAST(row_number() OVER (PARTITION BY folder ORDER BY CAST(coalesce(nullif(regexp_extract(name, '[0-9]+', 0), ''), '0') AS BIGINT), lower(name), name) - 1 AS INT) AS page_idx FROM k WHERE mime IS NOT NULL AND NOT contains(path, '__MACOSX/') AND NOT starts_with(name, '.')""",
    "eval_listing": f"SELECT doc_id, path, nullif(regexp_extract(split_part(path, '/', -2), '^([a-z]{{2}})_', 1), '') AS eval_lang, regexp_matches(split_part(path, '/', -2), '^[a-z]{{2}}_') AS matched FROM {PATHS}",
    "safe_names": f"SELECT doc_id, left(regexp_replace(path, '[^A-Za-z0-9_-]+', '_', 'g'), 60) AS safe, trim(regexp_replace(path, '[_.]+', ' ', 'g')) AS title FROM {PATHS}",
    "series_keys": f"WITH g AS (SELECT pos, series_name || ' / ' || src AS x FROM ({SQL['f11_glossary']})) SELECT pos, CASE WHEN pos % 3 = 0 THEN 'id:' || pos ELSE 'name:' || {_SLUG} END AS key FROM g",
    "url_verdict": f"""WITH u AS (SELECT page_id, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) AS scheme, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)) AS net FROM ({SQL['f7_urls']})),
v AS (SELECT *, regexp_replace(regexp_replace(net, '^.*@', ''), ':[0-9]*$', '') AS host FROM u), w AS (SELECT page_id, CASE WHEN scheme = 'http' AND net = '127.0.0.1:4567' THEN 'local' WHEN host = '' THEN 'no host' WHEN scheme <> 'https' THEN 'not https' WHEN host IN ('allowed.org', 'allowed.network') OR ends_with(host, '.allowed.org') OR ends_with(host, '.allowed.network') THEN 'allowed' ELSE 'host' END AS reason FROM v)
SELECT page_id, reason IN ('local', 'allowed') AS ok, reason FROM w""",
    "payload_guard": f"SELECT page_id, CASE WHEN page_id % 7 = 0 THEN 'bad_base64' WHEN url = '' THEN 'empty' ELSE 'ok' END AS verdict, CASE WHEN page_id % 7 <> 0 AND url <> '' THEN CAST(strlen(url) AS BIGINT) END AS n_bytes FROM ({SQL['f7_urls']})",
    "languages": f"SELECT event_id, upper(split_part(lang, '-', 1)) AS base, coalesce(CASE lang {_LANG} END, upper(lang)) AS name, CASE WHEN page_count > 1 THEN CAST(floor((page_idx + 1) * 100.0 / page_count + 0.5) AS INT) END AS pct FROM {V}",
    "chapter_meta": f"SELECT chapter_id, coalesce(body->>'$.relationships[0].attributes.title.en', body->>'$.relationships[0].attributes.title.ja') AS title, CAST(series_id AS VARCHAR) AS manga_id, CASE WHEN chapter_id % 7 = 0 THEN '?' ELSE CAST(chapter_id % 100 AS VARCHAR) END AS chapter, 'vi' AS language, CASE WHEN chapter_id % 3 = 0 THEN '' ELSE 'g' || chapter_id % 5 END AS groups FROM {FEED}",
    "chapter_feed": f"WITH {_ORDERED} SELECT series_id, chapter_id, CAST(n AS INT) AS n FROM o",
    "adjacent": f"WITH {_ORDERED} SELECT series_id, chapter_id, lag(chapter_id) OVER w AS prev_id, lead(chapter_id) OVER w AS next_id FROM o WINDOW w AS (PARTITION BY series_id ORDER BY n)",
    "next_n": f"WITH {_ORDERED} SELECT a.series_id, a.chapter_id AS start_id, CAST(b.n AS INT) AS n, b.chapter_id FROM o a JOIN o b ON a.series_id = b.series_id AND b.n BETWEEN a.n + 1 AND a.n + 3 WHERE a.chapter_id % 5 = 0",
    "page_urls": f"SELECT chapter_id, CAST(n_nationkey AS INT) AS idx, CASE WHEN chapter_id % 2 = 0 THEN 'https://h/data-saver/' || md5(CAST(chapter_id AS VARCHAR)) || '/s' || n_nationkey || '.jpg' ELSE 'https://h/data/' || md5(CAST(chapter_id AS VARCHAR)) || '/p' || n_nationkey || '.png' END AS url FROM {FEED} JOIN nation ON n_nationkey < 4",
    "page_signature": f"WITH {_SIG} SELECT * FROM sig",
    "fresh_drafts": f"WITH {_SIG}, {_FRESH} SELECT region_id, fresh FROM fr",
    "effective_regions": f"WITH {_SIG}, {_FRESH}, k AS (SELECT * FROM fr WHERE fresh) SELECT region_id, tl, 'base' AS origin FROM {R} r WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.chapter_id = r.chapter_id AND k.page_idx = r.page_idx) UNION ALL SELECT region_id, tl, 'draft' FROM k WHERE NOT deleted",
    "drawable": f"SELECT region_id FROM {R} WHERE t <> 'sfx' AND {_TOLD}",
    "retain_ttl": f"SELECT t.region_id FROM ({_TTL}) t JOIN ({SQL['f8_chapters']}) c USING (chapter_id) WHERE target_lang = 'en'",
    "retain_newest": f"SELECT region_id FROM {R} QUALIFY row_number() OVER (PARTITION BY chapter_id ORDER BY saved_at DESC, region_id DESC) <= 3",
    "chapter_list": f"""WITH p AS (SELECT chapter_id, page_idx, bool_or({_TOLD}) AS told, max(saved_at) AS saved_at FROM ({_TTL}) GROUP BY 1, 2),
k AS (SELECT chapter_id, count(*) AS pages, count(*) FILTER (told) AS told_pages, CAST(CAST(max(saved_at) AS DATE) AS VARCHAR) AS saved_at FROM p GROUP BY 1)
SELECT k.*, CASE WHEN title = '' THEN 'Unknown Manga' ELSE title END AS title, coalesce(chapter, '?') AS chapter, coalesce(chapter_title, '') AS chapter_title, coalesce(source_lang, '') AS source_lang, target_lang, manga_id FROM k JOIN ({SQL['f8_chapters']}) USING (chapter_id)""",
    "cache_stats": f"SELECT count(DISTINCT chapter_id) AS entries, CAST(sum(2 * (length(text) + length(tl))) AS BIGINT) AS bytes FROM {R}",
    "export_manifest": f"WITH p AS (SELECT chapter_id, page_idx, count(*) FILTER ({_TOLD} AND t <> 'sfx') AS regions FROM {R} GROUP BY 1, 2) SELECT *, 'Chapter_' || chapter_id AS folder, 'Chapter_' || chapter_id || '_' || lpad(CAST(page_idx + 1 AS VARCHAR), 3, '0') || '.png' AS file, CASE WHEN regions > 0 THEN 'typeset' ELSE 'original' END AS action FROM p",
    "export_status": f"""WITH p AS (SELECT DISTINCT chapter_id, page_idx FROM {R}), m AS (SELECT p.*, f.chapter_id IS NOT NULL AS there, f.error FROM p LEFT JOIN ({SQL['f8_fetched']}) f USING (chapter_id, page_idx)),
t AS (SELECT chapter_id, count(*) AS pages, bool_and(there) AS whole, arg_min(error, page_idx) FILTER (error IS NOT NULL) AS error FROM m GROUP BY 1)
SELECT chapter_id, 'Chapter_' || chapter_id AS folder, pages, CASE WHEN error IS NOT NULL THEN 'error' WHEN whole THEN 'done' ELSE 'open' END AS status, error FROM t""",
    "nearest_context": f"""WITH r AS (SELECT chapter_id, page_idx % 2 AS p, region_id, cx, cy, tl FROM {R}), m AS (SELECT a.chapter_id, a.p, a.region_id AS own, b.* EXCLUDE (chapter_id, p) FROM r a JOIN r b ON a.chapter_id = b.chapter_id AND a.p = b.p AND a.region_id <> b.region_id AND trim(b.tl) NOT IN ('', '—', '-')
QUALIFY row_number() OVER (PARTITION BY a.chapter_id, a.p, a.region_id ORDER BY abs(b.cy - a.cy), b.cy, b.cx, b.region_id) <= 8) SELECT own AS region_id, string_agg(tl, '|' ORDER BY cy, cx, region_id) AS context FROM m GROUP BY own""",
    "legend": f"SELECT region_id, CAST(row_number() OVER (PARTITION BY chapter_id, page_idx ORDER BY region_id) AS INT) AS number FROM {R} WHERE t = 'sign'",
    "seed_boxes": f"SELECT region_id, CASE WHEN {_TOLD} THEN tl ELSE '' END AS tl, CASE WHEN {_TOLD} THEN '' ELSE text END AS text FROM {R}",
    "route_pages": f"""SELECT event_id, mode, has_key, CASE WHEN split_part(lang, '-', 1) = 'es' THEN 'skip' WHEN event_id % 4 = 0 THEN 'cached' WHEN has_key AND mode <> 'off' AND (mode = 'all' OR lang IN ('ja', 'zh', 'zh-hk', 'ko')) THEN 'vision' ELSE 'local' END AS route FROM {V}, (SELECT unnest(['smart', 'all', 'off']) AS mode), (SELECT unnest([true, false]) AS has_key)""",
    "status_summary": f"""WITH i AS (SELECT chapter_id, count(*) FILTER (status = 'done') AS done, count(*) FILTER (status = 'error') AS error, count(*) FILTER (status = 'skipped') AS skipped, count(*) FILTER (status = 'pending') AS open FROM {V} GROUP BY 1), s AS (SELECT chapter_id, sum(chars / 1000.0::DOUBLE) AS spent FROM ({SQL['f4_calls']}) GROUP BY 1)
SELECT i.*, round(coalesce(spent, 0), 6) AS spent, round(coalesce(spent, 0), 9) >= 60 AS over FROM i LEFT JOIN s USING (chapter_id)""",
    "recent": _RECENT.format(n=8),
    "latest": _RECENT.format(n=1),
    "target_codes": f"SELECT event_id, CASE coalesce(CASE lang {_LANG} END, upper(lang)) {_CODES} END AS code FROM {V}",
    "chapter_ids": f"""WITH u AS (SELECT page_id, CASE WHEN page_id % 3 <> 0 THEN md5(url) END AS m, CASE WHEN page_id % 2 = 0 THEN CASE WHEN page_id % 4 = 0 THEN 'shelf' ELSE 'other' END || ':s1:' || page_id ELSE CAST(page_id AS VARCHAR) END AS k FROM ({SQL['f7_urls']}))
SELECT page_id, m[1:8] || '-' || m[9:12] || '-' || m[13:16] || '-' || m[17:20] || '-' || m[21:32] AS uuid, CASE WHEN page_id % 4 = 0 THEN 'shelf' ELSE 'web' END AS kind, CASE WHEN page_id % 4 = 0 THEN split_part(k, ':', 2) END AS series, CASE WHEN page_id % 4 = 0 THEN split_part(k, ':', 3) ELSE k END AS chapter FROM u""",
    "dominant_page": f"SELECT reader_id, CAST(date_trunc('hour', ts) AS TIMESTAMP) AS hour, page_idx FROM {V} WHERE visible > 0 QUALIFY row_number() OVER (PARTITION BY reader_id, date_trunc('hour', ts) ORDER BY visible DESC, event_id) = 1",
    "resolve_choice": f"SELECT event_id, CASE WHEN chapter_id % 5 = 0 THEN 'heavy' WHEN lang = 'ja' THEN 'vision' WHEN lang = 'es' THEN 'light' ELSE 'standard' END AS engine FROM {V}",
}
