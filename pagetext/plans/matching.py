"""Queries over two OCR outputs and engines, with their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagetext.functions.text import fold_text, marked_share
from pagetext.operators import matching as op
from pagetext.plans.fixtures import SQL, fixture


PAGE_W, PAGE_H = 960, 1500
CHUNK = "(?s).{1,60}"
ENGINES = ["heavy", "light"]


def _two(s, d, side):
    rows = op.fill_boxes(fixture(s, d, "f3_two_outputs", bounded=True).where(F.col("side") == side))
    return rows.withColumn("members", F.array(F.col("item_id") * 10, F.col("item_id") * 10 + 1)).withColumn("img_w", F.lit(PAGE_W)).withColumn("img_h", F.lit(PAGE_H))


def _placed(s, d, side):
    return op.rescale_coords(_two(s, d, side))


def _matches(s, d, metric="levenshtein"):
    return op.match_regions(_two(s, d, "a"), _two(s, d, "b"), metric=metric)


def _rounded(df):
    return df.select("side", "page_id", "item_id", *[F.round(c, 6).alias(c) for c in ("cx", "cy", *op.BOX)])


def _lines(s, d):
    """Whole texts as lines of 60 characters, each with a confidence."""
    texts = fixture(s, d, "f15_engine_text")
    lines = texts.select("doc_id", "lang", "engine", F.posexplode(F.regexp_extract_all("text", F.lit(CHUNK), F.lit(0))).alias("line", "text"))
    return lines.withColumn("conf", (F.col("doc_id") * 37 + F.col("line") * 11 + F.length("text")) % 100 / F.lit(100.0))


def _texts(s, d):
    size = F.length("text")
    return fixture(s, d, "f15_engine_text").withColumn("fragments", F.ceil(size / 60)).withColumn("regions", F.ceil(size / 300))


def rescale_coords(s, d):
    return _rounded(op.rescale_coords(fixture(s, d, "f3_two_outputs")))


def fix_right_cluster(s, d):
    return _rounded(op.fill_boxes(op.fix_right_cluster(op.rescale_coords(fixture(s, d, "f3_two_outputs")))))


def matched_regions(s, d):
    found = op.place_matches(_two(s, d, "a"), _two(s, d, "b"))
    return found.select("page_id", "item_id", *[F.round(c, 6).alias(c) for c in ("cx", "cy", *op.BOX)], "conf", F.array_join("members", ",").alias("members"))


def orphans(s, d):
    return op.orphans(_placed(s, d, "a"), op.match_regions(_two(s, d, "a"), _two(s, d, "b"), min_ratio=0.8)).select("page_id", "item_id")


QUERIES = {
    "fold_text": lambda s, d: fixture(s, d, "f3_two_outputs").select("side", "page_id", "item_id", fold_text(F.col("text")).alias("folded")),
    "rescale_coords": rescale_coords,
    "fix_right_cluster": fix_right_cluster,
    "match_candidates": lambda s, d: op.match_candidates(_two(s, d, "a"), _two(s, d, "b")),
    "match_regions": _matches,
    "match_regions_ratcliff": lambda s, d: _matches(s, d, "ratcliff"),
    "matched_regions": matched_regions,
    "orphans": orphans,
    "engine_report": lambda s, d: op.engine_report(_texts(s, d), ENGINES),
    "text_quality": lambda s, d: op.text_quality(_lines(s, d), [*ENGINES, "truth"]),
    "marked_share": lambda s, d: fixture(s, d, "f15_engine_text").select("doc_id", "engine", F.round(marked_share(F.col("text")), 6).alias("marked")),
    "engine_advice": lambda s, d: op.engine_advice(fixture(s, d, "f15_engine_text").select("doc_id", "lang", "engine"), s.createDataFrame([("de", "heavy"), ("fr", "light"), ("es", "absent")], "lang string, advised string"), ENGINES),
    "background_route": lambda s, d: op.background_route(fixture(s, d, "f16_tones")),
}

F3, F15, F16 = (f"({SQL[n].replace('STRING', 'VARCHAR')})" for n in ("f3_two_outputs", "f15_engine_text", "f16_tones"))
_FOLD = "regexp_replace(lower(strip_accents(text)), '[^a-z0-9]+', '', 'g')"
_E1 = "round_even(round({0}, 6), 1)"


def _percent(c: str) -> str:
    plain = c if c[0] == "c" else f"CASE WHEN mode = 'm' THEN {_E1.format(c)} ELSE {c} END"
    low, high = ("1.0", "99.0") if c[0] == "c" else ("0.0", "100.0")
    return f"CASE WHEN {c} IS NOT NULL THEN greatest({low}::DOUBLE, least({high}::DOUBLE, CASE WHEN mode = 'f' OR (mode = 'm' AND {c} < 2) THEN {_E1.format(c + ' * 100')} WHEN mode = 't' THEN {_E1.format(c + ' / 10')} ELSE {plain} END)) END AS {c}"


_SCALED = f"""k AS (SELECT *, max(greatest(cx, cy)) OVER w AS top, min(least(cx, cy)) OVER w AS low, sum(CASE WHEN cx > 100 THEN 1 ELSE 0 END + CASE WHEN cy > 100 THEN 1 ELSE 0 END) OVER w AS large, count(*) OVER w AS n FROM {F3} WINDOW w AS (PARTITION BY side, page_id)),
m AS (SELECT *, CASE WHEN top < 2 THEN 'f' WHEN 2 * large >= 2 * n THEN 't' WHEN top >= 5 AND low < 2 THEN 'm' END AS mode FROM k),
z AS (SELECT side, page_id, item_id, {", ".join(map(_percent, ("cx", "cy", *op.BOX)))} FROM m)"""
_ROUNDED = ", ".join(f"round({c}, 6) AS {c}" for c in ("cx", "cy", *op.BOX))
_FILL = "coalesce(x1, cx - 8) AS x1, coalesce(y1, cy - 5) AS y1, coalesce(x2, cx + 8) AS x2, coalesce(y2, cy + 5) AS y2"


def _pairs(least: float) -> str:
    return f"""f AS MATERIALIZED (SELECT side, page_id, item_id, {_FOLD} AS t FROM {F3}), d AS MATERIALIZED (SELECT side, page_id, item_id, t, length(t) AS n FROM f WHERE length(t) >= 3),
p AS MATERIALIZED (SELECT * FROM (SELECT a.page_id, a.item_id AS a, b.item_id AS b, round(1 - levenshtein(a.t, b.t) / greatest(a.n, b.n)::DOUBLE, 6) AS ratio FROM d a JOIN d b ON a.page_id = b.page_id AND a.side = 'a' AND b.side = 'b' AND least(a.n, b.n) >= {least} * greatest(a.n, b.n) - 1e-6) WHERE ratio >= {least}),
o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY ratio DESC, a, b) AS k FROM p),
w AS (SELECT page_id, k, a, b, ratio, [a] AS ua, [b] AS ub, true AS won FROM o WHERE k = 1 UNION ALL
  SELECT o.page_id, o.k, o.a, o.b, o.ratio, CASE WHEN list_contains(ua, o.a) OR list_contains(ub, o.b) THEN ua ELSE list_append(ua, o.a) END, CASE WHEN list_contains(ua, o.a) OR list_contains(ub, o.b) THEN ub ELSE list_append(ub, o.b) END, NOT (list_contains(ua, o.a) OR list_contains(ub, o.b))
  FROM w JOIN o ON o.page_id = w.page_id AND o.k = w.k + 1),
won AS MATERIALIZED (SELECT page_id, a, b, ratio FROM w WHERE won)"""


_LINES = f"""c AS (SELECT doc_id, lang, engine, regexp_extract_all(text, '{CHUNK}') AS parts FROM {F15}),
l AS MATERIALIZED (SELECT doc_id, lang, engine, unnest(range(len(parts))) AS line, unnest(parts) AS text FROM c), n AS MATERIALIZED (SELECT *, {_FOLD} AS folded FROM l)"""
_FLOOR = "CASE l.lang WHEN 'vi' THEN 0.25::DOUBLE WHEN 'ko' THEN 0.3::DOUBLE WHEN 'pt' THEN 0.3::DOUBLE ELSE 0.35::DOUBLE END"

ORACLES = {
    "fold_text": f"SELECT side, page_id, item_id, {_FOLD} AS folded FROM {F3}",
    "rescale_coords": f"WITH {_SCALED} SELECT side, page_id, item_id, {_ROUNDED} FROM z",
    "fix_right_cluster": f"""WITH {_SCALED}, s AS (SELECT *, count(*) OVER w >= 2 AND avg(CASE WHEN cx > 85 THEN 1.0 ELSE 0.0 END) OVER w >= 0.7 AS stuck, max(cy) OVER w - min(cy) OVER w < 10 AS flat, row_number() OVER (PARTITION BY side, page_id ORDER BY item_id) - 1 AS k, count(*) OVER w AS n FROM z WINDOW w AS (PARTITION BY side, page_id)),
t AS (SELECT side, page_id, item_id, stuck, flat, CASE WHEN stuck THEN 8.0::DOUBLE ELSE cx END AS cx, CASE WHEN stuck AND flat THEN {_E1.format("5 + k * (90.0::DOUBLE / (n - 1))")} ELSE cy END AS cy, x1, y1, x2, y2 FROM s),
u AS (SELECT side, page_id, item_id, cx, cy, CASE WHEN stuck THEN 3.0::DOUBLE ELSE x1 END AS x1, CASE WHEN stuck AND flat THEN cy - 3.5 WHEN stuck THEN greatest(1.0::DOUBLE, cy - 3.5) ELSE y1 END AS y1, CASE WHEN stuck THEN 13.0::DOUBLE ELSE x2 END AS x2, CASE WHEN stuck AND flat THEN cy + 3.5 WHEN stuck THEN least(99.0::DOUBLE, cy + 3.5) ELSE y2 END AS y2 FROM t),
v AS (SELECT side, page_id, item_id, cx, cy, {_FILL} FROM u) SELECT side, page_id, item_id, {_ROUNDED} FROM v""",
    "match_candidates": f"WITH RECURSIVE {_pairs(0.45)} SELECT page_id, a, b, ratio FROM p",
    "match_regions": f"WITH RECURSIVE {_pairs(0.45)} SELECT * FROM won",
    "matched_regions": f"""WITH RECURSIVE {_pairs(0.45)}, x AS (SELECT side, page_id, item_id, cx, cy, conf, {_FILL} FROM {F3})
SELECT a.page_id, a.item_id, {", ".join(f"round(CASE WHEN b.item_id IS NULL THEN a.{c} ELSE b.{c} END, 6) AS {c}" for c in ("cx", "cy", *op.BOX))}, b.conf, coalesce((b.item_id * 10) || ',' || (b.item_id * 10 + 1), CAST(-1 - a.item_id AS VARCHAR)) AS members
FROM x a LEFT JOIN won ON won.page_id = a.page_id AND won.a = a.item_id LEFT JOIN x b ON b.side = 'b' AND b.page_id = a.page_id AND b.item_id = won.b WHERE a.side = 'a'""",
    "orphans": f"""WITH RECURSIVE {_pairs(0.8)}, f3b AS (SELECT side, page_id, item_id, cx, cy, {_FILL} FROM {F3}), {_SCALED.replace(f"FROM {F3}", "FROM f3b")},
r AS (SELECT z.* FROM z WHERE side = 'a' AND NOT EXISTS (SELECT 1 FROM won WHERE won.page_id = z.page_id AND won.a = z.item_id) QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY item_id) <= 4)
SELECT page_id, item_id FROM r WHERE (x2 - x1) / 100 * {PAGE_W} >= 6 AND (y2 - y1) / 100 * {PAGE_H} >= 6""",
    "engine_report": "SELECT lang, " + ", ".join(f"count(*) FILTER (engine = '{e}') AS {e}_files, CAST(sum(ceil(length(text) / 60)) FILTER (engine = '{e}' AND error IS NULL) AS BIGINT) AS {e}_fragments, CAST(sum(ceil(length(text) / 300)) FILTER (engine = '{e}' AND error IS NULL) AS BIGINT) AS {e}_regions, CAST(sum(length(text)) FILTER (engine = '{e}' AND error IS NULL) AS BIGINT) AS {e}_chars, round(sum(millis) FILTER (engine = '{e}') / 1000, 3) AS {e}_seconds, count(error) FILTER (engine = '{e}') AS {e}_errors" for e in ENGINES) + f" FROM {F15} GROUP BY 1",
    "text_quality": f"""WITH {_LINES}, e AS (SELECT unnest(['heavy', 'light', 'truth']) AS engine), t AS (SELECT doc_id, line, lang, folded AS real, e.engine FROM n, e WHERE n.engine = 'truth'),
j AS (SELECT t.lang, t.engine, t.real, l.text, l.folded, (l.doc_id * 37 + l.line * 11 + length(l.text)) % 100 / 100.0::DOUBLE AS conf, {_FLOOR} AS floor FROM t LEFT JOIN n l ON l.doc_id = t.doc_id AND l.line = t.line AND l.engine = t.engine)
SELECT lang, engine, round(sum(length(regexp_replace(text, '[^À-ɏḀ-ỿ]', '', 'g'))) / sum(length(regexp_replace(text, '[^A-Za-zÀ-ɏḀ-ỿ]', '', 'g'))), 6) AS marked, round(avg(CASE WHEN text IS NULL THEN 0 WHEN folded = '' AND real = '' THEN 1 ELSE 1 - levenshtein(folded, real) / greatest(length(folded), length(real))::DOUBLE END), 6) AS similarity, round(avg(CASE WHEN text IS NOT NULL THEN CASE WHEN conf < floor THEN 1.0 ELSE 0.0 END END), 6) AS dropped FROM j GROUP BY 1, 2""",
    "marked_share": f"""SELECT doc_id, engine, round(length(regexp_replace(text, '[^À-ɏḀ-ỿ]', '', 'g'))::DOUBLE / nullif(length(regexp_replace(text, '[^A-Za-zÀ-ɏḀ-ỿ]', '', 'g')), 0), 6) AS marked FROM {F15}""",
    "engine_advice": f"SELECT doc_id, lang, engine, CASE WHEN lang = 'de' AND engine <> 'heavy' THEN 'heavy' WHEN lang = 'fr' AND engine <> 'light' THEN 'light' END AS advice FROM {F15}",
    "background_route": f"""WITH r AS (SELECT region_id, tone, n, sum(n) OVER (PARTITION BY region_id ORDER BY tone) AS below, sum(n) OVER (PARTITION BY region_id) AS all_n FROM {F16}), m AS (SELECT *, min(CASE WHEN 2 * below >= all_n THEN tone END) OVER (PARTITION BY region_id) AS median FROM r)
SELECT region_id, median, CASE WHEN sum(CASE WHEN abs(tone - median) <= 18 THEN n ELSE 0 END) / sum(n)::DOUBLE >= 0.85 THEN 'flat' ELSE 'inpaint' END AS route, CASE WHEN sum(tone * n) / sum(n)::DOUBLE < 128 THEN 'white' ELSE 'black' END AS label FROM m GROUP BY 1, 2""",
}
