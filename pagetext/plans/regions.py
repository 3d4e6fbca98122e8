"""Queries over fragments and regions, with their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagetext.operators import fragments as op
from pagetext.plans.fixtures import SQL, fixture

F1, F2 = SQL["f1_fragments"], SQL["f2_borders"]
_K = "CASE WHEN CAST(img_h AS DOUBLE) / img_w > 2 THEN 0.6::DOUBLE ELSE 1.0::DOUBLE END"
_REACH = f"""m AS (SELECT *, greatest(4, CAST(trunc((y2 - y1) * (s * 1.6::DOUBLE * {_K})) AS INT)) AS mv, greatest(4, CAST(trunc((y2 - y1) * (s * 0.3::DOUBLE * {_K})) AS INT)) AS mh FROM f),
p AS (SELECT a.page_id, a.s, a.frag_id AS a, b.frag_id AS b, a.x1 AS ax1, a.y1 AS ay1, a.x2 AS ax2, a.y2 AS ay2, b.x1 AS bx1, b.y1 AS by1, b.x2 AS bx2, b.y2 AS by2
  FROM m a JOIN m b ON a.page_id = b.page_id AND a.s = b.s AND a.frag_id < b.frag_id AND a.x1 - a.mh <= b.x2 + b.mh AND b.x1 - b.mh <= a.x2 + a.mh AND a.y1 - a.mv <= b.y2 + b.mv AND b.y1 - b.mv <= a.y2 + a.mv)"""
_FRAGS = f"f AS (SELECT *, 0.5::DOUBLE AS s FROM ({F1}))"
_BORDERED = f"""v AS (SELECT p.* FROM p WHERE NOT EXISTS (SELECT 1 FROM ({F2}) r WHERE r.page_id = p.page_id AND ((r.axis = 'h' AND r.pos > least(ay2, by2) AND r.pos < greatest(ay1, by1)) OR (r.axis = 'v' AND r.pos > least(ax2, bx2) AND r.pos < greatest(ax1, bx1)))))"""


def _components(edges: str) -> str:
    return f"""e AS (SELECT page_id, s, a, b FROM {edges} UNION ALL SELECT page_id, s, b, a FROM {edges}),
w AS (SELECT page_id, s, frag_id, frag_id AS root FROM f UNION SELECT w.page_id, w.s, e.b, w.root FROM w JOIN e ON e.page_id = w.page_id AND e.s = w.s AND e.a = w.frag_id WHERE w.root < e.b),
g AS (SELECT page_id, s, frag_id, min(root) AS group_id FROM w GROUP BY 1, 2, 3)"""


_FLOOR = "CASE lang WHEN 'vi' THEN 0.25::DOUBLE WHEN 'ko' THEN 0.3::DOUBLE WHEN 'pt' THEN 0.3::DOUBLE ELSE 0.35::DOUBLE END"


def merge_margins(spark, d):
    return op.merge_margins(fixture(spark, d, "f1_fragments")).select("page_id", "frag_id", "margin_v", "margin_h")


def overlap_pairs(spark, d):
    return op.overlap_pairs(op.merge_margins(fixture(spark, d, "f1_fragments")))


def veto_pairs(spark, d):
    frags = fixture(spark, d, "f1_fragments")
    return op.veto_pairs(op.overlap_pairs(op.merge_margins(frags)), frags, fixture(spark, d, "f2_borders"))


def gap_bands(spark, d):
    frags = fixture(spark, d, "f1_fragments")
    return op.gap_band(op.with_boxes(op.overlap_pairs(op.merge_margins(frags)), frags)).select("page_id", "a", "b", "gx1", "gy1", "gx2", "gy2")


def group_components(spark, d):
    return op.grouped_fragments(fixture(spark, d, "f1_fragments")).select("page_id", "frag_id", "group_id")


def group_components_bordered(spark, d):
    return op.grouped_fragments(fixture(spark, d, "f1_fragments"), borders=fixture(spark, d, "f2_borders")).select("page_id", "frag_id", "group_id")


def filter_by_confidence(spark, d):
    return op.filter_by_confidence(op.with_floor(op.grouped_fragments(fixture(spark, d, "f1_fragments")))).select("page_id", "group_id", "frag_id")


def region_boxes(spark, d):
    """Regions without their text order: box, centre, confidence and number of members."""
    return op.region_boxes(fixture(spark, d, "f1_fragments"), borders=fixture(spark, d, "f2_borders"))


def merge_regions(spark, d):
    return op.merge_regions(fixture(spark, d, "f1_fragments"), borders=fixture(spark, d, "f2_borders")).withColumn("members", F.array_join("members", ","))


def line_ids(spark, d):
    return op.line_ids(op.grouped_fragments(fixture(spark, d, "f1_fragments")))


def _wide(spark, d):
    """Two orders of a page as a group: the first and the last stand side by side, in two columns."""
    side = F.when(F.floor(F.col("frag_id") / 100).isin(0, 3), 0).otherwise(1).cast("bigint")
    return op.order_fragments(fixture(spark, d, "f1_fragments").withColumn("group_id", side))


def column_split(spark, d):
    return _wide(spark, d).select("page_id", "group_id", "split")


def order_fragments(spark, d):
    return _wide(spark, d).select("page_id", "group_id", F.posexplode_outer("ordered").alias("p", "m")).select("page_id", "group_id", F.col("m.id").alias("frag_id"), (F.col("p") + 1).alias("pos"))


def merge_sweep(spark, d):
    return op.merge_sweep(fixture(spark, d, "f1_fragments"), [0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0, 1.2], 0.5)


def diff_regions(spark, d):
    frags = fixture(spark, d, "f1_fragments")
    shape = lambda g: g.groupBy("page_id", "group_id").agg(F.array_sort(F.collect_list("frag_id")).alias("members"), F.lit("").alias("text"))
    return op.diff_regions(shape(op.grouped_fragments(frags)), shape(op.grouped_fragments(frags, borders=fixture(spark, d, "f2_borders"))))


def short_text_floor(spark, d):
    return op.short_text_floor(fixture(spark, d, "f1_fragments")).select("page_id", "frag_id")


def language_floor(spark, d):
    return op.with_floor(fixture(spark, d, "f1_fragments")).select("page_id", "frag_id", "hard_script", "min_conf")


def box_to_pct(spark, d):
    return op.box_to_pct(fixture(spark, d, "f1_fragments")).select("page_id", "frag_id", "pct_x1", "pct_y1", "pct_x2", "pct_y2", "cx", "cy")


def box_to_px(spark, d):
    pct = op.box_to_pct(fixture(spark, d, "f1_fragments")).select("page_id", "frag_id", "img_w", "img_h", *[F.col(f"pct_{c}").alias(c) for c in ("x1", "y1", "x2", "y2")])
    return op.box_to_px(pct).select("page_id", "frag_id", "px_x1", "px_y1", "px_x2", "px_y2")


def _regions(spark, d):
    frags = op.box_to_pct(fixture(spark, d, "f1_fragments"))
    return frags.select("page_id", F.col("frag_id").alias("region_id"), "cx", "cy", "x1", "y1", "x2", "y2", (F.col("frag_id") % 6 == 0).alias("deleted"), F.when(F.col("frag_id") % 5 == 0, "—").otherwise(F.col("text")).alias("tl"))


def best_iou(spark, d):
    r = _regions(spark, d)
    boxes = r.select("page_id", F.col("region_id").alias("box_id"), (F.col("x1") + 6).alias("x1"), (F.col("y1") + 3).alias("y1"), (F.col("x2") + 6).alias("x2"), (F.col("y2") + 3).alias("y2"))
    return op.best_iou(boxes, r)


def point_in_box(spark, d):
    r = _regions(spark, d)
    boxes = r.select("page_id", F.col("region_id").alias("box_id"), (F.col("cx") - 6).alias("x1"), (F.col("cy") - 2).alias("y1"), (F.col("cx") + 6).alias("x2"), (F.col("cy") + 2).alias("y2"))
    return op.point_in_box(boxes, r)


def reading_order(spark, d):
    return op.reading_order(_regions(spark, d), F.col("page_id") % 2 == 0)


QUERIES = {f.__name__: f for f in (merge_margins, overlap_pairs, veto_pairs, gap_bands, group_components, group_components_bordered, filter_by_confidence, region_boxes, merge_regions, line_ids, column_split, order_fragments, merge_sweep, diff_regions, short_text_floor, language_floor, box_to_pct, box_to_px, best_iou, point_in_box, reading_order)}

_PCT = "round_even(round({0} / {1} * 100, 6), 1)"
_BOX = ", ".join(f"{_PCT.format(c, 'img_w' if c[0] == 'x' else 'img_h')} AS pct_{c}" for c in ("x1", "y1", "x2", "y2"))
_CENTRE = "round_even(round((x1 + x2) / 2 / img_w * 100, 6), 1) AS cx, round_even(round((y1 + y2) / 2 / img_h * 100, 6), 1) AS cy"
_REGIONS = f"r AS (SELECT page_id, frag_id AS region_id, {_CENTRE}, x1, y1, x2, y2, frag_id % 6 = 0 AS deleted, CASE WHEN frag_id % 5 = 0 THEN '—' ELSE text END AS tl FROM ({F1}))"
_KEPT = f"""q AS (SELECT f.*, g.group_id, {_FLOOR} AS mc FROM f JOIN g USING (page_id, frag_id)),
k AS (SELECT *, max(CASE WHEN conf >= mc THEN 1 ELSE 0 END) OVER (PARTITION BY page_id, group_id) AS sure FROM q),
c AS (SELECT * FROM k WHERE conf >= CASE WHEN sure = 1 THEN 0.1::DOUBLE ELSE mc END)"""

_KEYS = "page_id, group_id, side"
_WIDE = f"wide AS MATERIALIZED (SELECT *, CAST(CASE WHEN floor(frag_id / 100) IN (0, 3) THEN 0 ELSE 1 END AS BIGINT) AS group_id FROM ({F1}))"


def _ordered(frags: str) -> str:
    """CTEs of the fragments of groups by line, and in reading order (od), from a table with group_id."""
    return f"""b0 AS (SELECT page_id, group_id, min(x1) AS gx, max(x2) - min(x1) AS gw, count(*) AS gn FROM {frags} GROUP BY 1, 2),
b1 AS (SELECT t.page_id, t.group_id, gx, gw, greatest(CAST(trunc((x1 - gx) * (200 / gw)) AS INT), 0) AS a, least(CAST(trunc((x2 - gx) * (200 / gw)) AS INT), 200) AS b FROM {frags} t JOIN b0 USING (page_id, group_id) WHERE gn >= 4 AND gw > 0),
b2 AS (SELECT *, coalesce(max(b) OVER (PARTITION BY page_id, group_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) + 1 AS s FROM b1),
b3 AS (SELECT page_id, group_id, gx + (s + a) / 2 / (200 / gw) AS cut FROM b2 WHERE a - s >= 6 QUALIFY row_number() OVER (PARTITION BY page_id, group_id ORDER BY a - s DESC, a, b) = 1),
sd AS (SELECT t.*, 'w' AS side FROM {frags} t UNION ALL SELECT t.*, CASE WHEN (x1 + x2) / 2 < cut THEN 'l' ELSE 'r' END FROM {frags} t JOIN b3 USING (page_id, group_id)),
n0 AS MATERIALIZED (SELECT *, (y1 + y2) / 2 AS yc, y2 - y1 AS fh, row_number() OVER (PARTITION BY {_KEYS} ORDER BY (y1 + y2) / 2, frag_id) AS k FROM sd),
fold AS (SELECT {_KEYS}, k, [{{'c': yc, 'h': fh, 'n': 1}}] AS ls, CAST(1 AS BIGINT) AS line FROM n0 WHERE k = 1 UNION ALL
  SELECT {_KEYS}, k, CASE WHEN hit > 0 THEN list_transform(ls, lambda l, i: CASE WHEN i = hit THEN {{'c': l.c + yc, 'h': l.h + fh, 'n': l.n + 1}} ELSE l END) ELSE list_append(ls, {{'c': yc, 'h': fh, 'n': 1}}) END, CASE WHEN hit > 0 THEN hit ELSE len(ls) + 1 END
  FROM (SELECT n.page_id, n.group_id, n.side, n.k, n.yc, n.fh, w.ls, CAST(coalesce(list_position(list_transform(w.ls, lambda l: abs(n.yc - l.c / l.n) <= 0.5 * greatest(n.fh, l.h / l.n)), true), 0) AS BIGINT) AS hit FROM fold w JOIN n0 n ON n.page_id = w.page_id AND n.group_id = w.group_id AND n.side = w.side AND n.k = w.k + 1)),
ln AS MATERIALIZED (SELECT n0.*, fold.line FROM n0 JOIN fold USING (page_id, group_id, side, k)),
tp AS (SELECT *, min(y1) OVER (PARTITION BY {_KEYS}, line) AS top FROM ln),
lm AS (SELECT {_KEYS}, line, (min(y1) + max(y2)) / 2 AS mid FROM ln GROUP BY {_KEYS}, line),
sm AS (SELECT {_KEYS}, min(y1) AS t0, max(y2) AS t1, count(*) AS m, count(DISTINCT line) AS lines FROM ln GROUP BY {_KEYS}),
s2 AS (SELECT l.page_id, l.group_id, l.m AS lm, r.m AS rm, l.t0 AS l0, l.t1 AS l1, r.t0 AS r0, r.t1 AS r1, l.lines AS ll, r.lines AS rl FROM sm l JOIN sm r ON l.page_id = r.page_id AND l.group_id = r.group_id AND l.side = 'l' AND r.side = 'r'),
s3 AS (SELECT s2.page_id, s2.group_id, count(*) FILTER (lm.side = 'l' AND mid BETWEEN r0 AND r1) AS in_r, count(*) FILTER (lm.side = 'r' AND mid BETWEEN l0 AND l1) AS in_l FROM s2 JOIN lm ON lm.page_id = s2.page_id AND lm.group_id = s2.group_id GROUP BY 1, 2),
sp AS (SELECT page_id, group_id, lm >= 2 AND rm >= 2 AND greatest(0, least(l1, r1) - greatest(l0, r0)) / nullif(least(l1 - l0, r1 - r0), 0) >= 0.7 AND CASE WHEN ll <= rl THEN ll >= in_l ELSE rl >= in_r END AS split FROM s2 JOIN s3 USING (page_id, group_id)),
od AS (SELECT tp.*, coalesce(split, false) AS split, row_number() OVER w AS pos, count(*) OVER (PARTITION BY page_id, group_id) AS all_n FROM tp LEFT JOIN sp USING (page_id, group_id) WHERE CASE WHEN coalesce(split, false) THEN side <> 'w' ELSE side = 'w' END WINDOW w AS (PARTITION BY page_id, group_id ORDER BY side, top, line, x1, k))"""


_ASSEMBLED = f"""o AS (SELECT page_id, group_id, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2, round_even(min(conf), 3) AS confidence, min(img_w) AS img_w, min(img_h) AS img_h, string_agg(CAST(frag_id AS VARCHAR), ',' ORDER BY pos) AS members,
  string_agg(CASE WHEN pos = all_n THEN text WHEN ends_with(text, '-') THEN left(text, length(text) - 1) ELSE text || ' ' END, '' ORDER BY pos) AS text FROM od GROUP BY 1, 2)
SELECT page_id, group_id, text, {_CENTRE}, {_BOX.replace('pct_', '')}, confidence, members FROM o"""
MERGED = f"WITH RECURSIVE {_FRAGS}, {_REACH}, {_components('p')}, {_KEPT}, {_ordered('c')}, {_ASSEMBLED}"

ORACLES = {
    "merge_regions": f"WITH RECURSIVE {_FRAGS}, {_REACH}, {_BORDERED}, {_components('v')}, {_KEPT}, {_ordered('c')}, {_ASSEMBLED}",
    "line_ids": f"WITH RECURSIVE {_FRAGS}, {_REACH}, {_components('p')}, q AS (SELECT f.*, g.group_id FROM f JOIN g USING (page_id, frag_id)), {_ordered('q')} SELECT page_id, group_id, frag_id, CAST(dense_rank() OVER (PARTITION BY page_id, group_id ORDER BY top, line) AS INT) AS line FROM tp WHERE side = 'w'",
    "column_split": f"WITH RECURSIVE {_WIDE}, {_ordered('wide')} SELECT DISTINCT page_id, group_id, split FROM od",
    "order_fragments": f"WITH RECURSIVE {_WIDE}, {_ordered('wide')} SELECT page_id, group_id, frag_id, CAST(pos AS INT) AS pos FROM od",
    "merge_margins": f"WITH {_FRAGS}, {_REACH} SELECT page_id, frag_id, mv AS margin_v, mh AS margin_h FROM m",
    "overlap_pairs": f"WITH {_FRAGS}, {_REACH} SELECT page_id, a, b FROM p",
    "veto_pairs": f"WITH {_FRAGS}, {_REACH}, {_BORDERED} SELECT page_id, a, b FROM v",
    "gap_bands": f"""WITH {_FRAGS}, {_REACH}, z AS (SELECT page_id, a, b, greatest(ax1, bx1) AS l, least(ax2, bx2) AS r, least(ay2, by2) AS t, greatest(ay1, by1) AS u FROM p)
SELECT page_id, a, b, CASE WHEN r > l AND u > t THEN l END AS gx1, CASE WHEN r > l AND u > t THEN t END AS gy1, CASE WHEN r > l AND u > t THEN r END AS gx2, CASE WHEN r > l AND u > t THEN u END AS gy2 FROM z""",
    "group_components": f"WITH RECURSIVE {_FRAGS}, {_REACH}, {_components('p')} SELECT page_id, frag_id, group_id FROM g",
    "group_components_bordered": f"WITH RECURSIVE {_FRAGS}, {_REACH}, {_BORDERED}, {_components('v')} SELECT page_id, frag_id, group_id FROM g",
    "filter_by_confidence": f"WITH RECURSIVE {_FRAGS}, {_REACH}, {_components('p')}, {_KEPT} SELECT page_id, group_id, frag_id FROM c",
    "region_boxes": f"""WITH RECURSIVE {_FRAGS}, {_REACH}, {_BORDERED}, {_components('v')}, {_KEPT},
o AS (SELECT page_id, group_id, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2, round_even(min(conf), 3) AS confidence, count(*) AS n, min(img_w) AS img_w, min(img_h) AS img_h FROM c GROUP BY 1, 2)
SELECT page_id, group_id, {_CENTRE}, {_BOX.replace('pct_', '')}, confidence, n FROM o""",
    "merge_sweep": f"""WITH RECURSIVE f AS (SELECT *, s FROM ({F1}), (SELECT unnest([0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0, 1.2])::DOUBLE AS s)), {_REACH}, {_components('p')},
h AS (SELECT s, page_id, count(*) AS fragments, count(DISTINCT group_id) AS regions, string_agg(frag_id || ':' || group_id, ',' ORDER BY frag_id) AS shape FROM g GROUP BY 1, 2)
SELECT h.s AS scale, CAST(sum(h.regions) AS BIGINT) AS regions, CAST(sum(h.fragments) AS BIGINT) AS fragments, count(*) FILTER (h.shape <> b.shape) AS changed_pages FROM h JOIN h b ON b.page_id = h.page_id AND b.s = 0.5::DOUBLE GROUP BY 1""",
    "diff_regions": f"""WITH RECURSIVE {_FRAGS}, {_REACH}, {_BORDERED}, {_components('p')},
e2 AS (SELECT page_id, a, b FROM v UNION ALL SELECT page_id, b, a FROM v),
w2 AS (SELECT page_id, frag_id, frag_id AS root FROM f UNION SELECT w2.page_id, e2.b, w2.root FROM w2 JOIN e2 ON e2.page_id = w2.page_id AND e2.a = w2.frag_id WHERE w2.root < e2.b),
g2 AS (SELECT page_id, frag_id, min(root) AS group_id FROM w2 GROUP BY 1, 2),
x AS (SELECT page_id, count(DISTINCT group_id) AS n, string_agg(frag_id || ':' || group_id, ',' ORDER BY frag_id) AS shape FROM g GROUP BY 1),
y AS (SELECT page_id, count(DISTINCT group_id) AS n, string_agg(frag_id || ':' || group_id, ',' ORDER BY frag_id) AS shape FROM g2 GROUP BY 1)
SELECT x.page_id, CASE WHEN x.shape = y.shape THEN 'unchanged' WHEN y.n > x.n THEN 'split' WHEN y.n < x.n THEN 'merged' ELSE 'regrouped' END AS change FROM x JOIN y USING (page_id)""",
    "short_text_floor": f"SELECT page_id, frag_id FROM ({F1}) WHERE length(trim(text)) > 0 AND NOT (length(trim(text)) <= 2 AND conf < 0.12)",
    "language_floor": f"SELECT page_id, frag_id, lang IN ('ja', 'zh', 'zh-hk', 'ko', 'th', 'ar') AS hard_script, {_FLOOR} AS min_conf FROM ({F1})",
    "box_to_pct": f"SELECT page_id, frag_id, {_BOX}, {_CENTRE} FROM ({F1})",
    "box_to_px": f"""WITH q AS (SELECT page_id, frag_id, img_w, img_h, {_BOX} FROM ({F1})),
a AS (SELECT *, greatest(0, least(CAST(round_even(round(pct_x1 * img_w / 100, 6), 0) AS INT), img_w - 1)) AS px_x1, greatest(0, least(CAST(round_even(round(pct_y1 * img_h / 100, 6), 0) AS INT), img_h - 1)) AS px_y1 FROM q)
SELECT page_id, frag_id, px_x1, px_y1, least(img_w, greatest(CAST(round_even(round(pct_x2 * img_w / 100, 6), 0) AS INT), px_x1 + 1)) AS px_x2, least(img_h, greatest(CAST(round_even(round(pct_y2 * img_h / 100, 6), 0) AS INT), px_y1 + 1)) AS px_y2 FROM a""",
    "best_iou": f"""WITH {_REGIONS}, b AS (SELECT page_id, region_id AS box_id, x1 + 6 AS x1, y1 + 3 AS y1, x2 + 6 AS x2, y2 + 3 AS y2 FROM r),
i AS (SELECT b.page_id, box_id, region_id, least(b.x2, r.x2) - greatest(b.x1, r.x1) AS w, least(b.y2, r.y2) - greatest(b.y1, r.y1) AS h, (b.x2 - b.x1) * (b.y2 - b.y1) + (r.x2 - r.x1) * (r.y2 - r.y1) AS ab FROM b JOIN r ON b.page_id = r.page_id AND NOT deleted),
u AS (SELECT page_id, box_id, region_id, w * h / (ab - w * h) AS iou FROM i WHERE w > 0 AND h > 0)
SELECT page_id, box_id, region_id, iou FROM u WHERE iou > 0.35 QUALIFY row_number() OVER (PARTITION BY page_id, box_id ORDER BY iou DESC, region_id) = 1""",
    "point_in_box": f"""WITH {_REGIONS} SELECT b.page_id, b.region_id AS box_id, r.region_id FROM r b JOIN r ON b.page_id = r.page_id AND r.tl <> '—' AND r.cx BETWEEN b.cx - 6 AND b.cx + 6 AND r.cy BETWEEN b.cy - 2 AND b.cy + 2
QUALIFY row_number() OVER (PARTITION BY b.page_id, b.region_id ORDER BY (r.x2 - r.x1) * (r.y2 - r.y1), r.region_id) = 1""",
    "reading_order": f"""WITH RECURSIVE {_REGIONS}, n AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY cy, cx, region_id) AS k FROM r),
w AS (SELECT page_id, region_id, cx, cy, k, cy AS start, 1 AS band FROM n WHERE k = 1 UNION ALL SELECT n.page_id, n.region_id, n.cx, n.cy, n.k, CASE WHEN n.cy - w.start >= 8 THEN n.cy ELSE w.start END, CASE WHEN n.cy - w.start >= 8 THEN w.band + 1 ELSE w.band END FROM w JOIN n ON n.page_id = w.page_id AND n.k = w.k + 1)
SELECT page_id, region_id, band, CAST(row_number() OVER (PARTITION BY page_id ORDER BY band, CASE WHEN page_id % 2 = 0 THEN -cx ELSE cx END, cy, region_id) AS INT) AS pos FROM w""",
}
