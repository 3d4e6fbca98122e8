"""Queries over run tables, with their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagetext.operators import runs as op
from pagetext.operators.graph import kept
from pagetext.plans.fixtures import SQL, fixture

WIDTH, HEIGHT = 460, 32


def _mask(s, d):
    return fixture(s, d, "f13_mask_runs")


def _boxes(s, d):
    return fixture(s, d, "f13_boxes")


def _pages(s, d):
    return _mask(s, d).select("page_id").distinct().withColumn("w", F.lit(WIDTH)).withColumn("h", F.lit(HEIGHT))


def _labelled(s, d):
    return op.components_of_runs(_mask(s, d))


def _filled(s, d):
    return op.fill_holes(_mask(s, d), _pages(s, d))


def components_of_runs(s, d):
    return _labelled(s, d)


def fill_holes(s, d):
    return _filled(s, d).groupBy("page_id", "label").agg(F.sum(F.col("x1") - F.col("x0") + 1).alias("pixels"))


def column_extents(s, d):
    return op.column_extents(_labelled(s, d))


def box_label(s, d):
    return op.box_label(_boxes(s, d), _labelled(s, d), pad=2).select("page_id", "box_id", "label")


def box_coverage(s, d):
    return op.box_coverage(_boxes(s, d), _filled(s, d)).select("page_id", "box_id", "label", F.round("share", 6).alias("share"))


def container_veto(s, d):
    return op.container_veto(_boxes(s, d), _filled(s, d), inside=0.5, outside=0.3)


def waist_veto(s, d):
    return op.waist_veto(_boxes(s, d), _labelled(s, d)).select("page_id", "a", "b", F.round("ratio", 6).alias("ratio"))


def path_label_veto(s, d):
    return op.path_label_veto(_boxes(s, d), _labelled(s, d))


def panel_borders(s, d):
    return op.panel_borders(fixture(s, d, "f14_ink_runs").where("level = 'dark'"), F.lit(280), apart=2)


def gap_profile_veto(s, d):
    return op.gap_profile_veto(fixture(s, d, "f14_bands"), fixture(s, d, "f14_ink_runs")).select("page_id", "gy1", "band_id", "veto")


def residual_check(s, d):
    before, boxes = kept(_mask(s, d)), kept(_boxes(s, d))  # read twice each
    after = before.where("y % 4 < 3").select("page_id", "y", (F.col("x0") + 5).alias("x0"), "x1")
    return op.residual_check(before, after, boxes).select("page_id", "box_id", "pixels", "blob", "share", "flagged")


QUERIES = {f.__name__: f for f in (components_of_runs, fill_holes, column_extents, box_label, box_coverage, container_veto, waist_veto, path_label_veto, panel_borders, gap_profile_veto, residual_check)}

_BOXES = f"({SQL['f13_boxes']})"
_INK = f"({SQL['f14_ink_runs']})"
_N = f"n AS MATERIALIZED ({SQL['f13_mask_runs']})"


def _labels(source: str, name: str, reach: int) -> str:
    """CTEs that label the runs of `source` as `name`: the least node that a path of touching runs reaches."""
    return f"""{name}_n AS MATERIALIZED (SELECT page_id, y, x0, x1, (CAST(y AS BIGINT) + 1) * 4294967296 + x0 AS node FROM {source}),
{name}_e AS MATERIALIZED (SELECT a.page_id, a.node AS a, b.node AS b FROM {name}_n a JOIN {name}_n b ON a.page_id = b.page_id AND b.y = a.y + 1 AND b.x0 <= a.x1 + {reach} AND b.x1 >= a.x0 - {reach}),
{name}_u AS MATERIALIZED (SELECT page_id, a, b FROM {name}_e UNION ALL SELECT page_id, b, a FROM {name}_e),
{name}_w AS (SELECT page_id, node, node AS root FROM {name}_n UNION SELECT w.page_id, u.b, w.root FROM {name}_w w JOIN {name}_u u ON u.page_id = w.page_id AND u.a = w.node WHERE w.root < u.b),
{name} AS MATERIALIZED (SELECT n.page_id, n.y, n.x0, n.x1, min(w.root) AS label FROM {name}_n n JOIN {name}_w w ON n.page_id = w.page_id AND n.node = w.node GROUP BY 1, 2, 3, 4)"""


_L = f"{_N}, {_labels('n', 'l', 1)}"
_FILLED = f"""{_N}, lines AS (SELECT DISTINCT page_id FROM n),
ends AS (SELECT page_id, unnest(range({HEIGHT})) AS y, -1 AS x0, -1 AS x1 FROM lines UNION ALL SELECT page_id, y, x0, x1 FROM n),
gaps AS (SELECT page_id, y, x1 + 1 AS x0, coalesce(lead(x0) OVER (PARTITION BY page_id, y ORDER BY x0), {WIDTH}) - 1 AS x1 FROM ends),
back AS MATERIALIZED (SELECT * FROM gaps WHERE x0 <= x1), {_labels('back', 'g', 0)},
holes AS (SELECT g.* FROM g WHERE NOT EXISTS (SELECT 1 FROM g c WHERE c.page_id = g.page_id AND c.label = g.label AND c.y = 0 AND c.x0 = 0)),
solid AS (SELECT page_id, y, x0, x1 FROM n UNION ALL SELECT page_id, y, x0, x1 FROM holes),
isles AS (SELECT *, CASE WHEN x0 > coalesce(max(x1) OVER (PARTITION BY page_id, y ORDER BY x0 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -2) + 1 THEN 1 ELSE 0 END AS new FROM solid),
numbered AS (SELECT *, sum(new) OVER (PARTITION BY page_id, y ORDER BY x0 ROWS UNBOUNDED PRECEDING) AS k FROM isles),
joined AS (SELECT page_id, y, min(x0) AS x0, max(x1) AS x1 FROM numbered GROUP BY page_id, y, k), {_labels('joined', 'l', 1)}"""


def _met(pad: int, boxes: str = _BOXES) -> str:
    return f"""met AS (SELECT b.page_id, b.box_id, r.label, sum(least(r.x1 + 1, b.x2 + {pad}) - greatest(r.x0, b.x1 - {pad})) AS pixels FROM {boxes} b JOIN l r ON b.page_id = r.page_id AND r.y >= b.y1 - {pad} AND r.y < b.y2 + {pad} AND least(r.x1 + 1, b.x2 + {pad}) > greatest(r.x0, b.x1 - {pad}) GROUP BY 1, 2, 3),
best AS (SELECT * FROM met QUALIFY row_number() OVER (PARTITION BY page_id, box_id ORDER BY pixels DESC, label) = 1)"""


_SHARES = f"s AS (SELECT b.page_id, b.box_id, coalesce(best.label, 0) AS label, coalesce(pixels / ((x2 - x1) * (y2 - y1))::DOUBLE, 0) AS share, floor((x1 + x2) / 2) AS x, floor((y1 + y2) / 2) AS y, x1, y1, x2, y2 FROM {_BOXES} b LEFT JOIN best USING (page_id, box_id))"
_NEAR = f"a.x1 - {op.REACH} < b.x2 AND b.x1 - {op.REACH} < a.x2 AND a.y1 - {op.REACH} < b.y2 AND b.y1 - {op.REACH} < a.y2"
_PAIRS = f"p AS (SELECT a.page_id, a.box_id AS a, b.box_id AS b, a.label AS al, b.label AS bl, a.share AS ash, b.share AS bsh, a.x AS ax, a.y AS a_y, b.x AS bx, b.y AS b_y FROM s a JOIN s b ON a.page_id = b.page_id AND a.box_id < b.box_id AND {_NEAR})"
_ALL = _PAIRS.replace(f" AND {_NEAR}", "")  # of a page, near or not
_COLUMNS = "ext AS MATERIALIZED (SELECT page_id, label, CAST(x AS INT) AS x, CAST(max(y) - min(y) + 1 AS INT) AS extent FROM (SELECT page_id, label, y, unnest(range(x0, x1 + 1)) AS x FROM l) GROUP BY 1, 2, 3)"
_PATCHES = f"""c AS (SELECT page_id, box_id, (x1 + x2) / 2 AS x, (y1 + y2) / 2 AS y, x1, y1, x2, y2 FROM {_BOXES}),
way AS (SELECT a.page_id, a.box_id AS a, b.box_id AS b, k, CAST(round_even(a.x + (b.x - a.x) * k / 8, 0) AS INT) AS x, CAST(round_even(a.y + (b.y - a.y) * k / 8, 0) AS INT) AS y FROM c a JOIN c b ON a.page_id = b.page_id AND a.box_id < b.box_id, (SELECT unnest(range(9)) AS k)),
patches AS (SELECT page_id, (a * 4096 + b) * 16 + k AS box_id, a, b, x - 3 AS x1, y - 3 AS y1, x + 4 AS x2, y + 4 AS y2 FROM way)"""
_AFTER = "(SELECT page_id, y, x0 + 5 AS x0, x1 FROM n WHERE y % 4 < 3)"

ORACLES = {
    "components_of_runs": f"WITH RECURSIVE {_L} SELECT page_id, y, x0, x1, label FROM l",
    "fill_holes": f"WITH RECURSIVE {_FILLED} SELECT page_id, label, CAST(sum(x1 - x0 + 1) AS BIGINT) AS pixels FROM l GROUP BY 1, 2",
    "column_extents": f"WITH RECURSIVE {_L}, {_COLUMNS}, k AS (SELECT *, x - row_number() OVER (PARTITION BY page_id, label, extent ORDER BY x) AS k FROM ext) SELECT page_id, label, CAST(min(x) AS INT) AS x0, CAST(max(x) AS INT) AS x1, extent FROM k GROUP BY page_id, label, extent, k",
    "box_label": f"WITH RECURSIVE {_L}, {_met(2)} SELECT b.page_id, b.box_id, coalesce(label, 0) AS label FROM {_BOXES} b LEFT JOIN best USING (page_id, box_id)",
    "box_coverage": f"WITH RECURSIVE {_FILLED}, {_met(0)}, {_SHARES} SELECT page_id, box_id, label, round(share, 6) AS share FROM s",
    "container_veto": f"WITH RECURSIVE {_FILLED}, {_met(0)}, {_SHARES}, {_ALL} SELECT page_id, a, b FROM p WHERE (ash >= 0.5 AND bsh >= 0.5 AND al <> bl) OR (ash >= 0.5 AND bsh <= 0.3) OR (ash <= 0.3 AND bsh >= 0.5)",
    "waist_veto": f"""WITH RECURSIVE {_L}, {_met(14)}, {_SHARES}, {_PAIRS}, {_COLUMNS},
q AS (SELECT p.page_id, a, b, al AS label, greatest(least(ax, bx), w.lo) AS lo, least(greatest(ax, bx), w.hi) AS hi FROM p JOIN (SELECT page_id, label, min(x) AS lo, max(x) AS hi FROM ext GROUP BY 1, 2) w ON w.page_id = p.page_id AND w.label = al
WHERE al = bl AND al <> 0 AND abs(ax - bx) > abs(a_y - b_y) AND abs(ax - bx) >= 12 AND least(greatest(ax, bx), w.hi) - greatest(least(ax, bx), w.lo) >= 12),
m AS (SELECT q.page_id, a, b, min(extent) AS thin, max(CASE WHEN x = lo THEN extent END) AS el, max(CASE WHEN x = hi THEN extent END) AS er FROM q JOIN ext ON ext.page_id = q.page_id AND ext.label = q.label AND x BETWEEN lo AND hi GROUP BY 1, 2, 3),
v AS (SELECT page_id, a, b, thin / least(el, er)::DOUBLE AS ratio FROM m) SELECT page_id, a, b, round(ratio, 6) AS ratio FROM v WHERE ratio <= 0.85""",
    "path_label_veto": f"WITH RECURSIVE {_L}, {_PATCHES}, {_met(0, 'patches')} SELECT p.page_id, p.a, p.b FROM best JOIN patches p USING (page_id, box_id) GROUP BY 1, 2, 3 HAVING count(DISTINCT label) >= 2",
    "panel_borders": f"""WITH w AS (SELECT DISTINCT page_id, y FROM {_INK} WHERE level = 'dark' AND x1 - x0 + 1 >= 112), m AS (SELECT *, CASE WHEN y - lag(y) OVER (PARTITION BY page_id ORDER BY y) <= 2 THEN 0 ELSE 1 END AS new FROM w),
k AS (SELECT *, sum(new) OVER (PARTITION BY page_id ORDER BY y) AS k FROM m) SELECT page_id, CAST((min(y) + max(y)) // 2 AS INT) AS pos FROM k GROUP BY page_id, k""",
    "gap_profile_veto": f"""WITH b AS (SELECT *, CASE WHEN tone >= 128 THEN 'dark' ELSE 'light' END AS level, tone IS NOT NULL AND gx2 - gx1 >= 4 AND gy2 - gy1 >= 2 AS usable FROM ({SQL['f14_bands']})),
r AS (SELECT *, unnest(range(gy1, gy2)) AS y FROM b WHERE usable),
k AS (SELECT r.page_id, r.gy1, r.band_id, r.y, any_value(gy2 - gy1) AS h, sum(CASE WHEN i.y IS NULL THEN 0 ELSE greatest(0, least(i.x1 + 1, gx2) - greatest(i.x0, gx1)) END) / any_value(gx2 - gx1)::DOUBLE AS ink FROM r LEFT JOIN {_INK} i ON i.page_id = r.page_id AND i.y = r.y AND i.level = r.level GROUP BY 1, 2, 3, 4),
c AS (SELECT *, sum(CASE WHEN ink < 0.04 THEN 0 ELSE 1 END) OVER (PARTITION BY page_id, gy1, band_id ORDER BY y) AS island FROM k),
t AS (SELECT page_id, gy1, band_id, island, any_value(h) AS high, max(ink) AS most, count(*) FILTER (ink < 0.04) AS clear FROM c GROUP BY 1, 2, 3, 4),
v AS (SELECT page_id, gy1, band_id, max(most) > 0.6 OR max(clear) = 0 OR max(clear) < 0.25 * any_value(high) AS veto FROM t GROUP BY 1, 2, 3)
SELECT b.page_id, b.gy1, b.band_id, v.veto FROM b LEFT JOIN v USING (page_id, gy1, band_id)""",
    "residual_check": f"""WITH RECURSIVE {_N}, shared AS (SELECT p.page_id, p.y, greatest(p.x0, q.x0) AS x0, least(p.x1, q.x1) AS x1 FROM n p JOIN {_AFTER} q ON p.page_id = q.page_id AND p.y = q.y AND greatest(p.x0, q.x0) <= least(p.x1, q.x1)),
inside AS MATERIALIZED (SELECT b.page_id * 1000 + b.box_id AS page_id, r.y, greatest(r.x0, b.x1) AS x0, least(r.x1, b.x2 - 1) AS x1 FROM {_BOXES} b JOIN shared r ON b.page_id = r.page_id AND r.y >= b.y1 AND r.y < b.y2 AND greatest(r.x0, b.x1) <= least(r.x1, b.x2 - 1)), {_labels('inside', 'l', 1)},
blobs AS (SELECT page_id, label, sum(x1 - x0 + 1) AS n FROM l GROUP BY 1, 2), t AS (SELECT page_id, sum(n) AS pixels, max(n) AS blob FROM blobs GROUP BY 1)
SELECT b.page_id, b.box_id, CAST(coalesce(pixels, 0) AS BIGINT) AS pixels, CAST(coalesce(blob, 0) AS BIGINT) AS blob, round(coalesce(pixels, 0) / ((x2 - x1) * (y2 - y1))::DOUBLE, 6) AS share, coalesce(pixels, 0) / ((x2 - x1) * (y2 - y1))::DOUBLE >= 0.006 OR coalesce(blob, 0) >= 12 AS flagged FROM {_BOXES} b LEFT JOIN t ON t.page_id = b.page_id * 1000 + b.box_id""",
}
