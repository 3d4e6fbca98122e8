"""Queries over corrections of regions, with their DuckDB equivalents."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from pagetext.operators import edits as op
from pagetext.operators.graph import kept
from pagetext.plans.fixtures import SQL, fixture
from pagetext.sources.batches import read_batches
from pagetext.streaming.jobs import shared_folder

_MEMBER = "struct(frag_id AS id, text, x1, y1, x2, y2)"
SAFE = 10_000  # above every region of a page


def _regions(s, d):
    """A page's orders as regions, their lines as members."""
    frags = fixture(s, d, "f1_fragments").withColumn("region_id", F.floor(F.col("frag_id") / 100))
    one = frags.groupBy("page_id", "region_id").agg(F.expr(f"array_sort(collect_list({_MEMBER}))").cast(op.MEMBERS).alias("members"))
    box = {c: F.expr(f"array_{'min' if c[1] == '1' else 'max'}(transform(members, m -> m.{c}))").alias(c) for c in op.BOX}
    text = F.array_join(F.transform("members", lambda m: m["text"]), " ")
    pos = F.expr("row_number() OVER (PARTITION BY page_id ORDER BY region_id) - 1")
    return one.select("page_id", "region_id", pos.alias("pos"), text.alias("text"), F.concat(F.lit("tl "), F.col("region_id").cast("string")).alias("tl"), F.lit("speech").alias("t"), *box.values(), "members")


def _shown(df):
    return df.select("page_id", "region_id", "pos", "text", "tl", *op.BOX, F.array_join(F.transform("members", lambda m: m["id"].cast("string")), ",").alias("members"))


def _splits(regions):
    keys = regions.select("page_id", "region_id").where("(page_id + region_id) % 3 = 0")
    return keys.select("page_id", "region_id", (F.col("page_id") % 4 - 1).cast("int").alias("after"), (F.col("region_id") + SAFE).alias("new_id"))


def _joins(regions):
    pages = regions.select("page_id").distinct().where("page_id % 4 < 3")
    return pages.select("page_id", (F.col("page_id") % 2 * 2).alias("region_id"), F.when(F.col("page_id") % 5 == 0, 77).otherwise(1).cast("bigint").alias("other_id"))


def split_regions(s, d):
    regions = kept(_regions(s, d))  # read more than once
    return _shown(op.split_regions(regions, _splits(regions)))


def join_regions(s, d):
    regions = kept(_regions(s, d))
    return _shown(op.join_regions(regions, _joins(regions)))


def manual_order(s, d):
    """The list of places backwards, with one that isn't there, after two moves."""
    regions = kept(_regions(s, d))
    pages = regions.groupBy("page_id").agg(F.count("*").cast("int").alias("n")).where("page_id % 3 <> 0")
    move = lambda seq, at, by: F.struct(F.lit(seq).alias("seq"), at.cast("int").alias("at"), F.lit(by).alias("by"))
    moves = F.array(move(2, F.col("page_id") % 4, 1), move(1, F.lit(0), 1))
    places = op.moved(F.concat(F.array(F.lit(50)), F.reverse(F.sequence(F.lit(0), F.col("n") - 1))), moves)
    return _shown(op.manual_order(regions, pages.select("page_id", places.alias("places"))))


def _log(regions):
    """Edits of two of three pages: a split of the first region, a join, a text, a move, a deletion, an addition."""
    pages = regions.select("page_id").distinct().where("page_id % 3 <> 1")
    none = {"text": F.lit(None).cast("string"), "other_id": F.lit(None).cast("bigint"), "after": F.lit(None).cast("int"), "by": F.lit(None).cast("int"), **{c: F.lit(None).cast("double") for c in op.BOX}}
    edit = lambda seq, region, kind, **more: F.struct(F.lit(seq).cast("bigint").alias("seq"), region.cast("bigint").alias("region_id"), F.lit(kind).alias("kind"), *[v.alias(k) for k, v in (none | more).items()])
    one = lambda n: F.lit(n).cast("bigint")
    kinds = [
        edit(6, one(500), "add", text=F.lit("new"), **{c: F.lit(float(n)) for n, c in enumerate(op.BOX)}),
        edit(5, one(3), "delete"),
        edit(4, one(2), "reorder", by=F.when(F.col("page_id") % 2 == 0, -1).otherwise(1).cast("int")),
        edit(3, one(3), "text", text=F.lit("gone")),
        edit(2, one(1), "text", text=F.concat(F.lit("text "), F.col("page_id").cast("string"))),
        edit(1, one(0), "split", other_id=one(SAFE), after=F.lit(0)),
    ]
    return pages.select("page_id", F.explode(F.array(*kinds)).alias("e")).select("page_id", "e.*").select(*[c.split()[0] for c in op.EDIT.split(", ")])


def replay_edits(s, d):
    regions = kept(_regions(s, d))
    return _shown(op.replay_edits(regions, _log(regions)))


def _chapters(s, d):
    return fixture(s, d, "f8_regions").select("chapter_id").distinct().withColumn("cacheable", F.col("chapter_id") % 4 != 0)


def write_regions(s, d):
    """Written in batches of even and odd pages, each run twice, and read back."""
    path, rows = f"{shared_folder(s)}-{uuid.uuid4().hex}", fixture(s, d, "f8_regions")
    for half in (0, 1, 0, 1):
        op.write_regions(rows.where(F.col("page_idx") % 2 == half), _chapters(s, d), path, half)
    return read_batches(s, path).select("chapter_id", "page_idx", "region_id", "tl")


def write_spend(s, d):
    path = f"{shared_folder(s)}-{uuid.uuid4().hex}"
    for _ in range(2):
        op.write_spend(fixture(s, d, "f4_calls"), path, "calls")
    return read_batches(s, path).groupBy(F.col("day").cast("string").alias("day")).agg(F.count("*").alias("calls"), F.sum("chars").alias("chars"))


QUERIES = {f.__name__: f for f in (split_regions, join_regions, manual_order, replay_edits, write_regions, write_spend)}

_F = f"f AS MATERIALIZED (SELECT *, CAST(floor(frag_id / 100) AS BIGINT) AS region_id FROM ({SQL['f1_fragments']}))"
_AGG = "min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2"
_R = f"""{_F}, r AS MATERIALIZED (SELECT page_id, region_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY region_id) - 1 AS INT) AS pos, string_agg(text, ' ' ORDER BY frag_id) AS text, 'tl ' || region_id AS tl, {_AGG}, string_agg(CAST(frag_id AS VARCHAR), ',' ORDER BY frag_id) AS members, count(*) AS n FROM f GROUP BY 1, 2)"""
_COLS = "page_id, region_id, pos, text, tl, x1, y1, x2, y2, members"


def _halves(after: str, cut: str, new_id: str) -> str:
    """The members of regions to be cut, on their side."""
    return f"""m AS (SELECT f.*, r.pos AS old, row_number() OVER (PARTITION BY f.page_id, f.region_id ORDER BY f.y1, f.frag_id) - 1 AS k, r.n FROM f JOIN r USING (page_id, region_id) WHERE {cut}),
c AS (SELECT *, CASE WHEN k <= {after} THEN 0 ELSE 1 END AS part FROM m WHERE {after} >= 0 AND {after} + 1 < n),
h AS (SELECT page_id, CASE WHEN part = 0 THEN region_id ELSE {new_id} END AS region_id, old AS pos, part, string_agg(text, ' ' ORDER BY y1, frag_id) AS text, '—' AS tl, {_AGG}, string_agg(CAST(frag_id AS VARCHAR), ',' ORDER BY y1, frag_id) AS members FROM c GROUP BY page_id, region_id, old, part)"""


_PLACED = "SELECT page_id, region_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY pos, part) - 1 AS INT) AS pos, text, tl, x1, y1, x2, y2, members FROM u"
_MOVE = "list_transform(o, lambda x, i: CASE WHEN i - 1 = {at} AND {at} + 1 < len(o) THEN o[{at} + 2] WHEN i - 1 = {at} + 1 THEN o[{at} + 1] ELSE x END)"

ORACLES = {
    "split_regions": f"""WITH {_R}, {_halves('(page_id % 4 - 1)', '(page_id + region_id) % 3 = 0', f'region_id + {SAFE}')},
u AS (SELECT page_id, region_id, pos, 0 AS part, text, tl, x1, y1, x2, y2, members FROM r WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.page_id = r.page_id AND c.region_id = r.region_id) UNION ALL SELECT page_id, region_id, pos, part, text, tl, x1, y1, x2, y2, members FROM h) {_PLACED}""",
    "join_regions": f"""WITH {_R}, j AS (SELECT a.page_id, a.region_id, b.region_id AS other, b.text AS t2, b.x1 AS bx1, b.y1 AS by1, b.x2 AS bx2, b.y2 AS by2, b.members AS m2 FROM r a JOIN r b ON a.page_id = b.page_id AND a.page_id % 4 < 3 AND a.region_id = a.page_id % 2 * 2 AND b.region_id = CASE WHEN a.page_id % 5 = 0 THEN 77 ELSE 1 END),
u AS (SELECT r.page_id, r.region_id, pos, 0 AS part, CASE WHEN t2 IS NULL THEN text ELSE text || ' ' || t2 END AS text, CASE WHEN t2 IS NULL THEN tl ELSE '—' END AS tl, least(x1, bx1) AS x1, least(y1, by1) AS y1, greatest(x2, bx2) AS x2, greatest(y2, by2) AS y2, CASE WHEN t2 IS NULL THEN members ELSE members || ',' || m2 END AS members
  FROM r LEFT JOIN j ON j.page_id = r.page_id AND j.region_id = r.region_id WHERE NOT EXISTS (SELECT 1 FROM j WHERE j.page_id = r.page_id AND j.other = r.region_id)) {_PLACED}""",
    "manual_order": f"""WITH {_R}, p AS (SELECT page_id, list_concat([50], list_reverse(range(count(*)))) AS o FROM r WHERE page_id % 3 <> 0 GROUP BY 1), p1 AS (SELECT page_id, {_MOVE.format(at='0')} AS o FROM p), p2 AS (SELECT page_id, {_MOVE.format(at='(page_id % 4)')} AS o FROM p1),
l AS (SELECT page_id, unnest(o) AS was, unnest(range(len(o))) AS spot FROM p2), u AS (SELECT r.* EXCLUDE (pos), spot AS pos, 0 AS part FROM r JOIN l ON l.page_id = r.page_id AND l.was = r.pos UNION ALL SELECT r.* EXCLUDE (pos), pos, 0 FROM r WHERE page_id % 3 = 0) {_PLACED}""",
    "replay_edits": f"""WITH {_R}, {_halves('0', 'page_id % 3 <> 1 AND region_id = 0', str(SAFE))},
s AS (SELECT page_id, region_id, pos, 0 AS part, text, tl, x1, y1, x2, y2, members FROM r WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.page_id = r.page_id AND c.region_id = r.region_id) UNION ALL SELECT page_id, region_id, pos, part, text, tl, x1, y1, x2, y2, members FROM h),
t AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY pos, part) - 1 AS place, page_id % 3 <> 1 AS touched FROM s),
w AS (SELECT page_id, place AS at, place + CASE WHEN page_id % 2 = 0 THEN -1 ELSE 1 END AS to_, (SELECT count(*) FROM t x WHERE x.page_id = t.page_id) AS n FROM t WHERE touched AND region_id = 2),
v AS (SELECT t.*, CASE WHEN w.at IS NULL OR to_ < 0 OR to_ >= n THEN place WHEN place = w.at THEN to_ WHEN place = to_ THEN w.at ELSE place END AS spot FROM t LEFT JOIN w USING (page_id)),
u AS (SELECT page_id, region_id, spot AS pos, 0 AS part, CASE WHEN touched AND region_id = 1 THEN 'text ' || page_id ELSE text END AS text, CASE WHEN touched AND region_id = 1 THEN '—' ELSE tl END AS tl, x1, y1, x2, y2, members FROM v WHERE NOT (touched AND region_id = 3)
  UNION ALL SELECT DISTINCT page_id, 500, 99, 0, 'new', '—', 0, 1, 2, 3, '' FROM r WHERE page_id % 3 <> 1) {_PLACED}""",
    "write_regions": f"SELECT chapter_id, page_idx, region_id, tl FROM ({SQL['f8_regions']}) WHERE chapter_id % 4 <> 0",
    "write_spend": f"SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS calls, CAST(sum(chars) AS BIGINT) AS chars FROM ({SQL['f4_calls']}) GROUP BY 1",
}
