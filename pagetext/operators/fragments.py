"""OCR fragments to text regions: margins, candidate pairs, vetoes, groups, reading order, regions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagetext.operators.graph import component_labels, forest_weights, touching_labels

LINE_GAP, SIDE_GAP, LEAST_MARGIN = 1.6, 0.3, 4
TALL_RATIO, TALL_SCALE = 2.0, 0.6
BUCKET_PX = 64
BOX = ("x1", "y1", "x2", "y2")
#: Confidence floors by language; others take DEFAULT_FLOOR.
FLOORS = {"vi": 0.25, "ko": 0.3, "pt": 0.3}
DEFAULT_FLOOR = 0.35
HARD_SCRIPTS = ("ja", "zh", "zh-hk", "ko", "th", "ar")


def half_even(v: Column, digits: int) -> Column:
    """Half to even, on six decimals, so that noise in the last bits doesn't decide."""
    return F.bround(F.round(v, 6), digits)


def with_floor(df: DataFrame, lang: str = "lang") -> DataFrame:
    """hard_script and min_conf of each row's language."""
    floor = reduce(lambda c, kv: c.when(F.col(lang) == kv[0], F.lit(kv[1])), FLOORS.items(), F.when(F.lit(False), F.lit(0.0)))
    return df.withColumn("hard_script", F.coalesce(F.col(lang).isin(*HARD_SCRIPTS), F.lit(False))).withColumn("min_conf", F.coalesce(floor, F.lit(DEFAULT_FLOOR)))


def short_text_floor(frags: DataFrame, longest: int = 2, least: float = 0.12) -> DataFrame:
    """Without empty texts and without unsure texts of at most `longest` characters."""
    size = F.length(F.trim("text"))
    return frags.where((size > 0) & ~((size <= longest) & (F.coalesce("conf", F.lit(1.0)) < least)))


def box_to_px(df: DataFrame) -> DataFrame:
    """px_*: percent boxes as whole pixels inside the page, at least 1 px each way."""
    px = lambda c, size: half_even(F.col(c) * F.col(size) / 100, 0).cast("int")
    low = lambda c, size: F.greatest(F.lit(0), F.least(px(c, size), F.col(size) - 1))
    out = df.withColumn("px_x1", low("x1", "img_w")).withColumn("px_y1", low("y1", "img_h"))
    return out.withColumn("px_x2", F.least(F.col("img_w"), F.greatest(px("x2", "img_w"), F.col("px_x1") + 1))).withColumn("px_y2", F.least(F.col("img_h"), F.greatest(px("y2", "img_h"), F.col("px_y1") + 1)))


def box_to_pct(df: DataFrame) -> DataFrame:
    """Percent of the page with one decimal (half to even), and the centre."""
    pct = lambda v, size: half_even(v / F.col(size) * 100, 1)
    x1, y1, x2, y2 = map(F.col, ("x1", "y1", "x2", "y2"))
    return df.select("*", pct(x1, "img_w").alias("pct_x1"), pct(y1, "img_h").alias("pct_y1"), pct(x2, "img_w").alias("pct_x2"), pct(y2, "img_h").alias("pct_y2"), pct((x1 + x2) / 2, "img_w").alias("cx"), pct((y1 + y2) / 2, "img_h").alias("cy"))


def merge_margins(frags: DataFrame, scale: float | Column = 0.5) -> DataFrame:
    """margin_v and margin_h: how far a fragment reaches, from its height; tall strips reach less."""
    scale = F.lit(float(scale)) if isinstance(scale, (int, float)) else scale
    height = F.col("y2") - F.col("y1")
    return frags.withColumn("margin_v", _reach(height, scale, LINE_GAP)).withColumn("margin_h", _reach(height, scale, SIDE_GAP))


def _reach(height: Column, scale: Column, factor: float) -> Column:
    k = F.when(F.col("img_h") / F.greatest(F.col("img_w"), F.lit(1)) > TALL_RATIO, F.lit(TALL_SCALE)).otherwise(1.0)
    return F.greatest(F.lit(LEAST_MARGIN), (height * (scale * factor * k)).cast("int"))


def boxed_pairs(frags: DataFrame, *also: str) -> DataFrame:
    """(page_id, *also, a, b, ax1 .. by2) of fragments of a page whose reaches touch, a < b, with both boxes.

    The theta join is an equi-join on y-buckets of BUCKET_PX; a pair is taken in the first bucket
    that both boxes have, so nothing has to be made distinct."""
    keys = ["page_id", *also]
    low, high = F.col("y1") - F.col("margin_v"), F.col("y2") + F.col("margin_v")
    slot = lambda c: F.floor(c / BUCKET_PX)
    reach = frags.select(*keys, "frag_id", *BOX, (F.col("x1") - F.col("margin_h")).alias("l"), low.alias("t"), (F.col("x2") + F.col("margin_h")).alias("r"), high.alias("d"), slot(low).alias("first"))
    spread = reach.withColumn("slot", F.explode(F.sequence(F.col("first"), slot(F.col("d")))))
    a, b = spread.alias("a"), spread.alias("b")
    same = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in [*keys, "slot"]]
    touch = (F.col("a.frag_id") < F.col("b.frag_id")) & (F.col("a.l") <= F.col("b.r")) & (F.col("b.l") <= F.col("a.r")) & (F.col("a.t") <= F.col("b.d")) & (F.col("b.t") <= F.col("a.d")) & (F.col("a.slot") == F.greatest("a.first", "b.first"))
    boxes = [F.col(f"{s}.{c}").alias(s + c) for s in "ab" for c in BOX]
    return a.join(b, reduce(Column.__and__, [*same, touch])).select(*[F.col(f"a.{k}") for k in keys], F.col("a.frag_id").alias("a"), F.col("b.frag_id").alias("b"), *boxes)


def overlap_pairs(frags: DataFrame, *also: str) -> DataFrame:
    """(page_id, *also, a, b) of fragments of a page whose reaches touch, a < b."""
    return boxed_pairs(frags, *also).select("page_id", *also, "a", "b")


def with_boxes(pairs: DataFrame, frags: DataFrame) -> DataFrame:
    """pairs with both boxes as ax1 .. by2, where they don't have them yet."""
    if "ax1" in pairs.columns:
        return pairs
    for side in "ab":
        box = frags.select("page_id", F.col("frag_id").alias(side), *[F.col(c).alias(side + c) for c in BOX])
        pairs = pairs.join(box, ["page_id", side])
    return pairs


def border_veto(boxed: DataFrame, borders: DataFrame) -> DataFrame:
    """Pairs without a border strictly inside their vertical (h) or horizontal (v) gap."""
    p, b = boxed.alias("p"), borders.alias("r")
    top, bottom = F.least("p.ay2", "p.by2"), F.greatest("p.ay1", "p.by1")
    left, right = F.least("p.ax2", "p.bx2"), F.greatest("p.ax1", "p.bx1")
    pos = F.col("r.pos")
    between = ((F.col("r.axis") == "h") & (pos > top) & (pos < bottom)) | ((F.col("r.axis") == "v") & (pos > left) & (pos < right))
    return p.join(b, (F.col("p.page_id") == F.col("r.page_id")) & between, "left_anti")


def gap_band(boxed: DataFrame) -> DataFrame:
    """The band strictly between two boxes that overlap in x and are apart in y; else nulls."""
    x1, x2 = F.greatest("ax1", "bx1"), F.least("ax2", "bx2")
    y1, y2 = F.least("ay2", "by2"), F.greatest("ay1", "by1")
    there = (x2 > x1) & (y2 > y1)
    return boxed.select("*", *[F.when(there, c).alias(n) for n, c in (("gx1", x1), ("gy1", y1), ("gx2", x2), ("gy2", y2))])


def veto_pairs(pairs: DataFrame, frags: DataFrame, borders: DataFrame | None = None, tables: dict | None = None, enabled: tuple[str, ...] = ("border", "label", "waist", "container", "profile"), extra: list[Column] | None = None) -> DataFrame:
    """Pairs that no enabled veto refuses: borders, then the label, waist, container and gap-profile
    vetoes whose tables of vetoed (page_id, a, b) are given, then the user's own predicates (true refuses)."""
    boxed = with_boxes(pairs, frags)
    if borders is not None and "border" in enabled:
        boxed = border_veto(boxed, borders)
    for name in ("label", "waist", "container", "profile"):
        if name in enabled and tables and name in tables:
            boxed = boxed.join(tables[name].select("page_id", "a", "b"), ["page_id", "a", "b"], "left_anti")
    for refuse in extra or []:
        boxed = boxed.where(~F.coalesce(refuse, F.lit(False)))
    return boxed.select("page_id", "a", "b")


def filter_by_confidence(grouped: DataFrame, min_conf: str = "min_conf", floor: float = 0.1) -> DataFrame:
    """Members above the low floor where a member of their group is sure, above min_conf elsewhere."""
    sure = grouped.groupBy("page_id", "group_id").agg(F.max(F.col("conf") >= F.col(min_conf)).alias("sure"))
    limit = F.when(F.col("sure"), F.lit(floor)).otherwise(F.col(min_conf))
    return grouped.join(sure, ["page_id", "group_id"]).where(F.col("conf") >= limit).drop("sure")


_LINES = """aggregate({fs}, cast(struct(array() AS lines, array() AS at) AS struct<lines:array<struct<c:double,h:double,n:int>>,at:array<int>>),
  (a, x) -> element_at(transform(array(cast(array_position(transform(a.lines, l -> abs(x.c - l.c / l.n) <= 0.5 * greatest(x.h, l.h / l.n)), true) AS int)),
    hit -> struct(if(hit > 0, transform(a.lines, (l, i) -> if(i = hit - 1, struct(l.c + x.c AS c, l.h + x.h AS h, l.n + 1 AS n), l)), concat(a.lines, array(struct(x.c AS c, x.h AS h, 1 AS n)))) AS lines,
                  concat(a.at, array(if(hit > 0, hit, size(a.lines) + 1))) AS at)), 1)).at"""
_FRAGS = "array_sort(collect_list(struct((y1 + y2) / 2 AS c, frag_id AS id, y2 - y1 AS h, x1, y1, x2, y2, text, conf)))"
_MEMBER = "f.id AS id, f.x1 AS x1, f.y1 AS y1, f.x2 AS x2, f.y2 AS y2, f.text AS text, f.conf AS conf"


def _ordered(fs: str) -> str:
    """Members by line (top edge, then first met), then from the left."""
    lined = f"zip_with({fs}, {_LINES.format(fs=fs)}, (f, l) -> struct(f.c AS c, {_MEMBER}, l AS line))"
    return f"""element_at(transform(array({lined}), m -> array_sort(transform(m, (f, i) -> struct(array_min(transform(filter(m, g -> g.line = f.line), g -> g.y1)) AS top, f.line AS line, f.x1 AS x, i AS i, {_MEMBER})))), 1)"""


def line_ids(grouped: DataFrame, *keys: str) -> DataFrame:
    """(keys, frag_id, line): lines of a group by top edge from 1. A fragment joins the first line
    whose mean centre is within half the larger of its height and the line's mean height; fragments
    come by centre, then id."""
    keys = keys or ("page_id", "group_id")
    folded = grouped.groupBy(*keys).agg(F.expr(_FRAGS).alias("fs")).withColumn("o", F.expr(_ordered("fs")))
    tops = F.expr("array_sort(array_distinct(transform(o, m -> struct(m.top AS top, m.line AS line))))")
    one = folded.withColumn("tops", tops).select(*keys, "tops", F.explode_outer("o").alias("m"))  # outer: no filter is inferred that would fold the lines again
    return one.select(*keys, F.col("m.id").alias("frag_id"), F.expr("cast(array_position(tops, struct(m.top AS top, m.line AS line)) AS int)").alias("line"))


def _split(groups: DataFrame) -> DataFrame:
    """left and right columns of fs, or nulls: at least 4 fragments, the widest empty stretch of a
    200-step axis at least 3 %, two on each side, the shorter side 70 % alongside the other, and the
    sparser side as many lines as the other has in its band."""
    wide = groups.withColumn("x0", F.expr("array_min(transform(fs, f -> f.x1))")).withColumn("w", F.expr("array_max(transform(fs, f -> f.x2)) - x0"))
    cells = "array_sort(transform(fs, f -> struct(greatest(cast((f.x1 - x0) * (200 / w) AS int), 0) AS a, least(cast((f.x2 - x0) * (200 / w) AS int), 200) AS b)))"
    gap = f"aggregate({cells}, struct(-1 AS reach, 0 AS s, 0 AS e), (g, c) -> struct(greatest(g.reach, c.b) AS reach, if(c.a - g.reach - 1 > g.e - g.s, g.reach + 1, g.s) AS s, if(c.a - g.reach - 1 > g.e - g.s, c.a, g.e) AS e))"
    cut = wide.withColumn("gap", F.when((F.size("fs") >= 4) & (F.col("w") > 0), F.expr(gap))).withColumn("cut", F.expr("CASE WHEN gap.e - gap.s >= 6 THEN x0 + (gap.s + gap.e) / 2 / (200 / w) END"))
    sides = cut.withColumn("l", F.expr("filter(fs, f -> (f.x1 + f.x2) / 2 < cut)")).withColumn("r", F.expr("filter(fs, f -> (f.x1 + f.x2) / 2 >= cut)"))
    sides = sides.withColumn("two", F.expr("cut IS NOT NULL AND size(l) >= 2 AND size(r) >= 2"))
    for s in "lr":
        sides = sides.withColumn(f"{s}_top", F.expr(f"array_min(transform({s}, f -> f.y1))")).withColumn(f"{s}_end", F.expr(f"array_max(transform({s}, f -> f.y2))")).withColumn(f"{s}o", F.when(F.col("two"), F.expr(_ordered(s))))
        sides = sides.withColumn(f"{s}_lines", F.expr(f"transform(array_distinct(transform({s}o, m -> m.line)), k -> element_at(transform(array(filter({s}o, m -> m.line = k)), g -> (array_min(transform(g, m -> m.y1)) + array_max(transform(g, m -> m.y2))) / 2), 1))"))
    shared = "greatest(0D, least(l_end, r_end) - greatest(l_top, r_top)) / nullif(least(l_end - l_top, r_end - r_top), 0D) >= 0.7"
    tail = """CASE WHEN size(l_lines) <= size(r_lines) THEN size(l_lines) >= size(filter(r_lines, m -> m BETWEEN l_top AND l_end))
      ELSE size(r_lines) >= size(filter(l_lines, m -> m BETWEEN r_top AND r_end)) END"""
    return sides.withColumn("split", F.expr(f"coalesce(two AND {shared} AND {tail}, false)"))


def order_fragments(grouped: DataFrame) -> DataFrame:
    """(page_id, group_id, img_w, img_h, split, ordered): members of a group in reading order, the left
    column before the right where the group splits."""
    groups = grouped.groupBy("page_id", "group_id").agg(F.expr(_FRAGS).alias("fs"), F.max("img_w").alias("img_w"), F.max("img_h").alias("img_h"))
    return _split(groups).select("page_id", "group_id", "img_w", "img_h", "split", F.when(F.col("split"), F.concat("lo", "ro")).otherwise(F.expr(_ordered("fs"))).alias("ordered"))


def assemble(ordered: DataFrame) -> DataFrame:
    """One region for each group: joined text, box and centre in percent, least confidence, members."""
    text = "aggregate(ordered, '', (t, m) -> CASE WHEN t = '' THEN m.text WHEN endswith(t, '-') THEN concat(substring(t, 1, length(t) - 1), m.text) ELSE concat(t, ' ', m.text) END)"
    box = {c: F.expr(f"array_{'min' if c[1] == '1' else 'max'}(transform(ordered, m -> m.{c}))").alias(c) for c in BOX}
    regions = ordered.select("page_id", "group_id", "img_w", "img_h", F.expr(text).alias("text"), *box.values(), F.bround(F.expr("array_min(transform(ordered, m -> m.conf))"), 3).alias("confidence"), F.expr("transform(ordered, m -> m.id)").alias("members"))
    return box_to_pct(regions).select("page_id", "group_id", "text", "cx", "cy", *[F.col(f"pct_{c}").alias(c) for c in box], "confidence", "members")


def grouped_fragments(frags: DataFrame, scale: float = 0.5, borders: DataFrame | None = None, **vetoes) -> DataFrame:
    """frags with group_id, the least member of the group; rows without a page or an id are dropped."""
    if vetoes:
        labels = component_labels(veto_pairs(boxed_pairs(merge_margins(frags, scale)), frags, borders, **vetoes))
    else:
        labels = touching_labels(merge_margins(frags, scale), borders)  # the others are groups of their own
    return frags.dropna(subset=["page_id", "frag_id"]).join(labels, ["page_id", "frag_id"], "left").withColumn("group_id", F.coalesce("group_id", "frag_id"))


def merge_regions(frags: DataFrame, scale: float = 0.5, borders: DataFrame | None = None, confidence: bool = True, **vetoes) -> DataFrame:
    """Fragments (page_id, frag_id, box, text, conf, img_w, img_h, lang) to regions."""
    grouped = grouped_fragments(frags, scale, borders, **vetoes)
    if confidence:
        grouped = filter_by_confidence(with_floor(grouped))
    return assemble(order_fragments(grouped))


def region_boxes(frags: DataFrame, scale: float = 0.5, borders: DataFrame | None = None, **vetoes) -> DataFrame:
    """(page_id, group_id, cx, cy, x1 .. y2, confidence, n) of merge_regions' regions: nothing of it asks for lines or order."""
    grouped = filter_by_confidence(with_floor(grouped_fragments(frags, scale, borders, **vetoes)))
    ends = [(F.min if c[1] == "1" else F.max)(c).alias(c) for c in BOX]
    regions = grouped.groupBy("page_id", "group_id").agg(*ends, F.max("img_w").alias("img_w"), F.max("img_h").alias("img_h"), F.bround(F.min("conf"), 3).alias("confidence"), F.count("*").alias("n"))
    return box_to_pct(regions).select("page_id", "group_id", "cx", "cy", *[F.col(f"pct_{c}").alias(c) for c in BOX], "confidence", "n")


def merge_sweep(frags: DataFrame, scales: list[float], baseline: float) -> DataFrame:
    """For each scale (held to 0.1 .. 1.5) regions, fragments and pages whose groups differ from the baseline's.

    Reaches grow with the scale, so a pair touches from some scale on, which is its weight: pairs are
    searched once, at the largest, and a page's minimum spanning forest, cut at each scale, gives
    its groups there. A scale has as many regions as fragments less edges up to it; a page differs
    from the baseline where an edge lies between the two."""
    held = sorted({min(1.5, max(0.1, s)) for s in [*scales, baseline]})
    base = held.index(min(1.5, max(0.1, baseline)))
    pages = frags.groupBy("page_id").agg(F.count("*").alias("n"), F.max("img_w").alias("img_w"), F.max("img_h").alias("img_h"))
    widest = boxed_pairs(merge_margins(frags, held[-1])).join(pages.select("page_id", "img_w", "img_h"), "page_id")

    def touches(scale: Column) -> Column:
        margin = lambda side, way: _reach(F.col(f"{side}y2") - F.col(f"{side}y1"), scale, way)
        mh, mv = margin("a", SIDE_GAP) + margin("b", SIDE_GAP), margin("a", LINE_GAP) + margin("b", LINE_GAP)
        return (F.col("ax1") - F.col("bx2") <= mh) & (F.col("bx1") - F.col("ax2") <= mh) & (F.col("ay1") - F.col("by2") <= mv) & (F.col("by1") - F.col("ay2") <= mv)

    first = reduce(lambda rest, i: F.when(touches(F.lit(held[i])), i).otherwise(rest), range(len(held) - 2, -1, -1), F.lit(len(held) - 1))
    forest = forest_weights(widest.select("page_id", "a", "b", first.alias("weight")))
    w = F.col("weight")
    merged = forest.groupBy("page_id").agg(F.min(F.when(w > base, w)).alias("up"), F.max(F.when(w <= base, w)).alias("down"), *[F.sum(F.when(w <= i, F.col("n")).otherwise(0)).alias(f"m{i}") for i in range(len(held))])
    regions = [F.sum(F.col("n") - F.coalesce(f"m{i}", F.lit(0))).alias(f"r{i}") for i in range(len(held))]
    changed = [F.count_if(F.coalesce(F.col("up") <= i if i > base else F.col("down") > i, F.lit(False))).alias(f"c{i}") for i in range(len(held))]
    total = pages.join(merged, "page_id", "left").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("fragments"), *regions, *changed).where("fragments > 0")
    rows = F.array(*[F.struct(F.lit(s).alias("scale"), F.col(f"r{i}").alias("regions"), F.col("fragments"), F.col(f"c{i}").alias("changed_pages")) for i, s in enumerate(held)])
    return total.select(F.inline(rows))


def diff_regions(before: DataFrame, after: DataFrame) -> DataFrame:
    """(page_id, change) by members: unchanged, split (more regions), merged (fewer) or regrouped; text
    where only texts differ."""
    side = lambda df, n: df.groupBy("page_id").agg(F.count("*").alias(f"{n}_n"), F.array_sort(F.collect_list(F.array_sort("members"))).alias(f"{n}_m"), F.array_sort(F.collect_list(F.struct("members", "text"))).alias(f"{n}_t"))
    both = side(before, "b").join(side(after, "a"), "page_id", "full")
    same = F.col("b_m") == F.col("a_m")
    n = lambda c: F.coalesce(c, F.lit(0))
    return both.select("page_id", F.when(same & (F.col("b_t") == F.col("a_t")), "unchanged").when(same, "text").when(n("a_n") > n("b_n"), "split").when(n("a_n") < n("b_n"), "merged").otherwise("regrouped").alias("change"))


def best_iou(boxes: DataFrame, regions: DataFrame, floor: float = 0.35) -> DataFrame:
    """(page_id, box_id, region_id, iou) of the region that overlaps a box most, strictly above floor;
    the first region wins ties; deleted regions don't count."""
    b, r = boxes.alias("b"), regions.where("NOT coalesce(deleted, false)").alias("r")
    w = F.least("b.x2", "r.x2") - F.greatest("b.x1", "r.x1")
    h = F.least("b.y2", "r.y2") - F.greatest("b.y1", "r.y1")
    area = lambda s: (F.col(f"{s}.x2") - F.col(f"{s}.x1")) * (F.col(f"{s}.y2") - F.col(f"{s}.y1"))
    met = b.join(r, (F.col("b.page_id") == F.col("r.page_id")) & (w > 0) & (h > 0)).select("b.page_id", "b.box_id", "r.region_id", F.try_divide(w * h, area("b") + area("r") - w * h).alias("iou")).where(F.col("iou") > floor)
    return met.groupBy("page_id", "box_id").agg(F.min_by("region_id", F.struct(-F.col("iou"), F.col("region_id"))).alias("region_id"), F.max("iou").alias("iou"))


def point_in_box(boxes: DataFrame, regions: DataFrame) -> DataFrame:
    """(page_id, box_id, region_id): the smallest translated region whose centre lies in the box."""
    b, r = boxes.alias("b"), regions.where("trim(coalesce(tl, '')) NOT IN ('', '—')").alias("r")
    inside = (F.col("b.page_id") == F.col("r.page_id")) & F.col("r.cx").between(F.col("b.x1"), F.col("b.x2")) & F.col("r.cy").between(F.col("b.y1"), F.col("b.y2"))
    area = (F.col("r.x2") - F.col("r.x1")) * (F.col("r.y2") - F.col("r.y1"))
    return b.join(r, inside).groupBy("b.page_id", "b.box_id").agg(F.min_by("r.region_id", F.struct(area, F.col("r.region_id"))).alias("region_id"))


def reading_order(regions: DataFrame, rtl: Column, band: float = 8.0) -> DataFrame:
    """regions(page_id, region_id, cx, cy) with `pos` from 1. Bands start at their first centre and
    end before one that lies `band` percent below; within a band the right comes first where rtl."""
    items = F.expr("array_sort(collect_list(struct(cy, cx, region_id)))")
    folded = regions.groupBy("page_id").agg(items.alias("rs"), F.max(rtl).alias("rtl"))
    bands = F.expr(f"""aggregate(rs, cast(struct(array() AS at, -1D AS start, 0 AS n) AS struct<at:array<int>,start:double,n:int>), (a, x) -> if(a.n = 0 OR x.cy - a.start >= {band},
      struct(concat(a.at, array(a.n + 1)) AS at, x.cy AS start, a.n + 1 AS n), struct(concat(a.at, array(a.n)) AS at, a.start AS start, a.n AS n))).at""")
    placed = folded.withColumn("bands", bands).withColumn("o", F.expr("array_sort(zip_with(rs, bands, (r, b) -> struct(b AS band, if(rtl, -r.cx, r.cx) AS x, r.cy AS cy, r.region_id AS id)))"))
    return placed.select("page_id", F.posexplode_outer("o").alias("p", "m")).select("page_id", F.col("m.id").alias("region_id"), F.col("m.band").alias("band"), (F.col("p") + 1).alias("pos"))
