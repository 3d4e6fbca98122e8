"""Grouping, lines, columns, assembly and matching on hand-made pages."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagetext.functions import alike
from pagetext.functions.text import marked_share
from pagetext.operators import fragments as op
from pagetext.operators import graph, matching, replies, runs
from pagetext.sources.tables import expand_archives, failure_counts, image_runs, ocr_pages

SCHEMA = "page_id bigint, frag_id bigint, x1 double, y1 double, x2 double, y2 double, text string, conf double, img_w int, img_h int, lang string, group_id bigint"


def page(spark, boxes, w=900, h=600, texts=None):
    rows = [(1, i, *map(float, b), (texts or {}).get(i, f"t{i}"), 0.9, w, h, "es", 0) for i, b in enumerate(boxes)]
    return spark.createDataFrame(rows, SCHEMA)


def sizes(df):
    return sorted(Counter(r.group_id for r in df.collect()).values())


def test_margins(spark):
    got = op.merge_margins(page(spark, [(0, 0, 9, 10), (0, 0, 9, 100), (0, 0, 9, 0)])).orderBy("frag_id").collect()
    assert got[1].margin_v > 5 * got[0].margin_v and got[1].margin_h == 15 and (got[2].margin_v, got[2].margin_h) == (4, 4)
    tall = op.merge_margins(page(spark, [(0, 0, 9, 100)], 800, 4000)).first().margin_v
    assert tall < op.merge_margins(page(spark, [(0, 0, 9, 100)], 800, 1200)).first().margin_v


@pytest.mark.parametrize(
    ("boxes", "borders", "want"),
    [
        ([(100, 100, 300, 140), (320, 100, 500, 140)], [], [1, 1]),
        ([(100, 100, 300, 140), (305, 100, 500, 140)], [], [2]),
        ([(100, 100, 300, 140), (100, 150, 300, 190)], [], [2]),
        ([(100, 300, 300, 325), (100, 335, 300, 360)], [("h", 330)], [1, 1]),
        ([(100, 100, 300, 120), (100, 125, 300, 145), (100, 150, 300, 170), (700, 500, 800, 520)], [], [1, 3]),
    ],
)
def test_groups(spark, boxes, borders, want):
    lines = spark.createDataFrame([(1, *b) for b in borders], "page_id bigint, axis string, pos int") if borders else None
    assert sizes(op.grouped_fragments(page(spark, boxes).drop("group_id"), borders=lines)) == want


def test_confidence(spark):
    df = page(spark, [(0, 0, 1, 1)] * 3).withColumn("group_id", F.when(F.col("frag_id") == 2, 2).otherwise(0)).withColumn("conf", F.when(F.col("frag_id") == 0, 0.9).otherwise(0.35)).withColumn("min_conf", F.lit(0.5))
    kept = lambda floor: sorted(r.frag_id for r in op.filter_by_confidence(df, floor=floor).collect())
    assert kept(0.3) == [0, 1] and kept(0.4) == [0]


def test_lines_and_text(spark):
    stack = page(spark, [(10, 18 * i, 90, 18 * i + 20) for i in range(5)])
    assert sorted(r.line for r in op.line_ids(stack).collect()) == [1, 2, 3, 4, 5]
    df = page(spark, [(100, 100, 130, 120), (140, 102, 200, 121), (100, 125, 150, 145)], 1000, 1000, {0: "un", 1: "pa-", 2: "seo."})
    region = op.assemble(op.order_fragments(df)).first()
    assert region.text == "un paseo." and region.members == [0, 1, 2] and (region.x1, region.y2) == (10.0, 14.5)


def test_columns(spark):
    two = [(100, 30 * i, 200, 30 * i + 20) for i in range(4)] + [(240, 30 * i, 340, 30 * i + 20) for i in range(4)]
    split = op.order_fragments(page(spark, two)).first()
    assert split.split and [m.id for m in split.ordered] == list(range(8))
    assert not op.order_fragments(page(spark, two[:4])).first().split


def test_reading_order(spark):
    rows = [(1, 0, 80.0, 10.0), (1, 1, 20.0, 12.0), (1, 2, 50.0, 30.0)]
    df = spark.createDataFrame(rows, "page_id int, region_id int, cx double, cy double")
    order = lambda rtl: [r.region_id for r in op.reading_order(df, F.lit(rtl)).orderBy("pos").collect()]
    assert order(True) == [0, 1, 2] and order(False) == [1, 0, 2]


def test_candidates_by_either_metric(spark):
    """Every pair of a page compared, with no regard to lengths."""
    import difflib

    rng = random.Random(7)
    make = lambda: "".join(rng.choice("abé d-") for _ in range(rng.randrange(0, 14)))
    fold = lambda t: "".join(c for c in t.replace("é", "e") if c.isalnum())
    a, b = ([(p, i, make()) for p in range(2) for i in range(25)] for _ in range(2))
    frames = [spark.createDataFrame(rows, "page_id int, item_id int, text string") for rows in (a, b)]

    def distance(x, y):
        row = list(range(len(y) + 1))
        for i, c in enumerate(x, 1):
            before, row[0] = row[0], i
            for j, d in enumerate(y, 1):
                before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (c != d))
        return row[-1]

    measures = {"levenshtein": lambda x, y: 1 - distance(x, y) / max(len(x), len(y)), "ratcliff": lambda x, y: difflib.SequenceMatcher(None, x, y, autojunk=False).ratio()}
    for metric, measure in measures.items():
        every = {(p, i, j): round(measure(fold(x), fold(y)), 6) for p, i, x in a for q, j, y in b if p == q and min(len(fold(x)), len(fold(y))) >= 3}
        want = {k: v for k, v in every.items() if v >= 0.45}
        assert {(r.page_id, r.a, r.b): r.ratio for r in matching.match_candidates(*frames, metric=metric).collect()} == pytest.approx(want) and want
        taken, kept = set(), set()
        for (p, i, j), _ in sorted(want.items(), key=lambda kv: (-kv[1], kv[0])):
            if not {(p, "a", i), (p, "b", j)} & taken:
                taken |= {(p, "a", i), (p, "b", j)}
                kept.add((p, i, j))
        assert {(r.page_id, r.a, r.b) for r in matching.match_regions(*frames, metric=metric).collect()} == kept


@pytest.mark.parametrize("metric", ["levenshtein", "ratcliff"])
def test_index_finds_what_all_pairs_do(spark, metric):
    """Texts of few letters, repeated and alike ones among them, at several thresholds."""
    rng = random.Random(8)
    make = lambda: "".join(rng.choice("abcde1") for _ in range(rng.randrange(3, 14)))
    base = [make() for _ in range(30)]
    near = lambda: (lambda t: t[:2] + rng.choice("abz") + t[3:])(rng.choice(base))
    frames = [spark.createDataFrame([(p, i, rng.choice([make, near, near, lambda: rng.choice(base)])()) for p in range(2) for i in range(50)], "page_id int, item_id int, text string") for _ in range(2)]
    for ratio in (0.5, 0.8, 0.95):
        every = {tuple(r) for r in matching.match_candidates(*frames, ratio, metric).collect()}
        sides = [matching._folded(f, s) for f, s in zip(frames, "ab", strict=True)]
        indexed = [tuple(r) for r in matching.indexed_candidates(*sides, ratio, metric).collect()]
        assert len(indexed) == len(set(indexed)) and set(indexed) == every and every
    taken, kept = set(), set()
    for p, i, j, r in sorted((tuple(r) for r in matching.match_candidates(*frames, 0.45, metric).collect()), key=lambda r: (-r[3], r[1], r[2])):
        if not {(p, "a", i), (p, "b", j)} & taken:
            taken |= {(p, "a", i), (p, "b", j)}
            kept.add((p, i, j, r))
    for likely in (0.3, 0.7, 0.9):
        assert {tuple(r) for r in matching.match_regions(*frames, metric=metric, likely=likely).collect()} == kept


def test_matches_are_greedy(spark):
    rng = random.Random(0)
    make = lambda: "".join(rng.choice("abc") for _ in range(rng.randrange(3, 7)))
    a, b = ([(1, i, make(), 1.0, 1.0, 0.5) for i in range(12)] for _ in range(2))
    frame = lambda rows: spark.createDataFrame(rows, "page_id int, item_id int, text string, cx double, cy double, conf double")
    left = matching.match_candidates(frame(a), frame(b)).collect()
    want, used_a, used_b = set(), set(), set()
    for r in sorted(left, key=lambda r: (-r.ratio, r.a, r.b)):
        if r.a not in used_a and r.b not in used_b:
            want.add((r.a, r.b))
            used_a.add(r.a)
            used_b.add(r.b)
    assert {(r.a, r.b) for r in matching.match_regions(frame(a), frame(b)).collect()} == want


def test_both_outputs_meet_by_page_once(spark):
    """No step before the last runs jobs or shuffles of its own."""
    frame = spark.createDataFrame([(1, 1, "one text"), (1, 2, "other text")], "page_id int, item_id int, text string")
    spark.sparkContext.setJobGroup("matches", "")
    for found in (matching.match_regions(frame, frame), matching.match_regions(frame, frame, metric="ratcliff"), matching.match_candidates(frame, frame)):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange ") == 1 and "Join" not in plan
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup("matches")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_distances_of_long_texts():
    """Texts of one and more words of 64 letters, equal, empty and of one letter too."""
    rng = random.Random(3)
    texts = alike.Texts([bytes(rng.choice(b"abc1z") for _ in range(rng.choice([0, 1, 3, 40, 63, 64, 65, 128, 129, 200]))) for _ in range(40)])

    def distance(x, y):
        row = list(range(len(y) + 1))
        for i, c in enumerate(x, 1):
            before, row[0] = row[0], i
            for j, d in enumerate(y, 1):
                before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (c != d))
        return row[-1]

    x, y = np.arange(200) % 40, np.array([rng.randrange(40) for _ in range(200)])
    assert texts.distances(x, y).tolist() == [distance(texts.texts[i], texts.texts[j]) for i, j in zip(x, y, strict=True)]
    assert alike.six_decimals(np.array([1 - 1 / 128, 0.4999995])).tolist() == [0.992188, 0.5]


def test_runs(spark):
    ring = [(1, y, x0, x1) for y in range(2, 8) for x0, x1 in ([(2, 9)] if y in (2, 7) else [(2, 3), (8, 9)])]
    df = spark.createDataFrame(ring, "page_id bigint, y int, x0 int, x1 int")
    pages = spark.createDataFrame([(1, 12, 10)], "page_id bigint, w int, h int")
    assert runs.components_of_runs(df).select("label").distinct().count() == 1
    assert runs.fill_holes(df, pages).agg(F.sum(F.col("x1") - F.col("x0") + 1)).first()[0] == 48


def strip(spark, rows):
    return spark.createDataFrame(rows, "page_id bigint, y int, x0 int, x1 int")


def boxes_of(spark, rows):
    return spark.createDataFrame([(1, *r) for r in rows], "page_id bigint, box_id int, x1 int, y1 int, x2 int, y2 int")


def pairs(df):
    return sorted((r.a, r.b) for r in df.collect())


def test_runs_of_tall_and_wide_pages(spark):
    df = strip(spark, [(1, 21_600, 0, 5), (1, 21_601, 150_000, 150_005), (1, 21_601, 3, 9)])
    got = {(r.y, r.x0): r.label for r in runs.components_of_runs(df).collect()}
    assert got[21_600, 0] == got[21_601, 3] == 21_601 * 2**32 and got[21_601, 150_000] == 21_602 * 2**32 + 150_000


def test_waist_veto(spark):
    """Two lobes of 20 rows joined by a neck of 6: pinched; by one of 18: not; boxes one above the other: not asked."""
    lobes = lambda neck: strip(spark, [(1, y, 0, 30) for y in range(20)] + [(1, y, 31, 50) for y in range(neck)] + [(1, y, 51, 80) for y in range(20)])
    boxes = boxes_of(spark, [(1, 5, 5, 15, 15), (2, 60, 5, 70, 15), (3, 5, 16, 15, 19)])
    found = lambda neck: {(r.a, r.b): round(r.ratio, 2) for r in runs.waist_veto(boxes, runs.components_of_runs(lobes(neck)), most=0.85).collect()}
    assert found(6) == {(1, 2): 0.3, (2, 3): 0.3} and found(18) == {}


def test_container_veto(spark):
    """In different containers, one in and one out, both in one: vetoed, vetoed, not."""
    solid = runs.components_of_runs(strip(spark, [(1, y, x, x + 19) for y in range(20) for x in (0, 40)]))
    boxes = boxes_of(spark, [(1, 2, 2, 8, 8), (2, 10, 10, 16, 16), (3, 42, 2, 50, 10), (4, 100, 2, 110, 10)])
    assert pairs(runs.container_veto(boxes, solid)) == [(1, 3), (1, 4), (2, 3), (2, 4), (3, 4)]


def test_path_label_veto(spark):
    solid = runs.components_of_runs(strip(spark, [(1, y, x, x + 19) for y in range(20) for x in (0, 40)]))
    boxes = boxes_of(spark, [(1, 2, 2, 8, 8), (2, 10, 2, 16, 8), (3, 42, 2, 50, 8)])
    assert pairs(runs.path_label_veto(boxes, solid)) == [(1, 3), (2, 3)]


@pytest.mark.parametrize(("rows", "tone", "veto"), [(range(0), 200, False), (range(4, 6), 200, False), (range(10), 200, True), ([0, 2, 3, 5, 6, 8], 200, True), (range(10), 40, False), (range(10), None, None)])
def test_gap_profile_veto(spark, rows, tone, veto):
    """Rows of full ink veto, as does a band whose clear stretches are short; ink of the other level doesn't count."""
    ink = spark.createDataFrame([(1, y, 0, 30 if len(rows) == 6 else 3 if len(rows) == 2 else 99, "dark") for y in rows], "page_id bigint, y int, x0 int, x1 int, level string")
    bands = spark.createDataFrame([(1, 0, 0, 100, 10, tone)], "page_id bigint, gx1 int, gy1 int, gx2 int, gy2 int, tone int")
    assert runs.gap_profile_veto(bands, ink).first().veto == veto


def test_residual_check(spark):
    before = strip(spark, [(1, y, 0, 50) for y in range(20)])
    boxes = boxes_of(spark, [(1, 0, 0, 40, 20), (2, 45, 0, 60, 20)])
    after = strip(spark, [(1, 3, 5, 9), (1, 4, 5, 9), (1, 9, 20, 20), (1, 15, 55, 59)])
    got = {r.box_id: (r.pixels, r.blob, r.flagged) for r in runs.residual_check(before, after, boxes).collect()}
    assert got == {1: (11, 10, True), 2: (0, 0, False)}


def test_sweep_agrees_with_groups(spark):
    rng = random.Random(5)
    rows = [(p, i, float(x := rng.randrange(600)), float(y := rng.randrange(400)), float(x + 40), float(y + 12), "t", 0.9, 900, 2000 if p else 600, "es") for p in range(3) for i in range(40)]
    df = spark.createDataFrame(rows, SCHEMA.replace(", group_id bigint", ""))
    scales = [0.1, 0.5, 1.0, 1.5]
    sweep = {r.scale: (r.regions, r.fragments, r.changed_pages) for r in op.merge_sweep(df, scales, 0.5).collect()}
    groups = {s: {(r.page_id, r.frag_id): r.group_id for r in op.grouped_fragments(df, s).collect()} for s in scales}
    changed = lambda s: sum(any(groups[s][k] != groups[0.5][k] for k in groups[s] if k[0] == p) for p in range(3))
    assert sweep == {s: (len({(k[0], g) for k, g in groups[s].items()}), 120, changed(s)) for s in scales}


def test_rescale_and_cluster(spark):
    rows = [("a", 1, i, 0.97, 0.5 + i * 0.01, 0.9, 0.4, 0.99, 0.6) for i in range(4)] + [("a", 2, 0, 970.0, 400.0, None, None, None, None), ("a", 2, 1, 300.0, 1200.0, 100.0, 2.0, 1500.0, 30.0)]
    df = spark.createDataFrame(rows, "side string, page_id int, item_id int, cx double, cy double, x1 double, y1 double, x2 double, y2 double")
    got = {(r.page_id, r.item_id): tuple(r)[3:] for r in matching.fill_boxes(matching.fix_right_cluster(matching.rescale_coords(df))).collect()}
    assert got[1, 3] == (8.0, 95.0, 3.0, 91.5, 13.0, 98.5) and got[1, 1][:2] == (8.0, 35.0)
    assert got[2, 0] == (97.0, 40.0, 89.0, 35.0, 105.0, 45.0) and got[2, 1] == (30.0, 99.0, 10.0, 0.2, 100.0, 3.0)


def test_orphans_cap_before_size(spark):
    rows = [(1, i, 0.0, 0.0, 0.1 if i < 3 else 50.0, 50.0, 960, 1500) for i in range(6)]
    df = spark.createDataFrame(rows, "page_id int, item_id int, x1 double, y1 double, x2 double, y2 double, img_w int, img_h int")
    assert [r.item_id for r in matching.orphans(df, spark.createDataFrame([], "page_id int, a int")).collect()] == [3]


def test_calls(spark):
    def call(instruction, items):
        if items == "bad":
            raise ValueError("no")
        if items == "busy":
            raise ConnectionError("429")
        return items.upper()

    asked = spark.createDataFrame([("x", "ok"), ("x", "bad"), ("x", "busy")], "instruction string, items string")
    done = {r["items"]: (r.body, r.status) for r in replies.translate_pages(asked, call, delays=(0.01,)).collect()}
    assert done == {"ok": ("OK", "ok"), "bad": (None, "error"), "busy": (None, "error")}


def test_sources(spark, tmp_path):
    import io
    import zipfile

    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("a/1.png", b"x")
        z.writestr("a/2.png", b"y")
    files = spark.createDataFrame([("ok.cbz", bytearray(data.getvalue())), ("bad.zip", bytearray(b"no"))], "path string, content binary")
    got = expand_archives(files).collect()
    assert sorted(r.path for r in got if r.path) == ["a/1.png", "a/2.png"] and sum(r.error is not None for r in got) == 1
    image = spark.createDataFrame([(1, 4, 2, 1, bytearray([0, 0, 255, 0, 255, 255, 255, 255]))], "page_id bigint, width int, height int, channels int, data binary")
    assert {(r.y, r.x0, r.x1) for r in image_runs(image, 100).collect()} == {(0, 0, 1), (0, 3, 3)}
    pages = spark.createDataFrame([(1, bytearray(b"a")), (2, bytearray(b"b")), (3, bytearray(b"c"))], "page_id bigint, content binary")
    one = [(0.0, 0.0, 1.0, 1.0, "t", 0.32)]
    read = ocr_pages(pages, lambda c, f: [(*one[0][:5], 0.9)] if c == b"a" else [], lambda c, f: one if c == b"b" else [])
    assert {r.page_id: r.reason for r in read.collect()} == {1: None, 2: None, 3: "empty"}
    assert [(r.reason, r.pages) for r in failure_counts(read).collect()] == [("empty", 1)]


def test_letters_and_equal_lines_take_no_table(spark):
    """Marks are counted in one go over a batch, not by expressions on each text, and equal lines are not compared."""
    rows = [(1, 0, "es", e, t, 0.9) for e, t in (("truth", "Ábc ×1"), ("light", "abc 1"), ("heavy", None))] + [(2, 0, "es", "truth", None, 0.1)]
    lines = spark.createDataFrame(rows, "doc_id int, line int, lang string, engine string, text string, conf double")
    told = matching.text_quality(lines, ["light", "heavy", "truth"])
    plan = told._jdf.queryExecution().executedPlan().toString()
    assert "regexp_replace" not in plan and "CASE WHEN (folded" in plan
    assert {r.engine: (r.marked, r.similarity, r.dropped) for r in told.collect()} == {"truth": (0.5, 0.5, 0.0), "light": (0.0, 0.5, 0.0), "heavy": (None, 0.0, None)}
    texts = spark.createDataFrame([("Éa",), ("",), (None,), ("12 ñ",)], "text string")
    shares = texts.select(marked_share(F.col("text")).alias("s"))
    assert "regexp_replace" not in shares._jdf.queryExecution().executedPlan().toString()
    assert [r.s for r in shares.collect()] == [0.5, None, None, 1.0]


def test_pages_are_read_where_they_are(spark):
    """Images are not shuffled to the fallback, and many pages' fragments come together."""
    pages = spark.createDataFrame([(i, bytearray(b"ab"[i % 2 : i % 2 + 1])) for i in range(40)], "page_id bigint, content binary").coalesce(1)
    calls = spark.sparkContext.accumulator(0)

    def first(content, floor):
        calls.add(1)
        return [(0.0, 0.0, 1.0, 1.0, "t", 0.9)] * 3 if content == b"a" else []

    spark.sparkContext.setJobGroup("pages", "")
    read = ocr_pages(pages, first, lambda content, floor: [(0.0, 0.0, 1.0, 1.0, "u", 0.31)])
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("pages")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert Counter(r.text for r in read.collect()) == {"t": 60, "u": 20} and calls.value == 40
    assert len(jobs) <= 2 and "Join" not in read._jdf.queryExecution().executedPlan().toString()


def test_groups_take_one_pass_over_pages(spark):
    """Fragments and borders meet by page once: pairs are neither joined nor shuffled; groups are those of the pairs."""
    rng = random.Random(5)
    rows = [(p, i, float(x := rng.randrange(800)), float(y := rng.randrange(500)), x + rng.randrange(5, 90) + 0.5, y + rng.randrange(1, 60) + 0.25, "t", 0.9, 900, 600, "es", 0) for p in range(6) for i in range(60)]
    frags = spark.createDataFrame([*rows, (7, 2**60 + 1, 0.0, 0.0, 9.0, 9.0, "t", 0.9, 900, 600, "es", 0), (7, 2**60, 2.0, 2.0, 9.0, 9.0, "t", 0.9, 900, 600, "es", 0), (8, 1, None, 1.0, 2.0, 3.0, "t", 0.9, 900, 600, "es", 0)], SCHEMA).drop("group_id")
    borders = spark.createDataFrame([(p, axis, float(rng.randrange(500))) for p in range(4) for axis in "hv" for _ in range(6)], "page_id bigint, axis string, pos double")
    reach = op.merge_margins(frags)
    for lines in (None, borders):
        pairs = op.boxed_pairs(reach) if lines is None else op.veto_pairs(op.boxed_pairs(reach), frags, lines)
        want = {tuple(r) for r in graph.group_components(frags, pairs.select("page_id", "a", "b")).collect()}
        found = op.grouped_fragments(frags, borders=lines).select("page_id", "frag_id", "group_id")
        assert {tuple(r) for r in found.collect()} == want and len({(p, g) for p, _, g in want}) < len(want) - 20
        plan = op.touching_labels(reach, lines)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange ") == 1 and "Join" not in plan


def test_place_matches_is_matched_regions(spark):
    """In one pass by page what the matches, joined to both outputs, give; rows without a page, an id or a text too."""
    rng = random.Random(5)
    nan, words = float("nan"), ["alpha", "alphq", "beta", "betta", "gamma", "gamut", "delta", "", None]
    kinds = "page_id bigint, item_id bigint, text string, cx double, cy double, x1 double, y1 double, x2 double, y2 double, conf double, members array<bigint>"
    number = lambda: rng.choice([None, nan, float(rng.randrange(90))])
    rows = lambda k: [(p, i, rng.choice(words), *(number() for _ in range(7)), [k * 1000 + (i or 0), k]) for p in [*range(40), None] for i in [*range(6), *[None] * (p == 7)]]
    a, b = (spark.createDataFrame(rows(k), kinds).repartition(3) for k in (1, 2))
    columns = ["page_id", "item_id", "cx", "cy", "x1", "y1", "x2", "y2", "conf", "members"]
    shown = lambda df: Counter(str(tuple(r)) for r in df.select(columns).collect())
    found = matching.place_matches(a.drop("conf", "members"), b)
    want = matching.matched_regions(a, b, matching.match_regions(a, b))
    assert shown(found) == shown(want) and sum(r.conf is not None for r in found.collect()) > 20


def test_large_tables_are_not_broadcast(spark, monkeypatch):
    from pagetext.plans import fixtures
    from pagetext.plans import matching as plans

    monkeypatch.setattr(fixtures, "BROADCAST_ROWS", 100, raising=False)
    plan = plans.matched_regions(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and plan.count("part.parquet") + plan.count("p_partkey") > 0
