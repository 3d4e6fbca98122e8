"""Run tables against pixels: overlaps tile by tile, envelopes, waists, bands with equal boxes."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagetext.operators import runs
from pagetext.sources.tables import image_runs

RUN = "page_id bigint, label bigint, y int, x0 int, x1 int"
BOX = "page_id bigint, box_id int, x1 int, y1 int, x2 int, y2 int"


def random_runs(rng, pages=3, height=150, width=300, labels=4):
    """Runs that don't overlap within a row, some of a few pixels, some across many tiles."""
    rows = []
    for page in range(pages):
        for y in range(height):
            x = rng.randrange(-20, 30)
            while x < width:
                n = rng.choice([1, 2, 5, 30, 90])
                rows.append((page, rng.randrange(labels), y, x, x + n - 1))
                x += n + rng.randrange(1, 40)
    return rows


def random_boxes(rng, n, pages=3, height=150, width=300):
    boxes = []
    for i in range(n):
        x, y = rng.randrange(-30, width), rng.randrange(-30, height)
        boxes.append((rng.randrange(pages), i, x, y, x + rng.choice([0, 3, 40, 200]), y + rng.choice([1, 9, 130])))
    return boxes


def label_map(rows, page, height, width, low=200):
    """Labels plus one at [y + low, x + low]; 0 where no run is."""
    out = np.zeros((height + 2 * low, width + 2 * low), int)
    for p, label, y, x0, x1 in rows:
        if p == page:
            out[y + low, x0 + low : x1 + low + 1] = label + 1
    return out


@pytest.mark.parametrize("pad", [0, 14])
def test_overlap_equals_pixels(spark, pad):
    rng = random.Random(pad)
    rows, boxes = random_runs(rng), random_boxes(rng, 40)
    got = {(r.page_id, r.box_id, r.label): r.pixels for r in runs._overlap(spark.createDataFrame(rows, RUN), spark.createDataFrame(boxes, BOX), pad).collect()}
    want = {}
    maps = [label_map(rows, p, 150, 300) for p in range(3)]
    for p, i, x1, y1, x2, y2 in boxes:
        part = maps[p][max(0, y1 - pad + 200) : y2 + pad + 200, max(0, x1 - pad + 200) : x2 + pad + 200]
        for label, n in zip(*np.unique(part[part > 0], return_counts=True), strict=True):
            want[p, i, int(label) - 1] = int(n)
    assert got == want and len(want) > 60


def test_envelope_equals_pixels(spark):
    rng = random.Random(2)
    rows = random_runs(rng, height=60)
    got = {}
    for r in runs.column_extents(spark.createDataFrame(rows, RUN)).collect():
        for x in range(r.x0, r.x1 + 1):
            assert (r.page_id, r.label, x) not in got
            got[r.page_id, r.label, x] = r.extent
    columns = {}
    for p, label, y, x0, x1 in rows:
        for x in range(x0, x1 + 1):
            low, high = columns.get((p, label, x), (y, y))
            columns[p, label, x] = (min(low, y), max(high, y))
    assert got == {k: high - low + 1 for k, (low, high) in columns.items()}


def test_envelope_rows_grow_with_runs_not_width(spark):
    wide = spark.createDataFrame([(1, 1, y, y * 10, 5_000_000 - y * 10) for y in range(40)], RUN)
    assert runs.column_extents(wide).count() == 79


def test_least_of_stretches():
    rng = np.random.default_rng(4)
    values = rng.integers(0, 1000, 200)
    first = rng.integers(0, 200, 500)
    last = np.minimum(first + rng.integers(0, 200, 500), 199)
    assert (runs._least(values, first, last) == [values[a : b + 1].min() for a, b in zip(first, last, strict=True)]).all()
    assert len(runs._least(values, first[:0], last[:0])) == 0


def test_waists_equal_pixels(spark):
    """Components of random runs: least column extent between two centres over the smaller end."""
    rng = random.Random(5)
    rows = []
    for page in range(4):
        top, bottom = 20, 60
        for x in range(0, 240):
            top = min(max(top + rng.choice([-3, 0, 3]), 0), 36)
            bottom = max(min(bottom + rng.choice([-3, 0, 3]), 80), 40)
            rows += [(page, y, x, x) for y in range(top, bottom)]
    labelled = runs.components_of_runs(runs.merged_runs(spark.createDataFrame(rows, "page_id bigint, y int, x0 int, x1 int")))
    boxes = [(p, i, x, y, x + w, y + 8) for p in range(4) for i, (x, y, w) in enumerate((rng.randrange(-10, 230), rng.randrange(30, 45), rng.choice([6, 21])) for _ in range(12))]
    got = {(r.page_id, r.a, r.b): r.ratio for r in runs.waist_veto(spark.createDataFrame(boxes, BOX), labelled, most=0.9).collect()}
    extents = [{x: sum(1 for q, _, c, _ in rows if q == p and c == x) for x in range(240)} for p in range(4)]
    want = {}
    for p, a, *s in boxes:
        for q, b, *t in boxes:
            (ax, ay), (bx, by) = (((k[0] + k[2]) // 2, (k[1] + k[3]) // 2) for k in (s, t))
            if p == q and a < b and abs(ax - bx) > abs(ay - by) and abs(ax - bx) >= 12:
                low, high = max(min(ax, bx), 0), min(max(ax, bx), 239)
                span = [extents[p][x] for x in range(low, high + 1)]
                if high - low >= 12 and min(span) / min(span[0], span[-1]) <= 0.9:
                    want[p, a, b] = min(span) / min(span[0], span[-1])
    assert got == pytest.approx(want) and len(want) > 5


def test_near_pairs(spark):
    rng = random.Random(6)
    boxes = random_boxes(rng, 60)
    got = [(r.page_id, r.a, r.b) for r in runs.near_pairs(spark.createDataFrame(boxes, BOX), 30).collect()]
    solid = [b for b in boxes if b[2] < b[4] and b[3] < b[5]]
    want = {(p[0], p[1], q[1]) for p in solid for q in solid if p[0] == q[0] and p[1] < q[1] and p[2] - 30 < q[4] and q[2] - 30 < p[4] and p[3] - 30 < q[5] and q[3] - 30 < p[5]}
    assert len(got) == len(set(got)) and set(got) == want and want


def test_no_join_by_page_alone(spark):
    """A strip of 20,000 rows and 500 boxes: runs and boxes meet in tiles."""
    strip = spark.range(60_000).select((F.least(F.col("id"), F.lit(0)) + 1).alias("page_id"), (F.col("id") % 3).alias("label"), F.floor(F.col("id") / 3).cast("int").alias("y"), ((F.col("id") % 3) * 300).cast("int").alias("x0"), ((F.col("id") % 3) * 300 + 250).cast("int").alias("x1"))
    boxes = spark.range(500).select((F.least(F.col("id"), F.lit(0)) + 1).alias("page_id"), F.col("id").cast("int").alias("box_id"), F.lit(40).alias("x1"), (F.col("id") * 39).cast("int").alias("y1"), F.lit(640).alias("x2"), (F.col("id") * 39 + 200).cast("int").alias("y2"))
    found = runs.box_coverage(boxes, strip)
    assert {(r.label, round(r.share, 6)) for r in found.collect()} == {(1, round(251 / 600, 6))}
    for frame in (found, runs.path_label_veto(boxes, strip), runs.container_veto(boxes, strip), runs.residual_check(strip, strip, boxes)):
        plan = frame._jdf.queryExecution().optimizedPlan().toString()
        for line in plan.splitlines():
            if "Join " in line:
                assert line.count(" = ") + line.count("<=>") > 1, line


def test_bands_of_one_box_and_two_tones(spark):
    ink = spark.createDataFrame([(1, y, 0, 99, "dark") for y in range(10)], "page_id bigint, y int, x0 int, x1 int, level string")
    bands = spark.createDataFrame([(1, 0, 0, 100, 10, 200), (1, 0, 0, 100, 10, 20), (1, 0, 0, 100, 10, None), (1, 0, 0, 100, 10, 200)], "page_id bigint, gx1 int, gy1 int, gx2 int, gy2 int, tone int")
    assert sorted((r.tone or -1, r.veto) for r in runs.gap_profile_veto(bands, ink).collect()) == [(-1, None), (20, False), (200, True), (200, True)]


def test_components_whatever_the_bands(spark):
    """Random runs with snakes through many bands, against a flood over pixels; a page larger than a batch."""
    rng = random.Random(7)
    rows = [(p, y, x0, x1) for p, _, y, x0, x1 in random_runs(rng, pages=2, height=60, width=120, labels=1)]
    rows += [(2, y, 5 * (y % 2), 5 * (y % 2) + 5) for y in range(500)]
    df = spark.createDataFrame(rows, "page_id bigint, y int, x0 int, x1 int").repartition(3)
    root = {}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for reach in (0, 1):
        root = {r: r for r in rows}
        by = {}
        for r in rows:
            by.setdefault(r[:2], []).append(r)
        for r in rows:
            for t in by.get((r[0], r[1] + 1), []):
                if t[2] <= r[3] + reach and t[3] >= r[2] - reach:
                    u, v = find(r), find(t)
                    root[max(u, v)] = min(u, v)
        want = {r: (find(r)[1] + 1 << 32) + find(r)[2] for r in rows}
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 100)
        try:
            for band in (1, 7, 64, 4096):
                assert {(r.page_id, r.y, r.x0, r.x1): r.label for r in runs.components_of_runs(df, reach, band).collect()} == want
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_container_veto_of_far_boxes_and_shared_ids(spark):
    """Boxes 900 px apart are a pair too; of boxes that share an id each has its own rows, and no more."""
    solid = spark.createDataFrame([(1, x, y, x, x + 19) for y in range(20) for x in (40, 1000)], RUN)
    boxes = spark.createDataFrame([(1, 1, 42, 2, 50, 10), (1, 2, 1002, 2, 1010, 10), (1, 2, 1004, 2, 1012, 10), (1, 3, 44, 2, 52, 10)], BOX)
    assert sorted((r.a, r.b) for r in runs.container_veto(boxes, solid).collect()) == [(1, 2), (1, 2), (2, 3), (2, 3)]


def test_path_label_veto_of_far_boxes(spark):
    """All pairs of a page, against patches pixel by pixel."""
    rng = random.Random(11)
    rows, boxes = random_runs(rng, pages=2, height=40, width=1500), []
    rows = [(p, label + 1, y, x0, x1) for p, label, y, x0, x1 in rows]
    for i in range(24):
        x, y = rng.randrange(0, 1400), rng.randrange(0, 30)
        boxes.append((i % 2, i // 2 if i > 3 else 1, x, y, x + 9, y + 7))
    got = [(r.page_id, r.a, r.b) for r in runs.path_label_veto(spark.createDataFrame(boxes, BOX), spark.createDataFrame(rows, RUN)).collect()]
    maps, seen = [label_map(rows, p, 40, 1500) for p in range(2)], {}
    for p, a, *s in boxes:
        for q, b, *t in boxes:
            if p == q and a < b:
                (ax, ay), (bx, by) = (((k[0] + k[2]) / 2, (k[1] + k[3]) / 2) for k in (s, t))
                for k in range(9):
                    x, y = round(ax + (bx - ax) * k / 8) + 200, round(ay + (by - ay) * k / 8) + 200
                    seen.setdefault((p, a, b), {}).setdefault(k, []).extend(maps[p][y - 3 : y + 4, x - 3 : x + 4].ravel())
    top = lambda cells: max(((cells.count(v), -v) for v in set(cells) if v), default=(0, 0))[1]
    want = {key for key, at in seen.items() if len({top(c) for c in at.values()} - {0}) > 1}
    assert len(got) == len(set(got)) and set(got) == want and 0 < len(want) < len(seen)


def test_holes_page_by_page_equal_those_of_bands(spark):
    """Pages filled as they come and pages labelled band by band have the same runs; so has a page without a size."""
    rng = random.Random(12)
    rows = [(p, y, x0, x1) for p, _, y, x0, x1 in random_runs(rng, pages=3, height=40, width=90, labels=1)]
    df = spark.createDataFrame(rows, "page_id bigint, y int, x0 int, x1 int").repartition(3)
    sizes = spark.createDataFrame([(0, 95, 40), (1, 95, 45)], "page_id bigint, w int, h int")
    found = lambda band: sorted(map(tuple, runs.fill_holes(df, sizes, band=band).collect()))
    assert found(4096) == found(42) == found(7) and len(found(4096)) < len(rows)


def test_filled_pages_shuffle_once(spark):
    """Runs and sizes of pages go through one exchange, not through joins and windows."""
    df = spark.range(100).selectExpr("id page_id", "cast(id % 7 as int) y", "0 x0", "5 x1")
    plan = runs.fill_holes(df, df.selectExpr("page_id", "10 w", "8 h"))._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Window" not in plan and plan.count("RepartitionByExpression") == 1


def test_boxes_across_bands(spark):
    tall = spark.range(10_000).selectExpr("1L page_id", "1 + id % 2 label", "cast(id as int) y", "0 x0", "9 x1")
    boxes = spark.createDataFrame([(1, 1, 2, -5, 4, 9_001), (1, 2, 0, 4_095, 20, 4_097), (1, 3, 30, 0, 40, 9_000)], BOX)
    got = {(r.box_id, r.label): r.pixels for r in runs._overlap(tall, boxes, 0).collect()}
    assert got == {(1, 1): 2 * 4_501, (1, 2): 2 * 4_500, (2, 1): 10, (2, 2): 10}


def test_runs_without_a_place_or_an_end(spark):
    rows = [(1, 0, 0, 5), (1, 1, 3, None), (1, 2, 3, 4), (1, None, 3, 4), (None, 1, 3, 4), (1, 1, None, 4)]
    df = spark.createDataFrame(rows, "page_id bigint, y int, x0 int, x1 int")
    assert sorted((r.y, r.x1, r.label >> 32) for r in runs.components_of_runs(df).collect()) == [(0, 5, 1), (1, None, 2), (2, 4, 3)]


@pytest.mark.parametrize("down", [False, True])
def test_images_of_many_sizes_in_few_parts(spark, down):
    """Images of one size are looked at together: 3,000 images give a handful of result frames, not one each."""
    rng = np.random.default_rng(9)
    images = []
    for i in range(3000):
        w, h, c = int(rng.integers(1, 6)), int(rng.integers(1, 4)), int(rng.choice([1, 3]))
        images.append((i, w, h, c, rng.integers(0, 256, (h, w, c), dtype=np.uint8).tobytes()))
    found = image_runs(spark.createDataFrame(images, "page_id bigint, width int, height int, channels int, data binary").coalesce(1), 100, down=down)
    want = set()
    for i, w, h, c, data in images:
        px = np.frombuffer(data, np.uint8).reshape(h, w, c).astype(float)
        ink = (px[:, :, 0] if c == 1 else px @ [0.114, 0.587, 0.299]) < 100
        for y, line in enumerate(ink.T if down else ink):
            at = np.flatnonzero(np.diff(np.concatenate([[0], line.astype(int), [0]])))
            want |= {(i, y, int(a), int(b) - 1) for a, b in zip(at[::2], at[1::2], strict=True)}
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(want) and set(got) == want


def test_profiles_take_one_pass_over_pages(spark):
    """A band's rows are laid out on its page, not shuffled, and judged as by a plain count."""
    rng = random.Random(4)
    bands = [(p, x, y, x + rng.randrange(2, 30), y + rng.randrange(1, 12), rng.choice([None, 3, 200])) for p in range(4) for _ in range(30) for x, y in [(rng.randrange(40), rng.randrange(20))]]
    ink = [(p, y, x, x + rng.randrange(12), rng.choice(["dark", "light"])) for p in range(3) for y in range(30) for _ in range(3) for x in [rng.randrange(60)]]
    told = runs.gap_profile_veto(spark.createDataFrame(bands, "page_id bigint, gx1 int, gy1 int, gx2 int, gy2 int, tone int"), spark.createDataFrame(ink, "page_id bigint, y int, x0 int, x1 int, level string"))

    def veto(p, x1, y1, x2, y2, tone):
        if tone is None or x2 - x1 < 4 or y2 - y1 < 2:
            return None
        level = "dark" if tone >= 128 else "light"
        shares = [sum(max(0, min(b + 1, x2) - max(a, x1)) for q, r, a, b, k in ink if (q, r, k) == (p, y, level)) / (x2 - x1) for y in range(y1, y2)]
        longest = max(len(s) for s in "".join(" c"[v < 0.04] for v in shares).split(" "))
        return max(shares) > 0.6 or longest == 0 or longest < 0.25 * (y2 - y1)

    got = sorted((tuple(r[c] for c in ("page_id", "gx1", "gy1", "gx2", "gy2", "tone", "veto")) for r in told.collect()), key=str)
    assert got == sorted(((*b, veto(*b)) for b in bands), key=str) and {r[-1] for r in got} == {None, True, False}
    assert "explode" not in told._jdf.queryExecution().optimizedPlan().toString()


def test_residual_check_over_bands(spark):
    """Runs that overlap, above the page's top and across a band's end, and runs without an end: pixels and blobs as counted one by one."""
    rng = random.Random(17)
    band = runs.BAND
    lines = [*range(-5, 12), *range(band - 8, band + 9), *range(3 * band - 3, 3 * band + 3)]
    some = lambda: [(p, y, x := rng.randrange(-4, 60), None if rng.random() < 0.02 else x + rng.randrange(-1, 9)) for p in range(3) for y in lines for _ in range(6)]
    before, after = some(), some()
    boxes = [(p, i, x, y, x + rng.randrange(0, 30), y + rng.randrange(0, 14)) for p in range(4) for i, (x, y) in enumerate((rng.randrange(-10, 60), rng.choice(lines) - 3) for _ in range(25))]
    boxes.append((1, 99, -10, -10, 70, 3 * band + 10))
    frames = [spark.createDataFrame(rows, "page_id bigint, y int, x0 int, x1 int").repartition(3) for rows in (before, after)]
    found = runs.residual_check(*frames, spark.createDataFrame(boxes, BOX))
    got = {(r.page_id, r.box_id): (r.pixels, r.blob, r.share, r.flagged) for r in found.collect()}
    shared = set()
    for p, y, a0, a1 in before:
        for q, z, b0, b1 in after:
            if p == q and y == z:
                ends = [e for e in (a1, b1) if e is not None]
                if ends:
                    shared |= {(p, y, x) for x in range(max(a0, b0), min(ends) + 1)}
    assert len(got) == len(boxes) == len({b[:2] for b in boxes})
    for p, i, x1, y1, x2, y2 in boxes:
        own = {(y, x) for q, y, x in shared if q == p and y1 <= y < y2 and x1 <= x < x2}
        n, largest = len(own), 0
        while own:
            todo, size = [own.pop()], 1
            while todo:
                y, x = todo.pop()
                near = {(y + dy, x + dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1)} & own
                own -= near
                size += len(near)
                todo += near
            largest = max(largest, size)
        area = (x2 - x1) * (y2 - y1)
        share = n / area if area else None
        assert got[p, i] == (n, largest, None if share is None else pytest.approx(share, abs=1e-6), (share is not None and share >= 0.006) or largest >= 12 or (None if share is None else False)), (p, i)


def test_residual_check_counts_where_runs_and_boxes_meet(spark, monkeypatch):
    """No runs inside boxes that lie in a band are dealt again or written, nor is what is found broadcast."""
    monkeypatch.setattr(runs, "components_of_runs", lambda *_: pytest.fail("runs are written again"))
    rows = spark.createDataFrame([(1, y, 2, 9) for y in range(30)], "page_id bigint, y int, x0 int, x1 int")
    found = runs.residual_check(rows, rows, spark.createDataFrame([(1, 0, 0, 0, 20, 9), (1, 1, 30, 0, 40, 9)], BOX))
    assert [(r.pixels, r.blob) for r in found.orderBy("box_id").collect()] == [(72, 72), (0, 0)]
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
