"""Corrections against hand-made pages, sinks, streams' helpers, replies and routes."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from pagetext.operators import edits as op
from pagetext.operators import library, replies, spend
from pagetext.operators.graph import by_page, component_labels
from pagetext.operators.replies import rescue_json
from pagetext.sources.batches import read_batches


def member(i, y):
    return (i, f"m{i}", float(i), float(y), float(i + 1), float(y + 1))


def region(r, pos, members, page=1):
    box = (min(m[2] for m in members), min(m[3] for m in members), max(m[4] for m in members), max(m[5] for m in members))
    return (page, r, pos, " ".join(m[1] for m in members), "old", "sfx", *box, members)


@pytest.fixture(scope="module")
def regions(spark):
    rows = [region(0, 0, [member(1, 9), member(2, 3), member(3, 6)]), region(1, 1, [member(4, 0)]), region(2, 2, [member(5, 0), member(6, 1)]), region(0, 0, [member(1, 0)], page=2)]
    return spark.createDataFrame(rows, op.REGION)


def shown(df):
    return sorted((r.page_id, r.pos, r.region_id, r.text, r.tl, r.t, r.x1, r.y1, r.x2, r.y2, tuple(m.id for m in r.members)) for r in df.collect())


def test_split(spark, regions):
    cuts = spark.createDataFrame([(1, 0, 1, 90), (1, 1, 0, 91), (1, 2, 5, 92), (2, 0, -1, 93)], "page_id bigint, region_id bigint, after int, new_id bigint")
    got = shown(op.split_regions(regions, cuts))
    assert got[0][1:5] == (0, 0, "m2 m3", "—") and got[0][-1] == (2, 3) and got[0][6:10] == (2.0, 3.0, 4.0, 7.0)
    assert got[1][1:5] == (1, 90, "m1", "—") and [g[2] for g in got] == [0, 90, 1, 2, 0] and [g[4] for g in got[2:]] == ["old"] * 3


def test_join(spark, regions):
    pairs = spark.createDataFrame([(1, 2, 0), (1, 1, 77), (2, 0, 0)], "page_id bigint, region_id bigint, other_id bigint")
    got = shown(op.join_regions(regions, pairs))
    assert [g[:5] for g in got] == [(1, 0, 1, "m4", "old"), (1, 1, 2, "m5 m6 m1 m2 m3", "—"), (2, 0, 0, "m1", "old")]
    assert got[1][6:] == (1.0, 0.0, 7.0, 10.0, (5, 6, 1, 2, 3))


def test_replay_agrees_with_split_and_join(spark, regions):
    none = {c: None for c in ("text", "other_id", "after", "by", *op.BOX)}
    log = [{"page_id": 1, "seq": 1, "region_id": 0, "kind": "split", **none, "other_id": 90, "after": 1}, {"page_id": 1, "seq": 2, "region_id": 2, "kind": "join", **none, "other_id": 90}]
    edits = spark.createDataFrame([tuple(e[c.split()[0]] for c in op.EDIT.split(", ")) for e in log], op.EDIT)
    cut = op.split_regions(regions, spark.createDataFrame([(1, 0, 1, 90)], "page_id bigint, region_id bigint, after int, new_id bigint"))
    assert shown(op.replay_edits(regions, edits)) == shown(op.join_regions(cut, spark.createDataFrame([(1, 2, 90)], "page_id bigint, region_id bigint, other_id bigint")))


def test_replay_of_odd_edits(spark, regions):
    def edit(seq, r, kind, text=None, other=None, after=None, by=None, page=1):
        return (page, seq, r, kind, text, other, after, by, 1.0, 2.0, 3.0, 4.0)

    log = [edit(1, 5, "text", "x"), edit(2, 1, "add", "again"), edit(3, 1, "delete"), edit(4, 1, "text", "late"), edit(5, 0, "reorder", by=1), edit(6, 0, "reorder", by=1), edit(7, 8, "add", ""), edit(8, 0, "join", other=8), edit(9, 7, "add", "first", page=3)]
    got = shown(op.replay_edits(regions, spark.createDataFrame(log, op.EDIT)))
    assert [g[:5] for g in got] == [(1, 0, 2, "m5 m6", "old"), (1, 1, 0, "m1 m2 m3", "—"), (2, 0, 0, "m1", "old"), (3, 0, 7, "first", "—")]
    assert shown(op.replay_edits(regions, spark.createDataFrame([], op.EDIT))) == shown(regions)


def test_manual_order(spark, regions):
    moves = F.expr("array(named_struct('seq', 2, 'at', 0, 'by', 1), named_struct('seq', 1, 'at', 2, 'by', 1), named_struct('seq', 3, 'at', 1, 'by', -9))")
    orders = spark.createDataFrame([(1, [2, 0, 9])], "page_id bigint, places array<int>").withColumn("places", op.moved(F.col("places"), moves))
    assert orders.first().places == [0, 2, 9]
    assert [(r.page_id, r.pos, r.region_id) for r in op.manual_order(regions, orders).orderBy("page_id", "pos").collect()] == [(1, 0, 0), (1, 1, 2), (2, 0, 0)]


def test_pages_longer_than_a_batch(spark):
    """Chains over many Arrow batches, pages that end inside one, and string keys."""
    rng = random.Random(1)
    rows = [(f"p{p}", a, a + 1) for p, n in enumerate((5000, 3, 1, 2500)) for a in range(n)]
    rng.shuffle(rows)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "700")
    try:
        got = component_labels(spark.createDataFrame(rows, "page_id string, a bigint, b bigint")).collect()
        whole = by_page(spark.createDataFrame(rows, "page_id string, a bigint, b bigint"), ["page_id"], lambda r, page: r.groupby("page_id").size().rename("n").reset_index(), "page_id string, n bigint").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == 5001 + 4 + 2 + 2501 and {r.group_id for r in got} == {0}
    assert sorted((r.page_id, r.n) for r in whole) == [("p0", 5000), ("p1", 3), ("p2", 1), ("p3", 2500)]


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, 0, "a"), (2, 0, "b"), (2, 1, "c")], "chapter_id bigint, page_idx int, tl string")
    chapters = spark.createDataFrame([(1, True), (2, False), (3, True)], "chapter_id bigint, cacheable boolean")
    for batch in (1, 2, 1):  # a retry leaves the same rows
        op.write_regions(rows, chapters, f"{tmp_path}/r", batch)
    assert sorted((r.batch, r.tl) for r in read_batches(spark, f"{tmp_path}/r").collect()) == [("1", "a"), ("2", "a")]


def test_rescue(spark):
    texts = {
        'a {"m":{"n":1},"translations":[1]}': '{"m":{"n":1},"translations":[1]}',
        'a {"translations":[1]} and more': '{"translations":[1]}',
        '{"x":{"translations":[{"a":{"b":1}}]}': '{"translations":[{"a":{"b":1}}]}',
        '{"translations":[1}': "",
        '} {"translations":[2],"k":{}}': '{"translations":[2],"k":{}}',
        "the translations of it": "",
        "": "",
    }
    df = spark.createDataFrame([(t, " " if i % 2 else None) for i, t in enumerate(texts)] + [('{"translations":[1]}', "told"), (None, None)], "reasoning string, answer string")
    got = [(r.reasoning, r.answer, r.rescued) for r in rescue_json(df).collect()]
    assert {t: x for t, a, x in got if a != "told" and t is not None} == texts
    assert ('{"translations":[1]}', "told", None) in got and (None, None, "") in got


def test_ids_and_routes(spark):
    url = "https://h/CHAPTER/0a1b2c3d-0000-1111-2222-333344445555/2"
    df = spark.createDataFrame([(url, "shelf:s:1"), ("https://h/chapter/1", "a:b"), (None, "other:s:1")], "url string, key string")
    got = [tuple(r) for r in df.select(library.chapter_id(F.col("url")), library.split_composite_id(F.col("key"), "shelf", "web").alias("p")).select("*").collect()]
    assert [g[0] for g in got] == ["0a1b2c3d-0000-1111-2222-333344445555", None, None]
    assert [tuple(g[1]) for g in got] == [("shelf", "s", "1"), ("web", None, "a:b"), ("web", None, "other:s:1")]
    pages = spark.createDataFrame([("ja", False), ("es-la", False), ("fr", True), ("fr", False)], "lang string, cached boolean")
    routes = lambda **how: [r.route for r in library.route_pages(pages, "es", ("ja",), **how).collect()]
    assert routes() == ["vision", "skip", "cached", "local"] and routes(mode="all") == ["vision", "skip", "cached", "vision"]
    assert routes(mode="all", has_key=False) == ["local", "skip", "cached", "local"] == routes(mode="off")


def test_natural_order_of_long_numbers(spark):
    names = ["9" * 41, "1" + "0" * 40 + "2", "1" + "0" * 40 + "10", "a2", "a10", "a002b", "10", "010x"]
    got = [r.n for r in spark.createDataFrame([(n,) for n in names], "n string").orderBy(library.natural_key(F.col("n")), "n").collect()]
    assert got == ["10", "010x", "9" * 41, "1" + "0" * 40 + "2", "1" + "0" * 40 + "10", "a2", "a002b", "a10"]


def test_indices_of_any_length(spark):
    sent = spark.createDataFrame([(1, 0, "a"), (1, 7, "b"), (1, 12345678901, "c")], "reply_id int, i bigint, text string")
    item = "struct<i:string,tl:string,translation:string,text:string,t:string>"
    parsed = spark.createDataFrame([(1, [("0000000000000", "x", None, None, "sfx"), (" 07 ", "y", None, None, None), ("12345678901", "z", None, None, None), ("7a", "no", None, None, None)])], f"reply_id int, items array<{item}>")
    assert {r.i: r.tl for r in replies.apply_replies(sent, parsed).collect()} == {0: "x", 7: "y", 12345678901: "z"}


def test_feed_keeps_the_first_of_differing_repeats(spark):
    rows = [(1, 5, "2024-01-02", "late"), (1, 5, "2024-01-01", "early"), (1, 6, "2024-01-03", "x")]
    frame = spark.createDataFrame(rows, "series_id int, chapter_id int, released string, body string")
    for f in (frame, frame.orderBy(F.desc("released"))):
        assert sorted((r.n, r.body) for r in library.chapter_feed(f).collect()) == [(1, "early"), (2, "x")]


def test_cache_in_another_language_is_a_miss(spark):
    cache = spark.createDataFrame([(1, 6, "2024-01-01", "en"), (2, 6, "2024-01-01", "es"), (3, 6, "2024-01-01", None), (4, 5, "2024-01-01", "en")], "chapter_id int, v int, saved_at string, target_lang string")
    live = lambda target: sorted(r.chapter_id for r in library.retain_ttl(cache, F.lit("2024-01-02"), 7, 6, target).collect())
    assert live("en") == [1] and live(None) == [1, 2, 3]


def test_export_status(spark):
    manifest = spark.createDataFrame([(c, p, f"Chapter_{c}") for c in (1, 2, 3) for p in (0, 1)], "chapter_id int, page_idx int, folder string")
    fetched = spark.createDataFrame([(1, 0, None), (1, 1, None), (2, 0, None), (2, 1, "HTTP 404"), (3, 0, None)], "chapter_id int, page_idx int, error string")
    assert {r.chapter_id: (r.status, r.error) for r in library.export_status(manifest, fetched).collect()} == {1: ("done", None), 2: ("error", "HTTP 404"), 3: ("open", None)}


def test_nearest_context_equals_all_pairs(spark):
    """Few heights, so that groups of equal ones are larger than k; regions without translation or height among them."""
    rng = random.Random(1)
    rows = [(1, p, i, float(rng.randrange(4)), rng.choice([None, *[float(x) for x in range(n)]]), rng.choice(["—", "-", "", *[f"t{i}"] * 4])) for p, n in ((0, 2), (1, 9), (2, 60)) for i in range(50)]
    frame = spark.createDataFrame(rows, "chapter_id int, page_idx int, region_id int, cx double, cy double, tl string")
    for k in (1, 3, 8):
        want = {}
        for c, p, i, _, cy, _ in rows:
            others = sorted((abs(r[4] - cy), r[4], r[3], r[2], r[5]) for r in rows if r[1] == p and r[2] != i and r[4] is not None and r[5] not in ("—", "-", "")) if cy is not None else []
            if others:
                want[p, i] = [r[4] for r in sorted(others[:k], key=lambda r: r[1:4])]
        found = library.nearest_context(frame, k)
        assert {(r.page_idx, r.region_id): r.context for r in found.collect()} == want
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert all("cy" in line for line in plan.splitlines() if "Join " in line)


def test_trailing_windows_by_slots(spark):
    rng = random.Random(2)
    calls = [(i, rng.choice("pq"), datetime(2024, 1, 1) + timedelta(milliseconds=rng.choice([rng.randrange(400_000), 60_000 * rng.randrange(5)]))) for i in range(300)]
    frame = spark.createDataFrame(calls, "call_id int, provider string, ts timestamp")
    got = {r.call_id: (r.in_window, r.limited, r.wait_ms) for r in spend.call_rate(frame, limit=20).collect()}
    for i, p, ts in calls:
        ago = sorted((ts - t) // timedelta(milliseconds=1) for _, q, t in calls if q == p and timedelta(0) <= ts - t < timedelta(seconds=60))
        assert got[i] == (len(ago), len(ago) >= 20, 60_000 - ago[-1] + 250 if len(ago) >= 20 else 0)
    partitions = [line for line in spend.call_rate(frame)._jdf.queryExecution().optimizedPlan().toString().splitlines() if line.lstrip("+- :").startswith("Window")]
    assert partitions and all("slot" in line for line in partitions)


def test_budget_by_slots(spark):
    rng = random.Random(3)
    items = [(i, rng.choice([1, 2, None]), rng.choice([None, datetime(2024, 1, 1) + timedelta(hours=rng.randrange(200))]), rng.choice([0.1, 0.0007, 2.5, None])) for i in range(200)]
    frame = spark.createDataFrame(items, "call_id int, chapter_id int, ts timestamp, cost double")
    got = {r.call_id: (r.before, r.skipped) for r in spend.budget_cut(frame, 20.0).collect()}
    for run in (1, 2, None):
        before = 0.0
        for i, _, _, cost in sorted((r for r in items if r[1] == run), key=lambda r: (r[2] is not None, r[2] or datetime.min, r[0])):
            assert got[i][0] == pytest.approx(before, abs=1e-9) and got[i][1] == (round(before, 9) >= 20.0)
            before += cost or 0.0
    assert len(got) == 200


def test_call_rate_sums_up_instead_of_looking_back(spark):
    """Windows only grow, so a dense stretch costs as much a call as a thin one; calls at one time, at a window's
    edge and without a time count as before."""
    rng = random.Random(8)
    calls = [(i, "pq"[rng.randrange(2)], None if i % 50 == 0 else rng.choice([0, 60_000, 120_000, rng.randrange(180_000)])) for i in range(600)]
    frame = spark.createDataFrame(calls, "call_id int, provider string, at bigint").select("call_id", "provider", F.timestamp_millis("at").alias("ts"))
    found = spend.call_rate(frame, limit=90)
    got = {r.call_id: (r.in_window, r.limited, r.wait_ms) for r in found.collect()}
    want = {}
    for i, p, at in calls:
        inside = [] if at is None else [t for _, q, t in calls if q == p and t is not None and at - 60_000 < t <= at]
        full = len(inside) >= 90
        want[i] = (len(inside), full, 60_000 - (at - min(inside)) + 250 if full else 0)
    assert got == want and any(w[1] for w in want.values())
    assert "RangeFrame, -" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_regions_are_made_once(spark):
    """Corrections read the regions from a table, not from the lines again for each use."""
    from pagetext.plans import edits as plans

    for query in (plans.split_regions, plans.join_regions, plans.manual_order, plans.replay_edits):
        plan = query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert "l_orderkey" not in plan
