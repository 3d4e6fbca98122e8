"""Streams in several batches: state that goes, late rows, pages in parts, logs that are compacted, retries."""

import os
import random
from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from pagetext.operators import edits as ed
from pagetext.operators.fragments import merge_regions
from pagetext.operators.graph import by_page
from pagetext.plans import edits, streams
from pagetext.sources import batches
from pagetext.streaming import jobs

START = datetime(2024, 1, 1)


@pytest.fixture
def folder(spark, tmp_path):
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield str(tmp_path)
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def landed(spark, folder, parts, schema):
    """A stream that takes each part as a batch."""
    for rows in parts:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    return jobs.as_stream(spark, f"{folder}/in", files=1)


def at(seconds):
    return START + timedelta(seconds=seconds)


def test_windows_end_and_late_rows_are_counted(spark, folder):
    parts = [[(at(s), "p") for s in range(0, 60, 5)], [(at(s), "p") for s in range(300, 360, 5)], [(at(700), "p")], [(at(10), "p")], [(at(5000), None)]]
    told = []
    found = jobs.kept(jobs.stream_call_rate(landed(spark, folder, parts, "ts timestamp, provider string"), "60 seconds", "60 seconds", "60 seconds", limit=5), "append", told)
    assert sorted((int((r.start - START).total_seconds()), r.calls, r.alert) for r in found.where("provider = 'p'").collect()) == [(0, 12, True), (300, 12, True), (660, 1, False)]
    assert told[0].late == 1 and max(told[0].state) > told[0].state[-1] == 1, told[0].state


def test_spells_of_reading(spark, folder):
    parts = [[(at(0), 1, 3, 1), (at(1), 1, 4, 2)], [(at(2), 1, 5, 3), (at(50), 1, 9, 4)], [(at(9000), None, None, None)]]
    told = []
    found = jobs.kept(jobs.stream_reading(landed(spark, folder, parts, "ts timestamp, reader_id int, page_idx int, seq int"), "5 seconds", "20 seconds"), "append", told)
    assert sorted((r.page_idx, r.events) for r in found.where("reader_id = 1").collect()) == [(5, 3), (9, 1)]
    assert told[0].state[-1] == 1 and told[0].late == 0


def test_latest_writes_only_what_moves_on(spark, folder):
    parts = [[("a", 5, "x"), ("b", 1, None)], [("a", 4, "old"), ("b", 2, "y")], [("a", 6, "z"), ("c", None, "n")]]
    changes = jobs.kept(jobs.stream_latest(landed(spark, folder, parts, "k string, seq bigint, v string"), "k", "seq", "v"), "update")
    assert sorted((r.batch, r.k, r.seq, r.v or "") for r in changes.collect()) == [(0, "a", 5, "x"), (0, "b", 1, ""), (1, "b", 2, "y"), (2, "a", 6, "z")]
    assert {(r.k, r.seq) for r in jobs.last_change(changes, "k").collect()} == {("a", 6), ("b", 2)}


FRAG = "page_id bigint, frag_id bigint, x1 double, y1 double, x2 double, y2 double, text string, conf double, img_w int, img_h int, lang string, expected int, landed_at timestamp"


def pages(n=12):
    rng = random.Random(3)
    rows = []
    for p in range(n):
        k = rng.randrange(4, 12)
        rows += [(p, i, float(x := rng.randrange(600)), float(y := rng.randrange(500)), float(x + 60), float(y + 16), f"t{p}.{i}", 0.9, 900, 1400, "es", k, START) for i in range(k)]
    return rows


def regions_of(df):
    return sorted((r.page_id, r.text, tuple(r.members)) for r in df.collect())


def test_pages_in_parts(spark, folder):
    """Fragments shuffled over three batches: the regions are those of whole pages."""
    rows = pages()
    whole = regions_of(merge_regions(spark.createDataFrame(rows, FRAG).drop("expected", "landed_at")))
    random.Random(4).shuffle(rows)
    parts = [rows[:30], rows[30:60], rows[60:] + rows[:3]]  # some land twice
    assert regions_of(jobs.stream_merge(landed(spark, folder, parts, FRAG))) == whole


def test_page_short_of_fragments_goes_by_time_and_opens_again(spark, folder):
    rows = [r for r in pages(2) if r[0] == 0]
    late = [(*r[:-1], at(4000)) for r in rows[-1:]]
    clock = [(99, 0, 0.0, 0.0, 9.0, 9.0, "tick", 0.9, 900, 1400, "es", 1, at(2000))]
    out = []
    stream = jobs.assembled(landed(spark, folder, [rows[:-1], clock, [(*clock[0][:1], 1, *clock[0][2:-2], 1, at(3000))], late], FRAG), "10 minutes")
    jobs.run(stream, "append", lambda batch, n: out.extend((r.page_id, r.version, r.frag_id) for r in batch.collect()))
    own = [(v, f) for p, v, f in out if p == 0]
    assert {f for v, f in own if v == 1} == {r[1] for r in rows[:-1]} and {f for v, f in own if v == 2} == {r[1] for r in rows}


def region_table(spark):
    member = lambda i: {"id": i, "text": f"m{i}", "x1": 0.0, "y1": float(i), "x2": 1.0, "y2": i + 1.0}
    rows = [(p, r, r, f"text {p}.{r}", "done", "speech", 0.0, 0.0, 9.0, 9.0, [member(10 * r + k) for k in range(3)]) for p in range(40) for r in range(4)]
    return spark.createDataFrame(rows, ed.REGION)


def edit_log(spark, n=6):
    rng = random.Random(9)
    rows = []
    for p in range(40):
        for seq in range(n):
            kind = rng.choice(["text", "delete", "add", "reorder", "split", "join"])
            rows.append((p, seq, rng.randrange(4), kind, f"edit {seq}", 100 + 10 * seq if kind == "split" else rng.randrange(4) if kind == "join" else None, 0, rng.choice([-1, 1]), 1.0, 2.0, 3.0, 4.0))
    return spark.createDataFrame(rows, ed.EDIT)


def shown(df):
    return sorted((r.page_id, r.pos, r.region_id, r.text, tuple(m["id"] for m in r.members)) for r in df.collect())


def test_correction_log(spark, folder):
    """However batches are compacted or run again, the regions are those of one replay; a read replays the tail alone."""
    regions, edits = region_table(spark), edit_log(spark)
    want = shown(ed.replay_edits(regions, edits))
    log = jobs.CorrectionLog(regions, f"{folder}/log")
    assert shown(log.read()) == shown(regions) and log.upto() == -1
    for batch in range(3):
        part = edits.where(F.col("seq").between(2 * batch, 2 * batch + 1))
        log.append(part, batch)
        log.append(part, batch)  # a retry
        if batch == 1:
            assert log.tail() == [0, 1]
            log.compact()
            assert log.tail() == [] and log.upto() == 1
            log.append(edits.where("seq < 2"), 0)  # held by the snapshot
            log.compact()
    assert log.tail() == [2] and shown(log.read()) == want
    log.compact()
    assert log.tail() == [] and shown(log.read()) == want and batches.committed(spark, f"{folder}/log/snapshots") == ["2"]


@pytest.mark.parametrize("every", [1, 2, 100])
def test_stream_of_edits(spark, folder, every):
    regions, edits = region_table(spark), edit_log(spark)
    for k in range(3):
        edits.where(F.col("seq").between(2 * k, 2 * k + 1)).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    log = jobs.stream_edits(jobs.as_stream(spark, f"{folder}/in", files=1), regions, every=every)
    assert shown(log.read()) == shown(ed.replay_edits(regions, edits)) and len(log.tail()) <= every


def test_registered_stream_of_edits(spark, folder):
    """The query itself, which lands its log in parts: the rows of its batch twin."""
    rows = lambda query: sorted(map(tuple, query(spark, "/root/testdata/sf0.001").collect()))
    found = rows(streams.stream_edits)
    assert found and found == rows(edits.replay_edits)


def test_a_batch_written_twice(spark, folder):
    rows = spark.createDataFrame([(1, 0, "a"), (2, 0, "b")], "chapter_id bigint, page_idx int, tl string")
    path = f"{folder}/sink"
    assert batches.read_batches(spark, path) is None
    for name in ("run-7", "run-7", "run-8"):
        batches.write_batch(rows, path, name)
    rows.limit(1).write.parquet(f"{path}/batch=half")
    os.remove(f"{path}/batch=half/_SUCCESS")
    assert batches.committed(spark, path) == ["run-7", "run-8"] and batches.read_batches(spark, path).count() == 4
    with pytest.raises(ValueError, match="named by"):
        batches.write_batch(rows, path, "../x")


def test_pages_of_a_union_stay_whole(spark):
    """Both sides of a union dealt by page already, and of unlike size: a page still comes to one task."""
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        side = lambda n, k: spark.range(n).select((F.col("id") % 3000).alias("page_id"), F.lit("x" * k).alias("pad")).withColumn("seq", F.row_number().over(Window.partitionBy("page_id").orderBy("pad")))
        rows = side(60_000, 400).union(side(3000, 1))
        found = by_page(rows, ["page_id"], lambda r, page: pd.DataFrame({"page_id": r.groupby(page)["page_id"].first(), "n": r.groupby(page).size()}), "page_id bigint, n bigint").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert len(found) == 3000 and {r.n for r in found} == {21}


def test_cache_entries_of_many_chapters_share_a_state(spark, folder):
    """500 chapters in a few states: the newest entry is live until the watermark has left it behind, whatever comes for others."""
    day = 86_400
    parts = [[(c, at(0), c % 7) for c in range(500)], [(c, at(3 * day), 1) for c in range(0, 500, 2)] + [(1, at(0), 0)], [(c, at(14 * day), 2) for c in range(0, 500, 4)], [(0, at(14 * day), 1)], [(-1, at(40 * day), 0)]]
    told, before = [], jobs.SHARDS
    jobs.SHARDS = 8
    try:
        changes = jobs.kept(jobs.stream_cache(landed(spark, folder, parts, "chapter_id bigint, saved_at timestamp, v int"), 7), "update", told)
    finally:
        jobs.SHARDS = before
    rows = changes.collect()
    assert max(told[0].state) <= 8, told[0].state
    assert sum(r.batch == 1 for r in rows) == 250 and {r.chapter_id for r in rows if r.batch == 1 and r.live} == set(range(0, 500, 2))
    last = {r.chapter_id: (r.v, r.live) for r in jobs.last_change(changes, "chapter_id").collect()}
    assert last == {c: (2 if c % 4 == 0 else 1 if c % 2 == 0 else c % 7, False) for c in range(500)} | {-1: (0, True)}


def test_pages_in_parts_share_states(spark, folder):
    rows = pages(60)
    whole = regions_of(merge_regions(spark.createDataFrame(rows, FRAG).drop("expected", "landed_at")))
    random.Random(5).shuffle(rows)
    told, before = [], jobs.SHARDS
    jobs.SHARDS = 4
    try:
        assert regions_of(jobs.stream_merge(landed(spark, folder, [rows[:200], rows[200:]], FRAG), told=told)) == whole
    finally:
        jobs.SHARDS = before
    assert max(told[0].state) <= 4, told[0].state


def test_merge_holds_no_fragments_as_state(spark, folder):
    """A page that is whole at once, one that is opened again by a late part, one that goes by time after the last
    batch, and a fragment that comes twice: the last one counts, and no state grows with what has landed."""
    rows = [(*r[:-2], 4, START) for r in pages(4) if r[1] < 4]
    own = [[r for r in rows if r[0] == p] for p in range(4)]
    changed = (*own[3][0][:6], "changed", *own[3][0][7:])
    tick = lambda s: (50 + s, 0, 0.0, 0.0, 60.0, 16.0, "tick", 0.9, 900, 1400, "es", 1, at(s))
    late = (*own[1][3][:-1], at(9000))
    parts = [[*own[0], *own[1][:3], *own[3][:2]], [tick(2000), changed, *own[3][2:]], [tick(4000)], [late, *[(*r[:-1], at(8000)) for r in own[2][:3]]], [tick(9500)]]
    told = []
    found = regions_of(jobs.stream_merge(landed(spark, folder, parts, FRAG), told=told))
    whole = [*own[0], *own[1][:3], late, *own[2][:3], changed, *own[3][1:], tick(2000), tick(4000), tick(9500)]
    assert found == regions_of(merge_regions(spark.createDataFrame(whole, FRAG).drop("expected", "landed_at")))
    assert max(told[0].state) == 0 and len(told[0].rows) == 5


def test_a_batch_of_pages_run_again(spark, folder):
    log = jobs.PageLog(spark, f"{folder}/log", "10 minutes")
    of = lambda df: df if df is None else sorted((r.page_id, r.frag_id) for r in df.collect())
    rows = [(*r[:-2], 4, START) for r in pages(3) if r[1] < 4]
    first, rest = (spark.createDataFrame(part, FRAG) for part in (rows[:6], rows[6:]))
    for _ in range(2):
        assert of(log.step(0, first)) == [(0, i) for i in range(4)]
    for _ in range(2):
        assert of(log.step(1, rest)) == [(p, i) for p in (1, 2) for i in range(4)]
    assert log.step(2, None) is None and log.pages()[1].where("version = 1 AND NOT twice").count() == 3
