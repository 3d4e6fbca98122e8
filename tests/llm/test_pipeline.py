"""Stages keep the documents' columns, decide as their operators do, and bear odd rows."""

import random
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline as pipeline
from pagetext.llm._arrays import buffers, packed, spans, word_hashes
from pagetext.llm._store import numbered, stored
from pagetext.llm.op7_mixing import _placed
from pagetext.llm.op10_long_repeats import _SUFFIX, _removed, _scanned, _Shape, long_repeats
from test_llm import DOCS, corpus, words


def test_stages(spark, tmp_path):
    rng = random.Random(4)
    item = words(rng, 30)
    extra = [(900, item, "en", "a", 1, None, None), (901, "#%$@!|" * 90, "en", "a", 1, None, None)]
    docs = spark.createDataFrame([*corpus(), *extra], DOCS)
    spark.createDataFrame([(i, 1, 0) for i in range(40)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    seen = spark.read.parquet(f"{tmp_path}/documents.parquet")
    ids = {}
    for name, stage in pipeline.STAGES:
        before, seen = seen, stored(stage(spark, seen, str(tmp_path)))
        ids[name] = [r.doc_id for r in seen.collect()]
        if name != "mixed":
            assert seen.columns == before.columns
    assert 901 not in ids["quality"] and set(range(40)) <= set(ids["quality"])
    near = ids["near_duplicates"]
    assert near.count(3) == 1 and 40 not in near and near.count(7) == 1 and 900 in near
    assert sorted(map(str, ids["repeats"])) == sorted(map(str, near))
    assert 900 not in ids["decontaminated"] and len(ids["decontaminated"]) == len(near) - 1
    assert len(ids["mixed"]) == len(ids["decontaminated"])
    assert pipeline.run(spark, str(tmp_path)).count() == len(ids["mixed"])


def test_repeated_passages_of_over_50_words_go(spark):
    rng = random.Random(8)
    short = lambda n: " ".join(f"{rng.choice('abcdefgh')}{rng.randrange(1000):03d}" for _ in range(n))
    over, under, wrapped = short(51), short(50), short(60)
    texts = [f"one {over} first", f"two\n{over} second", f"three {under} third", f"four {under} fourth", f"{wrapped} fifth", "sixth " + wrapped.replace(" ", "\n "), f"seventh {over.upper()}", None]
    docs = spark.createDataFrame([(i, t, len(t or "")) for i, t in enumerate(texts)], "doc_id bigint, text string, n_chars bigint").repartition(3).cache()
    assert len(over) < 400
    got = {r.doc_id: (r.text, r.n_chars) for r in pipeline.repeats(spark, docs, "").collect()}
    left = ["one  first", "two\n second", texts[2], texts[3], " fifth", "sixth ", texts[6], None]
    assert got == {i: (t, len(t or "")) for i, t in enumerate(left)}


def test_long_texts_of_few_words(spark):
    """Batches whose texts are long enough in bytes but not in words have no windows."""
    docs = spark.createDataFrame([(i, f"{'x' * 150} {i}", 152) for i in range(6)], "doc_id bigint, text string, n_chars bigint").repartition(6).cache()
    assert sorted((r.doc_id, r.text) for r in pipeline.repeats(spark, docs, "").collect()) == [(i, f"{'x' * 150} {i}") for i in range(6)]


def test_word_windows_against_brute_force(spark):
    rng = random.Random(12)
    base = words(rng, 200, 3).split()
    texts = [" ".join(base[rng.randrange(150) :][: rng.randrange(5, 60)] + words(rng, rng.randrange(40), 900).split()) for _ in range(60)]
    seen = Counter(tuple(w[k : k + 20]) for t in texts for w in [t.split()] for k in range(len(w) - 19))
    want = {}
    for i, t in enumerate(texts):
        w = t.split()
        gone = {j for k in range(len(w) - 19) if seen[tuple(w[k : k + 20])] > 1 for j in range(k, k + 20)}
        want[i] = [x for j, x in enumerate(w) if j not in gone]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3).cache()
    got = {r.doc_id: r.left.split() for r in long_repeats(docs, keep_text=True, length=1000, words=20).collect()}
    assert got == want and sum(map(len, want.values())) < sum(len(t.split()) for t in texts)


@pytest.mark.parametrize("rows", [[], [(None, None, None, None, None, None, None), (None, "", None, None, None, None, None), (1, " ", "en", "a", 1, None, None), (1, " ", "en", "a", 1, None, None)]])
def test_empty_and_null_tables(spark, tmp_path, rows):
    """No rows give none; null and blank rows pass every stage, with nothing to take."""
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = pipeline.run(spark, str(tmp_path)).collect()
    assert len(got) == len(rows) and all(r.taken == 0 for r in got)


def _peak(work):
    tracemalloc.start()
    try:
        return work(), tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_words_are_hashed_in_little_memory():
    """A slice of 4 MB takes some MB beside its spans; the hashes don't depend on where it is cut."""
    rng = random.Random(5)
    texts = [words(rng, 60_000, 3000), "x" * 600_000, words(rng, 400_000, 3000)]
    data, at = buffers(pa.array(texts))
    starts, ends, _ = spans(data, at)
    got, peak = _peak(lambda: word_hashes(data, starts, ends))
    assert len(data) > 3 << 20 and peak < 8 * len(starts) + (40 << 20)
    known = {}
    for h, t in zip(got.tolist(), " ".join(texts).split(), strict=True):
        assert known.setdefault(t, h) == h
    assert len(set(known.values())) == len(known)
    alone, one = buffers(pa.array([texts[0][:50]]))
    s, e, _ = spans(alone, one)
    assert word_hashes(alone, s, e)[:5].tolist() == got[:5].tolist()


def test_repeats_leave_few_copies_of_a_batch():
    """A large Arrow batch of texts is cut slice by slice, and a partition's suffixes are sorted column by column."""
    text = "".join(random.Random(6).choices("abcdefgh ", k=100_000))
    n, pack = 400, [500 << 24 | 30 << 12 | 1]
    batch = pa.record_batch([pa.array(range(n)), pa.array(range(n)), pa.array([text] * n), pa.array([pack] * n, pa.list_(pa.int64()))], ["row", "id", "text", "packs0"])
    shape = _Shape(400)
    rest, peak = _peak(lambda: sum(len(t) == 99_570 for b in _removed(iter([batch]), [shape], True, False) for t in b.column("left").to_pylist()))
    assert rest == n and peak < 20 << 20 < batch.nbytes

    rng = np.random.default_rng(2)
    own = {k: rng.integers(1, 1 << 14, 400_000).astype(kind) for k, kind in _SUFFIX.items()}
    own["key"] = rng.integers(0, 1 << 63, 400_000).astype(np.uint64)
    dealt = packed(np.arange(400_000) % 500, own)
    found, peak = _peak(lambda: sum(b.num_rows for b in _scanned(dealt.slice(i, 100) for i in range(0, 500, 100))))
    assert found == own["twice"].sum() and peak < 4 * dealt.nbytes


def test_numbers_start_no_python_workers(spark, tmp_path):
    """Files are numbered by a table that the JVM reads, not by an RDD of Python rows."""
    spark.range(9).repartition(3).write.parquet(f"{tmp_path}/rows")
    seen = spark.read.parquet(f"{tmp_path}/rows")
    totals = spark.createDataFrame([("a", 3, 1), ("b", 4, 1), (None, 5, 2)], "source string, source_size bigint, n bigint")
    assert [r.place for r in _placed(totals).orderBy("source_size").collect()] == [0, 1, 2]
    assert len({r.row for r in numbered(seen).collect()}) == 9
    for rows in (numbered(seen), _placed(totals)):
        left, sources = [rows._jdf.queryExecution().analyzed()], []
        while left:
            plan = left.pop()
            left += [plan.children().apply(i) for i in range(plan.children().size())]
            if plan.nodeName().endswith("RDD"):
                sources.append(plan.rdd().toDebugString())
        assert not any("PythonRDD" in s for s in sources)
