"""Resampling, hard negatives and toxicity against brute force; row numbers and shards that change no result."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pagetext.llm import op1_decontaminate as op1
from pagetext.llm import op11_resampling as op11
from pagetext.llm import op12_hard_negatives as op12
from pagetext.llm import op13_toxicity as op13
from pagetext.llm._store import numbered
from pagetext.llm.op5_jaccard_join import jaccard_groups
from pagetext.llm.op7_mixing import mix

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOLD = {c: c + 32 for c in range(65, 91)}


def runs(text):
    w = WORD.findall((text or "").translate(FOLD))
    return len(w), [zlib.crc32(" ".join(w[i : i + k]).encode()) % 10000 for k in (1, 2, 3) for i in range(len(w) - k + 1)]


def resampled(docs, target, percent=5):
    raw, wanted, per = Counter(), Counter(), [(i, *runs(t)) for i, t in docs]
    for _, _, f in per:
        raw.update(f)
    for t in target:
        wanted.update(runs(t)[1])
    s, t = sum(raw.values()), sum(wanted.values())
    gain = lambda b: math.floor(1000 * math.log((wanted[b] + 1) * (s + 10000) / ((raw[b] + 1) * (t + 10000))))
    rows = []
    for i, n, f in per:
        weight = sum(map(gain, f))
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((r for r in rows if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    for place, r in enumerate(able[: percent * len(able) // 100]):
        r[5] = place + 1
    return rows


def test_features_of_odd_texts():
    texts = ["", "Ab-c", "x" * 300 + " y " + "Zé" * 80, "a" * 64 + " " + "b" * 65 + " c", "ß ä ö", "1 2 3 4", None, "--", " ".join(f"w{i}" for i in range(50))]
    found = [Counter() for _ in texts]
    for row, bucket in op11.features(pa.array(texts)):
        for r, b in zip(row, bucket, strict=True):
            found[r][int(b)] += 1
    assert found == [Counter(runs(t)[1]) for t in texts]


def test_features_in_pieces(monkeypatch):
    text = " ".join(f"w{i % 7}" for i in range(100))
    whole = Counter(int(b) for _, bucket in op11.features(pa.array([text, "a b", text])) for b in bucket)
    monkeypatch.setattr(op11, "PIECE", 9)
    assert whole == Counter(int(b) for _, bucket in op11.features(pa.array([text, "a b", text])) for b in bucket)


def test_resample(spark):
    rng = random.Random(11)
    docs = [(i, " ".join(rng.choice("abcdefgh") + str(rng.randrange(9)) for _ in range(rng.randrange(0, 60)))) for i in range(400)]
    docs += [(400, None), (401, ""), (402, "Q" * 9000), (403, docs[3][1]), (None, docs[4][1]), (None, docs[5][1])]
    target = ["a1 a2 a3 b1", None, "c1 Zz"]
    frame = spark.createDataFrame([(*d, "clash", "clash", "clash") for d in docs], "doc_id bigint, text string, score string, rank string, row string").repartition(3)
    got = [tuple(r) for r in op11.resample(frame, spark.createDataFrame([(t,) for t in target], "text string"), percent=50, segment=17).collect()]
    assert Counter(got) == Counter(map(tuple, resampled(docs, target, 50)))
    empty = frame.limit(0)
    assert op11.resample(empty, empty).count() == 0
    assert {r["rank"] for r in op11.resample(frame.limit(5), empty).collect()} == {None}


@pytest.mark.parametrize(("segment", "most"), [(3, 1000), (40, 77), (10_000, 5), (1, 2)])
def test_ranks_by_regular_sampling(spark, segment, most):
    rng = random.Random(segment)
    rows = [(i, rng.choice([None, *range(9)]), rng.choice([7, 7, rng.randrange(50)])) for i in range(600)]
    frame = spark.createDataFrame(rows, "row bigint, doc_id bigint, score bigint").repartition(5)
    got = sorted((r["rank"], r.row) for r in op11.ranked(frame, most, segment=segment).collect() if r["rank"])
    want = sorted(rows, key=lambda r: (-r[2], r[1] is None, r[1] or 0, r[0]))[:most]
    assert [row for _, row in got] == [r[0] for r in want] and [p for p, _ in got] == list(range(1, len(want) + 1))
    assert op11.ranked(frame, most, segment=segment).count() == len(rows)


@pytest.mark.parametrize("size", [3, 1 << 12, 1 << 20, 1 << 27])
def test_products_are_exact(size):
    rng = np.random.default_rng(size)
    a, b = (rng.integers(-size, size, (n, 130)) for n in (9, 11))
    bound = 130 * size * size
    assert (op12.products(op12.Residues(a), op12.Residues(b), bound) == a @ b.T).all()


def mined(rows, every=50):
    known = []
    for i, v, label in rows:
        if i is None or v is None or label is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        x = [math.floor(256 * float(x)) for x in v]
        if sum(c * c for c in x) < 1 << 62:
            known.append((i, (label + 1) % 10 if i % 7 == 0 else label, x))
    out = []
    for n, (i, label, x) in enumerate(known):
        if i % every:
            continue
        scored = sorted((-sum(p * q for p, q in zip(x, y, strict=False)), j, own) for m, (j, own, y) in enumerate(known) if m != n)
        for s, j, _ in [r for r in scored if r[2] == label][:5]:
            fits = [r for r in scored if r[2] != label and 50 * -s <= 100 * -r[0] <= 95 * -s]
            out += [(i, j, k + 1, r[1], -s, -r[0]) for k, r in enumerate(fits[:3])]
    return Counter(out)


def test_mine(spark):
    rng = random.Random(12)
    vec = lambda: [round(rng.uniform(-1, 1), 1) for _ in range(4)]  # noqa: E731  ties are frequent
    rows = [(i, vec(), rng.randrange(3)) for i in range(260)]
    rows += [(300, [0.5, 0.5, 0.5, 0.5], 1), (300, [0.5, 0.5, 0.5, 0.5], 1), (301, None, 1), (302, vec(), None), (None, vec(), 1), (303, [1.0, None, 1.0, 1.0], 1), (304, [math.nan] * 4, 1), (350, [math.inf, 0.0, 0.0, 0.0], 1)]
    rows += [(400, [], 2), (450, [0.0] * 4, 2), (451, [3.0, 1.0], 2), (500, [1e30] * 4, 2), (550, [1e6] * 4, 0), (551, [9e5] * 4, 0), (552, [7e5] * 4, 1)]
    frame = spark.createDataFrame([(*r, "clash", "clash") for r in rows], "vec_id bigint, embedding array<double>, label int, row string, bucket string").repartition(4)
    want = mined(rows)
    assert Counter(map(tuple, op12.mine(frame).collect())) == want and want
    assert Counter(map(tuple, op12.mine(frame, block=16, anchor_block=2).collect())) == want
    assert op12.mine(frame.limit(0)).count() == 0


def test_anchors_are_not_broadcast(spark):
    """Copies of the anchors are as many as buckets of rows; a table of 64 copies went through the driver."""
    rows = [(i, [float(i % 5), float(i % 7)], i % 3) for i in range(600)]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")
    found = op12.mine(frame, block=8, anchor_block=2)
    assert Counter(map(tuple, found.collect())) == mined(rows)
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_transducers_compose():
    marks = lambda text, weights: [
        k for k, v in enumerate(op13.matched(text, op13.Lexicon(weights))[0]) if v
    ]
    w = {"twit": 3.0, "glork*": 2.0, "kill": 1.0}
    assert marks("what a twit this is", w) == [0]
    assert marks("you utter twit", w) == [op13.DIRECTED] == marks("twit that you are", w)
    assert marks("that is not a twit", w) == [op13.NEGATED]
    assert marks("the man said twit", w) == [op13.REPORTED] == marks('a "twit" is a noun', w)
    assert marks("not a twit, but it goes on and on: twit", w) == [0, op13.NEGATED]
    assert marks("I will kill you", w) == [op13.DIRECTED]
    assert marks("glorkish. GLORKEST? fine", w) == [0] and marks("twits killer", w) == []
    assert marks("glork one", {"glork**": 2.0}) == [] and marks("glorka glorko", {"glork**": 2.0}) == [0]
    sums, n = op13.matched(None, op13.Lexicon(w))
    assert not sums.any() and n == 0


def test_pieces_end_with_clauses(monkeypatch):
    monkeypatch.setattr(op13, "PIECE", 10)
    lexicon = op13.Lexicon({"twit": 3.0})
    text = "no ending here for long twit you. short. that is not a twit at all\nx"
    parts = list(op13._pieces(text))
    assert "".join(parts) == text and len(parts) > 2
    monkeypatch.undo()
    whole = op13.matched(text, lexicon)
    monkeypatch.setattr(op13, "PIECE", 10)
    assert (op13.matched(text, lexicon)[0] == whole[0]).all() and whole[1] == 16


def toxic_corpus(n=700):
    """Two insults, one of them a stem with new endings each time, in every tenth text; and copies of one toxic text."""
    rng = random.Random(13)
    rows = []
    for i in range(n):
        words = [f"{rng.choice('bcdfgl')}{rng.choice('aeiou')}{rng.choice('mnrst')}{rng.randrange(40)}" for _ in range(40)]
        toxic = i % 10 == 0
        if toxic:
            words[7] = rng.choice(["glorkwit", f"snarv{rng.choice('aeiou')}{rng.randrange(1000)}q"])
        rows.append((i, " ".join(words[:20]) + ". " + " ".join(words[20:]), int(toxic)))
    rows += [(n + k, rows[10][1] + " coda", 1) for k in range(60)]
    return rows


def test_toxicity_by_held_out_rows(spark):
    rows = toxic_corpus()
    docs = spark.createDataFrame([(i, t, "x", "clash", "clash") for i, t, _ in rows] + [(None, "a glorkwit", None, None, None), (9000, None, None, None, None), (9001, "", None, None, None), (3, "twice", None, None, None)], "doc_id bigint, text string, lang string, toxic string, sums string").repartition(3)
    labels = spark.createDataFrame([(i, t, 9) for i, _, t in rows] + [(None, 1, 1), (9000, None, 1)], "doc_id bigint, toxic int, text int")
    got = op13.toxicity(docs, labels).collect()
    assert len(got) == len(rows) + 4
    by = {r.doc_id: r for r in got if r.doc_id != 3}
    for i, _, toxic in rows:
        if i != 3:
            assert by[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and by[i].predicted == toxic, i
    assert by[None].predicted == 1 and not by[None].held_out
    assert by[9000].predicted == by[9001].predicted == 0 and 0 <= by[9000].score < 0.3
    again = {r.doc_id: r.score for r in op13.toxicity(docs.repartition(5), labels).collect()}
    assert all(math.isclose(again[i], by[i].score, rel_tol=1e-9) for i in by)
    unread = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert {r.doc_id: r.score for r in op13.toxicity(docs, unread).collect()} == {r.doc_id: r.score for r in got} or all(math.isclose(r.score, by[r.doc_id].score, rel_tol=1e-9) for r in op13.toxicity(docs, unread).collect() if r.doc_id != 3)


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "you idiot"), (2, "good day")], "doc_id bigint, text string")
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    assert {r.doc_id: r.predicted for r in op13.toxicity(docs, none).collect()} == {1: 1, 2: 0}
    assert op13.toxicity(docs.limit(0), none).count() == 0


def test_row_numbers_outlast_another_split(spark, tmp_path):
    """Scans of the same table by another number of cores cut it elsewhere; the numbers stay."""
    spark.range(4000).select(F.col("id").alias("doc_id"), F.concat_ws(" ", *[F.hash("id", F.lit(k)) for k in range(12)]).alias("text")).repartition(40).write.parquet(f"{tmp_path}/docs")
    read = spark.read.parquet(f"{tmp_path}/docs")
    rows, was = numbered(read.select("doc_id")), spark.conf.get("spark.sql.leafNodeDefaultParallelism", None)
    found = []
    try:
        for n in (4, 64):
            spark.conf.set("spark.sql.leafNodeDefaultParallelism", n)
            found.append({r.doc_id: r.row for r in spark.createDataFrame(rows.collect()).collect()} if n == 4 else {r.doc_id: r.row for r in rows.select("row", "doc_id").collect()})
        assert found[0] == found[1] and len(set(found[0].values())) == 4000
        assert numbered(read.groupBy("doc_id").count()).select("row").distinct().count() == 4000
        assert jaccard_groups(read).where("component <> row").count() == 0
    finally:
        spark.conf.unset("spark.sql.leafNodeDefaultParallelism") if was is None else spark.conf.set("spark.sql.leafNodeDefaultParallelism", was)


@pytest.mark.parametrize(("most", "at_once"), [(70, 16), (18, 16), (18, 4)])
def test_leaks_by_shards(spark, most, at_once):
    """Items that passages have only in part score the same in one index and in many."""
    rng = random.Random(1)
    words = lambda n: " ".join(f"w{rng.randrange(60)}" for _ in range(n))
    items = [(i, f"{words(rng.randrange(6, 12))}? {words(8)}.") for i in range(25)]
    docs = []
    for i in range(60):
        q = items[i % 25][1].split()
        cut = len(q) - rng.randrange(0, 3)
        docs.append((i, " ".join([words(30), *q[:cut], words(rng.randrange(50))])))
    frame, bench = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(2), spark.createDataFrame(items, "item_id bigint, text string")
    whole = sorted(map(tuple, op1.leaks(frame, bench, threshold=0.4, least_overlap=0.3).collect()))
    dealt = sorted(map(tuple, op1.leaks(frame, bench, threshold=0.4, least_overlap=0.3, most_words=most, at_once=at_once).collect()))
    assert whole == dealt and len(whole) >= 40


def test_mix_of_one_id(spark):
    """50,000 rows of one id are cut into groups like others; words taken meet the target, twice the same."""
    rows = spark.range(50_000).select(F.lit(7).cast("bigint").alias("doc_id"), F.concat_ws(" ", *[F.col("id") % 9] * 3).alias("text"), F.lit("a").alias("source")).union(spark.createDataFrame([(8, "x y", "b"), (9, "z " * 40, None)], "doc_id bigint, text string, source string"))
    first, again = (mix(rows, group=2_000) for _ in range(2))
    got = {r.source: (r.taken, r.target, r.n) for r in first.groupBy("source").agg(F.sum("taken").alias("taken"), F.max("target").alias("target"), F.count("*").alias("n"), F.max(F.col("taken") - 2 * F.col("size")).alias("over")).collect()}
    assert got["a"][2] == 50_000 and all(abs(taken - target) <= 1 for taken, target, _ in got.values())
    count = lambda df: Counter((r.source, r.taken) for r in df.collect())
    assert count(first) == count(again)
