"""Hot keys, texts over a slice and columns that clash, where these weren't tested before."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from pagetext.llm.op2_revisits import resolve_revisits
from pagetext.llm.op3_url_filter import RULES, url_filter
from pagetext.llm.op4_lattice_score import lattice_scores
from pagetext.llm import op6_quality
from pagetext.llm.op6_quality import classify
from test_hard_cases import kneser_ney
from test_llm import P, words


def clashing(df):
    return df.withColumns({c: F.lit("clash") for c in ("row", "word", "c", "n", "tokens", "score", "f0", "document", "key", "slice", "bucket")})


@pytest.mark.parametrize("bound", [1 << 20, 0])
def test_hot_url_in_filter(spark, bound):
    """One listed URL holds a third of all rows, each of which is repeated; every row keeps its verdict."""
    rows = [(i, f"http://other{i}.net/x") for i in range(600)] + [(i // 2, "http://l.net/x/?utm_source=1") for i in range(600)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string").withColumn("canonical", F.lit("clash")).repartition(5)
    listed = spark.createDataFrame([("l.net/x",)] * 3 + [("other7.net/x",)], "canonical string")
    got = Counter((r.page_id, r.host, r.verdict) for r in url_filter(pages, listed, RULES, broadcast_bytes=bound).collect())
    assert got == Counter((i, u.split("/")[2], "block" if "l.net" in u.split("/")[2:3] or i == 7 and "other7" in u else "allow") for i, u in rows)


@pytest.mark.parametrize("seconds", [7, 10**9])
def test_hot_url_in_revisits(spark, seconds):
    """One URL with 900 captures, rows repeated, ties of time: as looked up one by one."""
    rng = random.Random(2)
    rows = []
    for i in range(900):
        kind = rng.choice(["response", "revisit", "revisit"])
        rows.append((i, kind, "http://a.com/p" if i % 3 else f"http://b.com/{i % 7}", rng.randrange(300), rng.choice(["e1", "e2"]), None, {"etag": f"{i}"} if kind == "response" else {"date": "d"}, "d"))
    rows += rows[:20]
    df = spark.createDataFrame(rows, "record_id bigint, kind string, url string, ts bigint, etag string, last_modified string, headers map<string,string>, digest string").withColumn("canonical", F.lit("clash")).repartition(4)
    want = Counter()
    for i, kind, url, ts, etag, *_ in rows:
        if kind == "revisit":
            best = max(((r[3], r[0], r[4]) for r in rows if r[1] == "response" and r[2] == url and r[3] < ts), default=None)
            want[i, best[1] if best else None, "no_earlier_response" if best is None else "resolved" if best[2] == etag else "validator_mismatch"] += 1
    assert Counter((r.record_id, r.refers_to, r.status) for r in resolve_revisits(df, bucket_seconds=seconds).collect()) == want


def test_perplexity_of_a_text_over_its_slice(spark):
    trusted = ["abra cadabra", "a bad cab", "raba cab"]
    text = "abra cadabra bad " * 100_000
    docs = clashing(spark.createDataFrame([*[(i, t, "en") for i, t in enumerate(trusted)], (9, text, "en"), (10, "", "en")], "doc_id bigint, text string, lang string"))
    labels = spark.createDataFrame([(i, 1, 0) for i in range(3)], "doc_id bigint, quality int, toxic int")
    got = {r.doc_id: r for r in classify(docs, labels).collect()}
    model = kneser_ney(trusted, 6)
    one, two, three = (model("abra cadabra bad " * k) for k in (1, 2, 3))
    assert two - one == pytest.approx(three - two)
    assert got[9].n_symbols == len(text) + 1 and got[9].log10_prob == pytest.approx(one + (two - one) * 99_999)


def test_scores_of_a_text_over_its_slice_and_of_clashing_columns(spark):
    rng = random.Random(6)
    texts = [words(rng, rng.randrange(1, 60), 90) for _ in range(40)] + [words(rng, 400_000, 90)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    path = P.path("piece_bpe_32k.model")
    plain, odd = ({r.doc_id: r for r in lattice_scores(d, path).collect()} for d in (docs, clashing(docs)))
    assert plain.keys() == odd.keys() and all(math.isclose(plain[i].score, odd[i].score, rel_tol=1e-9) for i in plain)
    assert {i: r.n_tokens for i, r in plain.items()} == {i: len(t.split()) + 1 for i, t in enumerate(texts)}
    # A document's score is the sum of its words', so a text of the same words in two rows scores as one less an end.
    halves = spark.createDataFrame([*enumerate(texts[:-1]), (40, texts[-1]), (100, " ".join(texts[-1].split()[:200_000])), (101, " ".join(texts[-1].split()[200_000:]))], "doc_id bigint, text string")
    by = {r.doc_id: r for r in lattice_scores(halves, path).collect()}
    end = lattice_scores(halves.union(spark.createDataFrame([(1000, "")], halves.schema)), path).where("doc_id = 1000").first().score
    assert by[100].score + by[101].score == pytest.approx(by[40].score + end, rel=1e-4)


def test_stages_of_long_texts_and_clashing_columns(spark, tmp_path):
    """A text over 4 MB and columns named like those inside pass every stage as they came."""
    rng = random.Random(9)
    long_text = words(rng, 700_000, 10**6)
    assert len(long_text) > 4 << 20
    rows = [(i, words(rng, 60, 10**6), "en", "a") for i in range(8)] + [(50, long_text, "en", "b"), (51, long_text, None, None)]
    clashing(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").withColumn("n_chars", F.length("text"))).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, words(rng, 30, 10**6))], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = docs
    for name, stage in pipeline.STAGES[:-1]:
        seen = pipeline.stored(stage(spark, seen, str(tmp_path)))
        assert seen.columns == docs.columns and seen.where("row <> 'clash' OR document <> 'clash' OR f0 <> 'clash' OR key <> 'clash'").count() == 0
    left = {r.doc_id: r.text for r in seen.select("doc_id", "text").collect()}
    assert left == {i: t for i, t, _, _ in rows if i != 51}
    assert pipeline.run(spark, str(tmp_path)).count() == 9


def test_quality_learns_from_all_trusted_rows(spark, monkeypatch):
    """20,300 trusted rows are all in the model's texts; there is no most."""
    from pagetext.llm import op6_quality as op6

    seen, fit = [], op6.fit
    monkeypatch.setattr(op6, "fit", lambda texts: seen.append(texts.count()) or fit(texts.limit(50)))
    docs = spark.range(20_500).selectExpr("id doc_id", "concat('text ', id % 50) text", "'es' lang")
    labels = spark.range(20_500).selectExpr("id doc_id", "int(id < 20300) quality", "0 toxic")
    assert op6.score(docs, labels).count() == 20_500 and seen == [20_300]


def test_trusted_texts_stay_where_they_are(spark):
    """Exactly the trusted rows' texts, repeated ids and all, and none is shuffled however many there are (op6's disk)."""
    docs = spark.createDataFrame([(i % 900 if i % 7 else None, f"text {i}") for i in range(2000)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(0, 1000, 2)] + [(None, 1, 0)], "doc_id bigint, quality int, toxic int")
    want = sorted(r.text for r in docs.join(op6_quality.trusted_ids(labels), "doc_id", "left_semi").collect())
    for bits in (1, 16):  # one bit lets many others pass
        assert sorted(r.text for r in op6_quality.trusted_texts(docs, labels, bits_per_id=bits).collect()) == want and want
    least = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = op6_quality.trusted_texts(docs, labels)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", least)
    assert "SortMergeJoin" not in plan and not any("Exchange" in line and "text" in line for line in plan.splitlines())
