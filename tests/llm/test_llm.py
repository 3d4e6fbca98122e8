"""The ten operators against brute force on small tables with nulls, ties, repeats, long and empty texts."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagetext.llm import op1_decontaminate as op1
from pagetext.llm.op2_revisits import resolve_revisits
from pagetext.llm.op3_url_filter import RULES, url_filter
from pagetext.llm.op4_lattice_score import Lattice, lattice_scores, read_pieces
from pagetext.llm.op5_jaccard_join import jaccard_groups
from pagetext.llm.op6_quality import classify
from pagetext.llm.op7_mixing import mix
from pagetext.llm.op8_embedding_dedup import near_vectors
from pagetext.llm.op9_token_counts import token_counts
from pagetext.llm.op10_long_repeats import long_repeats

P = pytest.importorskip("public_tokenizers")
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, row string, keep string"


def words(rng, n, pool=400):
    return " ".join(f"w{rng.randrange(pool)}" for _ in range(n))


def corpus():
    """Texts with copies, near copies, shared passages, nulls, blanks, a long word, repeated rows and ids."""
    rng = random.Random(3)
    base = [words(rng, rng.randrange(1, 300)) for _ in range(40)]
    passage = words(rng, 90)
    texts = [*base, base[3], base[3], None, "", "  \t\n ", "one", "one two", "x" * 5000, "ab c" * 400, passage, base[5] + "\n" + passage, passage + " " + base[6]]
    for b in base[:12]:
        w = b.split()
        for k in range(0, len(w), 60):
            w[k] = "changed"
        texts.append(" ".join(w))
    rows = [(i, t, "en" if i % 3 else None, ("b", "a", None)[i % 3], len(t or ""), "clash", "clash") for i, t in enumerate(texts)]
    return [*rows, rows[7], (None, "null id", "en", "a", 7, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS).repartition(3).cache()


def empty(spark):
    return spark.createDataFrame([], DOCS)


def components(n, links):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        root[max(find(a), find(b))] = min(find(a), find(b))
    return [find(i) for i in range(n)]


@pytest.mark.parametrize(("width", "percent", "most"), [(3, 90, 3_000_000), (5, 80, 3_000_000), (3, 50, 600), (5, 80, 300), (2, 30, 100)])
def test_jaccard(spark, docs, width, percent, most):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set())
    links = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    want = Counter((rows[i][0], len(sets[i]), min((rows[j][0] for j, c in enumerate(root) if c == root[i] and rows[j][0] is not None), default=None)) for root in [components(len(rows), links)] for i in range(len(rows)))
    got = jaccard_groups(docs, width=width, percent=percent, most_in_task=most)
    least = got.groupBy("component").agg(F.min("doc_id").alias("c"))
    assert Counter(tuple(r) for r in got.join(least, "component").select("doc_id", "n_shingles", "c").collect()) == want
    assert jaccard_groups(empty(spark)).count() == 0


@pytest.mark.parametrize("batch", [10_000, 3])
def test_long_repeats(spark, docs, batch):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        _long_repeats(spark, docs)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_levels_find_what_one_sort_finds():
    """Suffixes of few keys and stretches, in batches of any size: the marks don't depend on how they came."""
    from pagetext.llm.op10_long_repeats import _SUFFIX, Levels

    rng = np.random.default_rng(3)
    for _ in range(20):
        n = int(rng.integers(1, 400))
        every = {k: np.arange(n).astype(kind) for k, kind in _SUFFIX.items()} | {"key": rng.integers(0, 40, n).astype(np.uint64), "twice": rng.random(n) < 0.05}
        every["whole"] = rng.integers(1, 4, n).astype(np.uint64) + every["key"]
        cuts = [0, *sorted(rng.integers(0, n + 1, 9).tolist()), n]
        levels = Levels()
        for s, e in zip(cuts, cuts[1:], strict=False):
            if e > s:
                levels.add({k: v[s:e] for k, v in every.items()})
        sizes = [len(r["key"]) for r in levels.runs]
        assert all(a > 2 * b for a, b in zip(sizes, sizes[1:], strict=False)) and sum(sizes) == n
        kinds = Counter(zip(every["key"].tolist(), every["whole"].tolist(), strict=True))
        per_key = Counter(k for k, _ in kinds)
        probed = []
        for run in levels.runs:
            for i, row in enumerate(run["row"].tolist()):
                k, w = int(every["key"][row]), int(every["whole"][row])
                assert run["settled"][i] == (kinds[k, w] > 1 or bool(every["twice"][row])) and run["several"][i] == (per_key[k] > 1)
                probed += [(k, w)] * bool(run["several"][i] and run["first"][i])
        assert Counter(probed) == Counter(kw for kw in kinds if per_key[kw[0]] > 1)


def _long_repeats(spark, docs):
    rows = [(r.doc_id, (r.text or "").encode()) for r in docs.collect()]
    seen = Counter(t[k : k + 400] for _, t in rows for k in range(len(t) - 399))
    want = Counter()
    for i, t in rows:
        gone = np.zeros(len(t) + 1, int)
        for k in range(len(t) - 399):
            if seen[t[k : k + 400]] > 1:
                gone[k], gone[k + 400] = gone[k] + 1, gone[k + 400] - 1
        mask = np.cumsum(gone[:-1]) > 0
        starts = int((mask & ~np.concatenate([[False], mask[:-1]])).sum()) if len(t) else 0
        want[i, len(t), int(mask.sum()), starts, hashlib.sha256(bytes(np.frombuffer(t, np.uint8)[~mask])).hexdigest()] += 1
    got = long_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "left").collect()
    assert Counter(tuple(r) for r in got) == want
    assert long_repeats(empty(spark)).count() == 0


def ranked_pieces(path):
    """Weights by a vocabulary's own ranks, read apart from the library."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    weights, scores = {}, {}
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
            scores[piece] = model.get_score(i)
    least = min(x for x in scores.values() if x < 0) - 10
    for key in [(True, b""), *((False, bytes([b])) for b in range(256))]:
        weights[key] = 1 / (10 - least)
    for piece, x in scores.items():
        own = piece.removeprefix("▁")
        if piece and "▁" not in own and own.encode() == own.encode().lower():
            weights[piece.startswith("▁"), own.encode()] = 1 / (10 - (x if x < 0 else max(y for y in scores.values() if y < 0)))
    return weights


def arcs_of(word, weights):
    total = sum(weights.values())
    n, longest = len(word), max(len(b) for _, b in weights)
    first = [(0, j, weights[True, word[:j]] / total) for j in range(min(n, longest) + 1) if (True, word[:j]) in weights]
    return first, [(i, j, weights[False, word[i:j]] / total) for i in range(n) for j in range(i + 1, min(n, i + longest) + 1) if (False, word[i:j]) in weights]


def forward(word, weights):
    first, inner = arcs_of(word, weights)
    ahead = np.full(len(word) + 1, -np.inf)
    for _, j, p in first:
        ahead[j] = np.logaddexp(ahead[j], math.log(p))
    for i, j, p in inner:
        ahead[j] = np.logaddexp(ahead[j], ahead[i] + math.log(p))
    return ahead


def expected_counts(word, weights):
    """By the probability with and without each arc's weight: d log p / d log w."""
    first, inner = arcs_of(word, weights)
    ahead = forward(word, weights)
    back = np.full(len(word) + 1, -np.inf)
    back[-1] = 0
    for i, j, p in sorted(inner, reverse=True):
        back[i] = np.logaddexp(back[i], math.log(p) + back[j])
    found = Counter()
    for start, arcs in ((True, first), (False, inner)):
        for i, j, p in arcs:
            found[start, word[i:j]] += math.exp((0 if start else ahead[i]) + math.log(p) + back[j] - ahead[-1])
    return found


@pytest.mark.parametrize("shared", [200_000, 20])
def test_lattice(spark, docs, shared):
    path = P.path("piece_bpe_32k.model")
    rows = [(r.doc_id, (r.text or "").encode().lower().split()) for r in docs.collect()]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    counts = Counter(w for i, t in rows if not held(i) for w in t)
    ends = sum(not held(i) for i, _ in rows)
    total, types = sum(counts.values()) + ends, len(counts) + 1
    once, two = (sum(c == k for c in counts.values()) for k in (1, 2))
    off = once / (once + 2 * two) if once and two else 0.5
    weights = ranked_pieces(path)
    fitted = {key: w * 0.01 * len(weights) / sum(weights.values()) for key, w in weights.items()}
    for w in counts:
        for key, n in expected_counts(w, weights).items():
            fitted[key] += n
    spelt = {w: math.exp(forward(w, fitted)[-1]) for _, t in rows for w in t}
    got = lattice_scores(docs, path, most_shared=shared).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    for i, t in rows:
        r = by[i]
        base = sum(math.log10((counts[w] + 0.5) / (total + 0.5 * (types + 1))) for w in t) + math.log10((ends + 0.5) / (total + 0.5 * (types + 1)))
        score = sum(math.log10(max(counts[w] - off, 0) / total + off * types / total * spelt[w]) for w in t) + math.log10((ends - off) / total)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(i), len(t) + 1, sum(counts[w] > 0 for w in t) + 1, total)
        assert r.base_score == pytest.approx(base) and r.score == pytest.approx(score)
    assert lattice_scores(empty(spark), path).count() == 0


def test_expected_pieces_follow_the_weights():
    weights = {(True, b""): 1.0, (True, b"a"): 2.0, (False, b"a"): 3.0, (False, b"b"): 4.0, (False, b"ab"): 5.0, (True, b"ab"): 6.0}
    for change in (1.0, 9.0):
        weights[True, b"ab"] = 6.0 * change
        p = {k: w / sum(weights.values()) for k, w in weights.items()}
        ways = {((True, b"ab"),): p[True, b"ab"], ((True, b"a"), (False, b"b")): p[True, b"a"] * p[False, b"b"], ((True, b""), (False, b"ab")): p[True, b""] * p[False, b"ab"], ((True, b""), (False, b"a"), (False, b"b")): p[True, b""] * p[False, b"a"] * p[False, b"b"]}
        want = Counter()
        for way, x in ways.items():
            for piece in way:
                want[piece] += x / sum(ways.values())
        got: dict = {}
        Lattice(weights).expected(b"ab", got)
        assert got == pytest.approx(dict(want))
    tiny = {(True, b""): 1.0, (False, b"x"): 1e-11, (False, b"xx"): 1e-24}
    got = {}
    Lattice(tiny).expected(b"x" * 60, got)
    assert got[True, b""] == pytest.approx(1) and got[False, b"x"] + 2 * got[False, b"xx"] == pytest.approx(60)


def test_lattice_sums_all_segmentations():
    model = Lattice({(True, b""): 1.0, (True, b"a"): 2.0, (False, b"a"): 3.0, (False, b"b"): 4.0, (False, b"ab"): 5.0, (True, b"ab"): 6.0})
    p = lambda x: x / 21
    want = p(6) + p(2) * p(4) + p(1) * p(5) + p(1) * p(3) * p(4)
    assert model.score(b"ab") == pytest.approx(math.log10(want))
    assert model._long(b"ab") == pytest.approx(math.log10(want))


def test_lattice_words_below_the_least_double():
    model = Lattice({(True, b""): 1.0, (True, b"q"): 1.0, (False, b"x"): 1e-11, (False, b"y"): 1e-12})
    for word in (b"x" * 30, b"y" * 32, b"xy" * 15):
        assert model.score(word) == pytest.approx(math.log10(0.5) + sum(-math.log10(2) - {120: 11, 121: 12}[b] for b in word))


def test_lattice_takes_probabilities_of_a_vocabulary(spark, tmp_path):
    import sentencepiece

    rng = random.Random(7)
    lines = [" ".join(rng.choice(["reading", "house", "stand", "stands", "reader", "houses"]) for _ in range(12)) for _ in range(300)]
    sentencepiece.SentencePieceTrainer.train(sentence_iterator=iter(lines), model_prefix=f"{tmp_path}/u", vocab_size=40, model_type="unigram", hard_vocab_limit=False, minloglevel=2)
    model = sentencepiece.SentencePieceProcessor(model_file=f"{tmp_path}/u.model")
    weights = {(p.startswith("▁"), p.removeprefix("▁").encode()): math.exp(model.get_score(i)) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i)) for p in [model.id_to_piece(i)]}
    got = read_pieces(f"{tmp_path}/u.model")
    assert len(weights) > 10 and {k: got[k] for k in weights} == pytest.approx(weights)
    held = next(i for i in range(99) if zlib.crc32(str(i).encode()) % 5 == 1)
    row = lattice_scores(spark.createDataFrame([(held, "houses é")], "doc_id bigint, text string"), f"{tmp_path}/u.model").first()
    lattice = Lattice(got)
    assert row.score == pytest.approx(lattice.score(b"houses") + lattice.score("é".encode()) - math.log10(2))


def test_token_counts(spark):
    from tokenizers import Tokenizer

    texts = [None, "", "don't 're ''s", " \n\n a  ", "x<|endoftext|> y", "é中 12ab !!  " * 50, "q" * 3000 + "\n" * 2000, "We'll've"]
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want = [(i, len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 1024) for i, t in enumerate(texts)]
    df = spark.createDataFrame([*enumerate(texts), (0, None)], "doc_id bigint, text string")
    got = sorted(tuple(r) for r in token_counts(df, P.path("byte_bpe_50k.json")).collect())
    assert got == sorted([*want, want[0]])
    assert token_counts(df.limit(0), P.path("byte_bpe_50k.json")).count() == 0


def test_mixing(spark, docs):
    got = mix(docs, group=5).collect()
    sizes = [(r.source, len((r.text or "").encode().split())) for r in docs.collect()]
    names = sorted({s for s, _ in sizes if s is not None}) + [None]
    own = {s: sum(n for x, n in sizes if x == s) for s in names}
    share, open_, target = 1.5 * sum(own.values()), set(names), {}
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    while True:  # share by weight until no target is above twice its source
        rest = share - sum(target.values())
        each = {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
        above = {s for s in open_ if each[s] > 2 * own[s]}
        if not above:
            target |= each
            break
        target |= {s: 2.0 * own[s] for s in above}
        open_ -= above
    assert len(got) == len(sizes)
    for s in names:
        rows = [r for r in got if r.source == s]
        assert all(r.target == pytest.approx(target[s]) and r.source_size == own[s] for r in rows)
        assert abs(sum(r.taken for r in rows) - target[s]) <= 1
        assert all(0 <= r.taken <= 2 * r.size for r in rows) and sum(r.copies != int(r.copies) for r in rows) <= 1
    assert Counter(map(tuple, got)) == Counter(map(tuple, mix(docs, group=5).collect()))
    assert mix(empty(spark)).count() == 0


@pytest.mark.parametrize("block", [2048, 3])
def test_vectors(spark, block):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(6, 16))
    rows = []
    for i in range(60):
        v = centres[i % 6] + rng.normal(size=16) * 0.13
        rows.append((i, [float(np.float32(x)) for x in v], i % 2))
    rows += [(60, rows[0][1], 0), (61, rows[0][1], 1), (62, None, 0), (63, [0.0] * 16, 0), (64, [float("nan")] * 16, 0), (65, rows[1][1], None), (66, [None, 1.0], 0)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").repartition(3)
    fine = [i for i, (_, v, lab) in enumerate(rows) if v and lab is not None and None not in v and np.isfinite(v).all() and any(v)]
    unit = {i: np.array(rows[i][1]) / np.linalg.norm(rows[i][1]) for i in fine}
    links = [(i, j) for i in fine for j in fine if j < i and rows[i][2] == rows[j][2] and unit[i] @ unit[j] >= 0.98]
    root = components(len(rows), links)
    n = Counter(x for pair in links for x in pair)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in near_vectors(df, cell=8, block=block, window=1.0).collect()}
    assert got == {i: (n[i], root[i], root[i] == i) for i in range(len(rows))} and links
    assert near_vectors(df.limit(0)).count() == 0


def recall(spark, x, **how):
    df = spark.createDataFrame([(i, [float(v) for v in r], 0) for i, r in enumerate(x)], "vec_id bigint, embedding array<double>, label int")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = int((unit @ unit.T >= 0.98).sum()) - len(x)
    assert want > 100
    return near_vectors(df, **how).agg(F.sum("n_links")).first()[0] / want


def test_vector_recall_at_the_default_window(spark):
    """Partners in random directions, along the few directions that vectors vary in, and across centroids."""
    rng = np.random.default_rng(6)
    isotropic = np.repeat(rng.normal(size=(150, 64)), 4, 0) + rng.normal(size=(600, 64)) * 0.11
    scale = np.geomspace(1, 0.02, 64)
    narrow = np.repeat(rng.normal(size=(150, 64)) * scale, 4, 0) + rng.normal(size=(600, 64)) * scale * 0.11
    ends = rng.normal(size=(40, 64))
    a, b = ends[rng.integers(0, 40, 300)], ends[rng.integers(0, 40, 300)]
    between = np.concatenate([(a + b) / 2 + (a - b) * t for t in (0.06, -0.06)])
    found = {name: recall(spark, x, cell=16) for name, x in (("isotropic", isotropic), ("narrow", narrow), ("between", between))}
    print(found)
    assert all(r >= 0.9 for r in found.values()), found


def test_vectors_of_one_direction_and_odd_ids(spark):
    """A third of all vectors in one tight group, in levels of cells; huge and tiny components; null and repeated ids."""
    rng = np.random.default_rng(9)
    base = rng.normal(size=8)
    rows = [(i, [float(v) for v in base + rng.normal(size=8) * 1e-3], "a") for i in range(200)]
    rows += [(1000 + i, [float(v) for v in rng.normal(size=8)], "a") for i in range(200)]
    rows += [(2000, [1e200, 1e200], "b"), (2001, [1e-200, 1e-200], "b"), (None, [1.0, 1.0], "b"), (None, [3.0, -1.0], "b"), (2002, [3.0, -1.0], "b"), (2002, [0.0, 1.0], "b")]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label string").withColumn("lead", F.lit(1)).withColumn("cell", F.lit("x"))
    got = near_vectors(df, cell=8, block=50, window=1.0).collect()
    assert len(got) == len(rows)
    by = {r.vec_id: r for r in got if r.vec_id is not None and r.vec_id != 2002}
    assert all(by[i].component_id == 0 and by[i].n_links >= 199 and by[i].kept == (i == 0) for i in range(200))
    assert (by[2000].n_links, by[2001].n_links, by[2001].component_id) == (2, 2, 2000)
    assert Counter((r.vec_id, r.n_links, r.component_id) for r in got if r.vec_id in (None, 2002)) == Counter([(None, 2, 2000), (None, 1, 2002), (2002, 1, 2002), (2002, 0, 2002)])


def test_url_filter(spark):
    rows = [(1, "https://www.a.example.org/es/x?b=1&a=2#f"), (2, "http://A.com:80/fr/"), (3, "http://b.com/de/1"), (4, "http://l.net/x/?utm_source=1"), (5, None), (6, "no scheme"), (7, "http://q.org"), (8, "https://example.org/en/12"), (4, "https://l.net/x"), (9, "http://xexample.org/es/")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string")
    listed = spark.createDataFrame([("l.net/x",), ("l.net/x",), (None,)], "canonical string")
    for bound in (1 << 20, 0):
        got = Counter((r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_filter(pages, listed, RULES, broadcast_bytes=bound).collect())
        assert got == Counter([(1, "www.a.example.org", "/es/x", "example.org/es/", "block"), (2, "a.com:80", "/fr/", None, "allow"), (3, "b.com", "/de/1", "com/de/", "block"), (4, "l.net", "/x/", None, "block"), (4, "l.net", "/x", None, "block"), (5, "", "", None, "allow"), (6, "", "", None, "allow"), (7, "q.org", "", None, "allow"), (8, "example.org", "/en/12", "example.org/en/1", "block"), (9, "xexample.org", "/es/", "org/", "allow")])
    assert url_filter(pages, listed.limit(0), RULES).where("verdict = 'block'").count() == 3
    assert url_filter(pages.limit(0), listed, RULES).count() == 0


def test_revisits(spark):
    h = {"etag": "x", "content-length": "9", "date": "1"}
    rows = [
        (1, "response", "http://a.com/p", 10, '"e1"', None, h, "d1"),
        (2, "revisit", "https://www.a.com/p/", 10, '"e1"', None, {}, None),
        (3, "revisit", "http://a.com/p#z", 9000, 'W/"e1"', None, {"date": "2", "content-length": "0"}, None),
        (4, "response", "http://a.com/p", 9000, '"e2"', "m", h, "d4"),
        (5, "response", "http://a.com/p", 9000, '"e3"', "m", h, "d5"),
        (6, "revisit", "http://a.com/p", 99999, '"e2"', "m", None, None),
        (7, "revisit", "http://a.com/p", 99999, None, "m", None, None),
        (8, "revisit", "http://a.com/p", 99999, None, None, None, None),
        (9, "revisit", None, 5, None, None, None, None),
        (10, "revisit", "http://a.com/p", None, None, None, None, None),
    ]
    df = spark.createDataFrame(rows, "record_id bigint, kind string, url string, ts bigint, etag string, last_modified string, headers map<string,string>, digest string")
    for seconds in (1, 3600, 10**9):
        got = {r.record_id: (r.status, r.refers_to, r.headers) for r in resolve_revisits(df, bucket_seconds=seconds).collect()}
        assert got == {2: ("no_earlier_response", None, None), 3: ("resolved", 1, {"etag": "x", "content-length": "9", "date": "2"}), 6: ("validator_mismatch", 5, None), 7: ("resolved", 5, h), 8: ("no_validator", 5, None), 9: ("no_earlier_response", None, None), 10: ("no_earlier_response", None, None)}
    assert resolve_revisits(df.limit(0)).count() == 0


def test_wand_is_exact():
    rng = random.Random(1)
    index = op1.Index([(i, words(rng, rng.randrange(3, 40), 300)) for i in range(300)])
    for _ in range(60):
        query = sorted({t for w in words(rng, 60, 300).split() if (t := index.terms.get(w.encode())) is not None})
        scores = Counter()
        for t in query:
            for a, x in zip(index.at[t], index.impact[t], strict=True):
                scores[int(a)] += x
        for threshold in (0.15, 0.3, 0.6):
            assert sorted((i, round(s, 9)) for i, s in index.search(query, threshold)) == sorted((i, round(s, 9)) for i, s in scores.items() if s >= threshold - 1e-9)


@pytest.mark.parametrize("most", [2_000_000, 20])
def test_leaks(spark, docs, most):
    rng = random.Random(9)
    items = [(i, f"{words(rng, 20, 5000)}. Answer {words(rng, 6, 5000)}.") for i in range(30)] + [(90, None), (91, ""), (92, "...")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    planted = spark.createDataFrame([(500, "w1 w2 " * 90 + items[4][1].upper() + " w3" * 70), (501, items[5][1]), (502, items[6][1].split(".")[0]), (502, "")], "doc_id bigint, text string")
    got = {(r.doc_id, r.item_id) for r in op1.leaks(docs.select("doc_id", "text").union(planted), bench, most_words=most).collect()}
    assert got == {(500, 4), (501, 5)}
    assert op1.leaks(planted, bench.limit(0)).count() == 0 and op1.leaks(planted.limit(0), bench).count() == 0


def test_quality(spark):
    rng = random.Random(2)
    good = [(i, " ".join(rng.choice(["the", "of", "reading", "a", "house", "stands"]) for _ in range(60)) + ".", "en") for i in range(120)]
    bad = [(i, "".join(rng.choice("#%$@!ZQXJ|") for _ in range(300)), "en") for i in range(200, 220)]
    odd = [(300, None, None), (301, "", "en"), (None, good[0][1], "xx"), (1, good[1][1], "en")]
    df = spark.createDataFrame([*good, *bad, *odd], "doc_id bigint, text string, lang string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(100)] + [(201, 0, 0), (5, 1, 1), (None, 1, 0), (3, 1, None)], "doc_id bigint, quality int, toxic int")
    got = classify(df, labels).collect()
    assert len(got) == len(good) + len(bad) + len(odd)
    assert all(r.keep == (r.doc_id is None or not 200 <= r.doc_id < 220) for r in got)
    assert all(r.keep for r in classify(df, labels.limit(0)).collect())
    assert classify(df.limit(0), labels).count() == 0


def test_quality_of_a_second_script(spark):
    rng = random.Random(13)
    latin = "".join(chr(c) for c in range(33, 127))
    first = [(i, "".join(rng.choice(latin) for _ in range(8000)), "en") for i in range(60)]
    good = [(i, " ".join(rng.choice(["читать", "большой", "дом", "стоит", "ночью", "река"]) for _ in range(40)), "ru") for i in range(100, 180)]
    bad = [(i, "".join(rng.sample(t, len(t))), "ru") for i, (_, t, _) in enumerate(good[:20], 200)]
    labels = spark.createDataFrame([(i, 1, 0) for i in [*range(60), *range(100, 160)]], "doc_id bigint, quality int, toxic int")
    df = spark.createDataFrame([*first, *good, *bad], "doc_id bigint, text string, lang string")
    assert {r.doc_id: r.keep for r in classify(df, labels).collect()} == {i: i < 200 for i, _, _ in [*first, *good, *bad]}


def test_model_probabilities_sum_to_one(spark):
    from pagetext.llm.op6_quality import fit, log_probabilities

    _, orders = fit(spark.createDataFrame([("abra cadabra",), ("abc",), ("",)], "text string"))
    assert np.allclose((10.0 ** log_probabilities(orders).astype(float)).reshape(-1, 64).sum(1), 1, atol=1e-4)
