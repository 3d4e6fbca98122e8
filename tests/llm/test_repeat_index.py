"""Stored levels of suffixes: batches one after another find what one table does."""

import hashlib
import random

from pagetext.llm.op10_long_repeats import RepeatIndex, long_repeats

LENGTH = 80


def corpus():
    rng = random.Random(10)
    words = lambda n: " ".join(f"{rng.randrange(10**6)}" for _ in range(n))
    shared = [words(30) for _ in range(6)]
    texts = [words(rng.randrange(5, 120)) for _ in range(60)]
    for i in range(0, 60, 2):
        piece = rng.choice(shared)
        cut = rng.randrange(0, 60)
        texts[i] = texts[i][:50] + piece[cut:] + texts[i][50:]
    texts += [texts[3], texts[3] + " tail", None, "", "short", shared[0] * 2, "ab" * 300]
    rng.shuffle(texts)
    return list(enumerate(texts))


def brute(rows):
    data = [(i, (t or "").encode()) for i, t in rows]
    seen: dict[bytes, int] = {}
    for _, b in data:
        for k in range(len(b) - LENGTH + 1):
            seen[b[k : k + LENGTH]] = seen.get(b[k : k + LENGTH], 0) + 1
    out = {}
    for i, b in data:
        gone = bytearray(len(b))
        for k in range(len(b) - LENGTH + 1):
            if seen[b[k : k + LENGTH]] > 1:
                gone[k : k + LENGTH] = b"\1" * LENGTH
        spans = sum(1 for k, g in enumerate(gone) if g and (not k or not gone[k - 1]))
        out[i] = (len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest())
    return out


def shown(df):
    return {r.id: (r.n_bytes, r.n_removed, r.n_spans, r.left) for r in df.collect()}


def indexed(spark, path, rows, cuts, forget=False):
    index = RepeatIndex(spark, str(path), length=LENGTH, parts=3)
    for first, last in zip([0, *cuts], [*cuts, len(rows)], strict=True):
        index.add(spark.createDataFrame(rows[first:last], "id bigint, text string").repartition(2))
        if forget:
            index.sizes.clear()
    return index


def test_batches_find_what_one_table_does(spark, tmp_path):
    rows = corpus()
    want = brute(rows)
    assert sum(r[1] > 0 for r in want.values()) > 30
    index = indexed(spark, tmp_path / "three", rows, [25, 33])
    assert shown(index.repeats()) == want
    assert list(index.sizes) == [1, 2] or len(index.sizes) < 3  # levels of like size have merged
    assert shown(indexed(spark, tmp_path / "one", rows, []).repeats()) == want
    whole = long_repeats(spark.createDataFrame(rows, "id bigint, text string"), id_column="id", length=LENGTH)
    assert shown(whole) == want


def test_levels_are_what_later_batches_meet(spark, tmp_path):
    rows = corpus()
    assert shown(indexed(spark, tmp_path / "lost", rows, [25, 33], forget=True).repeats()) != brute(rows)
