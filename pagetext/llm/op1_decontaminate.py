"""Benchmark decontamination: a BM25 inverted index of the test items, searched by block-max WAND
with every training passage as the query; what scores above the threshold is verified by the
overlap of the item's question and answer with the passage."""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagetext.llm._arrays import slices
from pagetext.llm._store import dropped, stored

K1, B = 1.2, 0.75
THRESHOLD = 0.5
OVERLAP = 0.6
BLOCK = 64
LEAST_STRIDE = 64
MOST_WORDS = 2_000_000  # of the items of one index
SHARDS_AT_ONCE = 16  # indexes that one scan of the documents searches
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def words_of(text: str) -> list[bytes]:
    """Runs of ASCII letters, digits and non-ASCII characters, A-Z lower-cased."""
    return WORD.findall(text.encode("utf-8", "surrogatepass").lower())


def question_and_answer(text: str) -> tuple[list[bytes], list[bytes]]:
    """An item's last sentence is its answer; with one sentence, the last quarter of its words."""
    parts = [w for s in re.split(r"[.!?\n]+", text) if (w := words_of(s))]
    if len(parts) > 1:
        return [w for p in parts[:-1] for w in p], parts[-1]
    words = parts[0] if parts else []
    cut = max(1, len(words) - max(1, len(words) // 4)) if len(words) > 1 else len(words)
    return words[:cut], words[cut:]


def _grams(words: list[bytes], n: int) -> set[tuple[bytes, ...]]:
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}


def overlap(part: list[bytes], passage: list[bytes]) -> float:
    """Share of the part's 3-word runs (shorter parts: the whole) that the passage has; 1 if empty."""
    if not part:
        return 1.0
    n = min(3, len(part))
    own = _grams(part, n)
    return len(own & _grams(passage, n)) / len(own)


@dataclass
class Statistics:
    """Of all items with words: how many, their mean and greatest length, and in how many each term is."""

    items: int
    mean: float
    longest: int
    df: dict[bytes, int]

    @staticmethod
    def of(docs: list[list[bytes]]) -> Statistics:
        n = [len(d) for d in docs]
        return Statistics(len(docs), sum(n) / max(1, len(n)), max(n, default=0), Counter(w for d in docs for w in set(d)))


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (shard, text): each shard's terms, with the number of its items that have them; and, without
    a term, its items, their words and the longest."""
    for batch in batches:
        df: dict[int, Counter] = defaultdict(Counter)
        n: dict[int, list[int]] = defaultdict(list)
        for shard, text in zip(batch.column("shard").to_pylist(), batch.column("text").to_pylist(), strict=True):
            if words := words_of(text):
                df[shard].update(set(words))
                n[shard].append(len(words))
        rows = [(shard, w, c, None, None) for shard, own in df.items() for w, c in own.items()] + [(shard, None, len(own), sum(own), max(own)) for shard, own in n.items()]
        yield pa.RecordBatch.from_pylist([dict(zip(("shard", "term", "n", "words", "longest"), r, strict=True)) for r in rows], pa.schema([("shard", pa.int32()), ("term", pa.binary()), ("n", pa.int64()), ("words", pa.int64()), ("longest", pa.int64())]))


class Index:
    """Postings by term in item order, in blocks with their greatest impact. An impact is the
    term's BM25 weight in the item over the item's whole weight, so a score is the weighted share of the
    item's terms that the query has. Weights depend on statistics of the whole benchmark, so an
    item scores the same in whatever shard it is."""

    def __init__(self, items: list[tuple[int, str]], statistics: Statistics | None = None):
        self.items = [(i, *question_and_answer(t)) for i, t in items]
        docs = [q + a for _, q, a in self.items]
        known = statistics or Statistics.of(docs)
        self.longest = known.longest
        counts = [Counter(d) for d in docs]
        self.terms = {w: n for n, w in enumerate(dict.fromkeys(w for tf in counts for w in tf))}
        idf = {w: math.log(1 + (known.items - known.df[w] + 0.5) / (known.df[w] + 0.5)) for w in self.terms}
        lists: list[list[tuple[int, float]]] = [[] for _ in self.terms]
        for at, tf in enumerate(counts):
            own = {w: idf[w] * n * (K1 + 1) / (n + K1 * (1 - B + B * len(docs[at]) / known.mean)) for w, n in tf.items()}
            whole = math.fsum(own.values())
            for w, x in own.items():
                lists[self.terms[w]].append((at, x / whole))
        self.at = [np.array([a for a, _ in p]) for p in lists]
        self.impact = [np.array([x for _, x in p]) for p in lists]
        self.block_max = [np.maximum.reduceat(x, np.arange(0, len(x), BLOCK)) for x in self.impact]
        self.most = np.array([x.max() for x in self.impact] or [0.0])
        self.essential: Essential | None = None

    def search(self, query: list[int], threshold: float) -> list[tuple[int, float]]:
        """All items that score at least the threshold, by block-max WAND."""
        found, end = [], len(self.items)
        cursors = [[int(self.at[t][0]), 0, t] for t in query]  # item, place in the list, term
        slip = threshold - 1e-9
        while True:
            cursors.sort()
            bound, pivot = 0.0, -1
            for n, (at, _, t) in enumerate(cursors):
                if at >= end:
                    break
                bound += self.most[t]
                if bound >= slip:
                    pivot = n
                    break
            if pivot < 0:
                return found
            item = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == item:
                pivot += 1
            bound, jump = 0.0, end
            for at, place, t in cursors[: pivot + 1]:
                block = (place + int(np.searchsorted(self.at[t][place:], item)) if at < item else place) // BLOCK
                if block < len(self.block_max[t]):
                    bound += self.block_max[t][block]
                    last = min((block + 1) * BLOCK, len(self.at[t])) - 1
                    jump = min(jump, int(self.at[t][last]) + 1)
            if bound >= slip:
                if cursors[0][0] == item:
                    score = math.fsum(self.impact[t][place] for at, place, t in cursors[: pivot + 1])  # whatever the order of terms
                    if score >= slip:
                        found.append((item, float(score)))
                    target = item + 1
                else:
                    target = item
            else:
                target = max(item + 1, min(jump, cursors[pivot + 1][0] if pivot + 1 < len(cursors) else end))
            for c in cursors[: pivot + 1]:
                if c[0] < target:
                    c[1] += int(np.searchsorted(self.at[c[2]][c[1] :], target))
                    c[0] = int(self.at[c[2]][c[1]]) if c[1] < len(self.at[c[2]]) else end


class Essential:
    """Postings that a passage needs some of: each item's terms but for its most frequent ones, whose
    impacts together stay below a share of the threshold. A passage that scores the threshold on an
    item gets the rest of it from the item's essential terms, whichever terms were taken as frequent."""

    def __init__(self, index: Index, seen: np.ndarray, threshold: float, share: float = 0.6):
        term = np.repeat(np.arange(len(index.at)), [len(a) for a in index.at])
        item = np.concatenate(index.at) if len(term) else np.zeros(0, int)
        impact = np.concatenate(index.impact) if len(term) else np.zeros(0)
        order = np.lexsort((-seen[term], item))
        term, item, impact = term[order], item[order], impact[order]
        first = np.searchsorted(item, item)
        run = np.concatenate([[0.0], np.cumsum(impact)])
        frequent = run[1:] - run[first] < share * threshold
        self.low = np.bincount(item[frequent], impact[frequent], len(index.items))
        order = np.argsort(term[~frequent], kind="stable")
        self.item, self.impact = item[~frequent][order], impact[~frequent][order]
        self.n = np.bincount(term[~frequent], minlength=len(index.at))
        self.start = np.cumsum(self.n) - self.n


def _passages(index: Index, texts: list[bytes], threshold: float) -> Iterator[tuple[int, int, list[bytes], list[int]]]:
    """(text, first word, words, distinct terms) of the passages that can score the threshold on some
    item, by their essential terms. Passages are two strides long and overlap by one; an item is
    at most a stride long."""
    if not index.items:
        return
    stride = max(LEAST_STRIDE, index.longest)
    words = [WORD.findall(t.lower()) for t in texts]
    known = index.terms.get
    flat = np.fromiter((known(w, -1) for own in words for w in own), np.int64)
    n = np.array([len(w) for w in words])
    if index.essential is None:
        index.essential = Essential(index, np.bincount(flat[flat >= 0], minlength=len(index.terms)), threshold)
    some = index.essential
    keep = np.flatnonzero((flat >= 0) & (some.n[flat] > 0))
    text = np.searchsorted(np.cumsum(n), keep, "right")
    place, flat = keep - (np.cumsum(n) - n)[text], flat[keep]
    blocks = -(-n // stride)
    first_block = np.cumsum(blocks) - blocks
    order = np.lexsort((place, flat, text))
    same = (text[order][1:] == text[order][:-1]) & (flat[order][1:] == flat[order][:-1])
    before = np.full(len(flat), -1)
    before[order[1:][same]] = place[order[:-1][same]]
    keys, gains = [], []
    for shift in (0, 1):  # a passage has its own stride and the next
        start = place // stride - shift
        new = np.flatnonzero((start >= 0) & (before < start * stride))
        many = some.n[flat[new]]
        at = np.repeat(some.start[flat[new]] - (np.cumsum(many) - many), many) + np.arange(many.sum())
        keys.append(np.repeat(first_block[text[new]] + start[new], many) * len(index.items) + some.item[at])
        gains.append(some.impact[at])
    key, back = np.unique(np.concatenate(keys), return_inverse=True)
    bound = np.bincount(back, np.concatenate(gains), len(key)) + some.low[key % max(1, len(index.items))]
    for p in np.unique(key[bound >= threshold - 1e-9] // max(1, len(index.items))):
        t = int(np.searchsorted(first_block, p, "right")) - 1
        low = int(p - first_block[t]) * stride
        own = words[t][low : low + 2 * stride]
        yield t, low, own, sorted({k for w in own if (k := known(w)) is not None})


_indexes: dict[str, Index] = {}


def _index(shared, alone: bool) -> Index:
    """The worker's index of a shard; it keeps one, or all of a scan that has few words."""
    name, items, statistics = shared.value
    if name not in _indexes:
        if alone:
            _indexes.clear()
        _indexes[name] = Index(items, statistics)
    return _indexes[name]


def _searched(shards: list, run: str, alone: bool, threshold: float, least: float):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name in [n for n in _indexes if not n.startswith(run)]:
            del _indexes[name]
        for batch in batches:
            for shared in shards:
                index = _index(shared, alone)
                for first, last in slices(batch.column("text")):
                    yield found(index, batch.slice(first, last - first))

    def found(index: Index, part: pa.RecordBatch) -> pa.RecordBatch:
        best: dict[tuple[int, int], tuple] = {}
        for t, low, words, terms in _passages(index, part.column("text").cast(pa.binary()).to_pylist(), threshold):
            for item, score in index.search(terms, threshold):
                number, question, answer = index.items[item]
                q, a = overlap(question, words), overlap(answer, words)
                if q >= least and a >= least and (score, -low) > best.get((t, item), (0.0, 0))[:2]:
                    best[t, item] = (score, -low, number, q, a)
        at = sorted(best)
        rows = [best[k] for k in at]
        columns = [part.column("id").take(pa.array([t for t, _ in at], pa.int64())), pa.array([r[2] for r in rows], pa.int64()), pa.array([-r[1] for r in rows], pa.int64()), *(pa.array([float(r[i]) for r in rows], pa.float64()) for i in (0, 3, 4))]
        return pa.RecordBatch.from_arrays(columns, ["id", "item", "passage", "score", "question_overlap", "answer_overlap"])

    return search


def leaks(docs: DataFrame, items: DataFrame, *, threshold: float = THRESHOLD, least_overlap: float = OVERLAP, most_words: int = MOST_WORDS, at_once: int = SHARDS_AT_ONCE, id_column: str = "doc_id") -> DataFrame:
    """(doc_id, item_id, passage, score, question_overlap, answer_overlap): for each row of
    docs(doc_id, text) and row of items(item_id, text) its best passage (first word, ties the
    earliest) that scores at least `threshold` and has at least `least_overlap` of both the
    item's question and its answer.

    An index has at most about most_words words of items: a larger benchmark is dealt into shards by a
    hash of its rows, and every passage is searched in each, at_once of them in one scan of the
    documents. Document frequencies, the mean length and the length of passages are those of the
    whole benchmark, so rows and scores are the same however many shards there are. Documents never
    move. Null, empty and wordless texts and items are found nowhere; repeated rows each count; an
    id may be null."""
    spark = docs.sparkSession
    known = items.select("item_id", "text").where("text IS NOT NULL")
    size = known.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-size // (6 * most_words)))
    known = known.withColumn("shard", F.pmod(F.xxhash64("item_id", "text"), F.lit(shards)).cast("int"))
    terms = stored(known.select("shard", "text").mapInArrow(_terms, "shard int, term binary, n bigint, words bigint, longest bigint"))
    whole = terms.where("term IS NULL").agg(F.sum("n").alias("n"), F.sum("words").alias("words"), F.max("longest").alias("longest")).first()
    df = stored(terms.where("term IS NOT NULL").groupBy("term").agg(F.sum("n").alias("n")))
    kind = docs.schema[id_column].dataType.simpleString()
    rows = docs.select(F.col(id_column).alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    found = None
    for first in range(0, shards, at_once):
        run, held = uuid.uuid4().hex, []
        for shard in range(first, min(first + at_once, shards)):
            own = [(r.item_id, r.text) for r in known.where(F.col("shard") == shard).orderBy("item_id", "text").collect() if words_of(r.text)]
            met = terms.where((F.col("shard") == shard) & F.col("term").isNotNull()).select("term").distinct()
            counts = {bytes(r.term): r.n for r in df.join(met, "term", "left_semi").collect()}
            statistics = Statistics(whole.n or 0, (whole.words or 0) / max(1, whole.n or 0), whole.longest or 0, counts)
            held.append(spark.sparkContext.broadcast((f"{run}-{shard}", own, statistics)))
        part = rows.mapInArrow(_searched(held, run, size > 12 * most_words, threshold, least_overlap), f"id {kind}, item bigint, passage bigint, score double, question_overlap double, answer_overlap double")
        if shards > at_once:  # a scan's finds are written, and its items released, before the next
            part = stored(part)
            for shared in held:
                shared.unpersist()
        found = part if found is None else found.union(part)
    dropped(terms, df)
    return found.withColumnRenamed("id", id_column).withColumnRenamed("item", "item_id")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
