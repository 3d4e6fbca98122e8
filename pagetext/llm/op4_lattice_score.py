"""LM scoring: the marginal probability of a document over all segmentations into the pieces of an
existing vocabulary, by a forward recursion over each word's lattice."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagetext.llm._arrays import slices
from pagetext.llm._store import numbered, stored

WORDS_IN_TASK = 200_000  # distinct ones that a task looks counts up in
MOST_SHARED = 200_000
MOST_CACHED = 1 << 19
LINEAR_BYTES = 32  # longer words are summed in logarithms
LEAST_LINEAR = 1e-290  # and so are words of less probability
UNKNOWN = 10.0  # below the least score: the score of bytes that have none
RANKED = 10.0  # a piece of rank r weighs 1 / (r + RANKED)
PRIOR = 0.01  # words' worth of the vocabulary's own weights, for each piece, that expected counts are added to
BATCH = 1 << 16


def _read(vocabulary: str) -> tuple[dict[tuple[bool, bytes], float], bool]:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=vocabulary)
    scores: dict[tuple[bool, bytes], float] = {}
    seen = []
    for i in range(model.get_piece_size()):
        if model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
            continue
        piece, score = model.id_to_piece(i), model.get_score(i)
        seen.append(score)
        first = piece.startswith("▁")
        own = piece[first:].encode()
        if (own or first) and "▁" not in piece[first:] and own == own.lower():
            scores[first, own] = score
    probable = any(x != int(x) for x in seen)
    weigh = math.exp if probable else lambda x: 1 / (RANKED - x)
    fair = [x for x in seen if x < 0]  # pieces set by the user have no score of their own
    top, least = max(fair), min(fair) - UNKNOWN
    found = dict.fromkeys([(True, b""), *((False, bytes([b])) for b in range(256))], weigh(least))
    return found | {key: weigh(x if x < 0 else top) for key, x in scores.items()}, probable


def read_pieces(vocabulary: str) -> dict[tuple[bool, bytes], float]:
    """(starts a word, bytes) -> weight of the pieces of a sentencepiece model; single bytes are
    among them, so that every text has a segmentation. A unigram model's scores are logarithms of
    probabilities, which are the weights. A BPE model's are the ranks of its merges, whole numbers:
    a piece's weight falls with its rank as word frequencies do (Zipf's law). Pieces with A-Z never
    fit lower-cased text and are left out."""
    return _read(vocabulary)[0]


class Lattice:
    """log10 probability of a word, its segmentations summed. A word is a piece that starts one
    and any number that don't; their probabilities sum to 1, so those of all words do."""

    def __init__(self, pieces: dict[tuple[bool, bytes], float]):
        total = sum(pieces.values())
        self.first = {b: p / total for (s, b), p in pieces.items() if s}
        self.inner = {b: p / total for (s, b), p in pieces.items() if not s}
        self.longest = max(len(b) for _, b in pieces)
        self.cache: dict[bytes, float] = {}

    def expected(self, word: bytes, into: dict[tuple[bool, bytes], float]) -> None:
        """Add how often each piece is expected in the word, all its segmentations weighed: a forward and
        a backward recursion, in logarithms where the word is improbable."""
        n, longest = len(word), self.longest
        arcs = [(0, j, True, p) for j in range(min(n, longest) + 1) if (p := self.first.get(word[:j]))]
        inner = [(i, j, False, p) for i in range(n) for j in range(i + 1, min(n, i + longest) + 1) if (p := self.inner.get(word[i:j]))]
        ahead = [0.0] * (n + 1)
        for _, j, _, p in arcs:
            ahead[j] += p
        for i, j, _, p in inner:
            ahead[j] += ahead[i] * p
        if ahead[n] > LEAST_LINEAR:
            back = [0.0] * n + [1 / ahead[n]]
            for i, j, _, p in reversed(inner):
                back[i] += p * back[j]
            for _, j, _, p in arcs:
                if x := p * back[j]:
                    into[True, word[:j]] = into.get((True, word[:j]), 0.0) + x
            for i, j, _, p in inner:
                if x := ahead[i] * p * back[j]:
                    into[False, word[i:j]] = into.get((False, word[i:j]), 0.0) + x
            return
        ahead, back = [-math.inf] * (n + 1), [-math.inf] * n + [0.0]
        for _, j, _, p in arcs:
            ahead[j] = _log_sum(ahead[j], math.log(p))
        for i, j, _, p in inner:
            ahead[j] = _log_sum(ahead[j], ahead[i] + math.log(p))
        for i, j, _, p in reversed(inner):
            back[i] = _log_sum(back[i], math.log(p) + back[j])
        for i, j, first, p in arcs + inner:
            if (x := (0.0 if first else ahead[i]) + math.log(p) + back[j] - ahead[n]) > -700:
                into[first, word[i:j]] = into.get((first, word[i:j]), 0.0) + math.exp(x)

    def score(self, word: bytes) -> float:
        if (known := self.cache.get(word)) is not None:
            return known
        n, longest, inner = len(word), self.longest, self.inner.get
        if n > LINEAR_BYTES:
            return self._long(word)
        reach = [0.0] * (n + 1)
        for j in range(min(n, longest) + 1):
            reach[j] = self.first.get(word[:j], 0.0)
        for i in range(n):
            if x := reach[i]:
                for j in range(i + 1, min(n, i + longest) + 1):
                    if p := inner(word[i:j]):
                        reach[j] += x * p
        if reach[n] < LEAST_LINEAR:
            return self._long(word)
        if len(self.cache) >= MOST_CACHED:
            self.cache.clear()
        found = self.cache[word] = math.log10(reach[n])
        return found

    def _long(self, word: bytes) -> float:
        n, window = len(word), self.longest
        logs = [-math.inf] * (n + 1)
        for j in range(min(n, window) + 1):
            if p := self.first.get(word[:j]):
                logs[j] = math.log(p)
        for j in range(1, n + 1):
            parts = [logs[j]] + [logs[i] + math.log(p) for i in range(max(0, j - window), j) if logs[i] > -math.inf and (p := self.inner.get(word[i:j]))]
            top = max(parts)
            if top > -math.inf:
                logs[j] = top + math.log(sum(math.exp(x - top) for x in parts))
        return logs[n] / math.log(10)


def _log_sum(a: float, b: float) -> float:
    top, low = max(a, b), min(a, b)
    return top if low == -math.inf else top + math.log1p(math.exp(low - top))


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    for batch in batches:
        for first, last in slices(batch.column("text")):
            part = batch.slice(first, last - first)
            yield part, [t or b"" for t in part.column("text").cast(pa.binary()).to_pylist()]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, texts in _texts(batches):
        seen: Counter[bytes] = Counter()
        for text in texts:
            seen.update(text.lower().split())
        yield pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.binary()).cast(pa.string()), pa.array(seen.values(), pa.int64())], ["word", "n"])


def _pieces_of(pieces):
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice, seen = Lattice(pieces.value), {}
        for batch in batches:
            for word in batch.column(0).cast(pa.binary()).to_pylist():
                lattice.expected(word, seen)
        yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in seen], pa.bool_()), pa.array([b for _, b in seen], pa.binary()), pa.array(seen.values(), pa.float64())], ["first", "piece", "n"])

    return counted


def _weighed(pieces):
    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(pieces.value)
        for batch in batches:
            words = batch.column("word").cast(pa.binary()).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("c"), pa.array([lattice.score(w) for w in words], pa.float64())], ["word", "c", "spelt"])

    return scored


def _split(frequent, end_base: float, end_score: float, end_known: int):
    """For each row its tokens and the sums over frequent words, on the first of its rows of rarer words."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared = frequent.value
        for part, texts in _texts(batches):
            row, word, n, tokens, known, base, score = [], [], [], [], [], [], []
            for r, text in zip(part.column("row").to_pylist(), texts, strict=True):
                words = text.lower().split()
                k, b, s, at = end_known, end_base, end_score, len(row)
                for w, times in Counter(words).items():
                    if (own := shared.get(w)) is not None:
                        k += times
                        b += times * own[0]
                        s += times * own[1]
                    else:
                        word.append(w)
                        n.append(times)
                if len(word) == at:
                    word.append(b" %d" % r)  # no word has a blank: met by none, and no key for many rows
                    n.append(0)
                more = len(word) - at - 1
                row += [r] * (more + 1)
                tokens += [len(words) + 1] + [0] * more
                known += [k] + [0] * more
                base += [b] + [0.0] * more
                score += [s] + [0.0] * more
            for i in range(0, len(row), BATCH):
                j = i + BATCH
                yield pa.RecordBatch.from_arrays([pa.array(row[i:j], pa.int64()), pa.array(word[i:j], pa.binary()).cast(pa.string()), pa.array(n[i:j], pa.int32()), pa.array(tokens[i:j], pa.int64()), pa.array(known[i:j], pa.int64()), pa.array(base[i:j], pa.float64()), pa.array(score[i:j], pa.float64())], ["row", "word", "n", "tokens", "known", "base", "score"])

    return rows


def _summed(pieces, total: int, discount: float, spread: float):
    """Each word's part of its row's sums; words that training doesn't have are spelt by the lattice."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(pieces.value)
        for batch in batches:
            if not batch.num_rows:
                continue
            n = batch.column("n").to_numpy().astype(float)
            c = np.nan_to_num(batch.column("c").to_numpy(zero_copy_only=False).astype(float))
            spelt = batch.column("spelt").to_numpy(zero_copy_only=False).astype(float).copy()
            fresh = np.flatnonzero((c == 0) & (n > 0))
            words = batch.column("word").take(pa.array(fresh)).cast(pa.binary()).to_pylist()
            spelt[fresh] = [lattice.score(w) for w in words]
            spelt = np.nan_to_num(spelt)
            if total:
                with np.errstate(divide="ignore"):
                    kept = np.log10(np.maximum(c - discount, 0) / total)
                own = np.logaddexp2(kept / math.log10(2), (math.log10(spread) + spelt) / math.log10(2)) * math.log10(2)
            else:
                own = spelt
            columns = [batch.column("tokens"), pa.array(batch.column("known").to_numpy() + (n * (c > 0)).astype(np.int64)), pa.array(batch.column("base").to_numpy() + n * np.log10(c + 0.5)), pa.array(batch.column("score").to_numpy() + n * own)]
            yield pa.RecordBatch.from_arrays([batch.column("row"), *columns], ["row", "tokens", "known", "base", "score"])

    return sums


def lattice_scores(docs: DataFrame, vocabulary: str, *, folds: int = 5, held_fold: int = 1, most_shared: int = MOST_SHARED) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row of
    docs(doc_id, text).

    Words are split at white space, A-Z lower-cased, and each text has an end; rows with
    crc32(doc_id) mod folds = held_fold are not learnt from (a null id is learnt from). A token's
    probability is its discounted training share plus the mass so freed times the probability of
    its spelling: the sum over all segmentations into vocabulary pieces, weighed by the
    vocabulary's own scores. Where these are probabilities (unigram) they stand as they are; ranks
    (BPE) give weights that one round of expected counts over all segmentations of every distinct
    training word refines, added to the vocabulary's own as a prior. The end has no
    spelling. Null and empty texts are the end alone; repeated rows and ids each count.

    Words with more than 1 / most_shared of all tokens, at most most_shared of them whatever the
    corpus, are broadcast; every other word meets its count in a shuffled join in which a
    word has at most that share of the rows. Piece counts come to the driver, one number for each vocabulary piece."""
    spark = docs.sparkSession
    context = spark.sparkContext
    fold = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds, F.lit(-1))
    read = numbered(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), (fold == held_fold).alias("held_out")))
    learnt = read.where("NOT held_out")
    counts = stored(learnt.select("text").mapInArrow(_counted, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("c")))
    ends = learnt.count()
    seen = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v"), F.count_if(F.col("c") == 1).alias("once"), F.count_if(F.col("c") == 2).alias("two")).first()
    total, types = seen.n + ends, seen.v + (ends > 0)
    discount = seen.once / (seen.once + 2 * seen.two) if seen.once and seen.two else 0.5
    spread = max(discount * types / total, 1e-12) if total else 1.0
    pieces, probable = _read(vocabulary)
    if not probable:
        prior = context.broadcast(pieces)
        mass = PRIOR * len(pieces) / sum(pieces.values())
        pieces = {key: p * mass for key, p in pieces.items()}
        for first, piece, n in counts.select("word").mapInArrow(_pieces_of(prior), "first boolean, piece binary, n double").groupBy("first", "piece").agg(F.sum("n")).collect():
            pieces[first, bytes(piece)] += n
    model = context.broadcast(pieces)
    spelt = stored(counts.mapInArrow(_weighed(model), "word string, c bigint, spelt double"))
    token = lambda c, s: math.log10(max(c - discount, 0) / total + spread * 10**s)
    frequent = {r.word.encode(): (math.log10(r.c + 0.5), token(r.c, r.spelt)) for r in spelt.where(F.col("c") * most_shared > total).collect()}
    end_score = math.log10((ends - discount) / total) if ends > 1 else -math.log10(max(total, 1) + 1)
    rare = read.select("row", "text").mapInArrow(_split(context.broadcast(frequent), math.log10(ends + 0.5), end_score, int(ends > 0)), "row bigint, word string, n int, tokens bigint, known bigint, base double, score double")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-seen.v // WORDS_IN_TASK))
    table = spelt.where(F.col("c") * most_shared <= total).repartition(parts, "word")
    joined = rare.repartition(parts, "word").join(table.hint("shuffle_hash"), "word", "left")  # a task's words fit its memory
    sums = joined.mapInArrow(_summed(model, total, discount, spread), "row bigint, tokens bigint, known bigint, base double, score double").groupBy("row").agg(*[F.sum(c).alias(c) for c in ("tokens", "known", "base", "score")])
    scale = math.log10(total + 0.5 * (types + 1))
    return read.select("row", "doc_id", "held_out").join(sums, "row").select("doc_id", "held_out", F.col("tokens").alias("n_tokens"), F.col("known").alias("n_known"), F.lit(total).cast("bigint").alias("train_tokens"), (F.col("base") - F.col("tokens") * scale).alias("base_score"), "score")


def op4_lattice_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return lattice_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("piece_bpe_32k.model"))
