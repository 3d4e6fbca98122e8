"""Toxicity: a weighted finite-state pattern grammar. Transducers for insults, threats, targets,
negation and reported speech are composed into one, which reads the word classes of a clause; what
is scored are the clauses that it matches, by weights learnt from labelled rows."""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagetext.llm._arrays import slices
from pagetext.llm._store import stored

FOLDS, HELD_OUT = 4, 2
THRESHOLD = 0.3
MOST_LABELLED = 8_000  # rows of each label that are learnt from, at most
MOST_CANDIDATES = 20_000  # forms that may become entries of the lexicon
LEAST_DOCS, LEAST_VOTES = 4, 2  # toxic texts that an entry occurs in; of which it is the best sign
LEAST_WEIGHT = 2.0
STEM, LONGEST_STEM = 3, 10  # characters of the beginnings of words that may be entries
NEAR, SCOPE = 4, 3  # words between an insult and its target; words that a negation reaches
SEED_WEIGHT = 2.0
PIECE = 1 << 20
SLICE_BYTES = 1 << 20

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, QUOTE = range(7)
NEGATED, REPORTED, DIRECTED, HIT = 1, 2, 4, 8

#: Closed classes of the four languages, and a few open ones to start from.
WORDS = {
    TARGET: "you your yours yourself u he him she her they them du dich dir dein deine ihr euch sie tu toi te vous votre il elle ils tú tu usted ustedes él ella ellos vosotros",
    NEGATION: "not no never neither nor isn't aren't wasn't don't doesn't nicht kein keine keiner niemals nie pas jamais aucun ni nunca jamás ningún ninguna tampoco",
    REPORT: "said says say saying called calls claimed claims wrote writes quoted quote reported sagte sagt sagen nannte nennt schrieb zitierte dit disait appelé appelle écrit cité dijo dice decía llamó llama escribió citó",
    THREAT: "kill killing hurt murder stab strangle töten umbringen ermorden verprügeln tuerai tuer assassiner frapperai matar mataré asesinar golpearé",
    INSULT: "idiot moron imbecile fool dumbass trottel dummkopf vollidiot abruti crétin connard imbécile estúpido idiota gilipollas",
}
TOKEN = re.compile(r"[^\W_]+(?:'[^\W_]+)?|[\"“”„«»]")
CLAUSE_END = re.compile(r"[.!?;:\n]+")

State, Symbol = tuple, tuple[int, int]  # a symbol: word class, marks
Transducer = tuple[State, Callable[[State, Symbol], tuple[State, Symbol]]]


def _insults() -> Transducer:
    """Marks an insult as a hit."""
    return (), lambda state, x: (state, (x[0], x[1] | HIT) if x[0] == INSULT else x)


def _threats() -> Transducer:
    """Marks a threatening verb as a hit."""
    return (), lambda state, x: (state, (x[0], x[1] | HIT) if x[0] == THREAT else x)


def _negation() -> Transducer:
    """Marks what stands up to SCOPE words behind a negation."""

    def step(state, x):
        if x[0] == NEGATION:
            return (SCOPE,), x
        return (max(state[0] - 1, 0),), (x[0], x[1] | NEGATED * (state[0] > 0))

    return (0,), step


def _reports() -> Transducer:
    """Marks what follows a verb of saying, and what stands in quotation marks."""

    def step(state, x):
        said, quoted = state
        if x[0] == QUOTE:
            return (said, not quoted), x
        return (said or x[0] == REPORT, quoted), (x[0], x[1] | REPORTED * (said or quoted))

    return (False, False), step


def _targets() -> Transducer:
    """Marks a hit up to NEAR words behind a target, and a target as near behind a hit."""

    def step(state, x):
        target, hit = state
        after = (NEAR if x[0] == TARGET else max(target - 1, 0), NEAR if x[1] & HIT else max(hit - 1, 0))
        met = (x[1] & HIT and target > 0) or (x[0] == TARGET and hit > 0)
        return after, (x[0], x[1] | DIRECTED * bool(met))

    return (0, 0), step


def composed(parts: list[Transducer], classes: int = QUOTE + 1) -> tuple[list[list[int]], list[list[int]]]:
    """The transducers as one: each reads what the one before writes. For each reachable state and
    word class, the next state and the marks written; state 0 is where a clause begins."""
    states, following, marks = {tuple(start for start, _ in parts): 0}, [], []
    for state in (order := list(states)):
        row, out = [], []
        for kind in range(classes):
            symbol, after = (kind, 0), []
            for own, (_, step) in zip(state, parts, strict=True):
                own, symbol = step(own, symbol)
                after.append(own)
            if tuple(after) not in states:
                states[tuple(after)] = len(states)
                order.append(tuple(after))
            row.append(states[tuple(after)])
            out.append(symbol[1])
        following.append(row)
        marks.append(out)
    return following, marks


GRAMMAR = composed([_insults(), _threats(), _negation(), _reports(), _targets()])
KINDS = 8  # of clauses, by their marks


class Lexicon:
    """Word classes and weights: whole words, beginnings of words ("stem*"), and beginnings that
    count where two words or more of the text have them ("stem**")."""

    def __init__(self, weights: dict[str, float]):
        self.words = {e: w for e, w in weights.items() if not e.endswith("*")}
        self.stems = {e[:-1]: w for e, w in weights.items() if e.endswith("*") and not e.endswith("**")}
        self.pairs = {e[:-2]: w for e, w in weights.items() if e.endswith("**")}
        self.heads = {e[:STEM] for e in (*self.stems, *self.pairs, *self.words)}
        self.longest = max(map(len, (*self.stems, *self.pairs)), default=0)
        self.closed = {w: kind for kind in (TARGET, NEGATION, REPORT) for w in WORDS[kind].split()}
        self.threats = set(WORDS[THREAT].split())

    def hits(self, words: set[str]) -> dict[str, float]:
        """The words that are entries, each with its weight: the heaviest of those that fit."""
        found, sharing = {}, defaultdict(list)
        for w in words:
            if w[:STEM] in self.heads:
                weight = self.words.get(w, 0.0)
                for n in range(STEM, min(len(w), self.longest) + 1):
                    weight = max(weight, self.stems.get(w[:n], 0.0))
                    if w[:n] in self.pairs:
                        sharing[w[:n]].append(w)
                if weight > 0:
                    found[w] = weight
        for stem, own in sharing.items():
            if len(own) > 1:
                found |= {w: max(found.get(w, 0.0), self.pairs[stem]) for w in own}
        return found

    def classes(self, tokens: list[str], hits: dict[str, float]) -> list[int]:
        return [(THREAT if t in self.threats else INSULT) if t in hits else self.closed.get(t, QUOTE if t in "\"“”„«»" else OTHER) for t in tokens]


def _pieces(text: str) -> Iterator[str]:
    """The text in parts of about PIECE characters that end where clauses end."""
    first = 0
    while first < len(text):
        end = CLAUSE_END.search(text, first + PIECE) if len(text) - first > PIECE else None
        last = end.end() if end else len(text)
        yield text[first:last]
        first = last


def matched(text: str | None, lexicon: Lexicon) -> tuple[np.ndarray, int]:
    """The weights of the text's matched clauses, summed by kind of clause, and its number of words.

    A clause counts once, with its heaviest hit; it counts as negated or reported only if all of its
    hits are, as directed if one of them is."""
    following, marks = GRAMMAR
    sums, n = np.zeros(KINDS), 0
    for piece in _pieces((text or "").lower()):
        words = TOKEN.findall(piece)
        n += len(words)
        hits = lexicon.hits(set(words))
        if not hits:
            continue
        for clause in CLAUSE_END.split(piece):
            tokens = TOKEN.findall(clause)
            if not any(t in hits for t in tokens):
                continue
            state, all_, any_, weight = 0, NEGATED | REPORTED, 0, 0.0
            for t, kind in zip(tokens, lexicon.classes(tokens, hits), strict=True):
                out, state = marks[state][kind], following[state][kind]
                any_ |= out & DIRECTED
                if out & HIT:
                    all_ &= out
                    weight = max(weight, hits[t])
            sums[all_ | any_] += weight
    return sums, n


# Learning


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The least hash of each text's three-word runs: near copies mostly share it."""
    for batch in batches:
        found = []
        for text in batch.column("text"):
            words = TOKEN.findall((text.as_py() or "").lower())
            found.append(min((xxhash.xxh64_intdigest(" ".join(words[i : i + 3])) for i in range(max(1, len(words) - 2))), default=0) >> 1)
        yield batch.append_column("sketch", pa.array(found, pa.int64()))


def _forms(text: str | None) -> set[str]:
    """Words of the text, their beginnings, and the beginnings that two words or more share."""
    words = set(TOKEN.findall((text or "").lower()))
    stems = Counter(w[:n] for w in words for n in range(STEM, min(len(w), LONGEST_STEM) + 1))
    return words | {stem + "*" for stem in stems} | {stem + "**" for stem, n in stems.items() if n > 1}


def _form_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def flushed() -> pa.RecordBatch:
        forms = sorted({*counts[0], *counts[1]})
        return pa.RecordBatch.from_arrays([pa.array(forms, pa.string()), pa.array([counts[0][f] for f in forms], pa.int64()), pa.array([counts[1][f] for f in forms], pa.int64())], ["form", "clean", "toxic"])

    counts = (Counter(), Counter())
    for batch in batches:
        for text, toxic in zip(batch.column("text"), batch.column("toxic"), strict=True):
            counts[toxic.as_py()].update(_forms(text.as_py()))
            if len(counts[0]) + len(counts[1]) > 500_000:
                yield flushed()
                counts = (Counter(), Counter())
    yield flushed()


def _votes(strength: dict[str, tuple]):
    def voted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The candidate that speaks strongest for each toxic text."""
        for batch in batches:
            best = [max((f for f in _forms(t.as_py()) if f in strength), key=strength.__getitem__, default=None) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([pa.array(best, pa.string())], ["form"])

    return voted


def _clauses(weights: dict[str, float], carry: list[str]):
    def matches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(weights)
        for batch in batches:
            for first, last in slices(batch.column("text"), SLICE_BYTES):
                part = batch.slice(first, last - first)
                found = [matched(t.as_py(), lexicon) for t in part.column("text")]
                sums = pa.FixedSizeListArray.from_arrays(pa.array(np.concatenate([s for s, _ in found])), KINDS).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in carry), sums, pa.array([n for _, n in found], pa.int64())], [*carry, "sums", "n_words"])

    return matches


def _inputs(sums: np.ndarray, n: np.ndarray) -> np.ndarray:
    """What the score is a logistic function of: 1, the clauses of each kind, and their density."""
    rate = sums.sum(-1) / np.maximum(n, 1)
    return np.column_stack([np.ones(len(sums)), np.log1p(sums), np.log1p(1000 * rate)])


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, start: np.ndarray, *, hold: float = 0.2) -> np.ndarray:
    """Coefficients of a logistic regression, held near `start`, by Newton steps."""
    b = start.copy()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        slope = x.T @ (weight * (p - y)) + hold * (b - start)
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + hold * np.eye(len(b))
        step = np.linalg.solve(curve, slope)
        b -= step * min(1.0, 2 / max(np.abs(step).max(), 1e-9))
        if np.abs(step).max() < 1e-6:
            break
    return b


START = np.array([-3.0, *[1.5 - 0.5 * bool(k & NEGATED) - 0.5 * bool(k & REPORTED) + 0.3 * bool(k & DIRECTED) for k in range(KINDS)], 0.2])


def training_rows(docs: DataFrame, labels: DataFrame, *, most: int = MOST_LABELLED) -> DataFrame:
    """(text, toxic) of rows to learn from: labelled ones outside the held-out fold, at most `most`
    ids of each label, picked by a hash of their ids; one row for each group of near copies."""
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(FOLDS)) != HELD_OUT)
    known = known.groupBy("doc_id").agg(F.max(F.when(F.col("toxic") > 0, 1).otherwise(0)).alias("toxic"))
    picked = [known.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most) for k in (0, 1)]
    rows = docs.select("doc_id", "text").join(F.broadcast(picked[0].union(picked[1])), "doc_id")
    sketched = stored(rows.mapInArrow(_sketched, "doc_id bigint, text string, toxic int, sketch bigint"))
    first = sketched.groupBy("sketch", "toxic").agg(F.min(F.struct("doc_id", F.xxhash64("text").alias("text"))).alias("first"))
    return stored(sketched.join(first, ["sketch", "toxic"]).where(F.struct("doc_id", F.xxhash64("text").alias("text")) == F.col("first")).select("text", "toxic").dropDuplicates(), instead=sketched)


def fit(rows: DataFrame, share: float, *, most_candidates: int = MOST_CANDIDATES) -> tuple[dict[str, float], np.ndarray]:
    """(weights of the lexicon's entries, coefficients of the score) from rows(text, toxic); share is
    the share of toxic rows among all labelled ones.

    Forms are whole words and beginnings of words, once or in two words of a text, so that inflected or
    compounded insults are known by their stem. Each form's weight is its log-odds between toxic and clean texts; of the
    heavy ones, those stay that are the strongest sign of some toxic texts. So a word that merely
    occurs beside insults is no entry. Seed words keep a weight of their own until the rows tell."""
    seeds = [*WORDS[INSULT].split(), *WORDS[THREAT].split()]
    seen = {r.toxic: r.n for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    clean, toxic = seen.get(0, 0), seen.get(1, 0)
    weights = dict.fromkeys(seeds, SEED_WEIGHT)
    if not clean or not toxic:
        return weights, START
    counts = rows.mapInArrow(_form_counts, "form string, clean bigint, toxic bigint").groupBy("form").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    weight = F.log((F.col("toxic") + 0.5) / (toxic + 1)) - F.log((F.col("clean") + 0.5) / (clean + 1))
    weighed = stored(counts.where((F.col("toxic") >= LEAST_DOCS) | F.col("form").isin(seeds)).withColumn("weight", weight))
    strong = weighed.where((F.col("toxic") >= LEAST_DOCS) & (F.col("weight") >= LEAST_WEIGHT)).withColumn("strength", F.col("weight") * F.sqrt("toxic"))
    best = strong.orderBy(F.col("strength").desc(), "form").limit(most_candidates).collect()
    strength = {r.form: (round(r.strength, 9), -r.form.count("*"), len(r.form), r.form) for r in best}
    votes = rows.where("toxic = 1").mapInArrow(_votes(strength), "form string").where("form IS NOT NULL").groupBy("form").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_VOTES).collect()
    known = {r.form: r.weight for r in best}
    weights |= {r.form: r.weight for r in weighed.where(F.col("form").isin(seeds) & (F.col("toxic") + F.col("clean") >= LEAST_DOCS)).collect()}
    weights |= {r.form: known[r.form] for r in votes}
    found = rows.mapInArrow(_clauses(weights, ["toxic"]), "toxic int, sums array<double>, n_words bigint").collect()  # at most 2 * MOST_LABELLED short rows
    found.sort(key=lambda r: (r.toxic, r.n_words, r.sums))
    y = np.array([r.toxic for r in found], float)
    x = _inputs(np.array([r.sums for r in found]), np.array([r.n_words for r in found]))
    sway = np.where(y == 1, share / toxic, (1 - share) / clean) * len(y)
    return weights, _logistic(x, y, sway, START)


def toxicity(docs: DataFrame, labels: DataFrame, *, threshold: float = THRESHOLD, most_labelled: int = MOST_LABELLED) -> DataFrame:
    """(doc_id, held_out, score, predicted, n_words, clauses) for each row of docs(doc_id, text), learnt
    from labels(doc_id, toxic); `clauses` is the weight of the clauses matched, by kind.

    Labels of ids whose crc32 modulo 4 is 2 are never read. An id with several labels counts as toxic
    if one of them says so. Null and empty texts match nothing and get the score of a text without
    matches, as do texts of words that nothing was learnt about; rows without an id are scored
    and aren't held out; repeated rows each count. Without labels of both kinds the seed words and
    given coefficients stand. An empty table gives no rows; other columns are not read."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(FOLDS)) == HELD_OUT
    share = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(~fold).agg(F.avg(F.when(F.col("toxic") > 0, 1.0).otherwise(0.0)).alias("share")).first().share or 0.0
    weights, b = fit(training_rows(docs, labels, most=most_labelled), share)
    rows = docs.mapInArrow(_clauses(weights, ["doc_id"]), "doc_id bigint, sums array<double>, n_words bigint")
    kinds = [F.log1p(F.col("sums")[k]) * float(b[1 + k]) for k in range(KINDS)]
    total = F.aggregate("sums", F.lit(0.0), lambda a, v: a + v)
    z = sum(kinds, F.lit(float(b[0]))) + F.log1p(1000 * total / F.greatest("n_words", F.lit(1))) * float(b[-1])
    score = 1 / (1 + F.exp(-z))
    return rows.select("doc_id", F.coalesce(fold, F.lit(False)).alias("held_out"), score.alias("score"), (score >= threshold).cast("int").alias("predicted"), "n_words", F.col("sums").alias("clauses"))


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
