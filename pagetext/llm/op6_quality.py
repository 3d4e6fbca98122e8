"""Quality classifier: an interpolated modified Kneser-Ney model of character 4-grams, trained on
trusted text; each document's perplexity is held against a quantile of its language."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagetext.llm._arrays import slices
from pagetext.llm._store import stored
from pagetext.llm.op3_url_filter import WORDS, blocked_bloom, in_block, maybe_in

LEAST_BITS, MOST_BITS = 6, 16  # of a symbol. 0: start and end, all bits: characters not in trusted text, between them its own
ORDER = 4
QUANTILE = 0.99
SLACK = 1.12
SHORT = 8  # a text of n symbols may have 1 + SHORT / n times its language's threshold
LEAST_TRUSTED = 30
SLICE_BYTES = 1 << 20  # of text that a task scores at once


def _symbols(texts: list[str], table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all texts, each after ORDER - 1 starts and before one end; and their ends."""
    whole = ("\0" * (ORDER - 1)).join(["", *[t.replace("\0", "�") + "\0" for t in texts]])
    points = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum([len(t) + ORDER for t in texts])
    return table[np.minimum(points, len(table) - 1)].astype(np.int64), ends


def _bits(table: np.ndarray) -> int:
    return int(table[-1]).bit_length()  # the last stands for characters not in trusted text


def _grams(texts: list[str], table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the 4-grams of all texts, and how many belong to each."""
    s, ends = _symbols(texts, table)
    code = s[ORDER - 1 :].copy()
    for back in range(1, ORDER):
        code += s[ORDER - 1 - back : len(s) - back] << (_bits(table) * back)
    last = np.zeros(len(s), bool)  # grams that end in a text's own symbols or its end
    start = ends - np.array([len(t) + ORDER for t in texts])
    last[:] = True
    for i in range(ORDER - 1):
        last[start + i] = False
    return code[last[ORDER - 1 :]], np.array([len(t) + 1 for t in texts])


def _characters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(0x110000, np.int64)
    for batch in batches:
        for first, last in slices(batch.column("text"), SLICE_BYTES):
            whole = "".join((t or "").replace("\0", "�") for t in batch.column("text").slice(first, last - first).to_pylist())
            total += np.bincount(np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32), minlength=0x110000)
    found = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(total[found])], ["point", "n"])


def _gram_counts(table: np.ndarray):
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last in slices(batch.column("text"), SLICE_BYTES):
                codes, _ = _grams([t or "" for t in batch.column("text").slice(first, last - first).to_pylist()], table)
                gram, n = np.unique(codes, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(gram, pa.int64()), pa.array(n, pa.int64())], ["gram", "n"])

    return counted


def _discounted(counts: DataFrame) -> tuple[DataFrame, Column]:
    """counts with the discount of each count by counts of counts; and the discount itself."""
    seen = counts.agg(*[F.count_if(F.col("n") == k).alias(f"n{k}") for k in range(1, 5)]).first()
    n1, n2, n3, n4 = (max(float(x or 0), 1.0) for x in seen)
    y = n1 / (n1 + 2 * n2)
    steps = [min(max(k - (k + 1) * y * b / a, 0.1), k - 0.1) for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
    off = F.when(F.col("n") == 1, steps[0]).when(F.col("n") == 2, steps[1]).otherwise(steps[2])
    return counts.withColumn("off", off), off


def fit(texts: DataFrame) -> tuple[np.ndarray, list[tuple[np.ndarray, ...]]]:
    """(symbol of each code point, for each order its sorted grams, their own shares, contexts and
    the contexts' back-off weights), from texts(text).

    Counts are sharded by gram and summed map-side first; lower orders count in how many contexts
    to the left a gram stands. Shares and back-off weights come from joins of a gram's count with
    its context's sums. Every character of the texts is a symbol of its own; more than 65,534 are
    an error. Characters that they don't have share one, which has no counts: all are equally new."""
    points = sorted(r.point for r in texts.mapInArrow(_characters, "point int, n bigint").select("point").distinct().collect())
    bits = max(LEAST_BITS, (len(points) + 1).bit_length())
    if bits > MOST_BITS:
        raise ValueError(f"{len(points)} characters in trusted texts; 4-grams of at most {2**MOST_BITS - 2} fit 64 bits")
    table = np.full(max(points, default=0) + 2, 2**bits - 1, np.int32)
    table[0] = 0
    table[points] = np.arange(1, len(points) + 1)
    counts = stored(texts.mapInArrow(_gram_counts(table), "gram bigint, n bigint").groupBy("gram").agg(F.sum("n").alias("n")))
    orders = []
    for order in range(ORDER, 0, -1):
        marked, _ = _discounted(counts)
        context = marked.groupBy(F.shiftrightunsigned("gram", bits).alias("context")).agg(F.sum("n").alias("total"), F.sum("off").alias("freed"))
        share = marked.join(context, F.shiftrightunsigned(marked["gram"], bits) == F.col("context")).select("gram", ((F.col("n") - F.col("off")) / F.col("total")).alias("share")).toPandas().sort_values("gram")
        weight = context.select("context", (F.col("freed") / F.col("total")).alias("weight")).toPandas().sort_values("context")
        orders.insert(0, (share["gram"].to_numpy(np.int64), share["share"].to_numpy(float), weight["context"].to_numpy(np.int64), weight["weight"].to_numpy(float)))
        if order > 1:
            counts = stored(counts.groupBy(F.col("gram").bitwiseAND(F.lit((1 << bits * (order - 1)) - 1)).alias("gram")).agg(F.count("*").alias("n")))
    return table, orders


def _found(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, otherwise: float) -> np.ndarray:
    if not len(keys):
        return np.full(len(wanted), otherwise)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], otherwise)


def log_probabilities(orders: list[tuple[np.ndarray, ...]], codes: np.ndarray | None = None, bits: int = LEAST_BITS) -> np.ndarray:
    """log10 probability of the last symbol of the 4-gram codes; by default of every code."""
    codes = np.arange(1 << ORDER * bits) if codes is None else codes
    found = np.full(len(codes), 2.0**-bits)
    for order, (gram, share, context, weight) in enumerate(orders):
        own = codes & ((1 << bits * (order + 1)) - 1) if order < ORDER - 1 else codes
        before = (codes >> bits) & ((1 << bits * order) - 1)
        found = found * _found(context, weight, before, 1.0) + _found(gram, share, own, 0.0)
    return np.log10(found)


def _scored(shared, keep_text: bool):
    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, orders = shared.value
        for batch in batches:
            for first, last in slices(batch.column("text"), SLICE_BYTES):
                part = batch.slice(first, last - first)
                codes, n = _grams([t or "" for t in part.column("text").to_pylist()], table)
                own, back = np.unique(codes, return_inverse=True)
                total = np.add.reduceat(log_probabilities(orders, own, _bits(table))[back], np.cumsum(n) - n)
                kept = part.num_columns - (not keep_text)  # the text is last
                yield pa.RecordBatch.from_arrays([*part.columns[:kept], pa.array(n), pa.array(total)], [*part.schema.names[:kept], "n_symbols", "log10_prob"])

    return scores


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Distinct ids of labelled rows of good quality that aren't toxic."""
    return labels.where("quality = 1 AND coalesce(toxic, 0) = 0 AND doc_id IS NOT NULL").select("doc_id").distinct()


def trusted_texts(docs: DataFrame, labels: DataFrame, *, bits_per_id: int = 16, broadcast_bytes: int = 32 << 20) -> DataFrame:
    """The texts of all trusted rows, without moving any: a blocked Bloom filter of the trusted ids passes
    theirs and a few others, and these others, found by ids alone, are taken out again. The filter is
    broadcast up to broadcast_bytes and joined by block beyond."""
    kind = docs.schema["doc_id"].dataType  # equal ids of another type have other hashes
    ids = stored(trusted_ids(labels).select(F.col("doc_id").try_cast(kind).alias("doc_id")).dropna())
    blocks = max(1, -(-ids.count() * bits_per_id // (64 * WORDS)))
    bloom = blocked_bloom(ids, "doc_id", blocks)
    if blocks * (WORDS + 1) * 8 <= broadcast_bytes:
        bloom = F.broadcast(bloom)
    passed = lambda *also: docs.select("doc_id", *also, in_block(F.col("doc_id"), blocks).alias("block")).join(bloom, "block").where(maybe_in(F.col("doc_id"))).select("doc_id", *also)
    others = stored(passed().join(ids, "doc_id", "left_anti").distinct())
    return passed("text").join(F.broadcast(others), "doc_id", "left_anti").select("text")


def score(docs: DataFrame, labels: DataFrame, *, carry: tuple[str, ...] = ("doc_id", "lang"), keep_text: bool = False) -> DataFrame:
    """The carried columns (and the text, if kept), n_symbols (characters and an end) and log10_prob
    of each row's text."""
    spark = docs.sparkSession
    table, orders = fit(stored(trusted_texts(docs, labels)))
    shared = spark.sparkContext.broadcast((table, orders))
    rows = docs.select(*carry, "text")
    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in rows.columns[: len(carry) + keep_text])
    return rows.mapInArrow(_scored(shared, keep_text), f"{kinds}, n_symbols bigint, log10_prob double")


def classify(docs: DataFrame, labels: DataFrame, *, quantile: float = QUANTILE, slack: float = SLACK, least_trusted: int = LEAST_TRUSTED, carry: tuple[str, ...] = ("doc_id", "lang"), keep_text: bool = False) -> DataFrame:
    """(carried columns, the text if kept, n_symbols, log10_prob, perplexity, threshold, keep) for each row of
    docs(doc_id, text, lang), with labels(doc_id, quality, toxic).

    The model is trained on the texts of all trusted rows; its distinct grams are broadcast. A language's threshold is slack times the quantile of
    the perplexities (in steps of 0.01 %) of all its trusted rows; languages with fewer than
    least_trusted of them, a null language too, take that of all trusted rows. Rows at or below it
    are kept; short texts, whose perplexity says little, are allowed more. Without trusted rows everything is kept, with a null threshold. Null and empty texts
    have one symbol, the end, which says nothing: they are kept. Repeated rows each count."""
    rated = score(docs, labels, carry=carry, keep_text=keep_text).withColumn("perplexity", F.pow(F.lit(10.0), -F.col("log10_prob") / F.col("n_symbols")))
    scored = stored(rated.select("doc_id", "lang", "perplexity") if keep_text else rated)  # texts are scored again rather than written
    step = F.ceil(F.log10("perplexity") * 10_000)
    bins = scored.join(trusted_ids(labels), "doc_id", "left_semi").groupBy("lang", step.alias("step")).agg(F.count("*").alias("n"))
    every = bins.withColumn("every", F.lit(True)).unionByName(bins.where("lang IS NOT NULL").withColumn("every", F.lit(False)).select("lang", "step", "n", "every")).withColumn("lang", F.when(~F.col("every"), F.col("lang"))).groupBy("every", "lang", "step").agg(F.sum("n").alias("n"))
    whole = Window.partitionBy("every", "lang")
    below = F.sum("n").over(whole.orderBy("step"))
    limits = every.withColumn("reached", below).withColumn("all", F.sum("n").over(whole)).where(F.col("reached") >= quantile * F.col("all")).groupBy("every", "lang").agg(F.min("step").alias("step"), F.first("all").alias("all"))
    limits = limits.withColumn("limit", slack * F.pow(F.lit(10.0), F.col("step") / 10_000.0))
    pooled = limits.where("every").agg(F.max("limit").alias("pooled")).first().pooled
    own = stored(limits.where(~F.col("every") & (F.col("all") >= least_trusted)).select("lang", "limit"))  # its size is known when it is joined
    threshold = F.coalesce("limit", F.lit(pooled).cast("double")) * (1 + F.lit(float(SHORT)) / F.col("n_symbols"))
    return (rated if keep_text else scored).join(own, "lang", "left").withColumn("threshold", threshold).withColumn("keep", F.coalesce((F.col("perplexity") <= threshold) | (F.col("n_symbols") == 1), F.lit(True))).select(*carry, *["text"] * keep_text, "n_symbols", "log10_prob", "perplexity", "threshold", "keep")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
