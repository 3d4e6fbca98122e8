"""Target-distribution importance resampling: documents are scored with an array of weights by
hashed feature, then ranked by parallel sorting by regular sampling."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagetext.llm._arrays import LOWER, buffers, slices
from pagetext.llm._store import stored

BUCKETS = 10_000
LONGEST_RUN = 3
LEAST_WORDS = 20
PERCENT = 5
SEED = 42
SEGMENT = 4_000  # rows that one segment of the sort has, about; more where there would be over MOST_SEGMENTS
MOST_SEGMENTS = 4_096
SAMPLES = 64  # rows for each segment that the splitters are picked from
SLICE_BYTES = 2 << 20
PIECE = 1 << 18  # words of one text that are handled at once
VECTOR_BYTES = 64  # of a word that is hashed together with others; longer ones are hashed one by one

WORD_BYTE = np.zeros(256, bool)
WORD_BYTE[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x41, 0x5B)]] = True  # A-Z count as their lower case
WORD_BYTE[0x80:] = True

SCORED = "doc_id bigint, n_words bigint, n_features bigint, weight bigint"


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """CRC-32's step for each byte; and for each length up to VECTOR_BYTES what that many zero bytes
    make of each byte of a checksum: a sum of words is joined from its words' checksums."""
    step = np.array([zlib.crc32(bytes([b])) for b in range(256)], np.uint32)
    step ^= step[0]
    shift = np.zeros((VECTOR_BYTES + 1, 4, 256), np.uint32)
    for k in range(4):
        shift[0, k] = np.arange(256, dtype=np.uint32) << np.uint32(8 * k)
    for n in range(1, VECTOR_BYTES + 1):
        shift[n] = step[shift[n - 1] & np.uint32(255)] ^ (shift[n - 1] >> np.uint32(8))
    return step, shift


_STEP, _SHIFT = _tables()
_BLANK = np.uint32(zlib.crc32(b" "))
_FULL = np.uint32(0xFFFFFFFF)


def _joined(left: np.ndarray, right: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Checksums of left + right, with the checksum and the length (up to VECTOR_BYTES) of the right."""
    byte = np.uint32(255)
    moved = _SHIFT[n, 0, left & byte] ^ _SHIFT[n, 1, left >> np.uint32(8) & byte] ^ _SHIFT[n, 2, left >> np.uint32(16) & byte] ^ _SHIFT[n, 3, left >> np.uint32(24)]
    return moved ^ right


def _word_sums(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-32 of each word's bytes."""
    found = np.full(len(starts), _FULL, np.uint32)
    n = np.minimum(ends - starts, VECTOR_BYTES)
    order = np.argsort(-n, kind="stable")
    held, first = found[order], starts[order]
    counts = np.bincount(n, minlength=VECTOR_BYTES + 1)
    more = len(starts) - np.cumsum(counts)  # words longer than k
    for k in range(VECTOR_BYTES):
        if not (m := more[k]):
            break
        held[:m] = _STEP[(held[:m] ^ data[first[:m] + k]) & np.uint32(255)] ^ (held[:m] >> np.uint32(8))
    found[order] = held ^ _FULL
    for i in np.flatnonzero(ends - starts > VECTOR_BYTES):
        found[i] = zlib.crc32(data[starts[i] : ends[i]].tobytes())
    return found


def _follows(left: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """Checksums of left + blank + word, for each word."""
    spaced = _STEP[(left ^ _FULL ^ np.uint32(32)) & np.uint32(255)] ^ ((left ^ _FULL) >> np.uint32(8)) ^ _FULL
    n = ends - starts
    found = _joined(spaced, sums, np.minimum(n, VECTOR_BYTES))
    for i in np.flatnonzero(n > VECTOR_BYTES):
        found[i] = zlib.crc32(data[starts[i] : ends[i]].tobytes(), int(spaced[i]))
    return found


def features(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, bucket) of every run of up to LONGEST_RUN words of the rows' texts, piece after piece;
    rows come in order, and one-word runs of a piece come before longer ones."""
    raw, at = buffers(column)
    solid = WORD_BYTE[raw]
    if not solid.any():
        return
    data = LOWER[raw]
    edge = np.zeros(len(data) + 1, bool)
    edge[at] = True
    before = np.concatenate([[False], solid[:-1]])
    starts = np.flatnonzero(solid & (~before | edge[:-1]))
    after = np.concatenate([solid[1:], [False]])
    ends = np.flatnonzero(solid & (~after | edge[1:])) + 1
    row = np.searchsorted(at, starts, "right") - 1
    for first in range(0, len(starts), PIECE):
        last = min(first + PIECE + LONGEST_RUN - 1, len(starts))
        s, e, r = starts[first:last], ends[first:last], row[first:last]
        own = min(PIECE, len(s))
        sums = _word_sums(data, s, e)
        run = sums
        yield r[:own], (run[:own] % np.uint32(BUCKETS)).astype(np.int64)
        for k in range(1, LONGEST_RUN):
            run = _follows(run[:-1], data, s[k:], e[k:], sums[k:])
            m = min(own, len(run))
            same = r[:m] == r[k : k + m]
            yield r[:m][same], (run[:m][same] % np.uint32(BUCKETS)).astype(np.int64)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        for first, last in slices(batch.column("text"), SLICE_BYTES):
            for _, bucket in features(batch.column("text").slice(first, last - first)):
                total += np.bincount(bucket, minlength=BUCKETS)
    found = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(total[found])], ["bucket", "n"])


def feature_counts(texts: DataFrame) -> np.ndarray:
    """How often each bucket occurs in texts(text). A task adds up its own rows, so at most BUCKETS
    rows leave it, and as many reach the driver."""
    found = np.zeros(BUCKETS, np.int64)
    for r in texts.select("text").mapInArrow(_counted, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        found[r.bucket] = r.n
    return found


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln) of each bucket's smoothed share in the target over that in the raw texts."""
    s, t = int(raw.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log(float((int(b) + 1) * (s + BUCKETS)) / float((int(a) + 1) * (t + BUCKETS)))) for a, b in zip(raw, target, strict=True)], np.int64)


def _weighed(gain: np.ndarray):
    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last in slices(batch.column("text"), SLICE_BYTES):
                part = batch.slice(first, last - first)
                words, runs, weight = (np.zeros(len(part), np.int64) for _ in range(3))
                single = True
                for i, (row, bucket) in enumerate(features(part.column("text"))):
                    single = i % LONGEST_RUN == 0
                    n = np.bincount(row, minlength=len(part))
                    runs += n
                    words += n * single
                    weight += np.bincount(row, gain[bucket], len(part)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *map(pa.array, (words, runs, weight))], ["doc_id", "n_words", "n_features", "weight"])

    return scores


def _before(a: tuple, b: tuple) -> np.ndarray:
    """Whether a row comes before another: higher score, then smaller doc_id (null last), then row."""
    out = a[3] < b[3]
    for x, y in ((a[2], b[2]), (a[1], b[1]), (-a[0], -b[0])):
        out = np.where(x == y, out, x < y)
    return out


def _keys(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    ids = batch.column("doc_id")
    return (batch.column("score").to_numpy(), np.asarray(ids.is_null()).astype(np.int64), ids.fill_null(0).to_numpy(), batch.column("row").to_numpy())


def _samples(each: int):
    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Every so many-th row of a run that comes in order."""
        seen = TaskContext.get().partitionId() * 7919 % each  # short runs differ in where they begin
        for batch in batches:
            at = np.arange((-seen) % each, len(batch), each)
            seen += len(batch)
            yield batch.take(pa.array(at)).select(["score", "doc_id", "row"])

    return sampled


def _dealt(splitters: tuple[np.ndarray, ...]):
    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = _keys(batch)
            low, high = np.zeros(len(batch), np.int64), np.full(len(batch), len(splitters[0]))
            while (open_ := low < high).any():
                mid = np.minimum((low + high) // 2, len(splitters[0]) - 1)
                right = ~_before(own, tuple(x[mid] for x in splitters))
                low, high = np.where(open_ & right, mid + 1, low), np.where(open_ & ~right, mid, high)
            yield batch.append_column("segment", pa.array(low.astype(np.int32)))

    return segments


def _placed(firsts: np.ndarray):
    def ranks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come segment after segment, in order: a row's rank is its place in the segment and all before."""
        last, n = -1, 0
        for batch in batches:
            segment = batch.column("segment").to_numpy()
            fresh = np.flatnonzero(np.concatenate([[True], segment[1:] != segment[:-1]])) if len(segment) else np.zeros(0, int)
            place = np.arange(len(segment)) - np.repeat(fresh, np.diff(np.append(fresh, len(segment)))) + 1
            if len(segment):
                place[segment == last] += n if segment[0] == last else 0
                last, n = int(segment[-1]), int(place[-1])
            yield batch.append_column("rank", pa.array(firsts[segment] + place, pa.int64()))

    return ranks


def _order() -> tuple[Column, ...]:
    return F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("row")


def ranked(rows: DataFrame, most: int, *, segment: int = SEGMENT, most_segments: int = MOST_SEGMENTS) -> DataFrame:
    """rows(row, doc_id, score, ...) with `rank`: 1 .. most by score, ties to the smaller doc_id, then
    to the smaller row (a number of its own for each row); beyond, null.

    Parallel sorting by regular sampling. Every partition is a run, sorted where it is; of each
    run every so many-th row is a sample, about SAMPLES for each segment, and regular splitters come
    from these, at most most_segments of them. Rows go to the segment between two splitters; segments are counted first, so those
    that hold no rank up to `most` aren't exchanged. An exchanged segment is sorted in its task,
    and what the segments before it hold is added. Splitters are told apart by row number too, so
    equal scores, and rows that repeat, are cut like others."""
    n = rows.count()
    if not n or most <= 0:
        return rows.withColumn("rank", F.lit(None).cast("bigint"))
    parts = min(-(-n // segment), most_segments)
    keys = "score bigint, doc_id bigint, row bigint"
    each = max(1, n // (parts * SAMPLES))
    sample = rows.select("score", "doc_id", "row").sortWithinPartitions(*_order()).mapInArrow(_samples(each), keys).toArrow()
    own = _keys(sample.combine_chunks().to_batches()[0]) if len(sample) else ()
    if own:
        order = np.lexsort((own[3], own[2], own[1], -own[0]))
        at = order[np.unique(np.arange(1, parts) * len(order) // parts)] if parts > 1 else order[:0]
        splitters = tuple(x[at] for x in own)
    else:
        splitters = tuple(np.zeros(0, np.int64) for _ in range(4))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    dealt = rows.mapInArrow(_dealt(splitters), f"{kinds}, segment int")
    sizes = np.zeros(len(splitters[0]) + 1, np.int64)
    for r in dealt.groupBy("segment").agg(F.count("*").alias("n")).collect():
        sizes[r.segment] = r.n
    firsts = np.cumsum(sizes) - sizes
    drawn = int(np.searchsorted(firsts, most))  # segments that hold a rank up to most
    spread = dealt.where(F.col("segment") < drawn).repartition(max(drawn, 1), "segment").sortWithinPartitions("segment", *_order())
    placed = spread.mapInArrow(_placed(firsts), f"{kinds}, segment int, rank bigint").withColumn("rank", F.when(F.col("rank") <= most, F.col("rank")))
    return placed.unionByName(dealt.where(F.col("segment") >= drawn).withColumn("rank", F.lit(None).cast("bigint"))).drop("segment")


def _numbered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    at = TaskContext.get().partitionId() << 33
    for rows in batches:
        rows["row"] = np.arange(at, at + len(rows))
        at += len(rows)
        yield rows


def resample(docs: DataFrame, target: DataFrame, *, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED, **how) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) for each row of docs(doc_id, text), with
    target(text).

    Words are runs of a-z (A-Z lower-cased), 0-9 and characters beyond ASCII; features are runs of
    one to three words, hashed into 10,000 buckets. A document's weight is the sum of its features' gains,
    its score adds Gumbel noise drawn from its id; of the rows with at least least_words words
    the best `percent` in a hundred are ranked. Null and empty texts have no feature and weight 0;
    a null doc_id draws as an empty one and comes last among ties; repeated rows each count and
    take ranks of their own; an empty table gives no rows, an empty target is smoothed alone.
    Columns of other names are not read."""
    gain = gains(feature_counts(docs), feature_counts(target))
    weighed = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(_weighed(gain), SCORED)
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0)))
    rows = stored(weighed.withColumn("score", F.col("weight") + noise).mapInPandas(_numbered, f"{SCORED}, score bigint, row bigint"))
    able = rows.where(F.col("n_words") >= least_words)
    most = percent * able.count() // 100
    columns = ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    short = rows.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("bigint"))
    return ranked(able, most, **how).select(*columns).unionByName(short.select(*columns))


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
