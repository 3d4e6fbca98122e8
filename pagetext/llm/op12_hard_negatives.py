"""Hard-negative mining: exact integer scores of anchors against all rows by matrix products in a
residue number system, then selection in the window that each positive's score opens."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagetext.llm._store import stored

EVERY = 50  # rows whose id it divides are anchors
SCALE = 256
POSITIVES, NEGATIVES = 5, 3
LEAST, MOST = 50, 95  # hundredths of the positive's score
ROWS, ANCHORS = 4096, 512  # rows in a block
BUCKETS = 64  # copies of the anchors, where there are as many blocks of rows
LARGEST = 1 << 62  # of a row's product with itself: scores fit 64 bits then
EXACT = 1 << 24  # integers up to it are exact in float32
DEPTH = 64  # components that one product adds up


def _primes(below: int) -> list[int]:
    sieve = np.ones(below, bool)
    sieve[:2] = False
    for i in range(2, math.isqrt(below) + 1):
        if sieve[i]:
            sieve[i * i :: i] = False
    return [int(p) for p in np.flatnonzero(sieve)[::-1]]


#: Residues stay below half a prime on either side, so DEPTH products of them add up below EXACT.
PRIMES = [p for p in _primes(2 * math.isqrt(EXACT // DEPTH)) if DEPTH * ((p - 1) // 2) ** 2 < EXACT][:8]


def _centred(x: np.ndarray, p: int) -> np.ndarray:
    """x modulo p, from -(p - 1) / 2 to (p - 1) / 2."""
    half = (p - 1) // 2
    return (x + half) % p - half


class Residues:
    """An integer matrix modulo each prime, in float32."""

    def __init__(self, x: np.ndarray):
        self.x, self.parts = x, []

    def part(self, k: int) -> np.ndarray:
        while len(self.parts) <= k:
            self.parts.append(_centred(self.x, PRIMES[len(self.parts)]).astype(np.float32))
        return self.parts[k]


def products(a: Residues, b: Residues, bound: int) -> np.ndarray:
    """Exact inner products of a's rows with b's, none over `bound` on either side of 0.

    As many primes as the bound asks for: the product of all is more than twice as large. Each
    modulus is one float32 matrix product for DEPTH components. Chinese remaindering by mixed
    radix: every digit is centred, so that the sum is the signed score itself."""
    found, scale = None, 1
    for k, p in enumerate(PRIMES):
        left, right = a.part(k), b.part(k)
        residue = np.zeros((len(left), len(right)), np.int64)
        for at in range(0, left.shape[1], DEPTH):
            residue += (left[:, at : at + DEPTH] @ right[:, at : at + DEPTH].T).astype(np.int64)
        if found is None:
            found, scale = _centred(residue, p), p
        else:
            digit = _centred((residue - found % p) % p * pow(scale, -1, p), p)
            found = found + digit * np.int64(scale)
            scale *= p
        if scale > 2 * bound + 1:
            return found
    raise ValueError(f"scores up to {bound} need more than {len(PRIMES)} primes")


BLOCK = "bucket int, dims int, most bigint, rows binary, ids binary, labels binary, vectors binary"


def _blocks(size: int, bucket_of):
    """Arrow batches of (row, vec_id, label, x) as blocks of `size` rows, ordered by vec_id."""

    def block(parts: list[pa.RecordBatch], number: int) -> pa.RecordBatch:
        table = pa.Table.from_batches(parts)
        row, ids, label = (table.column(c).to_numpy() for c in ("row", "vec_id", "label"))
        x = table.column("x").combine_chunks()
        x = x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x
        lengths = np.diff(x.offsets.to_numpy())
        wide = np.zeros((len(lengths), int(lengths.max(initial=0))), np.int64)
        wide[np.arange(wide.shape[1]) < lengths[:, None]] = x.flatten().to_numpy()
        order = np.lexsort((row, ids))
        most = int((wide.astype(float) ** 2).sum(1).max(initial=0.0) * (1 + 1e-9)) + 1
        ends = int(wide.min(initial=0)), int(wide.max(initial=0))
        narrow = next(k for k in (np.int8, np.int16, np.int32, np.int64) if np.iinfo(k).min <= ends[0] and ends[1] <= np.iinfo(k).max)
        values = [bucket_of(number), wide.shape[1], most, row[order].tobytes(), ids[order].tobytes(), label[order].astype(np.int64).tobytes(), wide[order].astype(narrow).tobytes()]
        kinds = [pa.int32(), pa.int32(), pa.int64(), *[pa.binary()] * 4]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], [c.split()[0] for c in BLOCK.split(", ")])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, number = [], 0, 0
        for batch in batches:
            while len(batch):
                part = batch.slice(0, size - n)
                held.append(part)
                n, batch = n + len(part), batch.slice(len(part))
                if n == size:
                    yield block(held, number)
                    held, n, number = [], 0, number + 1
        if held:
            yield block(held, number)

    return packed


def _spread(buckets: int):
    return lambda number: (TaskContext.get().partitionId() * 31 + number) % buckets


class _Block:
    def __init__(self, batch: pa.RecordBatch, i: int):
        of = lambda name: batch.column(name)[i].as_py()
        self.rows, self.ids, self.labels = (np.frombuffer(of(n), np.int64) for n in ("rows", "ids", "labels"))
        self.most, dims, data = of("most"), of("dims"), of("vectors")
        self.x = np.frombuffer(data, f"i{max(1, len(data) // max(1, len(self.rows) * dims))}").reshape(len(self.rows), dims)

    def residues(self, dims: int) -> Residues:
        return Residues(self.x[:, :dims].astype(np.int64))


def _met(select):
    """Scores of the anchors and the rows of each pair of blocks, given to `select`. A bucket's blocks of rows
    come first and are held; its blocks of anchors pass by."""

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, bucket = [], None
        for batch in batches:
            for i in range(len(batch)):
                if (at := batch.column("bucket")[i].as_py()) != bucket:
                    held, bucket = [], at
                block = _Block(batch, i)
                if not batch.column("anchors")[i].as_py():
                    held.append(block)
                    continue
                wanted = batch.column("wanted")[i].as_py() if "wanted" in batch.schema.names else None
                known: dict[int, Residues] = {}
                for b in held:
                    dims = min(block.x.shape[1], b.x.shape[1])  # what a shorter row lacks is 0
                    if dims not in known:
                        known[dims] = block.residues(dims)
                    yield select(block, b, products(known[dims], b.residues(dims), (math.isqrt(block.most) + 1) * (math.isqrt(b.most) + 1)), wanted)

    return met


def _top(scores: np.ndarray, most: int) -> np.ndarray:
    """Places of the `most` highest scores; equal ones by place, which follows vec_id."""
    if len(scores) > most:
        at = np.flatnonzero(scores >= np.partition(scores, len(scores) - most)[len(scores) - most])
    else:
        at = np.arange(len(scores))
    return at[np.argsort(-scores[at], kind="stable")][:most]


FOUND = "anchor bigint, anchor_id bigint, other bigint, other_id bigint, score bigint"


def _best_positives(most: int):
    def select(a: _Block, b: _Block, scores: np.ndarray, _) -> pa.RecordBatch:
        rows = []
        for i in range(len(a.rows)):
            like = np.flatnonzero((b.labels == a.labels[i]) & (b.rows != a.rows[i]))
            at = like[_top(scores[i, like], most)]
            rows.append((np.full(len(at), a.rows[i]), np.full(len(at), a.ids[i]), b.rows[at], b.ids[at], scores[i, at]))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in zip(*rows, strict=True)], [c.split()[0] for c in FOUND.split(", ")])

    return select


MINED = "anchor bigint, anchor_id bigint, positive bigint, positive_id bigint, positive_score bigint, negative bigint, negative_id bigint, negative_score bigint"


def _best_negatives(most: int, least_share: int, most_share: int):
    def select(a: _Block, b: _Block, scores: np.ndarray, wanted: list) -> pa.RecordBatch:
        rows = []
        for i, positives in enumerate(wanted):
            lows = [-(-least_share * p["score"] // 100) for p in positives]
            highs = [most_share * p["score"] // 100 for p in positives]
            near = [k for k in range(len(positives)) if lows[k] <= highs[k]]
            if not near:
                continue
            s = scores[i]
            at = np.flatnonzero((s >= min(lows[k] for k in near)) & (s <= max(highs[k] for k in near)) & (b.labels != a.labels[i]))
            at = at[np.argsort(-s[at], kind="stable")]
            for k in near:
                first = int(np.searchsorted(-s[at], -highs[k]))
                own = at[first : first + most]
                own = own[s[own] >= lows[k]]
                p = positives[k]
                rows.append((np.full(len(own), a.rows[i]), np.full(len(own), a.ids[i]), np.full(len(own), p["other"]), np.full(len(own), p["other_id"]), np.full(len(own), p["score"]), b.rows[own], b.ids[own], s[own]))
        rows = rows or [(np.zeros(0, np.int64),) * 8]
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in zip(*rows, strict=True)], [c.split()[0] for c in MINED.split(", ")])

    return select


def taking_part(vectors: DataFrame, *, scale: int = SCALE) -> DataFrame:
    """(vec_id, label, x) of the rows that take part, x their components as integers."""
    sound = F.col("embedding").isNotNull() & F.col("label").isNotNull() & F.col("vec_id").isNotNull() & F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("bigint") + 1) % 10).otherwise(F.col("label").cast("bigint"))
    x = F.transform("embedding", lambda v: F.floor(v.cast("double") * scale))
    size = F.aggregate("embedding", F.lit(0.0), lambda n, v: n + F.pow(F.abs(F.floor(v.cast("double") * scale).cast("double")), 2))
    return vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), "label", "embedding").where(sound).where(size < float(LARGEST)).select("vec_id", moved.alias("label"), x.alias("x"))


def _pairs(anchors: DataFrame, rows: DataFrame, buckets: int) -> DataFrame:
    """Every block of anchors beside every block of rows: the anchors are copied once for each bucket of row
    blocks, and a bucket comes as its row blocks, then the anchors. Nothing is broadcast, as the copies
    are many times what their table seems to be."""
    copied = anchors.withColumn("bucket", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1)))).withColumn("anchors", F.lit(True))
    both = rows.withColumn("anchors", F.lit(False)).unionByName(copied, allowMissingColumns=True)
    return both.repartition(buckets, "bucket").sortWithinPartitions("bucket", "anchors")


def mine(vectors: DataFrame, *, every: int = EVERY, positives: int = POSITIVES, negatives: int = NEGATIVES, least: int = LEAST, most: int = MOST, block: int = ROWS, anchor_block: int = ANCHORS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of vectors(vec_id,
    embedding, label).

    Anchors are rows whose vec_id `every` divides; scores are inner products of components
    floor(256 * x). An anchor's positives are its best rows of the same label; a positive's
    negatives are the best rows of other labels whose score is from `least` to `most` hundredths
    of its own. Ties go to the smaller vec_id. Rows lie in blocks of `block`; each block of anchors
    meets each of them, and from a pair of blocks only the best few of each anchor go on, which
    a window merges. The second product runs with the positives' scores known.

    Rows with a null label, vec_id or vector, or a null or non-finite component take no part, nor
    do those whose product with themselves is 2**62 or more, as their scores need not fit 64 bits.
    A shorter vector counts as filled with zeros. Rows that repeat each count: a copy of the anchor
    is another row, and anchors of one id are mined one by one. Empty tables give no rows; other
    columns are not read."""
    numbered = taking_part(vectors).withColumn("row", F.monotonically_increasing_id())
    rows = stored(numbered)
    blocks = stored(rows.mapInArrow(_blocks(block, _spread(1 << 30)), BLOCK))
    count = blocks.count()
    buckets = max(1, min(count, max(BUCKETS, count // 4)))
    blocks = blocks.withColumn("bucket", F.pmod("bucket", F.lit(buckets)))
    picked = rows.where(F.col("vec_id") % every == 0)
    parts = picked.count() // anchor_block + 1
    picked = picked.coalesce(parts)
    scored = _pairs(picked.mapInArrow(_blocks(anchor_block, lambda _: 0), BLOCK), blocks, buckets).mapInArrow(_met(_best_positives(positives)), FOUND)
    place = F.row_number().over(Window.partitionBy("anchor").orderBy(F.col("score").desc(), "other_id", "other"))
    first = scored.withColumn("place", place).where(F.col("place") <= positives)
    wanted = first.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("place", "score", "other", "other_id"))).alias("wanted"))
    asked = stored(picked.withColumnRenamed("row", "anchor").join(wanted.hint("merge"), "anchor").withColumnRenamed("anchor", "row").select("row", "vec_id", "label", "x", "wanted"))
    kind = "array<array<struct<place: int, score: bigint, other: bigint, other_id: bigint>>>"
    anchors = asked.coalesce(parts).mapInArrow(_asked(anchor_block), f"{BLOCK}, wanted {kind}")
    mined = _pairs(anchors, blocks, buckets).mapInArrow(_met(_best_negatives(negatives, least, most)), MINED)
    rank = F.row_number().over(Window.partitionBy("anchor", "positive").orderBy(F.col("negative_score").desc(), "negative_id", "negative"))
    return mined.withColumn("rank", rank).where(F.col("rank") <= negatives).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def _asked(size: int):
    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.sort_by([("vec_id", "ascending"), ("row", "ascending")])
            for at in range(0, len(batch), size):
                part = batch.slice(at, size)
                for found in _blocks(size, lambda _: 0)(iter([part.select(["row", "vec_id", "label", "x"])])):
                    wanted = part.column("wanted")
                    yield found.append_column("wanted", pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), wanted))

    return packed


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


ORACLE = f"""
WITH sound AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda v: floor({SCALE} * v::DOUBLE)) AS x
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND coalesce(list_bool_and(list_transform(embedding, lambda v: v IS NOT NULL AND isfinite(v))), true)
), scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS positive, list_dot_product(a.x, b.x)::BIGINT AS score
  FROM sound a JOIN sound b ON a.vec_id % {EVERY} = 0 AND a.vec_id <> b.vec_id
), positives AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scored WHERE positive
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= {POSITIVES}
)
SELECT p.anchor_id, p.positive_id, (row_number() OVER w)::INTEGER AS rank, n.other_id AS negative_id, p.positive_score, n.score AS negative_score
FROM positives p JOIN scored n ON n.anchor_id = p.anchor_id AND NOT n.positive
  AND {LEAST} * p.positive_score <= 100 * n.score AND 100 * n.score <= {MOST} * p.positive_score
WINDOW w AS (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.other_id)
QUALIFY row_number() OVER w <= {NEGATIVES}
"""
