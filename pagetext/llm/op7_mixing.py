"""Mixing sources to target weights: every document gets an expected number of copies; the
fractional parts are rounded by the pivotal method, pair after pair, and what one group leaves
over meets the others in a reduction tree."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagetext.llm._store import listed, numbered, stored

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST_COPIES = 2
FAN_IN = 1000


def _placed(totals: DataFrame) -> DataFrame:
    """totals with `place`, the source's number from 0 in code-point order, null last: sources are dealt
    out in ranges, and a range's numbers go on where those before it end."""
    ranges = totals.withColumn("none", F.col("source").isNull()).repartitionByRange("none", "source")
    spread = stored(ranges.withColumn("range", F.spark_partition_id()))
    sizes = sorted((r.range, r.n) for r in spread.groupBy("range").agg(F.count("*").alias("n")).collect())
    n = np.array([n for _, n in sizes], np.int64)
    starts = F.broadcast(listed(totals.sparkSession, range=pa.array([number for number, _ in sizes], pa.int32()), first=pa.array(np.cumsum(n) - n)))  # one row for each partition
    own = F.row_number().over(Window.partitionBy("range").orderBy(F.col("source").asc_nulls_last()))
    return spread.withColumn("own", own).join(starts, "range").select("source", "source_size", "n", (F.col("first") + F.col("own") - 1).alias("place"))


def source_targets(sizes: DataFrame, *, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST_COPIES) -> DataFrame:
    """(source, place, source_size, n, target) of sizes(source, size).

    Sources stand in code-point order, null last, and take the weights in turn. Targets share
    share * all words by weight; a target above most * source_size stops there and its excess is
    shared again by weight: the level (words for each unit of weight) rises in rounds, each one
    aggregation over the sources, until no further source stops."""
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    placed = stored(_placed(totals).withColumn("weight", weight).withColumn("cap", (most * F.col("source_size")).cast("double")))
    level, stopped = 0.0, -1
    while True:
        open_ = F.col("cap") > level * F.col("weight")
        seen = placed.agg(F.sum("source_size").alias("words"), F.sum(F.when(open_, F.col("weight"))).alias("weight"), F.coalesce(F.sum(F.when(~open_, F.col("cap"))), F.lit(0.0)).alias("caps"), F.count_if(~open_).alias("stopped")).first()
        if not seen.weight or seen.stopped == stopped:
            break
        level, stopped = (share * seen.words - seen.caps) / seen.weight, seen.stopped
    target = F.least("cap", level * F.col("weight")) if seen.weight else F.col("cap")
    return placed.select("source", "place", "source_size", "n", target.alias("target"))


def _pivot(rows: pd.DataFrame, seed: int, level: int) -> pd.DataFrame:
    """Round p of each row to 0 or 1 but for one row, which keeps what is left.

    Two documents at a time: words move from one to the other until one of them is integral, either
    way with the odds that leave both expectations unchanged; the words expected in all don't
    change at all. `part` is the share taken; `open` marks the row left."""
    rows = rows.sort_values(["size", "draw", "doc_id"], kind="stable", ignore_index=True)
    key = [seed, level, int(rows["place"].iloc[0]), int(rows["bucket"].iloc[0])]
    odds = np.random.default_rng(key).random(len(rows))
    size, p = rows["size"].to_numpy(float), rows["part"].to_numpy(float).copy()
    held = -1
    for i in range(len(rows)):
        if size[i] <= 0 or p[i] <= 0 or p[i] >= 1:
            p[i] = min(max(round(p[i]), 0), 1)
            continue
        if held < 0:
            held = i
            continue
        a, b = size[held], size[i]
        up, down = min(a * (1 - p[held]), b * p[i]), min(a * p[held], b * (1 - p[i]))
        if odds[i] * (up + down) < down:
            first = a * (1 - p[held]) <= b * p[i]
            p[held], p[i] = (1.0 if first else p[held] + up / a), (p[i] - up / b if first else 0.0)
        else:
            first = a * p[held] <= b * (1 - p[i])
            p[held], p[i] = (0.0 if first else p[held] - down / a), (p[i] + down / b if first else 1.0)
        if not 1e-12 < p[held] < 1 - 1e-12:
            p[held], held = round(p[held]), i
        if not 1e-12 < p[held] < 1 - 1e-12:
            p[held], held = round(p[held]), -1
    rows["part"], rows["open"] = p, np.arange(len(rows)) == held
    return rows


def _rounding(seed: int, level: int):
    return lambda rows: _pivot(rows, seed, level)


def mix(docs: DataFrame, *, group: int = 20_000, seed: int = 7, **how) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken) for each row of docs(doc_id,
    text, source).

    Size is the number of words (null and empty texts: 0, never taken). Each document of a source
    is expected target / source_size times, at most twice; whole copies are certain and the
    fraction is rounded. `copies` is whole but for the last document left in each source, whose
    leading words fill what is missing; so the words taken meet the target but for rounding.
    Sources are cut into groups of about `group` rows by a hash of doc_id, and level after level
    one open row of each group goes on, FAN_IN groups together; a source with very many rows has
    many groups. Draws depend on seed, source and group alone, so reruns agree; repeated rows each
    count; rows without an id, or of one that more than `group` rows have, are told apart by their number, so
    that they make many groups too; an empty table gives no rows."""
    sizes = docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint").alias("size"))
    sizes = numbered(stored(sizes))
    targets = stored(source_targets(sizes, **how))
    known = F.coalesce("source", F.lit(""))
    joined = sizes.withColumn("key", known).withColumn("none", F.col("source").isNull()).join(targets.select(known.alias("key"), F.col("source").isNull().alias("none"), "place", "source_size", "n", "target"), ["key", "none"])
    wanted = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    base = F.floor(wanted + 1e-12)
    hot = F.broadcast(sizes.groupBy("doc_id").agg(F.count("*").alias("alike")).where(F.col("alike") > group).select("doc_id", F.lit(True).alias("hot")))  # at most one id for each `group` rows
    joined = joined.join(hot, "doc_id", "left")
    drawn = joined.select("doc_id", "source", "size", "source_size", "target", "place", "n", base.alias("base"), F.greatest(wanted - base, F.lit(0.0)).alias("part"), F.when(F.col("doc_id").isNull() | F.col("hot"), F.xxhash64("row", F.lit(seed))).otherwise(F.xxhash64(F.col("doc_id").cast("string"), F.lit(seed))).alias("draw"))
    level = drawn.withColumn("bucket", F.pmod(F.col("draw"), F.ceil(F.col("n") / group))).withColumn("open", F.lit(False))
    columns = ["doc_id", "source", "size", "source_size", "target", "place", "n", "base", "part", "draw", "bucket", "open"]
    largest = targets.agg(F.max("n")).first()[0] or 0
    groups, depth, closed = -(-largest // group), 0, None
    while True:
        level = level.select(*columns)
        done = stored(level.groupBy("place", "bucket").applyInPandas(_rounding(seed, depth), level.schema))
        closed = done.where("NOT open") if closed is None else closed.union(done.where("NOT open"))
        if groups <= 1:
            closed = closed.union(done.where("open"))
            break
        level = done.where("open").withColumn("bucket", F.expr(f"bucket div {FAN_IN}"))
        groups, depth = -(-groups // FAN_IN), depth + 1
    copies = F.col("base") + F.col("part")
    return closed.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), F.round(copies * F.col("size")).cast("bigint").alias("taken"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")
