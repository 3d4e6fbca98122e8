"""Shared scratch tables: cut lineage by writing to the folder in spark.checkpoint.dir."""

from __future__ import annotations

import uuid
from weakref import WeakKeyDictionary

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MOST_FILES = 20_000

_paths: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def scratch_folder(spark: SparkSession) -> str:
    """The shared folder that spark.checkpoint.dir or the session's checkpoint directory names."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return named.rstrip("/")


def stored(df: DataFrame, *, instead: DataFrame | None = None) -> DataFrame:
    """Write the rows to a table in the shared folder and read them back, so that no later
    failure has to recompute what came before. A table that the new one is written `instead` of is
    dropped then."""
    spark = df.sparkSession
    path = f"{scratch_folder(spark)}/pagetext-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    _paths[found] = path
    if instead is not None:
        dropped(instead)
    return found


def dropped(*tables: DataFrame) -> None:
    """Delete stored tables that nothing reads any more; others are left alone."""
    for df in tables:
        if (path := _paths.pop(df, None)) is not None:
            context = df.sparkSession.sparkContext
            at = context._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(context._jsc.hadoopConfiguration()).delete(at, True)


def listed(spark: SparkSession, **columns: pa.Array) -> DataFrame:
    """A few rows of the driver's as a table. Spark reads Arrow itself; a list of Python rows would pass through
    Python workers of another kind, which stay in each executor's memory beside those of the Arrow functions."""
    return spark.createDataFrame(pa.table(columns))


def numbered(df: DataFrame, name: str = "row") -> DataFrame:
    """df with a number for each row that stays the same whenever it is read again, however the
    session splits its scans then: the place of its Parquet file among all files that are read, and of the row
    in the file. What isn't read straight from Parquet, or comes from more than MOST_FILES
    files, is written out with its numbers."""
    plan, files = df._jdf.queryExecution().analyzed(), None
    while plan.nodeName() in ("Project", "Filter"):
        plan = plan.children().head()
    if plan.nodeName().startswith(("LogicalRelation", "Relation")) and "parquet" in plan.toString():
        placed = df.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__place"))
        files = sorted(r[0] for r in placed.select("__file").distinct().limit(MOST_FILES + 1).collect())
    if files is None or len(files) > MOST_FILES:
        return stored(df.withColumn(name, F.monotonically_increasing_id()))
    order = listed(df.sparkSession, __order=pa.array(range(len(files)), pa.int64()), __file=pa.array(files, pa.string()))
    return placed.join(F.broadcast(order), "__file").withColumn(name, F.shiftleft("__order", 33) + F.col("__place")).select(*df.columns, name)
