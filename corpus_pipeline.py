"""From documents to a training mix: quality, near duplicates, long repeats, benchmark leaks, source weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagetext.llm._store import dropped, numbered, stored
from pagetext.llm.op1_decontaminate import leaks
from pagetext.llm.op5_jaccard_join import jaccard_groups
from pagetext.llm.op6_quality import classify
from pagetext.llm.op7_mixing import mix
from pagetext.llm.op10_long_repeats import long_repeats

#: No SQL gives the model's perplexities or the rounding's draws; tests hold every stage against brute force.
ORACLE_SQL = None

SHINGLE_WORDS = 5
SIMILAR_PERCENT = 80
REPEATED_WORDS = 51


def _packed(docs: DataFrame, *keys: str) -> DataFrame:
    """Keys, text and all columns but the text as one, whose names can't clash with an operator's."""
    others = [F.col(f"`{c}`").alias(f"f{i}") for i, c in enumerate(docs.columns) if c != "text"]
    return docs.select(*keys, "text", F.struct(*others, F.col("text").isNull().alias("no_text")).alias("document"))


def _unpacked(packed: DataFrame, columns: list[str]) -> DataFrame:
    return packed.select(*[F.col("text") if c == "text" else F.col(f"document.f{i}").alias(c) for i, c in enumerate(columns)])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity is within their language's threshold.

    Null and empty texts are kept, and everything where no row is trusted. A null language has the
    threshold of all trusted rows. Repeated rows are judged one by one, texts of any length as a whole."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    judged = classify(_packed(docs, "doc_id", "lang"), labels, carry=("doc_id", "lang", "document"), keep_text=True)
    return _unpacked(judged.where("keep"), docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of similar documents the one with the least doc_id (null last, then the first row).

    Null, empty and blank texts are similar to nothing and stay. Of repeated rows one stays."""
    rows = numbered(_packed(docs, "doc_id"))
    keyed = rows.select(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row").alias("key"), "text", "row")
    groups = stored(jaccard_groups(keyed, width=SHINGLE_WORDS, percent=SIMILAR_PERCENT, id_column="key", row_column="row"))
    stays = groups.groupBy("component").agg(F.min("key").alias("first"), F.count("*").alias("n")).where("n > 1")
    goes = stored(groups.join(stays, "component").where("key <> first").select("key.row"), instead=groups)
    return _unpacked(rows.join(goes, "row", "left_anti"), docs.columns)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the bytes that repeated strings of 400 bytes or passages of 51 words cover.

    n_chars follows where something goes. Null texts stay null, empty ones empty; of rows that are
    repeated as a whole nothing is left but the rows. Texts of any length are searched as a whole."""
    left = long_repeats(_packed(docs), id_column="document", keep_text=True, words=REPEATED_WORDS)
    text = F.when((F.col("n_removed") == 0) & F.col("document.no_text"), F.lit(None)).otherwise(F.col("left"))
    cut = left.select("document", text.alias("text"), "n_removed")
    columns = []
    for i, (name, own) in enumerate(zip(docs.columns, docs.schema, strict=True)):
        was = F.col("text") if name == "text" else F.col(f"document.f{i}")
        columns.append((F.when(F.col("n_removed") > 0, F.length("text").cast(own.dataType)).otherwise(was) if name == "n_chars" else was).alias(name))
    return cut.select(*columns)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item was found.

    Null and empty texts hold none and stay, as does everything where the benchmark is empty; of
    repeated rows all go or stay. Every passage of a long text is searched."""
    rows = numbered(_packed(docs))
    found = stored(leaks(rows.select("row", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_column="row").select("row").distinct())
    return _unpacked(rows.join(found, "row", "left_anti"), docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Copies and words to take of each document.

    Null and empty texts have no words and are taken no times; a null source is a source of its
    own, the last; repeated rows each count."""
    return mix(docs)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("repeats", repeats), ("decontaminated", decontaminated), ("mixed", mixed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        before, docs = docs, stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = stored(docs)
            dropped(before)
    return docs
