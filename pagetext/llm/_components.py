"""Connected components by minimum labels, in DataFrame rounds and within a task."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from pagetext.llm._store import dropped, stored


def least_labels(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The least node that edges between a and b reach, for each of n nodes."""
    label = np.arange(n)
    while True:
        least = np.minimum(label[a], label[b])
        after = label.copy()
        np.minimum.at(after, a, least)
        np.minimum.at(after, b, least)
        np.minimum.at(after, label[a], least)
        np.minimum.at(after, label[b], least)
        after = after[after]
        if (after == label).all():
            return label
        label = after


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The edges a-b as one edge from each node to the least that it reaches."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    root = least_labels(ends[: len(a)], ends[len(a) :], len(nodes))
    far = root != np.arange(len(nodes))
    return nodes[far], nodes[root[far]]


def components(edges: DataFrame) -> DataFrame:
    """(id, root) for every id that appears in edges(a, b); root is the least id that links reach.

    Each round takes the least label among the neighbours and then follows the label's own label,
    so that chains shorten by half. Labels are written out each round, and each table is dropped
    when the next is there. The sums are map-side combined, so an id with very many neighbours
    costs one partial row per task.
    """
    both = stored(edges.where("a <> b").select("a", "b").union(edges.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = stored(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("root")).select("id", F.least("id", "root").alias("root")))
    while True:
        near = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("root").alias("root"))
        least = labels.withColumn("was", F.col("root")).union(near.withColumn("was", F.lit(None))).groupBy("id").agg(F.min("root").alias("root"), F.max("was").alias("was"))
        jump = labels.select(F.col("id").alias("root"), F.col("root").alias("next"))
        after = least.join(jump, "root", "left").select("id", F.least("root", F.coalesce("next", "root")).alias("root"), "was")
        moved = Observation()
        labels = stored(after.observe(moved, F.count_if(F.col("root") < F.col("was")).alias("n")).select("id", "root"), instead=labels)
        if not moved.get["n"]:
            dropped(both)
            return labels
