"""Embedding near-dedup: spherical k-means assigns vectors to cells, level after level, blocked
cosine products compare within cells, and one representative of each group is kept."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagetext.llm._components import components, least_labels
from pagetext.llm._store import dropped, numbered, stored

LEAST_COSINE = 0.98
CELL = 256
FAN = 256  # cells that a cell is cut into at most, in one level
FITTED = 16  # rows for each of them that its centroids are fitted on
WINDOW = 0.4
BLOCK = 2048
ASSIGNED = 4096  # rows that one task assigns


def unit_rows(vectors: pd.Series) -> np.ndarray:
    """Rows of length 1, whatever the size of their components."""
    x = np.stack(vectors.to_numpy()).astype(float)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def spherical_kmeans(x: np.ndarray, k: int, *, rounds: int = 8, seed: int = 8) -> np.ndarray:
    """k unit centroids of unit rows x, fewer where there are fewer distinct rows."""
    x = np.unique(x, axis=0)
    centroids = x[np.random.default_rng(seed).permutation(len(x))[:k]]
    for _ in range(rounds):
        near = (x @ centroids.T).argmax(1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, near, x)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centroids = np.where(norms > 1e-12, sums / np.maximum(norms, 1e-12), centroids)
    return centroids


def _fitted(rows: pd.DataFrame) -> pd.DataFrame:
    """A cell's centroids, from a sample of its rows."""
    found = spherical_kmeans(unit_rows(rows["vector"]), int(rows["fan"].iloc[0]))
    return pd.DataFrame({"cell": rows["cell"].iloc[0], "part": np.arange(len(found)), "centroid": list(found)})


def _assigned(reach: float):
    """Part of its cell that is nearest to each row, and copies for the parts that its partners may be in:
    those whose bisecting plane is within reach. A row is home where it is nearest on every level."""

    def assign(rows: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        if rows.empty or told.empty:
            return rows.assign(part=0)[["lead", "many", "vector", "home", "cell", "part"]]
        told = told.sort_values("part")
        c, part = np.stack(told["centroid"].to_numpy()), told["part"].to_numpy()
        cos = unit_rows(rows["vector"]) @ c.T
        near = cos.argmax(1)
        gaps = np.sqrt(np.maximum(2 - 2 * c @ c.T, 1e-18))[near]
        at, cell = np.nonzero((cos[np.arange(len(cos)), near][:, None] - cos) / gaps <= reach)
        out = rows.iloc[at]
        return pd.DataFrame({"lead": out["lead"].to_numpy(), "many": out["many"].to_numpy(), "vector": out["vector"].to_numpy(), "home": out["home"].to_numpy() & (cell == near[at]), "cell": out["cell"].to_numpy(), "part": part[cell]})

    return assign


def _compared(least: float):
    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        """Links of the home vectors of one block of a cell with another block: their number, and for every
        vector the least lead of its group as far as these links go."""
        i, j = rows["i"].iloc[0], rows["j"].iloc[0]
        homes, others = rows[rows["home"] & (rows["block"] == i)], rows[rows["block"] == j]
        if homes.empty or others.empty:
            return pd.DataFrame({"lead": [], "links": [], "root": []}).astype("int64")
        x, y = unit_rows(homes["vector"]), unit_rows(others["vector"])
        leads, node = np.unique(np.concatenate([homes["lead"].to_numpy(), others["lead"].to_numpy()]), return_inverse=True)
        own, far = node[: len(x)], node[len(x) :]
        many, links, root = others["many"].to_numpy(), np.zeros(len(leads), np.int64), np.arange(len(leads))
        for s in range(0, len(x), 512):
            near = x[s : s + 512] @ y.T >= least
            near[own[s : s + 512, None] == far[None]] = False
            links[own[s : s + 512]] += near @ many
            a, b = np.nonzero(near)
            root = np.minimum(root, least_labels(root[own[s + a]], root[far[b]], len(leads))[root])
        told = (links > 0) | (root != np.arange(len(leads)))
        return pd.DataFrame({"lead": leads[told], "links": links[told], "root": leads[root[told]]})

    return compare


def _cells(vectors: DataFrame, cell: int, reach: float) -> DataFrame:
    """(lead, many, vector, home, cell) of vectors(lead, many, label, dim, vector): each row in its own cell
    and copied into those that its partners may call home.

    Labels and lengths are the first cells. Each level cuts the cells that more than twice `cell` rows
    call home into at most FAN parts by k-means on a sample of their rows, until none is larger or centroids
    cut no more (equal directions): those are left to the blocks. Rows and centroids meet by cell and
    salt, so a task assigns about ASSIGNED rows however large the cell is."""
    level = vectors.select("lead", "many", "vector", F.lit(True).alias("home"), F.xxhash64("label", "dim").alias("cell"))
    kind = dict(level.dtypes)
    schema = f"lead bigint, many bigint, vector {kind['vector']}, home boolean, cell bigint, part int"
    level, done = stored(level), None
    while True:
        size = stored(level.groupBy("cell").agg(F.count("*").alias("n"), F.count_if("home").alias("homes")))
        large = size.where(F.col("homes") > 2 * cell).select("cell", "n", F.least(F.lit(FAN), F.ceil(F.col("homes") / cell)).cast("int").alias("fan"), F.ceil(F.col("n") / ASSIGNED).cast("int").alias("salts"))
        if not large.limit(1).count():
            return level.select("lead", "many", "vector", "home", "cell") if done is None else done.union(level.select("lead", "many", "vector", "home", "cell"))
        rows = level.join(large, "cell")
        sample = rows.where(F.pmod(F.xxhash64("lead", F.lit(1)), F.col("n")) < F.col("fan") * FITTED)
        centroids = stored(sample.groupBy("cell").applyInPandas(_fitted, "cell bigint, part int, centroid array<double>"))
        told = centroids.join(large.select("cell", F.col("salts").alias("copies")), "cell").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("copies") - 1))).drop("copies")
        salted = rows.withColumn("salt", F.pmod(F.xxhash64("lead", F.lit(2)), F.col("salts")).cast("int"))
        cut = stored(salted.groupBy("cell", "salt").cogroup(told.groupBy("cell", "salt")).applyInPandas(_assigned(reach), schema))
        parts = cut.groupBy("cell", "part").agg(F.count("*").alias("n")).groupBy("cell").agg(F.max("n").alias("most"))
        whole = stored(parts.join(size, "cell").where(F.col("most") > 0.9 * F.col("n")).select("cell"))
        ready = level.join(large.join(whole, "cell", "left_anti"), "cell", "left_anti").select("lead", "many", "vector", "home", "cell")
        done = stored(ready if done is None else done.union(ready), instead=done)
        level = stored(cut.join(whole, "cell", "left_anti").select("lead", "many", "vector", "home", F.xxhash64("cell", "part").alias("cell")), instead=level)
        dropped(cut, size, centroids, whole)


def near_vectors(vectors: DataFrame, *, least_cosine: float = LEAST_COSINE, cell: int = CELL, window: float = WINDOW, block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of vectors(vec_id, embedding, label).

    Vectors are compared where labels and lengths are equal; null labels, null, empty or zero
    vectors and those with null or non-finite components link with nothing. Equal vectors meet as
    one, with their number; rows are told apart by a number of their own, vec_id is only reported
    (the least of a group, null where it has none). Each vector is copied into the cells whose
    bisecting plane is within window * sin(angle): at window 1 no pair can be missed; the default
    covers four standard deviations of where a partner in a random direction lies in 100 dimensions
    (recall is tested, also on vectors that lie along few directions and between centroids). Cells of
    more than `block` vectors are compared block against block, in tasks of their own, once. Links are
    counted; each task passes on one edge for each vector, to the least one that its links reach."""
    most = F.array_max(F.transform("embedding", lambda x: F.abs(x.cast("double"))))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    fine = F.coalesce(F.col("label").isNotNull() & F.col("embedding").isNotNull() & finite & (most > 0), F.lit(False))
    read = vectors.select("vec_id", "label", "embedding", fine.alias("fine"))
    same = stored(read.where("fine").groupBy("label", F.col("embedding").alias("vector")).agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("many")))
    same = numbered(same.withColumn("dim", F.size("vector")), "lead")
    celled = stored(_cells(same, cell, window * (1 - least_cosine**2) ** 0.5))
    blocks = celled.groupBy("cell").agg(F.count("*").alias("n")).select("cell", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    placed = celled.join(blocks, "cell").withColumn("block", F.pmod(F.xxhash64("lead", F.lit(3)), F.col("blocks")).cast("int"))
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    met_as: dict[str, Column] = {"other": F.transform(every, lambda i: F.struct(i.alias("i"), F.col("block").alias("j"))), "home": F.transform(every, lambda j: F.struct(F.col("block").alias("i"), j.alias("j")))}
    pairs = F.when(F.col("home"), F.array_union(met_as["home"], met_as["other"])).otherwise(met_as["other"])
    tasks = placed.select("cell", "lead", "many", "vector", "home", "block", F.explode_outer(pairs).alias("pair")).select("cell", "pair.i", "pair.j", "lead", "many", "vector", "home", "block")
    met = stored(tasks.groupBy("cell", "i", "j").applyInPandas(_compared(least_cosine), "lead bigint, links bigint, root bigint"))
    links = met.groupBy("lead").agg(F.sum("links").alias("links"))
    roots = components(stored(met.select(F.col("lead").alias("a"), F.col("root").alias("b")))).withColumnRenamed("id", "lead")
    leads = stored(same.join(links, "lead", "left").join(roots, "lead", "left").select("label", "vector", "vec_id", F.coalesce("root", "lead").alias("root"), (F.coalesce("links", F.lit(0)) + F.col("many") - 1).alias("n_links")))
    dropped(celled, met)
    least = leads.groupBy("root").agg(F.min("vec_id").alias("component_id"))
    groups = leads.join(least, "root").select("label", "vector", "n_links", "component_id")
    linked = read.where("fine").withColumnRenamed("embedding", "vector").join(groups, ["label", "vector"], "left").select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), "component_id")
    alone = read.where("NOT fine").select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.col("vec_id") == F.col("component_id"))


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
