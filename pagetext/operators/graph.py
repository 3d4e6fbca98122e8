"""Work on whole pages: one shuffle by page, then page after page as the rows come; components inside pages."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cut(df: DataFrame) -> DataFrame:
    """Checkpoint in the shared folder that spark.checkpoint.dir names."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not named:
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(named)
    return df.checkpoint()


def kept(df: DataFrame) -> DataFrame:
    """The rows as a compressed table in the shared folder, for what is read more than once."""
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    path = f"{base.rstrip('/')}/pages-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def by_page(df: DataFrame, keys: list[str], work: Callable[[pd.DataFrame, np.ndarray], pd.DataFrame | Iterator[pd.DataFrame]], schema: str, *order: str) -> DataFrame:
    """work(rows, page) on whole pages, some at a time: rows of pages that ended with a batch, sorted by
    keys and order, and the running number of each row's page. A task holds a batch and one page; work whose
    result is larger than that returns it in parts."""

    def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest: list[pd.DataFrame] = []
        for rows in batches:
            if rows.empty:
                continue
            page = (rows[keys] != rows[keys].shift()).any(axis=1).to_numpy()
            if rest:
                page[0] = (rest[-1][keys].iloc[-1] != rows[keys].iloc[0]).any()
            starts = np.flatnonzero(page)
            if not len(starts):
                rest.append(rows)
                continue
            ended = [*rest, rows.iloc[: starts[-1]]] if starts[-1] or rest else []
            if ended:
                yield from done(ended)
            rest = [rows.iloc[starts[-1] :]]
        if rest:
            yield from done(rest)

    def done(parts: list[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat(parts, ignore_index=True) if len(parts) > 1 else parts[0].reset_index(drop=True)
        if len(rows):
            found = work(rows, np.cumsum((rows[keys] != rows[keys].shift()).any(axis=1).to_numpy()))
            yield from [found] if isinstance(found, pd.DataFrame) else found

    # Dealt by a hash of the keys: Spark drops a repartition by columns that a union's sides are dealt by
    # already, and may then coalesce the sides differently, which parts a page.
    return df.dropna(subset=keys).repartition(F.xxhash64(*keys)).sortWithinPartitions(*keys, *order).mapInPandas(stream, schema)


def least_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least node that each of n nodes reaches by the edges (a, b): roots are hooked to roots and paths halved
    until nothing changes."""
    label = np.arange(n)
    while True:
        least = np.minimum(label[a], label[b])
        after = label.copy()
        for ends in (a, b, label[a], label[b]):
            np.minimum.at(after, ends, least)
        after = after[after]
        if (after == label).all():
            return label
        label = after


def _labels(edges: pd.DataFrame, page: np.ndarray, keys: list[str]) -> pd.DataFrame:
    """Least labels of all pages at once, by halving paths until nothing changes."""
    ids, pages = np.concatenate([edges["a"].to_numpy(), edges["b"].to_numpy()]), np.concatenate([page, page])
    order = np.lexsort((ids, pages))
    fresh = np.concatenate([[True], (ids[order][1:] != ids[order][:-1]) | (pages[order][1:] != pages[order][:-1])])
    node = np.empty(len(ids), np.int64)
    node[order] = np.cumsum(fresh) - 1
    label = least_labels(int(fresh.sum()), node[: len(edges)], node[len(edges) :])
    first = order[fresh]
    rows = edges[keys].iloc[first % len(edges)].reset_index(drop=True)
    return rows.assign(frag_id=ids[first], group_id=ids[first][label])


def _ranks(page: list[np.ndarray], values: list[np.ndarray]) -> list[np.ndarray]:
    """Whole numbers that are in the order of (page, value), for arrays of both."""
    own, rank = np.unique(np.concatenate(values), return_inverse=True)
    keys = np.concatenate(page).astype(np.int64) * (len(own) + 1) + rank
    return np.split(keys, np.cumsum([len(v) for v in values])[:-1])


AT_ONCE = 1 << 18  # pairs laid out together


def _between(borders: tuple[np.ndarray, np.ndarray], page: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Whether a border of its page lies strictly between low and high."""
    if not len(borders[0]):
        return np.zeros(len(page), bool)
    at, low, high = _ranks([borders[0], page, page], [borders[1], low, high])
    at = np.sort(at)
    return np.searchsorted(at, high, "left") > np.searchsorted(at, low, "right")


def _touching(rows: pd.DataFrame, page: np.ndarray) -> pd.DataFrame:
    """Groups of fragments whose reaches touch with no border between: those that come by top edge before a
    reach's end are a run of the sorted rows."""
    kind, ids = rows["kind"].to_numpy(), rows["frag_id"].to_numpy()
    value = {c: rows[c].to_numpy(float) for c in ("x1", "y1", "x2", "y2", "mv", "mh")}
    lines = {axis: (page[kind == n], value["y1"][kind == n]) for n, axis in ((1, "h"), (2, "v"))}
    frags = np.flatnonzero(kind == 0)  # by page and id
    first = np.ones(len(frags), bool)
    first[1:] = (page[frags][1:] != page[frags][:-1]) | (ids[frags][1:] != ids[frags][:-1])
    node = np.cumsum(first) - 1
    boxed = ~np.isnan(np.stack([v[frags] for v in value.values()])).any(axis=0)
    at, node_of = frags[boxed], node[boxed]
    top, end = _ranks([page[at]] * 2, [value["y1"][at] - value["mv"][at], value["y2"][at] + value["mv"][at]])
    order = np.argsort(top, kind="stable")
    at, node_of, top, end = at[order], node_of[order], top[order], end[order]
    upto = np.searchsorted(top, end, "right")
    low = np.arange(len(at)) + 1
    n = np.maximum(upto - low, 0)
    total = np.cumsum(n)
    left, right, begin = value["x1"] - value["mh"], value["x2"] + value["mh"], 0
    edges = []
    while begin < len(at):
        stop = max(begin + 1, int(np.searchsorted(total, total[begin] - n[begin] + AT_ONCE, "right")))
        some = n[begin:stop]
        i, j = np.repeat(np.arange(begin, stop), some), np.arange(some.sum()) - np.repeat(np.cumsum(some) - some, some) + np.repeat(low[begin:stop], some)
        a, b = at[i], at[j]
        met = (left[a] <= right[b]) & (left[b] <= right[a]) & (value["y1"][b] - value["mv"][b] <= value["y2"][a] + value["mv"][a]) & (value["y1"][a] - value["mv"][a] <= value["y2"][b] + value["mv"][b])
        a, b, i, j = a[met], b[met], i[met], j[met]
        gap = lambda c: (np.minimum(value[f"{c}2"][a], value[f"{c}2"][b]), np.maximum(value[f"{c}1"][a], value[f"{c}1"][b]))  # noqa: E731, B023
        free = ~(_between(lines["h"], page[a], *gap("y")) | _between(lines["v"], page[a], *gap("x")))
        edges.append((node_of[i[free]], node_of[j[free]]))
        begin = stop
    ends = [np.concatenate([e[k] for e in edges] or [np.empty(0, np.int64)]) for k in (0, 1)]
    label = least_labels(int(first.sum()), *ends)
    one = frags[first]
    moved = np.flatnonzero(label != np.arange(len(label)))
    return pd.DataFrame({"page_id": rows["page_id"].to_numpy()[one[moved]], "frag_id": ids[one[moved]], "group_id": ids[one[label[moved]]]})


def touching_labels(frags: DataFrame, borders: DataFrame | None = None) -> DataFrame:
    """(page_id, frag_id, group_id) of frags(page_id, frag_id, box, margin_v, margin_h) that a lesser member reaches over
    fragments whose reaches touch, no border strictly inside their gap. Pairs lie inside pages: fragments and
    borders meet by page once, and pairs are laid out there, some at a time."""
    kinds = dict(frags.dtypes)
    boxes = [F.col(c).cast("double").alias(c) for c in ("x1", "y1", "x2", "y2")]
    rows = frags.dropna(subset=["frag_id"]).select("page_id", F.lit(0).alias("kind"), "frag_id", *boxes, F.col("margin_v").cast("double").alias("mv"), F.col("margin_h").cast("double").alias("mh"))
    if borders is not None:
        line = F.when(F.col("axis") == "h", 1).when(F.col("axis") == "v", 2)
        none = [F.lit(None).cast("double").alias(c) for c in ("x2", "y2", "mv", "mh")]
        told = borders.select("page_id", line.alias("kind"), F.lit(0).cast(kinds["frag_id"]).alias("frag_id"), F.lit(0.0).alias("x1"), F.col("pos").cast("double").alias("y1"), *none)
        rows = rows.union(told.dropna(subset=["kind", "y1"]))
    return by_page(rows, ["page_id"], _touching, f"page_id {kinds['page_id']}, frag_id {kinds['frag_id']}, group_id {kinds['frag_id']}", "kind", "frag_id")


def _merges(edges: pd.DataFrame, page: np.ndarray) -> pd.DataFrame:
    """How many groups of each page are merged at each weight: the edges of its minimum spanning forest.

    Edges are taken weight by weight, of all pages at once, and what a weight joins is one node for the next."""
    ids, pages = np.concatenate([edges["a"].to_numpy(), edges["b"].to_numpy()]), np.concatenate([page, page]) - 1
    order = np.lexsort((ids, pages))
    fresh = np.concatenate([[True], (ids[order][1:] != ids[order][:-1]) | (pages[order][1:] != pages[order][:-1])])
    node = np.empty(len(ids), np.int64)
    node[order] = np.cumsum(fresh) - 1
    a, b, weight = node[: len(edges)], node[len(edges) :], edges["weight"].to_numpy()
    of = pages[order[fresh]]
    label = np.arange(len(of))
    groups = np.bincount(of)
    found = []
    for w in np.unique(weight):
        x, y = a[weight == w], b[weight == w]
        while True:
            least = np.minimum(label[x], label[y])
            after = label.copy()
            for ends in (x, y, label[x], label[y]):
                np.minimum.at(after, ends, least)
            after = after[after]
            if (after == label).all():
                break
            label = after
        left = np.bincount(of[label == np.arange(len(of))], minlength=len(groups))
        found.append((np.full(len(groups), w), groups - left))
        groups = left
    named = edges["page_id"].iloc[np.flatnonzero(np.diff(page, prepend=page[0] - 1))]
    out = pd.DataFrame({"page_id": np.tile(named.to_numpy(), len(found)), "weight": np.concatenate([w for w, _ in found]), "n": np.concatenate([n for _, n in found])})
    return out[out["n"] > 0]


def forest_weights(edges: DataFrame) -> DataFrame:
    """(page_id, weight, n) of edges(page_id, a, b, weight int): of each page's minimum spanning forest, how
    many edges have each weight. Cut at a weight, the forest gives the groups of all edges up to it."""
    return by_page(edges.select("page_id", "a", "b", "weight"), ["page_id"], _merges, f"page_id {dict(edges.dtypes)['page_id']}, weight int, n bigint")


def component_labels(edges: DataFrame, *also: str) -> DataFrame:
    """(page_id, *also, frag_id, group_id) of the nodes that edges(a, b) have: the least member they reach.

    A component lies inside a page, so one shuffle by page brings each together."""
    keys = ["page_id", *also]
    kinds = dict(edges.dtypes)
    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), f"frag_id {kinds['a']}", f"group_id {kinds['a']}"])
    return by_page(edges.select(*keys, "a", "b"), keys, lambda rows, page: _labels(rows, page, keys), schema)


def group_components(nodes: DataFrame, edges: DataFrame, *also: str) -> DataFrame:
    """nodes(page_id, *also, frag_id) with group_id; nodes without edges are groups of their own."""
    keys = ["page_id", *also]
    labels = component_labels(edges, *also)
    return nodes.join(labels, [*keys, "frag_id"], "left").select(*keys, "frag_id", F.coalesce("group_id", "frag_id").alias("group_id"))
