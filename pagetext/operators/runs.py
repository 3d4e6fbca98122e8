"""Geometry on run tables (page_id, y, x0, x1): components, holes, extents, labels, borders, vetoes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagetext.operators.graph import by_page, component_labels, cut, kept, least_labels

BAND = 4096  # rows of a page that one task labels
REACH = 256  # pixels between boxes that count as near
WAIST_SPAN = 12
MOST_AT_ONCE = 1 << 18  # pairs, or rows of boxes, that a task lays out at once
_FAR = np.int64(1 << 40)
_NO_END = -(1 << 31)  # stands for the end of a run that has none


def _touching(row: np.ndarray, x0: np.ndarray, x1: np.ndarray, reach: int) -> np.ndarray:
    """For runs sorted by row and x0, the first run of each one's component: runs of neighbouring rows that overlap
    within `reach` columns connect. Runs of one row and x0 are one."""
    fresh = np.append(True, (row[1:] != row[:-1]) | (x0[1:] != x0[:-1]))
    node = np.cumsum(fresh) - 1
    a, b = _meet(row + 1, x0 - reach, x1 + reach, row, x0, x1)
    return np.flatnonzero(fresh)[least_labels(int(fresh.sum()), node[a], node[b])][node]


def components_of_runs(runs: DataFrame, reach: int = 1, band: int = BAND) -> DataFrame:
    """runs with label, the least node ((y + 1) * 2**32 + x0, never 0) of its component; runs of neighbouring rows that
    overlap within `reach` columns connect (1: eight ways, 0: four ways). Runs without a page, a row or a beginning have
    no place and are left out; those without an end touch nothing.

    A page is cut into bands of `band` rows, each labelled by itself, so a tall strip is many tasks' work. Then the
    labels on either side of a cut that touch are joined: the least of them names the component, which is
    the least node of all, however high the bands are. Labelled bands are kept as a table."""
    kinds = dict(runs.dtypes)

    def named(rows: pd.DataFrame, page: np.ndarray) -> pd.DataFrame:
        y, x0, x1 = (rows[c].to_numpy(np.int64) for c in ("y", "x0", "end"))
        first = _touching(_lines(_numbers(page), y), x0, x1, reach)
        return rows.assign(label=((y + 1 << 32) + x0)[first])[["page_id", "y", "x0", "end", "label"]]

    n = runs.dropna(subset=["page_id", "y", "x0"]).select("page_id", F.floor(F.col("y") / band).alias("band"), "y", "x0", F.coalesce("x1", F.lit(_NO_END)).alias("end"))
    labelled = by_page(n, ["page_id", "band"], named, f"page_id {kinds['page_id']}, y {kinds['y']}, x0 {kinds['x0']}, end {kinds['x1']}, label bigint", "y", "x0")
    labelled = kept(labelled.select("page_id", "y", "x0", F.when(F.col("end") > _NO_END, F.col("end")).alias("x1"), "label"))
    edge = F.floor(F.col("y") / band)
    bands = labelled.agg(F.min(edge).alias("first"), F.max(edge).alias("last")).first()
    if bands.first == bands.last:  # no page is cut
        return labelled
    a, b = (labelled.where(F.col("y") - edge * band == row).alias(side) for side, row in (("a", band - 1), ("b", 0)))
    touch = (F.col("a.page_id") == F.col("b.page_id")) & (F.col("b.y") == F.col("a.y") + 1) & (F.col("b.x0") <= F.col("a.x1") + reach) & (F.col("b.x1") >= F.col("a.x0") - reach)
    seams = a.join(b, touch).select("a.page_id", F.col("a.label").alias("a"), F.col("b.label").alias("b")).distinct()
    joined = component_labels(seams).select("page_id", F.col("frag_id").alias("label"), "group_id")
    return labelled.join(joined, ["page_id", "label"], "left").select("page_id", "y", "x0", "x1", F.coalesce("group_id", "label").alias("label"))


def _lines(page: np.ndarray, y: np.ndarray) -> np.ndarray:
    """A number for each row of each page; the rows of two pages are never neighbours."""
    low, high = int(y.min(initial=0)), int(y.max(initial=0))
    return page * (high - low + 2) + y - low


def background_runs(runs: DataFrame, pages: DataFrame) -> DataFrame:
    """The gaps between the runs of pages(page_id, w, h)."""
    rows = pages.select("page_id", "w", F.explode(F.sequence(F.lit(0), F.col("h") - 1)).alias("y"))
    edges = rows.select("page_id", "y", F.lit(-1).alias("x0"), F.lit(-1).alias("x1"), "w").union(runs.join(pages, "page_id").select("page_id", "y", "x0", "x1", "w"))
    after = F.coalesce(F.lead("x0").over(Window.partitionBy("page_id", "y").orderBy("x0")), F.col("w"))
    return edges.select("page_id", "y", (F.col("x1") + 1).alias("x0"), (after - 1).alias("x1")).where("x0 <= x1")


def _solid(rows: pd.DataFrame, page: np.ndarray) -> pd.DataFrame:
    """Runs of whole pages with their holes, labelled; a page's size comes as a row of its own."""
    page, sized = _numbers(page), rows["sized"].to_numpy()
    of, y, x0, x1 = page[~sized], *(rows[c].to_numpy(np.int64)[~sized] for c in ("y", "x0", "x1"))
    w, h = np.full(page[-1] + 1, -1), np.zeros(page[-1] + 1, np.int64)
    w[page[sized]], h[page[sized]] = rows["x0"].to_numpy()[sized], rows["x1"].to_numpy()[sized]
    known = np.zeros(page[-1] + 1, bool)
    known[page[sized]] = True
    edge, line = _spread(np.zeros(len(h), np.int64), h)  # the left edge of each row
    inside = known[of]
    g, gy, gx, end = (np.concatenate([e, r[inside]]) for e, r in ((edge, of), (line, y), (np.full(len(edge), -1), x0), (np.full(len(edge), -1), x1)))
    order = np.lexsort((gx, gy, g))
    g, gy, gx, end = g[order], gy[order], gx[order], end[order]
    same = np.append((g[1:] == g[:-1]) & (gy[1:] == gy[:-1]), False)[: len(g)]
    until = np.where(same, np.append(gx[1:], 0)[: len(g)], w[g]) - 1
    gap = end + 1 <= until
    g, gy, start, until = g[gap], gy[gap], end[gap] + 1, until[gap]
    if len(g):
        order = np.lexsort((start, gy, g))
        g, gy, start, until = g[order], gy[order], start[order], until[order]
        label = _touching(_lines(g, gy), start, until, 0)
        hole = ~np.isin(label, label[(gy == 0) & (start == 0)])
        of, y, x0, x1 = (np.concatenate([r, s[hole]]) for r, s in ((of, g), (y, gy), (x0, start), (x1, until)))
    order = np.lexsort((x0, y, of))
    of, y, x0, x1 = of[order], y[order], x0[order], x1[order]
    row = _lines(of, y)
    low = int(x0.min(initial=0))
    wide = int(x1.max(initial=0)) - low + 3
    reach = np.maximum.accumulate(row * wide + x1 - low)
    fresh = np.append(True, row[1:] * wide + x0[1:] - low > np.maximum(reach[:-1], row[1:] * wide - 2 - low) + 1)[: len(row)] | np.append(True, row[1:] != row[:-1])[: len(row)]
    first = np.flatnonzero(fresh)
    of, y, x0, x1, row = of[first], y[first], x0[first], np.maximum.reduceat(x1, first) if len(first) else x1, row[first]
    named = rows["page_id"].iloc[np.searchsorted(page, of)].to_numpy()
    return pd.DataFrame({"page_id": named, "y": y, "x0": x0, "x1": x1, "label": ((y + 1 << 32) + x0)[_touching(row, x0, x1, 1)] if len(y) else y})


def fill_holes(runs: DataFrame, pages: DataFrame, band: int = BAND) -> DataFrame:
    """runs with the holes in them, labelled: background that doesn't reach the corner four ways is inside.

    Pages of at most `band` rows are filled page after page as their runs come; taller ones by the components of their
    background, which are labelled band by band."""
    kinds = dict(runs.dtypes)
    runs = runs.select("page_id", "y", "x0", "x1").dropna()
    tall = pages.where(F.col("h") > band).select("page_id")
    low, high = (runs, None) if tall.isEmpty() else (runs.join(tall, "page_id", "left_anti"), runs.join(tall, "page_id", "left_semi"))
    sizes = pages.where(F.col("h") <= band).dropna().select("page_id", F.lit(True), F.lit(0), "w", "h")
    rows = low.select("page_id", F.lit(False).alias("sized"), "y", "x0", "x1").union(sizes)
    found = by_page(rows, ["page_id"], _solid, f"page_id {kinds['page_id']}, y {kinds['y']}, x0 {kinds['x0']}, x1 {kinds['x1']}, label bigint")
    if high is None:
        return found
    back = components_of_runs(background_runs(high, pages.where(F.col("h") > band)), reach=0, band=band)
    corner = back.where("y = 0 AND x0 = 0").select("page_id", "label")
    holes = back.join(corner, ["page_id", "label"], "left_anti").select("page_id", "y", "x0", "x1")
    return found.union(components_of_runs(merged_runs(high.union(holes)), band=band))


def merged_runs(runs: DataFrame) -> DataFrame:
    """Runs of a row that touch, as one."""
    w = Window.partitionBy("page_id", "y").orderBy("x0")
    reach = F.max("x1").over(w.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum(F.when(F.col("x0") > F.coalesce(reach, F.lit(-2)) + 1, 1).otherwise(0)).over(w)
    return runs.select("page_id", "y", "x0", "x1", island.alias("k")).groupBy("page_id", "y", "k").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1")).drop("k")


def _envelope(group: np.ndarray, y: np.ndarray, x0: np.ndarray, x1: np.ndarray) -> tuple[np.ndarray, ...]:
    """(group, x0, x1, extent) of the stretches between the ends of a group's runs: lowest run less topmost,
    plus one, 0 where no run is. Groups are numbered in order.

    A run is laid on the two blocks of 2**k stretches that cover it; blocks hand their topmost and
    lowest run down to their halves, so n runs take n log n steps and no pixel is looked at."""
    low = int(x0.min(initial=0))
    wide = int(x1.max(initial=0)) - low + 2
    ends, at = np.unique(np.concatenate([group * wide + x0 - low, group * wide + x1 + 1 - low]), return_inverse=True)
    left, right = at[: len(y)], at[len(y) :]
    level = np.frexp(np.maximum(right - left, 1))[1] - 1
    top, bottom = np.full(len(ends), _FAR), np.full(len(ends), -_FAR)
    for k in range(int(level.max(initial=0)), -1, -1):
        own = level == k
        for i in (left[own], right[own] - (1 << k)):
            np.minimum.at(top, i, y[own])
            np.maximum.at(bottom, i, y[own])
        if k and (half := 1 << (k - 1)) < len(ends):
            top, bottom = (np.concatenate([t[:half], f(t[half:], t[:-half])]) for t, f in ((top, np.minimum), (bottom, np.maximum)))
    extent = np.where(bottom >= top, bottom - top + 1, 0)
    within = np.append(ends[1:] // wide == ends[:-1] // wide, False) if len(ends) else np.zeros(0, bool)
    fresh = np.flatnonzero(within & ~np.concatenate([[False], within[:-1] & (extent[1:] == extent[:-1])])) if len(ends) else at
    last = np.flatnonzero(within & ~np.concatenate([within[1:] & (extent[1:] == extent[:-1]), [False]])) if len(ends) else at
    return ends[fresh] // wide, ends[fresh] % wide + low, ends[last + 1] % wide + low - 1, extent[fresh]


def _least(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The least of values[first .. last], for each of many stretches, from a sparse table."""
    level, table, found = np.frexp(last - first + 1)[1] - 1, values, values[first]
    for k in range(int(level.max(initial=0)) + 1):
        own = level == k
        found[own] = np.minimum(table[first[own]], table[last[own] - (1 << k) + 1])
        table = np.minimum(table[: -(1 << k) or None], table[1 << k :]) if len(table) > 1 << k else table
    return found


def _numbers(page: np.ndarray) -> np.ndarray:
    return page.astype(np.int64) - 1


def column_extents(labelled: DataFrame) -> DataFrame:
    """(page_id, label, x0, x1, extent): the stretches of columns where bottom less top, plus one, is the
    same; holes don't count. Rows grow with the runs, not with their width."""
    keys, kinds = ["page_id", "label"], dict(labelled.dtypes)

    def swept(rows: pd.DataFrame, page: np.ndarray) -> pd.DataFrame:
        group = _numbers(page)
        g, x0, x1, extent = _envelope(group, *(rows[c].to_numpy(np.int64) for c in ("y", "x0", "x1")))
        named = rows[keys].iloc[np.searchsorted(group, g)].reset_index(drop=True)
        return named.assign(x0=x0, x1=x1, extent=extent)[extent > 0]

    return by_page(labelled.select(*keys, "y", "x0", "x1"), keys, swept, f"page_id {kinds['page_id']}, label {kinds['label']}, x0 int, x1 int, extent int")


def _boxed(rows: pd.DataFrame, page: np.ndarray) -> Iterator[pd.DataFrame]:
    """(page_id, box_id, label, pixels) of the boxes among the runs of a band, some boxes at a time."""
    page, asked = _numbers(page), rows["asked"].to_numpy()
    runs, boxes, of = rows[~asked], rows[asked], page[asked]
    if not len(runs) or not len(boxes):
        return
    y, x0, x1, label = (runs[c].to_numpy(np.int64) for c in ("y", "x0", "x1", "label"))
    t, d, l, r = (boxes[c].to_numpy(np.int64) for c in ("y", "y2", "x0", "x1"))
    top, high = int(y.min()), int(y.max()) - int(y.min()) + 1
    own, names = page[~asked] * high + y - top, np.unique(label)
    code = np.searchsorted(names, label)
    first = np.clip(t, top, top + high)
    n = np.clip(d, top, top + high) - first
    for i, j in _chunks(n):
        box, line = _spread(first[i:j], n[i:j])
        box += i
        at, run = _meet(of[box] * high + line - top, l[box], r[box] - 1, own, x0, x1)
        box = box[at]
        key, back = np.unique(box * len(names) + code[run], return_inverse=True)
        pixels = np.bincount(back, np.minimum(x1[run], r[box] - 1) - np.maximum(x0[run], l[box]) + 1, len(key))
        which = boxes.iloc[key // len(names)]
        yield pd.DataFrame({"page_id": which["page_id"].to_numpy(), "box_id": which["box_id"].to_numpy(), "label": names[key % len(names)], "pixels": pixels.astype(np.int64)})


def _overlap(labelled: DataFrame, boxes: DataFrame, pad: int) -> DataFrame:
    """(page_id, box_id, label, pixels) of padded boxes.

    Runs and boxes meet in bands of BAND rows, band after band as the rows come; a box is in each band that it reaches."""
    kinds = dict(boxes.dtypes)
    floor = lambda c: F.floor(c / BAND)
    own = boxes.select("page_id", "box_id", (F.col("x1") - pad).alias("l"), (F.col("y1") - pad).alias("t"), (F.col("x2") + pad).alias("r"), (F.col("y2") + pad).alias("d")).where("l < r AND t < d")
    asked = own.select("page_id", F.explode(F.sequence(floor(F.col("t")), floor(F.col("d") - 1))).alias("band"), F.lit(True).alias("asked"), "box_id", F.lit(0).cast("bigint").alias("label"), F.col("t").alias("y"), F.col("d").alias("y2"), F.col("l").alias("x0"), F.col("r").alias("x1"))
    runs = labelled.dropna(subset=["label", "y", "x0", "x1"]).select("page_id", floor(F.col("y")).alias("band"), F.lit(False).alias("asked"), F.lit(0).cast(kinds["box_id"]).alias("box_id"), "label", "y", F.col("y").alias("y2"), "x0", "x1")
    met = by_page(runs.union(asked), ["page_id", "band"], _boxed, f"page_id {kinds['page_id']}, box_id {kinds['box_id']}, label bigint, pixels bigint", "y", "x0")
    return met.repartition("page_id", "box_id").groupBy("page_id", "box_id", "label").agg(F.sum("pixels").alias("pixels"))


def box_label(boxes: DataFrame, labelled: DataFrame, pad: int = 14) -> DataFrame:
    """boxes with the label that most pixels of the padded box have (ties the least; 0 if none)."""
    best = _overlap(labelled, boxes, pad).groupBy("page_id", "box_id").agg(F.min_by("label", F.struct(-F.col("pixels"), F.col("label"))).alias("label"))
    return boxes.join(best, ["page_id", "box_id"], "left").withColumn("label", F.coalesce("label", F.lit(0)))


def box_coverage(boxes: DataFrame, territory: DataFrame) -> DataFrame:
    """boxes with the label that covers most of them, and its share."""
    area = (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))
    best = _overlap(territory, boxes, 0).groupBy("page_id", "box_id").agg(F.max_by(F.struct("label", "pixels"), F.struct("pixels", -F.col("label"))).alias("m"))
    return boxes.join(best, ["page_id", "box_id"], "left").select(*boxes.columns, F.coalesce("m.label", F.lit(0)).alias("label"), F.coalesce(F.try_divide("m.pixels", area), F.lit(0.0)).alias("share"))


def _chunks(n: np.ndarray, most: int = MOST_AT_ONCE) -> Iterator[tuple[int, int]]:
    """Stretches (first, after) of items that have n rows each, with at most `most` rows or one item."""
    total, first = np.cumsum(n), 0
    while first < len(n):
        after = max(int(np.searchsorted(total, (total[first - 1] if first else 0) + most, "right")), first + 1)
        yield first, after
        first = after


def _spread(first: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For items that have n places each from `first` on: the item of each place, and the place."""
    n = np.maximum(n, 0)
    item = np.repeat(np.arange(len(n)), n)
    return item, np.arange(len(item)) - np.repeat(np.cumsum(n) - n, n) + first[item]


def _all_pairs(page: np.ndarray, ids: pd.Series, most: int = MOST_AT_ONCE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(a, b), rows of a page with the id of a below that of b, some at a time; rows are sorted by page and id, and
    those of one id stay together as a."""
    fresh = np.append(True, (page[1:] != page[:-1]) | (ids.iloc[1:].to_numpy() != ids.iloc[:-1].to_numpy()))
    starts = np.flatnonzero(fresh)
    sizes = np.diff(np.append(starts, len(page)))
    group = np.cumsum(fresh) - 1
    later = (starts + sizes)[group]
    n = np.searchsorted(page, page, "right") - later
    for i, j in _chunks(np.add.reduceat(n, starts), most):
        first, after = starts[i], starts[j] if j < len(starts) else len(page)
        a, b = _spread(later[first:after], n[first:after])
        yield a + first, b


def near_pairs(boxes: DataFrame, reach: int = REACH) -> DataFrame:
    """(page_id, a, b), a < b, of boxes of a page less than `reach` pixels apart. Empty boxes are near nothing."""
    return _beside(boxes.select("page_id", "box_id", "x1", "y1", "x2", "y2"), reach).select("page_id", "a", "b")


def _beside(boxes: DataFrame, reach: int = REACH) -> DataFrame:
    """The near pairs with the columns of both boxes as ax1 .. bshare. A page's boxes are swept from the top: a
    box meets those that begin below its own beginning and less than `reach` below its end."""
    kinds, own = dict(boxes.dtypes), [c for c in boxes.columns if c not in ("page_id", "box_id")]

    def swept(rows: pd.DataFrame, page: np.ndarray) -> Iterator[pd.DataFrame]:
        x1, y1, x2, y2 = (rows[c].to_numpy(float) for c in ("x1", "y1", "x2", "y2"))
        page = _numbers(page)
        low, wide = y1.min(), y2.max() - y1.min() + reach + 2
        last = np.searchsorted(page * wide + y1 - low, page * wide + y2 + reach + 0.5 - low)
        n = last - np.arange(len(page)) - 1
        for i, j in _chunks(n):
            a, b = _spread(np.arange(i, j) + 1, n[i:j])
            a += i
            near = (x1[a] - reach < x2[b]) & (x1[b] - reach < x2[a]) & (y1[b] - reach < y2[a])
            a, b = a[near], b[near]
            ids = rows["box_id"].to_numpy()
            turn, apart = ids[a] > ids[b], ids[a] != ids[b]
            a, b = np.where(turn, b, a)[apart], np.where(turn, a, b)[apart]
            sides = [rows.iloc[k][["box_id", *own]].set_axis([s, *[s + c for c in own]], axis=1).reset_index(drop=True) for s, k in (("a", a), ("b", b))]
            yield pd.concat([rows["page_id"].iloc[a].reset_index(drop=True), *sides], axis=1)

    schema = [f"page_id {kinds['page_id']}", *[f"{s} {kinds['box_id']}, " + ", ".join(f"{s}{c} {kinds[c]}" for c in own) for s in "ab"]]
    return by_page(boxes.where("x1 < x2 AND y1 < y2 AND box_id IS NOT NULL"), ["page_id"], swept, ", ".join(schema), "y1")


def _sided(pairs: DataFrame | None, boxes: DataFrame) -> DataFrame:
    """pairs(page_id, a, b), by default the near ones, with the columns of both boxes as ax1 .. bshare."""
    if pairs is None:
        return _beside(boxes)
    pairs = pairs.select("page_id", "a", "b")
    for side in "ab":
        pairs = pairs.join(boxes.select("page_id", F.col("box_id").alias(side), *[F.col(c).alias(side + c) for c in boxes.columns if c not in ("page_id", "box_id")]), ["page_id", side])
    return pairs


def container_veto(boxes: DataFrame, territory: DataFrame, inside: float = 0.6, outside: float = 0.15, pairs: DataFrame | None = None) -> DataFrame:
    """(page_id, a, b) of the pairs, by default all of a page, whose boxes are in different containers, or one
    inside and one outside."""
    told = box_coverage(boxes, territory)

    def veto(label_a, label_b, share_a, share_b):
        a_in, b_in, a_out, b_out = share_a >= inside, share_b >= inside, share_a <= outside, share_b <= outside
        return (a_in & b_in & (label_a != label_b)) | (a_in & b_out) | (a_out & b_in)

    def vetoed(rows: pd.DataFrame, page: np.ndarray) -> Iterator[pd.DataFrame]:
        label, share = rows["label"].to_numpy(), rows["share"].to_numpy()
        for a, b in _all_pairs(page, rows["box_id"]):
            off = veto(label[a], label[b], share[a], share[b])
            yield _named(rows, a[off], b[off])

    if pairs is not None:
        p = _sided(pairs, cut(told))
        return p.where(veto(*(F.col(c) for c in ("alabel", "blabel", "ashare", "bshare")))).select("page_id", "a", "b")
    return by_page(told.select("page_id", "box_id", "label", "share").dropna(subset=["box_id"]), ["page_id"], vetoed, _pair_schema(boxes), "box_id")


def _named(rows: pd.DataFrame, a: np.ndarray, b: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"page_id": rows["page_id"].to_numpy()[a], "a": rows["box_id"].to_numpy()[a], "b": rows["box_id"].to_numpy()[b]})


def _pair_schema(boxes: DataFrame) -> str:
    kinds = dict(boxes.dtypes)
    return f"page_id {kinds['page_id']}, a {kinds['box_id']}, b {kinds['box_id']}"


def _waists(rows: pd.DataFrame, page: np.ndarray) -> pd.DataFrame:
    """From the runs of labels and spans of columns: each span's least extent over the smaller one at its ends."""
    group, asked = _numbers(page), rows["asked"].to_numpy()
    y, x0, x1 = (rows[c].to_numpy(np.int64) for c in ("y", "x0", "x1"))
    g, left, right, extent = _envelope(group[~asked], y[~asked], x0[~asked], x1[~asked])
    at = np.flatnonzero(asked)
    first, after = np.searchsorted(g, group[at]), np.searchsorted(g, group[at], "right")
    at, first, last = at[after > first], first[after > first], after[after > first] - 1
    ends = [np.clip(x[at], left[first], right[last]) for x in (x0, x1)]
    low, wide = int(left.min(initial=0)), int(right.max(initial=0)) - int(left.min(initial=0)) + 2
    i, j = (np.searchsorted(g * wide + left - low, group[at] * wide + x - low, "right") - 1 for x in ends)
    thin = np.minimum(extent[i], extent[j])
    keep = (ends[1] - ends[0] >= WAIST_SPAN) & (thin > 0)
    return rows.iloc[at][["page_id", "a", "b"]].assign(ratio=_least(extent, i, j) / np.maximum(thin, 1))[keep]


def waist_veto(boxes: DataFrame, labelled: DataFrame, most: float = 0.85, pairs: DataFrame | None = None, pad: int = 14) -> DataFrame:
    """(page_id, a, b, ratio) of the pairs side by side in one component that is pinched between their centres.

    The span between two centres and the runs of its component meet in one stream; the least extent
    of a span comes from a table of minima over the component's stretches."""
    p = _sided(pairs, box_label(boxes, labelled, pad).select("page_id", "box_id", "x1", "y1", "x2", "y2", "label")).where("alabel = blabel AND alabel <> 0")
    centre = lambda s, c: F.floor((F.col(f"{s}{c}1") + F.col(f"{s}{c}2")) / 2).cast("int")
    p = p.select("page_id", "a", "b", F.col("alabel").alias("label"), *[centre(s, c).alias(s + c) for s in "ab" for c in "xy"]).where(f"abs(ax - bx) > abs(ay - by) AND abs(ax - bx) >= {WAIST_SPAN}")
    spans = p.select("page_id", "label", F.lit(True).alias("asked"), F.lit(0).alias("y"), F.least("ax", "bx").alias("x0"), F.greatest("ax", "bx").alias("x1"), "a", "b")
    kinds = dict(spans.dtypes)
    shapes = labelled.join(spans.select("page_id", "label").distinct(), ["page_id", "label"], "left_semi")
    rows = shapes.select("page_id", "label", F.lit(False).alias("asked"), "y", "x0", "x1", *[F.lit(0).cast(kinds[c]).alias(c) for c in "ab"]).union(spans)
    schema = f"page_id {kinds['page_id']}, a {kinds['a']}, b {kinds['b']}, ratio double"
    return by_page(rows, ["page_id", "label"], _waists, schema).where(F.col("ratio") <= most)


def _meet(row: np.ndarray, low: np.ndarray, high: np.ndarray, own: np.ndarray, x0: np.ndarray, x1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(stretch, run) for each run [x0, x1] of row `own` that meets a stretch [low, high] of row `row`; runs are sorted
    by row and x0."""
    if not len(own) or not len(row):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    base = int(x0.min()) - 1
    wide = max(int(x1.max()), int(x0.max())) - base + 2
    at = lambda x: np.clip(x - base, 0, wide - 1)
    ends = np.maximum.accumulate(own * wide + at(x1))
    first = np.searchsorted(ends, row * wide + np.maximum(at(low), 1), "left")
    stretch, run = _spread(first, np.searchsorted(own * wide + at(x0), row * wide + at(high), "right") - first)
    met = (x1[run] >= low[stretch]) & (x0[run] <= high[stretch])
    return stretch[met], run[met]


def _most(item: np.ndarray, label: np.ndarray, pixels: np.ndarray, n: int) -> np.ndarray:
    """The label that has most pixels of each of n items, ties the least; 0 for items without any."""
    best = np.zeros(n, np.int64)
    if len(item):
        names, code = np.unique(label, return_inverse=True)
        key, at = np.unique(item * len(names) + code, return_inverse=True)
        total = np.bincount(at, pixels)
        owner = key // len(names)
        order = np.lexsort((key, -total, owner))
        first = order[np.append(True, owner[order][1:] != owner[order][:-1])]
        best[owner[first]] = names[key[first] % len(names)]
    return best


def _paths(points: int, radius: int):
    def vetoed(rows: pd.DataFrame, page: np.ndarray) -> Iterator[pd.DataFrame]:
        page, asked = _numbers(page), rows["asked"].to_numpy()
        boxes = rows[asked].assign(of=page[asked]).sort_values(["of", "box_id"], kind="stable").reset_index(drop=True)
        runs, of = rows[~asked], boxes["of"].to_numpy()
        if not len(boxes) or not len(runs):
            return
        y, x0, x1, label = (runs[c].to_numpy(np.int64) for c in ("y", "x0", "x1", "label"))
        top, high = int(y.min()), int(y.max()) - int(y.min()) + 1
        own = page[~asked] * high + y - top
        cx, cy = ((boxes[low].to_numpy(float) + boxes[up].to_numpy(float)) / 2 for low, up in (("x0", "x1"), ("y", "y2")))
        ids, code = boxes["box_id"].to_numpy(), np.unique(boxes["box_id"].to_numpy(), return_inverse=True)[1]
        twin = np.append(False, (of[1:] == of[:-1]) & (ids[1:] == ids[:-1]))
        twin |= np.append(twin[1:], False)
        k = np.arange(points)
        for a, b in _all_pairs(of, boxes["box_id"], MOST_AT_ONCE // 8):
            if not len(a):
                continue
            x, y_ = (np.rint(c[a][:, None] + (c[b] - c[a])[:, None] * k / (points - 1)).astype(np.int64).ravel() for c in (cx, cy))
            # Patches at one place have one label; those of boxes that share an id count together.
            place = (np.repeat(of[a], points) * (np.ptp(y_) + 1) + y_ - y_.min()) * (np.ptp(x) + 1) + x - x.min()
            if (double := twin[a] | twin[b]).any():
                pair = np.unique(np.stack([of[a], code[a], code[b]]), axis=1, return_inverse=True)[1].ravel()
                place = np.where(np.repeat(double, points), -1 - (pair[:, None] * points + k).ravel(), place)
            _, one, patch = np.unique(place, return_index=True, return_inverse=True)
            looked = np.concatenate([one[place[one] >= 0], np.flatnonzero(place < 0)])
            row, line = np.repeat(looked, 2 * radius + 1), np.tile(np.arange(-radius, radius + 1), len(looked))
            line = y_[row] + line
            row, line = row[(line >= top) & (line < top + high)], line[(line >= top) & (line < top + high)]
            at, run = _meet(np.repeat(of[a], points)[row] * high + line - top, x[row] - radius, x[row] + radius, own, x0, x1)
            row = row[at]
            best = _most(patch[row], label[run], np.minimum(x1[run], x[row] + radius) - np.maximum(x0[run], x[row] - radius) + 1, len(one))
            seen = best[patch].reshape(len(a), points)
            off = np.where(seen == 0, np.iinfo(np.int64).max, seen).min(axis=1) < np.where(seen == 0, np.iinfo(np.int64).min, seen).max(axis=1)
            found = pd.DataFrame({"page_id": boxes["page_id"].to_numpy()[a[off]], "a": ids[a[off]], "b": ids[b[off]]})
            yield found.drop_duplicates() if twin.any() else found

    return vetoed


def path_label_veto(boxes: DataFrame, labelled: DataFrame, points: int = 9, radius: int = 3, pairs: DataFrame | None = None) -> DataFrame:
    """(page_id, a, b) of the pairs, by default all of a page, where the patches on the way between the centres have
    two labels or more."""
    if pairs is None:
        kinds = dict(boxes.dtypes)
        whole = boxes.dropna(subset=["box_id", "x1", "y1", "x2", "y2"])
        asked = whole.select("page_id", F.lit(True).alias("asked"), "box_id", F.lit(0).cast("bigint").alias("label"), F.col("y1").alias("y"), F.col("y2"), F.col("x1").alias("x0"), F.col("x2").alias("x1"))
        seen = labelled.select("page_id", F.lit(False).alias("asked"), F.lit(0).cast(kinds["box_id"]).alias("box_id"), "label", "y", F.col("y").alias("y2"), "x0", "x1")
        return by_page(seen.union(asked), ["page_id"], _paths(points, radius), _pair_schema(boxes), "y", "x0")
    p = _sided(pairs, boxes)
    centre = lambda s, c: (F.col(f"{s}{c}1") + F.col(f"{s}{c}2")) / 2
    at = p.select("page_id", "a", "b", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("k"), *[centre(s, c).alias(s + c) for s in "ab" for c in "xy"])
    step = lambda s: F.bround(F.col(f"a{s}") + (F.col(f"b{s}") - F.col(f"a{s}")) * F.col("k") / (points - 1)).cast("int")
    patches = at.select("page_id", "a", "b", "k", (step("x") - radius).alias("x1"), (step("y") - radius).alias("y1"), (step("x") + radius + 1).alias("x2"), (step("y") + radius + 1).alias("y2")).withColumn("box_id", F.struct("a", "b", "k"))
    seen = box_label(patches, labelled, pad=0).where("label <> 0")
    return seen.groupBy("page_id", "a", "b").agg(F.countDistinct("label").alias("labels")).where("labels >= 2").select("page_id", "a", "b")


def panel_borders(runs: DataFrame, across: Column, apart: int = 6, share: float = 0.4) -> DataFrame:
    """(page_id, pos): rows with a dark run of 40 % of the page's width; rows at most `apart` apart are one border."""
    long = runs.where(F.col("x1") - F.col("x0") + 1 >= F.greatest(F.lit(1), (across * share).cast("int"))).select("page_id", "y").distinct()
    w = Window.partitionBy("page_id").orderBy("y")
    marked = long.withColumn("new", F.when(F.col("y") - F.lag("y").over(w) <= apart, 0).otherwise(1)).withColumn("k", F.sum("new").over(w))
    return marked.groupBy("page_id", "k").agg(F.expr("(min(y) + max(y)) div 2").alias("pos")).drop("k")


def gap_profile_veto(bands: DataFrame, ink: DataFrame) -> DataFrame:
    """bands(page_id, gx1, gy1, gx2, gy2, tone) with veto: a row is more than 60 % ink, none is below 4 %, or the
    longest clear stretch is under a quarter of the band. Ink is dark on tones from 128, else light;
    null for bands under 4 px wide or 2 px high, or without a tone."""
    usable = F.col("tone").isNotNull() & (F.col("gx2") - F.col("gx1") >= 4) & (F.col("gy2") - F.col("gy1") >= 2)
    key = ["page_id", "gx1", "gy1", "gx2", "gy2", "tone"]
    dark = F.when(F.col("tone") >= 128, 1).otherwise(0).alias("dark")
    sides = [
        ink.where("level IN ('dark', 'light')").select("page_id", F.lit(0).alias("kind"), "y", F.col("x0").alias("gx1"), F.col("y").alias("gy1"), F.col("x1").alias("gx2"), F.col("y").alias("gy2"), F.lit(0).cast(bands.schema["tone"].dataType).alias("tone"), F.when(F.col("level") == "dark", 1).otherwise(0).alias("dark")),
        bands.where(usable).select(*key).distinct().select("page_id", F.lit(1).alias("kind"), F.col("gy1").alias("y"), *key[1:], dark),
    ]
    kinds = dict(bands.dtypes)
    told = by_page(sides[0].dropna().union(sides[1]), ["page_id"], _profiles, ", ".join([*(f"{k} {kinds[k]}" for k in key), "veto boolean"]), "kind", "dark", "y")
    return bands.join(told, key, "left")  # bands without a tone have no veto


ROWS_AT_ONCE = 1 << 16  # of bands, laid out together


def _profiles(rows: pd.DataFrame, page: np.ndarray) -> Iterator[pd.DataFrame]:
    """Vetoes of whole pages' bands: each of a band's rows meets the runs of its page, level and row by a search."""
    kind, y, x0, x1, y1, dark = (rows[c].to_numpy(np.int64) for c in ("kind", "y", "gx1", "gx2", "gy2", "dark"))
    if not (kind == 1).any():
        return
    least = y.min()
    span = max(y.max(), y1.max()) - least + 1
    line = (page.astype(np.int64) * 2 + dark) * span + y - least
    ink = np.flatnonzero(kind == 0)  # by page, level and row
    bands = np.flatnonzero(kind == 1)
    high = y1[bands] - y[bands]
    total = np.cumsum(high)
    begin = 0
    while begin < len(bands):
        stop = max(begin + 1, int(np.searchsorted(total, total[begin] - high[begin] + ROWS_AT_ONCE, "right")))
        some, n = bands[begin:stop], high[begin:stop]
        start = np.cumsum(n) - n
        of = np.repeat(some, n)
        at = line[of] + np.arange(len(of)) - np.repeat(start, n)
        low = np.searchsorted(line[ink], at, "left")
        met = np.searchsorted(line[ink], at, "right") - low
        row = np.repeat(np.arange(len(of)), met)
        run = ink[np.arange(len(row)) - np.repeat(np.cumsum(met) - met, met) + np.repeat(low, met)]
        both = np.maximum(0, np.minimum(x1[run] + 1, x1[of[row]]) - np.maximum(x0[run], x0[of[row]]))
        share = np.bincount(row, both, len(of)) / (x1[of] - x0[of])
        last = np.where(share < 0.04, np.repeat(start, n) - 1, np.arange(len(of)))  # row that isn't clear
        clear = np.maximum.reduceat(np.arange(len(of)) - np.maximum.accumulate(last), start)
        veto = (np.maximum.reduceat(share, start) > 0.6) | (clear == 0) | (clear < 0.25 * n)
        yield rows.iloc[some][["page_id", "gx1", "gy1", "gx2", "gy2", "tone"]].assign(veto=veto)
        begin = stop


_OPEN = np.int64(1 << 31)  # stands for an end that isn't known


def _united(row: np.ndarray, x0: np.ndarray, x1: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of a row that overlap or touch, as one, by row and x0."""
    if not len(row):
        return row, x0, x1
    order = np.lexsort((x0, row))
    row, x0, x1 = row[order], x0[order], x1[order]
    low = int(x0.min())
    wide = int(x1.max()) - low + 3
    reach = np.maximum.accumulate(row * wide + x1 - low)
    fresh = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (row[1:] * wide + x0[1:] - low > reach[:-1] + 1)))
    return row[fresh], x0[fresh], np.maximum.reduceat(x1, fresh)


def _left(rows: pd.DataFrame, page: np.ndarray) -> Iterator[pd.DataFrame]:
    """What boxes of a band have of both kinds of runs, some boxes at a time: pixels and the largest blob, or, of boxes
    that go on in another band, the runs."""
    page, kind = _numbers(page), rows["kind"].to_numpy()
    top = rows["band"].to_numpy(np.int64) * BAND
    line, x0, x1 = page * BAND + rows["y"].to_numpy(np.int64) - top, rows["x0"].to_numpy(np.int64), rows["x1"].to_numpy(np.int64)
    before, after, asked = (np.flatnonzero(kind == k) for k in range(3))
    if not len(before) or not len(after) or not len(asked):
        return
    shared = []
    for at in range(0, len(before), MOST_AT_ONCE >> 4):
        some = before[at : at + (MOST_AT_ONCE >> 4)]
        i, j = _meet(line[some], x0[some], x1[some], line[after], x0[after], x1[after])
        i, j = some[i], after[j]
        low, high = np.maximum(x0[i], x0[j]), np.minimum(x1[i], x1[j])
        both = (low <= high) & (low > -_OPEN) & (high < _OPEN)
        shared.append((line[i[both]], low[both], high[both]))
    own, x0, x1 = _united(*(np.concatenate(c) for c in zip(*shared, strict=True)))
    boxes = rows.iloc[asked]
    names = boxes["box_id"].to_numpy()
    order = np.lexsort((names, page[asked]))
    boxes, names, of, top = boxes.iloc[order], names[order], page[asked][order], top[asked][order]
    fresh = np.append(True, (of[1:] != of[:-1]) | (names[1:] != names[:-1]))
    code, first = np.cumsum(fresh) - 1, np.flatnonzero(fresh)  # boxes of one name are one
    t, d = (np.clip(boxes[c].to_numpy(np.int64) - top, 0, BAND) for c in ("y", "y2"))
    l, r, goes_on = boxes["x0"].to_numpy(np.int64), boxes["x1"].to_numpy(np.int64), np.maximum.reduceat(boxes["goes_on"].to_numpy(), first)
    for c, e in _chunks(np.add.reduceat(np.maximum(d - t, 0), first)):
        some = np.arange(first[c], first[e] if e < len(first) else len(boxes))
        box, y = _spread(t[some], (d - t)[some])
        box = some[box]
        at, run = _meet(of[box] * BAND + y, l[box], r[box] - 1, own, x0, x1)
        row, low, high = _united(code[box[at]] * (BAND + 1) + y[at], np.maximum(x0[run], l[box[at]]), np.minimum(x1[run], r[box[at]] - 1))
        if not len(row):
            continue
        which, n = row // (BAND + 1), high - low + 1
        told = boxes.iloc[first[c:e]][["page_id", "box_id"]]
        part = _touching(row, low, high, 1)
        size = np.bincount(part, n, len(row)).astype(np.int64)
        blob = np.zeros(e - c, np.int64)
        np.maximum.at(blob, which - c, size)
        ended = ~goes_on[c:e] & (blob > 0)
        yield told[ended].assign(pixels=np.bincount(which - c, n, e - c).astype(np.int64)[ended], blob=blob[ended], y=None, x0=None, x1=None)
        more = goes_on[which]
        if more.any():
            which = which[more]
            yield told.iloc[which - c].assign(pixels=None, blob=None, y=row[more] % (BAND + 1) + top[first[which]], x0=low[more], x1=high[more])


def residual_check(before: DataFrame, after: DataFrame, boxes: DataFrame, share: float = 0.006, blob: int = 12) -> DataFrame:
    """boxes with pixels that are off the tone both before and after, their share, the largest blob and the flag.

    Runs and boxes meet once, in bands of BAND rows, and blobs are counted there; of boxes that reach over a band's
    end the runs go on, and are labelled across bands."""
    kinds = dict(boxes.dtypes)
    floor = lambda c: F.floor(c / BAND)
    own = boxes.dropna(subset=["page_id", "box_id"]).where("x1 < x2 AND y1 < y2")
    low, high = floor(F.col("y1")), floor(F.col("y2") - 1)
    asked = own.select("page_id", F.explode(F.sequence(low, high)).alias("band"), F.lit(2).alias("kind"), "box_id", (low < high).alias("goes_on"), F.col("y1").alias("y"), "y2", F.col("x1").alias("x0"), F.col("x2").alias("x1"))
    end = lambda c, n: F.coalesce(F.col(c).cast("bigint"), F.lit(int(n))).alias(c)
    side = lambda df, n: df.dropna(subset=["page_id", "y"]).select("page_id", floor(F.col("y")).alias("band"), F.lit(n).alias("kind"), F.lit(0).cast(kinds["box_id"]).alias("box_id"), F.lit(False).alias("goes_on"), "y", F.col("y").alias("y2"), end("x0", -_OPEN), end("x1", _OPEN))
    columns = ["page_id", "box_id", "pixels", "blob", "y", "x0", "x1"]
    schema = f"page_id {kinds['page_id']}, box_id {kinds['box_id']}, pixels bigint, blob bigint, y bigint, x0 bigint, x1 bigint"
    met = kept(by_page(side(before, 0).union(side(after, 1)).union(asked), ["page_id", "band"], lambda rows, page: (part[columns] for part in _left(rows, page)), schema, "y", "x0"))
    found, runs = met.where("y IS NULL").select("page_id", "box_id", "pixels", "blob"), met.where("y IS NOT NULL")
    if not runs.isEmpty():
        name = F.concat_ws(":", "page_id", "box_id")
        labelled = components_of_runs(runs.select(name.alias("page_id"), "y", "x0", "x1"))
        sizes = labelled.groupBy("page_id", "label").agg(F.sum(F.col("x1") - F.col("x0") + 1).alias("n")).groupBy("page_id").agg(F.sum("n").alias("pixels"), F.max("n").alias("blob"))
        found = found.union(sizes.select(F.substring_index("page_id", ":", 1).cast(kinds["page_id"]), F.substring_index("page_id", ":", -1).cast(kinds["box_id"]), "pixels", "blob"))
    total = found.groupBy("page_id", "box_id").agg(F.sum("pixels").alias("pixels"), F.max("blob").alias("blob"))
    told = boxes.join(total.hint("merge"), ["page_id", "box_id"], "left").na.fill(0, ["pixels", "blob"])  # its rows are many times their file
    part = F.try_divide(F.col("pixels").cast("double"), (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1")))
    return told.withColumn("share", F.round(part, 6)).withColumn("flagged", (part >= share) | (F.col("blob") >= blob))
