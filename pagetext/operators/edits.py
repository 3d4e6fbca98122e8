"""Corrections of a page's regions: split, join, edit logs and manual orders.

Regions are rows (page_id, region_id, pos, text, tl, t, x1, y1, x2, y2, members), `pos` their place on
the page and `members` an array of (id, text, x1, y1, x2, y2)."""

from __future__ import annotations

from itertools import groupby
from operator import itemgetter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagetext.operators.graph import by_page
from pagetext.sources.batches import write_batch

BLANK = "—"
MEMBERS = "array<struct<id:bigint,text:string,x1:double,y1:double,x2:double,y2:double>>"
REGION = f"page_id bigint, region_id bigint, pos int, text string, tl string, t string, x1 double, y1 double, x2 double, y2 double, members {MEMBERS}"
COLUMNS = [c.split()[0] for c in REGION.split(", ")]
BOX = ("x1", "y1", "x2", "y2")


def _union_box(members: Column) -> dict[str, Column]:
    side = lambda c: F.transform(members, lambda m: m[c])
    return {c: F.array_min(side(c)) if c[1] == "1" else F.array_max(side(c)) for c in BOX}


def _replaced(regions: DataFrame) -> DataFrame:
    """Places from 0 again, in the order of `pos` and then of `part`."""
    place = F.row_number().over(Window.partitionBy("page_id").orderBy("pos", "part")) - 1
    return regions.withColumn("pos", place).select(*COLUMNS)


def split_regions(regions: DataFrame, splits: DataFrame) -> DataFrame:
    """regions with those of splits(page_id, region_id, after, new_id) cut in two: members by top edge, the
    first after + 1 of them stay, the others become new_id, right behind. Texts are joined by blanks,
    boxes are the members', translations are reset. A cut that leaves a side empty does nothing."""
    told = regions.join(splits, ["page_id", "region_id"], "left")
    ordered = F.transform(F.array_sort(F.transform("members", lambda m, i: F.struct(m["y1"].alias("top"), i.alias("i"), m.alias("m")))), lambda x: x["m"])
    n = F.col("after") + 1
    cut = told.withColumn("sorted", ordered).withColumn("cut", F.coalesce((n >= 1) & (n < F.size("members")), F.lit(False)))
    parts = F.array(F.struct(F.lit(0).alias("part"), F.slice("sorted", F.lit(1), F.greatest(n, F.lit(0))).alias("own")), F.struct(F.lit(1).alias("part"), F.slice("sorted", F.greatest(n, F.lit(0)) + 1, F.size("sorted")).alias("own")))
    halves = cut.where("cut").withColumn("p", F.explode(parts)).select("page_id", F.when(F.col("p.part") == 0, F.col("region_id")).otherwise(F.col("new_id")).alias("region_id"), "pos", F.array_join(F.transform("p.own", lambda m: m["text"]), " ").alias("text"), F.lit(BLANK).alias("tl"), "t", *[v.alias(c) for c, v in _union_box(F.col("p.own")).items()], F.col("p.own").alias("members"), "p.part")
    return _replaced(cut.where("NOT cut").select(*COLUMNS, F.lit(0).alias("part")).union(halves))


def join_regions(regions: DataFrame, joins: DataFrame) -> DataFrame:
    """regions with other_id of joins(page_id, region_id, other_id) taken into region_id: texts that aren't
    empty joined by a blank, the union of the boxes, members of both, the translation reset. A pair of
    which a side is missing, or that is one region, does nothing; a region is in one pair at most."""
    other = regions.select("page_id", F.col("region_id").alias("other_id"), F.struct("text", "members", *BOX).alias("o"))
    met = joins.where("region_id <> other_id").join(other, ["page_id", "other_id"]).join(regions.select("page_id", "region_id"), ["page_id", "region_id"], "left_semi")
    told = regions.join(met.select("page_id", "region_id", "o"), ["page_id", "region_id"], "left").join(met.select("page_id", F.col("other_id").alias("region_id")), ["page_id", "region_id"], "left_anti")
    joined = F.col("o").isNotNull()
    filled = F.filter(F.array("text", "o.text"), lambda t: F.coalesce(t, F.lit("")) != "")
    text = F.when(joined, F.array_join(filled, " ")).otherwise(F.col("text"))
    box = {c: F.when(joined, (F.least if c[1] == "1" else F.greatest)(c, f"o.{c}")).otherwise(F.col(c)) for c in BOX}
    return _replaced(told.select("page_id", "region_id", "pos", text.alias("text"), F.when(joined, BLANK).otherwise(F.col("tl")).alias("tl"), "t", *[v.alias(c) for c, v in box.items()], F.when(joined, F.concat("members", "o.members")).otherwise(F.col("members")).alias("members"), F.lit(0).alias("part")))


def manual_order(regions: DataFrame, orders: DataFrame) -> DataFrame:
    """regions in the order of orders(page_id, places), a list of their places from 0: places that no region
    has are dropped, and so are regions that the list leaves out. Pages without a list stay."""
    listed = orders.select("page_id", F.posexplode("places").alias("at", "pos"))
    kept = regions.join(listed, ["page_id", "pos"]).withColumn("pos", F.col("at"))
    rest = regions.join(orders.select("page_id"), "page_id", "left_anti")
    return _replaced(kept.select(*COLUMNS, F.lit(0).alias("part")).union(rest.select(*COLUMNS, F.lit(0).alias("part"))))


def moved(places: Column, moves: Column) -> Column:
    """A list of places after moves(seq, at, by) in turn: what stands `at` changes with its neighbour; moves
    beyond an end do nothing."""

    def move(list_: Column, m: Column) -> Column:
        at, to = m["at"], m["at"] + m["by"]
        swapped = F.transform(list_, lambda x, i: F.when(i == at, F.get(list_, to)).when(i == to, F.get(list_, at)).otherwise(x))
        return F.when((at >= 0) & (at < F.size(list_)) & (to >= 0) & (to < F.size(list_)), swapped).otherwise(list_)

    return F.aggregate(F.array_sort(moves), places, move)


def _box(members: list[dict]) -> dict[str, float]:
    return {c: (min if c[1] == "1" else max)(m[c] for m in members) for c in BOX}


def _replay(regions: list[dict], edits: list[dict]) -> list[dict]:
    """One page's regions after its edits, one by one."""
    for e in edits:
        at = next((i for i, r in enumerate(regions) if r["region_id"] == e["region_id"] and not r.get("gone")), None)
        kind = e["kind"]
        if kind == "add" and at is None:
            regions.append({"region_id": e["region_id"], "text": e["text"], "tl": BLANK, "t": "speech", "members": [], **{c: e[c] for c in BOX}})
        elif at is None:
            continue
        elif kind == "text":
            regions[at] |= {"text": e["text"], "tl": BLANK}
        elif kind == "delete":
            regions[at]["gone"] = True
        elif kind == "reorder":
            live = [i for i, r in enumerate(regions) if not r.get("gone")]
            to = live.index(at) + int(e["by"])
            if 0 <= to < len(live):
                regions[at], regions[live[to]] = regions[live[to]], regions[at]
        elif kind == "split":
            own = sorted(regions[at]["members"], key=lambda m: m["y1"])
            first, rest = own[: int(e["after"]) + 1], own[int(e["after"]) + 1 :]
            if first and rest:
                make = lambda group, name, old=regions[at]: {"region_id": name, "text": " ".join(m["text"] for m in group), "tl": BLANK, "t": old["t"], "members": group, **_box(group)}
                regions[at : at + 1] = [make(first, e["region_id"]), make(rest, e["other_id"])]
        elif kind == "join":
            other = next((i for i, r in enumerate(regions) if r["region_id"] == e["other_id"] and i != at and not r.get("gone")), None)
            if other is not None:
                a, b = regions[at], regions[other]
                a |= {"text": " ".join(t for t in (a["text"], b["text"]) if t), "tl": BLANK, "members": [*a["members"], *b["members"]], **_box([a, b])}
                del regions[other]
    return [r for r in regions if not r.get("gone")]


EDIT = "page_id bigint, seq bigint, region_id bigint, kind string, text string, other_id bigint, after int, by int, x1 double, y1 double, x2 double, y2 double"


def replay_edits(regions: DataFrame, edits: DataFrame) -> DataFrame:
    """regions after a log of edits(page_id, seq, region_id, kind, text, other_id, after, by, x1 .. y2), page
    by page in the order of seq: text (the translation is reset), add, delete, reorder (change places
    with a live neighbour), split and join. Edits of regions that aren't there do nothing; an add of
    one that is there neither. Pages without edits don't pass through Python."""
    touched = edits.select("page_id").distinct()
    log = edits.select("page_id", "seq", "kind", "region_id", F.lit(None).cast("int").alias("pos"), "text", F.lit(None).cast("string").alias("tl"), F.lit(None).cast("string").alias("t"), *BOX, F.lit(None).cast(MEMBERS).alias("members"), "other_id", "after", "by")
    changed = regions.join(touched, "page_id", "left_semi").select(*COLUMNS)
    rows = changed.select(*[F.col(c) if c in COLUMNS else F.lit(None).cast(log.schema[c].dataType).alias(c) for c in log.columns])

    def work(part: pd.DataFrame, page: np.ndarray) -> pd.DataFrame:
        out = []
        for _, records in groupby(zip(page.tolist(), part.to_dict("records"), strict=True), key=itemgetter(0)):
            own, told = [], []
            for _, r in records:
                (told if r["kind"] is not None else own).append(r)
            for r in own:
                r["members"] = [m if isinstance(m, dict) else m.asDict() for m in (r["members"] if r["members"] is not None else [])]
            name = (own or told)[0]["page_id"]
            out += [{**{c: r[c] for c in COLUMNS if c not in ("page_id", "pos")}, "page_id": name, "pos": i} for i, r in enumerate(_replay(own, told))]
        return pd.DataFrame(out, columns=COLUMNS)

    replayed = by_page(rows.unionByName(log), ["page_id"], work, REGION, "seq", "pos")
    return regions.join(touched, "page_id", "left_anti").select(*COLUMNS).union(replayed)


def cacheable(rows: DataFrame, chapters: DataFrame) -> DataFrame:
    """rows of the chapters whose pages survive a reload (chapters(chapter_id, cacheable))."""
    return rows.join(chapters.where("cacheable").select("chapter_id"), "chapter_id", "left_semi")


def write_regions(regions: DataFrame, chapters: DataFrame, path: str, batch: int | str, buckets: int = 256) -> None:
    """Cacheable chapters' regions as Parquet, in folders of a hash of the chapter, as a batch of the table: a
    retry of the batch writes it over. read_batches reads the table."""
    kept = cacheable(regions, chapters).withColumn("bucket", F.pmod(F.xxhash64("chapter_id"), F.lit(buckets)).cast("int"))
    write_batch(kept.repartition("bucket"), path, batch, "bucket")


def write_spend(spend: DataFrame, path: str, batch: int | str) -> None:
    """Priced calls as Parquet, in folders by day, as a batch of the table; every chapter's, cacheable or not."""
    write_batch(spend.withColumn("day", F.to_date("ts")).repartition("day"), path, batch, "day")
