"""Queries over table functions: archives, images, engines and model calls made from the given tables, with
their DuckDB equivalents."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F

from pagetext.operators import replies
from pagetext.plans.fixtures import table
from pagetext.plans.replies import SENT, _sent
from pagetext.sources import tables as op

LINE = "[^\\n]+"


def _zipped(rows: pd.DataFrame) -> pd.DataFrame:
    """One archive of a group of documents; every fifth is broken."""
    group = int(rows["group"].iloc[0])
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("folder/", "")
        for doc, text in zip(rows["doc_id"], rows["text"], strict=True):
            z.writestr(f"folder/p{doc}.txt", text or "")
    return pd.DataFrame({"path": [f"{group}.cbz"], "content": [b"broken" if group % 5 == 0 else data.getvalue()]})


def expand_archives(s, d):
    docs = table(s, d, "documents").select(F.floor(F.col("doc_id") / 8).alias("group"), "doc_id", "text")
    files = docs.groupBy("group").applyInPandas(_zipped, "path string, content binary")
    found = op.expand_archives(files)
    return found.select("archive", "path", F.md5("content").alias("md5"), F.split_part("error", F.lit(":"), F.lit(1)).alias("error"))


def image_runs(s, d):
    """Pictures of 16 pixels' width, a row for each line of an order: the bytes of a digest."""
    rows = table(s, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.md5(F.concat_ws("-", "l_partkey", "l_suppkey")))).alias("rows"))
    images = rows.select(F.col("l_orderkey").alias("page_id"), F.lit(16).alias("width"), F.size("rows").alias("height"), F.lit(1).alias("channels"), F.unhex(F.array_join("rows", "")).alias("data"))
    return op.image_runs(images, 128)


def _engine(content: bytes, floor: float) -> list[tuple]:
    """A fragment for each line; the confidence comes from its length."""
    lines = [t for t in content.decode().split("\n") if t]
    if content.startswith(b"Q"):
        raise ValueError("unreadable")
    return [(0.0, float(i), float(len(t)), i + 1.0, t, len(t) % 40 / 100) for i, t in enumerate(lines)]


def ocr_pages(s, d):
    images = table(s, d, "documents").select(F.col("doc_id").alias("page_id"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("content"))
    return op.ocr_pages(images, _engine, _engine, min_conf=0.38).select("page_id", "text", F.round("conf", 6).alias("conf"), "reason")


def _call(instruction: str, items: str) -> str:
    if instruction.endswith("1"):
        raise ValueError("refused")
    if instruction.endswith("2"):
        raise ConnectionError("429")
    return f"<{items}>"


def translate_pages(s, d):
    asked = _sent(s, d).select("reply_id", F.concat(F.lit("say "), F.pmod("reply_id", F.lit(5)).cast("string")).alias("instruction"), F.concat_ws("|", "i", "text").alias("items"))
    return replies.translate_pages(asked, _call, delays=(0.0,)).select("reply_id", "items", "body", "status", "reason")


QUERIES = {f.__name__: f for f in (expand_archives, image_runs, ocr_pages, translate_pages)}

ORACLES = {
    "expand_archives": """WITH g AS (SELECT doc_id, coalesce(text, '') AS text, CAST(floor(doc_id / 8) AS BIGINT) AS n FROM documents)
SELECT n || '.cbz' AS archive, 'folder/p' || doc_id || '.txt' AS path, md5(text) AS md5, NULL AS error FROM g WHERE n % 5 <> 0 UNION ALL SELECT DISTINCT n || '.cbz', NULL, NULL, 'BadZipFile' FROM g WHERE n % 5 = 0""",
    "image_runs": """WITH r AS (SELECT l_orderkey AS page_id, md5(l_partkey || '-' || l_suppkey) AS m FROM lineitem), n AS (SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY m) - 1 AS INT) AS y, m FROM r),
p AS (SELECT page_id, y, m, unnest(range(16)) AS x FROM n), k AS (SELECT page_id, y, x, x - row_number() OVER (PARTITION BY page_id, y ORDER BY x) AS island FROM p WHERE substr(m, CAST(2 * x + 1 AS INT), 1) < '8')
SELECT page_id, y, CAST(min(x) AS INT) AS x0, CAST(max(x) AS INT) AS x1 FROM k GROUP BY page_id, y, island""",
    "ocr_pages": f"""WITH d AS (SELECT doc_id AS page_id, coalesce(text, '') AS text FROM documents), l AS (SELECT page_id, unnest(regexp_extract_all(text, '{LINE}')) AS text FROM d WHERE NOT starts_with(text, 'Q')),
c AS (SELECT page_id, text, length(text) % 40 / 100.0::DOUBLE AS conf FROM l), m AS (SELECT page_id, max(conf) AS top FROM c GROUP BY 1), f AS (SELECT d.page_id, starts_with(d.text, 'Q') AS bad, CASE WHEN top >= 0.38 THEN 0.38::DOUBLE ELSE 0.38::DOUBLE - 0.05 END AS floor, coalesce(top, -1) AS top FROM d LEFT JOIN m USING (page_id))
SELECT page_id, c.text, round(conf, 6) AS conf, NULL AS reason FROM c JOIN f USING (page_id) WHERE conf >= floor UNION ALL SELECT page_id, NULL, NULL, CASE WHEN bad THEN 'error: unreadable' ELSE 'empty' END FROM f WHERE bad OR top < floor""",
    "translate_pages": f"""WITH s AS (SELECT reply_id, i || '|' || text AS items, reply_id % 5 AS k FROM ({SENT}))
SELECT reply_id, items, CASE WHEN k NOT IN (1, 2) THEN '<' || items || '>' END AS body, CASE WHEN k IN (1, 2) THEN 'error' ELSE 'ok' END AS status, CASE k WHEN 1 THEN 'ValueError: refused' WHEN 2 THEN '429' END AS reason FROM s""",
}
