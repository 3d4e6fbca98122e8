"""Table functions over files: archive entries, image runs, OCR by the user's engine."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagetext.operators.graph import cut


def expand_archives(files: DataFrame) -> DataFrame:
    """(archive, path, content, error): one row an entry of files(path, content), zip or cbz; an archive
    that can't be read gives one row with its error, not a failed job."""

    def entries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for name, data in zip(rows["path"], rows["content"], strict=True):
                try:
                    with zipfile.ZipFile(io.BytesIO(data)) as archive:
                        for entry in archive.infolist():
                            if not entry.is_dir():
                                yield pd.DataFrame({"archive": [name], "path": [entry.filename], "content": [archive.read(entry)], "error": [None]})
                except (zipfile.BadZipFile, RuntimeError, NotImplementedError, TypeError, OSError) as error:
                    yield pd.DataFrame({"archive": [name], "path": [None], "content": [None], "error": [f"{type(error).__name__}: {error}"]})

    return files.select("path", "content").mapInPandas(entries, "archive string, path string, content binary, error string")


PIXELS_AT_ONCE = 1 << 22


def image_runs(images: DataFrame, threshold: int, dark: bool = True, down: bool = False) -> DataFrame:
    """(page_id, y, x0, x1) of grey levels below (dark) or above the threshold, along rows or columns, of
    images(page_id, width, height, channels, data) as Spark's image source decodes them (BGR).
    Images of one size are looked at together, up to PIXELS_AT_ONCE values."""

    def runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for (w, h, c), alike in rows.groupby(["width", "height", "channels"], sort=False):
                step = max(PIXELS_AT_ONCE // max(w * h * c, 1), 1)
                for first in range(0, len(alike), step):
                    part = alike.iloc[first : first + step]
                    px = np.frombuffer(b"".join(part["data"]), np.uint8).reshape(len(part), h, w, c)
                    grey = px[..., 0].astype(np.int16) if c == 1 else px[..., :3].astype(float) @ [0.114, 0.587, 0.299]
                    ink = (grey < threshold) if dark else (grey > threshold)
                    ink = np.pad(ink.swapaxes(1, 2) if down else ink, ((0, 0), (0, 0), (1, 1))).astype(np.int8)
                    edge = np.diff(ink, axis=2)
                    image, y, x0 = np.nonzero(edge == 1)
                    x1 = np.nonzero(edge == -1)[2] - 1
                    yield pd.DataFrame({"page_id": part["page_id"].to_numpy()[image], "y": y.astype(np.int32), "x0": x0.astype(np.int32), "x1": x1.astype(np.int32)})

    return images.select("page_id", "width", "height", "channels", "data").mapInPandas(runs, "page_id bigint, y int, x0 int, x1 int")


FRAGMENT = "page_id bigint, frag_id int, x1 double, y1 double, x2 double, y2 double, text string, conf double, reason string"
LEAST_RETRY_FLOOR = 0.20


FRAGMENTS_AT_ONCE = 10_000


def ocr_pages(images: DataFrame, engine: Callable[[bytes, float], list[tuple]], fallback: Callable[[bytes, float], list[tuple]], min_conf: float = 0.35) -> DataFrame:
    """Fragments of images(page_id, content) by the user's engine(content, floor), a list of (x1, y1, x2, y2,
    text, conf). Pages without any are read again, where they are, by the fallback at a floor lower by
    0.05; a page that fails or stays empty has one row with the reason."""
    columns = [c.split()[0] for c in FRAGMENT.split(", ")]
    again = max(min_conf - 0.05, LEAST_RETRY_FLOOR)

    def read(page, content) -> list[tuple]:
        try:
            found = [f for f in engine(content, min_conf) if f[5] >= min_conf] or [f for f in fallback(content, again) if f[5] >= again]
            why = "empty"
        except Exception as error:  # noqa: BLE001  the page's own outcome
            found, why = [], f"error: {error}"
        return [(page, i, *f, None) for i, f in enumerate(found)] or [(page, None, None, None, None, None, None, None, why)]

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []
        for rows in batches:
            for page, content in zip(rows["page_id"].astype(object), rows["content"], strict=True):
                out += read(page, content)
                if len(out) >= FRAGMENTS_AT_ONCE:
                    yield frame(out)
                    out = []
        if out:
            yield frame(out)

    def frame(out: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(out, columns=columns).astype({"page_id": "Int64", "frag_id": "Int32"})

    return cut(images.select("page_id", "content").mapInPandas(work, FRAGMENT))  # once read, no page is read again, whatever is lost


def failure_counts(fragments: DataFrame) -> DataFrame:
    """Pages by reason of failure."""
    return fragments.where("reason IS NOT NULL").groupBy(F.split_part("reason", F.lit(":"), F.lit(1)).alias("reason")).agg(F.countDistinct("page_id").alias("pages"))
