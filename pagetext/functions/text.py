"""Text functions that Spark has no builtin for, as Arrow functions."""

from __future__ import annotations

import difflib

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from pagetext.functions.alike import folded


@F.pandas_udf(StringType())
def _folded(texts: pd.Series) -> pd.Series:
    there = texts.notna().to_numpy()
    out = pd.Series([None] * len(texts), dtype=object)
    out[there] = [t.decode() for t in folded(texts[there].tolist())]
    return out


def fold_text(c: Column) -> Column:
    """NFKD without combining marks, lower case, letters a-z and digits alone."""
    return _folded(c)


@F.pandas_udf(DoubleType())
def ratcliff(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp similarity of each pair."""
    return pd.Series([0.0 if x is None or y is None else difflib.SequenceMatcher(None, x, y, autojunk=False).ratio() for x, y in zip(a, b, strict=True)])


def levenshtein_ratio(a: Column, b: Column) -> Column:
    far = F.when(a == b, F.lit(0)).otherwise(F.levenshtein(a, b))  # equal texts need no table
    return 1 - F.try_divide(far.cast("double"), F.greatest(F.length(a), F.length(b)))


_KIND = np.zeros(0x110000, np.int8)  # 1: letters, 2: marked ones (precomposed Latin letters)
for _first, _last, _kind in (("A", "Z", 1), ("a", "z", 1), ("À", "ɏ", 2), ("Ḁ", "ỿ", 2)):
    _KIND[ord(_first) : ord(_last) + 1] = _kind


@F.pandas_udf(StructType([StructField("marked", LongType()), StructField("letters", LongType())]))
def letter_counts(texts: pd.Series) -> pd.DataFrame:
    """How many letters each text has, and how many of them carry a mark; nulls for null."""
    there = texts.notna().to_numpy()
    whole = texts[there].tolist()
    kind = _KIND[np.frombuffer("".join(whole).encode("utf-32-le", "surrogatepass"), np.uint32)]
    ends = np.cumsum([0, *map(len, whole)])
    out = {}
    for name, found in (("marked", kind == 2), ("letters", kind > 0)):
        upto = np.concatenate([[0], np.cumsum(found)])[ends]
        n = pd.array([None] * len(texts), dtype="Int64")
        n[there] = np.diff(upto)
        out[name] = n
    return pd.DataFrame(out)


def marked_share(c: Column) -> Column:
    """Share of letters that carry a mark (precomposed Latin letters)."""
    n = letter_counts(c)
    return F.try_divide(n["marked"].cast("double"), n["letters"])
