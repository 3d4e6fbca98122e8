"""Suffix-array dedup: bytes covered by a long string that also starts elsewhere.

A suffix array of every byte is far beyond the machine time allowed, so the array is sparse: it
holds the suffixes that start at anchors, places whose next bytes hash below a bound. Anchors
depend on content alone, so two copies of a window have the same first anchor at the same offset.
Suffixes are ordered by the hash of their first KEY bytes and of the whole stretch that their
windows span. Hash-partitioned parts of the array are kept as families of sorted levels: each new
batch is sorted and merge-scanned against the levels that are there, then levels of like size merge.
Stretches equal as a whole are repeated; where only the keys agree, the windows are compared one
by one in a second pass. Passages of so many words go the same way, over one hash a word.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagetext.llm._arrays import SLICE_BYTES, buffers, mix, packed, powers, slices, spans, word_hashes
from pagetext.llm._store import dropped, numbered, stored

LENGTH = 400
PASSAGE_WORDS = 51
BYTES_IN_TASK = 32 << 20  # of text whose suffixes one task sorts, about
_EXACT = np.arange(256, dtype=np.uint8)
_LOOSE = np.uint64(0xA5A5_1234_9876_5A5B)


@dataclass(frozen=True)
class _Shape:
    """Windows of `length` bytes, or of as many words."""

    length: int
    words: bool = False

    def __post_init__(self):
        if not 8 <= self.length <= 1024:
            raise ValueError(f"windows of {self.length}: 8 to 1024 can be had")

    @property
    def key(self) -> int:
        return self.length // 4

    @property
    def gram(self) -> int:
        return min(12, self.key)

    @property
    def spacing(self) -> int:
        return self.length // 8

    @property
    def farthest(self) -> int:
        """Of an anchor from the start of its windows."""
        return self.length - self.key

    def units(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Bytes or word hashes of all rows, and the n + 1 offsets."""
        data, at = buffers(column)
        if not self.words:
            return data, at
        starts, ends, row = spans(data, at)
        return word_hashes(data, starts, ends, _EXACT), np.searchsorted(row, np.arange(len(column) + 1))


class _Bytes:
    """Hashes of any stretch of a byte string, or of word hashes."""

    def __init__(self, data: np.ndarray):
        self.up, self.down = powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.up[:-1], out=self.sums[1:])

    def hash(self, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        return mix((self.sums[e] - self.sums[s]) * self.down[s])


def _pieces(at: np.ndarray, most: int, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first byte and end of stretches of at most `most` window starts each."""
    n = np.maximum(np.diff(at) - (length - 1), 0)
    per = -(-n // most)
    row = np.repeat(np.arange(len(n)), per)
    k = np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)
    low = at[row] + k * most
    return row, low, np.minimum(low + most + length - 1, at[row + 1])


def _suffixes(data: np.ndarray, low: np.ndarray, high: np.ndarray, shape: _Shape) -> tuple[np.ndarray, ...]:
    """Of stretches data[low:high]: stretch, anchor, nearest and farthest window start before the
    anchor, key and whole-stretch hash. Windows without an anchor in their first `farthest` units
    stand for themselves."""
    found = []
    length, farthest = shape.length, shape.farthest
    spot = np.uint64(2**64 // shape.spacing)
    for i, (s, e) in enumerate(zip(low.tolist(), high.tolist(), strict=True)):
        part = _Bytes(data[s:e])
        n, starts = e - s, e - s - length + 1
        gram = np.arange(n - shape.gram + 1)
        anchors = np.flatnonzero(part.hash(gram, gram + shape.gram) < spot)
        anchors = anchors[anchors <= starts - 1 + farthest]
        gap = np.diff(anchors, prepend=-1) - 1
        near, far = np.maximum(0, anchors - (starts - 1)), np.minimum(gap, farthest)
        used = near <= far
        anchors, near, far = anchors[used], near[used], far[used]
        covered = np.zeros(starts + 1, np.int32)
        np.add.at(covered, anchors - far, 1)
        np.add.at(covered, anchors - near + 1, -1)
        loose = np.flatnonzero(np.cumsum(covered[:-1]) == 0)
        key = part.hash(anchors, anchors + shape.key)
        span = mix((near * 1024 + far).astype(np.uint64))
        whole = part.hash(anchors - far, anchors - near + length) + span
        single = part.hash(loose, loose + length) ^ _LOOSE
        zero = np.zeros(len(loose), np.int64)
        found.append((np.full(len(anchors) + len(loose), i), np.concatenate([anchors, loose]), np.concatenate([near, zero]), np.concatenate([far, zero]), np.concatenate([key, single]), np.concatenate([whole, single])))
    if not found:
        none = np.zeros(0, np.int64)
        return none, none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


_SUFFIX = {"key": np.uint64, "whole": np.uint64, "row": np.int64, "at": np.int32, "near": np.int16, "far": np.int16, "twice": np.bool_}
_SUFFIX_ROWS = "bucket int, " + ", ".join(f"{k} binary" for k in _SUFFIX)


def _bits(parts: int) -> int:
    """Of a key by which it is dealt out: many buckets for each partition, whatever their number."""
    return max(10, (16 * parts).bit_length())


def _anchored(shape: _Shape, bits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Suffixes of (row, text), dealt by key. Of stretches that a batch holds more than once, one goes
    on to its key and the others, settled, to buckets of their own."""

    def anchored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last in slices(batch.column("text")):
                part = batch.slice(first, last - first)
                data, at = shape.units(part.column("text"))
                row, low, high = _pieces(at, SLICE_BYTES, shape.length)
                piece, place, near, far, key, whole = _suffixes(data, low, high, shape)
                _, lead, back, n = np.unique(key ^ mix(whole), return_index=True, return_inverse=True, return_counts=True)
                twice = n[back] > 1
                bucket = key >> np.uint64(64 - bits)
                rest = lead[back] != np.arange(len(key))
                bucket[rest] = mix(np.arange(len(key), dtype=np.uint64))[rest] >> np.uint64(64 - bits)
                rows = part.column("row").to_numpy()[row[piece]]
                yield packed(bucket, {"key": key, "whole": np.where(rest, np.uint64(0), whole), "row": rows, "at": (place + low[piece] - at[row[piece]]).astype(np.int32), "near": near.astype(np.int16), "far": far.astype(np.int16), "twice": twice})

    return anchored


class Levels:
    """A family of sorted runs of suffixes, no two of like size.

    A new batch is sorted into a run of its own and scanned against each run that is there: where
    both have a key, stretches equal as a whole are `settled`, and where a key has several stretches
    each of these has one suffix, its `first`, to be probed. Then runs of like size merge, so that a
    suffix moves a logarithmic number of times however many batches come."""

    def __init__(self):
        self.runs: list[dict[str, np.ndarray]] = []

    @staticmethod
    def _sorted(run: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        """Takes run's columns one by one, so that but one is there twice."""
        order = np.lexsort((run["whole"], run["key"]))
        return {k: run.pop(k)[order] for k in list(run) if k not in ("group", "opens")}

    @classmethod
    def _merged(cls, old: dict[str, np.ndarray], new: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        for run in (old, new):
            del run["group"], run["opens"]
        return cls._grouped(cls._sorted({k: np.concatenate([old.pop(k), new.pop(k)]) for k in list(old)}))

    @staticmethod
    def _grouped(run: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        fresh = np.concatenate([[True], run["key"][1:] != run["key"][:-1]])
        return run | {"group": np.cumsum(fresh) - 1, "opens": np.flatnonzero(fresh)}

    @classmethod
    def _run(cls, batch: dict[str, np.ndarray]) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """A batch, whose columns go, as a sorted run, without flags but `first`: the first of each stretch; and the
        number of each suffix's stretch."""
        batch["pair"] = batch["key"] ^ mix(batch["whole"])
        run = cls._grouped(cls._sorted(batch))
        whole, none = run["whole"], np.zeros(len(run["key"]), bool)
        kind = np.concatenate([[True], (whole[1:] != whole[:-1]) | (run["group"][1:] != run["group"][:-1])])
        return run | {"first": kind, "settled": none, "several": none.copy()}, np.cumsum(kind) - 1

    def hold(self, batch: dict[str, np.ndarray]) -> None:
        """A run that was scanned against all others before."""
        self.runs.append(self._run(batch)[0])

    def scan(self, batch: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        """A new batch as a run, with what it finds in itself and in the runs that are there."""
        run, number = self._run(batch)
        whole, opens = run["whole"], run["opens"]
        run |= {"settled": (np.bincount(number)[number] > 1) | run["twice"], "several": (whole[opens] != whole[np.append(opens[1:], len(whole)) - 1])[run["group"]]}
        for level in self.runs:
            self._scan(run, level)
        return run

    def add(self, batch: dict[str, np.ndarray]) -> None:
        run = self.scan(batch)
        while self.runs and len(self.runs[-1]["key"]) <= 2 * len(run["key"]):
            run = self._merged(self.runs.pop(), run)
        self.runs.append(run)

    @staticmethod
    def _scan(new: dict[str, np.ndarray], old: dict[str, np.ndarray]) -> None:
        """Keys that both runs have: their stretches against each other."""
        _, a, b = np.intersect1d(new["key"][new["opens"]], old["key"][old["opens"]], assume_unique=True, return_indices=True)
        if not len(a):
            return
        ends, met = [], []
        for run, at in ((new, a), (old, b)):
            last = np.append(run["opens"][1:], len(run["key"])) - 1
            ends += [run["whole"][run["opens"][at]], run["whole"][last[at]]]
            held = np.zeros(len(run["opens"]), bool)
            held[at] = True
            met.append(np.flatnonzero(held[run["group"]]))
        differ = (ends[0] != ends[1]) | (ends[2] != ends[3]) | (ends[0] != ends[2])
        for run, at in ((new, a), (old, b)):
            mixed = np.zeros(len(run["opens"]), bool)
            mixed[at[differ]] = True
            run["several"] |= mixed[run["group"]]
        known = np.isin(new["pair"][met[0]], old["pair"][met[1]])
        new["settled"][met[0][known]] = True
        new["first"][met[0][known]] = False
        old["settled"][met[1][np.isin(old["pair"][met[1]], new["pair"][met[0]])]] = True


def _packs(at: np.ndarray, near: np.ndarray, far: np.ndarray, settled: np.ndarray) -> np.ndarray:
    return at.astype(np.int64) << 24 | far.astype(np.int64) << 12 | near.astype(np.int64) << 1 | settled


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, pack) of suffixes that aren't alone: settled where the whole stretch is repeated, and to
    be probed where another with the same key has another stretch."""
    levels = Levels()
    told = lambda run, which, done: pa.RecordBatch.from_arrays([pa.array(run["row"][which]), pa.array(_packs(run["at"][which], run["near"][which], run["far"][which], np.full(which.sum(), done)))], ["row", "pack"])
    for batch in batches:
        if not batch.num_rows:
            continue
        run = {k: buffers(batch.column(k))[0].view(kind) for k, kind in _SUFFIX.items()}
        early = run["whole"] == 0
        if early.any():
            yield told(run, early, 1)
            run = {k: v[~early] for k, v in run.items()}
        if len(run["key"]):
            levels.add(run)
    for run in levels.runs:
        yield told(run, run["settled"], 1)
        yield told(run, run["several"] & run["first"], 0)


_WINDOW = {"row": np.int64, "at": np.int32, "near": np.int16, "far": np.int16, "hashes": np.uint64}
_WINDOW_ROWS = "bucket int, " + ", ".join(f"{k} binary" for k in _WINDOW)


def _probed(shape: _Shape, bits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Hashes of the windows to be compared, of (row, text, packs), dealt by suffix key."""

    def probed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last in slices(batch.column("text")):
                part = batch.slice(first, last - first)
                data, offsets = shape.units(part.column("text"))
                out = []
                for i, (row, packs) in enumerate(zip(part.column("row").to_pylist(), part.column("packs").to_pylist(), strict=True)):
                    packs = np.sort(np.array(packs, np.int64))
                    at, far, near = packs >> 24, packs >> 12 & 0xFFF, packs >> 1 & 0x7FF
                    done = 0
                    while done < len(at):
                        low = int(at[done] - far[done])
                        upto = max(done + 1, int(np.searchsorted(at, low + SLICE_BYTES)))
                        base = max(0, int((at - far)[done:upto].min()))
                        text = _Bytes(data[offsets[i] + base : min(offsets[i + 1], offsets[i] + int(at[upto - 1]) + shape.length)])
                        a, f, k = at[done:upto] - base, far[done:upto], near[done:upto]
                        n = f - k + 1
                        ends = np.cumsum(n)
                        o = np.arange(ends[-1]) - np.repeat(ends - n, n) + np.repeat(k, n)
                        s = np.repeat(a, n) - o
                        out.append((text.hash(a, a + shape.key), np.full(len(a), row), at[done:upto], k, f, text.hash(s, s + shape.length)))
                        done = upto
                if not out:
                    continue
                key, row, at, near, far, hashes = (np.concatenate(x) for x in zip(*out, strict=True))
                bucket = (key >> np.uint64(64 - bits)).astype(np.int64)
                wide = np.repeat(bucket, far - near + 1)
                plain = packed(bucket, {"row": row, "at": at.astype(np.int32), "near": near.astype(np.int16), "far": far.astype(np.int16)})
                yield pa.RecordBatch.from_arrays([*plain.columns, packed(wide, {"hashes": hashes}).column(1)], ["bucket", *_WINDOW])

    return probed


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, pack) of runs of repeated windows: the last start of each run as anchor, the first as far."""
    got = [{k: buffers(batch.column(k))[0].view(kind) for k, kind in _WINDOW.items()} for batch in batches if batch.num_rows]
    if not got:
        return
    run = {k: np.concatenate([g.pop(k) for g in got]) for k in _WINDOW}
    hashes = run["hashes"]
    order = np.argsort(hashes, kind="stable")
    same = hashes[order][1:] == hashes[order][:-1]
    repeated = np.zeros(len(hashes), bool)
    repeated[order[1:][same]] = repeated[order[:-1][same]] = True
    n = run["far"].astype(np.int64) - run["near"] + 1
    owner = np.repeat(np.arange(len(n)), n)
    o = np.arange(len(hashes)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(run["near"].astype(np.int64), n)
    opens = repeated & np.concatenate([[True], ~repeated[:-1] | (owner[1:] != owner[:-1])])
    closes = repeated & np.concatenate([~repeated[1:] | (owner[1:] != owner[:-1]), [True]])
    a, b = np.flatnonzero(opens), np.flatnonzero(closes)
    who = owner[a]
    yield pa.RecordBatch.from_arrays([pa.array(run["row"][who]), pa.array(_packs(run["at"][who], o[a], o[b], np.ones(len(a), np.int64)))], ["row", "pack"])


def _runs(found: list[tuple[int, int]]) -> list[list[int]]:
    """Stretches that overlap or touch, as one."""
    runs: list[list[int]] = []
    for s, e in sorted(found):
        if runs and s <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], e)
        else:
            runs.append([s, e])
    return runs


def _removed(batches: Iterator[pa.RecordBatch], shapes: list[_Shape], keep_text: bool, keep_passages: bool) -> Iterator[pa.RecordBatch]:
    """Bytes left of (id, text, packs by shape): counts and digest, or the text itself."""
    names = ["row", "id", "n_bytes", "n_removed", "n_spans", "n_passages", "passage_bytes", "left"]
    for whole in batches:
        for first, last in slices(whole.column("text")):
            batch = whole.slice(first, last - first)
            out = []
            for k, text in enumerate(batch.column("text").cast(pa.binary()).to_pylist()):
                text = text or b""
                goes: list[tuple[int, int]] = []
                passages: list[list[int]] = []
                for shape, packs in zip(shapes, batch.columns[3:], strict=True):
                    if p := packs[k].as_py():
                        p = np.array(p, np.int64)
                        at, far, near = p >> 24, p >> 12 & 0xFFF, p >> 1 & 0x7FF
                        s, e = at - far, at - near + shape.length
                        if shape.words:
                            starts, ends, _ = spans(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
                            s, e = starts[s], ends[e - 1]
                            passages = _runs(list(zip(s.tolist(), e.tolist(), strict=True)))
                        if not (shape.words and keep_passages):
                            goes += zip(s.tolist(), e.tolist(), strict=True)
                gone, kept, last = _runs(goes), [], 0
                for s, e in gone:
                    kept.append(text[last:s])
                    last = e
                kept.append(text[last:])
                left = b"".join(kept)
                out.append((len(text), len(text) - len(left), len(gone), len(passages), sum(e - s for s, e in passages), left.decode("utf-8", "ignore") if keep_text else hashlib.sha256(left).hexdigest()))
            *counts, rest = zip(*out, strict=True) if out else [()] * 6
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("id"), *(pa.array(c, pa.int64()) for c in counts), pa.array(rest, pa.string())], names)


def _marked(rows: DataFrame, shape: _Shape, parts: int) -> DataFrame:
    """(row, packs) of the repeated windows of rows(row, text), whose suffixes are dealt to so many tasks."""
    bits = _bits(parts)
    least = 2 * shape.length - 1 if shape.words else shape.length  # words of a byte, and blanks between them
    long = rows.where(F.octet_length("text") >= least)
    scanned = long.mapInArrow(_anchored(shape, bits), _SUFFIX_ROWS).repartition(parts, "bucket").mapInArrow(_scanned, "row bigint, pack bigint")
    marks = stored(scanned.groupBy("row").agg(F.collect_list("pack").alias("packs")))
    open_marks = marks.select("row", F.filter("packs", lambda p: p.bitwiseAND(F.lit(1)) == 0).alias("packs")).where("size(packs) > 0")
    probed = long.join(open_marks, "row").select("row", "text", "packs").mapInArrow(_probed(shape, bits), _WINDOW_ROWS)
    more = stored(probed.repartition(parts, "bucket").mapInArrow(_compared, "row bigint, pack bigint").groupBy("row").agg(F.collect_list("pack").alias("more")))
    settled = marks.select("row", F.filter("packs", lambda p: p.bitwiseAND(F.lit(1)) == 1).alias("packs"))
    none = F.array().cast("array<bigint>")
    return settled.join(more, "row", "full").select("row", F.concat(F.coalesce("packs", none), F.coalesce("more", none)).alias("packs"))


def long_repeats(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", keep_text: bool = False, length: int = LENGTH, words: int | None = None, keep_passages: bool = False) -> DataFrame:
    """(row, id, n_bytes, n_removed, n_spans, n_passages, passage_bytes, left) for each row: bytes
    covered by a string of `length` bytes that also starts anywhere else in the table are removed,
    and with `words` those covered by so many words that do, with the white space between them,
    whatever it is; n_passages counts the maximal stretches of the latter and passage_bytes their
    bytes, and with keep_passages they are told but not removed. `left` is the SHA-256 of the rest,
    or with keep_text the rest itself, without broken characters at its seams.

    Texts are taken as UTF-8, null as empty; matches don't cross rows, overlaps count, and strings
    are judged on the input. Repeated rows remove each other's bytes altogether. Strings are
    compared by 64-bit hashes. Suffixes are dealt to as many tasks as the texts' size asks for, so a task's
    share stays the same however much there is. Texts of any length are cut into overlapping stretches of 4 MB; a
    stretch that very many rows share costs one shuffled suffix for each batch that holds it. Other
    columns don't matter; an empty table gives no rows."""
    read = numbered(docs.select(F.col(id_column).alias("id"), F.coalesce(text_column, F.lit("")).alias("text")))
    shapes = [_Shape(length), *([_Shape(words, words=True)] if words else [])]
    parts = -(-(read.agg(F.sum(F.octet_length("text"))).first()[0] or 1) // BYTES_IN_TASK)
    marks = None
    for i, shape in enumerate(shapes):
        own = _marked(read.select("row", "text"), shape, parts).withColumnRenamed("packs", f"packs{i}")
        marks = own if marks is None else marks.join(own, "row", "full")
    kind = docs.schema[id_column].dataType.simpleString()
    left = read.join(marks, "row", "left").select("row", "id", "text", *[f"packs{i}" for i in range(len(shapes))])
    found = left.mapInArrow(lambda it: _removed(it, shapes, keep_text, keep_passages), f"row bigint, id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, n_passages bigint, passage_bytes bigint, left string")
    return found.withColumnRenamed("id", id_column)


def _met_levels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, pack) as _scanned() tells them, from one partition of a new batch's suffixes (level -1) and those
    of stored levels: the new run's own, and what it and each level find in one another. What levels
    have found among themselves was told when their batches came."""
    parts: dict[int, list] = {}
    for batch in batches:
        for level, *columns in zip(batch.column("level").to_pylist(), *(batch.column(k).to_pylist() for k in _SUFFIX), strict=True):
            parts.setdefault(level, []).append([np.frombuffer(c, kind) for c, kind in zip(columns, _SUFFIX.values(), strict=True)])
    runs = {level: {k: np.concatenate(x) for k, x in zip(_SUFFIX, zip(*own, strict=True), strict=True)} for level, own in parts.items()}
    told = lambda run, which, done: pa.RecordBatch.from_arrays([pa.array(run["row"][which]), pa.array(_packs(run["at"][which], run["near"][which], run["far"][which], np.full(which.sum(), done)))], ["row", "pack"])
    if -1 not in runs:
        return
    early = runs[-1]["whole"] == 0
    yield told(runs[-1], early, 1)
    new = {k: v[~early] for k, v in runs.pop(-1).items()}
    if not len(new["key"]):
        return
    levels = Levels()
    for _, run in sorted(runs.items()):
        run = {k: v[run["whole"] != 0] for k, v in run.items()}
        if len(run["key"]):
            levels.hold(run)
    for run in [levels.scan(new), *levels.runs]:
        yield told(run, run["settled"], 1)
        yield told(run, run["several"] & run["first"], 0)


class RepeatIndex:
    """Long repeats of a corpus that comes batch by batch: the levels of suffixes, kept as tables in `path`.

    A new batch's suffixes are scanned against every level that is there, and marks both the new
    documents and the earlier ones that it repeats; then it becomes a level, and levels of like size
    merge, so a suffix is written a logarithmic number of times. Levels are dealt to `parts`
    partitions by their keys' first bits. Texts and marks of each batch are kept beside them."""

    def __init__(self, spark: SparkSession, path: str, *, length: int = LENGTH, parts: int = 64):
        self.spark, self.path, self.shape, self.parts = spark, path, _Shape(length), parts
        self.sizes: dict[int, int] = {}  # of the levels that are there, by number
        self.batches = 0

    def _level(self, number: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/levels/{number}")

    def add(self, docs: DataFrame) -> None:
        """A further batch of documents(id, text)."""
        at, shape, bits = self.batches, self.shape, _bits(self.parts)
        rows = docs.select("id", F.coalesce("text", F.lit("")).alias("text"))
        rows.select("id", "text", (F.monotonically_increasing_id() + F.lit(at << 52)).alias("row")).write.mode("overwrite").parquet(f"{self.path}/texts/batch={at}")
        texts = self.spark.read.parquet(f"{self.path}/texts/batch={at}")
        suffixes = stored(texts.where(F.octet_length("text") >= shape.length).select("row", "text").mapInArrow(_anchored(shape, bits), _SUFFIX_ROWS))
        levels = [self._level(n).withColumn("level", F.lit(n)) for n in sorted(self.sizes)]
        met = suffixes.withColumn("level", F.lit(-1))
        for level in levels:
            met = met.unionByName(level)
        found = stored(met.repartition(self.parts, "bucket").mapInArrow(_met_levels, "row bigint, pack bigint").groupBy("row").agg(F.collect_set("pack").alias("packs")))
        doubtful = found.select("row", F.filter("packs", lambda p: p.bitwiseAND(F.lit(1)) == 0).alias("packs")).where("size(packs) > 0")
        every = self.spark.read.parquet(f"{self.path}/texts").select("row", "text")
        probed = every.join(doubtful, "row").select("row", "text", "packs").mapInArrow(_probed(shape, bits), _WINDOW_ROWS)
        more = probed.repartition(self.parts, "bucket").mapInArrow(_compared, "row bigint, pack bigint")
        settled = found.select("row", F.explode(F.filter("packs", lambda p: p.bitwiseAND(F.lit(1)) == 1)).alias("pack"))
        settled.union(more).write.mode("overwrite").parquet(f"{self.path}/marks/batch={at}")
        self._merge(suffixes, at)
        dropped(suffixes, found)
        self.batches += 1

    def _merge(self, run: DataFrame, number: int) -> None:
        """The new run as a level, joined with all of at most twice its size, smallest first."""
        size = run.agg(F.coalesce(F.sum(F.octet_length("key")), F.lit(0)).alias("n")).first().n
        gone = []
        for n in sorted(self.sizes, key=self.sizes.get):
            if self.sizes[n] <= 2 * size:
                run, size = run.unionByName(self._level(n)), size + self.sizes[n]
                gone.append(n)
        run.repartition(self.parts, "bucket").sortWithinPartitions("bucket").write.mode("overwrite").parquet(f"{self.path}/levels/{number}")
        for n in gone:
            del self.sizes[n]
        self.sizes[number] = size

    def repeats(self, keep_text: bool = False) -> DataFrame:
        """(id, n_bytes, n_removed, n_spans, left) of all documents so far, as long_repeats() has them."""
        marks = self.spark.read.parquet(f"{self.path}/marks").groupBy("row").agg(F.collect_set("pack").alias("packs0"))
        left = self.spark.read.parquet(f"{self.path}/texts").join(marks, "row", "left").select("row", "id", "text", "packs0")
        kind, shapes = left.schema["id"].dataType.simpleString(), [self.shape]
        found = left.mapInArrow(lambda it: _removed(it, shapes, keep_text, False), f"row bigint, id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, n_passages bigint, passage_bytes bigint, left string")
        return found.select("id", "n_bytes", "n_removed", "n_spans", "left")


def op10_long_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strings of 400 bytes are removed. Passages of 51 words, of which two in five are shorter than that,
    are told beside them: how many there are, and their bytes."""
    found = long_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), words=PASSAGE_WORDS, keep_passages=True)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.col("left").alias("kept_sha256"), "n_passages", "passage_bytes")
