"""Array helpers used inside Arrow tasks: texts as byte buffers, word and shingle hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: White space of every contract here: 0x20 and 0x09-0x0D.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}
SLICE_BYTES = 4 << 20
HASHED_BYTES = 1 << 18  # of words that are hashed at once: some arrays of 8 bytes for each


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """_BASE and its inverse to the powers 0 .. n - 1, modulo 2**64."""
    if len(_powers["up"]) < n:
        size = max(n, HASHED_BYTES + 1)
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[name] = np.cumprod(steps, dtype=np.uint64)
    return _powers["up"][:n], _powers["down"][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; one-to-one."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all rows and the n + 1 offsets; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, pa.scalar("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"", column.type))
    wide = column.cast(pa.large_binary() if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else pa.large_string())
    _, offsets, data = wide.buffers()
    at = np.frombuffer(offsets, np.int64)[wide.offset : wide.offset + len(wide) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and len(wide) and at[-1] > at[0] else np.zeros(0, np.uint8)
    return raw, at - (at[0] if len(at) else 0)


def slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `most` bytes each; a longer row stands alone."""
    if not len(column):
        return
    _, at = buffers(column)
    first = 0
    while first < len(column):
        last = int(np.searchsorted(at, at[first] + most, "right")) - 1
        last = max(first + 1, min(last, len(column)))
        yield first, last
        first = last


def spans(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word starts, word ends and the row of each word; words don't cross rows."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none
    solid = ~SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[at] = True
    before = np.empty(len(data), bool)
    before[0] = False
    before[1:] = solid[:-1]
    starts = np.flatnonzero(solid & (~before | edge[:-1]))
    after = np.empty(len(data), bool)
    after[-1] = False
    after[:-1] = solid[1:]
    ends = np.flatnonzero(solid & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(at, starts, "right") - 1


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: np.ndarray = LOWER) -> np.ndarray:
    """64-bit hash of each word, its bytes folded: A-Z lower-cased."""
    out = np.empty(len(starts), np.uint64)
    first = 0
    while first < len(starts):
        low = starts[first]
        last = max(first + 1, int(np.searchsorted(ends, low + HASHED_BYTES, "right")))
        high = ends[last - 1]
        up, down = powers(int(high - low) + 1)
        sums = np.zeros(int(high - low) + 1, np.uint64)
        np.cumsum((fold[data[low:high]].astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
        s, e = starts[first:last] - low, ends[first:last] - low
        out[first:last] = mix((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64))
        first = last
    return out


def shingle_sets(column: pa.Array, width: int) -> list[np.ndarray]:
    """The sorted distinct hashes of each row's `width`-word shingles. A row with fewer words has
    its whole sequence as one shingle; a row without words has none."""
    data, at = buffers(column)
    starts, ends, row = spans(data, at)
    words = word_hashes(data, starts, ends)
    bounds = np.searchsorted(row, np.arange(len(column) + 1))
    factors = mix(np.arange(1, width + 1, dtype=np.uint64)) | np.uint64(1)
    if len(words) >= width:
        n = len(words) - width + 1
        rolled = np.zeros(n, np.uint64)
        for i in range(width):
            rolled += words[i : i + n] * factors[i]
        rolled = mix(rolled)
    else:
        rolled = np.zeros(0, np.uint64)
    found = []
    for i in range(len(column)):
        s, e = bounds[i], bounds[i + 1]
        if e - s >= width:
            found.append(np.unique(rolled[s : e - width + 1]))
        elif e > s:
            found.append(mix((words[s:e] * factors[: e - s]).sum(dtype=np.uint64, keepdims=True) + np.uint64(e - s)))
        else:
            found.append(rolled[:0])
    return found


def list_column(parts: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    """One list for each row, from one array for each row."""
    offsets = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(p) for p in parts], out=offsets[1:])
    flat = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.view(np.int64) if flat.dtype == np.uint64 else flat, kind))


def packed(bucket: np.ndarray, columns: dict[str, np.ndarray]) -> pa.RecordBatch:
    """One row for each bucket, its columns as bytes."""
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    fresh = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else np.zeros(0, int)
    ends = np.append(fresh[1:], len(bucket)) if len(bucket) else fresh
    arrays = [pa.array(bucket[fresh].astype(np.int32))]
    for values in columns.values():
        values = np.ascontiguousarray(values[order])
        arrays.append(pa.array([values[s:e].tobytes() for s, e in zip(fresh, ends, strict=True)], pa.binary()))
    return pa.RecordBatch.from_arrays(arrays, ["bucket", *columns])
