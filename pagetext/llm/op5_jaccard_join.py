"""N-gram Jaccard join: documents whose shingle sets have Jaccard similarity >= t, exactly.

Jaccard distance is a metric, but two unrelated documents are at distance about 1 from each other
and from every pivot, so Voronoi regions of pivot documents alone would copy every document into
every region (the window is 2 * (1 - t) wide). The outer regions are therefore those of pivots that
do separate: set size (distance from the empty set) cuts the documents into bands, and boundary
documents are copied into the band below; within a band the hash space is cut into more classes
than two linked documents can differ by, so that linked documents agree on many classes as a whole.
A document that shares fewer of its classes than that with all others together has no links and
goes; of the rest each needs only its rarest classes to meet every partner. Documents that meet
form closed regions; inside them pivot documents, Voronoi cells and triangle-inequality windows
find the links, cell by cell, recursively, across tasks while a region is too large for one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagetext.llm._arrays import list_column, mix, packed, shingle_sets, slices
from pagetext.llm._components import components, stars
from pagetext.llm._store import dropped, numbered, stored

MOST_IN_TASK = 3_000_000  # shingles of a region that one task joins
KEYS_IN_TASK = 2_000_000
SLICE_SHINGLES = 1_000_000
SLICE_BYTES = 1 << 20  # of text that a task turns into keys at once
BYTES_A_WORD = 6
SPREAD = 1.43  # classes for each element by which two linked sets of a band may differ
PIVOTS = 8
LEAST_CUT = 0.7  # of a region's size: cells above this don't cut it


def band_of(size: int) -> int:
    """Band b holds the sizes from 2**b to 2**(b + 1) - 1."""
    return size.bit_length() - 1


def class_keys(values: np.ndarray, percent: int) -> list[tuple[np.ndarray, int]]:
    """Of one sorted set, for its own band and each below that a partner's size can lie in: keys, the
    content of each class, and how many of them it shares with any partner that it meets there.

    Sets that link differ by at most (1 - t) / t of the smaller one's size, and each element in
    which they differ spoils one class. Empty classes are no keys, unless too few others are left."""
    size, found = len(values), []
    if not size:
        return found
    sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(values), dtype=np.uint64)])
    for band in range(band_of(size), band_of(max(1, -(-size * percent // 100))) - 1, -1):
        top = (2 << band) - 1
        m = int(np.ceil(SPREAD * (top + 1) * (100 - percent) / percent)) + 1
        cuts = np.searchsorted(values >> np.uint64(32), ((np.arange(m + 1, dtype=np.uint64) << np.uint64(32)) + np.uint64(m - 1)) // np.uint64(m))
        used = cuts[1:] > cuts[:-1]
        agree = int(used.sum()) - min(size, top) * (100 - percent) // percent
        if agree < 1:
            used[:], agree = True, 1
        name = mix(np.flatnonzero(used).astype(np.uint64) + np.uint64(band << 40))
        found.append((mix((sums[cuts[1:]] - sums[cuts[:-1]])[used] + name), agree))
    return found


def _units(sets: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Keys of all sets and the unit (set and band) of each; of each unit its set * 8 + band from the
    top, and how many keys it shares with a partner."""
    per = [(8 * i + k, keys, agree) for i, s in enumerate(sets) for k, (keys, agree) in enumerate(class_keys(s, percent))]
    flat = np.concatenate([np.zeros(0, np.uint64), *(keys for _, keys, _ in per)])
    owner = np.repeat(np.arange(len(per)), [len(keys) for _, keys, _ in per])
    return flat, owner, np.array([u for u, _, _ in per], np.int64), np.array([a for _, _, a in per], np.int64)


def _bits(parts: int) -> int:
    """Of a key by which it is dealt out: several buckets for each partition, whatever their number."""
    return max(10, (16 * parts).bit_length())


def _dealt(flat: np.ndarray, bits: int, **columns: np.ndarray) -> pa.RecordBatch:
    """Keys dealt by their first bits; the next 48 in `keys`."""
    low = np.ascontiguousarray((flat & np.uint64((1 << 48) - 1)).astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :6]
    return packed((flat >> np.uint64(64 - bits)).astype(np.int64), {"keys": low, **columns})


def _undealt(bucket: int, keys: bytes) -> np.ndarray:
    """Keys told apart by the bits of their bucket and 48 others, or as many as fit beside them."""
    whole = np.zeros((len(keys) // 6, 8), np.uint8)
    whole[:, :6] = np.frombuffer(keys, np.uint8).reshape(-1, 6)
    return whole.view("<u8").ravel() ^ mix(np.full(1, bucket, np.uint64))


_SENT = "bucket int, keys binary, offsets binary, twice binary, first bigint, block bigint, units binary, counts binary, row bigint, id {kind}, n bigint, seal bigint"


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[int, int]]:
    """Slices of a batch whose rows are numbered one after another."""
    row = batch.column("row").to_numpy()
    ends = np.append(np.flatnonzero(np.diff(row) != 1) + 1, len(row))
    for start, end in zip(np.append(0, ends), ends, strict=False):
        for first, last in slices(batch.column("text").slice(start, end - start), SLICE_BYTES):
            yield start + first, start + last


def _keyed(width: int, percent: int, bits: int):
    """From (row, id, text): keys dealt by bucket, of a key that a slice holds more than once one, marked
    so; for each unit the shared keys that its slice shows, less those that it needs; and for each
    row its set's size and seal."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind = batch.schema.field("id").type
            for first, last in _runs(batch):
                part = batch.slice(first, last - first)
                rows = part.column("row").to_numpy()
                sets = shingle_sets(part.column("text"), width)
                flat, owner, unit, agree = _units(sets, percent)
                key, lead, back, n = np.unique(flat, return_index=True, return_inverse=True, return_counts=True)
                known = np.bincount(owner, n[back] > 1, len(unit)).astype(np.int32) - agree.astype(np.int32)
                if len(unit):
                    dealt = _dealt(key, bits, offsets=unit[owner[lead]].astype(np.uint32), twice=n > 1)
                    yield _batch(dealt.num_rows, kind, bucket=dealt.column(0), keys=dealt.column(1), offsets=dealt.column(2), twice=dealt.column(3), first=pa.array(np.full(dealt.num_rows, rows[0])))
                    yield _tallied(rows[0] * 8 + unit, known, kind)
                seal = [int(mix(s).sum(dtype=np.uint64).astype(np.int64)) if len(s) else 0 for s in sets]
                at = pa.array((rows & 0xFFF).astype(np.int32))
                yield _batch(len(rows), kind, bucket=at, row=part.column("row"), id=part.column("id"), n=pa.array([len(s) for s in sets], pa.int64()), seal=pa.array(seal, pa.int64()))

    return keyed


def _batch(rows: int, kind: pa.DataType, **columns: pa.Array) -> pa.RecordBatch:
    types = {"bucket": pa.int32(), "first": pa.int64(), "block": pa.int64(), "row": pa.int64(), "id": kind, "n": pa.int64(), "seal": pa.int64()}
    names = [c.split()[0] for c in _SENT.split(", ")]
    return pa.RecordBatch.from_arrays([columns[c] if c in columns else pa.nulls(rows, types.get(c, pa.binary())) for c in names], names)


def _tallied(units: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.RecordBatch:
    """Counts of units, by blocks of 16,384 rows."""
    block, back = np.unique(units >> 17, return_inverse=True)
    out = packed(back, {"units": units, "counts": counts.astype(np.int32)})
    return _batch(len(block), kind, bucket=pa.array((block & 0xFFF).astype(np.int32)), block=pa.array(block), units=out.column(1), counts=out.column(2))


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From one partition of dealt keys: for each unit how many of its keys other slices have too, packed
    by blocks of rows; what is known already goes through."""
    keys, units, twice = [], [], []
    for batch in batches:
        kind = batch.schema.field("id").type
        sent = batch.column("keys").is_valid()
        rest = batch.filter(pc.invert(sent))
        if rest.num_rows:
            yield rest
        own = batch.filter(sent)
        for bucket, bits, offsets, more, first in zip(*(own.column(c).to_pylist() for c in ("bucket", "keys", "offsets", "twice", "first")), strict=True):
            keys.append(_undealt(bucket, bits))
            units.append(np.frombuffer(offsets, np.uint32).astype(np.int64) + 8 * first)
            twice.append(np.frombuffer(more, bool))
    if not keys:
        return
    key, unit, more = np.concatenate(keys), np.concatenate(units), np.concatenate(twice)
    _, back, n = np.unique(key, return_inverse=True, return_counts=True)
    told, count = np.unique(unit[(n[back] > 1) & ~more], return_counts=True)
    if len(told):
        yield _tallied(told, count, kind)


def _alive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with a unit that shares as many keys as links need."""
    units, counts = [], []
    for batch in batches:
        units += [np.frombuffer(b, np.int64) for b in batch.column("units").to_pylist()]
        counts += [np.frombuffer(b, np.int32) for b in batch.column("counts").to_pylist()]
    if units:
        unit, back = np.unique(np.concatenate(units), return_inverse=True)
        enough = np.bincount(back, np.concatenate(counts).astype(float)) >= 0
        yield pa.RecordBatch.from_arrays([pa.array(np.unique(unit[enough] >> 3))], ["row"])


def _valued(width: int):
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last in slices(batch.column("text"), SLICE_BYTES):
                part = batch.slice(first, last - first)
                yield pa.RecordBatch.from_arrays([part.column("row"), part.column("slice"), part.column("n"), list_column(shingle_sets(part.column("text"), width), pa.int64())], ["row", "slice", "n", "values"])

    return sets


def _sets(table: pa.Table) -> list[np.ndarray]:
    flat = table.column("values").combine_chunks()
    at = flat.offsets.to_numpy()
    values = flat.values.to_numpy(zero_copy_only=False).view(np.uint64)
    return [values[s:e] for s, e in zip(at, at[1:], strict=False)]


_COUNTED = "bucket int, keys binary, counts binary, slice bigint"


def _slice_keys(percent: int, bits: int):
    """The distinct keys of a slice of sets and how many of its units have each."""

    def keys(table: pa.Table) -> pa.Table:
        flat, _, _, _ = _units(_sets(table), percent)
        key, n = np.unique(flat, return_counts=True)
        dealt = _dealt(key, bits, full=key, counts=n.astype(np.int32))
        return pa.Table.from_arrays([dealt.column(0), dealt.column(2), dealt.column(3), pa.array(np.full(dealt.num_rows, table.column("slice")[0].as_py()))], names=["bucket", "keys", "counts", "slice"])

    return keys


def _frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each slice its keys that more than one unit has, and how many do."""
    keys, counts, owner = [], [], []
    for batch in batches:
        for key, n, own in zip(*(batch.column(c).to_pylist() for c in ("keys", "counts", "slice")), strict=True):
            keys.append(np.frombuffer(key, np.uint64))
            counts.append(np.frombuffer(n, np.int32))
            owner.append(np.full(len(keys[-1]), own))
    if not keys:
        return
    key, own = np.concatenate(keys), np.concatenate(owner)
    _, back = np.unique(key, return_inverse=True)
    total = np.bincount(back, np.concatenate(counts)).astype(np.int64)[back]
    key, own, total = key[total > 1], own[total > 1], total[total > 1]
    order = np.argsort(own, kind="stable")
    key, own, total = key[order], own[order], total[order]
    first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(own) else np.zeros(0, int)
    for s, e in zip(first, np.append(first, len(own))[1:], strict=True):
        yield pa.RecordBatch.from_arrays([pa.array([own[s]]), pa.array([key[s:e].tobytes()]), pa.array([total[s:e].tobytes()])], ["slice", "keys", "totals"])


_STARRED = "bucket int, keys binary, rows binary, a bigint, b bigint"


def _rarest(percent: int, bits: int):
    """Of a slice's sets and their shared keys: the keys by which each unit meets all its partners, its
    rarest ones, of which a slice sends one with the least row that has it; and the edges of the
    slice's other rows with that one."""

    def rarest(sets: pa.Table, told: pa.Table) -> pa.Table:
        names = [c.split()[0] for c in _STARRED.split(", ")]
        key = np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(b, np.uint64) for b in told.column("keys").to_pylist())])
        n = np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(b, np.int64) for b in told.column("totals").to_pylist())])
        none = pa.Table.from_arrays([pa.nulls(0, t) for t in (pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64())], names=names)
        if not len(key) or not sets.num_rows:
            return none
        key, first = np.unique(key, return_index=True)
        n = n[first]
        flat, owner, unit, agree = _units(_sets(sets), percent)
        at = np.minimum(np.searchsorted(key, flat), len(key) - 1)
        hit = key[at] == flat
        quota = np.bincount(owner[hit], minlength=len(unit)) - agree + 1  # partners share `agree` keys, so one that isn't of the last agree - 1
        flat, owner, n = flat[hit], owner[hit], n[at[hit]]
        order = np.lexsort((flat, n, owner))
        flat, owner = flat[order], owner[order]
        rank = np.arange(len(owner)) - np.searchsorted(owner, owner)
        flat, owner = flat[rank < quota[owner]], owner[rank < quota[owner]]
        if not len(flat):
            return none
        rows = sets.column("row").to_numpy()[unit[owner] >> 3]
        order = np.lexsort((rows, flat))
        flat, rows = flat[order], rows[order]
        fresh = np.concatenate([[True], flat[1:] != flat[:-1]])
        lead = rows[fresh][np.cumsum(fresh) - 1]
        a, b = stars(rows, lead)
        dealt = _dealt(flat[fresh], bits, full=flat[fresh], rows=rows[fresh])
        sent = pa.Table.from_arrays([dealt.column(0), dealt.column(2), dealt.column(3), pa.nulls(dealt.num_rows, pa.int64()), pa.nulls(dealt.num_rows, pa.int64())], names=names)
        edges = pa.Table.from_arrays([pa.array((a & 0xFFF).astype(np.int32)), pa.nulls(len(a), pa.binary()), pa.nulls(len(a), pa.binary()), pa.array(a), pa.array(b)], names=names)
        return pa.concat_tables([sent, edges])

    return rarest


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b): one edge a row from one partition of dealt keys and edges."""
    keys, rows, a, b = [], [], [], []
    for batch in batches:
        for key, row, x, y in zip(*(batch.column(c).to_pylist() for c in ("keys", "rows", "a", "b")), strict=True):
            if key is None:
                a.append(x)
                b.append(y)
            else:
                keys.append(np.frombuffer(key, np.uint64))
                rows.append(np.frombuffer(row, np.int64))
    ends = [np.array(a, np.int64)], [np.array(b, np.int64)]
    if keys:
        key, row = np.concatenate(keys), np.concatenate(rows)
        order = np.lexsort((row, key))
        key, row = key[order], row[order]
        fresh = np.concatenate([[True], key[1:] != key[:-1]])
        ends[0].append(row)
        ends[1].append(row[fresh][np.cumsum(fresh) - 1])
    a, b = stars(*map(np.concatenate, ends))
    if len(a):
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


class _Cluster:
    """Sets of one region and their links. Distances are whole counts: intersections by one pass
    over all elements for each pivot. `group` may say which sets are known to be together."""

    def __init__(self, sets: list[np.ndarray], percent: int, group: np.ndarray | None = None):
        self.sizes = np.array([len(s) for s in sets])
        _, codes = np.unique(np.concatenate(sets), return_inverse=True)
        self.cuts = np.concatenate([[0], np.cumsum(self.sizes)])
        self.codes, self.percent = codes.astype(np.int32), percent
        self.mark = np.zeros(int(codes.max(initial=-1)) + 1, bool)
        self.group = np.arange(len(sets)) if group is None else np.unique(group, return_inverse=True)[1]

    def common(self, pivot: int, ids: np.ndarray) -> np.ndarray:
        """Intersection sizes of a set with others."""
        own = self.codes[self.cuts[pivot] : self.cuts[pivot + 1]]
        self.mark[own] = True
        if len(ids) == len(self.sizes):
            hits = np.add.reduceat(self.mark[self.codes], self.cuts[:-1], dtype=np.int64)[ids]
        else:
            n = self.sizes[ids]
            ends = np.cumsum(n)
            at = np.arange(ends[-1]) - np.repeat(ends - n, n) + np.repeat(self.cuts[ids], n)
            hits = np.add.reduceat(self.mark[self.codes[at]], ends - n, dtype=np.int64)
        self.mark[own] = False
        return hits

    def linked(self, pivot: int, ids: np.ndarray, both: np.ndarray) -> np.ndarray:
        return 100 * both >= self.percent * (self.sizes[pivot] + self.sizes[ids] - both)

    def distance(self, pivot: int, ids: np.ndarray, both: np.ndarray) -> np.ndarray:
        return 1 - both / (self.sizes[pivot] + self.sizes[ids] - both)

    def join(self, ids: np.ndarray) -> None:
        if len(ids):
            old = np.unique(self.group[ids])
            self.group[np.isin(self.group, old)] = old.min()

    def solve(self, ids: np.ndarray, fan: int = PIVOTS, small: int = 48) -> None:
        """Link all pairs among ids that are similar. Pivots give cells; a document is also copied
        into a cell whose pivot is at most 2r farther than its own, as its partners may be there."""
        radius = 1 - self.percent / 100 + 1e-9
        while len(ids) > small and len(np.unique(self.group[ids])) > 1:
            pivots = ids[np.linspace(0, len(ids) - 1, fan).astype(int)]
            far = np.empty((fan, len(ids)))
            for i, pivot in enumerate(pivots):
                both = self.common(pivot, ids)
                self.join(np.append(ids[self.linked(pivot, ids, both)], pivot))
                far[i] = self.distance(pivot, ids, both)
            cells = [ids[far[i] <= far.min(0) + 2 * radius] for i in range(fan)]
            cells = [c for c in cells if len(np.unique(self.group[c])) > 1]
            if sum(len(c) for c in cells) >= LEAST_CUT * fan * len(ids) or max((len(c) for c in cells), default=0) > 0.9 * len(ids):
                break
            for cell in cells:
                self.solve(cell, fan, small)
            return
        self.scan(ids)

    def scan(self, ids: np.ndarray) -> None:
        """Cells that pivots don't cut: each document outside the largest group is a pivot for the
        documents of other groups whose size and distance from the first pivots allow a link."""
        ids = ids[np.argsort(self.sizes[ids], kind="stable")]
        radius = 1 - self.percent / 100 + 1e-9
        seen: list[np.ndarray] = []
        done = np.zeros(len(ids), bool)
        while True:
            groups, n = np.unique(self.group[ids], return_counts=True)
            todo = np.flatnonzero(~done & (self.group[ids] != groups[n.argmax()]))
            if len(groups) == 1 or not len(todo):
                return
            i = todo[0]
            done[i] = True
            fits = (self.group[ids] != self.group[ids[i]]) & (100 * np.minimum(self.sizes[ids], self.sizes[ids[i]]) >= self.percent * np.maximum(self.sizes[ids], self.sizes[ids[i]]))
            for d in seen:
                fits &= np.abs(d - d[i]) <= radius
            if len(seen) < 4:
                fits[:] = True
            some = ids[fits]
            if not len(some):
                continue
            both = self.common(ids[i], some)
            self.join(np.append(some[self.linked(ids[i], some, both)], ids[i]))
            if len(seen) < 4:
                seen.append(self.distance(ids[i], some, both))


def _links(percent: int):
    """(a, b): each row of a region, or of two blocks of one, with the first row of its group."""

    def solved(table: pa.Table) -> pa.Table:
        table = table.sort_by("row")
        cluster = _Cluster(_sets(table), percent, table.column("known").to_numpy())
        cluster.solve(np.arange(table.num_rows))
        ids = table.column("row").to_numpy()
        first = np.full(int(cluster.group.max()) + 1, -1)
        first[cluster.group[::-1]] = ids[::-1]
        return pa.table({"a": ids, "b": first[cluster.group]})

    return solved


def _pivoted(percent: int):
    """From (region, row, n, values, pivots): the pivots that a row links with, and the cells, by pivot,
    in which its partners may be: those whose pivot is at most twice the radius farther than its own."""

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        radius = 1 - percent / 100 + 1e-9
        for batch in batches:
            near, own, told, others = [], [], None, []
            for region, values, pivots in zip(batch.column("region").to_pylist(), batch.column("values"), batch.column("pivots"), strict=True):
                if region != told:
                    told, others = region, [(p["row"].as_py(), p["values"].values.to_numpy(zero_copy_only=False).view(np.uint64)) for p in pivots]
                one = values.values.to_numpy(zero_copy_only=False).view(np.uint64)
                rows, far, linked = [], [], []
                for row, other in others:
                    both = len(np.intersect1d(one, other, assume_unique=True))
                    either = len(one) + len(other) - both
                    rows.append(row)
                    far.append(1 - both / either)
                    linked.append(100 * both >= percent * either)
                least = min(far)
                near.append([r for r, hit in zip(rows, linked, strict=True) if hit])
                own.append([r for r, d in zip(rows, far, strict=True) if d <= least + 2 * radius])
            yield pa.RecordBatch.from_arrays([batch.column("region"), batch.column("row"), batch.column("n"), pa.array(near, pa.list_(pa.int64())), pa.array(own, pa.list_(pa.int64()))], ["region", "row", "n", "near", "own"])

    return cells


def _cut_regions(regions: DataFrame, sets: DataFrame, percent: int, most: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One round over regions(region, row, n) too large for a task: (edges of rows that link with
    a pivot, cells as regions of their own, regions that no pivots cut).

    Pivots are rows with the least hashes; each region's pivots meet its rows in as many salted
    copies as it has tasks' worth of shingles, so a region's size makes no task larger."""
    size = regions.groupBy("region").agg(F.sum("n").alias("all"), F.count("*").alias("rows"), F.array_distinct(F.array(*[F.min_by("row", F.xxhash64("row", F.lit(k))) for k in range(PIVOTS)])).alias("pivots"))
    size = stored(size.withColumn("salts", F.ceil(F.col("all") / most).cast("int")))
    pivots = size.select("region", F.explode("pivots").alias("row")).join(sets.select("row", "values"), "row").groupBy("region").agg(F.collect_list(F.struct("row", "values")).alias("pivots"))
    salted = pivots.join(size.select("region", "salts"), "region").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).select("region", "salt", "pivots")
    rows = regions.join(size.select("region", "salts"), "region").withColumn("salt", F.pmod(F.xxhash64("row"), F.col("salts")).cast("int")).join(sets.select("row", "values"), "row")
    celled = stored(rows.join(salted, ["region", "salt"]).select("region", "row", "n", "values", "pivots").mapInArrow(_pivoted(percent), "region bigint, row bigint, n bigint, near array<bigint>, own array<bigint>"))
    edges = celled.select(F.col("row").alias("a"), F.explode("near").alias("b")).where("a <> b")
    cells = celled.select("region", "row", "n", F.explode("own").alias("pivot"))
    parts = cells.groupBy("region", "pivot").agg(F.count("*").alias("part")).groupBy("region").agg(F.max("part").alias("part"), F.sum("part").alias("parts"))
    cut = parts.join(size.select("region", "rows"), "region").select("region", ((F.col("part") <= 0.9 * F.col("rows")) & (F.col("parts") < LEAST_CUT * PIVOTS * F.col("rows"))).alias("cut"))
    smaller = cells.join(cut.where("cut"), "region").select(F.xxhash64("region", "pivot").alias("region"), "row", "n")
    whole = regions.join(cut.where("NOT cut"), "region").select("region", "row", "n")
    return edges, smaller, whole


def _blocks(regions: DataFrame, known: DataFrame, most: int) -> DataFrame:
    """(region, i, j, row, known): pairs of blocks of the regions that no pivots cut, such that any two
    rows of groups that aren't known to be together meet. Rows of a region's largest group are
    together already and meet only the blocks of the others."""
    rows = regions.join(known, "row", "left").withColumn("known", F.coalesce("root", "row")).drop("root")
    largest = rows.groupBy("region", "known").agg(F.count("*").alias("c")).groupBy("region").agg(F.max_by("known", "c").alias("largest"))
    told = rows.join(largest, "region").withColumn("main", F.col("known") == F.col("largest"))
    n = lambda main: F.coalesce(F.ceil(2 * F.sum(F.when(F.col("main") == main, F.col("n"))) / most), F.lit(0)).cast("int")
    size = told.groupBy("region").agg(n(False).alias("others"), n(True).alias("mains"))
    block = lambda of: F.pmod(F.xxhash64("row"), F.greatest(F.lit(1), F.col(of))).cast("int")
    placed = told.join(size.where("others > 0"), "region").withColumn("at", F.when(F.col("main"), F.col("others") + block("mains")).otherwise(block("others")))
    upto = F.when(F.col("main"), F.col("others")).otherwise(F.col("others") + F.col("mains"))
    pairs = F.transform(F.sequence(F.lit(0), upto - 1), lambda k: F.struct(F.least("at", k).alias("i"), F.greatest("at", k).alias("j")))
    return placed.select("region", "row", "known", F.explode(pairs).alias("p")).select("region", "p.i", "p.j", "row", "known")


def _joined(regions: DataFrame, sets: DataFrame, percent: int, most: int) -> DataFrame:
    """(a, b): edges that join the rows of each region of regions(region, row, n) that links reach."""
    solve = lambda rows, *keys: rows.join(sets.select("row", "values"), "row").groupBy(*keys).applyInArrow(_links(percent), "a bigint, b bigint").where("a <> b")
    found, level = [], stored(regions)
    while True:
        size = level.groupBy("region").agg(F.sum("n").alias("all"), F.count("*").alias("rows")).where("rows > 1")
        small, large = (level.join(size.where(which), "region").select("region", "row", "n") for which in (F.col("all") <= most, F.col("all") > most))
        found.append(stored(solve(small.withColumn("known", F.col("row")), "region")))
        if not large.limit(1).count():
            dropped(level)
            break
        edges, smaller, whole = _cut_regions(stored(large), sets, percent, most)
        edges = stored(edges)
        found.append(edges)
        found.append(stored(solve(_blocks(whole, components(edges).withColumnRenamed("id", "row"), most), "region", "i", "j")))
        level = stored(smaller, instead=level)
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out


def jaccard_groups(docs: DataFrame, *, width: int = 3, percent: int = 90, id_column: str = "doc_id", text_column: str = "text", row_column: str | None = None, most_in_task: int = MOST_IN_TASK) -> DataFrame:
    """(row, id, n_shingles, component) for each row: `component` is the row number of the least row
    that links reach. Two rows are linked where 100 * intersection >= percent * union of their sets
    of `width`-word shingles (64-bit hashes of A-Z lower-cased words); with fewer words the whole
    sequence is the one shingle; null, empty and blank texts are linked with nothing. Row numbers
    stand for rows, so repeated ids and rows are told apart; row_column names numbers that numbered() has given
    already; other columns don't matter.

    All texts are read once for their keys, and those of documents that share enough of them once
    more. Equal sets meet as one set. A key costs one entry for each slice of the input that has
    it, however many rows do. Regions of more than most_in_task shingles are cut by pivots in
    rounds of their own; what pivots don't cut meets in pairs of blocks, without rows that are known
    to be together; only links that join groups are returned, never all pairs. Keys are told apart
    by 58 bits at least: a false meeting only lets two sets be looked at together."""
    read = docs.select(F.col(id_column).alias("id"), F.coalesce(text_column, F.lit("")).alias("text"), *([F.col(row_column).alias("row")] if row_column else []))
    read = read if row_column else numbered(read)
    size = read.agg(F.sum(F.octet_length("text"))).first()[0] or 1
    parts = max(1, int(size / BYTES_A_WORD * 2.2 * (100 - percent) / percent / KEYS_IN_TASK))
    kind, bits = docs.schema[id_column].dataType, _bits(parts)
    sent = _SENT.format(kind=kind.simpleString())
    told = stored(read.select("row", "id", "text").mapInArrow(_keyed(width, percent, bits), sent).repartition(parts, "bucket").mapInArrow(_shared, sent))
    judged = told.where("row IS NOT NULL").select("row", "id", "n", "seal")
    tallies = told.where("units IS NOT NULL").select("block", "units", "counts")
    alive = stored(tallies.repartition(parts, "block").mapInArrow(_alive, "row bigint"))
    leads = stored(judged.join(alive, "row").groupBy("seal", "n").agg(F.min("row").alias("row"), F.count("*").alias("copies")))
    total = leads.agg(F.sum("n")).first()[0] or 0
    count = max(1, -(-total // SLICE_SHINGLES))
    chosen = leads.select("row", "n", F.pmod(F.xxhash64("row"), F.lit(count)).alias("slice"))
    sets = stored(read.select("row", "text").join(chosen.hint("merge"), "row").mapInArrow(_valued(width), "row bigint, slice bigint, n bigint, values array<bigint>"))
    parts = max(1, int(total * 2.2 * (100 - percent) / percent / KEYS_IN_TASK))
    bits = _bits(parts)
    shared = sets.groupBy("slice").applyInArrow(_slice_keys(percent, bits), _COUNTED).repartition(parts, "bucket").mapInArrow(_frequent, "slice bigint, keys binary, totals binary")
    starred = sets.groupBy("slice").cogroup(shared.groupBy("slice")).applyInArrow(_rarest(percent, bits), _STARRED)
    touching = components(stored(starred.repartition(parts, "bucket").mapInArrow(_together, "a bigint, b bigint")))
    regions = touching.select(F.col("id").alias("row"), F.col("root").alias("region")).join(sets.select("row", "n"), "row")
    links = _joined(regions, sets, percent, most_in_task)
    same = judged.join(leads.where("copies > 1").select("seal", "n", F.col("row").alias("lead")), ["seal", "n"]).where("row <> lead").select(F.col("row").alias("a"), F.col("lead").alias("b"))
    linked = components(stored(links.union(same)))
    dropped(alive, leads, sets, touching)
    return judged.join(linked.withColumnRenamed("id", "row"), "row", "left").select("row", F.col("id").alias(id_column), F.col("n").alias("n_shingles"), F.coalesce("root", "row").alias("component"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = stored(jaccard_groups(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    least = groups.groupBy("component").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("n")).where("n > 1").drop("n")
    return groups.join(least, "component", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
