"""Token counts by a compiled transducer: a deterministic pre-tokenizer over character classes
whose transitions mark where pieces start, and a lazily compiled table of emitted-token counts for
the pieces that its transitions close. Long inputs are cut into chunks; each chunk gives a map from
start state to end state, and a parallel prefix scan over the maps gives every chunk's start."""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagetext.llm._arrays import buffers, slices

START, LETTERS, DIGITS, OTHER, QUOTE, QUOTE_R, QUOTE_V, QUOTE_L, BLANK, BLANKS, WHITE, WHITES = range(12)
STATES = 12
ONE, R, V, L, E, LETTER, DIGIT, SPACE, BREAK, APOSTROPHE, MARK, END = range(12)
CLASSES = 12
HERE, BEFORE = 1, 2  # a piece starts at this character, at the one before
CHUNK = 1024
MOST_CACHED = 1 << 20


def _compile() -> tuple[np.ndarray, np.ndarray]:
    """Next state and marked starts for each state and class: contractions, then words, numbers or
    other marks with one blank before, then white space, whose last character goes to what follows."""
    go, out = np.zeros((STATES, CLASSES), np.uint8), np.zeros((STATES, CLASSES), np.uint8)
    enters = {**dict.fromkeys((ONE, R, V, L, E, LETTER), LETTERS), DIGIT: DIGITS, SPACE: BLANK, BREAK: WHITE, APOSTROPHE: QUOTE, MARK: OTHER, END: START}
    for state in range(STATES):
        for kind, to in enters.items():
            go[state, kind], out[state, kind] = to, HERE * (kind != END)
    stay = [(LETTERS, k, LETTERS) for k in (ONE, R, V, L, E, LETTER)] + [(DIGITS, DIGIT, DIGITS)]
    stay += [(s, k, OTHER) for s in (OTHER, QUOTE) for k in (MARK, APOSTROPHE)]
    stay += [(QUOTE, ONE, START), (QUOTE, R, QUOTE_R), (QUOTE, V, QUOTE_V), (QUOTE, L, QUOTE_L), (QUOTE_R, E, START), (QUOTE_V, E, START), (QUOTE_L, L, START)]
    stay += [(s, k, to) for s in (BLANK, BLANKS, WHITE, WHITES) for k, to in ((SPACE, BLANKS), (BREAK, WHITES))]
    stay += [(BLANK, k, OTHER if k == APOSTROPHE else to) for k, to in enters.items() if k not in (SPACE, BREAK, END)]
    late = [(s, k) for s, closed in ((QUOTE_R, E), (QUOTE_V, E), (QUOTE_L, L)) for k in range(CLASSES) if k != closed]
    for s, k in late:  # the letter after the apostrophe was a word's first
        out[s, k] = BEFORE | (HERE if k not in (ONE, R, V, L, E, LETTER, END) else 0)
    for k in range(CLASSES):
        if k not in (SPACE, BREAK, END):
            go[BLANKS, k], out[BLANKS, k] = OTHER if k == APOSTROPHE else enters[k], BEFORE
            out[WHITES, k] = BEFORE | HERE
    for s, k, to in stay:
        go[s, k], out[s, k] = to, 0
    return go, out


GO, OUT = _compile()
_kinds: list[np.ndarray] = []


def kinds() -> np.ndarray:
    """Class of each code point."""
    if not _kinds:
        table = np.full(0x110000, MARK, np.uint8)
        every = "".join(map(chr, range(0x110000)))
        for pattern, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", DIGIT)):
            for run in regex.finditer(pattern, every):
                table[run.start() : run.end()] = kind
        _settle(table)
        table[[9, 10, 11, 12, 13, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = BREAK
        table[32], table[39] = SPACE, APOSTROPHE
        for letters, kind in (("stmd", ONE), ("r", R), ("v", V), ("l", L), ("e", E)):
            table[[ord(x) for x in letters]] = kind
        _kinds.append(table)
    return _kinds[0]


def _settle(table: np.ndarray) -> None:
    """Code points newer than this Python's tables: what the tokenizer library takes them for."""
    from tokenizers.pre_tokenizers import ByteLevel

    split = ByteLevel(add_prefix_space=False).pre_tokenize_str
    for c in np.flatnonzero(table != MARK):
        if unicodedata.category(chr(c)) == "Cn":
            table[c] = {2: LETTER, 1: DIGIT}.get(found[0][1][1], MARK) if len(found := split(f"a{chr(c)}1")) == 2 else MARK


def starts_of(kind: np.ndarray, chunk: int = CHUNK) -> np.ndarray:
    """Marks where pieces start, for classes that begin in START."""
    n = len(kind)
    columns = -(-n // chunk)
    grid = np.full(columns * chunk, END, np.uint8)
    grid[:n] = kind
    grid = np.ascontiguousarray(grid.reshape(columns, chunk).T)
    go, out = GO.ravel().astype(np.int16), OUT.ravel()
    maps = np.repeat(np.arange(STATES, dtype=np.int16)[:, None], columns, 1)
    for step, row in enumerate(grid):  # state maps of all chunks at once
        maps = go[maps * CLASSES + row]
        if step % 16 == 15 and (maps == maps[0]).all():
            single = maps[0]
            for rest in grid[step + 1 :]:
                single = go[single * CLASSES + rest]
            maps = np.repeat(single[None, :], STATES, 0)
            break
    reach = 1
    while reach < columns:  # prefix scan: map of chunk i after the maps of all before it
        maps[:, reach:] = maps[:, reach:][maps[:, :-reach], np.arange(columns - reach)]
        reach *= 2
    state = np.concatenate([[START], maps[START, :-1]]).astype(np.int16)
    marks = np.empty_like(grid)
    for i, row in enumerate(grid):
        at = state * CLASSES + row
        marks[i], state = out[at], go[at]
    flat = marks.T.ravel()[:n]
    found = (flat & HERE).astype(bool)
    found[:-1] |= (flat[1:] & BEFORE).astype(bool)
    return found


class PieceCounts(dict):
    """Tokens of a piece, compiled when first met; forgotten when the table grows too large."""

    def __init__(self, merges: list[tuple[str, str]]):
        super().__init__()
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in set(plain)]
        ids = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}
        self.ranks: dict[int, int] = {}  # of a pair of symbol ids
        self.made: list[int] = []  # symbol id by rank
        for rank, (a, b) in enumerate(merges):
            self.made.append(ids.setdefault(a + b, len(ids)))
            self.ranks.setdefault(ids[a] << 32 | ids[b], rank)

    def __missing__(self, piece: str) -> int:
        if len(self) > MOST_CACHED:
            self.clear()
        symbols = list(piece.encode("utf-8", "surrogatepass"))
        n = self[piece] = self._long(symbols) if len(symbols) > 64 else self._short(symbols)
        return n

    def _short(self, symbols: list[int]) -> int:
        rank, none = self.ranks.get, len(self.made)
        ranks = [rank(a << 32 | b, none) for a, b in zip(symbols, symbols[1:], strict=False)]
        while ranks and (best := min(ranks)) < none:
            at = ranks.index(best)
            symbols[at : at + 2] = [new := self.made[best]]
            del ranks[at]
            if at:
                ranks[at - 1] = rank(symbols[at - 1] << 32 | new, none)
            if at < len(ranks):
                ranks[at] = rank(new << 32 | symbols[at + 1], none)
        return len(symbols)

    def _long(self, symbols: list[int]) -> int:
        n, rank, gone = len(symbols), self.ranks.get, -1
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i) for i in range(n - 1) if (r := rank(symbols[i] << 32 | symbols[i + 1])) is not None]
        heapq.heapify(heap)
        left = n
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i]
            if symbols[i] == gone or j >= n or rank(symbols[i] << 32 | symbols[j]) != r:
                continue
            symbols[i], symbols[j] = self.made[r], gone
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            left -= 1
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n and (r := rank(symbols[x] << 32 | symbols[y])) is not None:
                    heapq.heappush(heap, (r, x))
        return left


_compiled: dict[str, PieceCounts] = {}


def count_tokens(texts: list[str], counts: PieceCounts, special: str, chunk: int = CHUNK) -> np.ndarray:
    """Tokens of each text; the special string is one token wherever it stands."""
    pieces, of, extra = [], [], np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        parts = text.split(special) if special and special in text else (text,)
        extra[i] = len(parts) - 1
        pieces += parts
        of += [i] * len(parts)
    whole = "\0".join([*pieces, ""])
    kind = kinds()[np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)]
    ends = np.cumsum([len(p) + 1 for p in pieces]) - 1
    kind[ends] = END
    found = starts_of(kind, chunk)
    found[ends] = False
    bound = found.copy()
    bound[ends] = True
    at = np.flatnonzero(bound)
    real = found[at]
    first = at[real]
    last = np.append(at[1:], len(whole))[real]
    n = np.fromiter((counts[whole[s:e]] for s, e in zip(first.tolist(), last.tolist(), strict=True)), np.int64, len(first))
    per_piece = np.bincount(np.searchsorted(ends, first), n, len(pieces))
    return (np.bincount(np.array(of), per_piece, len(texts)) if of else np.zeros(len(texts))).astype(np.int64) + extra


def token_counts(docs: DataFrame, vocabulary: str, *, id_column: str = "doc_id", text_column: str = "text", limit: int = 1024) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) for each row, by the byte-level BPE file `vocabulary`
    (tokenizers JSON). Null texts are empty; repeated rows and null ids stay; whole texts of any
    length are counted, chunk by chunk. The merges, of the vocabulary's fixed size, are broadcast."""
    with open(vocabulary, encoding="utf-8") as f:
        card = json.load(f)
    merges = [tuple(m if isinstance(m, list) else m.split(" ")) for m in card["model"]["merges"]]
    special = next((t["content"] for t in card["added_tokens"] if t["special"]), "")
    shared = docs.sparkSession.sparkContext.broadcast((vocabulary, merges, special))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, pairs, mark = shared.value
        if name not in _compiled:
            _compiled[name] = PieceCounts(pairs)
        counts = _compiled[name]
        for batch in batches:
            for first, last in slices(batch.column(1)):
                part = batch.slice(first, last - first)
                _, at = buffers(part.column(1))
                n = count_tokens([t or "" for t in part.column(1).to_pylist()], counts, mark)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(at)), pa.array(n), pa.array(n > limit)], ["id", "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema[id_column].dataType.simpleString()
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    return rows.mapInArrow(counted, f"id {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean").withColumnRenamed("id", id_column)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
