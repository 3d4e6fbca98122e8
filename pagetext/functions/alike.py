"""How alike the texts of many pairs are, with numpy: folded texts as codes, distances of all pairs at once."""

from __future__ import annotations

import difflib
import unicodedata
from decimal import ROUND_HALF_UP, Decimal

import numpy as np

LETTERS = b"0123456789abcdefghijklmnopqrstuvwxyz"
WORD = 64
AT_ONCE = 1 << 15  # pairs whose bit columns are worked on together, so that they stay in the cache
_LOWER = bytes(range(256)).lower()
_OTHER = bytes(i for i in range(256) if i and i not in LETTERS + LETTERS.upper())
_CODE = np.zeros(256, np.uint8)
_CODE[list(LETTERS)] = np.arange(len(LETTERS))


def folded(texts: list[str]) -> list[bytes]:
    """NFKD without combining marks, lower case, letters a-z and digits alone: of all texts in one go."""
    if not texts:
        return []
    whole = unicodedata.normalize("NFKD", "\0".join(t.replace("\0", "") if "\0" in t else t for t in texts))
    return whole.encode("ascii", "ignore").translate(_LOWER, _OTHER).split(b"\0")


class Texts:
    """Folded texts: codes one after the other, where each starts and how long it is."""

    def __init__(self, texts: list[bytes]):
        self.texts = texts
        self.codes = _CODE[np.frombuffer(b"".join(texts), np.uint8)]
        self.size = np.fromiter(map(len, texts), np.int64, len(texts))
        self.start = np.cumsum(self.size) - self.size

    def letters(self) -> np.ndarray:
        """How often each letter is in each text."""
        of = np.repeat(np.arange(len(self.size)), self.size)
        return np.bincount(of * len(LETTERS) + self.codes, minlength=len(self.size) * len(LETTERS)).reshape(-1, len(LETTERS))

    def distances(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Levenshtein distance of the texts x[i] and y[i]: columns of the table as bits, a letter of the
        longer text at a time for all pairs; shorter texts of more than 64 letters take several words."""
        swap = self.size[x] > self.size[y]
        x, y = np.where(swap, y, x), np.where(swap, x, y)
        words = np.maximum(1, -(-self.size[x] // WORD))
        found = np.empty(len(x), np.int64)
        order = np.lexsort((-self.size[y], words))
        for same in np.split(order, np.flatnonzero(np.diff(words[order])) + 1):
            for first in range(0, len(same), AT_ONCE):
                some = same[first : first + AT_ONCE]
                found[some] = self._columns(x[some], y[some], int(words[some[0]]))
        return found

    def _columns(self, x: np.ndarray, y: np.ndarray, words: int) -> np.ndarray:
        own, row = np.unique(x, return_inverse=True)
        size = self.size[own]
        of, place = np.repeat(np.arange(len(own)), size), np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        has = np.zeros(len(own) * words * len(LETTERS), np.uint64)
        one = np.uint64(1)
        np.add.at(has, (of * words + place // WORD) * len(LETTERS) + self.codes[np.repeat(self.start[own], size) + place], one << (place % WORD).astype(np.uint64))
        row = row * (words * len(LETTERS))
        start, end = self.start[y], self.size[y]
        last = ((self.size[x] - 1) % WORD).astype(np.uint64)
        score = self.size[x].copy()
        score[score == 0] = end[score == 0]
        up, down = [np.full(len(x), ~np.uint64(0)) for _ in range(words)], [np.zeros(len(x), np.uint64) for _ in range(words)]
        live = np.searchsorted(-end, -np.arange(1, end.max(initial=0) + 1), side="right")  # longer ones come first
        for j, n in enumerate(live.tolist()):
            at = row[:n] + self.codes[start[:n] + j]
            more, less = one, np.uint64(0)
            for w in range(words):
                eq, pv, mv = has[at + w * len(LETTERS)], up[w][:n], down[w][:n]
                xv = eq | mv
                eq = eq | less
                xh = (((eq & pv) + pv) ^ pv) | eq
                ph, mh = mv | ~(xh | pv), pv & xh
                if w == words - 1:
                    score[:n] += ((ph >> last[:n]) & one).astype(np.int64) - ((mh >> last[:n]) & one).astype(np.int64)
                after = ph >> np.uint64(63), mh >> np.uint64(63)
                ph, mh = (ph << one) | more, (mh << one) | less
                up[w][:n] = mh | ~(xv | ph)
                down[w][:n] = ph & xv
                more, less = after
        return np.where(self.size[x] == 0, end, score)

    def ratcliff(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Ratcliff-Obershelp similarity of the texts x[i] and y[i]."""
        found, matcher, before = np.empty(len(x)), difflib.SequenceMatcher(None, autojunk=False), -1
        for i in np.argsort(y, kind="stable").tolist():
            if y[i] != before:
                before = y[i]
                matcher.set_seq2(self.texts[before])
            matcher.set_seq1(self.texts[x[i]])
            found[i] = matcher.ratio()
        return found


def six_decimals(values: np.ndarray) -> np.ndarray:
    """Rounded half up from their shortest decimal forms, as Spark's round does."""
    own, back = np.unique(values, return_inverse=True)
    return np.array([float(Decimal(repr(v)).quantize(Decimal("1e-6"), ROUND_HALF_UP)) for v in own.tolist()])[back] if len(own) else values
