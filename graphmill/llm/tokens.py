"""Pre-tokens of two public byte-pair vocabularies, found for whole blocks of text at once, with a bounded cache of their encodings.

A byte-pair model encodes each pre-token by itself, so a text's ids are the ids of its
pre-tokens one after another. Pre-tokens repeat: each worker encodes a new one once and
keeps it by its 64-bit hash, checked against its spelling.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from graphmill.llm import text as tx


def _contractions(c: np.ndarray, cls: np.ndarray, first: np.ndarray, start: np.ndarray, apostrophes: np.ndarray) -> None:
    """At the given starts, 's 't 'm 'd 're 've 'll are tokens of their own; what follows starts anew."""
    n = len(c)
    a = apostrophes[(apostrophes + 1 < n)]
    a = a[(cls[a + 1] == tx.LETTER) & ~first[a + 1]]
    if not len(a):
        return
    one = c[a + 1]
    pad = np.append(c, [0, 0])
    two = np.where(first[np.minimum(a + 2, n)], 0, pad[a + 2])
    single = np.isin(one, [ord(x) for x in "stmd"])
    double = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
    hit = single | double
    a, after = a[hit], (a + np.where(single, 2, 3))[hit]
    start[a + 1] = False
    go = (after < n) & ~first[np.minimum(after, n)]
    go[go] &= cls[after[go]] == tx.LETTER
    start[after[go]] = True


def byte_level_spans(c: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans of the pattern 's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+; they cover each text."""
    n = len(c)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cls, first = tx.classes()[c], tx.doc_starts(n, offs)
    start = first[:n].copy()
    start[1:] |= cls[1:] != cls[:-1]
    last = np.flatnonzero((cls[:-1] == tx.SPACE) & (cls[1:] != tx.SPACE) & ~first[1:n])
    start[last] = True
    start[last[c[last] == 32] + 1] = False
    _contractions(c, cls, first, start, np.flatnonzero((c == 39) & start))
    s = np.flatnonzero(start)
    return s, np.append(s[1:], n)


def word_level_spans(c: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans of the pattern 's|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+; white space is in none."""
    n = len(c)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cls, first = tx.classes()[c], tx.doc_starts(n, offs)
    start = first[:n].copy()
    start[1:] |= (cls[1:] != cls[:-1]) | (cls[1:] == tx.NUMBER)
    _contractions(c, cls, first, start, np.flatnonzero((c == 39) & start))
    s = np.flatnonzero(start)
    e = np.append(s[1:], n)
    word = cls[s] != tx.SPACE
    return s[word], e[word]


class Cache:
    """Numbers of pre-tokens: a two-choice table of hashes of fixed size in front of a pool that is emptied when it is full.

    make(strings) adds the values of new pre-tokens, numbered from size on. The hash only
    proposes: what it finds is compared with the pre-token's spelling, and two spellings of
    one hash are told apart by a dictionary.
    """

    def __init__(self, make: Callable[[list[str]], None], entries: int, bits: int = 21):
        self.make, self.entries, self.bits = make, entries, bits
        self.size = 0
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(1 << self.bits, np.uint64)
        self.at = np.zeros(1 << self.bits, np.int64)
        self.spelled, self.used = np.zeros(1 << 16, np.uint32), 0
        self.first, self.length = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)
        self.twins: dict[str, int] = {}

    def full(self) -> bool:
        return self.size >= self.entries

    def _add(self, strings: list[str]) -> np.ndarray:
        """Numbers of new pre-tokens."""
        self.make(strings)
        c, offs = tx.codes(strings)
        while self.used + len(c) > len(self.spelled):
            self.spelled = np.concatenate([self.spelled, np.zeros_like(self.spelled)])
        while self.size + len(strings) > len(self.first):
            self.first, self.length = (np.concatenate([x, np.zeros_like(x)]) for x in (self.first, self.length))
        number = self.size + np.arange(len(strings))
        self.first[number], self.length[number] = self.used + offs[:-1], np.diff(offs)
        self.spelled[self.used : self.used + len(c)] = c
        self.used += len(c)
        self.size += len(strings)
        return number

    def _other(self, c: np.ndarray, s: np.ndarray, e: np.ndarray, number: np.ndarray) -> np.ndarray:
        """Places at which the span is not spelled like the pre-token of that number."""
        n = e - s
        same = self.length[number] == n
        full = np.flatnonzero(same & (n > 0))
        if len(full):
            k = n[full]
            apart = c[tx.ragged(s[full], k)] != self.spelled[tx.ragged(self.first[number[full]], k)]
            same[full] = ~np.logical_or.reduceat(apart, np.cumsum(k) - k)
        return np.flatnonzero(~same)

    def look(self, c: np.ndarray, s: np.ndarray, e: np.ndarray, whole: str) -> np.ndarray:
        """Numbers of the pre-tokens c[s:e]; whole is c as a string."""
        h = tx.hashes(c, s, e)
        mask = np.uint64((1 << self.bits) - 1)
        a, b = (h & mask).astype(np.int64), ((h >> np.uint64(32)) & mask).astype(np.int64)
        in_a = self.keys[a] == h
        out = np.where(in_a, self.at[a], self.at[b])
        new = np.flatnonzero(~in_a & (self.keys[b] != h))
        if len(new):
            keys, first, inverse = np.unique(h[new], return_index=True, return_inverse=True)
            number = self._add([whole[s[i] : e[i]] for i in new[first].tolist()])
            out[new] = number[inverse]
            ka, kb = (keys & mask).astype(np.int64), ((keys >> np.uint64(32)) & mask).astype(np.int64)
            slot = np.where(self.keys[ka] == 0, ka, kb)
            self.keys[slot] = keys
            self.at[slot] = number
            # two new keys may meet in a slot: the last write wins in both arrays alike
        for i in self._other(c, s, e, out).tolist():
            word = whole[s[i] : e[i]]
            if word not in self.twins:
                self.twins[word] = int(self._add([word])[0])
            out[i] = self.twins[word]
        return out
