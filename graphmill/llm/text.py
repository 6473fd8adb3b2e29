"""Text as flat numpy arrays: code points, classes, runs and 64-bit hashes of runs.

Everything works on a block of documents at once (a quarter of a million characters), so
that the cost per character is a few array passes and memory is bounded by the
longest single document.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3
#: Characters handled together, so that temporary arrays stay in the cache; a longer single text makes a block of its own.
BLOCK = 1 << 18
#: Unicode White_Space, which differs from str.isspace in U+001C..U+001F.
WHITE_SPACE = (9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)

_U = np.uint64
#: Modulus and bases of the two polynomials that hashes() evaluates.
_P = _U((1 << 31) - 1)
_BASES = (1_203_948_437, 1_871_530_229)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


@lru_cache(1)
def classes() -> np.ndarray:
    """Class of every code point."""
    table = np.zeros(0x110000, np.uint8)
    for i in range(0x110000):
        c = unicodedata.category(chr(i))[0]
        if c == "L":
            table[i] = LETTER
        elif c == "N":
            table[i] = NUMBER
    table[list(WHITE_SPACE)] = SPACE
    return table


@lru_cache(1)
def _salts() -> tuple[np.ndarray, np.ndarray]:
    """Two random numbers below the modulus for every code point."""
    x = mix(np.arange(0x110000, dtype=np.uint64) + _U(0x51ED270B))
    return (x >> _U(33)) % _P, (x & _P) % _P


def _fold(x: np.ndarray) -> np.ndarray:
    """A smaller number of the same remainder: below 2**33 for any x, at most the modulus + 2 for x below 2**33."""
    return (x & _P) + (x >> _U(31))


def _remainder(x: np.ndarray) -> np.ndarray:
    x = _fold(_fold(x))
    return np.where(x >= _P, x - _P, x)


_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """base ** i modulo the prime for i < n."""
    known = _POWERS.get(base, np.ones(1, np.uint64))
    if len(known) < n:
        out = known
        while len(out) < max(n, BLOCK + 4096):
            out = np.concatenate([out, _remainder(out * _U(pow(base, len(out), int(_P))))])
        if n > 4 * BLOCK:  # not kept: one very long text should not pin memory
            return out[:n]
        _POWERS[base] = known = out
    return known[:n]


def blocks(lengths: np.ndarray, limit: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Row ranges of at most limit characters each, or of one longer row."""
    ends = np.cumsum(lengths)
    lo = 0
    while lo < len(lengths):
        before = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, before + limit, "right")))
        yield lo, hi
        lo = hi


def codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts one after another, and where each text starts."""
    offs = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)), out=offs[1:])
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), offs


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of an Arrow string column without a copy, and where each text starts; null is empty."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    offs = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


def doc_starts(n: int, offs: np.ndarray) -> np.ndarray:
    """Flags of the positions at which a text starts."""
    out = np.zeros(n + 1, bool)
    out[offs] = True
    return out


def runs(inside: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of set flags that stay within one text."""
    n = len(inside)
    first = doc_starts(n, offs)
    start, end = inside.copy(), inside.copy()
    start[1:] &= ~inside[:-1] | first[1:n]
    end[:-1] &= ~inside[1:] | first[1:n]
    return np.flatnonzero(start), np.flatnonzero(end) + 1


def hashes(symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans: equal spans, equal hashes, wherever they stand.

    Two polynomials modulo a prime over random numbers for the symbols, from prefix sums; a
    modulus of 2**64 would have constructible collisions at every base. Two different spans
    of up to n symbols are equal with probability (n / 2**31)**2 at most, usually 2**-62;
    who needs spans told apart for certain compares them (see tokens.Cache).
    """
    out = np.zeros(len(starts), np.uint64)
    for base, salt in zip(_BASES, _salts()):
        sums = np.zeros(len(symbols) + 1, np.uint64)
        np.cumsum(_fold(salt[symbols] * _powers(base, len(symbols))), out=sums[1:])
        down = _powers(pow(base, -1, int(_P)), len(symbols) + 1)[starts]
        out = out << _U(31) | _remainder(_remainder(sums[ends] - sums[starts]) * down)
    return mix(out ^ mix((ends - starts).astype(np.uint64)))


def gram_hashes(symbols: np.ndarray, n: int) -> np.ndarray:
    """64-bit hashes of all runs of n symbols, by joining the hashes of shorter runs in pairs."""
    h, width = mix(symbols.astype(np.uint64) + _U(0x51ED270B)), 1
    while width < n and len(symbols) >= n:
        by = min(width, n - width)
        a, b = h[: len(h) - by], h[by:]
        h = (a ^ a >> _U(29)) * _U(0x9E3779B97F4A7C15) + b
        h ^= h >> _U(32)
        h *= _U(0xD6E8FEB86659FD93)
        width += by
    return h if len(symbols) >= n else h[:0]


_SPACE_BYTE = np.zeros(256, bool)
_SPACE_BYTE[[9, 10, 11, 12, 13, 32]] = True
_LOWER_BYTE = np.arange(256, dtype=np.uint8)
_LOWER_BYTE[65:91] += 32


def ascii_words(data: np.ndarray, offs: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words `[^\\x20\\x09-\\x0D]+` and, for each text, where its words start; lower: A-Z as a-z."""
    s, e = runs(~_SPACE_BYTE[data], offs)
    h = hashes(_LOWER_BYTE[data] if lower else data, s, e) if len(s) else np.zeros(0, np.uint64)
    return h, np.searchsorted(s, offs)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All positions of the spans (start, length), one after another."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    keep = lengths > 0
    starts, lengths = starts[keep], lengths[keep]
    out = np.ones(total, np.int64)
    at = np.zeros(len(lengths), np.int64)
    np.cumsum(lengths[:-1], out=at[1:])
    out[0] = starts[0]
    out[at[1:]] = starts[1:] - (starts[:-1] + lengths[:-1] - 1)
    return np.cumsum(out)
