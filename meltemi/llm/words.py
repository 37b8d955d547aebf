"""Words and their fingerprints from the bytes of many texts at once, in numpy."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_BASE, _MIX = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_MASK = (1 << 64) - 1


def _table(separators: range | list[int] | set[int]) -> np.ndarray:
    """For every byte, A-Z lowered: the byte it stands for, 0 for a separator."""
    out = np.arange(256, dtype=np.uint8)
    out[0x41:0x5B] += 32
    out[list(separators)] = 0
    return out


#: Fixed: words of letters, digits and non-ASCII bytes; everything else of ASCII separates.
ALNUM = _table({*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)})
#: Fixed: ASCII white space; the other kind of words is of anything else.
BLANK = {0x20, *range(0x09, 0x0E)}


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up = np.full(n, _BASE, np.uint64)
    down = np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, at least n of each."""
    size = 1 << max(20, int(n).bit_length())
    up, down = _powers(size)
    return up[:n], down[:n]


#: Two primes below 2^31 and a base for each: words are told apart by their polynomials modulo both.
_PRIMES = ((2_147_483_647, 1_402_024_253), (2_147_483_629, 871_537_019))


@lru_cache(maxsize=4)
def _prime_powers(size: int, prime: int, base: int) -> np.ndarray:
    out = np.ones(size, np.uint64)
    k = 1
    while k < size:
        out[k : 2 * k] = out[: min(k, size - k)] * np.uint64(pow(base, k, prime)) % np.uint64(prime)
        k *= 2
    return out.astype(np.uint32)


def word_prints(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit fingerprints of the spans of ``low``, never 0.

    A polynomial modulo 2^64 gives some different words the same value whatever the base; modulo a prime, two words of n bytes agree for at most n of all bases.
    """
    n = len(low)
    size = 1 << max(16, int(n + 1).bit_length())
    joined = np.zeros(len(starts), np.uint64)
    for prime, base in _PRIMES:
        up, down, p = _prime_powers(size, prime, base), _prime_powers(size, prime, pow(base, -1, prime)), np.uint64(prime)
        terms = (low.astype(np.uint64) + np.uint64(1)) * up[:n]
        if n >= 1 << 24:  # sums of fewer such terms stay below 2^63
            terms %= p
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(terms, out=total[1:])
        joined = (joined << np.uint64(31)) | ((total[ends] - total[starts]) % p * down[starts] % p)
    h = mixed(joined)
    return np.where(h == 0, np.uint64(1), h)


def mixed(h: np.ndarray) -> np.ndarray:
    """Every bit of the input on every bit of the output."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(_MIX)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(_BASE)
    return h ^ (h >> np.uint64(32))


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts joined, offsets of each); a null has none."""
    texts = pc.fill_null(texts, "").cast(pa.large_binary())
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return raw, at - at[0]


class Words:
    """Words of a block of texts: byte span, fingerprint, and per text the range of its words.

    Fingerprints are those of :func:`word_prints` over the word's bytes (A-Z lowered). No word crosses texts.
    """

    def __init__(self, texts: pa.Array, kind: str = "alnum") -> None:
        self.raw, self.offsets = utf8(texts)
        raw, n = self.raw, len(self.raw)
        if kind == "alnum":
            low = ALNUM[raw]
            inside = low != 0
        else:
            low = _table(())[raw]
            inside = ~np.isin(raw, list(BLANK)) if n else np.zeros(0, bool)
        edge = np.zeros(n + 1, bool)
        edge[self.offsets] = True
        before = np.zeros(n + 1, bool)
        before[1:] = inside
        now = np.zeros(n + 1, bool)
        now[:-1] = inside
        self.starts = np.flatnonzero(now & (~before | edge))
        self.ends = np.flatnonzero(before & (~now | edge))
        self.prints = word_prints(low, self.starts, self.ends)
        #: Word range of text i: first[i] to first[i + 1].
        self.first = np.searchsorted(self.starts, self.offsets)
        self.low = low

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def text_of(self) -> np.ndarray:
        """The text's number of every word."""
        return np.repeat(np.arange(len(self.counts)), self.counts)


def shingles(prints: np.ndarray, size: int) -> np.ndarray:
    """Fingerprints of the runs of ``size`` consecutive words, by place of the first word."""
    n = len(prints) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for k in range(size):
        h = h * np.uint64(_BASE) + prints[k : k + n]
    return mixed(h)
