"""Vectorised splitting of UTF-8 bytes into tokens and hashing of tokens."""

from __future__ import annotations

import numpy as np

U = np.uint64
_BASE = U(0x9E3779B97F4A7C15)
_pow = np.ones(1, U)

#: Bytes that are no part of a word: [\x20\x09-\x0D].
WHITE = np.zeros(256, bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True
#: All ASCII bytes but letters and digits; other characters count as letters.
PUNCT = np.ones(256, bool)
PUNCT[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
#: A-Z to a-z, others as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def powers(n: int) -> np.ndarray:
    """The base's first n powers modulo 2**64."""
    global _pow
    if len(_pow) < n:
        out = np.full(max(n, 2 * len(_pow), 1024), _BASE, U)
        out[0] = 1
        _pow = np.cumprod(out, dtype=U)
    return _pow[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all others."""
    h = h ^ (h >> U(30))
    h = h * U(0xBF58476D1CE4E5B9)
    h = h ^ (h >> U(27))
    h = h * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def spans(buf: np.ndarray, offsets: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the tokens of all rows laid end to end in buf, and how many tokens stand before each row's end."""
    n = len(buf)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets) - 1, np.int64)
    word = ~separators[buf]
    begins = np.zeros(n + 1, bool)
    begins[offsets] = True
    first = word.copy()
    first[1:] &= ~word[:-1] | begins[1:n]
    last = word.copy()
    last[:-1] &= ~word[1:] | begins[1:n]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets[1:])


#: Bytes of spans that are hashed at once (one span may be longer).
BLOCK = 4 << 20


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span's bytes."""
    if not len(starts):
        return np.zeros(0, U)
    lens = ends - starts
    upto = np.cumsum(lens)
    if upto[-1] > BLOCK and len(starts) > 1:
        cuts = np.unique(np.searchsorted(upto, np.arange(BLOCK, upto[-1] + BLOCK, BLOCK), side="right"))
        edges = np.unique(np.concatenate(([0], cuts, [len(starts)])))
        if len(edges) > 2:
            return np.concatenate([span_hashes(buf, starts[a:b], ends[a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True)])
    before = upto - lens
    off = np.arange(upto[-1]) - np.repeat(before, lens)
    of = buf[np.repeat(starts, lens) + off].astype(U) + U(1)
    of *= powers(int(lens.max()))[off]
    return mix(np.add.reduceat(of, before) + lens.astype(U))


def chain(*parts: np.ndarray) -> np.ndarray:
    """A hash of sequences: the n-th parts of them as arrays."""
    h = parts[0]
    for p in parts[1:]:
        h = mix(h * U(0xD6E8FEB86659FD93) + p)
    return h
