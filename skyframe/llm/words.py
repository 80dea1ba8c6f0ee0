"""Words of a text as 64-bit hashes, computed over whole arrays.

A word is a run of letters and digits of the lower-cased text; a run beyond 65,536 code points is cut there.
Its hash is a polynomial over the code points modulo 2^64, finished with a bit mixer, so prefixes of words get
hashes from the same running sums."""

from __future__ import annotations

import functools

import numpy as np

LONGEST = 1 << 16
BLOCK = 1 << 19
BASE = 0x9E3779B97F4A7C15


@functools.cache
def word_table() -> np.ndarray:
    return np.fromiter((chr(i).isalnum() for i in range(0x110000)), bool, 0x110000)


@functools.cache
def powers() -> tuple[np.ndarray, np.ndarray]:
    """BASE^i and its inverse modulo 2^64, for every place in a block."""
    n = BLOCK + LONGEST + 1
    with np.errstate(over="ignore"):
        up = np.cumprod(np.full(n, BASE, np.uint64))
        down = np.cumprod(np.full(n, pow(BASE, -1, 1 << 64), np.uint64))
    return up, down


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finisher on 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def spans(cp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words among the code points."""
    inside = np.zeros(len(cp) + 2, np.int8)
    inside[1:-1] = word_table()[cp]
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[0::2], edges[1::2]
    if len(starts) and int((ends - starts).max()) > LONGEST:
        pieces = [np.arange(s, e, LONGEST) for s, e in zip(starts, ends, strict=True)]
        last = [np.minimum(p + LONGEST, e) for p, e in zip(pieces, ends, strict=True)]
        starts, ends = np.concatenate(pieces), np.concatenate(last)
    return starts, ends


def word_hashes(text: str, prefixes: tuple[int, ...] = ()) -> tuple[np.ndarray, ...]:
    """Hashes of the words in order; with ``prefixes``, one more array for each length with the hashes of the
    word's first so many code points (0 where the word is not longer than that)."""
    cp = points(text.lower())
    starts, ends = spans(cp)
    up, down = powers()
    out = [np.empty(len(starts), np.uint64) for _ in range(1 + len(prefixes))]
    first = 0
    while first < len(starts):
        origin = int(starts[first])
        last = max(first + 1, int(np.searchsorted(ends, origin + BLOCK, "right")))
        s, e = starts[first:last] - origin, ends[first:last] - origin
        sums = np.zeros(int(e[-1]) + 1, np.uint64)
        np.cumsum((cp[origin:origin + int(e[-1])].astype(np.uint64) + np.uint64(1)) * up[:int(e[-1])], out=sums[1:])
        back, base = down[s], sums[s]
        out[0][first:last] = mix((sums[e] - base) * back)
        for k, length in enumerate(prefixes, 1):
            at = np.minimum(s + length, e)
            out[k][first:last] = np.where(e - s > length, mix((sums[at] - base) * back + np.uint64(length)), np.uint64(0))
        first = last
    return tuple(out) if prefixes else (out[0],)


def shingles(words: np.ndarray, width: int = 5) -> np.ndarray:
    """Hashes of the runs of ``width`` words; a shorter text with any word has the one run of all its words."""
    if len(words) == 0:
        return words
    n = max(1, len(words) - width + 1)
    out = np.full(n, len(words) if len(words) < width else width, np.uint64)
    for k in range(min(width, len(words))):
        out = mix(out * np.uint64(BASE) + words[k:k + n])
    return out
