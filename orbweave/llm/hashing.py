"""64-bit hashes of the words and shingles of many texts at once, without a Python object a word.

A word's hash is a sum over its bytes of a random value of the byte times a power of its place in the word, modulo 2^64, then
mixed. It doesn't depend on where the word stands.
"""

from __future__ import annotations

import functools

import numpy as np

#: Bytes whose values are worked out at once, unless one word alone has more.
RUN_BYTES = 1 << 18
M1, M2, M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
BASE = 0x5851F42D4C957F2D
SPACES = [0x20, *range(0x09, 0x0E)]
IS_SPACE = np.isin(np.arange(256), SPACES)


def values(fold: bool) -> np.ndarray:
    """A random value of each byte, none for white space; with fold A-Z have those of a-z."""
    out = np.random.Generator(np.random.PCG64(19)).integers(1, 1 << 64, 256, np.uint64)
    out[IS_SPACE] = 0
    if fold:
        out[0x41:0x5B] = out[0x61:0x7B]
    return out


VALUES = {fold: values(fold) for fold in (False, True)}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (splitmix64's finish)."""
    x = (x ^ (x >> np.uint64(30))) * M2
    x = (x ^ (x >> np.uint64(27))) * M3
    return x ^ (x >> np.uint64(31))


@functools.lru_cache(2)
def powers(bits: int) -> np.ndarray:
    x = np.full(1 << bits, BASE, np.uint64)
    x[0] = 1
    return np.multiply.accumulate(x)


def word_places(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first byte of each word, byte after it, n + 1 bounds of the texts in words). Text i is data[at[i] : at[i + 1]]; words are
    what stands between white space (0x20, 0x09 to 0x0D) and the texts' edges."""
    solid = ~IS_SPACE[data]
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    inner = at[(at > 0) & (at < len(data))]
    first[inner], last[inner - 1] = solid[inner], solid[inner - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, at)


def long_word(data: np.ndarray, value: np.ndarray) -> int:
    """The sum of a word that is longer than a run, by pieces."""
    total = 0
    for a in range(0, len(data), RUN_BYTES):
        part = value[data[a : a + RUN_BYTES]]
        total += int((part * powers(RUN_BYTES.bit_length())[: len(part)]).sum(dtype=np.uint64)) * pow(BASE, a, 1 << 64)
    return total % (1 << 64)


def word_hashes(data: np.ndarray, at: np.ndarray, fold: bool) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, n + 1 bounds of the texts in words)."""
    starts, stops, bounds = word_places(data, at)
    size, out, value = stops - starts, np.empty(len(starts), np.uint64), VALUES[fold]
    upto = np.concatenate([[0], np.cumsum(size)])
    i = 0
    while i < len(starts):
        if size[i] > RUN_BYTES:
            out[i] = long_word(data[starts[i] : stops[i]], value)
            i += 1
            continue
        j = int(np.searchsorted(upto, upto[i] + RUN_BYTES, side="right")) - 1
        local = upto[i:j] - upto[i]
        place = np.arange(upto[j] - upto[i]) - np.repeat(local, size[i:j])
        terms = value[data[np.repeat(starts[i:j], size[i:j]) + place]]
        terms *= powers(max(6, int(size[i:j].max()).bit_length()))[place]
        out[i:j] = np.add.reduceat(terms, local)
        i = j
    return mix(out), bounds


def joined(w: np.ndarray, k: int, n: int) -> np.ndarray:
    """Hashes of the n windows of k adjacent words at the beginning of w."""
    h = np.full(n, k, np.uint64)
    for i in range(k):
        h = mix(h * M1 + w[i : i + n])
    return h


def shingle_sets(data: np.ndarray, at: np.ndarray, k: int) -> list[np.ndarray]:
    """Of each text the distinct hashes of its k-word shingles, ascending as signed integers; A-Z lower-cased. Fewer words are
    one shingle, no words none."""
    w, bounds = word_hashes(data, at, True)
    every = joined(w, k, max(0, len(w) - k + 1)).view(np.int64)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= k:
            out.append(np.unique(every[a : b - k + 1]))
        else:
            out.append(joined(w[a:b], b - a, min(1, b - a)).view(np.int64))
    return out
