"""Vectorised tokens and hashes over batches of UTF-8 texts (numpy, no loop per word)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: The bytes that separate words: 0x09-0x0D and 0x20.
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_SALT = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (the splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_POSITION = mix(np.arange(1, 257, dtype=np.uint64) * _SALT) | np.uint64(1)


def _position_keys(n: int) -> np.ndarray:
    global _POSITION
    if n > len(_POSITION):
        _POSITION = mix(np.arange(1, 2 * n + 1, dtype=np.uint64) * _SALT) | np.uint64(1)
    return _POSITION


def chunks(texts: list[bytes], limit: int = 250_000) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about limit bytes, so that temporary arrays stay small; a longer text is a range of its own."""
    at, held = 0, 0
    for i, t in enumerate(texts):
        if held and held + len(t) > limit:
            yield at, i
            at, held = i, 0
        held += len(t) + 1
    if at < len(texts):
        yield at, len(texts)


def words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The joined bytes, each word's start and end in them, and each text's first word (with a closing total)."""
    buf = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    space = _SPACE[buf]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if len(buf) and not space[0]:
        edge = np.concatenate([[0], edge])
    starts, ends = edge[0::2], edge[1::2]
    lens = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    first = np.searchsorted(starts, np.concatenate([[0], np.cumsum(lens)]))
    return buf, starts, ends, first


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word: a random-key sum over its bytes, scrambled with its length."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lens = ends - starts
    keys = _position_keys(int(lens.max()))
    offsets = np.concatenate([[0], np.cumsum(lens)[:-1]])
    place = np.arange(int(lens.sum())) - np.repeat(offsets, lens)
    body = buf[np.repeat(starts, lens) + place].astype(np.uint64) + np.uint64(1)
    return mix(np.add.reduceat(body * keys[place], offsets) + lens.astype(np.uint64) * _SALT)


def shingle_sets(texts: list[bytes], size: int) -> list[np.ndarray]:
    """Each text's sorted distinct hashes of `size` consecutive words; with fewer words, of the whole sequence; without words, empty."""
    out: list[np.ndarray] = []
    for a, b in chunks(texts):
        buf, starts, ends, first = words(texts[a:b])
        h = word_hashes(buf, starts, ends)
        rolled = np.full(max(0, len(h) - size + 1), np.uint64(size))
        for j in range(size):
            rolled = mix(rolled * _SALT ^ h[j : j + len(rolled)])
        for i in range(b - a):
            lo, hi = int(first[i]), int(first[i + 1])
            if hi - lo >= size:
                out.append(np.unique(rolled[lo : hi - size + 1]))
            elif hi > lo:
                one = np.full(1, np.uint64(hi - lo))
                for j in range(lo, hi):
                    one = mix(one * _SALT ^ h[j : j + 1])
                out.append(one)
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """The intersection size of two sorted distinct arrays."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = len(b) - 1
    return int(np.count_nonzero(b[at] == a))
