"""Vectorised hashes of words and byte windows over many texts at once."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

_ODD = 0x9E3779B97F4A7C15
_INVERSE = pow(_ODD, -1, 1 << 64)


def mix64(x: np.ndarray) -> np.ndarray:
    """A permutation of 64-bit integers that spreads each bit over all others."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@lru_cache(maxsize=1)
def _byte_values() -> np.ndarray:
    return mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(_ODD))


_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base ** (0, 1, ..., n - 1), modulo 2 ** 64."""
    if len(_powers.get(base, ())) < n:
        x = np.full(max(n, 1 << 16), base, np.uint64)
        x[0] = 1
        _powers[base] = np.cumprod(x, dtype=np.uint64)
    return _powers[base][:n]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Sums from which window_hash has the hash of any piece of data: bytes, or 64-bit
    integers that are hashes themselves."""
    out = np.zeros(len(data) + 1, np.uint64)
    values = data if data.dtype == np.uint64 else _byte_values()[data]
    np.cumsum(values * _power(_ODD, len(data)), out=out[1:])
    return out


def window_hash(prefix: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each data[begin:end], the same wherever the bytes stand."""
    raw = (prefix[end] - prefix[begin]) * _power(_INVERSE, len(prefix))[begin]
    return mix64(raw + (end - begin).astype(np.uint64))


def run_hash(prefix: np.ndarray, size: int) -> np.ndarray:
    """window_hash of every piece of a size, in order."""
    raw = prefix[size:] - prefix[:-size]
    raw *= _power(_INVERSE, len(prefix))[: len(raw)]
    raw += np.uint64(size)
    return mix64(raw)


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def word_places(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The texts in one buffer, the begin and end of each word ``[^\\x20\\x09-\\x0D]+`` there,
    and the number of each text's first word (one more place at the end)."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    edge = np.flatnonzero(np.diff(_SPACE[data], prepend=True))  # starts and ends in turn
    begin, end = edge[::2], edge[1::2]
    stops = np.cumsum([len(t) + 1 for t in texts])
    return data, begin, end, np.concatenate(([0], np.searchsorted(begin, stops)))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts, and the number of each text's first word (one
    more place at the end)."""
    data, begin, end, at = word_places(texts)
    return window_hash(prefix_hash(data), begin, end), at


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of runs of the given lengths, one after another."""
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(int(lengths.sum()))


def shingle_sets(texts: list[bytes | None], size: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text, of the given number of words; a
    text of fewer words is one shingle, one without words none."""
    hashes, at = word_hashes([t or b"" for t in texts])
    out = []
    rolled = hashes * np.uint64(3)
    for k in range(1, size):
        rolled = mix64(rolled[:-1]) * np.uint64(_ODD) + hashes[k:] if len(rolled) else rolled
    for i in range(len(texts)):
        a, b = int(at[i]), int(at[i + 1])
        if b - a >= size:
            out.append(np.unique(rolled[a : b - size + 1]))
        elif b > a:
            h = np.uint64(b - a)
            for k in range(a, b):
                h = mix64(np.array([h]))[0] ^ hashes[k]
            out.append(np.array([h], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def grouped(texts: list, size: int):
    """Runs of neighbouring texts of about size bytes."""
    begin, held = 0, 0
    for i, t in enumerate(texts):
        held += 0 if t is None else len(t)
        if held >= size:
            yield texts[begin : i + 1]
            begin, held = i + 1, 0
    if begin < len(texts):
        yield texts[begin:]
