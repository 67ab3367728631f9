"""Vectorised text kernels: word hashes and word shingles of a batch of texts, in NumPy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Bytes of text that are hashed together; a longer text is hashed alone.
CHUNK = 1 << 19
ODD = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTE = np.random.Generator(np.random.PCG64(20)).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: nearby values become unrelated ones."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(kind: str, base: np.uint64, n: int) -> np.ndarray:
    if len(_powers[kind]) < n:
        steps = np.full(n, base, np.uint64)
        steps[0] = 1
        _powers[kind] = np.cumprod(steps, dtype=np.uint64)
    return _powers[kind]


def chunks(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about CHUNK bytes."""
    start = held = 0
    for i, t in enumerate(texts):
        if i > start and held + len(t) > CHUNK:
            yield start, i
            start, held = i, 0
        held += len(t) + 1
    if start < len(texts):
        yield start, len(texts)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The 64-bit hashes of all white-space separated words, and where each text's words begin (one more entry)."""
    raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    space = _SPACE[raw]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], space)).view(np.int8)))  # starts and ends by turns
    starts, ends = edge[0::2], edge[1::2]
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE[raw] * _power("up", ODD, len(raw))[: len(raw)], out=sums[1:])
    words = mixed((sums[ends] - sums[starts]) * _power("down", _INVERSE, len(raw))[: len(raw)][starts])
    offsets = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])))
    return words, np.searchsorted(starts, offsets)


def shingle_hashes(words: np.ndarray, begins: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of `width` words of each text, and where each text's begin; a text with fewer words has one, of all of them."""
    counts = np.diff(begins)
    if len(words) < width:
        grams = np.zeros(0, np.uint64)
    else:
        n = len(words) - width + 1
        grams = np.zeros(n, np.uint64)
        for j in range(width):
            grams = (grams ^ words[j : j + n]) * ODD
            grams ^= grams >> np.uint64(29)
        grams = mixed(grams)
    full = np.maximum(counts - width + 1, 0)
    short = (counts > 0) & (counts < width)
    sizes = full + short
    out_begins = np.concatenate(([0], np.cumsum(sizes)))
    out = np.empty(out_begins[-1], np.uint64)
    owner = np.repeat(np.arange(len(counts)), counts)
    at = np.arange(len(words))
    inside = at < (begins[1:] - width + 1)[owner]
    place = at - begins[:-1][owner] + out_begins[:-1][owner]
    out[place[inside]] = grams[np.flatnonzero(inside)]
    for i in np.flatnonzero(short):
        h = np.array([counts[i]], np.uint64)
        for j in range(begins[i], begins[i + 1]):
            h = mixed((h ^ words[j : j + 1]) * ODD)
        out[out_begins[i]] = h[0]
    return out, out_begins
