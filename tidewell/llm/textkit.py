"""Vectorised word hashing over batches of texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

U64 = np.uint64
WINDOW = 1 << 18
_P = 0x9E3779B97F4A7C15 | 1
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_BYTE = np.random.Generator(np.random.PCG64(7)).integers(1, 2**63, size=256, dtype=np.uint64)
_powers = [np.ones(1, dtype=U64), np.ones(1, dtype=U64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, 2 * len(_powers[0]))
        inverse = pow(_P, -1, 2**64)
        for k, base in enumerate((_P, inverse)):
            steps = np.full(size, base, dtype=U64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every output bit depends on every input bit."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def windows(data: np.ndarray, size: int = WINDOW) -> Iterator[tuple[int, int]]:
    """Limits of parts of about ``size`` bytes that end with white space, as ``data`` does: no word is cut."""
    at = 0
    while at < len(data):
        end = min(at + size, len(data))
        while end < len(data) and not _SPACE[data[end - 1]]:
            ahead = np.flatnonzero(_SPACE[data[end : end + size]])
            end = end + int(ahead[0]) + 1 if len(ahead) else min(end + size, len(data))
        yield at, end
        at = end


def words_in(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and 64-bit hashes of the words of bytes that end with white space; A-Z count as lower-case."""
    space = _SPACE[data]
    edge = np.empty(len(data), dtype=bool)
    edge[0] = True
    edge[1:] = space[:-1]
    starts = np.flatnonzero(edge & ~space)
    edge[:-1] = space[1:]
    edge[-1] = True
    ends = np.flatnonzero(edge & ~space) + 1
    up, down = _power_tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, dtype=U64)
    np.cumsum(_BYTE[_LOWER[data]] * up[: len(data)], out=sums[1:])
    return starts, mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U64))


def word_hashes(texts: list[str | None], slab: int = 4 * WINDOW):
    """Yield ``(offsets, hashes)`` for runs of texts of about ``slab`` bytes, one text at least.

    Words are maximal runs of anything but the six ASCII white-space characters, with A-Z lower-cased; text ``i`` of the
    run has the word hashes ``hashes[offsets[i]:offsets[i + 1]]``. A null text counts as empty. Bytes are worked on
    window by window, so besides its words a long text costs no more memory than a window.
    """
    held, size = [], 0
    for i, t in enumerate(texts):
        raw = t.encode("utf-8", "surrogatepass") if t else b""
        held.append(raw)
        size += len(raw) + 1
        if size >= slab or i == len(texts) - 1:
            data = np.frombuffer(b"\n".join(held) + b"\n", dtype=np.uint8)
            limits = np.cumsum([len(r) + 1 for r in held])
            found = [(a, *words_in(data[a:b])) for a, b in windows(data)]
            starts = np.concatenate([a + s for a, s, _ in found])
            offsets = np.zeros(len(held) + 1, dtype=np.int64)
            offsets[1:] = np.searchsorted(starts, limits)
            yield offsets, np.concatenate([h for *_, h in found])
            held, size = [], 0


def shingle_sets(texts: list[str | None], words: int):
    """Yield for every text its sorted distinct ``words``-word shingle hashes (fewer words: the whole sequence as one)."""
    for offsets, h in word_hashes(texts):
        rolled = h.copy()
        for k in range(1, words):
            rolled[:-k or None] = mix(rolled[:-k or None] * U64(0x9FB21C651E98DF25) + h[k:] + U64(k)) if len(h) > k else rolled[:-k or None]
        for a, b in zip(offsets[:-1], offsets[1:]):
            n = b - a
            if n == 0:
                yield np.empty(0, dtype=U64)
            elif n < words:
                whole = np.array([n], dtype=U64)
                for x in h[a:b]:
                    whole = mix(whole * U64(0x9FB21C651E98DF25) + x)
                yield whole
            else:
                yield np.unique(rolled[a : b - words + 1])
