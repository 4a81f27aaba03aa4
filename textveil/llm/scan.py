"""Words, shingles and rolling hashes of many texts at once, over the UTF-8 bytes of an Arrow column."""

from __future__ import annotations

import numpy as np

#: Base of the polynomial hash modulo 2**64 (odd, so that it has an inverse).
BASE = 0x9E3779B97F4A7C15


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: each bit of the input moves each bit of the output."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int, base: int = BASE) -> tuple[np.ndarray, np.ndarray]:
    """base**k and base**-k modulo 2**64 for k up to ``n``, kept for the next call."""
    if base not in _powers or len(_powers[base][0]) <= n:
        size = 1 << max(19, int(n + 1).bit_length())
        made = []
        for b in (base, pow(base, -1, 1 << 64)):
            x = np.full(size, b, np.uint64)
            x[0] = 1
            made.append(np.multiply.accumulate(x))
        _powers[base] = made[0], made[1]
    up, down = _powers[base]
    return up[: n + 1], down[: n + 1]


def byte_values(lower: bool, seed: int = 1) -> np.ndarray:
    """A random 64-bit value for each byte; with ``lower``, A-Z have those of a-z."""
    v = mixed((np.arange(256, dtype=np.uint64) + np.uint64(1 + 256 * seed)) * np.uint64(0xD1342543DE82EF95))
    if lower:
        v[65:91] = v[97:123]
    return v


#: Classes of bytes: 0 ends a word; neighbours of different classes are different words.
SPACED = np.ones(256, np.uint8)
SPACED[[32, *range(9, 14)]] = 0
MARKED = np.where((np.arange(256) >= 128) | np.isin(np.arange(256), [*range(48, 58), *range(65, 91), *range(97, 123)]), 1, 2).astype(np.uint8) * SPACED


def prefix_sums(buf: np.ndarray, values: np.ndarray, base: int = BASE) -> tuple[np.ndarray, np.ndarray]:
    up, down = powers(len(buf), base)
    s = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(values[buf] * up[: len(buf)], out=s[1:])
    return s, down


def words(buf: np.ndarray, off: np.ndarray, classes: np.ndarray = SPACED, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end, row) of each word. Words never cross rows."""
    n = len(buf)
    if not n:
        e = np.empty(0, np.int64)
        return np.empty(0, np.uint64), e, e, e
    k = classes[buf]
    cut = np.empty(n, bool)
    cut[0] = True
    np.not_equal(k[1:], k[:-1], out=cut[1:])
    cut[off[:-1][off[:-1] < n]] = True
    start = np.flatnonzero(cut)
    end = np.append(start[1:], n)
    live = k[start] != 0
    start, end = start[live], end[live]
    s, down = prefix_sums(buf, byte_values(lower))
    return mixed((s[end] - s[start]) * down[start]), start, end, np.searchsorted(off, start, "right") - 1


def row_counts(row: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(row, minlength=n).astype(np.int64)


def shingles(h: np.ndarray, row: np.ndarray, n: int, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``width`` words in a row, with the offsets of each row's hashes; a row of fewer words has one for the whole, one without words none."""
    count = row_counts(row, n)
    made = np.where(count >= width, count - width + 1, np.minimum(count, 1))
    off = np.concatenate(([0], np.cumsum(made)))
    first = np.concatenate(([0], np.cumsum(count)))[:-1]
    at = np.repeat(first - off[:-1], made) + np.arange(off[-1])
    have = np.repeat(np.minimum(count, width), made)
    pad = np.concatenate((h, np.zeros(width, np.uint64)))
    total = have.astype(np.uint64) * np.uint64(0xA0761D6478BD642F)
    for k in range(width):
        part = pad[at + k] * np.uint64(pow(BASE, 3 * k + 1, 1 << 64))
        if have.size and have.min() <= k:
            part = np.where(have > k, part, np.uint64(0))
        total += part
    return mixed(total), off


def distinct(values: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's distinct values in ascending order, with their offsets."""
    parts = [np.unique(values[a:b]) for a, b in zip(off[:-1], off[1:], strict=True)]
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    return (np.concatenate(parts) if parts else values[:0]), np.concatenate(([0], np.cumsum(sizes)))


def sliding_min_argleft(h: np.ndarray, width: int) -> np.ndarray:
    """For each window of ``width`` values the place of its least value, the leftmost where several are least."""
    n = len(h) - width + 1
    if n <= 0:
        return np.empty(0, np.int64)
    value, place, have = h, np.arange(len(h), dtype=np.int64), 1

    def join(step: int, v, p):
        a, b, pa_, pb = v[:-step], v[step:], p[:-step], p[step:]
        right = b < a
        return np.where(right, b, a), np.where(right, pb, pa_)

    while have * 2 <= width:
        value, place = join(have, value, place)
        have *= 2
    if have < width:
        value, place = join(width - have, value, place)
    return place[:n]
