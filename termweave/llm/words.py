"""Words of UTF-8 texts as arrays: where they lie and 64-bit hashes of them and of runs of them, without a Python string each.

A word is a run of bytes other than space and tab to carriage return. Hashes are polynomials modulo 2**64 over random values of
the bytes, as differences of prefix sums, so a text costs a few array operations whatever its number of words; two of
them are independent.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

#: Longest stretch of bytes, or of words, that one prefix sum covers.
BLOCK = 1 << 16
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


class Polynomial:
    """Sums of value * factor**place, taken back to place 0 by the factor's inverse."""

    def __init__(self, seed: int):
        g = np.random.Generator(np.random.PCG64(seed))
        self.of_byte = g.integers(0, 1 << 64, 256, dtype=np.uint64, endpoint=False)
        factor = int(g.integers(0, 1 << 62, dtype=np.uint64)) * 2 + 1
        inverse = pow(factor, -1, 1 << 64)
        self.up, self.down = (np.cumprod(np.array([1] + [f] * BLOCK, np.uint64)) for f in (factor, inverse))

    def prefix(self, values: np.ndarray) -> np.ndarray:
        out = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * self.up[: len(values)], out=out[1:])
        return out


_polynomials: list[Polynomial] = []


def polynomial(i: int) -> Polynomial:
    while len(_polynomials) <= i:
        _polynomials.append(Polynomial(40 + len(_polynomials)))
    return _polynomials[i]


def find(data: np.ndarray, cuts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Where words start and end in ``data``; a word also ends where a text starts (``cuts``)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = ~SPACE[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    if cuts is not None:
        c = cuts[cuts < len(data)]
        first[c] = inside[c]
        c = c[c > 0]
        last[c - 1] = inside[c - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, k: int = 1) -> np.ndarray:
    """[k, word]"""
    out = np.zeros((k, len(starts)), np.uint64)
    i = 0
    while i < len(starts):
        base = starts[i]
        j = int(np.searchsorted(ends, base + BLOCK, "right"))
        if j <= i:  # one word of more than BLOCK bytes
            h = xxhash.xxh3_128_intdigest(data[base : ends[i]].tobytes())
            out[:, i] = [(h >> 64 * (q % 2)) & 0xFFFFFFFFFFFFFFFF for q in range(k)]
            i += 1
            continue
        piece, a, b = data[base : ends[j - 1]], starts[i:j] - base, ends[i:j] - base
        for q in range(k):
            p = polynomial(q)
            c = p.prefix(p.of_byte[piece])
            out[q, i:j] = mixed((c[b] - c[a]) * p.down[a] + (b - a).astype(np.uint64))
        i = j
    return out


def runs(h: np.ndarray, n: int, q: int = 0) -> np.ndarray:
    """The hash of each run of ``n`` of the hashes."""
    size = max(0, len(h) - n + 1)
    out, p = np.zeros(size, np.uint64), polynomial(q)
    step = BLOCK - n
    for i in range(0, size, step):
        c = p.prefix(h[i : i + step + n - 1])
        m = len(c) - n
        out[i : i + m] = mixed((c[n : n + m] - c[:m]) * p.down[:m])
    return out


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and where each row's begin, with the end; a null has none."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if not len(column) or column.buffers()[2] is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]
