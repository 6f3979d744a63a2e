"""Splits and hashes the words of whole Arrow batches with numpy.

Texts stay in Arrow's UTF-8 buffer; words are (start, end) byte positions in
it and each has a 64-bit hash. No Python object is made for a word. Work is
done in slices of bounded size, so memory does not follow the batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_SLICE = 4 << 20
_LONG = 1024


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads all 64 bits (the constants of splitmix64)."""
    x = x + U64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def powers(base: int, n: int) -> np.ndarray:
    p = np.full(max(n, 1), base, dtype=U64)
    p[0] = 1
    return np.cumprod(p, dtype=U64)


_MASK = np.array([0xFFFFFFFFFFFFFFFF >> (64 - 8 * n) if n else 0 for n in range(9)], U64)

#: Bytes between words: ASCII white space only.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes between words: everything in ASCII but letters and digits.
NON_ALNUM = np.zeros(256, bool)
NON_ALNUM[[*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = True
SAME = np.arange(256, dtype=np.uint8)
#: A-Z to a-z.
LOWER = SAME.copy()
LOWER[0x41:0x5B] += 32


@dataclass
class Words:
    """Words of several texts. Text i has the words first[i] to first[i + 1]."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    first: np.ndarray

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def text_of(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts())


def buffer(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "").cast(pa.large_string())
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]] if len(offs) else raw, offs - (offs[0] if len(offs) else 0)


def slices(batch: pa.RecordBatch, column: str, most: int = _SLICE) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about `most` bytes of text, one row at least."""
    _, offs = buffer(batch.column(column))
    at, n = 0, batch.num_rows
    while at < n:
        to = max(at + 1, int(np.searchsorted(offs, offs[at] + most, side="right")) - 1)
        yield batch.slice(at, min(to, n) - at)
        at = min(to, n)


def _hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: np.ndarray) -> np.ndarray:
    """Mixes in eight bytes of every word at a time; words over _LONG bytes go one by one."""
    held = np.concatenate([data if fold is SAME else fold[data], np.zeros(8, np.uint8)])
    eight = np.ndarray((len(held) - 7,), np.dtype("<u8"), held, strides=(1,))
    lens = ends - starts
    out = mix(lens.astype(U64))
    at, k = np.flatnonzero(lens <= _LONG), 0
    while len(at):
        x = eight[starts[at] + k] & _MASK[np.minimum(lens[at] - k, 8)]
        out[at] = mix(out[at] ^ x) if k else mix(out[at] + x)
        k += 8
        at = at[lens[at] > k]
    for i in np.flatnonzero(lens > _LONG):
        out[i] = int.from_bytes(blake2b(held[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return out


def split(column: pa.Array, sep: np.ndarray = SPACE, fold: np.ndarray = SAME, hashed: bool = True) -> Words:
    data, offs = buffer(column)
    inside = ~sep[data]
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    at = offs[:-1][offs[:-1] < offs[1:]]
    start[at] = inside[at]
    end = inside.copy()
    end[:-1] &= ~inside[1:] | start[1:]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return Words(data, starts, ends, _hashes(data, starts, ends, fold) if hashed else np.zeros(0, U64), np.searchsorted(starts, offs))


def shingles(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of k consecutive words at each place; the last k - 1 are cut off."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    p, out = powers(0xD1342543DE82EF95, k), np.zeros(n, U64)
    for i in range(k):
        out += h[i : i + n] * p[i]
    return mix(out)


_Q, _QI = 0xDA942042E4DD58B5, pow(0xDA942042E4DD58B5, -1, 1 << 64)


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """As shingles(), in time that does not follow k."""
    if len(h) < k:
        return np.zeros(0, U64)
    c = np.concatenate([np.zeros(1, U64), np.cumsum(h * powers(_Q, len(h)), dtype=U64)])
    return mix((c[k:] - c[:-k]) * powers(_QI, len(h))[: len(h) - k + 1])


def sliding_min(x: np.ndarray, k: int) -> np.ndarray:
    """The smallest of k consecutive values at each place."""
    n, have, out = len(x) - k + 1, 1, x
    if n <= 0:
        return x[:0]
    while have < k:
        step = min(have, k - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out[:n]


def fold_all(h: np.ndarray, seed: int) -> int:
    """One hash of a whole sequence."""
    with np.errstate(over="ignore"):
        total = np.sum(h * powers(_Q + 2 * seed, len(h)), dtype=U64) if len(h) else U64(0)
        return int(mix(np.array([total ^ U64(len(h)) ^ (U64(seed) << U64(48))], U64))[0])


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
