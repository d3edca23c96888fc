"""Vectorised word splitting and hashing over Arrow string columns.

A batch of texts is handled as one byte buffer with offsets, so the cost per
word is a few numpy passes over bytes instead of a Python loop. Batches are cut
into slices of bounded size first, which bounds memory whatever Spark's batch
size is; a single longer text is a slice of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 2 << 20
U64 = np.uint64

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Bytes of the words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ in lower-cased text.
NAME = np.ones(256, bool)
NAME[0x00:0x30] = NAME[0x3A:0x61] = NAME[0x7B:0x80] = False
#: A-Z to a-z, every other byte as it is.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def _odd(seed: int) -> int:
    return int(np.random.default_rng(seed).integers(1, 1 << 62)) * 2 + 1


_BYTE = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64)
_WORD_BASE, _ROLL_BASE = _odd(11), _odd(13)
_tables: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept and grown by doubling."""
    t = _tables.get(base)
    if t is None or len(t) < n:
        m = max(1 << 16, 1 << (n - 1).bit_length())
        t = np.empty(m, U64)
        t[0] = 1
        k = 1
        while k < m:
            t[k : 2 * k] = t[:k] * U64(pow(base, k, 1 << 64))
            k *= 2
        _tables[base] = t
    return t[:n]


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the finaliser of MurmurHash3)."""
    x = x ^ U64(salt)
    x ^= x >> U64(33)
    x *= U64(0xFF51AFD7ED558CCD)
    x ^= x >> U64(33)
    x *= U64(0xC4CEB9FE1A85EC53)
    x ^= x >> U64(33)
    return x


def column(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null is the empty text."""
    arr = batch.column(batch.schema.get_field_index(name))
    arr = pc.fill_null(arr.cast(pa.large_string()), "")
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if len(arr) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = arr.buffers()
    offs = np.frombuffer(offs, np.int64)[arr.offset : arr.offset + len(arr) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


def slices(offs: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges [a, b) of documents of about ``limit`` bytes each."""
    n, a = len(offs) - 1, 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offs, offs[a] + limit, "right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


def words(buf: np.ndarray, offs: np.ndarray, member: np.ndarray | None = None):
    """Word starts, ends, and per document the index of its first word (n_docs + 1 values).

    A word is a maximal run of bytes that aren't SPACE (or that are ``member``).
    """
    n = len(buf)
    inside = ~SPACE[buf] if member is None else member[buf]
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    first, last = offs[:-1], offs[1:]
    full = last > first
    before[first[full]] = False
    after[last[full] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offs)


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, a function of its bytes alone."""
    if not len(starts):
        return np.zeros(0, U64)
    lens = ends - starts
    at = np.cumsum(lens) - lens
    pos = np.arange(int(lens.sum())) - np.repeat(at, lens)
    src = buf[pos + np.repeat(starts, lens)]
    low, high = pos & 0xFFFF, pos >> 16
    v = _BYTE[src] * powers(_WORD_BASE, 1 << 16)[low]
    if lens.max() > 1 << 16:  # only words of that length: a word's hash must not depend on others
        own = np.repeat(lens > 1 << 16, lens)
        v[own] = mix(v[own]) * powers(_odd(17), int(high.max()) + 1)[high[own]]
    return mix(np.add.reduceat(v, at) + lens.astype(U64) * U64(0x9E3779B97F4A7C15))


def rolling(h: np.ndarray, k: int, salt: int) -> np.ndarray:
    """Hash of each run of k consecutive word hashes; len(h) - k + 1 values."""
    n = len(h)
    if n < k:
        return np.zeros(0, U64)
    inverse = pow(_ROLL_BASE, -1, 1 << 64)
    q = np.zeros(n + 1, U64)
    np.cumsum(mix(h, salt) * powers(_ROLL_BASE, n), out=q[1:])
    return mix((q[k:] - q[:-k]) * powers(inverse, n - k + 1))


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """min(x[i : i + w]) for each i; len(x) - w + 1 values."""
    k, y = 1, x
    while 2 * k <= w:
        y = np.minimum(y[:-k], y[k:])
        k *= 2
    return np.minimum(y[: len(x) - w + 1], y[w - k : w - k + len(x) - w + 1])


def sliding_max(x: np.ndarray, w: int) -> np.ndarray:
    k, y = 1, x
    while 2 * k <= w:
        y = np.maximum(y[:-k], y[k:])
        k *= 2
    return np.maximum(y[: len(x) - w + 1], y[w - k : w - k + len(x) - w + 1])
