"""NumPy kernels over the UTF-8 buffers of Arrow string columns.

No Python object is made per word: words are found with table look-ups on the
bytes, and hashed with a polynomial whose prefix sums are taken once a chunk.
Words are maximal runs of bytes other than 0x20 and 0x09-0x0D, after A-Z (only)
are lower-cased.  Hashes have 64 bits; two different words or shingles of one
pair of documents agree by chance with probability about 2**-64 each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
CHUNK_BYTES = 1 << 18
_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix(h: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijection on 64-bit words that scatters all bits; salt picks one of many."""
    h = h + U((salt * 0xD1342543DE82EF95 + 0x632BE59BD9B4E019) & (2**64 - 1))
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


_BYTE = mix(np.arange(256, dtype=U), 7)[_LOWER]
_powers: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]


def _power_tables(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, CHUNK_BYTES * 2)
        for k, base in enumerate((_BASE, _INV)):
            table = np.full(size, U(base))
            table[0] = U(1)
            _powers[k] = np.multiply.accumulate(table)
    return _powers


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all strings, one after another, and the offsets of each; null is empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def chunks(offsets: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of strings of about ``most`` bytes together; a longer string is alone."""
    n, first = len(offsets) - 1, 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, side="right")) - 1)
        yield first, min(last, n)
        first = min(last, n)


#: Also ASCII punctuation ends a word.
MARKS = _SPACE.copy()
MARKS[[*range(0, 48), *range(58, 65), *range(91, 97), *range(123, 128)]] = True


def word_hashes(raw: np.ndarray, offsets: np.ndarray, space: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all strings in order, and the word offsets of each string; ``space`` tells what ends a word."""
    n = len(raw)
    if n == 0:
        return np.zeros(0, U), np.zeros(len(offsets), np.int64)
    inside = ~space[raw]
    cut = np.zeros(n + 1, dtype=bool)
    cut[offsets] = True
    before = cut[:-1].copy()
    before[1:] |= ~inside[:-1]
    after = cut[1:].copy()
    after[:-1] |= ~inside[1:]
    starts, ends = np.flatnonzero(inside & before), np.flatnonzero(inside & after) + 1
    power, inverse = _power_tables(n + 1)
    total = np.zeros(n + 1, U)
    np.cumsum(_BYTE[raw] * power[:n], out=total[1:])
    hashes = mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(U))
    return hashes, np.searchsorted(starts, offsets)


def shingles(words: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each string's n-word shingles in order of place, and their offsets.

    A string of fewer words (but not none) has one: its whole sequence.
    """
    count = np.diff(at)
    doc = np.repeat(np.arange(len(count)), count)
    made = [np.zeros(0, U)]
    of = [np.zeros(0, np.int64)]
    if len(words) >= n:
        h = words[: len(words) - n + 1].copy()
        for k in range(1, n):
            h = h * U(_BASE) + words[k : len(words) - n + 1 + k]
        ok = doc[: len(h)] == doc[n - 1 :]
        made.append(mix(h[ok], n))
        of.append(doc[: len(h)][ok])
    for size in range(1, n):
        short = np.flatnonzero(count == size)
        if len(short):
            h = words[at[short]].copy()
            for k in range(1, size):
                h = h * U(_BASE) + words[at[short] + k]
            made.append(mix(h, 64 + size))
            of.append(short)
    if len(made) > 2:
        h, d = np.concatenate(made), np.concatenate(of)
        order = np.argsort(d, kind="stable")
        h, d = h[order], d[order]
    else:
        h, d = made[-1], of[-1]
    return h, np.searchsorted(d, np.arange(len(count) + 1))


def shingle_sets(column: pa.Array, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """Row number and sorted distinct shingle hashes of each string."""
    raw, offsets = utf8(column)
    for first, last in chunks(offsets):
        part = offsets[first : last + 1]
        words, at = word_hashes(raw[part[0] : part[-1]], part - part[0])
        h, ends = shingles(words, at, n)
        for k in range(last - first):
            own = np.sort(h[ends[k] : ends[k + 1]])
            if len(own) > 1:
                own = own[np.concatenate(([True], own[1:] != own[:-1]))]
            yield first + k, own
