"""Vectorised kernels over Arrow text columns, shared by the Python-style operators.

Texts of an Arrow batch are taken in slices of a few MB, so a worker's memory
does not grow with the batch. Hashes are polynomials over 64-bit
integers (wrap-around) with a random value for each byte, finished by a mixer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 2 << 20
SHINGLE = 5
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
#: White space between words: the six ASCII characters.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """The finishing permutation of SplitMix64."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))
_BYTE_SECOND = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x8CB92BA72F3D8DD7))
_SECOND = np.uint64(0xC2B2AE3D27D4EB4F)
_BYTE_FOLDED = _BYTE.copy()
_BYTE_FOLDED[65:91] = _BYTE[97:123]
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int, second: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i for i < n, of the first or the second base."""
    base = int(_SECOND if second else _BASE)
    if base not in _powers or len(_powers[base][0]) < n:
        whole = (SLICE_BYTES >> 2 * second) + 4096
        m = whole >> 2 if n <= whole >> 2 else whole if n <= whole else max(n, 2 * len(_powers[base][0]) if base in _powers else 0)
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(m, b, np.uint64)
            p[0] = 1
            both.append(np.multiply.accumulate(p))
        _powers[base] = tuple(both)
    up, down = _powers[base]
    return up[:n], down[:n]


def prefix_hash(data: np.ndarray, folded: bool = False, second: bool = False) -> np.ndarray:
    """Running sums, so that spans() can hash any span; folded: ASCII letters without case; second: an independent hash."""
    up, _ = powers(len(data) + 1, second)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((_BYTE_SECOND if second else _BYTE_FOLDED if folded else _BYTE)[data] * up[: len(data)], out=out[1:])
    return out


def spans(sums: np.ndarray, start: np.ndarray, end: np.ndarray, second: bool = False) -> np.ndarray:
    """64-bit hashes of data[start:end] from prefix_hash's sums (with the same second); equal spans have equal hashes wherever they stand."""
    _, down = powers(len(sums), second)
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D))


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) for runs of rows; nulls count as empty texts."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_utf8()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        end = min(end, len(texts))
        yield at, end, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each word, a run of bytes that aren't white space."""
    solid = ~SPACE[data]
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    begins = solid.copy()
    begins[1:] &= ~solid[:-1] | first[1:n]
    ends = solid.copy()
    ends[:-1] &= ~solid[1:] | first[1:n]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return start, end, np.searchsorted(offsets, start, "right") - 1


def shingles(data: np.ndarray, offsets: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of each shingle of k words; a text of fewer words, but one or more, is one shingle."""
    start, end, row = words(data, offsets)
    h = spans(prefix_hash(data, True), start, end)
    if not len(h):
        return row, h
    rows = len(offsets) - 1
    count = np.bincount(row, minlength=rows)
    at = np.concatenate(([0], np.cumsum(count)))[row]  # first word of the row
    left = at + count[row] - np.arange(len(row))  # words from here to the row's end
    total = np.zeros(len(h), np.uint64)
    factor = np.uint64(1)
    for j in range(k):
        part = np.zeros(len(h), np.uint64)
        part[: len(h) - j] = h[j:] if j else h
        total += np.where(left > j, part * factor, np.uint64(0))
        factor = np.uint64(int(factor) * int(_BASE) % (1 << 64))
    keep = (left >= k) | ((count[row] < k) & (np.arange(len(row)) == at))
    return row[keep], mix(total[keep])


def counted(row: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (row, hash) in order, and how often each occurs."""
    if not len(h):
        return row, h, np.zeros(0, np.int64)
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    new = np.concatenate(([True], (row[1:] != row[:-1]) | (h[1:] != h[:-1])))
    at = np.flatnonzero(new)
    return row[at], h[at], np.diff(np.append(at, len(h)))
