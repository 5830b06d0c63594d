"""Bytes of Arrow text columns as 64-bit hashes of words and lines, without a Python object per word.

Texts are handled in slices of bounded bytes, so a task's memory does not depend on its batch.  The
hash of a segment is a polynomial in its bytes, then mixed; equal bytes give equal hashes everywhere.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 18
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
UPPER = bytes(range(65, 91))
#: A-Z to lower case, every white-space byte to a blank.
WORD_TABLE = bytes.maketrans(UPPER + SPACES, UPPER.lower() + b" " * len(SPACES))
_FACTOR, _OTHER = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
_MULTIPLY = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
_powers: dict[int, np.ndarray] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(_MULTIPLY[0])
    h ^= h >> np.uint64(27)
    h *= np.uint64(_MULTIPLY[1])
    h ^= h >> np.uint64(31)
    return h


def unmix(h: np.ndarray) -> np.ndarray:
    """The inverse of ``mix``."""
    h = h ^ (h >> np.uint64(31)) ^ (h >> np.uint64(62))
    h = h * np.uint64(pow(_MULTIPLY[1], -1, 1 << 64))
    h ^= (h >> np.uint64(27)) ^ (h >> np.uint64(54))
    h *= np.uint64(pow(_MULTIPLY[0], -1, 1 << 64))
    return h ^ (h >> np.uint64(30)) ^ (h >> np.uint64(60))


def powers(n: int, factor: int = _FACTOR) -> np.ndarray:
    known = _powers.get(factor)
    if known is None or len(known) < n:
        size = max(64, 1 << (n - 1).bit_length())
        steps = np.full(size, factor, dtype=np.uint64)
        steps[0] = 1
        known = _powers[factor] = np.multiply.accumulate(steps)
    return known


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, np.ndarray, bytes]]:
    """(first row, offsets from 0, bytes) of consecutive rows with about ``limit`` bytes; null is empty."""
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    offsets = np.frombuffer(column.buffers()[1], dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = memoryview(column.buffers()[2]) if column.buffers()[2] is not None else memoryview(b"")
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1)
        part = offsets[first : last + 1]
        yield first, part - part[0], bytes(data[part[0] : part[-1]])
        first = last


def segment_hashes(data: np.ndarray, inside: np.ndarray, starts: np.ndarray, factor: int = _FACTOR) -> np.ndarray:
    """A hash for every segment: ``inside`` marks its bytes, ``starts`` its first byte, in order."""
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    values = data[inside]
    heads = (np.cumsum(inside, dtype=np.int64) - 1)[starts]
    lengths = np.diff(np.append(heads, len(values)))
    place = np.arange(len(values), dtype=np.int64) - np.repeat(heads, lengths)
    terms = powers(int(lengths.max()), factor)[place]
    terms *= values.astype(np.uint64) + np.uint64(1)
    return mix(np.add.reduceat(terms, heads))


def words(offsets: np.ndarray, data: bytes, table: bytes = WORD_TABLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the rows, and each row's bounds in them; ``table`` folds bytes, blanks part words."""
    text = np.frombuffer(data.translate(table), dtype=np.uint8)
    if not len(text):
        return np.zeros(0, dtype=np.uint64), np.zeros(len(offsets), dtype=np.int64)
    inside = text != 32
    begins = np.zeros(len(text), dtype=bool)
    begins[offsets[:-1][offsets[:-1] < len(text)]] = True
    begins[1:] |= ~inside[:-1]
    starts = np.flatnonzero(begins & inside)
    return segment_hashes(text, inside, starts), np.searchsorted(starts, offsets)


def combine(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the ``n`` consecutive words that start at every place; the last n-1 places have none."""
    size = len(hashes) - n + 1
    if size <= 0:
        return np.zeros(0, dtype=np.uint64)
    total = np.zeros(size, dtype=np.uint64)
    for k in range(n):
        total = total * np.uint64(_OTHER) + hashes[k : k + size]
    return mix(total)
