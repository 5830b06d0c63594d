"""Arrays of fixed size that many tasks fill: Bloom filters for values seen once and twice, and count sketches.

A task sends its array as compressed blocks; the blocks of one place are merged as they stream in, so no task or
group holds more than a few blocks, and at most the array's fixed size comes to the driver.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

BLOCK_BYTES = 1 << 14
SCHEMA = "block int, x binary, y binary"


def bits_for(values: float, least: int, most: int, each: int = 16) -> int:
    """A power of two of about ``each`` bits a value, within bounds."""
    return min(most, max(least, 1 << int(values * each).bit_length()))


def places(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    mask = np.uint64(bits - 1)
    return (hashes & mask).astype(np.int64), ((hashes >> np.uint64(32)) & mask).astype(np.int64)


def has(array: np.ndarray, place: np.ndarray) -> np.ndarray:
    return (array[place >> 3] >> (place & 7).astype(np.uint8)) & 1 > 0


def contains(array: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which hashes a filter may hold: all that it does hold, and a few others."""
    a, b = places(hashes, len(array) * 8)
    return has(array, a) & has(array, b)


def put(array: np.ndarray, place: np.ndarray) -> None:
    np.bitwise_or.at(array, place >> 3, np.left_shift(1, place & 7).astype(np.uint8))


def filters(hashes_of: Callable[[pa.RecordBatch], Iterator[np.ndarray]], bits: int):
    """A task's two filters: x for hashes seen, y for hashes seen again."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = (np.zeros(bits // 8, dtype=np.uint8) for _ in range(2))
        for batch in batches:
            for hashes in hashes_of(batch):
                for place in places(hashes, bits):
                    place, count = np.unique(place, return_counts=True)
                    put(twice, place[(count > 1) | has(once, place)])
                    put(once, place)
        yield from blocks(once, twice)

    return run


def blocks(x: np.ndarray, y: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    x = x.view(np.uint8)
    for k in range(0, len(x), BLOCK_BYTES):
        part = x[k : k + BLOCK_BYTES]
        if part.any():
            other = zlib.compress(y[k : k + BLOCK_BYTES].tobytes(), 1) if y is not None else b""
            yield pa.record_batch([pa.array([k // BLOCK_BYTES], pa.int32()), pa.array([zlib.compress(part.tobytes(), 1)], pa.binary()), pa.array([other], pa.binary())], ["block", "x", "y"])


def _array(blob: bytes, kind=np.uint8) -> np.ndarray:
    return np.frombuffer(zlib.decompress(blob) if blob else b"", dtype=kind)


def _merge_filters(a: list[np.ndarray], b: list[np.ndarray]) -> list[np.ndarray]:
    """Seen twice: twice in a task, or once in two tasks."""
    return [a[0] | b[0], a[1] | b[1] | (a[0] & b[0])]


def _merged(kind, join):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for block, x, y in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                new = [_array(x, kind), _array(y)]
                held[block] = join(held[block], new) if block in held else new
        for block, (x, y) in held.items():
            yield pa.record_batch([pa.array([block], pa.int32()), *(pa.array([zlib.compress(v.tobytes(), 1)], pa.binary()) for v in (x, y))], ["block", "x", "y"])

    return run


def _gather(parts: DataFrame, size: int, kind, join, column: str) -> np.ndarray:
    n = max(size // BLOCK_BYTES // 16, int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    out = np.zeros(size, dtype=np.uint8)
    for row in parts.repartition(n, "block").mapInArrow(_merged(kind, join), SCHEMA).select("block", column).collect():
        data = _array(row[1])
        out[row[0] * BLOCK_BYTES : row[0] * BLOCK_BYTES + len(data)] = data
    return out.view(kind)


def gather_filter(parts: DataFrame, bits: int, twice: bool) -> np.ndarray:
    return _gather(parts, bits // 8, np.uint8, _merge_filters, "y" if twice else "x")


def gather_counts(parts: DataFrame, cells: int) -> np.ndarray:
    return _gather(parts, cells * 4, np.uint32, lambda a, b: [a[0] + np.minimum(b[0], np.uint32(0xFFFFFFFF) - a[0]), a[1]], "x")


def filter_of_longs(df: DataFrame, column: str, least: int = 1 << 16, most: int = 1 << 29, twice: bool = False) -> np.ndarray:
    """The filter of a long column's values, mixed hashes."""
    bits = bits_for(df.count(), least, most)
    return gather_filter(df.select(column).mapInArrow(filters(lambda b: iter([np.asarray(b.column(0)).view(np.uint64)]), bits), SCHEMA), bits, twice)
