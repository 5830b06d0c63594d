"""Nearest neighbours by cosine over randomly rotated one-bit codes.

Unit vectors are rotated by a random orthogonal matrix and kept as their signs, packed to one bit a dimension, with
a correction scalar: the inner product of the vector and its code.  For a query the code gives an unbiased estimate
of the inner product and a bound of its error.  Only vectors whose upper bound reaches the k-th best lower bound are
reranked, by the exact cosine of the original vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pubwatch.session import materialize

#: Width of the error bound in standard deviations of the estimate.
BOUND = 2.5
#: Queries scanned at once; a task holds their vectors.
BLOCK_QUERIES = 2048
#: Vectors estimated at once against 256 queries.
CHUNK, QUERY_CHUNK = 4096, 256
SEED = 20


def rotation(dimensions: int, seed: int = SEED) -> np.ndarray:
    """A random orthogonal matrix, the same in every task."""
    return np.linalg.qr(np.random.default_rng([seed, dimensions]).standard_normal((dimensions, dimensions)))[0]


def valid_vectors(df: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """``vec_id, v, dims``: rows whose vector takes part, in double precision."""
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return (
        df.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("v"))
        .where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & ~bad & F.exists("v", lambda x: x != 0))
        .withColumn("dims", F.size("v"))
    )


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(-1, dims)


def unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def encode(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed signs of the rotated unit vectors, and <code, vector>, which lies in (0, 1]."""
    turned = unit(v) @ rotation(v.shape[1])
    return np.packbits(turned > 0, axis=1), np.abs(turned).sum(axis=1) / np.sqrt(v.shape[1])


def build_index(df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """``vec_id, v, dims, code, fit`` of every vector that takes part, written to the shared folder."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = np.asarray(batch.column(2))
            for d in np.unique(dims).tolist():
                part = batch.filter(pa.array(dims == d))
                codes, fit = encode(matrix(part.column(1), d))
                yield pa.record_batch([*part.columns, pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(fit)], ["vec_id", "v", "dims", "code", "fit"])

    return materialize(valid_vectors(df, vec_id, embedding).mapInArrow(run, "vec_id long, v array<double>, dims int, code binary, fit double"), "one-bit-index")


class Best:
    """The k nearest vectors so far for every query of a block."""

    def __init__(self, ids: np.ndarray, v: np.ndarray, k: int):
        self.ids, self.v, self.unit, self.k = ids, v, unit(v), k
        self.scores = np.full((len(ids), k), -np.inf)
        self.found = np.full((len(ids), k), np.iinfo(np.int64).max)

    def scan(self, ids: np.ndarray, v: np.ndarray, codes: np.ndarray, fit: np.ndarray, bound: float) -> None:
        """Estimate all pairs, rerank those that the error bounds leave."""
        d = v.shape[1]
        signs = np.unpackbits(codes, axis=1, count=d).astype(np.float32) * 2 - 1
        width = (bound * np.sqrt(np.maximum(0, 1 - fit * fit)) / fit / np.sqrt(max(d - 1, 1))).astype(np.float32) + np.float32(1e-5)
        scale = (1 / (fit * np.sqrt(d))).astype(np.float32)
        whole = unit(v)
        for a in range(0, len(self.ids), QUERY_CHUNK):
            q = slice(a, a + QUERY_CHUNK)
            guess = ((self.unit[q] @ rotation(d)).astype(np.float32) @ signs.T) * scale
            own = self.ids[q][:, None] == ids[None, :]
            lower = np.where(own, -np.inf, guess - width)
            n = min(self.k, lower.shape[1])
            least = np.maximum(self.scores[q, -1], np.partition(lower, -n, axis=1)[:, -n] if n == self.k else -np.inf)
            rows, columns = np.nonzero((guess + width >= least[:, None]) & ~own)
            for b in range(0, len(rows), 1 << 16):
                r, c = rows[b : b + (1 << 16)], columns[b : b + (1 << 16)]
                self.merge(a + r, ids[c], (self.unit[a + r] * whole[c]).sum(axis=1))

    def merge(self, rows: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        """Add exact scores; ``rows`` is ascending."""
        touched = np.unique(rows)
        old_rows = np.repeat(touched, self.k)
        r = np.concatenate([old_rows, rows])
        s = np.concatenate([self.scores[touched].ravel(), scores])
        i = np.concatenate([self.found[touched].ravel(), ids])
        order = np.lexsort((i, -s, r))
        r, s, i = r[order], s[order], i[order]
        heads = np.flatnonzero(np.append(True, r[1:] != r[:-1]))
        pick = heads[:, None] + np.arange(self.k)
        self.scores[touched], self.found[touched] = s[pick], i[pick]

    def rows(self) -> pa.RecordBatch:
        real = np.isfinite(self.scores)
        return pa.record_batch([pa.array(np.repeat(self.ids, self.k)[real.ravel()]), pa.array(self.found[real]), pa.array(self.scores[real])], ["query_id", "vec_id", "score"])


def _search(shared, k: int, bound: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {d: Best(ids, v, k) for d, (ids, v) in shared.value.items()}
        for batch in batches:
            dims = np.asarray(batch.column(2))
            for d in set(np.unique(dims).tolist()) & best.keys():
                part = batch.filter(pa.array(dims == d))
                for a in range(0, part.num_rows, CHUNK):
                    ids, v, _, codes, fit = part.slice(a, CHUNK).columns
                    packed = np.frombuffer(b"".join(codes.to_pylist()), dtype=np.uint8).reshape(len(ids), -1)
                    best[d].scan(np.asarray(ids), matrix(v, d), packed, np.asarray(fit), bound)
        for x in best.values():
            yield x.rows()

    return run


def nearest(index: DataFrame, queries: DataFrame, k: int = 5, bound: float = BOUND, block: int = BLOCK_QUERIES) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k nearest other vectors of every query by cosine.

    ``queries`` holds rows of the index.  They go out in blocks of about ``block``, each scanned against all codes.
    Vectors that are null, empty, zero or hold a null or non-finite component take no part, nor do null ids; vectors
    are compared with those of as many dimensions only; rows that repeat an id are candidates like others, except
    to queries of that id; equal scores go to the smaller id.  Every task returns k rows for a query, which the
    final ranking cuts to k; fewer candidates give fewer rows.
    """
    spark, n = index.sparkSession, max(1, -(-queries.count() // block))
    found = []
    for b in range(n):
        rows = queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(n)) == b).select("vec_id", "v", "dims").toArrow()
        dims = np.asarray(rows["dims"])
        held = {d: (np.asarray(part["vec_id"]), matrix(part["v"].combine_chunks(), d)) for d in np.unique(dims).tolist() for part in [rows.filter(pa.array(dims == d))]}
        found.append(index.mapInArrow(_search(spark.sparkContext.broadcast(held), k, bound), "query_id long, vec_id long, score double"))
    near = reduce(DataFrame.unionAll, found)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
