"""Line de-duplication with two Bloom filters: lines seen once, and lines seen twice.

Every task sets bits for the hashes of its lines; a hash whose bits were set before sets them in the second filter
too.  The tasks' filters are merged block by block, and only lines that the merged second filter suspects are
shuffled, as (digest, document), for the exact count of documents and the choice of the one that keeps the line.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from pubwatch.llm import bits as bit_arrays
from pubwatch.llm import textual
from pubwatch.session import bounded_batches, materialize

MIN_CHARS, MIN_DOCUMENTS = 40, 5
#: Bounds of a filter's bits. A full filter suspects more lines, which costs a shuffle and changes no result.
LEAST_BITS, MOST_BITS = 1 << 16, 1 << 29
STRIPPED = " \t\n\x0b\x0c\r"
_CAPITALS, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LOWER = bytes.maketrans(textual.UPPER, textual.UPPER.lower())
_SPACE = np.zeros(256, dtype=bool)
_SPACE[list(textual.SPACES)] = True


def keys_of(offsets: np.ndarray, data: bytes, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, bytes]:
    """First and last byte and hash of every line key of at least ``least`` code points, and the folded bytes."""
    folded = data.translate(_LOWER)
    text = np.frombuffer(folded, dtype=np.uint8)
    solid = np.flatnonzero(~_SPACE[text])
    none = np.zeros(0, dtype=np.int64)
    if not len(solid):
        return none, none, none.astype(np.uint64), folded
    begins = np.zeros(len(text) + 1, dtype=bool)
    begins[offsets[:-1]] = True
    begins[1:] |= text == 10
    line = np.cumsum(begins[:-1])[solid]
    heads = np.flatnonzero(np.append(True, line[1:] != line[:-1]))
    first, last = solid[heads], solid[np.append(heads[1:], len(solid)) - 1]
    points = np.append(0, np.cumsum((text & 0xC0) != 0x80))
    long = points[last + 1] - points[first] >= least
    first, last = first[long], last[long]
    edge = np.zeros(len(text) + 1, dtype=np.int8)
    edge[first] += 1
    edge[last + 1] -= 1
    inside = np.cumsum(edge[:-1], dtype=np.int8).astype(bool)
    return first, last, textual.segment_hashes(text, inside, first), folded


def twice_filter(docs: DataFrame, text: str, least: int = MIN_CHARS, most_bits: int = MOST_BITS) -> np.ndarray:
    """The merged second filter; at most ``most_bits`` / 8 bytes come to the driver."""
    bounded_batches(docs.sparkSession)
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    bits = bit_arrays.bits_for(size / 256, LEAST_BITS, most_bits)

    def hashes_of(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        return (keys_of(offsets, data, least)[2] for _, offsets, data in textual.slices(batch.column(0)))

    return bit_arrays.gather_filter(docs.select(text).mapInArrow(bit_arrays.filters(hashes_of, bits), bit_arrays.SCHEMA), bits, twice=True)


def suspects(docs: DataFrame, doc_id: str, text: str, twice: np.ndarray, least: int = MIN_CHARS) -> DataFrame:
    """``digest, doc_id``: the lines, once per row, that the filter says were seen twice."""
    shared = docs.sparkSession.sparkContext.broadcast(twice)
    kind = docs.schema[doc_id].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, offsets, data in textual.slices(batch.column(1)):
                first, last, hashes, folded = keys_of(offsets, data, least)
                seen = np.flatnonzero(bit_arrays.contains(shared.value, hashes))
                at = np.searchsorted(offsets, first[seen], side="right") - 1 + row
                found = {(int(r), hashlib.md5(folded[first[k] : last[k] + 1], usedforsecurity=False).digest()) for r, k in zip(at, seen, strict=True)}
                if found:
                    rows, digests = zip(*found, strict=True)
                    yield pa.record_batch([pa.array(digests, pa.binary()), batch.column(0).take(pa.array(rows, pa.int64()))], ["digest", "doc_id"])

    return docs.select(doc_id, text).mapInArrow(run, StructType([StructField("digest", BinaryType()), StructField("doc_id", kind)]))


def digest_of(line: Column) -> Column:
    """The digest that ``suspects`` gives a line, in the JVM."""
    return F.unhex(F.md5(F.translate(F.trim(line, F.lit(STRIPPED)), _CAPITALS, _SMALL)))


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = MIN_CHARS, documents: int = MIN_DOCUMENTS, most_bits: int = MOST_BITS) -> DataFrame:
    """The documents without their repeated lines, with ``n_lines`` (before) and ``n_dropped``.

    A line's key is the line without white space at its ends and with A-Z lower-cased.  Keys of at least ``least``
    code points found in at least ``documents`` distinct documents lose all their lines except in the largest
    ``doc_id``; the other lines stay, joined by ``\\n``.  Null and empty texts are one empty line; rows with equal
    ids count as one document and are all cleaned alike; a null id is a document that never keeps a common line;
    other columns pass through (those named like the added ones are replaced); an empty table stays empty.
    """
    names = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    docs = docs.select(*names)
    pairs = materialize(suspects(docs, doc_id, text, twice_filter(docs, text, least, most_bits), least).groupBy("digest", "doc_id").agg(F.lit(1).alias("one")).drop("one"), "line-pairs")
    common = materialize(pairs.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("keeper")).where(F.col("n") >= documents).drop("n"), "common-lines")
    drops = (
        pairs.join(common, "digest").where(~F.col("doc_id").eqNullSafe(F.col("keeper")))
        .groupBy("doc_id").agg(F.collect_list("digest").alias("_drop")).withColumnRenamed("doc_id", "_doc")
    )
    drops = materialize(drops, "line-drops")
    lines = F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)
    # Merged at every size, so that the plan and its cost grow evenly.
    joined = docs.join(drops.hint("merge"), F.col(doc_id).eqNullSafe(F.col("_doc")), "left")
    kept = F.filter(lines, lambda x: ~((F.length(F.trim(x, F.lit(STRIPPED))) >= least) & F.array_contains("_drop", digest_of(x))))
    # A generated column is computed once however often it is read.
    done = joined.select(*names, F.explode(F.array(F.struct(F.size(lines).cast("long").alias("n"), F.when(F.col("_drop").isNotNull(), kept).alias("kept")))).alias("_line"))
    new = F.when(F.col("_line.kept").isNull(), F.coalesce(F.col(text), F.lit(""))).otherwise(F.array_join("_line.kept", "\n"))
    dropped = F.when(F.col("_line.kept").isNull(), F.lit(0)).otherwise(F.col("_line.n") - F.size("_line.kept")).cast("long")
    return done.select(*(new.alias(c) if c == text else F.col(c) for c in names), F.col("_line.n").alias("n_lines"), dropped.alias("n_dropped"))
