"""Benchmark decontamination with spaced seeds.

A seed is a fixed mask over consecutive words that ignores some of them.  The masked words of every place of the
test items and of the documents are hashed; equal hashes are hits.  Around a hit the two texts are compared word
by word on the hit's diagonal, where substituted words are tolerated.  The two masks find every window of 13 words
with at most two substitutions (all 78 pairs of places are covered by some shift of a mask).

The test items are the query set.  They come in blocks of bounded size, each of which all documents are scanned
against once; the documents are never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from pubwatch.llm import textual
from pubwatch.session import bounded_batches, materialize

#: Places that count, from the first word of a seed.
MASKS = ((0, 1, 2, 4, 6, 7), (0, 1, 3, 6, 7, 8))
WINDOW, SUBSTITUTIONS = 13, 2
#: Bytes of test items in one block, which each task holds hashed (about ten times as much memory).
BLOCK_BYTES = 4 << 20
TABLE_BITS = 22
#: A-Z lower-cased; ASCII marks and white space part words.
_FOLD = bytearray(textual.WORD_TABLE)
for _byte in range(128):
    if not chr(_byte).isalnum():
        _FOLD[_byte] = 32
FOLD = bytes(_FOLD)


class Seeds:
    """The hashed places of a block of items, sorted by hash."""

    def __init__(self, texts: list[str | None], masks=MASKS):
        self.hashes, self.bounds = (np.concatenate(x) for x in _pieces(texts))
        self.masks, self.keys, self.places = masks, [], []
        item = np.searchsorted(self.bounds, np.arange(len(self.hashes)), side="right") - 1
        for mask in masks:
            key, place = masked(self.hashes, mask), np.arange(max(0, len(self.hashes) - mask[-1]))
            place = place[item[place] == item[place + mask[-1]]] if len(place) else place
            order = np.argsort(key[place], kind="stable")
            self.keys.append(key[place][order])
            self.places.append(place[order])
        self.table = np.zeros(1 << TABLE_BITS, dtype=bool)
        for key in self.keys:
            self.table[(key >> np.uint64(64 - TABLE_BITS)).astype(np.int64)] = True

    def hits(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``words`` and in the items that share a seed's hash."""
        left, right = [], []
        for mask, keys, places in zip(self.masks, self.keys, self.places, strict=True):
            key = masked(words, mask)
            at = np.flatnonzero(self.table[(key >> np.uint64(64 - TABLE_BITS)).astype(np.int64)])
            low, high = (np.searchsorted(keys, key[at], side=s) for s in ("left", "right"))
            count = high - low
            shift = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            left.append(np.repeat(at, count))
            right.append(places[np.repeat(low, count) + shift])
        return np.concatenate(left), np.concatenate(right)


def _pieces(texts: list[str | None]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    found, ends, total = [np.zeros(0, dtype=np.uint64)], [np.zeros(1, dtype=np.int64)], 0
    for _, offsets, data in textual.slices(pa.array(texts, pa.string())):
        hashes, bounds = textual.words(offsets, data, FOLD)
        found.append(hashes)
        ends.append(bounds[1:] + total)
        total += len(hashes)
    return found, ends


def masked(words: np.ndarray, mask: tuple[int, ...]) -> np.ndarray:
    size = max(0, len(words) - mask[-1])
    total = np.zeros(size, dtype=np.uint64)
    for k in mask:
        total = total * np.uint64(0x9E3779B97F4A7C15) + words[k : k + size]
    return textual.mix(total)


def overlap(equal: np.ndarray, window: int, substitutions: int) -> tuple[int, int, int]:
    """(words, equal words, first word) of the windows with enough equal words; ``equal``: along a diagonal."""
    if len(equal) < window:
        return 0, 0, -1
    total = np.append(0, np.cumsum(equal))
    good = np.flatnonzero(total[window:] - total[:-window] >= window - substitutions)
    if not len(good):
        return 0, 0, -1
    edge = np.zeros(len(equal) + 1, dtype=np.int64)
    np.add.at(edge, good, 1)
    np.add.at(edge, good + window, -1)
    covered = np.cumsum(edge[:-1]) > 0
    return int(covered.sum()), int((covered & equal).sum()), int(good[0])


def find_overlaps(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``doc_id, item_id, overlap_words, equal_words, doc_word, item_word``: one row per document and test item.

    A document row and an item overlap where 13 words in a row on one diagonal differ in at most two; the row
    holds the diagonal with the most such words and where it starts (words from 0).  Words are runs of ASCII
    letters and digits and of any other non-ASCII bytes, A-Z lower-cased.  Items of fewer than 13 words overlap
    nothing; null and empty texts overlap nothing; repeated rows give repeated rows; null ids are kept as they are.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    items = items.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("text"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = int(size // block_bytes) + 1
    schema = StructType([
        StructField("doc_id", docs.schema[doc_id].dataType), StructField("item_id", items.schema["item_id"].dataType),
        *(StructField(c, LongType(), False) for c in ("overlap_words", "equal_words", "doc_word", "item_word")),
    ])
    found = []
    for block in range(n):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == block).toArrow()
        shared = spark.sparkContext.broadcast((Seeds(rows["text"].to_pylist()), rows["item_id"].combine_chunks()))
        found.append(docs.select(doc_id, text).mapInArrow(_scan(shared), schema))
    return reduce(DataFrame.unionAll, found)


def _scan(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds, ids = shared.value
        for batch in batches:
            rows, columns = [], [[] for _ in range(5)]
            for row, offsets, data in textual.slices(batch.column(1)):
                words, bounds = textual.words(offsets, data, FOLD)
                for (doc, item), best in _best(seeds, words, bounds).items():
                    rows.append(doc + row)
                    for column, value in zip(columns, (item, *best), strict=True):
                        column.append(value)
            if rows:
                taken = [batch.column(0).take(pa.array(rows, pa.int64())), ids.take(pa.array(columns[0], pa.int64()))]
                yield pa.record_batch([*taken, *(pa.array(c, pa.int64()) for c in columns[1:])], ["doc_id", "item_id", "overlap_words", "equal_words", "doc_word", "item_word"])

    return run


def _best(seeds: Seeds, words: np.ndarray, bounds: np.ndarray) -> dict[tuple[int, int], tuple[int, int, int, int]]:
    """For every row and item the best diagonal: words covered, equal words, places of its first window."""
    left, right = seeds.hits(words)
    best: dict[tuple[int, int], tuple[int, int, int, int]] = {}
    if not len(left):
        return best
    doc, item = np.searchsorted(bounds, left, side="right") - 1, np.searchsorted(seeds.bounds, right, side="right") - 1
    for d, i, shift in np.unique(np.stack([doc, item, left - right], axis=1), axis=0).tolist():
        begin, end = int(seeds.bounds[i]), int(seeds.bounds[i + 1])
        low, high = max(begin, int(bounds[d]) - shift), min(end, int(bounds[d + 1]) - shift)
        if high - low < WINDOW or (d, i) in best and best[d, i][0] > high - low:
            continue
        covered, equal, first = overlap(words[low + shift : high + shift] == seeds.hashes[low:high], WINDOW, SUBSTITUTIONS)
        at = (covered, equal, low + shift + first - int(bounds[d]), low + first - begin)
        if covered and ((d, i) not in best or (at[0], at[1], -at[2]) > (best[d, i][0], best[d, i][1], -best[d, i][2])):
            best[d, i] = at
    return best


def decontaminate(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", **names) -> DataFrame:
    """The documents without those that overlap a test item; rows with a null id go if any such row overlaps.

    The ids found are written first, so Spark knows their size and broadcasts them only below its threshold.
    """
    ids = materialize(find_overlaps(docs, items, doc_id, text, **names).select(F.col("doc_id").alias("_id")).distinct(), "contaminated")
    return docs.join(ids, F.col(doc_id).eqNullSafe(F.col("_id")), "left_anti")
