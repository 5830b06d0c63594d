"""Language identification by rank-order profiles of character n-grams.

A profile is the list of a language's most frequent n-grams.  A document's own most frequent n-grams are compared to
each profile by the out-of-place distance: the sum of differences in rank, with the profile's length for an n-gram
that is not in it.  The nearest profile names the language.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from pubwatch.llm import textual
from pubwatch.session import bounded_batches

#: Length of a profile, also of a document's list.
PROFILE = 300
#: Counts a task holds before it passes them on.
FLUSH = 1 << 20
#: Parts in which a language's n-grams are ranked before the final ranking.
SALTS = 16
UNKNOWN = "und"
#: Least score of a document that counts as written in its language, whatever was learned.
LEAST_SCORE = 0.05
#: N-grams in a class of documents (short lists score high), and training documents it needs for a bound without its neighbours.
CLASS_GRAMS, CLASS_DOCUMENTS = 50, 100
#: A class' bound is MARGIN times the score that LOW of its training documents stay below, read off BINS equal steps.
LOW, MARGIN, BINS = 0.01, 0.7, 1000
_SHIFT = np.int64(21)


@cache
def letters() -> np.ndarray:
    """For every code point its lower-case letter, 0 for what is no letter."""
    table = np.zeros(0x110000, dtype=np.int64)
    for c in range(0x110000):
        if chr(c).isalpha():
            small = chr(c).lower()
            table[c] = ord(small) if len(small) == 1 else c
    return table


def padded(offsets: np.ndarray, data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The rows' letters with a blank before each row and at the end, and where each row's blank is."""
    marks = np.append(0, np.cumsum((np.frombuffer(data, dtype=np.uint8) & 0xC0) != 0x80))[offsets]
    points = letters()[np.frombuffer(data.decode().encode("utf-32-le"), dtype=np.uint32)]
    out = np.zeros(len(points) + len(offsets), dtype=np.int64)
    rows = np.repeat(np.arange(len(offsets) - 1), np.diff(marks))
    out[np.arange(len(points)) + rows + 1] = points
    return out, marks + np.arange(len(offsets))


def ngrams(c: np.ndarray) -> list[np.ndarray]:
    """Codes of the 1- to 3-grams of blank-padded letters; blanks only at the ends of a 2- or 3-gram."""
    one, two = c[c > 0], c[:-1] | (c[1:] + 1) << _SHIFT
    three = c[:-2] | (c[1:-1] + 1) << _SHIFT | (c[2:] + 1) << _SHIFT * 2
    return [one, two[(c[:-1] > 0) | (c[1:] > 0)], three[c[1:-1] > 0]]


def counted(c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(np.concatenate(ngrams(c)), return_counts=True)


def top(codes: np.ndarray, counts: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` most frequent codes, most frequent first, ties by code."""
    if len(codes) > n:
        least = -np.partition(-counts, n - 1)[n - 1]
        keep = counts >= least
        codes, counts = codes[keep], counts[keep]
    return codes[np.argsort(-counts, kind="stable")][:n]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
    size = 0

    def flush() -> Iterator[pa.RecordBatch]:
        for lang, parts in held.items():
            codes, place = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            total = np.bincount(place, weights=np.concatenate([p[1] for p in parts])).astype(np.int64)
            yield pa.record_batch([pa.array([lang] * len(codes), pa.string()), pa.array(codes), pa.array(total)], ["lang", "gram", "n"])
        held.clear()

    for batch in batches:
        langs = batch.column(1)
        for lang in langs.unique().to_pylist():
            mine = batch.column(0).filter(pc.equal(langs, lang))
            for _, offsets, data in textual.slices(mine):
                held.setdefault(lang, []).append(counted(padded(offsets, data)[0]))
                size += len(held[lang][-1][0])
                if size > FLUSH:
                    yield from flush()
                    size = 0
    yield from flush()


def profiles(docs: DataFrame, text: str = "text", lang: str = "lang", size: int = PROFILE) -> dict[str, list[int]]:
    """The ``size`` most frequent n-grams of every language, counted over all texts of ``docs``.

    ``size`` rows for every distinct ``lang`` come to the driver; ties go to the smaller code.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(text), F.col(lang).cast("string").alias("lang"))
    total = rows.mapInArrow(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    total = total.withColumn("salt", F.pmod(F.xxhash64("gram"), F.lit(SALTS)))
    for keys in (("lang", "salt"), ("lang",)):
        total = total.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("n"), "gram"))).where(F.col("place") <= size)
    found: dict[str, list[tuple[int, int]]] = {}
    for row in total.select("lang", "place", "gram").collect():
        found.setdefault(row.lang, []).append((row.place, row.gram))
    return {k: [g for _, g in sorted(found[k])] for k in sorted(found)}


class Profiles:
    def __init__(self, known: dict[str, list[int]], size: int = PROFILE):
        self.names, self.size = list(known), size
        self.grams = np.unique(np.concatenate([np.zeros(0, dtype=np.int64), *(np.array(g, dtype=np.int64) for g in known.values())]))
        self.ranks = np.full((len(self.grams) + 1, len(known)), -1, dtype=np.int64)
        for k, grams in enumerate(known.values()):
            self.ranks[np.searchsorted(self.grams, grams), k] = np.arange(len(grams))

    def judge(self, c: np.ndarray) -> tuple[str, float, int]:
        """(language, 1 - distance / largest distance, n-grams compared) of a blank-padded row; ties go to the first name."""
        mine = top(*counted(c), self.size)
        if not len(mine) or not self.names:
            return UNKNOWN, 0.0, 0
        at = np.searchsorted(self.grams, mine)
        at[at == len(self.grams)] = 0
        at = np.where(self.grams[at] == mine, at, len(self.grams)) if len(self.grams) else at
        known = self.ranks[at]
        distance = np.where(known >= 0, np.minimum(np.abs(known - np.arange(len(mine))[:, None]), self.size), self.size).sum(axis=0)
        k = int(distance.argmin())
        return self.names[k], 1.0 - float(distance[k]) / (self.size * len(mine)), len(mine)


def identify(docs: DataFrame, known: dict[str, list[int]], text: str = "text", size: int = PROFILE, grams: str | None = None) -> DataFrame:
    """Adds ``lang_pred`` and ``score`` (0 to 1) to every row, from its whole text alone; ``grams`` names a column for the n-grams compared.

    ``und`` with score 0 where the text is null, empty or has no letter, or nothing was learned; equal distances go
    to the language that sorts first; equal texts get equal results; columns of these names are replaced.
    """
    added = [StructField("lang_pred", StringType()), StructField("score", DoubleType()), *([StructField(grams, LongType())] if grams else [])]
    names = [c for c in docs.columns if c not in [f.name for f in added]]
    docs = docs.select(*names)
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(Profiles(known, size))
    schema = StructType([*docs.schema.fields, *added])
    place = names.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for _, offsets, data in textual.slices(batch.column(place)):
                c, bounds = padded(offsets, data)
                found += [shared.value.judge(c[a : b + 1]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
            langs, scores, sizes = zip(*found, strict=True) if found else ((), (), ())
            new = [pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(sizes, pa.int64())]
            yield pa.record_batch([*batch.columns, *new[: len(added)]], schema.names)

    return docs.mapInArrow(run, schema)


def held_out(doc_id: str = "doc_id", folds: int = 4, fold: int = 2) -> Column:
    """Whether crc32 of the id's text falls in the fold that nothing is learned from; a null id is like empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % folds == fold


def identify_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Learn from the documents outside the held-out fold that have a language, predict for all."""
    return identify(docs, profiles(docs.where(~held_out(doc_id)), text, lang), text)


def _class(grams: str, size: int) -> Column:
    return F.least(F.floor(F.col(grams) / CLASS_GRAMS), F.lit(size // CLASS_GRAMS)).cast("int")


def least_scores(judged: DataFrame, lang: str = "lang", grams: str = "n_grams", size: int = PROFILE, floor: float = LEAST_SCORE) -> list[float]:
    """For every class by number of n-grams the least score of a document in its language.

    ``judged``: training documents; those predicted as labelled count.  A class with few of them takes in its
    neighbours; fewer than ``CLASS_DOCUMENTS`` in all say nothing about a low quantile and leave ``floor``.  At most ``BINS`` counts of a class come to the driver, so the bounds are the same in every run.
    """
    own = judged.where(F.col("lang_pred") == F.col(lang).cast("string"))
    counts = np.zeros((size // CLASS_GRAMS + 1, BINS + 1), dtype=np.int64)
    for row in own.groupBy(_class(grams, size).alias("k"), F.floor(F.col("score") * BINS).cast("int").alias("b")).count().collect():
        counts[row["k"], row["b"]] += row["count"]
    bounds = []
    for k in range(len(counts)):
        near = next((n for r in range(len(counts)) if (n := counts[max(0, k - r) : k + r + 1].sum(axis=0)).sum() >= CLASS_DOCUMENTS), counts.sum(axis=0))
        bounds.append(max(floor, MARGIN * int(np.searchsorted(np.cumsum(near), LOW * near.sum(), side="right")) / BINS) if near.sum() >= CLASS_DOCUMENTS else floor)
    return bounds


def keep_identified(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", least_score: float = LEAST_SCORE) -> DataFrame:
    """The documents without those of no language: no letter at all, or unlike every learned language.

    What is unlike follows from the scores that the documents outside the held-out fold reach in their own language.
    """
    train = docs.where(~held_out(doc_id))
    known = profiles(train, text, lang)
    labelled = train.where(F.col(lang).isNotNull()).select(F.col(text).alias("text"), F.col(lang).alias("lang"))
    bounds = least_scores(identify(labelled, known, grams="n_grams"), floor=least_score)
    judged = identify(docs, known, text, grams="_n_grams")
    least = F.element_at(F.array(*map(F.lit, bounds)), _class("_n_grams", PROFILE) + 1)
    return judged.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least)).select(*docs.columns)
