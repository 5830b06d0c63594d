"""Hard negatives from an inverted multi-index over two half-space codebooks.

Each half of a vector is assigned to the nearest word of its codebook; a pair of words is a cell.  For an anchor the
score of any row in cell (i, j) is at most <q1, c_i> + |q1| r_i + <q2, d_j> + |q2| r_j, where r is the radius of the rows
under a word.  A heap walks the cells in order of these sums and opens them until a window is certified: the
next bound lies below the k-th score found, or below the window's lower end.  Vectors are integers, scores exact.

The codebooks are fitted on a bounded sample of rows; every row is indexed.  Bounds are made from the rows at hand,
so the result does not depend on the sample.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pubwatch.llm.storage import shared_folder
from pubwatch.session import materialize

#: Rows the codebooks are fitted on, words a half, and rounds of fitting.
SAMPLE_ROWS, WORDS, ROUNDS = 8192, 24, 8
#: Anchors searched at once, rows a task indexes at once, rows a task of the index holds, rows scored at once.
BLOCK_ANCHORS, CHUNK_ROWS, TASK_ROWS, GATHER = 4096, 1 << 16, 1 << 16, 512
POSITIVES, NEGATIVES = 5, 3
#: The window of a negative's score, in hundredths of the positive's.
LOW, HIGH = 50, 95
_SLACK = 1e-9


def valid_rows(df: DataFrame, vec_id: str, embedding: str, label: str) -> DataFrame:
    """``vec_id, label, v, dims``: the rows that take part, components scaled to integers."""
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = df.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"), F.col(embedding).cast("array<double>").alias("v"))
    return rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & ~bad).select(
        "vec_id", "label", F.transform("v", lambda x: F.floor(x * 256)).alias("v"), F.size("v").alias("dims"))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.int64).reshape(len(column), dims)


def _fit(x: np.ndarray, words: int) -> np.ndarray:
    """Words of one half by Lloyd's rounds from spread rows of the sample."""
    centres = np.unique(x, axis=0)
    centres = centres[np.linspace(0, len(centres) - 1, min(words, len(centres))).astype(int)].astype(float)
    for _ in range(ROUNDS):
        near = _assign(x, centres)
        held = np.bincount(near, minlength=len(centres))
        for d in range(x.shape[1]):
            centres[held > 0, d] = (np.bincount(near, x[:, d], len(centres)) / np.maximum(held, 1))[held > 0]
    return centres


def _assign(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres * centres).sum(axis=1) - 2 * (x @ centres.T)).argmin(axis=1)


def fit_codebooks(rows: DataFrame, sample: int = SAMPLE_ROWS, words: int = WORDS) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Two codebooks for every number of dimensions, from the ``sample`` rows with the smallest hashes."""
    taken = rows.select("v", "dims").orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).toArrow()
    dims = np.asarray(taken["dims"])
    out = {}
    for d in np.unique(dims).tolist():
        x = _matrix(taken["v"].combine_chunks().filter(pa.array(dims == d)), d).astype(float)
        out[d] = (_fit(x[:, : d // 2], words), _fit(x[:, d // 2 :], words))
    return out


def build_index(df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", words: int = WORDS) -> tuple[DataFrame, dict]:
    """(``vec_id, label, v, dims, cell`` of every row that takes part, dealt by ranges of cells; the codebooks).

    A range is cut by cell and id, so a cell that holds any share of the rows spreads over tasks.  Dimensions that the
    sample has not seen get one word of zeros.
    """
    rows = valid_rows(df, vec_id, embedding, label)
    books = fit_codebooks(rows, words=words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, cells = np.asarray(batch.column(3)), np.zeros(batch.num_rows, dtype=np.int32)
            for d in set(np.unique(dims).tolist()) & books.keys():
                x = _matrix(batch.column(2).filter(pa.array(dims == d)), d).astype(float)
                cells[dims == d] = _assign(x[:, : d // 2], books[d][0]) * words + _assign(x[:, d // 2 :], books[d][1])
            yield pa.record_batch([*batch.columns, pa.array(cells)], ["vec_id", "label", "v", "dims", "cell"])

    coded = rows.mapInArrow(run, "vec_id long, label long, v array<long>, dims int, cell int")
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // TASK_ROWS))
    dealt = coded.repartitionByRange(tasks, "dims", "cell", "vec_id").sortWithinPartitions("dims", "cell")
    return materialize(dealt, "multi-index"), books


def cells_by_bound(a: np.ndarray, b: np.ndarray) -> Iterator[tuple[float, int, int]]:
    """(a[i] + b[j], i, j) for falling sums; ``a`` and ``b`` are falling.  Every pair is pushed once."""
    heap = [(-(a[0] + b[0]), 0, 0)]
    while heap:
        bound, i, j = heapq.heappop(heap)
        yield -bound, i, j
        if j + 1 < len(b):
            heapq.heappush(heap, (-(a[i] + b[j + 1]), i, j + 1))
        if j == 0 and i + 1 < len(a):
            heapq.heappush(heap, (-(a[i + 1] + b[0]), i + 1, 0))


class MultiIndex:
    """The cells of some rows of one dimension, with the radii of these rows."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, v: np.ndarray, cells: np.ndarray, book: tuple[np.ndarray, np.ndarray], words: int):
        order = np.argsort(cells, kind="stable")
        self.ids, self.labels, self.v, cells = ids[order], labels[order], v[order], cells[order]
        heads = np.flatnonzero(np.append(True, cells[1:] != cells[:-1]))
        self.first, self.last = {}, {}
        for c, low, high in zip(cells[heads].tolist(), heads.tolist(), [*heads[1:].tolist(), len(cells)], strict=True):
            self.first[c], self.last[c] = low, high
        self.words, self.half = words, v.shape[1] // 2
        self.sides = []
        for side, used in ((0, cells // words), (1, cells % words)):
            part = self.v[:, : self.half] if side == 0 else self.v[:, self.half :]
            away = np.sqrt(((part - book[side][used]) ** 2).sum(axis=1))
            present = np.unique(used)
            self.sides.append((present, book[side][present], np.array([away[used == c].max() for c in present])))

    def bounds(self, q: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Per half: (words by falling bound, their upper bounds, their lower bounds) for every anchor."""
        out = []
        for side, (present, centres, radii) in enumerate(self.sides):
            part = (q[:, : self.half] if side == 0 else q[:, self.half :]).astype(float)
            middle, reach = part @ centres.T, np.sqrt((part * part).sum(axis=1))[:, None] * radii
            reach += _SLACK * (np.abs(middle) + reach) + 1e-6
            order = np.argsort(-(middle + reach), axis=1, kind="stable")
            out.append((present[order], np.take_along_axis(middle + reach, order, 1), np.take_along_axis(middle - reach, order, 1)))
        return out

    def scores(self, rows: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Exact integer inner products."""
        v = self.v[rows]
        size = float(np.abs(v.astype(float)).max(initial=0)) * float(np.abs(q.astype(float)).max(initial=0)) * max(len(q), 1)
        if size < 1 << 53:
            return (v.astype(float) @ q.astype(float)).astype(np.int64)
        if size >= 1 << 63 and (np.abs(v.astype(float)) @ np.abs(q.astype(float))).max(initial=0) >= 2.0**63 * (1 - _SLACK):
            raise ValueError("an inner product may pass 64 bits")
        return v @ q

    def search(self, q: np.ndarray, goals: list) -> None:
        """Open cells by falling bound until every goal of every anchor is certified."""
        (first, up1, low1), (second, up2, low2) = self.bounds(q)
        for n, goal in enumerate(goals):
            held, size, need = [], 0, goal.need()
            for bound, i, j in cells_by_bound(up1[n], up2[n]):
                if bound < need:
                    break
                cell = int(first[n, i]) * self.words + int(second[n, j])
                if cell not in self.first or low1[n, i] + low2[n, j] > goal.top:
                    continue
                held.append(np.arange(self.first[cell], self.last[cell]))
                size += len(held[-1])
                if size >= GATHER:
                    self._open(held, q[n], goal)
                    held, size, need = [], 0, goal.need()
            if held:
                self._open(held, q[n], goal)

    def _open(self, held: list[np.ndarray], q: np.ndarray, goal) -> None:
        rows = np.concatenate(held)
        goal.add(self.ids[rows], self.labels[rows], self.scores(rows, q))


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((ids, -scores))[:k]
    return ids[order], scores[order]


class Near:
    """An anchor's best rows of its own label."""

    top = np.inf

    def __init__(self, anchor: int, label: int, k: int):
        self.anchor, self.label, self.k = anchor, label, k
        self.ids, self.found = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)

    def need(self) -> float:
        return float(self.found[-1]) if len(self.found) == self.k else -np.inf

    def add(self, ids: np.ndarray, labels: np.ndarray, scores: np.ndarray) -> None:
        fits = (labels == self.label) & (ids != self.anchor)
        self.ids, self.found = _best(np.append(self.ids, ids[fits]), np.append(self.found, scores[fits]), self.k)

    def rows(self) -> list[tuple]:
        return [(self.anchor, i, s) for i, s in zip(self.ids.tolist(), self.found.tolist(), strict=True)]


class Windows:
    """An anchor's best rows of other labels in the window of each of its positives."""

    def __init__(self, anchor: int, label: int, positives: list[tuple[int, int]], k: int, low: int, high: int):
        self.anchor, self.label, self.k = anchor, label, k
        # [positive, its score, least and largest score of the window, ids, scores]
        self.open = [[p, s, -(-low * s // 100), high * s // 100, np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)] for p, s in positives if low * s <= high * s]
        self.top = max((float(w[3]) for w in self.open), default=-np.inf)

    def need(self) -> float:
        return min((float(w[5][-1]) if len(w[5]) == self.k else float(w[2]) for w in self.open), default=np.inf)

    def add(self, ids: np.ndarray, labels: np.ndarray, scores: np.ndarray) -> None:
        other = labels != self.label
        for w in self.open:
            fits = other & (scores >= w[2]) & (scores <= w[3])
            w[4], w[5] = _best(np.append(w[4], ids[fits]), np.append(w[5], scores[fits]), self.k)

    def rows(self) -> list[tuple]:
        return [(self.anchor, p, s, i, n) for p, s, _, _, ids, found in self.open for i, n in zip(ids.tolist(), found.tolist(), strict=True)]


def _search(shared, goals_of, books: dict, words: int, names: list[str]):
    """A task's best rows for every anchor of the block, over chunks of the index."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        goals = {d: goals_of(block) for d, block in shared.value.items()}
        held: list[pa.RecordBatch] = []

        def flush() -> None:
            if not held:
                return
            rows = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            dims = np.asarray(rows["dims"])
            for d in set(np.unique(dims).tolist()) & goals.keys():
                part = rows.filter(pa.array(dims == d)).combine_chunks()
                ids, labels, cells = (np.asarray(part[c]) for c in ("vec_id", "label", "cell"))
                book = books.get(d) or (np.zeros((1, d // 2)), np.zeros((1, d - d // 2)))
                MultiIndex(ids, labels, _matrix(part["v"].combine_chunks(), d), cells, book, words).search(shared.value[d]["v"], goals[d])

        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= CHUNK_ROWS:
                flush()
        flush()
        found = [row for of in goals.values() for goal in of for row in goal.rows()]
        if found:
            yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names)

    return run


def _block(rows: pa.Table) -> dict[int, dict]:
    """Anchors of a block by dimensions; of repeated ids the row with the smallest label and vector is taken."""
    dims = np.asarray(rows["dims"])
    out = {}
    for d in np.unique(dims).tolist():
        part = rows.filter(pa.array(dims == d)).combine_chunks()
        ids, labels, v = np.asarray(part["vec_id"]), np.asarray(part["label"]), _matrix(part["v"].combine_chunks(), d)
        out[d] = {"ids": ids, "labels": labels, "v": v}
    return out


def _top(found: DataFrame, keys: list[str], score: str, row: str, k: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc(score), row)
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(index: DataFrame, books: dict, anchors: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, words: int = WORDS, block: int = BLOCK_ANCHORS) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``anchors`` holds rows of the index.  An anchor's positives are its first ``positives`` other rows of its label by
    falling inner product, ties to the smaller id; for each, the first ``negatives`` rows of other labels whose score
    lies between ``low`` and ``high`` hundredths of the positive's.  Rows with a null id, label, vector or component,
    or a non-finite one, take no part; vectors are compared with those of as many dimensions only; rows that carry the
    anchor's id are no candidates, other repeated rows are each one, but equal positives are one; a repeated anchor counts once (smallest label,
    then vector); negative positive scores have empty windows.

    Anchors go out in blocks of about ``block``: the block's positives are found first, then its negatives, each in
    one pass over the index, and written before the next block begins, so the driver holds one block at a time.
    Every task returns ``k`` rows for an anchor or positive, which the final ranking cuts to k.
    """
    spark = index.sparkSession
    single = materialize(anchors.groupBy("vec_id").agg(F.min(F.struct("label", "v", "dims")).alias("a")).select("vec_id", "a.*"), "anchors")
    blocks = max(1, -(-single.count() // block))
    folder = shared_folder(spark, "hard-negatives")
    schema = "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long, rank int"
    for b in range(blocks):
        own = _block(single.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b).toArrow())
        shared = spark.sparkContext.broadcast(own)

        def near(x: dict) -> list[Near]:
            return [Near(a, label, positives) for a, label in zip(x["ids"].tolist(), x["labels"].tolist(), strict=True)]

        found = index.mapInArrow(_search(shared, near, books, words, ["anchor", "row", "score"]), "anchor long, row long, score long")
        listed: dict[int, list[tuple[int, int]]] = {}
        for anchor, row, score in _top(found, ["anchor"], "score", "row", positives).select("anchor", "row", "score").collect():
            listed.setdefault(anchor, []).append((row, score))

        def windows(x: dict, listed: dict = listed) -> list[Windows]:
            return [Windows(a, label, list(dict.fromkeys(listed.get(a, []))), negatives, low, high) for a, label in zip(x["ids"].tolist(), x["labels"].tolist(), strict=True)]

        names = ["anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"]
        hits = index.mapInArrow(_search(shared, windows, books, words, names), ", ".join(f"{n} long" for n in names))
        _top(hits, ["anchor_id", "positive_id", "positive_score"], "negative_score", "negative_id", negatives).write.parquet(f"{folder}/block={b}")
        shared.destroy()
    found = spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(folder)
    return found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
