"""An interpolated modified Kneser-Ney bigram model, counted by Spark and read from sorted hash arrays.

Counting: tasks pre-aggregate their n-grams to sorted hash blocks, dealt by ranges of the (mixed) hash, so no group
depends on how frequent a word is.  A task takes the shards of a file in order, merges each one's blocks, adds the
sorted hashes and counts to the file in the shared folder, and passes on what each context and each continuation gains;
these are gathered over shards and merged in a second shuffle.  Scoring: workers look the sorted n-grams of many texts up
in the files, a memory-mapped one at a time.  The number of files has a limit, so a lookup does not grow with the shards.

A bigram's key is 32 bits of the context's hash and 32 bits of the word's; unigram counts use 64 bits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import ExitStack
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from pubwatch.llm import textual
from pubwatch.llm.storage import mounted, shared_folder, whole_file
from pubwatch.session import bounded_batches, materialize

UNIGRAM, BIGRAM, CONTEXT, CONTINUATION = range(4)
#: Tokens a shard holds on average, and tokens a task gathers before it passes its counts on.
SHARD_TOKENS, FLUSH_TOKENS = 1 << 21, 1 << 22
#: The files of a kind are at most 2 to this power.
FILE_BITS = 6
#: Keys of contexts and continuations that a task gathers before it passes them on, and tokens looked up at once.
FLUSH_KEYS, LOOKUP_TOKENS = 1 << 20, 1 << 19
#: A kind's key and values as they are kept, and how many arrays its blocks hold.
LAYOUT = {UNIGRAM: (np.uint64, np.uint64), BIGRAM: (np.uint64, np.float32), CONTEXT: (np.uint32, np.float32, np.float32), CONTINUATION: (np.uint32, np.float32)}
BLOCK_ARRAYS = {UNIGRAM: 2, BIGRAM: 2, CONTEXT: 5, CONTINUATION: 2}
BEGIN, END = np.uint64(0x0123456789ABCDEF), np.uint64(0xFEDCBA9876543210)
_HALF = np.uint64(32)
_ROW = "kind int, shard int, blob binary, a double, b double, c double, d double, e double"
_NAMES = ["kind", "shard", "blob", "a", "b", "c", "d", "e"]
_TYPES = [pa.int32(), pa.int32(), pa.binary(), *[pa.float64()] * 5]


def sequence(words: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(tokens with an end after each row, the token before each, where each row starts)."""
    rows = len(bounds) - 1
    tokens = np.empty(len(words) + rows, dtype=np.uint64)
    tokens[np.arange(len(words)) + np.repeat(np.arange(rows), np.diff(bounds))] = words
    tokens[bounds[1:] + np.arange(rows)] = END
    starts = bounds[:-1] + np.arange(rows)
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[starts] = BEGIN
    return tokens, before, starts


def bigram_keys(before: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    return textual.mix((before >> _HALF) << _HALF | tokens >> _HALF)


def pack(keys: np.ndarray, *values: np.ndarray) -> bytes:
    """Sorted keys as differences, and values, by byte planes: the high planes compress to nothing."""
    planes = [np.ascontiguousarray(x.astype(np.uint64).view(np.uint8).reshape(-1, 8).T) for x in (np.diff(keys, prepend=np.uint64(0)), *values)]
    return zstandard.compress(b"".join(p.tobytes() for p in planes), 1)


def unpack(blob: bytes, n: int) -> list[np.ndarray]:
    data = np.frombuffer(zstandard.decompress(blob), dtype=np.uint8).reshape(n, 8, -1)
    arrays = [np.ascontiguousarray(x.T).view(np.uint64).ravel() for x in data]
    return [np.cumsum(arrays[0], dtype=np.uint64), *arrays[1:]]


def merge(parts: list[list[np.ndarray]]) -> list[np.ndarray]:
    """Distinct keys in order, values of equal keys added."""
    keys = np.concatenate([p[0] for p in parts])
    order = np.argsort(keys)
    keys = keys[order]
    heads = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, dtype=np.int64)
    return [keys[heads], *(np.add.reduceat(np.concatenate([p[k] for p in parts])[order], heads) if len(keys) else np.zeros(0) for k in range(1, len(parts[0])))]


def shard_of(keys: np.ndarray, bits: int, width: int) -> np.ndarray:
    return (keys >> np.uint64(width - bits)).astype(np.int64) if bits else np.zeros(len(keys), dtype=np.int64)


def _blocks(kind: int, arrays: list[np.ndarray], bits: int, width: int) -> Iterator[tuple]:
    shards = shard_of(arrays[0], bits, width)
    edges = np.append(np.flatnonzero(np.append(True, shards[1:] != shards[:-1])), len(shards)) if len(shards) else []
    for low, high in zip(edges[:-1], edges[1:], strict=True):
        yield kind, int(shards[low]), pack(*(x[low:high] for x in arrays)), *[0.0] * 5


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], _NAMES)


def _flush(held: dict[int, list[list[np.ndarray]]], bits: int, width: int) -> Iterator[pa.RecordBatch]:
    """Blocks of what is held by kind, which is merged and let go."""
    for kind, parts in held.items():
        rows = list(_blocks(kind, merge(parts), bits, width)) if parts else []
        parts.clear()
        if rows:
            yield _batch(rows)


def _count(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[list[np.ndarray]]] = {UNIGRAM: [], BIGRAM: []}
        size = 0
        for batch in batches:
            for _, offsets, data in textual.slices(batch.column(0)):
                tokens, before, _ = sequence(*textual.words(offsets, data))
                for kind, keys in ((UNIGRAM, tokens), (BIGRAM, bigram_keys(before, tokens))):
                    keys, counts = np.unique(keys, return_counts=True)
                    held[kind].append([keys, counts.astype(np.uint64)])
                size += len(tokens)
                if size >= FLUSH_TOKENS:
                    yield from _flush(held, bits, 64)
                    size = 0
        yield from _flush(held, bits, 64)

    return run


def _array_file(folder: str, kind: int, file: int, array: int) -> str:
    return f"{folder}/{kind}-{file}.{array}"


def _by_file(parts: DataFrame, bits: int) -> DataFrame:
    """All blocks of a file in one task, in the order of their shards."""
    return parts.repartition("kind", F.shiftright("shard", max(0, bits - FILE_BITS))).sortWithinPartitions("kind", "shard")


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, list[np.ndarray]]]:
    """(kind, shard, merged arrays) of blocks in this order."""
    blocks = (row for batch in batches for row in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True))
    for (kind, shard), group in groupby(blocks, lambda row: row[:2]):
        yield kind, shard, merge([unpack(blob, BLOCK_ARRAYS[kind]) for *_, blob in group])


def _write(folder: str, bits: int, shards: Iterator[tuple[int, int, list[np.ndarray]]], keep: Callable) -> Iterator:
    """Adds each shard's arrays ``keep(kind, shard, arrays)[0]`` to its file, passes the rest of the result on."""
    for (kind, file), group in groupby(shards, lambda s: (s[0], s[1] >> max(0, bits - FILE_BITS))):
        with ExitStack() as stack:
            outs = [stack.enter_context(whole_file(_array_file(folder, kind, file, k))) for k in range(len(LAYOUT[kind]))]
            for shard in group:
                kept, rest = keep(*shard)
                for out, array, form in zip(outs, kept, LAYOUT[kind], strict=True):
                    out.write(array.astype(form).tobytes())
                yield rest


def _kinds(counts: np.ndarray) -> list[float]:
    """How many n-grams occur once, twice, three and four times."""
    return [float((counts == k).sum()) for k in (1, 2, 3, 4)]


def _merge_counts(folder: str, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[list[np.ndarray]]] = {CONTEXT: [], CONTINUATION: []}

        def keep(kind: int, shard: int, arrays: list[np.ndarray]) -> tuple[list[np.ndarray], tuple]:
            keys, counts = arrays
            if kind == UNIGRAM:
                return arrays, (kind, shard, b"", float(counts.sum()), float(len(keys)), 0.0, 0.0, 0.0)
            plain = textual.unmix(keys)
            context, word = plain >> _HALF, plain & np.uint64(0xFFFFFFFF)
            of = lambda k: (counts == k if k < 3 else counts >= k).astype(np.uint64)
            held[CONTEXT].append(merge([[context, counts, of(1), of(2), of(3)]]))
            held[CONTINUATION].append(merge([[word, np.ones(len(word), dtype=np.uint64)]]))
            return arrays, (kind, shard, b"", *_kinds(counts), 0.0)

        for row in _write(folder, bits, _merged(batches), keep):
            yield _batch([row])
            if sum(len(part[0]) for parts in held.values() for part in parts) >= FLUSH_KEYS:
                yield from _flush(held, bits, 32)
        yield from _flush(held, bits, 32)

    return run


def _merge_contexts(folder: str, bits: int, discounts: tuple[float, float, float]):
    def keep(kind: int, shard: int, arrays: list[np.ndarray]) -> tuple[list[np.ndarray], tuple]:
        keys, *values = arrays
        if kind == CONTEXT:
            total = values[0].astype(np.float64)
            kept = sum(d * v.astype(np.float64) for d, v in zip(discounts, values[1:], strict=True)) / total
            return [keys, total, kept], (kind, shard, b"", *[0.0] * 5)
        return arrays, (kind, shard, str(int(values[0].sum())).encode(), *_kinds(values[0]), float((values[0] >= 3).sum()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _write(folder, bits, _merged(batches), keep):
            yield _batch([row])

    return run


def discounts_of(once: float, twice: float, thrice: float, four: float) -> tuple[float, float, float]:
    """The three discounts from the numbers of n-grams by count; 0.5, 1, 1.5 where these give none within bounds."""
    usual = (0.5, 1.0, 1.5)
    if not (once and twice and thrice):
        return usual
    y = once / (once + 2 * twice)
    found = (1 - 2 * y * twice / once, 2 - 3 * y * thrice / twice, 3 - 4 * y * four / thrice)
    return found if all(0 < d <= k for k, d in enumerate(found, 1)) else usual


@dataclass(frozen=True)
class Model:
    """Where the arrays are, and the sums that hold for all of them."""

    folder: str
    bits: int
    tokens: int
    distinct: int
    bigrams: tuple[float, float, float]
    unigrams: tuple[float, float, float]
    continuations: float
    #: Probability that the unigram level hands to the uniform distribution.
    spare: float

    @property
    def file_bits(self) -> int:
        return min(self.bits, FILE_BITS)


def train(docs: DataFrame, text: str = "text", shard_tokens: int = SHARD_TOKENS) -> Model:
    """Count all texts of ``docs`` (null: empty) and write the model to the shared folder, which must be mounted."""
    spark = docs.sparkSession
    folder = mounted(shared_folder(spark, "kneser-ney"))
    bounded_batches(spark)
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    bits = max(0, int(size // 6 // shard_tokens).bit_length())
    merged = _by_file(docs.select(text).mapInArrow(_count(bits), _ROW), bits).mapInArrow(_merge_counts(folder, bits), _ROW)
    merged = materialize(merged, "ngram-sums")
    sums = {r.kind: r for r in merged.where(F.length("blob") == 0).groupBy("kind").agg(*(F.sum(x).alias(x) for x in "abcd")).collect()}
    first, second = sums.get(UNIGRAM), sums.get(BIGRAM)
    bigrams = discounts_of(*(second[x] for x in "abcd")) if second else discounts_of(0, 0, 0, 0)
    rest = materialize(_by_file(merged.where(F.length("blob") > 0), bits).mapInArrow(_merge_contexts(folder, bits, bigrams), _ROW), "context-sums")
    row = rest.where(F.col("kind") == CONTINUATION).agg(
        *(F.coalesce(F.sum(x), F.lit(0.0)).alias(x) for x in "abcde"), F.sum(F.col("blob").cast("string").cast("double")).alias("all")
    ).first()
    unigrams = discounts_of(*(row[x] for x in "abcd"))
    whole = row["all"] or 0.0
    spare = (unigrams[0] * row["a"] + unigrams[1] * row["b"] + unigrams[2] * row["e"]) / whole if whole else 1.0
    return Model(folder, bits, int(first.a) if first else 0, int(first.b) if first else 0, bigrams, unigrams, whole, spare)


class Arrays:
    """The arrays of a model; a file is mapped while it is looked into, so only one takes memory."""

    def __init__(self, model: Model):
        self.model = model

    def arrays(self, kind: int, file: int) -> list[np.ndarray] | None:
        try:
            return [np.memmap(_array_file(self.model.folder, kind, file, k), dtype=form, mode="r") for k, form in enumerate(LAYOUT[kind])]
        except FileNotFoundError:  # no n-gram has such a hash
            return None

    def find(self, kind: int, keys: np.ndarray) -> list[np.ndarray]:
        """The values of sorted distinct keys, 0 for unknown ones."""
        width = 64 if kind in (UNIGRAM, BIGRAM) else 32
        out = [np.zeros(len(keys)) for _ in LAYOUT[kind][1:]]
        files = shard_of(keys, self.model.file_bits, width)
        edges = np.append(np.flatnonzero(np.append(True, files[1:] != files[:-1])), len(files)) if len(keys) else []
        for low, high in zip(edges[:-1], edges[1:], strict=True):
            arrays = self.arrays(kind, int(files[low]))
            if arrays is None:
                continue
            wanted = keys[low:high].astype(arrays[0].dtype)
            at = np.searchsorted(arrays[0], wanted)
            at[at == len(arrays[0])] = 0
            known = arrays[0][at] == wanted
            for o, values in zip(out, arrays[1:], strict=True):
                o[low:high] = np.where(known, values[at], 0)
        return out


def discounted(counts: np.ndarray, by: tuple[float, float, float]) -> np.ndarray:
    return np.maximum(counts - np.array([0.0, *by])[np.minimum(counts, 3).astype(np.int64)], 0)


def log_probabilities(arrays: Arrays, tokens: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(log10 probability of each token after the one before it, its count in training)."""
    m = arrays.model
    single, place = np.unique(np.append(tokens, BEGIN), return_inverse=True)
    counts = arrays.find(UNIGRAM, single)[0]
    half, narrow = np.unique(single >> _HALF, return_inverse=True)
    total, kept = (x[narrow] for x in arrays.find(CONTEXT, half))
    follows = arrays.find(CONTINUATION, half)[0][narrow]
    alone = discounted(follows, m.unigrams) / max(m.continuations, 1.0) + m.spare / (m.distinct + 1)
    own = place[:-1]
    context = np.append(place[-1], own[:-1])
    context[before == BEGIN] = place[-1]
    pairs, where = np.unique(bigram_keys(before, tokens), return_inverse=True)
    pair = arrays.find(BIGRAM, pairs)[0][where]
    with np.errstate(divide="ignore", invalid="ignore"):
        p = np.where(total[context] > 0, discounted(pair, m.bigrams) / total[context] + kept[context] * alone[own], alone[own])
    return np.log10(p), counts[own]


def _row_sums(arrays: Arrays, slices: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> list[np.ndarray]:
    """(tokens, known tokens, base score, score) of each row of some slices."""
    m, ends = arrays.model, np.cumsum([len(tokens) for tokens, *_ in slices])
    tokens, before = (np.concatenate([s[k] for s in slices]) for k in (0, 1))
    starts = np.concatenate([s[2] + end - len(s[0]) for s, end in zip(slices, ends, strict=True)])
    logs, counts = log_probabilities(arrays, tokens, before)
    base = np.log10((counts + 0.5) / (m.tokens + 0.5 * (m.distinct + 1)))
    return [np.diff(np.append(starts, len(tokens))), *(np.add.reduceat(x, starts) for x in ((counts > 0).astype(np.int64), base, logs))]


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Adds ``n_tokens, n_known, train_tokens, base_score, score`` (log10) to every row, from its whole text.

    Tokens are the words between white space, A-Z lower-cased, then one end; null and empty texts have the end
    alone.  Columns of these names are replaced; an untrained model gives every token the uniform probability.
    """
    added = [("n_tokens", LongType()), ("n_known", LongType()), ("train_tokens", LongType()), ("base_score", DoubleType()), ("score", DoubleType())]
    names = [c for c in docs.columns if c not in dict(added)]
    docs = docs.select(*names)
    bounded_batches(docs.sparkSession)
    schema, place = StructType([*docs.schema.fields, *(StructField(n, t) for n, t in added)]), names.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrays = Arrays(model)
        for batch in batches:
            parts, held = [], []
            for _, offsets, data in textual.slices(batch.column(place)):
                held.append(sequence(*textual.words(offsets, data)))
                if sum(len(tokens) for tokens, *_ in held) >= LOOKUP_TOKENS:
                    parts.append(_row_sums(arrays, held))
                    held = []
            if held:
                parts.append(_row_sums(arrays, held))
            n, known, base, logs = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0),) * 4
            yield pa.record_batch([*batch.columns, pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array(np.full(len(n), model.tokens), pa.int64()), pa.array(base, pa.float64()), pa.array(logs, pa.float64())], [*names, *dict(added)])

    return docs.mapInArrow(run, schema)


def held_out(doc_id: str = "doc_id", folds: int = 5, fold: int = 1) -> Column:
    """Whether crc32 of the id's text falls in the fold that is not learned from; a null id is like empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % folds == fold
