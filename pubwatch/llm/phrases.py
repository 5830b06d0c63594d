"""Collocations of two and three words, counted in burst tries over word ids.

Words that are frequent enough get ids: their ranks among the sorted hashes, in arrays that workers memory-map.  A
task counts phrases in a trie over the leading bits of the word ids whose leaves are hash containers; a full container
bursts into children, and when the trie holds too much, its largest subtrees leave whole, as sorted runs.  Runs are
dealt by prefixes (first word and a few bits of the next, so that a hot word spreads) and merged per prefix partition.

A phrase is only counted if its parts are frequent: pairs of frequent words, then triples of two frequent pairs.  No
phrase that reaches the limit is lost, as its parts occur at least as often.  Word hashes have 63 bits and include the
language; phrase keys are exact ids.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pubwatch.llm import textual
from pubwatch.llm.storage import mounted, shared_folder, write_whole
from pubwatch.session import materialize

LEAST_COUNT, TOP, ABSORBED = 10, 2000, 50
UNKNOWN = "und"
#: Bytes of text handled at once, entries a container holds before it bursts, entries a trie holds before it spills.
SLICE_BYTES, BURST, TRIE_ENTRIES = 1 << 21, 1 << 14, 1 << 20
#: A burst makes this many bits of children; a prefix takes as many bits of the second word.
FAN_BITS = 4
#: Ids in one memory-mapped array; least prefix partitions, and words of the corpus a prefix partition has on average.
SHARD_IDS, PREFIXES, PREFIX_WORDS = 1 << 18, 256, 1 << 20
_PLACE_BITS = 33
_PIECE_ENDS = b".,;:!?\x0a\x0b\x0c\x0d"
TABLE = bytes.maketrans(textual.UPPER + b"\x09" + _PIECE_ENDS, textual.UPPER.lower() + b" " + b"\n" * len(_PIECE_ENDS))
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def tokens(offsets: np.ndarray, data: bytes, languages: np.ndarray) -> tuple[np.ndarray, ...]:
    """(hashes, rows, whether the next word follows in the same piece, starts, ends, folded bytes) of all words."""
    folded = data.translate(TABLE)
    text = np.frombuffer(folded, dtype=np.uint8)
    inside = (text != 32) & (text != 10)
    begins = np.zeros(len(text), dtype=bool)
    begins[offsets[:-1][offsets[:-1] < len(text)]] = True
    begins[1:] |= ~inside[:-1]
    begins &= inside
    starts = np.flatnonzero(begins)
    inside_next = np.append(inside[1:] & ~begins[1:], False)
    ends = np.flatnonzero(inside & ~inside_next[: len(inside)]) + 1
    rows = np.searchsorted(offsets, starts, side="right") - 1
    hashes = textual.mix(textual.segment_hashes(text, inside, starts) ^ languages[rows]) >> np.uint64(1)
    piece = np.cumsum(text == 10, dtype=np.int32)[starts]
    follows = np.zeros(len(starts), dtype=bool)
    follows[:-1] = (rows[1:] == rows[:-1]) & (piece[1:] == piece[:-1])
    return hashes, rows, follows, starts, ends, folded


def _languages(column: pa.Array) -> tuple[np.ndarray, list[str], np.ndarray]:
    """(code of each row, names, hash of each row)."""
    coded = column.dictionary_encode() if not pa.types.is_dictionary(column.type) else column
    names = coded.dictionary.to_pylist()
    hashes = np.array([int.from_bytes(hashlib.md5(x.encode(), usedforsecurity=False).digest()[:8], "little") for x in names], dtype=np.uint64)
    codes = np.asarray(coded.indices)
    return codes, names, hashes[codes] if len(names) else np.zeros(len(column), dtype=np.uint64)


def _slices(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, list[str], tuple[np.ndarray, ...]]]:
    """(language code of each row, names, tokens) for slices of a batch of ``text, lang``."""
    codes, names, hashes = _languages(batch.column(1))
    for row, offsets, data in textual.slices(batch.column(0), SLICE_BYTES):
        span = slice(row, row + len(offsets) - 1)
        yield codes[span], names, tokens(offsets, data, hashes[span])


def _strings(folded: bytes, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The words at ascending places, as one Arrow array over the text's bytes."""
    bounds = np.empty(2 * len(starts), dtype=np.int32)
    bounds[0::2], bounds[1::2] = starts, ends
    parts = pa.StringArray.from_buffers(len(bounds) - 1, pa.py_buffer(bounds), pa.py_buffer(folded))
    return parts.take(pa.array(np.arange(0, len(bounds) - 1, 2)))


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names_out = ["lang", "h", "word", "c"]
    for batch in batches:
        for codes, names, (hashes, rows, _, starts, ends, folded) in _slices(batch):
            if not len(hashes):
                continue
            keys, place, counts = np.unique(hashes, return_index=True, return_counts=True)
            order = np.argsort(place)
            keys, place, counts = keys[order], place[order], counts[order]
            spoken = codes[rows]
            totals = np.bincount(spoken, minlength=len(names))
            said = np.flatnonzero(totals)
            yield pa.record_batch([
                pa.array(names, pa.string()).take(pa.array(spoken[place])), pa.array(keys.view(np.int64)),
                _strings(folded, starts[place], ends[place]), pa.array(counts.astype(np.int64))], names_out)
            yield pa.record_batch([
                pa.array(names, pa.string()).take(pa.array(said)), pa.array(np.full(len(said), -1)), pa.nulls(len(said), pa.string()), pa.array(totals[said].astype(np.int64))], names_out)


def count_words(docs: DataFrame, least: int) -> DataFrame:
    """``lang, h, word, c``: words that occur at least ``least`` times; a null word holds its language's total."""
    counted = docs.mapInArrow(_count_words, "lang string, h long, word string, c long")
    summed = counted.groupBy("lang", "h", "word").agg(F.sum("c").alias("c"))
    return materialize(summed.where((F.col("c") >= least) | F.col("word").isNull()), "phrase-words")


@dataclass
class Ids:
    """Ranks of sorted keys, in memory-mapped arrays of bounded size."""

    folder: str
    size: int
    firsts: np.ndarray
    offsets: np.ndarray
    _open: dict = field(default_factory=dict)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_open": {}}

    def _array(self, shard: int) -> np.ndarray:
        if shard not in self._open:
            self._open[shard] = np.memmap(f"{mounted(self.folder)}/{shard}.keys", dtype=np.uint64, mode="r")
        return self._open[shard]

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The rank of every key; -1 for others."""
        unique, back = np.unique(keys, return_inverse=True)
        out = np.full(len(unique), -1, dtype=np.int64)
        shards = np.searchsorted(self.firsts, unique, side="right") - 1
        for shard in np.unique(shards[shards >= 0]).tolist():
            low, high = np.searchsorted(shards, [shard, shard + 1])
            array = self._array(shard)
            at = np.minimum(np.searchsorted(array, unique[low:high]), len(array) - 1)
            hit = array[at] == unique[low:high]
            out[low:high][hit] = self.offsets[shard] + at[hit]
        return out[back]


def with_ids(df: DataFrame, key: str, label: str) -> tuple[DataFrame, Ids]:
    """``df`` with ``id``, the rank of its distinct non-negative ``key``, and the arrays that workers look keys up in.

    The keys are sorted by range; one row per range comes to the driver, about one for ``SHARD_IDS`` keys.
    """
    spark = df.sparkSession
    count = df.count()
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-count // SHARD_IDS))
    placed = df.repartitionByRange(shards, key).sortWithinPartitions(key).withColumn("_place", F.monotonically_increasing_id())
    placed = materialize(placed, label).withColumn("_part", F.shiftright("_place", _PLACE_BITS).cast("int"))
    parts = placed.groupBy("_part").agg(F.min(key).alias("first"), F.count("*").alias("n")).orderBy("_part").collect()
    sizes = np.array([r["n"] for r in parts], dtype=np.int64)
    offsets = np.cumsum(sizes) - sizes
    folder = shared_folder(spark, label)
    numbers = {r["_part"]: k for k, r in enumerate(parts)}

    def write(group: tuple, table: pa.Table) -> pa.Table:
        keys = np.sort(np.asarray(table[key]).view(np.uint64))
        write_whole(f"{folder}/{numbers[group[0].as_py()]}.keys", keys.tobytes())
        return pa.table({"n": pa.array([len(keys)], pa.int64())})

    written = placed.select("_part", key).groupBy("_part").applyInArrow(write, "n long").agg(F.sum("n").alias("n")).first()["n"]
    if (written or 0) != count:
        raise RuntimeError(f"{written} of {count} ids were written")
    starts = spark.createDataFrame([(r["_part"], int(o)) for r, o in zip(parts, offsets, strict=True)], "_part int, _offset long")
    position = F.col("_place") - F.shiftleft(F.col("_part").cast("long"), _PLACE_BITS)
    # One row per range of about SHARD_IDS keys.
    numbered = placed.join(F.broadcast(starts), "_part").withColumn("id", F.col("_offset") + position).drop("_part", "_place", "_offset")
    return numbered, Ids(folder, count, np.array([r["first"] for r in parts], dtype=np.uint64), offsets)


class Container:
    """An open-addressing hash table of keys and counts that doubles as it fills."""

    def __init__(self, slots: int = 1 << 8):
        self.keys, self.counts, self.n = np.full(slots, _EMPTY), np.zeros(slots, dtype=np.int64), 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        """``keys`` are distinct."""
        if 2 * (self.n + len(keys)) > len(self.keys):
            old, held = self.keys[self.keys != _EMPTY], self.counts[self.keys != _EMPTY]
            slots = 1 << int(4 * (self.n + len(keys))).bit_length()
            self.keys, self.counts, self.n = np.full(slots, _EMPTY), np.zeros(slots, dtype=np.int64), 0
            self._insert(old, held)
        self._insert(keys, counts)

    def _insert(self, keys: np.ndarray, counts: np.ndarray) -> None:
        mask = np.uint64(len(self.keys) - 1)
        at = (textual.mix(keys) & mask).astype(np.int64)
        while len(keys):
            free = self.keys[at] == _EMPTY
            self.keys[at[free]] = keys[free]
            mine = self.keys[at] == keys
            self.n += int((mine & free).sum())
            self.counts[at[mine]] += counts[mine]
            keys, counts, at = keys[~mine], counts[~mine], (at[~mine] + 1) & int(mask)

    def entries(self) -> tuple[np.ndarray, np.ndarray]:
        """Keys in order, and their counts."""
        used = self.keys != _EMPTY
        order = np.argsort(self.keys[used])
        return self.keys[used][order], self.counts[used][order]


class PhraseTrie:
    """Containers under a trie over the leading bits of keys of ``width`` bits."""

    def __init__(self, width: int, burst: int = BURST):
        self.width, self.burst = width, burst
        self.lows, self.depths, self.leaves = [0], [0], [Container()]

    def __len__(self) -> int:
        return sum(leaf.n for leaf in self.leaves)

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        """``keys`` are distinct and ascending."""
        edges = [*np.searchsorted(keys, np.array(self.lows, dtype=np.uint64)).tolist(), len(keys)]
        for k in range(len(self.leaves) - 1, -1, -1):
            if edges[k + 1] > edges[k]:
                self._put(k, keys[edges[k] : edges[k + 1]], counts[edges[k] : edges[k + 1]])

    def _put(self, k: int, keys: np.ndarray, counts: np.ndarray) -> None:
        leaf, depth = self.leaves[k], self.depths[k] + FAN_BITS
        if leaf.n + len(keys) <= self.burst or depth > self.width:
            leaf.add(keys, counts)
            return
        step = 1 << (self.width - depth)
        lows = [self.lows[k] + step * c for c in range(1 << FAN_BITS)]
        self.lows[k : k + 1], self.depths[k : k + 1] = lows, [depth] * len(lows)
        self.leaves[k : k + 1] = [Container() for _ in lows]
        for part, held in (leaf.entries(), (keys, counts)):
            edges = [*np.searchsorted(part, np.array(lows, dtype=np.uint64)).tolist(), len(part)]
            for c in range(len(lows) - 1, -1, -1):
                if edges[c + 1] > edges[c]:
                    # A child may burst in turn, which moves only the leaves behind it.
                    at = self.lows.index(lows[c])
                    if self.depths[at] == depth:
                        self._put(at, part[edges[c] : edges[c + 1]], held[edges[c] : edges[c + 1]])
                    else:
                        self._below(lows[c], step, part[edges[c] : edges[c + 1]], held[edges[c] : edges[c + 1]])

    def _below(self, low: int, step: int, keys: np.ndarray, counts: np.ndarray) -> None:
        """Add to the leaves of a subtree that has burst."""
        at = [k for k, x in enumerate(self.lows) if low <= x < low + step]
        edges = [*np.searchsorted(keys, np.array([self.lows[k] for k in at], dtype=np.uint64)).tolist(), len(keys)]
        for c in range(len(at) - 1, -1, -1):
            if edges[c + 1] > edges[c]:
                self._put(at[c], keys[edges[c] : edges[c + 1]], counts[edges[c] : edges[c + 1]])

    def spill(self, keep: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Sorted runs of the largest subtrees below the root, until at most ``keep`` entries are left."""
        shift = max(self.width - FAN_BITS, 0)
        sizes: dict[int, int] = {}
        for low, leaf in zip(self.lows, self.leaves, strict=True):
            sizes[low >> shift] = sizes.get(low >> shift, 0) + leaf.n
        left = sum(sizes.values())
        for tree, n in sorted(sizes.items(), key=lambda x: -x[1]):
            if left <= keep or not n:
                return
            own = [k for k, low in enumerate(self.lows) if low >> shift == tree]
            runs = [self.leaves[k].entries() for k in own]
            yield np.concatenate([r[0] for r in runs]), np.concatenate([r[1] for r in runs])
            first, depth = own[0], min(self.depths[own[0]], FAN_BITS)
            self.lows[first : own[-1] + 1], self.depths[first : own[-1] + 1], self.leaves[first : own[-1] + 1] = [self.lows[first]], [depth], [Container()]
            left -= n


def _keys(words: Ids, pairs: Ids | None, bits: int, hashes: np.ndarray, follows: np.ndarray) -> np.ndarray:
    """Keys of all places where a pair (or, with ``pairs``, a triple) of frequent parts starts."""
    ids = words.find(hashes)
    shift = np.uint64(bits)
    at = np.flatnonzero(follows[:-1] & (ids[:-1] >= 0) & (ids[1:] >= 0)) if len(ids) else np.zeros(0, dtype=np.int64)
    two = ids[at].astype(np.uint64) << shift | ids[at + 1].astype(np.uint64)
    if pairs is None:
        return two
    ranks = np.full(len(ids) + 1, -1, dtype=np.int64)
    ranks[at] = pairs.find(two)
    start = np.flatnonzero((ranks[:-1] >= 0) & (ranks[1:] >= 0))
    return ranks[start].astype(np.uint64) << shift | ids[start + 2].astype(np.uint64)


def _count_phrases(words: Ids, pairs: Ids | None, bits: int, width: int, prefixes: int, burst: int, entries: int):
    def runs(trie: PhraseTrie, keep: int) -> Iterator[pa.RecordBatch]:
        for keys, counts in trie.spill(keep):
            prefix = (textual.mix(keys >> np.uint64(max(bits - FAN_BITS, 0))) % np.uint64(prefixes)).astype(np.int64)
            order = np.argsort(prefix, kind="stable")
            keys, counts, prefix = keys[order], counts[order].astype(np.uint32), prefix[order]
            heads = np.flatnonzero(np.append(True, prefix[1:] != prefix[:-1]))
            edges = [*heads.tolist(), len(keys)]
            yield pa.record_batch([
                pa.array(prefix[heads].astype(np.int32)), pa.array([keys[a:b].tobytes() for a, b in zip(edges, edges[1:], strict=False)], pa.binary()),
                pa.array([counts[a:b].tobytes() for a, b in zip(edges, edges[1:], strict=False)], pa.binary())], ["prefix", "keys", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = PhraseTrie(width, burst)
        for batch in batches:
            for _, _, (hashes, _, follows, *_) in _slices(batch):
                trie.add(*np.unique(_keys(words, pairs, bits, hashes, follows), return_counts=True))
                if len(trie) > entries:
                    yield from runs(trie, entries // 2)
        yield from runs(trie, 0)

    return run


def _merge(runs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """One sorted run of several; a stable sort merges what is already in order."""
    keys, counts = np.concatenate([r[0] for r in runs]), np.concatenate([r[1] for r in runs])
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    heads = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[heads], np.add.reduceat(counts[order], heads)


def _merge_runs(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prefix, held, size = None, [], 0

        def done() -> Iterator[pa.RecordBatch]:
            if held:
                keys, counts = _merge(held)
                yield pa.record_batch([pa.array(keys[counts >= least].view(np.int64)), pa.array(counts[counts >= least])], ["k", "c"])

        for batch in batches:
            for p, keys, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if p != prefix:
                    yield from done()
                    prefix, held, size = p, [], 0
                held.append((np.frombuffer(keys, dtype=np.uint64), np.frombuffer(counts, dtype=np.uint32).astype(np.int64)))
                size += len(held[-1][0])
                if size > 4 * PREFIX_WORDS:
                    held = [_merge(held)]
                    size = len(held[0][0])
        yield from done()

    return run


def count_phrases(docs: DataFrame, words: Ids, pairs: Ids | None, total: int, least: int, label: str, burst: int = BURST, entries: int = TRIE_ENTRIES) -> DataFrame:
    """``k, c``: the phrases that occur at least ``least`` times; k holds the ids of the first part and the last word."""
    bits = max(words.size.bit_length(), 1)
    width = bits + max((words.size if pairs is None else pairs.size).bit_length(), 1)
    if width > 63:
        raise ValueError(f"{words.size} frequent words and their phrases need {width} bits, more than 63")
    prefixes = max(PREFIXES, total // PREFIX_WORDS)
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), prefixes // 4)
    runs = docs.mapInArrow(_count_phrases(words, pairs, bits, width, prefixes, burst, entries), "prefix int, keys binary, counts binary")
    merged = runs.repartition(parts, "prefix").sortWithinPartitions("prefix").mapInArrow(_merge_runs(least), "k long, c long")
    return materialize(merged, label)


def exact_score(a: str, first: str, rest: str) -> Column:
    """floor(1000000 * a * a / (first * rest)) in decimals of 38 digits: exact for counts below 10^15."""
    whole = lambda c: f"cast({c} as decimal(15, 0))"
    return F.expr(f"cast((cast(1000000 as decimal(7, 0)) * {whole(a)} * {whole(a)}) div ({whole(first)} * {whole(rest)}) as bigint)")


def mine_phrases(docs: DataFrame, least: int = LEAST_COUNT, top: int = TOP, absorbed: int = ABSORBED, text: str = "text", lang: str = "lang", burst: int = BURST, entries: int = TRIE_ENTRIES) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's first ``top`` phrases of two and three words.

    Texts (null: empty; A-Z lower-cased) are cut into pieces at ``.,;:!?`` and line ends, and those into words at
    blanks and tabs.  A phrase that occurs ``a >= least`` times scores floor(10^6 a a / (l r)) at its lowest-scoring
    cut, the earlier one of ties, where l and r count the two parts.  Pairs that lie in a triple with at least
    ``absorbed`` hundredths of their count are dropped.  A null language is ``und``; repeated rows count as often; other
    columns are ignored; empty tables and texts without words give no rows.  A text is handled whole, so a task's
    memory is about 60 bytes for each byte of its longest text, if that is above ``SLICE_BYTES``.
    """
    rows = docs.select(F.coalesce(F.col(text), F.lit("")).alias("text"), F.coalesce(F.col(lang).cast("string"), F.lit(UNKNOWN)).alias("lang"))
    counted = count_words(rows, least)
    totals = counted.where("word is null").select("lang", F.col("c").alias("n"))
    total = totals.agg(F.sum("n").alias("n")).first()["n"] or 0
    words, word_ids = with_ids(counted.where("word is not null"), "h", "word-ids")
    bits = max(word_ids.size.bit_length(), 1)
    mask = (1 << bits) - 1
    pairs, pair_ids = with_ids(count_phrases(rows, word_ids, None, total, least, "word-pairs", burst, entries), "k", "pair-ids")
    triples = count_phrases(rows, word_ids, pair_ids, total, least, "word-triples", burst, entries)

    named = lambda n: words.select(F.col("id").alias(f"i{n}"), F.col("word").alias(f"w{n}"), F.col("c").alias(f"c{n}"))
    last = lambda c: F.col(c).bitwiseAND(F.lit(mask))
    two = pairs.select("id", "k", "c", F.shiftright("k", bits).alias("i1"), last("k").alias("i2"))
    three = (
        triples.select(F.shiftright("k", bits).alias("id"), last("k").alias("i3"), F.col("c").alias("a"))
        .join(two.select("id", F.col("k").alias("k12"), F.col("c").alias("c12"), "i1", "i2"), "id")
        .withColumn("k23", F.shiftleft(F.col("i2"), bits).bitwiseOR(F.col("i3"))).drop("id")
        .join(two.select(F.col("k").alias("k23"), F.col("c").alias("c23")), "k23")
    )
    three = materialize(three, "phrase-triples")
    inside = three.select(F.explode(F.array("k12", "k23")).alias("k"), "a").groupBy("k").agg(F.max("a").alias("longest"))
    open_pairs = two.join(inside, "k", "left").where(F.coalesce(100 * F.col("longest") < absorbed * F.col("c"), F.lit(True)))
    languages = words.select(F.col("id").alias("i1"), "lang")
    of_two = open_pairs.select("i1", "i2", F.col("c").alias("a")).join(named(1), "i1").join(named(2), "i2").join(languages, "i1").select(
        "lang", F.concat_ws(" ", "w1", "w2").alias("phrase"), "a", F.col("c1").alias("l"), F.col("c2").alias("r"), exact_score("a", "c1", "c2").alias("score"))
    cut = F.struct(exact_score("a", "c1", "c23").alias("score"), F.lit(1).alias("k"), F.col("c1").alias("l"), F.col("c23").alias("r"))
    other = F.struct(exact_score("a", "c12", "c3").alias("score"), F.lit(2).alias("k"), F.col("c12").alias("l"), F.col("c3").alias("r"))
    of_three = three.join(named(1), "i1").join(named(2), "i2").join(named(3), "i3").join(languages, "i1").select(
        "lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), "a", F.least(cut, other).alias("cut")).select(
        "lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = of_two.unionByName(of_three).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
