"""Near-duplicate join by Jaccard similarity of word shingles, with a matrix of token groups.

Rows with equal shingle sets are one node.  Similar nodes are put into groups: nodes that share a band of minimum
hashes are compared to one leader, those that reach the threshold form its star, and the others meet another leader in the next
round, hence components without any pair list.

Near copies that no star takes in form a family around the leader they resemble most, and are told by how they differ from
it (``family_links``).  The token-group matrix then holds for every group of at most ``GROUP`` nodes of a family (or of a
component without one) the union of their shingles.  A node of another family that shares a prefix shingle with the group is a query: its overlap
with the union bounds its overlap with every member, and only groups whose bound reaches what the smallest member
needs are opened.

No link is lost: under one global order of the shingles, sets with Jaccard of at least t share one of each set's
first n - ceil(t n) + 1 shingles.  The order puts shingles with frequent sketch cells last, so that passages which
many documents share are not what candidates are found by.  At a shingle that two prefixes share, whatever comes before
it and is in no other prefix is in one set only: this and what is left behind it bound the overlap.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from pubwatch.functions.base import computed
from pubwatch.llm import bits, textual
from pubwatch.llm.storage import release
from pubwatch.session import bounded_batches, materialize

WORDS, PERCENT = 4, 85
GROUP = 32
#: Rounds of stars; more or fewer only move links between the stars and the matrix.
ROUNDS = 3
#: Bounds of the sketch's cells; fuller cells only worsen the order of shingles.
LEAST_CELLS, MOST_CELLS = 1 << 16, 1 << 24
#: A prefix is longer than what a link can lose by this part of it; more shingles tell more, and meet more often.
SPARE = 4
#: Classes of frequency in a doubling, and the first class of cells that hold twice the mean: shingles below it are rare.
STEPS, FREQUENT = 4, 17
SALT = textual.mix(np.arange(1, 2, dtype=np.uint64))[0]
#: Minimum hashes of a band; of J to this power of the pairs with Jaccard J a band is equal.
BAND = 3
#: A node belongs to the family of a leader whose set it resembles by so many percent, and a family of more nodes is dealt in parts.
NEAR, DEALT = 50, 512
#: Times a family's leader takes the place of a leader that belongs to a family itself; every time doubles the steps made.
JUMPS = 2
#: Bands over all shingles, which copies of one text share, and over the rare ones, which passages don't fill.
ANY, RARE = 5, 2


def shingles(offsets: np.ndarray, data: bytes, n: int) -> Iterator[np.ndarray]:
    """For every row its shingles' hashes, in text order; a row of fewer words has one for the whole sequence."""
    words, bounds = textual.words(offsets, data)
    all_shingles = textual.combine(words, n)
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= n:
            yield all_shingles[a : b - n + 1]
        elif b > a:
            yield textual.mix(textual.combine(words[a:b], b - a) ^ np.uint64(b - a))
        else:
            yield words[:0]


def node_of(distinct: np.ndarray) -> int:
    """A set's 64-bit name: the sum of its mixed shingles."""
    with np.errstate(over="ignore"):
        return int(textual.mix(textual.mix(distinct ^ SALT).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(distinct))).view(np.int64)[0])


def minimum_bands(ordered: np.ndarray, bands: int) -> np.ndarray:
    """Hashes of ``bands`` bands of minimum hashes: the range of hashes is cut into equal parts, a part's least shingle
    (of an empty part the next one's) is one minimum.  ``ordered`` is sorted, so nothing is hashed again.
    """
    parts = bands * BAND
    starts = np.arange(parts, dtype=np.uint64) * np.uint64((1 << 64) // parts)
    least = ordered[np.searchsorted(ordered, starts) % len(ordered)].reshape(bands, BAND)
    total = least[:, 0]
    for k in range(1, BAND):
        total = textual.mix(total) + least[:, k]
    return textual.mix(total)


def least_overlap(n: int, percent: int) -> int:
    return -(-percent * n // 100)


def shared_prefix(n, percent: int):
    """How many shingles of their prefixes two linked sets share at least, for the smaller size n; more for like sizes, see ``_shared_enough``."""
    return (n - least_overlap(n, percent)) // SPARE + 1


def frequency_classes(docs: DataFrame, text: str, n: int) -> np.ndarray:
    """For every sketch cell how often its shingles occur, as a logarithm: ``STEPS`` classes a doubling, ``FREQUENT`` at twice the mean."""
    bounded_batches(docs.sparkSession)
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    cells = bits.bits_for(size / 64, LEAST_CELLS, MOST_CELLS, 1)
    shift = np.uint64(64 - cells.bit_length() + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(cells, dtype=np.uint32)
        for batch in batches:
            for _, offsets, data in textual.slices(batch.column(0)):
                words, _ = textual.words(offsets, data)
                np.add.at(total, (textual.combine(words, n) >> shift).astype(np.int64), np.uint32(1))
        yield from bits.blocks(total)

    total = bits.gather_counts(docs.select(text).mapInArrow(run, bits.SCHEMA), cells)
    kinds, least = np.zeros(cells, dtype=np.uint8), 2 * max(1.0, float(total.mean()))
    step = 1 - FREQUENT
    while (above := total >= least * 2 ** (step / STEPS)).any():
        kinds += above
        step += 1
    return kinds


def features(docs: DataFrame, doc_id: str, text: str, n: int, percent: int) -> DataFrame:
    """``doc_id, source, node, n, mins, prefix`` of every row; an empty set has n 0 and empty lists.

    ``source`` is a hash of the text, by which ``sets_of`` finds a node's text without making every row's shingles.
    """
    shared = docs.sparkSession.sparkContext.broadcast(frequency_classes(docs, text, n))
    longs = ArrayType(LongType(), False)
    schema = StructType([StructField("doc_id", docs.schema[doc_id].dataType), StructField("source", LongType()), StructField("node", LongType()), StructField("n", IntegerType()), StructField("mins", longs), StructField("prefix", longs)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        shift = np.uint64(64 - len(table).bit_length() + 1)
        for batch in batches:
            for row, offsets, data in textual.slices(batch.column(2)):
                nodes, sizes, mins, prefixes = [], [], [], []
                for found in shingles(offsets, data, n):
                    s = np.unique(found)
                    size = len(s)
                    nodes.append(node_of(s))
                    sizes.append(size)
                    kind = table[(s >> shift).astype(np.int64)]
                    prefixes.append(s[np.argsort(kind, kind="stable")[: size - least_overlap(size, percent) + shared_prefix(size, percent) if size else 0]])
                    rare = s[kind < FREQUENT]
                    rare = rare if len(rare) else s
                    mins.append(np.concatenate([minimum_bands(s, ANY), minimum_bands(rare, RARE)]) if size else s)
                lists = [pa.ListArray.from_arrays(np.append(0, np.cumsum([len(x) for x in part])).astype(np.int32), np.concatenate(part).view(np.int64)) for part in (mins, prefixes)]
                yield pa.record_batch([*(batch.column(k).slice(row, len(nodes)) for k in (0, 1)), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int32()), *lists], schema.names)

    return materialize(docs.select(doc_id, F.xxhash64(text), text).mapInArrow(run, schema), "shingle-features")


def sets_of(docs: DataFrame, text: str, rows: DataFrame, nodes: DataFrame, n: int) -> DataFrame:
    """``node, shingles`` of the wanted nodes: a filter of one text's hash each goes to the texts, not the texts to a join."""
    sources = materialize(rows.join(nodes, "node", "left_semi").groupBy("node").agg(F.min("source").alias("source")), "set-sources")
    shared = docs.sparkSession.sparkContext.broadcast(bits.filter_of_longs(sources, "source"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            batch = batch.filter(pa.array(bits.contains(shared.value, np.asarray(batch.column(0)).view(np.uint64))))
            for _, offsets, data in textual.slices(batch.column(1)):
                found = [s for s in map(np.unique, shingles(offsets, data, n)) if len(s)]
                names = [node_of(s) for s in found]
                wanted = [k for k, name in enumerate(names) if not (name in seen or seen.add(name))]
                if len(seen) > 1 << 18:
                    seen.clear()
                if wanted:
                    ends = np.append(0, np.cumsum([len(found[k]) for k in wanted])).astype(np.int32)
                    values = np.concatenate([found[k] for k in wanted]).view(np.int64)
                    yield pa.record_batch([pa.array([names[k] for k in wanted], pa.int64()), pa.ListArray.from_arrays(ends, values)], ["node", "shingles"])

    texts = docs.select(F.xxhash64(text).alias("source"), text)
    parts = texts.mapInArrow(run, StructType([StructField("node", LongType()), StructField("shingles", ArrayType(LongType(), False))]))
    found = materialize(parts.groupBy("node").agg(F.first("shingles").alias("shingles")), "shingle-sets")
    release(sources)
    return found


def similar(a: str, b: str, percent: int):
    """Whether two shingle arrays (of distinct values) reach the threshold."""
    both = F.size(F.array_intersect(a, b))
    return 100 * both >= percent * (F.size(a) + F.size(b) - both)


def connected(links: DataFrame) -> DataFrame:
    """``node, comp``: the smallest node that can be reached from every node of ``links`` (``a, b``).

    Smallest labels spread over the links and along themselves, which doubles the distance covered in every round;
    every round is written to the shared folder.
    """
    edges = materialize(links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = materialize(edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("comp")), "labels")
    while True:
        near = edges.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("near"))
        spread = labels.join(near, "node").select("node", F.col("comp").alias("old"), F.least("comp", "near").alias("comp"))
        jump = labels.select(F.col("node").alias("comp"), F.col("comp").alias("further"))
        new = materialize(spread.join(jump, "comp", "left").select("node", "old", F.least("comp", "further").alias("comp")), "labels")
        release(labels)
        labels = new.select("node", "comp")
        if new.where(F.col("old") != F.col("comp")).isEmpty():
            release(edges)
            return labels


def meetings(nodes: DataFrame) -> DataFrame:
    """``k, least, node, n, fame``: the bands of minimum hashes that several nodes have, and how often a node's are shared."""
    keys = materialize(nodes.select("node", "n", F.posexplode("mins").alias("k", "least")).groupBy("k", "least", "node").agg(F.first("n").alias("n")), "minimum-hashes")
    shared = materialize(keys.groupBy("k", "least").agg(F.count(F.lit(1)).alias("m")).where("m > 1"), "shared-hashes")
    met = materialize(keys.join(shared, ["k", "least"]), "met-hashes")
    fame = met.groupBy("node").agg(F.sum("m").alias("fame"))
    famed = materialize(met.join(fame, "node").select("k", "least", "node", "n", "fame"), "famed-hashes")
    release(keys, shared, met)
    return famed


def star_components(docs: DataFrame, text: str, nodes: DataFrame, n: int, percent: int, rounds: int = ROUNDS, aside: dict | None = None) -> DataFrame:
    """``node, comp``: components of the links between nodes and the leader of those that share a band of minimum hashes.

    The leader is the node whose bands are shared most, so the text that copies derive from rather than a
    copy; ties go to the smaller node.  What a leader's component does not reach is led by another node in the next
    round.  Links that the rounds leave are found by the matrix.  ``aside`` receives what the families are made of:
    the ``sets`` of all nodes that share a band, and ``met`` (``a, b, both, total, linked``), the leaders they resemble.
    """
    left = meetings(nodes).withColumn("comp", F.col("node"))
    sets = sets_of(docs, text, nodes, left.select("node"), n)
    met = comps = None
    for _ in range(rounds):
        first = left.groupBy("k", "least").agg(F.max(F.struct("fame", -F.col("node"), "node", "n", "comp")).alias("b"))
        first = materialize(first.select("k", "least", F.col("b.node").alias("b"), F.col("b.n").alias("bn"), F.col("b.comp").alias("bc")), "leaders")
        led = left.join(first, ["k", "least"]).where(F.col("comp") != F.col("bc"))
        pairs = materialize(led.where(fitting("n", "bn", percent)).select(F.col("node").alias("a"), "b").distinct(), "star-pairs")
        found = materialize(resembling(pairs, sets, min(NEAR, percent)).withColumn("linked", enough("both", "total", percent)), "star-links")
        met = found if met is None else met.unionAll(found)
        if comps is not None:
            release(comps)
        comps = connected(met.where("linked"))
        ends = comps.select(F.col("node").alias("b"), F.col("comp").alias("bd"))
        rest = led.drop("comp").join(comps, "node", "left").join(ends, "b", "left").withColumn("comp", F.coalesce("comp", "node"))
        rest = materialize(rest.where(F.col("comp") != F.coalesce("bd", "b")).select("k", "least", "node", "n", "fame", "comp"), "unled-hashes")
        release(left, first, pairs)
        left = rest
        if left.isEmpty():
            break
    release(left)
    if aside is None:
        release(met, sets)
    else:
        aside.update(met=met, sets=sets)
    return comps


def families(met: DataFrame, comps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``node, comp`` of the components and of the lone nodes that resemble a leader, under the name of the leader's
    component or of the leader; and ``comp, pivot``, for every family the leader that most of its nodes resemble.

    Any division of the nodes will do: links within a family are found by ``family_links``, others by the matrix.
    """
    lone = met.where(~F.col("linked")).join(comps.select(F.col("node").alias("a")), "a", "left_anti")
    lone = lone.join(comps.select(F.col("node").alias("b"), "comp"), "b", "left")
    best = F.max(F.struct(F.col("comp").isNotNull(), F.col("both") / F.col("total"), "b", "comp")).alias("best")
    led = materialize(lone.groupBy(F.col("a").alias("node")).agg(best).select("node", F.col("best.b").alias("b"), F.coalesce("best.comp", "best.b").alias("comp")), "led-nodes")
    # A leader shares its bands more often than those it leads, so there are no circles.
    for _ in range(JUMPS):
        further = led.select(F.col("node").alias("comp"), F.col("comp").alias("further"))
        moved = materialize(led.join(further, "comp", "left").select("node", "b", F.coalesce("further", "comp").alias("comp")), "led-nodes")
        release(led)
        led = moved
    pivots = led.groupBy("comp", "b").agg(F.count(F.lit(1)).alias("led")).groupBy("comp").agg(F.max(F.struct("led", "b")).alias("most"))
    pivots = materialize(pivots.select("comp", F.col("most.b").alias("pivot")), "pivots")
    named = pivots.select(F.col("comp").alias("node"), "comp").join(comps, "node", "left_anti").join(led, "node", "left_anti")
    members = materialize(comps.select("node", "comp").unionAll(led.select("node", "comp")).unionAll(named), "families")
    release(led)
    return members, pivots


def differences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``node, comp, pivot, n, base, added, delta`` of ``node, comp, pivot, shingles, base``: the set's differences from the
    pivot's set, first the ``added`` shingles, then those it lacks; each is hashed with the pivot."""
    for batch in batches:
        salts = textual.mix(np.asarray(batch.column(2)).view(np.uint64) ^ SALT)
        (sets, ends), (bases, starts) = ((np.asarray(batch.column(k).flatten()).view(np.uint64), np.asarray(batch.column(k).offsets)) for k in (3, 4))
        ends, starts = ends - ends[0], starts - starts[0]
        deltas, added = [np.zeros(0, dtype=np.uint64)], []
        for k in range(batch.num_rows):
            own, base = sets[ends[k] : ends[k + 1]], bases[starts[k] : starts[k + 1]]
            more = np.setdiff1d(own, base, assume_unique=True)
            added.append(len(more))
            deltas.append(textual.mix(np.concatenate([more, ~np.setdiff1d(base, own, assume_unique=True)]) ^ salts[k]))
        lists = pa.ListArray.from_arrays(np.cumsum([len(x) for x in deltas]).astype(np.int32), np.concatenate(deltas).view(np.int64))
        sizes = (pa.array(x, pa.int32()) for x in (np.diff(ends), np.diff(starts), added))
        yield pa.record_batch([*(batch.column(k) for k in range(3)), *sizes, lists], ["node", "comp", "pivot", "n", "base", "added", "delta"])


def difference_counts(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """A filter of the differences that several nodes have, and for sketch cells how often theirs occur, ``STEPS`` classes a doubling."""
    total = rows.agg(F.sum(F.size("delta"))).first()[0] or 0
    size, cells = bits.bits_for(total, 1 << 16, 1 << 29, 4), bits.bits_for(total, LEAST_CELLS, MOST_CELLS, 1)
    shift = np.uint64(64 - cells.bit_length() + 1)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(cells, dtype=np.uint32)
        for batch in batches:
            np.add.at(seen, (np.asarray(batch.column(0).flatten()).view(np.uint64) >> shift).astype(np.int64), np.uint32(1))
        yield from bits.blocks(seen)

    tokens_of = lambda b: iter([np.asarray(b.column(0).flatten()).view(np.uint64)])
    deltas = rows.select("delta")
    twice = bits.gather_filter(deltas.mapInArrow(bits.filters(tokens_of, size), bits.SCHEMA), size, twice=True)
    counts = bits.gather_counts(deltas.mapInArrow(count, bits.SCHEMA), cells)
    return twice, (STEPS * np.log2(np.maximum(counts, 1))).astype(np.uint8)


def met_at(twice: np.ndarray, kinds: np.ndarray, added: int, n: int, base: int, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int, int]:
    """(the differences that a link can use, rare ones first; how many added and lacking ones there are from each of them on;
    how many of them a link with any partner meets at, and with a partner in the pivot's star) of a node.

    ``twice`` marks those that other nodes of the family may share; see ``family_links`` for the least that a link shares.
    """
    d, up, down = len(twice), 100 + percent, 100 - percent
    used = np.flatnonzero(twice)
    used = used[np.argsort(kinds[used], kind="stable")]
    more = np.cumsum((used < added)[::-1])[::-1]
    every = max(0, len(used) - (up * d + down * (base - n)) // (2 * up))
    over = up * d - down * (n + base)
    return used, more, len(used) - np.arange(len(used)) - more, every, max(every, len(used) + over // -200 + 1) if over > 0 else every


def family_links(members: DataFrame, pivots: DataFrame, comps: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``a, b``: components that a link between two nodes of one family joins.

    Sets x, y of n and m shingles link if they differ in at most c (n + m) of them, c = (100 - percent) / (100 + percent).  With
    the differences D, E from a pivot of p shingles they differ in |D| + |E| - 2 |D and E|.  If x does not link with the pivot,
    e = |D| - c (n + p) > 0, so a link shares more than (|E| + c (p - m)) / 2 of E, and at least e / (1 + c) of D, since
    m <= p + |E|: near copies meet where they have an edit in common, not where they have their text in common.  Only
    differences that several nodes have count.  Under one order of a family's differences, rare ones first, a link shares one of
    the first of each: ``short`` marks those that do for every partner, a node ``outside`` the pivot's star has more of them.
    """
    sizes = members.join(pivots, "comp").groupBy("comp", "pivot").agg(F.ceil(F.count(F.lit(1)) / DEALT).alias("parts"))
    base = sizes.join(sets.select(F.col("node").alias("pivot"), F.col("shingles").alias("base")), "pivot")
    base = base.select("pivot", "base", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    rows = members.join(sizes, "comp").select("node", "pivot", F.pmod(F.xxhash64("node"), F.col("parts")).alias("part"))
    rows = rows.join(comps, "node", "left").join(sets, "node").join(base, ["pivot", "part"])
    rows = rows.select("node", F.coalesce("comp", "node").alias("comp"), "pivot", "shingles", "base")
    schema = "node long, comp long, pivot long, n int, base int, added int, delta array<long>"
    rows = materialize(rows.mapInArrow(differences, schema), "differences")
    shared = rows.sparkSession.sparkContext.broadcast(difference_counts(rows))

    def postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filled, classes = shared.value
        shift = np.uint64(64 - len(classes).bit_length() + 1)
        for batch in batches:
            tokens, ends = np.asarray(batch.column(5).flatten()), np.asarray(batch.column(5).offsets)
            ends = ends - ends[0]
            twice, kinds = bits.contains(filled, tokens.view(np.uint64)), classes[(tokens.view(np.uint64) >> shift).astype(np.int64)]
            n, bases, added = (np.asarray(batch.column(k)) for k in (2, 3, 4))
            row, kept, parts = [], [], [[], [], []]
            for k in range(batch.num_rows):
                part = slice(ends[k], ends[k + 1])
                used, more, less, every, count = met_at(twice[part], kinds[part], int(added[k]), int(n[k]), int(bases[k]), percent)
                row.append(np.full(count, k))
                kept.append(ends[k] + used[:count])
                for values, found in zip(parts, (more, less, np.arange(len(used)) < every), strict=True):
                    values.append(found[:count])
            if row:
                at = np.concatenate(row)
                more, less, short = map(np.concatenate, parts)
                d = np.diff(ends)[at]
                outside = (100 + percent) * d.astype(np.int64) > (100 - percent) * (n[at].astype(np.int64) + bases[at])
                ints = (pa.array(x, pa.int32()) for x in (n[at], d, more, less))
                yield pa.record_batch([pa.array(tokens[np.concatenate(kept)]), *(batch.column(k).take(pa.array(at)) for k in (0, 1)), *ints, pa.array(outside), pa.array(short.astype(bool))], names)

    names = ["token", "node", "comp", "n", "size", "more", "less", "outside", "short"]
    posted = rows.select("node", "comp", "n", "base", "added", "delta").mapInArrow(postings, "token long, node long, comp long, n int, size int, more int, less int, outside boolean, short boolean")
    posted = materialize(posted, "family-postings")

    def side(rows: DataFrame, name: str) -> DataFrame:
        return rows.select("token", *(F.col(c).alias(f"{c}_{name}") for c in ("node", "comp", "n", "size", "more", "less")))

    both = F.least("more_a", "more_b") + F.least("less_a", "less_b")
    near = 2 * (100 + percent) * both.cast("long") >= (100 + percent) * (F.col("size_a") + F.col("size_b")) - (100 - percent) * (F.col("n_a") + F.col("n_b"))
    wanted = (F.col("comp_a") != F.col("comp_b")) & fitting("n_a", "n_b", percent) & near
    far, others = posted.where("outside"), posted.where("short and not outside")
    pairs = side(far.where("short"), "a").join(side(far.where("short"), "b"), "token").where((F.col("node_a") > F.col("node_b")) & wanted)
    pairs = pairs.unionAll(side(far, "a").join(side(others, "b"), "token").where(wanted))
    pairs = materialize(pairs.select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).distinct(), "family-pairs")
    own = rows.where((100 + percent) * F.size("delta").cast("long") <= (100 - percent) * (F.col("n").cast("long") + F.col("base")))
    found = verified(pairs, sets, percent).unionAll(own.select(F.col("node").alias("a"), F.col("pivot").alias("b")))
    for end in ("a", "b"):
        named = comps.select(F.col("node").alias(end), F.col("comp").alias("_comp"))
        found = found.join(named, end, "left").withColumn(end, F.coalesce("_comp", end)).drop("_comp")
    found = materialize(found.where("a <> b").select("a", "b").distinct(), "family-links")
    release(rows, posted, pairs)
    return found


def fitting(a: str, b: str, percent: int):
    return (F.col(a) * 100 >= F.col(b) * percent) & (F.col(b) * 100 >= F.col(a) * percent)


def enough(both: str, total: str, percent: int):
    return 100 * F.col(both) >= percent * F.col(total)


def resembling(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``a, b, both, total``: the pairs with a Jaccard of at least ``percent`` %, the sizes of intersection and union."""
    a, b = (sets.select(F.col("node").alias(c), F.col("shingles").alias(f"_{c}")) for c in ("a", "b"))
    sized = computed(pairs.join(a, "a").join(b, "b"), {"both": F.size(F.array_intersect("_a", "_b")), "total": F.size("_a") + F.size("_b")})
    return sized.select("a", "b", "both", (F.col("total") - F.col("both")).alias("total")).where(enough("both", "total", percent))


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    return resembling(pairs, sets, percent).select("a", "b")


def placed(twice: np.ndarray, ends: np.ndarray, n: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, shingles before it that other prefixes may hold, shingles of the set from it on) of the entries that a link can use.

    ``twice`` marks the shingles of the rows' prefixes that other prefixes may hold, ``ends`` bounds the rows.  At an entry
    that a linked set shares, all shingles before it that both sets hold are in both prefixes, so those that are in no
    other prefix are lost to the overlap; an entry behind too many of them is of no use.
    """
    row, place = np.repeat(np.arange(len(n)), np.diff(ends)), np.arange(len(twice)) - np.repeat(ends[:-1] - ends[0], np.diff(ends))
    total = np.append(0, np.cumsum(twice))
    before = total[:-1] - total[ends[:-1] - ends[0]][row]
    keep = np.flatnonzero(twice & ((place - before) * 100 <= n[row] * (100 - percent)))
    return keep, before[keep], (n[row] - place)[keep]


def matrix_links(docs: DataFrame, text: str, rows: DataFrame, members: DataFrame, comps: DataFrame, n: int, percent: int) -> DataFrame:
    """``a, b``: components that a link between nodes of two families joins, found by the token-group matrix; a component
    that is in no family is one of its own.  In here ``comp`` is the name of a family, until sets are compared."""
    frequent = bits.bits_for(rows.agg(F.sum(F.size("prefix"))).first()[0] or 0, 1 << 16, 1 << 29, 4)
    tokens_of = lambda b: iter([textual.mix(np.asarray(b.column(0).flatten()).view(np.uint64))])
    twice = bits.gather_filter(rows.select("prefix").mapInArrow(bits.filters(tokens_of, frequent), bits.SCHEMA), frequent, twice=True)
    shared = docs.sparkSession.sparkContext.broadcast(twice)

    def postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            tokens, ends = np.asarray(lists.flatten()), np.asarray(lists.offsets)
            row = np.repeat(np.arange(batch.num_rows), np.diff(ends))
            keep, before, rest = placed(bits.contains(shared.value, textual.mix(tokens.view(np.uint64))), ends, np.asarray(batch.column(1)).astype(np.int64), percent)
            at = pa.array(row[keep])
            yield pa.record_batch([pa.array(tokens[keep]), batch.column(0).take(at), batch.column(1).take(at), pa.array(before, pa.int32()), pa.array(rest, pa.int32())], ["token", "node", "n", "before", "rest"])

    sizes = members.groupBy("comp").agg(F.count(F.lit(1)).alias("members"))
    part = F.pmod(F.xxhash64("node"), F.ceil(F.col("members") / GROUP))
    grouped = materialize(members.join(sizes, "comp").select("node", "comp", F.xxhash64("comp", part).alias("grp"), (F.col("members") > GROUP).alias("parted")), "groups")
    posted = rows.select("node", "n", "prefix").mapInArrow(postings, "token long, node long, n int, before int, rest int").join(grouped.drop("parted"), "node", "left")
    # Dealt by token once: distinct rows and the tokens of several components need no further exchange.
    by_token = Window.partitionBy("token")
    distinct = posted.repartition(F.col("token")).groupBy("token", "node").agg(*(F.first(c).alias(c) for c in ("n", "before", "rest", "comp", "grp")))
    comp = F.coalesce("comp", "node")
    mixed = distinct.withColumn("c", F.min(comp).over(by_token)).withColumn("d", F.max(comp).over(by_token)).where("c <> d").drop("c", "d")
    # Nodes of no component are groups of their own and are stored without the two names.
    posted = materialize(mixed, "postings").select("token", "node", "n", "before", "rest", comp.alias("comp"), F.coalesce("grp", _only_group("node")).alias("grp"))
    query = posted.select("token", "node", "n", "before", "rest", F.col("comp").alias("a"))
    # The matrix' columns: for a token the components with it, then, for the queries that meet one of several groups, its groups.
    whole = _candidates(query, _cells(posted, "comp"), ["token"], ["node", "n", "a", "b"], percent)
    whole = materialize(whole, "component-candidates")
    parted = grouped.where("parted").select(F.col("comp").alias("b")).distinct()
    narrow = materialize(query.join(whole.join(parted, "b", "left_semi").select("node", "b"), "node"), "narrowed-queries")
    cells = _cells(posted.join(parted.withColumnRenamed("b", "comp"), "comp", "left_semi"), "comp", "grp")
    several = _candidates(narrow, cells, ["token", "b"], ["node", "n", "a", "b", "grp"], percent)
    single = whole.join(parted, "b", "left_anti").withColumn("grp", _only_group("b"))
    candidates = materialize(single.unionByName(several), "candidates")
    lone = posted.select("node", "grp").distinct()
    opened = materialize(candidates.select("grp").distinct().join(lone.unionAll(grouped.select("node", "grp")).distinct(), "grp"), "members")
    sets = sets_of(docs, text, rows, opened.select("node").unionAll(candidates.select("node")), n)
    release(narrow, whole)
    whose = sets.join(comps, "node", "left").select("node", "shingles", F.coalesce("comp", "node").alias("comp"))
    matrix = opened.join(whose, "node").groupBy("grp").agg(F.array_distinct(F.flatten(F.collect_list("shingles"))).alias("union"), F.collect_list(F.struct("comp", "shingles")).alias("sets"))
    matrix = materialize(matrix, "token-groups")
    wide = candidates.select("node", "grp").join(whose, "node").join(matrix, "grp")
    wide = wide.where(reachable("shingles", "union", "sets.shingles", percent)).select(F.col("comp").alias("a"), "shingles", F.explode("sets").alias("other"))
    links = wide.where((F.col("a") != F.col("other.comp")) & similar("shingles", "other.shingles", percent)).select("a", F.col("other.comp").alias("b"))
    links = materialize(links.distinct(), "component-links")
    release(posted, grouped, candidates, opened, sets, matrix)
    return links


def reachable(query: str, union: str, sets: str, percent: int):
    """Whether the overlap with a group's union reaches what a link with its smallest set needs, or with the smallest that fits the query."""
    n, least = F.size(query), F.array_min(F.transform(sets, F.size))
    return (100 + percent) * F.size(F.array_intersect(query, union)).cast("long") >= percent * (n + F.greatest(least, F.ceil(n * percent / 100)))


def _only_group(comp: str):
    """The group of a component that needs no second one."""
    return F.xxhash64(comp, F.lit(0).cast("long"))


def _cells(posted: DataFrame, *by: str) -> DataFrame:
    """For a token the groups whose prefixes hold it, the range of their sizes and the most there is before and from it on."""
    cells = posted.groupBy("token", *by).agg(F.min("n").alias("low"), F.max("n").alias("high"), F.max("before").alias("most_before"), F.max("rest").alias("most_rest"))
    return cells.withColumnRenamed("comp", "b")


def _shared_enough(percent: int):
    """Whether a query of ``n`` shingles shares as many of its prefix with a group as with a linked set of ``low`` to ``high``.

    Of a set's n shingles n - overlap are in one set only, so of a prefix at least its length less those are shared,
    counted from the shorter remainder: the query's is shortest for the least partner, the partner's for the largest.
    """
    t = percent / 100
    least = F.ceil(F.col("n") * percent / 100)
    low, high = F.greatest("low", least), F.least("high", F.floor(F.col("n") * 100 / percent))
    spare = F.floor((F.col("n") - least) / SPARE) + 1
    by_query = (F.col("shared") + least - spare) * (100 + percent) >= percent * (F.col("n") + low)
    # Without rounding, and with a little room for the arithmetic.
    by_partner = F.col("shared") + 1.001 > t * (F.col("n") + high) / (1 + t) - t * high + (1 - t) * high / SPARE
    return by_query | by_partner


def _candidates(query: DataFrame, cells: DataFrame, on: list[str], by: list[str], percent: int) -> DataFrame:
    """Queries and groups that share as many prefix shingles as linked sets must, the smaller of which has at least
    ``percent`` % of the query's size and the group's least one; a shared shingle counts if the overlap can be enough there."""
    sizes = (F.col("high") * 100 >= F.col("n") * percent) & (F.col("n") * 100 >= F.col("low") * percent)
    overlap = (F.least("before", "most_before") + F.least("rest", "most_rest")).cast("long")
    enough = (100 + percent) * overlap >= percent * (F.col("n") + F.greatest("low", F.ceil(F.col("n") * percent / 100)))
    return (
        query.join(cells, on).where((F.col("a") > F.col("b")) & sizes & enough)
        .groupBy(*by).agg(F.count(F.lit(1)).alias("shared"), F.min("low").alias("low"), F.max("high").alias("high"))
        .where(_shared_enough(percent)).drop("shared", "low", "high")
    )


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row: the smallest id reachable by links, itself included.

    Words are runs without white space, A-Z lower-cased; a set holds the distinct ``n``-word shingles of the whole
    text, or the whole sequence of fewer words.  Rows link when the intersection is at least ``percent`` % of the
    union.  Null, empty and blank texts have an empty set and link with nothing; rows that repeat an id are rows of
    their own; null ids are ignored when the smallest id is chosen, unless a component has no other.
    Shingles and sets are told apart by 64-bit hashes.
    """
    rows = features(docs, doc_id, text, n, percent)
    full = rows.where("n > 0")
    aside: dict[str, DataFrame] = {}
    comps = star_components(docs, text, full, n, percent, ROUNDS, aside)
    members, links = comps, None
    if aside:
        members, pivots = families(aside["met"], comps)
        links = family_links(members, pivots, comps, aside["sets"], percent)
        release(pivots, *aside.values())
    found = matrix_links(docs, text, full, members, comps, n, percent)
    merged = connected(found if links is None else found.unionAll(links))
    named = full.groupBy("node").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies"))
    named = named.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    named = named.join(merged.select(F.col("node").alias("comp"), F.col("comp").alias("whole")), "comp", "left").withColumn("comp", F.coalesce("whole", "comp"))
    named = materialize(named.select("node", "comp", "least", "copies"), "nodes")
    # Rows that are alone keep their own id and need no entry.
    small = named.groupBy("comp").agg(F.min("least").alias("component_id"), F.sum("copies").alias("rows")).where(F.col("rows") > 1)
    small = materialize(named.join(materialize(small, "components"), "comp").select("node", "component_id"), "node-components")
    out = rows.select("doc_id", F.when(F.col("n") > 0, F.col("node")).alias("node"), F.col("n").cast("long").alias("n_shingles"))
    return _looked_up(out, small).select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def _looked_up(rows: DataFrame, entries: DataFrame) -> DataFrame:
    """Left join on ``node``; rows without a node don't take part, so they don't meet in one partition."""
    some = rows.where(F.col("node").isNotNull()).join(entries, "node", "left")
    none = rows.where(F.col("node").isNull()).withColumn("component_id", F.lit(None).cast(entries.schema["component_id"].dataType))
    return some.unionByName(none)


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The documents without near copies: of every component the smallest id stays (and rows that repeat it).

    Rows without an id can't be told apart and stay.
    """
    found = near_duplicates(docs, doc_id, text, n, percent).where(F.col("doc_id") != F.col("component_id"))
    drop = materialize(found.select(F.col("doc_id").alias("_id")).distinct(), "near-copies")
    return docs.join(drop, F.col(doc_id) == F.col("_id"), "left_anti")
