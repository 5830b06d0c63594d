"""What the near-duplicate join leaves out before it compares sets, and that no link goes with it."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pubwatch.llm import jaccard


def test_groups_whose_smallest_set_needs_more_stay_closed(spark):
    """88 of 100 shingles in the union: enough for a set of 85, not for groups whose sets have 100."""
    query = list(range(100))
    same = [[*range(88), *range(1000 + 20 * k, 1012 + 20 * k)] for k in range(3)]
    rows = [(query, sorted({x for s in sets for x in s}), sets) for sets in (same, [*same, query[:86]], [query])]
    df = spark.createDataFrame(rows, "q array<long>, u array<long>, s array<array<long>>")
    assert [r[0] for r in df.select(jaccard.reachable("q", "u", "s", 85)).collect()] == [False, True, True]


def test_entries_behind_too_many_lone_shingles_go():
    twice = np.array([0, 1, 0, 1, 0, 1, 1, 1, 1], dtype=bool)
    keep, before, rest = jaccard.placed(twice, np.array([7, 13, 13, 16]), np.array([10, 0, 10]), 80)
    # The first row's third lone shingle leaves 7 of 10 at most; the last row has none.
    assert (keep.tolist(), before.tolist(), rest.tolist()) == ([1, 3, 6, 7, 8], [0, 1, 0, 1, 2], [9, 7, 10, 9, 8])
    assert all(len(x) == 0 for x in jaccard.placed(twice[:0], np.array([0]), np.zeros(0, dtype=np.int64), 85))


def brute(texts: dict[int, str], n: int, percent: int) -> dict[int, int]:
    sets, comp = {}, {k: k for k in texts}
    for k, t in texts.items():
        w = t.split()
        sets[k] = {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()
    for a in texts:
        for b in texts:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]) and comp[a] != comp[b]:
                low, high = sorted((comp[a], comp[b]))
                comp = {k: low if c == high else c for k, c in comp.items()}
    return comp


@pytest.mark.parametrize(("rounds", "percent"), [(jaccard.ROUNDS, 85), (0, 85), (0, 80)])
def test_components_near_the_threshold(spark, monkeypatch, rounds, percent):
    """Near copies of a few texts, shared passages and lone words in every mixture; without stars the matrix finds all links."""
    if not rounds:
        monkeypatch.setattr(jaccard, "star_components", lambda docs, text, nodes, *_: nodes.select("node", F.col("node").alias("comp")).limit(0))
    rng = random.Random(7)
    word = lambda: f"w{rng.randrange(10**9)}"
    passages, bases = ([[word() for _ in range(rng.choice(sizes))] for _ in range(6)] for sizes in ((5, 9, 20), (30, 60, 120)))
    texts = {}
    for k in range(240):
        w = list(rng.choice(bases)) if k % 3 else sum(rng.sample(passages, rng.randint(1, 4)), [])
        for _ in range(rng.choice((0, 1, 1, 2, 3, 4, 6))):
            at = rng.randrange(len(w))
            w[at : at + 1] = rng.choice(([], [word()], [w[at], word()], w[at:] + w[:at] if k % 5 == 0 else [word()]))
            w = w or [word()]
        texts[k] = " ".join(w)
    got = jaccard.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3), n=3, percent=percent)
    want = brute(texts, 3, percent)
    assert {r.doc_id: r.component_id for r in got.collect()} == want and 20 < len(set(want.values())) < 230


@pytest.mark.parametrize("percent", [80, 85, 100])
def test_linked_sets_share_enough_of_their_prefixes(spark, percent):
    """The least that linked sets of two sizes can share passes; like sizes need more than the length of the spare part."""
    length = lambda n: n - jaccard.least_overlap(n, percent) + jaccard.shared_prefix(n, percent)
    rows = []
    for n in range(1, 160):
        for m in range(1, 160):
            both = -(-percent * (n + m) // (100 + percent))
            if both <= min(n, m):
                rows.append((n, m, m, min(length(n) - n + both, length(m) - m + both)))
    df = spark.createDataFrame(rows, "n int, low int, high int, shared int")
    assert all(r.shared >= 1 for r in df.collect()) and df.where(~jaccard._shared_enough(percent)).isEmpty()
    if percent == 85:
        assert df.where("n = 147 and low = 147").select(F.col("n"), F.col("low"), F.col("high"), (F.col("shared") - 3).alias("shared")).where(jaccard._shared_enough(percent)).isEmpty()
