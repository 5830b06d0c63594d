"""Near copies that no star takes in: met by the edits they have in common, and no link goes with that."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest
from test_overlap_bounds import brute

from pubwatch.llm import jaccard


def edited(rng: random.Random, base: list[str], least: int, most: int) -> str:
    words = list(base)
    for at in rng.sample(range(0, len(base), 5), rng.randint(least, most)):
        words[at] = f"e{rng.randrange(12)}"
    return " ".join(words)


def test_near_copies_of_one_text_are_not_paired_with_each_other(spark, monkeypatch):
    """400 copies with 3 to 5 words replaced by one of twelve, which hardly ever reach the text they come from or one another."""
    rng, made = random.Random(3), {}
    base = [f"w{k}" for k in range(150)]
    texts = {k: edited(rng, base, 3, 5) for k in range(1, 401)} | {0: " ".join(base)}
    for k in range(401, 441):
        words = texts[k - 400].split()
        words[rng.randrange(1, 150, 5)] = f"e{rng.randrange(10**9)}"
        texts[k] = " ".join(words)
    write = jaccard.materialize

    def counted(df, label):
        out = write(df, label)
        made[label] = made.get(label, 0) + (out.count() if "pairs" in label or "candidates" in label else 0)
        return out

    monkeypatch.setattr(jaccard, "materialize", counted)
    got = {r.doc_id: r.component_id for r in jaccard.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)).collect()}
    assert got == brute(texts, 4, 85) and 100 < len(set(got.values())) < 420
    assert sum(made.values()) < 16 * len(texts), made


@pytest.mark.parametrize("percent", [60, 85, 100])
def test_links_of_a_family_meet_in_their_first_differences(percent):
    """All links of random sets, but those of two sets that link with the pivot, share one of the first differences of both."""
    rng, linked = np.random.default_rng(percent), 0
    for size in (3, 8, 40):
        base = np.arange(size, dtype=np.uint64) * np.uint64(977)
        others = rng.integers(1 << 40, 1 << 63, 2 * size, dtype=np.uint64)
        sets = [base]
        for _ in range(60):
            start = sets[rng.integers(len(sets))]
            kept = rng.choice(start, rng.integers(len(start) // 2 + 1, len(start) + 1), replace=False)
            sets.append(np.unique(np.concatenate([kept, rng.choice(others, rng.integers(0, size // 2 + 1), replace=False)])))
        lists = (pa.array([x.view(np.int64) for x in part], pa.list_(pa.int64())) for part in (sets, [base] * len(sets)))
        names = [pa.array(x, pa.int64()) for x in (range(len(sets)), range(len(sets)), [0] * len(sets))]
        rows = next(jaccard.differences(iter([pa.record_batch([*names, *lists], ["node", "comp", "pivot", "shingles", "base"])]))).to_pylist()
        counts: dict[int, int] = {}
        for row in rows:
            for token in row["delta"]:
                counts[token] = counts.get(token, 0) + 1
        found = []
        for row in rows:
            delta = row["delta"]
            twice, kinds = np.array([counts[t] > 1 for t in delta], dtype=bool), np.array([counts[t] for t in delta], dtype=np.uint8)
            used, more, less, every, some = jaccard.met_at(twice, kinds, row["added"], row["n"], row["base"], percent)
            found.append({delta[u]: (k < every, k < some, more[k], less[k]) for k, u in enumerate(used)})
        star = [100 * len(np.intersect1d(s, base)) >= percent * len(np.union1d(s, base)) for s in sets]
        for a, x in enumerate(sets):
            for b, y in enumerate(sets):
                if star[a] or (b >= a and not star[b]) or 100 * len(np.intersect1d(x, y)) < percent * len(np.union1d(x, y)):
                    continue
                need = (len(rows[a]["delta"]) + len(rows[b]["delta"]) - (100 - percent) * (len(x) + len(y)) / (100 + percent)) / 2
                met = [t for t, (short, long, *_) in found[a].items() if (long if star[b] else short) and found[b].get(t, (False,))[0]]
                assert any(sum(map(min, found[a][t][2:], found[b][t][2:])) >= need - 1e-9 for t in met), (size, a, b)
                linked += 1
    assert linked > 20
