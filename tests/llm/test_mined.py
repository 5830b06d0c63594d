"""Certified quality rules, hard negatives and phrases against brute force, on awkward tables."""

from __future__ import annotations

import collections
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from pubwatch.llm import hard_negatives, phrases, quality

DOCS = "doc_id long, text string, lang string, level string, n_words int, _s int"
SPACE = r"[\x20\x09-\x0D]+"


def statistics(t: str | None) -> tuple:
    t = t or ""
    words = [w for w in re.split(SPACE, t) if w]
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    where = collections.defaultdict(list)
    for i in range(len(words) - 7):
        where[tuple(words[i : i + 8])].append(i)
    covered = {j for at in where.values() if len(at) > 1 for i in at for j in range(i, i + 8)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), len(lines), len(lines) - len(set(lines)), len(covered)


@pytest.fixture(scope="module")
def texts():
    r = random.Random(4)
    word = lambda: "".join(r.choices("abcdeéß", k=r.randint(1, 9)))
    plain = [" ".join(word() for _ in range(n)) for n in (1, 7, 8, 9, 25, 400, 20_000)]
    eight = " ".join(word() for _ in range(8))
    return [
        None, "", " \n\t\x0b\x0c\r", "f f f f", "\x0cfar of f\x0c", *plain, eight, f"{eight} {eight}", f"{eight} x {eight} y {eight[:-1]}", " ".join(["a"] * 60),
        f"{plain[4]} {plain[4]}", "one\ntwo\none\n\n \none", "# $%&|<>*\n## ##", "nul bsp   x", f"{plain[5]}\n{plain[5]}\n{plain[4]}",
    ]


def test_statistics_by_hand(spark, texts):
    rows = [(k, t, None, "x", 5, 6) for k, t in enumerate(texts)]
    found = quality.with_statistics(spark.createDataFrame(rows, DOCS))
    assert found.columns == ["doc_id", "text", "lang", "level", *quality.STATISTICS]
    for row in found.collect():
        assert tuple(row[c] for c in quality.STATISTICS) == statistics(row["text"]), repr(row["text"])[:80]


def test_binomial_tail_is_exact(spark):
    cases = [(0, 0), (1, 0), (50, 0), (50, 3), (400, 8), (400, 400), (5000, 60), (100_000, 1900), (3_000_000_000, 59_900_000), (3_000_000_000, 1000)]
    df = spark.createDataFrame(cases, "n long, k long").select("n", "k", quality.binomial_tail(F.col("n"), F.col("k"), 0.02).alias("p"))
    for n, k, p in df.collect():
        if n <= 100_000:
            want = sum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(0.02) + (n - i) * math.log(0.98)) for i in range(min(k, n) + 1))
            assert p == pytest.approx(min(want, 1), rel=1e-7, abs=1e-12)
        else:
            z = (k + 0.5 - n * 0.02) / math.sqrt(n * 0.02 * 0.98)
            assert p == pytest.approx(0.5 * math.erfc(-z / math.sqrt(2)), rel=0.05, abs=1e-12)


def test_cutoffs_are_certified_per_stratum(spark):
    r = random.Random(8)
    word = lambda: "".join(r.choices("abcdefgh", k=5))
    rows, labels = [], []
    for k in range(900):
        lang = ("en", "de", None)[k % 3] if k < 840 else "fr"
        body = " ".join(word() for _ in range(30))
        symbols = "#" * 3 if lang == "de" and k % 2 else ""  # half of the good German texts have a tenth of a symbol a word
        rows.append((k, f"{body} {symbols}", lang, "", 0, 0))
        labels.append((k, 1))
    rows += [(1000 + k, " ".join(word() + "#" for _ in range(30)), lang, "", 0, 0) for k, lang in enumerate(("en", "de", None, "fr", "es"))]
    labels += [(1001, 0), (None, 1), (5, None), (7777, 1), (8, 1), (8, 1)]
    found = quality.judge_quality(spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int"))
    cutoffs = {(x["stratum"], x["cutoff_level"]) for x in found.select("stratum", "cutoff_level").distinct().collect()}
    # 280 good texts are enough for a chain of three strata, 60 are not; 3 symbols in 31 words pass the cutoff of 100 in
    # a thousand (level 4) and not that of 50, so the German chain ends at level 4.
    assert cutoffs == {("en", 7), ("de", 4), ("und", 7), ("fr", None), ("es", None)}
    out = {x["doc_id"]: x["kept"] for x in found.where("doc_id >= 1000").collect()}
    assert out == {1000: False, 1001: False, 1002: False, 1003: True, 1004: True}
    assert found.where("doc_id < 900 and not kept").count() == 0
    none = quality.judge_quality(spark.createDataFrame(rows, DOCS).limit(0), spark.createDataFrame([], "doc_id long, quality int"))
    assert none.count() == 0
    unlabelled = quality.judge_quality(spark.createDataFrame(rows, DOCS), spark.createDataFrame([], "doc_id long, quality int"))
    assert unlabelled.where("not kept").count() == 0 and unlabelled.count() == len(rows)


def brute_negatives(rows: list[tuple], step: int) -> list[tuple]:
    held = [(i, lab, [math.floor(256 * x) for x in v]) for i, lab, v in rows if None not in (i, lab, v) and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, label, v in held:
        if a % step:
            continue
        scored = [(sum(x * y for x, y in zip(v, w, strict=True)), i, lab) for i, lab, w in held if i != a and len(w) == len(v)]
        for p, pi in sorted(((s, i) for s, i, lab in scored if lab == label), key=lambda x: (-x[0], x[1]))[:5]:
            fits = sorted(((s, i) for s, i, lab in scored if lab != label and 50 * p <= 100 * s <= 95 * p), key=lambda x: (-x[0], x[1]))[:3]
            out += [(a, pi, k + 1, i, p, s) for k, (s, i) in enumerate(fits)]
    return sorted(out)


def test_hard_negatives_against_brute_force(spark):
    r = np.random.default_rng(3)
    rows = [(int(k), int(k % 4), (r.standard_normal(9) + (k % 5)).tolist()) for k in range(400)]
    rows += [(500 + k, k % 3, [1.0] * 9) for k in range(120)]  # equal vectors: ties
    rows += [(k, 1, r.standard_normal(4).tolist()) for k in (700, 701, 702, 710)] + [(711, 2, [0.0, 0.0, 0.0, 0.0]), (720, 1, []), (721, 2, []), (730, 5, [0.5]), (731, 6, [0.4])]
    rows += [(800, None, [1.0] * 9), (810, 1, None), (820, 1, [1.0, None] + [1.0] * 7), (830, 1, [float("nan")] * 9), (None, 1, [1.0] * 9), (840, 2, [-3.0] * 9)]
    df = spark.createDataFrame([(*x, 0, "x") for x in rows], "vec_id long, label int, embedding array<double>, dims int, cell string").repartition(5)
    index, books = hard_negatives.build_index(df, words=6)
    for block in (4096, 9):
        found = hard_negatives.mine(index, books, index.where("vec_id % 10 = 0"), words=6, block=block)
        assert sorted(tuple(x) for x in found.collect()) == brute_negatives(rows, 10)
    index, books = hard_negatives.build_index(df.limit(0))
    assert hard_negatives.mine(index, books, index).count() == 0


def test_hard_negatives_of_large_numbers(spark):
    # The largest product, of 20 * 2**27 with itself, is just below 2**63.
    big = [(k, k % 2, [float((k + 1) << 19), 3.0 * k, float(7 << 18)]) for k in range(20)]
    df = spark.createDataFrame(big, "vec_id long, label int, embedding array<double>")
    index, books = hard_negatives.build_index(df)
    assert sorted(tuple(x) for x in hard_negatives.mine(index, books, index).collect()) == brute_negatives(big, 1)
    index, books = hard_negatives.build_index(spark.createDataFrame([(0, 1, [1e18]), (1, 1, [1e18])], "vec_id long, label int, embedding array<double>"))
    with pytest.raises(Exception, match="64 bits"):
        hard_negatives.mine(index, books, index).collect()


def test_cells_come_by_falling_bound():
    r = np.random.default_rng(1)
    a, b = -np.sort(-r.standard_normal(9)), -np.sort(-r.standard_normal(7))
    seen = list(hard_negatives.cells_by_bound(a, b))
    assert len({x[1:] for x in seen}) == 63 and [x[0] for x in seen] == sorted((x[0] for x in seen), reverse=True)


def brute_phrases(rows: list[tuple], least: int, top: int) -> list[tuple]:
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    f = collections.defaultdict(collections.Counter)
    n = collections.Counter()
    for t, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (t or "").translate(low)):
            words = [w for w in re.split(r"[\x20\x09]+", piece) if w]
            n[lang or "und"] += len(words)
            for size in (1, 2, 3):
                for i in range(len(words) - size + 1):
                    f[lang or "und"][tuple(words[i : i + size])] += 1
    out = []
    for lang, of in f.items():
        candidates = {p: a for p, a in of.items() if len(p) > 1 and a >= least}
        scored = []
        for p, a in candidates.items():
            if any(len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) and 100 * b >= 50 * a for q, b in candidates.items()):
                continue
            score, _, left, right = min((10**6 * a * a // (of[p[:k]] * of[p[k:]]), k, of[p[:k]], of[p[k:]]) for k in range(1, len(p)))
            scored.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, p, left, right) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


@pytest.fixture(scope="module")
def spoken():
    r = random.Random(11)
    vocabulary = [f"w{k}" for k in range(30)] + ["Été", "ça", "ß", "'"]
    out = []
    for k in range(60):
        words = r.choices(vocabulary, weights=[1 / (i + 1) for i in range(len(vocabulary))], k=80)
        out.append(("".join(w + r.choice((" ", " ", " ", "  \t", ", ", ".\n", "\x0b")) for w in words), ("en", "fr", None)[k % 3]))
    out += [(None, "en"), ("", None), (" \t\n.,;", "de"), ("one", "de"), ("New York city " * 40, "en"), ("NEW york. city", "en"), ("a a a a a a a a a a a a a", "x")]
    return out + out[:7]


def test_phrases_against_brute_force(spark, spoken):
    df = spark.createDataFrame([(t, lang, 1, "z") for t, lang in spoken], "text string, lang string, n int, phrase string").repartition(4)
    for least, top, burst, entries in ((10, 2000, 1 << 14, 1 << 20), (4, 7, 4, 64)):
        found = phrases.mine_phrases(df, least=least, top=top, burst=burst, entries=entries)
        assert sorted(tuple(x) for x in found.collect()) == brute_phrases(spoken, least, top)
    assert phrases.mine_phrases(df.limit(0)).count() == 0
    assert phrases.mine_phrases(df.where("lang = 'de'")).count() == 0


def test_trie_bursts_and_spills():
    r = np.random.default_rng(5)
    trie, want, out = phrases.PhraseTrie(20, burst=8), collections.Counter(), collections.Counter()
    for k in range(60):
        keys, counts = np.unique(r.integers(0, 1 << (20 if k % 2 else 6), 50).astype(np.uint64), return_counts=True)
        want.update(dict(zip(keys.tolist(), counts.tolist(), strict=True)))
        trie.add(keys, counts)
        if len(trie) > 300:
            for run in trie.spill(100):
                assert (np.diff(run[0].astype(np.int64)) > 0).all()
                out.update(dict(zip(*(x.tolist() for x in run), strict=True)))
            assert len(trie) <= 300
    assert len(trie.leaves) > 16 and trie.lows == sorted(trie.lows)
    for run in trie.spill(0):
        out.update(dict(zip(*(x.tolist() for x in run), strict=True)))
    assert out == want and len(trie) == 0


def test_scores_pass_64_bits(spark):
    a, left, right = 9 * 10**14, 9 * 10**14, 91 * 10**13
    row = spark.createDataFrame([(a, left, right)], "a long, l long, r long").select(phrases.exact_score("a", "l", "r")).first()
    assert row[0] == 10**6 * a * a // (left * right)
