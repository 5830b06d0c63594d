"""Quality rules whose cutoffs are certified on labelled holdouts: a limited share of good documents is rejected.

Every rule compares a statistic of the text with a cutoff.  The cutoffs form a ladder of levels, from lenient to
strict, fixed before any label is read, so all labelled rows are a holdout.  Within a stratum the levels are tested
in order: level j holds if the exact binomial tail P(Bin(n, limit) <= k) is at most risk / strata, where k of the n
good documents are rejected at it.  The first level that fails ends the stratum's chain (fixed-sequence testing
needs no correction along the chain; strata are corrected by Bonferroni).  So with probability 1 - risk at most
``limit`` of a stratum's good documents are rejected, in all strata at once, by all rules together.

Everything is a DataFrame or SQL function.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pubwatch.functions.base import bind, computed, sql_let
from pubwatch.session import materialize

#: The largest share of good documents that may be rejected, and the probability that a stratum exceeds it.
LIMIT, RISK = 0.02, 0.05
#: A repeated passage has this many words.
WINDOW = 8
UNKNOWN = "und"
#: Per rule, the comparison that rejects, with {c} for the cutoff, and the cutoffs from lenient to strict.
RULES = {
    "symbols": ("1000 * n_symbols > {c} * n_words", (1000, 500, 300, 200, 100, 50, 20, 10)),
    "repeated_lines": ("100 * n_dup_lines > {c} * n_lines", (60, 50, 45, 40, 35, 30, 25, 20)),
    "repeated_words": ("100 * n_repeat_words > {c} * n_words", (30, 28, 26, 24, 22, 20, 18, 15)),
    "long_words": ("100 * word_chars > {c} * n_words", (1200, 1000, 900, 800, 760, 720, 680, 650)),
    "short_words": ("100 * word_chars < {c} * n_words", (250, 275, 300, 325, 350, 375, 400, 420)),
}
LEVELS = 8
_SPACE = r"[\\x20\\x09-\\x0D]"
_SYMBOLS = "[#*$%&|<>]"
STATISTICS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def _repeated(w: str) -> str:
    """SQL text: how many of the words ``w`` lie in windows that occur twice or more.

    Only texts whose window hashes (64 bits) are not all distinct sort them.
    """
    again = "(j > 0 and s[j - 1].x = e.x) or (j + 1 < size(s) and s[j + 1].x = e.x)"
    places = f"sort_array(transform(filter(s, (e, j) -> {again}), e -> e.i))"
    covered = f"aggregate(p, named_struct('n', 0, 'last', -{WINDOW}), (a, i) -> named_struct('n', a.n + least({WINDOW}, i - a.last), 'last', i), a -> a.n)"
    marked = sql_let("sort_array(transform(h, (x, i) -> named_struct('x', x, 'i', i)))", "s", sql_let(places, "p", covered))
    # Elements by index: slice() copies the whole array for every window.
    each = ", ".join(f"v[i + {k}]" for k in range(WINDOW))
    hashes = sql_let(f"transform({w}, x -> xxhash64(x))", "v", f"transform(sequence(0, size(v) - {WINDOW}), i -> xxhash64({each}))")
    return f"if(size({w}) <= {WINDOW}, 0, {sql_let(hashes, 'h', f'if(size(array_distinct(h)) = size(h), 0, {marked})')})"


def _statistics() -> str:
    words = rf"if(b = '', cast(array() as array<string>), split(b, '{_SPACE}+'))"
    lines = rf"filter(split(t, '\\n', -1), x -> x rlike '[^\\x20\\x09-\\x0D]')"
    symbols = f"if(t rlike '{_SYMBOLS}', length(t) - length(regexp_replace(t, '{_SYMBOLS}', '')), 0)"
    row = (
        f"named_struct('n_words', bigint(size(w)), 'word_chars', bigint(length(regexp_replace(t, '{_SPACE}+', ''))), 'n_symbols', bigint({symbols}), "
        f"'n_lines', bigint(size(l)), 'n_dup_lines', bigint(size(l) - size(array_distinct(l))), 'n_repeat_words', bigint({_repeated('w')}))"
    )
    return sql_let(r"btrim(t, ' \t\n\u000B\u000C\r')", "b", sql_let(words, "w", sql_let(lines, "l", row)))


def with_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds the statistics of every text (null: none of anything); columns of the same names are replaced."""
    made = computed(docs.drop("_s"), {"_s": bind(F.coalesce(F.col(text), F.lit("")), _statistics(), "t")})
    return made.drop(*STATISTICS).select("*", *[F.col(f"_s.{c}").alias(c) for c in STATISTICS]).drop("_s")


def base_failed() -> Column:
    return F.expr("n_words < 20 or 100 * n_repeat_words > 30 * n_words")


def reject_level() -> Column:
    """The first level of the ladder that rejects a document; null if none does."""
    return F.coalesce(*(
        F.when(F.expr(" or ".join(f"({test.format(c=cutoffs[level])})" for test, cutoffs in RULES.values())), F.lit(level)) for level in range(LEVELS)
    ))


def _log_factorial(x: str) -> str:
    """SQL text of ln(x!): the product for small numbers, else Stirling's series (below 1e-12 off)."""
    series = f"{x} * ln({x}) - {x} + 0.5d * ln({2 * math.pi} * {x}) + 1d / (12d * {x}) - 1d / (360d * pow({x}, 3)) + 1d / (1260d * pow({x}, 5))"
    return f"if({x} <= 20, ln(double(factorial(int(least({x}, 20d))))), {series})"


def binomial_tail(n: Column, k: Column, share: float) -> Column:
    """P(Bin(n, share) <= k).

    Terms more than 40 standard deviations from the mean are below the smallest double, so the sum has at most 80 of
    them, whatever n is.
    """
    spread = f"40 * sqrt(v.n * {share * (1 - share)}d)"
    low, high = f"bigint(greatest(0, floor(v.n * {share}d - {spread})))", f"least(v.k, bigint(ceil(v.n * {share}d + {spread})))"
    first = f"{_log_factorial('double(v.n)')} - {_log_factorial('double(a)')} - {_log_factorial('double(v.n - a)')} + a * ln({share}d) + (v.n - a) * ln({1 - share}d)"
    step = f"s.t + ln(double(v.n - i + 1) / i) + {math.log(share / (1 - share))}d"
    more = f"aggregate(sequence(a + 1, z), named_struct('t', f, 's', exp(f)), (s, i) -> {sql_let(step, 'u', "named_struct('t', u, 's', s.s + exp(u))")}, s -> s.s)"
    total = sql_let(low, "a", sql_let(high, "z", f"if(z < a, 0d, {sql_let(first, 'f', f'if(z = a, exp(f), least(1d, {more}))')})"))
    return bind(F.struct(n.cast("long").alias("n"), k.cast("long").alias("k")), total, "v")


def certify(judged: DataFrame, labels: DataFrame, limit: float = LIMIT, risk: float = RISK, doc_id: str = "doc_id") -> DataFrame:
    """``stratum, level, n_good, n_rejected, tail, holds``: the test of every level in every labelled stratum.

    ``judged`` has ``doc_id, stratum, level``, ``labels`` has ``doc_id, quality``; a document is good if all its
    labels are 1.  Counting combines before the shuffle; a stratum's histogram has one number per level.
    """
    good = labels.where("quality is not null").groupBy(F.col(doc_id).alias("_doc")).agg(F.min("quality").alias("_q")).where("_q = 1")
    held = judged.join(good, F.col(doc_id) == F.col("_doc"))
    counts = held.groupBy("stratum").agg(F.count("*").alias("n_good"), *[F.count_if(F.col("level") <= j).alias(f"_k{j}") for j in range(LEVELS)])
    rows = counts.withColumn("_strata", F.count("*").over(Window.partitionBy())).select(
        "stratum", "n_good", "_strata", F.posexplode(F.array(*[F.col(f"_k{j}") for j in range(LEVELS)])).alias("level", "n_rejected"))
    tested = rows.withColumn("tail", binomial_tail(F.col("n_good"), F.col("n_rejected"), limit))
    below = Window.partitionBy("stratum").orderBy("level").rowsBetween(Window.unboundedPreceding, 0)
    return tested.select("stratum", "level", "n_good", "n_rejected", "tail", F.min(F.col("tail") <= risk / F.col("_strata")).over(below).alias("holds"))


def judge_quality(docs: DataFrame, labels: DataFrame, limit: float = LIMIT, risk: float = RISK, doc_id: str = "doc_id", text: str = "text", stratum: str = "lang") -> DataFrame:
    """``doc_id``, the statistics, ``base_failed``, ``stratum``, ``level`` (the first that rejects), ``cutoff_level`` (the strictest
    that holds in the stratum, else null) and ``kept``.

    A document is kept unless it fails the base rules or its stratum's certified cutoffs.  A stratum without enough
    labels has no certificate and rejects nothing beyond the base rules.  A null stratum is ``und``; null and empty
    texts have no words and fail the base; null ids are judged, not matched to labels; repeated rows stay and count
    as often; labels without a document, with null ids or a null quality don't count; empty tables give empty results.
    Texts are read once: the statistics are written to the shared folder, and the thresholds are read back from a
    table of one row per stratum, so Spark broadcasts them only if that table is small.
    """
    named = docs.select(F.col(doc_id), F.coalesce(F.col(stratum).cast("string"), F.lit(UNKNOWN)).alias("stratum"), F.col(text).alias("_text"))
    stats = with_statistics(named, "_text").drop("_text").withColumn("base_failed", base_failed())
    judged = materialize(stats.withColumn("level", F.when(~F.col("base_failed"), reject_level())), "quality-statistics")
    tests = certify(judged.where("not base_failed").select(doc_id, "stratum", "level"), labels, limit, risk, doc_id)
    chosen = materialize(tests.where("holds").groupBy("stratum").agg(F.max("level").alias("cutoff_level")), "quality-cutoffs")
    kept = ~F.col("base_failed") & ~F.coalesce(F.col("level") <= F.col("cutoff_level"), F.lit(False))
    return judged.join(chosen, "stratum", "left").withColumn("kept", kept)
