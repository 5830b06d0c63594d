"""Mixing sources to target weights by Poisson replication.

Every document of a source is repeated a Poisson number of times whose mean is the source's target repetition
rate.  The count inverts the Poisson distribution at a uniform value hashed from seed and document, so a second
run, a retried task and another engine make the same copies.  The copies are then shuffled globally by a hash.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pubwatch.session import materialize

#: Largest mean that one inversion handles; larger means are sums of equal independent parts.
PART_MEAN = 16
#: Counts tabulated for a part: P(more) is below 1e-30 for a mean of 16.
PART_COUNTS = 100


def hashed_bits(seed: int, *parts: Column) -> Column:
    """52 bits of an MD5 as a bigint."""
    text = F.concat_ws(":", F.lit(str(seed)), *(F.coalesce(p.cast("string"), F.lit("-")) for p in parts))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("bigint")


def uniform(seed: int, *parts: Column) -> Column:
    """A value in (0, 1) from 52 hashed bits."""
    return (hashed_bits(seed, *parts) + F.lit(0.5)) / F.lit(2.0**52)


def source_rates(docs: DataFrame, weights: Mapping[str, float], default_weight: float = 1.0, epochs: float = 1.0) -> DataFrame:
    """``source_key, rate, parts, cdf``: how often a document of the source is to appear on average.

    The sources' expected characters are in proportion to their weights and add up to ``epochs`` times all
    characters.  A null source is a source of its own; a source without characters has rate 0.
    """
    weight = F.lit(float(default_weight))
    for name, value in weights.items():
        weight = F.when(F.col("source") == name, F.lit(float(value))).otherwise(weight)
    totals = docs.groupBy("source").agg(F.sum(F.coalesce(F.length("text"), F.lit(0)).cast("bigint")).alias("chars"))
    totals = totals.withColumn("weight", F.when(F.col("chars") > 0, weight).otherwise(0.0))
    # One row, so the nested-loop join is over the sources alone.
    whole = totals.agg(F.sum("chars").alias("all_chars"), F.sum("weight").alias("all_weight"))
    rate = F.when(F.col("weight") > 0, F.lit(float(epochs)) * F.col("all_chars") * F.col("weight") / F.col("all_weight") / F.col("chars")).otherwise(0.0)
    rates = (
        totals.join(F.broadcast(whole)).select(F.coalesce(F.concat(F.lit("s"), "source"), F.lit("null")).alias("source_key"), rate.alias("rate"))
        .withColumn("parts", F.greatest(F.lit(1), F.ceil(F.col("rate") / PART_MEAN)).cast("int"))
    )
    mean = "rate / parts"
    steps = f"""aggregate(sequence(1, {PART_COUNTS}), named_struct('p', exp(-{mean}), 'c', exp(-{mean}), 'out', array(exp(-{mean}))),
        (s, i) -> named_struct('p', s.p * ({mean}) / i, 'c', s.c + s.p * ({mean}) / i, 'out', concat(s.out, array(s.c + s.p * ({mean}) / i))), s -> s.out)"""
    return rates.withColumn("cdf", F.expr(steps))


def mix_sources(docs: DataFrame, weights: Mapping[str, float], default_weight: float = 1.0, epochs: float = 1.0, seed: int = 17) -> DataFrame:
    """The documents, each as often as its Poisson count says, in a global random order.

    Adds ``n_copies`` (the document's count), ``copy`` (from 1) and ``order_key`` (a hash; partitions are dealt by
    it and sorted by it).  Null and empty texts count no characters but are repeated like others of their source;
    rows with equal ``doc_id`` get equal counts; an empty table gives an empty result; columns named like the
    added ones are replaced.  The rate table has one row per source and is written before the join, so that Spark
    knows its size: it is broadcast only below the session's threshold, and beyond it a hot source's partition is
    split by adaptive execution.
    """
    names = [c for c in docs.columns if c not in ("n_copies", "copy", "order_key")]
    rates = materialize(source_rates(docs, weights, default_weight, epochs), "rates")
    keyed = docs.select(*names).withColumn("source_key", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("null")))
    counted = keyed.join(rates, "source_key").withColumn(
        "n_copies",
        F.aggregate(
            F.transform(F.sequence(F.lit(1), F.col("parts")), lambda i: F.size(F.filter("cdf", lambda c: c < uniform(seed, F.col("doc_id"), i)))),
            F.lit(0), lambda a, x: a + x,
        ),
    )
    copies = counted.where("n_copies > 0").select(*names, "n_copies", F.explode(F.sequence(F.lit(1), F.col("n_copies"))).alias("copy"))
    ordered = copies.withColumn("order_key", hashed_bits(seed, F.lit("order"), F.col("doc_id"), F.col("copy")))
    return ordered.repartition(F.col("order_key")).sortWithinPartitions("order_key", "doc_id", "copy")

