"""Exact order operators that stay distributed: global row numbers and order statistics."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pubwatch.session import materialize

_ROWS_PER_PARTITION_BITS = 33
#: Distinct values that may be ordered in one group, and values drawn to cut a larger bracket.
BRACKET_VALUES, PIVOTS = 4096, 24


def number_rows(df: DataFrame, order: list[Column], name: str = "number") -> DataFrame:
    """Number all rows 1..n in a global order without funnelling them through one task.

    The rows are range-sorted, written once to the shared checkpoint folder with their
    (partition, position) id, and the per-partition counts - one row per partition - give the
    offsets.  ``order`` must be a total order, otherwise equal rows keep an arbitrary order.
    """
    placed = materialize(df.orderBy(*order).withColumn("_place", F.monotonically_increasing_id()), "numbered")
    partition = F.shiftright("_place", _ROWS_PER_PARTITION_BITS)
    counts = placed.groupBy(partition.alias("_part")).agg(F.count("*").alias("_rows"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"))
    # One row per written partition: bounded by the number of shuffle partitions.
    joined = placed.withColumn("_part", partition).join(F.broadcast(offsets), "_part")
    position = F.col("_place") - F.shiftleft(F.col("_part"), _ROWS_PER_PARTITION_BITS)
    return joined.withColumn(name, (F.col("_offset") + position + 1).cast("bigint")).drop("_place", "_part", "_offset")


def nearest_rank(fraction: float) -> Callable[[Column], Column]:
    """Rank ceil(fraction * n), the value at or above the given share of rows."""
    return lambda n: F.greatest(F.lit(1), F.ceil(n * F.lit(fraction))).cast("bigint")


def lower_median(n: Column) -> Column:
    return F.floor((n + 1) / 2).cast("bigint")


def upper_median(n: Column) -> Column:
    return (F.floor(n / 2) + 1).cast("bigint")


def order_statistics(
    df: DataFrame, keys: list[str], value: str, ranks: dict[str, Callable[[Column], Column]], width: int = BRACKET_VALUES, pivots: int = PIVOTS,
) -> DataFrame:
    """Exact k-th smallest values per group: keys, n, min, max, then one column per entry of ``ranks``.

    ``ranks`` maps a column name to the exact rank as a function of n; nulls are left out.  Values keep their own type,
    whatever can be ordered.  Equal values are counted first, map-side, so a value that holds any share of the rows is
    one row.  Then every wanted rank has a bracket, at first the whole group.  Brackets of more than ``width`` distinct
    values are narrowed: random values of the bracket cut it into pieces, the pieces are counted (a few numbers per
    task), and the piece that holds the rank is the next bracket.  A round divides a bracket by about ``pivots`` / 2.
    Only brackets of at most ``width`` values are ordered, so no group is collected or sorted whole.
    """
    group = keys or ["_all"]
    rows = df.select(*keys, F.col(value).alias("_v")) if keys else df.select(F.lit(1).alias("_all"), F.col(value).alias("_v"))
    valued = materialize(rows.where("_v is not null").groupBy(*group, "_v").agg(F.count("*").alias("_c")), "rank-values")
    whole = valued.groupBy(*group).agg(F.sum("_c").alias("n"), F.min("_v").alias("min"), F.max("_v").alias("max"), F.count("*").alias("_d"))
    wanted = F.array(*[F.struct(F.lit(k).alias("k"), rank(F.col("n")).alias("rank")) for k, rank in enumerate(ranks.values())])
    state = whole.select(*group, F.explode(wanted).alias("_r"), F.col("min").alias("_low"), F.col("max").alias("_high"), "_d").select(
        *group, "_r.k", "_r.rank", "_low", "_high", "_d")
    ready = state.where(F.col("_d") <= width)
    while not (open_ := materialize(state.where(F.col("_d") > width), "rank-brackets")).isEmpty():
        state = _narrow(valued, open_, group, pivots)
        ready = ready.unionByName(state.where(F.col("_d") <= width))
    upto = Window.partitionBy(*group, "k").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    counted = _inside(valued, ready, group).withColumn("_upto", F.sum("_c").over(upto))
    hit = (F.col("_upto") >= F.col("rank")) & (F.col("_upto") - F.col("_c") < F.col("rank"))
    picked = counted.where(hit).groupBy(*group).agg(*[F.min(F.when(F.col("k") == k, F.col("_v"))).alias(name) for k, name in enumerate(ranks)])
    out = whole.drop("_d").join(picked, group, "left")
    return out if keys else out.drop("_all")


def _inside(valued: DataFrame, brackets: DataFrame, group: list[str]) -> DataFrame:
    """Counted values with every bracket they lie in.  Brackets are read from a table of known size: that decides the join."""
    sides = [F.col(f"v.{c}").eqNullSafe(F.col(f"b.{c}")) for c in group]
    joined = valued.alias("v").join(brackets.alias("b"), reduce(and_, sides))
    return joined.where(F.col("_v").between(F.col("_low"), F.col("_high"))).select("b.*", "_v", "_c")


def _narrow(valued: DataFrame, brackets: DataFrame, group: list[str], pivots: int) -> DataFrame:
    """The piece of every bracket that holds its rank; the rank then counts from the piece's start.

    A pivot is the value with the least hash under one of several seeds, so it is a value of the bracket, in its own
    type; pieces are the pivots themselves and the gaps between them, and at least one value leaves the bracket.
    """
    keys = [*group, "k"]
    rows = _inside(valued, brackets, group)
    drawn = rows.groupBy(*keys).agg(*[F.min_by("_v", F.xxhash64("_v", F.lit(seed))).alias(f"_p{seed}") for seed in range(pivots)])
    cuts = materialize(drawn.select(*keys, F.array_sort(F.array_distinct(F.array(*[f"_p{seed}" for seed in range(pivots)]))).alias("_cuts")), "rank-pivots")
    sides = [F.col(f"r.{c}").eqNullSafe(F.col(f"p.{c}")) for c in keys]
    below = F.aggregate("_cuts", F.lit(0), lambda n, p: n + F.when(p < F.col("_v"), 2).when(p == F.col("_v"), 1).otherwise(0))
    placed = rows.alias("r").join(cuts.alias("p"), reduce(and_, sides)).select("r.*", below.alias("_piece"))
    pieces = placed.groupBy(*keys, "rank", "_piece").agg(F.sum("_c").alias("_c"), F.min("_v").alias("_low"), F.max("_v").alias("_high"), F.count("*").alias("_d"))
    upto = Window.partitionBy(*keys).orderBy("_piece").rowsBetween(Window.unboundedPreceding, 0)
    running = pieces.withColumn("_upto", F.sum("_c").over(upto))
    chosen = running.where((F.col("_upto") >= F.col("rank")) & (F.col("_upto") - F.col("_c") < F.col("rank")))
    return materialize(chosen.select(*keys, (F.col("rank") - F.col("_upto") + F.col("_c")).alias("rank"), "_low", "_high", "_d"), "rank-pieces")


def distribution(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """n, min, max, median and p95 (nearest rank) per group."""
    stats = order_statistics(df, keys, value, {
        "_m1": lower_median, "_m2": upper_median, "p95": nearest_rank(0.95),
    })
    return stats.withColumn("median", (F.col("_m1") + F.col("_m2")) / 2).drop("_m1", "_m2")


def side_by_side(*rows: DataFrame) -> DataFrame:
    """One row out of one-row tables with different columns: a union and an aggregate, where a join on a constant
    would be a Cartesian product."""
    wide = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), rows)
    return wide.agg(*[F.max(c).alias(c) for c in wide.columns])
