"""Run tables: history, comparison of two runs, performance baselines and quality evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pubwatch import fixed_values as V
from pubwatch.functions.dates import parse_datetime
from pubwatch.operators.dedupe import keep_first
from pubwatch.operators.ranking import distribution, side_by_side

REQUIRED_SUMMARY_FIELDS = ("delivery_id", "run_id", "status", "data_fingerprint", "output_file")
COUNT_FIELDS = ("all_news_count", "filtered_news_count", "parliament_count", "filtered_parliament_count")


def validate_summary(runs: DataFrame) -> DataFrame:
    """Add ``broken``: missing required texts and unknown states."""
    missing = [F.when(F.coalesce(F.col(c), F.lit("")) == "", F.lit(f"missing_{c}")) for c in REQUIRED_SUMMARY_FIELDS]
    state = F.when(~F.coalesce(F.col("status").isin("complete", "degraded"), F.lit(False)), F.lit("unknown_status"))
    return runs.withColumn("broken", F.array_compact(F.array(*missing, state)))


def limit_history(runs: DataFrame, modified: str, tie: str, limit: int = V.HISTORY_LIMIT) -> DataFrame:
    """Newest valid runs; a top-k, so each task keeps only ``limit`` rows."""
    return runs.orderBy(F.col(modified).desc(), F.col(tie)).limit(limit)


def latest_reports(runs: DataFrame) -> DataFrame:
    """Latest row per (run_id, output_file); of equal keys the later in the history wins."""
    return keep_first(runs, [F.col("run_id"), F.col("output_file")], [F.col("history_seq").desc()])


def report_state(status: Column) -> Column:
    return F.when(status == "complete", F.lit("已產生・完整")).when(status == "degraded", F.lit("已產生・來源需注意")).otherwise(F.lit("執行失敗"))


def needs_retry(source_health: Column) -> Column:
    return F.exists(source_health, lambda h: ~h["success"] | (F.coalesce(h["warning"], F.lit("")) != ""))


def is_measured(performance: Column) -> Column:
    wall = performance["total_wall_seconds"]
    finite = wall.isNotNull() & ~F.isnan(wall) & (wall != float("inf"))
    return F.coalesce(
        (performance["schema_version"] == 1) & finite & (wall > 0) & (F.coalesce(performance["runtime_version"], F.lit("")) != ""), F.lit(False)
    )


def compare_runs(left: DataFrame, right: DataFrame) -> DataFrame:
    """Field-by-field comparison of two runs of the same period, long form.

    Both: run_id, period_start, period_end, four counts, data_fingerprint, status, delivery_id,
    profile_hash, health_contract, provenance_contract, source_count, source_success_rate.
    """
    fields = [*COUNT_FIELDS, "data_fingerprint", "status", "delivery_id", "profile_hash", "health_contract", "provenance_contract",
              "source_count", "source_success_rate"]

    def long_form(df: DataFrame, side: str) -> DataFrame:
        pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields])
        return df.select("period_start", "period_end", F.explode(pairs).alias("p")).select(
            "period_start", "period_end", "p.field", F.col("p.value").alias(side), F.lit(True).alias(f"_{side}")
        )

    # A period that one side lacks stays, and matches nothing.
    joined = long_form(left, "left").join(long_form(right, "right"), ["period_start", "period_end", "field"], "full")
    both = F.col("_left").isNotNull() & F.col("_right").isNotNull()
    return joined.withColumn("match", both & F.col("left").eqNullSafe(F.col("right"))).drop("_left", "_right")


def logical_matches(comparison: DataFrame) -> DataFrame:
    return comparison.groupBy("period_start", "period_end").agg(F.bool_and("match").alias("logical_match"))


def record_parity(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows with different multiplicity on the two sides: row columns, left_count, right_count.

    Counting both sides in one aggregate combines map-side, so repeated rows cost little.
    """
    columns = left.columns
    tagged = left.withColumn("_l", F.lit(1)).withColumn("_r", F.lit(0)).unionByName(
        right.select(*columns).withColumn("_l", F.lit(0)).withColumn("_r", F.lit(1))
    )
    counted = tagged.groupBy(*columns).agg(F.sum("_l").alias("left_count"), F.sum("_r").alias("right_count"))
    return counted.where("left_count <> right_count")


def sort_canonical(items: DataFrame) -> DataFrame:
    """Parity order with timestamps as UTC microsecond text."""
    stamp = F.date_format(parse_datetime(F.col("published_at")), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")
    return items.withColumn("published_at", stamp).orderBy("link", "published_at", "title")


# --- performance ---------------------------------------------------------------------------------


def once_per_run(entries: DataFrame) -> DataFrame:
    """One sample per execution; its repeats are identical, so the choice does not matter."""
    return entries.dropDuplicates(["generated_at", "run_id", "output_file"])


def stage_distributions(entries: DataFrame, keys: list[str], stages: str = "stages") -> DataFrame:
    """Distribution per stage; null where any run of the group lacks the stage."""
    long = entries.select(*keys, F.explode(stages).alias("stage", "seconds"))
    runs = entries.groupBy(*keys).agg(F.count("*").alias("_runs"))
    stats = distribution(long.where(~F.isnan("seconds") & (F.col("seconds") >= 0) & (F.col("seconds") < float("inf"))), [*keys, "stage"], "seconds")
    names = long.select(*keys, "stage").distinct()
    joined = names.join(runs, keys).join(stats, [*keys, "stage"], "left")
    whole = F.coalesce(F.col("n") == F.col("_runs"), F.lit(False))
    return joined.select(*keys, "stage", *[F.when(whole, F.col(c)).alias(c) for c in ("median", "p95", "min", "max")])


def bench_budget(current: DataFrame, baseline: DataFrame) -> DataFrame:
    """``current`` and ``baseline``: size, p95_ms -> over budget and regressed flags per size."""
    budget = F.lit(None).cast("double")
    for size, limit in V.BENCH_BUDGET_MS.items():
        budget = F.when(F.col("size") == size, F.lit(limit)).otherwise(budget)
    joined = current.join(baseline.select("size", F.col("p95_ms").alias("baseline_p95_ms")), "size", "left")
    over = F.coalesce(F.col("p95_ms") > budget, F.lit(False))
    worse = F.coalesce((F.col("baseline_p95_ms") > 0) & (F.col("p95_ms") > F.col("baseline_p95_ms") * V.BENCH_REGRESSION_FACTOR), F.lit(False))
    return joined.withColumns({"over_budget": over, "regressed": worse})


# --- quality ------------------------------------------------------------------------------------


def labelled_issues(cases: DataFrame) -> DataFrame:
    """Problems of a labelled set: id, issue."""
    repeated = cases.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("id").cast("string").alias("id"), F.lit("duplicate").alias("issue"))
    unknown = cases.where(~F.col("label").isin("related", "unrelated", "boundary")).select(F.col("id").cast("string").alias("id"), F.lit("unknown_label").alias("issue"))
    empty = cases.agg(F.count("*").alias("n")).where("n = 0").select(F.lit("all").alias("id"), F.lit("empty").alias("issue"))
    return repeated.unionByName(unknown).unionByName(empty)


def confusion(cases: DataFrame) -> DataFrame:
    """``cases``: label, included -> counts, precision, recall (null without a base) and boundary count."""
    related, unrelated, taken = F.col("label") == "related", F.col("label") == "unrelated", F.col("included")
    counted = cases.agg(
        F.count_if(related & taken).alias("tp"), F.count_if(unrelated & taken).alias("fp"),
        F.count_if(unrelated & ~taken).alias("tn"), F.count_if(related & ~taken).alias("fn"),
        F.count_if(F.col("label") == "boundary").alias("boundary_count"),
    )
    return counted.withColumns({
        "precision": F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")), "recall": F.try_divide(F.col("tp"), F.col("tp") + F.col("fn")),
    })


def compare_cases(current: DataFrame, baseline: DataFrame) -> DataFrame:
    """Cases that changed or exist on one side only; ``regression`` marks a correct decision that turned wrong.

    ``current``: id, label, included; ``baseline``: id, included.
    """
    joined = current.join(baseline.select("id", F.col("included").alias("before")), "id", "full")
    changed = joined.where(~F.col("included").eqNullSafe(F.col("before")))
    wrong = ((F.col("label") == "related") & ~F.col("included")) | ((F.col("label") == "unrelated") & F.col("included"))
    side = F.when(F.col("before").isNull(), F.lit("added")).when(F.col("included").isNull(), F.lit("missing")).otherwise(F.lit("changed"))
    return changed.withColumns({"change": side, "regression": F.coalesce(wrong & F.col("before").isNotNull(), F.lit(False))})


def run_counts(news: DataFrame, briefings: DataFrame) -> DataFrame:
    """The four report counts; both inputs carry ``included``."""
    def tally(df: DataFrame, names: tuple[str, str]) -> DataFrame:
        return df.agg(F.count("*").alias(names[0]), F.count_if("included").alias(names[1]))

    return side_by_side(tally(news, ("all_news_count", "filtered_news_count")), tally(briefings, ("parliament_count", "filtered_parliament_count")))
