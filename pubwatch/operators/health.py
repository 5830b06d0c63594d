"""Source health, run status and run observability."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pubwatch import fixed_values as V
from pubwatch.functions.base import any_of, ordered_distinct
from pubwatch.functions.urls import route_category
from pubwatch.operators.ranking import nearest_rank, order_statistics, side_by_side

# Wordings that later operators recognise in a warning text, with the code each one stands for.
EMPTY_PARSE_WORDS = ("解析為零", "未解析到", "解析失敗", "欄位不完整")


def health_rules(spark, minimum: dict[str, int] | None = None, age_days: dict[str, int] | None = None) -> DataFrame:
    """Per-source thresholds; a table of configuration size."""
    low = V.MINIMUM_ITEMS if minimum is None else minimum
    age = V.MAXIMUM_AGE_DAYS if age_days is None else age_days
    rows = [(s, low.get(s, 0), age.get(s)) for s in sorted({*low, *age})]
    return spark.createDataFrame(rows, "source string, minimum_items int, maximum_age_days int")


def source_counts(entries: DataFrame, sources: DataFrame, source: str = "source") -> DataFrame:
    """One row per source, also for sources without entries.

    ``entries``: source, kept (became a record), candidate, published_at.
    """
    counted = entries.groupBy(source).agg(
        F.count_if("kept").alias("item_count"),
        F.count_if("candidate").alias("candidate_count"),
        F.max(F.when(F.col("kept"), F.col("published_at"))).alias("newest_published_at"),
        F.min("published_at").alias("oldest_published_at"),
    )
    return sources.select(source).join(counted, source, "left").withColumns({
        "item_count": F.coalesce("item_count", F.lit(0)), "candidate_count": F.coalesce("candidate_count", F.lit(0)),
    })


def minimum_items_warning(source: Column, items: Column, minimum: Column) -> Column:
    text = F.concat(source, F.lit(" 筆數異常：取得 "), items.cast("string"), F.lit(" 筆，低於健康門檻 "), minimum.cast("string"), F.lit(" 筆"))
    return F.when(items < F.coalesce(minimum, F.lit(0)), text)


def stale_warning(source: Column, newest: Column, age_days: Column, since: Column, now: Column) -> Column:
    """Only for recent periods: the newest record is older than the source's limit."""
    recent = since >= now - F.make_interval(days=F.lit(V.STALENESS_PERIOD_DAYS))
    old = newest < now - F.make_interval(days=age_days)
    return F.when(
        age_days.isNotNull() & newest.isNotNull() & recent & old,
        F.concat(source, F.lit(" 最新資料已超過 "), age_days.cast("string"), F.lit(" 天")),
    )


def coverage_warning(source: Column, oldest: Column, since: Column) -> Column:
    return F.when(oldest > since, F.concat(source, F.lit(" 官方 RSS 最舊資料晚於查詢起日，期間可能不完整")))


def zero_parse_warning(source: Column, candidates: Column, parsed: Column, where: Column) -> Column:
    return F.when((candidates > 0) & (parsed == 0), F.concat(source, F.lit(" RSS 有候選資料但解析為零筆："), where))


def is_candidate(stamp: Column, link: Column, allowed: Column, since: Column, until: Column | None) -> Column:
    """Undated or in period, and without a link or with an allowed one."""
    inside = (stamp >= since) & (stamp < until if until is not None else F.lit(True))
    return (stamp.isNull() | inside) & ((F.coalesce(link, F.lit("")) == "") | allowed)


def threshold_warning(counts: DataFrame, rules: DataFrame, since: Column, now: Column) -> DataFrame:
    """Add ``rule_warning``: too few items, else too old.

    ``rules`` may grow with the sources, so it carries no broadcast hint; its size decides.
    """
    joined = counts.join(rules, "source", "left")
    source, items = F.col("source"), F.col("item_count")
    warning = F.coalesce(
        minimum_items_warning(source, items, F.col("minimum_items")),
        stale_warning(source, F.col("newest_published_at"), F.col("maximum_age_days"), since, now),
    )
    return joined.withColumn("rule_warning", warning).drop("minimum_items", "maximum_age_days")


def warnings_per_source(warnings: DataFrame, source: str = "source") -> DataFrame:
    """Ordered-distinct warnings of each source.

    Repeats are combined map-side before any list is built, so the list holds distinct texts only.
    ``warnings``: source, warning, position.
    """
    once = warnings.where(F.coalesce("warning", F.lit("")) != "").groupBy(source, "warning").agg(F.min("position").alias("position"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("position", "warning"))), lambda w: w["warning"])
    return once.groupBy(source).agg(ordered.alias("warnings"))


def source_health(counts: DataFrame, rules: DataFrame, warnings: DataFrame, since: Column, now: Column) -> DataFrame:
    """Success rows: counts, newest record and the joined warning text."""
    joined = threshold_warning(counts, rules, since, now).join(warnings_per_source(warnings), "source", "left")
    listed = ordered_distinct(F.concat(F.array("rule_warning"), F.coalesce("warnings", F.array().cast("array<string>"))))
    said = F.exists(listed, lambda w: F.contains(w, F.lit("解析為零筆")))
    extra = F.when(
        (F.col("candidate_count") > 0) & (F.col("item_count") == 0) & ~said,
        F.array(F.concat("source", F.lit(" 有候選資料但解析為零筆"))),
    ).otherwise(F.array().cast("array<string>"))
    return joined.select(
        "source", F.lit(True).alias("critical"), F.lit(True).alias("success"), "item_count", "candidate_count",
        "newest_published_at", F.array_join(F.concat(listed, extra), V.WARNING_SEPARATOR).alias("warning"),
    )


def failed_health(attempts: DataFrame) -> DataFrame:
    """``attempts``: source, attempt, error -> attempts made, first and last error text."""
    return attempts.groupBy("source").agg(
        F.max("attempt").alias("attempts"), F.min_by("error", "attempt").alias("first_error"), F.max_by("error", "attempt").alias("error")
    ).withColumn("success", F.lit(False))


def run_status(health: DataFrame, group: list[str] | None = None, critical_only: bool = False) -> DataFrame:
    """Complete only if every (critical) source succeeded without a warning; distinct warnings in order.

    ``health``: source, critical, success, warning, position.
    """
    keys = group or []
    silent = F.coalesce(F.col("warning"), F.lit("")) == ""
    fine = F.col("success") & silent
    if critical_only:
        fine = fine | ~F.col("critical")
    state = health.groupBy(*keys).agg(F.coalesce(F.bool_and(fine), F.lit(True)).alias("_fine"))
    once = health.where(~silent).groupBy(*keys, "warning").agg(F.min("position").alias("position"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("position", "warning"))), lambda w: w["warning"])
    texts = once.groupBy(*keys).agg(ordered.alias("warnings"))
    joined = state.join(texts, keys, "left") if keys else side_by_side(state, texts)
    return joined.select(
        *keys, F.when(F.col("_fine"), F.lit("complete")).otherwise(F.lit("degraded")).alias("status"),
        F.coalesce("warnings", F.array().cast("array<string>")).alias("warnings"),
    )


def budget_alerts(success_rate: Column, p95: Column, zero_ratio: Column, peak_memory_mb: Column | None = None) -> Column:
    peak = F.lit(0.0) if peak_memory_mb is None else peak_memory_mb
    return F.array_compact(F.array(
        F.when(success_rate < V.BUDGET_SUCCESS_RATE, F.lit("source_success_rate")),
        F.when(p95 > V.BUDGET_P95_SECONDS, F.lit("source_p95_seconds")),
        F.when(zero_ratio > V.BUDGET_ZERO_RATIO, F.lit("zero_item_ratio")),
        F.when(peak > V.BUDGET_PEAK_MEMORY_MB, F.lit("peak_memory_mb_100k")),
    ))


def observability(health: DataFrame) -> DataFrame:
    """One row over the critical sources: count, success rate, nearest-rank p95, zero ratio, alerts."""
    critical = health.where("critical")
    totals = critical.agg(
        F.count("*").alias("source_count"), F.avg(F.col("success").cast("int")).alias("_rate"),
        F.avg((F.col("item_count") == 0).cast("int")).alias("_zero"),
    )
    row = side_by_side(totals, order_statistics(critical, [], "duration_seconds", {"_p95": nearest_rank(0.95)}).select("_p95"))
    rate, slow, zero = F.coalesce("_rate", F.lit(1.0)), F.coalesce("_p95", F.lit(0.0)), F.coalesce("_zero", F.lit(0.0))
    return row.select(
        "source_count", F.bround(rate, 3).alias("source_success_rate"), F.bround(slow, 3).alias("source_p95_seconds"),
        F.bround(zero, 3).alias("zero_item_ratio"),
        F.when(F.col("source_count") == 0, F.array().cast("array<string>")).otherwise(budget_alerts(rate, slow, zero)).alias("alerts"),
    )


def http_counts(log: DataFrame) -> DataFrame:
    """``log``: url, status_code, retry."""
    return log.groupBy(route_category(F.col("url")).alias("category")).agg(
        F.count("*").alias("attempted_count"), F.count_if("retry").alias("retry_count"),
        F.count_if(F.col("status_code") == 429).alias("rate_limited_count"),
    )


def failed_sources(health: DataFrame, sources: DataFrame) -> DataFrame:
    """Sources that need a retry, in source order; rows of other sources stand for the briefings source.

    ``sources``: source_id, source_ord.
    """
    bad = health.where(~F.col("success") | (F.coalesce(F.col("warning"), F.lit("")) != "")).select("source").distinct()
    named = bad.join(sources, bad["source"] == sources["source_id"], "left")
    last = sources.agg(F.max("source_ord")).scalar()
    return named.select(
        F.coalesce("source_id", F.lit(V.BRIEFINGS_SOURCE_ID)).alias("source_id"), F.coalesce(F.col("source_ord"), last + 1).alias("source_ord")
    ).distinct().orderBy("source_ord")


def health_advice(success: Column, warning: Column, candidates: Column, items: Column) -> Column:
    """Advice labels of a health row; several may apply, and there is always one."""
    text = F.coalesce(warning, F.lit(""))
    found = F.array_compact(F.array(
        F.when(~success, F.lit("取得失敗")),
        F.when(text.rlike("解析為零|未解析到|解析失敗|欄位不完整|頁面格式") | ((F.coalesce(candidates, F.lit(0)) > 0) & (items == 0)), F.lit("解析需檢查")),
        F.when(text.rlike("最舊|期間可能不完整|歷史|涵蓋"), F.lit("期間涵蓋不足")),
        F.when(text.rlike("(?i)備援|fallback"), F.lit("使用備援")),
        F.when(text.rlike("最新資料已超過|筆數異常|健康門檻"), F.lit("發布頻率需核對")),
    ))
    default = F.when(text != "", F.lit("需注意")).when(items == 0, F.lit("期間內未取得資料")).otherwise(F.lit("正常"))
    return F.when(F.size(found) > 0, found).otherwise(F.array(default))


def needs_attention(success: Column, warning: Column) -> Column:
    return ~success | (F.coalesce(warning, F.lit("")) != "")


def quality_issues(health: DataFrame, records: DataFrame) -> DataFrame:
    """Issue rows of a run.

    ``health``: source, success, candidate_count, item_count, warning.
    ``records``: source, title, valid (validity and attribution already decided).
    """
    text = F.coalesce(F.col("warning"), F.lit(""))
    kind = (
        F.when(~F.col("success"), F.lit("fetch_failed"))
        .when((F.col("candidate_count") > 0) & (F.col("item_count") == 0), F.lit("parser_empty"))
        .when(any_of(text, [F.contains(text, F.lit(w)) for w in EMPTY_PARSE_WORDS]), F.lit("parser_warning"))
    )
    of_sources = health.select("source", kind.alias("kind"), text.alias("message")).where("kind is not null")
    of_records = records.where(~F.col("valid")).select("source", F.lit("invalid_record").alias("kind"), F.col("title").alias("message"))
    none = health.agg(F.count("*").alias("_n")).where("_n = 0").select(
        F.lit("all").alias("source"), F.lit("missing_health").alias("kind"), F.lit("沒有來源健康紀錄").alias("message")
    )
    return of_sources.unionByName(of_records).unionByName(none)


def transient_only(issues: DataFrame, health: DataFrame, aggregator_url: str = "https://news.google.com/rss/search") -> DataFrame:
    """One row: is every issue a failed fetch whose aggregator answers were all transient?

    ``health``: source, success, candidate_count, endpoints array<struct<url, status_code>>.
    """
    statuses = F.transform(F.filter("endpoints", lambda e: e["url"] == aggregator_url), lambda e: e["status_code"])
    passing = (F.coalesce("candidate_count", F.lit(0)) == 0) & (F.size(statuses) > 0) & F.forall(statuses, lambda s: s.isin(*V.TRANSIENT_STATUSES))
    failed = health.where(~F.col("success")).agg(F.coalesce(F.bool_and(passing), F.lit(True)).alias("_p"))
    listed = issues.agg(F.count("*").alias("_n"), F.count_if(F.col("kind") != "fetch_failed").alias("_o"))
    return side_by_side(listed, failed).select(((F.col("_n") > 0) & (F.col("_o") == 0) & F.col("_p")).alias("transient_only"))
