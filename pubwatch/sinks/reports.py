"""Report tables and the JSON sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pubwatch import fixed_values as V
from pubwatch.functions.base import fold
from pubwatch.operators.dedupe import dedupe_news
from pubwatch.operators.ranking import number_rows
from pubwatch.operators.relevance import Profile, keyword_table
from pubwatch.operators.runs import validate_summary

_MATCH = ("matched_topics", "matched_keywords", "relevance_level", "relevance_score", "core_matched_keywords", "general_matched_keywords", "supporting_matched_keywords")
_MATCH_NAMES = ("topics", "keywords", "level", "score", "core", "general", "supporting")


def _joined(values: str) -> Column:
    return F.array_join(F.col(values), V.LIST_SEPARATOR)


def _match_columns() -> list[Column]:
    lists = {c for c in _MATCH if c not in ("relevance_level", "relevance_score")}
    return [(_joined(c) if c in lists else F.col(c)).alias(n) for c, n in zip(_MATCH, _MATCH_NAMES, strict=True)]


def _report_order() -> list[Column]:
    """Agency, time, title; the link makes the order total, since it is unique after de-duplication."""
    return [F.col("agency"), F.col("published_at"), fold(F.col("title")), F.col("link"), F.col("title"), F.col("unit_category")]


def news_report(news: DataFrame, matches: bool = False) -> DataFrame:
    """Numbered news rows in report order; ``matches`` adds the seven match columns."""
    numbered = number_rows(dedupe_news(news), _report_order())
    base = ["number", "agency", F.col("published_at").cast("date").alias("news_date"), "unit_category", "content_type", "title", "link"]
    return numbered.select(*base, *(_match_columns() if matches else []))


def briefing_report(briefings: DataFrame, matches: bool = False, arrival: str = "arrival_seq") -> DataFrame:
    """Briefing rows, newest first, then publisher descending."""
    ordered = briefings.orderBy(F.col("published_at").desc(), F.col("publisher").desc(), F.col(arrival))
    base = [
        F.col("published_at").cast("date").alias("data_date"), F.lit("United Kingdom").alias("country"), F.lit("UK Parliament").alias("institution"),
        "chamber", F.lit("Research Briefing").alias("source_type"), "publisher", _joined("topics").alias("briefing_topics"), "document_type", "title", "summary",
        "identifier", "webpage_url", "pdf_url", "fetched_from",
    ]
    return ordered.select(*base, *(_match_columns() if matches else []))


def bilingual_rows(report: DataFrame, translations: DataFrame) -> DataFrame:
    """Two lines per record, original then translated title, adjacent by (number, line)."""
    joined = report.join(translations.select(F.col("text").alias("title"), "translation"), "title", "left")
    lines = F.array(
        F.struct(F.lit(0).alias("line"), F.col("title").alias("text")), F.struct(F.lit(1).alias("line"), F.coalesce("translation", F.lit("")).alias("text"))
    )
    return joined.select("number", F.explode(lines).alias("l")).select("number", "l.line", "l.text")


def report_sections(news: DataFrame, briefings: DataFrame) -> DataFrame:
    """News and research rows in one table with a section tag."""
    return news.withColumn("section", F.lit("新聞稿")).unionByName(briefings.withColumn("section", F.lit("研究")), allowMissingColumns=True)


def settings_report(spark, profile: Profile, profile_digest: str, calendar: str, news: DataFrame | None = None) -> DataFrame:
    """Profile facts, one row per keyword with its weights, and a notice if a record came through the fallback feed."""
    facts = [
        ("設定檔 ID", profile.profile_id), ("設定檔名稱", profile.name), ("設定檔版本", str(profile.version)), ("設定檔雜湊", profile_digest),
        ("最低納入分數", str(profile.minimum_score)), ("Excel 日期紀年", calendar), ("選用來源", V.LIST_SEPARATOR.join(profile.selected_sources)),
    ]
    columns = "row_kind string, position int, name string, value string, strength string, title_score int, summary_score int"
    head = spark.createDataFrame([("setting", i, n, v, None, None, None) for i, (n, v) in enumerate(facts)], columns)
    label = F.lit("")
    for strength, text in V.STRENGTH_LABELS.items():
        label = F.when(F.col("strength") == strength, F.lit(text)).otherwise(label)
    words = keyword_table(spark, profile).select(
        F.lit("keyword").alias("row_kind"), (F.col("topic_ord") * 1000 + F.col("kw_ord")).alias("position"), F.col("topic").alias("name"),
        F.col("phrase").alias("value"), label.alias("strength"), F.col("title_weight").alias("title_score"), F.col("summary_weight").alias("summary_score"),
    )
    out = head.unionByName(words)
    if news is None:
        return out
    used = news.agg(F.coalesce(F.bool_or(F.contains("source_feed", F.lit(V.AGGREGATOR_HOST + "/"))), F.lit(False)).alias("used")).where("used")
    notice = used.select(F.lit("notice").alias("row_kind"), F.lit(0).alias("position"), F.lit("備援資料日期").alias("name"),
                         F.lit("備援日期取自 RSS，可能為索引或更新日期，未核對官方發布日期；備援連結可能經轉址。").alias("value"))
    return out.unionByName(notice, allowMissingColumns=True)


def audit_report(audit: DataFrame) -> DataFrame:
    """One line per audited source: id, name, outcome and endpoint or reason, table characters escaped."""
    detail = F.when(F.col("outcome") == "verified", F.col("endpoint")).otherwise(F.coalesce("reason", F.lit("")))

    def safe(c: Column) -> Column:
        return F.regexp_replace(F.replace(F.coalesce(c, F.lit("")), F.lit("|"), F.lit("\\|")), "\n", " ")

    return audit.select("id", safe(F.col("name_en")).alias("name_en"), "outcome", safe(detail).alias("detail"))


def write_run_summary(summary: DataFrame, path: str) -> None:
    """One JSON document per run; required fields must be set.  The commit protocol makes it atomic."""
    broken = validate_summary(summary).where("size(broken) > 0").select("broken").first()
    if broken is not None:
        raise ValueError(f"run summary is not valid: {broken['broken']}")
    summary.write.mode("overwrite").json(path)


def append_run_history(payloads: DataFrame, path: str, kind: str = "run-summary") -> None:
    """Append ``{recorded_at, kind, payload}`` lines; ``payloads`` holds the payload columns."""
    payloads.select(
        F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("recorded_at"), F.lit(kind).alias("kind"), F.struct(*payloads.columns).alias("payload")
    ).write.mode("append").json(path)


def write_report(report: DataFrame, path: str, order: list[str], fmt: str = "parquet") -> None:
    """Write a report table range-sorted: many files, globally ordered by name."""
    report.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").format(fmt).save(path)
