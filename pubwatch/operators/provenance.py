"""Record provenance and content fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pubwatch.functions.base import fold
from pubwatch.functions.canonical import lower_escapes
from pubwatch.functions.urls import canonical_url
from pubwatch.operators.dedupe import unit_or_agency
from pubwatch.operators.merge import attach_fetched_at

PARSER_VERSION = "v1"
FINGERPRINT_VERSION = "v3"
FLAT_FINGERPRINT_BYTES = 256 * 1024 * 1024
_TREE_PREFIXES = (6, 4, 2)


def build_provenance(news: DataFrame, briefings: DataFrame, health: DataFrame, generated_at: Column) -> DataFrame:
    """Seven provenance columns for every news and briefing row."""
    of_news = attach_fetched_at(
        news.select(
            F.lit("news").alias("record_type"), unit_or_agency().alias("source_id"), F.col("link").alias("url"),
            canonical_url(F.col("link")).alias("canonical_url"), "source_feed",
        ), health, generated_at, F.col("source_id"),
    )
    of_briefings = attach_fetched_at(
        briefings.select(
            F.lit("parliament").alias("record_type"), F.col("publisher").alias("source_id"), F.col("webpage_url").alias("url"),
            canonical_url(F.col("webpage_url")).alias("canonical_url"), F.col("fetched_from").alias("source_feed"),
        ), health, generated_at, F.concat("source_id", F.lit(" RSS")),
    )
    return of_news.unionByName(of_briefings).withColumn("parser_version", F.lit(PARSER_VERSION))


def sort_provenance(rows: DataFrame) -> DataFrame:
    return rows.orderBy("record_type", "source_id", "canonical_url", "url", "source_feed")


def _by_fold(values: Column) -> Column:
    keyed = F.array_sort(F.transform(values, lambda v: F.struct(fold(v).alias("k"), v.alias("v"))))
    return F.transform(keyed, lambda s: s["v"])


def _canonical_json(fields: dict[str, Column]) -> Column:
    """Compact JSON with sorted keys, nulls kept, and lower-case hex in control escapes."""
    return lower_escapes(F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"}))


_STRENGTH_COLUMNS = ("matched_keywords", "core_matched_keywords", "general_matched_keywords", "supporting_matched_keywords")


def news_lines(news: DataFrame) -> DataFrame:
    fields = {c: F.col(c) for c in ("agency", "agency_en", "unit_category", "content_type", "title", "summary", "link", "source_feed", "relevance_score")}
    fields |= {c: _by_fold(F.col(c)) for c in _STRENGTH_COLUMNS}
    fields |= {"type": F.lit("news"), "date": F.date_format("published_at", "yyyy-MM-dd"), "matched_topics": F.array_sort("matched_topics")}
    return news.select(_canonical_json(fields).alias("line"))


def briefing_lines(briefings: DataFrame) -> DataFrame:
    fields = {c: F.col(c) for c in (
        "publisher", "chamber", "identifier", "document_type", "title", "summary", "webpage_url", "pdf_url", "fetched_from", "relevance_score")}
    fields |= {c: _by_fold(F.col(c)) for c in _STRENGTH_COLUMNS}
    fields |= {
        "type": F.lit("parliament"), "date": F.date_format("published_at", "yyyy-MM-dd"),
        "topics": F.array_sort("topics"), "matched_topics": F.array_sort("matched_topics"),
    }
    return briefings.select(_canonical_json(fields).alias("line"))


def record_lines(news: DataFrame, briefings: DataFrame) -> DataFrame:
    return news_lines(news).unionByName(briefing_lines(briefings))


def data_fingerprint(news: DataFrame, briefings: DataFrame, limit_bytes: int = FLAT_FINGERPRINT_BYTES) -> DataFrame:
    """SHA-256 over the sorted canonical records of a small run, as one flat text.

    A flat digest reads its bytes in one order, so it is only defined here for a run whose
    records fit ``limit_bytes`` (measured first); larger tables use :func:`fingerprint_tree`.
    """
    lines = record_lines(news, briefings)
    size = lines.agg(F.coalesce(F.sum(F.octet_length("line")), F.lit(0)).alias("b")).first()["b"]
    if size > limit_bytes:
        raise ValueError(f"{size} bytes of records exceed the flat fingerprint's {limit_bytes}; use fingerprint_tree")
    joined = F.concat(F.lit('{"records":['), F.array_join(F.sort_array(F.collect_list("line")), ","), F.lit(f'],"schema":"{FINGERPRINT_VERSION}"}}'))
    return lines.agg(F.sha2(joined, 256).alias("data_fingerprint"))


def run_fingerprint(news: DataFrame, briefings: DataFrame) -> DataFrame:
    """The fingerprint of a run of any size: the tree over all its records, news and briefings."""
    return fingerprint_tree(record_lines(news, briefings)).withColumnRenamed("fingerprint", "data_fingerprint")


def fingerprint_tree(lines: DataFrame) -> DataFrame:
    """Order-free SHA-256 tree over any number of rows, repeats included.

    Equal rows are counted map-side first; the row digests are then grouped by ever shorter
    prefixes.  Digests spread evenly, so every group stays small whatever the input's skew.
    No rows at all have the digest of the empty text.
    """
    level = lines.groupBy(F.sha2("line", 256).alias("h")).agg(F.count("*").alias("c")).select(
        F.col("h"), F.concat_ws(":", "h", "c").alias("v")
    )
    digest = F.sha2(F.array_join(F.sort_array(F.collect_list("v")), ","), 256)
    for size in _TREE_PREFIXES:
        level = level.groupBy(F.left("h", F.lit(size)).alias("h")).agg(digest.alias("v"))
    return level.agg(digest.alias("fingerprint"))


def response_hash(body: Column) -> Column:
    return F.struct(F.sha2(body, 256).alias("response_sha256"), F.octet_length(body).alias("bytes_count"))


def run_id(start: Column, end: Column, profile_id: Column, default_profile_id: str, prefix: str) -> Column:
    base = F.concat(F.lit(prefix), F.lit("-"), F.date_format(start, "yyyy-MM-dd"), F.lit("_"), F.date_format(end, "yyyy-MM-dd"))
    return F.when(profile_id == default_profile_id, base).otherwise(F.concat_ws("-", base, profile_id))


def delivery_id(run: Column, status: Column, fingerprint: Column) -> Column:
    return F.concat_ws(":", run, F.concat(F.lit("RunStatus."), F.upper(status)), F.left(fingerprint, F.lit(16)))


def report_stem(start: Column, end: Column, profile_id: Column, default_profile_id: str, title: str) -> Column:
    base = F.concat(F.date_format(start, "yyyyMMdd"), F.lit("-"), F.date_format(end, "yyyyMMdd"), F.lit(f"_{title}"))
    return F.concat(F.when(profile_id == default_profile_id, base).otherwise(F.concat_ws("_", base, profile_id)), F.lit(".xlsx"))
