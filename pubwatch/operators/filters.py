"""Row filters and predicates over records, links and catalogue rows."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pubwatch import fixed_values as V
from pubwatch.functions.base import any_of, fold, literal_array, strip
from pubwatch.functions.dates import parse_datetime
from pubwatch.functions.text import clean_text, normalize_words, strip_title_suffix
from pubwatch.functions.urls import (
    content_type, hosts_related, is_agency_homepage, url_host, url_hostname, url_path, url_query, url_scheme,
)


def filter_period(records: DataFrame, since: Column, until: Column | None, column: str = "published_at") -> DataFrame:
    """Half-open period; plain comparisons, so the scan can skip row groups."""
    out = records.where(F.col(column) >= since)
    return out if until is None else out.where(F.col(column) < until)


def in_period(stamp: Column, since: Column, until: Column | None) -> Column:
    return (stamp >= since) & (stamp < until if until is not None else F.lit(True))


def link_allowed(link: Column, patterns: Column, homepage: Column | None = None) -> Column:
    """Not a landing page, and one of the patterns occurs (no patterns: every link)."""
    listed = (F.size(patterns) == 0) | F.exists(patterns, lambda p: F.contains(link, p))
    return ~is_agency_homepage(link, homepage) & listed


def official_host(link: Column, official_urls: Column, both_ways: bool = True) -> Column:
    """Is the link's host one of the official hosts, or a sub-domain (or parent) of one?"""
    host = url_host(link)
    hosts = F.transform(official_urls, url_host)

    def related(h: Column) -> Column:
        if both_ways:
            return hosts_related(host, h)
        return (h != "") & ((host == h) | F.endswith(host, F.concat(F.lit("."), h)))

    return (host != "") & F.exists(hosts, related)


def smoke_link(link: Column, source_feed: Column, official_urls: Column) -> Column:
    """Attribution check of a finished record; aggregator links count only from the aggregator feed."""
    return F.when(url_host(link) == V.AGGREGATOR_HOST, url_hostname(source_feed) == V.AGGREGATOR_HOST).otherwise(
        official_host(link, official_urls, both_ways=False)
    )


def decision_exception(link: Column, document_format: Column) -> Column:
    kind = fold(F.coalesce(document_format, F.lit("")))
    return (F.contains(kind, F.lit("decision")) | F.contains(kind, F.lit("judgment"))) & url_hostname(link).isin("gov.uk", "www.gov.uk")


def split_homepages(news: DataFrame, homepage: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(records that stay, removed count per source)."""
    landing = is_agency_homepage(F.col("link"), homepage)
    kept = news.where(~landing)
    removed = news.where(landing).groupBy("source_id").agg(F.count("*").alias("removed"))
    return kept, removed


def adjust_health_counts(health: DataFrame, removed: DataFrame) -> DataFrame:
    """Subtract removed landing pages from each source's item count, never below zero."""
    joined = health.join(removed.withColumnRenamed("source_id", "source"), "source", "left")
    left = F.greatest(F.lit(0).cast("bigint"), F.col("item_count") - F.coalesce(F.col("removed"), F.lit(0)))
    return joined.withColumn("item_count", left).drop("removed")


def fallback_rules(spark) -> DataFrame:
    rows = [
        (source, host, needed, list(V.FALLBACK_EXCLUDED_TITLES.get(source, ())), list(V.FALLBACK_EXCLUDED_PREFIXES.get(source, ())))
        for source, host, needed, _suffix in V.FALLBACK_RULES
    ]
    return spark.createDataFrame(
        rows, "source string, expected_host string, must_contain string, excluded_titles array<string>, excluded_prefixes array<string>"
    )


def filter_fallback(entries: DataFrame, rules: DataFrame, since: Column, until: Column | None) -> DataFrame:
    """Aggregator search entries that may stand in for an official source.

    ``entries``: source, title, link, published_at, publisher_url, summary, homepage.
    ``rules``: one row per source with a fallback; without a hint, its size decides how it is joined.
    """
    joined = entries.join(rules, "source")
    publisher = url_host(F.coalesce(F.col("publisher_url"), F.lit("")))
    title = strip_title_suffix(F.col("source"), clean_text(F.col("title")))
    lowered = fold(F.col("title"))
    return (
        joined.where(in_period(F.col("published_at"), since, until))
        .where((F.coalesce(F.col("publisher_url"), F.lit("")) == "") | (publisher == F.col("expected_host")))
        .where((url_host(F.col("link")) == F.col("expected_host")) | (url_host(F.col("link")) == V.AGGREGATOR_HOST))
        .where(~is_agency_homepage(F.col("link"), F.col("homepage")))
        .where(F.contains(clean_text(F.col("title")), F.col("must_contain")))
        .withColumn("title", title)
        .where(~F.array_contains(F.col("excluded_titles"), lowered))
        .where(~F.exists(F.col("excluded_prefixes"), lambda p: F.startswith(lowered, p)))
        .where(F.length("title") >= V.MINIMUM_TITLE_CHARS)
        .drop("expected_host", "must_contain", "excluded_titles", "excluded_prefixes")
    )


@dataclass(frozen=True)
class ResultFilters:
    """Interactive result query; None means no restriction."""

    query: str = ""
    item_type: str | None = None
    strength: str | None = None
    source: str | None = None
    topic: str | None = None
    minimum_score: int = 0
    maximum_score: int = 999
    date_start: date | None = None
    date_end: date | None = None


def filter_results(rows: DataFrame, filters: ResultFilters) -> DataFrame:
    """``rows``: item_type, title, summary, source, published_at and the match columns."""
    wanted = filters.query.casefold().strip()
    searchable = fold(F.concat_ws(
        " ", "title", "summary", F.array_join("matched_topics", " "), F.array_join("matched_keywords", " "), "source"
    ))
    tests = [F.col("relevance_score").between(filters.minimum_score, filters.maximum_score)]
    if filters.date_start:
        tests.append(F.col("published_at") >= F.lit(str(filters.date_start)).cast("timestamp"))
    if filters.date_end:
        tests.append(F.col("published_at") < F.date_add(F.lit(str(filters.date_end)).cast("date"), 1).cast("timestamp"))
    if filters.item_type:
        tests.append(F.col("item_type") == filters.item_type)
    if filters.source:
        tests.append(F.col("source") == filters.source)
    if filters.strength:
        tests.append(F.size(f"{filters.strength}_matched_keywords") > 0)
    if filters.topic:
        tests.append(F.array_contains("matched_topics", filters.topic))
    if wanted:
        tests.append(F.contains(searchable, F.lit(wanted)))
    out = rows
    for test in tests:
        out = out.where(test)
    return out


SORT_COLUMNS = ("type", "date", "source", "score", "level", "title")


def sort_results(rows: DataFrame, column: str = "score", descending: bool = True, tie: tuple[str, ...] = ()) -> DataFrame:
    level = F.when(F.col("relevance_level") == V.LEVEL_HIGH, 3).when(F.col("relevance_level") == V.LEVEL_MEDIUM, 2).when(
        F.col("relevance_level") == V.LEVEL_LOW, 1).otherwise(0)
    keys = {
        "type": fold(F.col("item_type")), "date": F.col("published_at"), "source": fold(F.col("source")),
        "score": F.col("relevance_score"), "level": level, "title": fold(F.col("title")),
    }
    key = keys.get(column, keys["score"])
    return rows.orderBy(key.desc() if descending else key.asc(), *[F.col(t) for t in tie])


def searchable_agencies(catalog: DataFrame) -> DataFrame:
    """Searchable catalogue rows as source-dimension rows with derived feeds, pages and patterns."""
    none = F.array().cast("array<string>")
    adapter = F.col("adapter")
    return catalog.where((F.col("status") == "searchable") & adapter.isin("govuk_search", "feed", "html_news")).select(
        F.col("id").alias("source_id"),
        F.coalesce(F.nullif("name_zh", F.lit("")), F.col("name_en")).alias("name_zh"),
        "name_en", "homepage",
        F.when(adapter == "feed", F.array("feed")).when(adapter == "govuk_search", F.array(F.concat("homepage", F.lit(".atom")))).otherwise(none).alias("feeds"),
        F.when(adapter == "html_news", F.array("news_page")).otherwise(none).alias("news_pages"),
        F.when(adapter == "govuk_search", literal_array(V.GOV_LINK_PATTERNS)).otherwise(none).alias("link_include_patterns"),
    )


def search_catalog(catalog: DataFrame, query: str = "", jurisdiction: str | None = None) -> DataFrame:
    text = F.lower(F.concat("id", "name_zh", "name_en", "kind"))
    out = catalog if jurisdiction is None else catalog.where(F.col("jurisdiction") == jurisdiction)
    return out.where(F.contains(text, F.lit(query.lower())))


def valid_record(title: Column, link: Column, stamp: Column, since: Column, until: Column) -> Column:
    return (
        (strip(title) != "") & url_scheme(link).isin("http", "https") & (url_hostname(link) != "")
        & F.coalesce(in_period(stamp, since, until), F.lit(False)) & ~is_agency_homepage(link)
    )


def audit_targets(catalog: DataFrame) -> DataFrame:
    """Directory-only rows plus rows an earlier review enabled, homepage set back to its authority."""
    reviewed = F.coalesce(F.col("review_status"), F.lit("")) != ""
    return catalog.where((F.col("status") == "directory_only") | reviewed).withColumn(
        "homepage", F.coalesce(F.nullif("authority_url", F.lit("")), F.col("homepage"))
    )


def is_retryable(error_class: Column) -> Column:
    return error_class == "DownloadError"


def publication_scope(requested: Column, final: Column) -> Column:
    """A host root stays a root; a nested page never gains its parent's whole site."""
    root = F.concat(url_scheme(final), F.lit("://"), F.regexp_extract(final, r"^[^:]+://([^/?#]*)", 1), F.lit("/"))
    return F.when((url_host(requested) == url_host(final)) & url_path(requested).isin("", "/"), root).otherwise(final)


def scoped_parent_index(identifier: Column, endpoint: Column) -> Column:
    trimmed = F.regexp_replace(endpoint, "/+$", "")
    tests = [(identifier == i) & (trimmed == u.rstrip("/")) for i, u in V.SCOPED_PARENT_INDEXES.items()]
    return any_of(identifier, tests)


def scoped_welsh_index(url: Column) -> Column:
    by_node = url_path(url).rlike(r"^/node/\d+/latest-external-org-content/?$")
    by_query = url_query(url).rlike(r"(^|&)field_external_organisations(\[|%5B)\d+(\]|%5D)=[^&]")
    return (url_host(url) == "gov.wales") & (by_node | by_query)


def identity_scope(requested: Column, final: Column, contacts: Column) -> Column:
    """A body's own contact page stands for its whole independent site; otherwise the nested boundary."""
    host = url_host(final)
    independent = ~host.isin(*V.SHARED_PUBLISHERS) & ~host.isin(*V.RELATED_PUBLISHERS) & ~F.endswith(host, F.lit("-ni.gov.uk"))
    root = F.concat(url_scheme(final), F.lit("://"), F.regexp_extract(final, r"^[^:]+://([^/?#]*)", 1), F.lit("/"))
    return F.when(F.array_contains(contacts, requested) & independent, root).otherwise(publication_scope(requested, final))


def breadcrumb_scope(name: Column, homepage: Column, crumbs: Column) -> Column:
    """Does a breadcrumb that links back to the homepage carry the body's name?  crumbs: array<struct<label,href>>."""
    return F.exists(crumbs, lambda c: (url_path(c["href"]) == url_path(homepage)) & (normalize_words(c["label"]) == normalize_words(name)))


def feed_is_attributable(identifier: Column, name: Column, homepage: Column, endpoint: Column, feed_title: Column) -> Column:
    """Can a feed be attributed to this body rather than to a whole shared site?"""
    host, base, feed = url_host(homepage), url_path(homepage), url_path(endpoint)
    plain_name = normalize_words(name)
    nested = F.startswith(feed, F.concat(F.regexp_replace(base, "/+$", ""), F.lit("/")))
    has_path = F.regexp_replace(base, "^/+|/+$", "") != ""
    publisher = F.lit(None).cast("string")
    for site, (_source, label) in V.RELATED_PUBLISHERS.items():
        publisher = F.when(host == site, F.lit(" ".join(label.lower().split()))).otherwise(publisher)
    slug = F.substring_index(identifier, ":", -1)
    organisation = F.filter(F.split(url_query(endpoint), "&"), lambda kv: F.regexp_replace(F.substring_index(kv, "=", 1), r"(%5B|\[).*$", "").isin("organisations", "filter_organisations"))
    return (
        F.when((identifier == V.TEXT_FEED_BODY) & (host == "scotcourts.gov.uk") & (endpoint == V.TEXT_FEED_URL), F.lit(True))
        .when((plain_name != "") & F.contains(normalize_words(feed_title), plain_name), F.lit(True))
        .when(publisher.isNotNull() & (publisher != plain_name), has_path & nested)
        .when(
            F.startswith(identifier, F.lit("govuk:")) & (host == "gov.uk"),
            (feed == F.concat(F.lit("/government/organisations/"), slug, F.lit(".atom")))
            | F.exists(organisation, lambda kv: F.substring_index(kv, "=", -1) == slug),
        )
        .when(host.isin(*V.SHARED_PUBLISHERS), has_path & nested)
        .otherwise(base.isin("", "/") | nested)
    )


def parse_search_results(results: DataFrame, since: Column, until: Column | None) -> DataFrame:
    """One search result per row to a record plus its reject ``reason`` (null: kept).

    ``results``: source_id, page_url, link, title, description, public_timestamp, format, patterns, homepage.
    """
    from pubwatch.functions.urls import url_join

    raw = F.coalesce(F.col("link"), F.lit(""))
    stamped = results.withColumn("_raw", raw).withColumn("link", url_join(F.lit("https://www.gov.uk"), raw)).withColumn(
        "published_at", parse_datetime(F.col("public_timestamp"))
    ).withColumn("title", clean_text(F.col("title"))).withColumn("summary", clean_text(F.col("description")))
    allowed = link_allowed(F.col("link"), F.col("patterns"), F.col("homepage")) | decision_exception(F.col("link"), F.col("format"))
    reason = (
        F.when(F.col("_raw") == "", F.lit("missing_link"))
        .when(~allowed, F.lit("path_not_allowed"))
        .when(F.coalesce(F.col("public_timestamp"), F.lit("")) == "", F.lit("missing_date"))
        .when(F.col("published_at").isNull(), F.lit("bad_date"))
        .when(~in_period(F.col("published_at"), since, until), F.lit("out_of_period"))
        .when(F.col("title") == "", F.lit("missing_title"))
    )
    kind = F.when(decision_exception(F.lit("https://www.gov.uk/"), F.col("format")), F.lit("judgment")).otherwise(
        content_type(F.col("link"), F.col("title"))
    )
    return stamped.withColumn("reason", reason).withColumn("content_type", kind).drop("_raw")


