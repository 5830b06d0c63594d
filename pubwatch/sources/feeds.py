"""RSS and Atom bodies to entries and records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pubwatch import fixed_values as V
from pubwatch.functions.base import literal_map, text_or
from pubwatch.functions.dates import parse_feed_date
from pubwatch.functions.text import briefing_identifier, briefing_pdf_url, clean_text, entry_summary, feed_topics
from pubwatch.functions.urls import content_type
from pubwatch.operators.filters import in_period, link_allowed, official_host
from pubwatch.operators.health import is_candidate

ENTRY_PATTERN = r"(?s)<(?:item|entry)(?:\s[^>]*)?>.*?</(?:item|entry)>"
_TEXT = "string"
ENTRY_SCHEMA = (
    f"title {_TEXT}, link array<struct<_VALUE:string,_href:string,_rel:string>>, guid {_TEXT}, id {_TEXT}, pubDate {_TEXT}, "
    f"published {_TEXT}, updated {_TEXT}, date {_TEXT}, created {_TEXT}, description {_TEXT}, summary {_TEXT}, "
    f"encoded array<string>, content array<string>, category array<struct<_VALUE:string,_term:string>>, "
    f"source struct<_url:string>, _corrupt string"
)


def split_entries(responses: DataFrame, every_body: bool = False) -> DataFrame:
    """One row per item or entry of a landed feed: raw XML and its position.

    Entries are cut out before they are parsed, so a broken one - or a broken document around
    them - does not lose the others.  With ``every_body`` a body without entries has one row without a position, and
    ``unreadable`` tells of every row's body whether it is no feed at all.
    """
    kept, found = [c for c in responses.columns if c != "body"], F.regexp_extract_all("body", F.lit(ENTRY_PATTERN), F.lit(0))
    if every_body:
        rows = responses.select(*kept, "body", F.posexplode_outer(found).alias("position", "xml"))
        unreadable = F.when(F.col("position").isNull(), is_unreadable(F.col("body"))).otherwise(F.lit(False))
        return rows.select(*kept, unreadable.alias("unreadable"), "position", "xml")
    return responses.select(*kept, F.posexplode(found).alias("position", "xml"))


def scan_feed(responses: DataFrame, every_body: bool = False) -> DataFrame:
    """Entries of landed feeds: title, link, id, published_at, texts, tags, publisher_url; ``every_body`` as in ``split_entries``."""
    parsed = F.from_xml(F.regexp_replace("xml", r"(</?)[A-Za-z]+:", "$1"), ENTRY_SCHEMA, {"columnNameOfCorruptRecord": "_corrupt"})
    e = F.col("e")
    link = F.coalesce(
        F.get(F.filter(e["link"], lambda x: x["_href"].isNotNull() & (F.coalesce(x["_rel"], F.lit("alternate")) == "alternate")), 0)["_href"],
        F.get(F.filter(e["link"], lambda x: F.coalesce(x["_VALUE"], F.lit("")) != ""), 0)["_VALUE"],
    )
    bodies = F.concat(F.coalesce(e["encoded"], F.array().cast("array<string>")), F.coalesce(e["content"], F.array().cast("array<string>")))
    return split_entries(responses, every_body).withColumn("e", parsed).select(
        *[c for c in responses.columns if c != "body"], *(["unreadable"] if every_body else []), "position",
        F.coalesce(e["title"], F.lit("")).alias("title"), F.trim(F.coalesce(link, F.lit(""))).alias("link"),
        F.coalesce(e["guid"], e["id"], F.lit("")).alias("entry_id"),
        parse_feed_date(e["pubDate"], e["published"], e["updated"], e["date"], e["created"]).alias("published_at"),
        F.coalesce(e["summary"], F.lit("")).alias("summary_text"), F.coalesce(e["description"], F.lit("")).alias("description_text"),
        bodies.alias("content"),
        F.transform(F.coalesce(e["category"], F.array().cast("array<struct<_VALUE:string,_term:string>>")), lambda c: F.coalesce(c["_term"], c["_VALUE"])).alias("tags"),
        F.coalesce(e["source"]["_url"], F.lit("")).alias("publisher_url"),
    )


def is_unreadable(body: Column) -> Column:
    """No feed at all: not one entry, and no readable feed around it.  A null body is unreadable."""
    root = body.rlike(r"(?s)<(?:rss|feed|rdf:RDF)\b.*</(?:rss|feed|rdf:RDF)>\s*$")
    return F.when(body.rlike(ENTRY_PATTERN), F.lit(False)).otherwise(F.coalesce(~root, F.lit(True)))


def feed_errors(responses: DataFrame) -> DataFrame:
    return responses.where(is_unreadable(F.col("body"))).drop("body")


RECORD_COLUMNS = ("agency", "agency_en", "unit_category", "title", "link", "published_at", "summary", "source_feed", "content_type")


def judged_entries(
    entries: DataFrame, sources: DataFrame, since: Column, until: Column | None, check_host: bool = False, carried: tuple[str, ...] = (),
) -> DataFrame:
    """Every entry of a known source as a record, with ``kept`` (dated, allowed, titled) and ``candidate``.

    ``sources``: source_id, agency, agency_en, homepage, patterns, official_urls.  Entries that are not kept have no summary.
    ``carried`` names columns of the entries that go along.
    """
    allowed = link_allowed(F.col("link"), F.col("patterns"), F.col("homepage"))
    if check_host:
        allowed = allowed & official_host(F.col("link"), F.col("official_urls"))
    title, stamp = clean_text(F.col("title")), F.col("published_at")
    kept = F.coalesce(in_period(stamp, since, until), F.lit(False)) & (F.col("link") != "") & allowed & (title != "")
    kind = F.when(F.endswith("source_id", F.lit(":judgments")), F.lit("judgment")).otherwise(content_type(F.col("link"), F.col("title")))
    summary = entry_summary(F.col("summary_text"), F.col("description_text"), F.col("content"))
    flagged = entries.join(sources, "source_id").withColumns({
        "kept": F.coalesce(kept, F.lit(False)), "candidate": F.coalesce(is_candidate(stamp, F.col("link"), allowed, since, until), F.lit(False)), "title": title,
    })
    return flagged.withColumns({
        "unit_category": F.col("source_id"), "source_feed": F.col("url"), "content_type": kind, "summary": F.when(F.col("kept"), summary),
    }).select("source_id", "kept", "candidate", *carried, *RECORD_COLUMNS)


def feed_records(entries: DataFrame, sources: DataFrame, since: Column, until: Column | None, check_host: bool = False) -> DataFrame:
    """Dated, allowed entries as records; ``sources`` as in :func:`judged_entries`."""
    return judged_entries(entries, sources, since, until, check_host).where("kept").select(*RECORD_COLUMNS)


def briefing_records(entries: DataFrame, since: Column, document_type: str = "Research Briefing") -> DataFrame:
    """Feed entries of the briefing publishers; ``entries`` also carries publisher, feed_url, page_no."""
    rows = entries.where(F.col("published_at") >= since).withColumn(
        "identifier", briefing_identifier(F.col("link"), F.col("entry_id"), clean_text(F.col("title")))
    )
    summary = text_or(F.col("summary_text"), F.col("description_text"))
    return rows.select(
        "published_at", F.coalesce(F.element_at(literal_map(V.CHAMBERS), F.col("publisher")), F.lit("")).alias("chamber"), "publisher",
        clean_text(F.col("title")).alias("title"), clean_text(summary).alias("summary"), "identifier", F.col("link").alias("webpage_url"),
        briefing_pdf_url(F.array_join("content", " "), F.col("identifier")).alias("pdf_url"), feed_topics(F.col("tags")).alias("topics"),
        F.lit(document_type).alias("document_type"), F.concat(F.lit("Official RSS: "), "feed_url").alias("fetched_from"),
        F.struct("page_no", "position").alias("arrival_seq"),
    )
