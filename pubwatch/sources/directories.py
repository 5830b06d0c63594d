"""Directories of public bodies: landed pages to listed-only catalogue rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pubwatch import fixed_values as V
from pubwatch.functions.text import slugify
from pubwatch.functions.urls import url_join
from pubwatch.operators.catalog import directory_entry, first_per_id, suffix_collisions, union_catalog
from pubwatch.sources import html as H
from pubwatch.sources.cards import CARD, NODES, _cards, _with

_COLUMNS = ["id", "name_en", "name_zh", "jurisdiction", "kind", "homepage", "status", "adapter", "feed", "provenance", "reason"]


def _place():
    """Order of a row over all pages of a directory."""
    return F.struct(F.col("page_url"), F.col("position").cast("bigint").alias("position")).alias("position")


def scotland_bodies(pages: DataFrame) -> DataFrame:
    """One row per h3 heading; its homepage is the first outside link before the next heading.

    ``pages``: page_url, body, kind.
    """
    headings = _cards(H.with_nodes(pages), H.select("h3"))
    rows = _with(headings, name=H.text_of(CARD), stop=f"coalesce(array_min(transform(filter({NODES}, n -> n.tag = 'h3' and n.parent = card.parent and n.pre > card.pre), n -> n.pre)), if(card.parent >= 0, get({NODES}, card.parent).post + 1, 2147483647))")
    link = f"get(filter({NODES}, n -> n.pre > card.post and n.pre < stop and n.parent <> card.parent and {H.css('a[href^=http]', 'n')}), 0)"
    rows = _with(rows, link=link).where("name <> ''").withColumn("homepage", F.coalesce(F.expr("link.attrs['href']"), F.col("page_url")))
    return rows.select(*directory_entry("scotland", F.col("name"), F.lit("Scotland"), F.col("kind"), F.col("homepage"), F.col("page_url")), _place())


def wales_bodies(pages: DataFrame) -> DataFrame:
    """Index items except local government; the id comes from the link, not the name."""
    items = _cards(H.with_nodes(pages), H.select("li.index-list__item"))
    rows = _with(items, anchor=H.first(".index-list__title a[href]", CARD), type=H.first(".index-list__type", CARD)).where("anchor is not null")
    rows = _with(rows, kind=f"if(type is null, 'Other', {H.text_of('type')})", name=H.text_of("anchor"), href=H.attr("anchor", "href")).where("kind <> 'Local government'")
    homepage = url_join(F.lit(V.WALES_DIRECTORY), F.col("href"))
    entry = rows.select(*directory_entry("wales", F.col("name"), F.lit("Wales"), F.col("kind"), homepage, F.lit(V.WALES_DIRECTORY)), "href", _place())
    return entry.withColumn("id", F.concat(F.lit("wales:"), F.replace(F.regexp_replace("href", "^/+|/+$", ""), F.lit("/"), F.lit("-")))).drop("href")


def ni_departments(pages: DataFrame) -> DataFrame:
    links = _with(_cards(H.with_nodes(pages), H.select("article li a[href]")), name=H.text_of(CARD), href=H.attr(CARD, "href"))
    rows = links.where("name like 'Department%' or name = 'The Executive Office'")
    homepage = url_join(F.lit(V.NI_DEPARTMENTS), F.col("href"))
    return rows.select(*directory_entry("ni", F.col("name"), F.lit("Northern Ireland"), F.lit("Government department"), homepage, F.lit(V.NI_DEPARTMENTS)), _place())


def ni_bodies(pages: DataFrame) -> DataFrame:
    """Items of the content lists: the leading text of an item, and every nested item."""
    items = _cards(H.with_nodes(pages), H.select("main .content ul li"))
    leading = "get(filter(dom.texts, p -> p.pos > card.pre and p.pos <= card.post and not p.raw), 0).text"
    rows = _with(items, name=f"coalesce({leading}, '')").where("name <> '' and name not like '%:'")
    return rows.select(*directory_entry("ni", F.col("name"), F.lit("Northern Ireland"), F.lit("Public body"), F.lit(V.NI_BODIES), F.lit(V.NI_BODIES)), _place())


def ew_courts(pages: DataFrame) -> DataFrame:
    links = _with(_cards(H.with_nodes(pages), H.select("main .organogram a[href]")), name=H.text_of(CARD), href=H.attr(CARD, "href")).where("name <> ''")
    place = F.when(F.contains("name", F.lit("Supreme Court")), F.lit("UK")).otherwise(F.lit("England and Wales"))
    homepage = url_join(F.lit(V.EW_COURTS), F.col("href"))
    rows = links.select(*directory_entry("court-ew", F.col("name"), place, F.lit("Court or tribunal"), homepage, F.lit(V.EW_COURTS)), _place())
    return suffix_collisions(rows)


def literal_rows(spark: SparkSession) -> DataFrame:
    """Rows that no landed page carries: reviewed names, courts of three jurisdictions, court feeds."""
    rows = [("ni", n, "Northern Ireland", "Public body", V.NI_FINANCE_DIRECTORY, V.NI_FINANCE_DIRECTORY) for n in V.NI_FINANCE_BODIES]
    rows += [("court-scotland", n, "Scotland", "Court or tribunal", u, V.SCOTLAND_COURTS) for n, u in V.SCOTLAND_COURT_PAGES.items()]
    rows += [("court-wales", n, "Wales", "Tribunal", V.WALES_TRIBUNALS, V.WALES_TRIBUNALS) for n in V.WALES_TRIBUNAL_NAMES]
    rows += [("court-ni", n, "Northern Ireland", "Court or tribunal", V.NI_COURTS, V.NI_COURTS_EVIDENCE) for n in V.NI_COURT_NAMES]
    plain = spark.createDataFrame(rows, "prefix string, name string, jurisdiction string, kind string, homepage string, provenance string").select(
        F.concat_ws(":", "prefix", slugify(F.col("name"))).alias("id"), F.col("name").alias("name_en"), F.lit("").alias("name_zh"), "jurisdiction", "kind",
        "homepage", F.lit("directory_only").alias("status"), F.lit("").alias("adapter"), F.lit("").alias("feed"), "provenance", F.lit(V.UNVERIFIED_REASON).alias("reason"),
    )
    feeds = spark.createDataFrame(
        [(i, n, "", j, "Official judicial publication", h, "searchable", "feed", f, p, "") for i, (n, j, h, f, p) in V.COURT_FEEDS.items()],
        ", ".join(f"{c} string" for c in _COLUMNS),
    )
    return plain.unionByName(feeds)


def scan_directories(spark: SparkSession, landed: dict[str, DataFrame]) -> DataFrame:
    """All directories in one catalogue table; the first row of an id wins, literal rows come last."""
    readers = {"scotland": scotland_bodies, "wales": wales_bodies, "ni_departments": ni_departments, "ni_bodies": ni_bodies, "courts": ew_courts}
    parts = [
        readers[name](pages).select(*_COLUMNS, F.struct(F.lit(i).alias("part"), F.col("position").alias("place")).alias("position"))
        for i, (name, pages) in enumerate(landed.items())
    ]
    nowhere = F.struct(F.lit("").alias("page_url"), F.lit(0).cast("bigint").alias("position"))
    literal = literal_rows(spark).withColumn("position", F.struct(F.lit(99).alias("part"), nowhere.alias("place")))
    return first_per_id(union_catalog(*parts, literal)).drop("position")
