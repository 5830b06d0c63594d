"""Queries: sources over landed bodies that Spark builds from the given tables, and streaming twins."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import functions as F

from pubwatch import fixed_values as V
from pubwatch.functions.dates import utc_text
from pubwatch.functions.text import clean_text
from pubwatch.operators.runs import limit_history, validate_summary
from pubwatch.session import checkpoint_folder
from pubwatch.sinks import reports
from pubwatch.sources import cards, directories, feeds, payloads
from pubwatch.streaming import live
from pubwatch.workload import tables as T
from pubwatch.workload.matching_sql import matching_ctes
from pubwatch.workload.records import HOMEPAGE, P, SINCE, UNTIL
from pubwatch.workload.registry import query
from pubwatch.workload.scalars import SCHEME_HOST, decoded
from pubwatch.workload.tables import text_ts, with_tables

# --- feeds ----------------------------------------------------------------------------------------------------


def _xml(column: str) -> str:
    return f"replace(replace({column}, '&', '&amp;'), '<', '&lt;')"


def feed_bodies(t):
    """One landed feed per document: a full item, an item without title, and every seventh body is no feed."""
    stamp = "date_format(published_at, \"EEE, dd MMM yyyy HH:mm:ss 'GMT'\")"
    body = f"""if(doc_id % 7 = 3, concat('<html>', {_xml('title')}, '</html>'), concat('<?xml version="1.0"?><rss version="2.0"><channel><title>Feed</title><item><title>', {_xml(_xml('title'))}, '</title><link>', {_xml('link')}, '</link><guid>CBP-', doc_id,
      '</guid><pubDate>', {stamp}, '</pubDate><description>', {_xml(_xml('summary'))}, '</description><category>', lang, '</category></item><item><link>https://x.example/', doc_id, '</link><pubDate>', {stamp}, '</pubDate></item></channel>', if(doc_id % 5 = 0, '', '</rss>')))"""
    return t.spread(t.news).selectExpr("doc_id", "source AS source_id", "source_feed AS url", f"{body} AS body")


@query("scan_feed", with_tables(T.NEWS) + f"""SELECT doc_id, 0 AS position, {T.squeeze('title')} AS title, link, {text_ts('published_at')} AS published, 'CBP-' || CAST(doc_id AS VARCHAR) AS entry_id, lang AS tags FROM news WHERE doc_id % 7 <> 3
  UNION ALL SELECT doc_id, 1, '', 'https://x.example/' || CAST(doc_id AS VARCHAR), {text_ts('published_at')}, '', '' FROM news WHERE doc_id % 7 <> 3""")
def _(t):
    rows = feeds.scan_feed(feed_bodies(t))
    return rows.select("doc_id", "position", clean_text(F.col("title")).alias("title"), "link", utc_text(F.col("published_at")).alias("published"), "entry_id", F.array_join("tags", "|").alias("tags"))


@query("scan_feed_errors", with_tables(T.NEWS) + "SELECT doc_id FROM news WHERE doc_id % 7 = 3")
def _(t):
    return feeds.feed_errors(feed_bodies(t)).select("doc_id")


@query("feed_records", with_tables(T.NEWS) + f"""SELECT agency, link, {T.squeeze('title')} AS title, md5({T.squeeze('summary')}) AS summary_md5 FROM news WHERE doc_id % 7 <> 3 AND published_at >= {SINCE} AND published_at < {UNTIL} AND link <> '' AND NOT {HOMEPAGE}
  AND link <> 'https://www.gov.uk/government/news/' || CAST(CAST(substr(source, 4) AS INTEGER) AS VARCHAR) AND {T.squeeze('title')} <> ''""")
def _(t):
    sources = t.sources.selectExpr("source_id", "display_name AS agency", "name_en AS agency_en", "homepage", "array('/') AS patterns", "array('https://www.gov.uk/') AS official_urls")
    rows = feeds.feed_records(feeds.scan_feed(feed_bodies(t)), sources, t.since, t.until, check_host=True)
    return rows.select("agency", "link", "title", F.md5("summary").alias("summary_md5"))


@query("scan_briefings_feed", with_tables(T.NEWS) + f"""SELECT doc_id, 'CBP-' || CAST(doc_id AS VARCHAR) AS identifier, '{V.BRIEFING_PDF_ROOT}CBP-' || CAST(doc_id AS VARCHAR) || '/CBP-' || CAST(doc_id AS VARCHAR) || '.pdf' AS pdf_url, 'House of Lords' AS chamber, lang AS topics
  FROM news WHERE doc_id % 7 <> 3 AND published_at >= {SINCE}""")
def _(t):
    entries = feeds.scan_feed(feed_bodies(t)).where("position = 0").withColumns({"publisher": F.lit("House of Lords Library"), "feed_url": F.col("url"), "page_no": F.lit(1), "link": F.lit("https://l.example/")})
    rows = feeds.briefing_records(entries, t.since)
    return rows.select(F.expr("cast(substr(identifier, 5) AS bigint)").alias("doc_id"), "identifier", "pdf_url", "chamber", F.array_join("topics", "|").alias("topics"))


# --- JSON -------------------------------------------------------------------------------------------------------


def _search_bodies(t):
    result = """named_struct('link', if(doc_id % 9 = 0, null, replace(link, 'https://www.gov.uk', '')), 'title', if(doc_id % 11 = 0, '', concat('R ', title)), 'description', summary,
      'public_timestamp', case when doc_id % 13 = 0 then '' when doc_id % 17 = 0 then 'soon' else date_format(published_at, "yyyy-MM-dd'T'HH:mm:ss'Z'") end, 'format', if(doc_id % 4 = 0, 'tribunal_decision', 'news_story'))"""
    return t.spread(t.news).selectExpr("doc_id", "source AS source_id", f"to_json(named_struct('results', array({result}), 'total', 1)) AS body", "array('/guidance/', '/government/news/') AS patterns", "'' AS homepage")


@query("scan_search_api", with_tables(T.NEWS) + f"""SELECT doc_id, coalesce(CASE WHEN doc_id % 9 = 0 OR link = '' THEN 'missing_link' WHEN NOT ((NOT {HOMEPAGE} AND (contains(link, '/guidance/') OR contains(link, '/government/news/'))) OR doc_id % 4 = 0) THEN 'path_not_allowed' WHEN doc_id % 13 = 0 THEN 'missing_date'
  WHEN doc_id % 17 = 0 THEN 'bad_date' WHEN published_at < {SINCE} OR published_at >= {UNTIL} THEN 'out_of_period' WHEN doc_id % 11 = 0 THEN 'missing_title' END, 'kept') AS reason FROM news""")
def _(t):
    rows = payloads.scan_search_api(_search_bodies(t), t.since, t.until)
    return rows.select("doc_id", F.coalesce("reason", F.lit("kept")).alias("reason"))


def _briefing_bodies(t):
    item = """named_struct('publisher', named_struct('prefLabel', named_struct('_value', publisher)), 'date', named_struct('_value', date_format(published_at, 'yyyy-MM-dd')), 'title', concat('T ', title), '_about', concat('http://data.example/', conv_id),
      'identifier', identifier, 'topic', array(named_struct('prefLabel', chamber), named_struct('prefLabel', 'Common')))"""
    body = f"case when conv_id % 11 = 0 then '[]' when conv_id % 13 = 0 then '{{\"result\":{{\"items\":{{}}}}}}' else to_json(named_struct('result', named_struct('items', array({item})))) end"
    return t.spread(t.briefings).selectExpr("conv_id", "turn", f"{body} AS body")


@query("scan_briefings_api", with_tables(T.BRIEFINGS) + f"""SELECT conv_id, turn, publisher, chamber, {T.squeeze("'T ' || title")} AS title, strftime(published_at, '%Y-%m-%d 00:00:00') AS published, chamber || '|Common' AS topics, identifier FROM briefings WHERE conv_id % 11 <> 0 AND conv_id % 13 <> 0""")
def _(t):
    rows = payloads.scan_briefings_api(_briefing_bodies(t))
    return rows.select("conv_id", "turn", "publisher", "chamber", "title", utc_text(F.col("published_at")).alias("published"), F.array_join("topics", "|").alias("topics"), "identifier")


@query("briefings_contract", "SELECT conv_id, turn, CASE WHEN conv_id % 11 = 0 THEN 'payload must be an object' ELSE 'result.items must be a list' END AS contract FROM conversations WHERE conv_id % 11 = 0 OR conv_id % 13 = 0")
def _(t):
    return payloads.briefing_payloads(_briefing_bodies(t)).where("contract is not null").select("conv_id", "turn", "contract")


@query("scan_catalog", with_tables(T.CATALOG) + "SELECT id, name_en FROM catalog")
def _(t):
    documents = t.catalog.select(F.lit(1).alias("schema_version"), F.array(F.struct("id", "name_en")).alias("sources"))
    folder = f"{checkpoint_folder(t.spark)}/catalogue-{uuid.uuid4().hex}"
    documents.write.json(folder)
    return payloads.scan_catalog(t.spark, folder, one_document=False).select("id", "name_en")


@query("scan_run_data", "SELECT doc_id FROM documents WHERE doc_id % 3 = 1")
def _(t):
    folder = f"{checkpoint_folder(t.spark)}/runs-{uuid.uuid4().hex}"
    t.read("documents").select("doc_id", F.concat(F.lit("run-"), F.col("doc_id") % 3).alias("run_id")).write.partitionBy("run_id").parquet(folder)
    return payloads.scan_run_data(t.spark, folder, "run-1").select("doc_id")


@query("append_run_history", "SELECT o_orderpriority AS kind_of_run, count(*) AS lines FROM orders GROUP BY 1")
def _(t):
    folder = f"{checkpoint_folder(t.spark)}/history-{uuid.uuid4().hex}"
    rows = t.read("orders").select("o_orderkey", "o_orderpriority")
    reports.append_run_history(rows.where("o_orderkey % 2 = 0"), folder)
    reports.append_run_history(rows.where("o_orderkey % 2 = 1"), folder)
    lines = t.spark.read.schema("recorded_at string, kind string, payload struct<o_orderkey:bigint,o_orderpriority:string>").json(folder).where("kind = 'run-summary' AND recorded_at is not null")
    return lines.groupBy(F.col("payload.o_orderpriority").alias("kind_of_run")).agg(F.count("*").alias("lines"))


@query("write_run_summary", with_tables(T.RUNS) + "SELECT run_id, status FROM runs")
def _(t):
    folder = f"{checkpoint_folder(t.spark)}/summary-{uuid.uuid4().hex}"
    rows = t.runs.withColumn("delivery_id", F.col("data_fingerprint")).drop("generated_at")
    reports.write_run_summary(rows, folder)
    return t.spark.read.schema("run_id string, status string").json(folder)


@query("scan_run_history", "SELECT CAST(o_orderkey AS VARCHAR) AS delivery_id FROM orders WHERE o_orderkey % 4 <> 0 ORDER BY CAST(o_orderkey AS VARCHAR) LIMIT 30")
def _(t):
    folder = f"{checkpoint_folder(t.spark)}/history-{uuid.uuid4().hex}"
    rows = t.runs.withColumns({
        "delivery_id": F.col("o_orderkey").cast("string"), "run_id": F.expr("if(o_orderkey % 4 = 0, '', run_id)"), "period_start": F.lit("2024-01-01"), "period_end": F.lit("2024-01-07"),
        "generated_at": F.lit("2024-01-08T00:00:00Z"),
    })
    rows.write.json(folder)
    history = t.spark.read.schema(payloads.RUN_SCHEMA).json(folder)
    sound = validate_summary(history).where("size(broken) = 0")
    return limit_history(sound, "generated_at", "delivery_id").select("delivery_id")


# --- HTML ---------------------------------------------------------------------------------------------------------

CARD_DATE = "TIMESTAMP '2024-01-01' + to_days(CAST(page_id % 40 AS INTEGER))"
CARD_WHERE = f"{CARD_DATE} >= {SINCE} AND {CARD_DATE} < {UNTIL}"


def _card_pages(t):
    """The given pages with a dated, linked heading put into their article."""
    card = "concat('<article><h2><a href=\"/news/', page_id, '\">Official announcement number ', page_id, '</a></h2><time datetime=\"', date_format(date_add(date'2024-01-01', int(page_id % 40)), 'yyyy-MM-dd'), '\">day</time>')"
    return t.spread(t.read("pages")).selectExpr("page_id", "'page-source' AS source_id", "url AS page_url", f"replace(html, '<article>', {card}) AS body", "'' AS homepage", "array('/news/') AS patterns")


CARDS_SQL = f"SELECT url AS page_url, 'Official announcement number ' || CAST(page_id AS VARCHAR) AS title, {SCHEME_HOST} || '/news/' || CAST(page_id AS VARCHAR) AS link, {text_ts(CARD_DATE)} AS published FROM pages WHERE {CARD_WHERE}"


@query("html_index_cards", CARDS_SQL)
def _(t):
    rows = cards.index_cards(_card_pages(t).drop("homepage", "patterns"), t.since, t.until)
    return rows.select("page_url", "title", "link", utc_text(F.col("published_at")).alias("published"))


@query("html_official_cards", CARDS_SQL.replace(CARD_WHERE, f"{CARD_DATE} >= {SINCE}"))
def _(t):
    return cards.official_cards(_card_pages(t), t.since).select("page_url", "title", "link", utc_text(F.col("published_at")).alias("published"))


@query("html_generic_links", CARDS_SQL.replace(CARD_WHERE, f"{CARD_DATE} >= {SINCE}"))
def _(t):
    return cards.generic_links(_card_pages(t), t.since).select("page_url", "title", "link", utc_text(F.col("published_at")).alias("published"))


HEADING = T.squeeze(decoded("regexp_replace(regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1), '(?s)</?[A-Za-z][^>]*>', ' ', 'g')"))
TITLED = f"length({HEADING}) >= 12"


@query("html_page_item", f"SELECT url AS page_url, {text_ts(CARD_DATE)} AS published, {HEADING} AS title FROM pages WHERE {TITLED}")
def _(t):
    pages = _card_pages(t).withColumn("body", F.regexp_replace("body", "<head>", F.lit('<head><meta property="article:published_time" content="2020-01-01">')))
    rows = cards.page_items(pages)
    return rows.select("page_url", utc_text(F.col("published_at")).alias("published"), "title")


@query("html_summary", "SELECT url AS page_url, 'About page ' || CAST(page_id AS VARCHAR) AS summary FROM pages WHERE " + TITLED)
def _(t):
    described = F.expr("replace(body, '<head>', concat('<head><meta property=\"datePublished\" content=\"2020-01-01\"><meta name=\"description\" content=\"About page ', page_id, '\">'))")
    return cards.page_items(_card_pages(t).withColumn("body", described)).select("page_url", "summary")


@query("html_date", f"SELECT url AS page_url, '2021-05-0' || CAST(page_id % 3 + 1 AS VARCHAR) || ' 00:00:00' AS published FROM pages WHERE {TITLED}")
def _(t):
    dated = F.expr("""replace(html, '<head>', concat('<head>', case page_id % 3 when 0 then '<script type="application/ld+json">{"datePublished":"2021-05-01"}</script>' when 1 then '<meta property="article:published_time" content="2021-05-02"><script type="application/ld+json">{}</script>'
      else '<script type="application/ld+json">[]</script>' end)) """)
    written = F.when(F.col("page_id") % 3 == 2, F.regexp_replace(dated, "<article>", "<article><p>Published: 3 May 2021</p>")).otherwise(dated)
    pages = t.spread(t.read("pages")).select(F.lit("s").alias("source_id"), F.col("url").alias("page_url"), written.alias("body"), F.lit("").alias("homepage"))
    return cards.page_items(pages).select("page_url", utc_text(F.col("published_at")).alias("published"))


@query("html_source_adapters", f"SELECT url AS page_url, CASE page_id % 3 WHEN 0 THEN 'Electoral Commission' WHEN 1 THEN 'NPSA' ELSE 'Ofcom' END AS source_id, 'Adapter record number ' || CAST(page_id AS VARCHAR) AS title, '2024-03-09 00:00:00' AS published FROM pages")
def _(t):
    card = F.expr("""case page_id % 3 when 0 then concat('<article class="c-teaser big"><a href="/n/1"><span class="c-teaser__title">Adapter record number ', page_id, '</span></a><time datetime="2024-03-09">x</time></article>')
      when 1 then concat('<div class="views-row"><h3><a href="/n/1">Adapter record number ', page_id, '</a></h3>Blog publish date is 09/03/2024</div>') else concat('<a href="/n/1">Adapter record number ', page_id, ' Published: 9 March 2024</a>') end""")
    pages = t.spread(t.read("pages")).select("page_id", F.col("url").alias("page_url"), F.expr("case page_id % 3 when 0 then 'Electoral Commission' when 1 then 'NPSA' else 'Ofcom' end").alias("source_id"), F.concat("html", card).alias("body"))
    return cards.adapter_cards(pages, t.since).select("page_url", "source_id", "title", utc_text(F.col("published_at")).alias("published"))


@query("html_sibling_cards", f"SELECT url AS page_url, {SCHEME_HOST} || '/a?article=' || CAST(page_id AS VARCHAR) AS link, 'Summary ' || CAST(page_id AS VARCHAR) AS summary FROM pages")
def _(t):
    block = F.expr("""concat(html, '<div class="news-short-article"><div class="news-short-article-date">9 January 2024</div><div class="news-short-article-intro"><a href="/a?article=', page_id, '">Official sibling announcement</a></div><div class="news-short-article-text">Summary ', page_id,
      '</div><div class="news-short-article-intro"><a href="/a?article=undated">Undated sibling announcement</a></div></div>')""")
    pages = t.spread(t.read("pages")).select(F.lit("s").alias("source_id"), F.col("url").alias("page_url"), block.alias("body"))
    return cards.sibling_cards(pages, t.since, t.until).select("page_url", "link", "summary")


@query("briefing_topic_cards", "SELECT url AS page_url, 'CBP-' || CAST(page_id AS VARCHAR) AS identifier, 'Tech' AS topics, 'Research' AS document_type, 'Short text' AS summary FROM pages")
def _(t):
    card = F.expr("""concat(html, '<article class="card"><div class="card__heading"><a href="/research-briefings/cbp-', page_id, '/">Briefing title</a></div><div class="card__date"><time datetime="2024-01-09">x</time></div><p>Short text</p>
      <ul class="tag-list"><li><a href="/topic/tech/">Tech</a></li><li><a href="/type/research/">Research</a></li></ul></article>')""")
    pages = t.spread(t.read("pages")).select(F.lit("https://archive.example/").alias("archive_url"), F.col("url").alias("page_url"), card.alias("body"), F.lit("House of Lords").alias("chamber"), F.lit("House of Lords Library").alias("publisher"))
    return cards.briefing_cards(pages).select("page_url", "identifier", F.array_join("topics", "|").alias("topics"), "document_type", "summary")


@query("html_in_range_date", f"SELECT url AS page_url, {CARD_DATE} >= TIMESTAMP '2024-01-09' AND {CARD_DATE} < TIMESTAMP '2024-01-23' AS in_range FROM pages")
def _(t):
    days = {"start_day": F.lit("2024-01-09").cast("date"), "end_day": F.lit("2024-01-23").cast("date")}
    return cards.in_range_dates(_card_pages(t).withColumns(days))


def _link_pages(t):
    head = """concat('<head><link rel="alternate" type="application/rss+xml" href="/feed/', page_id, '"><link rel="alternate" type="application/atom+xml" href="/atom"><link rel="stylesheet" href="/s.css">')"""
    foot = """concat('<a href="/rss/all.xml">All items</a><a href="/latest">Latest news</a><a href="/newsroom/">Room</a><a href="https://body', page_id, '.example/">Body ', page_id, '</a></article>')"""
    return t.spread(t.read("pages")).selectExpr("page_id", "url AS page_url", f"replace(replace(html, '<head>', {head}), '</article>', {foot}) AS body", "concat('Body ', page_id) AS name_en", "false AS shared", "false AS context")


# Two of the given pages may have one url.
PAGE = ("page_id", "page_url")


@query("discover_feeds", f"SELECT url AS page_url, {SCHEME_HOST} || '/feed/' || CAST(page_id AS VARCHAR) || '|' || {SCHEME_HOST} || '/atom' AS feed_urls FROM pages")
def _(t):
    return cards.discover_feeds(cards.page_links(_link_pages(t)), PAGE).select("page_url", F.array_join("feed_urls", "|").alias("feed_urls"))


@query("advertised_feeds", f"SELECT url AS page_url, {SCHEME_HOST} || '/feed/' || CAST(page_id AS VARCHAR) || '|' || {SCHEME_HOST} || '/atom|' || {SCHEME_HOST} || '/rss/all.xml' AS feed_urls FROM pages")
def _(t):
    return cards.advertised_feeds(cards.page_links(_link_pages(t)), PAGE).select("page_url", F.array_join("feed_urls", "|").alias("feed_urls"))


@query("body_feeds", f"SELECT CASE WHEN page_id % 4 = 0 THEN '{V.TEXT_FEED_URL}' ELSE '' END AS feed_urls, count(*) AS pages FROM pages GROUP BY 1")
def _(t):
    pages = t.read("pages").select(
        F.when(F.col("page_id") % 4 == 0, F.lit(V.TEXT_FEED_BODY)).otherwise(F.lit("other")).alias("id"), F.lit(V.TEXT_FEED_PAGE + "/").alias("page_url"), F.concat("html", F.lit(V.TEXT_FEED_URL)).alias("body")
    )
    return cards.text_feeds(pages).groupBy(F.array_join("feed_urls", "|").alias("feed_urls")).agg(F.count("*").alias("pages"))


@query("news_links_top3", f"SELECT url AS page_url, {SCHEME_HOST} || '/latest' AS url, 0 AS rank, 1 AS place FROM pages UNION ALL SELECT url, {SCHEME_HOST} || '/newsroom/', 1, 2 FROM pages")
def _(t):
    return cards.news_links(cards.page_links(_link_pages(t)), page=PAGE).drop("page_id")


@query("topk_links", f"SELECT url AS page_url, {SCHEME_HOST} || '/latest' AS url FROM pages")
def _(t):
    return cards.news_links(cards.page_links(_link_pages(t)), 1, PAGE).select("page_url", "url")


@query("candidate_sites", "SELECT url AS page_url, 'https://body' || CAST(page_id AS VARCHAR) || '.example/' AS url FROM pages")
def _(t):
    return cards.candidate_sites(cards.page_links(_link_pages(t)), page=PAGE).select("page_url", "url")


DIRECTORY_COUNTS = """SELECT prefix, CAST(sum(n) AS BIGINT) AS bodies FROM (SELECT 'scotland' AS prefix, count(*) AS n FROM pages UNION ALL SELECT 'wales', count(*) FROM pages UNION ALL SELECT 'court-ew', count(*) + 2 FROM pages
  UNION ALL SELECT unnest(['ni', 'court-scotland', 'court-wales', 'court-ni']), unnest([23, 9, 6, 6])) GROUP BY prefix"""


@query("scan_directories", DIRECTORY_COUNTS)
def _(t):
    pages = t.spread(t.read("pages"))
    welsh = pages.select(F.col("url").alias("page_url"), F.expr("concat(html, '<ul><li class=\"index-list__item\"><div class=\"index-list__title\"><a href=\"/body-', page_id, '\">Welsh body ', page_id, '</a></div><span class=\"index-list__type\">Board</span></li></ul>')").alias("body"))
    scottish = pages.select(F.col("url").alias("page_url"), F.expr("concat(html, '<h3>Scottish body ', page_id, '</h3><p><a href=\"https://s', page_id, '.example/\">site</a></p>')").alias("body"), F.lit("Board").alias("kind"))
    courts = pages.select(F.col("url").alias("page_url"), F.expr("concat('<main><div class=\"organogram\"><a href=\"/courts/c', page_id, '/\">Court ', page_id div 2, '</a></div></main>', html)").alias("body"))
    found = directories.scan_directories(t.spark, {"scotland": scottish, "wales": welsh, "courts": courts})
    return found.groupBy(F.substring_index("id", ":", 1).alias("prefix")).agg(F.count("*").alias("bodies"))


# --- streams ----------------------------------------------------------------------------------------------------------


def _stream(t, table: str):
    # A pattern, because a table may be one file or a folder of part files; a plain path must be a folder.
    schema = t.read(table).schema
    return t.spark.readStream.schema(schema).parquet(f"{t.folder}/{{{table}}}.parquet")


def _finished(t, stream, label: str, partition_by=(), settings=()):
    folder = f"{checkpoint_folder(t.spark)}/{label}-{uuid.uuid4().hex}"
    live.run_to_end(stream, folder, partition_by=partition_by, settings=settings)
    return live.read_back(t.spark, stream, folder)


def _streamed_news(t):
    rows = T.Tables(t.spark, t.folder)
    rows.read = lambda name: _stream(t, name)
    return rows.news


@query("stream_dedupe", with_tables(T.NEWS) + f"SELECT count(DISTINCT CASE WHEN link <> '' THEN lower(regexp_replace(link, '/+$', '')) ELSE 'doc' || CAST(doc_id AS VARCHAR) END) AS records FROM news")
def _(t):
    # Every document without a link gets its own title, so the SQL can count keys simply.
    news = _streamed_news(t).withColumn("title", F.when(F.col("link") == "", F.concat(F.lit("doc"), "doc_id")).otherwise(F.col("title")))
    return _finished(t, live.stream_dedupe(news, "60 days").select("record_key"), "stream-dedupe").agg(F.count("*").alias("records"))


@query("stream_health_window", """SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, 'src' || CAST(user_id AS VARCHAR) AS source, count(*) AS checks, count(*) FILTER (event_type <> 'error') AS successes FROM events
  WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 DAY GROUP BY 1, 2""")
def _(t):
    # Days that the watermark has not passed yet are still open and not in the output.
    rows = T.Tables(t.spark, t.folder)
    rows.read = lambda name: _stream(t, name)
    done = _finished(t, live.stream_health_window(rows.health.select("ts", "source", "success", "item_count")), "stream-health")
    return done.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "source", "checks", "successes")


@query("stream_score", with_tables(T.NEWS) + ", " + matching_ctes(P, "news", "doc_id") + f" SELECT doc_id, score AS relevance_score FROM assessed WHERE score >= 12 AND NOT {HOMEPAGE}")
def _(t):
    scored = live.stream_score(_streamed_news(t), P).select("doc_id", "relevance_score")
    return _finished(t, scored, "stream-score")


@query("stream_ledger", """WITH e AS (SELECT 'd' || CAST(o_custkey AS VARCHAR) AS delivery_id, CASE o_orderstatus WHEN 'F' THEN 'sent' WHEN 'O' THEN 'claimed' ELSE 'released' END AS event, o_orderkey AS event_seq, o_orderdate AS seen FROM orders
    WHERE o_orderdate <= (SELECT max(o_orderdate) FROM orders) - INTERVAL 1 DAY),
  c AS (SELECT *, coalesce(lag(event) OVER w = 'claimed', false) AS after_claim FROM e WINDOW w AS (PARTITION BY delivery_id ORDER BY seen, event_seq)),
  s AS (SELECT *, coalesce(bool_or(event = 'sent' AND after_claim) OVER (PARTITION BY delivery_id ORDER BY seen, event_seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS sent FROM c)
  SELECT delivery_id, event_seq, event, NOT sent AND (CASE WHEN event = 'claimed' THEN NOT after_claim ELSE after_claim END) AS accepted,
    CASE WHEN sent THEN 'sent' WHEN event = 'claimed' THEN 'claimed' WHEN after_claim THEN event ELSE '' END AS state FROM s""")
def _(t):
    # Events that the watermark has not passed yet still wait for earlier ones and have no verdict.
    events = _stream(t, "orders").selectExpr(
        "concat('d', o_custkey) AS delivery_id", "case o_orderstatus when 'F' then 'sent' when 'O' then 'claimed' else 'released' end AS event", "o_orderkey AS event_seq",
        "concat('run-', o_custkey) AS run_id", "cast(o_orderdate AS timestamp) AS event_time")
    verdicts = _finished(t, live.stream_ledger(events, keep=pd.Timedelta(days=36500)), "stream-ledger", settings=(live.ROCKSDB,))
    return verdicts.select("delivery_id", "event_seq", "event", "accepted", "state")
