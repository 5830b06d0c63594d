"""Queries: filters, joins, de-duplication, relevance, provenance and the run itself."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from pubwatch import fixed_values as V
from pubwatch.functions.base import bind, sql_let
from pubwatch.functions.dates import utc_text
from pubwatch.functions.text import sql_matching_text
from pubwatch.functions.urls import canonical_url, content_type, is_agency_homepage, url_host
from pubwatch.operators import dedupe, filters, merge, provenance, ranking, relevance
from pubwatch.operators.relevance import KeywordIndex
from pubwatch.plans.publication_run import Run, publication_run, selective_rerun
from pubwatch.session import materialize
from pubwatch.workload import tables as T
from pubwatch.workload.matching_sql import found_sql, joined_phrases, joined_topics, matching_ctes, ordered_phrases
from pubwatch.workload.registry import query
from pubwatch.workload.tables import with_tables

P = T.PROSE_PROFILE
SINCE, UNTIL = f"TIMESTAMP '{T.SINCE}'", f"TIMESTAMP '{T.UNTIL}'"
LINK_FORM = T.fold("regexp_replace(trim(link), '/+$', '')")
NEWS_ORDER = "published_at DESC, CASE WHEN unit_category = '' THEN agency ELSE unit_category END, link, title"
KEYED = f"""keyed AS (SELECT *, CASE WHEN {LINK_FORM} <> '' THEN 'link|' || {LINK_FORM}
  ELSE 'title|' || {T.fold('agency')} || '|' || strftime(published_at, '%Y-%m-%d') || '|' || {T.squeeze(T.fold('title'))} END AS record_key FROM news)"""
DEDUPED = f"deduped AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY record_key ORDER BY {NEWS_ORDER}) AS rn FROM keyed) WHERE rn = 1)"
# Equal times, units, links and titles keep arrival order: the document's number.
ARRIVAL = ("doc_id",)
FIRST_ARRIVED = DEDUPED.replace(NEWS_ORDER, f"{NEWS_ORDER}, doc_id")
HOMEPAGE = "regexp_matches(link, '^https://(www\\.)?gov\\.uk/government/organisations/[^/]*/*$')"


# --- filters ------------------------------------------------------------------------------------------


@query("filter_period", with_tables(T.NEWS) + f"SELECT doc_id, {T.text_ts('published_at')} AS published FROM news WHERE published_at >= {SINCE} AND published_at < {UNTIL}")
def _(t):
    return filters.filter_period(t.news, t.since, t.until).select("doc_id", utc_text(F.col("published_at")).alias("published"))


@query("filter_selected_sources", with_tables(T.NEWS) + f"SELECT doc_id, source FROM news WHERE source IN ({', '.join(repr(s) for s in P.selected_sources)})")
def _(t):
    return relevance.selected_sources(t.news, P, "source").select("doc_id", "source")


@query("filter_link_patterns", with_tables(T.NEWS) + f"""SELECT doc_id, link FROM news WHERE NOT {HOMEPAGE}
  AND (doc_id % 3 = 0 OR contains(link, '/guidance') OR contains(link, '/government/reports/'))""")
def _(t):
    patterns = F.when(F.col("doc_id") % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("/guidance"), F.lit("/government/reports/")))
    return t.news.where(filters.link_allowed(F.col("link"), patterns)).select("doc_id", "link")


HOST = "regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)), '^www\\.', '')"


@query("filter_official_host", f"""SELECT page_id, {HOST} AS host FROM pages WHERE {HOST} IN ('example.com', 'spam-farm.example.org') OR {HOST} LIKE '%.example.com' OR {HOST} LIKE '%.spam-farm.example.org'
  OR 'example.com' LIKE '%.' || {HOST} OR 'spam-farm.example.org' LIKE '%.' || {HOST}""")
def _(t):
    official = F.array(F.lit("https://www.example.com/"), F.lit("https://spam-farm.example.org/x"))
    return t.read("pages").where(filters.official_host(F.col("url"), official)).select("page_id", url_host(F.col("url")).alias("host"))


@query("filter_homepages", with_tables(T.NEWS) + f"SELECT doc_id, {HOMEPAGE} AS homepage FROM news")
def _(t):
    return t.news.select("doc_id", is_agency_homepage(F.col("link")).alias("homepage"))


@query("agg_removed_by_source", with_tables(T.NEWS) + f"SELECT source AS source_id, count(*) AS removed FROM news WHERE {HOMEPAGE} GROUP BY source")
def _(t):
    return filters.split_homepages(t.news.withColumn("source_id", F.col("source")))[1]


@query("adjust_health_counts", with_tables(T.NEWS) + f""", h AS (SELECT source, count(*) AS item_count FROM news GROUP BY source), r AS (SELECT source, count(*) * 4 AS removed FROM news WHERE {HOMEPAGE} GROUP BY source)
  SELECT h.source, CAST(greatest(0, item_count - coalesce(removed, 0)) AS BIGINT) AS item_count FROM h LEFT JOIN r ON h.source = r.source""")
def _(t):
    news = t.news.withColumn("source_id", F.col("source"))
    removed = filters.split_homepages(news)[1].withColumn("removed", F.col("removed") * 4)
    return filters.adjust_health_counts(news.groupBy("source").agg(F.count("*").alias("item_count")), removed)


FALLBACK_ENTRIES = """entries AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'Ofcom' WHEN 1 THEN 'NPSA' WHEN 2 THEN 'Electoral Commission' ELSE 'ICO' END AS source,
  CASE WHEN doc_id % 17 = 2 THEN 'Donation summary' ELSE title END || CASE doc_id % 4 WHEN 0 THEN CASE WHEN doc_id % 8 = 0 THEN ' - Ofcom - www.ofcom.org.uk' ELSE ' - Ofcom' END
    WHEN 1 THEN ' - National Protective Security Authority | NPSA' WHEN 2 THEN ' - Electoral Commission' ELSE ' - ICO' END AS raw_title,
  CASE WHEN doc_id % 3 = 0 THEN 'https://news.google.com/a/' WHEN doc_id % 3 = 1 THEN 'https://ico.org.uk/' ELSE 'https://other.example/' END || CAST(doc_id AS VARCHAR) AS link, published_at,
  CASE WHEN doc_id % 5 = 0 THEN '' WHEN doc_id % 5 = 1 THEN 'https://wrong.example/' ELSE 'https://www.' || CASE doc_id % 4 WHEN 0 THEN 'ofcom.org.uk' WHEN 1 THEN 'npsa.gov.uk' WHEN 2 THEN 'electoralcommission.org.uk' ELSE 'ico.org.uk' END || '/' END AS publisher_url FROM news)"""


@query("filter_fallback_feed", with_tables(T.NEWS, FALLBACK_ENTRIES) + f""", c AS (SELECT *, {T.squeeze('raw_title')} AS ct FROM entries), s AS (SELECT *, trim(regexp_replace(ct,
    CASE source WHEN 'Ofcom' THEN '\\s+-\\s+(Ofcom\\s+-\\s+)?www\\.ofcom\\.org\\.uk$' WHEN 'NPSA' THEN '(?i)\\s+-\\s+National Protective Security Authority(?:\\s+\\|\\s+NPSA)?$'
    WHEN 'Electoral Commission' THEN '(?i)\\s+-\\s+Electoral Commission$' ELSE '(?i)\\s+-\\s+ICO$' END, '')) AS title FROM c)
  SELECT doc_id, source, title FROM s WHERE published_at >= {SINCE} AND published_at < {UNTIL} AND publisher_url <> 'https://wrong.example/'
  AND (link LIKE 'https://news.google.com/%' OR (source = 'ICO' AND link LIKE 'https://ico.org.uk/%')) AND (source <> 'Ofcom' OR contains(ct, 'www.ofcom.org.uk'))
  AND NOT (source = 'Electoral Commission' AND lower(title) LIKE 'donation summary%') AND length(title) >= 12""")
def _(t):
    entries = t.news.selectExpr(
        "doc_id", "case doc_id % 4 when 0 then 'Ofcom' when 1 then 'NPSA' when 2 then 'Electoral Commission' else 'ICO' end AS source",
        "concat(if(doc_id % 17 = 2, 'Donation summary', title), case doc_id % 4 when 0 then if(doc_id % 8 = 0, ' - Ofcom - www.ofcom.org.uk', ' - Ofcom') when 1 then "
        "' - National Protective Security Authority | NPSA' when 2 then ' - Electoral Commission' else ' - ICO' end) AS title",
        "concat(case doc_id % 3 when 0 then 'https://news.google.com/a/' when 1 then 'https://ico.org.uk/' else 'https://other.example/' end, doc_id) AS link", "published_at",
        "case doc_id % 5 when 0 then '' when 1 then 'https://wrong.example/' else concat('https://www.', case doc_id % 4 when 0 then 'ofcom.org.uk' when 1 then 'npsa.gov.uk' when 2 then 'electoralcommission.org.uk' else 'ico.org.uk' end, '/') end AS publisher_url",
        "'' AS homepage",
    )
    return filters.filter_fallback(entries, filters.fallback_rules(t.spark), t.since, t.until).select("doc_id", "source", "title")


@query("govuk_decision_exception", with_tables(T.NEWS) + "SELECT doc_id, doc_id % 6 < 2 AND link LIKE 'https://www.gov.uk/%' AS excepted FROM news")
def _(t):
    kind = F.expr("case doc_id % 6 when 0 then 'Court_Decision' when 1 then 'employment judgment' else 'press_release' end")
    return t.news.select("doc_id", filters.decision_exception(F.col("link"), kind).alias("excepted"))


@query("valid_record", with_tables(T.NEWS) + f"SELECT doc_id, trim(title) <> '' AND link <> '' AND published_at >= {SINCE} AND published_at < {UNTIL} AND NOT {HOMEPAGE} AS valid FROM news")
def _(t):
    return t.news.select("doc_id", filters.valid_record(F.col("title"), F.col("link"), F.col("published_at"), t.since, t.until).alias("valid"))


SCORED_CTES = matching_ctes(P, "news", "doc_id")


@query("filter_results", with_tables(T.NEWS) + ', ' + SCORED_CTES + f""", shown AS (SELECT *, score >= 12 AND NOT {HOMEPAGE} AS included FROM assessed)
  SELECT doc_id, CASE WHEN included THEN score ELSE 0 END AS relevance_score FROM shown
  WHERE included AND score BETWEEN 12 AND 40 AND (kt1 OR ks1 OR kt2 OR ks2 OR kt3 OR ks3 OR kt4 OR ks4 OR kt5 OR ks5 OR kt6 OR ks6 OR kt7 OR ks7 OR kt8 OR ks8 OR kt9 OR ks9 OR kt10 OR ks10 OR kt11 OR ks11 OR kt12 OR ks12 OR kt13 OR ks13)
  AND ({joined_phrases(P, 'kt{i} OR ks{i}', strength='core')}) <> '' AND contains({T.fold("title || ' ' || summary")}, 'tion')
  AND ({joined_topics(P)}) LIKE '%Supply%' AND published_at >= TIMESTAMP '2024-01-05' AND published_at < TIMESTAMP '2024-01-26'""")
def _(t):
    rows = relevance.annotate(t.spread(t.news), P).withColumns({"item_type": F.lit("news"), "source": F.col("agency")})
    wanted = filters.ResultFilters(
        query=" TION ", item_type="news", strength="core", topic="Supply", minimum_score=12, maximum_score=40, date_start=date(2024, 1, 5), date_end=date(2024, 1, 25)
    )
    return filters.filter_results(rows, wanted).select("doc_id", "relevance_score")


@query("sort_results", with_tables(T.NEWS) + ', ' + SCORED_CTES + f""", shown AS (SELECT *, CASE WHEN score >= 12 AND NOT {HOMEPAGE} THEN score ELSE 0 END AS s FROM assessed)
  SELECT row_number() OVER (ORDER BY s DESC, doc_id) AS place, doc_id, s AS relevance_score FROM shown""")
def _(t):
    rows = relevance.annotate(t.spread(t.news), P).withColumns({"item_type": F.lit("news"), "source": F.col("agency")})
    # Written first: a range sort reads its input twice, and the texts are to be scored once.
    scored = materialize(rows.select("doc_id", "relevance_score"), "scored")
    return ranking.number_rows(scored, [F.col("relevance_score").desc(), F.col("doc_id")], "place")


# --- de-duplication --------------------------------------------------------------------------------------


@query("dedupe_news", with_tables(T.NEWS, KEYED, FIRST_ARRIVED) + f"SELECT doc_id, link, {T.text_ts('published_at')} AS published FROM deduped")
def _(t):
    return dedupe.dedupe_news(t.news, ARRIVAL).select("doc_id", "link", utc_text(F.col("published_at")).alias("published"))


@query("dedupe_lineitem", """SELECT l_orderkey, l_linenumber, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate DESC, l_partkey, l_suppkey, l_linenumber, l_extendedprice) AS rn FROM lineitem) WHERE rn = 1""")
def _(t):
    order = [F.col("l_shipdate").desc(), *[F.col(c) for c in ("l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice")]]
    return dedupe.keep_first(t.read("lineitem"), [F.col("l_orderkey")], order).select("l_orderkey", "l_linenumber", "l_partkey")


BRIEFING_KEY = "CASE WHEN identifier <> '' THEN identifier WHEN webpage_url <> '' THEN regexp_replace(webpage_url, '/+$', '') ELSE publisher || ':' || title END"
BRIEFINGS_ONCE = f"once AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {BRIEFING_KEY} ORDER BY published_at DESC, arrival_seq) AS rn FROM briefings) WHERE rn = 1)"


@query("dedupe_briefings", with_tables(T.BRIEFINGS, BRIEFINGS_ONCE) + "SELECT conv_id, turn FROM once")
def _(t):
    return dedupe.dedupe_briefings(t.briefings).select("conv_id", "turn")


@query("first_link_per_page", """SELECT u AS page_url, l AS link, min(p) AS position FROM (SELECT 'src' || CAST(user_id AS VARCHAR) AS u, event_type AS l, event_id AS p FROM events) GROUP BY u, l""")
def _(t):
    cards = t.health.join(t.read("events").select("event_id", "event_type"), "event_id").select(F.col("source").alias("page_url"), F.col("event_type").alias("link"), F.col("event_id").alias("position"))
    return dedupe.first_link_per_page(cards)


# --- joins -------------------------------------------------------------------------------------------------

RESOLVED = """resolved AS (SELECT n.*, coalesce((SELECT s.source_id FROM sources s WHERE s.display_name = n.a OR s.source_id = n.a OR s.name_en = n.e OR s.source_id = n.unit_category ORDER BY s.source_ord LIMIT 1), n.a) AS source_id
  FROM (SELECT *, CASE doc_id % 5 WHEN 0 THEN source WHEN 1 THEN 'Unknown body' ELSE agency END AS a, CASE WHEN doc_id % 4 = 0 THEN 'Body src1' ELSE 'none' END AS e FROM news) n)"""


@query("join_resolve_source", with_tables(T.NEWS, T.SOURCES, RESOLVED) + "SELECT doc_id, source_id FROM resolved")
def _(t):
    news = t.news.withColumn("agency", F.expr("case doc_id % 5 when 0 then source when 1 then 'Unknown body' else agency end")).withColumn(
        "agency_en", F.expr("if(doc_id % 4 = 0, 'Body src1', 'none')")
    )
    return merge.resolve_source(news, t.sources).select("doc_id", "source_id")


WORDS = [(p, tp, s) for tp, ws in P.topics for p, s in ws]


def _keyword_sql() -> str:
    parts = [
        f"SELECT doc_id, '{tp}' AS topic, '{p}' AS phrase, '{s}' AS strength FROM n WHERE {found_sql(p, 'x')}" for p, tp, s in WORDS
    ]
    return with_tables(T.NEWS) + f", n AS (SELECT doc_id, ' ' || {T.fold(T.squeeze('summary'))} || ' ' AS x FROM news) " + " UNION ALL ".join(parts)


@query("join_keywords", _keyword_sql())
def _(t):
    return relevance.join_keywords(t.spread(t.news), P, "doc_id", "summary")


@query("join_health_fetched_at", with_tables(T.NEWS) + """SELECT doc_id, CASE WHEN u.s IN (SELECT DISTINCT 'src' || CAST(user_id AS VARCHAR) FROM events WHERE user_id % 2 = 0) THEN 'at ' || u.s ELSE 'run' END AS fetched_at
  FROM (SELECT doc_id, CASE WHEN unit_category = '' THEN agency ELSE unit_category END AS s FROM news) u""")
def _(t):
    observed = t.health.select("source", F.when(F.expr("cast(substr(source, 4) AS int) % 2 = 0"), F.concat(F.lit("at "), "source")).otherwise(F.lit("")).alias("fetched_at"))
    return merge.attach_fetched_at(t.news.select("doc_id", "unit_category", "agency"), observed, F.lit("run"), dedupe.unit_or_agency()).select("doc_id", "fetched_at")


CACHE = "cache AS (SELECT title AS text, min(CASE WHEN doc_id % 3 = 0 THEN title || ' ' WHEN doc_id % 3 = 1 THEN 'tr ' || title ELSE '' END) AS translation FROM news WHERE doc_id % 2 = 0 GROUP BY title)"


def _cache(t):
    text = F.expr("case doc_id % 3 when 0 then concat(title, ' ') when 1 then concat('tr ', title) else '' end")
    return t.news.where("doc_id % 2 = 0").groupBy(F.col("title").alias("text")).agg(F.min(text).alias("translation"))


HITS = f"""texts AS (SELECT DISTINCT title AS text FROM news WHERE title <> ''), looked AS (SELECT t.text, coalesce(c.translation <> '' AND {T.squeeze(T.fold('c.translation'))} <> {T.squeeze(T.fold('t.text'))}, false) AS hit,
  c.translation FROM texts t LEFT JOIN cache c ON t.text = c.text)"""


@query("join_translation_cache", with_tables(T.NEWS, CACHE, HITS) + "SELECT md5(text) AS text_md5, hit, CASE WHEN hit THEN md5(translation) ELSE 'none' END AS translation_md5 FROM looked")
def _(t):
    looked = merge.lookup_translations(merge.distinct_texts(t.news.select(F.col("title").alias("text"), F.col("doc_id").alias("position"))), _cache(t))
    return looked.select(F.md5("text").alias("text_md5"), "hit", F.coalesce(F.md5("translation"), F.lit("none")).alias("translation_md5"))


@query("agg_distinct_texts", with_tables(T.NEWS) + "SELECT md5(title) AS text_md5, min(doc_id) AS position FROM news WHERE title <> '' GROUP BY title")
def _(t):
    once = merge.distinct_texts(t.news.select(F.col("title").alias("text"), F.col("doc_id").alias("position")))
    return once.select(F.md5("text").alias("text_md5"), "position")


@query("cache_upsert", with_tables(T.NEWS, CACHE) + """, fresh AS (SELECT title AS text, min('new ' || title) AS translation FROM news WHERE doc_id % 5 = 0 AND title <> '' GROUP BY title)
  SELECT md5(coalesce(f.text, c.text)) AS text_md5, md5(coalesce(f.translation, c.translation)) AS translation_md5 FROM cache c FULL OUTER JOIN fresh f ON c.text = f.text""")
def _(t):
    fresh = t.news.where("doc_id % 5 = 0").groupBy(F.col("title").alias("text")).agg(F.min(F.concat(F.lit("new "), "title")).alias("translation"))
    return merge.upsert_cache(_cache(t), fresh).select(F.md5("text").alias("text_md5"), F.md5("translation").alias("translation_md5"))


@query("untranslated_titles", with_tables(T.NEWS, CACHE) + f"SELECT DISTINCT md5(n.title) AS title_md5 FROM news n JOIN cache c ON n.title = c.text WHERE n.title <> '' AND {T.squeeze(T.fold('c.translation'))} = {T.squeeze(T.fold('n.title'))}")
def _(t):
    return merge.untranslated_titles(t.news.select("title"), _cache(t)).select(F.md5("title").alias("title_md5"))


PREVIOUS = "previous AS (SELECT *, source AS source_id FROM news WHERE doc_id % 4 <> 1), fetched AS (SELECT *, source AS source_id FROM news WHERE doc_id % 4 <> 2 AND source IN ('src1', 'src2', 'src3')), both_runs AS (SELECT * FROM previous WHERE source_id NOT IN ('src1', 'src2', 'src3') UNION ALL SELECT * FROM fetched)"


@query("join_preserve_semi", with_tables(T.NEWS, PREVIOUS, KEYED.replace("FROM news)", "FROM both_runs)"), FIRST_ARRIVED) + "SELECT doc_id, source_id FROM deduped")
def _(t):
    news = t.news.withColumn("source_id", F.col("source"))
    retried = t.sources.where("source_id IN ('src1', 'src2', 'src3')").select("source_id")
    return merge.merge_news(news.where("doc_id % 4 <> 1"), news.where("doc_id % 4 <> 2 AND source IN ('src1', 'src2', 'src3')"), retried, ARRIVAL).select("doc_id", "source_id")


@query("join_merge_briefings", with_tables(T.BRIEFINGS) + "SELECT conv_id, turn FROM briefings WHERE conv_id % 2 = 1")
def _(t):
    return merge.merge_briefings(t.briefings, t.briefings.where("conv_id % 2 = 1"), True).select("conv_id", "turn")


@query("join_merge_health", with_tables(T.HEALTH, T.HEALTH_SOURCES) + """, named AS (SELECT h.*, CASE WHEN s.source_id IS NULL THEN 'UK Parliament' ELSE h.source END AS source_id, coalesce(s.source_ord, (SELECT max(source_ord) + 1 FROM health_sources)) AS source_ord
    FROM health h LEFT JOIN health_sources s ON h.source = s.source_id), retried AS (SELECT source_id FROM health_sources WHERE source_ord % 5 = 0)
  SELECT event_id, source_id, source_ord FROM named WHERE (event_id % 2 = 0 AND source_id NOT IN (SELECT source_id FROM retried)) OR (event_id % 2 = 1 AND source_id IN (SELECT source_id FROM retried))""")
def _(t):
    retried = t.health_sources.where("source_ord % 5 = 0").select("source_id")
    fresh = t.health.where("event_id % 2 = 1").join(retried.withColumnRenamed("source_id", "source"), "source", "left_semi")
    return merge.merge_health(t.health.where("event_id % 2 = 0"), fresh, retried, t.health_sources).select("event_id", "source_id", "source_ord")


@query("anti_out_of_period", with_tables(T.NEWS) + f"""SELECT doc_id FROM news WHERE doc_id % 2 = 0 AND regexp_replace(link, '/+$', '') NOT IN
  (SELECT regexp_replace(link, '/+$', '') FROM news WHERE doc_id % 2 = 1 AND (published_at < {SINCE} OR published_at >= {UNTIL}))""")
def _(t):
    return merge.exclude_out_of_period_links(t.news.where("doc_id % 2 = 0"), t.news.where("doc_id % 2 = 1"), t.since, t.until).select("doc_id")


@query("join_attribution", with_tables(T.NEWS, T.SOURCES) + f"""SELECT n.doc_id FROM (SELECT *, CASE WHEN doc_id % 6 = 0 THEN 'Other' ELSE agency END AS a, CASE WHEN doc_id % 9 = 0 THEN 'x' ELSE agency_en END AS e FROM news) n LEFT JOIN sources s ON n.a = s.display_name
  WHERE s.source_id IS NULL OR n.e <> s.name_en OR NOT (n.link <> '' AND n.published_at >= {SINCE} AND n.published_at < {UNTIL} AND NOT {HOMEPAGE.replace('(link', '(n.link')})""")
def _(t):
    news = t.news.withColumns({"agency": F.expr("if(doc_id % 6 = 0, 'Other', agency)"), "agency_en": F.expr("if(doc_id % 9 = 0, 'x', agency_en)")})
    joined = news.join(t.sources.select(F.col("display_name").alias("agency"), "name_en", F.col("homepage").alias("_h")), "agency", "left")
    valid = filters.valid_record(F.col("title"), F.col("link"), F.col("published_at"), t.since, t.until)
    fine = valid & F.col("_h").isNotNull() & (F.col("agency_en") == F.col("name_en")) & filters.smoke_link(F.col("link"), F.col("source_feed"), F.array("_h"))
    return joined.where(~F.coalesce(fine, F.lit(False))).select("doc_id")


# --- relevance -----------------------------------------------------------------------------------------------


@query("match_keywords", with_tables(T.NEWS) + ', ' + SCORED_CTES + f""" SELECT doc_id, {joined_phrases(P, 'ft{i}', order=lambda i: i)} AS in_title, {joined_phrases(P, 'fs{i}', order=lambda i: i)} AS in_summary FROM assessed""")
def _(t):
    index = KeywordIndex.of(P)
    def found(column):
        numbers = bind(F.col(column), sql_let(sql_matching_text("x"), "w", index.sql_match("w")))
        return F.array_join(F.transform(numbers, lambda n: F.element_at(F.expr(index._strings(index.phrases)), n)), V.LIST_SEPARATOR)

    return t.spread(t.news).select("doc_id", found("title").alias("in_title"), found("summary").alias("in_summary"))


@query("suppress_overlaps", with_tables(T.NEWS) + ', ' + SCORED_CTES + f""" SELECT doc_id, {joined_phrases(P, 'kt{i}', order=lambda i: i)} AS in_title, {joined_phrases(P, 'ks{i}', order=lambda i: i)} AS in_summary FROM assessed""")
def _(t):
    index = KeywordIndex.of(P)
    rows = t.spread(t.news).select("doc_id", index.assess(F.col("title"), F.col("summary")).alias("a"))
    names = index._strings(index.phrases)
    return rows.select("doc_id", *[F.expr(f"array_join(transform(a.{c}, n -> element_at({names}, n)), '、')").alias(f"in_{c}") for c in ("title", "summary")])


@query("score_relevance", with_tables(T.NEWS) + ', ' + SCORED_CTES + " SELECT doc_id, score FROM assessed")
def _(t):
    index = KeywordIndex.of(P)
    return t.spread(t.news).select("doc_id", index.assess(F.col("title"), F.col("summary"))["score"].alias("score"))


EXPLAINED = f"""{joined_topics(P)} AS topics, {joined_phrases(P, 'kt{i} OR ks{i}')} AS keywords, {joined_phrases(P, 'kt{i}')} AS title_keywords, {joined_phrases(P, 'ks{i}')} AS summary_keywords,
  {joined_phrases(P, 'kt{i} OR ks{i}', strength='core')} AS core, {joined_phrases(P, 'kt{i} OR ks{i}', strength='general')} AS general, {joined_phrases(P, 'kt{i} OR ks{i}', strength='supporting')} AS supporting"""
LEVEL = "CASE WHEN score >= 8 THEN '高' WHEN score >= 5 THEN '中' ELSE '低' END"


@query("explain_relevance", with_tables(T.NEWS) + ', ' + SCORED_CTES + f" SELECT doc_id, {EXPLAINED}, score, {LEVEL} AS level FROM assessed WHERE score >= 12 AND NOT {HOMEPAGE}")
def _(t):
    rows = relevance.filter_relevant(t.spread(t.news), P)
    lists = {"topics": "matched_topics", "keywords": "matched_keywords", "title_keywords": "title_matched_keywords", "summary_keywords": "summary_matched_keywords",
             "core": "core_matched_keywords", "general": "general_matched_keywords", "supporting": "supporting_matched_keywords"}
    return rows.select("doc_id", *[F.array_join(c, V.LIST_SEPARATOR).alias(n) for n, c in lists.items()], F.col("relevance_score").alias("score"), F.col("relevance_level").alias("level"))


@query("filter_relevant", with_tables(T.NEWS) + ', ' + SCORED_CTES + f""", shown AS (SELECT *, score >= 12 AND NOT {HOMEPAGE} AS included FROM assessed)
  SELECT doc_id, included, CASE WHEN included THEN score ELSE 0 END AS relevance_score, CASE WHEN included THEN {LEVEL} ELSE '' END AS level, CASE WHEN included THEN {joined_phrases(P, 'kt{i} OR ks{i}')} ELSE '' END AS keywords FROM shown""")
def _(t):
    return relevance.annotate(t.spread(t.news), P).select(
        "doc_id", "included", "relevance_score", F.col("relevance_level").alias("level"), F.array_join("matched_keywords", V.LIST_SEPARATOR).alias("keywords")
    )


@query("relevance_level", "SELECT o_orderkey, CASE WHEN o_custkey % 12 >= 8 THEN '高' WHEN o_custkey % 12 >= 5 THEN '中' ELSE '低' END AS level FROM orders")
def _(t):
    return t.read("orders").select("o_orderkey", relevance.relevance_level(F.col("o_custkey") % 12).alias("level"))


DRAW_ORDER = {"supporting": 0, "general": 1, "core": 2}
_STRENGTH = {p: s for p, _topic, s in WORDS}
_DRAWN = sorted(enumerate((w[0] for w in ordered_phrases(P)), 1), key=lambda e: (DRAW_ORDER[_STRENGTH[e[1]]], e[1].encode()))
DRAWN = ", ".join(f"CASE WHEN kt{i} OR ks{i} THEN '{p}' END" for i, p in _DRAWN)


@query("highlight_plan", with_tables(T.NEWS) + ', ' + SCORED_CTES + f" SELECT doc_id, concat_ws('、', {DRAWN}) AS drawn FROM assessed WHERE score >= 12 AND NOT {HOMEPAGE}")
def _(t):
    rows = relevance.filter_relevant(t.spread(t.news), P)
    plan = relevance.highlight_plan(F.col("title_keyword_strengths"), F.col("summary_keyword_strengths"))
    return rows.select("doc_id", F.array_join(F.transform(plan, lambda s: s["keyword"]), V.LIST_SEPARATOR).alias("drawn"))


# --- provenance and identity ------------------------------------------------------------------------------------

CANONICAL = "regexp_replace(link, '/+$', '')"


@query("build_provenance", with_tables(T.NEWS, T.BRIEFINGS) + f"""SELECT 'news' AS record_type, CASE WHEN unit_category = '' THEN agency ELSE unit_category END AS source_id, link AS url, {CANONICAL} AS canonical_url, source_feed,
  CASE WHEN unit_category IN ('src0', 'src2') THEN 'seen' ELSE 'run' END AS fetched_at, 'v1' AS parser_version FROM news
  UNION ALL SELECT 'parliament', publisher, webpage_url, regexp_replace(webpage_url, '/+$', ''), 'Official RSS: fixture', CASE WHEN publisher = 'House of Lords Library' THEN 'seen' ELSE 'run' END, 'v1' FROM briefings""")
def _(t):
    rows = t.sources.where("source_id IN ('src0', 'src2')").select(F.col("source_id").alias("source")).unionByName(t.one_row(source=F.lit("House of Lords Library RSS")))
    observed = rows.withColumn("fetched_at", F.lit("seen"))
    return provenance.build_provenance(t.news, t.briefings, observed, F.lit("run"))


@query("sort_provenance", with_tables(T.NEWS) + f"SELECT row_number() OVER (ORDER BY source_id, canonical_url, doc_id) AS place, doc_id FROM (SELECT doc_id, CASE WHEN unit_category = '' THEN agency ELSE unit_category END AS source_id, {CANONICAL} AS canonical_url FROM news)")
def _(t):
    rows = t.news.select("doc_id", dedupe.unit_or_agency().alias("source_id"), canonical_url(F.col("link")).alias("canonical_url"))
    return ranking.number_rows(rows, [F.col("source_id"), F.col("canonical_url"), F.col("doc_id")], "place").select("place", "doc_id")


def _escaped(column: str) -> str:
    return f"replace(replace(replace({column}, '\\', '\\\\'), '\"', '\\\"'), chr(10), '\\n')"


NEWS_LINE = """'{"agency":"' || agency || '","agency_en":"' || agency_en || '","content_type":"news","core_matched_keywords":[],"date":"' || strftime(published_at, '%Y-%m-%d') || '","general_matched_keywords":[],"link":"' || link ||
  '","matched_keywords":[],"matched_topics":[],"relevance_score":0,"source_feed":"' || source_feed || '","summary":"' || """ + _escaped("summary") + """ || '","supporting_matched_keywords":[],"title":"' || """ + _escaped("title") + """ || '","type":"news","unit_category":"' || unit_category || '"}'"""


def _plain_matches(df):
    return df.withColumns({c: F.array().cast("array<string>") for c in ("matched_topics", "matched_keywords", "core_matched_keywords", "general_matched_keywords", "supporting_matched_keywords")}).withColumn("relevance_score", F.lit(0))


BRIEFING_LINE = """'{"chamber":"' || chamber || '","core_matched_keywords":[],"date":"' || strftime(published_at, '%Y-%m-%d') || '","document_type":"Research Briefing","fetched_from":"Official RSS: fixture","general_matched_keywords":[],"identifier":"' || identifier ||
  '","matched_keywords":[],"matched_topics":[],"pdf_url":"","publisher":"' || publisher || '","relevance_score":0,"summary":"' || """ + _escaped("summary") + """ || '","supporting_matched_keywords":[],"title":"' || """ + _escaped("title") + """ || '","topics":["Topic"],"type":"parliament","webpage_url":"' || webpage_url || '"}'"""


def _tree_sql(lines: str) -> str:
    levels = "".join(f", l{i + 1} AS (SELECT left(h, {n}) AS h, sha256(string_agg(v, ',' ORDER BY v)) AS v FROM l{i} GROUP BY left(h, {n}))" for i, n in enumerate((6, 4, 2, 0)))
    return with_tables(T.NEWS, T.BRIEFINGS) + f", l0 AS (SELECT h, h || ':' || CAST(count(*) AS VARCHAR) AS v FROM ({lines}) GROUP BY h){levels}"


@query("data_fingerprint", _tree_sql(f"SELECT sha256({NEWS_LINE}) AS h FROM news UNION ALL SELECT sha256({BRIEFING_LINE}) FROM briefings") + " SELECT v AS data_fingerprint FROM l4")
def _(t):
    return provenance.run_fingerprint(_plain_matches(t.news), _plain_matches(t.briefings))


@query("fingerprint_tree", " UNION ALL ".join(f"SELECT * FROM ({_tree_sql(f'SELECT sha256({line}) AS h FROM {kind}')} SELECT '{kind}' AS kind, v AS fingerprint FROM l4)" for kind, line in (("news", NEWS_LINE), ("briefings", BRIEFING_LINE))))
def _(t):
    trees = {"news": provenance.news_lines(_plain_matches(t.news)), "briefings": provenance.briefing_lines(_plain_matches(t.briefings))}
    first, second = (provenance.fingerprint_tree(lines).select(F.lit(kind).alias("kind"), "fingerprint") for kind, lines in trees.items())
    return first.unionByName(second)


@query("delivery_id", with_tables(T.RUNS) + """SELECT o_orderkey, run_id || ':RunStatus.' || upper(status) || ':' || left(data_fingerprint, 16) AS delivery_id FROM runs""")
def _(t):
    return t.runs.select("o_orderkey", provenance.delivery_id(F.col("run_id"), F.col("status"), F.col("data_fingerprint")).alias("delivery_id"))


@query("run_id", """SELECT o_orderkey, 'watch-' || strftime(o_orderdate, '%Y-%m-%d') || '_' || strftime(o_orderdate + INTERVAL 7 DAY, '%Y-%m-%d') || CASE WHEN o_orderpriority = '1-URGENT' THEN '' ELSE '-' || o_orderpriority END AS run_id FROM orders""")
def _(t):
    start = F.col("o_orderdate").cast("date")
    return t.read("orders").select("o_orderkey", provenance.run_id(start, F.date_add(start, 7), F.col("o_orderpriority"), "1-URGENT", "watch").alias("run_id"))


@query("report_filename", """SELECT o_orderkey, strftime(o_orderdate, '%Y%m%d') || '-' || strftime(o_orderdate + INTERVAL 7 DAY, '%Y%m%d') || '_report' || CASE WHEN o_orderpriority = '1-URGENT' THEN '' ELSE '_' || o_orderpriority END || '.xlsx' AS file_name FROM orders""")
def _(t):
    start = F.col("o_orderdate").cast("date")
    return t.read("orders").select("o_orderkey", provenance.report_stem(start, F.date_add(start, 7), F.col("o_orderpriority"), "1-URGENT", "report").alias("file_name"))


# --- the run --------------------------------------------------------------------------------------------------

RUN_HEALTH = "run_health AS (SELECT source AS source, count(*) AS item_count FROM news GROUP BY source)"
PERIOD_NEWS = T.NEWS.replace("FROM documents)", f"FROM documents WHERE CAST(TIMESTAMP '2024-01-01' + to_minutes(CAST(doc_id * 7919 % 43200 AS INTEGER)) AS TIMESTAMP) >= {SINCE} AND CAST(TIMESTAMP '2024-01-01' + to_minutes(CAST(doc_id * 7919 % 43200 AS INTEGER)) AS TIMESTAMP) < {UNTIL})")
KEPT = f"kept AS (SELECT d.* FROM deduped d LEFT JOIN sources s ON d.source = s.source_id WHERE NOT {HOMEPAGE} AND (d.link = '' OR regexp_replace(d.link, '/+$', '') <> s.homepage))"
RUN_CTES = with_tables(PERIOD_NEWS, KEYED, DEDUPED, T.SOURCES, KEPT) + ', ' + matching_ctes(P, "kept", "doc_id")


def period_run(t):
    per_source = t.news.groupBy("source").agg(F.count("*").alias("item_count")).select("source", F.lit(True).alias("critical"), F.lit(True).alias("success"), "item_count", F.lit(0.0).alias("duration_seconds"), F.lit("").alias("warning"), F.regexp_extract("source", "[0-9]+", 0).cast("int").alias("position"))
    return publication_run(t.news, t.briefings, per_source, t.sources, P, t.since, t.until, ARRIVAL)


def _topic_sql() -> str:
    words = ordered_phrases(P)
    parts = []
    for topic in (tp for tp, _ in P.topics):
        ids = [i for i in range(1, len(words) + 1) if words[i - 1][1] == topic]
        parts.append(f"SELECT '{topic}' AS topic, count(*) AS records, max(score) AS best_score FROM assessed WHERE score >= 12 AND ({' OR '.join(f'kt{i} OR ks{i}' for i in ids)}) HAVING count(*) > 0")
    return RUN_CTES.replace(DEDUPED, FIRST_ARRIVED) + " " + " UNION ALL ".join(parts)


@query("run_topic_counts", _topic_sql())
def _(t):
    return period_run(t).topic_counts()


RUN_COUNTS = f""", b AS (SELECT * FROM briefings WHERE published_at >= {SINCE} AND published_at < {UNTIL}), bo AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {BRIEFING_KEY} ORDER BY published_at DESC, arrival_seq) AS rn FROM b) WHERE rn = 1)
  SELECT (SELECT count(*) FROM assessed) AS all_news_count, (SELECT count(*) FROM assessed WHERE score >= 12) AS filtered_news_count, (SELECT count(*) FROM bo) AS parliament_count"""


@query("agg_run_counts", f"WITH {T.BRIEFINGS}, " + RUN_CTES.removeprefix("WITH ") + RUN_COUNTS)
def _(t):
    return period_run(t).counts().select("all_news_count", "filtered_news_count", "parliament_count")


@query("selective_rerun", with_tables(T.NEWS) + f""", again AS (SELECT * FROM news WHERE source IN ('src3', 'src7')), base AS (SELECT * FROM news WHERE source NOT IN ('src3', 'src7') AND doc_id % 8 <> 0 UNION ALL SELECT * FROM again),
  {KEYED.replace('FROM news)', 'FROM base)')}, {FIRST_ARRIVED} SELECT doc_id FROM deduped WHERE NOT {HOMEPAGE}""")
def _(t):
    health = t.sources.select(F.col("source_id").alias("source"), F.lit(True).alias("critical"), (~F.col("source_id").isin("src3", "src7")).alias("success"), F.lit(1).alias("item_count"), F.lit("").alias("warning"))
    news = t.news.withColumn("source_id", F.col("source"))
    keep = ~F.expr(filters_sql())
    before = Run(news.where("doc_id % 8 <> 0 OR source IN ('src3', 'src7')").where(keep), t.briefings, health, t.since, t.until)
    again = Run(news.where("source IN ('src3', 'src7')").where(keep), t.briefings, health.where("source IN ('src3', 'src7')").withColumn("success", F.lit(True)), t.since, t.until)
    return selective_rerun(before, again, t.sources, P, V.BRIEFINGS_SOURCE_ID, ARRIVAL).news.select("doc_id")


def filters_sql() -> str:
    return "link rlike '^https://www.gov.uk/government/organisations/[^/]*/*$'"


@query("agg_stage_counts", with_tables(T.NEWS, KEYED, DEDUPED) + f"""SELECT 'agency' AS family, (SELECT count(*) FROM news WHERE link <> '') AS candidate_count, (SELECT count(*) FROM news) AS source_output_count,
  (SELECT count(*) FROM news WHERE published_at >= {SINCE} AND published_at < {UNTIL}) AS date_filtered_count, (SELECT count(*) FROM deduped) AS final_output_count""")
def _(t):
    counted = t.news.agg(
        F.count_if(F.col("link") != "").alias("candidate_count"), F.count("*").alias("source_output_count"),
        F.count_if(filters.in_period(F.col("published_at"), t.since, t.until)).alias("date_filtered_count"),
    ).withColumn("_k", F.lit(1))
    final = dedupe.dedupe_news(t.news).agg(F.count("*").alias("final_output_count")).withColumn("_k", F.lit(1))
    return counted.join(final, "_k").select(F.lit("agency").alias("family"), "candidate_count", "source_output_count", "date_filtered_count", "final_output_count")


@query("union_all", "SELECT source, count(*) AS records FROM (SELECT source FROM documents UNION ALL SELECT role FROM conversations) GROUP BY source")
def _(t):
    both = t.read("documents").select("source").unionByName(t.read("conversations").select(F.col("role").alias("source")))
    return both.groupBy("source").agg(F.count("*").alias("records"))


@query("content_type", with_tables(T.NEWS) + """SELECT doc_id, CASE WHEN contains(lower(link), '/judgment') THEN 'judgment' WHEN contains(lower(link), '/guidance/') OR contains(lower(link || ' ' || title), 'guidance') THEN 'guidance'
  WHEN contains(lower(link), '/report') OR contains(lower(link || ' ' || title), 'report') OR contains(lower(link || ' ' || title), 'research') THEN 'report'
  WHEN contains(lower(link), '/publication') OR contains(lower(link), '/consultation') OR contains(lower(link || ' ' || title), 'publication') OR contains(lower(link || ' ' || title), 'consultation') THEN 'publication' ELSE 'news' END AS content_type FROM news""")
def _(t):
    return t.news.select("doc_id", content_type(F.col("link"), F.col("title")).alias("content_type"))

