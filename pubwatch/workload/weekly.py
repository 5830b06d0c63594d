"""Queries: one whole run over landed feed bodies that Spark builds from the given tables."""

from __future__ import annotations

from datetime import UTC, date, datetime

from pyspark.sql import functions as F

from pubwatch import fixed_values as V
from pubwatch.functions.dates import utc_text
from pubwatch.operators.health import health_rules
from pubwatch.plans.publication_run import RunRequest, landed_run
from pubwatch.workload import tables as T
from pubwatch.workload.landed import feed_bodies
from pubwatch.workload.matching_sql import joined_phrases, joined_topics, matching_ctes
from pubwatch.workload.records import BRIEFING_KEY, HOMEPAGE, KEYED, DEDUPED, P, SINCE, UNTIL
from pubwatch.workload.registry import query
from pubwatch.workload.tables import squeeze

REQUEST = RunRequest(date(2024, 1, 9), date(2024, 1, 22), P, datetime(2024, 2, 1, tzinfo=UTC), "report.xlsx")
LEAST = {"src1": 1_000_000_000}


def _xml(column: str) -> str:
    return f"replace(replace({column}, '&', '&amp;'), '<', '&lt;')"


def _briefing_bodies(t):
    """One landed feed per message; every eleventh conversation's bodies are no feeds."""
    stamp = "date_format(published_at, \"EEE, dd MMM yyyy HH:mm:ss 'GMT'\")"
    body = f"""if(conv_id % 11 = 3, '<html></html>', concat('<?xml version="1.0"?><rss version="2.0"><channel><item><title>', {_xml(_xml('title'))}, '</title><link>', webpage_url, '</link><guid>', identifier,
      '</guid><pubDate>', {stamp}, '</pubDate><description>', {_xml(_xml('summary'))}, '</description><category>', chamber, '</category></item></channel></rss>'))"""
    return t.briefings.selectExpr("publisher", "'fixture' AS url", "arrival_seq AS page_no", f"{body} AS body", "turn % 4 / 8.0D AS duration_seconds")


def weekly(t):
    sources = t.sources.selectExpr("*", "array('/') AS patterns", "array('https://www.gov.uk/') AS official_urls")
    bodies = feed_bodies(t).selectExpr("*", "doc_id % 7 / 8.0D AS duration_seconds")
    return landed_run(bodies, _briefing_bodies(t), sources, health_rules(t.spark, LEAST, {}), REQUEST, check_host=True)


def _listed(condition: str, joined: str) -> str:
    return f"""CASE WHEN {condition} AND ({joined}) <> '' THEN '["' || ({joined}) || '"]' ELSE '[]' END"""


def _text(column: str) -> str:
    return f"replace(replace({column}, '\\', '\\\\'), '\"', '\\\"')"


def _line(fields: dict[str, str], condition: str) -> str:
    """SQL of the canonical line: every field is SQL of a written value."""
    hit = "kt{i} OR ks{i}"
    fields = fields | {f"{s}_matched_keywords": _listed(condition, joined_phrases(P, hit, strength=s, sep='","')) for s in ("core", "general", "supporting")}
    fields |= {"matched_keywords": _listed(condition, joined_phrases(P, hit, sep='","')), "matched_topics": _listed(condition, joined_topics(P, '","')),
               "relevance_score": f"CAST(CASE WHEN {condition} THEN score ELSE 0 END AS VARCHAR)", "date": "'\"' || strftime(published_at, '%Y-%m-%d') || '\"'"}
    return "'{' || " + " || ',' || ".join(f"""'"{k}":' || {fields[k]}""" for k in sorted(fields)) + " || '}'"


def _quoted(column: str) -> str:
    return f"""'"' || {_text(column)} || '"'"""


_NEWS_IN = f"{HOMEPAGE} IS NOT TRUE AND link <> '' AND regexp_replace(link, '/+$', '') <> 'https://www.gov.uk/government/news/' || CAST(CAST(substr(source, 4) AS INTEGER) AS VARCHAR)"
_KIND = """CASE WHEN contains(lower(link), '/judgment') THEN 'judgment' WHEN contains(lower(link), '/guidance/') OR contains(lower(link || ' ' || title), 'guidance') THEN 'guidance'
  WHEN contains(lower(link), '/report') OR contains(lower(link || ' ' || title), 'report') OR contains(lower(link || ' ' || title), 'research') THEN 'report'
  WHEN contains(lower(link), '/publication') OR contains(lower(link), '/consultation') OR contains(lower(link || ' ' || title), 'publication') OR contains(lower(link || ' ' || title), 'consultation') THEN 'publication' ELSE 'news' END"""
_READ = f"""read AS (SELECT * REPLACE ({squeeze('title')} AS title, {squeeze('summary')} AS summary, source AS unit_category) FROM raw WHERE doc_id % 7 <> 3),
  flagged AS (SELECT *, published_at >= {SINCE} AND published_at < {UNTIL} AND {_NEWS_IN} AND title <> '' AS kept, published_at >= {SINCE} AND published_at < {UNTIL} AND (link = '' OR ({_NEWS_IN})) AS candidate FROM read),
  news AS (SELECT * FROM flagged WHERE kept)"""
_N_IN, _B_IN = f"(score >= 12 AND NOT {HOMEPAGE})", "(score >= 12)"
_NEWS_LINE = _line({
    "agency": _quoted("agency"), "agency_en": _quoted("agency_en"), "content_type": f"'\"' || {_KIND} || '\"'", "link": _quoted("link"), "source_feed": _quoted("source_feed"),
    "summary": _quoted("summary"), "title": _quoted("title"), "type": "'\"news\"'", "unit_category": _quoted("unit_category")}, _N_IN)
_PDF = f"CASE WHEN identifier = '' THEN '' ELSE '{V.BRIEFING_PDF_ROOT}' || identifier || '/' || identifier || '.pdf' END"
_BRIEFING_LINE = _line({
    "chamber": _quoted("chamber"), "document_type": "'\"Research Briefing\"'", "fetched_from": "'\"Official RSS: fixture\"'", "identifier": _quoted("identifier"), "pdf_url": f"'\"' || {_PDF} || '\"'",
    "publisher": _quoted("publisher"), "summary": _quoted("summary"), "title": _quoted("title"), "topics": "'[\"' || chamber || '\"]'", "type": "'\"parliament\"'", "webpage_url": _quoted("webpage_url")}, _B_IN)
_LEVELS = ", ".join(f"l{i + 1} AS (SELECT left(h, {n}) AS h, sha256(string_agg(v, ',' ORDER BY v)) AS v FROM l{i} GROUP BY left(h, {n}))" for i, n in enumerate((6, 4, 2)))

RUN = f"""WITH {T.NEWS.replace('news AS (', 'raw AS (', 1)}, {T.BRIEFINGS}, {T.SOURCES}, {_READ}, {KEYED}, {DEDUPED},
  n AS (WITH {matching_ctes(P, 'deduped', 'doc_id')} SELECT *, {_N_IN} AS included, {_NEWS_LINE} AS line FROM assessed),
  landed AS (SELECT * REPLACE ({squeeze('title')} AS title, {squeeze('summary')} AS summary) FROM briefings WHERE conv_id % 11 <> 3 AND published_at >= {SINCE}),
  distinct_briefings AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {BRIEFING_KEY} ORDER BY published_at DESC, arrival_seq) AS rn FROM landed WHERE published_at < {UNTIL}) WHERE rn = 1),
  b AS (WITH {matching_ctes(P, 'distinct_briefings', 'conv_id')} SELECT *, {_B_IN} AS included, {_BRIEFING_LINE} AS line FROM assessed),
  counted AS (SELECT source, count(*) FILTER (kept) AS items, count(*) FILTER (candidate) AS candidates FROM flagged GROUP BY source),
  bodies AS (SELECT source, sum(doc_id % 7 / 8.0) AS seconds, bool_or(doc_id % 7 <> 3) AS success, bool_or(doc_id % 7 = 3) AS broken FROM documents GROUP BY source),
  health AS (SELECT 'agency' AS family, source_ord AS o, s.source_id AS source, coalesce(items, 0) AS items, coalesce(candidates, 0) AS candidates, seconds, success,
      concat_ws('；', CASE WHEN s.source_id = 'src1' THEN 'src1 筆數異常：取得 ' || CAST(coalesce(items, 0) AS VARCHAR) || ' 筆，低於健康門檻 1000000000 筆' END,
        CASE WHEN broken THEN s.source_id || ' RSS/Atom 讀取失敗' END, CASE WHEN candidates > 0 AND items = 0 THEN s.source_id || ' 有候選資料但解析為零筆' END) AS warning
    FROM sources s LEFT JOIN counted c ON c.source = s.source_id LEFT JOIN bodies d ON d.source = s.source_id
    UNION ALL SELECT 'parliament', 2147483647, publisher || ' RSS', count(*) FILTER (conv_id % 11 <> 3 AND published_at >= {SINCE}), count(*) FILTER (conv_id % 11 <> 3 AND published_at >= {SINCE}), sum(turn % 4 / 8.0), bool_or(conv_id % 11 <> 3),
      CASE WHEN bool_or(conv_id % 11 = 3) THEN publisher || ' RSS RSS/Atom 讀取失敗' ELSE '' END FROM briefings GROUP BY publisher)"""


@query("publication_run", RUN + """ SELECT 'news' AS record_type, link, md5(title) AS title_md5, strftime(published_at, '%Y-%m-%d %H:%M:%S') AS published, included, CASE WHEN included THEN score ELSE 0 END AS relevance_score FROM n
  UNION ALL SELECT 'parliament', webpage_url, md5(title), strftime(published_at, '%Y-%m-%d %H:%M:%S'), included, CASE WHEN included THEN score ELSE 0 END FROM b""")
def _(t):
    rows = weekly(t).records()
    return rows.select("record_type", "link", F.md5("title").alias("title_md5"), utc_text(F.col("published_at")).alias("published"), "included", "relevance_score")


@query("run_summary", RUN + f""", l0 AS (SELECT h, h || ':' || CAST(count(*) AS VARCHAR) AS v FROM (SELECT sha256(line) AS h FROM n UNION ALL SELECT sha256(line) FROM b) GROUP BY h), {_LEVELS},
  print AS (SELECT sha256(coalesce(string_agg(v, ',' ORDER BY v), '')) AS data_fingerprint FROM l3),
  told AS (SELECT warning, min((o, source)) AS p FROM health WHERE warning <> '' GROUP BY warning),
  state AS (SELECT CASE WHEN bool_and(success AND warning = '') THEN 'complete' ELSE 'degraded' END AS status FROM health),
  seen AS (SELECT count(*) AS sources, round_even(avg(CAST(success AS INTEGER)), 3) AS rate, round_even(avg(CAST(items = 0 AS INTEGER)), 3) AS zero FROM health),
  slow AS (SELECT min(seconds) AS p95 FROM (SELECT seconds, row_number() OVER (ORDER BY seconds) AS i, count(*) OVER () AS n FROM health) WHERE i = CAST(ceil(n * 0.95) AS BIGINT))
  SELECT 'watch-2024-01-09_2024-01-22-{P.profile_id}' AS run_id, '2024-01-09' AS period_start, '2024-01-22' AS period_end, 'report.xlsx' AS output_file,
    (SELECT count(*) FROM n) AS all_news_count, (SELECT count(*) FROM n WHERE included) AS filtered_news_count, (SELECT count(*) FROM b) AS parliament_count, (SELECT count(*) FROM b WHERE included) AS filtered_parliament_count,
    status, (SELECT string_agg(warning, '|' ORDER BY p) FROM told) AS warnings, data_fingerprint, 'watch-2024-01-09_2024-01-22-{P.profile_id}:RunStatus.' || upper(status) || ':' || left(data_fingerprint, 16) AS delivery_id,
    sources AS source_count, CAST(rate AS DOUBLE) AS source_success_rate, CAST(p95 AS DOUBLE) AS source_p95_seconds, CAST(zero AS DOUBLE) AS zero_item_ratio FROM print, state, seen, slow""")
def _(t):
    row = weekly(t).summary()
    kept = [c for c in row.columns if c not in ("generated_at", "observability", "warnings", "selected_sources", "minimum_score") and not c.startswith("profile_")]
    seen = [F.col(f"observability.{c}").alias(c) for c in ("source_count", "source_success_rate", "source_p95_seconds", "zero_item_ratio")]
    return row.select(*kept, F.array_join("warnings", "|").alias("warnings"), *seen)


@query("agg_pipeline_counts", RUN + """ SELECT family, CAST(sum(candidates) AS BIGINT) AS candidate_count, CAST(sum(items) AS BIGINT) AS source_output_count, any_value(f) AS date_filtered_count, any_value(f) AS deduped_count, any_value(f) AS final_output_count, any_value(r) AS relevant_output_count
  FROM health JOIN (SELECT 'agency' AS family, count(*) AS f, count(*) FILTER (included) AS r FROM n UNION ALL SELECT 'parliament', count(*), count(*) FILTER (included) FROM b) USING (family) GROUP BY family""")
def _(t):
    return weekly(t).pipeline_counts()
