"""Queries: health, paging, run tables, quality evaluation, reports and the delivery ledger."""

from __future__ import annotations

from pyspark.sql import functions as F

from pubwatch import fixed_values as V
from pubwatch.functions.base import computed
from pubwatch.functions.dates import utc_text
from pubwatch.functions.urls import route_category
from pubwatch.operators import baselines, cutoff, dedupe, health, ledger, ranking, relevance, runs
from pubwatch.operators.relevance import KeywordIndex
from pubwatch.sinks import reports
from pubwatch.workload import tables as T
from pubwatch.workload.matching_sql import joined_phrases, joined_topics, matching_ctes
from pubwatch.workload.records import ARRIVAL, DEDUPED, FIRST_ARRIVED, HOMEPAGE, KEYED, LEVEL, P, SCORED_CTES, SINCE
from pubwatch.workload.registry import query
from pubwatch.workload.tables import text_ts, with_tables

NOW = f"TIMESTAMP '{T.NOW}'"
EVENT_SINCE = "TIMESTAMP '2024-01-10'"

# --- health -------------------------------------------------------------------------------------------------

RULES = "rules AS (SELECT DISTINCT 'src' || CAST(user_id AS VARCHAR) AS source, CAST(40 + user_id % 40 AS INTEGER) AS minimum_items, CASE WHEN user_id % 3 = 0 THEN CAST(2 + user_id % 5 AS INTEGER) END AS age FROM events)"
COUNTS = """counts AS (SELECT 'src' || CAST(u.user_id AS VARCHAR) AS source, count(*) FILTER (e.event_type = 'click') AS item_count, count(*) FILTER (e.event_type IN ('click', 'view')) AS candidate_count,
  max(CASE WHEN e.event_type = 'click' THEN e.ts END) AS newest, min(e.ts) AS oldest FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN events e ON e.user_id = u.user_id AND e.event_type <> 'error' GROUP BY u.user_id)"""


def _rules(t):
    return t.read("events").select("user_id").distinct().selectExpr(
        "concat('src', user_id) AS source", "cast(40 + user_id % 40 AS int) AS minimum_items", "if(user_id % 3 = 0, cast(2 + user_id % 5 AS int), null) AS maximum_age_days"
    )


def _counts(t):
    e = t.read("events").where("event_type <> 'error'").selectExpr("concat('src', user_id) AS source", "event_type = 'click' AS kept", "event_type IN ('click', 'view') AS candidate", "cast(ts AS timestamp) AS published_at")
    return health.source_counts(e, t.health.select("source").distinct())


@query("agg_source_counts", with_tables(COUNTS) + f"SELECT source, item_count, candidate_count, {text_ts('newest')} AS newest, {text_ts('oldest')} AS oldest FROM counts")
def _(t):
    return _counts(t).select("source", "item_count", "candidate_count", utc_text(F.col("newest_published_at")).alias("newest"), utc_text(F.col("oldest_published_at")).alias("oldest"))


@query("agg_candidates", with_tables(T.NEWS) + f"""SELECT source, count(*) FILTER (doc_id % 11 = 0 OR (published_at >= {SINCE} AND (link = '' OR contains(link, '/guidance/')))) AS candidates FROM news GROUP BY source""")
def _(t):
    stamp = F.when(F.col("doc_id") % 11 != 0, F.col("published_at"))
    link = F.when(F.col("doc_id") % 11 != 0, F.col("link")).otherwise(F.lit(""))
    return t.news.groupBy("source").agg(F.count_if(health.is_candidate(stamp, link, F.contains("link", F.lit("/guidance/")), t.since, None)).alias("candidates"))


MIN_TEXT = "c.source || ' 筆數異常：取得 ' || CAST(item_count AS VARCHAR) || ' 筆，低於健康門檻 ' || CAST(minimum_items AS VARCHAR) || ' 筆'"


@query("health_rule_min_items", with_tables(COUNTS, RULES) + f"SELECT c.source, CASE WHEN item_count < minimum_items THEN {MIN_TEXT} ELSE '' END AS warning FROM counts c JOIN rules r ON c.source = r.source")
def _(t):
    joined = _counts(t).join(_rules(t), "source")
    return joined.select("source", F.coalesce(health.minimum_items_warning(F.col("source"), F.col("item_count"), F.col("minimum_items")), F.lit("")).alias("warning"))


STALE = "age IS NOT NULL AND newest < TIMESTAMP '2024-02-01' - to_days(age)"


@query("health_rule_stale", with_tables(COUNTS, RULES) + f"SELECT c.source, CASE WHEN {STALE} THEN c.source || ' 最新資料已超過 ' || CAST(age AS VARCHAR) || ' 天' ELSE '' END AS warning FROM counts c JOIN rules r ON c.source = r.source")
def _(t):
    joined = _counts(t).join(_rules(t), "source")
    warning = health.stale_warning(F.col("source"), F.col("newest_published_at"), F.col("maximum_age_days"), t.since, t.now)
    return joined.select("source", F.coalesce(warning, F.lit("")).alias("warning"))


@query("health_rule_coverage", with_tables(COUNTS) + "SELECT source, CASE WHEN oldest > TIMESTAMP '2024-01-01 06:00:00' THEN source || ' 官方 RSS 最舊資料晚於查詢起日，期間可能不完整' ELSE '' END AS warning FROM counts")
def _(t):
    warning = health.coverage_warning(F.col("source"), F.col("oldest_published_at"), F.lit("2024-01-01 06:00:00").cast("timestamp"))
    return _counts(t).select("source", F.coalesce(warning, F.lit("")).alias("warning"))


@query("health_rule_zero_parse", """SELECT 'src' || CAST(user_id AS VARCHAR) AS source, CAST(d AS VARCHAR) AS day, CASE WHEN count(*) FILTER (event_type = 'view') > 0 AND count(*) FILTER (event_type = 'click') = 0 THEN 'src' || CAST(user_id AS VARCHAR) || ' RSS 有候選資料但解析為零筆：feed' ELSE '' END AS warning
  FROM (SELECT *, CAST(ts AS DATE) AS d FROM events) GROUP BY user_id, d""")
def _(t):
    e = t.read("events").selectExpr("concat('src', user_id) AS source", "cast(cast(ts AS date) AS string) AS day", "event_type")
    counted = e.groupBy("source", "day").agg(F.count_if(F.col("event_type") == "view").alias("c"), F.count_if(F.col("event_type") == "click").alias("p"))
    return counted.select("source", "day", F.coalesce(health.zero_parse_warning(F.col("source"), F.col("c"), F.col("p"), F.lit("feed")), F.lit("")).alias("warning"))


@query("agg_source_health", with_tables(T.HEALTH, COUNTS, RULES) + f""", w AS (SELECT source, warning, min(event_id) AS p FROM health WHERE warning <> '' GROUP BY source, warning), ws AS (SELECT source, string_agg(warning, '；' ORDER BY p) AS listed FROM w GROUP BY source)
  SELECT c.source, item_count, candidate_count, concat_ws('；', CASE WHEN item_count < minimum_items THEN {MIN_TEXT} WHEN {STALE} THEN c.source || ' 最新資料已超過 ' || CAST(age AS VARCHAR) || ' 天' END, listed,
    CASE WHEN candidate_count > 0 AND item_count = 0 AND coalesce(listed, '') NOT LIKE '%解析為零筆%' THEN c.source || ' 有候選資料但解析為零筆' END) AS warning
  FROM counts c JOIN rules r ON c.source = r.source LEFT JOIN ws ON c.source = ws.source""")
def _(t):
    told = t.health.select("source", "warning", F.col("event_id").alias("position"))
    return health.source_health(_counts(t), _rules(t), told, t.since, t.now).select("source", "item_count", "candidate_count", "warning")


@query("agg_failed_health", """SELECT 'src' || CAST(user_id AS VARCHAR) AS source, max(event_id) AS attempts, arg_min(event_type || CAST(event_id AS VARCHAR), event_id) AS first_error, arg_max(event_type || CAST(event_id AS VARCHAR), event_id) AS error, false AS success FROM events GROUP BY user_id""")
def _(t):
    attempts = t.read("events").selectExpr("concat('src', user_id) AS source", "event_id AS attempt", "concat(event_type, event_id) AS error")
    return health.failed_health(attempts)


@query("agg_run_status", with_tables(T.HEALTH) + """, w AS (SELECT source, warning, min(event_id) AS p FROM health WHERE warning <> '' GROUP BY source, warning)
  SELECT h.source, CASE WHEN bool_and((success AND warning = '') OR NOT critical) THEN 'complete' ELSE 'degraded' END AS status, (SELECT coalesce(string_agg(warning, '|' ORDER BY p), '') FROM w WHERE w.source = h.source) AS warnings FROM health h GROUP BY h.source""")
def _(t):
    return health.run_status(t.health.withColumn("position", F.col("event_id")), ["source"], critical_only=True).select("source", "status", F.array_join("warnings", "|").alias("warnings"))


@query("agg_observability", with_tables(T.HEALTH) + """, c AS (SELECT * FROM health WHERE critical), r AS (SELECT duration_seconds, row_number() OVER (ORDER BY duration_seconds) AS i, count(*) OVER () AS n FROM c),
  o AS (SELECT count(*) AS source_count, avg(CAST(success AS INTEGER)) AS rate, avg(CAST(item_count = 0 AS INTEGER)) AS zero, (SELECT min(duration_seconds) FROM r WHERE i = CAST(ceil(n * 0.95) AS BIGINT)) AS p95 FROM c)
  SELECT source_count, round_even(rate, 3) AS source_success_rate, round_even(p95, 3) AS source_p95_seconds, round_even(zero, 3) AS zero_item_ratio,
  concat_ws('|', CASE WHEN rate < 0.9 THEN 'source_success_rate' END, CASE WHEN p95 > 60 THEN 'source_p95_seconds' END, CASE WHEN zero > 0.25 THEN 'zero_item_ratio' END) AS alerts FROM o""")
def _(t):
    return health.observability(t.health).withColumn("alerts", F.array_join("alerts", "|"))


@query("agg_http_counts", with_tables(T.HTTP) + """SELECT CASE WHEN contains(url, 'news.google.com') THEN 'fallback' WHEN contains(url, '/api/search.json') THEN 'search_api' ELSE 'list' END AS category,
  count(*) AS attempted_count, count(*) FILTER (retry) AS retry_count, count(*) FILTER (status_code = 429) AS rate_limited_count FROM http_log GROUP BY category""")
def _(t):
    return health.http_counts(t.http_log)


@query("route_category", with_tables(T.HTTP) + "SELECT event_id, CASE WHEN contains(url, 'news.google.com') THEN 'fallback' WHEN contains(url, '/api/search.json') THEN 'search_api' ELSE 'list' END AS category FROM http_log")
def _(t):
    return t.http_log.select("event_id", route_category(F.col("url")).alias("category"))


@query("agg_failed_sources", with_tables(T.HEALTH, T.HEALTH_SOURCES) + """SELECT DISTINCT coalesce(s.source_id, 'UK Parliament') AS source_id, coalesce(s.source_ord, (SELECT max(source_ord) + 1 FROM health_sources)) AS source_ord
  FROM health h LEFT JOIN health_sources s ON h.source = s.source_id WHERE (NOT h.success OR h.warning <> '') AND h.item_count = 0 AND h.duration_seconds > 5""")
def _(t):
    return health.failed_sources(t.health.where("item_count = 0 AND duration_seconds > 5"), t.health_sources)


ADVICE = """concat_ws('|', CASE WHEN NOT success THEN '取得失敗' END, CASE WHEN contains(warning, '解析為零') OR (candidate_count > 0 AND item_count = 0) THEN '解析需檢查' END,
  CASE WHEN contains(warning, '最新資料已超過') THEN '發布頻率需核對' END)"""


@query("health_advice", with_tables(T.HEALTH) + f"SELECT event_id, CASE WHEN {ADVICE} <> '' THEN {ADVICE} WHEN warning <> '' THEN '需注意' WHEN item_count = 0 THEN '期間內未取得資料' ELSE '正常' END AS advice FROM health")
def _(t):
    advice = health.health_advice(F.col("success"), F.col("warning"), F.col("candidate_count"), F.col("item_count"))
    return t.health.select("event_id", F.array_join(advice, "|").alias("advice"))


@query("sort_health_attention", with_tables(T.HEALTH) + "SELECT row_number() OVER (ORDER BY CASE WHEN NOT success OR warning <> '' THEN 0 ELSE 1 END, event_id) AS place, event_id FROM health")
def _(t):
    attention = F.when(health.needs_attention(F.col("success"), F.col("warning")), 0).otherwise(1)
    return ranking.number_rows(t.health.select("event_id", attention.alias("a")), [F.col("a"), F.col("event_id")], "place").select("place", "event_id")


@query("quality_issues", with_tables(T.HEALTH) + """SELECT source, CASE WHEN NOT success THEN 'fetch_failed' WHEN candidate_count > 0 AND item_count = 0 THEN 'parser_empty' ELSE 'parser_warning' END AS kind, count(*) AS issues FROM health
  WHERE NOT success OR (candidate_count > 0 AND item_count = 0) OR contains(warning, '解析為零') GROUP BY 1, 2 UNION ALL SELECT 'doc' AS source, 'invalid_record' AS kind, count(*) AS issues FROM documents WHERE doc_id % 3 = 0""")
def _(t):
    records = t.read("documents").select(F.lit("doc").alias("source"), F.lit("t").alias("title"), (F.col("doc_id") % 3 != 0).alias("valid"))
    return health.quality_issues(t.health, records).groupBy("source", "kind").agg(F.count("*").alias("issues"))


@query("transient_only", with_tables(T.HEALTH, T.HTTP) + """, f AS (SELECT h.candidate_count, l.status_code FROM health h JOIN http_log l ON h.event_id = l.event_id WHERE NOT h.success)
  SELECT (SELECT count(*) FROM f) > 0 AND bool_and(candidate_count = 0 AND status_code IN (0, 429, 500, 502, 503, 504)) AS transient_only FROM f""")
def _(t):
    joined = t.health.join(t.http_log, "event_id").withColumn("endpoints", F.array(F.struct(F.lit("https://news.google.com/rss/search").alias("url"), F.col("status_code"))))
    issues = t.health.where("NOT success").select(F.lit("fetch_failed").alias("kind"))
    return health.transient_only(issues, joined)


# --- paging and tiers -----------------------------------------------------------------------------------------

PAGES = f"""paged AS (SELECT 'src' || CAST(user_id AS VARCHAR) AS source, 30 - CAST(datediff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS INTEGER) AS page_no, count(*) AS entries, count(*) FILTER (event_type <> 'error') AS dated, min(ts) AS oldest FROM events GROUP BY 1, 2)"""


def _pages(t):
    e = t.read("events").selectExpr("concat('src', user_id) AS source", "30 - datediff(ts, date'2024-01-01') AS page_no", "event_type", "cast(ts AS timestamp) AS ts")
    return e.groupBy("source", "page_no").agg(F.count("*").alias("entries"), F.count_if(F.col("event_type") != "error").alias("dated"), F.min("ts").alias("oldest"))


def _cut(stop: str, extra: str = "") -> str:
    return with_tables(PAGES) + f""", b AS (SELECT *, {stop} AS stop FROM paged), l AS (SELECT source, min(CASE WHEN stop THEN page_no END) AS last FROM b GROUP BY source)
  SELECT b.source, b.page_no, b.entries FROM b JOIN l ON b.source = l.source WHERE (l.last IS NULL OR b.page_no <= l.last) {extra}"""


def _since(t):
    return F.lit("2024-01-10").cast("timestamp")


@query("page_cutoff_feed", _cut(f"entries < 10 OR dated = 0 OR oldest < {EVENT_SINCE}"))
def _(t):
    return cutoff.page_cutoff_feed(_pages(t), ["source"], _since(t)).select("source", "page_no", "entries")


@query("page_cutoff_api", _cut(f"entries < 2 OR oldest < {EVENT_SINCE}"))
def _(t):
    return cutoff.page_cutoff_api(_pages(t), ["source"], _since(t), 2).select("source", "page_no", "entries")


@query("page_cutoff_archive", _cut(f"entries = 0 OR oldest < {EVENT_SINCE}", "AND b.entries > 0"))
def _(t):
    return cutoff.page_cutoff_archive(_pages(t), ["source"], _since(t)).select("source", "page_no", "entries")


@query("page_cutoff_search", with_tables(PAGES) + """, r AS (SELECT *, dated > 0 AS readable, sum(CASE WHEN dated > 0 THEN entries ELSE 0 END) OVER (PARTITION BY source ORDER BY page_no) AS fetched FROM paged),
  l AS (SELECT source, min(CASE WHEN NOT readable OR entries = 0 OR fetched >= 40 THEN page_no END) AS last FROM r GROUP BY source)
  SELECT r.source, r.page_no, r.entries FROM r JOIN l ON r.source = l.source WHERE readable AND (l.last IS NULL OR r.page_no <= l.last)""")
def _(t):
    pages = _pages(t).withColumns({"readable": F.col("dated") > 0, "total": F.lit(40)})
    return cutoff.page_cutoff_search(pages, ["source"])[0].select("source", "page_no", "entries")


@query("fallback_tier", """SELECT event_id FROM (SELECT event_id, user_id, CASE event_type WHEN 'error' THEN NULL WHEN 'click' THEN 1 WHEN 'view' THEN 2 ELSE 3 END AS tier, value FROM events WHERE value > 30) e
  WHERE tier IS NULL OR tier = (SELECT min(CASE event_type WHEN 'error' THEN NULL WHEN 'click' THEN 1 WHEN 'view' THEN 2 ELSE 3 END) FROM events x WHERE x.user_id = e.user_id AND x.value > 30)""")
def _(t):
    rows = t.read("events").where("value > 30").selectExpr("event_id", "user_id AS source_id", "case event_type when 'error' then null when 'click' then 1 when 'view' then 2 else 3 end AS tier")
    return cutoff.fallback_tier(rows).select("event_id")


@query("streak_matches", "SELECT count(*) AS consecutive_matches FROM events WHERE ts > (SELECT max(ts) FROM events WHERE event_type = 'signup')")
def _(t):
    return cutoff.trailing_matches(t.read("events").selectExpr("ts AS compared_at", "event_type <> 'signup' AS logical_match"))


# --- run tables ---------------------------------------------------------------------------------------------------


@query("validate_summary", with_tables(T.RUNS) + "SELECT o_orderkey, concat_ws('|', CASE WHEN o_orderkey % 7 = 0 THEN 'missing_run_id' END, CASE WHEN o_orderkey % 5 = 0 THEN 'unknown_status' END) AS broken FROM runs")
def _(t):
    rows = t.runs.withColumns({
        "run_id": F.expr("if(o_orderkey % 7 = 0, '', run_id)"), "status": F.expr("if(o_orderkey % 5 = 0, 'failed', status)"), "delivery_id": F.col("data_fingerprint"),
    })
    return runs.validate_summary(rows).select("o_orderkey", F.array_join("broken", "|").alias("broken"))


@query("limit_history", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderdate DESC, o_orderkey LIMIT 30")
def _(t):
    return runs.limit_history(t.read("orders").where("o_orderstatus = 'F'"), "o_orderdate", "o_orderkey").select("o_orderkey")


@query("latest_report", with_tables(T.RUNS) + "SELECT run_id, output_file, max(o_orderkey) AS o_orderkey FROM runs GROUP BY run_id, output_file")
def _(t):
    return runs.latest_reports(t.runs.withColumn("history_seq", F.col("o_orderkey"))).select("run_id", "output_file", "o_orderkey")


@query("report_state", with_tables(T.RUNS) + "SELECT o_orderkey, CASE status WHEN 'complete' THEN '已產生・完整' ELSE '已產生・來源需注意' END AS state, o_orderkey % 3 = 0 OR o_orderkey % 4 = 0 AS needs_retry FROM runs")
def _(t):
    listed = F.array(F.struct((F.col("o_orderkey") % 3 != 0).alias("success"), F.lit("").alias("warning")), F.struct(F.lit(True).alias("success"), F.when(F.col("o_orderkey") % 4 == 0, F.lit("w")).otherwise(F.lit("")).alias("warning")))
    return t.runs.select("o_orderkey", runs.report_state(F.col("status")).alias("state"), runs.needs_retry(listed).alias("needs_retry"))


@query("measured_performance", "SELECT o_orderkey, o_orderkey % 3 <> 0 AND o_totalprice > 100000 AND o_orderkey % 5 <> 0 AS measured FROM orders")
def _(t):
    p = F.struct((F.col("o_orderkey") % 3 != 0).cast("int").alias("schema_version"), F.when(F.col("o_totalprice") > 100000, F.col("o_totalprice")).otherwise(F.lit(0.0)).alias("total_wall_seconds"),
                 F.when(F.col("o_orderkey") % 5 != 0, F.lit("1.0")).otherwise(F.lit("")).alias("runtime_version"))
    return t.read("orders").select("o_orderkey", runs.is_measured(p).alias("measured"))


def _side(t, shift: int):
    rows = t.read("customer").selectExpr(
        "c_custkey AS period_start", "c_custkey AS period_end", "c_custkey AS all_news_count", f"if(c_custkey % 4 = 0, c_custkey + {shift}, c_custkey) AS filtered_news_count", "1 AS parliament_count", "1 AS filtered_parliament_count",
        f"if(c_custkey % 3 = 0, concat('f', {shift}), 'f') AS data_fingerprint", "'complete' AS status", "cast(null AS string) AS delivery_id", "c_mktsegment AS profile_hash", "c_name AS health_contract", "c_name AS provenance_contract",
        "c_nationkey AS source_count", "round(c_acctbal, 1) AS source_success_rate",
    )
    return rows


@query("compare_runs", """SELECT field, count(*) AS compared, count(*) FILTER (m) AS matched FROM (SELECT unnest(['all_news_count', 'filtered_news_count', 'parliament_count', 'filtered_parliament_count', 'data_fingerprint', 'status', 'delivery_id', 'profile_hash', 'health_contract',
  'provenance_contract', 'source_count', 'source_success_rate']) AS field, unnest([true, c_custkey % 4 <> 0, true, true, c_custkey % 3 <> 0, true, true, true, true, true, true, true]) AS m FROM customer) GROUP BY field""")
def _(t):
    compared = runs.compare_runs(_side(t, 1), _side(t, 2))
    return compared.groupBy("field").agg(F.count("*").alias("compared"), F.count_if("match").alias("matched"))


@query("logical_match", "SELECT c_custkey AS period_start, c_custkey % 4 <> 0 AND c_custkey % 3 <> 0 AS logical_match FROM customer")
def _(t):
    return runs.logical_matches(runs.compare_runs(_side(t, 1), _side(t, 2))).select("period_start", "logical_match")


@query("except_record_parity", """SELECT coalesce(a.l_partkey, b.l_partkey) AS l_partkey, CAST(coalesce(a.n, 0) AS BIGINT) AS left_count, CAST(coalesce(b.n, 0) AS BIGINT) AS right_count FROM (SELECT l_partkey, count(*) AS n FROM lineitem WHERE l_linenumber < 4 GROUP BY 1) a
  FULL OUTER JOIN (SELECT l_partkey, count(*) AS n FROM lineitem WHERE l_linenumber > 3 GROUP BY 1) b ON a.l_partkey = b.l_partkey WHERE coalesce(a.n, 0) <> coalesce(b.n, 0)""")
def _(t):
    lines = t.read("lineitem")
    return runs.record_parity(lines.where("l_linenumber < 4").select("l_partkey"), lines.where("l_linenumber > 3").select("l_partkey"))


@query("sort_canonical", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') || '.000000+00:00' AS published_at FROM orders")
def _(t):
    items = t.read("orders").selectExpr("o_orderkey", "o_orderkey AS link", "date_format(o_orderdate, \"yyyy-MM-dd'T'HH:mm:ss'Z'\") AS published_at", "'t' AS title")
    return runs.sort_canonical(items).select("o_orderkey", "published_at")


# Every order is a recorded run; every seventh is recorded twice, every 31st again with another machine, and some lack a condition.
PERF_ENTRIES = """WITH entries AS (SELECT o.*, copy, 'run-' || CAST(o_orderkey AS VARCHAR) AS run_id, CASE WHEN o_orderkey % 50 = 0 THEN 0.0 ELSE o_totalprice END AS wall, CASE WHEN o_orderkey % 97 = 0 THEN ' ' ELSE 'rev-' || CAST(o_orderkey % 2 AS VARCHAR) END AS revision,
    CASE o_orderstatus WHEN 'F' THEN 'complete' ELSE 'degraded' END AS status, CASE WHEN o_orderkey % 9 = 0 THEN 'retry' ELSE 'full' END AS run_kind, CASE WHEN o_orderkey % 4 <> 2 THEN o_totalprice * 2 END AS export
  FROM orders o JOIN (VALUES (0), (1), (2)) c(copy) ON copy = 0 OR (copy = 1 AND o_orderkey % 7 = 0) OR (copy = 2 AND o_orderkey % 31 = 0)),
  samples AS (SELECT *, '{"context": {"cache_key": "empty", "cache_state": "cold", "machine": "Büro \\"8\\"", "revision": "' || revision || '"}, "counts": {"all_news_count": ' || CAST(o_custkey % 2 AS VARCHAR) || ', "filtered_news_count": 1, "filtered_parliament_count": 0, "parliament_count": 2}, '
    || '"health": [["src1", true, 0, ""], ["src2", ' || CASE status WHEN 'complete' THEN 'true' ELSE 'false' END || ', 3, "slow"]], "performance": {"run_kind": "' || run_kind || '", "runtime": "spark", "runtime_version": "4.1", "schema_version": 1, "total_endpoint": "write", "translation_cache_hits": null, "translation_cache_misses": 2, "workers": 8}, '
    || '"sources": ["src1", "src2"], "summary": {"data_fingerprint": "f", "period_end": "2024-01-07", "period_start": "2024-01-01", "profile_hash": "' || o_orderpriority || '", "status": "' || status || '"}}' AS conditions
    FROM entries WHERE copy = 0 AND wall > 0 AND trim(revision) <> '' AND o_orderkey % 31 <> 0) """


def _perf_entries(t):
    src1 = "named_struct('source', 'src1', 'success', true, 'item_count', cast(null AS bigint), 'warning', cast(null AS string))"
    src2 = "named_struct('source', 'src2', 'success', o_orderstatus = 'F', 'item_count', 3L, 'warning', 'slow')"
    copies = "explode(filter(array(0, if(o_orderkey % 7 = 0, 1, null), if(o_orderkey % 31 = 0, 2, null)), c -> c is not null)) AS copy"
    return t.read("orders").selectExpr("*", copies).selectExpr(
        """named_struct('revision', if(o_orderkey % 97 = 0, ' ', concat('rev-', o_orderkey % 2)), 'machine', if(copy = 2, 'other', 'Büro "8"'), 'cache_state', 'cold', 'cache_key', 'empty') AS context""",
        f"""named_struct('run_id', concat('run-', o_orderkey), 'generated_at', cast(o_orderdate AS string), 'output_file', 'report.xlsx', 'period_start', '2024-01-01', 'period_end', '2024-01-07', 'profile_hash', o_orderpriority,
          'status', if(o_orderstatus = 'F', 'complete', 'degraded'), 'data_fingerprint', 'f', 'selected_sources', if(o_orderkey div 2 % 2 = 0, array('src1', 'src2'), array('src2', 'src1')), 'source_health', if(o_orderkey div 2 % 2 = 0, array({src1}, {src2}), array({src2}, {src1})),
          'all_news_count', o_custkey % 2, 'filtered_news_count', 1, 'parliament_count', 2, 'filtered_parliament_count', 0, 'performance', named_struct('schema_version', 1, 'runtime', 'spark', 'runtime_version', '4.1', 'workers', 8, 'run_kind', if(o_orderkey % 9 = 0, 'retry', 'full'),
          'total_endpoint', 'write', 'translation_cache_hits', cast(null AS bigint), 'translation_cache_misses', 2L, 'total_wall_seconds', if(o_orderkey % 50 = 0, 0D, o_totalprice), 'stages', map('collection', o_totalprice, 'export', if(o_orderkey % 4 <> 2, o_totalprice * 2, null)))) AS summary""",
    )


def _spread_sql(value: str) -> str:
    """The four figures of a group, from the rows' places ``i`` of ``n``."""
    middle = f"(min(CASE WHEN i = (n + 1) // 2 THEN {value} END) + min(CASE WHEN i = n // 2 + 1 THEN {value} END)) / 2"
    return f"min({value}) AS min, max({value}) AS max, min(CASE WHEN i = CAST(ceil(n * 0.95) AS BIGINT) THEN {value} END) AS p95, {middle} AS median"


@query("agg_perf_groups", PERF_ENTRIES + f""", g AS (SELECT *, row_number() OVER (PARTITION BY conditions ORDER BY wall) AS i, count(*) OVER (PARTITION BY conditions) AS n FROM samples)
  SELECT left(sha256(conditions), 12) AS group_id, conditions, n AS sample_count, {_spread_sql('wall')}, n >= 3 AND min(run_kind) = 'full' AND min(status) = 'complete' AS baseline_ready FROM g GROUP BY conditions, n""")
def _(t):
    return baselines.baseline_groups(baselines.baseline_samples(_perf_entries(t)))


@query("agg_perf_stages", PERF_ENTRIES + f""", long AS (SELECT conditions, 'collection' AS stage, o_totalprice AS v FROM samples UNION ALL SELECT conditions, 'export', export FROM samples),
  g AS (SELECT *, row_number() OVER (PARTITION BY conditions, stage ORDER BY v) AS i, count(*) OVER (PARTITION BY conditions, stage) AS n, count(v) OVER (PARTITION BY conditions, stage) AS known FROM long),
  s AS (SELECT left(sha256(conditions), 12) AS group_id, stage, n = known AS whole, {_spread_sql('v')} FROM g GROUP BY conditions, stage, n, known)
  SELECT group_id, stage, {', '.join(f'CASE WHEN whole THEN {c} END AS {c}' for c in ('median', 'p95', 'min', 'max'))} FROM s""")
def _(t):
    return baselines.baseline_stages(baselines.baseline_samples(_perf_entries(t)))


@query("agg_perf_dedupe", PERF_ENTRIES + """, faults AS (SELECT run_id, 'unmeasured' AS code FROM entries WHERE wall <= 0 UNION ALL SELECT run_id, 'unclear_conditions' FROM entries WHERE trim(revision) = ''
  UNION ALL SELECT run_id, 'conflicting_records' FROM entries WHERE wall > 0 AND trim(revision) <> '' AND o_orderkey % 31 = 0) SELECT run_id, code, count(*) AS records FROM faults GROUP BY run_id, code""")
def _(t):
    return baselines.baseline_issues(_perf_entries(t)).select("run_id", "code", "records")


@query("agg_perf_once", "SELECT count(*) AS samples FROM (SELECT DISTINCT o_custkey, o_orderdate FROM orders)")
def _(t):
    entries = t.read("orders").selectExpr("o_custkey AS run_id", "o_orderdate AS generated_at", "'f' AS output_file")
    return runs.once_per_run(entries).agg(F.count("*").alias("samples"))


@query("agg_percentile_bench", """SELECT p_brand, min(p_retailprice) AS best, round(avg(p_retailprice), 3) AS mean, min(CASE WHEN i = CAST(round_even((n - 1) * 0.95, 0) AS BIGINT) + 1 THEN p_retailprice END) AS p95
  FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice) AS i, count(*) OVER (PARTITION BY p_brand) AS n FROM part) GROUP BY p_brand""")
def _(t):
    part = t.read("part")
    stats = ranking.order_statistics(part, ["p_brand"], "p_retailprice", {"p95": lambda n: (F.bround((n - 1) * F.lit(0.95)) + 1).cast("bigint")})
    mean = part.groupBy("p_brand").agg(F.round(F.avg("p_retailprice"), 3).alias("mean"))
    return stats.join(mean, "p_brand").select("p_brand", F.col("min").alias("best"), "mean", "p95")


@query("join_baseline_bench", """SELECT l_linenumber AS size, p95_ms > CASE l_linenumber WHEN 1 THEN 10.0 ELSE 30.0 END AS over_budget, p95_ms > b * 1.3 AS regressed FROM (SELECT l_linenumber, max(l_quantity) AS p95_ms, min(l_quantity) + l_linenumber * 10 AS b FROM lineitem WHERE l_linenumber < 3 GROUP BY 1)""")
def _(t):
    lines = t.read("lineitem").where("l_linenumber < 3").groupBy("l_linenumber").agg(F.max("l_quantity").alias("p95_ms"), (F.min("l_quantity") + F.col("l_linenumber") * 10).alias("b"))
    size = F.when(F.col("l_linenumber") == 1, F.lit("1000")).otherwise(F.lit("10000"))
    current, baseline = lines.select(size.alias("size"), "l_linenumber", "p95_ms"), lines.select(size.alias("size"), F.col("b").alias("p95_ms"))
    return runs.bench_budget(current, baseline).select(F.col("l_linenumber").alias("size"), "over_budget", "regressed")


# --- quality --------------------------------------------------------------------------------------------------------

LABEL_SCORES = with_tables(T.LABELLED) + ", " + matching_ctes(P, "labelled", "id") + ", cases AS (SELECT id, label, score >= 12 AS included FROM assessed)"


def _cases(t):
    index = KeywordIndex.of(P)
    scored = computed(t.spread(t.labelled), {"score": index.assess(F.col("title"), F.col("summary"))["score"]})
    return scored.select("id", "label", (F.col("score") >= 12).alias("included"))


@query("agg_confusion", LABEL_SCORES + """, k AS (SELECT count(*) FILTER (label = 'related' AND included) AS tp, count(*) FILTER (label = 'unrelated' AND included) AS fp, count(*) FILTER (label = 'unrelated' AND NOT included) AS tn,
  count(*) FILTER (label = 'related' AND NOT included) AS fn, count(*) FILTER (label = 'boundary') AS boundary_count FROM cases) SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) END AS recall FROM k""")
def _(t):
    return runs.confusion(_cases(t))


@query("scan_labelled_cases", with_tables(T.LABELLED) + "SELECT CAST(id AS VARCHAR) AS id, 'duplicate' AS issue FROM labelled GROUP BY id HAVING count(*) > 1 UNION ALL SELECT CAST(id AS VARCHAR), 'unknown_label' FROM labelled WHERE id % 50 = 0")
def _(t):
    return runs.labelled_issues(t.labelled.withColumn("label", F.expr("if(id % 50 = 0, 'maybe', label)")))


@query("join_baseline_cases", LABEL_SCORES + """SELECT coalesce(c.id, b.id) AS id, CASE WHEN b.id IS NULL THEN 'added' WHEN c.id IS NULL THEN 'missing' ELSE 'changed' END AS change,
  coalesce(b.id IS NOT NULL AND ((c.label = 'related' AND NOT c.included) OR (c.label = 'unrelated' AND c.included)), false) AS regression
  FROM (SELECT * FROM cases WHERE id % 7 <> 0) c FULL OUTER JOIN (SELECT id, CASE WHEN id % 5 = 0 THEN NOT included ELSE included END AS included FROM cases WHERE id % 11 <> 0) b ON c.id = b.id WHERE c.included IS DISTINCT FROM b.included""")
def _(t):
    cases = _cases(t)
    before = cases.where("id % 11 <> 0").select("id", F.expr("if(id % 5 = 0, NOT included, included)").alias("included"))
    return runs.compare_cases(cases.where("id % 7 <> 0"), before).select("id", "change", "regression")


# --- reports -----------------------------------------------------------------------------------------------------------

REPORT_ORDER = f"agency, published_at, {T.fold('title')}, link, title, unit_category"


@query("report_all_news", with_tables(T.NEWS, KEYED, DEDUPED) + f"SELECT row_number() OVER (ORDER BY {REPORT_ORDER}) AS number, agency, strftime(published_at, '%Y-%m-%d') AS news_date, unit_category, 'news' AS content_type, title, link FROM deduped")
def _(t):
    return reports.news_report(t.news).withColumn("news_date", F.col("news_date").cast("string"))


@query("row_numbering", "SELECT row_number() OVER (ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS number, l_orderkey, l_linenumber FROM lineitem")
def _(t):
    order = [F.col(c) for c in ("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")]
    return ranking.number_rows(t.read("lineitem").select("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"), order).select("number", "l_orderkey", "l_linenumber")


FILTERED_REPORT = f"""SELECT row_number() OVER (ORDER BY {REPORT_ORDER}) AS number, doc_id_text, topics, keywords, level, score, core, general, supporting FROM (SELECT *, title AS doc_id_text, {joined_topics(P)} AS topics, {joined_phrases(P, 'kt{i} OR ks{i}')} AS keywords, {LEVEL} AS level,
  {joined_phrases(P, 'kt{i} OR ks{i}', strength='core')} AS core, {joined_phrases(P, 'kt{i} OR ks{i}', strength='general')} AS general, {joined_phrases(P, 'kt{i} OR ks{i}', strength='supporting')} AS supporting FROM assessed WHERE score >= 12 AND NOT {HOMEPAGE})"""


@query("report_filtered_news", with_tables(T.NEWS, KEYED, FIRST_ARRIVED) + ", " + matching_ctes(P, "deduped", "doc_id") + FILTERED_REPORT)
def _(t):
    rows = relevance.filter_relevant(t.spread(dedupe.dedupe_news(t.news, ARRIVAL)), P)
    return reports.news_report(rows, matches=True).select("number", F.col("title").alias("doc_id_text"), "topics", "keywords", "level", "score", "core", "general", "supporting")


@query("report_briefings", with_tables(T.BRIEFINGS) + "SELECT strftime(published_at, '%Y-%m-%d') AS data_date, 'United Kingdom' AS country, 'UK Parliament' AS institution, chamber, publisher, title, identifier, webpage_url FROM briefings")
def _(t):
    return reports.briefing_report(t.briefings).select(F.col("data_date").cast("string").alias("data_date"), "country", "institution", "chamber", "publisher", "title", "identifier", "webpage_url")


@query("report_bilingual_rows", with_tables(T.NEWS, KEYED, DEDUPED) + f""", r AS (SELECT row_number() OVER (ORDER BY {REPORT_ORDER}) AS number, title FROM deduped), tr AS (SELECT title AS text, min('tr ' || title) AS translation FROM news WHERE doc_id % 2 = 0 GROUP BY title)
  SELECT number, 0 AS line, title AS text FROM r UNION ALL SELECT number, 1, coalesce(translation, '') FROM r LEFT JOIN tr ON r.title = tr.text""")
def _(t):
    translations = t.news.where("doc_id % 2 = 0").groupBy(F.col("title").alias("text")).agg(F.min(F.concat(F.lit("tr "), "title")).alias("translation"))
    return reports.bilingual_rows(reports.news_report(t.news).select("number", "title"), translations)


@query("report_sections", with_tables(T.NEWS, T.BRIEFINGS) + "SELECT section, count(*) AS records, count(chamber) AS with_chamber FROM (SELECT '新聞稿' AS section, NULL AS chamber FROM news UNION ALL SELECT '研究', chamber FROM briefings) GROUP BY section")
def _(t):
    both = reports.report_sections(t.news.select("title", "agency"), t.briefings.select("title", "chamber"))
    return both.groupBy("section").agg(F.count("*").alias("records"), F.count("chamber").alias("with_chamber"))


_SETTING_ROWS = " UNION ALL ".join(
    f"SELECT 'keyword' AS row_kind, '{tp}' AS name, '{w}' AS value, {V.TITLE_WEIGHTS[s]} AS title_score, {V.SUMMARY_WEIGHTS[s]} AS summary_score" for tp, ws in P.topics for w, s in ws
)


@query("report_settings", with_tables(T.NEWS) + f"{_SETTING_ROWS} UNION ALL SELECT 'notice', '備援資料日期', 'x', NULL, NULL FROM (SELECT bool_or(contains(source_feed, 'news.google.com/')) AS used FROM news) WHERE used")
def _(t):
    rows = reports.settings_report(t.spark, P, "hash", "gregorian", t.news)
    return rows.where("row_kind <> 'setting'").select("row_kind", "name", "value", "title_score", "summary_score")


@query("report_strength_tag", with_tables(T.NEWS) + ', ' + SCORED_CTES + f""" SELECT doc_id, CASE WHEN ({joined_phrases(P, 'kt{i}', strength='core')}) <> '' THEN 'core' WHEN ({joined_phrases(P, 'kt{i}', strength='general')}) <> '' THEN 'general'
  WHEN ({joined_phrases(P, 'kt{i}', strength='supporting')}) <> '' THEN 'supporting' ELSE {LEVEL} END AS tag FROM assessed WHERE score >= 12 AND NOT {HOMEPAGE}""")
def _(t):
    rows = relevance.filter_relevant(t.spread(t.news), P)
    return rows.select("doc_id", relevance.strongest_tag(F.col("title_keyword_strengths"), F.col("relevance_level")).alias("tag"))


# --- ledger --------------------------------------------------------------------------------------------------------------

LEDGER = """ledger AS (SELECT 'd' || CAST(o_custkey AS VARCHAR) AS delivery_id, CASE o_orderstatus WHEN 'F' THEN 'sent' WHEN 'O' THEN 'claimed' ELSE 'released' END AS event, 'run-' || CAST(o_custkey AS VARCHAR) AS run_id, o_orderkey AS event_seq FROM orders)"""
STATE = "state AS (SELECT delivery_id, arg_max(event, event_seq) AS state, max(event_seq) AS event_seq FROM ledger GROUP BY delivery_id HAVING arg_max(event, event_seq) <> 'released')"


def _ledger(t):
    return t.read("orders").selectExpr(
        "concat('d', o_custkey) AS delivery_id", "case o_orderstatus when 'F' then 'sent' when 'O' then 'claimed' else 'released' end AS event", "concat('run-', o_custkey) AS run_id", "'complete' AS status",
        "'f' AS data_fingerprint", "'x.xlsx' AS excel_path", "'' AS message_id", "o_orderkey AS event_seq",
    )


@query("ledger_state", with_tables(LEDGER, STATE) + "SELECT * FROM state")
def _(t):
    return ledger.ledger_state(_ledger(t)).select("delivery_id", "state", "event_seq")


@query("agg_ledger_status", with_tables(LEDGER, STATE) + "SELECT state, count(*) AS deliveries FROM state GROUP BY state")
def _(t):
    return ledger.ledger_status(ledger.ledger_state(_ledger(t)))


CLAIMS = "requests AS (SELECT 'd' || CAST(c_custkey // 2 AS VARCHAR) AS delivery_id, CASE WHEN c_custkey % 50 = 0 THEN 'd' || CAST(c_custkey AS VARCHAR) ELSE 'run-' || CAST(c_custkey AS VARCHAR) END AS run_id FROM customer)"


def _requests(t):
    return t.read("customer").selectExpr("concat('d', c_custkey div 2) AS delivery_id", "if(c_custkey % 50 = 0, concat('d', c_custkey), concat('run-', c_custkey)) AS run_id", "'complete' AS status", "'f' AS data_fingerprint", "'x.xlsx' AS excel_path")


@query("ledger_claim", with_tables(LEDGER, STATE, CLAIMS) + "SELECT delivery_id, min(run_id) AS run_id FROM requests WHERE delivery_id NOT IN (SELECT delivery_id FROM state) AND run_id NOT IN (SELECT delivery_id FROM state) GROUP BY delivery_id")
def _(t):
    return ledger.claim(_requests(t), ledger.ledger_state(_ledger(t)), F.lit(10**12))[0].select("delivery_id", "run_id")


@query("join_ledger_claim", with_tables(LEDGER, STATE, CLAIMS) + """SELECT delivery_id, run_id, CASE WHEN run_id IN (SELECT delivery_id FROM state) THEN 'legacy run_id already sent' ELSE 'already claimed or sent' END AS reason FROM requests
  WHERE delivery_id IN (SELECT delivery_id FROM state) OR run_id IN (SELECT delivery_id FROM state)""")
def _(t):
    return ledger.claim(_requests(t), ledger.ledger_state(_ledger(t)), F.lit(10**12))[1]


@query("ledger_complete", with_tables(LEDGER, STATE) + "SELECT 'd' || CAST(c_custkey AS VARCHAR) AS delivery_id, coalesce((SELECT s.state FROM state s WHERE s.delivery_id = 'd' || CAST(c_custkey AS VARCHAR)) = 'claimed', false) AS sent FROM customer")
def _(t):
    asked = t.read("customer").selectExpr("concat('d', c_custkey) AS delivery_id", "'m' AS message_id")
    done, refused = ledger.complete(asked, ledger.ledger_state(_ledger(t)), F.lit(10**12))
    return done.select("delivery_id", F.lit(True).alias("sent")).unionByName(refused.select("delivery_id", F.lit(False).alias("sent")))


@query("ledger_release", with_tables(LEDGER, STATE) + "SELECT delivery_id FROM state WHERE state = 'claimed' AND delivery_id IN (SELECT 'd' || CAST(c_custkey AS VARCHAR) FROM customer)")
def _(t):
    asked = t.read("customer").selectExpr("concat('d', c_custkey) AS delivery_id")
    return ledger.recover(asked, ledger.ledger_state(_ledger(t)), F.lit(10**12), confirmed=True).select("delivery_id")


@query("ledger_recover", with_tables(LEDGER, STATE) + "SELECT s.delivery_id, 'released' AS event FROM state s WHERE s.state = 'claimed'")
def _(t):
    state = ledger.ledger_state(_ledger(t))
    return ledger.recover(state.select("delivery_id"), state, F.lit(10**12), confirmed=True).select("delivery_id", "event")
