"""Queries: the reviewed source catalogue."""

from __future__ import annotations

from pyspark.sql import functions as F

from pubwatch import fixed_values as V
from pubwatch.functions.dates import utc_text
from pubwatch.operators import catalog as C
from pubwatch.operators import filters
from pubwatch.sinks import reports
from pubwatch.sources import payloads
from pubwatch.workload import tables as T
from pubwatch.workload.registry import query
from pubwatch.workload.tables import text_ts, with_tables

CATALOG = with_tables(T.CATALOG)
AT = "2024-01-02T03:04:05+00:00"


@query("filter_catalog", CATALOG + """SELECT id AS source_id, CASE adapter WHEN 'feed' THEN feed WHEN 'govuk_search' THEN homepage || '.atom' ELSE '' END AS feeds, CASE adapter WHEN 'html_news' THEN news_page ELSE '' END AS news_pages, CASE adapter WHEN 'govuk_search' THEN 6 ELSE 0 END AS patterns
  FROM catalog WHERE status = 'searchable'""")
def _(t):
    rows = filters.searchable_agencies(t.catalog)
    return rows.select("source_id", F.array_join("feeds", "|").alias("feeds"), F.array_join("news_pages", "|").alias("news_pages"), F.size("link_include_patterns").alias("patterns"))


@query("search_catalog", CATALOG + "SELECT id FROM catalog WHERE jurisdiction = 'Scotland' AND contains(lower(id || name_zh || name_en || kind), 'machin')")
def _(t):
    return filters.search_catalog(t.catalog, "MACHIN", "Scotland").select("id")


@query("audit_targets", CATALOG + "SELECT id, CASE WHEN authority_url <> '' THEN authority_url ELSE homepage END AS homepage FROM catalog WHERE status = 'directory_only' OR review_status <> ''")
def _(t):
    return filters.audit_targets(t.catalog).select("id", "homepage")


@query("agg_shared_urls", CATALOG + "SELECT homepage, count(*) AS sources FROM catalog GROUP BY homepage HAVING count(*) > 1")
def _(t):
    return C.shared_urls(t.catalog)


@query("agg_jurisdictions", CATALOG + "SELECT jurisdiction, count(*) AS sources FROM catalog GROUP BY ROLLUP (jurisdiction)")
def _(t):
    return C.jurisdiction_counts(t.catalog)


AUDIT = """audit AS (SELECT id, k, name_en, CASE WHEN status = 'searchable' THEN 'verified' WHEN k % 5 = 0 THEN 'covered_by_parent' WHEN k % 5 = 1 THEN 'feed_validation_failed' WHEN k % 5 = 2 THEN 'available_as_other_source' ELSE 'no_verified_endpoint' END AS outcome,
  'checked | ' || CAST(k AS VARCHAR) AS reason FROM catalog)"""


def _audit(t):
    return t.catalog.selectExpr(
        "id", "k", "name_en", "case when status = 'searchable' then 'verified' when k % 5 = 0 then 'covered_by_parent' when k % 5 = 1 then 'feed_validation_failed' when k % 5 = 2 then 'available_as_other_source' else 'no_verified_endpoint' end AS outcome",
        "concat('checked | ', k) AS reason", "concat('https://endpoint.example/', k) AS endpoint", "jurisdiction",
    )


@query("agg_outcomes", CATALOG + f", {AUDIT} SELECT outcome, count(*) AS sources FROM audit GROUP BY outcome")
def _(t):
    return C.outcome_counts(_audit(t))


@query("audit_report", CATALOG + f", {AUDIT} SELECT id, name_en, outcome, CASE WHEN outcome = 'verified' THEN 'https://endpoint.example/' || CAST(k AS VARCHAR) ELSE replace(reason, '|', '\\|') END AS detail FROM audit")
def _(t):
    return reports.audit_report(_audit(t))


# --- review state --------------------------------------------------------------------------------------------


def _reviews(t):
    return t.catalog.where("k % 3 = 1").selectExpr(
        "id", "k", "case k % 2 when 0 then 'feed' else 'html_news' end AS adapter", "concat('https://reviewed.example/', k) AS homepage", "concat('https://reviewed.example/list/', k) AS endpoint",
        "'https://authority.example/' AS authority_url", f"'{AT}' AS checked_at",
    )


def _assessments(t):
    none = "cast(array() AS array<string>)"
    return t.catalog.where("k % 4 = 0").selectExpr("id", "k", "'no_verified_endpoint' AS outcome", "concat('held ', k) AS reason", f"'{AT}' AS checked_at", f"{none} AS parent_sources", f"{none} AS alternative_sources")


def _exclusions(t):
    return t.catalog.where("k % 5 = 0").select("id", "k")


STATE_COLUMNS = ("id", "homepage", "status", "adapter", "feed", "news_page", "reason", "review_status")
REVIEWED = "'https://reviewed.example/' || CAST(k AS VARCHAR)"
ENDPOINT = "'https://reviewed.example/list/' || CAST(k AS VARCHAR)"


def _state_sql(where: str, assessed: str, reviewed: str) -> str:
    def pick(review: str, hold: str, column: str) -> str:
        return f"CASE WHEN {reviewed} THEN {review} WHEN {assessed} THEN {hold} ELSE {column} END AS {column}"

    return CATALOG + "SELECT id, " + ", ".join((
        pick(REVIEWED, "homepage", "homepage"), pick("'searchable'", "'directory_only'", "status"), pick("CASE k % 2 WHEN 0 THEN 'feed' ELSE 'html_news' END", "''", "adapter"),
        pick(f"CASE k % 2 WHEN 0 THEN {ENDPOINT} ELSE '' END", "''", "feed"), pick(f"CASE k % 2 WHEN 0 THEN '' ELSE {ENDPOINT} END", "''", "news_page"), pick("''", "'held ' || CAST(k AS VARCHAR)", "reason"),
        pick("'verified'", "'no_verified_endpoint'", "review_status"),
    )) + f" FROM catalog WHERE {where}"


@query("join_catalog_overrides", _state_sql("true", "false", "k % 3 = 1"))
def _(t):
    return C.apply_overrides(t.catalog, _reviews(t)).select(*STATE_COLUMNS)


@query("join_catalog_assessments", _state_sql("true", "k % 4 = 0", "false"))
def _(t):
    return C.apply_assessments(t.catalog, _assessments(t)).select(*STATE_COLUMNS)


@query("join_catalog_exclusions", _state_sql("k % 5 <> 0", "false", "false"))
def _(t):
    return C.apply_exclusions(t.catalog, _exclusions(t)).select(*STATE_COLUMNS)


@query("catalog_review_state", _state_sql("k % 5 <> 0", "k % 4 = 0", "k % 3 = 1"))
def _(t):
    return C.apply_review_state(t.catalog, _reviews(t), _assessments(t), _exclusions(t)).select(*STATE_COLUMNS)


@query("catalog_id_issues", CATALOG + "SELECT 'x' || CAST(k AS VARCHAR) AS id, 'orphan' AS issue FROM catalog WHERE k % 10 = 0 UNION ALL SELECT id, 'duplicate' FROM catalog WHERE k % 6 = 0")
def _(t):
    rows = t.catalog.where("k % 6 = 0").select("id").unionByName(t.catalog.where("k % 6 = 0").select("id")).unionByName(t.catalog.where("k % 10 = 0").select(F.concat(F.lit("x"), "k").alias("id")))
    return C.id_issues(rows, t.catalog)


@query("validate_override", CATALOG + """SELECT id, concat_ws('|', CASE WHEN k % 7 = 0 THEN 'unknown_adapter' END, CASE WHEN k % 5 = 0 THEN 'insecure_url' END, CASE WHEN k % 7 <> 0 AND k % 2 = 1 AND k % 4 = 1 THEN 'foreign_html' WHEN k % 7 <> 0 AND k % 2 = 0 AND k % 4 = 2 THEN 'foreign_feed' END,
  CASE WHEN k % 11 = 0 THEN 'not_read' END, CASE WHEN k % 13 = 0 THEN 'bad_hash' END, CASE WHEN k % 17 = 0 THEN 'bad_time' END) AS broken FROM catalog""")
def _(t):
    rows = t.catalog.selectExpr(
        "id", "if(k % 7 = 0, 'other', if(k % 2 = 0, 'feed', 'html_news')) AS adapter", "concat(if(k % 5 = 0, 'http', 'https'), '://body.example/', k) AS homepage",
        "concat('https://', case k % 4 when 1 then 'other.example' when 2 then 'other.example' else 'body.example' end, '/x') AS endpoint", "'https://authority.example/' AS authority_url",
        f"""named_struct('http_status', if(k % 11 = 0, 404, 200), 'parsed_count', 3, 'response_sha256', if(k % 13 = 0, 'zz', sha2(id, 256)), 'production_parser_verified', true, 'python_rust_parity', true,
          'scope_verified', false, 'scope_endpoint', '', 'scope_homepage', '', 'checked_at', if(k % 17 = 0, '2024-01-02T03:04:05', '{AT}')) AS verification""",
    )
    return C.validate_override(rows).select("id", F.array_join("broken", "|").alias("broken"))


@query("validate_assessment", CATALOG + "SELECT id, concat_ws('|', CASE WHEN k % 3 = 0 THEN 'bad_outcome' END, CASE WHEN k % 4 = 0 THEN 'missing_reason' END) AS broken FROM catalog")
def _(t):
    rows = t.catalog.selectExpr("id", "if(k % 3 = 0, 'odd', 'policy_excluded') AS outcome", "if(k % 4 = 0, '', 'r') AS reason", f"'{AT}' AS checked_at")
    return C.validate_assessment(rows).select("id", F.array_join("broken", "|").alias("broken"))


@query("validate_exclusion", CATALOG + """SELECT id, concat_ws('|', CASE WHEN k % 3 = 0 THEN 'missing_reason' END, CASE WHEN k % 5 = 0 THEN 'not_restorable' END, CASE WHEN k % 2 = 0 AND k % 7 = 0 THEN 'state_not_kept' END, CASE WHEN k % 4 = 1 THEN 'missing_replacements' END) AS broken FROM catalog""")
def _(t):
    rows = t.catalog.selectExpr(
        "id", "if(k % 2 = 0, 'user_requested_removal', if(k % 4 = 1, 'covered_by_parent', 'policy_excluded')) AS outcome", "if(k % 3 = 0, '', 'r') AS reason", f"'{AT}' AS checked_at", "'https://authority.example/' AS authority_url",
        "cast(array() AS array<string>) AS replacement_sources", "named_struct('id', if(k % 5 = 0, 'zz', id), 'name_en', name_en, 'status', if(k % 7 = 0, 'searchable', 'directory_only'), 'reason', 'why') AS original_source",
        "'directory_only' AS original_status", "'why' AS original_reason",
    )
    return C.validate_exclusion(rows).select("id", F.array_join("broken", "|").alias("broken"))


# --- identities -------------------------------------------------------------------------------------------------


CONTACTS = """contacts AS (SELECT upper(name_en) AS name_en, CASE WHEN k % 2 = 0 THEN 'https://www.nidirect.gov.uk/c/' ELSE 'https://own.example/' END || CAST(k AS VARCHAR) AS contact_url, k AS position FROM catalog WHERE k % 4 <> 3)"""


def _contacts(t):
    return t.catalog.where("k % 4 <> 3").selectExpr(
        "upper(name_en) AS name_en", "concat(if(k % 2 = 0, 'https://www.nidirect.gov.uk/c/', 'https://own.example/'), k) AS contact_url", "'https://www.nidirect.gov.uk/letter/a' AS authority_url", "k AS position"
    )


@query("join_identity_names", CATALOG + f""", {CONTACTS} SELECT id, contact_url FROM (SELECT c.id, o.contact_url, row_number() OVER (PARTITION BY c.id ORDER BY CASE WHEN contains(o.contact_url, 'nidirect.gov.uk') THEN 1 ELSE 0 END, o.position) AS i
  FROM catalog c JOIN contacts o ON lower(o.name_en) = lower(c.name_en)) WHERE i = 1""")
def _(t):
    return C.join_identities(t.catalog.select("id", "name_en"), _contacts(t)).select("id", "contact_url")


@query("join_identity_evidence", CATALOG + """SELECT id, CASE WHEN NOT starts_with(id, 'ni:') THEN 'id_out_of_range' WHEN k % 3 = 0 THEN 'name_differs' WHEN k % 5 = 0 THEN 'authority_not_official' WHEN k % 2 = 0 THEN 'authority_not_read' WHEN k % 7 = 0 THEN 'link_not_listed' END AS issue FROM catalog
  WHERE NOT starts_with(id, 'ni:') OR k % 3 = 0 OR k % 5 = 0 OR k % 2 = 0 OR k % 7 = 0""")
def _(t):
    rows = t.catalog.selectExpr("id", "k", "name_en", "if(k % 3 = 0, 'Someone else', upper(name_en)) AS matched_name", "concat(if(k % 5 = 0, 'https://other.example/', 'https://www.health-ni.gov.uk/'), k) AS authority_url", "concat('https://own.example/', k) AS contact_url")
    log = rows.selectExpr("authority_url AS url", "if(k % 2 = 0, 404, 200) AS status_code")
    listed = rows.where("k % 7 <> 0").select("name_en", "contact_url", "authority_url")
    return C.identity_issues(rows.drop("name_en", "k"), t.catalog, log, listed)


@query("join_name_aliases", CATALOG + """, q AS (SELECT id, name_en, jurisdiction FROM catalog WHERE status = 'searchable' OR k % 4 = 1), r AS (SELECT id, name_en, jurisdiction FROM catalog WHERE status <> 'searchable')
  SELECT r.id, min(q.id) AS alternative_source FROM r JOIN q ON q.name_en = r.name_en AND q.id <> r.id AND q.jurisdiction = r.jurisdiction GROUP BY r.id HAVING count(*) = 1""")
def _(t):
    rows = t.catalog.where("status <> 'searchable'").select("id", "name_en", "jurisdiction")
    return C.name_aliases(rows, t.catalog.where("status = 'searchable' OR k % 4 = 1").select("id", "name_en", "jurisdiction"))


# --- audit and removals ---------------------------------------------------------------------------------------------


@query("verify_feed_rows", with_tables(T.NEWS) + f"""SELECT source AS id, count(*) AS parsed_count, {text_ts('min(published_at)')} AS oldest, {text_ts('max(published_at)')} AS newest, arg_min('https://www.body.example/' || CAST(doc_id AS VARCHAR), doc_id) AS sample_link
  FROM news WHERE doc_id % 4 <> 0 AND doc_id % 3 <> 0 AND published_at < TIMESTAMP '{T.UNTIL}' GROUP BY source""")
def _(t):
    entries = t.news.selectExpr(
        "source AS id", "'https://body.example/' AS homepage", "'https://body.example/feed' AS endpoint", "if(doc_id % 3 = 0, 'Hello world!', concat('Record ', doc_id)) AS title",
        "if(doc_id % 3 = 0, 'Welcome to WordPress. This is your first post.', 'text') AS summary", "concat(if(doc_id % 4 = 0, 'https://else.example/', 'https://www.body.example/'), doc_id) AS link", "published_at", "doc_id AS position",
    )
    rows = C.verify_feed_rows(entries, t.until)
    return rows.select("id", "parsed_count", utc_text(F.col("oldest_published_at")).alias("oldest"), utc_text(F.col("newest_published_at")).alias("newest"), "sample_link")


@query("audit_outcome", CATALOG + """SELECT id, CASE WHEN k % 10 = 0 THEN 'verified' WHEN k % 7 = 0 THEN 'covered_by_parent' WHEN starts_with(id, 'court-ew:') AND k % 3 = 0 THEN 'covered_by_parent' WHEN k % 4 = 0 THEN 'html_adapter_required' WHEN k % 5 = 1 THEN 'feed_validation_failed'
  WHEN k % 2 = 0 THEN 'network_or_access_error' ELSE 'no_verified_endpoint' END AS outcome FROM catalog""")
def _(t):
    rows = t.catalog.selectExpr("id", "k % 20 = 0 AS verified", "k % 10 = 0 AS html_verified", "false AS courts_page", "if(k % 7 = 0, array('UKRI'), cast(array() AS array<string>)) AS related", "k % 3 = 0 AS shared_court_feed",
                                "if(k % 4 = 0, 1, 0) AS attributable_news", "if(k % 5 = 1, 2, 0) AS candidates", "if(k % 2 = 0, 1, 0) AS failures")
    return C.audit_outcome(rows).select("id", "outcome")


def _planned(t):
    audit = _audit(t).join(t.catalog.select("id", F.col("k").alias("_k2")), "id").selectExpr("id", "outcome", "reason", "if(k % 2 = 0, array('UKRI'), array(concat('missing:', k))) AS parent_sources", "cast(array() AS array<string>) AS alternative_sources")
    return C.plan_removals(t.catalog, audit, ("UKRI",))


@query("plan_removals", CATALOG + f""", {AUDIT} SELECT a.id, a.outcome, CASE WHEN a.outcome = 'covered_by_parent' THEN '共用採集路由，移至既有發布來源；保留機關與替代路由對照（不表示機關裁撤）：' ELSE '' END || a.reason AS reason,
  CASE WHEN c.authority_url <> '' THEN c.authority_url ELSE c.provenance END AS authority_url, a.k % 2 = 0 AS replaceable FROM audit a JOIN catalog c ON a.id = c.id WHERE c.status <> 'searchable' AND a.outcome IN ('covered_by_parent', 'available_as_other_source')""")
def _(t):
    return _planned(t).select("id", "outcome", "reason", "authority_url", "replaceable")


@query("subset_replacements", CATALOG + f", {AUDIT} SELECT a.k % 2 = 0 AS replaceable, count(*) AS plans FROM audit a JOIN catalog c ON a.id = c.id WHERE c.status <> 'searchable' AND a.outcome IN ('covered_by_parent', 'available_as_other_source') GROUP BY 1")
def _(t):
    return _planned(t).groupBy("replaceable").agg(F.count("*").alias("plans"))


@query("plan_disabled", CATALOG + "SELECT id, CASE WHEN authority_url <> '' THEN authority_url ELSE provenance END AS authority_url, reason AS original_reason FROM catalog WHERE status = 'directory_only'")
def _(t):
    return C.plan_disabled(t.catalog).select("id", "authority_url", "original_reason")


def _plan_inputs(t):
    current = t.catalog.select("id", "k", F.to_json(F.struct("id", "name_en", "status")).alias("row_json"))
    plan = current.where("k % 3 = 1").select("id", F.when(F.col("k") % 7 == 0, F.lit("{}")).otherwise(F.col("row_json")).alias("original"))
    return C.apply_removal_plan(current.where("k % 5 = 0").select("id"), plan, current)


@query("apply_removal_plan", CATALOG + "SELECT id FROM catalog WHERE k % 5 = 0 OR k % 3 = 1")
def _(t):
    return _plan_inputs(t)[0].select("id")


@query("removal_plan_conflicts", CATALOG + "SELECT id FROM catalog WHERE k % 5 <> 0 AND k % 3 = 1 AND k % 7 = 0")
def _(t):
    return _plan_inputs(t)[1]


@query("runtime_holds", CATALOG + "SELECT id AS source, 'network_or_access_error' AS outcome FROM catalog WHERE k % 2 = 0 AND k % 3 = 0 AND k % 5 <> 0")
def _(t):
    rows = t.catalog.selectExpr(
        "id AS source", "explode(array('one', 'two')) AS runtime", "k", "concat('https://e.example/', k) AS _e"
    ).selectExpr("source", "runtime", "if(runtime = 'one', k % 2 <> 0, k % 3 <> 0) AS success", "array(named_struct('url', _e, 'status_code', if(k % 5 = 0, 200, 503))) AS endpoints")
    reviews = t.catalog.selectExpr("id", "concat('https://e.example/', k) AS endpoint")
    return C.runtime_holds(rows, reviews, ("one", "two")).select("source", "outcome")


@query("guard_min_rows", CATALOG + "SELECT count(*) AS rows FROM catalog")
def _(t):
    return C.guard_min_rows(t.catalog, 35, "catalogue")


@query("scan_org_api", CATALOG + f"SELECT 'govuk:body-' || CAST(k AS VARCHAR) AS id, name_en, CASE WHEN k % 3 = 0 THEN 'searchable' ELSE 'directory_only' END AS status, CASE WHEN k % 3 = 0 THEN 'govuk_search' ELSE '' END AS adapter FROM catalog WHERE k % 5 <> 0 AND k % 3 <> 2")
def _(t):
    root = V.GOV_ORGANISATIONS
    body = F.to_json(F.struct(F.array(F.struct(
        F.col("name_en").alias("title"), F.col("kind").alias("format"), F.concat(F.when(F.col("k") % 5 == 0, F.lit("https://elsewhere.example/")).otherwise(F.lit(root)), F.col("k")).alias("web_url"),
        F.struct(F.concat(F.lit("body-"), "k").alias("slug"), F.expr("case k % 3 when 0 then 'live' when 1 then 'exempt' else 'closed' end").alias("govuk_status")).alias("details"),
    )).alias("results")))
    return payloads.scan_organisations(t.catalog.select(body.alias("body")), F.lit("api")).select("id", "name_en", "status", "adapter")
