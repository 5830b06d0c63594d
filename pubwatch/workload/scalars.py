"""Queries: one per scalar function, over whole tables and whole texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from pubwatch import fixed_values as V
from pubwatch.functions import dates, text, urls
from pubwatch.operators import filters, provenance
from pubwatch.operators.catalog import unknown_ids
from pubwatch.sources import payloads
from pubwatch.workload import tables as T
from pubwatch.workload.registry import query
from pubwatch.workload.tables import text_ts, with_tables

# --- text ----------------------------------------------------------------------------------------------------

NO_TAGS = "html"
for _element in ("script", "style", "template"):
    NO_TAGS = f"regexp_replace({NO_TAGS}, '(?is)<{_element}\\b[^>]*>.*?</{_element}\\s*>', ' ', 'g')"
NO_TAGS = f"regexp_replace({NO_TAGS}, '(?s)<!--.*?-->', ' ', 'g')"
NO_TAGS = f"regexp_replace(regexp_replace({NO_TAGS}, '(?s)<[!?][^>]*>', ' ', 'g'), '(?s)</?[A-Za-z][^>]*>', ' ', 'g')"


def decoded(x: str) -> str:
    """SQL: the references that occur in the pages, with and without their semicolon."""
    for name, character in (("&copy;", "©"), ("&middot;", "·"), ("&quot;", '"'), ("&amp;", "&"), ("&amp", "&")):
        x = f"replace({x}, '{name}', '{character}')"
    return x


PAGE_TEXT = T.squeeze(decoded(NO_TAGS))


@query("clean_text", f"SELECT page_id, md5({PAGE_TEXT}) AS text_md5, length({PAGE_TEXT}) AS chars FROM pages")
def _(t):
    cleaned = t.spread(t.read("pages")).select("page_id", text.clean_text(F.col("html")).alias("x"))
    return cleaned.select("page_id", F.md5("x").alias("text_md5"), F.length("x").cast("bigint").alias("chars"))


@query("normalize_for_match", f"SELECT page_id, md5(' ' || {T.fold(PAGE_TEXT)} || ' ') AS text_md5 FROM pages")
def _(t):
    return t.spread(t.read("pages")).select("page_id", F.md5(text.normalize_for_match(F.col("html"))).alias("text_md5"))


@query("keyword_in_text", with_tables(T.NEWS) + f""", n AS (SELECT doc_id, ' ' || {T.fold(T.squeeze('summary'))} || ' ' AS x FROM news)
  SELECT doc_id, regexp_matches(x, '(^|[^a-z0-9])of($|[^a-z0-9])') AS short_hit, contains(x, 'thatin') AS long_hit FROM n""")
def _(t):
    rows = t.spread(t.news).select("doc_id", text.matching_text(F.col("summary")).alias("x"))
    return rows.select("doc_id", text.keyword_in_text("of", F.col("x")).alias("short_hit"), text.keyword_in_text("Thatin", F.col("x")).alias("long_hit"))


BOILED = f"""b AS (SELECT doc_id, {T.squeeze("summary")} AS x FROM news)"""


@query("strip_boilerplate", with_tables(T.NEWS, BOILED) + """SELECT doc_id, md5(trim(x || CASE WHEN doc_id % 2 = 0 THEN ' It matters.' ELSE '' END)) AS text_md5 FROM (SELECT doc_id, x || CASE WHEN x <> '' AND NOT regexp_matches(x, '[.!?]$') THEN '.' ELSE '' END AS x FROM b)""")
def _(t):
    # Every second document gets sentences that must go and one that must stay.
    ended = F.expr("if(trim(summary) <> '' AND NOT regexp_replace(summary, '\\\\s+$', '') rlike '[.!?]$', concat(summary, '.'), summary)")
    extra = F.when(F.col("doc_id") % 2 == 0, F.lit(" Government Digital Service The body is responsible for tests. It matters. Find out more about us! Subscribe to news.")).otherwise(F.lit(""))
    return t.spread(t.news).select("doc_id", F.md5(text.strip_boilerplate(F.concat(ended, extra))).alias("text_md5"))


DASHED = f"regexp_replace({T.fold('title')}, '[–—]', '-', 'g')"


@query("normalize_title", with_tables(T.NEWS) + f"SELECT doc_id, {T.squeeze(DASHED)} AS title FROM news")
def _(t):
    return t.news.select("doc_id", text.normalize_title(F.col("title")).alias("title"))


WORDS_OF = "array_to_string(regexp_extract_all({x}, '[\\p{{L}}\\p{{N}}\\p{{M}}_]+'), ' ')"


@query("normalize_words", with_tables(T.NEWS) + f"SELECT doc_id, {WORDS_OF.format(x=T.fold('title'))} AS words FROM news")
def _(t):
    return t.news.select("doc_id", text.normalize_words(F.col("title")).alias("words"))


@query("identity_key", f"SELECT c_custkey, 'body ' || CAST(c_custkey AS VARCHAR) || ' health and social care trust and ' || lower(c_mktsegment) AS identity FROM customer")
def _(t):
    name = F.concat(F.lit("Body (ABC) "), F.col("c_custkey"), F.lit(" HSC Trust (Northern Ireland) & "), F.col("c_mktsegment"))
    return t.read("customer").select("c_custkey", text.identity_key(name).alias("identity"))


@query("slugify", with_tables(T.NEWS) + """SELECT doc_id, array_to_string(regexp_extract_all(lower(title), '[\\p{L}\\p{N}]+'), '-') AS slug, CASE WHEN s = '' THEN 'custom' ELSE s END AS profile_slug
  FROM (SELECT *, regexp_replace(regexp_replace(replace(lower(title), 'ß', 'ss'), '[^a-z0-9-]+', '-', 'g'), '^-+|-+$', '', 'g') AS s FROM news)""")
def _(t):
    return t.news.select("doc_id", text.slugify(F.col("title")).alias("slug"), text.safe_profile_id(F.col("title")).alias("profile_slug"))


@query("is_challenge_page", "SELECT page_id, page_id % 3 = 0 AS challenge FROM pages")
def _(t):
    body = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("<title>Just a moment...</title> CloudFlare"), "html")).otherwise(F.concat(F.lit("just a moment "), "html"))
    return t.read("pages").select("page_id", text.is_challenge_page(body).alias("challenge"))


@query("is_retryable", "SELECT event_id, event_type = 'error' AS retryable FROM events")
def _(t):
    return t.read("events").select("event_id", filters.is_retryable(F.when(F.col("event_type") == "error", F.lit("DownloadError")).otherwise(F.lit("ValidationError"))).alias("retryable"))


@query("script_runs", "SELECT c_custkey, '新聞 |' || c_name || '|標題：' || '|' || c_mktsegment AS runs FROM customer")
def _(t):
    mixed = F.concat(F.lit("新聞 "), "c_name", F.lit("標題："), "c_mktsegment")
    return t.read("customer").select("c_custkey", F.array_join(F.transform(text.script_runs(mixed), lambda r: r["text"]), "|").alias("runs"))


@query("default_strength", "SELECT p_partkey, CASE WHEN p_name IN ('x') THEN 'supporting' ELSE 'core' END AS by_name, CASE WHEN p_partkey % 3 = 0 THEN 'supporting' WHEN length(p_type) >= 10 THEN 'core' ELSE 'general' END AS by_type FROM part")
def _(t):
    by_type = F.when(F.col("p_partkey") % 3 == 0, F.lit("Supply Chain")).otherwise(F.col("p_type"))
    return t.read("part").select("p_partkey", text.default_strength(F.col("p_name")).alias("by_name"), text.default_strength(by_type).alias("by_type"))


@query("strip_title_suffix", with_tables(T.NEWS) + "SELECT doc_id, trim(title) AS title FROM news")
def _(t):
    source = F.element_at(F.array(*[F.lit(r[0]) for r in V.FALLBACK_RULES]), (F.col("doc_id") % 4 + 1).cast("int"))
    suffix = F.element_at(F.array(F.lit(" - Ofcom - www.ofcom.org.uk"), F.lit(" - National Protective Security Authority"), F.lit(" - electoral commission"), F.lit(" - ICO")), (F.col("doc_id") % 4 + 1).cast("int"))
    return t.news.select("doc_id", text.strip_title_suffix(source, F.concat("title", suffix)).alias("title"))


@query("translate_by_rule", """SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN '計票後聲明 - ' || CAST(year(o_orderdate) AS VARCHAR) || ' 年蘇格蘭議會選舉' WHEN 1 THEN '投票後聲明 - ' || CAST(year(o_orderdate) AS VARCHAR) || ' 年 ' || CAST(month(o_orderdate) AS VARCHAR) || ' 月'
  WHEN 2 THEN '譯文' ELSE 'Same title' END AS translation FROM orders""")
def _(t):
    title = F.expr("""case o_orderkey % 4 when 0 then concat('Post count statement - ', year(o_orderdate), ' Scottish Parliament election') when 1 then concat('Post poll statement – ', date_format(o_orderdate, 'MMMM yyyy')) else 'Same title' end""")
    given = F.expr("case o_orderkey % 4 when 2 then '譯文' when 3 then 'Same title' else '' end")
    return t.read("orders").select("o_orderkey", text.translate_by_rule(title, given).alias("translation"))


@query("expand_source_ids", "SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'BIST|DCMS|Cabinet Office|ICO' WHEN 1 THEN 'BIST|ICO' ELSE 'ICO|BIST|DCMS|Cabinet Office' END AS ids FROM orders")
def _(t):
    ids = F.expr("case o_orderkey % 3 when 0 then array('DSIT', 'DBT', 'ICO') when 1 then array('DBT', 'BIST', 'ICO') else array('ICO', 'DSIT', 'ICO') end")
    return t.read("orders").select("o_orderkey", F.array_join(text.expand_source_ids(ids), "|").alias("ids"))


@query("except_sources", "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'XYZ' ELSE '' END AS unknown FROM orders")
def _(t):
    chosen = F.expr("if(o_orderkey % 2 = 0, array('ICO', 'XYZ'), array('ICO'))")
    return t.read("orders").select("o_orderkey", F.array_join(unknown_ids(chosen, F.array(F.lit("ICO"), F.lit("CMA"))), "|").alias("unknown"))


@query("briefing_identifier", "SELECT DISTINCT conv_id, CASE conv_id % 3 WHEN 0 THEN 'CBP-' || CAST(conv_id AS VARCHAR) WHEN 1 THEN 'POST-PN-' || CAST(conv_id AS VARCHAR) ELSE '' END AS identifier FROM conversations")
def _(t):
    link = F.expr("case conv_id % 3 when 0 then concat('https://x.example/research-briefings/cbp-', conv_id, '/') when 1 then concat('https://x.example/post-pn-', conv_id) else 'https://x.example/' end")
    return t.read("conversations").select("conv_id", text.briefing_identifier(link, F.lit("Title")).alias("identifier")).distinct()


@query("briefing_pdf_url", f"SELECT conv_id, turn, CASE conv_id % 3 WHEN 0 THEN 'https://d.example/CBP-' || CAST(conv_id AS VARCHAR) || '.pdf?x=1&y=2' WHEN 1 THEN '{V.BRIEFING_PDF_ROOT}CBP-' || CAST(conv_id AS VARCHAR) || '/CBP-' || CAST(conv_id AS VARCHAR) || '.pdf' ELSE '' END AS pdf_url FROM conversations")
def _(t):
    identifier = F.expr("if(conv_id % 3 = 2, '', concat('CBP-', conv_id))")
    content = F.expr("concat(text, if(conv_id % 3 = 0, concat(' <a href=\"https://d.example/CBP-', conv_id, '.pdf?x=1&amp;y=2\">pdf</a> https://d.example/other.pdf'), ' none '))")
    return t.read("conversations").select("conv_id", "turn", text.briefing_pdf_url(content, identifier).alias("pdf_url"))


@query("feed_topics", with_tables(T.NEWS) + f"SELECT doc_id, CASE WHEN {T.squeeze('title')} = '' THEN 'Tech|' || lang ELSE 'Tech|' || {T.squeeze('title')} || '|' || lang END AS topics FROM news")
def _(t):
    return t.news.select("doc_id", F.array_join(text.feed_topics(F.array(F.lit("Tech"), F.lit(""), F.col("title"), F.lit(" Tech "), F.col("lang"))), "|").alias("topics"))


ONE_TITLE = "'one ' || title"


@query("entry_summary", with_tables(T.NEWS) + f"SELECT doc_id, md5(CASE doc_id % 3 WHEN 0 THEN {T.squeeze('title')} WHEN 1 THEN CASE WHEN summary = '' THEN {T.squeeze(ONE_TITLE)} ELSE {T.squeeze('summary')} END ELSE {T.squeeze(ONE_TITLE)} END) AS summary_md5 FROM news")
def _(t):
    first, second = F.expr("if(doc_id % 3 = 0, title, '')"), F.expr("if(doc_id % 3 = 1, summary, '')")
    third = F.array(F.lit("one"), F.col("title"))
    picked = F.when((F.col("doc_id") % 3 == 0) & (F.col("title") == ""), F.lit("")).otherwise(text.entry_summary(first, second, third))
    return t.news.select("doc_id", F.md5(picked).alias("summary_md5"))


@query("first_text", with_tables(T.BRIEFINGS) + f"SELECT conv_id, turn, {T.squeeze('title')} AS title, CASE WHEN {T.squeeze('title')} IN ('', 'B') THEN 'B' ELSE 'B|' || {T.squeeze('title')} END AS topics FROM briefings")
def _(t):
    made = F.to_json(F.struct(
        F.array(F.struct(F.struct(F.col("title").alias("_value")).alias("prefLabel"))).alias("label"),
        F.array(F.struct(F.lit("B").alias("prefLabel")), F.struct(F.col("title").alias("prefLabel")), F.struct(F.lit("B").alias("prefLabel"))).alias("topics"),
    ))
    rows = t.briefings.select("conv_id", "turn", F.parse_json(made).alias("item"))
    return rows.select("conv_id", "turn", payloads.first_text("item", "title", "label").alias("title"), F.array_join(payloads.list_text("item", "topic", "topics"), "|").alias("topics"))


@query("list_text", "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_name || '|' || p_type WHEN 1 THEN p_brand ELSE '' END AS texts FROM part")
def _(t):
    item = F.expr("""parse_json(case p_partkey % 3 when 0 then concat('{"topic":[{"label":"', p_name, '"},{"title":{"_value":"', p_type, '"}},{"name":["', p_name, '"]}]}')
      when 1 then to_json(named_struct('topics', p_brand)) else '{"topic":[]}' end)""")
    return t.read("part").select("p_partkey", item.alias("item")).select("p_partkey", F.array_join(payloads.list_text("item", "topic", "topics", "topic.prefLabel"), "|").alias("texts"))


# --- urls -----------------------------------------------------------------------------------------------------------

SCHEME_HOST, PATH = "regexp_extract(url, '^([a-z]+://[^/?#]*)', 1)", "regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1)"


@query("canonical_url", f"SELECT page_id, lower({SCHEME_HOST}) || CASE WHEN regexp_replace({PATH}, '/+$', '') = '' THEN '/' ELSE regexp_replace({PATH}, '/+$', '') END AS canonical FROM pages")
def _(t):
    return t.read("pages").select("page_id", urls.canonical_url(F.col("url")).alias("canonical"))


@query("url_host", f"SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)), '^www\\.', '') AS host, {PATH} AS path FROM pages")
def _(t):
    return t.read("pages").select("page_id", urls.url_host(F.col("url")).alias("host"), urls.url_path(F.col("url")).alias("path"))


@query("url_join", f"SELECT page_id, CASE page_id % 4 WHEN 0 THEN {SCHEME_HOST} || '/news/1' WHEN 1 THEN {SCHEME_HOST} || regexp_replace({PATH}, '[^/]*$', '') || 'a?b=c' WHEN 2 THEN 'https://other.example/x' ELSE {SCHEME_HOST} || '/top' END AS link FROM pages")
def _(t):
    href = F.expr("case page_id % 4 when 0 then '/news/1' when 1 then 'a?b=c' when 2 then 'https://other.example/x' else '/x/../top' end")
    return t.read("pages").select("page_id", urls.url_join(F.col("url"), href).alias("link"))


@query("strip_query", "SELECT page_id, regexp_replace(url, '[?#].*$', '') AS url FROM pages")
def _(t):
    return t.read("pages").select("page_id", urls.strip_query(F.col("url")).alias("url"))


# --- dates -----------------------------------------------------------------------------------------------------------

STAMP = "o_orderdate + to_seconds(CAST(o_orderkey % 86400 AS INTEGER))"


def _stamped(t):
    return t.read("orders").selectExpr("o_orderkey", "cast(o_orderdate AS timestamp) + make_dt_interval(0, 0, 0, o_orderkey % 86400) AS ts")


@query("parse_datetime", f"SELECT o_orderkey, CASE o_orderkey % 8 WHEN 7 THEN 'none' WHEN 3 THEN {text_ts(STAMP + ' - INTERVAL 2 HOUR')} WHEN 0 THEN {text_ts(STAMP)} WHEN 1 THEN {text_ts(STAMP)} WHEN 2 THEN {text_ts(STAMP)} ELSE {text_ts('o_orderdate')} END AS parsed FROM orders")
def _(t):
    shape = F.expr("""case o_orderkey % 8 when 0 then date_format(ts, "EEE, dd MMM yyyy HH:mm:ss 'GMT'") when 1 then date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'") when 2 then date_format(ts, 'dd MMMM yyyy HH:mm:ss') when 3 then date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'+02:00'")
      when 4 then date_format(ts, 'd MMMM yyyy') when 5 then date_format(ts, 'MMM d, yyyy') when 6 then date_format(ts, 'dd/MM/yyyy') else 'not a date' end""")
    return _stamped(t).select("o_orderkey", F.coalesce(dates.utc_text(dates.parse_datetime(shape)), F.lit("none")).alias("parsed"))


@query("parse_feed_date", f"SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN {text_ts(STAMP)} WHEN o_orderkey % 3 = 1 THEN {text_ts('o_orderdate')} ELSE 'none' END AS parsed FROM orders")
def _(t):
    rows = _stamped(t)
    published, updated = F.expr("if(o_orderkey % 3 = 0, date_format(ts, \"EEE, dd MMM yyyy HH:mm:ss '+0000'\"), '')"), F.expr("if(o_orderkey % 3 < 2, date_format(ts, 'yyyy-MM-dd'), null)")
    return rows.select("o_orderkey", F.coalesce(dates.utc_text(dates.parse_feed_date(published, updated)), F.lit("none")).alias("parsed"))


@query("parse_index_date", f"SELECT o_orderkey, CASE o_orderkey % 6 WHEN 5 THEN 'none' WHEN 4 THEN strftime({STAMP}, '%Y-%m-%d %H:%M:00') ELSE {text_ts('o_orderdate')} END AS parsed FROM orders")
def _(t):
    shape = F.expr("""case o_orderkey % 6 when 0 then replace(date_format(ts, "d'th' MMM yyyy"), 'Sep', 'Sept') when 1 then date_format(ts, 'dd / MM / yyyy') when 2 then date_format(ts, "yyyy-M-d'T00:00:00'") when 3 then date_format(ts, 'dd MMM, yyyy')
      when 4 then date_format(ts, 'yyyy-MM-dd HH:mm') else date_format(ts, 'd MMMM') end""")
    return _stamped(t).select("o_orderkey", F.coalesce(dates.utc_text(dates.parse_index_date(shape)), F.lit("none")).alias("parsed"))


LOCAL = "INTERVAL 8 HOUR"
LOCAL_DAY = f"date_trunc('day', {STAMP} + {LOCAL})"


@query("period_bounds", f"""SELECT o_orderkey, CASE o_orderkey % 5 WHEN 4 THEN 'none' WHEN 0 THEN {text_ts(f'{LOCAL_DAY} - to_days(CAST(o_orderkey % 60 AS INTEGER)) - {LOCAL}')} WHEN 3 THEN {text_ts(f'{LOCAL_DAY} - INTERVAL 14 DAY - {LOCAL}')} ELSE {text_ts(f'o_orderdate - INTERVAL 9 DAY - {LOCAL}')} END AS since,
  CASE o_orderkey % 5 WHEN 4 THEN 'none' WHEN 1 THEN {text_ts(f'o_orderdate + INTERVAL 1 DAY - {LOCAL}')} ELSE {text_ts(f'{LOCAL_DAY} + INTERVAL 1 DAY - {LOCAL}')} END AS until FROM orders""")
def _(t):
    period = F.expr("""case o_orderkey % 5 when 0 then cast(o_orderkey % 60 AS string) when 1 then concat(date_format(ts - interval 9 days, 'yyyyMMdd'), ' ～ ', date_format(ts, 'yyyy-MM-dd')) when 2 then date_format(ts - interval 9 days, 'yyyy-MM-dd') when 3 then '' else '2024-13-40' end""")
    rows = _stamped(t).select("o_orderkey", dates.period_bounds(period, F.col("ts")).alias("b"))
    return rows.select("o_orderkey", *[F.coalesce(dates.utc_text(F.col(f"b.{c}")), F.lit("none")).alias(c) for c in ("since", "until")])


@query("roc_date", "SELECT o_orderkey, CASE WHEN o_orderkey % 50 = 0 THEN 'none' ELSE printf('民國%03d年%02d月%02d日', CAST(year(o_orderdate) - 1911 AS INTEGER), CAST(month(o_orderdate) AS INTEGER), CAST(day(o_orderdate) AS INTEGER)) END AS roc, strftime(o_orderdate, '%Y-%m-%d') AS back FROM orders")
def _(t):
    day = F.when(F.col("o_orderkey") % 50 == 0, F.lit("1911-12-31").cast("date")).otherwise(F.col("o_orderdate").cast("date"))
    own = F.col("o_orderdate").cast("date")
    back = dates.roc_to_gregorian(F.year(own) - 1911, F.month(own), F.dayofmonth(own)).cast("string")
    return t.read("orders").select("o_orderkey", F.coalesce(dates.roc_date(day), F.lit("none")).alias("roc"), back.alias("back"))


@query("taipei_timestamp", f"SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN '未記錄' ELSE strftime({STAMP} + {LOCAL}, '%Y/%m/%d %H:%M') END AS shown FROM orders")
def _(t):
    return _stamped(t).select("o_orderkey", dates.taipei_timestamp(F.expr("if(o_orderkey % 9 = 0, 'soon', date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss'Z'\"))")).alias("shown"))


# --- hashes and scopes ---------------------------------------------------------------------------------------------------


@query("response_hash", "SELECT page_id, sha256(html) AS response_sha256, octet_length(encode(html)) AS bytes_count FROM pages")
def _(t):
    return t.read("pages").select("page_id", provenance.response_hash(F.col("html")).alias("r")).select("page_id", "r.response_sha256", F.col("r.bytes_count").cast("bigint").alias("bytes_count"))


@query("profile_hash", """SELECT p_partkey, sha256('{"description":"d","minimum_score":' || CAST(p_size AS VARCHAR) || ',"name":"' || p_name || '","profile_id":"p-' || CAST(p_partkey AS VARCHAR) || '","selected_sources":["ICO"],"topics":[{"keywords":[{"phrase":"' || p_type || '","strength":"core"}],"name":"' || p_brand || '"}],"version":1}') AS profile_hash FROM part""")
def _(t):
    rows = t.read("part").selectExpr("p_partkey", "'d' AS description", "p_size AS minimum_score", "p_name AS name", "concat('p-', p_partkey) AS profile_id", "array('ICO') AS selected_sources",
                                     "array(named_struct('name', p_brand, 'keywords', array(named_struct('phrase', p_type, 'strength', 'core')))) AS topics", "1 AS version")
    return rows.select("p_partkey", payloads.profile_hash().alias("profile_hash"))


@query("validate_profile", """SELECT p_partkey, concat_ws('|', CASE WHEN p_partkey % 2 = 0 THEN 'profile_id' END, CASE WHEN p_size % 5 = 0 THEN 'minimum_score' END, CASE WHEN p_partkey % 3 = 0 THEN 'unknown_sources' END, CASE WHEN p_partkey % 7 = 0 THEN 'duplicate_phrase' END) AS broken FROM part""")
def _(t):
    rows = t.read("part").selectExpr(
        "p_partkey", "if(p_partkey % 2 = 0, 'Bad Id', concat('p-', p_partkey)) AS profile_id", "p_name AS name", "1 AS version", "p_size % 5 AS minimum_score", "if(p_partkey % 3 = 0, array('ICO', 'XYZ'), array('ICO')) AS selected_sources",
        "array(named_struct('name', p_brand, 'keywords', array(named_struct('phrase', p_type, 'strength', 'core'), named_struct('phrase', if(p_partkey % 7 = 0, lower(p_type), 'other'), 'strength', 'general')))) AS topics",
    )
    return payloads.validate_profile(rows, ("ICO", "CMA")).select("p_partkey", F.array_join("broken", "|").alias("broken"))


@query("migrate_profile", """SELECT 'p-' || CAST(p_partkey AS VARCHAR) AS profile_id, p_type AS phrase, 'general' AS strength FROM part WHERE p_partkey % 3 <> 0 UNION ALL SELECT 'p-' || CAST(p_partkey AS VARCHAR), 'extra', 'core' FROM part WHERE p_partkey % 3 <> 0""")
def _(t):
    body = F.expr("""if(p_partkey % 3 = 0, '{broken', concat('{"profile_id":"p-', p_partkey, '","name":"n","version":', p_partkey % 3 - 1, ',"selected_sources":["ICO"],"topics":[{"name":"t","keywords":[', if(p_partkey % 3 = 1, concat('"', p_type, '"'), concat('{"phrase":"', p_type, '"}')), ',{"phrase":"extra","strength":"core"}]}]}'))""")
    profiles, _bad = payloads.parse_profiles(t.read("part").select(F.lit("x").alias("path"), body.alias("body")))
    words = profiles.select("profile_id", F.explode("topics").alias("t")).select("profile_id", F.explode("t.keywords").alias("k"))
    return words.select("profile_id", "k.phrase", "k.strength")


@query("scan_profile", "SELECT p_partkey % 3 <> 0 AS good, count(*) AS documents FROM part GROUP BY 1")
def _(t):
    body = F.expr("""if(p_partkey % 3 = 0, '{broken', concat('{"profile_id":"p-', p_partkey, '","name":"n","version":1,"selected_sources":["ICO"],"topics":[{"name":"t","keywords":[{"phrase":"a"}]}]}'))""")
    good, bad = payloads.parse_profiles(t.read("part").select(F.lit("x").alias("path"), body.alias("body")))
    return good.select(F.lit(True).alias("good")).unionByName(bad.select(F.lit(False).alias("good"))).groupBy("good").agg(F.count("*").alias("documents"))


@query("scope_match", """SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'https://body.example/' ELSE 'https://body.example/a/' || CAST(page_id AS VARCHAR) END AS scope, page_id % 5 = 0 AS scoped_parent, page_id % 3 = 0 AS welsh FROM pages""")
def _(t):
    rows = t.read("pages").selectExpr("page_id", "if(page_id % 2 = 0, 'https://www.body.example', 'https://body.example/a') AS requested", "concat('https://body.example/a/', page_id) AS final",
                                      "if(page_id % 5 = 0, 'https://audit.scot/accounts-commission/', 'https://audit.scot/') AS parent", "if(page_id % 3 = 0, concat('https://www.gov.wales/node/', page_id, '/latest-external-org-content'), 'https://www.gov.wales/news') AS welsh_url")
    return rows.select("page_id", filters.publication_scope(F.col("requested"), F.col("final")).alias("scope"),
                       filters.scoped_parent_index(F.lit("scotland:accounts-commission-for-scotland"), F.col("parent")).alias("scoped_parent"), filters.scoped_welsh_index(F.col("welsh_url")).alias("welsh"))


@query("feed_attribution", "SELECT page_id, CASE page_id % 5 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true WHEN 3 THEN false ELSE true END AS attributable FROM pages")
def _(t):
    rows = t.read("pages").selectExpr(
        "page_id", "element_at(array('x:1', 'x:1', 'govuk:abc', 'x:1', 'x:1'), int(page_id % 5) + 1) AS id", "concat('Body ', page_id) AS name",
        "element_at(array('https://gov.wales/a', 'https://gov.wales/', 'https://www.gov.uk/government/organisations/abc', 'https://own.example/part', 'https://own.example/'), int(page_id % 5) + 1) AS homepage",
        "element_at(array('https://gov.wales/feed', 'https://gov.wales/feed', 'https://www.gov.uk/search/all.atom?organisations%5B%5D=abc', 'https://own.example/feed', 'https://own.example/feed'), int(page_id % 5) + 1) AS endpoint",
        "if(page_id % 5 = 0, concat('News of BODY ', page_id), 'News') AS title",
    )
    return rows.select("page_id", filters.feed_is_attributable(F.col("id"), F.col("name"), F.col("homepage"), F.col("endpoint"), F.col("title")).alias("attributable"))
