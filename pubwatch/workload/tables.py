"""Bindings: the engine's tables derived from the given ones, in Spark and as SQL text.

Each derivation exists twice on purpose.  ``Tables`` builds it with DataFrames; the upper-case
strings are common table expressions that the expected-result SQL starts from.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pubwatch.operators.relevance import Profile

EPOCH_2024 = 1704067200
SINCE, UNTIL, NOW = "2024-01-08 16:00:00", "2024-01-22 16:00:00", "2024-02-01 00:00:00"
KINDS = ("government/news", "guidance", "government/reports", "government/consultations", "government/organisations")
REGION_PREFIX = {"AFRICA": "govuk:", "AMERICA": "scotland:", "ASIA": "wales:", "EUROPE": "ni:", "MIDDLE EAST": "court-ew:"}
REGION_PLACE = {"AFRICA": "UK", "AMERICA": "Scotland", "ASIA": "Wales", "EUROPE": "Northern Ireland", "MIDDLE EAST": "England and Wales"}

# The given texts are invented prose, so the profile uses words that occur in them.
PROSE_PROFILE = Profile(
    "prose-watch", "Prose watch",
    (
        ("Signals", (("that the", "core"), ("hehely", "core"), ("thatin", "general"), ("that", "supporting"))),
        ("Supply", (("for the", "core"), ("orre", "general"), ("inoran", "general"), ("of", "supporting"), ("th", "general"))),
        ("Règles", (("que les", "core"), ("und der", "core"), ("élément", "general"), ("la", "supporting"))),
    ),
    selected_sources=tuple(f"src{i}" for i in range(0, 20, 2)), minimum_score=12,
)


def _case(column: str, mapping: dict[str, str]) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in mapping.items()) + " END"


def text_ts(column: str) -> str:
    return f"strftime({column}, '%Y-%m-%d %H:%M:%S')"


def squeeze(x: str) -> str:
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


def fold(x: str) -> str:
    return f"replace(lower({x}), 'ß', 'ss')"


NEWS = f"""news AS (SELECT doc_id, lang, 'Agency ' || source AS agency, 'Body ' || source AS agency_en,
  CASE WHEN doc_id % 7 = 0 THEN '' ELSE source END AS unit_category, source,
  split_part(text, chr(10), 1) AS title,
  CASE WHEN strpos(text, chr(10)) > 0 THEN substr(text, strpos(text, chr(10)) + 1) ELSE '' END AS summary,
  CASE WHEN doc_id % 10 = 0 THEN '' ELSE 'https://www.gov.uk/' ||
    CASE (doc_id // 2) % 5 {' '.join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(KINDS))} END
    || '/' || CAST(doc_id // 2 AS VARCHAR) || CASE WHEN doc_id % 2 = 1 THEN '/' ELSE '' END END AS link,
  CAST(TIMESTAMP '2024-01-01' + to_minutes(CAST(doc_id * 7919 % 43200 AS INTEGER)) AS TIMESTAMP) AS published_at,
  'https://feeds.example/' || source AS source_feed FROM documents)"""

BRIEFINGS = """briefings AS (SELECT conv_id, turn, conv_id * 1000 + turn AS arrival_seq,
  CAST(TIMESTAMP '2024-01-01' + to_hours(CAST(conv_id * 37 % 700 AS INTEGER)) AS TIMESTAMP) AS published_at,
  CASE role WHEN 'user' THEN 'House of Commons Library' WHEN 'assistant' THEN 'House of Lords Library' ELSE 'Parliamentary Office of Science and Technology' END AS publisher,
  CASE role WHEN 'user' THEN 'House of Commons' WHEN 'assistant' THEN 'House of Lords' ELSE 'POST' END AS chamber,
  split_part(text, chr(10), 1) AS title,
  CASE WHEN strpos(text, chr(10)) > 0 THEN substr(text, strpos(text, chr(10)) + 1) ELSE '' END AS summary,
  CASE WHEN conv_id % 5 = 0 THEN '' ELSE 'CBP-' || CAST(conv_id AS VARCHAR) END AS identifier,
  CASE WHEN conv_id % 10 = 0 THEN '' ELSE 'https://library.example/' || CAST(conv_id AS VARCHAR) || '/' END AS webpage_url
  FROM conversations)"""

HEALTH = """health AS (SELECT event_id, ts, 'src' || CAST(user_id AS VARCHAR) AS source, user_id % 4 <> 0 AS critical,
  event_type <> 'error' AS success, value AS duration_seconds,
  CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) % 5 AS item_count,
  CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) % 3 AS candidate_count,
  CASE event_type WHEN 'error' THEN 'src' || CAST(user_id AS VARCHAR) || ' RSS/Atom 讀取失敗' WHEN 'signup' THEN '最新資料已超過 14 天'
    WHEN 'purchase' THEN 'RSS 有候選資料但解析為零筆' ELSE '' END AS warning FROM events)"""

HTTP = """http_log AS (SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'https://news.google.com/rss/search?q=x' WHEN 1 THEN 'https://www.gov.uk/api/search.json?start=' || CAST(event_id AS VARCHAR)
  ELSE 'https://site.example/news' END AS url, CASE event_id % 10 WHEN 0 THEN 429 WHEN 1 THEN 503 ELSE 200 END AS status_code, event_id % 4 = 0 AS retry FROM events)"""

RUNS = """runs AS (SELECT o_orderkey, 'run-' || CAST(o_orderkey // 3 AS VARCHAR) AS run_id, 'report-' || CAST(o_orderkey % 2 AS VARCHAR) || '.xlsx' AS output_file,
  o_orderdate AS generated_at, CASE o_orderstatus WHEN 'F' THEN 'complete' ELSE 'degraded' END AS status, CASE WHEN o_orderkey % 9 = 0 THEN 'retry' ELSE 'full' END AS run_kind,
  o_orderpriority AS profile_hash, o_totalprice AS total_wall_seconds, o_custkey % 50 AS all_news_count, o_custkey % 20 AS filtered_news_count,
  o_custkey % 9 AS parliament_count, o_custkey % 4 AS filtered_parliament_count, sha256(CAST(o_custkey AS VARCHAR)) AS data_fingerprint FROM orders)"""

CATALOG = f"""catalog AS (SELECT c_custkey AS k, {_case('r_name', REGION_PREFIX)} || CAST(c_custkey AS VARCHAR) AS id,
  'Body ' || CAST(c_custkey // 3 AS VARCHAR) || ' ' || lower(c_mktsegment) AS name_en, '' AS name_zh, {_case('r_name', REGION_PLACE)} AS jurisdiction, c_mktsegment AS kind,
  'https://' || replace(lower(n_name), '_', '-') || '.example.org/' || CAST(c_custkey % 40 AS VARCHAR) AS homepage,
  CASE WHEN c_custkey % 3 = 0 THEN 'searchable' ELSE 'directory_only' END AS status,
  CASE c_custkey % 9 WHEN 0 THEN 'feed' WHEN 3 THEN 'govuk_search' WHEN 6 THEN 'html_news' ELSE '' END AS adapter,
  CASE c_custkey % 9 WHEN 0 THEN 'https://feeds.example/' || CAST(c_custkey AS VARCHAR) ELSE '' END AS feed,
  CASE c_custkey % 9 WHEN 6 THEN 'https://pages.example/' || CAST(c_custkey AS VARCHAR) ELSE '' END AS news_page,
  'https://directory.example/' || CAST(n_nationkey AS VARCHAR) AS provenance, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE 'not verified' END AS reason,
  CASE WHEN c_custkey % 11 = 0 THEN 'verified' ELSE '' END AS review_status, CASE WHEN c_custkey % 13 = 0 THEN 'https://authority.example/' || CAST(c_custkey AS VARCHAR) ELSE '' END AS authority_url,
  '' AS review_checked_at FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""

LABELLED = """labelled AS (SELECT d.doc_id AS id, CASE WHEN toxic = 1 THEN 'boundary' WHEN quality = 1 THEN 'related' ELSE 'unrelated' END AS label,
  split_part(text, chr(10), 1) AS title, CASE WHEN strpos(text, chr(10)) > 0 THEN substr(text, strpos(text, chr(10)) + 1) ELSE '' END AS summary
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""


class Tables:
    """Lazy engine tables over one folder of Parquet files."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def spread(self, df: DataFrame) -> DataFrame:
        """Use all cores on a table that was read as a few large chunks; nothing to do on large tables."""
        cores = self.spark.sparkContext.defaultParallelism
        return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df

    def one_row(self, **columns) -> DataFrame:
        return self.spark.range(1).select(*[c.alias(n) for n, c in columns.items()])

    @property
    def since(self):
        return F.lit(SINCE).cast("timestamp")

    @property
    def until(self):
        return F.lit(UNTIL).cast("timestamp")

    @property
    def now(self):
        return F.lit(NOW).cast("timestamp")

    @cached_property
    def news(self) -> DataFrame:
        return self.read("documents").selectExpr(
            "doc_id", "lang", "concat('Agency ', source) AS agency", "concat('Body ', source) AS agency_en", "if(doc_id % 7 = 0, '', source) AS unit_category", "source",
            "substring_index(text, '\\n', 1) AS title", "if(contains(text, '\\n'), substr(text, instr(text, '\\n') + 1), '') AS summary",
            "if(doc_id % 10 = 0, '', concat('https://www.gov.uk/', element_at(array(" + ", ".join(f"'{k}'" for k in KINDS) + "), int((doc_id div 2) % 5) + 1), '/', doc_id div 2, if(doc_id % 2 = 1, '/', ''))) AS link",
            f"timestamp_seconds({EPOCH_2024} + (doc_id * 7919 % 43200) * 60) AS published_at", "concat('https://feeds.example/', source) AS source_feed", "'news' AS content_type",
        )

    @cached_property
    def briefings(self) -> DataFrame:
        return self.read("conversations").selectExpr(
            "conv_id", "turn", "conv_id * 1000 + turn AS arrival_seq", f"timestamp_seconds({EPOCH_2024} + (conv_id * 37 % 700) * 3600) AS published_at",
            "case role when 'user' then 'House of Commons Library' when 'assistant' then 'House of Lords Library' else 'Parliamentary Office of Science and Technology' end AS publisher",
            "case role when 'user' then 'House of Commons' when 'assistant' then 'House of Lords' else 'POST' end AS chamber",
            "substring_index(text, '\\n', 1) AS title", "if(contains(text, '\\n'), substr(text, instr(text, '\\n') + 1), '') AS summary",
            "if(conv_id % 5 = 0, '', concat('CBP-', conv_id)) AS identifier", "if(conv_id % 10 = 0, '', concat('https://library.example/', conv_id, '/')) AS webpage_url",
            "'' AS pdf_url", "array('Topic') AS topics", "'Research Briefing' AS document_type", "'Official RSS: fixture' AS fetched_from",
        )

    @cached_property
    def health(self) -> DataFrame:
        return self.read("events").selectExpr(
            "event_id", "cast(ts AS timestamp) AS ts", "concat('src', user_id) AS source", "user_id % 4 <> 0 AS critical", "event_type <> 'error' AS success", "value AS duration_seconds",
            "cast(regexp_extract(props, '([0-9]+)', 1) AS bigint) % 5 AS item_count", "cast(regexp_extract(props, '([0-9]+)', 1) AS bigint) % 3 AS candidate_count",
            "case event_type when 'error' then concat('src', user_id, ' RSS/Atom 讀取失敗') when 'signup' then '最新資料已超過 14 天' when 'purchase' then 'RSS 有候選資料但解析為零筆' else '' end AS warning",
        )

    @cached_property
    def http_log(self) -> DataFrame:
        return self.read("events").selectExpr(
            "event_id", "case event_id % 3 when 0 then 'https://news.google.com/rss/search?q=x' when 1 then concat('https://www.gov.uk/api/search.json?start=', event_id) else 'https://site.example/news' end AS url",
            "case event_id % 10 when 0 then 429 when 1 then 503 else 200 end AS status_code", "event_id % 4 = 0 AS retry",
        )

    @cached_property
    def runs(self) -> DataFrame:
        return self.read("orders").selectExpr(
            "o_orderkey", "concat('run-', o_orderkey div 3) AS run_id", "concat('report-', o_orderkey % 2, '.xlsx') AS output_file", "cast(o_orderdate AS timestamp) AS generated_at",
            "if(o_orderstatus = 'F', 'complete', 'degraded') AS status", "if(o_orderkey % 9 = 0, 'retry', 'full') AS run_kind", "o_orderpriority AS profile_hash", "o_totalprice AS total_wall_seconds",
            "o_custkey % 50 AS all_news_count", "o_custkey % 20 AS filtered_news_count", "o_custkey % 9 AS parliament_count", "o_custkey % 4 AS filtered_parliament_count",
            "sha2(cast(o_custkey AS string), 256) AS data_fingerprint",
        )

    @cached_property
    def catalog(self) -> DataFrame:
        joined = self.read("customer").join(self.read("nation"), F.expr("c_nationkey = n_nationkey")).join(self.read("region"), F.expr("n_regionkey = r_regionkey"))
        return joined.selectExpr(
            "c_custkey AS k", f"concat({_case('r_name', REGION_PREFIX)}, c_custkey) AS id", "concat('Body ', c_custkey div 3, ' ', lower(c_mktsegment)) AS name_en", "'' AS name_zh",
            f"{_case('r_name', REGION_PLACE)} AS jurisdiction", "c_mktsegment AS kind", "concat('https://', replace(lower(n_name), '_', '-'), '.example.org/', c_custkey % 40) AS homepage",
            "if(c_custkey % 3 = 0, 'searchable', 'directory_only') AS status", "case c_custkey % 9 when 0 then 'feed' when 3 then 'govuk_search' when 6 then 'html_news' else '' end AS adapter",
            "if(c_custkey % 9 = 0, concat('https://feeds.example/', c_custkey), '') AS feed", "if(c_custkey % 9 = 6, concat('https://pages.example/', c_custkey), '') AS news_page",
            "concat('https://directory.example/', n_nationkey) AS provenance", "if(c_custkey % 3 = 0, '', 'not verified') AS reason", "if(c_custkey % 11 = 0, 'verified', '') AS review_status",
            "if(c_custkey % 13 = 0, concat('https://authority.example/', c_custkey), '') AS authority_url", "'' AS review_checked_at",
            "cast(array() AS array<string>) AS parent_sources", "cast(array() AS array<string>) AS alternative_sources",
        )

    @cached_property
    def labelled(self) -> DataFrame:
        return self.read("documents").join(self.read("labels"), "doc_id").selectExpr(
            "doc_id AS id", "case when toxic = 1 then 'boundary' when quality = 1 then 'related' else 'unrelated' end AS label",
            "substring_index(text, '\\n', 1) AS title", "if(contains(text, '\\n'), substr(text, instr(text, '\\n') + 1), '') AS summary",
        )

    @cached_property
    def sources(self) -> DataFrame:
        """Source dimension: one row per document source."""
        return self.read("documents").select("source").distinct().selectExpr(
            "cast(substr(source, 4) AS int) AS source_ord", "source AS source_id", "concat('Agency ', source) AS display_name", "concat('Body ', source) AS name_en",
            "concat('https://www.gov.uk/government/news/', cast(substr(source, 4) AS int)) AS homepage",
        )

    @cached_property
    def health_sources(self) -> DataFrame:
        """Health source dimension: three of four users are agencies, the rest stands for the briefings source."""
        return self.read("events").where("user_id % 4 <> 3").select("user_id").distinct().selectExpr("concat('src', user_id) AS source_id", "cast(user_id AS int) AS source_ord")


SOURCES = """sources AS (SELECT DISTINCT CAST(substr(source, 4) AS INTEGER) AS source_ord, source AS source_id, 'Agency ' || source AS display_name, 'Body ' || source AS name_en,
  'https://www.gov.uk/government/news/' || CAST(CAST(substr(source, 4) AS INTEGER) AS VARCHAR) AS homepage FROM documents)"""
HEALTH_SOURCES = "health_sources AS (SELECT DISTINCT 'src' || CAST(user_id AS VARCHAR) AS source_id, CAST(user_id AS INTEGER) AS source_ord FROM events WHERE user_id % 4 <> 3)"


def with_tables(*tables: str) -> str:
    return "WITH " + ", ".join(tables) + " "
