"""JSON payloads: search results, briefings, organisations, profiles and run history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pubwatch import fixed_values as V
from pubwatch.functions.base import fold, literal_map, q, strip, text_or
from pubwatch.functions.dates import parse_datetime
from pubwatch.functions.text import briefing_identifier, expand_source_ids, sql_clean_text
from pubwatch.operators.filters import parse_search_results
from pubwatch.operators.runs import limit_history, validate_summary

SEARCH_SCHEMA = "struct<results:array<struct<link:string,title:string,description:string,public_timestamp:string,format:string>>,total:bigint>"


def search_results(responses: DataFrame) -> DataFrame:
    """One row per search result; pages whose ``results`` is no list yield nothing."""
    payload = F.from_json("body", SEARCH_SCHEMA)
    return responses.select(
        *[c for c in responses.columns if c != "body"], F.posexplode(payload["results"]).alias("position", "r")
    ).select(*[c for c in responses.columns if c != "body"], "position", "r.*")


def search_pages(responses: DataFrame) -> DataFrame:
    """Page facts of a search: entries, total, readable."""
    payload = F.from_json("body", SEARCH_SCHEMA)
    entries = F.coalesce(F.array_size(payload["results"]), F.lit(0))
    return responses.select(
        *[c for c in responses.columns if c != "body"], entries.alias("entries"), F.coalesce(payload["total"], entries.cast("bigint")).alias("total"),
        payload["results"].isNotNull().alias("readable"),
    )


def scan_search_api(responses: DataFrame, since: Column, until: Column | None) -> DataFrame:
    """Search results with their reject reason; ``responses`` also carries homepage and patterns."""
    return parse_search_results(search_results(responses), since, until)


def search_warnings(results: DataFrame) -> DataFrame:
    """Counted reject classes that a run reports."""
    told = ("missing_link", "missing_date", "bad_date", "missing_title")
    return results.where(F.col("reason").isin(*told)).groupBy("source_id", "reason").agg(F.count("*").alias("rows"))


# --- briefings ---------------------------------------------------------------------------------------


def sql_nesting(value: str) -> str:
    """SQL: how deep lists and objects nest in a variant, by the brackets of its JSON outside of texts."""
    bare = f"to_json({value})"
    for pattern in (r"\\.", '"[^"]*"', r"[^\[\]{}]"):
        bare = f"regexp_replace({bare}, {q(pattern)}, '')"
    step = "s.d + case when c in ('[', '{') then 1 when c in (']', '}') then -1 else 0 end"
    return f"coalesce(aggregate(split({bare}, ''), named_struct('d', 0, 'm', 0), (s, c) -> named_struct('d', {step}, 'm', greatest(s.m, {step})), s -> s.m), 0)"


def sql_list_text(value: str) -> str:
    """SQL: texts of a variant that is a text, a list or an object with a label, cleaned, in order, once each.

    Lists are opened and objects replaced by their first filled label, level by level, as deep
    as the value nests, until only plain values are left.
    """
    none = "cast(array() as array<variant>)"
    labels = ", ".join(f"variant_get(e, '$.{key}', 'variant')" for key in V.BRIEFING_LABEL_KEYS)
    filled = "filter(array(" + labels + "), w -> w is not null and not is_variant_null(w) and to_json(w) not in ('\"\"', '[]', '{}', '0', 'false'))"
    step = (f"case when e is null or is_variant_null(e) then {none} when schema_of_variant(e) like 'ARRAY%' then cast(e as array<variant>) "
            f"when schema_of_variant(e) like 'OBJECT%' then slice({filled}, 1, 1) else array(e) end")
    leaves = f"aggregate(sequence(1, {sql_nesting(value)} + 1), array({value}), (level, i) -> flatten(transform(level, e -> {step})))"
    return f"array_distinct(filter(transform({leaves}, e -> {sql_clean_text('cast(e as string)')}), t -> t <> ''))"


def _field(column: str, key: str) -> str:
    path = '$["' + key + '"]'
    return f"variant_get({column}, {q(path)}, 'variant')"


def list_text(column: str, *keys: str) -> Column:
    """Texts of the first key that is present."""
    return F.expr(sql_list_text(f"coalesce({', '.join(_field(column, k) for k in keys)})"))


def first_text(column: str, *keys: str) -> Column:
    """First text over the keys, in key order; empty if none has one."""
    found = ", ".join(f"get({sql_list_text(_field(column, k))}, 0)" for k in keys)
    return F.expr(f"coalesce({found}, '')")


def briefing_payloads(responses: DataFrame) -> DataFrame:
    """Items of landed payloads; ``contract`` is null or says what is wrong with the payload."""
    v = responses.withColumn("_v", F.try_parse_json("body"))
    items = F.expr("try_variant_get(_v, '$.result.items', 'array<variant>')")
    checked = v.withColumn("_items", items)
    contract = (
        F.when(F.col("_v").isNull() | ~F.schema_of_variant("_v").like("OBJECT%"), F.lit("payload must be an object"))
        .when(F.col("_items").isNull(), F.lit("result.items must be a list"))
        .when(F.expr("exists(_items, i -> schema_of_variant(i) not like 'OBJECT%')"), F.lit("items must be objects"))
    )
    return checked.withColumn("contract", contract).drop("_v", "body")


def scan_briefings_api(responses: DataFrame) -> DataFrame:
    """Briefings of sound payloads; items without publisher, date or title are dropped."""
    items = briefing_payloads(responses).where("contract is null").select(
        *[c for c in responses.columns if c != "body"], F.posexplode("_items").alias("position", "item")
    )
    rows = items.select(
        *[c for c in responses.columns if c != "body"], "position",
        first_text("item", "publisher", "publisher.prefLabel", "publisher_label").alias("publisher"),
        parse_datetime(first_text("item", "date", "published", "publicationDate")).alias("published_at"),
        first_text("item", "title", "label").alias("title"), first_text("item", "_about", "url", "webpage", "uri").alias("webpage_url"),
        first_text("item", "abstract", "description", "summary").alias("summary"), first_text("item", "identifier", "id").alias("_id"),
        first_text("item", "pdf", "pdfUrl", "attachment", "document").alias("pdf_url"),
        list_text("item", "topic", "topics", "topic.prefLabel").alias("topics"),
        text_or(first_text("item", "type", "publicationType"), "Research Briefing").alias("document_type"),
    ).where("publisher <> '' and title <> '' and published_at is not null")
    return rows.select(
        *[c for c in rows.columns if c != "_id"],
        text_or(F.col("_id"), briefing_identifier(F.col("webpage_url"), F.col("title"))).alias("identifier"),
        F.coalesce(F.element_at(literal_map(V.CHAMBERS), F.col("publisher")), F.lit("")).alias("chamber"),
        F.lit("Research Briefings API").alias("fetched_from"),
    )


# --- organisations and catalogue -----------------------------------------------------------------------


def scan_organisations(responses: DataFrame, provenance: Column) -> DataFrame:
    """Organisation pages as catalogue rows; closed, built-in and foreign bodies are left out."""
    schema = "struct<results:array<struct<title:string,format:string,web_url:string,details:struct<slug:string,govuk_status:string>>>>"
    r = responses.select(F.explode(F.from_json("body", schema)["results"]).alias("r")).select("r.*")
    slug, state = F.col("details.slug"), F.coalesce("details.govuk_status", F.lit(""))
    kept = r.where(
        (F.coalesce(slug, F.lit("")) != "") & ~slug.isin(*V.BUILT_IN_SLUGS) & (state != "closed") & F.startswith("web_url", F.lit(V.GOV_ORGANISATIONS))
    )
    live = (state == "live") & ~slug.isin(*V.DIRECTORY_ONLY_SLUGS)
    return kept.select(
        F.concat(F.lit("govuk:"), slug).alias("id"), F.col("title").alias("name_en"), F.lit("").alias("name_zh"), F.lit("UK").alias("jurisdiction"),
        F.coalesce("format", F.lit("Other")).alias("kind"), F.col("web_url").alias("homepage"),
        F.when(live, F.lit("searchable")).otherwise(F.lit("directory_only")).alias("status"),
        F.when(live, F.lit("govuk_search")).otherwise(F.lit("")).alias("adapter"), provenance.alias("provenance"),
        F.when(live, F.lit("")).when(slug.isin(*V.DIRECTORY_ONLY_SLUGS), F.lit("依專案設定不抓 BBC")).otherwise(F.lit("GOV.UK 未標記為可發布來源")).alias("reason"),
    )


def scan_catalog(spark: SparkSession, path: str, one_document: bool = True) -> DataFrame:
    """Catalogue snapshot rows; any version but 1 is an error.

    A snapshot is one indented document per file; set ``one_document`` to False for JSON lines,
    which also split across tasks.
    """
    raw = spark.read.option("multiLine", str(one_document).lower()).json(path)
    checked = raw.withColumn("_ok", F.assert_true(F.col("schema_version") == 1, F.lit("unsupported catalogue version")))
    return checked.where(F.col("_ok").isNull()).select(F.explode("sources").alias("s")).select("s.*")


# --- profiles --------------------------------------------------------------------------------------------


def parse_profiles(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(profiles, quarantined documents) of landed profile JSON: path, body.

    Version 0 keywords may be plain texts; they become general keywords.  Retired source ids are
    replaced by their successors.
    """
    v = documents.withColumn("_v", F.try_parse_json("body"))
    listed = F.expr("try_variant_get(_v, '$.profiles', 'array<variant>')")
    opened = v.withColumn("_all", F.when(listed.isNotNull(), listed).otherwise(F.array("_v")))
    one = opened.select("path", "body", F.explode("_all").alias("p"))
    keyword = ("named_struct('phrase', if(schema_of_variant(k) like 'OBJECT%', variant_get(k, '$.phrase', 'string'), cast(k as string)), "
               "'strength', if(schema_of_variant(k) like 'OBJECT%', coalesce(variant_get(k, '$.strength', 'string'), 'general'), 'general'))")
    topic = (f"named_struct('name', variant_get(t, '$.name', 'string'), "
             f"'keywords', transform(try_variant_get(t, '$.keywords', 'array<variant>'), k -> {keyword}))")
    rows = one.select(
        "path", "body", F.expr("try_variant_get(p, '$.profile_id', 'string')").alias("profile_id"), F.expr("try_variant_get(p, '$.name', 'string')").alias("name"),
        F.expr("coalesce(try_variant_get(p, '$.description', 'string'), '')").alias("description"),
        F.expr("coalesce(try_variant_get(p, '$.version', 'int'), 0)").alias("from_version"),
        expand_source_ids(F.expr("try_variant_get(p, '$.selected_sources', 'array<string>')")).alias("selected_sources"),
        F.expr(f"transform(try_variant_get(p, '$.topics', 'array<variant>'), t -> {topic})").alias("topics"),
        F.expr("coalesce(try_variant_get(p, '$.minimum_score', 'int'), 3)").alias("minimum_score"),
    ).withColumn("version", F.when(F.col("from_version") == 0, F.lit(V.PROFILE_VERSION)).otherwise(F.col("from_version")))
    checked = validate_profile(rows)
    return checked.where("size(broken) = 0").drop("body", "from_version", "broken"), checked.where("size(broken) > 0").select("path", "body", "broken")


def validate_profile(profiles: DataFrame, available: tuple[str, ...] | None = None) -> DataFrame:
    """Add ``broken``: the rules a profile violates."""
    phrases = F.flatten(F.transform("topics", lambda t: F.transform(t["keywords"], lambda k: fold(strip(k["phrase"])))))
    strengths = F.flatten(F.transform("topics", lambda t: F.transform(t["keywords"], lambda k: k["strength"])))

    def blank(c: Column) -> Column:
        return F.coalesce(strip(c), F.lit("")) == ""

    known = F.lit(False) if available is None else F.size(F.array_except("selected_sources", F.array(*[F.lit(a) for a in available]))) > 0
    tests = {
        "version": F.col("version") != V.PROFILE_VERSION, "profile_id": ~F.col("profile_id").rlike(V.PROFILE_ID_PATTERN), "name": blank(F.col("name")),
        "minimum_score": F.col("minimum_score") < 1, "no_sources": F.size("selected_sources") < 1, "unknown_sources": known,
        "no_topics": F.size("topics") < 1, "blank_topic": F.exists("topics", lambda t: blank(t["name"])),
        "no_keywords": F.exists("topics", lambda t: F.coalesce(F.size(t["keywords"]), F.lit(0)) < 1), "blank_phrase": F.exists(phrases, lambda p: p == ""),
        "duplicate_phrase": F.size(F.array_distinct(phrases)) != F.size(phrases), "unknown_strength": F.exists(strengths, lambda s: ~s.isin(*V.STRENGTHS)),
    }
    return profiles.withColumn("broken", F.array_compact(F.array(*[F.when(F.coalesce(t, F.lit(True)), F.lit(n)) for n, t in tests.items()])))


def profile_hash() -> Column:
    """SHA-256 of the canonical JSON of a profile row."""
    topics = F.transform("topics", lambda t: F.struct(
        F.transform(t["keywords"], lambda k: F.struct(k["phrase"].alias("phrase"), k["strength"].alias("strength"))).alias("keywords"), t["name"].alias("name")
    ))
    fields = {"description": F.col("description"), "minimum_score": F.col("minimum_score"), "name": F.col("name"), "profile_id": F.col("profile_id"),
              "selected_sources": F.col("selected_sources"), "topics": topics, "version": F.col("version")}
    return F.sha2(F.to_json(F.struct(*[c.alias(n) for n, c in sorted(fields.items())])), 256)


# --- run history -------------------------------------------------------------------------------------------

RUN_SCHEMA = (
    "run_id string, generated_at string, period_start string, period_end string, output_file string, all_news_count bigint, "
    "filtered_news_count bigint, parliament_count bigint, filtered_parliament_count bigint, status string, data_fingerprint string, "
    "delivery_id string, profile_id string, profile_name string"
)


def scan_run_history(spark: SparkSession, folder: str, limit: int = V.HISTORY_LIMIT) -> DataFrame:
    """Newest valid run summaries of a folder, newest file first."""
    raw = spark.read.text(folder, wholetext=True, pathGlobFilter="*.run.json").select(
        "value", F.col("_metadata.file_modification_time").alias("modified"), F.col("_metadata.file_path").alias("path")
    )
    rows = raw.select("modified", "path", F.from_json("value", RUN_SCHEMA).alias("r")).select("modified", "path", "r.*")
    sound = validate_summary(rows).where(
        (F.size("broken") == 0) & parse_datetime(F.col("generated_at")).isNotNull()
        & F.col("period_start").try_cast("date").isNotNull() & F.col("period_end").try_cast("date").isNotNull()
    ).drop("broken")
    return limit_history(sound, "modified", "path", limit)


def scan_run_data(spark: SparkSession, path: str, run_id: str) -> DataFrame:
    """Record rows of one earlier run, by partition."""
    return spark.read.parquet(path).where(F.col("run_id") == run_id)
