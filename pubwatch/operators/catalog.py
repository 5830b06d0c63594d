"""The reviewed source catalogue: review state, identities, audit outcomes and removals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pubwatch import fixed_values as V
from pubwatch.functions.base import any_of, literal_array
from pubwatch.functions.text import identity_key, normalize_words, slugify
from pubwatch.functions.urls import hosts_related, url_host, url_hostname, url_netloc, url_path, url_query, url_scheme

from pubwatch.operators.dedupe import keep_first

_NO_IDS = "array<string>"


def _rules(tests: dict[str, Column]) -> Column:
    """Codes of the broken rules; a rule that cannot be decided counts as broken."""
    return F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(True)), F.lit(code)) for code, bad in tests.items()]))


def _blank(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit("")) == ""


def _zoned(value: Column) -> Column:
    return value.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}.*(Z|[+-]\d{2}:?\d{2})$")


def validate_override(reviews: DataFrame) -> DataFrame:
    """Add ``broken``: the rules a reviewed endpoint violates."""
    adapter, home, endpoint = F.col("adapter"), F.col("homepage"), F.col("endpoint")
    proof = F.col("verification")

    def bad_url(c: Column, schemes: tuple[str, ...]) -> Column:
        return ~url_scheme(c).isin(*schemes) | (url_netloc(c) == "")

    slug = F.substring_index("id", ":", -1)
    search_ok = (
        F.startswith("id", F.lit("govuk:")) & (url_hostname(endpoint) == "www.gov.uk") & (url_path(endpoint) == "/api/search.json")
        & (F.array_join(F.transform(
            F.filter(F.split(url_query(endpoint), "&"), lambda kv: F.startswith(kv, F.lit("filter_organisations="))),
            lambda kv: F.substring_index(kv, "=", -1)), ",") == slug)
    )
    shared_html = (adapter == "html_news") & (url_host(home) == "gov.wales")
    return reviews.withColumn("broken", _rules({
        "missing_id": _blank("id"),
        "unknown_adapter": ~adapter.isin("feed", "govuk_search", "html_news"),
        "bad_homepage": bad_url(home, ("http", "https")),
        "bad_authority": bad_url(F.col("authority_url"), ("http", "https")),
        "bad_endpoint": bad_url(endpoint, ("http", "https")),
        "insecure_url": (url_scheme(home) != "https") | (url_scheme(endpoint) != "https"),
        "not_official_search": (adapter == "govuk_search") & ~search_ok,
        "foreign_html": (adapter == "html_news") & (url_hostname(endpoint) != url_hostname(home)),
        "foreign_feed": (adapter == "feed") & ~hosts_related(url_host(endpoint), url_host(home)),
        "not_read": F.coalesce(proof["http_status"] != 200, F.lit(True)) | F.coalesce(proof["parsed_count"] < 1, F.lit(True)),
        "scope_unproven": shared_html & (
            ~F.coalesce(proof["scope_verified"], F.lit(False)) | ~F.coalesce(proof["scope_endpoint"] == endpoint, F.lit(False))
            | ~F.coalesce(proof["scope_homepage"] == home, F.lit(False))),
        "bad_hash": ~F.coalesce(proof["response_sha256"], F.lit("")).rlike("^[0-9a-f]{64}$"),
        "parser_unverified": ~F.coalesce(proof["production_parser_verified"], F.lit(False)),
        "parity_unverified": adapter.isin("feed", "html_news") & ~F.coalesce(proof["python_rust_parity"], F.lit(False)),
        "bad_time": ~_zoned(F.coalesce(proof["checked_at"], F.lit(""))),
        "closed_source": F.col("id").isin(*V.CLOSED_SOURCES),
    }))


def validate_assessment(assessments: DataFrame) -> DataFrame:
    return assessments.withColumn("broken", _rules({
        "bad_outcome": ~F.col("outcome").isin(*V.ASSESSMENT_OUTCOMES),
        "missing_reason": _blank("reason"),
        "bad_time": ~_zoned(F.coalesce("checked_at", F.lit(""))),
    }))


def validate_exclusion(exclusions: DataFrame) -> DataFrame:
    original, replacements = F.col("original_source"), F.coalesce(F.col("replacement_sources"), F.array().cast(_NO_IDS))
    requested = F.col("outcome") == "user_requested_removal"
    return exclusions.withColumn("broken", _rules({
        "missing_id": _blank("id"),
        "bad_outcome": ~F.col("outcome").isin(*V.EXCLUSION_OUTCOMES),
        "missing_reason": _blank("reason"),
        "not_restorable": ~F.coalesce((original["id"] == F.col("id")) & (F.coalesce(original["name_en"], F.lit("")) != ""), F.lit(False)),
        "state_not_kept": requested & ~F.coalesce(
            (original["status"] == "directory_only") & (F.col("original_status") == "directory_only")
            & (F.col("original_reason") == F.coalesce(original["reason"], F.lit(""))), F.lit(False)),
        "bad_time": ~_zoned(F.coalesce("checked_at", F.lit(""))),
        "bad_authority": ~url_scheme(F.col("authority_url")).isin("http", "https") | (url_netloc(F.col("authority_url")) == ""),
        "bad_replacements": F.exists(replacements, lambda r: F.coalesce(r, F.lit("")) == "") | F.array_contains(replacements, F.col("id")),
        "missing_replacements": F.col("outcome").isin("covered_by_parent", "available_as_other_source") & (F.size(replacements) == 0),
    }))


def id_issues(rows: DataFrame, catalog: DataFrame | None) -> DataFrame:
    """Duplicate ids and, if a catalogue is given, ids it does not have: id, issue."""
    repeated = rows.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id", F.lit("duplicate").alias("issue"))
    if catalog is None:
        return repeated
    orphans = rows.select("id").distinct().join(catalog.select("id"), "id", "left_anti").select("id", F.lit("orphan").alias("issue"))
    return repeated.unionByName(orphans)


def apply_overrides(catalog: DataFrame, reviews: DataFrame) -> DataFrame:
    """Reviewed endpoints win: the entry becomes searchable with the reviewed adapter."""
    r = reviews.select("id", *[F.col(c).alias(f"_{c}") for c in ("adapter", "homepage", "endpoint", "authority_url", "checked_at")])
    joined, hit = catalog.join(r, "id", "left"), F.col("_adapter").isNotNull()

    def then(value: Column, name: str) -> Column:
        return F.when(hit, value).otherwise(F.col(name))

    none = F.array().cast(_NO_IDS)
    return joined.withColumns({
        "homepage": then(F.col("_homepage"), "homepage"),
        "status": then(F.lit("searchable"), "status"),
        "adapter": then(F.col("_adapter"), "adapter"),
        "feed": then(F.when(F.col("_adapter") == "feed", F.col("_endpoint")).otherwise(F.lit("")), "feed"),
        "news_page": then(F.when(F.col("_adapter") == "html_news", F.col("_endpoint")).otherwise(F.lit("")), "news_page"),
        "reason": then(F.lit(""), "reason"),
        "authority_url": then(F.col("_authority_url"), "authority_url"),
        "review_status": then(F.lit("verified"), "review_status"),
        "review_checked_at": then(F.col("_checked_at"), "review_checked_at"),
        "parent_sources": then(none, "parent_sources"),
        "alternative_sources": then(none, "alternative_sources"),
    }).drop("_adapter", "_homepage", "_endpoint", "_authority_url", "_checked_at")


def apply_assessments(catalog: DataFrame, assessments: DataFrame) -> DataFrame:
    """Holds stay visible: the entry is listed only, with the assessed reason, its endpoint cleared."""
    a = assessments.select("id", *[F.col(c).alias(f"_{c}") for c in ("outcome", "reason", "checked_at", "parent_sources", "alternative_sources")])
    joined, hit = catalog.join(a, "id", "left"), F.col("_outcome").isNotNull()
    none = F.array().cast(_NO_IDS)
    values = {
        "status": F.lit("directory_only"), "adapter": F.lit(""), "feed": F.lit(""), "news_page": F.lit(""),
        "reason": F.col("_reason"), "review_status": F.col("_outcome"), "review_checked_at": F.col("_checked_at"),
        "parent_sources": F.coalesce("_parent_sources", none), "alternative_sources": F.coalesce("_alternative_sources", none),
    }
    out = joined.withColumns({name: F.when(hit, value).otherwise(F.col(name)) for name, value in values.items()})
    return out.drop("_outcome", "_reason", "_checked_at", "_parent_sources", "_alternative_sources")


def apply_exclusions(catalog: DataFrame, exclusions: DataFrame) -> DataFrame:
    return catalog.join(exclusions.select("id"), "id", "left_anti")


def apply_review_state(catalog: DataFrame, reviews: DataFrame, assessments: DataFrame, exclusions: DataFrame) -> DataFrame:
    """Exclusions first, then assessments, then overrides, so the later one wins."""
    gone = exclusions.select("id")
    current = apply_exclusions(catalog, exclusions)
    current = apply_assessments(current, assessments.join(gone, "id", "left_anti"))
    return apply_overrides(current, reviews.join(gone, "id", "left_anti"))


def shared_urls(catalog: DataFrame) -> DataFrame:
    return catalog.groupBy("homepage").agg(F.count("*").alias("sources")).where("sources > 1")


def jurisdiction_counts(catalog: DataFrame) -> DataFrame:
    """Sources per jurisdiction and the total row (null jurisdiction)."""
    return catalog.rollup("jurisdiction").agg(F.count("*").alias("sources"))


def outcome_counts(audit: DataFrame) -> DataFrame:
    return audit.groupBy("outcome").agg(F.count("*").alias("sources"))


# --- identities ------------------------------------------------------------------------------


def join_identities(targets: DataFrame, contacts: DataFrame) -> DataFrame:
    """Best contact per source by normalised name; a body's own site before a directory page.

    ``contacts``: name_en, contact_url, authority_url, position.
    """
    c = contacts.select(
        identity_key(F.col("name_en")).alias("_k"), F.col("name_en").alias("matched_name"), "contact_url", "authority_url", "position",
        url_host(F.col("contact_url")).isin("gov.uk", "nidirect.gov.uk").cast("int").alias("_directory"),
    )
    # The best contact of a name is chosen before the join, so a frequent name multiplies nothing.
    best = keep_first(c, [F.col("_k")], [F.col("_directory"), F.col("position"), F.col("contact_url")])
    return targets.withColumn("_k", identity_key(F.col("name_en"))).join(best, "_k").drop("_k", "_directory", "position")


def identity_issues(mapping: DataFrame, catalog: DataFrame, log: DataFrame, contacts: DataFrame) -> DataFrame:
    """Why a proposed identity is not accepted: id, issue (no row: accepted).

    ``mapping``: id, matched_name, authority_url, contact_url; ``log``: url, status_code;
    ``contacts``: the links found on the authority pages (name_en, contact_url, authority_url).
    """
    named = catalog.select("id", F.col("name_en").alias("_name"))
    read = log.where("status_code = 200").select(F.col("url").alias("authority_url")).distinct().withColumn("_read", F.lit(True))
    listed = contacts.select("authority_url", "contact_url", identity_key(F.col("name_en")).alias("_key")).distinct().withColumn("_listed", F.lit(True))
    joined = (
        mapping.join(named, "id", "left").withColumn("_key", identity_key(F.coalesce("_name", F.lit(""))))
        .join(read, "authority_url", "left").join(listed, ["authority_url", "contact_url", "_key"], "left")
    )
    host = url_host(F.col("authority_url"))
    issue = (
        F.when(F.col("_name").isNull() | ~F.startswith("id", F.lit("ni:")), F.lit("id_out_of_range"))
        .when(F.col("_key") != identity_key(F.coalesce("matched_name", F.lit(""))), F.lit("name_differs"))
        .when(~F.startswith("authority_url", F.lit("https://")) | ~(host.isin("gov.uk", "nidirect.gov.uk") | F.endswith(host, F.lit("-ni.gov.uk"))), F.lit("authority_not_official"))
        .when(F.col("_read").isNull(), F.lit("authority_not_read"))
        .when(F.col("_listed").isNull(), F.lit("link_not_listed"))
    )
    single = joined.select("id", issue.alias("issue")).where("issue is not null").distinct()
    repeated = mapping.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id", F.lit("duplicate").alias("issue"))
    return single.unionByName(repeated)


def alias_scope(jurisdiction: Column, name: Column, candidate_jurisdiction: Column) -> Column:
    words = normalize_words(name)
    marked = F.lit(False)
    for region, markers in V.ALIAS_MARKERS.items():
        marked = marked | ((jurisdiction == region) & any_of(words, [F.contains(words, F.lit(m)) for m in markers]))
    return (jurisdiction == candidate_jurisdiction) | ((candidate_jurisdiction == "UK") & marked)


def name_aliases(rows: DataFrame, queryable: DataFrame) -> DataFrame:
    """Same-name sources with a usable channel; accepted only when exactly one fits.

    ``rows`` and ``queryable``: id, name_en, jurisdiction.  Only the count and the smallest id travel,
    never a list of all candidates.
    """
    q = queryable.select(normalize_words(F.col("name_en")).alias("_k"), F.col("id").alias("_id"), F.col("jurisdiction").alias("_j"))
    # One row per (name, jurisdiction) carries the candidates: their number, and the two extreme ids.
    grouped = q.distinct().groupBy("_k", "_j").agg(F.count("*").alias("_n"), F.min("_id").alias("_lo"), F.max("_id").alias("_hi"))
    joined = rows.withColumn("_k", normalize_words(F.col("name_en"))).join(grouped, "_k")
    fits = joined.where(alias_scope(F.col("jurisdiction"), F.col("name_en"), F.col("_j")))
    own = ((F.col("_j") == F.col("jurisdiction")) & F.col("_self")).cast("int")
    selfs = q.select("_k", F.col("_id").alias("id"), F.lit(True).alias("_self")).distinct()
    marked = fits.join(selfs, ["_k", "id"], "left").withColumn("_self", F.coalesce("_self", F.lit(False)))
    other = F.when(own == 1, F.when(F.col("_lo") == F.col("id"), F.col("_hi")).otherwise(F.col("_lo"))).otherwise(F.col("_lo"))
    counted = marked.groupBy("id").agg(
        F.sum(F.col("_n") - own).alias("candidates"),
        F.min(F.when(F.col("_n") - own > 0, other)).alias("alternative_source"),
    )
    return counted.where("candidates = 1").select("id", "alternative_source")


# --- audit -------------------------------------------------------------------------------------


def verify_feed_rows(entries: DataFrame, now: Column) -> DataFrame:
    """Evidence per (source, endpoint) from parsed feed rows that are real, past and on the body's own site.

    ``entries``: id, homepage, endpoint, title, summary, link, published_at, position.
    """
    placeholder = (normalize_words(F.col("title")) == "hello world") & F.contains(normalize_words(F.col("summary")), F.lit("welcome to wordpress"))
    good = entries.where(~placeholder & (F.col("published_at") < now) & hosts_related(url_host(F.col("link")), url_host(F.col("homepage"))))
    return good.groupBy("id", "endpoint").agg(
        F.count("*").alias("parsed_count"), F.min("published_at").alias("oldest_published_at"),
        F.max("published_at").alias("newest_published_at"), F.min_by("link", "position").alias("sample_link"),
    )


def audit_outcome(evidence: DataFrame) -> DataFrame:
    """One outcome per source by fixed precedence.

    ``evidence``: id, verified, html_verified, courts_page, related array, shared_court_feed,
    attributable_news, candidates, failures (counts).
    """
    outcome = (
        F.when(F.col("id") == "govuk:bbc", F.lit("policy_excluded"))
        .when(F.col("id") == "court-ew:find-case-law", F.lit("permission_required"))
        .when(F.col("verified") | F.col("html_verified"), F.lit("verified"))
        .when((F.col("id") == "govuk:financial-remedies-court") & F.col("courts_page"), F.lit("covered_by_parent"))
        .when(F.size("related") > 0, F.lit("covered_by_parent"))
        .when(F.startswith("id", F.lit("court-ew:")) & F.col("shared_court_feed"), F.lit("covered_by_parent"))
        .when(F.col("attributable_news") > 0, F.lit("html_adapter_required"))
        .when(F.col("candidates") > 0, F.lit("feed_validation_failed"))
        .when(F.col("failures") > 0, F.lit("network_or_access_error"))
        .otherwise(F.lit("no_verified_endpoint"))
    )
    courts = literal_array(("court-ew:announcements", "court-ew:judgments"))
    parents = F.when(outcome == "covered_by_parent", F.when(F.size("related") > 0, F.array_sort("related")).otherwise(courts)).otherwise(F.array().cast(_NO_IDS))
    return evidence.select("id", outcome.alias("outcome"), parents.alias("parent_sources"))


# --- removals ------------------------------------------------------------------------------------


def _evidence_url() -> Column:
    return F.coalesce(F.nullif("authority_url", F.lit("")), F.nullif("provenance", F.lit("")), F.col("homepage"))


def plan_removals(catalog: DataFrame, audit: DataFrame, extra_ids: tuple[str, ...] = ()) -> DataFrame:
    """Rows to exclude with reason and replacements; ``replaceable`` is false where the plan must fail.

    ``audit``: id, outcome, reason, parent_sources, alternative_sources.
    """
    a = audit.select("id", "outcome", F.col("reason").alias("_reason"), F.col("parent_sources").alias("_p"), F.col("alternative_sources").alias("_a"))
    rows = catalog.join(a, "id").where((F.col("status") != "searchable") & ~F.col("id").isin(*V.KEPT_SCOPED_SOURCES))
    replacements = F.when(F.size("_p") > 0, F.col("_p")).otherwise(F.coalesce("_a", F.array().cast(_NO_IDS)))
    shared = F.col("outcome").isin("covered_by_parent", "available_as_other_source")
    closed = (F.col("outcome") == "policy_excluded") & (F.col("id") == "govuk:bbc")
    obsolete = (F.col("outcome") == "feed_validation_failed") & (F.col("id") == V.OBSOLETE_SOURCE)
    planned = rows.where(shared | closed | obsolete).select(
        "id", F.when(obsolete, F.lit("obsolete_source")).otherwise(F.col("outcome")).alias("outcome"),
        F.when(F.col("outcome") == "covered_by_parent", F.concat(F.lit("共用採集路由，移至既有發布來源；保留機關與替代路由對照（不表示機關裁撤）："), "_reason"))
        .when(obsolete, F.lit("舊政府機關網址現為獨立非營利公司；不屬現行政府發布來源，唯一 RSS 為 WordPress 樣板"))
        .otherwise(F.col("_reason")).alias("reason"),
        F.when(obsolete, F.lit(V.OBSOLETE_EVIDENCE)).otherwise(_evidence_url()).alias("authority_url"),
        F.when(closed, F.array().cast(_NO_IDS)).otherwise(replacements).alias("replacement_sources"),
    )
    available = catalog.where("status = 'searchable'").select(F.col("id").alias("_r")).withColumn("_ok", F.lit(1))
    wanted = planned.select("id", F.explode("replacement_sources").alias("_r")).join(available, "_r", "left")
    missing = wanted.where(F.col("_ok").isNull() & ~F.col("_r").isin(*extra_ids)).groupBy("id").agg(F.count("*").alias("_missing"))
    needs = F.col("outcome").isin("covered_by_parent", "available_as_other_source")
    return planned.join(missing, "id", "left").withColumn(
        "replaceable", ~needs | ((F.size("replacement_sources") > 0) & F.col("_missing").isNull())
    ).drop("_missing")


def plan_disabled(catalog: DataFrame) -> DataFrame:
    return catalog.where("status = 'directory_only'").select(
        "id", F.lit("user_requested_removal").alias("outcome"), _evidence_url().alias("authority_url"),
        F.when(F.size("parent_sources") > 0, F.col("parent_sources")).otherwise(F.coalesce("alternative_sources", F.array().cast(_NO_IDS))).alias("replacement_sources"),
        F.col("status").alias("original_status"), F.coalesce("reason", F.lit("")).alias("original_reason"),
    )


def apply_removal_plan(exclusions: DataFrame, plan: DataFrame, catalog: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(exclusions with the plan's new ids, ids whose catalogue row changed since planning).

    ``plan`` carries ``original`` - the row's canonical JSON at planning time - and ``catalog`` the
    current one as ``row_json``.
    """
    new = plan.join(exclusions.select("id"), "id", "left_anti")
    changed = new.join(catalog.select("id", "row_json"), "id", "left").where(~F.col("original").eqNullSafe(F.col("row_json"))).select("id")
    return exclusions.unionByName(new, allowMissingColumns=True), changed


def runtime_holds(evidence: DataFrame, reviews: DataFrame, runtimes: tuple[str, ...]) -> DataFrame:
    """Sources to hold: every selected runtime has exactly one row, failed, with the reviewed endpoint failing.

    ``evidence``: source, runtime, success, endpoints array<struct<url, status_code>>; ``reviews``: id, endpoint.
    """
    joined = evidence.where(F.col("runtime").isin(*runtimes)).join(
        reviews.select(F.col("id").alias("source"), "endpoint"), "source"
    )
    failing = F.exists("endpoints", lambda e: (e["url"] == F.col("endpoint")) & ((e["status_code"] == 0) | (e["status_code"] >= 400)))
    per_runtime = joined.groupBy("source", "runtime").agg(F.count("*").alias("n"), F.bool_and(~F.col("success") & failing).alias("proven"))
    held = per_runtime.groupBy("source").agg(F.count_if((F.col("n") == 1) & F.col("proven")).alias("proven_runtimes"))
    return held.where(F.col("proven_runtimes") == len(runtimes)).select(
        "source", F.lit("network_or_access_error").alias("outcome"), "proven_runtimes"
    )


# --- directories -----------------------------------------------------------------------------------


def directory_entry(prefix: str, name: Column, jurisdiction: Column, kind: Column, homepage: Column, provenance: Column) -> list[Column]:
    return [
        F.concat(F.lit(prefix + ":"), slugify(name)).alias("id"), name.alias("name_en"), F.lit("").alias("name_zh"),
        jurisdiction.alias("jurisdiction"), kind.alias("kind"), homepage.alias("homepage"),
        F.lit("directory_only").alias("status"), F.lit("").alias("adapter"), F.lit("").alias("feed"),
        provenance.alias("provenance"), F.lit(V.UNVERIFIED_REASON).alias("reason"),
    ]


def first_per_id(rows: DataFrame, position: str = "position") -> DataFrame:
    return keep_first(rows, [F.col("id")], [F.col(position)])


def suffix_collisions(rows: DataFrame, position: str = "position") -> DataFrame:
    """A later row with a taken id gets the last folder of its own path as suffix."""
    folder = F.element_at(F.filter(F.split(url_path(F.col("homepage")), "/"), lambda p: p != ""), -1)
    first = rows.groupBy("id").agg(F.min(position).alias("_first"))
    joined = rows.join(first, "id")
    return joined.withColumn("id", F.when(F.col(position) == F.col("_first"), F.col("id")).otherwise(F.concat_ws("-", "id", slugify(folder)))).drop("_first")


def guard_min_rows(rows: DataFrame, minimum: int, label: str) -> DataFrame:
    """The row count, or an error if a directory yields fewer rows than it ever should."""
    return rows.agg(F.count("*").alias("rows")).select(
        F.when(F.col("rows") >= minimum, F.col("rows")).otherwise(F.raise_error(F.lit(f"{label}: too few directory rows")).cast("bigint")).alias("rows")
    )


def union_catalog(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def unknown_ids(selected: Column, available: Column) -> Column:
    return F.array_except(selected, available)


