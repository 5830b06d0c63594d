"""The weekly run over landed data, and the selective re-run of failed sources."""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from pubwatch import fixed_values as V
from pubwatch.functions.base import literal_array
from pubwatch.functions.dates import period_bounds
from pubwatch.functions.urls import is_agency_homepage
from pubwatch.operators.dedupe import dedupe_briefings, dedupe_news
from pubwatch.operators.filters import adjust_health_counts, filter_period
from pubwatch.operators.health import failed_sources, observability, run_status, source_counts, source_health
from pubwatch.operators.merge import as_lookup, merge_briefings, merge_health, merge_news, resolve_source
from pubwatch.operators.provenance import build_provenance, delivery_id, run_fingerprint, run_id
from pubwatch.operators.ranking import side_by_side
from pubwatch.operators.relevance import Profile, annotate
from pubwatch.operators.runs import COUNT_FIELDS, run_counts
from pubwatch.session import materialize
from pubwatch.sources.feeds import briefing_records, is_unreadable, judged_entries, scan_feed


@dataclass(frozen=True)
class Run:
    """Lazy tables of one run."""

    news: DataFrame
    briefings: DataFrame
    health: DataFrame
    since: Column
    until: Column

    def counts(self) -> DataFrame:
        return run_counts(self.news, self.briefings)

    def status(self) -> DataFrame:
        return run_status(self.health, critical_only=True)

    def observability(self) -> DataFrame:
        return observability(self.health)

    def fingerprint(self) -> DataFrame:
        return run_fingerprint(self.news, self.briefings)

    def provenance(self, generated_at: Column) -> DataFrame:
        return build_provenance(self.news, self.briefings, self.health, generated_at)

    def topic_counts(self) -> DataFrame:
        """The question a run answers first: which topics, how many records, how strong."""
        found = self.news.where("included").select(F.explode("matched_topics").alias("topic"), "relevance_score")
        return found.groupBy("topic").agg(F.count("*").alias("records"), F.max("relevance_score").alias("best_score"))


def bounds(period: str, now: Column) -> tuple[Column, Column]:
    both = period_bounds(F.lit(period), now)
    return both["since"], both["until"]


def judged_news(news: DataFrame, sources: DataFrame, profile: Profile, since: Column, until: Column, arrival: tuple[str, ...] = ()) -> DataFrame:
    """Records of the period, once each, with source, match columns and ``landing`` (a source's own start page).

    The period filter comes first, so it reaches the scan; rows are de-duplicated before they are scored.  The
    de-duplication is the one exchange of whole records: sources are looked up beside them.
    """
    fetched = dedupe_news(filter_period(news, since, until), arrival)
    named = resolve_source(fetched, sources, ("homepage",))
    landing = is_agency_homepage(F.col("link"), F.coalesce("homepage", F.lit("")))
    return annotate(named.withColumn("landing", F.coalesce(landing, F.lit(False))).drop("homepage"), profile)


def removed_pages(judged: DataFrame) -> DataFrame:
    return judged.where("landing").groupBy("source_id").agg(F.count("*").alias("removed"))


def publication_run(
    news: DataFrame, briefings: DataFrame, health: DataFrame, sources: DataFrame, profile: Profile, since: Column, until: Column, arrival: tuple[str, ...] = (),
) -> Run:
    """Period filter, de-duplication, landing-page removal, relevance and health of one run, as lazy tables.

    ``sources``: source_ord, source_id, display_name, name_en, homepage.
    """
    judged = judged_news(news, sources, profile, since, until, arrival)
    return Run(
        judged.where(~F.col("landing")).drop("landing"), annotate(dedupe_briefings(filter_period(briefings, since, until)), profile, link=None),
        adjust_health_counts(health, removed_pages(judged)), since, until,
    )


# --- a run over landed bodies -------------------------------------------------------------------------------


@dataclass(frozen=True)
class RunRequest:
    """What a run was asked for; days are local days, the last one included."""

    period_start: date
    period_end: date
    profile: Profile
    generated_at: datetime
    output_file: str
    prefix: str = "watch"
    default_profile_id: str = V.DEFAULT_PROFILE_ID

    def __post_init__(self) -> None:
        if self.period_end < self.period_start:
            raise ValueError("the period ends before it starts")

    @property
    def since(self) -> Column:
        return F.to_utc_timestamp(F.lit(self.period_start.isoformat()), V.LOCAL_ZONE)

    @property
    def until(self) -> Column:
        return F.to_utc_timestamp(F.lit((self.period_end + timedelta(days=1)).isoformat()), V.LOCAL_ZONE)


@dataclass(frozen=True)
class LandedRun(Run):
    """A run whose stages are written: its outputs share them, and its counts come from the writing itself."""

    request: RunRequest
    observed: dict[str, dict[str, int]]

    def counts(self) -> DataFrame:
        news, briefings = self.observed["agency"], self.observed["parliament"]
        row = (news["final"], news["relevant"], briefings["final"], briefings["relevant"])
        return self.news.sparkSession.createDataFrame([row], ", ".join(f"{c} bigint" for c in COUNT_FIELDS))

    def pipeline_counts(self) -> DataFrame:
        """Six counts per record family, from candidates to relevant records.

        Candidates and source output are sums over the health rows; the rest was observed while the stages were
        written.  As records are de-duplicated with the period filter, both of these have the same count.
        """
        sums = self.health.groupBy("family").agg(F.sum("candidate_count").alias("candidate_count"), F.sum("source_item_count").alias("source_output_count"))
        rows = [(family, c["fetched"], c["fetched"], c["final"], c["relevant"]) for family, c in self.observed.items()]
        names = ("date_filtered_count", "deduped_count", "final_output_count", "relevant_output_count")
        seen = self.news.sparkSession.createDataFrame(rows, "family string, " + ", ".join(f"{c} bigint" for c in names))
        zero = {c: F.coalesce(c, F.lit(0)).cast("bigint") for c in ("candidate_count", "source_output_count")}
        return seen.join(sums, "family", "left").withColumns(zero).select("family", *zero, *names)

    def summary(self) -> DataFrame:
        """The run's one output row: identity, period, counts, status and warnings, fingerprint, delivery id, profile, observability."""
        ask, profile = self.request, self.request.profile
        start, end = F.lit(ask.period_start), F.lit(ask.period_end)
        row = side_by_side(self.counts(), self.status(), self.fingerprint(), self.observability())
        named = row.withColumn("run_id", run_id(start, end, F.lit(profile.profile_id), ask.default_profile_id, ask.prefix))
        return named.select(
            "run_id", F.lit(ask.generated_at.isoformat()).alias("generated_at"), F.date_format(start, "yyyy-MM-dd").alias("period_start"),
            F.date_format(end, "yyyy-MM-dd").alias("period_end"), F.lit(ask.output_file).alias("output_file"), *COUNT_FIELDS, "status", "warnings",
            "data_fingerprint", delivery_id(F.col("run_id"), F.col("status"), F.col("data_fingerprint")).alias("delivery_id"),
            F.lit(profile.profile_id).alias("profile_id"), F.lit(profile.name).alias("profile_name"), F.lit(profile.version).alias("profile_version"),
            F.lit(profile.content_hash).alias("profile_hash"), literal_array(profile.selected_sources).alias("selected_sources"),
            F.lit(profile.minimum_score).alias("minimum_score"),
            F.struct("source_count", "source_success_rate", "source_p95_seconds", "zero_item_ratio", "alerts").alias("observability"),
        )

    def records(self) -> DataFrame:
        """Both families in one table: record_type, link, title, published_at, included, relevance_score."""
        shared = ("title", "published_at", "included", "relevance_score")
        news = self.news.select(F.lit("news").alias("record_type"), "link", *shared)
        return news.unionByName(self.briefings.select(F.lit("parliament").alias("record_type"), F.col("webpage_url").alias("link"), *shared))


def _stored(df: DataFrame, label: str, **counts: Column) -> tuple[DataFrame, dict[str, int]]:
    """Write a stage and count it on the way.

    The counts sit in the task that writes, above the last exchange: each partition is counted once, by the attempt
    that is committed, also where lost executors make Spark repeat the stages below.
    """
    seen = Observation(f"{label}-{uuid.uuid4().hex}")
    written = materialize(df.observe(seen, *[c.alias(name) for name, c in counts.items()]), label)
    return written, {name: int(value or 0) for name, value in seen.get.items()}


def _body_facts(bodies: DataFrame, source: Column) -> DataFrame:
    """One row per source, written, since health asks twice; ``bodies``: a row per body with unreadable and duration_seconds."""
    facts = bodies.groupBy(source.alias("source")).agg(
        F.count_if("unreadable").alias("unreadable"), F.count("*").alias("bodies"), F.sum("duration_seconds").alias("duration_seconds")
    )
    return materialize(facts.withColumn("success", F.col("unreadable") < F.col("bodies")), "run-bodies")


def _feed_health(family: str, counts: DataFrame, facts: DataFrame, positions: DataFrame, rules: DataFrame, since: Column, now: Column) -> DataFrame:
    """Health rows of one family; a source without one readable body has failed."""
    facts = positions.select("source").join(facts, "source", "left").withColumns({
        "success": F.coalesce("success", F.lit(False)), "duration_seconds": F.coalesce("duration_seconds", F.lit(0.0)),
    })
    told = facts.where("unreadable > 0 OR NOT success").select("source", F.concat("source", F.lit(" RSS/Atom 讀取失敗")).alias("warning"), F.lit(0).alias("position"))
    rows = source_health(counts, rules, told, since, now).drop("success")
    return rows.join(facts.select("source", "success", "duration_seconds"), "source").join(positions, "source").withColumns({
        "family": F.lit(family), "source_item_count": F.col("item_count"),
    })


#: Landed entries have no arrival number, so equal ones are told apart by what else they say.
_SETTLED_BY = ("summary", "source_feed", "agency", "agency_en")


def landed_run(responses: DataFrame, briefing_responses: DataFrame, sources: DataFrame, rules: DataFrame, request: RunRequest, check_host: bool = False) -> LandedRun:
    """A whole run from landed feed bodies: entries, records, health, relevance; every stage is written once.

    ``responses``: source_id, url, body, duration_seconds.  ``briefing_responses``: publisher, url, page_no, body,
    duration_seconds; (page_no, place in the body) must be unique, it settles ties.  ``sources``: source_ord,
    source_id, display_name, name_en, homepage, patterns, official_urls.  ``rules``: thresholds, see ``health_rules``.

    Bodies of unknown sources are left out.  A null or broken body is a warning of its source; a source all of whose
    bodies are broken, or that has none, has failed.  Without any record the run is a run with zero counts.
    """
    since, until, now = request.since, request.until, F.lit(request.generated_at).cast("timestamp")
    beside = as_lookup(sources)
    known = sources.select("source_id", F.col("display_name").alias("agency"), F.col("name_en").alias("agency_en"), "homepage", "patterns", "official_urls")
    of_body = ("position", "unreadable", "duration_seconds")
    judged_all, _ = _stored(judged_entries(scan_feed(responses, every_body=True), beside(known), since, until, check_host, of_body), "run-entries", entries=F.count("position"))
    judged, of_news = _stored(
        judged_news(judged_all.where("kept").drop("source_id", "kept", "candidate", *of_body), sources, request.profile, since, until, _SETTLED_BY), "run-news",
        fetched=F.count("*"), final=F.count_if(~F.col("landing")), relevant=F.count_if(~F.col("landing") & F.col("included")),
    )
    entries = scan_feed(briefing_responses).withColumn("feed_url", F.col("url"))
    found, _ = _stored(briefing_records(entries, since), "run-briefing-entries", entries=F.count("*"))
    briefings, of_briefings = _stored(
        annotate(dedupe_briefings(filter_period(found, since, until)), request.profile, link=None), "run-briefings",
        fetched=F.count("*"), final=F.count("*"), relevant=F.count_if("included"),
    )
    positions = sources.select(F.col("source_id").alias("source"), F.struct("source_ord", F.lit("").alias("name")).alias("position"))
    entered, bodies = judged_all.where("position is not null"), judged_all.where("coalesce(position, 0) = 0")
    counts = source_counts(entered.select(F.col("source_id").alias("source"), "kept", "candidate", "published_at"), positions)
    of_agencies = _feed_health("agency", counts, _body_facts(bodies, F.col("source_id")), positions, rules, since, now)
    feed = F.concat(F.col("publisher"), F.lit(" RSS"))
    facts = _body_facts(briefing_responses.withColumn("unreadable", is_unreadable(F.col("body"))), feed)
    after = facts.select("source", F.struct(F.lit(2**31 - 1).alias("source_ord"), F.col("source").alias("name")).alias("position"))
    counts = source_counts(found.select(feed.alias("source"), F.lit(True).alias("kept"), F.lit(True).alias("candidate"), "published_at"), after)
    of_publishers = _feed_health("parliament", counts, facts, after, rules, since, now)
    health = adjust_health_counts(of_agencies.unionByName(of_publishers), removed_pages(judged))
    return LandedRun(
        judged.where(~F.col("landing")).drop("landing"), briefings, materialize(health, "run-health"), since, until, request,
        {"agency": of_news, "parliament": of_briefings},
    )


def selective_rerun(previous: Run, again: Run, sources: DataFrame, profile: Profile, briefings_id: str, arrival: tuple[str, ...] = ()) -> Run:
    """Merge the re-collected sources of ``again`` into ``previous``.

    Both runs must have been made with the same profile.
    """
    retried = failed_sources(previous.health, sources).select("source_id")
    news = merge_news(previous.news, again.news, retried, arrival)
    has_briefings = retried.where(F.col("source_id") == briefings_id).limit(1).count() == 1
    columns = [c for c in news.columns if not c.endswith("matched_keywords") and not c.endswith("_strengths") and c not in (
        "included", "matched_topics", "relevance_score", "relevance_level")]
    return Run(
        annotate(news.select(*columns), profile), merge_briefings(previous.briefings, again.briefings, has_briefings),
        merge_health(previous.health, again.health, retried, sources), previous.since, previous.until,
    )
