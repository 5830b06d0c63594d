"""Comparable performance baselines: which measured runs may share one, and their distributions.

Entries are rows of two structs.

``context``: revision, machine, cache_state, cache_key.
``summary``: run_id, generated_at, output_file, period_start, period_end, profile_hash, status, data_fingerprint,
selected_sources array<string>, source_health array<struct<source, success, item_count, warning>>, the four report
counts, and ``performance``: schema_version, runtime, runtime_version, workers, run_kind, total_endpoint,
translation_cache_hits, translation_cache_misses, total_wall_seconds, stages map<string, double>.

Null rows and fields: a missing condition is a fault of the entry, a missing cache counter is a condition of its own.
An empty table gives empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pubwatch import fixed_values as V
from pubwatch.functions.base import strip
from pubwatch.functions.canonical import json_list, json_object, json_plain, json_row, json_text
from pubwatch.operators.ranking import distribution
from pubwatch.operators.runs import COUNT_FIELDS, is_measured, stage_distributions
from pubwatch.session import materialize

IDENTITY = ("generated_at", "run_id", "output_file")
GROUP_ID_CHARS = 12
_S, _P, _C = F.col, "summary.performance.", "context."
_PERIOD = ("period_start", "period_end", "profile_hash", "status", "data_fingerprint")
_PERFORMANCE = {
    "schema_version": json_plain, "runtime": json_text, "runtime_version": json_text, "workers": json_plain, "run_kind": json_text,
    "total_endpoint": json_text, "translation_cache_hits": json_plain, "translation_cache_misses": json_plain,
}


def _blank(value: Column) -> Column:
    return F.coalesce(strip(value) == "", F.lit(True))


def entry_faults() -> Column:
    """Codes of what keeps an entry out of every baseline; empty for a sound one."""
    said = [F.when(_blank(_S(f"summary.{c}")), F.lit(f"missing_{c}")) for c in (*IDENTITY, "period_start", "period_end", "profile_hash")]
    listed = [F.when(F.coalesce(F.size(_S(f"summary.{c}")), F.lit(0)) < 1, F.lit(f"missing_{c}")) for c in ("selected_sources", "source_health")]
    how = [F.when(_blank(_S(_P + c)), F.lit(f"missing_{c}")) for c in ("runtime", "runtime_version", "total_endpoint")]
    counted = [F.when(F.coalesce(_S(f"summary.{c}") < 0, F.lit(True)), F.lit(f"invalid_{c}")) for c in COUNT_FIELDS]
    where = [_blank(_S(_C + c)) for c in ("revision", "machine", "cache_key")]
    unclear = where[0] | where[1] | where[2] | ~F.coalesce(_S(_C + "cache_state").isin("cold", "warm"), F.lit(False))
    return F.array_compact(F.array(
        F.when(~is_measured(_S("summary.performance")), F.lit("unmeasured")), F.when(unclear, F.lit("unclear_conditions")), *said, *listed, *how,
        F.when(F.coalesce(_S(_P + "workers"), F.lit(0)) < 1, F.lit("missing_workers")),
        F.when(~F.coalesce(_S(_P + "run_kind").isin("full", "retry"), F.lit(False)), F.lit("unknown_run_kind")),
        F.when(~F.coalesce(_S("summary.status").isin("complete", "degraded"), F.lit(False)), F.lit("unknown_status")), *counted,
    ))


def conditions() -> Column:
    """Everything two runs must share to be compared, as canonical JSON.

    Lists of sources and of health rows are sorted: the order in which a run met its sources is no condition.
    """
    health = F.array_sort(F.transform("summary.source_health", lambda s: F.struct(
        s["source"].alias("source"), s["success"].alias("success"), F.coalesce(s["item_count"].cast("bigint"), F.lit(0)).alias("item_count"),
        F.coalesce(s["warning"], F.lit("")).alias("warning"),
    )))
    return json_object({
        "context": json_object({c: json_text(_S(_C + c)) for c in ("revision", "machine", "cache_state", "cache_key")}),
        "summary": json_object({c: json_text(_S(f"summary.{c}")) for c in _PERIOD}),
        "sources": json_list(F.array_sort("summary.selected_sources"), json_text),
        "health": json_list(health, lambda s: json_row([json_text(s["source"]), json_plain(s["success"]), json_plain(s["item_count"]), json_text(s["warning"])])),
        "performance": json_object({c: write(_S(_P + c)) for c, write in _PERFORMANCE.items()}),
        "counts": json_object({c: json_plain(_S(f"summary.{c}")) for c in COUNT_FIELDS}),
    })


def entry_signature() -> Column:
    """Digest of a whole entry; the stages are a map, so they are ordered first."""
    performance = _S("summary.performance").withField("stages", F.array_sort(F.map_entries(_S(_P + "stages"))))
    whole = F.struct(_S("context"), _S("summary").withField("performance", performance).alias("summary"))
    return F.sha2(F.to_json(whole, {"ignoreNullFields": "false"}), 256)


def _once(entries: DataFrame) -> DataFrame:
    """One row per execution: least and greatest signature, number of records and one sample.

    Repeats meet in a map-side aggregate, so an execution recorded any number of times is one row per task.
    """
    key = conditions()
    sample = F.struct(
        F.sha2(key, 256).alias("condition_hash"), key.alias("conditions"), _S(_P + "run_kind").alias("run_kind"), _S("summary.status").alias("status"),
        _S(_P + "total_wall_seconds").alias("total_wall_seconds"), _S(_P + "stages").alias("stages"),
    )
    rows = entries.where(F.size(entry_faults()) == 0).select(*[_S(f"summary.{c}").alias(c) for c in IDENTITY], entry_signature().alias("_sig"), sample.alias("_sample"))
    return rows.groupBy(*IDENTITY).agg(F.min("_sig").alias("_low"), F.max("_sig").alias("_high"), F.count("*").alias("records"), F.first("_sample").alias("_sample"))


def baseline_samples(entries: DataFrame) -> DataFrame:
    """One sample per sound execution: identity, condition_hash, conditions, run_kind, status, seconds, stages.

    The samples are written once, as the rounds of the distributions read them again.  An execution recorded twice with the same content is one sample; recorded with different contents it is none, and
    :func:`baseline_issues` names it.
    """
    return materialize(_once(entries).where("_low = _high").select(*IDENTITY, "_sample.*"), "baseline-samples")


def baseline_issues(entries: DataFrame) -> DataFrame:
    """Entries that enter no baseline: identity, code, records.  Conflicting executions have ``conflicting_records``."""
    broken = entries.select(*[_S(f"summary.{c}").alias(c) for c in IDENTITY], F.explode(entry_faults()).alias("code"))
    conflicts = _once(entries).where("_low <> _high").select(*IDENTITY, F.lit("conflicting_records").alias("code"), "records")
    return broken.groupBy(*IDENTITY, "code").agg(F.count("*").alias("records")).unionByName(conflicts)


def _short(key: str = "condition_hash") -> Column:
    return F.left(F.col(key), F.lit(GROUP_ID_CHARS)).alias("group_id")


def baseline_groups(samples: DataFrame) -> DataFrame:
    """Wall-time distribution per set of conditions; grouped by the whole digest, shown by its first characters."""
    facts = samples.groupBy("condition_hash").agg(*[F.min(c).alias(c) for c in ("conditions", "run_kind", "status")])
    stats = distribution(samples, ["condition_hash"], "total_wall_seconds")
    ready = (F.col("n") >= V.BASELINE_MINIMUM_RUNS) & (F.col("run_kind") == "full") & (F.col("status") == "complete")
    return facts.join(stats, "condition_hash").select(
        _short(), "conditions", F.col("n").alias("sample_count"), ready.alias("baseline_ready"), "median", "p95", "min", "max"
    )


def baseline_stages(samples: DataFrame) -> DataFrame:
    """Distribution of every stage per set of conditions; null where a run of the group lacks the stage."""
    rows = stage_distributions(samples, ["condition_hash"])
    return rows.select(_short(), *[c for c in rows.columns if c != "condition_hash"])
