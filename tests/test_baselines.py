"""Comparable baselines: conditions, repeats and conflicts, faults, canonical text."""

import hashlib
import json
import math

import pytest

from pubwatch.functions.canonical import json_list, json_object, json_plain, json_row, json_text
from pubwatch.operators import baselines
from pyspark.sql import functions as F

ENTRY = """context struct<revision:string,machine:string,cache_state:string,cache_key:string>,
  summary struct<run_id:string,generated_at:string,output_file:string,period_start:string,period_end:string,profile_hash:string,status:string,data_fingerprint:string,
    selected_sources:array<string>,source_health:array<struct<source:string,success:boolean,item_count:int,warning:string>>,
    all_news_count:long,filtered_news_count:long,parliament_count:long,filtered_parliament_count:long,
    performance:struct<schema_version:int,runtime:string,runtime_version:string,workers:int,run_kind:string,total_endpoint:string,translation_cache_hits:long,
      translation_cache_misses:long,total_wall_seconds:double,stages:map<string,double>>>"""


def entry(number=1, **changes):
    """A sound entry; ``changes`` go to the part that has the field."""
    context = {"revision": "r1", "machine": "Büro \"8\"\x1f", "cache_state": "cold", "cache_key": "none"}
    performance = {
        "schema_version": 1, "runtime": "spark", "runtime_version": "4.1", "workers": 8, "run_kind": "full", "total_endpoint": "write",
        "translation_cache_hits": None, "translation_cache_misses": None, "total_wall_seconds": 10.0 * number, "stages": {"read": 1.0 * number, "write": None},
    }
    summary = {
        "run_id": "r", "generated_at": f"t{number}", "output_file": "o", "period_start": "2026-01-01", "period_end": "2026-01-07", "profile_hash": "p", "status": "complete",
        "data_fingerprint": "f", "selected_sources": ["B", "A"], "source_health": [("B", True, 2, None), ("A", False, None, "w")],
        "all_news_count": 2, "filtered_news_count": 1, "parliament_count": 0, "filtered_parliament_count": 0,
    }
    for name, value in changes.items():
        part = next(p for p in (context, summary, performance) if name in p)
        part[name] = value
    return context, {**summary, "performance": performance}


def table(spark, *entries):
    return spark.createDataFrame(list(entries), ENTRY)


def groups(spark, *entries):
    return baselines.baseline_groups(baselines.baseline_samples(table(spark, *entries))).collect()


def test_three_runs_make_a_baseline_and_a_repeat_is_no_run(spark):
    samples = baselines.baseline_samples(table(spark, entry(1), entry(2), entry(3), entry(3)))
    row = baselines.baseline_groups(samples).first()
    assert (row["sample_count"], row["baseline_ready"], row["median"], row["p95"], row["min"], row["max"]) == (3, True, 20.0, 30.0, 10.0, 30.0)
    stages = {r["stage"]: r["median"] for r in baselines.baseline_stages(samples).collect()}
    assert stages == {"read": 2.0, "write": None}
    assert not groups(spark, entry())[0]["baseline_ready"]


def test_group_id_is_the_digest_of_the_sorted_conditions(spark):
    context, summary = entry()
    performance = summary["performance"]
    contract = {
        "context": context, "sources": ["A", "B"], "health": [["A", False, 0, "w"], ["B", True, 2, ""]],
        "summary": {k: summary[k] for k in ("period_start", "period_end", "profile_hash", "status", "data_fingerprint")},
        "performance": {k: v for k, v in performance.items() if k not in ("total_wall_seconds", "stages")},
        "counts": {k: v for k, v in summary.items() if k.endswith("_count")},
    }
    text = json.dumps(contract, ensure_ascii=False, sort_keys=True)
    row = groups(spark, entry())[0]
    assert row["conditions"] == text and row["group_id"] == hashlib.sha256(text.encode()).hexdigest()[:12]


@pytest.mark.parametrize(("name", "value"), [
    ("machine", "m2"), ("cache_key", "k2"), ("revision", "r2"), ("data_fingerprint", "g"), ("profile_hash", "q"), ("status", "degraded"),
    ("run_kind", "retry"), ("runtime", "other"), ("translation_cache_hits", 2), ("all_news_count", 3), ("selected_sources", ["A"]),
])
def test_other_conditions_are_another_group(spark, name, value):
    rows = groups(spark, entry(1), entry(2, **{name: value}))
    assert [r["sample_count"] for r in rows] == [1, 1]


def test_the_order_of_sources_is_no_condition(spark):
    rows = groups(spark, entry(1), entry(2, selected_sources=["A", "B"], source_health=[("A", False, 0, "w"), ("B", True, 2, "")]))
    assert [r["sample_count"] for r in rows] == [2]


def test_conflicting_records_are_named_and_make_no_sample(spark):
    rows = table(spark, entry(1), entry(1, machine="m2"), entry(2), entry(2))
    assert [tuple(r) for r in baselines.baseline_issues(rows).collect()] == [("t1", "r", "o", "conflicting_records", 2)]
    assert [r["generated_at"] for r in baselines.baseline_samples(rows).collect()] == ["t2"]


def test_faulty_entries_are_named(spark):
    faults = {
        "unmeasured": [("total_wall_seconds", v) for v in (0.0, -1.0, math.nan, math.inf, None)] + [("schema_version", 2)],
        "missing_profile_hash": [("profile_hash", None)], "missing_selected_sources": [("selected_sources", []), ("selected_sources", None)],
        "unknown_run_kind": [("run_kind", "half")], "unclear_conditions": [("cache_state", "warmish"), ("machine", " "), ("revision", None)],
        "invalid_parliament_count": [("parliament_count", -1), ("parliament_count", None)], "missing_generated_at": [("generated_at", None)],
        "missing_workers": [("workers", 0)], "unknown_status": [("status", "x")],
    }
    wanted = [(code, change) for code, changes in faults.items() for change in changes]
    rows = table(spark, *[entry(n, **{**({} if c[0] == "generated_at" else {"generated_at": f"g{n}"}), c[0]: c[1]}) for n, (_, c) in enumerate(wanted)], (None, None))
    found = {(r["generated_at"], r["code"]) for r in baselines.baseline_issues(rows).collect()}
    assert all((None if c[0] == "generated_at" else f"g{n}", code) in found for n, (code, c) in enumerate(wanted))
    assert baselines.baseline_samples(rows).count() == 0
    empty = rows.where("false")
    assert baselines.baseline_issues(empty).count() == 0 and baselines.baseline_groups(baselines.baseline_samples(empty)).count() == 0


def test_groups_need_no_cartesian_product(spark):
    out = baselines.baseline_groups(baselines.baseline_samples(table(spark, entry(1), entry(2))))
    assert "Cartesian" not in out._jdf.queryExecution().executedPlan().toString()


def test_canonical_text_matches_json(spark):
    value = 'x\x1f\x0b "q" \\u001F é \n'
    row = spark.createDataFrame([(value, 3, None, ["b", None])], "t string, n int, z string, l array<string>")
    text = json_object({"b": json_plain(F.col("n")), "a": json_text(F.col("t")), "é": json_row([json_text(F.col("z")), json_plain(F.lit(True))]), "l": json_list(F.col("l"), json_text)})
    wanted = json.dumps({"a": value, "b": 3, "l": ["b", None], "é": [None, True]}, ensure_ascii=False)
    assert row.select(text).first()[0] == wanted
