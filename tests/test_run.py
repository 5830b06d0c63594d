"""A whole run over landed bodies: counts, health, status, summary, plan."""

import re
from datetime import UTC, date, datetime

import pytest
from pyspark.sql import functions as F

from pubwatch.functions.dates import utc_text
from pubwatch.operators.health import health_rules
from pubwatch.operators.relevance import Profile
from pubwatch.plans.publication_run import RunRequest, judged_news, landed_run

PROFILE = Profile("quantum-watch", "Quantum watch", (("Quantum", (("quantum computing", "core"), ("qubit", "general"))),), selected_sources=("A", "B"), minimum_score=5)
REQUEST = RunRequest(date(2026, 6, 1), date(2026, 6, 7), PROFILE, datetime(2026, 6, 8, tzinfo=UTC), "out.xlsx")
BODY = "source_id string, url string, body string, duration_seconds double"
PRESS = "publisher string, url string, page_no long, body string, duration_seconds double"
SOURCE = "source_ord int, source_id string, display_name string, name_en string, homepage string, patterns array<string>, official_urls array<string>"
SOURCES = [(i, s, f"Agency {s}", f"Body {s}", f"https://{s.lower()}.example/", [], []) for i, s in enumerate("ABC")]


def item(title, link, day, guid="", summary=""):
    return f"<item><title>{title}</title><link>{link}</link><guid>{guid}</guid><pubDate>Mon, {day:02d} Jun 2026 12:00:00 GMT</pubDate><description>{summary}</description></item>"


def feed(*items):
    return "<rss><channel>" + "".join(items) + "</channel></rss>"


def run(spark, bodies, press=(), sources=SOURCES):
    return landed_run(spark.createDataFrame(list(bodies), BODY), spark.createDataFrame(list(press), PRESS), spark.createDataFrame(list(sources), SOURCE),
                      health_rules(spark, {}, {}), REQUEST)


NEWS = [
    ("A", "u", feed(item("Quantum computing law", "https://a.example/1", 2), item("Quantum computing law", "https://A.example/1/", 3), item("Old", "https://a.example/2", 20),
                    item("", "https://a.example/3", 3), item("Fishing", "https://a.example/4", 4)), 1.0),
    ("A", "u2", None, 2.0),
    ("B", "u", "<html>gone</html>", 4.0),
    ("Z", "u", feed(item("Unknown source", "https://z.example/1", 3)), 1.0),
]
PAPERS = [("House of Lords Library", "l", 1, feed(item("Qubit and quantum computing", "https://l.example/1", 3, "CBP-1"), item("Late", "https://l.example/2", 9, "CBP-2")), 0.5)]


def test_counts_health_and_status_of_a_run(spark):
    done = run(spark, NEWS, PAPERS)
    assert tuple(done.counts().first()) == (2, 1, 1, 1)
    assert {tuple(r) for r in done.pipeline_counts().collect()} == {("agency", 3 + 1, 3, 2, 2, 2, 1), ("parliament", 2, 2, 1, 1, 1, 1)}
    health = {r["source"]: (r["success"], r["item_count"], r["duration_seconds"], r["warning"]) for r in done.health.collect()}
    assert health == {
        "A": (True, 3, 3.0, "A RSS/Atom 讀取失敗"), "B": (False, 0, 4.0, "B RSS/Atom 讀取失敗"), "C": (False, 0, 0.0, "C RSS/Atom 讀取失敗"),
        "House of Lords Library RSS": (True, 2, 0.5, ""),
    }
    row = done.summary().first()
    assert (row["run_id"], row["status"], row["warnings"]) == ("watch-2026-06-01_2026-06-07-quantum-watch", "degraded", [f"{s} RSS/Atom 讀取失敗" for s in "ABC"])
    assert row["delivery_id"] == f"{row['run_id']}:RunStatus.DEGRADED:{row['data_fingerprint'][:16]}" and row["observability"]["source_count"] == 4
    assert row["selected_sources"] == ["A", "B"] and row["profile_hash"] == PROFILE.content_hash
    assert {(r["record_type"], r["title"], r["included"]) for r in done.records().collect()} == {
        ("news", "Quantum computing law", True), ("news", "Fishing", False), ("parliament", "Qubit and quantum computing", True)}


def test_a_clean_run_is_complete_and_its_fingerprint_follows_the_records(spark):
    one = [("A", "u", feed(item("Quantum computing law", "https://a.example/1", 2)), 1.0)]
    other = [("A", "u", feed(item("Quantum computing law", "https://a.example/1", 2, summary="changed")), 1.0)]
    first, second = (run(spark, b, sources=SOURCES[:1]).summary().first() for b in (one, other))
    assert first["status"] == second["status"] == "complete" and first["warnings"] == []
    assert first["data_fingerprint"] != second["data_fingerprint"] and first["delivery_id"] != second["delivery_id"]


def test_a_run_over_nothing(spark):
    done = run(spark, [], sources=[])
    assert tuple(done.counts().first()) == (0, 0, 0, 0) and done.records().count() == 0
    assert {tuple(r) for r in done.pipeline_counts().collect()} == {("agency", 0, 0, 0, 0, 0, 0), ("parliament", 0, 0, 0, 0, 0, 0)}
    row = done.summary().first()
    assert (row["status"], row["all_news_count"], row["observability"]["source_count"]) == ("complete", 0, 0)


def test_a_period_is_whole_local_days(spark):
    bounds = spark.range(1).select(utc_text(REQUEST.since), utc_text(REQUEST.until)).first()
    assert tuple(bounds) == ("2026-05-31 16:00:00", "2026-06-07 16:00:00")
    with pytest.raises(ValueError):
        RunRequest(date(2026, 6, 2), date(2026, 6, 1), PROFILE, datetime(2026, 6, 8, tzinfo=UTC), "o")


def _news(spark, rows):
    return spark.createDataFrame(
        [(f"Agency {u}", "", u, t, "text", l, datetime(2026, 6, 3, tzinfo=UTC)) for u, t, l in rows],
        "agency string, agency_en string, unit_category string, title string, summary string, link string, published_at timestamp")


def _wide_exchanges(df):
    text = df.sparkSession._jvm.org.apache.spark.sql.api.python.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    return [s for s in re.findall(r"\(\d+\) Exchange\nInput \[\d+\]: \[(.*?)\]\n", text) if "summary#" in s]


def test_records_move_once(spark, monkeypatch):
    from pubwatch.operators import merge

    sources = spark.createDataFrame(SOURCES, SOURCE)
    news = _news(spark, [("A", "one", "https://a.example/1"), ("A", "home", "https://a.example/")])
    out = judged_news(news, sources, PROFILE, REQUEST.since, REQUEST.until)
    assert len(_wide_exchanges(out)) == 1
    assert {(r["title"], r["landing"], r["source_id"]) for r in out.collect()} == {("one", False, "A"), ("home", True, "A")}
    monkeypatch.setattr(merge, "LOOKUP_BYTES", 0)
    unhinted = judged_news(news, sources, PROFILE, REQUEST.since, REQUEST.until)
    assert {(r["title"], r["landing"], r["source_id"]) for r in unhinted.collect()} == {("one", False, "A"), ("home", True, "A")}
    assert "ResolvedHint" in out._jdf.queryExecution().analyzed().toString() and "ResolvedHint" not in unhinted._jdf.queryExecution().analyzed().toString()


def test_repeated_source_ids_multiply_nothing(spark):
    sources = spark.createDataFrame([*SOURCES, (9, "A", "Agency A", "Body A", "https://later.example/", [], [])], SOURCE)
    out = judged_news(_news(spark, [("A", "one", "https://a.example/1")]), sources, PROFILE, REQUEST.since, REQUEST.until)
    assert out.count() == 1 and out.select(F.count("source_id")).first()[0] == 1


def test_the_profile_hash_equals_the_scan_s(spark):
    from pubwatch.sources.payloads import profile_hash

    topics = [(t, [(p, s) for p, s in words]) for t, words in PROFILE.topics]
    row = spark.createDataFrame(
        [(PROFILE.version, PROFILE.profile_id, PROFILE.name, PROFILE.description, PROFILE.minimum_score, list(PROFILE.selected_sources), topics)],
        "version int, profile_id string, name string, description string, minimum_score int, selected_sources array<string>, topics array<struct<name:string,keywords:array<struct<phrase:string,strength:string>>>>")
    assert row.select(profile_hash()).first()[0] == PROFILE.content_hash


def test_bodies_of_agencies_are_read_once(spark, monkeypatch):
    from pubwatch.plans import publication_run as plan
    from pubwatch.sources import feeds

    bodies = ["<rss><channel><item><title>a</title></item><item><title>b</title></item></channel></rss>", "<rss><channel></channel></rss>", "<html></html>", None, "<item>x</item>"]
    rows = feeds.split_entries(spark.createDataFrame(enumerate(bodies), "id int, body string"), every_body=True).collect()
    assert sorted((r["id"], r["position"] is None, r["unreadable"]) for r in rows) == [
        (0, False, False), (0, False, False), (1, True, False), (2, True, True), (3, True, True), (4, False, False)]
    asked = []
    facts = plan._body_facts
    monkeypatch.setattr(plan, "_body_facts", lambda df, source: asked.append(df.columns) or facts(df, source))
    from pubwatch.workload import tables, weekly

    weekly.weekly(tables.Tables(spark, "/root/testdata/sf0.001")).counts().collect()
    assert "body" not in asked[0] and {"unreadable", "duration_seconds"} <= set(asked[0])
