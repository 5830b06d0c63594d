"""Operators on small tables: brute-force checks, hot keys and independence of row order."""

import math
import random
from datetime import UTC, datetime, timedelta

import pandas as pd
from pyspark.sql import functions as F

from pubwatch.operators import catalog, cutoff, dedupe, health, ledger, merge, ranking, runs
from pubwatch.streaming import live

NEWS = "agency string, unit_category string, title string, link string, published_at timestamp"


def news(spark, *rows):
    day = datetime(2026, 6, 1, tzinfo=UTC)
    return spark.createDataFrame([("Agency", u, t, l, day) for u, t, l in rows], NEWS)


def test_dedupe_cases(spark):
    assert dedupe.dedupe_news(news(spark, ("A", "t", "https://x/a"), ("A", "t", " HTTPS://x/a/ "))).count() == 1
    assert dedupe.dedupe_news(news(spark, ("A", "t", "https://x/a"), ("A", "t", "https://x/b"))).count() == 2
    both = [("beta", "t", "https://x/a"), ("alpha", "t", "https://x/a")]
    for rows in (both, both[::-1]):
        assert dedupe.dedupe_news(news(spark, *rows)).first()["unit_category"] == "alpha"
    assert dedupe.dedupe_news(news(spark, ("A", "One – two", ""), ("B", "one -  TWO", ""))).count() == 1


def test_equal_records_keep_arrival_order(spark):
    rows = news(spark, *[("A", "same title", "")] * 40).select("*", F.monotonically_increasing_id().alias("n")).withColumn("arrival", F.expr("cast(row_number() over (order by n) AS int)")).drop("n")
    for seed in range(3):
        mixed = rows.orderBy(F.rand(seed)).repartition(1 + 3 * seed)
        assert [r["arrival"] for r in dedupe.dedupe_news(mixed, ("arrival",)).collect()] == [1]
        named = mixed.withColumn("source_id", F.lit("s"))
        both = merge.merge_news(named.where("arrival > 20"), named.where("arrival between 7 and 20"), spark.createDataFrame([("x",)], "source_id string"), ("arrival",))
        assert [r["arrival"] for r in both.collect()] == [7]


def test_dedupe_limits_a_hot_key_before_the_exchange(spark):
    rows = spark.range(3000).select(F.lit("A").alias("agency"), F.lit("u").alias("unit_category"), F.col("id").cast("string").alias("title"),
                                    F.when(F.col("id") % 3 == 0, F.lit("https://hot/")).otherwise(F.concat(F.lit("https://x/"), "id")).alias("link"), F.timestamp_seconds("id").alias("published_at"))
    out = dedupe.dedupe_news(rows)
    assert out.count() == 2001 and out.where("link = 'https://hot/'").first()["title"] == "2997"
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.index("WindowGroupLimit") < plan.index("Exchange hashpartitioning") < plan.rindex("WindowGroupLimit")


def test_results_do_not_depend_on_partitioning(spark):
    rng = random.Random(5)
    rows = [(rng.choice("ab"), f"t{rng.randrange(40)}", rng.choice(["", f"https://x/{rng.randrange(60)}"])) for _ in range(400)]
    table = news(spark, *rows)
    expected = sorted(map(tuple, dedupe.dedupe_news(table).collect()))
    rng.shuffle(rows)
    assert sorted(map(tuple, dedupe.dedupe_news(news(spark, *rows).repartition(13)).collect())) == expected


def test_order_statistics_match_brute_force_with_a_hot_group(spark):
    rng = random.Random(11)
    data = [("hot", rng.choice([float(rng.randrange(5000)), rng.random() * 100])) for _ in range(30000)] + [(f"g{i % 7}", float(rng.randrange(50))) for i in range(300)] + [("one", 4.0)]
    found = {r["g"]: r for r in ranking.distribution(spark.createDataFrame(data, "g string, v double").repartition(8), ["g"], "v").collect()}
    groups = {}
    for g, v in data:
        groups.setdefault(g, []).append(v)
    for g, values in groups.items():
        values.sort()
        n = len(values)
        assert found[g]["n"] == n and found[g]["min"] == values[0] and found[g]["max"] == values[-1]
        assert found[g]["p95"] == values[math.ceil(n * 0.95) - 1]
        assert found[g]["median"] == (values[(n + 1) // 2 - 1] + values[n // 2]) / 2


def test_order_statistics_narrow_in_the_values_own_type(spark):
    big = 1 << 60  # neighbours that a double can't tell apart
    rows = [("hot", big + (k * 7919) % 3000) for k in range(6000)] + [("one", 5), ("none", None), (None, 3), (None, 4)]
    df = spark.createDataFrame(rows, "g string, v long").repartition(7)
    ranks = {"low": lambda n: F.lit(1).cast("long"), "median": ranking.lower_median, "p95": ranking.nearest_rank(0.95)}
    found = {r["g"]: r for r in ranking.order_statistics(df, ["g"], "v", ranks, width=20, pivots=6).collect()}
    hot = sorted(v for g, v in rows if g == "hot")
    assert tuple(found["hot"][c] for c in ("n", "low", "median", "p95", "max")) == (6000, hot[0], hot[2999], hot[5699], hot[-1])
    assert found["one"]["median"] == 5 and "none" not in found and found[None]["n"] == 2


def test_number_rows_is_dense_and_ordered(spark):
    rows = spark.range(5000).select(F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("k"), "id")
    out = ranking.number_rows(rows.repartition(11), [F.col("k"), F.col("id")]).collect()
    assert [(r["k"], r["id"]) for r in sorted(out, key=lambda r: r["number"])] == sorted((r["k"], r["id"]) for r in out)
    assert sorted(r["number"] for r in out) == list(range(1, 5001))


def test_source_contract(spark):
    rows = spark.createDataFrame([("A", True, True, 2, 2.0), ("B", True, True, 0, 3.0), ("C", True, False, 0, 70.0), ("D", False, False, 0, 900.0)], "source string, critical boolean, success boolean, item_count int, duration_seconds double")
    assert tuple(health.observability(rows).first()) == (3, 0.667, 70.0, 0.667, ["source_success_rate", "source_p95_seconds", "zero_item_ratio"])
    assert tuple(health.observability(rows.where("false")).first()) == (0, 1.0, 0.0, 0.0, [])


def test_sources_without_rows_keep_a_health_row(spark):
    now = datetime(2026, 6, 1, tzinfo=UTC)
    entries = spark.createDataFrame([("BIST", True, True, now - timedelta(days=20)), ("Quiet", False, True, now)], "source string, kept boolean, candidate boolean, published_at timestamp")
    sources = spark.createDataFrame([("BIST",), ("DCMS",), ("Quiet",)], "source string")
    told = spark.createDataFrame([("BIST", "w2", 2), ("BIST", "w1", 1), ("BIST", "w2", 3)], "source string, warning string, position int")
    rows = {r["source"]: r for r in health.source_health(health.source_counts(entries, sources), health.health_rules(spark), told, F.lit(now - timedelta(days=25)), F.lit(now)).collect()}
    assert rows["BIST"]["warning"] == "BIST 最新資料已超過 14 天；w1；w2"
    assert rows["DCMS"]["warning"] == "DCMS 筆數異常：取得 0 筆，低於健康門檻 1 筆"
    assert rows["Quiet"]["warning"] == "Quiet 有候選資料但解析為零筆"


def test_run_status(spark):
    rows = spark.createDataFrame([("a", True, True, "", 1), ("b", False, False, "x", 2), ("c", False, True, "x", 3)], "source string, critical boolean, success boolean, warning string, position int")
    assert tuple(health.run_status(rows, critical_only=True).first()) == ("complete", ["x"])
    assert tuple(health.run_status(rows).first()) == ("degraded", ["x"])
    assert tuple(health.run_status(rows.where("false")).first()) == ("complete", [])


def test_trailing_matches(spark):
    table = "compared_at int, logical_match boolean"
    assert cutoff.trailing_matches(spark.createDataFrame([(1, True), (2, False), (3, True), (4, True)], table)).first()[0] == 2
    assert cutoff.trailing_matches(spark.createDataFrame([(1, True), (2, True)], table)).first()[0] == 2


def test_aliases_match_brute_force(spark):
    rng = random.Random(2)
    places = ["UK", "Scotland", "Wales"]
    rows = [(f"r{i}", f"Body {rng.randrange(12)}" + rng.choice(["", " Scotland"]), rng.choice(places)) for i in range(60)]
    usable = [(f"q{i}", f"BODY {rng.randrange(12)}" + rng.choice(["", " scotland"]), rng.choice(places)) for i in range(25)] + rows[:5]
    schema = "id string, name_en string, jurisdiction string"
    found = {tuple(r) for r in catalog.name_aliases(spark.createDataFrame(rows, schema), spark.createDataFrame(usable, schema)).collect()}

    def fits(name, place, other):
        return place == other or (other == "UK" and place == "Scotland" and "scotland" in name.lower())

    expected = set()
    for i, name, place in rows:
        ids = {q for q, n, p in usable if n.lower() == name.lower() and q != i and fits(name, place, p)}
        if len(ids) == 1:
            expected.add((i, ids.pop()))
    assert found == expected and expected


def test_ledger_life_cycle(spark):
    events = "delivery_id string, event string, run_id string, status string, data_fingerprint string, excel_path string, message_id string, event_seq long"
    empty = spark.createDataFrame([], events)
    runs_table = spark.createDataFrame([("d1", "r1", "complete", "f", "x"), ("d1", "r2", "complete", "f", "x"), ("d2", "old", "degraded", "g", "y")], "delivery_id string, run_id string, status string, data_fingerprint string, excel_path string")
    claimed, refused = ledger.claim(runs_table, ledger.ledger_state(empty), F.lit(1).cast("long"))
    assert {r["delivery_id"] for r in claimed.collect()} == {"d1", "d2"} and refused.count() == 0
    log = spark.createDataFrame(claimed.collect(), events)
    _again, refused = ledger.claim(runs_table, ledger.ledger_state(log), F.lit(2).cast("long"))
    assert refused.count() == 3
    asked = spark.createDataFrame([("d1", "m1"), ("d9", "m9")], "delivery_id string, message_id string")
    sent, bad = ledger.complete(asked, ledger.ledger_state(log), F.lit(3).cast("long"))
    assert [r["delivery_id"] for r in bad.collect()] == ["d9"]
    log = spark.createDataFrame(log.collect() + sent.collect(), events)
    gone = ledger.release(spark.createDataFrame([("d1",), ("d2",)], "delivery_id string"), ledger.ledger_state(log), F.lit(4).cast("long"))
    state = {r["delivery_id"]: r["state"] for r in ledger.ledger_state(spark.createDataFrame(log.collect() + gone.collect(), events)).collect()}
    assert state == {"d1": "sent"}


def test_resolve_source_takes_the_first_in_order(spark):
    sources = spark.createDataFrame([(0, "A", "甲 (A)", "Alpha"), (1, "B", "乙 (B)", "Beta")], "source_ord int, source_id string, display_name string, name_en string")
    rows = spark.createDataFrame([("乙 (B)", "Alpha", "B"), ("B", "x", None), ("?", "?", "A"), ("Else", "", "")], "agency string, agency_en string, unit_category string")
    assert sorted((r["agency"], r["source_id"]) for r in merge.resolve_source(rows, sources).collect()) == [("?", "A"), ("B", "B"), ("Else", "Else"), ("乙 (B)", "A")]


def test_period_filter_reaches_the_scan(spark, tmp_path):
    from pubwatch.operators.filters import filter_period

    path = str(tmp_path / "news")
    spark.range(10).select("id", F.timestamp_seconds("id").alias("published_at"), F.lit("x").alias("body")).write.parquet(path)
    bounds = [F.lit(x).cast("timestamp") for x in ("1970-01-01 00:00:02", "1970-01-01 00:00:05")]
    out = filter_period(spark.read.parquet(path), *bounds).select("id")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(published_at" in plan and "LessThan(publis" in plan and "body" not in plan
    assert sorted(r["id"] for r in out.collect()) == [2, 3, 4]


def test_scoring_needs_no_shuffle(spark):
    from pubwatch.operators.relevance import default_profile, filter_relevant

    rows = spark.createDataFrame([("AI plan", "", "https://x.example/1")], "title string, summary string, link string")
    plan = filter_relevant(rows, default_profile())._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Join" not in plan


def test_page_cutoffs_have_no_limit_of_their_own(spark):
    pages = spark.range(1, 121).selectExpr("'s' AS source", "int(id) AS page_no", "10 AS entries", "10 AS dated", "timestamp'2024-02-01' AS oldest", "true AS readable", "5000 AS total")
    since = F.lit("2024-01-01").cast("timestamp")
    assert cutoff.page_cutoff_feed(pages, ["source"], since).count() == 120
    assert cutoff.page_cutoff_feed(pages, ["source"], since, max_pages=20).count() == 20
    kept, warnings = cutoff.page_cutoff_search(pages, ["source"])
    assert kept.count() == 120 and warnings.first()["warning"] is None
    assert cutoff.page_cutoff_search(pages, ["source"], max_pages=50)[1].first()["warning"] == "too_many_results"


def test_search_pages_are_summed_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(cutoff, "PAGE_BLOCK", 16)
    pages = spark.range(240).selectExpr("concat('s', id % 2) AS source", "int(id div 2) AS page_no", "int(1 + id % 3) AS entries", "bigint(if(id % 2 = 0, 100, 1000)) AS total", "id <> 151 AS readable")
    rows = sorted(pages.collect(), key=lambda r: r.page_no)
    want, fetched, over = set(), {"s0": 0, "s1": 0}, set()
    for r in rows:
        if r.source not in over:
            fetched[r.source] += r.entries if r.readable else 0
            want |= {(r.source, r.page_no, fetched[r.source])} if r.readable else set()
            over |= {r.source} if not r.readable or fetched[r.source] >= r.total else set()
    kept, warnings = cutoff.page_cutoff_search(pages, ["source"])
    assert {(r.source, r.page_no, r.fetched) for r in kept.collect()} == want and len(over) == 2
    assert {r.source: r.warning for r in warnings.collect()} == {"s0": None, "s1": "broken_page"}


def test_sources_repeated_by_id_do_not_multiply_news(spark):
    news = spark.createDataFrame([("x", "y", "u1")], "agency string, agency_en string, unit_category string")
    sources = spark.createDataFrame([(2, "u1", "A", "B"), (1, "u1", "C", "D")], "source_ord int, source_id string, display_name string, name_en string")
    assert merge.resolve_source(news, sources).count() == 1


def test_a_period_of_one_run_only_matches_nothing(spark):
    fields = [*runs.COUNT_FIELDS, "data_fingerprint", "status", "delivery_id", "profile_hash", "health_contract", "provenance_contract", "source_count", "source_success_rate"]
    one = spark.range(2).selectExpr("string(id) AS period_start", "string(id) AS period_end", *(f"string(null) AS {f}" for f in fields))
    got = {r.period_start: r.logical_match for r in runs.logical_matches(runs.compare_runs(one, one.where("period_start = '0'"))).collect()}
    assert got == {"0": True, "1": False}


def test_ledger_is_the_same_in_any_row_order(spark):
    schema = "delivery_id string, event string, run_id string, status string, data_fingerprint string, excel_path string, message_id string, event_seq long"
    made = lambda d, e, r, seq: (d, e, r, "complete", "f", f"{r}.xlsx", "m" if e == "sent" else "", seq)
    rows = [
        made("race", "claimed", "b", 1), made("race", "claimed", "a", 1), made("late", "claimed", "y", 4), made("late", "claimed", "a", 5),
        made("again", "claimed", "a", 1), made("again", "released", "a", 2), made("again", "claimed", "z", 3), made("again", "claimed", "c", 4),
        made("final", "claimed", "a", 1), made("final", "released", "a", 2), made("final", "sent", "a", 2), made("gone", "claimed", "a", 1), made("gone", "released", "a", 1),
    ]
    want = {("race", "claimed", "a", 1), ("late", "claimed", "y", 5), ("again", "claimed", "z", 4), ("final", "sent", "a", 2)}
    for order in (rows, rows[::-1], rows[5:] + rows[:5]):
        state = ledger.ledger_state(spark.createDataFrame(order, schema).repartition(3))
        assert {(r["delivery_id"], r["state"], r["run_id"], r["event_seq"]) for r in state.collect()} == want


def test_stream_ledger_over_batches_and_restarts(spark, tmp_path):
    schema = "delivery_id string, event string, event_seq long, run_id string, event_time timestamp"
    at = lambda day, hour=0: datetime(2024, 1, day, hour)
    batches = [
        [("a", "sent", 2, "r", at(1, 2)), ("b", "claimed", 3, "r", at(1, 3))],
        [("a", "claimed", 1, "r", at(1, 1)), ("b", "released", 4, "r", at(1, 4)), ("b", "sent", 5, "r", at(1, 5)), ("x", "claimed", 6, "r", at(4))],
        [("a", "claimed", 7, "late", at(1, 1)), ("a", "claimed", 8, "r", at(5)), ("x", "sent", 9, "r", at(9))],
        [("x", "claimed", 10, "r", at(28)), ("a", "claimed", 11, "r", at(20))],
        [("x", "claimed", 12, "r", at(29))],
    ]
    landed = tmp_path / "in"
    landed.mkdir()
    stream = spark.readStream.schema(schema).parquet(str(landed))
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(landed))
        out = live.stream_ledger(stream, delay="1 day", keep=pd.Timedelta(days=7))
        live.run_to_end(out, str(tmp_path), settings=(live.ROCKSDB,))
    found = [(r["delivery_id"], r["event"], r["event_seq"], r["state"], r["accepted"]) for r in live.read_back(spark, out, str(tmp_path)).collect()]
    assert sorted(found, key=str) == sorted([
        ("a", "claimed", 1, "claimed", True), ("a", "sent", 2, "sent", True), ("a", "claimed", 8, "sent", False), ("a", "expired", None, "", True),
        ("b", "claimed", 3, "claimed", True), ("b", "released", 4, "released", True), ("b", "sent", 5, "", False),
        ("x", "claimed", 6, "claimed", True), ("x", "sent", 9, "sent", True), ("x", "expired", None, "", True),
        ("a", "claimed", 11, "claimed", True), ("x", "claimed", 10, "claimed", True),
    ], key=str)


def test_a_delivery_has_one_timer_and_one_call_judges_all_its_events():
    class State:
        value, calls = None, 0

        def exists(self):
            return self.value is not None

        def get(self):
            self.calls += 1
            return self.value if isinstance(self.value, tuple) else iter(self.value)

        def update(self, value):
            self.value = value

        def clear(self):
            self.value = None

        def appendList(self, rows):  # noqa: N802 - Spark's name
            self.value = (self.value or []) + rows

        put = update

    class Handle:
        timers, current, waiting = [], State(), State()

        def getValueState(self, *_):  # noqa: N802
            return self.current

        def getListState(self, *_):  # noqa: N802
            return self.waiting

        def registerTimer(self, at):  # noqa: N802
            self.timers.append(at)

    class Now:
        getCurrentWatermarkInMs = getExpiryTimeInMs = lambda self: 1500

    machine, handle = live.DeliveryMachine(10**9), Handle()
    machine.init(handle)
    rows = [{"at": i, "event_seq": i, "kind": 1 + 2 * (i % 2), "run_id": "r", "event": ("claimed", "released")[i % 2]} for i in range(2000)]
    assert list(machine.handleInputRows(("d",), iter(rows[::-1]), Now())) == [] and handle.timers == [0]
    out = list(machine.handleExpiredTimer(("d",), Now(), Now()))
    assert [r["event_seq"] for r in out] == list(range(1501)) and all(r["accepted"] for r in out)
    assert handle.timers == [0, 1501] and handle.waiting.calls == 1 and len(handle.waiting.value) == 499 and handle.current.value[0] == "claimed"
