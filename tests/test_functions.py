import html
import random

from pyspark.sql import functions as F

from pubwatch.functions import dates, text, urls
from pubwatch.functions.base import squeeze, strip


def values(spark, function, inputs):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], "i int, x string")
    return [r["y"] for r in df.select("i", function(F.col("x")).alias("y")).orderBy("i").collect()]


def stamps(spark, function, inputs):
    return values(spark, lambda c: dates.utc_text(function(c)), inputs)


def test_clean_text(spark):
    cases = {
        "<p>The Board&#8217;s <b>up</b>date &amp;amp; &copy 2024 &nbsp;x</p>": "The Board's up date & © 2024 x",
        "a<script>var t='</p>'</script>b<!-- c -->d": "a b d",
        "it ’ s fine; don‘t": "it's fine; don't",
        "R&D rules AT&T &#x1F600; &#150;": "R&D rules AT&T 😀 –",
        "Plain\xa0 text　here\n": "Plain text here",
        "<a title='x>y'>q</a>": "q",
        "": "",
        None: "",
    }
    assert values(spark, text.clean_text, list(cases)) == list(cases.values())


def test_unescape_agrees_with_the_standard_library(spark):
    samples = ["&lt;b&gt; &eacute;&Eacute; &notin; &notit; &copy2 &#65;&#x41; &#0; &bogus; & && &amp;lt;", "none", "&hellip;&ndash;&rsquo;s"]
    assert values(spark, text.unescape, samples) == [html.unescape(s) for s in samples]


def test_white_space(spark):
    rng = random.Random(1)
    samples = ["".join(rng.choice("ab \t\n\x1c\x85\xa0 　é") for _ in range(40)) for _ in range(50)]
    assert values(spark, squeeze, samples) == [" ".join(s.split()) for s in samples]
    assert values(spark, strip, samples) == [s.strip() for s in samples]


def test_short_phrases_need_boundaries(spark):
    texts = [" said ", " an ai plan ", " r&d ", " our&d ", " ai"]
    assert values(spark, lambda c: text.keyword_in_text("AI", c), texts) == [False, True, False, False, True]
    assert values(spark, lambda c: text.keyword_in_text("R&D", c), texts) == [False, False, True, False, False]


def test_boilerplate(spark):
    sentence = "The Department for Business and Trade is responsible for technology policy. Kept one! Find out more about us."
    assert values(spark, text.strip_boilerplate, [sentence, "Government Digital Service launches app"]) == ["Kept one!", "launches app"]


def test_normalize_title_is_idempotent(spark):
    rng = random.Random(7)
    samples = ["".join(rng.choice("aB –—-ß　\tÉ") for _ in range(20)) for _ in range(60)]
    once = values(spark, text.normalize_title, samples)
    assert values(spark, text.normalize_title, once) == once


def test_dates(spark):
    cases = {
        "Mon, 08 Jun 2026 09:00:00 GMT": "2026-06-08 09:00:00", "2026-09-25T08:00:00Z": "2026-09-25 08:00:00", "2026-09-29T12:00:00+01:00": "2026-09-29 11:00:00",
        "25 September 2026": "2026-09-25 00:00:00", "8 June 2026": "2026-06-08 00:00:00", "Sep 25, 2026": "2026-09-25 00:00:00", "28/09/2026": "2026-09-28 00:00:00",
        "Tue, 1 Jul 2003 10:52:37 +0200": "2003-07-01 08:52:37", "nonsense": None, "2024-13-45": None, "18 September": None, "": None,
    }
    assert stamps(spark, dates.parse_datetime, list(cases)) == list(cases.values())


def test_index_dates(spark):
    cases = {
        "26th September 2026": "2026-09-26 00:00:00", "29 Sept 2026": "2026-09-29 00:00:00", "28 / 09 / 2026": "2026-09-28 00:00:00", "16 Sep, 2026": "2026-09-16 00:00:00",
        "2024-5-3T00:00:00": "2024-05-03 00:00:00", "2024-05-03 10:11": "2024-05-03 10:11:00", "September 25, 2026": "2026-09-25 00:00:00", "18 September": None,
    }
    assert stamps(spark, dates.parse_index_date, list(cases)) == list(cases.values())


def test_date_parsers_never_fail(spark):
    rng = random.Random(3)
    samples = ["".join(rng.choice("0123456789 :/-,TZ+JanSeptMay") for _ in range(rng.randrange(24))) for _ in range(300)]
    assert len(stamps(spark, dates.parse_datetime, samples)) == len(stamps(spark, dates.parse_index_date, samples)) == 300


def test_period_bounds(spark):
    now = F.lit("2026-06-01 20:00:00").cast("timestamp")
    cases = {
        "": ("2026-05-18 16:00:00", "2026-06-02 16:00:00"), "30": ("2026-05-02 16:00:00", "2026-06-02 16:00:00"), "20260501 ～ 20260515": ("2026-04-30 16:00:00", "2026-05-15 16:00:00"),
        "2026-05-01~20260515": ("2026-04-30 16:00:00", "2026-05-15 16:00:00"), "20260516~20260515": (None, None), "abc": (None, None),
    }
    for field, place in (("since", 0), ("until", 1)):
        assert stamps(spark, lambda c, f=field: dates.period_bounds(c, now)[f], list(cases)) == [v[place] for v in cases.values()]


def test_urls(spark):
    canonical = {
        "HTTPS://Example.COM/path/?utm_source=mail#section": "https://example.com/path", "https://example.com/": "https://example.com/",
        "https://u:p@www.Gov.uk:8080/x/": "https://www.gov.uk:8080/x", "not a url ": "not a url", "https://a b.com/x y/": "https://a b.com/x y",
    }
    assert values(spark, urls.canonical_url, list(canonical)) == list(canonical.values())
    base = F.lit("https://h.org/a/b/c.html?q=1")
    joined = {"/x": "https://h.org/x", "d": "https://h.org/a/b/d", "../d?z": "https://h.org/a/d?z", "//o.org/y": "https://o.org/y", "?k=2": "https://h.org/a/b/c.html?k=2", "/p/../q": "https://h.org/q"}
    assert values(spark, lambda c: urls.url_join(base, c), list(joined)) == list(joined.values())
    homepages = {"https://www.gov.uk/government/organisations/x/?y=1": True, "https://www.gov.uk/government/organisations/x/about": False, "https://own.example/": True, "https://own.example/a": False, "": False}
    assert values(spark, lambda c: urls.is_agency_homepage(c, F.lit("https://www.own.example")), list(homepages)) == list(homepages.values())


def test_calendar(spark):
    row = spark.range(1).select(
        dates.roc_date(F.lit("2026-05-01").cast("date")).alias("a"), dates.roc_date(F.lit("1911-12-31").cast("date")).alias("b"),
        dates.taipei_timestamp(F.lit("2026-05-01T20:00:00Z")).alias("c"), dates.taipei_timestamp(F.lit("x")).alias("d"),
    ).first()
    assert tuple(row) == ("民國115年05月01日", None, "2026/05/02 04:00", "未記錄")


def test_script_runs(spark):
    runs = values(spark, lambda c: F.transform(text.script_runs(c), lambda r: F.concat_ws(":", r["script"], r["text"])), ["AI 新聞, 2026年", "…abc"])
    assert runs == [["other:AI ", "cjk:新聞, ", "other:2026", "cjk:年"], ["other:…abc"]]
