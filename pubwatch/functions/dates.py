"""Date functions: lenient parsing to UTC, local-day periods, calendar texts."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from pubwatch import fixed_values as V
from pubwatch.functions.base import ALL_SPACE, SPACE, bind, let, q, sql_array, sql_let

_SHORT_MONTHS = tuple(name[:3] for name in V.MONTH_NAMES)
# RFC 2822 zone names and their offsets in minutes
_ZONES = {"ut": 0, "utc": 0, "gmt": 0, "z": 0, "est": -300, "edt": -240, "cst": -360, "cdt": -300,
          "mst": -420, "mdt": -360, "pst": -480, "pdt": -420, "ast": -240, "adt": -180}
_MAIL = (r"^(?:[A-Za-z]{3,9},?\s+)?(\d{1,2})[\s-]+([A-Za-z]{3,9})[\s-]+(\d{4}|\d{2})\s+"
         r"(\d{1,2}):(\d{2})(?::(\d{2}))?(?:\s+([A-Za-z]+|[+-]\d{4}).*)?$")
_ISO = (r"^(\d{4})-(\d{2})-(\d{2})(?:[T ](\d{2})(?::?(\d{2})(?::?(\d{2}(?:[.,]\d+)?))?)?"
        r"(Z|[+-]\d{2}(?::?\d{2})?)?)?$")


def _month(name: str, short: bool = True, long: bool = True) -> str:
    """SQL: month number of a name, or null."""
    found = []
    if long:
        found.append(f"array_position({sql_array(V.MONTH_NAMES)}, lower({name}))")
    if short:
        found.append(f"array_position({sql_array(_SHORT_MONTHS)}, lower({name}))")
    return f"nullif(greatest(0L, {', '.join(found)}), 0)"


def _offset_minutes(zone: str) -> str:
    named = "case lower(z) " + " ".join(f"when '{k}' then {v}" for k, v in _ZONES.items()) + " else 0 end"
    numeric = ("if(z like '-%', -1, 1) * (try_cast(substr(replace(z, ':', ''), 2, 2) as int) * 60"
               " + coalesce(try_cast(substr(replace(z, ':', ''), 4, 2) as int), 0))")
    return sql_let(zone, "z", f"if(z rlike '^[+-][0-9]', {numeric}, {named})")


def _stamp(year: str, month: str, day: str, hour: str = "", minute: str = "", second: str = "", zone: str = "") -> str:
    def number(x: str) -> str:
        return f"try_cast(coalesce(nullif({x}, ''), '0') as int)" if x else "0"

    seconds = f"try_cast(replace(coalesce(nullif({second}, ''), '0'), ',', '.') as decimal(16,6))" if second else "0"
    local = (f"try_make_timestamp(try_cast({year} as int), try_cast({month} as int), try_cast({day} as int), "
             f"{number(hour)}, {number(minute)}, {seconds}, 'UTC')")
    return f"timestamp_micros(unix_micros({local}) - {_offset_minutes(zone)} * 60000000L)" if zone else local


def _matched(text: str, pattern: str, build) -> str:
    """SQL: run the pattern once; when it fits, build a timestamp from its groups g[0], g[1], ..."""
    groups = re.compile(pattern).groups
    parts = ", ".join(f"regexp_extract({text}, {q(pattern)}, {i})" for i in range(1, groups + 1))
    made = build(*[f"g[{i}]" for i in range(groups)])
    return f"if({text} rlike {q(pattern)}, {sql_let(f'array({parts})', 'g', made)}, null)"


def _mail_date(t: str) -> str:
    def build(d, m, y, hh, mm, ss, zone):
        year = f"if(length({y}) = 2, concat(if(try_cast({y} as int) > 68, '19', '20'), {y}), {y})"
        return _stamp(year, _month(m), d, hh, mm, ss, zone)

    return _matched(t, _MAIL, build)


def _iso_date(t: str) -> str:
    return _matched(t, _ISO, _stamp)


def _written(t: str, *forms: str) -> list[str]:
    shapes = {
        "Ymd": (r"^(\d{4})(\d{2})(\d{2})$", lambda y, m, d: _stamp(y, m, d)),
        "d B Y": (r"^(\d{1,2})\s+([A-Za-z]+)\s+(\d{4})$", lambda d, m, y: _stamp(y, _month(m), d)),
        "B d, Y": (r"^([A-Za-z]+)\s+(\d{1,2}),\s+(\d{4})$", lambda m, d, y: _stamp(y, _month(m, short=False), d)),
        "b d, Y": (r"^([A-Za-z]+)\s+(\d{1,2}),\s+(\d{4})$", lambda m, d, y: _stamp(y, _month(m), d)),
        "d b, Y": (r"^(\d{1,2})\s+([A-Za-z]{3}),\s+(\d{4})$", lambda d, m, y: _stamp(y, _month(m), d)),
        "d/m/Y": (r"^(\d{1,2})/(\d{1,2})/(\d{4})$", lambda d, m, y: _stamp(y, m, d)),
        "Y-m-d": (r"^(\d{4})-(\d{1,2})-(\d{1,2})$", lambda y, m, d: _stamp(y, m, d)),
        "Y-m-d H:M": (r"^(\d{4})-(\d{1,2})-(\d{1,2})\s+(\d{1,2}):(\d{1,2})$", _stamp),
    }
    return [_matched(t, *shapes[form]) for form in forms]


def sql_strip(x: str) -> str:
    return f"btrim({x}, {q(ALL_SPACE)})"


def sql_parse_datetime(x: str) -> str:
    forms = ", ".join([_mail_date("d"), _iso_date("d"), *_written("d", "Ymd", "Y-m-d", "d B Y", "d/m/Y", "b d, Y")])
    return sql_let(sql_strip(x), "d", f"coalesce({forms})")


def sql_parse_index_date(x: str) -> str:
    text = sql_strip(x)
    for pattern, new in (
        (rf"[{SPACE}]*/[{SPACE}]*", "/"), (r"\bSept\b", "Sep"), (r"^(\d{1,2})(?:st|nd|rd|th)(?=\s)", "$1"),
        (r"^(\d{4})-(\d)-(\d{1,2})(T.*)$", "$1-0$2-$3$4"), (r"^(\d{4}-\d{2})-(\d)(T.*)$", "$1-0$2$3"),
    ):
        text = f"regexp_replace({text}, {q(pattern)}, {q(new)})"
    forms = [_iso_date("d"), *_written("d", "Ymd", "d B Y", "B d, Y", "d b, Y", "d/m/Y", "Y-m-d", "Y-m-d H:M"), _mail_date("d")]
    return sql_let(text, "d", f"coalesce({', '.join(forms)})")


def parse_datetime(value: Column) -> Column:
    """Mail date, ISO 8601 or one of the written forms, as UTC; anything else is null, never an error."""
    return bind(value, sql_parse_datetime("x"))


def parse_index_date(value: Column) -> Column:
    """Date text of an index card; it must carry an explicit year."""
    return bind(value, sql_parse_index_date("x"))


def parse_feed_date(*candidates: Column) -> Column:
    """First candidate field that parses: published, updated, created and so on."""
    return F.coalesce(*[parse_datetime(c) for c in candidates])


def utc_midnight_of_local_day(day: Column) -> Column:
    """Start of a local calendar day as a UTC instant."""
    return F.to_utc_timestamp(day.cast("timestamp"), V.LOCAL_ZONE)


def _day(text: Column) -> Column:
    compact = F.regexp_extract(text, r"^(\d{4})(\d{2})(\d{2})$", 0)
    dashed = F.regexp_extract(text, r"^\d{4}-\d{2}-\d{2}$", 0)
    as_dashed = F.concat_ws("-", F.substring(compact, 1, 4), F.substring(compact, 5, 2), F.substring(compact, 7, 2))
    return F.when(compact != "", as_dashed.try_cast("date")).when(dashed != "", dashed.try_cast("date"))


def period_bounds(period: Column, now: Column) -> Column:
    """struct<since, until> of a period text: days back, one start day, or ``a~b``; null fields if unreadable.

    ``since`` is the local midnight of the first day, ``until`` that after the last, both as UTC instants.
    """
    def build(text: Column) -> Column:
        today = F.from_utc_timestamp(now, V.LOCAL_ZONE).cast("date")
        days = F.when(text == "", F.lit(V.DEFAULT_PERIOD_DAYS)).when(text.rlike(r"^\d{1,4}$"), text.try_cast("int"))
        spread = r"^(.+?)[~～〜](.+)$"
        ranged = text.rlike(spread)
        first = F.when(days.isNotNull(), F.date_sub(today, days)).when(ranged, _day(F.regexp_extract(text, spread, 1))).otherwise(_day(text))
        last = F.when(ranged, _day(F.regexp_extract(text, spread, 2))).otherwise(today)
        good = first.isNotNull() & last.isNotNull() & (first <= last)
        return F.struct(
            F.when(good, utc_midnight_of_local_day(first)).alias("since"),
            F.when(good, utc_midnight_of_local_day(F.date_add(last, 1))).alias("until"),
        )

    return let(F.regexp_replace(F.coalesce(period, F.lit("")), f"[{SPACE}]+", ""), build)


def roc_date(day: Column, strict: bool = False) -> Column:
    """Minguo calendar text of a date; days before the calendar's first are null, or an error if strict."""
    text = F.format_string("民國%03d年%02d月%02d日", F.year(day) - V.ROC_YEAR_OFFSET, F.month(day), F.dayofmonth(day))
    early = F.raise_error(F.lit("no Minguo year before 1912-01-01")).cast("string") if strict else F.lit(None).cast("string")
    return F.when(day >= F.lit(V.ROC_FIRST_DAY).cast("date"), text).when(day.isNull(), F.lit(None)).otherwise(early)


def roc_to_gregorian(year: Column, month: Column, day: Column) -> Column:
    text = F.format_string("%04d-%02d-%02d", year + V.ROC_YEAR_OFFSET, month, day)
    return F.when(year >= 1, text.try_cast("date"))


def taipei_timestamp(value: Column) -> Column:
    """UTC text as local ``yyyy/MM/dd HH:mm``; unreadable or missing text says so."""
    stamp = parse_datetime(value)
    return F.coalesce(F.date_format(F.from_utc_timestamp(stamp, V.LOCAL_ZONE), "yyyy/MM/dd HH:mm"), F.lit("未記錄"))


def utc_text(stamp: Column) -> Column:
    return F.date_format(stamp, "yyyy-MM-dd HH:mm:ss")
