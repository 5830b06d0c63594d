"""Text functions: cleaning, matching forms, identity keys and small text rules."""

from __future__ import annotations

import html.entities

from pyspark.sql import Column
from pyspark.sql import functions as F

from pubwatch import fixed_values as V
from pubwatch.functions.base import (
    bind, fold, literal_array, literal_map, ordered_distinct, q, sql_any, sql_let, sql_squeeze, squeeze, strip, text_or,
)

HIDDEN_ELEMENTS = r"(?is)<(script|style|template)\b[^>]*>.*?(?:</\1\s*>|\z)"
COMMENTS = r"(?s)<!--.*?(?:-->|\z)"
DECLARATIONS = r"(?s)<[!?][^>]*>"
TAGS = r"""(?s)</?[A-Za-z](?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+'|[^>\s]*+))*+>"""


def _entity_tables() -> tuple[str, str, str]:
    legacy = {k: v for k, v in html.entities.html5.items() if not k.endswith(";")}
    # The old names come first: they are the common ones and a map lookup scans in order.
    names = sorted((k[:-1] for k in html.entities.html5 if k.endswith(";")), key=lambda k: (k not in legacy, k))
    closed = "\x01".join(f"{k}\x02{html.entities.html5[k + ';']}" for k in names)
    opened = "\x01".join(f"{k}\x02{v}" for k, v in legacy.items())
    pattern = "|".join(sorted(legacy, key=lambda k: (-len(k), k)))
    return closed, opened, pattern


_CLOSED, _LEGACY, _LEGACY_NAMES = _entity_tables()
_TOKEN = rf"&#[xX][0-9a-fA-F]+;?|&#[0-9]+;?|&[A-Za-z][A-Za-z0-9]*;|&(?:{_LEGACY_NAMES})|[^&]+|&"
_CP1252 = "\x01".join(f"{i}\x02{bytes([i]).decode('cp1252', 'replace')}" for i in range(0x80, 0xA0))


def _sql_map(packed: str) -> str:
    return f"str_to_map({q(packed)}, '\x01', '\x02')"


def _sql_code_point(code: str) -> str:
    # UTF-32 covers every plane; the C1 range is read as Windows-1252 like a browser does.
    return sql_let(code, "c", f"""case
        when c = 0 or c > 1114111 or c between 55296 and 57343 then '\ufffd'
        when c between 128 and 159 then element_at({_sql_map(_CP1252)}, cast(c as string))
        else decode(unhex(lpad(hex(c), 8, '0')), 'UTF-32') end""")


def sql_unescape(x: str) -> str:
    name, prefix = "regexp_extract(t, '^&([A-Za-z0-9]+)', 1)", f"regexp_extract(t, '^&({_LEGACY_NAMES})', 1)"
    by_prefix = sql_let(prefix, "p", f"if(p <> '', concat(element_at({_sql_map(_LEGACY)}, p), substr(t, length(p) + 2)), null)")
    decode = f"""case
        when t not like '&%' or t = '&' then t
        when t rlike '^&#[xX]' then {_sql_code_point("cast(conv(right(regexp_extract(t, '^&#[xX]([0-9a-fA-F]+)', 1), 8), 16, 10) as bigint)")}
        when t rlike '^&#[0-9]' then {_sql_code_point("cast(right(regexp_extract(t, '^&#([0-9]+)', 1), 12) as bigint)")}
        else coalesce(if(t like '%;', element_at({_sql_map(_CLOSED)}, {name}), null), {by_prefix}, t) end"""
    return f"if(contains({x}, '&'), array_join(transform(regexp_extract_all({x}, {q(_TOKEN)}, 0), t -> {decode}), ''), {x})"


def sql_fold(x: str) -> str:
    return f"replace(lower({x}), 'ß', 'ss')"


def sql_strip_tags(x: str) -> str:
    for pattern in (HIDDEN_ELEMENTS, COMMENTS, DECLARATIONS, TAGS):
        x = f"regexp_replace({x}, {q(pattern)}, ' ')"
    return x


_APOSTROPHES = "[’‘']"


def _sql_mend(x: str) -> str:
    short = r"(?i)([A-Za-z]) ?[’‘'] ?(s|t|re|ve|ll|d|m)(?![\p{L}\p{N}_])"
    return f"""regexp_replace(regexp_replace({x}, {q(short)}, {q("$1'$2")}), '([A-Za-z])[’‘](?=[A-Za-z])', {q("$1'")})"""


def sql_clean_text(x: str) -> str:
    """SQL text of :func:`clean_text`; ``x`` is a name or another cheap expression."""
    # References are decoded twice, because feeds escape their HTML once more.
    decoded = f"aggregate(sequence(1, 2), {sql_strip_tags('h')}, (u, i) -> {sql_unescape('u')})"
    plain = sql_let(f"coalesce({x}, '')", "h", f"if(h rlike '[<&]', {decoded}, h)")
    return sql_let(sql_squeeze(plain), "s", f"if(s rlike {q(_APOSTROPHES)}, {_sql_mend('s')}, s)")


def unescape(value: Column) -> Column:
    """Decode HTML character references in one pass, without a Python worker."""
    return bind(value, sql_unescape("x"))


def clean_text(value: Column) -> Column:
    """Visible text of an HTML fragment: tags out, references decoded, blanks collapsed, apostrophes mended.

    Script, style and template contents are not text.  Text without ``<``, ``&`` or an
    apostrophe takes the short way.
    """
    return bind(value, sql_clean_text("x"))


def normalize_for_match(value: Column) -> Column:
    return bind(value, f"concat(' ', {sql_fold(sql_clean_text('x'))}, ' ')")


def is_short(phrase: str) -> bool:
    return len(phrase) <= V.SHORT_PHRASE_CHARS and phrase.isascii()


def sql_keyword_in_text(phrase: str, text: str) -> str:
    wanted = phrase.lower().replace("ß", "ss").strip()
    if not wanted:
        return "false"
    found = f"contains({text}, {q(wanted)})"
    if is_short(wanted):
        pattern = rf"(?<![a-z0-9])\Q{wanted}\E(?![a-z0-9])"
        return f"({found} and {text} rlike {q(pattern)})"
    return found


def keyword_in_text(phrase: str, text: Column) -> Column:
    """Does ``text`` (already in matching form) contain ``phrase``?

    ASCII phrases of up to three characters need a boundary on both sides.
    """
    return bind(text, sql_keyword_in_text(phrase, "x"))


def sql_strip_boilerplate(x: str) -> str:
    cleaned = sql_clean_text(x)
    without = "n"
    for phrase in V.BOILERPLATE_PHRASES:
        without = f"regexp_replace({without}, {q(rf'(?iu)' + chr(92) + 'Q' + phrase + chr(92) + 'E')}, ' ')"
    mentioned = sql_let("lower(n)", "l", sql_any(f"contains(l, {q(p.lower())})" for p in V.BOILERPLATE_PHRASES))
    named = sql_let(cleaned, "n", f"if({mentioned}, {sql_squeeze(without)}, n)")
    tests = sql_any(f"contains(f, {q(p)})" for p in V.BOILERPLATE_SENTENCES)
    kept = f"filter(split(b, {q(r'(?<=[.!?]) +')}), o -> not {sql_let(sql_fold('o'), 'f', tests)})"
    return sql_let(named, "b", f"if({sql_let(sql_fold('b'), 'f', tests)}, trim(array_join({kept}, ' ')), b)")


def strip_boilerplate(value: Column) -> Column:
    """Remove organisation names, then whole sentences that carry a boilerplate phrase."""
    return bind(value, sql_strip_boilerplate("x"))


def sql_matching_text(x: str) -> str:
    again = f"concat(' ', {sql_fold(sql_clean_text('m'))}, ' ')"
    plain = f"concat(' ', {sql_fold('m')}, ' ')"
    return sql_let(sql_strip_boilerplate(x), "m", f"if(m rlike {q('[<&’‘' + chr(39) + ']')}, {again}, {plain})")


def matching_text(value: Column) -> Column:
    """The form keywords are looked up in: boilerplate out, cleaned again, folded, padded."""
    return bind(value, sql_matching_text("x"))


def normalize_title(value: Column) -> Column:
    return squeeze(F.regexp_replace(fold(value), "[–—]", "-"))


def normalize_words(value: Column) -> Column:
    words = F.regexp_extract_all(fold(F.coalesce(value, F.lit(""))), F.lit(r"[\p{L}\p{N}\p{M}_]+"), F.lit(0))
    return F.array_join(words, " ")


def identity_key(value: Column) -> Column:
    """Name key: acronym and "(Northern Ireland)" brackets out, hsc spelled out, & read as and."""
    no_region = F.regexp_replace(value, r"(?i)\(northern ireland\)", " ")
    no_acronym = F.regexp_replace(no_region, r"\((?=[^)a-z]*[A-Z])[^)\p{Ll}]*\)", " ")
    spelled = F.regexp_replace(fold(no_acronym), r"(?<![\p{L}\p{N}_])hsc(?![\p{L}\p{N}_])", "health and social care")
    return normalize_words(F.replace(spelled, F.lit("&"), F.lit(" and ")))


def slugify(value: Column) -> Column:
    return F.array_join(F.regexp_extract_all(F.lower(value), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), "-")


def safe_profile_id(value: Column) -> Column:
    dashed = F.regexp_replace(fold(value), "[^a-z0-9-]+", "-")
    return text_or(F.regexp_replace(dashed, "^-+|-+$", ""), "custom")


def is_challenge_page(body: Column) -> Column:
    """Interstitial page check on the opening characters only, as the rule itself says."""
    opening = F.lower(F.left(body, F.lit(V.CHALLENGE_WINDOW_CHARS)))
    return F.contains(opening, F.lit("just a moment")) & F.contains(opening, F.lit("cloudflare"))


def script_runs(value: Column) -> Column:
    """Split mixed text into runs of CJK and other characters: array<struct<script, text>>.

    Characters that are neither alphanumeric nor CJK stay with the run before them.
    """
    cjk = r"\x{2e80}-\x{9fff}\x{f900}-\x{faff}\x{20000}-\x{2fa1f}\x{ff00}-\x{ffef}"
    other_word = rf"[[\p{{L}}\p{{N}}]&&[^{cjk}]]"
    joiner = rf"[^\p{{L}}\p{{N}}{cjk}]"
    pattern = rf"[{cjk}](?:[{cjk}]|{joiner})*|^{joiner}+(?:{other_word}|{joiner})*|{other_word}(?:{other_word}|{joiner})*"
    return F.transform(
        F.regexp_extract_all(value, F.lit(pattern), F.lit(0)),
        lambda run: F.struct(
            F.when(run.rlike(rf"^[{cjk}]"), F.lit("cjk")).otherwise(F.lit("other")).alias("script"),
            run.alias("text"),
        ),
    )


def default_strength(phrase: Column) -> Column:
    trimmed = strip(phrase)
    return (
        F.when(fold(phrase).isin(*V.SUPPORTING_PHRASES), F.lit("supporting"))
        .when(F.contains(trimmed, F.lit(" ")) | (F.length(trimmed) >= V.CORE_PHRASE_CHARS), F.lit("core"))
        .otherwise(F.lit("general"))
    )


def strip_title_suffix(source: Column, title: Column) -> Column:
    """Remove the publisher suffix that the aggregator appends, by source."""
    out = title
    for name, _host, _needed, pattern in V.FALLBACK_RULES:
        out = F.when(source == name, strip(F.regexp_replace(title, pattern, ""))).otherwise(out)
    return out


def _month_year(value: Column) -> Column:
    trimmed = strip(value)
    month = F.regexp_extract(trimmed, r"^([A-Za-z]+)\s+\d{4}$", 1)
    year = F.regexp_extract(trimmed, r"^[A-Za-z]+\s+(\d{4})$", 1)
    names = literal_map({name: f"{i} 月" for i, name in enumerate(V.MONTH_NAMES, 1)})
    return F.when(month != "", F.concat(year, F.lit(" 年 "), F.coalesce(F.element_at(names, F.lower(month)), month))).otherwise(value)


def _election_title(title: Column) -> Column:
    count = r"(?i)^Post count statement\s*[-–]\s*(\d{4})\s+(.+?)\s+election$"
    poll = r"(?i)^Post poll statement\s*[-–]\s*(.+)$"
    name = F.regexp_extract(title, count, 2)
    known = F.coalesce(F.element_at(literal_map(V.ELECTION_NAMES), F.lower(name)), name)
    return (
        F.when(name != "", F.concat(F.lit("計票後聲明 - "), F.regexp_extract(title, count, 1), F.lit(" 年"), known, F.lit("選舉")))
        .when(title.rlike(poll), F.concat(F.lit("投票後聲明 - "), _month_year(F.regexp_extract(title, poll, 1))))
        .otherwise(F.lit(""))
    )


def translate_by_rule(title: Column, translated: Column) -> Column:
    """A given translation if it differs from the title, else a fixed or rule-made one."""
    given = F.coalesce(translated, F.lit(""))
    manual = F.element_at(literal_map(V.TITLE_TRANSLATIONS), strip(title))
    return F.when((given != "") & (normalize_title(given) != normalize_title(title)), given).otherwise(
        F.coalesce(manual, F.nullif(_election_title(title), F.lit("")), given)
    )


def expand_source_ids(ids: Column) -> Column:
    """Replace retired source ids by their successors, first-seen order, no repeats."""
    def successors(x: Column) -> Column:
        out = F.array(x)
        for old, new in V.RETIRED_SOURCE_IDS.items():
            out = F.when(x == old, literal_array(new)).otherwise(out)
        return out

    return F.array_distinct(F.flatten(F.transform(ids, successors)))


def briefing_identifier(*values: Column) -> Column:
    combined = F.concat_ws(" ", *values)
    direct = F.upper(F.regexp_extract(combined, f"(?i){V.BRIEFING_ID_PATTERN}", 0))
    slug = F.upper(F.regexp_extract(combined, f"(?i){V.BRIEFING_SLUG_PATTERN}", 1))
    return text_or(direct, slug)


def briefing_pdf_url(content: Column, identifier: Column) -> Column:
    """First PDF link that carries the identifier; two id families have a constructed link."""
    links = F.regexp_extract_all(unescape(F.coalesce(content, F.lit(""))), F.lit(f"(?i){V.BRIEFING_PDF_PATTERN}"), F.lit(0))
    found = F.get(F.filter(links, lambda u: F.contains(F.lower(u), F.lower(identifier))), 0)
    built = F.concat(F.lit(V.BRIEFING_PDF_ROOT), identifier, F.lit("/"), identifier, F.lit(".pdf"))
    return (
        F.when(identifier == "", F.lit(""))
        .when(found.isNotNull(), found)
        .when(F.startswith(identifier, F.lit("CBP-")) | F.startswith(identifier, F.lit("SN-")), built)
        .otherwise(F.lit(""))
    )


def feed_topics(terms: Column) -> Column:
    return ordered_distinct(F.transform(F.coalesce(terms, F.array().cast("array<string>")), clean_text))


def entry_summary(summary: Column, description: Column, content: Column) -> Column:
    """Summary, else description, else the joined content parts."""
    return clean_text(F.coalesce(F.nullif(summary, F.lit("")), F.nullif(description, F.lit("")), F.array_join(content, " ")))
