"""Expected-result SQL for keyword matching, generated from a profile.

Greedy overlap suppression is spelled out phrase by phrase, longest first: a phrase is kept if it
is found and no kept longer phrase contains it.
"""

from __future__ import annotations

import re

from pubwatch import fixed_values as V
from pubwatch.operators.relevance import Profile
from pubwatch.workload.tables import fold, squeeze


def ordered_phrases(profile: Profile) -> list[tuple[str, str, str]]:
    rows = [(p, t, s) for t, words in profile.topics for p, s in words]
    return sorted(rows, key=lambda r: (-len(r[0]), r[0].casefold()))


def found_sql(phrase: str, text: str) -> str:
    p = phrase.lower().replace("'", "''")
    if len(phrase) <= 3 and phrase.isascii():
        return f"regexp_matches({text}, '(^|[^a-z0-9]){re.escape(p)}($|[^a-z0-9])')"
    return f"contains({text}, '{p}')"


def _covers(longer: str, shorter: str) -> bool:
    if len(shorter) <= 3 and shorter.isascii():
        return re.search(rf"(?<![a-z0-9]){re.escape(shorter)}(?![a-z0-9])", longer) is not None
    return shorter in longer


def matching_ctes(profile: Profile, table: str, key: str, extra: str = "") -> str:
    """CTEs up to ``assessed``: key, kept flags t1.. and s1.., score; plus the ``extra`` columns of the table."""
    words = ordered_phrases(profile)
    numbers = range(1, len(words) + 1)
    norm = f"normed AS (SELECT *, ' ' || {fold(squeeze('title'))} || ' ' AS nt, ' ' || {fold(squeeze('summary'))} || ' ' AS ns FROM {table})"
    flags = ", ".join(f"{found_sql(words[i - 1][0], 'n' + side)} AS f{side}{i}" for side in "ts" for i in numbers)
    out = [norm, f"found AS (SELECT *, {flags} FROM normed)"]
    previous = "found"
    for i in numbers:
        parts = []
        for side in "ts":
            above = [f"k{side}{j}" for j in range(1, i) if _covers(words[j - 1][0].lower(), words[i - 1][0].lower())]
            parts.append(f"f{side}{i}" + "".join(f" AND NOT {a}" for a in above) + f" AS k{side}{i}")
        out.append(f"kept{i} AS (SELECT *, {', '.join(parts)} FROM {previous})")
        previous = f"kept{i}"
    terms = []
    for i in numbers:
        strength = words[i - 1][2]
        terms.append(f"CASE WHEN kt{i} THEN {V.TITLE_WEIGHTS[strength]} ELSE 0 END")
        skip = f" AND NOT kt{i}" if strength == "supporting" else ""
        terms.append(f"CASE WHEN ks{i}{skip} THEN {V.SUMMARY_WEIGHTS[strength]} ELSE 0 END")
    distinct = " + ".join(f"CAST(kt{i} OR ks{i} AS INTEGER)" for i in numbers)
    topics = {t: [i for i in numbers if words[i - 1][1] == t] for t, _ in profile.topics}
    topic_count = " + ".join("CAST(" + " OR ".join(f"kt{i} OR ks{i}" for i in ids) + " AS INTEGER)" for ids in topics.values())
    score = f"{' + '.join(terms)} + CASE WHEN {distinct} >= 2 THEN 1 ELSE 0 END + CASE WHEN {topic_count} >= 2 THEN 1 ELSE 0 END"
    out.append(f"assessed AS (SELECT *, CAST({score} AS INTEGER) AS score{extra} FROM {previous})")
    return ", ".join(out)


def joined_phrases(profile: Profile, condition: str, order=None, strength: str | None = None, sep: str = "、") -> str:
    """SQL: the kept phrases joined in fold order; ``condition`` uses {i} for the phrase number."""
    words = ordered_phrases(profile)
    chosen = [i for i in range(1, len(words) + 1) if strength is None or words[i - 1][2] == strength]
    chosen.sort(key=order or (lambda i: words[i - 1][0].casefold()))
    cases = ", ".join(f"CASE WHEN {condition.format(i=i)} THEN '{words[i - 1][0]}' END" for i in chosen)
    return f"concat_ws('{sep}', {cases})"


def joined_topics(profile: Profile, sep: str = "、") -> str:
    words = ordered_phrases(profile)
    cases = []
    for topic in sorted(t for t, _ in profile.topics):
        ids = [i for i in range(1, len(words) + 1) if words[i - 1][1] == topic]
        cases.append("CASE WHEN " + " OR ".join(f"kt{i} OR ks{i}" for i in ids) + f" THEN '{topic}' END")
    return f"concat_ws('{sep}', {', '.join(cases)})"
