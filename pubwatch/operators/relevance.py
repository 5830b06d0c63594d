"""Topic relevance: keyword matching, overlap suppression, scoring and explanation.

A profile is configuration of bounded size.  It is compiled once on the driver into a few
array literals, ordered the way overlaps are resolved, so that scoring a record is array
arithmetic on keyword numbers inside the scan stage: no join, no shuffle, no Python.
"""

from __future__ import annotations

import hashlib
import html
import json
import re
from dataclasses import dataclass, field
from dataclasses import fields as fields_of

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pubwatch import fixed_values as V
from pubwatch.functions.base import bind, computed, literal_array, q, sql_let
from pubwatch.functions.text import is_short, sql_keyword_in_text, sql_matching_text
from pubwatch.functions.urls import is_agency_homepage

MATCH_FIELDS = {
    "matched_topics": "array<string>", "matched_keywords": "array<string>",
    "title_matched_keywords": "array<string>", "summary_matched_keywords": "array<string>",
    "core_matched_keywords": "array<string>", "general_matched_keywords": "array<string>",
    "supporting_matched_keywords": "array<string>",
    "title_keyword_strengths": "map<string,string>", "summary_keyword_strengths": "map<string,string>",
    "relevance_score": "int", "relevance_level": "string",
}


@dataclass(frozen=True)
class Profile:
    profile_id: str
    name: str
    topics: tuple[tuple[str, tuple[tuple[str, str], ...]], ...]
    selected_sources: tuple[str, ...] = V.DEFAULT_SOURCES
    description: str = ""
    version: int = V.PROFILE_VERSION
    minimum_score: int = V.DEFAULT_MINIMUM_SCORE

    def keyword_rows(self) -> list[tuple]:
        """(topic, topic_ord, phrase, kw_ord, strength) rows of the keyword dimension."""
        return [(topic, t, phrase, k, strength)
                for t, (topic, words) in enumerate(self.topics) for k, (phrase, strength) in enumerate(words)]

    @property
    def content_hash(self) -> str:
        """SHA-256 of the profile's canonical JSON, as the profile scan computes it."""
        topics = [{"name": t, "keywords": [{"phrase": p, "strength": s} for p, s in words]} for t, words in self.topics]
        fields = {f.name: getattr(self, f.name) for f in fields_of(self)} | {"topics": topics}
        return hashlib.sha256(json.dumps(fields, ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def strength_of(phrase: str) -> str:
    """Default strength of a phrase: listed as supporting, long or multi-word, else general."""
    if phrase.casefold() in V.SUPPORTING_PHRASES:
        return "supporting"
    bare = phrase.strip()
    return "core" if " " in bare or len(bare) >= V.CORE_PHRASE_CHARS else "general"


def default_profile() -> Profile:
    topics = tuple((t, tuple((p, strength_of(p)) for p in phrases)) for t, phrases in V.TOPIC_PHRASES.items())
    return Profile(V.DEFAULT_PROFILE_ID, V.DEFAULT_PROFILE_NAME, topics, description=V.DEFAULT_PROFILE_DESCRIPTION)


def _plain(phrase: str) -> str:
    text = html.unescape(re.sub(r"<[^>]*>", " ", phrase)).lower().replace("ß", "ss")
    return " ".join(text.split())


def _inside(shorter: str, longer: str) -> bool:
    if shorter == longer:
        return True
    if is_short(shorter):
        return re.search(rf"(?<![a-z0-9]){re.escape(shorter)}(?![a-z0-9])", longer) is not None
    return shorter in f" {longer} "


@dataclass(frozen=True)
class KeywordIndex:
    """A compiled profile; keyword numbers start at 1 and follow the overlap order."""

    minimum_score: int
    phrases: tuple[str, ...]
    forms: tuple[str, ...]
    topics: tuple[str, ...]
    strengths: tuple[str, ...]
    covered_by: tuple[tuple[int, ...], ...] = field(repr=False)

    @classmethod
    def of(cls, profile: Profile) -> KeywordIndex:
        rows = [(phrase, topic, strength) for topic, words in profile.topics for phrase, strength in words]
        rows.sort(key=lambda r: (-len(_plain(r[0])), r[0].casefold()))
        forms = tuple(_plain(r[0]) for r in rows)
        covered = tuple(
            tuple(j + 1 for j in range(i) if _inside(forms[i], forms[j])) for i in range(len(rows))
        )
        return cls(profile.minimum_score, tuple(r[0] for r in rows), forms, tuple(r[1] for r in rows),
                   tuple(r[2] for r in rows), covered)

    # -- literals ------------------------------------------------------------------
    def _table(self, values, kind: str) -> str:
        """SQL: a literal array, folded to a constant by the optimizer."""
        return f"from_json({q(json.dumps(list(values), ensure_ascii=False))}, 'array<{kind}>')"

    def _ints(self, values) -> str:
        return self._table(values, "int")

    def _strings(self, values) -> str:
        return self._table(values, "string")

    # -- matching ------------------------------------------------------------------
    def sql_match(self, text: str) -> str:
        """Ascending numbers of all phrases found in ``text`` (already in matching form)."""
        numbered = [(i, p) for i, p in enumerate(self.forms, 1) if p]
        long = self._table([{"i": i, "p": p} for i, p in numbered if not is_short(p)], "struct<i:int,p:string>")
        found = f"transform(filter({long}, k -> contains({text}, k.p)), k -> k.i)"
        short = [f"if({sql_keyword_in_text(p, text)}, {i}, null)" for i, p in numbered if is_short(p)]
        return f"array_sort(concat({found}, array_compact(array({', '.join(short)}))))" if short else found

    def sql_suppress(self, numbers: str) -> str:
        """Drop a phrase that lies inside an already kept one; a fold, because keeping is sequential."""
        if not any(self.covered_by):
            return numbers
        table = self._table([list(c) for c in self.covered_by], "array<int>")
        fold = (f"aggregate({numbers}, cast(array() as array<int>), "
                f"(kept, n) -> if(arrays_overlap(kept, element_at({table}, n)), kept, array_append(kept, n)))")
        return f"if(size({numbers}) < 2, {numbers}, {fold})"

    def sql_kept(self, value: str) -> str:
        matched = sql_let(sql_matching_text(value), "w", self.sql_match("w"))
        return sql_let(matched, "all_found", self.sql_suppress("all_found"))

    def match(self, text: Column) -> Column:
        return bind(text, self.sql_match("x"))

    def suppress(self, numbers: Column) -> Column:
        return bind(numbers, self.sql_suppress("x"))

    # -- scoring -------------------------------------------------------------------
    def sql_topics(self, numbers: str) -> str:
        return f"array_sort(array_distinct(transform({numbers}, n -> element_at({self._strings(self.topics)}, n))))"

    def sql_score(self, title: str, summary: str) -> str:
        title_weight = self._ints(V.TITLE_WEIGHTS[s] for s in self.strengths)
        summary_weight = self._ints(V.SUMMARY_WEIGHTS[s] for s in self.strengths)
        supporting = self._ints(int(s == "supporting") for s in self.strengths)
        in_title = f"aggregate({title}, 0, (a, n) -> a + element_at({title_weight}, n))"
        repeated = f"element_at({supporting}, n) = 1 and array_contains({title}, n)"
        in_summary = f"aggregate(filter({summary}, n -> not ({repeated})), 0, (a, n) -> a + element_at({summary_weight}, n))"
        union = f"array_union({title}, {summary})"
        return f"{in_title} + {in_summary} + if(size({union}) >= 2, 1, 0) + if(size({self.sql_topics(union)}) >= 2, 1, 0)"

    def assess(self, title: Column, summary: Column) -> Column:
        """struct<title, summary, score>: kept keyword numbers per field and the score."""
        both = F.struct(title.alias("title"), summary.alias("summary"))
        found = f"named_struct('title', {self.sql_kept('x.title')}, 'summary', {self.sql_kept('x.summary')})"
        return bind(both, sql_let(
            found, "y", f"named_struct('title', y.title, 'summary', y.summary, 'score', {self.sql_score('y.title', 'y.summary')})"
        ))

    # -- explanation ---------------------------------------------------------------
    def sql_by_fold(self, numbers: str) -> str:
        order = sorted(range(len(self.phrases)), key=lambda i: self.phrases[i].casefold())
        place = [0] * len(order)
        for rank, i in enumerate(order, 1):
            place[i] = rank
        ranks = f"array_sort(transform({numbers}, n -> element_at({self._ints(place)}, n)))"
        return f"transform({ranks}, r -> element_at({self._strings(self.phrases[i] for i in order)}, r))"

    def _sql_strength_map(self, numbers: str) -> str:
        entry = f"struct(element_at({self._strings(self.phrases)}, n), element_at({self._strings(self.strengths)}, n))"
        return f"map_from_entries(transform({numbers}, n -> {entry}))"

    def explain(self, found: str) -> dict[str, Column]:
        """The eleven match columns of the assessment struct in column ``found``."""
        title, summary = f"{found}.title", f"{found}.summary"
        union = f"array_union({title}, {summary})"
        names, strengths = self._strings(self.phrases), self._strings(self.strengths)

        def of_strength(wanted: str) -> str:
            chosen = f"filter({union}, n -> element_at({strengths}, n) = '{wanted}')"
            return f"array_sort(transform({chosen}, n -> element_at({names}, n)))"

        texts = {
            "matched_topics": self.sql_topics(union),
            "matched_keywords": self.sql_by_fold(union),
            "title_matched_keywords": self.sql_by_fold(title),
            "summary_matched_keywords": self.sql_by_fold(summary),
            "core_matched_keywords": of_strength("core"),
            "general_matched_keywords": of_strength("general"),
            "supporting_matched_keywords": of_strength("supporting"),
            "title_keyword_strengths": self._sql_strength_map(title),
            "summary_keyword_strengths": self._sql_strength_map(summary),
        }
        columns = {name: F.expr(text) for name, text in texts.items()}
        score = F.col(f"{found}.score")
        return columns | {"relevance_score": score, "relevance_level": relevance_level(score)}


def relevance_level(score: Column) -> Column:
    return (
        F.when(score >= V.LEVEL_HIGH_FROM, F.lit(V.LEVEL_HIGH))
        .when(score >= V.LEVEL_MEDIUM_FROM, F.lit(V.LEVEL_MEDIUM))
        .otherwise(F.lit(V.LEVEL_LOW))
    )


def _assessed(records: DataFrame, index: KeywordIndex) -> DataFrame:
    """Add the assessment struct ``_found``, evaluated once per record whatever is filtered on it."""
    return computed(records, {"_found": index.assess(F.col("title"), F.col("summary"))})


def annotate(records: DataFrame, profile: Profile, link: str | None = "link") -> DataFrame:
    """Add ``included`` and the match columns; rows below the minimum keep empty match columns.

    Give ``link`` for news (landing pages never qualify) and None for briefings.
    """
    index = KeywordIndex.of(profile)
    scored = _assessed(records, index)
    good = F.col("_found.score") >= profile.minimum_score
    if link is not None:
        good = good & ~is_agency_homepage(F.col(link))
    scored = scored.withColumn("included", good)
    blank = {"int": F.lit(0), "string": F.lit("")}

    def empty(kind: str) -> Column:
        if kind.startswith("array"):
            return F.array().cast(kind)
        if kind.startswith("map"):
            return F.create_map().cast(kind)
        return blank[kind]

    columns = {
        name: F.when(F.col("included"), value).otherwise(empty(MATCH_FIELDS[name]))
        for name, value in index.explain("_found").items()
    }
    return scored.withColumns(columns).drop("_found")


def filter_relevant(records: DataFrame, profile: Profile, link: str | None = "link") -> DataFrame:
    """Only the qualifying rows: decided on numbers first, explained afterwards."""
    index = KeywordIndex.of(profile)
    scored = records
    if link is not None:
        scored = scored.where(~is_agency_homepage(F.col(link)))
    scored = _assessed(scored, index)
    return scored.where(F.col("_found.score") >= profile.minimum_score).withColumns(index.explain("_found")).drop("_found")


def highlight_plan(title_strengths: Column, summary_strengths: Column) -> Column:
    """array<struct<keyword, strength>> in drawing order, core last; the title's strength wins."""
    def place(strength: Column) -> Column:
        return F.when(strength == "supporting", 0).when(strength == "general", 1).otherwise(2)

    entries = F.map_entries(F.map_concat(summary_strengths, title_strengths))
    ranked = F.array_sort(F.transform(
        entries, lambda e: F.struct(place(e["value"]).alias("o"), e["key"].alias("keyword"), e["value"].alias("strength"))
    ))
    return F.transform(ranked, lambda r: F.struct(r["keyword"].alias("keyword"), r["strength"].alias("strength")))


def strongest_tag(strengths: Column, level: Column) -> Column:
    """Strongest strength present in a strength map, else the relevance level."""
    values = F.map_values(strengths)
    out = level
    for strength in reversed(V.STRENGTHS):
        out = F.when(F.array_contains(values, strength), F.lit(strength)).otherwise(out)
    return out


def keyword_table(spark, profile: Profile) -> DataFrame:
    """The profile's keyword dimension with its weights, for joins and the settings report."""
    rows = [(*r, V.TITLE_WEIGHTS[r[4]], V.SUMMARY_WEIGHTS[r[4]]) for r in profile.keyword_rows()]
    return spark.createDataFrame(
        rows, "topic string, topic_ord int, phrase string, kw_ord int, strength string, title_weight int, summary_weight int"
    )


def join_keywords(records: DataFrame, profile: Profile, id_column: str, text_column: str) -> DataFrame:
    """Long form of the matches: one row per record and phrase found.

    The phrases are profile constants, so the theta join is an explode of array arithmetic
    rather than a nested-loop join: matching rows leave the scan stage, nothing is shuffled.
    """
    index = KeywordIndex.of(profile)
    found = bind(F.col(text_column), sql_let(sql_matching_text("x"), "w", index.sql_match("w")))
    looked_up = {"topic": index.topics, "phrase": index.phrases, "strength": index.strengths}
    return records.select(id_column, F.explode(found).alias("_n")).select(
        id_column, *[F.expr(f"element_at({index._strings(values)}, _n)").alias(name) for name, values in looked_up.items()]
    )


def selected_sources(records: DataFrame, profile: Profile, column: str) -> DataFrame:
    return records.where(F.array_contains(literal_array(profile.selected_sources), F.col(column)))
