"""Joins that resolve, enrich and merge record tables, and the selective re-run."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pubwatch import fixed_values as V
from pubwatch.functions.base import text_or
from pubwatch.functions.text import normalize_title, translate_by_rule
from pubwatch.operators.dedupe import dedupe_news


LOOKUP_BYTES = 32 * 1024 * 1024


def as_lookup(dimension: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """How tables derived from ``dimension`` (at most two rows a row) are joined: broadcast only if its measured size
    is within ``LOOKUP_BYTES``, else without a hint."""
    size = F.octet_length(F.to_json(F.struct(*dimension.columns)))
    small = dimension.agg(F.coalesce(F.sum(size), F.lit(0)).alias("b")).first()["b"] <= LOOKUP_BYTES
    return F.broadcast if small else lambda df: df


def resolve_source(news: DataFrame, sources: DataFrame, carried: tuple[str, ...] = ()) -> DataFrame:
    """Add ``source_id``: the first source (by ordinal) that matches by any name, else the agency text.

    ``sources``: source_ord, source_id, display_name, name_en, and the ``carried`` columns, which the match brings
    along (null without one).  Three equi joins on distinct keys instead of one OR join; each lookup holds one row per
    name, so repeated ids multiply nothing, and a dimension of measured small size makes no record move.
    """
    beside = as_lookup(sources.select("source_ord", "source_id", "display_name", "name_en", *carried))
    hit = F.struct("source_ord", "source_id", *carried)

    def named(*names: str) -> DataFrame:
        keyed = sources.select(F.explode(F.array(*names)).alias(names[0]), hit.alias("_h")) if len(names) > 1 else sources.select(names[0], hit.alias("_h"))
        return keyed.groupBy(names[0]).agg(F.min("_h").alias("_m"))

    by_agency = named("display_name", "source_id").toDF("agency", "_a")
    by_english, by_unit = named("name_en").toDF("agency_en", "_e"), named("source_id").toDF("unit_category", "_u")
    joined = news
    for key, lookup in (("agency", by_agency), ("agency_en", by_english), ("unit_category", by_unit)):
        joined = joined.join(beside(lookup), key, "left")
    first = F.array_min(F.array_compact(F.array("_a", "_e", "_u")))
    found = {"source_id": F.coalesce(first["source_id"], F.col("agency")), **{c: first[c] for c in carried}}
    return joined.withColumns(found).drop("_a", "_e", "_u")


def canonical_health_source(source: Column, known: Column) -> Column:
    return F.when(known.isNotNull(), source).otherwise(F.lit(V.BRIEFINGS_SOURCE_ID))


def merge_news(previous: DataFrame, fetched: DataFrame, retried: DataFrame, arrival: tuple[str, ...] = ()) -> DataFrame:
    """Keep the previous rows of sources that were not retried, add the new rows, de-duplicate."""
    kept = previous.join(retried, "source_id", "left_anti")
    return dedupe_news(kept.unionByName(fetched, allowMissingColumns=True), arrival)


def merge_briefings(previous: DataFrame, fetched: DataFrame, briefings_retried: bool) -> DataFrame:
    """Table-level choice: the new briefings if their source was retried, else the old ones."""
    return fetched if briefings_retried else previous


def merge_health(previous: DataFrame, fetched: DataFrame, retried: DataFrame, sources: DataFrame) -> DataFrame:
    """Health rows of sources not retried plus the new rows, in source order.

    Rows of sources outside ``sources`` (source_id, source_ord) belong to the briefings source.
    """
    known = sources.select(F.col("source_id").alias("source"), "source_ord")
    last = sources.agg(F.max("source_ord")).scalar()

    def identified(health: DataFrame) -> DataFrame:
        joined = health.join(known, "source", "left")
        return joined.withColumn("source_id", canonical_health_source(F.col("source"), F.col("source_ord")))

    kept = identified(previous).join(retried, "source_id", "left_anti")
    both = kept.unionByName(identified(fetched), allowMissingColumns=True)
    return both.withColumn("source_ord", F.coalesce(F.col("source_ord"), last + 1)).orderBy("source_ord", "source")


def exclude_out_of_period_links(cards: DataFrame, feed_entries: DataFrame, since: Column, until: Column) -> DataFrame:
    """Drop cards whose link a feed dates outside the period."""
    outside = feed_entries.where((F.col("published_at") < since) | (F.col("published_at") >= until))
    links = outside.select(F.regexp_replace("link", "/+$", "").alias("_l")).distinct()
    return cards.withColumn("_l", F.regexp_replace("link", "/+$", "")).join(links, "_l", "left_anti").drop("_l")


def attach_fetched_at(records: DataFrame, health: DataFrame, default: Column, key: Column) -> DataFrame:
    """Fetch time of the record's source, else the run's time."""
    observed = health.where(F.coalesce("fetched_at", F.lit("")) != "").groupBy(F.col("source").alias("_s")).agg(F.max("fetched_at").alias("_f"))
    joined = records.withColumn("_s", key).join(observed, "_s", "left")
    return joined.withColumn("fetched_at", F.coalesce("_f", default)).drop("_s", "_f")


# --- translation cache ---------------------------------------------------------------------


def distinct_texts(texts: DataFrame, text: str = "text", position: str = "position") -> DataFrame:
    """Texts to translate, once each, with the place of first use."""
    return texts.where(F.coalesce(F.col(text), F.lit("")) != "").groupBy(text).agg(F.min(position).alias(position))


def lookup_translations(texts: DataFrame, cache: DataFrame) -> DataFrame:
    """Cache join; a hit needs a stored translation that differs from the text once normalised.

    ``cache``: text, translation -> text, translation (null on a miss), hit.
    """
    stored = cache.where(F.coalesce("translation", F.lit("")) != "")
    joined = texts.select("text").distinct().join(stored, "text", "left")
    resolved = F.when(F.col("translation").isNotNull(), translate_by_rule(F.col("text"), F.col("translation")))
    good = F.coalesce((resolved != "") & (normalize_title(resolved) != normalize_title(F.col("text"))), F.lit(False))
    return joined.select("text", F.when(good, resolved).alias("translation"), good.alias("hit"))


def cache_counts(looked_up: DataFrame) -> DataFrame:
    return looked_up.agg(F.count_if("hit").alias("translation_cache_hits"), F.count_if(~F.col("hit")).alias("translation_cache_misses"))


def upsert_cache(cache: DataFrame, new: DataFrame) -> DataFrame:
    """New non-empty translations win over stored ones."""
    fresh = new.where((F.coalesce("text", F.lit("")) != "") & (F.coalesce("translation", F.lit("")) != "")).select("text", F.col("translation").alias("_n"))
    return cache.join(fresh, "text", "full").select("text", F.coalesce("_n", "translation").alias("translation"))


def untranslated_titles(titles: DataFrame, translations: DataFrame) -> DataFrame:
    joined = titles.where(F.col("title") != "").select("title").distinct().join(
        translations.withColumnRenamed("text", "title"), "title"
    )
    return joined.where(normalize_title(F.coalesce("translation", F.lit(""))) == normalize_title(F.col("title"))).select("title")


def source_label(unit: str = "unit_category", agency: str = "agency") -> Column:
    return text_or(F.col(unit), F.col(agency))
