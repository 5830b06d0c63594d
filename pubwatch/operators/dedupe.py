"""First-wins de-duplication of records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pubwatch.functions.base import fold, strip, text_or
from pubwatch.functions.text import normalize_title


def keep_first(df: DataFrame, keys: list[Column], order: list[Column]) -> DataFrame:
    """One row per key, the first in ``order``.

    Catalyst turns ``row_number() = 1`` into a per-partition group limit before the exchange,
    so a key that holds a third of all rows sends one row per input partition, not all of them.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(window)).where("_rank = 1").drop("_rank")


def link_form(link: Column) -> Column:
    return fold(F.rtrim(strip(link), F.lit("/")))


def news_key(link: Column, agency: Column, published_at: Column, title: Column) -> Column:
    """Link form, else agency + UTC day + normalised title; the tag keeps the two kinds apart."""
    by_link = link_form(link)
    other = F.concat_ws("\x1f", F.lit("title"), fold(agency), F.date_format(published_at, "yyyy-MM-dd"), normalize_title(title))
    return F.when(by_link != "", F.concat(F.lit("link\x1f"), by_link)).otherwise(other)


def unit_or_agency() -> Column:
    return text_or(F.col("unit_category"), F.col("agency"))


def dedupe_news(news: DataFrame, arrival: tuple[str, ...] = ()) -> DataFrame:
    """Newest per key, then by unit, link and title; what is equal in these keeps arrival order (the ``arrival`` columns).

    Without ``arrival`` records that are equal in all four but differ elsewhere are told apart by chance.
    """
    key = news_key(F.col("link"), F.col("agency"), F.col("published_at"), F.col("title"))
    return keep_first(
        news.withColumn("_key", key),
        [F.col("_key")],
        [F.col("published_at").desc(), unit_or_agency(), F.col("link"), F.col("title"), *[F.col(c) for c in arrival]],
    ).drop("_key")


def briefing_key() -> Column:
    link = F.rtrim(F.col("webpage_url"), F.lit("/"))
    return F.coalesce(
        F.nullif(F.col("identifier"), F.lit("")),
        F.nullif(link, F.lit("")),
        F.concat_ws(":", F.col("publisher"), F.col("title")),
    )


def dedupe_briefings(briefings: DataFrame, arrival: tuple[str, ...] = ("arrival_seq",)) -> DataFrame:
    """Newest per key; equal times keep arrival order, which is why arrival is a column."""
    return keep_first(
        briefings.withColumn("_key", briefing_key()),
        [F.col("_key")],
        [F.col("published_at").desc(), *[F.col(c) for c in arrival]],
    ).drop("_key")


def first_link_per_page(cards: DataFrame, page: str = "page_url", link: str = "link", position: str = "position") -> DataFrame:
    return keep_first(cards, [F.col(page), F.col(link)], [F.col(position)])
