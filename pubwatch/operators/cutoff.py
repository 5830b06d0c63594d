"""Which landed pages of a paged source count, and which tier of a source cascade."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pubwatch import fixed_values as V

#: Pages of a source that one task orders.
PAGE_BLOCK = 1024


def keep_until_stop(pages: DataFrame, keys: list[str], stop: Column, max_pages: int | None = None, first_page: int = 1) -> DataFrame:
    """Pages up to and including the first one with ``stop``; ``max_pages`` limits them where a caller asks for it.

    The first stopping page is a minimum, which combines map-side; no window over a source's pages.
    """
    bounded = pages if max_pages is None else pages.where(F.col("page_no") < first_page + max_pages)
    bounded = bounded.withColumn("_stop", stop)
    first = bounded.groupBy(*keys).agg(F.min(F.when(F.col("_stop"), F.col("page_no"))).alias("_last"))
    joined = bounded.join(first, keys)
    return joined.where(F.col("_last").isNull() | (F.col("page_no") <= F.col("_last"))).drop("_stop", "_last")


def page_cutoff_feed(pages: DataFrame, keys: list[str], since: Column, max_pages: int | None = None) -> DataFrame:
    """Stop at a page that is short, undated or reaches back before ``since``.

    ``pages``: keys, page_no (from 1), entries, dated, oldest.
    """
    stop = (F.col("entries") < V.FEED_PAGE_ENTRIES) | (F.col("dated") == 0) | F.coalesce(F.col("oldest") < since, F.lit(False))
    return keep_until_stop(pages, keys, stop, max_pages)


def page_cutoff_api(pages: DataFrame, keys: list[str], since: Column, page_size: int, max_pages: int | None = None) -> DataFrame:
    stop = (F.col("entries") < page_size) | F.coalesce(F.col("oldest") < since, F.lit(False))
    return keep_until_stop(pages, keys, stop, max_pages, first_page=0)


def page_cutoff_archive(pages: DataFrame, keys: list[str], since: Column, max_pages: int | None = None) -> DataFrame:
    """Stop at the first page without cards or with one before ``since``."""
    stop = (F.col("entries") == 0) | F.coalesce(F.col("oldest") < since, F.lit(False))
    return keep_until_stop(pages, keys, stop, max_pages).where("entries > 0")


def page_cutoff_search(pages: DataFrame, keys: list[str], max_pages: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(pages that count, warning per source) of a search with a stated total.

    ``pages``: keys, page_no (from 0), entries, total, readable.  A page that cannot be read ends
    the source but keeps what came before.  Pages landed twice count once.  With ``max_pages`` a source that
    this limit cuts short has the warning ``too_many_results``.
    """
    bounded = (pages if max_pages is None else pages.where(F.col("page_no") < max_pages)).groupBy(*keys, "page_no").agg(
        F.max("entries").alias("entries"), F.max("total").alias("total"), F.bool_and("readable").alias("readable")
    )
    # Sums over blocks of pages come first, so no task orders all pages of a source.
    blocks = bounded.withColumn("_block", F.floor(F.col("page_no") / PAGE_BLOCK)).withColumn("_own", F.when(F.col("readable"), F.col("entries")).otherwise(0))
    earlier = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy(*keys, "_block").orderBy("page_no").rowsBetween(Window.unboundedPreceding, 0)
    offsets = blocks.groupBy(*keys, "_block").agg(F.sum("_own").alias("_sum")).select(*keys, "_block", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before"))
    within = blocks.withColumn("fetched", F.sum("_own").over(upto)).join(offsets, [*keys, "_block"])
    running = within.withColumn("fetched", F.col("fetched") + F.col("_before")).drop("_block", "_own", "_before")
    stop = ~F.col("readable") | (F.col("entries") == 0) | (F.col("fetched") >= F.col("total"))
    kept = keep_until_stop(running, keys, stop, max_pages, first_page=0)
    last = kept.groupBy(*keys).agg(
        F.max("page_no").alias("last_page"), F.max("fetched").alias("fetched"), F.max("total").alias("total"),
        F.bool_and("readable").alias("readable"), F.min("entries").alias("fewest"),
    )
    warning = (
        F.when(~F.col("readable"), F.lit("broken_page"))
        .when(F.lit(max_pages is not None) & (F.col("last_page") == (max_pages or 0) - 1) & (F.col("fetched") < F.col("total")) & (F.col("fewest") > 0), F.lit("too_many_results"))
    )
    return kept.where("readable"), last.withColumn("warning", warning)


def fallback_tier(records: DataFrame, source: str = "source_id", tier: str = "tier") -> DataFrame:
    """Keep a source's lowest tier that has rows; supplements (tier null) always stay.

    The tier is a minimum per source that combines map-side, joined back on the source; adaptive
    execution splits a source that holds most rows.
    """
    lowest = records.where(F.col(tier).isNotNull()).groupBy(source).agg(F.min(tier).alias("_lowest"))
    joined = records.join(lowest, source, "left")
    return joined.where(F.col(tier).isNull() | (F.col(tier) == F.col("_lowest"))).drop("_lowest")


def trailing_matches(history: DataFrame, order: str = "compared_at", match: str = "logical_match") -> DataFrame:
    """Length of the newest unbroken run of matches: rows after the last mismatch, found by a maximum."""
    last_miss = history.where(~F.col(match)).agg(F.max(order)).scalar()
    return history.where(last_miss.isNull() | (F.col(order) > last_miss)).agg(F.count("*").alias("consecutive_matches"))
