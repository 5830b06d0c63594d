"""URL filter rules by hashed host-suffix and path-prefix expressions.

A URL is expanded into ``host suffix + path prefix`` expressions.  Each is hashed with SHA-256; a short prefix
of the digest is the equi-join key to the rules, the full digest confirms the hit, and of the confirmed rules
the most specific one decides.  Only the shapes (labels of the host, length of the path) that some rule has are
expanded, so nothing is cut off: a URL of any depth meets every rule that can fit it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX_HEX = 8
RULE_SCHEMA = "host string, path string, verdict string"
#: The production rules: (host, path, verdict).
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
_CAPITALS, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def with_host_and_path(df: DataFrame, url: str = "url") -> DataFrame:
    """``host`` (A-Z lower-cased) and ``path`` of a URL; both empty for null and for text without ``://``."""
    found, rest = F.col("_u").contains("://"), F.expr("substring(_u, instr(_u, '://') + 3)")
    host, path = F.regexp_extract(rest, r"^([^/?#]*)", 1), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return (
        df.withColumn("_u", F.coalesce(F.col(url), F.lit("")))
        .withColumn("host", F.when(found, F.translate(host, _CAPITALS, _SMALL)).otherwise(""))
        .withColumn("path", F.when(found, path).otherwise(""))
        .drop("_u")
    )


def hashed_rules(rules: DataFrame) -> DataFrame:
    """One row per expression; of rules with equal host and path, ``block`` wins over ``allow``."""
    expression = F.concat("host", "path")
    return (
        rules.where("host <> '' AND path IS NOT NULL").withColumn("host", F.translate("host", _CAPITALS, _SMALL))
        .groupBy("host", "path").agg(F.max("verdict").alias("rule_verdict"))
        .select(expression.alias("rule"), "rule_verdict", F.sha2(expression, 256).alias("rule_digest"),
                F.size(F.split("host", r"\.")).alias("labels"), F.length("path").alias("path_chars"))
        .withColumn("rule_prefix", F.substring("rule_digest", 1, PREFIX_HEX))
    )


def judge_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """Adds ``host``, ``path``, ``rule`` (null without one) and ``verdict`` to every row of ``pages``.

    A rule fits its host and all subdomains of it if the path starts with the rule's path; the longest rule wins
    (then the one with the longer host).  No rule: ``default``.  Columns of the same names are replaced; null,
    empty and odd URLs keep their row; repeated rows stay repeated; empty tables give empty results.  The shapes
    read on the driver are pairs of small numbers: at most the label counts times the path lengths of the rules.
    """
    names = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    keyed = hashed_rules(rules)
    shapes = sorted(tuple(r) for r in keyed.select("labels", "path_chars").distinct().collect())
    kept = with_host_and_path(pages.select(*names), url)
    if not shapes:
        return kept.select(*names, "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    labels = F.expr("size(split(host, '[.]'))")
    expressions = F.array(*(
        F.when((labels >= n) & (F.length("path") >= m) & (F.col("host") != ""),
               F.concat(F.substring_index("host", ".", -n), F.substring("path", 1, m)))
        for n, m in shapes
    ))
    # The row number ties a row's expressions together again; it is made and used inside one stage.
    rows = kept.select(*names, "host", "path", F.monotonically_increasing_id().alias("_row"))
    wide = rows.select("*", F.explode(expressions).alias("_expression"))
    hit = (
        wide.withColumn("_digest", F.sha2("_expression", 256)).withColumn("_prefix", F.substring("_digest", 1, PREFIX_HEX))
        .join(keyed, (F.col("_prefix") == F.col("rule_prefix")) & (F.col("_digest") == F.col("rule_digest")), "left")
    )
    best = F.max(F.when(F.col("rule").isNotNull(), F.struct(F.length("rule").alias("n"), -F.col("path_chars"), "rule", "rule_verdict"))).alias("_best")
    return (
        hit.groupBy("_row").agg(*(F.first(c).alias(c) for c in [*names, "host", "path"]), best)
        .select(*names, "host", "path", F.col("_best.rule").alias("rule"), F.coalesce("_best.rule_verdict", F.lit(default)).alias("verdict"))
    )
