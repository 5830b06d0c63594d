"""Small building blocks shared by the Column functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The characters a Unicode-aware \s matches, spelled out so that Java needs no (?U) flag.
SPACE = r"\s\x1c-\x1f\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"

# The same set beyond ASCII as plain characters, and the ASCII characters other than the blank.
WIDE_SPACE = "".join(map(chr, (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
ALL_SPACE = " " + "".join(map(chr, (*range(0x09, 0x0E), *range(0x1C, 0x20)))) + WIDE_SPACE
NARROW_SPACE = r"[\x09-\x0d\x1c-\x1f]"



def q(value: str) -> str:
    """A SQL string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def sql_let(value: str, name: str, body: str) -> str:
    """SQL text that evaluates ``value`` once and names it inside ``body``."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def bind(value: Column, body: str, name: str = "x") -> Column:
    """Apply SQL text to any Column: ``body`` sees the value as ``name``, evaluated once.

    Long functions are written as SQL text because one parsed expression costs one call to the
    JVM, where the same tree built node by node costs thousands.
    """
    return F.element_at(F.call_function("transform", F.array(value), F.expr(f"{name} -> {body}")), 1)


def sql_array(values) -> str:
    """A literal string array as SQL text."""
    items = ", ".join(q(v) for v in values)
    return f"array({items})" if items else "cast(array() as array<string>)"


def sql_any(tests) -> str:
    listed = list(tests)
    return "(" + " or ".join(listed) + ")" if listed else "false"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once and use it many times without copying its expression tree."""
    return F.element_at(F.transform(F.array(value), body), 1)


def text_or(value: Column, default: Column | str) -> Column:
    """``value`` unless it is null or empty; mirrors an ``a or b`` over strings."""
    fallback = F.lit(default) if isinstance(default, str) else default
    return F.coalesce(F.nullif(value, F.lit("")), fallback)


def sql_squeeze(x: str) -> str:
    """SQL text of :func:`squeeze`: white space to blanks by one-character classes, which regular
    expressions scan fast, and runs of blanks only where there are any."""
    narrow = f"if(octet_length(w) = length(w), w, regexp_replace(w, {q('[' + WIDE_SPACE + ']')}, ' '))"
    blanks = f"regexp_replace({narrow}, {q(NARROW_SPACE)}, ' ')"
    return sql_let(x, "w", sql_let(blanks, "b1", "trim(if(contains(b1, '  '), regexp_replace(b1, '  +', ' '), b1))"))


def squeeze(value: Column) -> Column:
    """Collapse every run of white space to one blank and strip both ends."""
    return bind(value, sql_squeeze("x"))


def strip(value: Column) -> Column:
    """Strip Unicode white space from both ends (a plain trim only removes blanks)."""
    return F.btrim(value, F.lit(ALL_SPACE))


def fold(value: Column) -> Column:
    """Case folding: lower case plus the sharp s, the one letter where the two differ in practice."""
    return F.replace(F.lower(value), F.lit("ß"), F.lit("ss"))


def ordered_distinct(values: Column) -> Column:
    """Drop null and empty entries and repeats, keeping first-seen order."""
    return F.array_distinct(F.filter(values, lambda v: v.isNotNull() & (v != "")))


def literal_array(values) -> Column:
    items = [F.lit(v) for v in values]
    return F.array(*items) if items else F.array().cast("array<string>")


def literal_map(mapping: dict) -> Column:
    """A string map as one folded literal, so that a lookup adds a single plan node."""
    keys = F.array(*[F.lit(k) for k in mapping])
    values = F.array(*[F.lit(v) for v in mapping.values()])
    return F.map_from_arrays(keys, values)


def any_of(value: Column, tests: list[Column]) -> Column:
    out = F.lit(False)
    for test in tests:
        out = out | test
    return out


def computed(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add costly columns so that later filters use their values.

    A filter on a projected column is pushed below the projection and evaluates the whole
    expression again, once per predicate.  Generated columns cannot be pushed through.
    """
    pack = F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))
    kept = [F.col(f"`{c}`") for c in df.columns if c not in columns]
    out = df.select(*kept, F.explode(pack).alias("_computed"))
    return out.select(*kept, *[F.col(f"_computed.{n}").alias(n) for n in columns])
