"""Canonical JSON as Column expressions: sorted keys, nested rows, one written form per value.

Equal content gives equal text whatever the order of keys, so the text can be hashed to an identity.
Numbers are written as Spark casts them; nulls are written, never left out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from pubwatch.functions.base import let


def lower_escapes(text: Column) -> Column:
    """Lower-case hex in the control escapes of a JSON text."""
    def lower_hex(x: Column) -> Column:
        out = x
        for code in ("0B", "0E", "0F", "1A", "1B", "1C", "1D", "1E", "1F"):
            out = F.regexp_replace(out, rf"(?<!\\)((?:\\\\)*)\\u00{code}", rf"$1\\u00{code.lower()}")
        return F.when(F.contains(x, F.lit("\\u00")), out).otherwise(x)

    return let(text, lower_hex)


def json_text(value: Column) -> Column:
    """A string, escaped and quoted."""
    quoted = let(F.to_json(F.array(value)), lambda x: F.substring(x, F.lit(2), F.length(x) - 2))
    return F.when(value.isNull(), F.lit("null")).otherwise(lower_escapes(quoted))


def json_plain(value: Column) -> Column:
    """A number or a boolean."""
    return F.coalesce(value.cast("string"), F.lit("null"))


def json_row(values: list[Column]) -> Column:
    """Written values as one array of fixed length."""
    return F.concat(F.lit("["), F.concat_ws(", ", *values), F.lit("]"))


def json_list(values: Column, item: Callable[[Column], Column]) -> Column:
    """An array, each element written by ``item``."""
    return F.coalesce(F.concat(F.lit("["), F.array_join(F.transform(values, item), ", "), F.lit("]")), F.lit("null"))


def json_object(fields: dict[str, Column]) -> Column:
    """Written values under fixed keys, sorted by key."""
    pairs = [F.concat(F.lit(f'"{key}": '), fields[key]) for key in sorted(fields)]
    return F.concat(F.lit("{"), F.concat_ws(", ", *pairs), F.lit("}"))
