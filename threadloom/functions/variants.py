"""Reading JSON rows that follow no schema: typed accessors over variants, and the text that nested values hold."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from threadloom.functions.text import is_blank


def string(v: Column, path: str) -> Column:
    """The string at a path; null for anything else."""
    found = F.try_variant_get(v, path, "variant")
    return F.when(F.schema_of_variant(found) == "STRING", F.try_variant_get(v, path, "string"))


def itself(v: Column) -> Column:
    """A value that is a string."""
    return F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))


def field(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "variant")


def items(v: Column) -> Column:
    """The items of an array; null for anything else."""
    return F.try_variant_get(v, "$", "array<variant>")


def compact(v: Column) -> Column:
    """A value as JSON without white space, keys in order."""
    return F.to_json(v)


def joined(values: Column, text, drop_blank: bool = True) -> Column:
    parts = F.transform(values, text)
    return F.array_join(F.filter(parts, lambda t: t.isNotNull() & ~is_blank(t) if drop_blank else t.isNotNull()), "\n")


def flat_text(v: Column) -> Column:
    """A string, the ``text`` of an object, or those of an array's items, a line each; null if there is none."""
    found = items(v)
    said = joined(found, lambda x: F.coalesce(itself(x), string(x, "$.text")), drop_blank=False)
    return F.coalesce(itself(v), F.when(found.isNotNull(), F.nullif(said, F.lit(""))), string(v, "$.text"))


def _nested(value, keys: tuple[str, ...], first_key_decides: bool) -> str | None:
    if isinstance(value, str):
        return value
    if isinstance(value, list):
        parts = [t for x in value if (t := _nested(x, keys, first_key_decides)) and t.strip()]
        return "\n".join(parts) or None
    if isinstance(value, dict):
        if isinstance(value.get("text"), str):
            return value["text"]
        for key in keys:
            if key in value:
                text = _nested(value[key], keys, first_key_decides)
                if first_key_decides or text is not None:
                    return text
    return None


def nested_text(v: Column, keys: tuple[str, ...] = ("content", "parts"), first_key_decides: bool = False) -> Column:
    """Text of a string, of an array's items, or of an object: its ``text``, else that of the first of ``keys`` that has some,
    to any depth; null if there is none.

    Plain shapes are read by expressions; only what these leave open goes through Python. ``first_key_decides``: of an object
    only the first key that is there counts.
    """

    @F.pandas_udf("string")
    def deep(rows: pd.Series) -> pd.Series:
        return rows.map(lambda t: None if t is None else _nested(json.loads(t), keys, first_key_decides))

    found = items(v)
    own = lambda x: F.coalesce(itself(x), string(x, "$.text"))
    plain = F.when(found.isNotNull() & F.forall(found, lambda x: own(x).isNotNull()), joined(found, own))
    plain = F.coalesce(itself(v), string(v, "$.text"), plain)
    return F.nullif(F.coalesce(plain, deep(F.when(plain.isNull(), compact(v)))), F.lit(""))
