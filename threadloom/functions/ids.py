"""Content addressing: SHA-256 ids as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def prefixed(prefix: str, material: Column) -> Column:
    return F.concat(F.lit(prefix), F.sha2(material, 256))


def content_hash(text: Column) -> Column:
    return prefixed("sha256:", text)


def json_fragment(text: Column) -> Column:
    """Escapes backslash, quote, line feed, carriage return and tab, and nothing else."""
    out = F.coalesce(text, F.lit(""))
    for raw, escaped in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        out = F.replace(out, F.lit(raw), F.lit(escaped))
    return out


#: Fixed order of the fields that identify an event; the project isn't among them.
EVENT_FIELDS = ("source", "source_session_id", "source_event_id", "event_type", "role", "timestamp", "content_hash", "parent_hash", "parser_version")


def event_id(fields: dict[str, Column]) -> Column:
    """Id of an event over its canonical JSON; null fields count as empty."""
    parts = [F.concat(F.lit(f'"{name}":"'), json_fragment(fields[name]), F.lit('"')) for name in EVENT_FIELDS]
    return prefixed("evt:v1:", F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}")))


def citation(*fields: Column) -> Column:
    """Id of a provider message: its fields, one a line, line number included."""
    return prefixed("message:v1:", F.concat_ws("\n", *[f.cast("string") for f in fields]))


def ordered_digest(key: Column, line: Column) -> Column:
    """Aggregate: content hash of the lines in key order, one after the other."""
    rows = F.array_sort(F.collect_list(F.struct(key.alias("k"), line.alias("v"))))
    return content_hash(F.array_join(F.transform(rows, lambda r: r["v"]), ""))
