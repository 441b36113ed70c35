"""Scalar text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def shorten(text: Column, n: int) -> Column:
    """The first ``n`` code points and ``...`` if there are more."""
    return F.when(F.length(text) <= n, text).otherwise(F.concat(F.substring(text, 1, n), F.lit("...")))


def lines(text: Column) -> Column:
    """Lines of a text: a carriage return before a line feed goes with it, one last empty line doesn't count."""
    parts = F.split(text, "\r?\n", -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def is_blank(text: Column) -> Column:
    return text.isNull() | text.rlike(r"(?U)\A\s*\z")


def strip(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, r"(?U)\A\s+|\s+\z", "")


def contains_literal(text: Column, needle: str, ignore_case: bool = False) -> Column:
    """Literal substring, never a pattern; folding lower-cases both sides."""
    return F.contains(F.lower(text), F.lit(needle.lower())) if ignore_case else F.contains(text, F.lit(needle))


def basename(path: Column) -> Column:
    return F.try_element_at(F.filter(F.split(strip(path), "/"), lambda s: s != ""), F.lit(-1))


def hyphen_name(path: Column) -> Column:
    """A path as one directory name: every slash a hyphen."""
    return F.replace(path, F.lit("/"), F.lit("-"))


def project_aliases(name: Column, path: Column) -> Column:
    """Other names of a project: base names and hyphen forms of its name and path, without its own name."""
    names = F.array(basename(name), basename(path), hyphen_name(name), hyphen_name(path))
    return F.array_sort(F.array_distinct(F.filter(names, lambda x: x.isNotNull() & (x != "") & (x != name))))


def mask_paths(text: Column) -> Column:
    """Local paths below the usual roots become [LOCAL_PATH]."""
    return F.regexp_replace(text, "/(Users|home|tmp|var|private)/[^\"' \t\n\r,}\\])(]*", "[LOCAL_PATH]")


def path_component(text: Column) -> Column:
    return F.regexp_replace(text, "[^A-Za-z0-9._-]", "_")


#: A word of these characters, or of none, needs no quotes.
SHELL_PLAIN = "A-Za-z0-9_@%+=:,./-"


def shell_quote(text: Column) -> Column:
    return F.when(text.rlike(f"\\A[{SHELL_PLAIN}]*\\z"), text).otherwise(F.concat(F.lit("'"), F.replace(text, F.lit("'"), F.lit("'\\''")), F.lit("'")))


def git_remote(url: Column) -> Column:
    return F.lower(F.regexp_replace(strip(url), r"(\.git)+\z", ""))


def first_non_empty(*columns: Column) -> Column:
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns])


def percent_decode(text: Column) -> Column:
    """Percent-decoding that keeps a bad escape as it is: good runs decode, the rest stays."""
    runs = F.regexp_extract_all(text, F.lit("((?:%[0-9A-Fa-f]{2})+|[^%]+|%)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda r: F.when(r.rlike("^(%[0-9A-Fa-f]{2})+$"), F.coalesce(F.try_url_decode(r), r)).otherwise(r)), "")


def remap_paths(text: Column, pairs: list[tuple[str, str]]) -> Column:
    """Replaces each key by its value, one after the other in key order."""
    out = text
    for old, new in sorted(pairs):
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


def shorten_tool_message(role: Column, text: Column, n: int = 2000) -> Column:
    """A tool's message for a transcript: its head and a mark that it goes on; other roles' stay whole."""
    return F.when((role == "tool") & (F.length(text) > n), F.concat(F.substring(text, 1, n), F.lit("\n... [truncated]"))).otherwise(text)


def shorten_output(text: Column, n: int = 2000) -> Column:
    """Long tool output of an event: its head, how much is left out, and the hash of the whole."""
    gone = (F.length(text) - n).cast("string")
    tail = F.concat(F.lit("\n... [truncated; omitted_chars="), gone, F.lit("; full_content_hash=sha256:"), F.sha2(text, 256), F.lit("]"))
    return F.when(F.length(text) <= n, text).otherwise(F.concat(F.substring(text, 1, n), tail))


def entropy(text: Column) -> Column:
    """Shannon entropy in bits over the characters of an ASCII text."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    counts = F.transform(F.array_distinct(chars), lambda d: F.size(F.filter(chars, lambda c: c == d)).cast("double"))
    total = F.length(text).cast("double")
    return F.aggregate(counts, F.lit(0.0), lambda a, n: a - n / total * F.log2(n / total))
