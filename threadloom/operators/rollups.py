"""Project and session rollups over messages, their orders, pages and totals.

Each rollup is one shuffle on its key with partial aggregation; pages are top-k, never a full sort.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.functions import text as T
from threadloom.sources.views import SESSION_KEY

PREVIEW_CHARS = 120


def _first_path() -> Column:
    place = F.struct("source_file", "line_index")
    return F.coalesce(F.min_by("project_path", F.when(F.col("project_path") != "", place)), F.lit(""))


def project_rollup(messages: DataFrame) -> DataFrame:
    return messages.groupBy("source", "project_name").agg(
        F.count(F.lit(1)).cast("int").alias("message_count"),
        F.countDistinct("session_id").cast("int").alias("session_count"),
        F.max("timestamp").alias("last_timestamp"),
        _first_path().alias("project_path"),
    )


def session_rollup(messages: DataFrame) -> DataFrame:
    """Counts by role, first and last time, and a preview: the first user text, shortened."""
    user = F.col("role") == "user"
    place = F.when(user, F.struct("timestamp", "source_file", "line_index"))
    return messages.groupBy(*SESSION_KEY).agg(
        F.count(F.lit(1)).cast("int").alias("message_count"),
        F.count_if(user).cast("int").alias("user_messages"),
        F.count_if(F.col("role") == "assistant").cast("int").alias("assistant_messages"),
        F.min("timestamp").alias("first_timestamp"),
        F.max("timestamp").alias("last_timestamp"),
        _first_path().alias("project_path"),
        F.coalesce(T.shorten(F.min_by("content", place), PREVIEW_CHARS), F.lit("")).alias("preview"),
    )


def rank_order(by: str = "timestamp", descending: bool = True, ties: tuple[str, ...] = ("project_name", "project_path", "source")) -> list[Column]:
    """Time then count, or count then time, both in the order asked for; ties ascend always."""
    first = ("last_timestamp", "message_count") if by == "timestamp" else ("message_count", "last_timestamp")
    return [F.desc(c) if descending else F.asc(c) for c in first] + [F.asc(c) for c in ties]


def project_order(by: str = "timestamp", descending: bool = True) -> list[Column]:
    return rank_order(by, descending)


def session_order(by: str = "timestamp", descending: bool = True) -> list[Column]:
    return rank_order(by, descending, ("session_id", "project_name", "project_path", "source"))


def page(rows: DataFrame, order: list[Column], limit: int | None, offset: int = 0) -> DataFrame:
    """Rows ``offset`` to ``offset + limit`` of an order; offsets past the end give none."""
    out = rows.orderBy(*order)
    out = out.offset(offset) if offset else out
    return out if limit is None else out.limit(limit)


def page_metadata(rows: DataFrame, limit: int | None, offset: int = 0) -> DataFrame:
    """One row: total, returned, next_offset, next_page (never without a limit)."""
    total = F.count(F.lit(1))
    got = F.greatest(F.lit(0), F.least(total - offset, F.lit(limit) if limit is not None else total))
    after = F.least(total, F.lit(offset)) + got
    more = (after < total) if limit is not None else F.lit(False)
    return rows.agg(total.alias("total"), got.cast("long").alias("returned"), after.cast("long").alias("next_offset"), more.alias("next_page"))


class AgeOutOfRange(ValueError):
    """An age that no session has, or the newest session's without asking for it."""


def check_ages(sessions: DataFrame, newest: int, oldest: int, include_newest: bool = False) -> None:
    """Raises ``AgeOutOfRange``; ages are never clamped."""
    if newest == oldest == 0 and not include_newest:
        raise AgeOutOfRange("age 0 is the newest session: include_newest is needed")
    total = sessions.limit(oldest + 1).count()
    if oldest > total - 1:
        raise AgeOutOfRange(f"{total} sessions in scope, ages up to {max(total - 1, 0)}, asked for {oldest}")


def cwd_metadata(rows: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """As ``page_metadata`` for the answer over all sources: a next page is told without a look at the limit."""
    total = F.count(F.lit(1))
    after = F.lit(offset) + F.greatest(F.lit(0), F.least(total - offset, F.lit(limit)))
    return rows.agg(total.alias("total"), after.cast("long").alias("next_offset"), (after < total).alias("next_page"))


def continuation(program: str, command: str, options: list[tuple[str, str | int | None]], next_offset: int) -> str:
    """The command line that asks for the next page; options without a value are left out."""
    quote = lambda s: s if re.fullmatch(f"[{T.SHELL_PLAIN}]*", s) else "'" + s.replace("'", "'\\''") + "'"
    parts = [program, command, *[f"--{k} {quote(str(v))}" for k, v in options if v is not None], f"--offset {next_offset}"]
    return " ".join(parts)


def totals(messages: DataFrame) -> DataFrame:
    return messages.agg(F.count(F.lit(1)).alias("total_messages"), F.countDistinct(*SESSION_KEY).alias("total_sessions"))


def ages(sessions: DataFrame) -> DataFrame:
    """``age``: 0 for the newest session. Ranks come from counts per hour plus the rank inside the hour, so no
    task sees all sessions."""
    order = [F.desc("last_timestamp"), F.desc("message_count"), F.asc("session_id"), F.asc("project_name"), F.asc("project_path"), F.asc("source")]
    rows = sessions.withColumn("_hour", F.substring("last_timestamp", 1, 13))
    counts = rows.groupBy("_hour").count()
    newer = Window.orderBy(F.desc("_hour")).rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("_hour", F.coalesce(F.sum("count").over(newer), F.lit(0)).alias("_newer"))
    inside = F.row_number().over(Window.partitionBy("_hour").orderBy(*order))
    return rows.join(base, "_hour").withColumn("age", (F.col("_newer") + inside - 1).cast("long")).drop("_hour", "_newer")


def recall(sessions: DataFrame, messages: DataFrame, newest: int, oldest: int) -> DataFrame:
    """Messages of the sessions with ages newest..oldest, oldest session last; a top-k of sessions, then a semi join."""
    order = [F.desc("last_timestamp"), F.desc("message_count"), F.asc("session_id"), F.asc("project_name"), F.asc("project_path"), F.asc("source")]
    top = page(sessions, order, oldest - newest + 1, newest)
    chosen = top.withColumn("age", (F.row_number().over(Window.orderBy(*order)) + newest - 1).cast("long")).select(*SESSION_KEY, "age")
    # at most oldest - newest + 1 rows: the caller's bound
    return messages.join(F.broadcast(chosen), list(SESSION_KEY))
