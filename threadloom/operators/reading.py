"""Reading messages: filters, newest-first windows put back in time order, ranges, transcripts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadloom.functions.text import shorten_tool_message
from threadloom.sources.views import SESSION_KEY

CHRONOLOGICAL = ("timestamp", "source_file", "line_index", "session_id", "source")
API_COLUMNS = ("source", "project_name", "session_id", "role", "content", "model", "timestamp", "is_subagent", "msg_type", "input_tokens", "output_tokens")


def select_messages(messages: DataFrame, source: str | None = None, projects: list[str] | None = None, sessions: list[str] | None = None) -> DataFrame:
    """Source equality, project and session membership; none or an empty list means all."""
    out = messages
    if source is not None:
        out = out.where(F.col("source") == source)
    if projects:
        out = out.where(F.col("project_name").isin(projects))
    if sessions:
        out = out.where(F.col("session_id").isin(sessions))
    return out


def newest_window(messages: DataFrame, limit: int | None, offset: int = 0) -> DataFrame:
    """The ``limit`` newest messages after skipping ``offset`` newest ones, in time order."""
    out = messages.orderBy(*[F.desc(c) for c in CHRONOLOGICAL])
    out = out.offset(offset) if offset else out
    out = out if limit is None else out.limit(limit)
    return out.orderBy(*CHRONOLOGICAL)


def oldest_page(messages: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    out = messages.orderBy(*CHRONOLOGICAL)
    return (out.offset(offset) if offset else out).limit(limit)


def api(messages: DataFrame) -> DataFrame:
    return messages.select(*API_COLUMNS)


def with_session_counts(messages: DataFrame) -> DataFrame:
    counts = messages.groupBy(*SESSION_KEY).agg(F.count(F.lit(1)).alias("session_messages"))
    return messages.join(counts, list(SESSION_KEY))


def by_session_count(messages: DataFrame) -> DataFrame:
    """All messages with their session's count, those of the largest sessions first, equal counts in time order."""
    return with_session_counts(messages).orderBy(F.desc("session_messages"), *CHRONOLOGICAL)


def index_range(messages: DataFrame, first: int, end: int) -> DataFrame:
    """Messages ``first`` to ``end`` (exclusive) of each session in time order, with their index."""
    own = Window.partitionBy(*SESSION_KEY).orderBy(*CHRONOLOGICAL)
    return messages.withColumn("message_index", (F.row_number().over(own) - 1).cast("long")).where((F.col("message_index") >= first) & (F.col("message_index") < end))


def latest_session_window(messages: DataFrame, n: int) -> DataFrame:
    """The last ``n`` messages of the session that holds the newest message."""
    newest = messages.orderBy(F.desc("timestamp"), F.desc("source_file"), F.desc("line_index"), F.asc("session_id"), F.asc("project_name"), F.asc("source")).limit(1)
    # one row
    return newest_window(messages.join(F.broadcast(newest.select(*SESSION_KEY)), list(SESSION_KEY), "left_semi"), n)


def session_inputs(messages: DataFrame) -> DataFrame:
    """One text per session for a reader with little room: a header, then a line per message in time order; long tool messages are cut."""
    line = F.concat(F.lit("["), "timestamp", F.lit("] "), "role", F.lit(": "), shorten_tool_message(F.col("role"), F.col("content")), F.lit("\n"))
    rows = F.array_sort(F.collect_list(F.struct(*CHRONOLOGICAL, line.alias("line"))))
    said = F.array_join(F.transform(rows, lambda r: r["line"]), "")
    return messages.groupBy(*SESSION_KEY).agg(F.concat(F.lit("=== Session: "), "session_id", F.lit(" ===\n"), said).alias("input"))


def transcripts(messages: DataFrame) -> DataFrame:
    """One text per project: a header where the session changes, then a line per message, by session in time order.

    The text is the result, so a project's must fit a row (2 GB); its pieces are put together per session first.
    """
    line = F.concat(F.lit("- ["), "timestamp", F.lit("] "), "role", F.lit(": "), "content", F.lit("\n"))
    rows = F.array_sort(F.collect_list(F.struct(*CHRONOLOGICAL, line.alias("line"))))
    said = F.array_join(F.transform(rows, lambda r: r["line"]), "")
    head = F.concat(F.lit("\n## Session "), "session_id", F.lit(" ("), "source", F.lit(", "), "project_name", F.lit(")\n"))
    own = messages.groupBy(*SESSION_KEY).agg(F.concat(head, said).alias("text"))
    parts = F.array_sort(F.collect_list(F.struct("session_id", "source", "text")))
    return own.groupBy("project_name").agg(F.array_join(F.transform(parts, lambda r: r["text"]), "").alias("transcript"))
