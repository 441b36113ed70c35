"""Literal line search, ranked sessions, and bounded message windows around matches.

Texts without the needle are dropped ahead of line splitting; lines are judged inside the row and only matches are
exploded. Retrieval ranks and limits sessions first; messages are read for the few that survive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.functions import ids
from threadloom.functions import text as T
from threadloom.operators.reading import CHRONOLOGICAL
from threadloom.sources.views import SESSION_KEY

SNIPPET_CHARS = 500
MAX_SESSIONS, BEFORE, AFTER, CAP = 3, 3, 12, 24


def line_matches(rows: DataFrame, column: str, needle: str, ignore_case: bool = False, context: int = 0) -> DataFrame:
    """One row per matching line of ``column``: ``line`` from 1, ``snippet``, ``before`` and ``after`` lines.

    A line matches once however often it holds the needle; a needle with a line feed matches none.
    """
    hit = lambda x: T.contains_literal(x, needle, ignore_case)
    found = rows.where(hit(F.col(column))).withColumn("_lines", T.lines(F.col(column)))
    first = lambda i: F.greatest(i - context, F.lit(0))
    row = lambda x, i: F.struct(
        (i + 1).alias("line"),
        x.alias("text"),
        (F.slice("_lines", first(i) + 1, i - first(i)) if context else F.array().cast("array<string>")).alias("before"),
        (F.slice("_lines", i + 2, F.lit(context)) if context else F.array().cast("array<string>")).alias("after"),
    )
    matches = F.filter(F.transform("_lines", row), lambda m: hit(m["text"]))
    out = found.select("*", F.explode(matches).alias("_m")).drop("_lines")
    return out.select(
        *rows.columns, F.col("_m.line").alias("line"), T.shorten(F.col("_m.text"), SNIPPET_CHARS).alias("snippet"), F.col("_m.before").alias("before"), F.col("_m.after").alias("after")
    )


def message_citation() -> Column:
    """Id of a matching line of a message, by the message's fields and ``line``, the number of the line."""
    return ids.citation(*[F.col(c) for c in ("source", "project_name", "session_id", "role", "timestamp", "line", "content")])


def rank_sessions(matches: DataFrame) -> DataFrame:
    """Per session: matches, latest time and first citation (by time, citation, line)."""
    return matches.groupBy(*SESSION_KEY).agg(
        F.count(F.lit(1)).alias("matches"), F.max("timestamp").alias("latest"), F.min(F.struct("timestamp", "citation", "line"))["citation"].alias("first_citation")
    )


def top_sessions(groups: DataFrame, provider: DataFrame, k: int = MAX_SESSIONS, pins: list[str] | None = None) -> DataFrame:
    """The ``k`` best readable sessions with ``rank`` from 1; pins restrict them."""
    order = [F.desc("matches"), F.desc("latest"), *[F.asc(c) for c in SESSION_KEY]]
    if pins:
        groups = groups.where(F.col("session_id").isin(pins))
    readable = groups.join(provider.select(*SESSION_KEY).distinct(), list(SESSION_KEY), "left_semi")
    best = readable.orderBy(*order).limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def unreadable(groups: DataFrame, provider: DataFrame) -> DataFrame:
    return groups.join(provider.select(*SESSION_KEY).distinct(), list(SESSION_KEY), "left_anti").withColumn("reason", F.lit("no provider messages"))


def anchors(matches: DataFrame, provider: DataFrame, best: DataFrame, needle: str) -> tuple[DataFrame, DataFrame]:
    """(rank, message_index) of each match's message, and the indexed messages of the best sessions.

    A match's message: same time and text with the needle; else same time; else with the needle; else the first
    from its time on; else the last.
    """
    key = list(SESSION_KEY)
    chosen = F.broadcast(best.select(*key, "rank"))  # at most k rows
    own = Window.partitionBy(*key).orderBy(*CHRONOLOGICAL)
    indexed = provider.join(chosen, key).withColumn("message_index", (F.row_number().over(own) - 1).cast("long"))
    holds = T.contains_literal(F.col("content"), needle, True)
    none = F.lit(None).cast("long")
    # one row a session and time: its first message, the first with the needle, the last, and whether a match asks for it
    said = indexed.select("rank", F.col("timestamp").alias("at"), F.col("message_index").alias("i"), F.when(holds, F.col("message_index")).alias("held"), F.lit(False).alias("asked"))
    asked = matches.join(chosen, key).select("rank", F.col("timestamp").alias("at"), none.alias("i"), none.alias("held"), F.lit(True).alias("asked"))
    times = said.union(asked).groupBy("rank", "at").agg(F.min("i").alias("first"), F.min("held").alias("held"), F.max("i").alias("last"), F.max("asked").alias("asked"))
    whole = Window.partitionBy("rank")
    later = whole.orderBy("at").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    anchor = F.coalesce("held", "first", F.min("held").over(whole), F.min("first").over(later), F.max("last").over(whole))
    found = times.withColumn("anchor", anchor).where("asked")
    return found.where("anchor is not null").select("rank", "anchor").distinct(), indexed


def windows(found: DataFrame, indexed: DataFrame, before: int = BEFORE, after: int = AFTER, cap: int = CAP) -> DataFrame:
    """Messages around the anchors, at most ``cap`` a session: anchors first, then by index; ``truncated`` tells."""
    around = found.select("rank", F.explode(F.sequence(F.greatest(F.lit(0), F.col("anchor") - before), F.col("anchor") + after)).alias("message_index"), "anchor")
    wanted = around.groupBy("rank", "message_index").agg(F.max(F.col("message_index") == F.col("anchor")).alias("is_anchor"))
    rows = indexed.join(wanted, ["rank", "message_index"])
    own = Window.partitionBy("rank")
    rows = rows.withColumn("_place", F.row_number().over(own.orderBy(F.desc("is_anchor"), "message_index"))).withColumn("truncated", F.count(F.lit(1)).over(own) > cap)
    return rows.where(F.col("_place") <= cap).drop("_place")


def check_pins(groups: DataFrame, pins: list[str]) -> None:
    """Raises ``LookupError`` if a pinned session has no match."""
    found = {r.session_id for r in groups.where(F.col("session_id").isin(pins)).select("session_id").distinct().collect()}  # at most the pins
    if lost := [p for p in pins if p not in found]:
        raise LookupError(f"pinned_session_not_found: {lost[0]}")


def sessions_with_page(best: DataFrame, rows: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """Every ranked session with the messages it has on a page over all windows; sessions without any keep an empty list."""
    page = flat_page(rows, limit, offset).groupBy("rank").agg(F.array_sort(F.collect_list(F.struct("message_index", "role", "content"))).alias("messages"))
    empty = F.array().cast("array<struct<message_index bigint, role string, content string>>")
    return best.join(page, "rank", "left").withColumn("messages", F.coalesce("messages", empty))


def flat_metadata(rows: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """One row: total, next_page, next_offset; without a next page the offset stays what it was."""
    total = F.count(F.lit(1))
    end = F.least(total, F.least(total, F.lit(offset)) + F.lit(limit))
    more = F.lit(limit > 0) & (end < total)
    return rows.agg(total.alias("total"), more.alias("next_page"), F.when(more, end).otherwise(F.lit(offset)).cast("long").alias("next_offset"))


def flat_page(rows: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """A page over the windows of all ranked sessions, in rank and message order, with the total."""
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    page = rows.orderBy("rank", "message_index")
    page = (page.offset(offset) if offset else page).limit(limit)
    # one row
    return page.crossJoin(F.broadcast(total))
