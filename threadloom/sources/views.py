"""Canonical tables of the engine, here mapped from the driver's tables: messages, store events, claims.

``MESSAGES_SQL`` and the others are the same mappings as DuckDB common table expressions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed order of the sources; a scan of all of them concatenates in this order.
SOURCES = ("claude", "codex", "cursor", "grok", "pi")
MESSAGE_COLUMNS = (
    "source", "project_name", "project_path", "session_id", "role", "content", "model", "timestamp",
    "is_subagent", "msg_type", "input_tokens", "output_tokens", "source_file", "line_index",
)
SESSION_KEY = ("source", "project_name", "session_id")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per message; timestamps stay strings, their order is that of their bytes."""
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    conv = F.col("conv_id")
    stamp = F.timestamp_seconds(F.lit(1704067200) + (conv % 50) * 3600 + F.col("turn") * 60)
    session = F.concat(F.lit("conv-"), conv)
    project = F.concat(F.lit("/proj/p"), conv % 7)
    said = F.col("role") == "assistant"
    return c.select(
        F.element_at(F.array(*map(F.lit, SOURCES)), (conv % 5 + 1).cast("int")).alias("source"),
        project.alias("project_name"),
        F.when(conv % 3 == 0, F.lit("")).otherwise(F.concat(F.lit("/home/dev"), project)).alias("project_path"),
        session.alias("session_id"),
        "role",
        F.col("text").alias("content"),
        F.when(said, F.concat(F.lit("m"), conv % 3)).otherwise(F.lit("")).alias("model"),
        F.date_format(stamp, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"),
        (conv % 10 == 0).alias("is_subagent"),
        F.col("role").alias("msg_type"),
        F.when(said, F.lit(0)).otherwise(F.length("text")).cast("long").alias("input_tokens"),
        F.when(said, F.length("text")).otherwise(F.lit(0)).cast("long").alias("output_tokens"),
        F.concat(session, F.lit(".jsonl")).alias("source_file"),
        F.col("turn").cast("long").alias("line_index"),
    )


MESSAGES_SQL = """messages AS (
  SELECT (['claude','codex','cursor','grok','pi'])[conv_id % 5 + 1] AS source, '/proj/p' || (conv_id % 7) AS project_name,
    CASE WHEN conv_id % 3 = 0 THEN '' ELSE '/home/dev/proj/p' || (conv_id % 7) END AS project_path,
    'conv-' || conv_id AS session_id, role, text AS content,
    CASE WHEN role = 'assistant' THEN 'm' || (conv_id % 3) ELSE '' END AS model,
    strftime(make_timestamp((1704067200 + (conv_id % 50) * 3600 + turn * 60) * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS timestamp,
    conv_id % 10 = 0 AS is_subagent, role AS msg_type,
    CASE WHEN role = 'assistant' THEN 0 ELSE length(text) END::BIGINT AS input_tokens,
    CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END::BIGINT AS output_tokens,
    'conv-' || conv_id || '.jsonl' AS source_file, turn::BIGINT AS line_index
  FROM conversations
)"""

#: Activity kinds of the driver's events as event types of the store.
EVENT_TYPES = {"signup": "session_start", "view": "assistant_turn", "click": "user_turn", "purchase": "tool_call", "error": "tool_result"}


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Store events: one row per event with its project, session, type, role, time and text."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    kinds = F.create_map(*[F.lit(x) for pair in EVENT_TYPES.items() for x in pair])
    kind = F.coalesce(F.try_element_at(kinds, F.col("event_type")), F.lit("unknown_raw_event"))
    role = F.when(kind == "user_turn", "user").when(kind == "assistant_turn", "assistant").when(kind.isin("tool_call", "tool_result"), "tool").otherwise("system")
    return e.select(
        F.concat(F.lit("proj-"), F.col("user_id") % 10).alias("project_id"),
        F.element_at(F.array(*map(F.lit, SOURCES)), (F.col("user_id") % 5 + 1).cast("int")).alias("source"),
        F.concat(F.lit("u"), F.col("user_id")).alias("source_session_id"),
        F.when(F.col("event_id") % 4 != 0, F.concat(F.lit("e"), F.col("event_id"))).alias("source_event_id"),
        kind.alias("event_type"),
        role.alias("role"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("timestamp"),
        F.col("props").alias("content_text"),
        F.col("event_id").alias("seq"),
    )


EVENTS_SQL = """store AS (
  SELECT 'proj-' || (user_id % 10) AS project_id, (['claude','codex','cursor','grok','pi'])[user_id % 5 + 1] AS source,
    'u' || user_id AS source_session_id, CASE WHEN event_id % 4 <> 0 THEN 'e' || event_id END AS source_event_id,
    CASE event_type WHEN 'signup' THEN 'session_start' WHEN 'view' THEN 'assistant_turn' WHEN 'click' THEN 'user_turn'
      WHEN 'purchase' THEN 'tool_call' WHEN 'error' THEN 'tool_result' ELSE 'unknown_raw_event' END AS event_type,
    CASE event_type WHEN 'click' THEN 'user' WHEN 'view' THEN 'assistant' WHEN 'purchase' THEN 'tool' WHEN 'error' THEN 'tool' ELSE 'system' END AS role,
    strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') AS timestamp, props AS content_text, event_id AS seq
  FROM events
)"""


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learned memory: one claim per benchmark item, with two references to events."""
    b = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    item = F.col("item_id")
    return b.select(
        F.concat(F.lit("mem-"), item).alias("memory_id"),
        F.concat(F.lit("proj-"), item % 10).alias("project_id"),
        F.element_at(F.array(*map(F.lit, ("fact", "preference", "Work_Flow", "secret-note", "bad kind!"))), (item % 5 + 1).cast("int")).alias("kind"),
        F.col("text").alias("claim"),
        ((item % 10) / F.lit(10.0)).alias("confidence"),
        F.when(item % 7 == 0, F.lit("rejected")).otherwise(F.lit("pending")).alias("status"),
        F.array(F.concat(F.lit("e"), item), F.concat(F.lit("e"), item * 97)).alias("evidence_refs"),
    )


CLAIMS_SQL = """claims AS (
  SELECT 'mem-' || item_id AS memory_id, 'proj-' || (item_id % 10) AS project_id,
    (['fact','preference','Work_Flow','secret-note','bad kind!'])[item_id % 5 + 1] AS kind, text AS claim,
    (item_id % 10)::DOUBLE / 10.0::DOUBLE AS confidence, CASE WHEN item_id % 7 = 0 THEN 'rejected' ELSE 'pending' END AS status,
    ['e' || item_id, 'e' || (item_id * 97)] AS evidence_refs
  FROM benchmark
)"""
