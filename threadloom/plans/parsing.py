"""Registered queries: transcripts written from conversations in each layout and parsed back."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadloom.plans.reading import M
from threadloom.sources import capture as C
from threadloom.sources import transcripts as P
from threadloom.sources import views as V

QUERIES, ORACLES = {}, {}


def _rows(m, path, *rows):
    """(path, line_index, raw): each of ``rows`` is (line number, JSON struct or raw text) per message."""
    lines = F.array(*[F.struct(F.lit(0).cast("long").alias("n") if n is None else n.cast("long").alias("n"), raw.alias("raw")) for n, raw in rows])
    return m.select(path.alias("path"), F.explode(lines).alias("l")).select("path", F.col("l.n").alias("line_index"), F.col("l.raw").alias("raw"))


def _json(**fields):
    return F.to_json(F.struct(*[(f if not isinstance(f, str) else F.lit(f)).alias(k) for k, f in fields.items()]))


def _obj(**fields):
    return F.struct(*[(f if not isinstance(f, str) else F.lit(f)).alias(k) for k, f in fields.items()])


def _talk(s, d):
    return V.messages(s, d).where("role in ('user', 'assistant')")


OUT = ("session_id", "role", "content", "timestamp")
SQL = M + " SELECT session_id, role, content, timestamp FROM messages WHERE role IN ('user', 'assistant')"


def _claude_rows(m):
    turn = F.col("line_index") * 2
    good = _json(type=F.col("role"), sessionId=F.col("session_id"), timestamp=F.col("timestamp"), cwd=F.when(F.col("line_index") % 2 == 0, F.col("project_name")),
                 message=_obj(role=F.col("role"), content=F.array(_obj(type="text", text=F.col("content"))), usage=_obj(input_tokens=F.col("input_tokens"), output_tokens=_obj(total=F.col("output_tokens")))))
    return _rows(m, F.concat(F.lit("/h/.claude/projects/p/"), "source_file"), (turn, good), (turn + 1, F.lit('{"type": "user", "broken')))


def parse_claude(s, d):
    return P.parse_claude(_claude_rows(_talk(s, d))).select(*OUT, "input_tokens", "output_tokens")


def _codex_rows(m):
    head = _json(type="session_meta", payload=_obj(id=F.col("session_id"), cwd=F.col("project_name"), model_provider="m"))
    text = F.when(
        F.col("role") == "user", _json(type="event_msg", timestamp=F.col("timestamp"), payload=_obj(type="user_message", message=F.col("content")))
    ).otherwise(_json(type="response_item", timestamp=F.col("timestamp"), payload=_obj(role="assistant", content=F.array(_obj(type="output_text", text=F.col("content"))))))
    return _rows(m, F.concat(F.lit("/h/.codex/sessions/"), "source_file"), (None, head), (F.col("line_index") + 1, text)).distinct()


def parse_codex(s, d):
    return P.parse_codex(_codex_rows(_talk(s, d))).select(*OUT)


def parse_cursor(s, d):
    m = _talk(s, d)
    row = _json(role=F.col("role"), timestamp=F.col("timestamp"), message=_obj(content=F.array(_obj(type="thinking", text="hidden"), _obj(type="text", text=F.col("content")))))
    return P.parse_cursor(_rows(m, F.concat(F.lit("/h/.cursor/projects/p/agent-transcripts/"), "session_id", F.lit("/"), "source_file"), (F.col("line_index"), row))).select(*OUT)


def parse_grok(s, d):
    m = _talk(s, d)
    half = F.floor(F.length("content") / 2).cast("int")
    ms = F.unix_millis(F.to_timestamp("timestamp"))

    def row(text):
        kind = F.when(F.col("role") == "user", "user_message_chunk").otherwise("agent_message_chunk")
        return _json(method="session/update", params=_obj(sessionId=F.col("session_id"), _meta=_obj(agentTimestampMs=ms), update=_obj(sessionUpdate=kind, content=_obj(type="text", text=text))))

    whole, first, rest = row(F.col("content")), row(F.substring("content", 1, half)), row(F.substr("content", half + 1))
    user = F.col("role") == "user"
    turn = F.col("line_index") * 2
    rows = _rows(m, F.concat(F.lit("/h/.grok/sessions/%2Fhome%2Fme/"), "session_id", F.lit("/updates.jsonl")), (turn, F.when(user, whole).otherwise(first)), (turn + 1, F.when(user, F.lit("not json")).otherwise(rest)))
    return P.parse_grok(rows).select(*OUT)


def parse_pi(s, d):
    m = _talk(s, d)
    head = _json(type="session", id=F.col("session_id"), cwd=F.col("project_name"))
    row = _json(type="message", timestamp=F.col("timestamp"), message=_obj(role=F.col("role"), content=F.array(_obj(type="text", text=F.col("content")))))
    tool = _json(type="message", timestamp=F.col("timestamp"), message=_obj(role="toolResult", content="x"))
    turn = F.col("line_index") * 2
    return P.parse_pi(_rows(m, F.concat(F.lit("/h/.pi/agent/sessions/--p--/1_"), "source_file"), (None, head), (turn + 1, row), (turn + 2, tool)).distinct()).select(*OUT)


def capture_events(s, d):
    return C.capture(_claude_rows(_talk(s, d)), "claude", "proj:v1:test").select("source_session_id", "event_type", "role", "timestamp", "content_text", "content_hash", "parent_hash")


# in grok's layout the chunks between two user messages are one answer
GROK_SQL = M + """, talk AS (SELECT *, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY line_index) AS island FROM messages WHERE role IN ('user', 'assistant'))
SELECT session_id, role, string_agg(content, '' ORDER BY line_index) AS content, min(timestamp) AS timestamp FROM talk GROUP BY session_id, role, island"""
QUERIES |= {"parse_claude": parse_claude, "parse_codex": parse_codex, "parse_cursor": parse_cursor, "parse_grok_coalesce": parse_grok, "parse_pi": parse_pi, "capture_events": capture_events}
ORACLES |= {
    "parse_claude": M + " SELECT session_id, role, content, timestamp, input_tokens, output_tokens FROM messages WHERE role IN ('user', 'assistant')",
    "parse_codex": SQL, "parse_cursor": SQL, "parse_grok_coalesce": GROK_SQL, "parse_pi": SQL,
    "capture_events": M + """ SELECT session_id AS source_session_id, role || '_turn' AS event_type, role, timestamp, content AS content_text, 'sha256:' || sha256(content) AS content_hash,
    lag('sha256:' || sha256(content)) OVER (PARTITION BY session_id ORDER BY line_index) AS parent_hash FROM messages WHERE role IN ('user', 'assistant')""",
}
