"""Registered queries: line search and retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadloom.operators import search as S
from threadloom.plans.reading import M
from threadloom.sources import views as V

QUERIES, ORACLES = {}, {}
NEEDLE = "the of"


def _add(name, query, sql):
    QUERIES[name], ORACLES[name] = query, sql


def _m(spark, d):
    return V.messages(spark, d)


# lines of every message, numbered from 1, without one empty line at the end
LINES_SQL = M + """, split AS (SELECT *, string_split(replace(content, chr(13) || chr(10), chr(10)), chr(10)) AS raw FROM messages),
lined AS (SELECT *, CASE WHEN raw[len(raw)] = '' THEN raw[1:len(raw) - 1] ELSE raw END AS ls FROM split),
lines AS (SELECT * EXCLUDE (raw), unnest(ls) AS text, unnest(range(1, len(ls) + 1)) AS line FROM lined)"""
SNIP = "CASE WHEN length(text) <= 500 THEN text ELSE substring(text, 1, 500) || '...' END"
CITE = "'message:v1:' || sha256(concat_ws(chr(10), source, project_name, session_id, role, timestamp, line::VARCHAR, content))"


def _find(needle, ignore=False, context=0, where="true", columns=("session_id", "line_index", "line", "snippet")):
    return lambda s, d: S.line_matches(_m(s, d).where(where), "content", needle, ignore, context).select(*columns)


_add("find_literal", _find("The "), LINES_SQL + f" SELECT session_id, line_index, line::INT AS line, {SNIP} AS snippet FROM lines WHERE contains(text, 'The ')")
_add("find_ignore_case", _find("tHe OF", True), LINES_SQL + f" SELECT session_id, line_index, line::INT AS line, {SNIP} AS snippet FROM lines WHERE contains(lower(text), 'the of')")
_add(
    "find_context_lines",
    lambda s, d: S.line_matches(_m(s, d), "content", NEEDLE, True, 1).select("session_id", "line_index", "line", F.array_join("before", "\n").alias("before"), F.array_join("after", "\n").alias("after")),
    LINES_SQL + " SELECT session_id, line_index, line::INT AS line, CASE WHEN line > 1 THEN ls[line - 1] ELSE '' END AS before, CASE WHEN line < len(ls) THEN ls[line + 1] ELSE '' END AS after FROM lines WHERE contains(lower(text), 'the of')",
)
_add("find_role_event_filters", _find("the", True, 0, "role = 'user' and source in ('codex', 'pi')"), LINES_SQL + f" SELECT session_id, line_index, line::INT AS line, {SNIP} AS snippet FROM lines WHERE contains(lower(text), 'the') AND role = 'user' AND source IN ('codex', 'pi')")


def find_all(messages, claims, needle: str, source: str | None = None):
    """Matches in messages and, unless a source filter is set, in active learned memory."""
    found = S.line_matches(messages if source is None else messages.where(F.col("source") == source), "content", needle, True)
    found = found.select(F.lit("message").alias("kind"), S.message_citation().alias("citation"), "line", "snippet", "timestamp")
    if source is not None:
        return found
    known = S.line_matches(claims.where("status <> 'rejected'"), "claim", needle, True)
    return found.unionByName(known.select(F.lit("memory").alias("kind"), F.col("memory_id").alias("citation"), "line", "snippet", F.lit("").alias("timestamp")))


_add(
    "find_with_learned_memory",
    lambda s, d: find_all(_m(s, d), V.claims(s, d), "the"),
    LINES_SQL + f", {V.CLAIMS_SQL}, known AS (SELECT memory_id, unnest(string_split(claim, chr(10))) AS text, unnest(range(1, len(string_split(claim, chr(10))) + 1)) AS line FROM claims WHERE status <> 'rejected')"
    f" SELECT 'message' AS kind, {CITE} AS citation, line::INT AS line, {SNIP} AS snippet, timestamp FROM lines WHERE contains(lower(text), 'the')"
    f" UNION ALL SELECT 'memory', memory_id, line::INT, {SNIP}, '' FROM known WHERE contains(lower(text), 'the')",
)
_add(
    "find_line_format",
    lambda s, d: S.line_matches(_m(s, d), "content", NEEDLE, True).select(F.concat_ws("\t", S.message_citation(), F.col("line").cast("string"), "source", "snippet").alias("value")),
    LINES_SQL + f" SELECT concat_ws(chr(9), {CITE}, line::VARCHAR, source, {SNIP}) AS value FROM lines WHERE contains(lower(text), 'the of')",
)


# retrieval: every twentieth session is known to the store only
def _store_matches(spark, d, needle=NEEDLE):
    return S.line_matches(_m(spark, d), "content", needle, True).withColumn("citation", S.message_citation())


def _provider(spark, d):
    return _m(spark, d).where("cast(substring(session_id, 6) as bigint) % 20 <> 19")


GROUPS_SQL = LINES_SQL + f""", matches AS (SELECT *, {CITE} AS citation FROM lines WHERE contains(lower(text), 'the of')),
provider AS (SELECT * FROM messages WHERE substring(session_id, 6)::BIGINT % 20 <> 19),
groups AS (SELECT source, project_name, session_id, count(*) AS matches, max(timestamp) AS latest, first(citation ORDER BY timestamp, citation, line) AS first_citation
  FROM matches GROUP BY source, project_name, session_id),
best AS (SELECT *, (row_number() OVER (ORDER BY matches DESC, latest DESC, source, project_name, session_id))::INT AS rank FROM groups SEMI JOIN provider USING (source, project_name, session_id)
  WHERE {{pins}} ORDER BY rank LIMIT {{k}}),
indexed AS (SELECT p.*, b.rank, row_number() OVER (PARTITION BY b.rank ORDER BY p.timestamp, p.source_file, p.line_index) - 1 AS message_index
  FROM provider p JOIN best b USING (source, project_name, session_id)),
times AS (SELECT DISTINCT b.rank, m.timestamp AS at_ts FROM matches m JOIN best b USING (source, project_name, session_id)),
anchors AS (SELECT DISTINCT rank, anchor FROM (SELECT t.rank, t.at_ts, coalesce(
    min(message_index) FILTER (timestamp = at_ts AND contains(lower(content), 'the of')), min(message_index) FILTER (timestamp = at_ts),
    min(message_index) FILTER (contains(lower(content), 'the of')), min(message_index) FILTER (timestamp >= at_ts), max(message_index)) AS anchor
  FROM times t JOIN indexed i ON t.rank = i.rank GROUP BY t.rank, t.at_ts)),
wanted AS (SELECT i.*, bool_or(i.message_index = a.anchor) OVER (PARTITION BY i.rank, i.message_index) AS is_anchor, row_number() OVER (PARTITION BY i.rank, i.message_index) AS once
  FROM indexed i JOIN anchors a ON i.rank = a.rank AND i.message_index BETWEEN a.anchor - {{before}} AND a.anchor + {{after}}),
placed AS (SELECT *, row_number() OVER (PARTITION BY rank ORDER BY is_anchor DESC, message_index) AS place, count(*) OVER (PARTITION BY rank) > {{cap}} AS truncated FROM wanted WHERE once = 1),
windows AS (SELECT * FROM placed WHERE place <= {{cap}})"""


def _sql(tail, k=3, before=3, after=12, cap=24, pins="true"):
    return GROUPS_SQL.format(k=k, before=before, after=after, cap=cap, pins=pins) + tail


def _windows(spark, d, k=3, before=3, after=12, cap=24, pins=None, needle=NEEDLE):
    matches, provider = _store_matches(spark, d, needle), _provider(spark, d)
    best = S.top_sessions(S.rank_sessions(matches), provider, k, pins)
    found, indexed = S.anchors(matches, provider, best, needle)
    return S.windows(found, indexed, before, after, cap)


_add("retrieve_rank", lambda s, d: S.top_sessions(S.rank_sessions(_store_matches(s, d)), _provider(s, d), 10), _sql(" SELECT * FROM best", 10))
_add("retrieve_matches", lambda s, d: _store_matches(s, d).select("session_id", "citation", "line", "snippet", "timestamp"), _sql(f" SELECT session_id, citation, line::INT AS line, {SNIP} AS snippet, timestamp FROM matches"))


def _anchors(s, d):
    matches, provider = _store_matches(s, d), _provider(s, d)
    return S.anchors(matches, provider, S.top_sessions(S.rank_sessions(matches), provider, 10), NEEDLE)[0]


_add("retrieve_anchor", _anchors, _sql(" SELECT rank, anchor FROM anchors", 10))
_add("retrieve_window_capped", lambda s, d: _windows(s, d, 5, 1, 2, 3).select("rank", "session_id", "message_index", "is_anchor", "truncated", "content"), _sql(" SELECT rank, session_id, message_index, is_anchor, truncated, content FROM windows", 5, 1, 2, 3))
_add(
    "retrieve_flat_page",
    lambda s, d: S.flat_page(_windows(s, d), 72, 2).select("rank", "source", "session_id", "message_index", "is_anchor", "role", "content", "timestamp", "total"),
    _sql(" SELECT rank, source, session_id, message_index, is_anchor, role, content, timestamp, (SELECT count(*) FROM windows) AS total FROM windows ORDER BY rank, message_index LIMIT 72 OFFSET 2"),
)
PINS = ["conv-6", "conv-9", "conv-12", "conv-19"]
_add("retrieve_pinned", lambda s, d: _windows(s, d, pins=PINS).select("rank", "session_id", "message_index", "is_anchor"), _sql(" SELECT rank, session_id, message_index, is_anchor FROM windows", pins="session_id IN ('conv-6', 'conv-9', 'conv-12', 'conv-19')"))


def _kept_sessions(s, d):
    matches, provider = _store_matches(s, d), _provider(s, d)
    best = S.top_sessions(S.rank_sessions(matches), provider, 5)
    found, indexed = S.anchors(matches, provider, best, NEEDLE)
    return S.sessions_with_page(best, S.windows(found, indexed, 1, 2, 3), 4, 3).select("rank", "session_id", F.array_join(F.transform("messages", lambda m: m["message_index"].cast("string")), ",").alias("on_page"))


_add("retrieve_sessions_kept", _kept_sessions, _sql(" , page AS (SELECT rank, message_index FROM windows ORDER BY rank, message_index LIMIT 4 OFFSET 3) SELECT b.rank, b.session_id, coalesce((SELECT string_agg(message_index::VARCHAR, ',' ORDER BY message_index) FROM page p WHERE p.rank = b.rank), '') AS on_page FROM best b", 5, 1, 2, 3))
_add("retrieve_page_metadata", lambda s, d: S.flat_metadata(_windows(s, d), 5, 3), _sql(" SELECT count(*) AS total, least(count(*), 3) + 5 < count(*) AS next_page, CASE WHEN least(count(*), 3) + 5 < count(*) THEN 8 ELSE 3 END::BIGINT AS next_offset FROM windows"))
_add("retrieve_unreadable", lambda s, d: S.unreadable(S.rank_sessions(_store_matches(s, d)), _provider(s, d)), _sql(" SELECT *, 'no provider messages' AS reason FROM groups ANTI JOIN provider USING (source, project_name, session_id)"))
