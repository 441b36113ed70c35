"""Registered queries: projects, sessions, messages, recency, context."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadloom.functions import text as T
from threadloom.operators import reading as R
from threadloom.operators import rollups as U
from threadloom.sources import views as V

QUERIES, ORACLES = {}, {}

SESSIONS_SQL = """sessions AS (
  SELECT source, project_name, session_id, count(*)::INT AS message_count, (count(*) FILTER (role = 'user'))::INT AS user_messages,
    (count(*) FILTER (role = 'assistant'))::INT AS assistant_messages, min(timestamp) AS first_timestamp, max(timestamp) AS last_timestamp,
    coalesce(first(project_path ORDER BY source_file, line_index) FILTER (project_path <> ''), '') AS project_path,
    coalesce(first(CASE WHEN length(content) <= 120 THEN content ELSE substring(content, 1, 120) || '...' END
      ORDER BY timestamp, source_file, line_index) FILTER (role = 'user'), '') AS preview
  FROM messages GROUP BY source, project_name, session_id
)"""
PROJECTS_SQL = """projects AS (
  SELECT source, project_name, count(*)::INT AS message_count, count(DISTINCT session_id)::INT AS session_count, max(timestamp) AS last_timestamp,
    coalesce(first(project_path ORDER BY source_file, line_index) FILTER (project_path <> ''), '') AS project_path
  FROM messages GROUP BY source, project_name
)"""
M = "WITH " + V.MESSAGES_SQL
MS = M + ", " + SESSIONS_SQL
MP = M + ", " + PROJECTS_SQL
TIES_S = "session_id, project_name, project_path, source"
TIES_P = "project_name, project_path, source"
CHRON = "timestamp, source_file, line_index, session_id, source"
CHRON_DESC = "timestamp DESC, source_file DESC, line_index DESC, session_id DESC, source DESC"
API = ", ".join(R.API_COLUMNS)
AGE = "row_number() OVER (ORDER BY last_timestamp DESC, message_count DESC, session_id, project_name, project_path, source) - 1 AS age"


def _add(name, query, sql):
    QUERIES[name], ORACLES[name] = query, sql


def _m(spark, d):
    return V.messages(spark, d)


def _sessions(spark, d):
    return U.session_rollup(_m(spark, d))


def _projects(spark, d):
    return U.project_rollup(_m(spark, d))


# projects
_add("list_projects", lambda s, d: U.page(_projects(s, d), U.project_order(), 10), MP + f" SELECT * FROM projects ORDER BY last_timestamp DESC, message_count DESC, {TIES_P} LIMIT 10")
_add("list_projects_by_count_asc", lambda s, d: U.page(_projects(s, d), U.project_order("count", False), 10), MP + f" SELECT * FROM projects ORDER BY message_count, last_timestamp, {TIES_P} LIMIT 10")
_add("projects_page2", lambda s, d: U.page(_projects(s, d), U.project_order(), 10, 10), MP + f" SELECT * FROM projects ORDER BY last_timestamp DESC, message_count DESC, {TIES_P} LIMIT 10 OFFSET 10")
_add("projects_totals", lambda s, d: U.totals(_m(s, d)), M + " SELECT count(*) AS total_messages, count(DISTINCT (source, project_name, session_id)) AS total_sessions FROM messages")
_add(
    "project_aliases",
    lambda s, d: _projects(s, d).select("source", "project_name", F.array_join(T.project_aliases(F.col("project_name"), F.col("project_path")), "|").alias("aliases")),
    MP + """ SELECT source, project_name, array_to_string(list_sort(list_distinct(list_filter([
      regexp_extract(project_name, '([^/]*)$', 1), regexp_extract(project_path, '([^/]*)$', 1), replace(project_name, '/', '-'), replace(project_path, '/', '-')],
      lambda x: x <> '' AND x <> project_name))), '|') AS aliases FROM projects""",
)


def resolve_project(projects, identifier: str):
    """Project rows that an identifier means: exact names or paths (with or without the leading slash), else aliases."""
    bare = identifier.strip("/")
    exact = projects.withColumn("tier", F.when(F.col("project_name").isin(identifier, "/" + bare, bare) | F.col("project_path").isin(identifier, "/" + bare, bare), F.lit(1)).when(
        F.array_contains(T.project_aliases(F.col("project_name"), F.col("project_path")), identifier), F.lit(2)))
    best = exact.where("tier is not null").agg(F.min("tier").alias("best"))
    # one row
    return exact.join(F.broadcast(best), F.col("tier") == F.col("best")).select("source", "project_name", "tier")


RESOLVE = """, tiers AS (SELECT source, project_name, CASE WHEN project_name IN ({a}) OR project_path IN ({a}) THEN 1
  WHEN list_contains([regexp_extract(project_name, '([^/]*)$', 1), regexp_extract(project_path, '([^/]*)$', 1), replace(project_name, '/', '-'), replace(project_path, '/', '-')], '{i}') AND '{i}' <> project_name THEN 2 END AS tier FROM projects)
SELECT source, project_name, tier FROM tiers WHERE tier = (SELECT min(tier) FROM tiers)"""
_add("resolve_project_exact", lambda s, d: resolve_project(_projects(s, d), "proj/p3"), MP + RESOLVE.format(a="'proj/p3', '/proj/p3'", i="proj/p3"))
_add("resolve_project_alias", lambda s, d: resolve_project(_projects(s, d), "p4"), MP + RESOLVE.format(a="'p4', '/p4'", i="p4"))

# sessions
_add("list_sessions", lambda s, d: U.page(_sessions(s, d), U.session_order(), 20), MS + f" SELECT * FROM sessions ORDER BY last_timestamp DESC, message_count DESC, {TIES_S} LIMIT 20")
_add("sessions_by_count", lambda s, d: U.page(_sessions(s, d), U.session_order("count"), 20, 5), MS + f" SELECT * FROM sessions ORDER BY message_count DESC, last_timestamp DESC, {TIES_S} LIMIT 20 OFFSET 5")
_add(
    "sessions_in_project",
    lambda s, d: U.page(U.session_rollup(R.select_messages(_m(s, d), None, ["/proj/p2", "/proj/p5"])), U.session_order("timestamp", False), None),
    MS + " SELECT * FROM sessions WHERE project_name IN ('/proj/p2', '/proj/p5')",
)
_add("session_preview", lambda s, d: _sessions(s, d).select("session_id", "preview"), MS + " SELECT session_id, preview FROM sessions")
_add("session_source_file", lambda s, d: _m(s, d).groupBy(*V.SESSION_KEY).agg(F.min("source_file").alias("source_file")), M + " SELECT source, project_name, session_id, min(source_file) AS source_file FROM messages GROUP BY ALL")

# messages
_add("read_session", lambda s, d: R.api(R.newest_window(R.select_messages(_m(s, d), sessions=["conv-7", "conv-57"]), 50)), M + f" SELECT {API} FROM messages WHERE session_id IN ('conv-7', 'conv-57') ORDER BY {CHRON_DESC} LIMIT 50")
_add("read_session_newest_page", lambda s, d: R.api(R.newest_window(R.select_messages(_m(s, d), sessions=["conv-7", "conv-57"]), 3, 2)), M + f" SELECT {API} FROM messages WHERE session_id IN ('conv-7', 'conv-57') ORDER BY {CHRON_DESC} LIMIT 3 OFFSET 2")
_add("read_project_page2", lambda s, d: R.api(R.newest_window(R.select_messages(_m(s, d), projects=["/proj/p1"]), 20, 20)), M + f" SELECT {API} FROM messages WHERE project_name = '/proj/p1' ORDER BY {CHRON_DESC} LIMIT 20 OFFSET 20")
_add("read_source", lambda s, d: R.api(R.newest_window(R.select_messages(_m(s, d), "cursor"), 200)), M + f" SELECT {API} FROM messages WHERE source = 'cursor' ORDER BY {CHRON_DESC} LIMIT 200")


def cwd_probes(spark, cwd: str):
    """The (source, project name) pairs under which each source files a working directory."""
    hyphen = cwd.replace("/", "-")
    rows = [("claude", hyphen), ("codex", cwd), ("cursor", hyphen.lstrip("-")), ("grok", cwd), ("pi", f"-{hyphen}--")]
    return spark.createDataFrame(rows, "source string, project_name string")


def read_cwd(spark, messages, cwd: str, limit: int, offset: int = 0):
    """Messages of a working directory over all sources, oldest first."""
    # five rows
    return R.oldest_page(messages.join(F.broadcast(cwd_probes(spark, cwd)), ["source", "project_name"], "left_semi"), limit, offset)


_add("read_cwd_fanout_oldest_page", lambda s, d: R.api(read_cwd(s, _m(s, d), "/proj/p6", 15)), M + f" SELECT {API} FROM messages WHERE (source, project_name) IN (('claude','-proj-p6'), ('codex','/proj/p6'), ('cursor','proj-p6'), ('grok','/proj/p6'), ('pi','--proj-p6--')) ORDER BY {CHRON} LIMIT 15")
_add(
    "messages_by_session_count",
    lambda s, d: R.by_session_count(_m(s, d)).select("session_id", "line_index", "session_messages", "timestamp"),
    M + f" SELECT session_id, line_index, session_messages, timestamp FROM (SELECT *, count(*) OVER (PARTITION BY source, project_name, session_id) AS session_messages FROM messages) ORDER BY session_messages DESC, {CHRON}",
)
_add("message_index_range", lambda s, d: R.index_range(_m(s, d), 1, 3).select("session_id", "message_index", "content"), M + f" SELECT session_id, message_index, content FROM (SELECT *, row_number() OVER (PARTITION BY source, project_name, session_id ORDER BY {CHRON}) - 1 AS message_index FROM messages) WHERE message_index >= 1 AND message_index < 3")
_add(
    "latest_session_window",
    lambda s, d: R.api(R.latest_session_window(_m(s, d), 3)),
    M + f", newest AS (SELECT source, project_name, session_id FROM messages ORDER BY timestamp DESC, source_file DESC, line_index DESC, session_id, project_name, source LIMIT 1) SELECT {API} FROM messages SEMI JOIN newest USING (source, project_name, session_id) ORDER BY {CHRON_DESC} LIMIT 3",
)
_add("page_metadata", lambda s, d: U.page_metadata(_m(s, d), 50, 100), M + " SELECT count(*) AS total, greatest(0, least(count(*) - 100, 50))::BIGINT AS returned, (least(count(*), 100) + greatest(0, least(count(*) - 100, 50)))::BIGINT AS next_offset, least(count(*), 100) + greatest(0, least(count(*) - 100, 50)) < count(*) AS next_page FROM messages")

# recency
RECALL = MS + ", aged AS (SELECT source, project_name, session_id, " + AGE + " FROM sessions) SELECT m.session_id, m.line_index, m.content, a.age FROM messages m JOIN aged a USING (source, project_name, session_id) WHERE age BETWEEN {} AND {}"


def _recall(first, last):
    return lambda s, d: U.recall(_sessions(s, d), _m(s, d), first, last).select("session_id", "line_index", "content", "age")


_add("recall_previous", _recall(1, 1), RECALL.format(1, 1))
_add("recall_include_newest", _recall(0, 0), RECALL.format(0, 0))
_add("recall_range", _recall(2, 5), RECALL.format(2, 5))
_add("session_ages", lambda s, d: U.ages(_sessions(s, d)).select("session_id", "age"), MS + f" SELECT session_id, {AGE} FROM sessions")

# context
_add("context_project_messages", lambda s, d: R.api(R.newest_window(R.select_messages(_m(s, d), projects=["/proj/p0"]), 100)), M + f" SELECT {API} FROM messages WHERE project_name = '/proj/p0' ORDER BY {CHRON_DESC} LIMIT 100")
_add("context_source_sessions", lambda s, d: U.session_rollup(R.select_messages(_m(s, d), "pi")), MS + " SELECT * FROM sessions WHERE source = 'pi'")
_add(
    "transcript_input",
    lambda s, d: R.transcripts(_m(s, d)).select("project_name", F.sha2("transcript", 256).alias("transcript_sha256"), F.length("transcript").alias("chars")),
    M + """, marked AS (SELECT *, lag(session_id) OVER w IS DISTINCT FROM session_id AS change FROM messages WINDOW w AS (PARTITION BY project_name ORDER BY session_id, source, timestamp, source_file, line_index)),
    joined AS (SELECT project_name, string_agg(CASE WHEN change THEN chr(10) || '## Session ' || session_id || ' (' || source || ', ' || project_name || ')' || chr(10) ELSE '' END || '- [' || timestamp || '] ' || role || ': ' || content || chr(10), '' ORDER BY session_id, source, timestamp, source_file, line_index) AS t FROM marked GROUP BY project_name)
    SELECT project_name, sha256(t) AS transcript_sha256, length(t)::INT AS chars FROM joined""",
)
_add(
    "tool_truncation",
    lambda s, d: _m(s, d).select("session_id", "line_index", T.shorten_output(F.col("content"), 200).alias("shown")),
    M + " SELECT session_id, line_index, CASE WHEN length(content) <= 200 THEN content ELSE substring(content, 1, 200) || chr(10) || '... [truncated; omitted_chars=' || (length(content) - 200) || '; full_content_hash=sha256:' || sha256(content) || ']' END AS shown FROM messages",
)
# every third message as a tool's, ten times as long
_add(
    "session_inputs",
    lambda s, d: R.session_inputs(_m(s, d).withColumns({"role": F.when(F.col("line_index") % 3 == 2, "tool").otherwise(F.col("role")), "content": F.repeat("content", F.lit(10))})).select("session_id", F.sha2("input", 256).alias("input_sha256"), F.length("input").alias("chars")),
    M + """, t AS (SELECT * REPLACE (CASE WHEN line_index % 3 = 2 THEN 'tool' ELSE role END AS role, repeat(content, 10) AS content) FROM messages),
    j AS (SELECT source, project_name, session_id, '=== Session: ' || session_id || ' ===' || chr(10) || string_agg('[' || timestamp || '] ' || role || ': ' || CASE WHEN role = 'tool' AND length(content) > 2000 THEN substring(content, 1, 2000) || chr(10) || '... [truncated]' ELSE content END || chr(10), '' ORDER BY timestamp, source_file, line_index) AS input FROM t GROUP BY source, project_name, session_id)
    SELECT session_id, sha256(input) AS input_sha256, length(input)::INT AS chars FROM j""",
)
# a page over all sources is told by what is left alone
_add("cwd_metadata", lambda s, d: U.cwd_metadata(R.select_messages(_m(s, d), "pi"), 15, 30), M + " SELECT count(*) AS total, (30 + greatest(0, least(count(*) - 30, 15)))::BIGINT AS next_offset, 30 + greatest(0, least(count(*) - 30, 15)) < count(*) AS next_page FROM messages WHERE source = 'pi'")
