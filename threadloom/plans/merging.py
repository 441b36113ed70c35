"""Registered queries: merges of the store's tables, whole syncs, completion of evidence runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadloom.functions.scratch import fresh
from threadloom.operators import merging as G
from threadloom.operators import redact as D
from threadloom.operators import syncing as Y
from threadloom.plans.reading import M
from threadloom.plans.storing import E, SCHEME, _e, _m

QUERIES, ORACLES = {}, {}


def _add(name, query, sql=None):
    QUERIES[name] = query
    if sql is not None:
        ORACLES[name] = sql


# merges: half of the events are in the store, the others come in a batch, several a key
def _session_rows(e):
    return e.select("project_id", "source", "source_session_id", F.col("timestamp").alias("started_at"), F.col("timestamp").alias("updated_at"), F.col("timestamp").alias("created_at"), F.when(F.col("seq") % 5 == 0, F.col("source_event_id")).alias("raw_local_ref"), "seq")


def _merged_sessions(s, d):
    e, rule = _session_rows(_e(s, d)), G.RULES["sessions"]
    stored = G.merge(None, e.where("seq % 4 < 2"), rule, ("seq",))
    return G.merge(stored, e.where("seq % 4 >= 2"), rule, ("seq",))


_add(
    "merge_sessions",
    _merged_sessions,
    E + """, o AS (SELECT *, seq % 4 >= 2 AS fresh, CASE WHEN seq % 5 = 0 THEN source_event_id END AS raw FROM stored)
    SELECT project_id, source, source_session_id, last(timestamp ORDER BY fresh, seq) AS started_at, last(timestamp ORDER BY fresh, seq) AS updated_at, first(timestamp ORDER BY fresh, seq) AS created_at,
      last(raw ORDER BY fresh, seq) FILTER (raw IS NOT NULL) AS raw_local_ref FROM o GROUP BY ALL""",
)


def _cursor_rows(s, d):
    return _m(s, d).select("source", F.col("project_name").alias("project_id"), F.col("source_file").alias("cursor_key"), F.concat(F.lit("line:"), "line_index").alias("cursor_value"), F.lit("v1").alias("parser_version"), F.sha2("content", 256).alias("last_event_hash"), F.col("timestamp").alias("updated_at"), F.col("timestamp").alias("created_at"), "line_index")


def _merged_cursors(s, d):
    rows, rule = _cursor_rows(s, d), G.RULES["source_cursors"]
    return G.merge(G.merge(None, rows.where("line_index < 2"), rule, ("line_index",)), rows.where("line_index >= 2"), rule, ("line_index",))


_add(
    "merge_cursors",
    _merged_cursors,
    M + """ SELECT source, project_name AS project_id, source_file AS cursor_key, 'line:' || max(line_index) AS cursor_value, 'v1' AS parser_version, last(sha256(content) ORDER BY line_index) AS last_event_hash,
      last(timestamp ORDER BY line_index) AS updated_at, first(timestamp ORDER BY line_index) AS created_at FROM messages GROUP BY ALL""",
)


def _search_rows(e, mark):
    return e.select(F.col("id").alias("event_id"), F.concat(F.lit(mark), "project_id").alias("project_id"), "source", F.concat(F.lit(mark), "content_text").alias("document_text"), F.concat(F.lit(SCHEME), "id").alias("citation"), F.concat("timestamp", F.lit(mark)).alias("updated_at"), "seq")


def _versions(s, d):
    """Search documents written in a first version and merged in a second; sessions change with both."""
    root, e = fresh(s, "versions"), _e(s, d)
    rules = G.RULES
    first = G.commit(s, root, 0, {"search_documents": (_search_rows(e.where("seq % 4 < 2"), "old "), rules["search_documents"], ("seq",)), "sessions": (_session_rows(e.where("seq % 4 < 2")), rules["sessions"], ("seq",))}, 8)
    G.commit(s, root, first, {"search_documents": (_search_rows(e.where("seq % 2 = 1"), "new "), rules["search_documents"], ("seq",)), "sessions": (_session_rows(e.where("seq % 4 >= 2")), rules["sessions"], ("seq",))})
    return root


_add(
    "merge_search_documents",
    lambda s, d: G.read_table(s, _versions(s, d), "search_documents"),
    E + """ SELECT id AS event_id, CASE WHEN seq % 4 < 2 THEN 'old ' ELSE 'new ' END || project_id AS project_id, source, CASE WHEN seq % 2 = 1 THEN 'new ' ELSE 'old ' END || content_text AS document_text,
      'store://event/' || id AS citation, timestamp || CASE WHEN seq % 2 = 1 THEN 'new ' ELSE 'old ' END AS updated_at FROM stored WHERE seq % 4 <> 2""",
)
_add("merge_sessions_versions", lambda s, d: G.read_table(s, _versions(s, d), "sessions"), ORACLES["merge_sessions"])


# sync: secrets and addresses are planted in every 13th and 17th event
def _planted(s, d):
    secret = F.when(F.col("seq") % 13 == 0, F.lit(" api_key=hunter2hunter2")).otherwise(F.lit(""))
    mail = F.when(F.col("seq") % 17 == 0, F.lit(" mail a@example.com")).otherwise(F.lit(""))
    return _e(s, d).withColumn("content_text", F.concat("content_text", mail, secret))


def _memory(e):
    """A memory of every 20th event, with it for evidence; every 60th in another project's name."""
    rows = e.where("seq % 20 < 2")
    return rows.select(
        F.concat(F.lit("mem-"), "seq").alias("memory_id"), F.when(F.col("seq") % 60 == 0, F.lit("proj-x")).otherwise(F.col("project_id")).alias("project_id"),
        F.when(F.col("seq") % 100 == 0, F.lit("secret-note")).otherwise(F.lit(" Fact ")).alias("kind"), F.concat(F.lit("seen "), "seq", F.when(F.col("seq") % 7 == 0, F.lit(" by a@example.com")).otherwise(F.lit(""))).alias("claim"),
        F.lit(0.9).alias("confidence"), F.when(F.col("seq") % 40 == 1, "pending").otherwise(F.lit("active")).alias("status"), F.array(F.concat(F.lit(SCHEME), "id")).alias("evidence_refs"), F.lit(None).cast("array<string>").alias("counterevidence_refs"), F.col("timestamp").alias("created_at"),
    )


PROJECTED = ("seq", "project_id", "source", "id", "remote_id", "remote_hash", "search_hash", "event_path", "search_path", "passed", "reasons")


def _projected(s, d):
    """Written once: memory, manifest, uploads and report read it."""
    path = fresh(s, "projection")
    Y.project_events(_planted(s, d)).select(*PROJECTED).write.parquet(path)
    return s.read.parquet(path)


def _report(s, d):
    e, rows = _planted(s, d), _projected(s, d)
    memory = Y.project_memory(_memory(e), rows, SCHEME)
    remote = rows.where("seq % 3 = 0 and passed").select(F.col("event_path").alias("sync_path"))
    return Y.sync_report(rows, memory, remote, "mem://remote").drop("manifest_version")


SYNC_SQL = (
    E.replace("props AS content_text", "props || CASE WHEN event_id % 17 = 0 THEN ' mail a@example.com' ELSE '' END || CASE WHEN event_id % 13 = 0 THEN ' api_key=hunter2hunter2' ELSE '' END AS content_text").replace("hashed AS (SELECT *, 'sha256:' || sha256(content_text) AS content_hash", "hashed AS (SELECT *, 'sha256:' || sha256(original) AS content_hash").replace("FROM store)", "FROM (SELECT s.*, e.props AS original FROM store s JOIN events e ON e.event_id = s.seq))")
    + """, clean AS (SELECT *, replace(content_text, 'a@example.com', '[REDACTED:private_email]') AS red FROM stored),
    judged AS (SELECT *, CASE WHEN event_type IN ('tool_call', 'tool_result', 'unknown_raw_event') THEN [event_type || ' events require a dedicated safe sync projection'] ELSE [] END
      || CASE WHEN seq % 13 = 0 THEN ['1 deterministic secret finding(s) of kind key_value_secret under policy redact:v1'] ELSE [] END AS reasons FROM clean),
    named AS (SELECT *, 'evt:v1:' || sha256('{' || """
    + " || ',' || ".join("'\"" + f + "\":\"' || " + ("'sha256:' || sha256(red)" if f == "content_hash" else "replace(replace(coalesce(" + f + ", ''), chr(92), chr(92)||chr(92)), '\"', chr(92)||'\"')") + " || '\"'" for f in Y.ids.EVENT_FIELDS)
    + """ || '}') AS rid FROM judged),
    projected AS (SELECT *, len(reasons) = 0 AS passed, 'sha256:' || sha256(red) AS rhash, 'sha256:' || sha256('search:' || rid || ':' || red) AS shash,
      'projects/' || project_id || '/sessions/' || source_session_id || '/events/' || replace(rid, ':', '_') || '.json' AS epath, 'projects/' || project_id || '/search/' || replace(rid, ':', '_') || '.json' AS spath FROM named)"""
)
MEMORY_SQL = SYNC_SQL + """, mem AS (SELECT *, CASE WHEN seq % 60 = 0 THEN 'proj-x' ELSE project_id END AS own, 'seen ' || seq || CASE WHEN seq % 7 = 0 THEN ' by [REDACTED:private_email]' ELSE '' END AS claim,
      passed AND seq % 60 <> 0 AND seq % 100 <> 0 AS ok FROM projected WHERE seq % 20 < 2 AND seq % 40 <> 1),
    part AS (SELECT *, '{"claim":"' || claim || '","confidence":0.9,"counterevidence_refs":[],"created_at":' AS a, ',"evidence_refs":["store://event/' || rid || '"],"id":' AS b, ',"kind":"fact","status":"active"}' AS c FROM mem),
    told AS (SELECT *, 'learned-memory:v1:sha256:' || sha256(a || 'null' || b || 'null' || c) AS mid FROM part),
    memory AS (SELECT *, 'sha256:' || sha256(a || '"' || timestamp || '"' || b || '"' || mid || '"' || c) AS mhash, 'projects/' || own || '/learned-memory/' || replace(mid, ':', '_') || '.json' AS mpath FROM told)"""
_add(
    "sync_projection",
    lambda s, d: Y.project_events(_planted(s, d)).select("seq", "passed", F.array_join("reasons", "; ").alias("reasons"), "remote_id", "search_hash", "event_path", "search_path"),
    SYNC_SQL + " SELECT seq, passed, array_to_string(reasons, '; ') AS reasons, CASE WHEN passed THEN rid END AS remote_id, CASE WHEN passed THEN shash END AS search_hash, CASE WHEN passed THEN epath END AS event_path, CASE WHEN passed THEN spath END AS search_path FROM projected",
)
_add(
    "sync_memory",
    lambda s, d: Y.project_memory(_memory(_planted(s, d)), _projected(s, d), SCHEME).select("memory_id", "project_id", "passed", "remote_id", "remote_hash", "path", F.when(F.col("passed"), F.col("claim")).alias("claim")),
    MEMORY_SQL + " SELECT 'mem-' || seq AS memory_id, own AS project_id, ok AS passed, CASE WHEN ok THEN mid END AS remote_id, CASE WHEN ok THEN mhash END AS remote_hash, CASE WHEN ok THEN mpath END AS path, CASE WHEN ok THEN claim END AS claim FROM memory",
)
_add(
    "sync_report",
    _report,
    MEMORY_SQL + """, entries AS (SELECT project_id, 'event' AS kind, rid AS ref, rhash AS hash, epath AS path, seq FROM projected WHERE passed UNION ALL SELECT project_id, 'search_document', rid, shash, spath, seq FROM projected WHERE passed
      UNION ALL SELECT own, 'learned_memory', mid, mhash, mpath, seq FROM memory WHERE ok),
    roots AS (SELECT project_id, 'sha256:' || sha256(string_agg(concat_ws(chr(9), kind, ref, hash, path) || chr(10), '' ORDER BY kind, ref, path)) AS root_hash,
      count(*) FILTER (kind = 'event' AND seq % 3 <> 0) AS uploaded_events, count(*) FILTER (kind = 'search_document') AS uploaded_search_documents, count(*) FILTER (kind = 'learned_memory') AS uploaded_learned_memory FROM entries GROUP BY project_id),
    ev AS (SELECT project_id, count(*) AS total_events, count(*) FILTER (passed) AS synced_events, count(*) FILTER (NOT passed) AS blocked_events FROM projected GROUP BY 1),
    me AS (SELECT own AS project_id, count(*) FILTER (ok) AS synced_learned_memory, count(*) FILTER (NOT ok) AS blocked_learned_memory FROM memory GROUP BY 1),
    al AS (SELECT project_id, coalesce(total_events, 0) AS total_events, coalesce(synced_events, 0) AS synced_events, coalesce(blocked_events, 0) AS blocked_events, coalesce(uploaded_events, 0) AS uploaded_events,
      coalesce(uploaded_search_documents, 0) AS uploaded_search_documents, coalesce(uploaded_learned_memory, 0) AS uploaded_learned_memory, coalesce(synced_learned_memory, 0) AS synced_learned_memory,
      coalesce(blocked_learned_memory, 0) AS blocked_learned_memory, coalesce(root_hash, 'sha256:' || sha256('')) AS root_hash FROM ev FULL JOIN me USING (project_id) LEFT JOIN roots USING (project_id))
    SELECT *, 'sync-manifest:v1:' || sha256(concat_ws(':', 'mem://remote', project_id, root_hash, 'redact:v1')) AS manifest_id,
      CASE WHEN blocked_events + blocked_learned_memory = 0 THEN 'synced' WHEN synced_events + synced_learned_memory = 0 THEN 'blocked' ELSE 'partial' END AS status FROM al""",
)


# redaction runs recorded again: their former spans go
def _spans(s, d):
    found = D.redact(_planted(s, d).where("seq % 13 = 0 or seq % 17 = 0"), "content_text").withColumn("run_id", Y.run_id(F.col("id")))
    spans = found.select("seq", "run_id", F.explode("findings").alias("f")).select("seq", "run_id", "f.kind", F.concat_ws("-", "run_id", "f.kind", "f.start_byte").alias("id"))
    old = spans.withColumn("kind", F.concat(F.lit("old "), "kind"))
    again = found.where("seq % 2 = 0")
    return G.replace_details(old, again, spans.where("seq % 4 = 0"), "run_id").select("seq", "run_id", "kind")


_add(
    "redaction_spans_replaced",
    _spans,
    SYNC_SQL + """, spans AS (SELECT seq, id, 'key_value_secret' AS kind FROM projected WHERE seq % 13 = 0 UNION ALL SELECT seq, id, 'private_email' FROM projected WHERE seq % 17 = 0)
    SELECT seq, 'redaction-run:v1:' || sha256(id || ':redact:v1') AS run_id, CASE WHEN seq % 4 = 0 THEN '' ELSE 'old ' END || kind AS kind FROM spans WHERE seq % 2 = 1 OR seq % 4 = 0""",
)


# completion: project 3's run was completed before, 5's isn't reported, 2's has a wrong state, 4's a reference to nothing
def _completed(s, d):
    e = _e(s, d)
    run = F.concat(F.lit("run-"), "project_id")
    n = F.col("project_id")
    runs = e.select("project_id").distinct().select(run.alias("run_id"), "project_id", F.when(n == "proj-3", "completed").otherwise(F.lit("running")).alias("status"), F.when(n == "proj-3", F.lit("before")).alias("output_hash"), F.lit(None).cast("string").alias("completed_at"))
    done = e.where(n != "proj-5").groupBy(run.alias("run_id")).agg(F.concat(F.lit("out-"), F.max("timestamp")).alias("output_hash"), F.max("timestamp").alias("completed_at"))
    ref = F.concat(F.lit(SCHEME), "id")
    base = e.where("seq % 10 < 2").select(run.alias("run_id"), "seq", n, F.col("event_type").alias("kind"), F.col("content_text").alias("claim"), F.lit(0.7).alias("confidence"), F.array(ref, ref).alias("evidence_refs"), F.array().cast("array<string>").alias("counterevidence_refs"))
    candidates = base.withColumn("status", F.when(n == "proj-2", "odd").otherwise(F.lit("pending")))
    memory = base.withColumn("status", F.lit("active")).withColumn("evidence_refs", F.when(n == "proj-4", F.array(F.lit(SCHEME + "none"))).otherwise(F.col("evidence_refs")))
    return Y.complete_runs(runs, done, candidates.drop("project_id"), memory.drop("project_id"), e, SCHEME)


_add(
    "runs_completed",
    lambda s, d: _completed(s, d)[0],
    E + """, g AS (SELECT project_id, max(timestamp) AS t FROM stored GROUP BY 1), p AS (SELECT *, 'run-' || project_id AS run_id, CASE project_id WHEN 'proj-3' THEN 'dream run is not running or does not exist: run-proj-3'
      WHEN 'proj-2' THEN 'invalid dream candidate status: odd' WHEN 'proj-4' THEN 'references missing evidence: store://event/none' END AS problem FROM g WHERE project_id <> 'proj-5')
    SELECT run_id, project_id, CASE WHEN problem IS NULL OR project_id = 'proj-3' THEN 'completed' ELSE 'running' END AS status, CASE WHEN problem IS NULL THEN 'out-' || t WHEN project_id = 'proj-3' THEN 'before' END AS output_hash,
      CASE WHEN problem IS NULL THEN t END AS completed_at, problem FROM p""",
)
KEPT_SQL = E + ", kept AS (SELECT *, max(timestamp) OVER (PARTITION BY project_id) AS t FROM stored QUALIFY seq % 10 < 2 AND project_id NOT IN ('proj-2', 'proj-3', 'proj-4', 'proj-5'))"
_add("run_candidates", lambda s, d: _completed(s, d)[1].select("seq", "id", "created_at", F.array_join("evidence_refs", ",").alias("refs")), KEPT_SQL + " SELECT seq, 'dream-candidate:v1:' || sha256('run-' || project_id || ':' || event_type || ':' || content_text || ':store://event/' || id || ':') AS id, t AS created_at, 'store://event/' || id AS refs FROM kept")
_add("run_memory", lambda s, d: _completed(s, d)[2].select("seq", "id", "run_id"), KEPT_SQL + " SELECT seq, 'learned-memory:v1:' || sha256(project_id || ':' || event_type || ':' || content_text || ':store://event/' || id || ':') AS id, 'run-' || project_id AS run_id FROM kept")
