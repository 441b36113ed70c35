"""Registered queries: ids and ingest, redaction, sync and memory, peers and bundles."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadloom.functions import ids
from threadloom.functions import text as T
from threadloom.operators import exchange as X
from threadloom.operators import redact as D
from threadloom.operators import store as W
from threadloom.operators.search import message_citation
from threadloom.plans.reading import M
from threadloom.sources import views as V

QUERIES, ORACLES = {}, {}
#: How references name events; stores choose their own.
SCHEME = "store://event/"


def _add(name, query, sql=None):
    QUERIES[name] = query
    if sql is not None:
        ORACLES[name] = sql


def _m(spark, d):
    return V.messages(spark, d)


def _e(spark, d):
    return W.with_ids(V.events(spark, d))


def _docs(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text")


# ids and ingest
ESC = "replace(replace(replace(replace(replace(coalesce({}, ''), chr(92), chr(92)||chr(92)), '\"', chr(92)||'\"'), chr(10), chr(92)||'n'), chr(13), chr(92)||'r'), chr(9), chr(92)||'t')"
FIELDS_SQL = " || ',' || ".join("'\"" + f + "\":\"' || " + ESC.format(f) + " || '\"'" for f in ids.EVENT_FIELDS)
E = (
    "WITH "
    + V.EVENTS_SQL
    + ", hashed AS (SELECT *, 'sha256:' || sha256(content_text) AS content_hash FROM store), chained AS (SELECT *, lag(content_hash) OVER (PARTITION BY source, source_session_id ORDER BY timestamp, seq) AS parent_hash, 'v1' AS parser_version FROM hashed), stored AS (SELECT *, 'evt:v1:' || sha256('{' || "
    + FIELDS_SQL
    + " || '}') AS id FROM chained)"
)
_add("content_hash", lambda s, d: _m(s, d).select("session_id", "line_index", ids.content_hash(F.col("content")).alias("content_hash")), M + " SELECT session_id, line_index, 'sha256:' || sha256(content) AS content_hash FROM messages")
_add("event_id", lambda s, d: _e(s, d).select("seq", "id"), E + " SELECT seq, id FROM stored")
_add("parent_hash_chain", lambda s, d: _e(s, d).select("seq", "content_hash", "parent_hash"), E + " SELECT seq, content_hash, parent_hash FROM stored")
_add(
    "ingest_anti_join",
    lambda s, d: W.new_rows(_e(s, d).where("seq % 3 <> 0").union(_e(s, d).where("seq % 5 = 1")), _e(s, d).where("seq % 2 = 0")).select("id", "seq"),
    E + " SELECT DISTINCT id, seq FROM stored WHERE (seq % 3 <> 0 OR seq % 5 = 1) AND id NOT IN (SELECT id FROM stored WHERE seq % 2 = 0)",
)


def _sessions_state(e, where):
    return e.where(where).groupBy("source", "source_session_id").agg(F.max("timestamp").alias("updated_at"), F.max_by("timestamp", F.struct("timestamp", "seq")).alias("started_at"))


_add(
    "session_upsert",
    lambda s, d: W.upsert(_sessions_state(_e(s, d), "seq % 4 < 2"), _sessions_state(_e(s, d), "seq % 4 = 2"), ["source", "source_session_id"], "updated_at"),
    E + """, old AS (SELECT source, source_session_id, max(timestamp) AS t FROM stored WHERE seq % 4 < 2 GROUP BY ALL), new AS (SELECT source, source_session_id, max(timestamp) AS t FROM stored WHERE seq % 4 = 2 GROUP BY ALL)
    SELECT source, source_session_id, coalesce(new.t, old.t) AS updated_at, coalesce(new.t, old.t) AS started_at FROM old FULL JOIN new USING (source, source_session_id)""",
)
_add(
    "cursor_positions",
    lambda s, d: _m(s, d).groupBy("source", "project_name", "source_file").agg(F.concat(F.lit("line:"), F.count(F.lit(1)), F.lit(";bytes:"), F.sum(F.octet_length("content") + 1)).alias("cursor"), F.max_by(F.sha2("content", 256), "line_index").alias("last_hash")),
    M + " SELECT source, project_name, source_file, 'line:' || count(*) || ';bytes:' || sum(strlen(content) + 1) AS cursor, sha256(last(content ORDER BY line_index)) AS last_hash FROM messages GROUP BY ALL",
)
_add("message_citation", lambda s, d: _m(s, d).withColumn("line", F.lit(1)).select("session_id", "line_index", message_citation().alias("citation")), M + " SELECT session_id, line_index, 'message:v1:' || sha256(concat_ws(chr(10), source, project_name, session_id, role, timestamp, '1', content)) AS citation FROM messages")


# redaction: detectors that RE2 and Java read alike are counted on both sides
def _detect(kind):
    return lambda s, d: _docs(s, d).select("doc_id", F.explode(D.values(F.col("text"), kind)).alias("value"))


def _detect_sql(kind):
    pattern = (D.SECRETS | D.PII)[kind][0]
    group = 1 if kind == "key_value_secret" else 0
    return "SELECT doc_id, unnest(regexp_extract_all(text, '" + pattern.replace("'", "''") + f"', {group})) AS value FROM documents"


for _name, _kind in (("detect_email", "private_email"), ("detect_phone", "private_phone"), ("detect_key_value", "key_value_secret")):
    _add(_name, _detect(_kind), _detect_sql(_kind))
_add(
    "detect_high_entropy",
    lambda s, d: _detect("high_entropy_secret")(s, d).where(F.col("value").rlike("[A-Za-z]") & F.col("value").rlike("[0-9]") & (F.size(F.array_distinct(F.split("value", ""))) >= D.MIN_DISTINCT) & (T.entropy(F.col("value")) >= D.MIN_ENTROPY)),
    "SELECT * FROM (" + _detect_sql("high_entropy_secret") + ") WHERE regexp_matches(value, '[A-Za-z]') AND regexp_matches(value, '[0-9]') AND len(list_distinct(string_split(value, ''))) >= 8 AND list_aggregate(string_split(value, ''), 'entropy') >= 3.5",
)


def _redacted(s, d):
    return D.redact(_docs(s, d), "text")


HITS_SQL = (
    "WITH hits AS (SELECT doc_id, (" + " OR ".join("regexp_matches(text, '" + D.SECRETS[k][0].replace("'", "''") + "')" for k in D.SECRETS if k not in ("high_entropy_secret", "private_key"))
    + " OR EXISTS (SELECT 1 FROM (SELECT unnest(regexp_extract_all(text, '" + D.SECRETS["high_entropy_secret"][0] + "')) AS v) WHERE regexp_matches(v, '[A-Za-z]') AND regexp_matches(v, '[0-9]') AND len(list_distinct(string_split(v, ''))) >= 8 AND list_aggregate(string_split(v, ''), 'entropy') >= 3.5)"
    + " OR regexp_matches(text, '" + D.SECRETS["private_key"][0] + "')) AS blocked FROM documents)"
)
_add(
    "redact_status_counts",
    lambda s, d: _redacted(s, d).withColumn("status", D.run_status(F.col("findings"), F.col("blocks_sync"))).groupBy("status").agg(F.count(F.lit(1)).alias("documents")).withColumn("sync_status", D.sync_status(F.col("status"))),
    HITS_SQL + " SELECT CASE WHEN blocked THEN 'blocked' ELSE 'passed' END AS status, count(*) AS documents, CASE WHEN blocked THEN 'blocked' ELSE 'redacted' END AS sync_status FROM hits GROUP BY blocked",
)



def _spans_sql() -> str:
    """Findings by the same patterns: a match's place is what the pieces and matches before it add up to; overlapping ones merge."""
    quote = lambda p: "'" + p.replace("'", "''") + "'"
    each = []
    for kind, (pattern, sure) in (D.SECRETS | D.PII).items():
        group = 1 if kind == "key_value_secret" else 0
        each.append(f"SELECT doc_id, '{kind}' AS kind, {sure}::DOUBLE AS sure, string_split_regex(text, {quote(pattern)}) AS s, regexp_extract_all(text, {quote(pattern)}, 0) AS w, regexp_extract_all(text, {quote(pattern)}, {group}) AS g FROM documents WHERE regexp_matches(text, {quote(pattern)})")
    pii = ", ".join(f"'{k}'" for k in D.PII)
    return f"""WITH raw AS ({" UNION ALL ".join(each)}), each AS (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM raw),
    hits AS (SELECT doc_id, kind, sure, w[i] AS whole, g[i] AS value, strlen(array_to_string(s[1:i], '')) + strlen(array_to_string(w[1:i - 1], '')) AS place FROM each),
    found AS (SELECT doc_id, kind, sure, value, place + strlen(whole) - strlen(value) - CASE WHEN whole <> value AND NOT ends_with(whole, value) THEN 1 ELSE 0 END AS a FROM hits
      WHERE kind <> 'high_entropy_secret' OR (regexp_matches(value, '[A-Za-z]') AND regexp_matches(value, '[0-9]') AND len(list_distinct(string_split(value, ''))) >= 8 AND list_aggregate(string_split(value, ''), 'entropy') >= 3.5)),
    spans AS (SELECT *, a + strlen(value) AS b FROM found WHERE value <> ''),
    marked AS (SELECT *, CASE WHEN a < max(b) OVER (PARTITION BY doc_id ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS head FROM spans),
    islands AS (SELECT *, sum(head) OVER (PARTITION BY doc_id ORDER BY a ROWS UNBOUNDED PRECEDING) AS island FROM marked),
    merged AS (SELECT doc_id, min(a)::BIGINT AS start_byte, max(b)::BIGINT AS end_byte, max(sure) AS confidence,
      CASE WHEN count(DISTINCT kind) = 1 THEN min(kind) WHEN bool_and(kind IN ({pii})) THEN 'pii' ELSE 'secret' END AS kind FROM islands GROUP BY doc_id, island),
    findings AS (SELECT doc_id, kind, start_byte, end_byte, CASE WHEN kind IN ('pii', {pii}) THEN '[REDACTED:' || kind || ']' ELSE '[REDACTED:secret]' END AS replacement, confidence, kind NOT IN ('pii', {pii}) AS blocks_sync FROM merged)"""


SPANS_SQL = _spans_sql()
_add("redact_kind_counts", lambda s, d: _redacted(s, d).select(F.explode("findings.kind").alias("kind")).groupBy("kind").agg(F.count(F.lit(1)).alias("findings")), SPANS_SQL + " SELECT kind, count(*) AS findings FROM findings GROUP BY kind")
_add(
    "redacted_text",
    lambda s, d: _redacted(s, d).where(F.size("findings") > 0).select("doc_id", "redacted", "blocks_sync"),
    SPANS_SQL + """, ends AS (SELECT *, coalesce(lag(end_byte) OVER w, 0) AS before, row_number() OVER (PARTITION BY doc_id ORDER BY start_byte DESC) AS last FROM findings WINDOW w AS (PARTITION BY doc_id ORDER BY start_byte)),
    b AS (SELECT e.*, encode(d.text) AS raw FROM ends e JOIN documents d USING (doc_id))
    SELECT doc_id, string_agg(decode(raw[before + 1:start_byte]) || replacement || CASE WHEN last = 1 THEN decode(raw[end_byte + 1:]) ELSE '' END, '' ORDER BY start_byte) AS redacted, bool_or(blocks_sync) AS blocks_sync FROM b GROUP BY doc_id""",
)
_add("finding_spans", lambda s, d: _redacted(s, d).select("doc_id", F.explode("findings").alias("f")).select("doc_id", "f.*"), SPANS_SQL + " SELECT * FROM findings")

# sync and memory
BLOCKER_SQL = "CASE WHEN event_type IN ('tool_call', 'tool_result', 'unknown_raw_event') THEN 'unsafe event type: ' || event_type END"
_add("sync_blockers", lambda s, d: _e(s, d).select("seq", W.sync_blocker(F.col("event_type")).alias("reason")).where("reason is not null"), E + f" SELECT seq, {BLOCKER_SQL} AS reason FROM stored WHERE {BLOCKER_SQL} IS NOT NULL")
_add(
    "sync_dry_run_status",  # without a detector coverage is degraded and nothing would be synced
    lambda s, d: _e(s, d).groupBy("project_id").agg(F.count_if(W.sync_blocker(F.col("event_type")).isNull()).alias("passed"), F.count_if(W.sync_blocker(F.col("event_type")).isNotNull()).alias("blocked")).withColumns({"coverage": F.lit("degraded"), "would_sync": F.lit(False)}),
    E + f" SELECT project_id, count(*) FILTER ({BLOCKER_SQL} IS NULL) AS passed, count(*) FILTER ({BLOCKER_SQL} IS NOT NULL) AS blocked, 'degraded' AS coverage, false AS would_sync FROM stored GROUP BY project_id",
)


def _entries(s, d):
    e = _e(s, d).where(W.sync_blocker(F.col("event_type")).isNull())
    path = F.concat(F.lit("sessions/"), T.path_component(F.col("source_session_id")), F.lit("/events/"), T.path_component(F.col("id")), F.lit(".json"))
    return e.select("project_id", F.lit("event").alias("kind"), F.col("id").alias("ref_id"), "content_hash", path.alias("sync_path"))


_add(
    "manifest_root_hash",
    lambda s, d: W.manifest_root(_entries(s, d), "project_id"),
    E + f", entries AS (SELECT project_id, 'event' AS kind, id AS ref_id, content_hash, 'sessions/' || source_session_id || '/events/' || replace(id, ':', '_') || '.json' AS sync_path FROM stored WHERE {BLOCKER_SQL} IS NULL) SELECT project_id, 'sha256:' || sha256(string_agg(concat_ws(chr(9), kind, ref_id, content_hash, sync_path) || chr(10), '' ORDER BY kind, ref_id, sync_path)) AS root_hash, count(*) AS entries FROM entries GROUP BY project_id",
)
_add(
    "evidence_bundle_hash",
    lambda s, d: X.evidence_hash(W.tail_per_project(_e(s, d), 20), SCHEME, "project_id"),
    E + ", tail AS (SELECT * FROM stored QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY timestamp DESC, id DESC) <= 20) SELECT project_id, 'sha256:' || sha256(string_agg('store://event/' || id || chr(9) || content_text || chr(10), '' ORDER BY timestamp, id)) AS evidence_hash FROM tail GROUP BY project_id",
)
_add("events_tail_per_project", lambda s, d: W.tail_per_project(_e(s, d), 5).select("project_id", "id", "timestamp"), E + " SELECT project_id, id, timestamp FROM stored QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY timestamp DESC, id DESC) <= 5")
STATE_SQL = "CASE WHEN seq % 11 = 0 THEN 'synced' WHEN " + BLOCKER_SQL + " IS NOT NULL THEN 'blocked' ELSE 'pending' END"


def _with_status(s, d):
    return _e(s, d).withColumn("sync_status", F.when(F.col("seq") % 11 == 0, "synced").when(W.sync_blocker(F.col("event_type")).isNotNull(), "blocked").otherwise("pending"))


_add("status_histogram", lambda s, d: _with_status(s, d).groupBy("source", "sync_status").agg(F.count(F.lit(1)).alias("events")), E + f" SELECT source, {STATE_SQL} AS sync_status, count(*) AS events FROM stored GROUP BY ALL")
_add(
    "sync_state",
    lambda s, d: _with_status(s, d).groupBy("project_id").agg(F.bool_or(F.col("sync_status") == "blocked").alias("b"), F.bool_or(F.col("sync_status") == "pending").alias("p"), F.bool_or(F.col("sync_status") == "synced").alias("r"))
    .select("project_id", W.sync_state(F.col("project_id") != "proj-3", F.col("b") & (F.col("project_id") != "proj-4"), F.col("r"), F.col("p")).alias("state")),
    E + f", st AS (SELECT project_id, {STATE_SQL} AS s FROM stored), g AS (SELECT project_id, bool_or(s = 'blocked') AS b, bool_or(s = 'pending') AS p, bool_or(s = 'synced') AS r FROM st GROUP BY project_id) SELECT project_id, CASE WHEN project_id = 'proj-3' THEN 'remote_unavailable' WHEN b AND project_id <> 'proj-4' THEN 'blocked' WHEN NOT r AND NOT p THEN 'remote_missing' WHEN p THEN 'pending' ELSE 'synced' END AS state FROM g",
)
C = "WITH " + V.CLAIMS_SQL
_add(
    "memory_status",
    lambda s, d: V.claims(s, d).select("memory_id", W.memory_status(F.col("confidence"), F.col("status")).alias("status"), W.kind_is_safe(F.col("kind")).alias("shareable"), W.observation_problem(F.col("kind"), F.col("claim"), F.col("confidence"), F.col("evidence_refs")).alias("problem")),
    C + " SELECT memory_id, CASE WHEN status = 'rejected' THEN status WHEN confidence >= 0.8 THEN 'active' ELSE 'pending' END AS status, regexp_matches(lower(trim(kind)), '^[a-z0-9_-]{1,64}$') AND NOT regexp_matches(lower(kind), 'identity|personal|secret|credential|sensitive') AS shareable, NULL::VARCHAR AS problem FROM claims",
)
_add("memory_ref_check", lambda s, d: W.missing_refs(V.claims(s, d), V.events(s, d)), C + ", " + V.EVENTS_SQL + ", refs AS (SELECT memory_id, project_id, unnest(evidence_refs) AS ref FROM claims) SELECT memory_id, ref FROM refs r WHERE NOT EXISTS (SELECT 1 FROM store s WHERE s.project_id = r.project_id AND s.source_event_id = r.ref)")
_add(
    "memory_ref_remap_strict",
    lambda s, d: W.remap_refs_strictly(V.claims(s, d), V.events(s, d).where("source_event_id is not null").select(F.col("source_event_id").alias("old"), F.concat(F.lit("remote-"), "source_event_id").alias("new"))).select("memory_id", F.array_join("refs", ",").alias("refs"), "problem"),
    C + ", " + V.EVENTS_SQL + """, known AS (SELECT DISTINCT source_event_id AS r FROM store WHERE source_event_id IS NOT NULL),
    first AS (SELECT memory_id, evidence_refs, CASE WHEN evidence_refs[1] NOT IN (SELECT r FROM known) THEN evidence_refs[1] WHEN evidence_refs[2] NOT IN (SELECT r FROM known) THEN evidence_refs[2] END AS lost FROM claims)
    SELECT memory_id, CASE WHEN lost IS NULL THEN 'remote-' || least(evidence_refs[1], evidence_refs[2]) || CASE WHEN evidence_refs[1] <> evidence_refs[2] THEN ',remote-' || greatest(evidence_refs[1], evidence_refs[2]) ELSE '' END END AS refs,
      'remote learned memory references missing evidence: ' || lost AS problem FROM first""",
)
_add(
    "memory_ref_remap",
    lambda s, d: W.remap_refs(V.claims(s, d), V.events(s, d).where("source_event_id is not null").select(F.col("source_event_id").alias("old"), F.concat(F.lit("remote-"), "source_event_id").alias("new"))).select("memory_id", F.array_join("refs", ",").alias("refs")),
    C + ", " + V.EVENTS_SQL + ", refs AS (SELECT memory_id, unnest(evidence_refs) AS old FROM claims), j AS (SELECT r.memory_id, 'remote-' || s.source_event_id AS new FROM refs r LEFT JOIN store s ON s.source_event_id = r.old) SELECT memory_id, string_agg(DISTINCT new, ',' ORDER BY new) AS refs FROM j GROUP BY memory_id HAVING count(*) = count(new)",
)


# peers and bundles
def _peers(s, d):
    m = _m(s, d)
    return W.peer_union(m.where("line_index % 2 = 0"), ("alpha", m.where("line_index % 3 <> 1")), ("beta", m))


_add("peer_union_dedup", lambda s, d: _peers(s, d).select("session_id", "line_index", "origin"), M + " SELECT session_id, line_index, CASE WHEN line_index % 2 = 0 THEN NULL WHEN line_index % 3 <> 1 THEN 'alpha' ELSE 'beta' END AS origin FROM messages QUALIFY row_number() OVER (PARTITION BY source, project_name, session_id, timestamp, role, content ORDER BY line_index % 2, line_index) = 1")


def _files(s, d):
    return _m(s, d).select("session_id", F.concat(F.lit("files/"), "line_index", F.lit("-"), "role", F.lit(".txt")).alias("path"), "content", F.sha2("content", 256).alias("sha256"))


FILES_SQL = M + ", files AS (SELECT session_id, 'files/' || line_index || '-' || role || '.txt' AS path, content, sha256(content) AS sha256 FROM messages)"
_add("bundle_id", lambda s, d: W.bundle_id(_files(s, d), "session_id"), FILES_SQL + " SELECT session_id, 'tp:v1:' || sha256(string_agg(path || ':' || sha256, '|' ORDER BY path)) AS bundle_id, count(*) AS files FROM files GROUP BY session_id")
_add(
    "bundle_verify",
    lambda s, d: _files(s, d).withColumn("stated", F.when(F.length("content") % 10 == 0, F.sha2(F.concat("content", F.lit("!")), 256)).otherwise(F.col("sha256"))).where("stated <> sha256").select("session_id", "path", F.lit("hash mismatch").alias("problem")),
    FILES_SQL + " SELECT session_id, path, 'hash mismatch' AS problem FROM files WHERE length(content) % 10 = 0",
)
PAIRS = [("/home/dev", "/srv/work"), ("/proj", "/p")]
_add("path_remap", lambda s, d: _m(s, d).select("session_id", "line_index", T.remap_paths(F.col("project_path"), PAIRS).alias("path")), M + " SELECT session_id, line_index, replace(replace(project_path, '/home/dev', '/srv/work'), '/proj', '/p') AS path FROM messages")
_add(
    "export_tree",
    lambda s, d: _e(s, d).select(
        F.concat_ws("/", T.path_component(F.col("source")), T.path_component(F.col("source_session_id")), F.concat(T.path_component(F.col("id")), F.lit(".md"))).alias("path"),
        F.concat(F.lit("# "), "event_type", F.lit("\n\n- time: "), "timestamp", F.lit("\n\n"), "content_text", F.lit("\n")).alias("contents"),
    ),
    E + " SELECT source || '/' || source_session_id || '/' || replace(id, ':', '_') || '.md' AS path, '# ' || event_type || chr(10) || chr(10) || '- time: ' || timestamp || chr(10) || chr(10) || content_text || chr(10) AS contents FROM stored",
)
_add("masked_paths", lambda s, d: _e(s, d).select("seq", T.mask_paths(F.concat(F.lit("cat /home/me/f.txt, "), "content_text")).alias("masked")), E + " SELECT seq, regexp_replace('cat /home/me/f.txt, ' || content_text, '/(Users|home|tmp|var|private)/[^\"'' \\t\\n\\r,}\\])(]*', '[LOCAL_PATH]', 'g') AS masked FROM stored")
_add(
    "write_if_absent",
    lambda s, d: W.write_if_absent(_files(s, d).select(F.concat_ws("/", "session_id", "path").alias("path"), "sha256"), _files(s, d).where("length(content) % 3 = 0").select(F.concat_ws("/", "session_id", "path").alias("path"), F.when(F.length("content") % 2 == 0, F.lit("other")).otherwise(F.col("sha256")).alias("sha256")), "path", "sha256")[1].select("path"),
    FILES_SQL + " SELECT session_id || '/' || path AS path FROM files WHERE length(content) % 3 = 0 AND length(content) % 2 = 0",
)
