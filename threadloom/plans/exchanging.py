"""Registered queries: stores that exchange events, merged answers, observations, bundles, event capture, scans of files."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadloom.functions import text as T
from threadloom.functions.scratch import fresh
from threadloom.operators import exchange as X
from threadloom.operators import resolve as N
from threadloom.operators import rollups as U
from threadloom.operators import store as W
from threadloom.plans.parsing import _claude_rows, _codex_rows, _json, _obj, _rows, _talk
from threadloom.plans.reading import M, MP, MS
from threadloom.plans.storing import C, E, SCHEME, _e, _files, _m
from threadloom.sources import capture
from threadloom.sources import transcripts as P
from threadloom.sources import views as V

QUERIES, ORACLES = {}, {}


def _add(name, query, sql):
    QUERIES[name], ORACLES[name] = query, sql


# events of another store: some with a wrong version, policy, hash or id
def _remote(s, d):
    e = _e(s, d)
    odd = lambda n, bad, good: F.when(F.col("seq") % n == 0, bad).otherwise(good)
    return e.withColumns(
        {
            "event_id": odd(17, F.concat(F.lit("evt:v1:"), F.lit("0")), F.col("id")), "manifest_version": odd(7, F.lit("v0"), F.lit(X.MANIFEST_VERSION)),
            "redaction_policy_id": odd(11, F.lit(None), F.lit(X.POLICY_ID)), "content_hash": odd(13, F.lit("sha256:0"), F.col("content_hash")),
        }
    )


PROBLEM_SQL = "CASE WHEN seq % 7 = 0 THEN 'manifest version mismatch' WHEN seq % 11 = 0 THEN 'redaction policy mismatch' WHEN seq % 13 = 0 THEN 'content_hash mismatch' WHEN seq % 17 = 0 THEN 'event id mismatch' END"
_add("remote_event_problems", lambda s, d: _remote(s, d).select("seq", X.event_problem().alias("problem")), E + f" SELECT seq, {PROBLEM_SQL} AS problem FROM stored")


def _hydrated(s, d):
    e = _e(s, d)
    # a third of the store's events have another id than the remote's, a third another role, a third are unknown
    stored = e.where("seq % 3 < 2").withColumns({"id": F.when(F.col("seq") % 3 == 0, F.concat(F.lit("local-"), "id")).otherwise(F.col("id")), "role": F.when(F.col("seq") % 3 == 1, F.lit("else")).otherwise(F.col("role"))})
    return X.hydrate(stored, e.withColumnRenamed("id", "event_id"))


_add("hydrate_match", lambda s, d: _hydrated(s, d).select("seq", "local_id", "found"), E + " SELECT seq, CASE WHEN seq % 3 = 0 THEN 'local-' || id ELSE id END AS local_id, (['identity', 'id', 'insert'])[seq % 3 + 1] AS found FROM stored")
_add("hydration_report", lambda s, d: X.hydration_report(_hydrated(s, d)), E + " SELECT count(*) AS remote_events, count(*) FILTER (seq % 3 = 2) AS inserted_events, count(*) FILTER (seq % 3 < 2) AS existing_events FROM stored")

# merged answers: descending turns ties round too
_add("merged_projects", lambda s, d: U.page(U.project_rollup(_m(s, d)), X.merged_order("timestamp", True, ("project_name", "source")), 10), MP + " SELECT * FROM projects ORDER BY last_timestamp DESC, project_name DESC, source DESC LIMIT 10")
_add("merged_projects_by_count", lambda s, d: U.page(U.project_rollup(_m(s, d)), X.merged_order("count", True, ("project_name", "source")), 10), MP + " SELECT * FROM projects ORDER BY message_count DESC, last_timestamp DESC, project_name DESC, source DESC LIMIT 10")
_add("merged_sessions", lambda s, d: U.page(U.session_rollup(_m(s, d)), X.merged_order("timestamp", True, ("session_id", "source")), 20), MS + " SELECT * FROM sessions ORDER BY last_timestamp DESC, session_id DESC, source DESC LIMIT 20")
_add("merged_newest", lambda s, d: X.merged_newest(_m(s, d), 40).select("session_id", "timestamp", "role", "content"), M + " SELECT session_id, timestamp, role, content FROM messages ORDER BY timestamp DESC, session_id DESC, source DESC, project_name DESC, role DESC LIMIT 40")


def _twice(s, d):
    found = U.session_rollup(_m(s, d)).select("source", "project_name", "session_id", "last_timestamp")
    return X.once_in_order(found.unionAll(found.where("session_id like '%3'")).unionAll(found.where("session_id like '%33'")))


_add("merged_sessions_once", _twice, MS + " SELECT source, project_name, session_id, last_timestamp FROM sessions")


def _known(s, d):
    p = U.project_rollup(_m(s, d))
    return p.withColumns({"git_remotes": F.array(F.concat(F.lit(" https://Host/"), F.regexp_replace("project_name", "/", ""), F.lit(".git.git")), F.concat(F.lit("git@host:"), "source")), "aliases": T.project_aliases(F.col("project_name"), F.col("project_path"))})


def _peer(remotes, path, name):
    def run(s, d):
        asked = s.createDataFrame([(remotes, path, name)], "git_remotes array<string>, local_path string, display_name string")
        return N.resolve_peers(_known(s, d).where("source = 'codex'"), asked).select("path")

    return run


_add("resolve_peer_by_remotes", _peer(["git@host:codex", "https://host/projp4.git "], "/else/where", "x"), MP + " SELECT project_path AS path FROM projects WHERE source = 'codex' AND project_name = '/proj/p4'")
_add("resolve_peer_by_path", _peer([], "/proj/p2", "p5"), MP + " SELECT CASE WHEN project_path = '' THEN project_name ELSE project_path END AS path FROM projects WHERE source = 'codex' AND project_name = '/proj/p2'")
_add("resolve_peer_by_name", _peer(["git@other"], "/else/where", "p5"), MP + " SELECT CASE WHEN project_path = '' THEN project_name ELSE project_path END AS path FROM projects WHERE source = 'codex' AND project_name = '/proj/p5'")
_add("resolve_peer_unknown", _peer([], "/else/where", "nothing"), "SELECT '/else/where' AS path")


def _names(who):
    def run(s, d):
        asked = s.createDataFrame([(who,)], "identifier string")
        return N.resolve_names(U.project_rollup(_m(s, d)).where("source = 'codex'"), asked).select(F.explode("names").alias("project_name"))

    return run


_add("resolve_names_exact", _names(" proj/p3 "), "SELECT '/proj/p3' AS project_name")
_add("resolve_names_alias", _names("p4"), "SELECT '/proj/p4' AS project_name")
_add("resolve_names_unknown", _names("nowhere"), "SELECT 'nowhere' AS project_name")


def _split(s, d):
    """Projects of which some moved: every third session's is elsewhere under the same last name, so that names are ambiguous."""
    m = _m(s, d)
    moved = F.col("session_id").rlike("[147]$")
    away = F.concat(F.lit("/old"), "project_name")
    p = U.project_rollup(m.withColumns({c: F.when(moved, away).otherwise(F.col(c)) for c in ("project_name", "project_path")}).where(~(moved & F.col("project_name").rlike("[05]$"))))
    remotes = F.array(F.concat(F.lit(" git@Host:"), F.regexp_extract("project_path", "([^/]*)$", 1), F.lit(".git")))
    return p.withColumns({"git_remotes": remotes, "aliases": T.project_aliases(F.col("project_name"), F.col("project_path"))})


def resolve_names_all(s, d):
    """What every session's folder means, spelled in six ways, among the projects of all sources."""
    seen = _m(s, d).select("project_name", "session_id").distinct()
    base = F.regexp_extract("project_name", "([^/]*)$", 1)
    ways = F.array("project_name", F.concat(F.lit(" "), F.expr("substr(project_name, 2)"), F.lit("\t")), base, F.concat(F.lit("/else/"), base), F.replace("project_name", F.lit("/"), F.lit("-")), F.concat(F.lit("none/"), "session_id"))
    found = N.resolve_names(_split(s, d), seen.select(F.explode(ways).alias("identifier")))
    return found.select("identifier", "tier", F.array_join("names", "|").alias("names"), "problem")


def resolve_peers_all(s, d):
    """Under which path a peer knows each session's project: asked by remotes, by path, by name and by nothing it knows."""
    seen = _m(s, d).select("project_name", "session_id").distinct()
    base = F.regexp_extract("project_name", "([^/]*)$", 1)
    none = F.array().cast("array<string>")
    ways = F.array(*[
        F.struct(r.alias("git_remotes"), p.alias("local_path"), n.alias("display_name"))
        for r, p, n in (
            (F.array(F.concat(F.lit("GIT@host:"), base)), F.lit("/x"), F.col("session_id")), (none, F.col("project_name"), base), (none, F.concat(F.lit("/old"), "project_name"), base),
            (none, F.lit("/x"), base), (F.array(F.lit("git@other")), F.concat(F.lit("/y/"), "session_id"), F.lit("nothing")),
        )
    ])
    found = N.resolve_peers(_split(s, d), seen.select(F.explode(ways).alias("w")).select("w.*"))
    return found.withColumn("git_remotes", F.array_join("git_remotes", " "))


_SPLIT = """, moved AS (SELECT regexp_matches(session_id, '[147]$') AS mv, * FROM messages),
placed AS (SELECT source, CASE WHEN mv THEN '/old' ELSE '' END || project_name AS n, CASE WHEN mv THEN '/old' || project_name ELSE project_path END AS p, timestamp, source_file, line_index
  FROM moved WHERE NOT (mv AND regexp_matches(project_name, '[05]$'))),
pr AS (SELECT source, n, coalesce(first(p ORDER BY source_file, line_index) FILTER (p <> ''), '') AS p, max(timestamp) AS lt, count(*) AS mc FROM placed GROUP BY ALL),
pl AS (SELECT *, CASE WHEN p = '' THEN n ELSE p END AS place, regexp_extract(n, '([^/]*)$', 1) AS bn, regexp_extract(p, '([^/]*)$', 1) AS bp FROM pr),
al AS (SELECT DISTINCT n, place, a FROM (SELECT n, place, unnest([bn, bp, replace(n, '/', '-'), replace(p, '/', '-')]) AS a FROM pl) WHERE a <> '' AND a <> n),
seen AS (SELECT DISTINCT project_name AS f, session_id AS s, regexp_extract(project_name, '([^/]*)$', 1) AS b FROM messages)"""
_add(
    "resolve_names_all",
    resolve_names_all,
    M + _SPLIT + """, ask AS (SELECT DISTINCT unnest([f, ' ' || substr(f, 2) || chr(9), b, '/else/' || b, replace(f, '/', '-'), 'none/' || s]) AS identifier FROM seen),
t AS (SELECT identifier, trim(identifier, ' ' || chr(9)) AS nm FROM ask),
e AS (SELECT identifier, array_to_string(list_sort(list_distinct(list(n))), '|') AS names FROM (
  SELECT identifier, source, sp, min(n) AS n FROM (SELECT identifier, unnest([nm, CASE WHEN nm LIKE '/%' THEN ltrim(nm, '/') ELSE '/' || nm END]) AS sp FROM t) x JOIN pr ON sp = pr.n OR sp = pr.p GROUP BY ALL) GROUP BY identifier),
g AS (SELECT identifier, count(DISTINCT place) AS places, array_to_string(list_sort(list_distinct(list(n))), '|') AS names FROM t JOIN al ON a = nm OR a = regexp_extract(nm, '([^/]*)$', 1) GROUP BY identifier)
SELECT t.identifier, CASE WHEN e.names IS NOT NULL THEN 'exact' WHEN g.places > 0 THEN 'alias' ELSE 'itself' END AS tier,
  CASE WHEN e.names IS NOT NULL THEN e.names WHEN g.places > 1 THEN NULL WHEN g.places = 1 THEN g.names ELSE t.identifier END AS names,
  CASE WHEN e.names IS NULL AND g.places > 1 THEN 'multiple projects matched alias "' || regexp_extract(nm, '([^/]*)$', 1) || '"; pass an exact project path' END AS problem
FROM t LEFT JOIN e USING (identifier) LEFT JOIN g USING (identifier)""",
)
_add(
    "resolve_peers_all",
    resolve_peers_all,
    M + _SPLIT + """, ask AS (SELECT DISTINCT w.r AS r, w.p AS lp, w.n AS dn FROM (SELECT unnest([{'r': 'GIT@host:' || b, 'p': '/x', 'n': s}, {'r': '', 'p': f, 'n': b}, {'r': '', 'p': '/old' || f, 'n': b},
  {'r': '', 'p': '/x', 'n': b}, {'r': 'git@other', 'p': '/y/' || s, 'n': 'nothing'}]) AS w FROM seen)),
gr AS (SELECT 'git@host:' || bp AS r, min(place) AS lo, count(DISTINCT place) AS k FROM pl WHERE p <> '' GROUP BY ALL),
gp AS (SELECT x AS lp, first(place ORDER BY lt DESC, mc DESC, n, p, source) AS place FROM (SELECT unnest([n, p]) AS x, * FROM pl) GROUP BY x),
gn AS (SELECT x AS dn, min(place) AS lo, count(DISTINCT place) AS k FROM (SELECT unnest([n, bn, bp]) AS x, place FROM pl UNION ALL SELECT a, place FROM al) GROUP BY ALL)
SELECT ask.r AS git_remotes, ask.lp AS local_path, ask.dn AS display_name,
  CASE WHEN gr.k > 0 THEN 'remotes' WHEN gp.place IS NOT NULL THEN 'path' WHEN gn.k > 0 THEN 'name' ELSE 'itself' END AS tier,
  CASE WHEN gr.k > 0 THEN CASE WHEN gr.k = 1 THEN gr.lo END WHEN gp.place IS NOT NULL THEN gp.place WHEN gn.k > 0 THEN CASE WHEN gn.k = 1 THEN gn.lo END ELSE ask.lp END AS path,
  CASE WHEN gr.k > 1 THEN 'multiple remote projects matched git remotes for ' || ask.dn || '; pass an explicit project'
    WHEN gr.k IS NULL AND gp.place IS NULL AND gn.k > 1 THEN 'multiple remote projects matched display name for ' || ask.dn || '; pass an explicit project' END AS problem
FROM ask LEFT JOIN gr ON gr.r = lower(ask.r) LEFT JOIN gp USING (lp) LEFT JOIN gn USING (dn)""",
)
_add(
    "git_remote_sets",
    lambda s, d: _known(s, d).select("source", "project_name", F.array_join(N.git_key(F.col("git_remotes")), " ").alias("remotes")),
    MP + " SELECT source, project_name, 'git@host:' || source || ' https://host/' || replace(project_name, '/', '') AS remotes FROM projects",
)
def _words(s, d):
    """Words of all sorts: ids, texts, ids with a line feed after them, with a comma, and none."""
    kind, own = F.col("line_index") % 5, F.col("session_id")
    word = F.when(kind == 0, own).when(kind == 1, F.col("content")).when(kind == 2, F.concat(own, F.lit("\n"))).when(kind == 3, F.concat(own, F.lit(",b"))).otherwise("")
    return _m(s, d).select("session_id", "line_index", T.shell_quote(word).alias("word"))


# the SQL asks what is left of a word without the characters that need no quotes
_add(
    "quoted", _words,
    M + """, words AS (SELECT session_id, line_index, CASE line_index % 5 WHEN 0 THEN session_id WHEN 1 THEN content WHEN 2 THEN session_id || chr(10) WHEN 3 THEN session_id || ',b' ELSE '' END AS w FROM messages)
    SELECT session_id, line_index, CASE WHEN translate(w, 'abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_@%+=:,./-', '') = '' THEN w
      ELSE chr(39) || replace(w, chr(39), chr(39) || chr(92) || chr(39) || chr(39)) || chr(39) END AS word FROM words""",
)


# observations
def _claims(s, d):
    refs = F.transform("evidence_refs", lambda r: F.when(F.col("memory_id").endswith("7"), r).otherwise(F.concat(F.lit(SCHEME), r)))
    return V.claims(s, d).withColumns({"evidence_refs": F.when(F.col("memory_id").endswith("3"), F.array().cast("array<string>")).otherwise(refs), "kind": F.when(F.col("memory_id").endswith("5"), F.lit(" \t\u2003")).otherwise(F.col("kind"))})


def _valid(s, d):
    return V.events(s, d).where("source_event_id is not null").select(F.concat(F.lit(SCHEME), "source_event_id").alias("ref"))


_add(
    "observation_problems",
    lambda s, d: X.observation_problems(_claims(s, d).withColumn("counterevidence_refs", F.when(F.col("memory_id").endswith("9"), F.array(F.lit(SCHEME + "nowhere")))), _valid(s, d), SCHEME),
    C + ", " + V.EVENTS_SQL + """, known AS (SELECT DISTINCT source_event_id AS r FROM store WHERE source_event_id IS NOT NULL)
    SELECT memory_id, CASE WHEN memory_id LIKE '%5' THEN 'kind is empty' WHEN trim(claim) = '' THEN 'claim is empty' WHEN memory_id LIKE '%3' THEN 'no evidence' WHEN memory_id LIKE '%7' THEN 'invalid evidence ref scheme: ' || evidence_refs[1]
      WHEN evidence_refs[1] NOT IN (SELECT r FROM known) THEN 'missing evidence: store://event/' || evidence_refs[1] WHEN evidence_refs[2] NOT IN (SELECT r FROM known) THEN 'missing evidence: store://event/' || evidence_refs[2]
      WHEN memory_id LIKE '%9' THEN 'missing evidence: store://event/nowhere' END AS problem FROM claims""",
)
_add("observation_counts", lambda s, d: X.status_counts(V.claims(s, d)), C + " SELECT CASE WHEN status = 'rejected' THEN status WHEN confidence >= 0.8 THEN 'active' ELSE 'pending' END AS status, count(*) AS observations FROM claims GROUP BY 1")
_add("unknown_fields", lambda s, d: V.claims(s, d).select("memory_id", F.array_join(X.unknown_fields(F.to_json(F.struct(F.col("claim").alias("claims"), F.col("kind"), F.lit(1).alias("usage"), F.when(F.col("confidence") > 0.5, "x").alias("extra")))), ",").alias("fields")), C + " SELECT memory_id, CASE WHEN confidence > 0.5 THEN 'kind,extra' ELSE 'kind' END AS fields FROM claims")
_add("refs_json", lambda s, d: V.claims(s, d).select("memory_id", W.encode_refs(F.col("evidence_refs")).alias("refs")).withColumn("first", F.get(W.decode_refs(F.col("refs")), F.lit(0))), C + " SELECT memory_id, '[\"' || evidence_refs[1] || '\",\"' || evidence_refs[2] || '\"]' AS refs, evidence_refs[1] AS first FROM claims")
_add("memory_problems", lambda s, d: _claims(s, d).withColumns({"manifest_version": F.lit("v1"), "status": F.when(F.col("memory_id").endswith("1"), "new").otherwise(F.col("status")), "counterevidence_refs": F.lit(None).cast("array<string>")}).select("memory_id", X.memory_problem(SCHEME).alias("problem")), C + """ SELECT memory_id, CASE WHEN memory_id LIKE '%1' THEN 'invalid status' WHEN memory_id LIKE '%3' THEN 'no evidence' WHEN memory_id LIKE '%7' THEN 'invalid evidence ref'
  WHEN memory_id LIKE '%5' OR NOT (regexp_matches(lower(trim(kind)), '^[a-z0-9_-]{1,64}$') AND NOT regexp_matches(lower(kind), 'identity|personal|secret|credential|sensitive')) THEN 'unsafe kind' END AS problem FROM claims""")

# events
SINCE = "2024-01-10T00:00:00"
_add("events_since", lambda s, d: W.events_of(_e(s, d), "codex", SINCE).select("project_id", "timestamp", "id"), E + f" SELECT project_id, timestamp, id FROM stored WHERE source = 'codex' AND timestamp >= '{SINCE}'")
_add("event_multiset", lambda s, d: W.multiset(_e(s, d).unionAll(_e(s, d).where("seq % 4 = 0"))), E + " SELECT id, CASE WHEN seq % 4 = 0 THEN 2 ELSE 1 END::BIGINT AS copies FROM stored")
_add(
    "latest_redaction_run",
    lambda s, d: W.latest_runs(_e(s, d).select(F.concat("source", F.lit("/"), "source_session_id").alias("event_id"), F.col("timestamp").alias("started_at"), F.col("seq").alias("run_id"), F.when(F.col("seq") % 2 == 0, "passed").otherwise("failed").alias("status"))),
    E + " SELECT source || '/' || source_session_id AS event_id, timestamp AS started_at, seq AS run_id, CASE WHEN seq % 2 = 0 THEN 'passed' ELSE 'failed' END AS status FROM stored QUALIFY row_number() OVER (PARTITION BY source, source_session_id ORDER BY timestamp DESC, seq DESC) = 1",
)


# bundles: written, read back, planned
def _bundles(s, d):
    path = fresh(s, "bundles")
    X.write_bundles(_files(s, d), path)
    return X.read_bundles(s, path)


_add("bundle_round_trip", lambda s, d: _bundles(s, d).select("session_id", "path", "sha256", "intact"), M + " SELECT session_id, 'files/' || line_index || '-' || role || '.txt' AS path, sha256(content) AS sha256, true AS intact FROM messages")


def _plan(force):
    def run(s, d):
        files = _m(s, d).select(F.concat("session_id", F.lit("/"), "line_index").alias("path"), "content", F.col("timestamp").alias("ended"), "line_index")
        here = files.where("line_index % 5 > 0").select("path", F.when(F.col("line_index") % 5 == 1, F.col("content")).otherwise(F.lit("old")).alias("content"), F.when(F.col("line_index") % 5 == 2, F.lit("9999")).when(F.col("line_index") % 5 == 3, F.lit("0000")).alias("stamp"))
        return X.apply_plan(files, here, "ended", force=force)

    return run


_add("apply_plan", _plan(False), M + " SELECT session_id || '/' || line_index AS path, (['write', 'skip-identical', 'conflict-newer', 'write', 'conflict-untimestamped'])[line_index % 5 + 1] AS action FROM messages")
_add("apply_plan_forced", _plan(True), M + " SELECT session_id || '/' || line_index AS path, CASE WHEN line_index % 5 = 1 THEN 'skip-identical' ELSE 'write' END AS action FROM messages")

# event capture over rows of every kind; which one a row is goes by the message's place
def _long():
    return F.repeat(F.concat("content", F.lit(" ")), F.lit(40))


def _kinds(m, path, rows):
    """One row a message, of the kind at ``line_index`` modulo the number of kinds."""
    raw = F.lit(None).cast("string")
    for k, row in enumerate(rows):
        raw = F.when(F.col("line_index") % len(rows) == k, row).otherwise(raw)
    return _rows(m, path, (F.col("line_index"), raw))


def _captured(rows, source):
    return capture.capture(rows, source, "p").select("source_session_id", F.regexp_extract("raw_local_ref", ":([0-9]+)$", 1).cast("long").alias("line"), "part", "event_type", "role", "content_text")


def capture_claude(s, d):
    m = _m(s, d)
    row = lambda **k: _json(sessionId=F.col("session_id"), **k)
    said = F.col("content")
    rows = [
        row(type="user", message=_obj(content=said)),
        row(type="assistant", message=_obj(role="assistant", content=F.array(_obj(type="tool_use", id="c1", name="ls", input=_obj(b=F.lit(2), a=F.lit(1)), text=F.lit(None).cast("string"), thinking=F.lit(None).cast("string"))))),
        row(type="assistant", message=_obj(content=F.array(_obj(type="thinking", text=said), _obj(type="text", text=F.lit("t"))))),
        row(type="user", message=_obj(content=F.array(_obj(type="tool_result", tool_use_id="c1", content=F.array(F.array(_obj(text=_long()))))))),
        row(type="system", event="started", content=said), row(type="summary", message=_obj(text=said)), row(type="queue-operation", operation="enqueue", content=said),
        row(type="queue-operation", action="remove"), row(type="attachment"), row(type="file-history-snapshot"), row(type="odd", payload=_obj(text=said)), row(type="user", message=_obj(role="tool", content=said)),
        row(type="user"), row(type="assistant", message=_obj(role="x")), row(type="session", kind="odd"),
    ]
    return _captured(_kinds(m, F.concat(F.lit("/h/.claude/projects/p/"), "source_file"), rows), "claude")


CUT = "CASE WHEN length(long) <= 2000 THEN long ELSE substring(long, 1, 2000) || chr(10) || '... [truncated; omitted_chars=' || (length(long) - 2000) || '; full_content_hash=sha256:' || sha256(long) || ']' END"
_add("capture_claude", capture_claude, M + f""", t AS (SELECT *, line_index % 15 AS k, line_index + 1 AS line, repeat(content || ' ', 40) AS long FROM messages),
p AS (SELECT *, 0 AS part FROM t UNION ALL SELECT *, 1 FROM t WHERE k = 2)
SELECT session_id AS source_session_id, line, part::INT AS part,
  CASE WHEN part = 1 THEN 'assistant_turn' ELSE (['user_turn','tool_call','compaction','tool_result','session_start','compaction','user_turn','unknown_raw_event','unknown_raw_event','unknown_raw_event','unknown_raw_event','tool_result','unknown_raw_event','unknown_raw_event','unknown_raw_event'])[k + 1] END AS event_type,
  CASE WHEN part = 1 THEN 'assistant' ELSE (['user','assistant','assistant','tool','system','system','user','system','system','system','system','tool','system','system','system'])[k + 1] END AS role,
  CASE WHEN part = 1 THEN 't' WHEN k = 1 THEN 'ls {{"a":1,"b":2}}' WHEN k = 3 THEN {CUT} WHEN k = 7 THEN 'Claude queue operation: remove' WHEN k = 8 THEN 'Claude attachment metadata omitted; see local raw ref'
    WHEN k = 9 THEN 'Claude file-history-snapshot metadata omitted; see local raw ref' WHEN k = 12 THEN 'Claude user row missing message payload' WHEN k = 13 THEN 'Claude assistant message missing content for role x'
    WHEN k = 14 THEN 'Claude lifecycle event: odd' ELSE content END AS content_text FROM p""")


def capture_codex(s, d):
    m = _m(s, d)
    said = F.col("content")
    item = lambda **k: _json(type="response_item", payload=_obj(**k))
    rows = [
        _json(type="session_meta", payload=_obj(id=F.col("session_id"), cwd="/secret", model_provider="mp")), _json(type="event_msg", payload=_obj(type="user_message", message=said)),
        item(role="assistant", content=F.array(_obj(type="output_text", text=said), _obj(type="output_text", text=F.lit("more")))), item(type="function_call", name="sh", arguments=F.concat(F.lit('{"a": "'), "role", F.lit('"}'))),
        item(type="function_call_output", output=_long()), item(type="reasoning", summary=F.array(_obj(type="summary_text", text=said))), _json(type="event_msg", payload=_obj(type="agent_reasoning", message=said)),
        item(role="tool", content=F.array(said)), item(role="developer", content=said), _json(type="event_msg", payload=_obj(n=F.lit(1), type="token_count")), _json(type="turn_context"), item(type="tool_call"),
    ]
    return _captured(_kinds(m, F.concat(F.lit("/h/.codex/sessions/"), "source_file"), rows), "codex")


_add("capture_codex", capture_codex, M + """, t AS (SELECT *, line_index % 12 AS k, line_index + 1 AS line, repeat(content || ' ', 40) AS long FROM messages)
SELECT session_id AS source_session_id, line, 0 AS part, (['session_start','user_turn','assistant_turn','tool_call','tool_result','compaction','compaction','tool_result','unknown_raw_event','unknown_raw_event','unknown_raw_event','tool_call'])[k + 1] AS event_type,
  (['system','user','assistant','assistant','tool','assistant','system','tool','developer','system','system','assistant'])[k + 1] AS role,
  CASE k WHEN 0 THEN 'Codex session ' || session_id || chr(10) || 'project: linked' || chr(10) || 'model_provider: mp' WHEN 2 THEN content || chr(10) || 'more' WHEN 3 THEN 'sh "{\\"a\\": \\"' || role || '\\"}"' WHEN 4 THEN long
    WHEN 9 THEN '{"n":1,"type":"token_count"}' WHEN 10 THEN '{"type":"turn_context"}' WHEN 11 THEN 'tool {"type":"tool_call"}' ELSE content END AS content_text FROM t""")


def capture_cursor(s, d):
    m = _m(s, d)
    said = F.col("content")
    row = lambda **k: _json(sessionId=F.col("session_id"), **k)
    block = lambda role, **k: row(role=role, message=_obj(content=F.array(_obj(**k))))
    rows = [
        row(type="session_start"), row(role="user", message=_obj(content=said)), block("assistant", type="text", text=said), block("assistant", type="function_call", name="cat", arguments="/home/me/x.txt"),
        block("assistant", type="tool_output", output=_long()), block("assistant", type="reasoning"), row(type="summary", content=said), row(type="session_end"), row(role="assistant", content=_obj(content=F.array(said))),
        row(role="user", content=F.lit(5)), row(type="odd"), block("user", type="image"),
    ]
    return _captured(_kinds(m, F.concat(F.lit("/h/.cursor/projects/p/"), "source_file"), rows), "cursor")


_add("capture_cursor", capture_cursor, M + f""", t AS (SELECT *, line_index % 12 AS k, line_index + 1 AS line, repeat(content || ' ', 40) AS long FROM messages)
SELECT session_id AS source_session_id, line, 0 AS part, (['session_start','user_turn','assistant_turn','tool_call','tool_result','compaction','compaction','session_end','assistant_turn','unknown_raw_event','unknown_raw_event','user_turn'])[k + 1] AS event_type,
  (['system','user','assistant','assistant','tool','assistant','system','system','assistant','system','system','user'])[k + 1] AS role,
  CASE k WHEN 0 THEN 'Cursor session started' WHEN 3 THEN 'cat "[LOCAL_PATH]"' WHEN 4 THEN {CUT} WHEN 5 THEN 'Cursor reasoning metadata omitted' WHEN 7 THEN 'Cursor session ended' WHEN 9 THEN 'Cursor user row had unsupported content shape'
    WHEN 10 THEN 'Cursor unknown event role/type: odd' WHEN 11 THEN 'Cursor content block metadata omitted: image' ELSE content END AS content_text FROM t""")


def capture_fixture(s, d):
    m = _m(s, d)
    said = F.col("content")
    row = lambda **k: _json(session_id=F.col("session_id"), **k)
    rows = [row(type="note", content=said), row(event_type="tool_output", message=_obj(role="t", content=F.array(said))), row(type="message", role="assistant", message=said), row(type="event_msg", payload=_obj(message=said)), row(type="what", n=F.lit(1))]
    return _captured(_kinds(m, F.concat(F.lit("/h/fixture/"), "source_file"), rows), "fixture")


_add("capture_fixture", capture_fixture, M + """, t AS (SELECT *, line_index % 5 AS k, line_index + 1 AS line FROM messages)
SELECT session_id AS source_session_id, line, 0 AS part, (['user_turn','tool_result','assistant_turn','user_turn','unknown_raw_event'])[k + 1] AS event_type, (['user','t','assistant','user','system'])[k + 1] AS role,
  CASE k WHEN 4 THEN '{"n":1,"session_id":"' || session_id || '","type":"what"}' ELSE content END AS content_text FROM t""")

# discovery by folder
_add("discover_claude", lambda s, d: capture.discover(_claude_rows(_talk(s, d)), "claude", "/proj/p3"), M + ", t AS (SELECT * FROM messages WHERE role IN ('user', 'assistant')) SELECT 'claude' AS source, session_id, '/h/.claude/projects/p/' || source_file AS path FROM t GROUP BY ALL HAVING min(project_name) = '/proj/p3' AND bool_or(line_index % 2 = 0)")
_add("discover_codex", lambda s, d: capture.discover(_codex_rows(_talk(s, d)), "codex", "/proj/p3"), M + " SELECT DISTINCT 'codex' AS source, session_id, '/h/.codex/sessions/' || source_file AS path FROM messages WHERE project_name = '/proj/p3' AND role IN ('user', 'assistant')")


# files of every layout, written and scanned
def _scanned(s, d):
    home = fresh(s, "home")
    m = _talk(s, d)
    plain = lambda c: _obj(content=F.array(_obj(type="text", text=c)))
    ms = F.unix_millis(F.to_timestamp("timestamp"))
    kind = F.when(F.col("role") == "user", "user_message_chunk").otherwise("agent_message_chunk")
    raw = (
        F.when(F.col("source") == "claude", _json(type=F.col("role"), sessionId=F.col("session_id"), timestamp=F.col("timestamp"), cwd=F.col("project_name"), message=plain(F.col("content"))))
        .when(F.col("source") == "codex", F.when(F.col("role") == "user", _json(type="event_msg", timestamp=F.col("timestamp"), payload=_obj(type="user_message", message=F.col("content")))).otherwise(_json(type="response_item", timestamp=F.col("timestamp"), payload=_obj(role="assistant", content=F.array(_obj(type="output_text", text=F.col("content")))))))
        .when(F.col("source") == "cursor", _json(role=F.col("role"), timestamp=F.col("timestamp"), message=plain(F.col("content"))))
        .when(F.col("source") == "grok", _json(params=_obj(_meta=_obj(agentTimestampMs=ms), update=_obj(sessionUpdate=kind, content=_obj(type="text", text=F.col("content"))))))
        .otherwise(_json(type="message", timestamp=F.col("timestamp"), message=_obj(role=F.col("role"), content=F.array(_obj(type="text", text=F.col("content"))))))
    )
    head = F.when(F.col("source") == "codex", _json(type="session_meta", payload=_obj(id=F.col("session_id"), cwd=F.col("project_name")))).when(F.col("source") == "pi", _json(type="session", id=F.col("session_id"), cwd=F.col("project_name")))
    heads = m.select("source", "session_id", F.lit(-1).cast("long").alias("n"), head.alias("value")).where("value is not null").distinct()
    rows = m.select("source", "session_id", F.col("line_index").alias("n"), raw.alias("value")).unionByName(heads)
    below = {"claude": "projects/p", "codex": "sessions/d", "cursor": "projects/p/agent-transcripts", "grok": "sessions/%2Fw", "pi": "agent/sessions/p"}
    for source, folder in below.items():
        own = rows.where(F.col("source") == source).repartition("session_id").sortWithinPartitions("session_id", "n")
        own.select("session_id", "value").write.partitionBy("session_id").text(f"{home}/.{source}/{folder}")
    return P.load_messages(s, home, pattern="*.txt")


_add(
    "scan_home",
    lambda s, d: _scanned(s, d).select("source", F.regexp_extract("session_id", "([^=]*)$", 1).alias("session_id"), "role", "content", "timestamp"),
    M + """, t AS (SELECT *, CASE WHEN source = 'grok' THEN sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY line_index) ELSE line_index END AS island FROM messages WHERE role IN ('user', 'assistant'))
    SELECT source, session_id, role, string_agg(content, '' ORDER BY line_index) AS content, min(timestamp) AS timestamp FROM t GROUP BY source, session_id, role, island""",
)


def _texts(s, d):
    rows = _claude_rows(_talk(s, d))
    lines = F.array_sort(F.collect_list(F.struct("line_index", "raw")))
    return rows.groupBy("path").agg(F.concat(F.array_join(F.transform(lines, lambda r: r["raw"]), "\n"), F.lit("\n{\"unfinished")).alias("value"))


_add("scan_warnings", lambda s, d: capture.warnings(_texts(s, d)).groupBy("path").agg(F.count(F.lit(1)).alias("warnings")), M + " SELECT '/h/.claude/projects/p/' || source_file AS path, count(*) AS warnings FROM messages WHERE role IN ('user', 'assistant') GROUP BY 1")
_add("scan_cursors", lambda s, d: capture.cursors(_texts(s, d)).select("path", F.regexp_extract("cursor", "^line:([0-9]+);", 1).cast("long").alias("lines")), M + " SELECT '/h/.claude/projects/p/' || source_file AS path, 2 * count(*) AS lines FROM messages WHERE role IN ('user', 'assistant') GROUP BY 1")
