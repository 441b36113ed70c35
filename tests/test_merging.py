import json

import pytest
from pyspark.sql import functions as F

from threadloom.functions import ids
from threadloom.functions.digests import streamed_digest
from threadloom.operators import merging as G
from threadloom.operators import redact as D
from threadloom.operators import syncing as Y

SESSIONS = G.RULES["sessions"]
COLUMNS = "project_id string, source string, source_session_id string, started_at string, updated_at string, raw_local_ref string, created_at string"
DOCS = G.RULES["search_documents"]
DOC_COLUMNS = "event_id string, document_text string, citation string, updated_at string, source string, seq int"


def sessions(spark, *rows):
    return spark.createDataFrame([(*r,) for r in rows], COLUMNS + ", seq int")


def plain_merge(stored, batch, rule, order):
    """One row after the other, as a table with a unique key does."""
    table = {tuple(r[k] for k in rule.key): dict(r) for r in stored}
    for row in sorted(batch, key=lambda r: [r[c] for c in order]):
        row = {k: v for k, v in row.items() if k not in order}
        key = tuple(row[k] for k in rule.key)
        if key not in table:
            table[key] = row
        else:
            table[key] |= {c: row[c] for c in rule.replaced} | {c: row[c] for c in rule.filled if row[c] is not None}
    return sorted(map(str, table.values()))


def rows_of(df):
    return sorted(str(r.asDict()) for r in df.collect())


def test_merge_is_row_after_row(spark):
    rows = [(f"p{i % 2}", "a" if i % 3 else None, f"s{i % 5}", f"t{i}", None if i % 4 == 0 else f"u{i}", f"r{i}" if i % 7 == 3 else None, f"c{i}", i) for i in range(60)]
    batch = sessions(spark, *rows)
    assert rows_of(G.merge(None, batch, SESSIONS, ("seq",))) == plain_merge([], [r.asDict() for r in batch.collect()], SESSIONS, ("seq",))
    old = G.merge(None, batch.where("seq < 13"), SESSIONS, ("seq",))
    new = batch.where("seq >= 13")
    expected = plain_merge([r.asDict() for r in old.collect()], [r.asDict() for r in new.collect()], SESSIONS, ("seq",))
    assert rows_of(G.merge(old, new, SESSIONS, ("seq",))) == expected
    # a batch merged on its own first gives the same
    assert rows_of(G.merge(old, G.merge(None, new, SESSIONS, ("seq",)), SESSIONS)) == expected
    assert rows_of(G.merge(old, new.limit(0), SESSIONS, ("seq",))) == rows_of(old)


def test_rules_that_never_replace_and_repeats(spark):
    aliases = spark.createDataFrame([("local", "x", "p1"), ("local", "x", "p1")], "source string, alias string, project_id string")
    stored = spark.createDataFrame([("local", "x", "p0")], aliases.schema)
    assert rows_of(G.merge(stored, aliases, G.RULES["project_aliases"])) == rows_of(stored)
    both = spark.createDataFrame([("k", "a"), ("k", "b")], "name string, adapter_version string").withColumns({"enabled": F.lit(1), "updated_at": F.lit("t")})
    again = [rows_of(G.merge(None, both.orderBy(F.desc("adapter_version") if i else F.asc("adapter_version")).repartition(3), G.RULES["sources"])) for i in range(2)]
    assert again[0] == again[1]  # without an order the result doesn't hang on the rows' places


def docs(spark, ids_, text, seq=0):
    return spark.createDataFrame([(i, f"{text} {i}", f"c:{i}", "t", "s", seq) for i in ids_], DOC_COLUMNS)


def test_versions_conflict_and_stay_readable(spark, tmp_path):
    root = "file://" + str(tmp_path / "store")
    assert G.latest(spark, root) == 0
    batch = docs(spark, [f"e{i}" for i in range(40)], "old")
    one = G.commit(spark, root, 0, {"search_documents": (batch, DOCS, ("seq",))}, buckets=8)
    before = json.loads((tmp_path / "store/versions/0000000001.json").read_text())
    two = G.commit(spark, root, one, {"search_documents": (docs(spark, ["e3", "new"], "again"), DOCS, ("seq",)), "sources": (spark.createDataFrame([("codex", "1", 1, "t")], "name string, adapter_version string, enabled int, updated_at string"), G.RULES["sources"], ())})
    assert G.latest(spark, root) == two == 2
    table = {r.event_id: r.document_text for r in G.read_table(spark, root, "search_documents").collect()}
    assert len(table) == 41 and table["e3"] == "again e3" and table["e4"] == "old e4" and table["new"] == "again new"
    assert {r.event_id: r.document_text for r in G.read_table(spark, root, "search_documents", one).collect()}["e3"] == "old e3"
    after = json.loads((tmp_path / "store/versions/0000000002.json").read_text())
    same = [b for b, p in before["search_documents"]["buckets"].items() if after["search_documents"]["buckets"][b] == p]
    assert len(before["search_documents"]["buckets"]) - len(same) <= 2  # only touched buckets are written
    # a writer who started from the first version comes too late, with both tables
    with pytest.raises(G.Conflict):
        G.commit(spark, root, one, {"search_documents": (docs(spark, ["e5"], "late"), DOCS, ("seq",)), "sources": (G.read_table(spark, root, "sources").withColumn("name", F.lit("late")), G.RULES["sources"], ())})
    assert G.latest(spark, root) == two and "late" not in str(G.read_table(spark, root, "search_documents").collect() + G.read_table(spark, root, "sources").collect())
    assert not [p for p in (tmp_path / "store/versions").iterdir() if p.name.startswith("_")]
    got = G.rows_of(spark, root, "search_documents", spark.createDataFrame([("e7",), ("none",)], "event_id string"))
    assert [r.event_id for r in got.collect()] == ["e7"]


def test_empty_batches_and_other_keys(spark, tmp_path):
    root = "file://" + str(tmp_path / "store")
    empty = docs(spark, ["x"], "t").limit(0)
    assert G.commit(spark, root, 0, {"search_documents": (empty, DOCS, ("seq",))}) == 1
    assert G.read_table(spark, root, "search_documents").count() == 0
    with pytest.raises(ValueError):
        G.commit(spark, root, 1, {"search_documents": (empty, G.Rule(("citation",)), ("seq",))})
    assert G.latest(spark, root) == 1


def test_streamed_digest_equals_the_collected_one(spark):
    rows = spark.range(20000).selectExpr("if(id % 3 = 0, 'hot', concat('g', id % 50)) g", "id * 7919 % 20011 k", "if(id % 11 = 0, null, concat('line ä ', id, '\\n')) line")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 100)
    try:
        got = {r.g: (r.digest, r.lines) for r in streamed_digest(rows, ("g",), ("k",), F.col("line")).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {r.g: (r.d, r.n) for r in rows.groupBy("g").agg(ids.ordered_digest(F.col("k"), F.coalesce("line", F.lit(""))).alias("d"), F.count(F.lit(1)).alias("n")).collect()}
    assert got == want and len(got) > 30
    assert streamed_digest(rows.limit(0), ("g",), ("k",), F.col("line")).count() == 0
    two = streamed_digest(rows.withColumn("h", F.lit(None).cast("int")), ("g", "h"), ("k",), F.col("line"))
    assert {r.g: (r.digest, r.lines) for r in two.collect()} == want


EVENT = "id string, project_id string, source string, source_session_id string, source_event_id string, event_type string, role string, timestamp string, content_text string, parent_hash string, parser_version string"


def event(i, text, kind="user_turn", project="p"):
    return (f"evt:{i}", project, "codex", "s 1", None, kind, "user", f"t{i}", text, None, "v1")


def test_events_are_judged_and_projected(spark):
    rows = [event(1, "plain"), event(2, "mail a@example.com"), event(3, "api_key=hunter2hunter2"), event(4, "x", "tool_call"), event(5, None), event(6, "ghp_" + "a1B2" * 9 + " api_key=hunter2hunter2", "tool_result")]
    got = {r.id: r for r in Y.project_events(spark.createDataFrame(rows, EVENT)).collect()}
    assert [got[f"evt:{i}"].passed for i in range(1, 7)] == [True, True, False, False, True, False]
    assert got["evt:2"].redacted == "mail [REDACTED:private_email]" and got["evt:2"].remote_id != got["evt:2"].id
    assert got["evt:4"].reasons == ["tool_call events require a dedicated safe sync projection"] and got["evt:4"].event_path is None
    assert got["evt:6"].reasons[0].startswith("tool_result events") and len(got["evt:6"].reasons) >= 2
    assert got["evt:1"].event_path == f"projects/p/sessions/s_1/events/{got['evt:1'].remote_id.replace(':', '_')}.json"
    blind = Y.project_events(spark.createDataFrame(rows[:1], EVENT), D.null_detector).collect()
    assert not blind[0].passed and blind[0].reasons == ["detector unavailable"]


MEMORY = "memory_id string, project_id string, kind string, claim string, confidence double, status string, evidence_refs array<string>, counterevidence_refs array<string>, created_at string"


def test_memory_that_may_go_and_that_may_not(spark):
    projected = Y.project_events(spark.createDataFrame([event(1, "a"), event(2, "b"), event(3, "c", "tool_call"), event(4, "d", project="q")], EVENT))
    row = lambda i, **k: ({"memory_id": f"m{i}", "project_id": "p", "kind": "Fact", "claim": "said", "confidence": 0.9, "status": "active", "evidence_refs": ["u/evt:1"], "counterevidence_refs": None, "created_at": "t"} | k)
    rows = [
        row(1), row(2, status="pending"), row(3, kind="secret"), row(4, claim="api_key=hunter2hunter2"), row(5, evidence_refs=[]), row(6, evidence_refs=None), row(7, evidence_refs=["u/evt:3"]),
        row(8, evidence_refs=["u/evt:4"]), row(9, counterevidence_refs=["u/none"]), row(10, evidence_refs=["u/evt:2", "u/evt:1", "u/evt:1"], counterevidence_refs=["u/evt:2"]), row(11, kind=None), row(12, claim=None), row(13, claim="mail a@example.com"),
    ]
    got = {r.memory_id: r for r in Y.project_memory(spark.createDataFrame([tuple(r.values()) for r in rows], MEMORY), projected, "u/").collect()}
    assert {k for k, r in got.items() if r.passed} == {"m1", "m10", "m12", "m13"} and "m2" not in got
    assert len(got["m10"].evidence_refs) == 2 and got["m10"].evidence_refs == sorted(got["m10"].evidence_refs) and len(got["m10"].counterevidence_refs) == 1
    assert got["m1"].kind == "fact" and got["m13"].claim == "mail [REDACTED:private_email]" and got["m3"].remote_id is None
    report = Y.sync_report(projected, Y.project_memory(spark.createDataFrame([tuple(rows[0].values())], MEMORY), projected, "u/"), Y.manifest_entries(projected), "r").collect()
    by = {r.project_id: r for r in report}
    assert (by["p"].synced_events, by["p"].blocked_events, by["p"].uploaded_events, by["p"].uploaded_learned_memory, by["p"].status) == (2, 1, 0, 1, "partial")
    assert by["q"].status == "synced" and by["q"].synced_learned_memory == 0
    alone = Y.sync_report(projected.where("id = 'evt:3'"), None, Y.manifest_entries(projected), "r").collect()[0]
    assert alone.status == "blocked" and alone.root_hash == "sha256:e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


OBSERVATION = "run_id string, seq int, kind string, claim string, confidence double, status string, evidence_refs array<string>, counterevidence_refs array<string>"


def test_a_run_completes_once_and_whole(spark, tmp_path):
    events = spark.createDataFrame([("p", "e1"), ("q", "e2")], "project_id string, id string")
    runs = spark.createDataFrame([(f"r{i}", "p", "failed" if i == 2 else "running", None, None) for i in range(1, 6)], "run_id string, project_id string, status string, output_hash string, completed_at string")
    done = spark.createDataFrame([(f"r{i}", "h", "t") for i in (1, 2, 3, 4, 9)] + [("r1", "later", "u")], "run_id string, output_hash string, completed_at string")
    ok = lambda r, seq=0, refs=("u/e1",), status="pending", against=None: (r, seq, "k", "c", 0.5, status, list(refs), against)
    candidates = spark.createDataFrame([ok("r1", refs=("u/e1", "u/e1")), ok("r3", 1, ("u/e2",)), ok("r3", 0), ok("r5")], OBSERVATION)
    memory = spark.createDataFrame([ok("r1", status="active"), ok("r4", status="active", against=["else"]), ok("r3", status="active")], OBSERVATION)
    after, found, learned = Y.complete_runs(runs, done, candidates, memory, events, "u/")
    got = {r.run_id: r for r in after.collect()}
    assert (got["r1"].status, got["r1"].output_hash, got["r1"].problem) == ("completed", "h", None)
    assert got["r2"].problem == "dream run is not running or does not exist: r2" and got["r2"].status == "failed"
    assert got["r9"].problem == "dream run is not running or does not exist: r9"
    assert got["r3"].problem == "references missing evidence: u/e2" and got["r3"].status == "running"
    assert got["r4"].problem == "invalid evidence ref scheme: else"
    assert [(r.run_id, r.evidence_refs) for r in found.collect()] == [("r1", ["u/e1"])] and [r.run_id for r in learned.collect()] == ["r1"]
    # the three tables change in one version; the second completion finds the run completed and brings nothing
    root, rule = "file://" + str(tmp_path / "runs"), G.Rule(("run_id",), ("status", "output_hash", "completed_at"))
    changes = {"runs": (after.where("problem is null").drop("problem"), rule, ()), "candidates": (found, G.RULES["candidates"], ()), "learned_memory": (learned, G.RULES["learned_memory"], ())}
    first = G.commit(spark, root, 0, {"runs": (runs, rule, ())}, buckets=2)
    assert G.commit(spark, root, first, changes, buckets=2) == 2
    state = G.read_table(spark, root, "runs")
    assert state.where("status = 'completed'").count() == 1 and G.read_table(spark, root, "candidates").count() == 1
    again = Y.complete_runs(state, done, candidates, memory, events, "u/")
    assert "not running" in again[0].where("run_id = 'r1'").first().problem and again[1].count() == again[2].count() == 0
