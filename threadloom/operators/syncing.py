"""A project's sync as one plan (scan, projection, memory, manifest, report) and the completion of evidence runs.

Everything is done for all projects of a table at once; nothing passes the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.functions import ids
from threadloom.functions.digests import streamed_digest
from threadloom.functions.text import path_component, strip
from threadloom.operators.exchange import MANIFEST_VERSION, MEMORY_STATES, POLICY_ID
from threadloom.operators.redact import Detector, pattern_detector, redact
from threadloom.operators.store import BLOCKED_TYPES, kind_is_safe

CANDIDATE_STATES = ("pending", "accepted", "rejected")  # fixed values
NO_REFS = "array<string>"


def _refs(refs: Column) -> Column:
    """References ascending, each once; none for null."""
    return F.array_sort(F.array_distinct(F.coalesce(refs, F.array().cast(NO_REFS))))


# ids of records: fixed prefixes and material
def run_id(event: Column) -> Column:
    return ids.prefixed("redaction-run:v1:", F.concat(event, F.lit(f":{POLICY_ID}")))


def manifest_id(remote: Column, project: Column, root_hash: Column) -> Column:
    return ids.prefixed("sync-manifest:v1:", F.concat_ws(":", remote, project, root_hash, F.lit(POLICY_ID)))


def candidate_id(run: Column) -> Column:
    return _observation_id("dream-candidate:v1:", run)


def memory_id(project: Column) -> Column:
    return _observation_id("learned-memory:v1:", project)


def _observation_id(prefix: str, owner: Column) -> Column:
    refs = [F.array_join(_refs(F.col(c)), "\n") for c in ("evidence_refs", "counterevidence_refs")]
    return ids.prefixed(prefix, F.concat_ws(":", owner, "kind", "claim", *refs))


# projection
def blocking_reasons(findings: Column) -> Column:
    """One sentence for each kind of secret found, by kind."""
    secrets = F.transform(F.filter(findings, lambda f: f["blocks_sync"]), lambda f: f["kind"])
    count = lambda k: F.size(F.filter(secrets, lambda x: x == k))
    return F.transform(F.array_sort(F.array_distinct(secrets)), lambda k: F.concat(count(k).cast("string"), F.lit(" deterministic secret finding(s) of kind "), k, F.lit(f" under policy {POLICY_ID}")))


def project_prefix(project: Column) -> Column:
    return F.concat(F.lit("projects/"), path_component(project))


def project_events(events: DataFrame, detector: Detector = pattern_detector) -> DataFrame:
    """Store events with ``reasons`` against them and, where there are none, what a remote store gets: ``remote_id`` (over the
    redacted text), ``redacted``, hashes and paths of the event and of its search document. A null text is empty."""
    rows = redact(events.withColumn("content_text", F.coalesce("content_text", F.lit(""))), "content_text", detector)
    kind = F.col("event_type")
    unsafe = F.when(kind.isin(*BLOCKED_TYPES), F.array(F.concat(kind, F.lit(" events require a dedicated safe sync projection")))).otherwise(F.array().cast(NO_REFS))
    reasons = F.concat(unsafe, F.coalesce(blocking_reasons(F.col("findings")), F.array().cast(NO_REFS)))
    blind = (F.size("reasons") == 0) & (F.col("coverage") != "deterministic")
    rows = rows.withColumn("reasons", reasons).withColumn("reasons", F.when(blind, F.array(F.lit("detector unavailable"))).otherwise(F.col("reasons")))
    rows = rows.withColumn("passed", F.size("reasons") == 0).withColumn("remote_hash", ids.content_hash(F.col("redacted")))
    rows = rows.withColumn("remote_id", ids.event_id({f: F.col(f) for f in ids.EVENT_FIELDS} | {"content_hash": F.col("remote_hash")}))
    prefix, own = project_prefix(F.col("project_id")), F.concat(path_component(F.col("remote_id")), F.lit(".json"))
    projected = {
        "remote_id": F.col("remote_id"), "remote_hash": F.col("remote_hash"),
        "search_hash": ids.content_hash(F.concat(F.lit("search:"), "remote_id", F.lit(":"), "redacted")),
        "event_path": F.concat(prefix, F.lit("/sessions/"), path_component(F.col("source_session_id")), F.lit("/events/"), own),
        "search_path": F.concat(prefix, F.lit("/search/"), own),
    }
    return rows.withColumns({name: F.when(F.col("passed"), value) for name, value in projected.items()})


def _material(memory: DataFrame, whole: bool) -> Column:
    """A memory as JSON, names in alphabetical order, refs ascending; with id and creation time, or null for both."""
    null = F.lit(None).cast("string")
    fields = ["claim", "confidence", "counterevidence_refs", F.col("created_at") if whole else null, "evidence_refs", F.col("remote_id") if whole else null, "kind", "status"]
    names = ("claim", "confidence", "counterevidence_refs", "created_at", "evidence_refs", "id", "kind", "status")
    return F.to_json(F.struct(*[(F.col(f) if isinstance(f, str) else f).alias(n) for f, n in zip(fields, names)]), {"ignoreNullFields": "false"})


def project_memory(memory: DataFrame, projected: DataFrame, scheme: str, detector: Detector = pattern_detector) -> DataFrame:
    """Active memory with ``passed`` and, where true, what a remote store gets: redacted claim, references to remote events,
    ``remote_id``, ``remote_hash``, ``path``.

    Held back: unsafe kinds, claims with secrets, kinds with any finding, references to events that weren't projected, and memory
    without evidence. ``projected`` is ``project_events``'s. ``memory_id`` is unique. Confidences below a thousandth are written
    in another form of number than other stores may choose.
    """
    rows = memory.where("status = 'active'").withColumns({c: F.coalesce(c, F.array().cast(NO_REFS)) for c in ("evidence_refs", "counterevidence_refs")})
    rows = redact(rows.withColumn("claim", F.coalesce("claim", F.lit(""))), "claim", detector)
    rows = rows.withColumnsRenamed({"findings": "_f", "redacted": "_claim", "blocks_sync": "_blocks", "coverage": "_coverage"})
    rows = redact(rows.withColumn("kind", F.coalesce("kind", F.lit(""))), "kind", detector)
    clean = kind_is_safe(F.col("kind")) & ~F.coalesce("_blocks", F.lit(False)) & (F.size("findings") == 0) & (F.col("coverage") == "deterministic")
    rows = rows.withColumn("_clean", F.coalesce(clean, F.lit(False))).drop("_f", "_blocks", "_coverage", "findings", "redacted", "blocks_sync", "coverage")
    each = [rows.select("memory_id", "project_id", F.lit(side).alias("side"), F.explode(c).alias("ref")) for side, c in ((0, "evidence_refs"), (1, "counterevidence_refs"))]
    known = projected.where("passed").select("project_id", F.concat(F.lit(scheme), "id").alias("ref"), F.concat(F.lit(scheme), "remote_id").alias("new")).dropDuplicates(["project_id", "ref"])
    found = each[0].unionByName(each[1]).join(known, ["project_id", "ref"], "left")
    sets = [F.array_sort(F.collect_set(F.when(F.col("side") == i, F.col("new")))).alias(f"_to{i}") for i in (0, 1)]
    mapped = found.groupBy("memory_id").agg(*sets, F.count_if(F.col("new").isNull()).alias("_lost"))
    rows = rows.join(mapped, "memory_id", "left")
    passed = F.col("_clean") & (F.coalesce("_lost", F.lit(0)) == 0) & (F.coalesce(F.size("_to0"), F.lit(0)) > 0)
    rows = rows.withColumns({"passed": passed, "kind": F.lower(strip(F.col("kind"))), "claim": F.col("_claim"), "evidence_refs": F.col("_to0"), "counterevidence_refs": F.coalesce("_to1", F.array().cast(NO_REFS))})
    rows = rows.withColumn("remote_id", F.when(F.col("passed"), F.concat(F.lit("learned-memory:v1:"), ids.content_hash(_material(rows, False)))))
    rows = rows.withColumn("remote_hash", F.when(F.col("passed"), ids.content_hash(_material(rows, True))))
    path = F.concat(project_prefix(F.col("project_id")), F.lit("/learned-memory/"), path_component(F.col("remote_id")), F.lit(".json"))
    return rows.withColumn("path", path).drop("_claim", "_clean", "_to0", "_to1", "_lost")


def manifest_entries(projected: DataFrame, memory: DataFrame | None = None) -> DataFrame:
    """(project_id, kind, ref_id, content_hash, sync_path): an event and a search document for each projected event, and the memory."""
    each = F.explode(
        F.array(
            F.struct(F.lit("event").alias("kind"), F.col("remote_hash").alias("content_hash"), F.col("event_path").alias("sync_path")),
            F.struct(F.lit("search_document").alias("kind"), F.col("search_hash").alias("content_hash"), F.col("search_path").alias("sync_path")),
        )
    )
    rows = projected.where("passed").select("project_id", F.col("remote_id").alias("ref_id"), each.alias("e")).select("project_id", "e.kind", "ref_id", "e.content_hash", "e.sync_path")
    if memory is not None:
        rows = rows.unionByName(memory.where("passed").select("project_id", F.lit("learned_memory").alias("kind"), F.col("remote_id").alias("ref_id"), F.col("remote_hash").alias("content_hash"), F.col("path").alias("sync_path")))
    return rows


def root_hashes(entries: DataFrame) -> DataFrame:
    """(project_id, root_hash, entries): as ``store.manifest_root``, for projects of any size."""
    line = F.concat(F.concat_ws("\t", "kind", "ref_id", "content_hash", "sync_path"), F.lit("\n"))
    found = streamed_digest(entries, ("project_id",), ("kind", "ref_id", "sync_path"), line)
    return found.select("project_id", F.col("digest").alias("root_hash"), F.col("lines").alias("entries"))


def uploads(entries: DataFrame, remote: DataFrame) -> DataFrame:
    """Entries to write: each path once, of those that the remote (sync_path) doesn't hold. Nothing there is ever replaced."""
    return entries.dropDuplicates(["sync_path"]).join(remote.select("sync_path").distinct(), "sync_path", "left_anti")


def sync_report(projected: DataFrame, memory: DataFrame | None, remote: DataFrame, remote_name: str) -> DataFrame:
    """One row a project: what was synced, uploaded and held back, ``root_hash``, ``manifest_id`` and ``status``.

    Without memory (a sync of one source) no memory is counted. Callers who want all three of projection, manifest and report
    should write the projection first: each of them evaluates it otherwise.
    """
    entries = manifest_entries(projected, memory)
    seen = projected.groupBy("project_id").agg(F.count(F.lit(1)).alias("total_events"), F.count_if("passed").alias("synced_events"), F.count_if(~F.col("passed")).alias("blocked_events"))
    new = uploads(entries, remote).groupBy("project_id").agg(*[F.count_if(F.col("kind") == k).alias(n) for k, n in (("event", "uploaded_events"), ("search_document", "uploaded_search_documents"), ("learned_memory", "uploaded_learned_memory"))])
    out = seen
    counts = ["total_events", "synced_events", "blocked_events", "uploaded_events", "uploaded_search_documents", "uploaded_learned_memory", "synced_learned_memory", "blocked_learned_memory"]
    if memory is not None:
        out = out.join(memory.groupBy("project_id").agg(F.count_if("passed").alias("synced_learned_memory"), F.count_if(~F.col("passed")).alias("blocked_learned_memory")), "project_id", "full_outer")
    else:
        out = out.withColumns({c: F.lit(0).cast("long") for c in ("synced_learned_memory", "blocked_learned_memory")})
    out = out.join(new, "project_id", "left").join(root_hashes(entries).drop("entries"), "project_id", "left")
    out = out.withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in counts}).withColumn("root_hash", F.coalesce("root_hash", ids.content_hash(F.lit(""))))
    whole = F.col("blocked_events") + F.col("blocked_learned_memory") == 0
    none = F.col("synced_events") + F.col("synced_learned_memory") == 0
    status = F.when(whole, "synced").when(none, "blocked").otherwise(F.lit("partial"))
    return out.select("project_id", *counts, "root_hash", manifest_id(F.lit(remote_name), F.col("project_id"), F.col("root_hash")).alias("manifest_id"), F.lit(MANIFEST_VERSION).alias("manifest_version"), status.alias("status"))


# completion of evidence runs
def _against(rows: DataFrame, known: DataFrame, scheme: str, label: str, states: tuple[str, ...], rank: int) -> DataFrame:
    """(run_id, at, wrong) of observations: the first thing against each; state, evidence, then references in order."""
    refs = F.concat(*[F.coalesce(c, F.array().cast(NO_REFS)) for c in ("evidence_refs", "counterevidence_refs")])
    each = rows.select("run_id", "project_id", "seq", F.posexplode(refs).alias("at", "ref")).join(known, ["project_id", "ref"], "left")
    bad = F.when(~F.startswith("ref", F.lit(scheme)), F.concat(F.lit("invalid evidence ref scheme: "), "ref")).when(F.col("known").isNull(), F.concat(F.lit("references missing evidence: "), "ref"))
    place = lambda step, at: F.struct(F.lit(rank).alias("table"), F.col("seq").alias("seq"), F.lit(step).alias("step"), at.cast("int").alias("at"))
    by_ref = each.select("run_id", place(2, F.col("at")).alias("at"), bad.alias("wrong")).where("wrong is not null")
    state = F.when(~F.coalesce(F.col("status").isin(*states), F.lit(False)), F.concat(F.lit(f"invalid {label} status: "), F.coalesce("status", F.lit("")))).when(
        F.coalesce(F.size("evidence_refs"), F.lit(0)) <= 0, F.lit(f"{label} requires at least one evidence ref")
    )
    return rows.select("run_id", place(1, F.lit(0)).alias("at"), state.alias("wrong")).where("wrong is not null").unionByName(by_ref)


def complete_runs(runs: DataFrame, done: DataFrame, candidates: DataFrame, memory: DataFrame, events: DataFrame, scheme: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Runs, candidates and memory that completions lead to; a run that can't be completed leaves nothing of it.

    ``runs``: (run_id, project_id, status, output_hash, completed_at); ``done``: (run_id, output_hash, completed_at), of several
    for one run the earliest, by hash where times are equal. ``candidates`` and ``memory``: (run_id, seq, kind, claim, confidence,
    status, evidence_refs, counterevidence_refs). ``events``: (project_id, id). Returns (a row a run in ``done`` with its state
    after, and ``problem``, null if completed; candidates to merge; memory to merge). Observations of runs not in ``done`` stay out.
    """
    known = events.select("project_id", F.concat(F.lit(scheme), "id").alias("ref")).distinct().withColumn("known", F.lit(True))
    once = done.groupBy("run_id").agg(F.min_by(F.struct("output_hash", "completed_at"), F.struct("completed_at", "output_hash")).alias("_d"))
    asked = once.join(runs, "run_id", "left")
    open_runs = asked.where("status = 'running'").select("run_id", "project_id", "_d")
    mine = [rows.drop("project_id").join(open_runs.select("run_id", "project_id"), "run_id") for rows in (candidates, memory)]
    wrong = _against(mine[0], known, scheme, "dream candidate", CANDIDATE_STATES, 1).unionByName(_against(mine[1], known, scheme, "learned memory", MEMORY_STATES, 2))
    first = wrong.groupBy("run_id").agg(F.min_by("wrong", "at").alias("wrong"))
    idle = F.when(~F.coalesce(F.col("status") == "running", F.lit(False)), F.concat(F.lit("dream run is not running or does not exist: "), "run_id"))
    judged = asked.join(first, "run_id", "left").withColumn("problem", F.coalesce(idle, "wrong"))
    good = F.col("problem").isNull()
    after = judged.select(
        "run_id", "project_id", F.when(good, "completed").otherwise(F.col("status")).alias("status"), F.when(good, F.col("_d.output_hash")).otherwise(F.col("output_hash")).alias("output_hash"),
        F.when(good, F.col("_d.completed_at")).otherwise(F.col("completed_at")).alias("completed_at"), "problem",
    )
    kept = open_runs.join(first, "run_id", "left_anti").select("run_id", F.col("_d.completed_at").alias("created_at"))
    shaped = [rows.withColumns({c: _refs(F.col(c)) for c in ("evidence_refs", "counterevidence_refs")}).join(kept, "run_id") for rows in mine]
    return after, shaped[0].withColumn("id", candidate_id(F.col("run_id"))), shaped[1].withColumn("id", memory_id(F.col("project_id")))
