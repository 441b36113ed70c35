"""Store operations: event ids and chains, idempotent appends, upserts, sync decisions, manifests, learned memory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.functions import ids
from threadloom.functions.text import strip

PARSER_VERSION = "v1"
#: Event types that are never synced.
BLOCKED_TYPES = ("tool_call", "tool_result", "unknown_raw_event")


def with_ids(events: DataFrame, session: tuple[str, ...] = ("source", "source_session_id"), order: tuple[str, ...] = ("timestamp", "seq")) -> DataFrame:
    """Adds content_hash, parent_hash (of the event before it in its session) and id."""
    own = Window.partitionBy(*session).orderBy(*order)
    rows = events.withColumn("content_hash", ids.content_hash(F.col("content_text")))
    rows = rows.withColumn("parent_hash", F.lag("content_hash").over(own)).withColumn("parser_version", F.lit(PARSER_VERSION))
    return rows.withColumn("id", ids.event_id({f: F.col(f) for f in ids.EVENT_FIELDS}))


def new_rows(batch: DataFrame, stored: DataFrame, key: str = "id") -> DataFrame:
    """Rows of a batch that the store lacks, once each: what an idempotent append writes."""
    return batch.dropDuplicates([key]).join(stored.select(key), key, "left_anti")


def upsert(stored: DataFrame, batch: DataFrame, key: list[str], latest: str) -> DataFrame:
    """The store after a merge: of rows with one key the last by ``latest``, the batch's before the store's."""
    both = stored.withColumn("_new", F.lit(0)).unionByName(batch.withColumn("_new", F.lit(1)))
    names = [c for c in stored.columns if c not in key]
    pick = F.max_by(F.struct(*names), F.struct("_new", latest)).alias("_r")
    return both.groupBy(*key).agg(pick).select(*key, *[F.col(f"_r.{c}").alias(c) for c in names])


def sync_blocker(event_type: Column) -> Column:
    """Why an event can't be synced as it is; null if nothing stands against it."""
    return F.when(event_type.isin(*BLOCKED_TYPES), F.concat(F.lit("unsafe event type: "), event_type))


def sync_state(remote_ok: Column, blocked: Column, remote_has: Column, pending: Column) -> Column:
    return (
        F.when(~remote_ok, "remote_unavailable").when(blocked, "blocked").when(~remote_has & ~pending, "remote_missing").when(pending, "pending").otherwise("synced")
    )


def tail_per_project(events: DataFrame, n: int) -> DataFrame:
    """The last ``n`` events of each project by time, then id."""
    own = Window.partitionBy("project_id").orderBy(F.desc("timestamp"), F.desc("id"))
    return events.withColumn("_r", F.row_number().over(own)).where(F.col("_r") <= n).drop("_r")


def manifest_root(entries: DataFrame, *group: str) -> DataFrame:
    """Root hash per group: kind, ref, hash and path, a line each, in order. A group's lines meet in one row (at most 2 GB)."""
    line = F.concat_ws("\t", "kind", "ref_id", "content_hash", "sync_path")
    return entries.groupBy(*group).agg(
        ids.ordered_digest(F.struct("kind", "ref_id", "sync_path"), F.concat(line, F.lit("\n"))).alias("root_hash"), F.count(F.lit(1)).alias("entries")
    )


def write_if_absent(new: DataFrame, existing: DataFrame, key: str, value: str) -> tuple[DataFrame, DataFrame]:
    """(rows to write, rows in conflict) of an append-only store."""
    absent = new.join(existing.select(key), key, "left_anti")
    old = existing.select(F.col(key), F.col(value).alias("_old"))
    return absent, new.join(old, key).where(F.col(value) != F.col("_old")).drop("_old")


#: Fixed value: the confidence from which a memory is active.
ACTIVE_FROM = 0.8
#: Parts of a kind that keep a memory from being shared.
BANNED_KINDS = ("identity", "personal", "secret", "credential", "sensitive")


def kind_is_safe(kind: Column) -> Column:
    clean = F.lower(strip(kind))
    return clean.rlike(r"\A[a-z0-9_-]{1,64}\z") & ~clean.rlike("|".join(BANNED_KINDS))


def memory_status(confidence: Column, status: Column) -> Column:
    """Rejected stays; from 0.8 on active, else pending."""
    return F.when(status == "rejected", status).when(confidence >= ACTIVE_FROM, "active").otherwise("pending")


def observation_problem(kind: Column, claim: Column, confidence: Column, refs: Column) -> Column:
    return (
        F.when(F.trim(kind) == "", "kind is empty").when(F.trim(claim) == "", "claim is empty").when(~confidence.between(0, 1), "confidence out of range")
        .when(F.size(refs) == 0, "no evidence")
    )


def missing_refs(memory: DataFrame, events: DataFrame, refs: str = "evidence_refs", ref_id: str = "source_event_id") -> DataFrame:
    """(memory_id, ref) of references to no event of the same project."""
    each = memory.select("memory_id", "project_id", F.explode(refs).alias("ref"))
    known = events.select("project_id", F.col(ref_id).alias("ref")).where("ref is not null").distinct()
    return each.join(known, ["project_id", "ref"], "left_anti").select("memory_id", "ref")


def remap_refs(memory: DataFrame, mapping: DataFrame, refs: str = "evidence_refs") -> DataFrame:
    """(memory_id, refs): mapped, ascending and distinct, for rows all of whose references map."""
    each = memory.select("memory_id", F.explode(refs).alias("old"))
    mapped = each.join(mapping, "old", "left").groupBy("memory_id").agg(
        F.count(F.lit(1)).alias("n"), F.count("new").alias("m"), F.array_sort(F.collect_set("new")).alias("refs")
    )
    return mapped.where("n = m").select("memory_id", "refs")


def remap_refs_strictly(memory: DataFrame, mapping: DataFrame, refs: str = "evidence_refs") -> DataFrame:
    """(memory_id, refs, problem), one row per row of ``memory``: as ``remap_refs``, but a row that doesn't map says so and has no refs.

    The problem names the first reference, by its place, that ``mapping`` (old, new) doesn't know; without references there is none.
    """
    each = memory.select("memory_id", F.posexplode_outer(refs).alias("at", "old"))
    known = mapping.select("old", "new").distinct()
    lost = F.col("at").isNotNull() & F.col("new").isNull()
    found = each.join(known, "old", "left").groupBy("memory_id").agg(F.array_sort(F.collect_set("new")).alias("refs"), F.min_by("old", F.when(lost, F.col("at"))).alias("lost"))
    problem = F.when(F.col("lost").isNotNull(), F.concat(F.lit("remote learned memory references missing evidence: "), "lost"))
    return found.select("memory_id", F.when(F.col("lost").isNull(), F.col("refs")).alias("refs"), problem.alias("problem"))


def peer_union(local: DataFrame, *peers: tuple[str, DataFrame]) -> DataFrame:
    """Local and peer messages; equal ones once, the local or first peer's. ``origin`` names a peer, null for local."""
    rows = local.withColumn("origin", F.lit(None).cast("string")).withColumn("_rank", F.lit(0))
    for i, (name, peer) in enumerate(peers, 1):
        rows = rows.unionByName(peer.withColumn("origin", F.lit(name)).withColumn("_rank", F.lit(i)), allowMissingColumns=True)
    own = Window.partitionBy("source", "project_name", "session_id", "timestamp", "role", "content").orderBy("_rank", "source_file", "line_index")
    return rows.withColumn("_r", F.row_number().over(own)).where("_r = 1").drop("_r", "_rank")


def bundle_id(files: DataFrame, *group: str) -> DataFrame:
    """Id of each bundle over path:hash of its files in path order, joined by bars."""
    rows = F.array_sort(F.collect_list(F.struct("path", "sha256")))
    text = F.array_join(F.transform(rows, lambda r: F.concat(r["path"], F.lit(":"), r["sha256"])), "|")
    return files.groupBy(*group).agg(ids.prefixed("tp:v1:", text).alias("bundle_id"), F.count(F.lit(1)).alias("files"))


def events_of(events: DataFrame, source: str, since: str | None = None) -> DataFrame:
    """Events of a source from a time on (their strings' order), by project, time and id."""
    out = events.where(F.col("source") == source)
    return (out if since is None else out.where(F.col("timestamp") >= since)).orderBy("project_id", "timestamp", "id")


def multiset(events: DataFrame, key: str = "id") -> DataFrame:
    """How often each id occurs."""
    return events.groupBy(key).agg(F.count(F.lit(1)).alias("copies"))


def latest_runs(runs: DataFrame, key: str = "event_id", order: tuple[str, ...] = ("started_at", "run_id")) -> DataFrame:
    """The last run of each event."""
    rest = [c for c in runs.columns if c != key]
    return runs.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(key, "r.*")


def encode_refs(refs: Column) -> Column:
    """References as a JSON array."""
    return F.to_json(F.coalesce(refs, F.array().cast("array<string>")))


def decode_refs(text: Column) -> Column:
    return F.coalesce(F.from_json(text, "array<string>"), F.array().cast("array<string>"))
