"""Exchange with other stores: scans of written stores with validation, hydration, peers in one order, bundles, observations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threadloom.functions import ids
from threadloom.functions.text import is_blank
from threadloom.operators.store import ACTIVE_FROM, kind_is_safe

# What a written store's documents say about themselves.
MANIFEST_VERSION, POLICY_ID = "v1", "redact:v1"
MEMORY_STATES = ("active", "pending", "superseded", "rejected")
#: What identifies an event besides its text; nulls count as equal.
IDENTITY = ("project_id", "source", "source_session_id", "source_event_id", "event_type", "role", "timestamp", "parent_hash", "parser_version")


class NotFound(LookupError):
    """Something named isn't there."""


def read_store(spark: SparkSession, root: str, schema: str, kind: str = "events") -> DataFrame:
    """The JSON documents of a written store: of ``sessions/*/events``, or of another folder (``learned-memory``)."""
    reader = spark.read.schema(schema).option("multiLine", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json")
    found = reader.json(f"{root.rstrip('/')}/{'sessions' if kind == 'events' else kind}")
    return found.where(F.col("_metadata.file_path").rlike("/events/[^/]*$")) if kind == "events" else found


def event_problem(version: str = MANIFEST_VERSION, policy: str = POLICY_ID) -> Column:
    """Why an event of another store isn't taken; null if it is. Hashes and ids are computed again from what it holds."""
    fields = {f: F.col(f) for f in ids.EVENT_FIELDS}
    fields["content_hash"] = ids.content_hash(F.col("content_text"))
    return (
        F.when(~F.col("manifest_version").eqNullSafe(version), "manifest version mismatch")
        .when(~F.col("redaction_policy_id").eqNullSafe(policy), "redaction policy mismatch")
        .when(~F.col("content_hash").eqNullSafe(fields["content_hash"]), "content_hash mismatch")
        .when(~F.col("event_id").eqNullSafe(ids.event_id(fields)), "event id mismatch")
    )


def memory_problem(scheme: str, version: str = MANIFEST_VERSION) -> Column:
    """Why a learned memory of another store isn't taken as it stands; null if it is."""
    refs = F.concat(F.col("evidence_refs"), F.coalesce("counterevidence_refs", F.array().cast("array<string>")))
    return (
        F.when(~F.col("manifest_version").eqNullSafe(version), "manifest version mismatch")
        .when(~F.coalesce(F.col("status").isin(*MEMORY_STATES), F.lit(False)), "invalid status")
        .when(F.coalesce(F.size("evidence_refs"), F.lit(0)) <= 0, "no evidence")
        .when(F.exists(refs, lambda r: ~F.startswith(r, F.lit(scheme))), "invalid evidence ref")
        .when(~F.coalesce(kind_is_safe(F.col("kind")), F.lit(False)), "unsafe kind")
    )


def scan_order(events: DataFrame) -> DataFrame:
    return events.orderBy("timestamp", "event_id")


def hydrate(stored: DataFrame, remote: DataFrame) -> DataFrame:
    """``remote`` with ``local_id`` and ``found`` (identity, id or insert): the stored event with the same identity, of these
    the one of least id; else the one with the same id; else the event is to be inserted under its own."""
    same = [remote[c].eqNullSafe(F.col(f"_{c}")) for c in IDENTITY]
    known = stored.groupBy(*[F.col(c).alias(f"_{c}") for c in IDENTITY]).agg(F.min("id").alias("_by_identity"))
    by_id = stored.select(F.col("id").alias("_by_id")).distinct()
    out = remote.join(known, same, "left").join(by_id, F.col("event_id") == F.col("_by_id"), "left")
    found = F.when(F.col("_by_identity").isNotNull(), "identity").when(F.col("_by_id").isNotNull(), "id").otherwise(F.lit("insert"))
    return out.select(*remote.columns, F.coalesce("_by_identity", "event_id").alias("local_id"), found.alias("found"))


def hydration_report(matched: DataFrame) -> DataFrame:
    return matched.agg(F.count(F.lit(1)).alias("remote_events"), F.count_if(F.col("found") == "insert").alias("inserted_events"), F.count_if(F.col("found") != "insert").alias("existing_events"))


# merged answers of several stores
API_CHRONOLOGICAL = ("timestamp", "session_id", "source", "project_name", "role")


def merged_order(by: str, descending: bool, ties: tuple[str, ...]) -> list[Column]:
    """Time, or count then time, then ``ties``: descending turns the whole order round, ties too."""
    first = ("last_timestamp",) if by == "timestamp" else ("message_count", "last_timestamp")
    return [F.desc(c) if descending else F.asc(c) for c in (*first, *ties)]


def merged_newest(messages: DataFrame, limit: int) -> DataFrame:
    """The ``limit`` newest of merged messages, in time order."""
    return messages.orderBy(*[F.desc(c) for c in API_CHRONOLOGICAL]).limit(limit).orderBy(*API_CHRONOLOGICAL)


def once_in_order(sessions: DataFrame) -> DataFrame:
    """Merged sessions newest first, of equal ones that follow one another the first; only neighbours count as equal."""
    key = ("source", "project_name", "session_id")
    # neighbours of one session share time and session id, so a window over these sees them together
    own = Window.partitionBy("last_timestamp", "session_id").orderBy("source", "project_name")
    before = [F.lag(c).over(own) for c in key]
    again = F.coalesce(before[0] == F.col(key[0]), F.lit(False)) & F.coalesce(before[1] == F.col(key[1]), F.lit(False))
    return sessions.withColumn("_again", again).where("not _again").drop("_again")


# observations and their evidence
def event_ref(event_id: Column, scheme: str) -> Column:
    """How other documents point to an event: the store's scheme and its id."""
    return F.concat(F.lit(scheme), event_id)


def evidence_hash(events: DataFrame, scheme: str, *group: str) -> DataFrame:
    """Hash of the evidence of each group: reference and text, a line each, by time and id."""
    line = F.concat(event_ref(F.col("id"), scheme), F.lit("\t"), "content_text", F.lit("\n"))
    return events.groupBy(*group).agg(ids.ordered_digest(F.struct("timestamp", "id"), line).alias("evidence_hash"))


def observation_problems(observations: DataFrame, valid: DataFrame, scheme: str, key: str = "memory_id") -> DataFrame:
    """(key, problem) of each observation (kind, claim, confidence, evidence_refs, counterevidence_refs): the first thing against
    it, null if nothing. References count in order, those of the counterevidence last.

    ``valid``: (ref) of the evidence there is.
    """
    none = F.array().cast("array<string>")
    every = F.concat(*[F.coalesce(c, none) for c in ("evidence_refs", "counterevidence_refs") if c in observations.columns])
    refs = observations.select(key, F.posexplode(every).alias("at", "ref"))
    known = refs.join(valid.select("ref", F.lit(True).alias("known")).distinct(), "ref", "left")
    wrong = F.when(~F.startswith("ref", F.lit(scheme)), F.concat(F.lit("invalid evidence ref scheme: "), "ref")).when(F.col("known").isNull(), F.concat(F.lit("missing evidence: "), "ref"))
    lost = known.withColumn("wrong", wrong).where("wrong is not null").groupBy(key).agg(F.min_by("wrong", "at").alias("wrong"))
    problem = (
        F.when(is_blank(F.col("kind")), "kind is empty").when(is_blank(F.col("claim")), "claim is empty").when(~F.col("confidence").between(0, 1), "confidence out of range")
        .when(F.coalesce(F.size("evidence_refs"), F.lit(0)) <= 0, "no evidence")
        .otherwise(F.col("wrong"))
    )
    return observations.join(lost, key, "left").select(key, problem.alias("problem"))


def status_counts(observations: DataFrame) -> DataFrame:
    """Observations by status; what isn't rejected is active from ``ACTIVE_FROM`` on and else pending."""
    status = F.when(F.col("status") == "rejected", "rejected").when(F.col("confidence") >= ACTIVE_FROM, "active").otherwise(F.lit("pending"))
    return observations.groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("observations"))


#: The fields that a document of observations may have.
OUTPUT_FIELDS = ("observations", "claims", "patterns", "open_loops", "learned_memory_updates", "counterevidence", "recommended_actions", "diagnostics", "usage")


def unknown_fields(document: Column) -> Column:
    """Fields of a JSON document that aren't among ``OUTPUT_FIELDS``."""
    return F.filter(F.json_object_keys(document), lambda k: ~k.isin(*OUTPUT_FIELDS))


# bundles
def write_bundles(files: DataFrame, path: str, key: str = "session_id") -> None:
    """One JSON document a bundle: its key and its files (path, sha256, content), by path. Spark's commit is the ready mark."""
    members = F.array_sort(F.collect_list(F.struct("path", "sha256", "content")))
    files.groupBy(key).agg(members.alias("files")).write.mode("overwrite").json(path)


BUNDLE = "files array<struct<path string, sha256 string, content string>>"


def read_bundles(spark: SparkSession, path: str, key: str = "session_id") -> DataFrame:
    """(key, path, sha256, content, intact) of the files of all bundles of a folder."""
    rows = spark.read.schema(f"{key} string, {BUNDLE}").json(path)
    found = rows.select(key, F.explode("files").alias("f")).select(key, "f.*")
    return found.withColumn("intact", F.col("sha256").eqNullSafe(F.sha2("content", 256)))


def apply_plan(bundled: DataFrame, present: DataFrame, last: str, dry_run: bool = False, force: bool = False) -> DataFrame:
    """(path, action) for each bundled file (path, content, ``last``: when the bundle's session ended) against the files present
    (path, content, stamp: the time in it, if any).

    Without ``force`` a bundle whose files are all there as they are is skipped whole; a file that differs and is newer, or has no time, is a conflict.
    """
    here = present.select("path", F.col("content").alias("_old"), F.col("stamp").alias("_stamp"))
    rows = bundled.join(here, "path", "left")
    same = F.coalesce(F.col("_old") == F.col("content"), F.lit(False))
    absent, newer = F.col("_old").isNull(), F.col("_stamp") > F.col(last)
    action = (
        F.when(same, "skip-identical").when(F.lit(dry_run), "dry-run").when(absent | F.lit(force), "write").when(F.col("_stamp").isNull(), "conflict-untimestamped").when(newer, "conflict-newer").otherwise(F.lit("write"))
    )
    return rows.select("path", action.alias("action"))
