"""Merges of the store's tables: what a row does to the stored one with its key, and tables in buckets under one version.

A merge is one grouped aggregation over stored and new rows, so a key that a third of a batch holds is combined before the shuffle.
On disk (``commit``) only buckets that the batch touches are read and written; several tables change in one version or not at all.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


@dataclass(frozen=True)
class Rule:
    """``replaced`` takes the last row's value, ``filled`` the last that isn't null, every other column stays the first row's."""

    key: tuple[str, ...]
    replaced: tuple[str, ...] = ()
    filled: tuple[str, ...] = ()


#: What happens to each table's row when its key comes again.
RULES = {
    "projects": Rule(("canonical_path",), ("display_name", "updated_at")),
    "project_links": Rule(("canonical_path",), ("project_id", "updated_at")),
    "project_aliases": Rule(("source", "alias")),
    "sources": Rule(("name",), ("adapter_version", "enabled", "updated_at")),
    "sessions": Rule(("project_id", "source", "source_session_id"), ("started_at", "updated_at"), ("raw_local_ref",)),
    "search_documents": Rule(("event_id",), ("document_text", "citation", "updated_at")),
    "redaction_runs": Rule(("id",), ("status", "blocking_findings", "created_at")),
    "source_cursors": Rule(("source", "project_id", "cursor_key"), ("cursor_value", "parser_version", "last_event_hash", "updated_at")),
    "candidates": Rule(("id",), ("confidence", "evidence_refs", "counterevidence_refs", "status")),
    "learned_memory": Rule(("id",)),
    "synced_memory": Rule(("id",), ("confidence", "evidence_refs", "counterevidence_refs", "status")),
    "sync_manifests": Rule(("id",)),
    "sync_manifest_entries": Rule(("manifest_id", "entry_kind", "entry_ref")),
}


def merge(stored: DataFrame | None, batch: DataFrame, rule: Rule, order: tuple[str, ...] = ()) -> DataFrame:
    """The table after the batch's rows came one after the other by ``order``, columns of the batch that the table lacks.

    Rows that ``order`` doesn't tell apart follow one another by a hash of all their columns. A null in a key is a value like any
    other. Without a stored table (None) the batch alone is merged; merging that into a table gives the same as merging the batch.
    """
    names = [c for c in batch.columns if c not in order]
    place = F.struct(F.lit(1).alias("new"), *order, F.xxhash64(*names).alias("tie"))
    rows = batch.select(*names, place.alias("_p"))
    if stored is not None:
        none = F.struct(F.lit(0).alias("new"), *[F.lit(None).cast(batch.schema[c].dataType).alias(c) for c in order], F.lit(0).cast("long").alias("tie"))
        rows = stored.select(*names, none.alias("_p")).unionByName(rows)
    return _combined(rows, rule, names, list(rule.key))


def _combined(rows: DataFrame, rule: Rule, names: list[str], by: list[str]) -> DataFrame:
    rest = [c for c in names if c not in by]
    kept = [c for c in rest if c not in rule.replaced + rule.filled]
    values = [F.min_by(F.struct(*kept), "_p").alias("_first")] if kept else []
    values += [F.max_by(F.struct(*rule.replaced), "_p").alias("_last")] if rule.replaced else []
    values += [F.max_by(c, F.when(F.col(c).isNotNull(), F.col("_p"))).alias(c) for c in rule.filled]
    whose = lambda c: c if c in by or c in rule.filled else F.col(f"{'_last' if c in rule.replaced else '_first'}.{c}").alias(c)
    grouped = rows.groupBy(*by).agg(*values) if values else rows.select(*by).distinct()
    return grouped.select(*[whose(c) for c in names])


def replace_details(stored: DataFrame, parents: DataFrame, batch: DataFrame, parent: str, key: str = "id") -> DataFrame:
    """Detail rows (a redaction run's spans) after their parents were recorded again: all former ones of these parents go, also
    where the batch brings none."""
    return stored.join(parents.select(parent).distinct(), parent, "left_anti").unionByName(batch.dropDuplicates([key]))


# tables on disk
class Conflict(RuntimeError):
    """Another writer published the version first."""


def _files(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def latest(spark: SparkSession, root: str) -> int:
    """The number of the last version; 0 if there is none."""
    at, files = _files(spark, f"{root}/versions")
    if not files.exists(at):
        return 0
    return max((int(n[:-5]) for n in (s.getPath().getName() for s in files.listStatus(at)) if n.endswith(".json") and n[:-5].isdigit()), default=0)


def _manifest(spark: SparkSession, root: str, version: int) -> dict:
    if version == 0:
        return {}
    text = spark.read.text(f"{root}/versions/{version:010d}.json", wholetext=True).first()
    return json.loads(text[0])


def _publish(spark: SparkSession, root: str, version: int, tables: dict) -> None:
    """Writes the manifest under a name of its own and renames it to the version's, which fails where that exists (as logs of streams do)."""
    jvm, path = spark._jvm, spark._jvm.org.apache.hadoop.fs.Path
    draft, files = _files(spark, f"{root}/versions/_{uuid.uuid4().hex}")
    out = files.create(draft, False)
    out.write(bytearray(json.dumps(tables).encode()))
    out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.getFileSystem(spark._jsc.hadoopConfiguration()).getUri(), spark._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    try:
        context.rename(draft, path(f"{root}/versions/{version:010d}.json"), options)
    except Exception as e:
        files.delete(draft, False)
        if "FileAlreadyExists" in str(e):
            raise Conflict(f"version {version} of {root} is there already") from None
        raise


def bucket(key: tuple[str, ...], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")


def _read(spark: SparkSession, root: str, table: dict, only=None) -> DataFrame:
    schema = StructType.fromJson(table["schema"])
    paths = sorted(f"{root}/{p}" for b, p in table["buckets"].items() if only is None or int(b) in only)
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def read_table(spark: SparkSession, root: str, name: str, version: int | None = None) -> DataFrame:
    """A table as of a version, the last one if None. What later versions do isn't seen."""
    return _read(spark, root, _manifest(spark, root, latest(spark, root) if version is None else version)[name])


def rows_of(spark: SparkSession, root: str, name: str, keys: DataFrame) -> DataFrame:
    """The rows with the keys asked for; only buckets that can hold one are read."""
    table = _manifest(spark, root, latest(spark, root))[name]
    key = tuple(table["key"])
    wanted = {r[0] for r in keys.select(bucket(key, table["count"])).distinct().collect()}  # at most a number a bucket
    same = [F.col(f"t.{c}").eqNullSafe(F.col(f"k.{c}")) for c in key]
    return _read(spark, root, table, wanted).alias("t").join(keys.select(*key).distinct().alias("k"), same, "left_semi")


def commit(spark: SparkSession, root: str, base: int, changes: dict[str, tuple[DataFrame, Rule, tuple[str, ...]]], buckets: int = 64) -> int:
    """Merges batches, by table (batch, rule, order), into version ``base`` and publishes the next one; its number.

    All tables change with the one manifest. If another writer has published since ``base``, ``Conflict`` is raised and nothing
    changes; the folders written are in no manifest. ``buckets`` counts for new tables: choose it so that one bucket is about a
    gigabyte. A table's schema is that of its first batch. Empty batches change no bucket.
    """
    tables = dict(_manifest(spark, root, base))
    for name, (batch, rule, order) in changes.items():
        names = [c for c in batch.columns if c not in order]
        now = tables.get(name) or {"key": list(rule.key), "count": buckets, "schema": batch.select(*names).schema.jsonValue(), "buckets": {}}
        if tuple(now["key"]) != rule.key:
            raise ValueError(f"the key of {name} is {now['key']}")
        own = f"{name}/{base + 1:010d}-{uuid.uuid4().hex}"
        staged = f"{root}/{own}-batch"
        merge(None, batch, rule, order).withColumn("_bucket", bucket(rule.key, now["count"])).write.parquet(staged)
        fresh = spark.read.parquet(staged)
        touched = {r[0] for r in fresh.select("_bucket").distinct().collect()}  # at most a number a bucket
        if touched:
            names = [f.name for f in StructType.fromJson(now["schema"])]
            old = _read(spark, root, now, touched).select(*names, bucket(rule.key, now["count"]).alias("_bucket"), F.lit(0).alias("_p"))
            both = old.unionByName(fresh.select(*names, "_bucket", F.lit(1).alias("_p")))
            # a bucket meets in one task, so its rows are grouped and written without another shuffle
            _combined(both.repartition("_bucket"), rule, [*names, "_bucket"], ["_bucket", *rule.key]).write.partitionBy("_bucket").parquet(f"{root}/{own}")
        at, files = _files(spark, staged)
        files.delete(at, True)
        tables[name] = {**now, "buckets": {**now["buckets"], **{str(b): f"{own}/_bucket={b}" for b in sorted(touched)}}}
    _publish(spark, root, base + 1, tables)
    return base + 1
