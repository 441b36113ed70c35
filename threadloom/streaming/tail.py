"""Tailing transcript files as a stream: complete lines only, rotation, and each event stored exactly once.

Spark's file stream takes files as finished and doesn't see what is appended to them, so the source is a Python data
source. Its offset maps each file to the bytes taken and a fingerprint of their first ones; the driver finds the new ends, which
lie on line ends, by reading the last bytes of each file, and tasks read what lies between two offsets, file by file. A
batch can be read again from its two offsets. Files are seen by the driver and all workers under one path.

Ingest is exactly once whatever the batches' borders: an event's parent is the one before it in its file, also if that
came with an earlier batch (its hash is kept per file), so its id doesn't depend on the borders; and a batch that is
replayed writes the same partition of the table again.

Two ways lead there. ``ingest`` keeps a file's last hash in a table of cursors, ``ingest_keyed`` in Spark's state store, one row a
file; with the option ``manifest`` offsets are small numbers and batches are bounded, see ``EpochReader``; with ``shards`` as well the
driver holds nothing a file, see ``ShardReader``.
"""

from __future__ import annotations

import hashlib
import json
import os
import shutil
import sys
import uuid
import zlib
from collections.abc import Iterator
from contextlib import suppress
from fnmatch import fnmatchcase
from pathlib import Path

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType

FINGERPRINT_BYTES = 4096
CHUNK = 1 << 20
#: ``life``: which life of the file a line is of, with the option ``manifest``: a file that begins again gets another one.
SCHEMA = StructType([StructField("path", StringType()), StructField("offset", LongType()), StructField("raw", StringType()), StructField("life", LongType())])


def fingerprint(raw: bytes) -> str:
    return hashlib.sha256(raw[:FINGERPRINT_BYTES]).hexdigest()


def _first_bytes(path: Path, n: int) -> bytes:
    with path.open("rb") as f:
        return f.read(min(n, FINGERPRINT_BYTES))


def last_line_end(path: Path) -> int:
    """The place after the last line feed of a file; reads back from its end."""
    with path.open("rb") as f:
        at = f.seek(0, 2)
        while at > 0:
            start = max(0, at - CHUNK)
            f.seek(start)
            found = f.read(at - start).rfind(b"\n")
            if found >= 0:
                return start + found + 1
            at = start
    return 0


def position(path: Path) -> dict:
    """How far a file can be taken: {offset, print}; the print is that of the first bytes before the offset."""
    end = last_line_end(path)
    return {"offset": end, "print": fingerprint(_first_bytes(path, end))}


def begin_of(path: Path, before: dict | None, to: dict) -> int:
    """Where to read a file from: behind the position before, or at 0 if the file is shorter or another one now."""
    if before is None or to["offset"] < before["offset"] or fingerprint(_first_bytes(path, before["offset"])) != before["print"]:
        return 0
    return before["offset"]


def line_end_within(path: Path, start: int, end: int, size: int) -> int:
    """The last line end at most ``size`` bytes behind ``start``; of a longer line its own end. ``end`` is a line end."""
    if end - start <= size:
        return end
    with path.open("rb") as f:
        at = start + size
        while at > start:
            low = max(start, at - CHUNK)
            f.seek(low)
            found = f.read(at - low).rfind(b"\n")
            if found >= 0:
                return low + found + 1
            at = low
        at = start + size
        f.seek(at)
        while at < end and (some := f.read(CHUNK)):
            found = some.find(b"\n")
            if found >= 0:
                return at + found + 1
            at += len(some)
    return end


def lines_between(path: Path, start: int, end: int, life: int | None = None) -> Iterator[tuple[str, int, str, int | None]]:
    """(path, offset, line, life) of the whole lines from ``start`` to ``end``."""
    with path.open("rb") as f:
        f.seek(start)
        while start < end and (line := f.readline()):
            yield str(path), start, line.removesuffix(b"\n").removesuffix(b"\r").decode("utf-8", "replace"), life
            start += len(line)


class Delta(InputPartition):
    """What one task reads: (path, start, end) of some files."""

    def __init__(self, parts: list[tuple[str, int, int]]):
        self.parts = parts


def packed(parts: list[tuple[str, int, int]], size: int) -> list[Delta]:
    """Files put together until they have ``size`` bytes; a file is never cut."""
    out, held = [], 0
    for part in parts:
        if not out or held >= size:
            out.append(Delta([]))
            held = 0
        out[-1].parts.append(part)
        held += part[2] - part[1]
    return out or [Delta([])]


class TailReader(DataSourceStreamReader):
    """Reads what files below a folder gained since an offset; small files share a task."""

    def __init__(self, options: dict):
        self.root, self.pattern = Path(options["path"].removeprefix("file://")), options.get("pattern", "*.jsonl")
        self.size = int(options.get("taskBytes", 16 << 20))

    def initialOffset(self) -> dict:
        return {"files": "{}"}

    def latestOffset(self) -> dict:
        return {"files": json.dumps({str(p): position(p) for p in sorted(self.root.rglob(self.pattern))}, sort_keys=True)}

    def partitions(self, start: dict, end: dict) -> list[Delta]:
        return self.between(json.loads(start["files"]), json.loads(end["files"]))

    def between(self, before: dict, after: dict) -> list[Delta]:
        changed = [(name, to) for name, to in sorted(after.items()) if before.get(name) != to]
        found = [(name, begin_of(Path(name), before.get(name), to), to["offset"]) for name, to in changed]
        return packed([p for p in found if p[1] < p[2]], self.size)

    def read(self, partition: Delta) -> Iterator[tuple]:
        for path, start, end in partition.parts:
            yield from lines_between(Path(path), start, end)


class EpochReader(TailReader):
    """As ``TailReader``, but offsets are numbers of epochs and batches are bounded.

    What an epoch means lies in a file of the folder ``manifest``: how far each file is taken. An epoch takes at most ``fileBytes`` of a file
    and about ``batchBytes`` in all (a line that is longer comes whole), those files first that waited longest; a file whose size and time
    didn't change isn't opened. After a restart a batch can hold two epochs: the one that was written before and the next.
    """

    KEPT = 200

    def __init__(self, options: dict):
        super().__init__(options)
        self.log = Path(options["manifest"].removeprefix("file://"))
        self.file_bytes, self.batch_bytes = int(options.get("filebytes", options.get("fileBytes", 64 << 20))), int(options.get("batchbytes", options.get("batchBytes", 1 << 30)))

    def initialOffset(self) -> dict:
        return {"epoch": 0}

    def _epochs(self) -> list[int]:
        return sorted(int(p.stem) for p in self.log.glob("*.json")) if self.log.is_dir() else []

    def files(self, epoch: int) -> dict:
        return json.loads((self.log / f"{epoch}.json").read_text()) if epoch else {}

    def _advanced(self, before: dict, epoch: int) -> dict:
        after, left = {}, self.batch_bytes
        names = {str(p): p for p in self.root.rglob(self.pattern)}
        for name in sorted(names, key=lambda n: (before[n]["epoch"] if n in before else 0, n)):
            old, stat = before.get(name), names[name].stat()
            seen = [stat.st_size, stat.st_mtime_ns]
            if left <= 0 or (old is not None and old["seen"] == seen):
                if old is not None:
                    after[name] = old
                continue
            to = position(names[name])
            start = begin_of(names[name], old, to)
            end = line_end_within(names[name], start, to["offset"], min(self.file_bytes, left))
            left -= end - start
            life = old["life"] if old is not None and start else epoch
            mark = {"offset": end, "life": life, "print": fingerprint(_first_bytes(names[name], end))}
            if old is not None and start == 0 == end == old["offset"]:
                mark["life"] = old["life"]  # no line yet
            moved = old is None or any(old[k] != v for k, v in mark.items())
            after[name] = {**mark, "epoch": epoch if moved else old["epoch"], "seen": seen if end == to["offset"] else None}
        return after

    def latestOffset(self) -> dict:
        known = self._epochs()
        last = known[-1] if known else 0
        before = self.files(last)
        after = self._advanced(before, last + 1)
        if not any(name not in before or before[name]["epoch"] != to["epoch"] for name, to in after.items()) and before.keys() == after.keys():
            return {"epoch": last}
        self.log.mkdir(parents=True, exist_ok=True)
        draft = self.log / f".{last + 1}.draft"
        draft.write_text(json.dumps(after, sort_keys=True))
        draft.rename(self.log / f"{last + 1}.json")
        return {"epoch": last + 1}

    def partitions(self, start: dict, end: dict) -> list[Delta]:
        of = lambda at: {name: {k: to[k] for k in ("offset", "print")} for name, to in self.files(at["epoch"]).items()}
        after, deltas = self.files(end["epoch"]), self.between(of(start), of(end))
        return [Delta([(*part, after[part[0]]["life"]) for part in delta.parts]) for delta in deltas]

    def read(self, partition: Delta) -> Iterator[tuple]:
        for path, start, end, life in partition.parts:
            yield from lines_between(Path(path), start, end, life)

    def commit(self, end: dict) -> None:
        for epoch in self._epochs():
            if epoch < end["epoch"] - self.KEPT:
                (self.log / f"{epoch}.json").unlink(missing_ok=True)


def files_below(root: Path, pattern: str, own=lambda name: True) -> Iterator[os.DirEntry]:
    """Files below a folder, one by one, in no order; of the entries right below it only those whose name is ``own``."""
    with suppress(FileNotFoundError), os.scandir(root) as entries:
        for entry in entries:
            if own(entry.name):
                if entry.is_dir(follow_symlinks=False):
                    yield from files_below(Path(entry.path), pattern)
                elif fnmatchcase(entry.name, pattern):
                    yield entry


class Share(InputPartition):
    """What one task reads: what the files of one shard gained between two epochs."""

    def __init__(self, shard: int, start: int, end: int):
        self.shard, self.start, self.end = shard, start, end


class ShardReader(TailReader):
    """As ``TailReader``, but the driver holds nothing a file, however many there are: offsets are numbers of epochs, and how far an epoch takes
    each file lies in the folder ``manifest``, in one file a shard.

    An entry right below the folder belongs to a shard by its name's checksum. The driver adds up names, sizes and times of all files, and another
    sum begins an epoch. A shard's first task settles its files' ends in that epoch; tasks that come again find them settled and read the same.
    Batches must be read whole, as reading settles the shards. ``shards`` says how many there are; a manifest keeps its number.
    """

    KEPT = 10

    def __init__(self, options: dict):
        super().__init__(options)
        self.log, self.shards = Path(options["manifest"].removeprefix("file://")), int(options["shards"])

    def initialOffset(self) -> dict:
        return {"epoch": 0}

    def _sum(self) -> list[int]:
        n = total = 0
        for entry in files_below(self.root, self.pattern):
            with suppress(FileNotFoundError):
                stat = entry.stat()
                said = f"{entry.path}\n{stat.st_size}\n{stat.st_mtime_ns}".encode("utf-8", "surrogateescape")
                n, total = n + 1, (total + int.from_bytes(hashlib.blake2b(said, digest_size=8).digest())) % 2**64
        return [n, total]

    def _epochs(self) -> list[int]:
        return sorted(int(p.stem) for p in self.log.glob("*.json")) if self.log.is_dir() else []

    def latestOffset(self) -> dict:
        last, found = max(self._epochs(), default=0), self._sum()
        before = json.loads((self.log / f"{last}.json").read_text()) if last else {"sum": [0, 0], "shards": self.shards}
        if before["shards"] != self.shards:
            raise ValueError(f"the manifest is of {before['shards']} shards, not {self.shards}")
        if before["sum"] == found:
            return {"epoch": last}
        self.log.mkdir(parents=True, exist_ok=True)
        draft = self.log / f".{last + 1}.draft"
        draft.write_text(json.dumps({"sum": found, "shards": self.shards}))
        draft.rename(self.log / f"{last + 1}.json")
        return {"epoch": last + 1}

    def partitions(self, start: dict, end: dict) -> list[Share]:
        return [Share(shard, start["epoch"], end["epoch"]) for shard in range(self.shards)]

    def settled(self, epoch: int, shard: int) -> dict:
        """{after, files}: the epoch that the shard's starts follow on, and {offset, print, start, seen} of its files."""
        return json.loads((self.log / str(epoch) / f"{shard}.json").read_text()) if epoch else {"after": 0, "files": {}}

    def _settle(self, shard: int, start: int, end: int, before: dict) -> None:
        after = {}
        for entry in files_below(self.root, self.pattern, lambda name: zlib.crc32(os.fsencode(name)) % self.shards == shard):
            path, stat, old = Path(entry.path), entry.stat(), before.get(entry.path)
            seen = [stat.st_size, stat.st_mtime_ns]
            if old is None or old["seen"] != seen:
                to = position(path)
                old = {**to, "start": begin_of(path, old, to), "seen": seen}
            after[entry.path] = old
        place = self.log / str(end) / f"{shard}.json"
        place.parent.mkdir(parents=True, exist_ok=True)
        draft = place.with_name(f".{shard}.{uuid.uuid4().hex}")
        draft.write_text(json.dumps({"after": start, "files": after}))
        with suppress(FileExistsError):  # another try of this task was first
            os.link(draft, place)
        draft.unlink()

    def read(self, partition: Share) -> Iterator[tuple]:
        before = self.settled(partition.start, partition.shard)["files"]
        if not (self.log / str(partition.end) / f"{partition.shard}.json").exists():
            self._settle(partition.shard, partition.start, partition.end, before)
        found = self.settled(partition.end, partition.shard)
        for name, to in sorted(found["files"].items()):
            old = before.get(name)
            if old is not None and (old["offset"], old["print"]) == (to["offset"], to["print"]):
                continue
            start = to["start"] if found["after"] == partition.start else begin_of(Path(name), old, to)
            if start < to["offset"]:
                yield from lines_between(Path(name), start, to["offset"])

    def commit(self, end: dict) -> None:
        for epoch in self._epochs():
            if epoch < end["epoch"] - self.KEPT:
                shutil.rmtree(self.log / str(epoch), ignore_errors=True)
                (self.log / f"{epoch}.json").unlink(missing_ok=True)


class TailSource(DataSource):
    """``spark.readStream.format("jsonl_tail").option("path", folder)``; with ``manifest``, see ``EpochReader``, with ``shards`` too, ``ShardReader``."""

    @classmethod
    def name(cls) -> str:
        return "jsonl_tail"

    def schema(self) -> StructType:
        return SCHEMA

    def streamReader(self, schema: StructType) -> TailReader:
        kind = ShardReader if "shards" in self.options else EpochReader if "manifest" in self.options else TailReader
        return kind(self.options)


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def store_batch(batch: DataFrame, number: int, normalise, chain, table: str, cursors: str, stream: str = "tail") -> None:
    """Writes the events of one batch of (path, offset, raw) to ``table``, and where each file stands to ``cursors``.

    ``normalise``: batch to events with path, line_index and part. ``chain``: (events, before) to events with ids, see
    ``capture.chained``. The partition of ``stream`` and ``number`` is replaced, so a batch may come again. New files and
    lines are only appended; of files that began again (rotation, another stream) events that the table holds are left out.
    """
    spark, part = batch.sparkSession, f"stream={stream}/batch={number}"
    others = ~((F.col("stream") == stream) & (F.col("batch") >= number))
    events = normalise(batch)
    before = None
    if _exists(spark, cursors):
        known = spark.read.parquet(cursors).where(others)
        before = known.groupBy("path").agg(F.max_by(F.struct("last_hash", "offset"), "at").alias("c")).select("path", "c.last_hash", "c.offset")
        starts = batch.groupBy("path").agg(F.min("offset").alias("start"))
        again = F.col("start") <= F.col("offset")
        # a file that began again has no event before its first
        before = before.join(starts, "path").select("path", F.when(~again, F.col("last_hash")).alias("last_hash"), again.alias("again"))
    events = chain(events, before)
    if before is not None and _exists(spark, table):
        repeated = before.where("again").select("path")
        if not repeated.isEmpty():
            old = spark.read.parquet(table).where(others).join(repeated, "path", "left_semi").select("id").distinct()
            events = events.join(old, "id", "left_anti")
    events.dropDuplicates(["id"]).write.mode("overwrite").parquet(f"{table}/{part}")
    last = chain(normalise(batch), None).groupBy("path").agg(F.max_by("content_hash", F.struct("line_index", "part")).alias("new_hash"))
    done = batch.groupBy("path").agg(F.max("offset").alias("offset")).join(last, "path", "left")
    if before is not None:
        done = done.join(before.select("path", "last_hash"), "path", "left")
    kept = F.col("new_hash") if before is None else F.coalesce("new_hash", "last_hash")
    done.select("path", "offset", kept.alias("last_hash"), F.current_timestamp().alias("at")).write.mode("overwrite").parquet(f"{cursors}/{part}")


def ingest(stream: DataFrame, normalise, chain, table: str, cursors: str, checkpoint: str, name: str = "tail"):
    """The query that stores the events of new lines, see ``store_batch``; to be started. ``name`` tells streams into one table apart."""
    return stream.writeStream.foreachBatch(lambda batch, number: store_batch(batch, number, normalise, chain, table, cursors, name)).option("checkpointLocation", checkpoint)


class FileChain(StatefulProcessor):
    """Gives each event the hash of the event before it in its file (``parent_hash``) and says whether the file began ``again``.

    The state is one row a file: the hash of its last event, its life, and whether it began again. A file in another life starts a new
    chain; all its later events are marked, as a batch may hold only a part of what is repeated.
    The new events of one file and batch meet in one task: at most the source's ``fileBytes``, twice that after a restart.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "content_hash string, life long, again boolean")

    def handleInitialState(self, key, initialState, timerValues) -> None:  # noqa: N803 (names of the interface)
        self.last.update((None, 0, True))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N803
        new = pd.concat(list(rows)).sort_values(["line_index", "part"], kind="stable")
        known = self.last.exists()
        before, lived, marked = self.last.get() if known else (None, 0, False)
        if new["life"].isna().any():
            raise ValueError("the source needs the option manifest")
        life = int(new["life"].iloc[0])
        anew = known and life != lived
        again = bool(marked) or anew
        parents = new["content_hash"].shift(1).astype(object)
        parents.iloc[0] = None if anew else before
        self.last.update((new["content_hash"].iloc[-1], life, again))
        yield new.drop(columns=["life"]).assign(parent_hash=parents.where(parents.notna(), None), again=again)

    def close(self) -> None:
        pass


PROVIDER = "spark.sql.streaming.stateStore.providerClass"
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def chained(events: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """A stream of events (path, line_index, part, life, content_hash and more) with parent_hash and again, by keyed state.

    ``known``: (path) of files that a table holds already when the stream starts.
    """
    out = StructType([f for f in events.schema.fields if f.name != "life"] + [StructField("parent_hash", StringType()), StructField("again", BooleanType())])
    first = None if known is None else known.select("path").distinct().groupBy("path")
    return events.groupBy("path").transformWithStateInPandas(FileChain(), out, "Append", "None", initialState=first)


def publish(batch: DataFrame, number: int, finish, table: str, name: str, work: str) -> None:
    """Writes one batch of chained events as one partition of the table, replacing what an earlier try left there.

    The stateful plan runs once: its rows go to ``work`` first. Where a file began again, events that the table holds are left out.
    """
    spark, part = batch.sparkSession, f"stream={name}/batch={number}"
    draft = f"{work}/batch={number}"
    finish(batch).dropDuplicates(["id"]).write.mode("overwrite").parquet(draft)
    rows = spark.read.parquet(draft)
    repeated = rows.where("again").select("path").distinct()
    new = rows.drop("again")
    if _exists(spark, table) and not repeated.isEmpty():
        others = ~((F.col("stream") == name) & (F.col("batch") >= number))
        old = spark.read.parquet(table).where(others).join(repeated, "path", "left_semi").select("id").distinct()
        new = new.join(old, "id", "left_anti")
    new.write.mode("overwrite").parquet(f"{table}/{part}")
    place = spark._jvm.org.apache.hadoop.fs.Path(draft)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def ingest_keyed(stream: DataFrame, normalise, finish, table: str, checkpoint: str, name: str = "tail", trigger: dict | None = None):
    """Starts the query that stores the events of new lines once each, with the chain's state in Spark's state store.

    ``normalise``: lines to events with path, line_index, part, life and content_hash, row by row. ``finish``: gives chained events their id.
    State and progress lie in ``checkpoint``, so a restart goes on with the same ids; batches that are replayed replace their own partition.
    """
    spark = stream.sparkSession
    known = spark.read.parquet(table).select("path") if _exists(spark, table) else None
    writer = chained(normalise(stream), known).writeStream.foreachBatch(lambda batch, number: publish(batch, number, finish, table, name, f"{checkpoint}/draft"))
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, STATE_STORE)  # the query keeps the settings it starts with
    try:
        return writer.option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "0 seconds"})).start()
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)


def reconcile(before: DataFrame, batch: DataFrame, warnings: DataFrame) -> DataFrame:
    """One row: rows discovered, distinct ids, imported (not stored before) and warnings."""
    found = batch.agg(F.count(F.lit(1)).alias("discovered"), F.countDistinct("id").alias("distinct_ids"))
    new = batch.select("id").distinct().join(before.select("id"), "id", "left_anti").agg(F.count(F.lit(1)).alias("imported"))
    # three tables of one row
    return found.crossJoin(new).crossJoin(warnings.agg(F.count(F.lit(1)).alias("warnings")))


def activity(events: DataFrame, time: str = "ts", window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Tumbling counts by event type with a watermark; works on streams and on tables. An addition of this engine."""
    source = events.withWatermark(time, late) if events.isStreaming else events
    return source.groupBy(F.window(time, window).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("events")).select(
        F.col("w.start").alias("window_start"), "event_type", "events"
    )


def session_activity(events: DataFrame, time: str = "ts", gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Session windows per user with a watermark. An addition of this engine."""
    source = events.withWatermark(time, late) if events.isStreaming else events
    return source.groupBy(F.session_window(time, gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("events")).select(
        F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "user_id", "events"
    )


def register(spark: SparkSession) -> None:
    """Registers the source; it is sent by value, as the workers that plan a source see no shipped packages."""
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    spark.dataSource.register(TailSource)
