"""Registered queries: a tail ingest run to its end, and activity windows."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter
from pathlib import Path

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.functions import ids
from threadloom.functions.scratch import fresh
from threadloom.functions.shipping import ship
from threadloom.plans.reading import M
from threadloom.sources import capture as C
from threadloom.sources import views as V
from threadloom.streaming import tail

QUERIES, ORACLES = {}, {}
VERSION = "v1"
SHARDS = 32


def _events(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    return e.withColumn("ts", F.col("ts").cast("timestamp"))


def message_events(batch: DataFrame, *more: str) -> DataFrame:
    """Events of lines that are messages: (path, offset, raw) to what ``capture.chained`` takes, and ``more`` columns of the lines."""
    kind = "source string, session_id string, role string, content string, timestamp string"
    found = batch.select("path", "offset", *more, F.from_json("raw", kind).alias("r")).where("r.session_id is not null")
    return found.select(
        "path", *more, F.col("offset").alias("line_index"), F.lit(0).alias("part"), "r.source", F.col("r.session_id").alias("source_session_id"), F.concat(F.lit("at:"), "offset").alias("source_event_id"),
        F.concat("r.role", F.lit("_turn")).alias("event_type"), "r.role", "r.timestamp", F.col("r.content").alias("content_text"),
    )


def chain(events: DataFrame, before: DataFrame | None) -> DataFrame:
    return C.chained(events, VERSION, before)


def write_folders(rows: DataFrame, folder: str, name: str) -> None:
    """Writes (key, value), a key's rows one behind the other, as the file ``name`` in a folder a key. Tasks write them; the driver
    neither commits nor lists files."""
    place = folder.removeprefix("file://")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, pairs = 0, (pair for batch in batches for pair in zip(*(c.to_pylist() for c in batch.columns)))
        for key, lines in groupby(pairs, itemgetter(0)):
            home = Path(place) / str(key)
            home.mkdir(parents=True, exist_ok=True)
            draft = home / f".{name}.{uuid.uuid4().hex}"
            with draft.open("wb") as f:
                f.writelines(f"{value}\n".encode() for _, value in lines)
            draft.rename(home / f"{name}.txt")
            n += 1
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})

    rows.mapInArrow(write, "n long").write.format("noop").mode("overwrite").save()


def tail_ingest(spark, d):
    """Writes every session as a file, in two goes, tails them after each into one table, and a third time with a new stream,
    which adds nothing."""
    ship(spark)
    tail.register(spark)
    home = fresh(spark, "tail")
    m = V.messages(spark, d).withColumn("go", F.col("line_index") % 2)
    rows = m.select("source_file", "go", "line_index", F.to_json(F.struct("source", "session_id", "role", "content", "timestamp")).alias("value"))

    def run(name: str) -> None:
        source = spark.readStream.format("jsonl_tail").option("path", f"{home}/in").option("pattern", "*.txt")
        stream = source.option("manifest", f"{home}/epochs-{name}").option("shards", SHARDS).load()
        query = tail.ingest(stream, message_events, chain, f"{home}/table", f"{home}/cursors", f"{home}/check-{name}", name).start()
        try:
            query.processAllAvailable()
        finally:
            query.stop()

    for go in range(2):
        part = rows.where(F.col("go") == go).repartition("source_file").sortWithinPartitions("source_file", "line_index")
        write_folders(part.select("source_file", "value"), f"{home}/in", str(go))
        run("first")
    run("second")
    return spark.read.parquet(f"{home}/table").select("source_session_id", "event_type", "role", "timestamp", "content_hash", "parent_hash")


def keyed_events(lines: DataFrame) -> DataFrame:
    """As ``message_events``, with what the keyed chain needs: the file's life and the content's hash."""
    return message_events(lines, "life").withColumn("content_hash", ids.content_hash(F.col("content_text")))


def with_id(events: DataFrame) -> DataFrame:
    rows = events.withColumn("parser_version", F.lit(VERSION))
    return rows.withColumn("id", ids.event_id({f: F.col(f) for f in ids.EVENT_FIELDS}))


def write_files(rows: DataFrame, folder: str, key: str = "session_id") -> None:
    """Writes (key, at, value) as one text file a key, its lines by ``at``; a file that is there is replaced at once."""
    place = folder.removeprefix("file://")

    def write(pdf: pd.DataFrame) -> pd.DataFrame:
        name = str(pdf[key].iloc[0])
        Path(place).mkdir(parents=True, exist_ok=True)
        draft = Path(place) / f".{name}.{uuid.uuid4().hex}"
        draft.write_bytes("".join(f"{v}\n" for v in pdf.sort_values("at")["value"]).encode())
        draft.rename(Path(place) / f"{name}.txt")
        return pd.DataFrame({"n": [len(pdf)]})

    rows.groupBy(key).applyInPandas(write, "n long").write.format("noop").mode("overwrite").save()


def tail_append_rotate(spark, d):
    """Every session as a file that grows twice, then some files that began again: with a new first line, or cut to their first line.

    Tailed after each step with the chain in keyed state, the stream stopped and started again in between; at the end a new stream, which adds nothing.
    """
    ship(spark)
    tail.register(spark)
    home = fresh(spark, "tail")
    value = F.to_json(F.struct("source", "session_id", "role", "content", "timestamp")).alias("value")
    m = V.messages(spark, d)
    rows = m.select("session_id", F.col("line_index").alias("at"), value)
    heads = m.where("session_id like '%3' and line_index = 0").withColumn("content", F.concat(F.lit("again "), "session_id"))
    heads = heads.select("session_id", F.lit(-1).cast("long").alias("at"), value)

    def run(name: str) -> None:
        source = spark.readStream.format("jsonl_tail").option("path", f"{home}/in").option("pattern", "*.txt").option("manifest", f"{home}/epochs-{name}")
        query = tail.ingest_keyed(source.load(), keyed_events, with_id, f"{home}/table", f"{home}/check-{name}", name)
        try:
            query.processAllAvailable()
        finally:
            query.stop()

    for step in (rows.where("at < 2"), rows, rows.where("session_id like '%3'").unionByName(heads).unionByName(rows.where("session_id like '%4' and at = 0"))):
        write_files(step, f"{home}/in")
        run("first")
    run("second")
    return spark.read.parquet(f"{home}/table").select("source_session_id", "event_type", "role", "timestamp", "content_hash", "parent_hash")


QUERIES |= {
    "tail_ingest": tail_ingest,
    "tail_append_rotate": tail_append_rotate,
    "activity_hourly": lambda s, d: tail.activity(_events(s, d)).select(F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("hour"), "event_type", "events"),
    "activity_sessions": lambda s, d: tail.session_activity(_events(s, d)).groupBy("user_id").agg(F.count(F.lit(1)).alias("sessions"), F.max("events").alias("longest")),
}
ORACLES |= {
    # each go's lines of a session are one file
    "tail_ingest": M + """ SELECT session_id AS source_session_id, role || '_turn' AS event_type, role, timestamp, 'sha256:' || sha256(content) AS content_hash,
    lag('sha256:' || sha256(content)) OVER (PARTITION BY session_id, line_index % 2 ORDER BY line_index) AS parent_hash FROM messages""",
    "tail_append_rotate": M + """, grown AS (SELECT 0 AS life, session_id, role, timestamp, content, line_index FROM messages
    UNION ALL SELECT 1, session_id, role, timestamp, content, line_index FROM messages WHERE session_id LIKE '%3'
    UNION ALL SELECT 1, session_id, role, timestamp, 'again ' || session_id, -1 FROM messages WHERE session_id LIKE '%3' AND line_index = 0)
    SELECT session_id AS source_session_id, role || '_turn' AS event_type, role, timestamp, 'sha256:' || sha256(content) AS content_hash,
    lag('sha256:' || sha256(content)) OVER (PARTITION BY life, session_id ORDER BY line_index) AS parent_hash FROM grown""",
    "activity_hourly": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS hour, event_type, count(*) AS events FROM events GROUP BY ALL",
    "activity_sessions": """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS first FROM events),
    s AS (SELECT user_id, sum(first) OVER (PARTITION BY user_id ORDER BY ts) AS no FROM g), c AS (SELECT user_id, no, count(*) AS n FROM s GROUP BY ALL)
    SELECT user_id, count(*) AS sessions, max(n) AS longest FROM c GROUP BY user_id""",
}
