"""Readers of the five transcript layouts: lines of files in, canonical messages out.

A file is the unit of order. ``scan`` keeps line numbers; each parser takes (path, line_index, raw) and is made of
variant accessors and values carried along a file, so files parse in parallel and malformed rows are just skipped.

Files of up to ``WHOLE_BYTES`` are read whole and are one window each. Larger ones are read in ranges, by many tasks: lines are counted per
range, a prefix sum over the ranges numbers them, and ``segment`` (the range's start) lets values be carried from range to range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threadloom.functions.ordered import carried, counted, first_of_file
from threadloom.functions.shipping import ship
from threadloom.functions.text import first_non_empty, is_blank, lines, percent_decode
from threadloom.functions.variants import field, items, itself, joined, nested_text, string
from threadloom.sources.views import MESSAGE_COLUMNS

#: Fixed layouts below a home folder, by source in scan order.
LAYOUTS: dict[str, tuple[str, ...]] = {
    "codex": (".codex/sessions", ".codex/archived_sessions"),
    "claude": (".claude/projects",),
    "cursor": (".cursor/projects",),
    "grok": (".grok/sessions",),
    "pi": (".pi/agent/sessions",),
}


#: Larger files are read in ranges.
WHOLE_BYTES = 1 << 26


def _reader(spark: SparkSession, pattern: str):
    return spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern)


def scan_whole(spark: SparkSession, *folders: str, pattern: str = "*.jsonl", whole_bytes: int = WHOLE_BYTES) -> DataFrame:
    """(path, line_index, raw) of the files of up to ``whole_bytes``; others are left out of the listing."""
    text = _reader(spark, pattern).text(list(folders), wholetext=True).where(F.col("_metadata.file_size") <= whole_bytes)
    rows = text.select(F.col("_metadata.file_path").alias("path"), F.posexplode(lines(F.col("value"))).alias("line_index", "raw"))
    return rows.withColumn("line_index", F.col("line_index").cast("long"))


def scan_ranges(spark: SparkSession, *folders: str, pattern: str = "*.jsonl", whole_bytes: int = WHOLE_BYTES) -> DataFrame:
    """(path, line_index, raw, segment) of the files of more than ``whole_bytes``, of any size, read in ranges of ``spark.sql.files.maxPartitionBytes``.

    Within a range lines are numbered as they are read; a first pass counts each range's lines. A file without a line
    feed for longer than a row may be can't be read.
    """
    at = F.col("_metadata")
    text = _reader(spark, pattern).option("lineSep", "\n").text(list(folders)).where(at["file_size"] > whole_bytes)
    rows = text.select(at["file_path"].alias("path"), at["file_block_start"].alias("segment"), at["file_size"].alias("size"), F.monotonically_increasing_id().alias("place"), F.col("value").alias("raw"))
    ranges = rows.groupBy("path", "segment").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("raw") + 1).alias("bytes"))
    file = Window.partitionBy("path")
    before = F.coalesce(F.sum("n").over(file.orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = ranges.select("path", "segment", (before - F.col("first")).alias("shift"), (F.sum("n").over(file) - 1).alias("last"), F.sum("bytes").over(file).alias("bytes"))
    found = rows.join(ranges, ["path", "segment"]).withColumn("line_index", F.col("place") + F.col("shift"))
    # a carriage return belongs to the line feed after it; the last line may have none
    open_end = (F.col("line_index") == F.col("last")) & (F.col("bytes") > F.col("size"))
    return found.select("path", "line_index", F.when(open_end, F.col("raw")).otherwise(F.regexp_replace("raw", r"\r\z", "")).alias("raw"), "segment")


def scan(spark: SparkSession, *folders: str, pattern: str = "*.jsonl", whole_bytes: int = WHOLE_BYTES) -> DataFrame:
    """(path, line_index, raw) of every ``pattern`` below the folders."""
    return scan_whole(spark, *folders, pattern=pattern, whole_bytes=whole_bytes).unionByName(scan_ranges(spark, *folders, pattern=pattern, whole_bytes=whole_bytes).drop("segment"))


def _text_items(v: Column, drop_blank: bool) -> Column:
    """Text of the items of an array that are objects of type ``text``."""
    return joined(F.filter(items(v), lambda x: string(x, "$.type") == "text"), lambda x: string(x, "$.text"), drop_blank)


def _tokens(v: Column, path: str) -> Column:
    """A whole number, or an object's total or value; else 0."""
    whole = lambda p: F.when(F.schema_of_variant(field(v, p)) == "BIGINT", F.try_variant_get(v, p, "long"))
    return F.coalesce(whole(path), whole(f"{path}.total"), whole(f"{path}.value"), F.lit(0)).cast("long")


def _parsed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("v", F.try_parse_json("raw")).where("v is not null")


def _finish(rows: DataFrame, source: str) -> DataFrame:
    defaults = {
        "model": F.lit(""), "timestamp": F.lit(""), "is_subagent": F.lit(False), "msg_type": F.col("role"),
        "input_tokens": F.lit(0).cast("long"), "output_tokens": F.lit(0).cast("long"), "project_path": F.lit(""),
    }
    rows = rows.withColumns({c: F.coalesce(F.col(c), d) if c in rows.columns else d for c, d in defaults.items()})
    rows = rows.withColumns({"source": F.lit(source), "source_file": F.col("path")})
    return rows.where(~is_blank(F.col("content"))).select(*MESSAGE_COLUMNS)


def parse_claude(rows: DataFrame) -> DataFrame:
    """User and assistant rows with a session and a text; files' rows without a folder get its first one."""
    ship(rows.sparkSession)
    v = F.col("v")
    out = _parsed(rows).withColumns(
        {
            "type": string(v, "$.type"), "session_id": string(v, "$.sessionId"), "content": nested_text(field(v, "$.message.content"), first_key_decides=True),
            "role": F.coalesce(string(v, "$.message.role"), string(v, "$.type")), "model": string(v, "$.message.model"), "timestamp": string(v, "$.timestamp"),
            "cwd": F.nullif(string(v, "$.cwd"), F.lit("")), "input_tokens": _tokens(v, "$.message.usage.input_tokens"), "output_tokens": _tokens(v, "$.message.usage.output_tokens"),
        }
    )
    out = out.where(F.col("type").isin("user", "assistant") & (F.col("session_id") != "") & ~is_blank(F.col("content")))
    return _finish(
        first_of_file(out, "first_cwd", F.col("cwd")).withColumns(
            {
                "project_path": F.coalesce("cwd", "first_cwd"),
                "project_name": F.regexp_extract("path", r"/projects/([^/]+)/", 1),
                "is_subagent": F.contains("path", F.lit("/subagents/")),
                "msg_type": F.col("type"),
            }
        ),
        "claude",
    )


def parse_codex(rows: DataFrame) -> DataFrame:
    """``session_meta`` sets session, folder and provider for the rows after it."""
    v = F.col("v")
    rows = _parsed(rows).withColumn("type", string(v, "$.type"))
    meta = F.col("type") == "session_meta"
    rows = carried(rows, {name: F.when(meta, string(v, path)) for name, path in (("session_id", "$.payload.id"), ("project_path", "$.payload.cwd"), ("model", "$.payload.model_provider"))})
    user = (F.col("type") == "event_msg") & (string(v, "$.payload.type") == "user_message")
    said = (F.col("type") == "response_item") & (string(v, "$.payload.role") == "assistant")
    parts = F.filter(F.try_variant_get(v, "$.payload.content", "array<variant>"), lambda x: string(x, "$.type") == "output_text")
    out = rows.where(user | said).withColumns(
        {
            "role": F.when(user, "user").otherwise("assistant"),
            "content": F.when(user, string(v, "$.payload.message")).otherwise(joined(parts, lambda x: string(x, "$.text"))),
            "timestamp": string(v, "$.timestamp"), "project_name": F.col("project_path"),
        }
    )
    return _finish(out.where("session_id <> '' and project_path <> ''"), "codex")


def parse_cursor(rows: DataFrame) -> DataFrame:
    """Text of an array is that of its text items; an object's is its text, else that of its content."""
    v = F.col("v")
    content, inner = field(v, "$.message.content"), field(v, "$.message.content.content")
    said = lambda x: F.coalesce(itself(x), F.when(items(x).isNotNull(), _text_items(x, False)), string(x, "$.text"))
    out = _parsed(rows).withColumns(
        {
            "role": string(v, "$.role"), "content": F.coalesce(said(content), said(inner)), "model": string(v, "$.message.model"),
            "timestamp": string(v, "$.timestamp"), "project_name": F.regexp_extract("path", r"/projects/([^/]+)/", 1),
            "session_id": F.regexp_extract("path", r"/agent-transcripts/([^/]+)/", 1),
        }
    )
    return _finish(out.where(F.col("role").isin("user", "assistant")), "cursor")


def epoch_stamp(ms: Column) -> Column:
    """RFC 3339 in UTC, fractions without trailing zeros."""
    stamp = F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd'T'HH:mm:ss.SSS")
    return F.concat(F.regexp_replace(stamp, r"(\.\d*[1-9])0*$|\.0+$", "$1"), F.lit("Z"))


def parse_grok(rows: DataFrame, summaries: DataFrame | None = None) -> DataFrame:
    """Updates of a session; chunks of one answer are joined without separator until the next user chunk.

    ``summaries``: (session_id, cwd, created_at, model) from the side files, where there are any.
    """
    ship(rows.sparkSession)
    v = F.col("v")
    update = "$.params.update"
    ms = F.coalesce(F.try_variant_get(v, "$.params._meta.agentTimestampMs", "long"), F.try_variant_get(v, f"{update}._meta.agentTimestampMs", "long"), F.try_variant_get(v, "$.timestamp", "long") * 1000)
    chunks = carried(_parsed(rows), {"model": string(v, f"{update}._meta.modelId")}).withColumns(
        {
            "kind": string(v, f"{update}.sessionUpdate"), "text": nested_text(field(v, f"{update}.content"), ("content",), True),
            "stamp": F.coalesce(F.when(F.schema_of_variant(F.try_variant_get(v, "$.timestamp", "variant")) == "STRING", string(v, "$.timestamp")), epoch_stamp(ms)),
            "session_id": F.element_at(F.split("path", "/"), -2), "folder": percent_decode(F.element_at(F.split("path", "/"), -3)),
        }
    ).where(F.col("kind").isin("user_message_chunk", "agent_message_chunk"))
    user = F.col("kind") == "user_message_chunk"
    chunks = counted(chunks, "island", user).where(~is_blank(F.col("text")))
    place = F.struct("line_index", "text", "stamp", "model")
    runs = chunks.groupBy("path", "session_id", "folder", "island", user.alias("user")).agg(F.array_sort(F.collect_list(place)).alias("c"))
    out = runs.select(
        "path", "session_id", F.col("folder").alias("project_name"), F.col("folder").alias("project_path"), F.when(F.col("user"), "user").otherwise("assistant").alias("role"),
        F.array_join(F.transform("c", lambda x: x["text"]), "").alias("content"), F.get("c", F.lit(0))["stamp"].alias("timestamp"), F.get("c", F.lit(0))["model"].alias("model"),
        F.get("c", F.lit(0))["line_index"].alias("line_index"),
    )
    if summaries is not None:
        s = summaries.select("session_id", F.col("cwd").alias("_cwd"), F.col("created_at").alias("_at"), F.col("model").alias("_model"))
        out = out.join(s, "session_id", "left").withColumns(
            {"project_path": first_non_empty(F.col("_cwd"), F.col("project_path")), "timestamp": F.coalesce("timestamp", "_at"), "model": F.coalesce("model", "_model")}
        )
    return _finish(out, "grok")


def read_summaries(spark: SparkSession, *folders: str) -> DataFrame:
    text = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "summary.json").text(list(folders), wholetext=True)
    v = F.try_parse_json("value")
    return text.select(
        F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2).alias("session_id"), string(v, "$.info.cwd").alias("cwd"), string(v, "$.created_at").alias("created_at"), string(v, "$.current_model_id").alias("model")
    )


def parse_pi(rows: DataFrame) -> DataFrame:
    """``session`` sets id and folder, ``model_change`` the model; tool results aren't messages."""
    v = F.col("v")
    rows = _parsed(rows).withColumn("type", string(v, "$.type"))
    head, change = F.col("type") == "session", F.col("type") == "model_change"
    stem = F.regexp_extract("path", r"([^/]*?)(\.jsonl)?$", 1)
    changed = F.concat_ws("/", *[F.nullif(string(v, p), F.lit("")) for p in ("$.provider", "$.modelId")])
    rows = carried(rows, {"session_id": F.when(head, string(v, "$.id")), "project_path": F.when(head, string(v, "$.cwd")), "running_model": F.when(change, changed)})
    rows = rows.withColumn("session_id", F.coalesce("session_id", F.element_at(F.split(stem, "_"), -1)))
    content = field(v, "$.message.content")
    usage = lambda *names: sum((_tokens(v, f"$.message.usage.{n}") for n in names), F.lit(0)).cast("long")
    out = rows.where((F.col("type") == "message") & string(v, "$.message.role").isin("user", "assistant")).withColumns(
        {
            "role": string(v, "$.message.role"), "content": F.coalesce(itself(content), F.when(items(content).isNotNull(), _text_items(content, True)), F.when(string(content, "$.type") == "text", string(content, "$.text"))),
            "model": F.coalesce(string(v, "$.message.model"), "running_model"), "timestamp": F.coalesce(string(v, "$.timestamp"), string(v, "$.message.timestamp")),
            "project_name": F.element_at(F.split("path", "/"), -2), "input_tokens": usage("input", "input_tokens", "inputTokens", "prompt_tokens"),
            "output_tokens": usage("output", "output_tokens", "outputTokens", "completion_tokens"),
        }
    )
    return _finish(out.where("project_path <> ''"), "pi")


PARSERS = {"codex": parse_codex, "claude": parse_claude, "cursor": parse_cursor, "grok": parse_grok, "pi": parse_pi}


def load_messages(spark: SparkSession, home: str, sources: tuple[str, ...] | None = None, pattern: str = "*.jsonl", whole_bytes: int = WHOLE_BYTES) -> DataFrame:
    """All messages below a home folder; sources not asked for aren't read. Files of more than ``whole_bytes`` are read and parsed in ranges."""
    out = None
    for source, folders in LAYOUTS.items():
        if sources is not None and source not in sources:
            continue
        present = [f"{home.rstrip('/')}/{f}" for f in folders if _exists(spark, f"{home.rstrip('/')}/{f}")]
        if not present:
            continue
        for read in (scan_whole, scan_ranges):
            rows = read(spark, *present, pattern=pattern, whole_bytes=whole_bytes)
            found = parse_grok(rows, read_summaries(spark, *present)) if source == "grok" else PARSERS[source](rows)
            out = found if out is None else out.unionByName(found)
    if out is None:
        raise FileNotFoundError(f"no transcripts below {home}")
    return out


def _exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)
