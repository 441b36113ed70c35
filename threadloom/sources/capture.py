"""Store events from transcript lines: one row to one or many events, with ids, parent hashes, warnings and cursors."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.functions import ids
from threadloom.functions.ordered import carried, previous, segmented
from threadloom.functions.shipping import ship
from threadloom.functions.text import is_blank, mask_paths, shorten_output
from threadloom.functions.variants import compact, field, flat_text, items, nested_text, string
from threadloom.sources.transcripts import WHOLE_BYTES, scan_ranges, scan_whole

EPOCH = "1970-01-01T00:00:00Z"
# The versions that are part of an event's identity, and the roles of event types.
PARSER_VERSIONS = {"claude": "claude-code-jsonl-v1", "codex": "codex-rollout-v1", "cursor": "cursor-agent-jsonl-v1", "fixture": "fixture-jsonl-v1"}
ROLES = {"user_turn": "user", "assistant_turn": "assistant", "tool_call": "assistant", "tool_result": "tool"}
TURNS = {"assistant": "assistant_turn", "tool": "tool_result", "user": "user_turn"}


def _choice(of: Column, names: dict[str, str], otherwise: Column) -> Column:
    return reduce(lambda out, pair: F.when(of == pair[0], pair[1]).otherwise(out), names.items(), otherwise)


def _turn(role: Column) -> Column:
    return _choice(role, TURNS, F.lit("unknown_raw_event"))


def _blocks(rows: DataFrame, content: Column) -> DataFrame:
    """A row for each item of ``content`` (columns ``block`` and ``i``), or one without them if it is no array."""
    found = items(content)
    each = F.transform(found, lambda x, i: F.struct(x.alias("block"), i.alias("i")))
    whole = F.array(F.struct(F.lit(None).cast("variant").alias("block"), F.lit(None).cast("int").alias("i")))
    return rows.withColumn("b", F.explode(F.when(found.isNotNull(), each).otherwise(whole))).select(*rows.columns, "b.block", "b.i")


def _suffix(*names: str) -> Column:
    return F.when(F.col("block").isNotNull(), F.coalesce(*[string(F.col("block"), f"$.{n}") for n in names], F.concat(F.lit("part-"), F.col("i").cast("string"))))


def _own_words(*others: str) -> Column:
    v = F.col("v")
    return F.coalesce(string(v, "$.content"), *[flat_text(field(v, f"$.{name}")) for name in others])


def claude_events(rows: DataFrame) -> DataFrame:
    """Adds event_type, role, content_text and suffix: each content block of a message is an event, other rows are one each."""
    v, block = F.col("v"), F.col("block")
    kind = F.coalesce(string(v, "$.type"), F.lit("unknown"))
    message = kind.isin("user", "assistant")
    content = field(v, "$.message.content")
    rows = _blocks(rows.withColumn("kind", kind), F.when(message, content))
    kind, part, inside = F.col("kind"), F.coalesce(string(block, "$.type"), F.lit("text")), block.isNotNull()
    rows = rows.withColumns({"part_type": F.when(inside, part), "row_role": F.coalesce(string(v, "$.message.role"), kind)})
    part, role = F.col("part_type"), F.col("row_role")
    subject = F.when(part == "tool_result", field(block, "$.content")).when(part == "tool_use", F.lit(None)).when(inside, block).when(message, content)
    rows = rows.withColumn("said", nested_text(subject))
    said = F.col("said")
    call = F.concat(F.coalesce(string(block, "$.name"), F.lit("tool")), F.lit(" "), F.coalesce(compact(field(block, "$.input")), compact(block)))
    life = F.coalesce(string(v, "$.event"), string(v, "$.event_type"), string(v, "$.kind"), kind)
    begins = {"session_start": "session_start", "started": "session_start", "session": "session_start", "session_end": "session_end", "ended": "session_end", "summary": "compaction", "compaction": "compaction"}
    operation = F.coalesce(string(v, "$.operation"), string(v, "$.action"), string(v, "$.kind"), F.lit("unknown"))
    lifecycle, queue = kind.isin("system", "summary", "session"), kind == "queue-operation"
    unknown = F.lit("unknown_raw_event")
    usable = content.isNotNull()
    return rows.withColumns(
        {
            "event_type": F.when(part == "tool_use", "tool_call").when(part == "tool_result", "tool_result").when(part == "thinking", "compaction")
            .when(inside | message & usable, _turn(role)).when(lifecycle, _choice(life, begins, unknown)).when(queue & (operation == "enqueue"), "user_turn").otherwise(unknown),
            "role": F.when(part.isin("tool_use", "thinking"), "assistant").when(part == "tool_result", "tool").when(inside | message & usable, role)
            .when(queue & (operation == "enqueue"), "user").otherwise(F.lit("system")),
            "content_text": F.when(part == "tool_use", call).when(part == "tool_result", shorten_output(F.coalesce(said, compact(block)))).when(inside, F.coalesce(said, compact(block)))
            .when(message & field(v, "$.message").isNull(), F.concat(F.lit("Claude "), kind, F.lit(" row missing message payload")))
            .when(message & ~usable, F.concat(F.lit("Claude "), kind, F.lit(" message missing content for role "), role))
            .when(message, said)
            .when(lifecycle, F.coalesce(_own_words("message"), F.concat(F.lit("Claude lifecycle event: "), life)))
            .when(queue, F.coalesce(_own_words("message", "payload"), F.concat(F.lit("Claude queue operation: "), operation)))
            .when(kind == "attachment", F.coalesce(_own_words("message", "payload"), F.lit("Claude attachment metadata omitted; see local raw ref")))
            .when(kind == "file-history-snapshot", F.coalesce(_own_words("message"), F.concat(F.lit("Claude "), kind, F.lit(" metadata omitted; see local raw ref"))))
            .otherwise(F.coalesce(_own_words("message", "payload"), F.concat(F.lit("Claude unknown event type: "), kind))),
            "suffix": _suffix("id", "tool_use_id"),
        }
    )


def codex_events(rows: DataFrame) -> DataFrame:
    """As ``claude_events``, one event a row; ``provider`` is the model provider seen last."""
    v = F.col("v")
    payload = field(v, "$.payload")
    rows = rows.withColumns({"kind": F.when(payload.isNotNull(), string(v, "$.type")), "inner": string(v, "$.payload.type"), "own_role": string(v, "$.payload.role")})
    kind, inner, own = F.col("kind"), F.col("inner"), F.col("own_role")
    meta, message, item = kind == "session_meta", kind == "event_msg", kind == "response_item"
    spoken = item & own.isNotNull()
    call, result, thought = item & inner.isin("function_call", "tool_call"), item & inner.isin("function_call_output", "tool_result"), item & (inner == "reasoning")
    user, packed = message & (inner == "user_message"), message & inner.isin("agent_reasoning", "context_compaction")
    words = lambda name: flat_text(field(v, f"$.payload.{name}"))
    raw = compact(payload)
    provider = F.coalesce(F.nullif(string(v, "$.payload.model_provider"), F.lit("")), F.col("provider"), F.lit(""))
    begun = F.concat(F.lit("Codex session "), F.coalesce(string(v, "$.payload.id"), F.lit("unknown")), F.lit("\nproject: linked\nmodel_provider: "), provider)
    asked = user & string(v, "$.payload.message").isNotNull()
    return rows.withColumns(
        {
            "event_type": F.when(meta, "session_start").when(asked, "user_turn").when(packed | thought & own.isNull(), "compaction").when(spoken & (own == "assistant"), "assistant_turn")
            .when(spoken & (own == "tool"), "tool_result").when(spoken, "unknown_raw_event").when(call, "tool_call").when(result, "tool_result").otherwise(F.lit("unknown_raw_event")),
            "role": F.when(asked, "user").when(spoken, own).when(call | thought, "assistant").when(result, "tool").otherwise(F.lit("system")),
            "content_text": F.when(meta, begun).when(asked, string(v, "$.payload.message")).when(packed, F.coalesce(string(v, "$.payload.message"), words("content"), raw))
            .when(spoken, F.coalesce(words("content"), raw))
            .when(call, F.concat(F.coalesce(string(v, "$.payload.name"), F.lit("tool")), F.lit(" "), F.coalesce(compact(field(v, "$.payload.arguments")), raw)))
            .when(result, F.coalesce(string(v, "$.payload.output"), words("content"), raw))
            .when(thought, F.coalesce(words("summary"), words("content"), raw))
            .when(item | message & ~user, raw).otherwise(compact(v)),
            "suffix": F.lit(None).cast("string"),
        }
    )


def cursor_events(rows: DataFrame) -> DataFrame:
    """As ``claude_events``; tool calls lose local paths."""
    v, block = F.col("v"), F.col("block")
    kind = string(v, "$.type")
    edge = F.coalesce(kind.isin("session_start", "session_end", "compaction", "summary"), F.lit(False))
    content = F.coalesce(field(v, "$.message.content"), field(v, "$.content"))
    rows = _blocks(rows.withColumns({"kind": kind, "edge": edge}), F.when(~edge, content))
    kind, edge, inside = F.col("kind"), F.col("edge"), block.isNotNull()
    rows = rows.withColumns({"part_type": F.when(inside, F.coalesce(string(block, "$.type"), F.lit("text"))), "row_role": F.coalesce(string(v, "$.role"), kind, F.lit("unknown"))})
    part, role = F.col("part_type"), F.col("row_role")
    call, result, thought = part.isin("tool_call", "function_call", "tool_use"), part.isin("tool_result", "tool_output", "function_call_output"), part.isin("thinking", "reasoning")
    subject = F.when(edge | call, F.lit(None)).when(result, field(block, "$.content")).when(inside, block).otherwise(content)
    rows = rows.withColumn("said", nested_text(subject, ("content",)))
    said = F.col("said")
    args = F.concat(F.coalesce(string(block, "$.name"), F.lit("tool")), F.lit(" "), F.coalesce(compact(field(block, "$.arguments")), compact(field(block, "$.input")), compact(block)))
    spoken = inside | said.isNotNull()
    return rows.withColumns(
        {
            "event_type": F.when(edge, F.when(kind.isin("compaction", "summary"), "compaction").otherwise(kind)).when(call, "tool_call").when(result, "tool_result").when(thought, "compaction")
            .when(spoken, _turn(role)).otherwise(F.lit("unknown_raw_event")),
            "role": F.when(call | thought, "assistant").when(result, "tool").when(~edge & spoken, role).otherwise(F.lit("system")),
            "content_text": F.when(kind == "session_start", "Cursor session started").when(kind == "session_end", "Cursor session ended")
            .when(edge, F.coalesce(_own_words("message"), F.concat(F.lit("Cursor "), kind))).when(call, mask_paths(args))
            .when(result, shorten_output(F.coalesce(string(block, "$.output"), said, F.lit("Cursor tool result metadata omitted"))))
            .when(thought, F.coalesce(said, F.lit("Cursor reasoning metadata omitted"))).when(inside, F.coalesce(said, F.concat(F.lit("Cursor content block metadata omitted: "), part)))
            .when(content.isNull(), F.coalesce(_own_words("message", "payload"), F.concat(F.lit("Cursor unknown event role/type: "), role)))
            .otherwise(F.coalesce(said, F.concat(F.lit("Cursor "), role, F.lit(" row had unsupported content shape")))),
            "suffix": _suffix("id", "tool_call_id", "tool_use_id"),
        }
    )


# Event types by the ``event_type`` or ``type`` of a plain row.
PLAIN_TYPES = {
    "session_meta": "session_start", "session_start": "session_start", "session": "session_start", "session_end": "session_end", "compaction": "compaction", "user": "user_turn", "note": "user_turn",
    "event_msg": "user_turn", "assistant": "assistant_turn", "response_item": "assistant_turn", "tool_output": "tool_result", "tool_result": "tool_result", "tool_call": "tool_call",
}


def fixture_events(rows: DataFrame) -> DataFrame:
    """As ``claude_events`` for rows of plain JSON, one event a row, blank ones too."""
    v = F.col("v")
    kind = F.coalesce(string(v, "$.event_type"), string(v, "$.type"))
    role = string(v, "$.role")
    message = F.when(role == "assistant", "assistant_turn").when(role.isin("tool", "toolResult"), "tool_result").otherwise(F.lit("user_turn"))
    rows = rows.withColumn("event_type", F.when(kind == "message", message).otherwise(_choice(kind, PLAIN_TYPES, F.lit("unknown_raw_event"))))
    words = lambda path: flat_text(field(v, path))
    text = F.coalesce(words("$.content"), words("$.message"), string(v, "$.payload.message"), words("$.payload.content"), words("$.message.content"), compact(v))
    default = _choice(F.col("event_type"), ROLES, F.lit("system"))
    return rows.withColumns({"role": F.coalesce(role, string(v, "$.message.role"), default), "content_text": text, "suffix": F.lit(None).cast("string")})


NORMALISERS = {"claude": claude_events, "codex": codex_events, "cursor": cursor_events, "fixture": fixture_events}


def _session(source: str) -> Column:
    """The session that a row sets for itself and those after it; null for none."""
    v = F.col("v")
    if source == "codex":
        return F.coalesce(string(v, "$.session_id"), F.when(string(v, "$.type") == "session_meta", string(v, "$.payload.id")))
    if source == "fixture":
        return F.coalesce(string(v, "$.session_id"), string(v, "$.sessionId"), string(v, "$.payload.id"))
    names = ("sessionId",) if source == "claude" else ("sessionId", "session_id")
    return F.nullif(F.coalesce(*[string(v, f"$.{n}") for n in names]), F.lit(""))


def stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*?)(\.[^./]*)?$", 1)


def normalised(rows: DataFrame, source: str) -> DataFrame:
    """Events of (path, line_index, raw) without chain and ids; malformed rows give none (see ``warnings``), blank texts neither."""
    ship(rows.sparkSession)
    v = F.col("v")
    ranged = ["segment"] if segmented(rows) else []
    parsed = rows.select("path", "line_index", "raw", *ranged, F.try_parse_json("raw").alias("v")).where("v is not null")
    parsed = carried(parsed, {"source_session_id": _session(source)} | ({"provider": string(v, "$.payload.model_provider")} if source == "codex" else {}))
    parsed = parsed.withColumn("source_session_id", F.coalesce("source_session_id", stem(F.col("path"))))
    own = {"claude": ("uuid", "id"), "codex": ("id", "payload.id"), "cursor": ("uuid", "id"), "fixture": ("uuid", "id")}[source]
    line = F.concat(F.lit("row:"), ids.content_hash(F.col("raw"))) if source == "fixture" else F.concat(F.lit("line:"), (F.col("line_index") + 1).cast("string"), F.lit(":"), ids.content_hash(F.col("raw")))
    parsed = parsed.withColumns({"base": F.coalesce(*[string(v, f"$.{n}") for n in own], line), "timestamp": F.coalesce(string(v, "$.timestamp"), F.lit(EPOCH))})
    out = NORMALISERS[source](parsed)
    if source != "fixture":
        out = out.where(~is_blank(F.col("content_text")))
    part = F.coalesce("i", F.lit(0)) if "i" in out.columns else F.lit(0)
    return out.select(
        F.lit(source).alias("source"), "source_session_id", F.concat_ws(":", "base", "suffix").alias("source_event_id"), "event_type", "role", "timestamp", "content_text",
        F.concat("path", F.lit(":"), (F.col("line_index") + 1).cast("string")).alias("raw_local_ref"), "path", "line_index", part.alias("part"), *ranged,
    )


def chained(events: DataFrame, parser_version: str, before: DataFrame | None = None) -> DataFrame:
    """Adds content_hash, parent_hash, parser_version and id; an event's parent is the event before it in its file.

    ``before``: (path, last_hash) of files whose earlier events were taken before; their first event follows on.
    """
    out = events.withColumn("content_hash", ids.content_hash(F.col("content_text")))
    out = previous(out, "parent_hash", "content_hash", ("line_index", "part"))
    if before is not None:
        out = out.join(before.select("path", "last_hash"), "path", "left").withColumn("parent_hash", F.coalesce("parent_hash", "last_hash"))
    out = out.withColumn("parser_version", F.lit(parser_version)).drop("last_hash", "segment")
    return out.withColumn("id", ids.event_id({f: F.col(f) for f in ids.EVENT_FIELDS}))


def capture(rows: DataFrame, source: str, project_id: str) -> DataFrame:
    """The store events of (path, line_index, raw), with ids and parent hashes."""
    return chained(normalised(rows, source), PARSER_VERSIONS[source]).withColumns({"project_id": F.lit(project_id), "sync_status": F.lit("pending")})


def capture_files(spark: SparkSession, source: str, project_id: str, *folders: str, pattern: str = "*.jsonl", whole_bytes: int = WHOLE_BYTES) -> DataFrame:
    """The store events of the transcripts below the folders; files of more than ``whole_bytes`` are read and chained range by range."""
    reads = [read(spark, *folders, pattern=pattern, whole_bytes=whole_bytes) for read in (scan_whole, scan_ranges)]
    whole, ranged = (capture(rows, source, project_id) for rows in reads)
    return whole.unionByName(ranged)


def discover(rows: DataFrame, source: str, project_path: str) -> DataFrame:
    """(source, session_id, path) of the files of (path, line_index, raw) that belong to a project, by path.

    A file belongs to the folder its rows name first. Without one, Claude's and Cursor's go by the name of their project's
    folder (Cursor's also if there is none), Codex's belong to none.
    """
    v = F.col("v")
    parsed = rows.select("path", "line_index", F.try_parse_json("raw").alias("v")).where("v is not null")
    cwd = {"codex": F.when(string(v, "$.type") == "session_meta", F.coalesce(string(v, "$.payload.cwd"), string(v, "$.cwd"))), "claude": F.nullif(string(v, "$.cwd"), F.lit(""))}
    found = cwd.get(source, F.nullif(F.coalesce(string(v, "$.cwd"), string(v, "$.workspace.cwd")), F.lit("")))
    own = string(v, "$.sessionId") if source == "claude" else F.nullif(F.coalesce(string(v, "$.sessionId"), string(v, "$.session_id")), F.lit(""))
    marks = parsed.select("path", "line_index", found.alias("cwd"), own.alias("own"))
    at = F.min(F.when(F.col("cwd").isNotNull(), F.col("line_index")))
    ends = marks.groupBy("path").agg(at.alias("at"), F.min_by("cwd", F.when(F.col("cwd").isNotNull(), F.col("line_index"))).alias("cwd"))
    # session ids count up to the row that names the folder
    seen = marks.where("own is not null").join(ends.select("path", "at"), "path").where("at is null or line_index <= at")
    pick = F.min_by if source == "claude" else F.max_by
    sessions = seen.groupBy("path").agg(pick("own", "line_index").alias("own"))
    files = rows.select("path").distinct().join(ends, "path", "left").join(sessions, "path", "left")
    alias = F.nullif(F.regexp_extract("path", r"/projects/([^/]+)/", 1), F.lit(""))
    bare = project_path.strip("/").replace("/", "-")
    named = F.lit(False) if source == "codex" else alias == f"-{bare}" if source == "claude" else alias.isNull() | alias.isin(f"-{bare}", bare)
    mine = F.when(F.col("cwd").isNotNull(), F.col("cwd") == project_path).otherwise(F.coalesce(named, F.lit(False)))
    session = stem(F.col("path")) if source == "codex" else F.coalesce("own", stem(F.col("path")))
    return files.where(mine).select(F.lit(source).alias("source"), session.alias("session_id"), "path")


def _tail(value: Column) -> tuple[Column, Column]:
    """The complete lines of a text, and what stands after them."""
    done = F.regexp_extract(value, r"(?s)\A(.*\n)?", 1)
    return done, F.substr(value, F.length(done) + 1)


def warnings(texts: DataFrame) -> DataFrame:
    """(path, line_index) of malformed rows of whole files (path, value); an unfinished last line isn't one."""
    rows = texts.select("path", F.posexplode(F.split("value", "\n")).alias("line_index", "raw"), F.size(F.split("value", "\n")).alias("n"))
    return rows.where((F.col("line_index") < F.col("n") - 1) & ~is_blank(F.col("raw")) & F.try_parse_json("raw").isNull()).select("path", "line_index")


def cursors(texts: DataFrame) -> DataFrame:
    """(path, cursor) of whole files (path, value): ``line:N;bytes:M`` after the last line that can be taken: a last line
    without line feed counts if it is whole JSON or blank."""
    done, rest = _tail(F.col("value"))
    whole = (rest != "") & (is_blank(rest) | F.try_parse_json(rest).isNotNull())
    lines = F.size(F.split(done, "\n")) - 1 + F.when(whole, 1).otherwise(F.lit(0))
    size = F.octet_length(done) + F.when(whole, F.octet_length(rest)).otherwise(F.lit(0))
    return texts.select("path", F.concat(F.lit("line:"), lines, F.lit(";bytes:"), size).alias("cursor"))
