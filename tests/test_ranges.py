"""Files read in ranges give the rows that whole files give, whatever the borders."""

import json
import random

import pytest

from threadloom.functions.ordered import carried, counted, first_of_file, previous
from threadloom.sources import capture as C
from threadloom.sources import transcripts as P
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def home(tmp_path_factory):
    """Transcripts of all layouts; long ones, some with carriage returns, broken and blank lines, without a last line feed, one empty."""
    top, rng = tmp_path_factory.mktemp("home"), random.Random(2)

    def write(path, rows, end="\n", last=True):
        path = top / path
        path.parent.mkdir(parents=True, exist_ok=True)
        text = end.join(r if isinstance(r, str) else json.dumps(r) for r in rows)
        path.write_bytes((text + (end if last else "")).encode())

    word = lambda: "wörd" * rng.randint(1, 30)
    claude = [{"type": rng.choice(["user", "assistant", "summary"]), "sessionId": f"s{k // 40}", "timestamp": f"t{k}", "message": {"content": word()}} | ({"cwd": "/late"} if k in (70, 90) else {}) for k in range(200)]
    write(".claude/projects/p/a.jsonl", [*claude[:50], "{broken", "", " \t", *claude[50:]], "\r\n")
    write(".claude/projects/p/b.jsonl", claude[:3], last=False)
    write(".claude/projects/p/empty.jsonl", [], last=False)
    codex = []
    for k in range(300):
        codex.append({"type": "event_msg", "timestamp": f"t{k}", "payload": {"type": "user_message", "message": word()}})
        if k % 90 == 5:
            codex.append({"type": "session_meta", "payload": {"id": f"c{k}", "cwd": f"/c/{k}", "model_provider": rng.choice(["m1", None])}})
        codex.append({"type": "response_item", "timestamp": f"u{k}", "payload": {"role": "assistant", "content": [{"type": "output_text", "text": word()}]}})
    write(".codex/sessions/x.jsonl", codex, last=False)
    write(".cursor/projects/q/agent-transcripts/z/z.jsonl", [{"role": "user", "message": {"content": word()}} for _ in range(80)])
    grok = [{"timestamp": k, "params": {"update": {"sessionUpdate": rng.choice(["user_message_chunk"] + 5 * ["agent_message_chunk"]), "content": {"type": "text", "text": word()}} | ({"_meta": {"modelId": f"g{k}"}} if k % 37 == 0 else {})}} for k in range(250)]
    write(".grok/sessions/%2Fh/sid/updates.jsonl", grok)
    pi = [{"type": "session", "id": "pid", "cwd": "/pi"}]
    pi += [{"type": "message", "timestamp": f"t{k}", "message": {"role": "user", "content": word()}} if k % 50 else {"type": "model_change", "provider": "a", "modelId": f"m{k}"} for k in range(200)]
    write(".pi/agent/sessions/d/2024_pi.jsonl", pi)
    return str(top)


@pytest.fixture
def ranges(spark):
    """Ranges of about 8,000 bytes."""
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    spark.conf.set("spark.sql.files.minPartitionNum", "1")
    yield
    for name in ("maxPartitionBytes", "openCostInBytes", "minPartitionNum"):
        spark.conf.unset(f"spark.sql.files.{name}")


def rows(df):
    return sorted(map(repr, df.collect()))


def test_lines_are_numbered_over_ranges(spark, home, ranges):
    folders = [f"{home}/{f}" for f in (".claude", ".codex", ".cursor", ".grok", ".pi")]
    whole, ranged = P.scan_whole(spark, *folders), P.scan_ranges(spark, *folders, whole_bytes=0)
    assert ranged.select("path", "segment").distinct().count() > 15
    assert rows(ranged.drop("segment")) == rows(whole)
    # both readers share the files by size: each file is read once
    assert rows(P.scan(spark, *folders, whole_bytes=20_000)) == rows(whole)
    assert P.scan_whole(spark, *folders, whole_bytes=-1).count() == 0 and P.scan_ranges(spark, *folders).count() == 0
    few = P.scan_whole(spark, *folders, whole_bytes=20_000)
    assert 0 < few.select("path").distinct().count() < whole.select("path").distinct().count()


def test_messages_and_events_over_ranges(spark, home, ranges):
    assert rows(P.load_messages(spark, home, whole_bytes=0)) == rows(P.load_messages(spark, home))
    for source, folder in (("claude", ".claude"), ("codex", ".codex"), ("cursor", ".cursor")):
        whole = C.capture_files(spark, source, "p", f"{home}/{folder}")
        assert rows(C.capture_files(spark, source, "p", f"{home}/{folder}", whole_bytes=0)) == rows(whole)
        assert whole.where("parent_hash is not null").count() > 0


def test_values_over_segments(spark):
    """Segments without a value, of one row, and ids that tie don't matter."""
    rng = random.Random(3)
    found = [(f"f{k % 3}", k, k // 17 * 100, rng.choice([None, None, None, f"v{k}"]), f"h{k}", rng.random() < 0.2) for k in range(200)]
    df = spark.createDataFrame(found, "path string, line_index long, segment long, value string, hash string, hit boolean").repartition(5)

    def all_of(df):
        df = carried(df, {"last": F.col("value"), "again": F.upper("value")})
        df = counted(first_of_file(df, "first", F.col("value")), "hits", F.col("hit"))
        return rows(previous(df, "before", "hash", ("line_index",)).drop("segment"))

    assert all_of(df) == all_of(df.drop("segment"))


def test_large_files_are_not_opened_whole(spark, tmp_path):
    """A file beyond what a row can hold is left out of the listing."""
    with open(tmp_path / "big.jsonl", "wb") as f:
        f.truncate(3 << 30)
    (tmp_path / "small.jsonl").write_text('{"a": 1}\n')
    assert [r.raw for r in P.scan_whole(spark, str(tmp_path)).collect()] == ['{"a": 1}']
