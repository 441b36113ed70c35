import pytest
from pyspark.sql import functions as F

from threadloom.plans.streaming import chain, message_events
from threadloom.streaming import tail


def read(reader, start):
    end = reader.latestOffset()
    return [r for part in reader.partitions(start, end) for r in reader.read(part)], end


def test_partial_tail_rotation_and_replay(tmp_path):
    file = tmp_path / "a.jsonl"
    reader = tail.TailReader({"path": str(tmp_path)})
    file.write_bytes(b"one\ntwo\r\nthr")
    rows, at = read(reader, reader.initialOffset())
    assert [r[1:3] for r in rows] == [(0, "one"), (4, "two")]
    assert read(reader, at) == ([], at)
    file.write_bytes(b"one\ntwo\r\nthree\n")
    rows, after = read(reader, at)
    assert [r[1:3] for r in rows] == [(9, "three")]
    # a reader that knows nothing reads a batch again from its two offsets
    again = tail.TailReader({"path": str(tmp_path)})
    assert [r for part in again.partitions(at, after) for r in again.read(part)] == rows
    file.write_bytes(b"new\n")
    assert [r[2] for r in read(reader, after)[0]] == ["new"]
    file.write_bytes(b"ONE\ntwo\r\nthree\n")
    assert [r[2] for r in read(reader, after)[0]] == ["ONE", "two", "three"]


def test_tasks_share_small_files_and_long_last_lines_wait(tmp_path):
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "a.jsonl").write_text("1\n2\n")
    (tmp_path / "b.jsonl").write_bytes(b"x\n" + b"y" * (3 * tail.CHUNK))
    reader = tail.TailReader({"path": str(tmp_path)})
    parts = reader.partitions(reader.initialOffset(), reader.latestOffset())
    assert [[(a, b) for _, a, b in p.parts] for p in parts] == [[(0, 2), (0, 4)]]
    reader = tail.TailReader({"path": str(tmp_path), "taskBytes": "1"})
    assert [[(a, b) for _, a, b in p.parts] for p in reader.partitions(reader.initialOffset(), reader.latestOffset())] == [[(0, 2)], [(0, 4)]]


def rows_of(spark, path, messages, start=0):
    import json

    out, at = [], start
    for m in messages:
        out.append((path, at, json.dumps({"source": "s", "session_id": "c", "role": "user", "content": m, "timestamp": "t"})))
        at += len(out[-1][2]) + 1
    return spark.createDataFrame(out, "path string, offset long, raw string"), at


def ids_of(spark, folder):
    return sorted(r.id for r in spark.read.parquet(f"{folder}/table").collect())


def test_ids_do_not_depend_on_batch_borders(spark, tmp_path):
    said = [f"m{i}" for i in range(6)]
    every, _ = rows_of(spark, "f", said)
    kept = []
    for name, cuts in (("one", [6]), ("two", [3, 6]), ("three", [1, 4, 6])):
        home, first = f"{tmp_path}/{name}", 0
        for number, cut in enumerate(cuts):
            ordered = every.orderBy("offset").collect()
            batch = spark.createDataFrame(ordered[first:cut], every.schema)
            for _ in range(2):  # each batch comes twice, as after a failure
                tail.store_batch(batch, number, message_events, chain, f"{home}/table", f"{home}/cursors")
            first = cut
        kept.append(ids_of(spark, home))
    assert kept[0] == kept[1] == kept[2] and len(set(kept[0])) == 6
    # the same lines from another stream, and from a file that began again, add nothing; new ones do
    home = f"{tmp_path}/one"
    tail.store_batch(every, 0, message_events, chain, f"{home}/table", f"{home}/cursors", "other")
    tail.store_batch(every, 1, message_events, chain, f"{home}/table", f"{home}/cursors")
    assert ids_of(spark, home) == kept[0]
    more, _ = rows_of(spark, "f", [*said, "m6"])
    tail.store_batch(more, 2, message_events, chain, f"{home}/table", f"{home}/cursors")
    assert len(ids_of(spark, home)) == 7


def test_stream_ingests_each_event_once(spark):
    from threadloom.plans import streaming
    from threadloom.sources import views as V

    out = streaming.tail_ingest(spark, "/root/testdata/sf0.001")
    want = V.messages(spark, "/root/testdata/sf0.001").count()
    assert out.count() == want and out.where("parent_hash is null").count() <= 2 * V.messages(spark, "/root/testdata/sf0.001").select("session_id").distinct().count()


def test_offsets_of_tail_ingest_name_no_files(spark, tmp_path, monkeypatch):
    from threadloom.plans import streaming

    monkeypatch.setattr(streaming, "fresh", lambda spark, name: f"file://{tmp_path}")
    streaming.tail_ingest(spark, "/root/testdata/sf0.001")
    said = [p.read_text() for name in ("first", "second") for p in (tmp_path / f"check-{name}" / "offsets").iterdir() if p.name.isdigit()]
    assert len(said) == 3 and all(len(s) < 2000 and ".txt" not in s for s in said)


def test_shards_settle_an_epoch_once(tmp_path):
    home, options = tmp_path / "in", {"path": str(tmp_path / "in"), "manifest": str(tmp_path / "epochs"), "shards": "4"}
    reader = tail.ShardReader(options)
    assert reader.latestOffset() == reader.initialOffset() == {"epoch": 0}
    (home / "s").mkdir(parents=True)
    for i in range(9):
        (home / f"{i}.jsonl").write_bytes(b"one %d\nhalf" % i)
    (home / "s" / "x.jsonl").write_bytes(b"x\n")
    (home / "other").write_bytes(b"no\n")

    def rows(reader, start, end):
        return sorted((r[0].removeprefix(f"{home}/"), *r[1:3]) for part in reader.partitions(start, end) for r in reader.read(part))

    start, at = reader.initialOffset(), reader.latestOffset()
    first = rows(reader, start, at)
    assert first == sorted([*((f"{i}.jsonl", 0, f"one {i}") for i in range(9)), ("s/x.jsonl", 0, "x")])
    assert len(list((tmp_path / "epochs" / "1").iterdir())) == 4 and reader.latestOffset() == at
    # what comes later belongs to the next epoch, also if the first is read again by a reader that knows nothing
    with (home / "3.jsonl").open("ab") as f:
        f.write(b" way\n")
    (home / "new.jsonl").write_bytes(b"n\n")
    again = tail.ShardReader(options)
    assert rows(again, start, at) == first
    after = again.latestOffset()
    more = [("3.jsonl", 6, "half way"), ("new.jsonl", 0, "n")]
    assert rows(again, at, after) == rows(reader, at, after) == more
    # two epochs at once, as without a checkpoint: each file from its begin to where the second takes it
    assert rows(again, start, after) == sorted(first + more)
    # files that began again or vanished, one that only got another time
    (home / "s" / "x.jsonl").write_bytes(b"X\ny\n")
    (home / "5.jsonl").unlink()
    (home / "6.jsonl").touch()
    last = again.latestOffset()
    assert rows(again, after, last) == [("s/x.jsonl", 0, "X"), ("s/x.jsonl", 2, "y")]
    again.KEPT = 1
    again.commit(last)
    assert sorted(p.name for p in (tmp_path / "epochs").iterdir()) == ["2", "2.json", "3", "3.json"]
    assert rows(tail.ShardReader(options), after, last) == [("s/x.jsonl", 0, "X"), ("s/x.jsonl", 2, "y")]
    with pytest.raises(ValueError):
        tail.ShardReader({**options, "shards": "5"}).latestOffset()


def test_reconcile(spark):
    old = spark.createDataFrame([("a",)], "id string")
    new = spark.createDataFrame([("a",), ("b",), ("b",)], "id string")
    assert tuple(tail.reconcile(old, new, old.where(F.lit(False))).first()) == (3, 2, 1, 0)


def drain(reader, at):
    """All epochs from ``at`` on: (rows of each, last offset)."""
    out = []
    while (end := reader.latestOffset()) != at:
        out.append([r[1:] for part in reader.partitions(at, end) for r in reader.read(part)])
        at = end
    return out, at


def test_epochs_are_bounded_and_survive_restarts(tmp_path):
    home, log = tmp_path / "in", tmp_path / "epochs"
    home.mkdir()
    options = {"path": str(home), "manifest": str(log), "fileBytes": "10", "batchBytes": "16"}
    a, b = home / "a.jsonl", home / "b.jsonl"
    a.write_bytes(b"".join(b"line%d\n" % i for i in range(4)) + b"x" * 40 + b"\nend\nhalf")
    b.write_bytes(b"one\ntwo\n")
    reader = tail.EpochReader(options)
    found, at = drain(reader, reader.initialOffset())
    # two files share the first epoch; the line of 40 bytes, longer than the bound, comes whole and in an epoch of its own
    assert found[0] == [(0, "line0", 1), (0, "one", 1), (4, "two", 1)] and [(24, "x" * 40, 1)] in found[:-1] and found[-1] == [(65, "end", 1)]
    assert sorted(r[1] for rows in found for r in rows) == sorted(["line0", "line1", "line2", "line3", "x" * 40, "end", "one", "two"])
    assert reader.latestOffset() == at == {"epoch": len(found)}
    # the same batch again from its two epochs, by a reader that knows nothing
    again = tail.EpochReader(options)
    assert [r[1:] for part in again.partitions({"epoch": 0}, {"epoch": 1}) for r in again.read(part)] == found[0]
    # a file that began again is read from 0, a vanished one is forgotten, one that grew goes on
    b.write_bytes(b"ONE\n")
    assert drain(again, at)[0] == [[(0, "ONE", at["epoch"] + 1)]]
    at = again.latestOffset()
    b.unlink()
    with a.open("ab") as f:
        f.write(b"!\n")
    found, at = drain(again, at)
    assert found == [[(69, "half!", 1)]] and list(again.files(at["epoch"])) == [str(a)]
    b.write_bytes(b"ONE\n")
    assert drain(again, at)[0] == [[(0, "ONE", at["epoch"] + 1)]]
    again.KEPT = 1
    again.commit(again.latestOffset())
    assert len(list(log.glob("*.json"))) == 2
    # what isn't a folder yet, and one without files
    assert tail.EpochReader({"path": str(tmp_path / "none"), "manifest": str(tmp_path / "m")}).latestOffset() == {"epoch": 0}


def test_files_that_waited_come_first(tmp_path):
    home = tmp_path / "in"
    home.mkdir()
    for name in "abc":
        (home / f"{name}.jsonl").write_bytes(b"12345678\n" * 2)
    reader = tail.EpochReader({"path": str(home), "manifest": str(tmp_path / "m"), "fileBytes": "9", "batchBytes": "9"})
    at, order = reader.initialOffset(), []
    for _ in range(6):
        end = reader.latestOffset()
        order += [p[0][-7] for part in reader.partitions(at, end) for p in part.parts]
        at = end
    assert order == list("abcabc") and reader.latestOffset() == at


def test_keyed_chain_restarts_and_replays(spark, tmp_path):
    import json

    from threadloom.plans.streaming import keyed_events, with_id

    tail.register(spark)

    def lines(name, said):
        return "".join(json.dumps({"source": "s", "session_id": name, "role": "user", "content": m, "timestamp": "t"}) + "\n" for m in said)

    def run(home, checkpoint, name="tail"):
        source = spark.readStream.format("jsonl_tail").option("path", f"{home}/in").option("manifest", f"{home}/epochs-{name}").option("fileBytes", "200").load()
        query = tail.ingest_keyed(source, keyed_events, with_id, f"{home}/table", checkpoint, name)
        try:
            query.processAllAvailable()
        finally:
            query.stop()

    home = tmp_path / "h"
    (home / "in").mkdir(parents=True)
    said = ["a", "b", "", None, "e", "f"]
    file = home / "in" / "x.jsonl"
    file.write_text("no message\n" + lines("x", said[:4]) + lines("x", said[4:])[:20])
    (home / "in" / "y.jsonl").write_text(lines("y", ["same", "same"]))
    (home / "in" / "z.jsonl").write_text("nothing here\n")
    run(home, f"{home}/check")
    file.write_text("no message\n" + lines("x", said))
    run(home, f"{home}/check")  # a restart in the middle of a file
    rows = spark.read.parquet(f"{home}/table").collect()
    kept = sorted(r.id for r in rows)
    assert len(set(kept)) == len(kept) == 8
    # the same ids as by the table of cursors, whole files in one batch
    flat = [r for f in sorted((home / "in").iterdir()) for r in tail.lines_between(f, 0, tail.last_line_end(f))]
    batch = spark.createDataFrame(flat, tail.SCHEMA)
    tail.store_batch(batch, 0, message_events, chain, f"{home}/other/table", f"{home}/other/cursors")
    assert ids_of(spark, f"{home}/other") == kept
    # the last batch comes again, as after a failure before its commit
    commits = [p for p in (home / "check" / "commits").iterdir() if p.name.isdigit()]
    last = max(commits, key=lambda p: int(p.name))
    last.unlink()
    last.with_name(f".{last.name}.crc").unlink(missing_ok=True)
    run(home, f"{home}/check")
    assert ids_of(spark, home) == kept
    # a new stream over the same table, and a file that began again with its first lines only, add nothing
    run(home, f"{home}/check-2", "second")
    file.write_text("no message\n" + lines("x", said[:2]))
    run(home, f"{home}/check")
    assert ids_of(spark, home) == kept
    # a file that began again with a first range that holds no event: the chain starts anew, behind it
    file.write_text("no message at all\n" * 20 + lines("x", ["new"]))
    run(home, f"{home}/check")
    new = [r for r in spark.read.parquet(f"{home}/table").collect() if r.id not in kept]
    assert [(r.content_text, r.parent_hash) for r in new] == [("new", None)]
