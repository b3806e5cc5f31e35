"""Streams that count once: records of an inbox, and the last outcome of a reference."""

import json
import os

from vellum.sources import snapshots
from vellum.streaming import events, inbox


def put(path, name, *rows):
    os.makedirs(path, exist_ok=True)
    with open(f"{path}/.{name}", "w") as f:
        f.write("\n".join(json.dumps(r) for r in rows))
    os.replace(f"{path}/.{name}", f"{path}/{name}")
    os.utime(f"{path}/{name}", (1_700_000_000 + int(name[0]), 1_700_000_000 + int(name[0])))


def seen(spark, root):
    return {r["key"]: r["status"] for r in snapshots.read(spark, root).collect()}


def test_a_batch_that_runs_again_changes_nothing(spark, tmp_path):
    folder, root, check = (str(tmp_path / n) for n in ("in", "store", "check"))
    run = lambda: inbox.committed(inbox.inbox_stream(spark, folder), root, check).awaitTermination()
    put(folder, "1.json", {"key": "a", "status": "draft"}, {"key": "b", "status": "draft"}, {"key": None, "status": "lost"})
    put(folder, "2.json", {"key": "a", "status": "clean"})
    run()
    assert seen(spark, root) == {"a": "clean", "b": "draft"}
    put(folder, "3.json", {"key": "b", "status": "clean"})
    run()
    last = max(os.listdir(f"{check}/commits"), key=lambda n: int(n) if n.isdigit() else -1)
    os.remove(f"{check}/commits/.{last}.crc")
    os.remove(f"{check}/commits/{last}")  # as if the driver had died after the store's commit and before the stream's
    version = snapshots.commit(spark, root, snapshots.read(spark, root).where("key = 'b'").selectExpr("key", "'later' as status", *(c for c in snapshots.RECORD_FIELDS if c not in ("key", "status"))))
    run()
    assert snapshots.snapshot(spark, root).version == version and seen(spark, root) == {"a": "clean", "b": "later"}
    snapshots.compact(spark, root)
    put(folder, "4.json", {"key": "c", "status": "draft"})
    run()
    assert seen(spark, root) == {"a": "clean", "b": "later", "c": "draft"} and dict(snapshots.snapshot(spark, root).batches) == {"inbox": 2}


def test_last_outcome_by_reference(spark, tmp_path):
    folder = str(tmp_path / "log")
    put(folder, "1.json", {"when": "2024-01-02", "command": "fetch", "ref": "x", "outcome": "ok"}, {"when": "2024-01-01", "command": "fetch", "ref": "y", "outcome": "error"})
    put(folder, "2.json", {"when": "2024-01-01", "command": "fetch", "ref": "x", "outcome": "error"}, {"when": "2024-01-03", "command": "ingest", "ref": "y", "outcome": "ok"})
    stream = spark.readStream.schema(events.EVENT).option("maxFilesPerTrigger", 1).json(folder)
    q = events.last_outcomes(stream).writeStream.format("memory").queryName("last").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(map(tuple, spark.table("last").collect())) == [("x", "2024-01-02", "fetch", "ok", 2), ("y", "2024-01-03", "ingest", "ok", 2)]
