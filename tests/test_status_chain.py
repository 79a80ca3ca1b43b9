"""Out-of-order, repeated and late events end in the right state, streamed and not."""

import random
from datetime import datetime, timedelta

from concordat.operators.registry import Registry
from concordat.streaming import status_chain as sc

START = datetime(2026, 1, 1)
# Reports of each work, and the status they must end in with two retries.
WORKS = {
    "done": (["PARSED", "CHUNKED", "INDEXED"], [], "INDEXED"),
    "gap": (["PARSED", "INDEXED"], [], "PARSED"),
    "late": (["PARSED"], [("PARSED", 1), ("PARSED", 2), ("PARSED", 3)], "PARSED"),
    "retried": ([], [("PARSED", 1), ("PARSED", 2)], "PENDING"),
    "failed": (["PARSED"], [("CHUNKED", 1), ("CHUNKED", 2), ("CHUNKED", 3), ("CHUNKED", 4)], "ERROR"),
    "elsewhere": (["PARSED", "CHUNKED"], [("PARSED", 1), ("PARSED", 2), ("PARSED", 3)], "CHUNKED"),
    "unknown": (["SHIPPED"], [], "PENDING"),
}


def events(seed):
    rows = []
    for work, (done, failed, _) in WORKS.items():
        rows += [(work, s, 9, True, None) for s in done] + [(work, s, a, False, f"{s} {a}") for s, a in failed]
    rows = [(*r, START + timedelta(minutes=i)) for i, r in enumerate(rows)]
    rows += random.Random(seed).sample(rows, len(rows) // 2)
    random.Random(seed).shuffle(rows)
    return rows


def test_every_order_ends_in_the_same_state(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    for seed in range(2):
        out = sc.statuses(spark.createDataFrame(events(seed), sc.EVENTS)).collect()
        assert {r["work_id"]: r["status"] for r in out} == {w: s for w, (_, _, s) in WORKS.items()}
        assert {r["work_id"]: r["error_message"] for r in out if r["error_message"]} == {"failed": "CHUNKED 4"}
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_stream_in_many_batches(spark, tmp_path):
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    registry = Registry(spark, str(tmp_path / "registry"), buckets=2)
    registry.init()
    rows = events(7)
    source = tmp_path / "events"
    for i in range(0, len(rows), 12):
        spark.createDataFrame(rows[i:i + 12], sc.EVENTS).coalesce(1).write.mode("append").json(str(source))
    stream = spark.readStream.schema(sc.EVENTS).option("maxFilesPerTrigger", 1).json(str(source))
    sc.follow(stream, registry, str(tmp_path / "checkpoint")).awaitTermination()
    assert {r["work_id"]: r["status"] for r in registry.documents().collect()} == {w: s for w, (_, _, s) in WORKS.items()}
    # State is kept: one more event moves a work on in a new run of the stream.
    spark.createDataFrame([("gap", "CHUNKED", 1, True, None, START)], sc.EVENTS).coalesce(1).write.mode("append").json(str(source))
    sc.follow(stream, registry, str(tmp_path / "checkpoint")).awaitTermination()
    assert {r["status"] for r in registry.by_status("INDEXED").collect() if r["work_id"] == "gap"} == {"INDEXED"}
    spark.conf.set("spark.sql.shuffle.partitions", "4")
