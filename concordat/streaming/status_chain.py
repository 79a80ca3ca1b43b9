"""The status machine of documents as keyed state: PENDING -> PARSED -> CHUNKED -> INDEXED, or ERROR.

Workers report what happened to a work as events, one for each attempt at a step. They come late, twice and in any
order. State for each work is what was reported - which steps succeeded, which attempts
failed - so the same events in any order end in the same status: the last step that was
reached without a gap; or ERROR once the step after it has failed more often than it may
be retried. A success that comes after the failures clears them. Events that are all there (not streamed)
need no state: the same statuses are sums over them.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from concordat.operators.registry import STATUSES, Registry

EVENTS = "work_id string, step string, attempt int, ok boolean, error_message string, at timestamp"
OUT = "work_id string, status string, error_message string, failures int, updated_at timestamp"
STEPS = STATUSES[1:4]
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def status_of(done: set[str], failed: dict[tuple[str, int], str], retries: int) -> tuple[str, str | None, int]:
    """(status, error, failures of the next step) of a work with these finished steps and failed attempts."""
    reached = 0
    while reached < len(STEPS) and STEPS[reached] in done:
        reached += 1
    if reached == len(STEPS):
        return STEPS[-1], None, 0
    tries = sorted(a for s, a in failed if s == STEPS[reached])
    if len(tries) > retries:
        return "ERROR", failed[STEPS[reached], tries[-1]], len(tries)
    return STATUSES[reached], None, len(tries)


class Chain(StatefulProcessor):
    """Keeps the steps and failed attempts of a work; at most (retries + 1) attempts of each step are remembered."""

    def __init__(self, retries: int):
        self.retries = retries

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.done = handle.getMapState("done", "step string", "at timestamp")
        self.failed = handle.getMapState("failed", "step string, attempt int", "error_message string")
        self.time = handle.getValueState("time", "at timestamp")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        done = {k[0] for k in self.done.keys()}
        failed = {tuple(k): v[0] for k, v in self.failed.iterator()}
        latest = self.time.get()[0] if self.time.exists() else None
        for frame in rows:
            for event in frame.itertuples(index=False):
                latest = event.at if latest is None or event.at > latest else latest
                if event.step not in STEPS:
                    continue
                if event.ok:
                    if event.step not in done:
                        done.add(event.step)
                        self.done.updateValue((event.step,), (event.at,))
                    continue
                attempt = (event.step, int(event.attempt))
                known = sorted(a for s, a in failed if s == event.step)
                if attempt not in failed and (len(known) <= self.retries or attempt[1] > known[-1]):
                    if len(known) > self.retries:  # the latest attempts say why
                        self.failed.removeKey((event.step, known[0]))
                        del failed[event.step, known[0]]
                    failed[attempt] = event.error_message
                    self.failed.updateValue(attempt, (event.error_message,))
        self.time.update((latest,))
        status, error, failures = status_of(done, failed, self.retries)
        yield pd.DataFrame({"work_id": [key[0]], "status": [status], "error_message": [error], "failures": [failures], "updated_at": [latest]})

    def close(self) -> None:
        pass


def _settled(events: DataFrame, retries: int) -> DataFrame:
    """The statuses that a ``Chain`` ends in, from all events at once.

    Reports of one attempt are put together first, so neither a report that comes often nor a work with many
    attempts meets in one task before it is summed up.
    """
    ok = F.coalesce("ok", F.lit(False))
    tried = events.groupBy("work_id", "step", "attempt").agg(
        F.max(ok).alias("done"), F.max(~ok).alias("failed"), F.min(F.when(~ok, F.col("error_message"))).alias("error"), F.max("at").alias("at"))
    sums = [F.max("at").alias("updated_at")]
    for i, step in enumerate(STEPS):
        here, lost = F.col("step") == step, F.when((F.col("step") == step) & F.col("failed"), F.col("attempt"))
        sums += [F.coalesce(F.max(here & F.col("done")), F.lit(False)).alias(f"done{i}"), F.least(F.count(lost), F.lit(retries + 1)).cast("int").alias(f"n{i}"),
                 F.max_by("error", lost).alias(f"error{i}")]
    works = tried.groupBy("work_id").agg(*sums)
    out = F.struct(F.lit(STEPS[-1]).alias("status"), F.lit(None).cast("string").alias("error_message"), F.lit(0).alias("failures"))
    for i in reversed(range(len(STEPS))):
        n = F.col(f"n{i}")
        open_ = F.struct(F.when(n > retries, "ERROR").otherwise(STATUSES[i]).alias("status"), F.when(n > retries, F.col(f"error{i}")).alias("error_message"), n.alias("failures"))
        out = F.when(~F.col(f"done{i}"), open_).otherwise(out)
    return works.select("work_id", out.alias("s"), "updated_at").select("work_id", "s.status", "s.error_message", "s.failures", "updated_at")


def statuses(events: DataFrame, retries: int = 2) -> DataFrame:
    """The status of every work that ``events`` (streamed or not) tell of; a stream gives a row for each change of its state."""
    events = events.where("work_id is not null and at is not null")
    if not events.isStreaming:
        return _settled(events, retries)
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    return events.groupBy("work_id").transformWithStateInPandas(
        Chain(retries), OUT, outputMode="Update", timeMode="None")


def follow(events: DataFrame, registry: Registry, checkpoint: str, *, retries: int = 2, available_now: bool = True) -> StreamingQuery:
    """Keep the registry's statuses at what the streamed events say. A repeated batch writes the same statuses again."""
    def apply(batch: DataFrame, _: int) -> None:
        registry.set_status(batch.select("work_id", "status", "error_message", "updated_at"))

    writer = statuses(events, retries).writeStream.outputMode("update").foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
