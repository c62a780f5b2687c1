"""Job messages as streams: intake, de-duplication, folds, completion, windows, dead letters."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quire.operators.deliveries import message_key
from quire.sources.sinks import dead_letters

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def poll_files(spark: SparkSession, path: str, schema: str, fmt: str = "json", files_per_batch: int = 100) -> DataFrame:
    """New files of a folder as a stream; the checkpoint knows which were read."""
    return spark.readStream.schema(schema).format(fmt).option("maxFilesPerTrigger", files_per_batch).load(path)


def first_deliveries(stream: DataFrame, keys: list[str], event_time: str, late: str = "2 days") -> DataFrame:
    """The first delivery of each message; state of a message is dropped ``late`` after it.

    Messages without identifier pass unchanged only if all keys are given; rows
    with a null key are compared by it like any other value.
    """
    keyed = stream.withColumns({f"_key_{k}": message_key(k) for k in keys}).withWatermark(event_time, late)
    return keyed.dropDuplicatesWithinWatermark([f"_key_{k}" for k in keys]).drop(*(f"_key_{k}" for k in keys))


def latest_states(stream: DataFrame, key: str, time: str, columns: list[str]) -> DataFrame:
    """The last event by key; run in update mode (the state is one row a key)."""
    last = F.max(F.struct(time, *[c for c in columns if c != time])).alias("l")
    return stream.groupBy(key).agg(last, F.count(F.lit(1)).alias("events")).select(key, *(F.col(f"l.{c}").alias(c) for c in dict.fromkeys([time, *columns])), "events")


def windowed_counts(stream: DataFrame, time: str, by: list[str], window: str = "5 minutes", late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """Events by window and ``by``; windows close ``late`` after the newest event."""
    w = F.window(time, window, slide) if slide else F.window(time, window)
    return stream.withWatermark(time, late).groupBy(w.alias("w"), *by).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("window_start"), *by, "n")


def rate_stream(stream: DataFrame, time: str, good: Column, bad: Column, window: str = "5 minutes", late: str = "10 minutes", least: float = 0.995) -> DataFrame:
    """Good and bad events by window, and whether the share of good ones is too small."""
    out = stream.withWatermark(time, late).groupBy(F.window(time, window).alias("w")).agg(F.count_if(good).alias("good"), F.count_if(bad).alias("bad"))
    share = F.when(F.col("good") + F.col("bad") > 0, F.col("good") / (F.col("good") + F.col("bad")))
    return out.select(F.col("w.start").alias("window_start"), "good", "bad", F.coalesce(share < least, F.lit(False)).alias("breach"))


def sessions(stream: DataFrame, key: str, time: str, gap: str = "15 minutes", late: str = "30 minutes") -> DataFrame:
    """Runs of a key's events without a gap: key, session_start, session_end, n."""
    out = stream.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n"))
    return out.select(key, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


class _Completion(StatefulProcessor):
    """Keeps a job's parts until all announced ones are there."""

    def __init__(self, wait_ms: int):
        self.wait_ms = wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.parts = handle.getMapState("parts", "part int", "text string")
        self.facts = handle.getValueState("facts", "announced int, emitted int, timer bigint")

    def _emit(self, key: tuple, reason: str) -> pd.DataFrame:
        found = sorted((int(k[0]), v[0]) for k, v in self.parts.iterator())
        return pd.DataFrame({"job_id": [key[0]], "received": [len(found)], "merged": ["\n".join(t for _, t in found if t and t.strip())], "reason": [reason]})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        facts = self.facts.get() if self.facts.exists() else (0, 0, 0)
        announced, emitted, timer = (int(x or 0) for x in facts)
        for batch in rows:
            for part, total, text in zip(batch["section_index"], batch["total_sections"], batch["summary_text"]):
                if not pd.isna(part):
                    self.parts.updateValue((int(part),), (None if text is None else str(text),))
                if not pd.isna(total):
                    announced = max(announced, int(total))
        n = sum(1 for _ in self.parts.keys())
        if announced and n >= announced and n > emitted:
            if timer:
                self.handle.deleteTimer(timer)
            self.facts.update((announced, n, 0))
            yield self._emit(key, "complete" if not emitted else "amended")
            return
        if not timer and n > emitted:
            timer = timerValues.getCurrentProcessingTimeInMs() + self.wait_ms
            self.handle.registerTimer(timer)
        self.facts.update((announced, emitted, timer))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        announced, emitted, _ = (int(x or 0) for x in self.facts.get())
        n = sum(1 for _ in self.parts.keys())
        self.facts.update((announced, n, 0))
        if n > emitted:
            yield self._emit(key, "timeout")

    def close(self) -> None:
        pass


def completed_jobs(stream: DataFrame, wait: int = 600) -> DataFrame:
    """One row (job_id, received, merged, reason) whenever all announced parts of a job are there.

    stream: job_id, section_index, total_sections, summary_text.  Parts may come
    in any order and more than once; a job that waits for more than ``wait``
    seconds gives what it has (reason ``timeout``), and later parts give it once
    more (``complete`` or ``amended``).  Needs the RocksDB state store
    (:data:`ROCKSDB`).  A job's state is its parts: one key on one task, which is
    bounded by the size of a job, not of the stream.
    """
    rows = stream.select("job_id", F.col("section_index").cast("int"), F.col("total_sections").cast("int"), "summary_text").filter("job_id is not null")
    return rows.groupBy("job_id").transformWithStateInPandas(
        statefulProcessor=_Completion(wait * 1000), outputStructType="job_id string, received int, merged string, reason string", outputMode="Append", timeMode="ProcessingTime"
    )


def split_batches(good: Callable[[DataFrame, int], None], bad: Callable[[DataFrame, int], None], is_bad: Column, reason: Column, value: str, stage: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that sends good rows one way and masked dead letters the other."""

    def run(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            good(batch.filter(~F.coalesce(is_bad, F.lit(False))), batch_id)
            rejected = batch.filter(F.coalesce(is_bad, F.lit(False))).withColumn("_reason", reason)
            bad(dead_letters(rejected, value, "_reason", stage), batch_id)
        finally:
            batch.unpersist()

    return run
