"""Streams over several micro-batches: state that ends with its window, and lateness that is dropped and counted.

The stateful jobs keep one small row a key and set a timer on event time; when the watermark passes it, the row goes. What a
key forgets can't matter any more: an event after the timer would be taken with or without the row. Rows of a batch are
taken in order of time.
"""

from __future__ import annotations

import contextlib
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from ..functions import urls as ul
from ..sources.writers import folder

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Timed(StatefulProcessor):
    """One row of state a key, which goes when its timer fires. Times are microseconds in the state, milliseconds in timers."""

    state_type: T.StructType

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.value = handle.getValueState("value", self.state_type)

    def remember(self, row: tuple, until_us: int) -> None:
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(int(old[0]) if isinstance(old, tuple) else int(old))
        self.value.update(row)
        self.handle.registerTimer(until_us // 1000 + 1)

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.value.clear()
        return iter(())

    def close(self) -> None:
        pass


def _micros(times: pd.Series) -> list[int]:
    return pd.to_datetime(times).astype("datetime64[us]").astype("int64").tolist()


class Spaced(_Timed):
    """Keeps the time of the last kept view; the row goes once any further view would be kept."""

    state_type = T.StructType([T.StructField("last", T.LongType())])

    def __init__(self, window_us: int):
        self.window = window_us

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        last = self.value.get()[0] if self.value.exists() else None
        kept = []
        for at in sorted(t for f in rows for t in _micros(f["seen_at"])):
            if last is None or at - last >= self.window:
                last = at
                kept.append(at)
        if kept:
            self.remember((last,), last + self.window)
        yield pd.DataFrame({"key": pd.Series([key[0]] * len(kept), dtype=object), "seen_at": pd.to_datetime(pd.Series(kept, dtype="int64"), unit="us")})


class Rising(_Timed):
    """Keeps a run's worst rank and last reading; a pause of more than the gap begins a new run."""

    state_type = T.StructType([T.StructField("last", T.LongType()), T.StructField("worst", T.IntegerType())])

    def __init__(self, gap_us: int):
        self.gap = gap_us

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        last, worst = self.value.get() if self.value.exists() else (None, 0)
        out = []
        for at, rank in sorted((t, int(r)) for f in rows for t, r in zip(_micros(f["at"]), f["rank"], strict=True)):
            if last is not None and at - last > self.gap:
                worst = 0
            last = at if last is None else max(last, at)
            if rank > worst:
                worst = rank
                out.append((at, rank))
        if last is not None:
            self.remember((last, worst), last + self.gap)
        yield pd.DataFrame({"key": pd.Series([key[0]] * len(out), dtype=object), "at": pd.to_datetime(pd.Series([a for a, _ in out], dtype="int64"), unit="us"), "rank": pd.Series([r for _, r in out], dtype="int32")})


def spaced_views(log: DataFrame, *, minutes: int = 10, lateness: str = "0 seconds") -> DataFrame:
    """(key, seen_at): views at least ``minutes`` after the last kept one of their key, of a stream (key, seen_at)."""
    keyed = log.withWatermark("seen_at", lateness).groupBy("key")
    return keyed.transformWithStateInPandas(Spaced(minutes * 60_000_000), "key string, seen_at timestamp", "Append", "EventTime")


def rising_alerts(states: DataFrame, *, hours: int, lateness: str = "0 seconds") -> DataFrame:
    """(key, at, rank): readings of a stream (key, at, rank) whose rank is above all earlier ones of their run.

    A run ends with a pause of more than ``hours``.
    """
    keyed = states.withWatermark("at", lateness).groupBy("key")
    return keyed.transformWithStateInPandas(Rising(hours * 3_600_000_000), "key string, at timestamp, rank int", "Append", "EventTime")


@contextlib.contextmanager
def timers(spark: SparkSession) -> Iterator[None]:
    """State with timers is kept in RocksDB; the session's own choice is put back."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)


def in_batches(rows: DataFrame, batch: str, name: str) -> tuple[DataFrame, int]:
    """``rows`` as a stream of one micro-batch for each value of ``batch`` (few whole numbers), in their order; and how many there are."""
    spark = rows.sparkSession
    path = folder(spark, name)
    numbers = sorted(r[0] for r in rows.select(batch).distinct().collect())
    if not numbers:
        rows.drop(batch).limit(0).write.parquet(path)
    for k in numbers:
        rows.filter(F.col(batch) == k).drop(batch).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(rows.drop(batch).schema).option("maxFilesPerTrigger", 1).parquet(path), len(numbers)


def finished(stream: DataFrame, write=None) -> tuple[DataFrame | None, list[dict]]:
    """Run a stream to the end of its input: what it gave (None with a ``write`` of its own) and the progress of its batches."""
    spark = stream.sparkSession
    out, state = folder(spark, "stream-out"), folder(spark, "stream-state")
    writer = stream.writeStream.option("checkpointLocation", state).outputMode("append").trigger(availableNow=True)
    writer = writer.foreachBatch(write) if write else writer.format("parquet").option("path", out)
    run = writer.start()
    run.awaitTermination()
    progress = [json.loads(p.json) for p in run.recentProgress]
    return (None if write else spark.read.schema(stream.schema).parquet(out)), progress


def late_rows(progress: list[dict]) -> int:
    """Rows that came after the watermark had passed them."""
    return sum(s.get("numRowsDroppedByWatermark", 0) for p in progress for s in p.get("stateOperators", []))


def state_rows(progress: list[dict]) -> list[int]:
    """Rows of state after each batch."""
    return [sum(s.get("numRowsTotal", 0) for s in p.get("stateOperators", [])) for p in progress]


def feed_run(items: DataFrame, seen: str, *, run: int, url: str = "url", at: str = "published", lateness: str = "36 hours") -> list[dict]:
    """One run over arriving feed entries: those with a new canonical URL are added to the table in the folder ``seen``.

    Entries that come later than the watermark are dropped. Within the watermark, keys are state; between batches and
    runs the table itself says what is known. A batch writes a folder of its own, so a batch that runs again replaces what it
    wrote and nothing is added twice.
    """
    fresh = items.withColumn("canonical", ul.canonical(F.col(url))).withWatermark(at, lateness).dropDuplicatesWithinWatermark(["canonical"])

    def add(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        known = known_feed(spark, seen, batch.schema).filter(~((F.col("run") == run) & (F.col("batch") == number)))
        batch.join(known.select("canonical"), "canonical", "left_anti").select(*batch.columns).write.mode("overwrite").parquet(f"{seen}/run={run}/batch={number}")

    return finished(fresh, add)[1]


def known_feed(spark: SparkSession, seen: str, schema: T.StructType) -> DataFrame:
    """The entries of all runs so far, with run and batch."""
    from pyspark.sql.utils import AnalysisException

    full = T.StructType([*schema.fields, T.StructField("run", T.IntegerType()), T.StructField("batch", T.IntegerType())])
    try:
        return spark.read.schema(full).parquet(seen)
    except AnalysisException:
        return spark.createDataFrame([], full)
