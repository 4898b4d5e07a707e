"""Streaming forms of the append-only logs."""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from reelspark.operators import statelog


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PROGRESS = "state string, attempt bigint, awaited bigint, timer bigint"
_REQUEST = "action string, target string, technical_qa_passed boolean"


def read_log(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int = 64) -> DataFrame:
    """Stream of table files. Verdicts do not depend on the files per trigger; they bound a batch's size."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


class Verdicts(StatefulProcessor):
    """Judges the requests of one project in order of seq, whatever order they arrive in.

    State is the project's workflow state, its attempt, the seq awaited next, and the requests that came
    before their turn, each an entry of its own. A request is judged once all earlier ones are. Without
    patience a gap stays open until it closes. With it, when a gap stays open for `patience_ms` of processing
    time, the judge goes on with the first request that waits. What arrives for a seq that has been passed is
    rejected as "late".
    """

    def __init__(self, patience_ms: int | None):
        self.patience_ms = patience_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.progress = handle.getValueState("progress", _PROGRESS)
        self.waiting = handle.getMapState("waiting", "seq bigint", _REQUEST)

    def _load(self) -> list:
        return list(self.progress.get()) if self.progress.exists() else [None, 0, 0, 0]

    def _judge(self, project: int, now: list, seq: int, request: tuple) -> tuple:
        reason, now[0], change = statelog.judge(now[0], request[0], request[1], bool(request[2]))
        now[1] = now[1] + 1 if change == "next" else 1 if change == "reset" else now[1]
        now[2] = seq + 1
        return project, seq, reason is None, reason, now[0], now[1]

    def _drain(self, project: int, now: list) -> Iterator[tuple]:
        while (request := self.waiting.getValue((now[2],))) is not None:
            seq = now[2]
            yield self._judge(project, now, seq, tuple(request))
            self.waiting.removeKey((seq,))

    def _save(self, now: list, clock: int) -> None:
        if self.patience_ms is None:
            self.progress.update(tuple(now))
            return
        if now[3]:
            self.handle.deleteTimer(now[3])
        now[3] = 0
        if next(iter(self.waiting.keys()), None) is not None:
            now[3] = clock + self.patience_ms
            self.handle.registerTimer(now[3])
        self.progress.update(tuple(now))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        project, now = int(key[0]), self._load()
        for batch in rows:
            out = []
            clean = batch.sort_values("seq").astype(object)
            for row in clean.where(clean.notna(), None).itertuples(index=False):
                seq, request = int(row.seq), (row.action, row.target, row.technical_qa_passed)
                if seq < now[2] or (seq > now[2] and self.waiting.containsKey((seq,))):
                    out.append((project, seq, False, "late", now[0], now[1]))
                elif seq > now[2]:
                    self.waiting.updateValue((seq,), request)
                else:
                    out.append(self._judge(project, now, seq, request))
                    out.extend(self._drain(project, now))
            if out:
                yield _frame(out)
        self._save(now, 0 if self.patience_ms is None else timerValues.getCurrentProcessingTimeInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        project, now = int(key[0]), self._load()
        now[3] = 0
        first = min((int(k[0]) for k in self.waiting.keys()), default=None)
        if first is not None:
            now[2] = first
            out = list(self._drain(project, now))
            self._save(now, timerValues.getCurrentProcessingTimeInMs())
            yield _frame(out)

    def close(self) -> None:
        pass


def _frame(rows: list[tuple]) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=["project_id", "seq", "accepted", "reason", "state", "attempt"])
    return frame.astype({"project_id": "int64", "seq": "int64", "accepted": "bool", "reason": object, "state": object, "attempt": "int64"})


def validate_stream(requests: DataFrame, patience_ms: int | None = None) -> DataFrame:
    """Verdicts on a stream of requests, with the rules of `statelog.validate_log` and equal to them for a whole log.

    requests(project_id, seq, action, target, technical_qa_passed), seq dense from zero per project, in files
    of any order. See `Verdicts` for requests that come early or too late. A repeated seq is late. With
    patience the stream watches the clock, so it must run on a processing-time trigger. Needs the RocksDB state
    store, which this sets on the session.
    """
    requests.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    columns = ["project_id", "seq", "action", "target", "technical_qa_passed"]
    rows = requests.select(F.col("project_id").cast("bigint").alias("project_id"), F.col("seq").cast("bigint").alias("seq"), *columns[2:])
    return rows.groupBy("project_id").transformWithStateInPandas(
        statefulProcessor=Verdicts(patience_ms), outputStructType=statelog.VERDICTS, outputMode="append", timeMode="none" if patience_ms is None else "processingTime"
    )


def first_seen(stream: DataFrame, key: str, at: str = "entered_at", keep: str = "1 hour") -> DataFrame:
    """Let each content key through once; repeats within the watermark are dropped."""
    return stream.withWatermark(at, keep).dropDuplicatesWithinWatermark([key])


class Sightings(StatefulProcessor):
    """Lets a key through, and again once `keep_us` have passed since; judges in order of event time.

    A row waits until the watermark has passed it, so rows that come out of order within the watermark's delay
    change nothing. A row behind the watermark is told as late. State is the last instant let through and the instants that
    wait; an event-time timer drops it when it can no longer matter, so the state holds the keys of the last `keep_us`.
    A batch costs a key one append and one timer, and a timer judges all instants that are due, however many they are.
    """

    def __init__(self, keep_us: int):
        self.keep_us = keep_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.passed = handle.getValueState("passed", "at_us bigint")
        self.waiting = handle.getListState("waiting", "at_us bigint")

    def _wake(self, at_us: int) -> None:
        self.handle.registerTimer(-(-at_us // 1000))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        watermark = timerValues.getCurrentWatermarkInMs() * 1000
        held = []
        for batch in rows:
            at = batch["at_us"].to_numpy()
            held.append(at[at >= watermark])
            late = np.sort(at[at < watermark])
            if len(late):
                yield pd.DataFrame({"key": key[0], "at_us": late, "late": True})
        instants = np.unique(np.concatenate(held)).tolist() if held else []
        if instants:
            self.waiting.appendList([(at,) for at in instants])
            self._wake(instants[0])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        watermark = timerValues.getCurrentWatermarkInMs() * 1000
        last = self.passed.get()[0] if self.passed.exists() else None
        known, out = last is not None, []
        waiting = sorted({int(k[0]) for k in self.waiting.get()}) if self.waiting.exists() else []
        due = bisect.bisect_right(waiting, watermark)
        for at in waiting[:due]:
            if last is None or at - last >= self.keep_us:
                out.append(at)
                last = at
        if due == len(waiting):
            if due:
                self.waiting.clear()
        else:
            if due:
                self.waiting.put([(at,) for at in waiting[due:]])
            self._wake(waiting[due])
        if last is not None and last + self.keep_us <= watermark:
            if known:
                self.passed.clear()
        elif out:
            self.passed.update((last,))
            self._wake(last + self.keep_us)
        if out:
            yield pd.DataFrame({"key": key[0], "at_us": out, "late": False})

    def close(self) -> None:
        pass


def sightings(stream: DataFrame, key: str, at: str = "entered_at", keep: str = "1 day", late: str = "1 hour") -> DataFrame:
    """First rows of each content key, once per `keep` of event time: key, at_us, late.

    Unlike `first_seen`, a key comes through again after `keep`, the result does not depend on how rows fall into
    batches, and rows more than the delay `late` behind come out marked instead of vanishing (`write_routed`
    keeps them apart). Rows newer than the watermark wait for it. Rows without key or time take no part. Needs the
    RocksDB state store, which this sets on the session.
    """
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    rows = stream.where(F.col(key).isNotNull() & F.col(at).isNotNull()).withWatermark(at, late)
    # Without the time column itself Spark leaves late rows to the processor.
    rows = rows.select(F.col(key).cast("string").alias("key"), F.unix_micros(F.col(at).cast("timestamp")).alias("at_us"))
    return rows.groupBy("key").transformWithStateInPandas(
        statefulProcessor=Sightings(int(pd.Timedelta(keep) // pd.Timedelta("1us"))), outputStructType="key string, at_us bigint, late boolean", outputMode="append", timeMode="eventTime"
    )


def write_routed(stream: DataFrame, folder: str):
    """Start a stream that writes rows in time below `folder`/rows and late ones below `folder`/late.

    A batch has folders of its own there, so one that is run again replaces what it had written.
    """

    def write(batch: DataFrame, number: int) -> None:
        for name, part in (("rows", ~F.col("late")), ("late", F.col("late"))):
            batch.where(part).drop("late").write.mode("overwrite").parquet(f"{folder}/{name}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()


def stage_counts(runs: DataFrame, at: str = "started_at", window: str = "1 day", late: str = "1 day") -> DataFrame:
    """Runs per stage and status in tumbling windows, emitted once a window is past the watermark."""
    rows = runs.withWatermark(at, late).groupBy(F.window(at, window).alias("w"), "stage", "status").agg(F.count(F.lit(1)).alias("runs"))
    return rows.select(F.col("w.start").alias("window_start"), "stage", "status", "runs")
