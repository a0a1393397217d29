"""Progress of running scans: latest stage per scan, batch and streaming."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

# Fixed values.
TERMINAL = ("complete", "error")
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
ABANDONED_AFTER_MS = 60 * 60 * 1000
LATENESS = "1 hour"

PROGRESS_SCHEMA = "scan_id string, stage string, progress int, timestamp timestamp, closed boolean"


def latest_stage(events: DataFrame) -> DataFrame:
    """Latest event per scan; ``closed`` once that is a terminal stage.

    ``max_by`` reduces map-side, so a scan with very many events stays cheap.
    Needs ``seq`` as a tie-break for equal timestamps.
    """
    last = F.max_by(F.struct("stage", "progress", "timestamp"), F.struct("timestamp", "seq"))
    return (events.groupBy("scan_id").agg(last.alias("e"))
            .select("scan_id", "e.*", F.col("e.stage").isin(*TERMINAL).alias("closed")))


def open_scans(events: DataFrame) -> DataFrame:
    """One row: the number of scans whose latest stage is not terminal."""
    return latest_stage(events).agg(F.count_if(~F.col("closed")).alias("active_scans"))


class _LatestStage(StatefulProcessor):
    """Keeps the newest event of each scan. A closed scan leaves its last event as a tombstone, so that a late older
    event cannot open it again; the state goes when the watermark is an hour past that event, as later events are dropped."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "stage string, progress int, micros bigint, seq bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        best = None
        if self.last.exists():
            stage, progress, micros, seq = self.last.get()
            best = (micros, seq, stage, progress)
        for frame in rows:
            for r in frame.itertuples(index=False):
                event = (int(r.timestamp.value // 1000), int(r.seq), r.stage, None if pd.isna(r.progress) else int(r.progress))
                if best is None or event[:2] > best[:2]:
                    best = event
        micros, seq, stage, progress = best
        self.last.update((stage, progress, micros, seq))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(max(micros // 1000 + ABANDONED_AFTER_MS, timer_values.getCurrentWatermarkInMs() + 1))
        yield self._row(key[0], stage, progress, micros, stage in TERMINAL)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.last.exists():
            stage, progress, micros, _ = self.last.get()
            self.last.clear()
            if stage not in TERMINAL:
                yield self._row(key[0], "abandoned", progress, micros, True)

    def close(self) -> None:
        pass

    @staticmethod
    def _row(scan_id, stage, progress, micros, closed) -> pd.DataFrame:
        return pd.DataFrame({"scan_id": [scan_id], "stage": [stage], "progress": pd.array([progress], dtype="Int32"),
                             "timestamp": [pd.Timestamp(micros, unit="us")], "closed": [closed]})


class _OpenScans(_LatestStage):
    """The same state, but only what opens and closes scans is given out: (scan_id, change), +1 or -1."""

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        before = self.last.exists() and self.last.get()[0] not in TERMINAL
        for frame in super().handleInputRows(key, rows, timer_values):
            change = int(not frame["closed"].iloc[0]) - int(before)
            if change:
                yield pd.DataFrame({"scan_id": [key[0]], "change": pd.array([change], dtype="Int32")})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        for _ in super().handleExpiredTimer(key, timerValues, expiredTimerInfo):
            yield pd.DataFrame({"scan_id": [key[0]], "change": pd.array([-1], dtype="Int32")})


def _newest_per_batch(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        yield frame.sort_values(["timestamp", "seq"]).drop_duplicates("scan_id", keep="last")


def _reduced(events: DataFrame, lateness: str) -> DataFrame:
    """Each Arrow batch cut to its newest event per scan. Events without a time are left out; a missing ``seq`` comes before all others."""
    slim = events.select("scan_id", "stage", "progress", "timestamp", F.coalesce(F.col("seq").cast("bigint"), F.lit(-1 << 62)).alias("seq"))
    return slim.filter("timestamp IS NOT NULL").mapInPandas(_newest_per_batch, slim.schema).withWatermark("timestamp", lateness)


def open_scan_changes(events: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """Streaming (update mode): (scan_id, change), +1 where a scan opens and -1 where it ends or falls silent. The sum of all changes
    is the number of scans now open. State and lateness as in ``progress_state``."""
    return _reduced(events, lateness).groupBy("scan_id").transformWithStateInPandas(
        statefulProcessor=_OpenScans(), outputStructType="scan_id string, change int", outputMode="Update", timeMode="EventTime")


def progress_state(events: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """Streaming form (update mode): one row per scan and micro-batch. Events later than ``lateness`` are dropped.

    Each Arrow batch is first cut to its newest event per scan, before the
    shuffle, so one noisy scan does not fill a state task. ``abandoned`` closes
    scans that fell silent for an hour of event time. The session must use the state store ``STATE_STORE``
    (``session.SETTINGS`` has it): this operator needs several columns per key.
    """
    return _reduced(events, lateness).groupBy("scan_id").transformWithStateInPandas(
        statefulProcessor=_LatestStage(), outputStructType=PROGRESS_SCHEMA,
        outputMode="Update", timeMode="EventTime")
