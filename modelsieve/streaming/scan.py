"""Scan artifacts as they arrive."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from modelsieve.plans.corpus import scan_files, scan_rows, stored
from modelsieve.sources.artifacts import DEFAULT_EXTENSIONS, describe_files, with_ids
from modelsieve.sources.tables import (append_errors, append_findings, append_new, append_results, conform, path_exists,
                                       read_table, schema_of)

FILE_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"
MANIFEST = ("path", "filename", "ext", "length", "modified")
ATTEMPTS = 5
DELAY = 30.0
ORDER = ("artifact_id string, path string, filename string, ext string, length bigint, micros bigint, attempt int, kind string, "
         "error string")
ORDER_COLUMNS = [c.split()[0] for c in ORDER.split(", ")]


def arriving_files(spark: SparkSession, src: str, exts=DEFAULT_EXTENSIONS, per_batch: int | None = None) -> DataFrame:
    """Manifest rows of new files below ``src``; their bytes are not read here."""
    reader = (spark.readStream.format("binaryFile").schema(FILE_SCHEMA)
              .option("recursiveFileLookup", "true"))
    if per_batch:
        reader = reader.option("maxFilesPerTrigger", per_batch)
    return describe_files(reader.load(src), exts)


def scan_batch(manifest: DataFrame, out: str, iocs_path: str | None = None) -> DataFrame:
    """Scan one batch of files, store results once per file version, and return (artifact_id, status, error) of each.

    Files that could not be read are stored too, with ``scan_status`` error, and listed in ``errors``; a later scan of them that
    succeeds takes their place. Scan ids follow from path, time and size, and rows already stored are left
    out, so a batch that is replayed after a failure adds nothing twice.
    """
    spark = manifest.sparkSession
    iocs = read_table(spark, "ioc_records", iocs_path) if iocs_path else None
    scan = scan_files(spark, manifest, iocs)
    rows = stored(scan_rows(scan, manifest), "rows")
    # findings first: a scan that is stored has its findings stored
    append_findings(scan.findings, rows, f"{out}/findings")
    append_results(rows, f"{out}/scans")
    failed = scan.errors.join(rows.select(F.col("scan_id").alias("artifact_id"), F.to_date("created_at").alias("scan_date")), "artifact_id")
    append_errors(failed, f"{out}/errors")
    why = scan.errors.groupBy("artifact_id").agg(F.min("error").alias("error"))
    return rows.select(F.col("scan_id").alias("artifact_id"), F.col("scan_status").alias("status")).join(why, "artifact_id", "left")


def _try(orders: DataFrame, out: str, iocs_path: str | None) -> None:
    """Scan what was ordered, (artifact_id, attempt, manifest columns), and note how each try ended, once per try."""
    spark = orders.sparkSession
    if orders.isEmpty():
        return
    ended = scan_batch(orders.select(*MANIFEST), out, iocs_path)
    notes = conform(orders.select("artifact_id", "attempt", "path").join(ended, "artifact_id"), "attempts")
    path = f"{out}/attempts"
    if path_exists(spark, path):
        notes = notes.join(read_table(spark, "attempts", path).select("artifact_id", "attempt"), ["artifact_id", "attempt"], "left_anti")
    notes.write.mode("append").parquet(path)


def retry_failed(spark: SparkSession, out: str, manifest: DataFrame, iocs_path: str | None = None, attempts: int = ATTEMPTS) -> int:
    """Try the failed scans below ``out`` once more whose files are in ``manifest``; returns how many were tried.

    The batch form of the queue of ``stream_scan_queue``: a scan is tried ``attempts`` times in all, the first time being that which failed.
    """
    failed = read_table(spark, "scans", f"{out}/scans").filter("scan_status = 'error'").select(F.col("scan_id").alias("artifact_id"))
    tried = spark.createDataFrame([], schema_of("attempts"))
    if path_exists(spark, f"{out}/attempts"):
        tried = read_table(spark, "attempts", f"{out}/attempts")
    number = tried.groupBy("artifact_id").agg(F.max("attempt").alias("_last"))
    orders = (with_ids(manifest).join(failed, "artifact_id", "left_semi").join(number, "artifact_id", "left")
              .withColumn("attempt", F.coalesce("_last", F.lit(1)) + 1).filter(F.col("attempt") <= attempts).drop("_last"))
    orders = stored(orders, "orders")
    _try(orders, out, iocs_path)
    return orders.count()


class _Queue(StatefulProcessor):
    """Keeps each file until its scan has finished. A failed try sets a timer, each time twice as long; when it runs out the
    file is ordered again, and after the last try it goes to the dead letters. Repeated and outdated news change nothing."""

    def __init__(self, attempts: int, delay_ms: int) -> None:
        self.attempts, self.delay_ms = attempts, delay_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.file = handle.getValueState("file", "path string, filename string, ext string, length bigint, micros bigint, attempt int, waiting boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        news = [r for frame in rows for r in frame.itertuples(index=False)]
        for r in sorted(news, key=lambda r: (not pd.isna(r.attempt), r.attempt)):
            known = self.file.get() if self.file.exists() else None
            if pd.isna(r.attempt):
                if known is None:
                    file = (r.path, r.filename, r.ext, int(r.length), int(r.micros))
                    self.file.update((*file, 1, False))
                    yield self._row(key[0], file, 1, "scan", None)
                continue
            if known is None or known[5] != int(r.attempt) or known[6]:
                continue
            if r.status != "error":
                self.file.clear()
            elif known[5] >= self.attempts:
                self.file.clear()
                yield self._row(key[0], known[:5], known[5], "dead", r.error)
            else:
                self.file.update((*known[:6], True))
                self.handle.registerTimer(timer_values.getCurrentProcessingTimeInMs() + self.delay_ms * 2 ** (known[5] - 1))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.file.exists():
            known = self.file.get()
            self.file.update((*known[:5], known[5] + 1, False))
            yield self._row(key[0], known[:5], known[5] + 1, "scan", None)

    def close(self) -> None:
        pass

    @staticmethod
    def _row(artifact, file, attempt, kind, error) -> pd.DataFrame:
        return pd.DataFrame([(artifact, *file, attempt, kind, error)], columns=ORDER_COLUMNS)


def scan_queue(arrivals: DataFrame, ended: DataFrame, attempts: int = ATTEMPTS, delay: float = DELAY) -> DataFrame:
    """Orders (kind ``scan``) and dead letters (kind ``dead``) from streams of arriving files and of tries that ended."""
    nothing = lambda kind: F.lit(None).cast(kind)
    files = with_ids(arrivals).select("artifact_id", "path", "filename", "ext", "length", F.unix_micros("modified").alias("micros"),
                                      nothing("int").alias("attempt"), nothing("string").alias("status"), nothing("string").alias("error"))
    tries = ended.select("artifact_id", "path", nothing("string").alias("filename"), nothing("string").alias("ext"),
                         nothing("bigint").alias("length"), nothing("bigint").alias("micros"), "attempt", "status", "error")
    return files.unionByName(tries).groupBy("artifact_id").transformWithStateInPandas(
        statefulProcessor=_Queue(attempts, int(delay * 1000)), outputStructType=ORDER, outputMode="Append", timeMode="ProcessingTime")


def stream_scan_queue(spark: SparkSession, src: str, out: str, checkpoint: str, iocs_path: str | None = None, per_batch: int | None = None,
                      attempts: int = ATTEMPTS, delay: float = DELAY, every: str = "10 seconds") -> StreamingQuery:
    """Scan every new file below ``src``; files that cannot be read are tried again later, ``attempts`` times in all.

    How tries end is written to ``attempts`` below ``out`` and read back as a stream, so the queue's state, its timers and the
    input survive a restart together. ``delay`` seconds pass before the second try, twice as many before each further one. Files given up are
    listed in ``dead_letters``. The query runs until stopped; the session must use the state store ``progress.STATE_STORE``.
    """
    path = f"{out}/attempts"
    if not path_exists(spark, path):
        spark.createDataFrame([], schema_of("attempts")).write.mode("append").parquet(path)
    ended = spark.readStream.schema(schema_of("attempts")).parquet(path)
    orders = scan_queue(arriving_files(spark, src, per_batch=per_batch), ended, attempts, delay)

    def run(batch: DataFrame, _: int) -> None:
        now = stored(batch, "orders")
        dead = conform(now.filter("kind = 'dead'").withColumn("attempts", F.col("attempt")), "dead_letters")
        if not dead.isEmpty():
            append_new(dead, "dead_letters", f"{out}/dead_letters", "artifact_id")
        _try(now.filter("kind = 'scan'").withColumn("modified", F.timestamp_micros("micros")), out, iocs_path)

    return (orders.writeStream.outputMode("append").foreachBatch(run).option("checkpointLocation", checkpoint)
            .trigger(processingTime=every).start())


def stream_scan(spark: SparkSession, src: str, out: str, checkpoint: str, iocs_path: str | None = None,
                per_batch: int | None = None, trigger: dict | None = None) -> StreamingQuery:
    """Scan, score and append every new file below ``src`` exactly once. For files that fail see ``retry_failed`` and ``stream_scan_queue``."""
    return (arriving_files(spark, src, per_batch=per_batch).writeStream
            .foreachBatch(lambda batch, _: scan_batch(batch, out, iocs_path))
            .option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())
