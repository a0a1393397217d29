"""Running totals over the stream of finished scans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from modelsieve.operators.analytics import overview
from modelsieve.sources.tables import path_exists

REFRESH = "5 seconds"


def live_stats(scans: DataFrame) -> DataFrame:
    """Total scans and threats so far (complete mode); state is one row."""
    return overview(scans).select("total_scans", "threats_found")


def start_active_scans(changes: DataFrame, name: str, checkpoint: str, trigger: dict | None = None, store: str | None = None) -> StreamingQuery:
    """Keep the number of scans now running in a view ``name`` (active_scans).

    ``changes`` is the stream of ``open_scan_changes``: which scans are open is held in its state store. Each micro-batch writes the sum of
    its changes to ``store`` (by default beside the checkpoint) under its own number, so a batch that is replayed writes the same
    row again, and a query that is restarted goes on from the same count.
    """
    spark = changes.sparkSession
    store = store or f"{checkpoint.rstrip('/')}-open-scans"

    def show() -> None:
        made = "batch bigint, change bigint"
        rows = spark.read.schema(made).parquet(store) if path_exists(spark, store) else spark.createDataFrame([], made)
        rows.agg(F.coalesce(F.sum("change"), F.lit(0)).alias("active_scans")).createOrReplaceTempView(name)

    def update(batch: DataFrame, number: int) -> None:
        row = batch.agg(F.coalesce(F.sum("change"), F.lit(0)).cast("bigint").alias("change"))
        row.coalesce(1).write.mode("overwrite").parquet(f"{store}/batch={number}")
        show()

    show()
    return (changes.writeStream.outputMode("update").foreachBatch(update).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"processingTime": REFRESH})).start())


def start_live_stats(scans: DataFrame, name: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Refresh the totals every five seconds in an in-memory table ``name``."""
    return (live_stats(scans).writeStream.outputMode("complete").format("memory").queryName(name)
            .option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"processingTime": REFRESH})).start())
