"""Incremental growth of the vulnerability table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from modelsieve.operators.intel import cve_merge, cve_parse
from modelsieve.sources.feeds import RESPONSE_SCHEMA, items_of, keyword_of
from modelsieve.sources.tables import append_new, conform, path_exists, read_table


def merge_batch(responses: DataFrame, table: str) -> None:
    """Add the unseen vulnerabilities of one batch of feed responses."""
    spark = responses.sparkSession
    existing = (read_table(spark, "cve_records", table) if path_exists(spark, table)
                else conform(spark.range(0).select(F.lit(None).alias("cve_id")), "cve_records"))
    append_new(cve_merge(existing, cve_parse(items_of(responses))), "cve_records", table, "cve_id")


def cve_incremental(spark: SparkSession, src: str, table: str, checkpoint: str) -> StreamingQuery:
    """Merge the feed files that landed since the last run, then stop."""
    landed = (spark.readStream.schema(RESPONSE_SCHEMA).option("multiLine", "true")
              .option("recursiveFileLookup", "true").json(src)
              .withColumn("keyword", keyword_of(F.col("_metadata.file_path"))))
    return (landed.writeStream.foreachBatch(lambda batch, _: merge_batch(batch, table))
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
