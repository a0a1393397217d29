"""Vulnerability feed responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from modelsieve.operators.intel import ITEM_SCHEMA

RESPONSE_SCHEMA = f"vulnerabilities array<{ITEM_SCHEMA}>"


def items_of(responses: DataFrame) -> DataFrame:
    """One row per item, numbered inside its response."""
    return responses.select("keyword", F.posexplode_outer("vulnerabilities").alias("pos", "item")).filter(
        "item is not null")


def read_cve_feed(spark: SparkSession, path: str) -> DataFrame:
    """(keyword, pos, item) of JSON responses stored as ``keyword=<word>/*.json``.

    Each response is one JSON document; its keyword is its folder.
    """
    responses = (spark.read.schema(RESPONSE_SCHEMA).option("multiLine", "true")
                 .option("recursiveFileLookup", "true").json(path)
                 .withColumn("keyword", keyword_of(F.col("_metadata.file_path"))))
    return items_of(responses)


def keyword_of(path: Column) -> Column:
    """Keyword in a file URI; the folder may hold it plain or percent-encoded."""
    return F.url_decode(F.url_decode(F.regexp_extract(path, r"keyword=([^/]*)/", 1)))


def parse_cve_responses(responses: DataFrame, col: str = "response") -> DataFrame:
    """The same rows from response texts held in a column next to ``keyword``."""
    return items_of(responses.select("keyword", F.from_json(col, RESPONSE_SCHEMA)["vulnerabilities"]
                                   .alias("vulnerabilities")))
