"""Result documents as JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEEP_NULLS = {"ignoreNullFields": "false"}


def result_documents(results: DataFrame, key: str = "scan_id") -> DataFrame:
    """(key, document): every column of a result row as one JSON document, nulls kept."""
    return results.select(key, F.to_json(F.struct(*results.columns), KEEP_NULLS).alias("document"))


def export_json(results: DataFrame, path: str, key: str = "scan_id") -> None:
    """Write one JSON document per line."""
    result_documents(results, key).select("document").write.mode("overwrite").text(path)
