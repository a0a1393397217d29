"""Screening against known-bad hashes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

IOC_PATTERN = "IOC-BLACKLIST"
IOC_DESCRIPTION = "This file is known to be malicious according to the global IOC database."


def ioc_flagged(artifacts: DataFrame, iocs: DataFrame) -> DataFrame:
    """Each artifact once, hits with the fixed result in further columns, which are null for the rest: one pass, one join.

    The hash list grows, so no broadcast is forced: AQE broadcasts its single
    column when it measures small and otherwise joins by hash. A hash shared by
    a third of all files skews only the artifact side, which AQE splits, since
    the list holds each hash once.
    """
    known = iocs.select("file_hash").distinct().withColumn("_known", F.lit(True))
    result = {"risk_score": 100, "risk_level": "critical", "pattern": IOC_PATTERN, "severity": "critical", "category": "known_malware",
              "description": IOC_DESCRIPTION}
    return (artifacts.join(known, "file_hash", "left")
            .withColumns({name: F.when(F.col("_known"), F.lit(value)) for name, value in result.items()}).drop("_known"))


def ioc_screen(artifacts: DataFrame, iocs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(hits, rest). Hits carry the fixed result and are scanned no further."""
    flagged = ioc_flagged(artifacts, iocs)
    return flagged.filter("pattern IS NOT NULL"), flagged.filter("pattern IS NULL").select(*artifacts.columns)
