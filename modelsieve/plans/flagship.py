"""Flagship query: signature scan to risk levels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from modelsieve.functions.matching import whole_content
from modelsieve.operators.scoring import artifact_cvss, engine_risk
from modelsieve.operators.signatures import signature_hits
from modelsieve.sources.derived import v_artifacts


def risk_profile(spark: SparkSession, d: str) -> DataFrame:
    """Artifacts, highest score and hits per risk level."""
    artifacts = v_artifacts(spark, d)
    hits = signature_hits(whole_content(artifacts)).withColumn(
        "ordinal", F.col("rule_no") * F.lit(10 ** 12).cast("bigint") + F.col("offset"))
    scored = engine_risk(artifact_cvss(hits))
    return (artifacts.select("artifact_id").join(scored, "artifact_id", "left")
            .groupBy(F.coalesce("risk_level", F.lit("clean")).alias("risk_level"))
            .agg(F.count("*").alias("artifacts"), F.coalesce(F.sum("threats_found"), F.lit(0)).alias("hits"),
                 F.coalesce(F.max("risk_score"), F.lit(0)).alias("max_score")))
