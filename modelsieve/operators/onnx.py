"""ONNX operator indicators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values.
SUSPICIOUS_OPS = ["PyOp", "CustomOp", "StringNormalizer"]
OP_SCORE = 9.8
OP_VECTOR = "CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H"


def onnx_ops(chunks: DataFrame, chunked: bool = False) -> DataFrame:
    """First byte offset of each suspicious operator name, case-sensitive.

    With ``chunked`` the earliest offset over all chunks of an artifact is kept.
    """
    text = F.decode("content", "ISO-8859-1")
    found = F.array(*[F.when(F.contains(F.col("content"), F.lit(op.encode())), F.struct(
        F.lit(k).alias("rule_no"), F.lit(op).alias("op"),
        (F.col("base_offset") + F.instr(text, op) - 1).alias("offset"))) for k, op in enumerate(SUSPICIOUS_OPS)])
    hits = chunks.select("artifact_id", F.explode(F.array_compact(found)).alias("f")).select("artifact_id", "f.*")
    if chunked:
        hits = hits.groupBy("artifact_id", "rule_no", "op").agg(F.min("offset").alias("offset"))
    return hits.select(
        "artifact_id", F.lit("dangerous_onnx_op").alias("type"), F.lit("code_execution").alias("category"),
        "offset", F.lit("critical").alias("severity"), F.lit(OP_SCORE).alias("cvss_score"),
        F.lit(OP_VECTOR).alias("cvss_vector"),
        F.format_string("Suspicious ONNX Operator found: %s. Can execute arbitrary code.", "op").alias("desc"),
        "op", "rule_no")
