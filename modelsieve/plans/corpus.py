"""End-to-end scan of a folder of artifacts."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from modelsieve.functions.matching import shared_context
from modelsieve.operators.admission import advisories, format_of
from modelsieve.operators.gguf import gguf_notes
from modelsieve.operators.ioc import ioc_screen
from modelsieve.operators.literals import literal_presence
from modelsieve.operators.safetensors import safetensors_notes
from modelsieve.operators.scoring import assemble_results, final_verdict, inspector_risk, sdk_risk
from modelsieve.operators.signatures import SIGNATURES, Signature
from modelsieve.plans.dispatch import FILE_FACTS, FINDING_COLUMNS, READ_ERROR, byte_findings, inspector_findings, structure_findings
from modelsieve.session import shared_dir
from modelsieve.sources.artifacts import (artifact_chunks, artifact_prefix, gguf_kv_of_files, pickle_ops_of_files,
                                          safetensors_heads, template_blocks_of_files, with_ids)

FORMAT_HEAD = 100


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Used where one expensive result feeds several consumers: they read the
    table instead of scanning artifact bytes again, and it outlives executors.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark, name)}/{name}"
    # many read tasks hold few rows each: rebalance to files of sensible size,
    # which also cuts partitions that grew too large
    df.hint("rebalance").write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@dataclass
class CorpusScan:
    files: DataFrame        # manifest with ids, format and hash
    findings: DataFrame
    results: DataFrame      # one row per file (see assemble_results), IOC hits and files with errors included
    errors: DataFrame       # (artifact_id, path, error) of every pass that could not read a file


def scan_files(spark: SparkSession, manifest: DataFrame, iocs: DataFrame | None = None,
               limit: int | None = None, signatures: Sequence[Signature] = SIGNATURES) -> CorpusScan:
    """Engine-profile scan of the files of a manifest, whole files unless ``limit`` says otherwise.

    1. one pass opens every file once and gives its hash, its format and the byte-level findings, stored together; 2. files with a
    known-bad hash are set aside; 3. opcode and header walkers run only on the other files of their format; 4. all findings are
    stored once and scored from the stored table. ``signatures`` replaces the built-in catalogue; the bytes that neighbouring
    chunks share follow from its widest rule.

    A file that any pass cannot read, or that is longer than ``limit``, is never clean: its status is ``error``
    (``partial`` in the message of the latter) and it has no score.
    """
    listed = stored(with_ids(manifest), "listed")
    chunks = artifact_chunks(listed, limit, context=shared_context([s.rule() for s in signatures]), facts=True)
    chunks = chunks.withColumn("format", format_of(F.coalesce("head", F.lit(b"")), F.col("filename")))
    first = stored(byte_findings(chunks, signatures).select(*FINDING_COLUMNS), "bytes")
    facts = first.filter(F.col("type") == FILE_FACTS).select("artifact_id", F.col("pattern_id").alias("format"), F.col("desc").alias("file_hash"))
    failed = first.filter(F.col("type") == READ_ERROR).groupBy("artifact_id").agg(F.min("desc").alias("error"))
    files = stored(listed.join(facts, "artifact_id", "left").join(failed, "artifact_id", "left"), "files")
    sound = files.filter("error is null").drop("error")
    if iocs is None:
        iocs = spark.createDataFrame([], "file_hash string")
    hits, open_ = ioc_screen(sound, iocs)
    of = lambda *formats: open_.filter(F.col("format").isin(*formats))
    walked = structure_findings(
        pickle_ops_of_files(of("pickle", "unknown"), limit), template_blocks_of_files(of("gguf")),
        artifact_chunks(of("onnx"), limit).filter("error is null"), safetensors_heads(of("safetensors")), chunked=True)
    in_bytes = first.filter(F.col("type") != FILE_FACTS).join(hits.select("artifact_id"), "artifact_id", "left_anti")
    seen = stored(in_bytes.unionByName(walked.select(*FINDING_COLUMNS)), "findings")
    findings = seen.filter(F.col("type") != READ_ERROR)
    routed = open_.unionByName(files.filter("error is not null").drop("error").withColumn("format", F.lit("unknown")), allowMissingColumns=True)
    path = routed.select("artifact_id", "path")
    errors = (seen.filter(F.col("type") == READ_ERROR).select("artifact_id", F.col("desc").alias("error"))
              .distinct().join(path, "artifact_id"))
    if limit is not None:
        errors = errors.unionByName(routed.filter(F.col("length") > limit).select(
            "artifact_id", "path", F.format_string("partial: %d of %d bytes were scanned", F.lit(limit), F.col("length")).alias("error")))
    results = assemble_results(routed.withColumn("file_size", F.col("length")), findings, errors=errors)
    known = hits.select(
        "artifact_id", "filename", F.lit(0).alias("page"), "risk_score", "risk_level",
        F.lit("danger").alias("status"), F.lit(1).cast("bigint").alias("threats_found"),
        F.lit("Known malicious hash.").alias("details"),
        F.array(F.struct("pattern", "severity", "description", F.col("filename").alias("location"), "category"))
         .alias("threats"),
        F.create_map(F.lit("file_size"), F.col("length").cast("string"), F.lit("extension"), F.col("ext"),
                     F.lit("threats_found"), F.lit("1"), F.lit("ioc_hit"), F.lit("true")).alias("metadata"))
    return CorpusScan(files, findings, results.unionByName(known), errors)


def scan_rows(scan: CorpusScan, manifest: DataFrame) -> DataFrame:
    """Rows for the scan table, with file facts and the scan time of the file; unread files have ``scan_status`` error."""
    facts = with_ids(manifest).select("artifact_id", "length", "ext", "modified")
    return (scan.results.join(facts, "artifact_id")
            .join(scan.files.select("artifact_id", "file_hash"), "artifact_id")
            .select(F.col("artifact_id").alias("scan_id"), "filename", F.col("length").alias("file_size"),
                    F.col("ext").alias("file_extension"), "file_hash", "risk_score", "risk_level", "threats",
                    "threats_found", F.col("metadata").alias("metadata_info"), F.lit("upload").alias("source_type"),
                    F.lit(True).alias("is_public"), F.col("modified").alias("created_at"),
                    F.when(F.col("status") == "error", "error").otherwise("completed").alias("scan_status")))


def _with_errors(results: DataFrame, failed: DataFrame, unknown: dict[str, str]) -> DataFrame:
    """Add ``error``; in rows of ``failed`` (artifact_id, error) the columns of ``unknown`` become null (or what it says)."""
    first = failed.groupBy(F.col("artifact_id").alias("_failed")).agg(F.min("error").alias("error"))
    met = results.join(first, results["artifact_id"] == first["_failed"], "left").drop("_failed")
    kinds = {f.name: f.dataType for f in results.schema}
    return met.withColumns({c: F.when(F.col("error").isNull(), F.col(c)).otherwise(F.lit(v).cast(kinds[c])) for c, v in unknown.items()})


def sdk_scan(manifest: DataFrame, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(threats, results) of a folder under the SDK profile: literals in whole files, or their first ``limit`` bytes.

    A file that cannot be read has an ``error``, the verdict UNKNOWN and no score.
    """
    files = with_ids(manifest)
    chunks = artifact_chunks(files, limit)
    seen = stored(literal_presence(chunks.filter("error is null"), chunked=True).withColumn("error", F.lit(None).cast("string"))
                  .unionByName(chunks.filter("error is not null").select("artifact_id", "error").distinct(), allowMissingColumns=True), "threats")
    threats = seen.filter("error is null").drop("error")
    scored = sdk_risk(files, threats).withColumns({"has_analysis": F.lit(False), "ai_verdict": F.lit(None).cast("string")})
    results = final_verdict(scored).drop("has_analysis", "ai_verdict")
    failed = seen.filter("error is not null").select("artifact_id", "error").distinct()
    return threats, _with_errors(results, failed, {"risk_score": None, "risk_level": None, "verdict": "UNKNOWN", "is_safe": False})


def inspect_files(manifest: DataFrame, layout: str = "u64", limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(findings, results) of a folder under the inspector profile, detectors chosen by extension.

    Every file has a result. What the inspector notes without a score (counts, keys, chat template, safety of the format) has a
    ``message``. A file that cannot be read has a ``file_error`` finding, an ``error`` and no score.
    """
    files = with_ids(manifest)
    heads = stored(artifact_prefix(files, FORMAT_HEAD), "heads")
    sound = files.join(heads.filter("error is null").select("artifact_id"), "artifact_id", "left_semi")
    sound_of = lambda *exts: sound.filter(F.col("ext").isin(*exts))
    kv = stored(gguf_kv_of_files(sound_of(".gguf"), limit, layout), "pairs")
    tensors = stored(safetensors_heads(sound_of(".safetensors")), "tensors")
    chunks = artifact_chunks(sound_of(".pkl", ".pickle", ".pt", ".pth"), limit)
    found = inspector_findings(
        heads.filter("ext <> '.safetensors' and error is null"), chunks.filter("error is null"),
        kv.filter("error is null").drop("error"), tensors.filter("error is null"))
    unscored = gguf_notes(kv.filter("error is null").drop("error")).unionByName(safetensors_notes(tensors.filter("error is null")))
    notes = advisories(files.select("artifact_id", "filename", F.col("length").alias("file_size")), limit).drop("filename", "file_size")
    failed = (heads.filter("error is not null").select("artifact_id", "error")
              .unionByName(kv.filter("error is not null").select("artifact_id", "error"))
              .unionByName(tensors.filter("error is not null").select("artifact_id", "error"))
              .unionByName(chunks.filter("error is not null").select("artifact_id", "error").distinct()))
    findings = stored(found.unionByName(failed.select("artifact_id", F.lit("file_error").alias("type"), F.lit("suspicious").alias("severity"),
                                                      F.col("error").alias("pattern")), allowMissingColumns=True)
                      .unionByName(notes, allowMissingColumns=True)
                      .unionByName(unscored.withColumnRenamed("detail", "message").withColumn("weight", F.lit(0.0)), allowMissingColumns=True), "inspection")
    failed = findings.filter("type = 'file_error'").select("artifact_id", F.col("pattern").alias("error"))
    return findings, _with_errors(inspector_risk(findings.filter("message IS NULL"), files), failed, {"risk_score": None, "risk_level": None})
