"""Findings to scores, levels, verdicts and result rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modelsieve.functions.bands import band, severity_rank
from modelsieve.functions.cvss import with_base_score
from modelsieve.functions.ranking import BUCKET_SPAN, rank_in_group


def cvss_base_score(df: DataFrame, metrics: str = "metrics", mode: str = "reference") -> DataFrame:
    """Add score, severity and vector of the metric struct in ``metrics``."""
    return with_base_score(df, metrics, mode)


def artifact_cvss(findings: DataFrame) -> DataFrame:
    """Highest score per artifact and the severity of the first finding with it.

    Both are map-side reducible, so an artifact with very many findings costs
    one row per task in the shuffle.
    """
    scored = F.col("cvss_score") > 0
    first = F.max_by(F.when(scored, F.col("severity")),
                     F.when(scored, F.struct("cvss_score", (-F.col("ordinal")).alias("o"))))
    return findings.groupBy("artifact_id").agg(
        F.coalesce(F.max(F.when(scored, F.col("cvss_score"))), F.lit(0.0)).alias("cvss_score"),
        F.coalesce(first, F.lit("None")).alias("severity"),
        F.count("*").alias("threats_found"))


def engine_risk(df: DataFrame) -> DataFrame:
    score = F.least((F.col("cvss_score") * 10).cast("int"), F.lit(100))
    return df.withColumn("risk_score", score).withColumn("risk_level", band(F.col("risk_score"), "engine"))


# Base risk by extension, weight by severity.
SDK_BASE = {".pkl": 30, ".pickle": 30, ".pt": 25, ".pth": 25, ".gguf": 5, ".safetensors": 3}
SDK_BASE_OTHER = 15
SDK_WEIGHT = {"critical": 35, "high": 20, "medium": 10, "low": 5}
SDK_WEIGHT_OTHER = 5


def _choice(col: Column, values: dict, rest) -> Column:
    out = F.lit(rest)
    for key, value in values.items():
        out = F.when(col == key, value).otherwise(out)
    return out


def sdk_risk(artifacts: DataFrame, threats: DataFrame) -> DataFrame:
    """Base by extension plus severity weights, at most 100."""
    sums = threats.groupBy("artifact_id").agg(
        F.sum(_choice(F.col("severity"), SDK_WEIGHT, SDK_WEIGHT_OTHER)).alias("threat_score"),
        F.count("*").alias("threats_found"))
    score = F.least(_choice(F.col("ext"), SDK_BASE, SDK_BASE_OTHER)
                    + F.coalesce("threat_score", F.lit(0)), F.lit(100)).cast("int")
    return (artifacts.select("artifact_id", "filename", "ext").join(sums, "artifact_id", "left")
            .select("artifact_id", "filename", "ext", score.alias("risk_score"),
                    F.coalesce("threats_found", F.lit(0)).alias("threats_found"))
            .withColumn("risk_level", band(F.col("risk_score"), "sdk")))


SAFETENSORS_FLOOR = 5.0


def inspector_risk(findings: DataFrame, artifacts: DataFrame | None = None) -> DataFrame:
    """Sum of weights held to 0..100.

    A SafeTensors header that was read to the end (``header_info`` or bad
    metadata) without a malicious finding scores at least 5. With ``artifacts`` (artifact_id)
    every one of them has a row; without findings it scores 0.
    """
    sums = findings.groupBy("artifact_id").agg(
        F.sum("weight").alias("_sum"),
        F.bool_or(F.col("severity").isin("malicious", "critical")).alias("_bad"),
        F.bool_or(F.col("type").isin("header_info", "invalid_metadata_type")).alias("_read"))
    if artifacts is not None:
        sums = artifacts.select("artifact_id").join(sums, "artifact_id", "left")
    floor = F.when(F.col("_read") & ~F.col("_bad"), F.greatest(F.col("_sum"), F.lit(SAFETENSORS_FLOOR)))
    score = F.greatest(F.least(F.coalesce(floor, F.col("_sum"), F.lit(0.0)), F.lit(100.0)), F.lit(0.0))
    return (sums.select("artifact_id", score.alias("risk_score"))
            .withColumn("risk_level", band(F.col("risk_score"), "inspector")))


def risk_bands(df: DataFrame, score: str, policies: list[str]) -> DataFrame:
    """Add one column per named band policy."""
    return df.withColumns({f"band_{p}": band(F.col(score), p) for p in policies})


def final_verdict(df: DataFrame) -> DataFrame:
    """``has_analysis`` rows take the analysis verdict (missing: UNKNOWN), others the score's."""
    return (df.withColumn("verdict", F.when(F.col("has_analysis"), F.coalesce("ai_verdict", F.lit("UNKNOWN")))
                          .otherwise(band(F.col("risk_score"), "verdict")))
            .withColumn("is_safe", F.col("risk_score") < 30))


def rank_findings(findings: DataFrame, ties: list[str] | None = None, span: int = BUCKET_SPAN) -> DataFrame:
    """Add ``rank``: severity first, then the order the findings were made in."""
    return rank_in_group(findings, "artifact_id", severity_rank(F.col("severity")), "ordinal", ties=ties, span=span)


def threat_pages(findings: DataFrame, page_size: int | None = None, span: int = BUCKET_SPAN) -> DataFrame:
    """(artifact_id, page, threats): all ranked threats of an artifact in one array.

    With ``page_size`` arrays are held to that length, and artifacts with more findings get further pages.
    For work on single findings use the findings table: it has a row for each.
    """
    named = findings.select(
        "artifact_id", "ordinal", "severity",
        F.coalesce("pattern_id", "type", F.lit("unknown")).alias("pattern"),
        F.coalesce("desc", F.lit("")).alias("description"),
        F.coalesce("category", F.lit("unknown")).alias("category"))
    # a missing severity ranks last but is shown as low
    ranked = rank_findings(named, ties=["pattern", "category", "description"], span=span).withColumn(
        "severity", F.coalesce("severity", F.lit("low")))
    page = F.floor((F.col("rank") - 1) / page_size).cast("int") if page_size else F.lit(0)
    return (ranked.groupBy("artifact_id", page.alias("page"))
            .agg(F.sort_array(F.collect_list(
                F.struct("rank", "pattern", "severity", "description", "category"))).alias("threats")))


def assemble_results(artifacts: DataFrame, findings: DataFrame, page_size: int | None = None,
                     span: int = BUCKET_SPAN, errors: DataFrame | None = None) -> DataFrame:
    """Result rows: score, level, status, summary, metadata, ranked threats.

    One row per artifact (``page`` 0); only with ``page_size`` do artifacts with more threats continue in rows with
    ``page`` 1, 2, ... Artifacts in ``errors`` (artifact_id, error) were not read to their end: their status is ``error``
    and they have no score and no level, whatever was found in the rest. ``artifacts`` needs artifact_id, filename, ext, file_size and format.
    """
    scores = engine_risk(artifact_cvss(findings))
    pages = threat_pages(findings, page_size, span)
    base = artifacts.select("artifact_id", "filename", "ext", "file_size", "format")
    joined = (base.join(scores, "artifact_id", "left").join(pages, "artifact_id", "left")
              .withColumn("threats", F.transform(
                  F.coalesce("threats", F.array()), lambda t: F.struct(
                      t["pattern"].alias("pattern"), t["severity"].alias("severity"),
                      t["description"].alias("description"), F.col("filename").alias("location"),
                      t["category"].alias("category")))))
    found = F.coalesce("threats_found", F.lit(0))
    score = F.coalesce("cvss_score", F.lit(0.0))
    if errors is None:
        joined = joined.withColumn("_error", F.lit(None).cast("string"))
    else:
        first = errors.groupBy(F.col("artifact_id").alias("_failed")).agg(F.min("error").alias("_error"))
        joined = joined.join(first, joined["artifact_id"] == first["_failed"], "left")
    read = F.col("_error").isNull()
    return joined.select(
        "artifact_id", "filename", F.coalesce("page", F.lit(0)).alias("page"),
        F.when(read, F.coalesce("risk_score", F.lit(0))).alias("risk_score"),
        F.when(read, F.coalesce("risk_level", F.lit("clean"))).alias("risk_level"),
        F.when(~read, "error").when(found > 0, "danger").otherwise("safe").alias("status"),
        found.alias("threats_found"),
        F.when(read, F.format_string("Analyzed %d bytes. Found %d potential threats.", F.col("file_size"), found))
         .otherwise(F.concat(F.lit("Not read to the end: "), "_error")).alias("details"),
        "threats",
        F.create_map(
            F.lit("file_size"), F.col("file_size").cast("string"), F.lit("extension"), F.col("ext"),
            F.lit("threats_found"), found.cast("string"), F.lit("cvss_score"), score.cast("string"),
            F.lit("cvss_severity"), F.coalesce("severity", F.lit("None")),
            F.lit("file_type"), F.col("format")).alias("metadata"))


PROMPT_TOP = {"judge": 10, "provider": 50}


def verdict_prompt_rows(results: DataFrame, top: int = PROMPT_TOP["judge"]) -> DataFrame:
    """One prompt per scan with its first ``top`` threats as JSON (a feature of the
    prompt, which also states the full count)."""
    shown = F.to_json(F.slice("threats", 1, top))
    return results.filter("page = 0").select(
        "artifact_id", F.size(F.slice("threats", 1, top)).alias("threats_shown"),
        F.concat_ws(
            "\n", F.concat(F.lit("File: "), "filename"),
            F.concat(F.lit("Extension: "), F.coalesce(F.col("metadata")["extension"], F.lit("unknown"))),
            F.concat(F.lit("File size: "), F.coalesce(F.col("metadata")["file_size"], F.lit("0")), F.lit(" bytes")),
            F.concat(F.lit("Risk score: "), F.col("risk_score").cast("string"), F.lit("/100")),
            F.concat(F.lit("Risk level: "), "risk_level"),
            F.concat(F.lit("Threats found: "), F.col("threats_found").cast("string")),
            F.concat(F.lit("Threat details: "), shown),
            F.lit("Answer with one JSON object: verdict, confidence, summary_en, summary_ar, key_risks, "
                  "recommendation, recommendation_ar, technical_details.")).alias("prompt"))


VERDICT_SCHEMA = ("verdict string, confidence int, summary_en string, summary_ar string, key_risks array<string>, "
                  "recommendation string, recommendation_ar string, technical_details string")


def parse_verdict_responses(df: DataFrame, col: str = "response") -> DataFrame:
    """Add ``analysis`` (verdict struct) read from a model's answer.

    The JSON may sit in a ``json`` or plain code fence. Missing fields take
    their defaults; an answer without a JSON object is UNKNOWN at 50.
    """
    raw = F.col(col)
    tagged = F.get(F.split(F.get(F.split(raw, "```json", 2), F.lit(1)), "```", 2), F.lit(0))
    plain = F.get(F.split(raw, "```", 3), F.lit(1))
    body = F.trim(F.when(F.contains(raw, F.lit("```json")), tagged)
                  .when(F.contains(raw, F.lit("```")), plain).otherwise(raw))
    df = df.withColumn("_body", F.regexp_replace(body, r"^\s+|\s+$", ""))
    ok = F.schema_of_variant(F.try_parse_json("_body")).startswith("OBJECT")
    df = df.withColumn("_ok", F.coalesce(ok, F.lit(False))).withColumn(
        "_a", F.from_json("_body", VERDICT_SCHEMA))
    text = lambda name: F.coalesce(F.col(f"_a.{name}"), F.lit("")).alias(name)
    return (df.withColumn("analysis", F.struct(
        F.when(~F.col("_ok"), "UNKNOWN").otherwise(F.coalesce("_a.verdict", F.lit("SUSPICIOUS"))).alias("verdict"),
        F.coalesce("_a.confidence", F.lit(50)).alias("confidence"),
        text("summary_en"), text("summary_ar"),
        F.coalesce("_a.key_risks", F.array().cast("array<string>")).alias("key_risks"),
        text("recommendation"), text("recommendation_ar"), text("technical_details")))
        .drop("_body", "_ok", "_a"))
