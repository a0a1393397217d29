"""Route artifacts to the detectors of their format and union the findings."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modelsieve.functions.matching import match_offsets, whole_content, with_candidates
from modelsieve.operators.admission import extension, format_of, magic_check
from modelsieve.operators.entropy import (BLOCK, MIN_BLOCK, MIN_FILE, ONNX_BLOCK, THRESHOLD,
                                          block_entropies, text_entropy)
from modelsieve.operators.gguf import gguf_metadata, gguf_metadata_rules
from modelsieve.operators.literals import literal_presence, weighted_pattern_counts
from modelsieve.operators.onnx import onnx_ops
from modelsieve.operators.pickles import opcode_findings, pickle_ops
from modelsieve.operators.safetensors import (ENGINE_URL, metadata_rules, metadata_values,
                                              safetensors_header, safetensors_header_rules)
from modelsieve.operators.signatures import SIGNATURES, Signature, signature_catalog
from modelsieve.operators.templates import block_findings, template_blocks

# Findings are ordered by phase (signatures, structure, entropy), rule, offset.
SIGNATURE_PHASE, STRUCTURE_PHASE, ENTROPY_PHASE, ERROR_PHASE, FACT_PHASE = 0, 1, 2, 3, 4
READ_ERROR = "read_error"
FILE_FACTS = "file_facts"
MOST_RULES = 10 ** 6

FINDING_COLUMNS = {
    "artifact_id": None, "type": "string", "pattern_id": "string", "category": "string",
    "offset": "bigint", "severity": "string", "cvss_score": "double", "cvss_vector": "string",
    "desc": "string", "size": "int", "entropy": "double", "ordinal": "bigint"}


def _ordinal(phase: int, rule: Column, offset: Column) -> Column:
    """One sortable number; offsets stay below 10^12 and rules below ``MOST_RULES``."""
    return (F.lit(phase * MOST_RULES * 10 ** 12).cast("bigint") + rule.cast("bigint") * 10 ** 12 + offset.cast("bigint"))


def as_findings(df: DataFrame, phase: int, rule: Column | None = None) -> DataFrame:
    rule = rule if rule is not None else F.lit(0)
    df = df.withColumn("ordinal", _ordinal(phase, rule, F.coalesce("offset", F.lit(0))))
    return df.select(*[
        F.col(name) if name in df.columns and kind is None
        else (F.col(name) if name in df.columns else F.lit(None)).cast(kind).alias(name)
        for name, kind in FINDING_COLUMNS.items()])


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def safetensors_findings(df: DataFrame) -> DataFrame:
    """Engine rules on the header: malformed, high-entropy value, URL."""
    state = safetensors_header(df)
    malformed = state.filter("status = 'malformed'").select(
        "artifact_id", F.lit("malformed_safetensors").alias("type"),
        F.lit("obfuscation_payload").alias("category"), F.lit(0).alias("offset"),
        F.lit("low").alias("severity"), F.lit(3.3).alias("cvss_score"),
        F.lit("CVSS:3.1/AV:L/AC:L/PR:N/UI:N/S:U/C:N/I:N/A:L").alias("cvss_vector"),
        F.lit("SafeTensors header is malformed").alias("desc"))
    values = text_entropy(metadata_values(df), "value")
    url = F.regexp_extract("value", ENGINE_URL, 0)
    finding = lambda kind, cat, sev, score, vector, desc: F.struct(
        F.lit(kind).alias("type"), F.lit(cat).alias("category"), F.lit(sev).alias("severity"),
        F.lit(score).alias("cvss_score"), F.lit(vector).alias("cvss_vector"), desc.alias("desc"))
    hits = values.select("artifact_id", F.explode(F.array_compact(F.array(
        F.when(F.col("flagged"), finding(
            "high_entropy_metadata", "obfuscation_payload", "high", 7.5,
            "CVSS:3.1/AV:L/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H",
            F.format_string("High entropy string found in metadata field '%s'. Possible hidden payload.", "key"))),
        F.when(url != "", finding(
            "suspicious_url_metadata", "network_exfiltration", "medium", 5.5,
            "CVSS:3.1/AV:L/AC:L/PR:N/UI:N/S:U/C:L/I:L/A:N",
            F.concat(F.lit("External URL found in metadata: "), url)))))).alias("f"))
    return union_all([malformed, hits.select("artifact_id", F.lit(8).alias("offset"), "f.*")])


def read_errors(df: DataFrame, message: str = "error") -> DataFrame:
    """Rows that could not be read as findings of their own type; they score nothing and mark the artifact."""
    return df.filter(F.col(message).isNotNull()).select(
        "artifact_id", F.lit(READ_ERROR).alias("type"), F.lit(0).alias("offset"), F.col(message).alias("desc"))


def byte_findings(chunks: DataFrame, signatures: Sequence[Signature] = SIGNATURES) -> DataFrame:
    """Signatures and entropy in one pass: each chunk is read once and crosses to
    Python once, where only rules with a present anchor are matched.

    Chunks with a ``file_hash`` also give a row FILE_FACTS with format and hash, so that the pass over the bytes is the only one.
    """
    signatures = list(signatures)
    if len(signatures) > MOST_RULES:
        raise ValueError(f"a catalogue holds at most {MOST_RULES} rules")
    rules = [s.rule() for s in signatures]
    # a SafeTensors file too short for its length field is not scanned at all
    scanned = (F.col("format") != "safetensors") | (F.col("file_len") >= 8)
    block = (F.when((F.col("format") == "safetensors") | (F.col("file_len") < MIN_FILE), 0)
             .when(F.col("format") == "onnx", ONNX_BLOCK).otherwise(BLOCK))
    given = lambda name: F.col(name) if name in chunks.columns else F.lit(None).cast("string")
    chunks = chunks.withColumns({"_error": given("error"), "_hash": given("file_hash")})
    seen = (with_candidates(chunks.withColumn("content", F.when(scanned, F.col("content")).otherwise(F.lit(b""))), rules).withColumn("_block", block)
            .filter((F.size("_rules") > 0) | (F.col("_block") > 0) | F.col("_error").isNotNull() | F.col("_hash").isNotNull())
            .select("artifact_id", "format", "_hash", "_block", "own_len", "_error", (F.col("base_offset") + F.col("own_start")).alias("_at"),
                    match_offsets(rules)("content", "base_offset", "own_start", "own_len", "_rules").alias("_m"),
                    block_entropies("content", "own_start", "own_len", "_block").alias("_e")))
    none = F.lit(None)
    row = lambda phase, rule, offset, size, bits: F.struct(
        F.lit(phase).alias("phase"), rule.cast("int").alias("rule_no"), offset.cast("bigint").alias("offset"),
        size.cast("int").alias("size"), bits.cast("double").alias("bits"))
    matches = F.transform("_m", lambda m: row(SIGNATURE_PHASE, m["rule"], m["start"], none, none))
    blocks = F.filter(F.transform("_e", lambda bits, i: row(
        ENTROPY_PHASE, F.lit(0), F.col("_at") + i * F.col("_block"),
        F.least(F.col("_block"), F.col("own_len") - i * F.col("_block")), bits)),
        lambda b: (b["bits"] > THRESHOLD) & (b["size"] >= MIN_BLOCK))
    failed = F.when(F.col("_error").isNotNull(), F.array(row(ERROR_PHASE, F.lit(0), F.col("_at"), none, none))).otherwise(F.array())
    facts = F.when(F.col("_hash").isNotNull(), F.array(row(FACT_PHASE, F.lit(0), F.lit(0), none, none))).otherwise(F.array())
    own = ("artifact_id", "format", "_hash", "_error")
    hits = seen.select(*own, F.explode(F.concat(matches, blocks, failed, facts)).alias("h")).select(*own, "h.*")
    catalog = signature_catalog(chunks.sparkSession, signatures).select(
        F.lit(SIGNATURE_PHASE).alias("phase"), F.col("position").alias("rule_no"),
        F.col("id").alias("pattern_id"), "category", "severity", "cvss_score", "cvss_vector", "desc")
    named = hits.join(catalog, ["phase", "rule_no"], "left")
    is_error = F.col("phase") == ERROR_PHASE
    is_block = F.col("phase") == ENTROPY_PHASE
    is_fact = F.col("phase") == FACT_PHASE
    bits = F.round("bits", 3)
    return named.select(
        "artifact_id", F.when(is_error, READ_ERROR).when(is_fact, FILE_FACTS).when(is_block, "possible_encrypted_payload")
        .otherwise("pattern_match").alias("type"),
        F.when(is_fact, F.col("format")).otherwise(F.col("pattern_id")).alias("pattern_id"), "category", "offset",
        F.when(is_block, "high").otherwise(F.col("severity")).alias("severity"),
        "cvss_score", "cvss_vector",
        F.when(is_error, F.col("_error")).when(is_fact, F.col("_hash"))
         .when(is_block, F.format_string("High entropy chunk detected (%s). Possible encrypted payload.",
                                         bits.cast("string"))).otherwise(F.col("desc")).alias("desc"),
        F.col("size"), bits.alias("entropy"),
        (F.col("phase") * F.lit(MOST_RULES * 10 ** 12).cast("bigint") + F.col("rule_no") * F.lit(10 ** 12).cast("bigint")
         + F.col("offset")).alias("ordinal"))


def engine_findings(chunks: DataFrame, ops: DataFrame, templates: DataFrame, onnx: DataFrame, safetensors: DataFrame,
                    chunked: bool, signatures: Sequence[Signature] = SIGNATURES) -> DataFrame:
    """Union of the engine detectors. Inputs with an ``error`` column, and opcode rows READ_ERROR, give
    ``read_error`` rows.

    ``chunks`` (of all formats, with ``format``) feed the byte-level detectors;
    ``ops`` are walked opcodes of the pickle route; ``onnx`` holds chunks of that
    format; ``templates`` are the template blocks of GGUF artifacts; ``safetensors`` has the header in ``content``.
    """
    return union_all([byte_findings(chunks, signatures).select(*FINDING_COLUMNS), structure_findings(ops, templates, onnx, safetensors, chunked)])


def structure_findings(ops: DataFrame, templates: DataFrame, onnx: DataFrame, safetensors: DataFrame, chunked: bool) -> DataFrame:
    """The engine detectors beside the byte-level ones; inputs as in ``engine_findings``."""
    onnx = onnx_ops(onnx, chunked)
    opcodes = opcode_findings(ops)
    failed = [read_errors(ops.filter("op = 'READ_ERROR'"), "arg")]
    failed += [read_errors(df) for df in (templates, safetensors) if "error" in df.columns]
    return union_all([
        as_findings(opcodes, STRUCTURE_PHASE, F.col("rule_no")),
        as_findings(block_findings(templates), STRUCTURE_PHASE),
        as_findings(onnx, STRUCTURE_PHASE, F.col("rule_no")),
        as_findings(safetensors_findings(safetensors), STRUCTURE_PHASE),
        *[as_findings(f, ERROR_PHASE) for f in failed]])


def _engine_table(df: DataFrame) -> DataFrame:
    routed = whole_content(df.withColumn("format", format_of(F.col("content"), F.col("filename"))))
    return engine_findings(
        routed, pickle_ops(routed.filter("format in ('pickle', 'unknown')")),
        template_blocks(routed.filter("format = 'gguf'")), routed.filter("format = 'onnx'"),
        routed.filter("format = 'safetensors'"), chunked=False)


def inspector_findings(heads: DataFrame, pickle_chunks: DataFrame, kv: DataFrame, tensors: DataFrame) -> DataFrame:
    """Weighted findings (artifact_id, type, severity, pattern, hits, weight).

    ``heads`` hold at least the first 16 bytes of all but SafeTensors files,
    ``pickle_chunks`` the bytes of the pickle family, ``kv`` decoded GGUF pairs and
    ``tensors`` the headers of SafeTensors files.
    """
    shape = lambda part, **named: part.select(
        "artifact_id", *[named.get(c, F.col(c) if c in part.columns else F.lit(None).cast(t)).cast(t).alias(c)
                         for c, t in (("type", "string"), ("severity", "string"), ("pattern", "string"),
                                      ("hits", "bigint"), ("weight", "double"))])
    short = heads.filter((extension(F.col("filename")) == ".gguf") & (F.octet_length("content") < 16))
    return union_all([
        shape(magic_check(heads)),
        shape(weighted_pattern_counts(pickle_chunks), type=F.lit("dangerous_pattern")),
        shape(gguf_metadata_rules(kv)),
        shape(short, type=F.lit("read_error"), severity=F.lit("suspicious"), weight=F.lit(5.0)),
        shape(safetensors_header_rules(tensors)),
        shape(metadata_rules(tensors).filter("profile = 'inspector'"))])


def _inspector_table(df: DataFrame) -> DataFrame:
    df = whole_content(df.withColumn("_ext", extension(F.col("filename"))))
    return inspector_findings(
        df.filter("_ext <> '.safetensors'"), df.filter("_ext in ('.pkl', '.pickle', '.pt', '.pth')"),
        gguf_metadata(df.filter("_ext = '.gguf'")), df.filter("_ext = '.safetensors'"))


def _sdk_table(df: DataFrame) -> DataFrame:
    return literal_presence(df)


PROFILES = {"engine": _engine_table, "sdk": _sdk_table, "inspector": _inspector_table}


def scan_corpus(artifacts: DataFrame, profile: str = "engine") -> DataFrame:
    """Findings of a table (artifact_id, filename, content) under one profile."""
    if profile not in PROFILES:
        raise ValueError(f"unknown profile: {profile}")
    return PROFILES[profile](artifacts)
