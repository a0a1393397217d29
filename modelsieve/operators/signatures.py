"""Engine-profile signatures: catalogue, hits with offsets, counts."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field
from re import _parser

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from modelsieve.functions.cvss import with_base_score
from modelsieve.functions.matching import Rule, find_matches

METRICS = ["av", "ac", "pr", "ui", "s", "c", "i", "a"]


@dataclass(frozen=True)
class Signature:
    id: str
    category: str
    regex: str
    severity: str
    metrics: str                # CVSS base vector
    desc: str
    anchor: str | None = field(default=None)

    def rule(self) -> Rule:
        return Rule(self.id, self.regex, self.anchor or required_literal(self.regex))

    def letters(self) -> list[str]:
        """Values of the metrics in the order of ``METRICS``."""
        return [part.split(":")[1] for part in self.metrics.split("/")]


def required_literal(regex: str) -> str | None:
    """The longest run of ASCII literals that every match of ``regex`` holds in one piece, at least three long; else None."""
    runs, run = [], ""
    todo = list(reversed(list(_parser.parse(regex, re.IGNORECASE))))
    while todo:
        kind, value = todo.pop()
        if kind is _parser.LITERAL and value < 128:
            run += chr(value)
            continue
        if kind is _parser.SUBPATTERN and not value[1] and not value[2]:
            todo += reversed(list(value[3]))
            continue
        runs, run = [*runs, run], ""
    longest = max([*runs, run], key=len)
    return longest if len(longest) >= 3 else None


# CODE-003 names each module once; naming one again would change nothing.
# The engine's signature list (id, category, regex, severity,
# metrics, description) with the literal each match must contain.
WRITTEN = [
    Signature("CODE-001", "code_execution", r"eval\s*\(", "critical", "AV:L/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H",
              "Usage of Python eval() for dynamic execution.", "eval"),
    Signature("CODE-002", "code_execution", r"exec\s*\(", "critical", "AV:L/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H",
              "Usage of Python exec() for dynamic code execution.", "exec"),
    Signature("CODE-003", "code_execution",
              r"""__import__\s*\(\s*['"](?:os|sys|subprocess|pty|ptyprocess|shlex|socket)['"]""",
              "high", "AV:L/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H", "Dynamic import of dangerous system modules.", "__import__"),
    Signature("CODE-004", "code_execution", r"compile\s*\(", "high", "AV:L/AC:H/PR:N/UI:N/S:U/C:H/I:H/A:H",
              "Usage of compile() to prepare dynamic strings for execution.", "compile"),
    Signature("CMD-001", "command_injection", r"os\.system\s*\(", "critical", "AV:L/AC:L/PR:N/UI:N/S:C/C:H/I:H/A:H",
              "Direct OS command execution.", "os.system"),
    Signature("CMD-002", "command_injection",
              r"subprocess\.(?:call|check_call|check_output|Popen|run)\s*\(", "critical", "AV:L/AC:L/PR:N/UI:N/S:C/C:H/I:H/A:H",
              "Subprocess command execution.", "subprocess."),
    Signature("CMD-003", "command_injection", r"os\.popen\s*\(", "high", "AV:L/AC:L/PR:N/UI:N/S:C/C:H/I:H/A:H",
              "OS popen process spawning.", "os.popen"),
    Signature("CMD-004", "command_injection", r"pty\.spawn\s*\(", "critical", "AV:L/AC:L/PR:N/UI:N/S:C/C:H/I:H/A:H",
              "PTY shell spawning (common in reverse shells).", "pty.spawn"),
    Signature("PKL-001", "deserialization_exploit", r"__reduce__", "critical", "AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H",
              "Presence of __reduce__ method which controls pickle reconstruction.", "__reduce__"),
    Signature("PKL-002", "deserialization_exploit", r"__reduce_ex__", "critical", "AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H",
              "Presence of __reduce_ex__ method.", "__reduce_ex__"),
    Signature("YAML-001", "deserialization_exploit", r"yaml\.load\s*\(", "high", "AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H",
              "Unsafe YAML loading.", "yaml.load"),
    Signature("NET-001", "network_exfiltration", r"urllib\.request\.urlopen\s*\(", "medium", "AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:N/A:N",
              "Fetching external network resources.", "urllib.request.urlopen"),
    Signature("NET-002", "network_exfiltration", r"requests\.(?:get|post|put|delete|head)\s*\(", "medium",
              "AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:N/A:N", "HTTP requests to external servers.", "requests."),
    Signature("NET-003", "network_exfiltration", r"socket\.socket\s*\(", "high", "AV:N/AC:L/PR:N/UI:N/S:C/C:H/I:H/A:H",
              "Raw socket creation (common in reverse shells).", "socket.socket"),
    Signature("OBF-001", "obfuscation_payload", r"base64\.b64decode\s*\(", "medium", "AV:L/AC:H/PR:N/UI:N/S:U/C:H/I:H/A:H",
              "Decoding base64 encoded strings, often used for payloads.", "base64.b64decode"),
    Signature("OBF-002", "obfuscation_payload", r"codecs\.decode\s*\(", "medium", "AV:L/AC:H/PR:N/UI:N/S:U/C:H/I:H/A:H",
              "Decoding using codecs (e.g., rot13, hex).", "codecs.decode"),
    Signature("OBF-003", "obfuscation_payload", r"zlib\.decompress\s*\(", "low", "AV:L/AC:H/PR:N/UI:N/S:U/C:L/I:N/A:N",
              "Decompressing packed payloads.", "zlib.decompress"),
]
# Modules whose import is a signature of its own.
MODULES = ["pty", "shlex", "subprocess", "os", "sys", "socket",
           "urllib", "requests", "httplib", "ftplib", "smtplib", "telnetlib"]


def _import_signatures() -> list[Signature]:
    made = []
    for number, module in enumerate(MODULES, start=100):
        for prefix, text, kind in (("DYN-MOD", f"import {module}", "import"),
                                   ("DYN-FROM", f"from {module} import", "from-import")):
            made.append(Signature(f"{prefix}-{number}", "code_execution", text, "high", "AV:L/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H",
                                  f"Explicit {kind} of dangerous module '{module}'.", text))
    return made


SIGNATURES: list[Signature] = WRITTEN + _import_signatures()


def signature_catalog(spark: SparkSession, signatures: Sequence[Signature] = SIGNATURES) -> DataFrame:
    """The catalogue as rows, in matching order, with its CVSS default score."""
    rows = [(k, s.id, s.category, s.regex, s.severity, tuple(s.letters()), s.desc)
            for k, s in enumerate(signatures)]
    schema = ("position int, id string, category string, pattern string, severity string, "
              "default_cvss struct<" + ",".join(f"{m}:string" for m in METRICS) + ">, desc string")
    return with_base_score(spark.createDataFrame(rows, schema).coalesce(1), "default_cvss")


def signatures_from(catalog: DataFrame) -> list[Signature]:
    """Read a user's catalogue rows (id, category, pattern, severity, default_cvss, desc), all of them."""
    return [Signature(r["id"], r["category"], r["pattern"], r["severity"],
                      "/".join(f"{m.upper()}:{r['default_cvss'][m]}" for m in METRICS), r["desc"]) for r in catalog.collect()]


def signature_hits(chunks: DataFrame, signatures: Sequence[Signature] | DataFrame = SIGNATURES) -> DataFrame:
    """One finding per match, with the byte offset of its start.

    Chunks must bring enough shared context for a match to end in; the readers
    in ``sources.artifacts`` extend it over whitespace runs for that reason.
    """
    if isinstance(signatures, DataFrame):
        signatures = signatures_from(signatures)
    signatures = list(signatures)
    catalog = signature_catalog(chunks.sparkSession, signatures).select(
        F.col("position").alias("rule_no"), "category", "severity", "cvss_score", "cvss_vector", "desc")
    hits = find_matches(chunks, [s.rule() for s in signatures])
    return (hits.join(catalog, "rule_no")
            .select("artifact_id", F.lit("pattern_match").alias("type"),
                    F.col("rule_id").alias("pattern_id"), "category", "offset", "severity",
                    "cvss_score", "cvss_vector", "desc", "rule_no"))


def signature_hit_counts(findings: DataFrame) -> DataFrame:
    return (findings.groupBy("artifact_id", "pattern_id", "category", "severity")
            .agg(F.count("*").alias("hits")))
