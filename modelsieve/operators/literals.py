"""SDK literals (presence only) and inspector pickle rules (weighted counts)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modelsieve.functions.matching import Rule, find_matches

# Pattern, severity, category, description.
SDK_LITERALS = [
    ("os.system", "critical", "code_execution", "System command execution"),
    ("subprocess", "high", "code_execution", "External process execution"),
    ("eval", "critical", "code_execution", "Dynamic code evaluation"),
    ("exec", "critical", "code_execution", "Code execution function"),
    ("pickle.loads", "high", "deserialization", "Unsafe pickle deserialization"),
    ("__reduce__", "critical", "deserialization", "Pickle execution hook"),
    ("import os", "high", "system_access", "OS module import"),
    ("shutil", "medium", "file_operations", "File system operations"),
    ("base64", "medium", "obfuscation", "Potential code obfuscation"),
    ("socket", "high", "network", "Network socket access"),
    ("requests", "medium", "network", "HTTP request capability"),
    ("urllib", "medium", "network", "URL access capability"),
    ("__import__", "high", "code_execution", "Dynamic import"),
    ("ctypes", "critical", "system_access", "Low-level system access"),
]


def literal_presence(df: DataFrame, literals: list[tuple[str, str, str, str]] = SDK_LITERALS,
                     chunked: bool = False) -> DataFrame:
    """One threat per literal present, case-sensitive, searched in the raw bytes.

    A table with one row per artifact needs no shuffle. With ``chunked`` the
    same literal may show in several chunks, so hits are reduced per artifact.
    """
    threats = F.array(*[
        F.when(F.contains(F.col("content"), F.lit(p.encode())), F.struct(
            F.lit(k).alias("ordinal"), F.lit(p).alias("pattern"), F.lit(s).alias("severity"),
            F.lit(c).alias("category"), F.lit(d).alias("description")))
        for k, (p, s, c, d) in enumerate(literals)])
    hits = (df.select("artifact_id", F.explode(F.array_compact(threats)).alias("t"))
            .select("artifact_id", "t.*"))
    return hits.dropDuplicates(["artifact_id", "pattern"]) if chunked else hits


# Label, regex, description, weight.
PICKLE_RULES = [
    ("os.system", r"os\.system", "System command execution via os.system", 15.0),
    ("subprocess", r"subprocess", "Process spawning via subprocess module", 15.0),
    ("exec", r"\bexec\b", "Dynamic code execution via exec()", 15.0),
    ("eval", r"\beval\b", "Dynamic expression evaluation via eval()", 15.0),
    ("__reduce_ex__", r"__reduce_ex__",
     "Custom deserialization hook — allows arbitrary code execution on unpickle", 40.0),
    ("__reduce__", r"__reduce__",
     "Custom deserialization hook — allows arbitrary code execution on unpickle", 40.0),
    ("socket", r"\bsocket\b", "Network socket operations", 15.0),
    ("requests", r"\brequests\b", "HTTP requests via requests library", 15.0),
    ("urllib", r"\burllib\b", "URL operations via urllib", 15.0),
    ("base64", r"\bbase64\b", "Base64 encoding/decoding — may hide obfuscated payloads", 15.0),
]


def weighted_pattern_counts(chunks: DataFrame) -> DataFrame:
    """Occurrences of each inspector rule per artifact, with its weight.

    When both reduce hooks occur, the plain one is lowered by the count of the
    other and dropped at zero, although its regex never matches the other.
    """
    rules = [Rule(label, regex, label, ignore_case=False, text=True) for label, regex, _, _ in PICKLE_RULES]
    labels = [r.rule_id for r in rules]
    sums = [F.count_if(F.col("rule_no") == k).alias(f"_n{k}") for k in range(len(rules))]
    per_artifact = find_matches(chunks, rules).groupBy("artifact_id").agg(*sums)
    ex, plain = (F.col(f"_n{labels.index(x)}") for x in ("__reduce_ex__", "__reduce__"))
    entries = F.array(*[
        F.struct(F.lit(k).alias("rule_no"), F.lit(label).alias("pattern"),
                 (plain - ex if label == "__reduce__" else F.col(f"_n{k}")).alias("hits"),
                 F.lit(weight).alias("weight"), F.lit(text).alias("description"),
                 F.lit("malicious" if weight >= 40 else "suspicious").alias("severity"))
        for k, (label, _, text, weight) in enumerate(PICKLE_RULES)])
    return (per_artifact.select("artifact_id", F.explode(F.filter(entries, lambda e: e["hits"] > 0)).alias("e"))
            .select("artifact_id", "e.*"))
