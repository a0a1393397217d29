"""CVSS base scores as column arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modelsieve.functions.once import computed_once

# Metric weights of CVSS v3.1 (public specification, section 7.4).
ATTACK_VECTOR = {"N": 0.85, "A": 0.62, "L": 0.55, "P": 0.20}
ATTACK_COMPLEXITY = {"L": 0.77, "H": 0.44}
PRIVILEGES_UNCHANGED = {"N": 0.85, "L": 0.62, "H": 0.27}
PRIVILEGES_CHANGED = {"N": 0.85, "L": 0.68, "H": 0.50}
USER_INTERACTION = {"N": 0.85, "R": 0.62}
IMPACT = {"H": 0.56, "L": 0.22, "N": 0.0}
# What a missing metric counts as.
DEFAULTS = {"av": "L", "ac": "L", "pr": "N", "ui": "N", "s": "U", "c": "H", "i": "H", "a": "H"}


def _weight(metric: Column, weights: dict[str, float]) -> Column:
    return F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])[metric]


def _tenths_up(n: Column, mode: str) -> Column:
    """Score in 1/100000 units, raised to the next tenth in integer arithmetic.

    ``spec`` follows Appendix A of the public specification. ``reference`` keeps
    a known deviation: anything that is not a whole number first gains a tenth
    and is then cut, so exact tenths such as 8.4 may end one step higher.
    """
    if mode == "spec":
        return F.when(n % 10000 == 0, n).otherwise(n - n % 10000 + 10000)
    raised = F.when(n % 100000 == 0, n).otherwise(n + 10000)
    return raised - raised % 10000


def with_base_score(df: DataFrame, metrics: str, mode: str = "reference") -> DataFrame:
    """Add cvss_score, cvss_severity and cvss_vector of the metric struct column.

    Missing metrics take their defaults. Every stage is evaluated once per row.
    """
    if mode not in ("reference", "spec"):
        raise ValueError(f"unknown CVSS mode: {mode}")
    given = F.col(metrics)
    df = computed_once(df, _m=F.struct(*[F.coalesce(given[k], F.lit(v)).alias(k) for k, v in DEFAULTS.items()]))
    m = {k: F.col(f"_m.{k}") for k in DEFAULTS}
    unchanged = m["s"] == "U"
    privileges = F.when(unchanged, _weight(m["pr"], PRIVILEGES_UNCHANGED)).otherwise(
        _weight(m["pr"], PRIVILEGES_CHANGED))
    df = computed_once(
        df,
        _exploit=F.lit(8.22) * _weight(m["av"], ATTACK_VECTOR) * _weight(m["ac"], ATTACK_COMPLEXITY)
        * privileges * _weight(m["ui"], USER_INTERACTION),
        _iss=1 - ((1 - _weight(m["c"], IMPACT)) * (1 - _weight(m["i"], IMPACT)) * (1 - _weight(m["a"], IMPACT))))
    iss = F.col("_iss")
    # The deviation kept in reference mode multiplies where the standard subtracts.
    correction = F.pow(iss - 0.02 if mode == "spec" else iss * 0.02, 15)
    df = computed_once(df, _impact=F.when(unchanged, 6.42 * iss).otherwise(
        7.52 * (iss - 0.029) - 3.25 * correction))
    both = F.col("_impact") + F.col("_exploit")
    total = F.least(F.when(unchanged, both).otherwise(1.08 * both), F.lit(10.0)) * 100000
    df = computed_once(df, _n=(F.round(total) if mode == "spec" else total).cast("bigint"))
    df = computed_once(df, cvss_score=F.when(F.col("_impact") <= 0, 0.0).otherwise(
        _tenths_up(F.col("_n"), mode) / 100000))
    return (df.withColumn("cvss_severity", severity_of(F.col("cvss_score")))
            .withColumn("cvss_vector", vector_of(m))
            .drop("_m", "_exploit", "_iss", "_impact", "_n"))


def severity_of(score: Column) -> Column:
    return (F.when(score == 0, "none").when(score <= 3.9, "low").when(score <= 6.9, "medium")
            .when(score <= 8.9, "high").otherwise("critical"))


def vector_of(m: dict[str, Column]) -> Column:
    parts = [F.concat(F.lit(f"/{k.upper()}:"), m[k]) for k in DEFAULTS]
    return F.concat(F.lit("CVSS:3.1"), *parts)

