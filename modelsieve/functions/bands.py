"""Named score bands. Each policy keeps its own thresholds; never mix them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values: (comparison, bound, label) in test order, then the label for the
# rest; ``null`` is the label of a missing score.
POLICIES: dict[str, dict] = {
    "engine": {"steps": [("<=", 0, "clean"), ("<", 40, "suspicious"), ("<", 70, "malicious")],
               "rest": "critical"},
    "sdk": {"steps": [("<", 30, "clean"), ("<", 60, "suspicious"), ("<", 85, "malicious")],
            "rest": "critical"},
    "inspector": {"steps": [("<=", 10, "clean"), ("<=", 40, "suspicious"), ("<=", 70, "malicious")],
                  "rest": "critical"},
    "badge_label": {"steps": [("<", 30, "clean"), ("<", 60, "suspicious"), ("<", 85, "dangerous")],
                    "rest": "critical", "null": "unknown"},
    "badge_color": {"steps": [("<", 30, "#2ECC71"), ("<", 60, "#E67E22"), ("<", 85, "#E74C3C")],
                    "rest": "#C0392B", "null": "#9f9f9f"},
    "cve": {"steps": [(">=", 9, "critical"), (">=", 7, "high"), (">=", 4, "medium")],
            "rest": "low", "null": "none"},
    "verdict": {"steps": [("<", 30, "SAFE"), ("<", 60, "SUSPICIOUS"), ("<", 85, "DANGEROUS")],
                "rest": "CRITICAL"},
}

# Ranks used to sort findings; anything else ranks 0.
SEVERITY_RANK = {"critical": 4, "high": 3, "medium": 2, "low": 1}


def band(score: Column, policy: str) -> Column:
    """Label of ``score`` under one of the named policies."""
    spec = POLICIES[policy]
    label = F.when(score.isNull(), F.lit(spec.get("null")))
    compare = {"<": lambda b: score < b, "<=": lambda b: score <= b, ">=": lambda b: score >= b}
    for op, bound, name in spec["steps"]:
        label = label.when(compare[op](bound), name)
    return label.otherwise(spec["rest"])


def severity_rank(severity: Column) -> Column:
    rank = F.lit(0)
    for name, value in SEVERITY_RANK.items():
        rank = F.when(F.lower(severity) == name, value).otherwise(rank)
    return rank
