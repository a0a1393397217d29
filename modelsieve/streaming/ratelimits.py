"""Requests over the limit per client and endpoint, in tumbling windows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Requests allowed and window, per endpoint.
LIMITS = {"scan_file": (10, "1 minute"), "scan_url": (5, "1 minute"), "key_generate": (3, "1 hour")}
WATERMARK = "10 minutes"


def rate_limit_audit(requests: DataFrame, limits: dict[str, tuple[int, str]] | None = None) -> DataFrame:
    """Windows in which an address exceeded an endpoint's limit.

    The same code runs in batch and on a stream (append mode); counts are
    reduced map-side. On a stream a window is reported once the watermark has
    passed its end.
    """
    limits = limits or LIMITS
    if requests.isStreaming:
        requests = requests.withWatermark("ts", WATERMARK)
    parts = []
    for span in sorted({w for _, w in limits.values()}):
        allowed = {e: n for e, (n, w) in limits.items() if w == span}
        cap = F.create_map(*[F.lit(x) for kv in allowed.items() for x in kv])[F.col("endpoint")]
        counts = (requests.filter(F.col("endpoint").isin(list(allowed)))
                  .groupBy(F.window("ts", span), "ip", "endpoint").agg(F.count("*").alias("requests")))
        parts.append(counts.select(
            F.col("window.start").alias("window_start"), "ip", "endpoint", "requests",
            (F.col("requests") - cap).alias("over")).filter("over > 0"))
    return reduce(DataFrame.unionByName, parts)
