"""Webhook outbox over the stream of finished scans."""

from __future__ import annotations

from pyspark.sql import DataFrame

from modelsieve.operators.notify import scan_events, webhook_fanout


def stream_outbox(results: DataFrame, subs: DataFrame) -> DataFrame:
    """Signed outbox rows of a result stream (append mode, stateless stream-static join).

    ``subs`` is a stored table, re-read by every micro-batch.
    """
    return webhook_fanout(scan_events(results), subs)
