"""Evaluate shared expressions once per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def computed_once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns behind a one-row generator.

    The optimizer does not inline through it, so an expression used by many
    later ones is evaluated once per row and generated code stays small.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))
