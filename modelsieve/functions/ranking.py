"""Ranks inside groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BUCKET_SPAN = 1 << 20


def rank_in_group(df: DataFrame, key: str, lead: Column, ordinal: str,
                  out: str = "rank", ties: list[str] | None = None, span: int = BUCKET_SPAN) -> DataFrame:
    """1-based position in ``key`` by ``lead`` descending, then ``ordinal`` (null last), then ``ties``.

    Rows with a null key are a group like any other.

    A plain window would sort each group in one task, and one group may hold a
    third of all rows. Here groups are cut into (lead, ordinal range) buckets:
    rows are numbered inside a bucket, and each bucket starts after the sizes of
    those before it. Only the small bucket table is windowed by ``key``. Choose
    ``span`` so that this many consecutive ordinals hold at most some million
    findings of one group; for byte offsets that is a chunk.
    """
    place = F.coalesce(F.col(ordinal), F.lit((1 << 63) - 1))
    cut = df.withColumn("_lead", lead).withColumn("_bucket", place - F.pmod(place, F.lit(span).cast("bigint")))
    names = [key, "_lead", "_bucket"]
    earlier = (Window.partitionBy(key).orderBy(F.desc("_lead"), "_bucket")
               .rowsBetween(Window.unboundedPreceding, -1))
    starts = (cut.groupBy(*names).agg(F.count("*").alias("_n"))
              .withColumn("_start", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
              .drop("_n"))
    inside = Window.partitionBy(*names).orderBy(F.col(ordinal).asc_nulls_last(), *(ties or []))
    starts = starts.withColumnsRenamed({n: f"{n}_of" for n in names})
    same = [cut[n].eqNullSafe(starts[f"{n}_of"]) for n in names]
    return (cut.join(starts, same).drop(*[f"{n}_of" for n in names])
            .withColumn(out, (F.col("_start") + F.row_number().over(inside)).cast("bigint"))
            .drop("_lead", "_bucket", "_start"))
