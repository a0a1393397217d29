"""Threat intelligence: vulnerability feed, indicators, pattern catalogue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modelsieve.operators.literals import SDK_LITERALS

# Feed keywords, in the order that decides ``affected_tech``.
KEYWORDS = ["pickle", "pytorch", "tensorflow", "keras", "huggingface",
            "safetensors", "gguf", "onnx", "machine learning model"]
DEFAULT_ID, DEFAULT_TEXT = "UNKNOWN", "No description available."

_METRIC = "array<struct<cvssData:struct<baseScore:double>>>"
ITEM_SCHEMA = (
    "struct<cve:struct<id:string,published:string,descriptions:array<struct<lang:string,value:string>>,"
    f"metrics:struct<cvssMetricV31:{_METRIC},cvssMetricV30:{_METRIC},cvssMetricV2:{_METRIC}>>>")


def cve_parse(feed: DataFrame, item: str = "item") -> DataFrame:
    """Flatten typed feed items; other columns pass through.

    The score comes from the newest metric version present, first entry; a
    present metric without a score gives null and no older version is tried.
    """
    cve = F.col(item)["cve"]
    english = F.get(F.filter(cve["descriptions"], lambda d: d["lang"] == "en"), F.lit(0))
    # a missing English text takes the default, an English entry without value stays null
    text = F.when(english.isNull(), F.lit(DEFAULT_TEXT)).otherwise(english["value"])
    first = lambda name: F.get(cve["metrics"][name], F.lit(0))["cvssData"]["baseScore"]
    versions = ["cvssMetricV31", "cvssMetricV30", "cvssMetricV2"]
    score = F.lit(None).cast("double")
    for name in reversed(versions):
        score = F.when(cve["metrics"][name].isNotNull(), first(name)).otherwise(score)
    rest = [c for c in feed.columns if c != item]
    return feed.select(*rest, F.coalesce(cve["id"], F.lit(DEFAULT_ID)).alias("cve_id"),
                       text.alias("description"), score.alias("cvss_score"),
                       F.try_to_timestamp(cve["published"]).alias("published_date"))


def keyword_position(keyword: Column) -> Column:
    order = F.array_position(F.array(*[F.lit(k) for k in KEYWORDS]), keyword)
    return F.when(order == 0, len(KEYWORDS) + 1).otherwise(order)


def cve_merge(existing: DataFrame, parsed: DataFrame) -> DataFrame:
    """Rows to insert: unseen ids, each once, tagged by its first keyword.

    "First" is a map-side ``min_by``, not a window, so an id repeated without
    end costs one row per task. Stored rows are never updated.
    """
    fields = ["cve_id", "description", "cvss_score", "published_date"]
    firsts = parsed.groupBy("cve_id").agg(F.min_by(
        F.struct(*fields[1:], F.col("keyword").alias("affected_tech")),
        F.struct(keyword_position(F.col("keyword")), "pos")).alias("r"))
    return firsts.select("cve_id", "r.*").join(existing.select("cve_id"), "cve_id", "left_anti")


def cve_recent(cves: DataFrame, n: int = 50) -> DataFrame:
    """Newest ``n`` (a top-k report); undated rows come first, ties by id."""
    return cves.orderBy(F.desc_nulls_first("published_date"), "cve_id").limit(n)


def cve_search(cves: DataFrame, term: str = "") -> DataFrame:
    """Rows whose id, description or technology contains ``term``, ignoring case."""
    if not term:
        return cves
    needle = F.lit(term.lower())
    return cves.filter(F.contains(F.lower("cve_id"), needle) | F.contains(F.lower("description"), needle)
                       | F.coalesce(F.contains(F.lower("affected_tech"), needle), F.lit(False)))


def cve_by_id(cves: DataFrame, cve_id: str) -> DataFrame:
    return cves.filter(F.col("cve_id") == cve_id)


def ioc_lookup(hashes: DataFrame, iocs: DataFrame) -> DataFrame:
    """Every looked-up hash with found or clean; verification state does not matter."""
    known = iocs.select("file_hash", "severity", "is_verified", "reported_at", F.lit(True).alias("_hit"))
    return (hashes.join(known, "file_hash", "left")
            .withColumn("status", F.when(F.col("_hit"), "found").otherwise("clean")).drop("_hit"))


def ioc_merge(iocs: DataFrame, reports: DataFrame) -> DataFrame:
    """Each report with ``status`` success (to be stored) or ignored.

    ``reports`` need file_hash, severity, reporter_id, reported_at and a unique
    ``report_id`` giving their order. The first report of an unseen hash wins.
    """
    firsts = reports.groupBy("file_hash").agg(F.min("report_id").alias("_first"))
    known = iocs.select("file_hash", F.lit(True).alias("_known"))
    unseen = firsts.join(known, "file_hash", "left_anti").select(F.col("_first").alias("report_id"),
                                                                 F.lit(True).alias("_new"))
    # the win is keyed by report id, so copies of one hash never meet in one task
    return (reports.join(unseen, "report_id", "left")
            .withColumn("severity", F.coalesce("severity", F.lit("malicious")))
            .withColumn("is_verified", F.lit(False))
            .withColumn("status", F.when(F.col("_new"), "success").otherwise("ignored")).drop("_new"))


# The built-in patterns are the SDK literals with a second text each.
SECOND_TEXTS = [
    "تنفيذ أوامر النظام",
    "تشغيل عمليات خارجية",
    "تنفيذ كود ديناميكي",
    "دالة تنفيذ الكود",
    "تحميل pickle غير آمن",
    "خطاف تنفيذ pickle",
    "استيراد وحدة النظام",
    "عمليات نظام الملفات",
    "إخفاء الكود المحتمل",
    "الوصول للشبكة",
    "قدرة طلب HTTP",
    "قدرة الوصول للروابط",
    "استيراد ديناميكي",
    "وصول منخفض للنظام",
]
BUILTIN_PATTERNS = [(*literal, text) for literal, text in zip(SDK_LITERALS, SECOND_TEXTS, strict=True)]


def pattern_catalog_active(patterns: DataFrame) -> DataFrame:
    """Active patterns, most detected first; the built-in list when there are none."""
    columns = ["pattern", "severity", "category", "description_en", "description_ar"]
    active = patterns.filter("is_active").select(*columns, "times_detected", F.lit("database").alias("source"))
    # the count is one row; it unfolds into the built-in list only when it is zero
    rows = F.array(*[F.struct(*[F.lit(x).alias(c) for c, x in zip(columns, row)]) for row in BUILTIN_PATTERNS])
    fallback = (active.agg(F.count("*").alias("n")).filter("n = 0").select(F.inline(rows))
                .withColumns({"times_detected": F.lit(None).cast("bigint"), "source": F.lit("builtin")}))
    return active.unionByName(fallback).orderBy(F.desc_nulls_last("times_detected"), "pattern")


def pattern_detection_counts(findings: DataFrame, patterns: DataFrame) -> DataFrame:
    """Detections of each catalogue pattern, zero included."""
    counts = findings.groupBy("pattern").agg(F.count("*").alias("times_detected"))
    return (patterns.select("pattern").distinct().join(counts, "pattern", "left")
            .withColumn("times_detected", F.coalesce("times_detected", F.lit(0))))
