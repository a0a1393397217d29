"""Stored tables: typed reads, idempotent appends, failed scans replaced by later results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

THREAT = "struct<pattern:string,severity:string,description:string,location:string,category:string>"

# Column names and types of the stored relations.
SCHEMAS: dict[str, str] = {
    "scans": (
        "scan_id string, filename string, file_size bigint, file_extension string, file_hash string, "
        f"risk_score double, risk_level string, threats array<{THREAT}>, threats_found bigint, "
        "metadata_info map<string,string>, ai_verdict string, ai_confidence int, ai_summary_en string, "
        "ai_summary_ar string, ai_key_risks array<string>, ai_recommendation_en string, "
        "ai_recommendation_ar string, source_type string, source_url string, ip_address string, "
        "user_agent string, is_public boolean, created_at timestamp, user_id string, scan_status string, "
        "scan_date date"),
    "threat_patterns": (
        "pattern string, severity string, category string, description_en string, description_ar string, "
        "times_detected int, is_active boolean, created_at timestamp"),
    "api_keys": (
        "key_hash string, key_prefix string, name string, email string, scans_used int, scans_limit int, "
        "is_active boolean, created_at timestamp, last_used timestamp"),
    "cve_records": (
        "cve_id string, description string, cvss_score double, published_date timestamp, affected_tech string, "
        "created_at timestamp"),
    "ioc_records": "file_hash string, severity string, reporter_id string, is_verified boolean, reported_at timestamp",
    "webhook_subscriptions": (
        "id bigint, user_id string, url string, secret_token string, events array<string>, is_active boolean, "
        "created_at timestamp"),
    "webhook_logs": (
        "id bigint, subscription_id bigint, event_type string, payload string, response_status int, "
        "response_body string, triggered_at timestamp"),
    "users": (
        "id string, email string, username string, display_name string, avatar_url string, provider string, "
        "provider_id string, plan string"),
    "progress": "scan_id string, stage string, progress int, message string, threat_count int, timestamp timestamp",
    "errors": "scan_id string, path string, error string, scan_date date",
    # one row per try of a file that a queue ordered
    "attempts": "artifact_id string, attempt int, status string, error string, path string",
    "dead_letters": "artifact_id string, path string, filename string, attempts int, error string",
    # one row per finding, for scans of any size
    "findings": ("scan_id string, type string, pattern_id string, category string, offset bigint, severity string, cvss_score double, "
                 "cvss_vector string, desc string, size int, entropy double, ordinal bigint, scan_status string, scan_date date"),
}

def schema_of(name: str) -> T.StructType:
    return T.StructType.fromDDL(SCHEMAS[name])


def read_table(spark: SparkSession, name: str, path: str, fmt: str = "parquet", **options) -> DataFrame:
    """Read a stored relation with its declared schema; nothing is inferred.

    Stored scans are read in their latest version: see ``latest_scans``. ``fmt="jdbc"`` reads the same relation from a database
    (pass url, dbtable and the partitioning options), which keeps one row per scan itself.
    """
    if fmt == "jdbc":
        declared = schema_of(name)
        rows = spark.read.format("jdbc").options(**options).load()
        return rows.select(*[F.col(f.name).cast(f.dataType) for f in declared if f.name in rows.columns])
    rows = read_versions(spark, name, path, fmt, **options)
    return latest_scans(rows) if name == "scans" else rows


def read_versions(spark: SparkSession, name: str, path: str, fmt: str = "parquet", **options) -> DataFrame:
    """All stored rows of a relation, earlier versions included."""
    return spark.read.schema(schema_of(name)).format(fmt).options(**options).load(path)


def _failed(rows: DataFrame) -> Column:
    return F.coalesce(rows["scan_status"] == "error", F.lit(False))


def latest_scans(versions: DataFrame) -> DataFrame:
    """One row per scan: a failed one is replaced by the result of a later try.

    A scan has at most two stored rows, so nothing but ids meets: failed scans, which are few, look for a finished row of theirs. A
    reader beside a writer sees either version of a scan, never both or none.
    """
    done = versions.filter(~_failed(versions))
    failed = versions.filter(_failed(versions))
    later = done.select(F.col("scan_id").alias("_id"), F.col("scan_date").alias("_date"))
    repaired = F.col("scan_id").eqNullSafe(F.col("_id")) & F.col("scan_date").eqNullSafe(F.col("_date"))
    return done.unionByName(failed.join(later, repaired, "left_anti"))


def conform(df: DataFrame, name: str) -> DataFrame:
    """Columns of ``df`` in the order and types of a relation; absent ones are null."""
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
                       for f in schema_of(name)])


def path_exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def append_new(df: DataFrame, name: str, path: str, key: str, partition: str | None = None) -> None:
    """Append the rows whose ``key`` is not stored yet, each key once.

    A rerun of the same input adds nothing. With ``partition`` (a column that
    follows from the key) only the touched partitions are read for the check.
    """
    spark = df.sparkSession
    rows = conform(df, name).dropDuplicates([key])
    if path_exists(spark, path):
        stored = read_versions(spark, name, path)
        if partition:
            stored = _between(stored, rows, partition)
        rows = rows.join(stored.select(key), key, "left_anti")
    writer = rows.write.mode("append")
    (writer.partitionBy(partition) if partition else writer).parquet(path)


def _between(stored: DataFrame, rows: DataFrame, partition: str) -> DataFrame:
    """Stored rows of the days that ``rows`` touch; rows without a date lie in a partition of their own."""
    span = rows.agg(F.min(partition), F.max(partition)).first()
    return stored.filter(F.col(partition).isNull() | F.col(partition).between(span[0], span[1]))


def _append_details(rows: DataFrame, name: str, path: str, keys: list[str]) -> None:
    """Store detail rows by day, where none are stored for their ``keys`` yet."""
    spark = rows.sparkSession
    rows = conform(rows, name)
    if path_exists(spark, path):
        known = _between(read_versions(spark, name, path), rows, "scan_date").select(*keys).distinct()
        rows = rows.join(known, keys, "left_anti")
    rows.write.mode("append").partitionBy("scan_date").parquet(path)


def append_findings(findings: DataFrame, scans: DataFrame, path: str) -> None:
    """Store the findings of ``scans`` (scan_id, created_at, scan_status), once for each status of a scan."""
    dated = scans.select("scan_id", F.to_date("created_at").alias("scan_date"), F.coalesce("scan_status", F.lit("completed")).alias("scan_status"))
    _append_details(findings.withColumnRenamed("artifact_id", "scan_id").join(dated, "scan_id"), "findings", path, ["scan_id", "scan_status"])


def read_findings(spark: SparkSession, findings_path: str, scans_path: str) -> DataFrame:
    """Stored findings of the latest version of each scan."""
    current = read_table(spark, "scans", scans_path).select("scan_id", F.coalesce("scan_status", F.lit("completed")).alias("scan_status"))
    return read_versions(spark, "findings", findings_path).join(current, ["scan_id", "scan_status"], "left_semi")


def append_errors(errors: DataFrame, path: str) -> None:
    """Store (artifact_id, path, error, scan_date) rows."""
    _append_details(errors.withColumnRenamed("artifact_id", "scan_id"), "errors", path, ["scan_id"])


def append_results(results: DataFrame, path: str) -> None:
    """Store scans by day: finished ones once per ``scan_id``, failed ones once and only while there is no finished row.

    So a failed scan that is tried again successfully becomes a finished one for every reader, and a replay of any batch, also
    of an older one, adds nothing. The scan id is derived from the file version, and ``created_at`` is the file's own time,
    so the day of a scan never changes between tries.
    """
    spark = results.sparkSession
    rows = conform(results.withColumn("scan_date", F.to_date("created_at")), "scans")
    rows = rows.withColumn("_failed", _failed(rows)).dropDuplicates(["scan_id", "_failed"])
    if path_exists(spark, path):
        stored = _between(read_versions(spark, "scans", path), rows, "scan_date")
        known = stored.select(F.col("scan_id").alias("_id"), _failed(stored).alias("_was"))
        rows = rows.join(known, (F.col("scan_id") == F.col("_id")) & (~F.col("_was") | F.col("_failed")), "left_anti")
    rows.drop("_failed").write.mode("append").partitionBy("scan_date").parquet(path)
