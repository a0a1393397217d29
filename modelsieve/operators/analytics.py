"""Reports over the scan table. All of them aggregate map-side first."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modelsieve.functions.bands import band

LEVELS = ["clean", "suspicious", "malicious", "critical"]
BAD = ["malicious", "critical"]


def _level_is(*names: str) -> Column:
    return F.coalesce(F.col("risk_level").isin(*names), F.lit(False))


def platform_stats(scans: DataFrame) -> DataFrame:
    return scans.agg(
        F.count("*").alias("total"),
        *[F.count_if(_level_is(level)).alias(level) for level in LEVELS],
        F.coalesce(F.round(F.avg("risk_score"), 1), F.lit(0.0)).alias("avg_risk_score"))


def overview(scans: DataFrame) -> DataFrame:
    return scans.agg(F.count("*").alias("total_scans"),
                     F.count_if(_level_is(*BAD)).alias("threats_found"),
                     F.count_if(_level_is("clean")).alias("clean_models"))


def threat_statistics(scans: DataFrame, cves: DataFrame, iocs: DataFrame) -> DataFrame:
    """Counts of three tables in one row; here everything not malicious counts as clean."""
    part = lambda df, bad, cve, ioc: df.select(
        F.lit(1 if bad is not None else 0).alias("s"), (bad if bad is not None else F.lit(False)).alias("b"),
        F.lit(cve).alias("c"), F.lit(ioc).alias("i"))
    rows = (part(scans, _level_is(*BAD), 0, 0).unionByName(part(cves, None, 1, 0))
            .unionByName(part(iocs, None, 0, 1)))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    bad = F.count_if("b")
    return rows.agg(total("s").alias("total_scans"), bad.alias("malicious_scans"),
                    (total("s") - bad).alias("clean_scans"),
                    total("c").alias("total_cves"), total("i").alias("total_iocs"))


def recent_scans(scans: DataFrame, n: int = 10) -> DataFrame:
    """Newest ``n`` public scans (1 to 50); ties by id."""
    if not 1 <= n <= 50:
        raise ValueError("n must lie between 1 and 50")
    return (scans.filter("is_public")
            .select("scan_id", "filename", "risk_score", "risk_level",
                    F.coalesce(F.nullif("ai_verdict", F.lit("")), F.lit("UNKNOWN")).alias("verdict"),
                    F.coalesce(F.size("threats"), F.lit(0)).alias("threats_count"), "created_at")
            .withColumn("threats_count", F.greatest("threats_count", F.lit(0)))
            .orderBy(F.desc_nulls_first("created_at"), "scan_id").limit(n))


def _or(name: str, default) -> Column:
    col = F.col(name)
    return F.coalesce(F.nullif(col, F.lit("")) if isinstance(default, str) else col, F.lit(default))


# Stored column and the name it is shown under.
TEXT_FIELDS = {"ai_summary_en": "summary_en", "ai_summary_ar": "summary_ar", "ai_recommendation_en": "recommendation",
               "ai_recommendation_ar": "recommendation_ar"}


def scan_detail(ids: DataFrame, scans: DataFrame) -> DataFrame:
    """Requested scans with a default for every empty field; ``found`` is false for unknown ids."""
    absent = {c: F.lit(None).cast(kind) for c, kind in {"metadata_info": "map<string,string>", "source_url": "string",
                                                        "ai_key_risks": "array<string>", **dict.fromkeys(TEXT_FIELDS, "string")}.items()
              if c not in scans.columns}
    rows = scans.withColumns(absent).withColumn("_found", F.lit(True))
    return ids.join(rows, "scan_id", "left").select(
        "scan_id", F.coalesce("_found", F.lit(False)).alias("found"),
        "filename", "risk_score", "risk_level",
        F.when(F.col("_found"), F.coalesce("threats", F.array())).alias("threats"),
        "created_at",
        F.when(F.col("_found"), _or("ai_verdict", "UNKNOWN")).alias("verdict"),
        F.when(F.col("_found"), _or("ai_confidence", 0)).alias("confidence"),
        F.when(F.col("_found"), F.coalesce("metadata_info", F.create_map().cast("map<string,string>"))).alias("metadata"),
        "source_url", *[F.when(F.col("_found"), _or(stored, "")).alias(shown) for stored, shown in TEXT_FIELDS.items()],
        F.when(F.col("_found"), F.coalesce("ai_key_risks", F.array().cast("array<string>"))).alias("key_risks"))


PERIOD_DAYS = {"1d": 1, "30d": 30, "90d": 90, "1y": 365}


def daily_trend(scans: DataFrame, period: str, now: datetime) -> DataFrame:
    """Safe and threat counts per day, days without scans included.

    An unknown period means seven days. No rows come back when nothing falls
    into the period.
    """
    days = PERIOD_DAYS.get(period, 7)
    end = F.lit(now)
    start = F.timestamp_add("DAY", F.lit(-days), end)
    counts = (scans.filter(F.col("created_at") >= start)
              .groupBy(F.to_date("created_at").alias("day"))
              .agg(F.count_if(_level_is("clean", "suspicious")).alias("safe"),
                   F.count_if(_level_is(*BAD)).alias("threats")))
    # At most 367 days lie in the range, so the counts fit one map, from which
    # the day list is filled without reading the scans again.
    in_range = F.when(F.col("day") <= F.to_date(end), F.struct("day", F.struct("safe", "threats")))
    by_day = counts.agg(F.count("*").alias("n"), F.map_from_entries(F.collect_list(in_range)).alias("m"))
    spine = by_day.filter("n > 0").select("m", F.explode(F.sequence(F.to_date(start), F.to_date(end))).alias("day"))
    cell = F.try_element_at("m", F.col("day"))
    return spine.select(F.date_format("day", "yyyy-MM-dd").alias("date"),
                        F.coalesce(cell["safe"], F.lit(0)).alias("safe"),
                        F.coalesce(cell["threats"], F.lit(0)).alias("threats"))


def level_pivot_by_day(scans: DataFrame) -> DataFrame:
    """Day by level counts; rows without a level or day are left out."""
    return (scans.filter("risk_level is not null and created_at is not null")
            .groupBy(F.date_format("created_at", "yyyy-MM-dd").alias("date"))
            .agg(*[F.count_if(_level_is(level)).alias(level) for level in LEVELS]))


def threats_by_extension(scans: DataFrame) -> DataFrame:
    """Malicious scans per extension. Missing and empty stay two groups, both shown as unknown."""
    return (scans.filter(_level_is(*BAD)).groupBy("file_extension").agg(F.count("*").alias("value"))
            .select(F.coalesce(F.nullif("file_extension", F.lit("")), F.lit("unknown")).alias("name"), "value"))


# Label, level and colour of the four severity bars.
SEVERITY_BARS = [("Critical", "critical", "#E74C3C"), ("High/Malicious", "malicious", "#E67E22"),
                 ("Medium/Suspicious", "suspicious", "#F1C40F"), ("Low/Clean", "clean", "#2ECC71")]


def severity_distribution(scans: DataFrame) -> DataFrame:
    counts = scans.agg(*[F.count_if(_level_is(level)).alias(level) for _, level, _ in SEVERITY_BARS])
    return counts.select(F.explode(F.array(*[F.struct(
        F.lit(name).alias("name"), F.col(level).alias("count"), F.lit(fill).alias("fill"))
        for name, level, fill in SEVERITY_BARS])).alias("b")).select("b.*")


def traffic_by_ip(scans: DataFrame, n: int = 100) -> DataFrame:
    """Busiest ``n`` addresses (a top-k report), ties by address."""
    return (scans.filter("ip_address is not null").groupBy("ip_address")
            .agg(F.count("*").alias("scans")).orderBy(F.desc("scans"), "ip_address").limit(n))


def compare_scans(pairs: DataFrame, scans: DataFrame) -> DataFrame:
    """Pairs (scan_a, scan_b) side by side; a pair is dropped when either side is missing."""
    slim = scans.select("scan_id", F.coalesce("risk_score", F.lit(100.0)).alias("score"), "risk_level",
                        F.greatest(F.coalesce(F.size("threats"), F.lit(0)), F.lit(0)).alias("n"))
    side = lambda s: slim.select(F.col("scan_id").alias(f"scan_{s}"), F.col("score").alias(f"{s}_score"),
                                 F.col("risk_level").alias(f"{s}_level"), F.col("n").alias(f"{s}_threat_count"))
    return (pairs.join(side("a"), "scan_a").join(side("b"), "scan_b")
            .withColumn("safer", F.when(F.col("a_score") <= F.col("b_score"), F.col("scan_a"))
                        .otherwise(F.col("scan_b")))
            .withColumn("risk_difference", F.abs(F.col("a_score") - F.col("b_score"))))


# Badge colours by level.
BADGE_COLORS = {"clean": "brightgreen", "suspicious": "yellow", "malicious": "orange", "critical": "red"}


def badge_rows(scans: DataFrame, label: str = "modelsieve") -> DataFrame:
    colors = F.create_map(*[F.lit(x) for kv in BADGE_COLORS.items() for x in kv])
    color = F.coalesce(F.get(F.array(colors[F.col("risk_level")]), F.lit(0)), F.lit("lightgrey"))
    return scans.select(
        "scan_id", F.to_json(F.struct(
            F.lit(1).alias("schemaVersion"), F.lit(label).alias("label"), F.col("risk_level").alias("message"),
            color.alias("color"), F.lit("shield").alias("namedLogo"))).alias("payload"),
        band(F.col("risk_score"), "badge_label").alias("score_label"),
        band(F.col("risk_score"), "badge_color").alias("score_color"))


def report_rows(results: DataFrame) -> DataFrame:
    """One row per threat as printed in a report; a placeholder row without threats."""
    t = results.select("scan_id", F.posexplode_outer("threats").alias("pos", "t"))
    fields = t.schema["t"].dataType.fieldNames()
    pick = lambda *names: F.coalesce(*[F.col(f"t.{n}") for n in names if n in fields], F.lit(None))
    title = F.initcap(F.replace(F.coalesce(pick("category"), F.lit("Unknown")), F.lit("_"), F.lit(" ")))
    some = F.col("t").isNotNull()
    return t.select(
        "scan_id", F.coalesce("pos", F.lit(0)).alias("pos"),
        F.when(some, title).alias("category"), F.when(some, F.upper(pick("severity"))).alias("severity"),
        F.when(some, pick("pattern", "type")).alias("pattern"),
        F.when(some, pick("description", "desc"))
         .otherwise("No malicious threats or dangerous patterns were identified in this file.")
         .alias("description"))


def policy_gate(results: DataFrame, batch: str = "batch", fail_on_critical: bool = True,
                fail_on_dangerous: bool = False) -> DataFrame:
    """Pass or fail per batch, as an exit code would say."""
    levels = (["critical"] if fail_on_critical else []) + (BAD if fail_on_dangerous else [])
    failing = _level_is(*levels) if levels else F.lit(False)
    return (results.groupBy(batch).agg(F.count("*").alias("scans"), F.count_if(failing).alias("failing"))
            .withColumn("exit_code", F.when(F.col("failing") > 0, 1).otherwise(0)))
