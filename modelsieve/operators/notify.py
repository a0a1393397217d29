"""Usage and notifications."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from modelsieve.functions.hashing import hmac_pads, hmac_sha256
from modelsieve.functions.once import computed_once
from modelsieve.session import shared_dir
from modelsieve.sources.tables import path_exists


def key_usage(presented: DataFrame, keys: DataFrame, usage: DataFrame) -> DataFrame:
    """Check presented raw keys (request_id, raw_key) against active keys.

    ``used`` is counted from the usage log (key_hash per use), reduced to one
    row per key before it meets the keys.
    """
    used = usage.groupBy("key_hash").agg(F.count("*").alias("scans_used"))
    active = keys.filter("is_active").join(used, "key_hash", "left").select(
        "key_hash", "name", "scans_limit", F.coalesce("scans_used", F.lit(0)).alias("scans_used"))
    return (presented.withColumn("key_hash", F.sha2("raw_key", 256)).join(active, "key_hash", "left")
            .select("request_id", F.col("name").isNotNull().alias("valid"), "name", "scans_used", "scans_limit",
                    (F.col("scans_limit") - F.col("scans_used")).alias("scans_remaining")))


def scan_events(results: DataFrame) -> DataFrame:
    """Events of finished scans that have a user: completed always, critical too when it is."""
    done = F.struct(F.lit("scan.completed").alias("event_type"), F.to_json(F.struct(
        "scan_id", F.coalesce("risk_level", F.lit("clean")).alias("risk_level"))).alias("payload"))
    critical = F.when(F.col("risk_level") == "critical", F.struct(
        F.lit("threat.critical").alias("event_type"),
        F.to_json(F.struct("scan_id", F.coalesce("threats", F.array()).alias("threats"))).alias("payload")))
    return (results.filter("user_id is not null")
            .select("scan_id", "user_id", F.explode(F.array_compact(F.array(done, critical))).alias("e"))
            .select("scan_id", "user_id", "e.*"))


def webhook_fanout(events: DataFrame, subs: DataFrame) -> DataFrame:
    """Outbox: each event for each active subscription of its user that listens to it.

    Both sides may be large. The join is by user id with the strategy left to
    AQE, which broadcasts measured-small subscriptions and splits hot users.
    """
    listening = computed_once(
        subs.filter("is_active").select(F.col("id").alias("subscription_id"), F.col("user_id").alias("_user"),
                                        "url", "secret_token", "events"),
        _pads=hmac_pads(F.encode("secret_token", "UTF-8"))).drop("secret_token")
    wanted = F.array_contains("events", F.col("event_type")) | F.array_contains("events", "all")
    return (events.join(listening, (events.user_id == F.col("_user")) & wanted)
            .select("scan_id", "user_id", "subscription_id", "url", "event_type", "payload",
                    hmac_sha256(F.col("_pads"), F.encode("payload", "UTF-8")).alias("signature")))


def delivery_log(logs: DataFrame, subs: DataFrame, n: int = 50, user: str | None = None) -> DataFrame:
    """Newest ``n`` delivery attempts per user (a top-k report), with the target url.

    The rank filter is applied per task before the shuffle (window group
    limit), so a user with very many attempts sends at most ``n`` rows per task.
    """
    owned = subs.select(F.col("id").alias("subscription_id"), "user_id", "url")
    if user is not None:
        owned = owned.filter(F.col("user_id") == user)
    joined = logs.join(owned, "subscription_id").select(
        "user_id", "id", "url", "event_type", "response_status", "triggered_at")
    order = [F.desc("triggered_at"), F.desc("id")]
    if user is not None:
        return joined.orderBy(*order).limit(n)
    newest = Window.partitionBy("user_id").orderBy(*order)
    return joined.withColumn("rank", F.row_number().over(newest)).filter(F.col("rank") <= n)


def profile_merge(users: DataFrame, incoming: DataFrame, newest: str | None = None) -> DataFrame:
    """Keyed upsert by email.

    Of several incoming rows of an email the one with the greatest ``newest`` wins (nulls last), ties and the lack of such a column
    falling to the greatest values; one winner per email and task is all that is shuffled. Incoming rows without an
    email are left out. Stored users without an email stay as they are, and each stored user of an email is updated.

    Name and picture change only to non-empty values, the provider id always;
    new rows start on the free plan and take their username from the email.
    """
    fields = ["username", "display_name", "avatar_url", "provider", "provider_id"]
    order = F.struct(*([newest] if newest else []), *[F.coalesce(c, F.lit("")) for c in fields])
    winners = (incoming.filter("email IS NOT NULL").groupBy("email").agg(F.max_by(F.struct(*fields), order).alias("_w"))
               .select("email", "_w.*", F.lit(True).alias("_new")))
    old, new = users.withColumn("_old", F.lit(True)).alias("o"), winners.alias("n")
    fresh = F.col("o._old").isNull()
    seen = F.col("n._new").isNotNull()
    keep = lambda c: F.coalesce(F.nullif(F.col(f"n.{c}"), F.lit("")), F.col(f"o.{c}")).alias(c)
    name = F.coalesce(F.nullif(F.col("n.username"), F.lit("")), F.substring_index("n.email", "@", 1))
    return old.join(new, F.col("o.email") == F.col("n.email"), "full").select(
        F.coalesce("o.email", "n.email").alias("email"),
        F.when(fresh, name).otherwise(F.col("o.username")).alias("username"),
        keep("display_name"), keep("avatar_url"),
        F.when(fresh, F.col("n.provider")).otherwise(F.col("o.provider")).alias("provider"),
        F.when(seen, F.col("n.provider_id")).otherwise(F.col("o.provider_id")).alias("provider_id"),
        F.when(fresh, "free").otherwise(F.col("o.plan")).alias("plan"),
        F.when(fresh, "inserted").when(seen, "updated").otherwise("kept").alias("change"))


PROFILE = ("email", "username", "display_name", "avatar_url", "provider", "provider_id", "plan")


def upsert_profiles(incoming: DataFrame, path: str, newest: str | None = None, buckets: int = 64) -> None:
    """Merge profiles into a stored table, of which only the buckets that hold an incoming email are read and rewritten.

    The table is partitioned by a hash of the email; ``buckets`` belongs to the table and may not change. Merging the same rows again
    changes nothing. One writer at a time.
    """
    spark = incoming.sparkSession
    of = F.pmod(F.xxhash64("email"), F.lit(buckets)).cast("int").alias("bucket")
    rows = incoming.filter("email IS NOT NULL")
    touched = [r["bucket"] for r in rows.select(of).distinct().collect()]   # at most ``buckets`` numbers
    schema = ", ".join(f"{c} string" for c in PROFILE)
    if path_exists(spark, path):
        users = spark.read.schema(f"{schema}, bucket int").parquet(path).filter(F.col("bucket").isin(touched)).drop("bucket")
    else:
        users = spark.createDataFrame([], schema)
    merged = profile_merge(users, rows, newest).select(*PROFILE)
    staged = f"{shared_dir(spark, 'profiles')}/merged"
    merged.select("*", of).write.parquet(staged)
    # What is overwritten was read before, into the staged table.
    (spark.read.schema(f"{schema}, bucket int").parquet(staged).repartition("bucket").write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path))
