"""Streams give the rows their batch forms give."""

import hashlib
import json
import time
from datetime import datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from modelsieve.operators.notify import scan_events, webhook_fanout
from modelsieve.plans.corpus import inspect_files, scan_files, sdk_scan
from modelsieve.plans.registry import QUERIES
from modelsieve.sources import derived as v
from modelsieve.sources.artifacts import artifact_manifest, with_ids
from modelsieve.sources.feeds import read_cve_feed
from modelsieve.sources.tables import read_table
from modelsieve.streaming.cve import cve_incremental
from modelsieve.streaming.outbox import stream_outbox
from modelsieve.streaming.progress import latest_stage, open_scan_changes, progress_state
from modelsieve.streaming.ratelimits import rate_limit_audit
from modelsieve.streaming.scan import stream_scan
from modelsieve.streaming.stats import start_active_scans, start_live_stats
from tests.conftest import SF

FILES = {"evil.pkl": b"\x80\x02cos\nsystem\n(X\x01\x00\x00\x00xtR. eval(", "ok.safetensors": b"\x02\0\0\0\0\0\0\0{}",
         "chat.gguf": b"GGUF {{ os.system('x') }}", "known.pt": b"bad bytes", "net.onnx": b"\x08onnx PyOp"}


def write(folder, items):
    folder.mkdir(parents=True, exist_ok=True)
    for name, data in items.items():
        (folder / name).write_bytes(data)


@pytest.fixture
def iocs(spark, tmp_path):
    path = str(tmp_path / "iocs")
    digest = hashlib.sha256(FILES["known.pt"]).hexdigest()
    spark.createDataFrame([(digest, "low", None, False, None)],
                          "file_hash string, severity string, reporter_id string, is_verified boolean, "
                          "reported_at timestamp").write.parquet(path)
    return path


def test_corpus_scan(spark, tmp_path, iocs):
    write(tmp_path / "in", FILES)
    manifest = artifact_manifest(spark, str(tmp_path / "in"), exts=("pkl", "safetensors", "gguf", "pt", "onnx"))
    scan = scan_files(spark, manifest, read_table(spark, "ioc_records", iocs))
    rows = {r["filename"]: r for r in scan.results.collect()}
    assert {k: (r["risk_level"], r["risk_score"]) for k, r in rows.items()} == {
        "evil.pkl": ("critical", 98), "ok.safetensors": ("clean", 0), "chat.gguf": ("critical", 100),
        "known.pt": ("critical", 100), "net.onnx": ("critical", 98)}
    assert [t["pattern"] for t in rows["known.pt"]["threats"]] == ["IOC-BLACKLIST"]
    assert {t["pattern"] for t in rows["evil.pkl"]["threats"]} == {"CODE-001", "unsafe_global", "reduce_execution"}
    assert {t["pattern"] for t in rows["chat.gguf"]["threats"]} == {"CMD-001", "ssti_risk"}
    assert scan.errors.count() == 0 and rows["evil.pkl"]["metadata"]["file_type"] == "pickle"


def test_sdk_and_inspector_profiles_over_files(spark, tmp_path):
    write(tmp_path / "in", FILES | {"short.gguf": b"GGU", "pre.pkl": b"\x80\x04 __reduce__ \xe9eval eval"})
    manifest = artifact_manifest(spark, str(tmp_path / "in"))
    threats, results = sdk_scan(manifest)
    rows = {r["filename"]: (r["risk_score"], r["risk_level"], r["verdict"], r["is_safe"]) for r in results.collect()}
    # evil.pkl holds "eval" only: 30 + 35
    assert rows["evil.pkl"] == (65, "malicious", "DANGEROUS", False)
    assert rows["ok.safetensors"] == (3, "clean", "SAFE", True) and rows["pre.pkl"][0] == 100
    assert threats.filter("pattern = 'os.system'").count() == 1
    findings, scored = inspect_files(manifest)
    levels = {r["artifact_id"]: (r["risk_score"], r["risk_level"]) for r in scored.collect()}
    named = {r["filename"]: levels[r["artifact_id"]] for r in with_ids(manifest).collect()}
    assert named == {"evil.pkl": (15.0, "suspicious"), "ok.safetensors": (5.0, "clean"),
                     "chat.gguf": (0.0, "clean"), "known.pt": (10.0, "clean"),
                     "short.gguf": (35.0, "suspicious"), "pre.pkl": (55.0, "malicious")}
    assert findings.filter("type = 'valid_magic'").count() == 3
    noted = {r["type"] for r in findings.filter("message is not null").collect()}
    assert "format_safety" in noted and noted <= {"format_safety", "header_info", "chat_template_found"}


def test_stream_scan_appends_once(spark, tmp_path, iocs):
    src, out, ckpt = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "ckpt")
    write(src, {k: FILES[k] for k in ("evil.pkl", "known.pt")})
    stream_scan(spark, str(src), out, ckpt, iocs).awaitTermination(300)
    write(src, {"ok.safetensors": FILES["ok.safetensors"]})
    stream_scan(spark, str(src), out, ckpt, iocs).awaitTermination(300)
    # a lost checkpoint replays everything, the store does not grow
    stream_scan(spark, str(src), out, str(tmp_path / "ckpt2"), iocs).awaitTermination(300)
    rows = read_table(spark, "scans", out + "/scans").collect()
    assert sorted((r["filename"], r["risk_level"]) for r in rows) == [
        ("evil.pkl", "critical"), ("known.pt", "critical"), ("ok.safetensors", "clean")]


def slices(spark, df, folder, n, order):
    """Write ``df`` as ``n`` files in ``order``, one per later micro-batch."""
    rows = df.withColumn("_s", F.ntile(n).over(Window.orderBy(order)))
    for k in range(1, n + 1):
        rows.filter(F.col("_s") == k).drop("_s").coalesce(1).write.mode("append").parquet(str(folder))
        time.sleep(1.1)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def test_progress_state_equals_batch(spark, tmp_path):
    events = v.v_progress(spark, SF)
    stream = slices(spark, events, tmp_path / "ev", 3, "seq")
    got = []
    query = (progress_state(stream).writeStream.outputMode("update")
             .foreachBatch(lambda b, i: got.append({r["scan_id"]: tuple(r) for r in b.collect()}))
             .option("checkpointLocation", str(tmp_path / "ck")).start())
    want = {r["scan_id"]: tuple(r) for r in latest_stage(events).select(
        "scan_id", "stage", "progress", "timestamp", "closed").collect()}
    final, deadline = {}, time.time() + 90
    # pending timers keep the query awake, so it is stopped once all slices are in
    while time.time() < deadline and (len([b for b in got if b]) < 3 or final != want):
        time.sleep(0.5)
        final = {}
        for batch in list(got):
            final |= batch
    query.stop()
    assert final == want


def test_progress_in_any_order_ends_and_counts_open_scans(spark, tmp_path):
    """Shuffled arrival gives the batch result, availableNow ends, and a late older event reopens nothing."""
    events = v.v_progress(spark, SF).withColumn("late", F.pmod(F.xxhash64("seq"), F.lit(1000)))
    stream = slices(spark, events, tmp_path / "ev", 3, "late")
    final = {}

    def take(batch, _):
        final.update({r["scan_id"]: tuple(r) for r in batch.collect()})

    query = (progress_state(stream, "60 days").writeStream.outputMode("update").foreachBatch(take)
             .option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start())
    assert query.awaitTermination(150)
    want = {r["scan_id"]: tuple(r) for r in latest_stage(events).select(
        "scan_id", "stage", "progress", "timestamp", "closed").collect()}
    assert final == want


def test_open_scans_survive_a_restart(spark, tmp_path):
    """Events without a time or number are no news; after a restart the count goes on from what the state store holds."""
    columns = "scan_id string, stage string, progress int, timestamp timestamp, seq long"
    at = lambda k: datetime(2024, 1, 1, 0, 0, k)
    batches = [[("a", "start", 0, at(1), 1), ("b", "start", 0, at(1), None), ("c", "start", 0, None, 3), ("d", "complete", 100, at(2), 4)],
               [("a", "complete", 100, at(3), 5), ("e", "start", 0, at(3), 6), ("b", "hashing", 10, at(4), None)],
               [("b", "error", 10, at(5), 7), ("a", "start", 0, at(1), 1)]]
    counts = []
    for rows in batches:
        spark.createDataFrame(rows, columns).coalesce(1).write.mode("append").parquet(str(tmp_path / "ev"))
        stream = spark.readStream.schema(columns).parquet(str(tmp_path / "ev"))
        query = start_active_scans(open_scan_changes(stream), "running_scans", str(tmp_path / "ck"), {"availableNow": True})
        if counts:
            assert spark.table("running_scans").first()[0] in (counts[-1], 2, 1)
        assert query.awaitTermination(150)
        counts.append(spark.table("running_scans").first()[0])
    assert counts == [2, 2, 1]


def test_rate_limit_stream_equals_batch(spark, tmp_path):
    limits = {"scan_file": (1, "1 minute"), "scan_url": (1, "1 minute"), "key_generate": (1, "1 hour")}
    requests = v.v_requests(spark, SF)
    later = requests.limit(1).select((F.lit("2024-03-01").cast("timestamp")).alias("ts"), F.lit("x").alias("ip"), "endpoint")
    stream = slices(spark, requests.unionByName(later), tmp_path / "rq", 2, "ts")
    got = []
    (rate_limit_audit(stream, limits).writeStream.outputMode("append")
     .foreachBatch(lambda b, i: got.extend(tuple(r) for r in b.collect()))
     .option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination(300))
    assert sorted(got) == sorted(tuple(r) for r in rate_limit_audit(requests, limits).collect())


def test_live_stats_and_outbox(spark, tmp_path):
    scans = v.v_scans(spark, SF).select("scan_id", "user_id", "risk_level", "threats", "created_at")
    stream = slices(spark, scans, tmp_path / "sc", 2, "created_at")
    start_live_stats(stream, "live", str(tmp_path / "c1"), {"availableNow": True}).awaitTermination(300)
    want = QUERIES["overview"](spark, SF).select("total_scans", "threats_found").first()
    assert spark.table("live").first() == want
    subs = v.v_webhook_subs(spark, SF)
    rows = []
    (stream_outbox(stream, subs).writeStream.foreachBatch(lambda b, i: rows.extend(tuple(r) for r in b.collect()))
     .option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start().awaitTermination(300))
    batch = [tuple(r) for r in webhook_fanout(scan_events(scans), subs).collect()]
    assert sorted(rows) == sorted(batch) and rows


def feed(*ids):
    return json.dumps({"vulnerabilities": [{"cve": {"id": i, "descriptions": [{"lang": "en", "value": f"d{i}"}]}}
                                           for i in ids]}, indent=1)


def test_feed_files_and_increment(spark, tmp_path):
    src, table, ckpt = tmp_path / "feed", str(tmp_path / "cves"), str(tmp_path / "ck")
    for word, ids in {"pytorch": ("A", "B"), "pickle": ("B", "C"), "machine%20learning%20model": ("A",)}.items():
        (src / f"keyword={word}").mkdir(parents=True)
        (src / f"keyword={word}" / "1.json").write_text(feed(*ids))
    rows = {(r["keyword"], r["item"]["cve"]["id"]) for r in read_cve_feed(spark, str(src)).collect()}
    assert rows == {("pytorch", "A"), ("pytorch", "B"), ("pickle", "B"), ("pickle", "C"), ("machine learning model", "A")}
    cve_incremental(spark, str(src), table, ckpt).awaitTermination(300)
    (src / "keyword=pickle" / "2.json").write_text(feed("A", "D"))
    cve_incremental(spark, str(src), table, ckpt).awaitTermination(300)
    got = {r["cve_id"]: r["affected_tech"] for r in read_table(spark, "cve_records", table).collect()}
    assert got == {"A": "pytorch", "B": "pickle", "C": "pickle", "D": "pickle"}
