"""Failed scans are tried again and replaced by what a later try finds."""

import os
import time

from pyspark.sql import functions as F

from modelsieve.sources.artifacts import artifact_manifest
from modelsieve.sources.tables import append_findings, append_results, read_findings, read_table, read_versions
from modelsieve.streaming.scan import retry_failed, scan_batch, stream_scan_queue

ROW = "scan_id string, scan_status string, risk_score double, created_at timestamp"


def rows(spark, *items):
    frame = spark.createDataFrame([(i, s, p) for i, s, p in items], "scan_id string, scan_status string, risk_score double")
    return frame.withColumn("created_at", F.lit("2024-01-05 10:00:00").cast("timestamp"))


def seen(spark, path):
    return sorted((r["scan_id"], r["scan_status"], r["risk_score"]) for r in read_table(spark, "scans", path).collect())


def test_error_then_completed_gives_completed(spark, tmp_path):
    path = str(tmp_path / "scans")
    first = rows(spark, ("a", "error", None), ("b", "completed", 3.0), ("c", "error", None), ("c", "error", None))
    append_results(first, path)
    append_results(first, path)
    assert seen(spark, path) == [("a", "error", None), ("b", "completed", 3.0), ("c", "error", None)]
    second = rows(spark, ("a", "completed", 7.0), ("b", "error", None), ("c", "error", None), ("d", "error", None), ("d", "completed", 1.0))
    before = read_table(spark, "scans", path)
    append_results(second, path)
    want = [("a", "completed", 7.0), ("b", "completed", 3.0), ("c", "error", None), ("d", "completed", 1.0)]
    assert seen(spark, path) == want
    for again in (second, first, second):
        append_results(again, path)
    assert seen(spark, path) == want and read_versions(spark, "scans", path).filter("scan_id in ('a', 'b', 'c')").count() == 4
    # A reader that listed the files before still has one row of each scan.
    assert sorted(r["scan_id"] for r in before.collect()) == ["a", "b", "c"]
    day = read_table(spark, "scans", path).filter("scan_date = date'2024-01-05' and scan_id = 'a'")
    assert [r["scan_status"] for r in day.collect()] == ["completed"]


def test_findings_of_the_latest_version_only(spark, tmp_path):
    scans, path = str(tmp_path / "scans"), str(tmp_path / "findings")
    found = lambda *ids: spark.createDataFrame([("a", i) for i in ids], "artifact_id string, pattern_id string")
    for status, ids in (("error", ("P1",)), ("error", ("P1",)), ("completed", ("P1", "P2")), ("completed", ("P1", "P2"))):
        batch = rows(spark, ("a", status, 1.0))
        append_findings(found(*ids), batch, path)
        append_results(batch, scans)
        assert sorted(r["pattern_id"] for r in read_findings(spark, path, scans).collect()) == sorted(ids)


def test_batch_retry_until_it_reads(spark, tmp_path):
    src, out = tmp_path / "in", str(tmp_path / "out")
    src.mkdir()
    for name in ("a.pkl", "b.pkl"):
        (src / name).write_bytes(b"\x80\x02N.")
    listed = artifact_manifest(spark, str(src))
    manifest = spark.createDataFrame(listed.collect(), listed.schema)
    os.rename(src / "a.pkl", tmp_path / "hidden")
    ended = {r["status"]: r["error"] for r in scan_batch(manifest, out).collect()}
    assert ended["completed"] is None and "a.pkl" in ended["error"]
    assert retry_failed(spark, out, manifest) == 1
    os.rename(tmp_path / "hidden", src / "a.pkl")
    assert retry_failed(spark, out, manifest) == 1 and retry_failed(spark, out, manifest) == 0
    assert sorted((r["filename"], r["scan_status"]) for r in read_table(spark, "scans", out + "/scans").collect()) == [
        ("a.pkl", "completed"), ("b.pkl", "completed")]
    tries = sorted((r["attempt"], r["status"]) for r in read_table(spark, "attempts", out + "/attempts").collect())
    assert tries == [(2, "error"), (3, "completed")]


def test_queue_repairs_and_gives_up(spark, tmp_path):
    """A file fails twice, then is stored once as completed; one that never reads ends as a dead letter; a restart goes on."""
    src, out, checkpoint = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "ck")
    src.mkdir()
    for name in ("late.pkl", "lost.pkl", "fine.pkl"):
        (src / name).write_bytes(b"\x80\x02N.")
    # The listing sees a directory entry that cannot be opened until it is repaired.
    for name in ("late.pkl", "lost.pkl"):
        os.rename(src / name, tmp_path / name)
        os.symlink(tmp_path / name, src / name)
    start = lambda: stream_scan_queue(spark, str(src), out, checkpoint, attempts=3, delay=0.5, every="1 second")
    tries = lambda: sorted((r["path"].rsplit("/", 1)[1], r["attempt"], r["status"])
                           for r in read_table(spark, "attempts", out + "/attempts").collect())

    from modelsieve.streaming import scan as module
    real, broken = module.scan_files, {"late.pkl": 2, "lost.pkl": 99}

    def failing(spark, manifest, iocs):
        """Hide the files that shall fail in this try, bring back the others."""
        names = [r["filename"] for r in manifest.select("filename").collect()]
        for n in set(names) & set(broken):
            there, away = tmp_path / n, tmp_path / f"{n}.away"
            if broken[n] > 0 and there.exists():
                os.rename(there, away)
            elif broken[n] <= 0 and away.exists():
                os.rename(away, there)
            broken[n] -= 1
        return real(spark, manifest, iocs)

    module.scan_files = failing
    query = start()
    try:
        deadline = time.time() + 240
        restarted = False
        while time.time() < deadline:
            done = tries()
            if not restarted and len(done) >= 4:
                query.stop()
                query, restarted = start(), True
            if restarted and os.path.exists(out + "/dead_letters") and ("late.pkl", 3, "completed") in done:
                break
            assert query.exception() is None
            time.sleep(1)
    finally:
        query.stop()
        module.scan_files = real
    done = tries()
    assert [x for x in done if x[0] == "late.pkl"] == [("late.pkl", 1, "error"), ("late.pkl", 2, "error"), ("late.pkl", 3, "completed")]
    assert [x[1:] for x in done if x[0] == "lost.pkl"] == [(k, "error") for k in (1, 2, 3)]
    rows_ = sorted((r["filename"], r["scan_status"]) for r in read_table(spark, "scans", out + "/scans").collect())
    assert rows_ == [("fine.pkl", "completed"), ("late.pkl", "completed"), ("lost.pkl", "error")]
    dead = read_table(spark, "dead_letters", out + "/dead_letters").collect()
    assert [(r["filename"], r["attempts"]) for r in dead] == [("lost.pkl", 3)] and "No such file" in dead[0]["error"]
