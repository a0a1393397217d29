"""Nothing hides behind a size, and what can't be read is never clean."""

import json
import struct
from datetime import datetime

import pytest

from modelsieve.functions.matching import whole_content
from modelsieve.operators.gguf import gguf_metadata, gguf_metadata_rules
from modelsieve.operators.safetensors import safetensors_header, safetensors_header_rules
from modelsieve.operators.scoring import inspector_risk, rank_findings
from modelsieve.operators.signatures import Signature, required_literal, signature_hits
from modelsieve.operators.templates import iter_blocks
from modelsieve.plans.corpus import inspect_files, scan_files, scan_rows, sdk_scan
from modelsieve.sources.artifacts import artifact_chunks, artifact_manifest
from modelsieve.sources.tables import append_results, read_table

MIB = 1 << 20


def text(value: str) -> bytes:
    raw = value.encode()
    return struct.pack("<Q", len(raw)) + raw


def tensors(header: bytes, tail: bytes = b"") -> bytes:
    return struct.pack("<Q", len(header)) + header + tail


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("with blank é#%")
    (root / "late payload.safetensors").write_bytes(tensors(b"{}", b"\0" * (51 * MIB) + b" os.system('x') "))
    pairs = [("long", 8, text("x" * (11 * MIB) + " os.system(1) ")),
             ("items", 9, struct.pack("<IQ", 8, 10_002) + b"".join(text(f"t{k}") for k in range(10_001)) + text("subprocess.run"))]
    body = b"".join(text(k) + struct.pack("<I", t) + v for k, t, v in pairs)
    (root / "big.gguf").write_bytes(b"GGUF" + struct.pack("<IQQ", 3, 0, len(pairs)) + body)
    (root / "ok.pkl").write_bytes(b"\x80\x02N.")
    return root


def manifest_with_missing(spark, folder):
    """The listing of a folder from which files vanished before the scan."""
    listed = artifact_manifest(spark, str(folder))
    gone = [(f"file:{folder}/gone{ext}", f"gone{ext}", ext, 100, datetime(2024, 1, 1)) for ext in (".pkl", ".gguf", ".safetensors", ".pt")]
    return listed.unionByName(spark.createDataFrame(gone, listed.schema))


def test_engine(spark, folder, tmp_path):
    manifest = manifest_with_missing(spark, folder)
    scan = scan_files(spark, manifest)
    rows = {r["filename"]: r for r in scan.results.collect()}
    assert rows["late payload.safetensors"]["risk_level"] == "critical" and rows["big.gguf"]["risk_level"] == "critical"
    assert rows["ok.pkl"]["status"] == "safe" and len(rows) == 7
    for ext in (".pkl", ".gguf", ".safetensors", ".pt"):
        r = rows[f"gone{ext}"]
        assert r["status"] == "error" and r["risk_score"] is None and r["risk_level"] is None
    assert {r["path"].rsplit("/", 1)[1] for r in scan.errors.collect()} == {f"gone{e}" for e in (".pkl", ".gguf", ".safetensors", ".pt")}
    stored = scan_rows(scan, manifest)
    for _ in range(2):
        append_results(stored, str(tmp_path / "scans"))
    kept = read_table(spark, "scans", str(tmp_path / "scans")).collect()
    assert len(kept) == 7 and {r["scan_status"] for r in kept if r["filename"].startswith("gone")} == {"error"}


def test_long_match_on_a_border(spark, tmp_path):
    rule = Signature("LONG", "x", r"KEY:\[A+\]", "high", "AV:L/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H", "long")
    data = b"b" * (2 * MIB - 100) + b"key:[" + b"a" * 9_000 + b"]" + b"c" * MIB
    (tmp_path / "long.pkl").write_bytes(data)
    chunks = artifact_chunks(artifact_manifest(spark, str(tmp_path)), chunk=MIB)
    assert [r["offset"] for r in signature_hits(chunks, [rule]).collect()] == [2 * MIB - 100]
    assert required_literal(r"(?:a|b)+x\s*(token_key)=\d") == "token_key=" and required_literal(r"a|bcdef") is None


def test_a_catalogue_of_any_size(spark):
    rows = [(f"R{k}", "c", f"needle{k:05d}[0-9]", "low", ("N", "L", "N", "N", "U", "H", "H", "H"), "d") for k in range(20_000)]
    catalog = spark.createDataFrame(rows, "id string, category string, pattern string, severity string, "
                                    "default_cvss struct<av:string,ac:string,pr:string,ui:string,s:string,c:string,i:string,a:string>, desc string")
    table = whole_content(spark.createDataFrame([("a", b"x needle190071 NEEDLE000009 needle12")], "artifact_id string, content binary"))
    assert {r["pattern_id"] for r in signature_hits(table, catalog).collect()} == {"R19007", "R0"}


def test_a_limit_is_partial_not_clean(spark, folder):
    rows = {r["filename"]: r for r in scan_files(spark, artifact_manifest(spark, str(folder)), limit=MIB).results.collect()}
    assert rows["late payload.safetensors"]["status"] == "error" and "partial" in rows["late payload.safetensors"]["details"]
    assert rows["ok.pkl"]["status"] == "safe"


def test_sdk_and_inspector(spark, folder):
    manifest = manifest_with_missing(spark, folder)
    _, results = sdk_scan(manifest)
    rows = {r["filename"]: r for r in results.collect()}
    assert len(rows) == 7 and not rows["late payload.safetensors"]["is_safe"] or rows["late payload.safetensors"]["threats_found"] > 0
    gone = [r for n, r in rows.items() if n.startswith("gone")]
    assert len(gone) == 4 and all(r["verdict"] == "UNKNOWN" and not r["is_safe"] and r["risk_score"] is None and r["error"] for r in gone)
    findings, results = inspect_files(manifest)
    names = {r["artifact_id"]: r["filename"] for r in scan_files(spark, manifest).results.collect()}
    rows = {names[r["artifact_id"]]: r for r in results.collect()}
    assert len(rows) == 7 and all((r["risk_score"] is None) == n.startswith("gone") for n, r in rows.items())
    assert rows["big.gguf"]["risk_level"] in ("malicious", "suspicious", "critical")
    assert {r["type"] for r in findings.collect()} >= {"file_error", "extension_warning", "format_risk"}


def test_gguf_values_are_whole(spark, folder):
    table = spark.createDataFrame([("g", (folder / "big.gguf").read_bytes())], "artifact_id string, content binary")
    kv = {r["key"]: r["value"] for r in gguf_metadata(table).collect()}
    assert len(kv["long"]) == 11 * MIB + 14 and json.loads(kv["items"])[10_001] == "subprocess.run"
    assert [r["pattern"] for r in gguf_metadata_rules(gguf_metadata(table)).collect()] == ["os.system()"]


def test_large_headers(spark):
    note = "n" * (20 * MIB)
    good = tensors(json.dumps({"__metadata__": {"note": note}, "w": {"dtype": "F32"}}).encode())
    over = struct.pack("<Q", 120 * MIB) + b"{}"
    table = spark.createDataFrame([("good", good, len(good)), ("over", over, 200 * MIB)], "artifact_id string, content binary, file_len bigint")
    assert {r["artifact_id"]: r["type"] for r in safetensors_header_rules(table).select("artifact_id", "type").collect()} == {
        "good": "header_info", "over": "oversized_header"}
    rows = {r["artifact_id"]: r for r in safetensors_header(table).collect()}
    assert rows["good"]["status"] == "ok" and rows["good"]["n_tensors"] == 1 and rows["good"]["metadata"]["note"] == note


def test_findings_without_ordinal_or_artifact_are_ranked(spark):
    rows = spark.createDataFrame([("a", "high", 1), ("a", "low", None), (None, "low", 5)], "artifact_id string, severity string, ordinal bigint")
    assert sorted((r["artifact_id"] or "", r["rank"]) for r in rank_findings(rows).collect()) == [("", 1), ("a", 1), ("a", 2)]


def test_files_without_findings_have_a_score(spark):
    none = spark.createDataFrame([], "artifact_id string, type string, severity string, weight double")
    rows = inspector_risk(none, spark.createDataFrame([("a",)], "artifact_id string")).collect()
    assert [(r["artifact_id"], r["risk_score"], r["risk_level"]) for r in rows] == [("a", 0.0, "clean")]


def test_appending_rows_without_date_twice_adds_nothing(spark, tmp_path):
    rows = spark.createDataFrame([("s1", None), ("s2", None)], "scan_id string, created_at timestamp")
    for _ in range(2):
        append_results(rows, str(tmp_path / "scans"))
    assert read_table(spark, "scans", str(tmp_path / "scans")).count() == 2


def test_template_blocks_in_a_stream_equal_one_search():
    import io
    import random
    import re
    rng = random.Random(1)
    for _ in range(300):
        data = "".join(rng.choice(["{{", "}}", "{%", "%}", "{", "}", "a", "bc"]) for _ in range(rng.randrange(40))).encode()
        want = [m[0] for m in re.finditer(rb"(?s)\{%.*?%\}|\{\{.*?\}\}", data)]
        assert list(iter_blocks(io.BytesIO(data).read, 3)) == want, data
