"""The data source of artifact bytes: planning, single opening, errors, pushdown, workers without the package."""

import hashlib
import os
import random
import re
import subprocess
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from modelsieve.functions.matching import Rule, shared_context, widest
from modelsieve.operators.signatures import SIGNATURES, Signature
from modelsieve.plans.corpus import scan_files
from modelsieve.sources import artifacts as src
from modelsieve.sources import reader

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("reader files")
    rng = random.Random(1)
    blobs = {f"f{k:02}.pkl": rng.randbytes(rng.choice([1, 900, 70_000])) for k in range(30)}
    blobs |= {"big.gguf": b"GGUF" + rng.randbytes(900_000), "one.safetensors": (2).to_bytes(8, "little") + b"{}"}
    for name, data in blobs.items():
        (root / name).write_bytes(data)
    return root, blobs


def test_plan_covers_every_file_and_chunk_once():
    rng = np.random.default_rng(3)
    for per_task, spread in ((5000, 5000), (100_000, 200_000)):
        lengths = rng.choice([0, 10, 3000, 4096, 50_000, 1_000_000], 400)
        plan = reader.planned(lengths, per_task, 1024, spread, True, True)
        chunks, hashes = {}, {}
        for first, end, begin, last in plan:
            for row in range(first, end):
                if last >= 0:
                    for k in range(begin, last) if last else range(max(1, -(-int(lengths[row]) // 1024))):
                        chunks[row, k] = chunks.get((row, k), 0) + 1
                if last <= 0:
                    hashes[row] = hashes.get(row, 0) + 1
        assert set(hashes.values()) == {1} and len(hashes) == 400
        assert set(chunks.values()) == {1} and len(chunks) == sum(max(1, -(-int(n) // 1024)) for n in lengths)
    assert reader.planned(np.array([], np.int64), 10, 10, 10, True, True) == []


@pytest.mark.parametrize("spread", [1 << 30, 100_000])
def test_hash_head_and_chunks_from_one_reading(spark, folder, spread):
    root, blobs = folder
    rows = reader.read_artifacts(src.with_ids(src.artifact_manifest(spark, str(root))).select("path", "filename", "length"),
                                 ["chunk_no", "own_start", "own_len", "content", "head", "file_hash", "error"], chunk=65536, spread=spread).collect()
    for name, data in blobs.items():
        own = sorted((r for r in rows if r["filename"] == name and r["chunk_no"] is not None), key=lambda r: r["chunk_no"])
        assert b"".join(bytes(r["content"])[r["own_start"]:r["own_start"] + r["own_len"]] for r in own) == data
        assert {bytes(r["head"]) for r in own} == {data[:100]} and not any(r["error"] for r in own)
        assert [r["file_hash"] for r in rows if r["filename"] == name and r["file_hash"]] == [hashlib.sha256(data).hexdigest()]


def test_each_file_is_opened_once(spark, folder, tmp_path):
    root, blobs = folder
    manifest = src.artifact_manifest(spark, str(root)).select("path", "length")
    path = reader.stored_manifest(manifest)
    source = reader.ArtifactFiles({"manifest": path, "chunk": "65536", "parallelism": "3"})
    made = source.reader(reader.StructType.fromDDL("path string, chunk_no bigint, own_len int, content binary, head binary, file_hash string, error string"))
    opened, real = [], reader.Stores.open
    reader.Stores.open = lambda self, p: (opened.append(p), real(self, p))[1]
    try:
        read = sum(int(np.sum(b.column(2).to_numpy())) for part in made.partitions() for b in made.read(part))
    finally:
        reader.Stores.open = real
    assert sorted(opened) == sorted(r["path"] for r in manifest.collect()) and read == sum(map(len, blobs.values()))


def test_lost_and_shortened_files_are_errors(spark, folder, tmp_path):
    for name in ("a.pkl", "b.pkl", "c.pkl"):
        (tmp_path / name).write_bytes(b"x" * 5000)
    manifest = src.artifact_manifest(spark, str(tmp_path))
    listed = spark.createDataFrame(manifest.collect(), manifest.schema)
    (tmp_path / "a.pkl").unlink()
    (tmp_path / "b.pkl").write_bytes(b"x" * 10)
    hashes = {r["filename"]: r for r in src.file_hashes(listed).collect()}
    assert hashes["a.pkl"]["error"] and "10 of 5000" in hashes["b.pkl"]["error"] and hashes["b.pkl"]["file_hash"] is None
    assert hashes["c.pkl"]["file_hash"] == hashlib.sha256(b"x" * 5000).hexdigest()
    chunks = src.artifact_chunks(listed, chunk=1000, facts=True).collect()
    assert {r["filename"] for r in chunks if r["error"]} == {"a.pkl", "b.pkl"} and sum(r["filename"] == "c.pkl" for r in chunks) == 5
    status = {r["filename"]: r["status"] for r in scan_files(spark, listed).results.collect()}
    assert [n for n, v in sorted(status.items()) if v == "error"] == ["a.pkl", "b.pkl"] and len(status) == 3


def test_filters_choose_files_before_reading(spark, folder):
    key = "spark.sql.python.filterPushdown.enabled"
    spark.conf.set(key, "true")
    try:
        manifest = src.artifact_manifest(spark, str(folder[0]))
        # A name that cannot be opened: only what passes the filter may be touched.
        broken = manifest.withColumn("path", F.when(F.col("ext") == ".gguf", F.col("path")).otherwise("file:/nowhere"))
        some = src.file_hashes(broken).filter("ext = '.gguf' and length > 10 and filename in ('big.gguf', 'x') and error is null")
        assert [r["filename"] for r in some.collect()] == ["big.gguf"]
        plan = some._jdf.queryExecution().executedPlan().toString()
        assert "ext" not in plan.split("Filter", 1)[1].split("\n", 1)[0] if "Filter" in plan else True
    finally:
        spark.conf.unset(key)
    assert src.file_hashes(manifest.filter("length < 0")).collect() == []


def test_context_follows_from_the_rules(spark, tmp_path):
    assert all(widest(s.rule()) < 64 for s in SIGNATURES) and shared_context([s.rule() for s in SIGNATURES]) == 64 << 10
    assert widest(Rule("x", r"ab{2,7}\s*(?:cd|efg)?\(", None)) == 1 + 7 + 3 + 1
    assert widest(Rule("x", r"a\s+b", None)) == 2
    with pytest.raises(ValueError):
        shared_context([Rule("x", r"a.*b", None)])
    wide = Signature("W-1", "own", r"begin[^e]{90000,110000}end", "high", "AV:L/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H", "wide")
    (tmp_path / "wide.pkl").write_bytes(b"." * (reader.CHUNK - 40_000) + b"begin" + b"." * 100_000 + b"end" + b"." * 200_000)
    scan = scan_files(spark, src.artifact_manifest(spark, str(tmp_path)), signatures=[*SIGNATURES, wide])
    assert [r["offset"] for r in scan.findings.filter("pattern_id = 'W-1'").collect()] == [reader.CHUNK - 40_000]


BARE = """
import sys
sys.path.insert(0, {repo!r})
from modelsieve.session import local_session
from modelsieve.plans.corpus import inspect_files, scan_files, sdk_scan
from modelsieve.sources.artifacts import artifact_chunks, artifact_manifest, file_hashes
spark = local_session(2, "2g")
manifest = artifact_manifest(spark, {folder!r})
print("hashes", file_hashes(manifest).count(), "chunks", artifact_chunks(manifest, chunk=65536).count())
print("scan", scan_files(spark, manifest).results.count(), "sdk", sdk_scan(manifest)[1].count(), "inspect", inspect_files(manifest)[1].count())
"""


def test_workers_need_no_package(folder, tmp_path):
    """Started in another folder without PYTHONPATH, as on a cluster: workers find only what travels with the tasks."""
    env = {k: v for k, v in os.environ.items() if k not in ("PYTHONPATH", "PYTHONSTARTUP")}
    done = subprocess.run([sys.executable, "-c", BARE.format(repo=REPO, folder=str(folder[0]))], cwd=tmp_path, env=env, capture_output=True, text=True,
                          timeout=600)
    chunks = sum(max(1, -(-len(b) // 65536)) for b in folder[1].values())
    assert f"hashes 32 chunks {chunks}" in done.stdout and "scan 32 sdk 32 inspect 32" in done.stdout, done.stderr[-3000:]
    assert not re.search("ModuleNotFoundError", done.stderr)


def test_small_chunks_share_a_batch(spark, tmp_path):
    """Chunks of many small files come in few batches of bounded size, in order and whole."""
    for k in range(120):
        (tmp_path / f"{k:03}.pkl").write_bytes(bytes([k]) * 3000)
    (tmp_path / "large.pkl").write_bytes(b"\xfe" * (3 << 20))
    table = src.artifact_manifest(spark, str(tmp_path)).select("path", "length").coalesce(1)
    schema = reader.StructType.fromDDL("path string, length bigint, chunk_no bigint, own_start int, own_len int, content binary, error string")
    made = reader.ArtifactReader(schema, {"manifest": reader.stored_manifest(table), "chunk": "1024", "context": "64", "parallelism": "1"})
    batches = [b for part in made.partitions() for b in made.read(part)]
    chunks = sum(b.num_rows for b in batches)
    assert chunks == 120 * 3 + 3072 and len(batches) <= 8
    assert all(b.nbytes < 2 * reader.BATCH_BYTES for b in batches)
    files = {}
    for row in (r for b in batches for r in b.to_pylist()):
        own = files.setdefault(row["path"].rsplit("/", 1)[-1], [])
        assert row["chunk_no"] == len(own) and row["error"] is None
        own.append(row["content"][row["own_start"]:row["own_start"] + row["own_len"]])
    assert {n: b"".join(c) for n, c in files.items()} == {p.name: p.read_bytes() for p in tmp_path.iterdir()}
