"""File sources: listing, range reads, hashes, and the chunking property."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from modelsieve.functions.matching import Rule, find_matches, whole_content
from modelsieve.operators.entropy import chunk_entropy
from modelsieve.operators.literals import PICKLE_RULES, literal_presence, weighted_pattern_counts
from modelsieve.operators.signatures import SIGNATURES, signature_hits, signature_catalog
from modelsieve.sources import artifacts as src

PIECES = [b"eval (", b"eval\n\t (", b"exec(", b"import os", b"from sys import", b"__reduce__", b"__reduce_ex__",
          b"subprocess.run(", b"EVAL(", b"__import__( 'os'", b"abc", b" ", b"\x00\xff\x80", b"evaluate", b"\n" * 9]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("artifacts")
    (root / "sub").mkdir()
    rng = random.Random(7)
    blobs = {"a.pkl": b"".join(rng.choice(PIECES) for _ in range(900)),
             "sub/B.GGUF": b"".join(rng.choice(PIECES) for _ in range(300)),
             "noise.bin": b"skip", "empty.pt": b"",
             "random.pth": rng.randbytes(30000), ".pkl": b"hidden", "blank.pt": b"eval" + b" " * 9000 + b"(x"}
    for name, data in blobs.items():
        (root / name).write_bytes(data)
    return root, blobs


def admitted(blobs):
    return {n: b for n, b in blobs.items() if n not in ("noise.bin", ".pkl", "empty.pt")}


def test_manifest_lists_supported_files_in_any_case(spark, folder):
    root, blobs = folder
    rows = src.artifact_manifest(spark, str(root)).collect()
    assert {(r["filename"], r["ext"], r["length"]) for r in rows} == {
        (n.split("/")[-1], "." + n.split(".")[-1].lower(), len(b)) for n, b in admitted(blobs).items()}


def test_manifest_plan_reads_no_content(spark, folder):
    plan = src.artifact_manifest(spark, str(folder[0]))._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("ReadSchema")[-1]


def test_manifest_lists_what_the_readers_of_spark_list(spark, tmp_path):
    names = ["a.pkl", "b c%20é.pt", "_x.pkl", "_k=1.pkl", ".h.pkl", "e.pth", "n._COPYING_", "one/two/three/deep.gguf", "_temp/in.pkl", "_y=2/in.pkl",
             ".git/in.pkl", "_metadata/in.pkl", "_metadata.pkl", "[w]/in.pkl"] + [f"m{k}/v{k % 3}/f.pkl" for k in range(90)]
    for name in names:
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"" if name == "e.pth" else name.encode())
    for root in (str(tmp_path), f"file://{tmp_path}/", f"{tmp_path}/m[12]*", f"{tmp_path}/a.pkl", f"{tmp_path}/one"):
        want = src.describe_files(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)).collect()
        got = src.artifact_manifest(spark, root).collect()
        assert sorted(got) == sorted(want) and got, root
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        src.artifact_manifest(spark, f"{tmp_path}/none")


def test_tasks_that_list_do_not_grow_with_the_files(spark, tmp_path):
    for k in range(3000):
        (tmp_path / f"{k}.pkl").write_bytes(b"x")
    listed = src.artifact_manifest(spark, str(tmp_path))
    assert listed.rdd.getNumPartitions() <= 4 * spark.sparkContext.defaultParallelism
    assert listed.count() == 3000


@pytest.mark.parametrize("chunk", [7, 512, 4096])
def test_chunks_cover_every_byte_once(spark, folder, chunk):
    root, blobs = folder
    chunks = src.artifact_chunks(src.artifact_manifest(spark, str(root)), limit=20000, chunk=chunk * 64)
    got = {}
    for r in chunks.orderBy("chunk_no").collect():
        own = r["content"][r["own_start"]:r["own_start"] + r["own_len"]]
        assert r["base_offset"] + r["own_start"] == r["chunk_no"] * chunk * 64
        got[r["filename"]] = got.get(r["filename"], b"") + bytes(own)
    assert got == {n.split("/")[-1]: b[:20000] for n, b in admitted(blobs).items()}


def expected_hits(data):
    return {(s.id, m.start()) for s in SIGNATURES for m in re.finditer(s.regex.encode(), data, re.I | re.M)}


@pytest.mark.parametrize("chunk", [64, 333, 5000])
def test_chunked_scan_equals_whole_scan(spark, folder, chunk):
    root, blobs = folder
    chunks = src.artifact_chunks(src.artifact_manifest(spark, str(root)), limit=1 << 20, chunk=chunk)
    names = src.with_ids(src.artifact_manifest(spark, str(root))).select("artifact_id", "filename")
    got = {}
    for r in signature_hits(chunks).join(names, "artifact_id").collect():
        got.setdefault(r["filename"], set()).add((r["pattern_id"], r["offset"]))
    for name, data in admitted(blobs).items():
        assert got.get(name.split("/")[-1], set()) == expected_hits(data)


def test_split_content_equals_whole_scan(spark, folder):
    data = folder[1]["a.pkl"]
    df = spark.createDataFrame([("x", bytearray(data))], "artifact_id string, content binary")
    for chunk in (128, 1000):
        hits = signature_hits(src.split_content(df, 1 << 20, chunk=chunk, context=256))
        assert {(r["pattern_id"], r["offset"]) for r in hits.collect()} == expected_hits(data)


def test_match_spanning_long_blank_run(spark, folder):
    chunks = src.artifact_chunks(src.artifact_manifest(spark, str(folder[0])).filter("filename = 'blank.pt'"),
                                 limit=1 << 20, chunk=512)
    assert [r["pattern_id"] for r in signature_hits(chunks).collect()] == ["CODE-001"]


def test_weighted_counts_are_unicode_aware_and_chunk_safe(spark):
    data = b"exec \xe9exec exec\xe9 eval.eval __reduce__ __reduce_ex__ __reduce__ socket_x"
    df = spark.createDataFrame([("x", bytearray(data))], "artifact_id string, content binary")
    text = data.decode("latin-1")
    want = {label: len(re.findall(regex, text)) for label, regex, _, _ in PICKLE_RULES}
    want["__reduce__"] -= want["__reduce_ex__"]
    for chunks in (whole_content(df), src.split_content(df, 1 << 20, chunk=10, context=32)):
        got = {r["pattern"]: r["hits"] for r in weighted_pattern_counts(chunks).collect()}
        assert got == {k: n for k, n in want.items() if n > 0}


def test_literal_presence_over_chunks(spark):
    df = spark.createDataFrame([("x", bytearray(b"zz eval eval os.system OS.SYSTEM" * 4))],
                               "artifact_id string, content binary")
    chunks = src.split_content(df, 1 << 20, chunk=9, context=16)
    got = sorted(r["pattern"] for r in literal_presence(chunks, chunked=True).collect())
    assert got == ["eval", "os.system"]


def test_hashes_prefix_and_missing_file(spark, folder):
    root, blobs = folder
    manifest = src.artifact_manifest(spark, str(root))
    got = {r["filename"]: r["file_hash"] for r in src.file_hashes(manifest).collect()}
    assert got == {n.split("/")[-1]: hashlib.sha256(b).hexdigest() for n, b in admitted(blobs).items()}
    gone = manifest.filter("filename = 'a.pkl'").withColumn("path", F.concat("path", F.lit(".gone")))
    assert src.file_hashes(gone).first()["error"]
    assert src.artifact_chunks(gone, 100).first()["error"]
    heads = {r["filename"]: bytes(r["content"]) for r in src.artifact_prefix(manifest, 5).collect()}
    assert heads["a.pkl"] == blobs["a.pkl"][:5]


def test_entropy_closed_forms(spark):
    uniform = bytes(range(256)) * 64
    rows = [("const", bytearray(b"a" * 20000)), ("uniform", bytearray(uniform)), ("small", bytearray(b"ab" * 100)),
            ("tail", bytearray(uniform[:8192] + b"x" * 63))]
    df = spark.createDataFrame(rows, "artifact_id string, content binary")
    got = {(r["artifact_id"], r["offset"]): (r["size"], r["entropy"], r["flagged"])
           for r in chunk_entropy(whole_content(df)).collect()}
    assert got == {("const", 0): (8192, 0.0, False), ("const", 8192): (8192, 0.0, False),
                   ("const", 16384): (3616, 0.0, False), ("uniform", 0): (8192, 8.0, True),
                   ("uniform", 8192): (8192, 8.0, True), ("tail", 0): (8192, 8.0, True)}
    split = {(r["artifact_id"], r["offset"]): (r["size"], r["entropy"], r["flagged"])
             for r in chunk_entropy(src.split_content(df, 1 << 20, chunk=8192)).collect()}
    assert split == got


def test_catalogue_scores_and_user_catalogue(spark):
    rows = {r["id"]: r for r in signature_catalog(spark).collect()}
    assert len(rows) == 41
    want = {"CODE-001": 8.4, "CMD-001": 10.0, "PKL-001": 9.8, "CODE-004": 7.4, "NET-001": 7.5, "NET-003": 10.0,
            "OBF-003": 2.9}
    assert {k: rows[k]["cvss_score"] for k in want} == want
    own = spark.createDataFrame(
        [("U-1", "mine", r"ab+c", "low", ("L", "L", "N", "N", "U", "H", "H", "H"), "x")],
        "id string, category string, pattern string, severity string, "
        "default_cvss struct<av:string,ac:string,pr:string,ui:string,s:string,c:string,i:string,a:string>, desc string")
    df = spark.createDataFrame([("x", bytearray(b"zABBCabc"))], "artifact_id string, content binary")
    got = signature_hits(whole_content(df), own).orderBy("offset").collect()
    assert [(r["pattern_id"], r["offset"], r["cvss_score"]) for r in got] == [("U-1", 1, 8.4), ("U-1", 5, 8.4)]


def test_rule_without_anchor(spark):
    df = spark.createDataFrame([("x", bytearray(b"1a22b"))], "artifact_id string, content binary")
    hits = find_matches(whole_content(df), [Rule("num", r"\d+", None)])
    assert sorted(r["offset"] for r in hits.collect()) == [0, 2]
