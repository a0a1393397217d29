"""Structural detectors on hand-made, inert bytes."""

import json
import pickle
import struct

import pytest
from pyspark.sql import functions as F

from modelsieve.functions.matching import whole_content
from modelsieve.operators import admission
from modelsieve.operators.gguf import STRING_RULES, gguf_metadata, gguf_metadata_rules, register_gguf_kv
from modelsieve.operators.onnx import onnx_ops
from modelsieve.operators.pickles import op_counts, pickle_opcode_audit, pickle_ops, register_pickle_ops, unsafe_imports
from modelsieve.operators.safetensors import metadata_rules, safetensors_header, safetensors_header_rules
from modelsieve.operators.templates import template_injection
from modelsieve.plans.dispatch import scan_corpus
from modelsieve.sources.artifacts import split_content


def frame(spark, items):
    return spark.createDataFrame([(k, k, bytearray(v)) for k, v in items.items()],
                                 "artifact_id string, filename string, content binary")


def text(s):
    raw = s.encode()
    return struct.pack("<Q", len(raw)) + raw


def gguf(*pairs, counts="<QQ", declared=None):
    body = b"".join(text(k) + struct.pack("<I", t) + v for k, t, v in pairs)
    return b"GGUF" + struct.pack("<I", 3) + struct.pack(counts, 7, len(pairs) if declared is None else declared) + body


def safetensors(header, length=None):
    raw = header if isinstance(header, bytes) else json.dumps(header).encode()
    return struct.pack("<Q", len(raw) if length is None else length) + raw


def test_pickle_audit(spark):
    protocol0 = b"cos\nsystem\n(S'x'\ntR."
    items = {"p0": protocol0, "p4": pickle.dumps(print, protocol=4), "plain": pickle.dumps({"a": 1}, protocol=2),
             "safe": b"ccollections\nOrderedDict\n)R.", "cut": b"cjson\ndumps\n", "junk": b"\xfa\xfb"}
    df = frame(spark, items)
    got = {(r["artifact_id"], r["type"]): (r["severity"], r["cvss_score"], r["offset"])
           for r in pickle_opcode_audit(df).collect()}
    assert got == {
        ("p0", "unsafe_global"): ("high", 8.4, 0),
        ("p0", "reduce_execution"): ("critical", 9.8, items["p0"].index(b"R.")),
        ("safe", "reduce_execution"): ("critical", 9.8, 26),
        ("cut", "unsafe_global"): ("medium", 5.5, 0), ("cut", "malformed_pickle"): ("medium", 5.5, 0),
        ("junk", "malformed_pickle"): ("medium", 5.5, 0)}
    counts = {r["artifact_id"]: r["stack_global_count"] for r in op_counts(pickle_ops(df)).collect()}
    assert counts["p4"] == 1 and counts["p0"] == 0
    rolled = {(r["module"], r["name"]): r["hits"] for r in unsafe_imports(pickle_ops(df)).collect()}
    assert rolled == {("os", "system"): 1, ("json", "dumps"): 1}


def test_table_functions_in_sql(spark):
    register_pickle_ops(spark)
    register_gguf_kv(spark)
    frame(spark, {"a": b"cos\nsystem\n)R."}).createOrReplaceTempView("pickles")
    rows = spark.sql("SELECT artifact_id, op, arg FROM pickles, LATERAL pickle_ops(content) ORDER BY pos").collect()
    assert [tuple(r) for r in rows] == [("a", "GLOBAL", "os system"), ("a", "REDUCE", None)]
    frame(spark, {"g": gguf(("k", 4, struct.pack("<I", 9)))}).createOrReplaceTempView("ggufs")
    assert spark.sql("SELECT key, value FROM ggufs, LATERAL gguf_kv(content)").first() == ("k", "9")


def test_gguf_values(spark):
    long_array = struct.pack("<IQ", 4, 10_005) + struct.pack("<10005I", *range(10_005))
    nested = struct.pack("<IQ", 9, 1) + struct.pack("<IQ", 8, 2) + text("x") + text("y")
    data = gguf(("u8", 0, b"\xff"), ("i8", 1, b"\xff"), ("f", 6, struct.pack("<f", 0.5)), ("b", 7, b"\x01"),
                ("big", 10, struct.pack("<Q", 2 ** 63 + 1)), ("arr", 9, long_array), ("nest", 9, nested),
                ("u8", 0, b"\x07"), ("last", 8, text("end")))
    rows = {r["key"]: r for r in gguf_metadata(frame(spark, {"g": data})).collect()}
    assert {k: rows[k]["value"] for k in ("u8", "i8", "f", "b", "big", "nest", "last")} == {
        "u8": "7", "i8": "-1", "f": "0.5", "b": "true", "big": str(2 ** 63 + 1), "nest": '[["x", "y"]]', "last": "end"}
    assert rows["u8"]["position"] == 0 and rows["u8"]["tensors"] == 7
    assert len(json.loads(rows["arr"]["value"])) == 10_005


def test_gguf_layouts_and_cut_files(spark):
    old = gguf(("k", 4, struct.pack("<I", 1)), counts="<II")
    assert gguf_metadata(frame(spark, {"g": old}), layout="u32").first()["value"] == "1"
    cut = gguf(("k", 8, text("abcdef")), ("z", 8, text("zz")))[:-14]
    df = frame(spark, {"cut": cut, "short": b"GGUF\x03", "none": gguf(declared=0)})
    rows = {(r["artifact_id"], r["key"]) for r in gguf_metadata(df).collect()}
    assert rows == {("cut", "k"), ("none", None)}


def test_gguf_rules(spark):
    data = gguf(("a.chat_template", 8, text("os.system(1) OS.SYSTEM (2)")), ("B.CHAT_TEMPLATE", 8, text("eval(1)")),
                ("note", 8, text("shutil.rmtree")), ("n", 4, struct.pack("<I", 3)))
    got = {(r["source"], r["type"], r["pattern"], r["hits"], r["weight"])
           for r in gguf_metadata_rules(gguf_metadata(frame(spark, {"g": data}))).collect()}
    assert got == {("metadata[a.chat_template]", "chat_template_injection", "os.system()", 2, 20.0),
                   ("chat_template", "chat_template_injection", "os.system()", 2, 20.0),
                   ("metadata[B.CHAT_TEMPLATE]", "dangerous_pattern", "eval()", 1, 25.0),
                   ("metadata[note]", "dangerous_pattern", "shutil", 1, 25.0)}


def test_literals_of_gguf_rules_lose_no_match(spark):
    """Letters beyond ASCII that a caseless expression takes for ASCII ones, and long values, hit as without the literals."""
    odd = ["o\u017f.\u017fystem(1)", "soc\u212aet.x", "__\u0130MPORT__ (x)", "\u0131mport shut\u0131l.x", "stra\u00dfe OS.POPEN\u00a0(", "\u03a3 reque\u017fts.",
           "open (", "x" * 100_000 + " <\u017fcript", "os.exe", "", "reopen(", "URLLIB.\u0130 ctypes."]
    data = gguf(*[(f"k{n}", 8, text(t)) for n, t in enumerate(odd)])
    got = {(r["source"], r["pattern"], r["hits"]) for r in gguf_metadata_rules(gguf_metadata(frame(spark, {"g": data}))).collect()}
    rows = spark.createDataFrame([(f"metadata[k{n}]", t) for n, t in enumerate(odd)], "source string, value string")
    want = {(r["source"], label, r["hits"]) for label, _, regex in STRING_RULES for r in rows.select(
        "source", F.regexp_count("value", F.lit(f"(?iuU){regex}")).alias("hits")).filter("hits > 0").collect()}
    assert got == want and len(got) > 6


def test_the_first_template_key_is_marked(spark):
    table = frame(spark, {"g": gguf(("x", 8, text("1")), ("Chat_Template", 4, struct.pack("<I", 3)), ("chat_template", 8, text("eval(1)"))), "e": gguf(("chat_template", 8, text("")))})
    kv = gguf_metadata(table)
    assert {(r["artifact_id"], r["key"]) for r in kv.filter("template").collect()} == {("g", "Chat_Template"), ("e", "chat_template")}
    assert {r["source"] for r in gguf_metadata_rules(kv).collect()} == {"metadata[chat_template]"}


def test_safetensors_states(spark):
    ok = {"__metadata__": {"a": "see https://x.example/q end", "n": 5, "b": "z" * 10_001}, "w": {}, "v": {}}
    items = {"short": b"\x01", "huge": safetensors(b"{}", 2 ** 63 + 5), "zero": safetensors(b"", 0),
             "cut": safetensors(b"{}", 90), "bad": safetensors(b"{oops"), "utf": safetensors(b'{"a":"\xff"}'),
             "list": safetensors([1]), "meta": safetensors({"__metadata__": [1]}), "ok": safetensors(ok),
             "null": safetensors({"__metadata__": None})}
    df = frame(spark, items)
    states = {r["artifact_id"]: (r["type"], r["weight"]) for r in safetensors_header_rules(df).collect()}
    assert states == {
        "short": ("invalid_header", 25.0), "huge": ("oversized_header", 30.0), "zero": ("empty_header", 5.0),
        "cut": ("truncated_header", 20.0), "bad": ("invalid_json", 25.0), "utf": ("invalid_json", 25.0),
        "list": ("invalid_header_type", 20.0), "meta": ("invalid_metadata_type", 10.0), "ok": ("header_info", 0.0),
        "null": ("header_info", 0.0)}
    table = {r["artifact_id"]: r for r in safetensors_header(df).collect()}
    assert table["short"]["status"] == "too_small" and table["ok"]["status"] == "ok"
    assert table["ok"]["n_tensors"] == 2 and table["ok"]["metadata"]["n"] == "5"
    assert {k for k, r in table.items() if r["status"] == "malformed"} == set(items) - {"short", "ok"}
    rules = {(r["type"], r["key"], r["pattern"], r["hits"]) for r in
             metadata_rules(df.filter("artifact_id = 'ok'")).collect()}
    assert rules == {("suspicious_url_metadata", "a", "https://x.example/q", 1), ("large_metadata_value", "b", None, 1),
                     ("header_pattern", None, "URL", 1), ("header_pattern", None, "base64 blob", 1)}


@pytest.mark.parametrize("template,names", [
    ("{{ os.system('x') }}", "os"), ("{{ x.os }}", None), ("{{ 'os' }}", None), ("{% set os = 1 %}", None),
    ("{% set x = os %}", "os"), ("{% if os %}", None), ("{{ f(system=1) }}", None), ("{{ a | system }}", None),
    ("{{ ''.__class__ }}", None), ("{{ __class__ ~ globals }}", "__class__, globals"), ("{{\nsubprocess\n}}", "subprocess"),
    ("{{ [system, os] }} {{ [system, os] }}", "os, system"), ("{{ x == os }}", "os"), ("{ os }", None)])
def test_templates(spark, template, names):
    rows = template_injection(frame(spark, {"t": b"\xff" + template.encode()})).collect()
    assert [r["desc"].rsplit(": ", 1)[1] for r in rows] == ([names] if names else [])


def test_onnx_first_offset_over_chunks(spark):
    df = frame(spark, {"m.onnx": b"\xc3" * 30 + b"PyOp CustomOp PyOp"})
    want = {("PyOp", 30), ("CustomOp", 35)}
    assert {(r["op"], r["offset"]) for r in onnx_ops(whole_content(df)).collect()} == want
    chunks = split_content(df, 1 << 20, chunk=8, context=16)
    assert {(r["op"], r["offset"]) for r in onnx_ops(chunks, chunked=True).collect()} == want


def test_formats(spark):
    items = {"a.gguf": b"\x80\x04x", "b.onnx": b"GGUF", "c.SAFETENSORS": b"", "d.safetensors": b"", "e.dat": b"\x08 onnx",
             "f.BIN": b"x", "g.onnx": b"", "onnx": b"", "h.zip": b"", "i.dat": b"\x08" + b"." * 99 + b"onnx"}
    got = {r["filename"]: r["format"] for r in admission.identify_format(frame(spark, items)).collect()}
    assert got == {"a.gguf": "pickle", "b.onnx": "gguf", "c.SAFETENSORS": "unknown", "d.safetensors": "safetensors",
                   "e.dat": "onnx", "f.BIN": "pickle", "g.onnx": "onnx", "onnx": "onnx", "h.zip": "unknown",
                   "i.dat": "unknown"}


def test_names_and_urls(spark):
    names = {"../../etc/a.pkl": "a.pkl", "  x.pt  ": "x.pt", "a\x00b​.pt": "ab.pt", "dir/": "unknown", "": "unknown",
             "n" * 600: "n" * 500, "a b.pt": "a b.pt"}
    df = spark.createDataFrame([(k,) for k in names], "filename string")
    assert {r["filename"]: r["clean_name"] for r in admission.sanitize_filename(df).collect()} == names
    exts = {"a.PKL": ".pkl", ".pkl": "", "..pkl": "", "a.b.pt": ".pt", "a": "", "a.": "."}
    got = spark.createDataFrame([(k,) for k in exts], "filename string").withColumn("e", admission.extension(F.col("filename")))
    assert {r["filename"]: r["e"] for r in got.collect()} == exts
    urls = {" https://hf.co/a/m.pt ": (None, "m.pt"), "https://user@HF.co:443/m.gguf?x#y": (None, "m.gguf"),
            "https://evil.example/hf.co/m.pt": ("host", None), "https://hf.co.evil.example/m.pt": ("host", None),
            "https://hf.co": ("extension", None), "javascript:x": ("scheme", None), "": ("empty", None),
            "https://hf.co/m.pt/": (None, "m.pt"), "https://hf.co/" + "x" * 2048: ("too_long", None)}
    df = spark.createDataFrame([(k,) for k in urls], "url string")
    assert {r["url"]: (r["reason"], r["filename"]) for r in admission.admit_url(df).collect()} == urls


def test_dispatch_keeps_engine_rules(spark):
    items = {"tiny.safetensors": b"eval(", "x.unknown": b"hello", "n.onnx": bytes(range(256)) * 16, "n.pt": bytes(range(256)) * 32}
    rows = scan_corpus(frame(spark, items)).collect()
    got = {(r["artifact_id"], r["type"], r["size"]) for r in rows}
    assert got == {("x.unknown", "malformed_pickle", None), ("n.onnx", "possible_encrypted_payload", 4096),
                   ("n.pt", "possible_encrypted_payload", 8192), ("n.pt", "malformed_pickle", None)}
    with pytest.raises(ValueError):
        scan_corpus(frame(spark, items), "other")
