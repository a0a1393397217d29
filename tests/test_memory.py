"""What Python holds at a time does not grow with the batches that Spark makes."""

import json
import tracemalloc

import pyarrow as pa

from modelsieve.functions import matching
from modelsieve.functions.slices import byte_slices
from modelsieve.operators import entropy, safetensors, scoring


def peak_of(work):
    tracemalloc.start()
    try:
        work()
        return tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_slices_keep_every_row_in_order():
    texts = ["a" * 10, None, "", "b" * 25, "c" * 3, None, "d" * 30, "e"]
    batch = pa.record_batch({"k": list(range(len(texts))), "t": pa.array(texts, pa.string())})
    slices = list(byte_slices([batch, batch.slice(3, 0), batch.slice(2, 3)], "t", most=20))
    assert [k for s in slices for k in s.column("k").to_pylist()] == [*range(len(texts)), 2, 3, 4]
    assert all(s.num_rows == 1 or sum(len(t or "") for t in s.column("t").to_pylist()) <= 20 for s in slices)
    assert [s.num_rows for s in slices] == [3, 1, 2, 1, 1, 1, 1, 1]


def test_headers_of_a_batch_are_parsed_in_small_pieces(spark):
    header = json.dumps({"__metadata__": {"note": "ab-" * 7_000, "n": 5}, "w": {}})
    batch = pa.record_batch({"artifact_id": list(range(2000)), "header_len": [len(header)] * 2000, "_present": [True] * 2000,
                             "header": [header] * 2000})
    out = iter([batch])
    rows = []

    def work():
        for piece in safetensors.parsed_batches(out):
            assert piece.nbytes < 8 << 20
            rows.extend(zip(piece.column("artifact_id").to_pylist(), piece.column("_tensors").to_pylist()))

    assert peak_of(work) < 16 << 20
    assert rows == [(k, 1) for k in range(2000)]
    table = spark.createDataFrame([(k, bytearray(len(header).to_bytes(8, "little") + header.encode())) for k in range(300)],
                                  "artifact_id bigint, content binary")
    got = safetensors.metadata_rules(table).select("artifact_id", "key", "type").collect()
    assert sorted(tuple(r) for r in got) == [(k, "note", "large_metadata_value") for k in range(300)]


def test_entropy_counts_a_long_value_in_pieces(spark):
    values = pa.array([bytes(range(256)) * (1 << 16), b"", None, b"ab"], pa.binary())
    found = []
    assert peak_of(lambda: found.extend(entropy.entropy.func(values).to_pylist())) < 32 << 20
    assert found == [8.0, 0.0, 0.0, 1.0]
    rows = spark.createDataFrame([(bytearray(v) if v is not None else None,) for v in values.to_pylist()[1:]], "v binary")
    assert [r[0] for r in rows.select(entropy.entropy("v")).collect()] == [0.0, 0.0, 1.0]


def test_rules_are_matched_on_one_chunk_at_a_time(spark):
    rules = [matching.Rule("call", r"eval\s*\(", "eval"), matching.Rule("text", r"\bexec\b", "exec", ignore_case=False, text=True)]
    chunk = b"x" * 20_000 + b" EVAL (1) exec "
    n, size = 1000, len(chunk)
    columns = [pa.array([chunk] * n, pa.binary()), pa.array([100] * n, pa.int64()), pa.array([0] * n, pa.int32()), pa.array([size] * n, pa.int32()),
               pa.array([[0, 1]] * (n - 1) + [[]], pa.list_(pa.int32()))]
    found = []
    assert peak_of(lambda: found.append(matching.match_offsets(rules).func(*columns))) < 8 << 20
    rows = found[0].to_pylist()
    assert rows[:-1] == [[{"rule": 0, "start": 20_101}, {"rule": 1, "start": 20_110}]] * (n - 1) and rows[-1] == []


def test_risk_of_headers_that_fill_many_slices(spark):
    """The inspector's score is the sum over all slices of a partition, whatever rows share a slice."""
    def content(k):
        raw = json.dumps({"__metadata__": {"note": "ab-" * 7_000 + ("eval (1)" if k % 2 else "")}, "w": {}}).encode()
        return bytearray((len(raw) if k % 5 else 0).to_bytes(8, "little") + raw)

    table = spark.createDataFrame([(k, content(k)) for k in range(400)], "artifact_id bigint, content binary").coalesce(1)
    found = safetensors.safetensors_header_rules(table).select("artifact_id", "type", "severity", "weight").unionByName(
        safetensors.metadata_rules(table).filter("profile = 'inspector'").select("artifact_id", "type", "severity", "weight"))
    got = {r["artifact_id"]: r["risk_score"] for r in scoring.inspector_risk(found).collect()}
    assert got == {k: 5.0 if k % 5 == 0 or k % 2 == 0 else 25.0 for k in range(400)}


def test_entropy_of_metadata_is_counted_where_the_header_is_parsed(spark):
    """One Python step, so one worker a task; it flags what the entropy operator flags in the values."""
    noisy = "".join(chr(32 + k % 95) + chr(128 + k * 61 % 1900) * (k % 2) for k in range(800))
    metas = [{"noisy": noisy, "short": noisy[:60], "list": [noisy], "n": 5, "none": None, "plain": "x" * 100, "empty": ""}, {}, None, [noisy], {"noisy": noisy}]
    raws = [json.dumps({"__metadata__": m, "w": {}}).encode() for m in metas] + [b"no json"]
    table = spark.createDataFrame([(k, bytearray(len(r).to_bytes(8, "little") + r)) for k, r in enumerate(raws)] + [(9, None)],
                                  "artifact_id bigint, content binary").coalesce(1)
    rules = safetensors.metadata_rules(table)
    plan = rules._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "EvalPython" not in plan
    got = sorted(tuple(r) for r in rules.filter("type = 'high_entropy_metadata'").select("artifact_id", "key").collect())
    plain = entropy.text_entropy(safetensors.metadata_values(table), "value").filter("flagged").select("artifact_id", "key")
    assert got == sorted(tuple(r) for r in plain.collect()) == [(0, "noisy"), (4, "noisy")]


def test_bits_of_a_slice_belong_to_its_own_values():
    headers = [json.dumps({"__metadata__": {"a": "ab" * k, "b": k, "c": "abcd"}}) if k % 3 else None for k in range(50)]
    batch = pa.record_batch({"header": pa.array(headers, pa.string())}).slice(7)
    found = pa.Table.from_batches(safetensors.parsed_batches([batch], bits=True)).column("_meta").to_pylist()
    assert [[(e["key"], e["bits"]) for e in row] for row in found] == [
        [("a", 1.0), ("b", 0.0), ("c", 2.0)] if k % 3 else [] for k in range(7, 50)]
