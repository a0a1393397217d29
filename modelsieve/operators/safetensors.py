"""SafeTensors headers: corpus table, structural rules, metadata rules."""

from __future__ import annotations

import json
from functools import partial

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modelsieve.functions.once import computed_once
from modelsieve.functions.slices import byte_slices
from modelsieve.operators.entropy import text_entropy, value_bits

MAX_HEADER = 100 * (1 << 20)

# Inspector finding, severity, weight per header state.
HEADER_STATES = [
    ("invalid_header", "malicious", 25.0),
    ("oversized_header", "malicious", 30.0),
    ("empty_header", "suspicious", 5.0),
    ("truncated_header", "malicious", 20.0),
    ("invalid_json", "malicious", 25.0),
    ("invalid_header_type", "malicious", 20.0),
    ("invalid_metadata_type", "suspicious", 10.0),
    ("header_info", "clean", 0.0),
]

# Label, regex, weight of the inspector's text rules.
TEXT_RULES = [
    ("URL", r"""https?://[^\s"'\\]+""", 10.0),
    ("base64 blob", r"(?:[A-Za-z0-9+/]{40,}={0,2})", 10.0),
    ("<script> tag", r"<script[^>]*>", 15.0),
    ("code execution", r"os\.system|subprocess\.|eval\s*\(|exec\s*\(", 20.0),
    ("__import__", r"__import__\s*\(", 20.0),
]
ENGINE_URL = r"""https?://[^\s'"]+"""
LARGE_VALUE_CHARS, LARGE_VALUE_WEIGHT = 10_000, 5.0


def _declared_length(content: Column) -> Column:
    """Unsigned little-endian 64-bit length in the first eight bytes."""
    digits = F.hex(F.substring(content, 1, 8))
    big_endian = F.concat(*[F.substring(digits, 15 - 2 * i, 2) for i in range(8)])
    return F.conv(big_endian, 16, 10).cast("decimal(20,0)")


def _json_kind(value) -> str:
    return {dict: "OBJECT", list: "ARRAY", str: "STRING", bool: "BOOLEAN", type(None): "VOID"}.get(type(value), "NUMBER")


def parse_header(text: str) -> tuple[str | None, str | None, int | None, list[dict]]:
    """(kind of the root, kind of the metadata, tensors, string values of the metadata) of a header of any size.

    A header that is not JSON has no kind; metadata that is missing has none either.
    """
    try:
        root = json.loads(text)
    except (ValueError, RecursionError):
        return None, None, None, []
    if not isinstance(root, dict):
        return _json_kind(root), None, None, []
    meta = root.get("__metadata__")
    known = _json_kind(meta) if "__metadata__" in root else None
    entries = [{"key": k, "kind": _json_kind(v), "value": v if isinstance(v, str) else json.dumps(v, ensure_ascii=False, separators=(",", ":"))}
               for k, v in meta.items()] if isinstance(meta, dict) else []
    return "OBJECT", known, len(root.keys() - {"__metadata__"}), entries


_ENTRY = pa.struct([("key", pa.string()), ("kind", pa.string()), ("value", pa.string())])


def _with_bits(meta: pa.ListArray) -> pa.ListArray:
    """The entries with the entropy of their string values, 0 for other kinds."""
    entries = meta.values
    strings = pc.if_else(pc.equal(entries.field("kind"), "STRING"), entries.field("value"), pa.scalar(None, pa.string()))
    return pa.ListArray.from_arrays(meta.offsets, pa.StructArray.from_arrays(
        [*entries.flatten(), value_bits(strings)], fields=[*_ENTRY, pa.field("bits", pa.float64())]))


def parsed_batches(batches, bits: bool = False):
    """Batches with ``header`` and, for a few megabytes of headers at a time, what is parsed from it; with ``bits`` the entropy of values too."""
    for batch in byte_slices(batches, "header"):
        texts = batch.column("header").to_pylist()
        kinds, metas, tensors, entries = zip(*[(None, None, None, []) if t is None else parse_header(t) for t in texts])
        meta = pa.array(entries, pa.list_(_ENTRY))
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(kinds, pa.string()), pa.array(metas, pa.string()), pa.array(tensors, pa.int32()),
             _with_bits(meta) if bits else meta], names=[*batch.schema.names, "_kind", "_meta_kind", "_tensors", "_meta"])


def with_header(df: DataFrame, bits: bool = False) -> DataFrame:
    """(artifact_id, header_len, _present, header, _kind, _meta_kind, _tensors, _meta), the header parsed once per row.

    ``content`` needs only the bytes up to the end of the header; pass the file
    size as ``file_len`` when the content is cut. Python holds the objects of a few
    megabytes of headers at a time, however many a batch has. With ``bits`` the
    entries of ``_meta`` have the entropy of their string values, counted in the same
    Python step, so that a task needs one worker and not two.
    """
    total = F.col("file_len") if "file_len" in df.columns else F.octet_length("content").cast("bigint")
    length = F.when(F.octet_length("content") >= 8, _declared_length(F.col("content")))
    df = computed_once(df.select("artifact_id", "content", total.alias("_total")), header_len=length)
    present = F.col("header_len") <= F.col("_total") - 8
    raw = F.when(present, F.substring(F.col("content"), F.lit(9), F.col("header_len").cast("int")).cast("string"))
    df = df.withColumn("_present", F.coalesce(present, F.lit(False))).withColumn("_text", raw)
    df = df.select("artifact_id", "header_len", "_present", F.when(F.is_valid_utf8("_text"), F.col("_text")).alias("header"))

    kind = df.schema["artifact_id"].dataType.simpleString()
    entry = "key:string,kind:string,value:string" + ",bits:double" * bits
    return df.mapInArrow(partial(parsed_batches, bits=bits),
                         f"artifact_id {kind}, header_len decimal(20,0), _present boolean, header string, _kind string, "
                         f"_meta_kind string, _tensors int, _meta array<struct<{entry}>>")


def _is_object(kind: Column) -> Column:
    return kind == "OBJECT"


def safetensors_header(df: DataFrame) -> DataFrame:
    """(artifact_id, status, header_len, n_tensors, metadata) per artifact.

    Status: too_small, malformed (length beyond the file, or not JSON, or a root
    or metadata that is not a JSON object) or ok.
    """
    h = with_header(df)
    bad_meta = F.col("_meta_kind").isNotNull() & ~_is_object(F.col("_meta_kind"))
    status = (F.when(F.col("header_len").isNull(), "too_small")
              .when(F.col("_kind").isNull() | ~_is_object(F.col("_kind")) | bad_meta, "malformed")
              .otherwise("ok"))
    meta = F.map_from_entries(F.transform("_meta", lambda m: F.struct(m["key"], m["value"])))
    return h.withColumn("status", status).select(
        "artifact_id", "status",
        # lengths beyond a bigint are shown as its largest value
        F.when(F.col("header_len").isNotNull(), F.least(
            F.col("header_len"), F.lit((1 << 63) - 1).cast("decimal(20,0)"))).cast("bigint").alias("header_len"),
        F.when(F.col("status") == "ok", F.col("_tensors")).alias("n_tensors"),
        F.when(F.col("status") == "ok", meta).alias("metadata"))


def safetensors_header_rules(df: DataFrame) -> DataFrame:
    """Inspector verdict on the header, one finding per artifact.

    States are tested in order and the first that holds is reported. Only
    ``invalid_metadata_type`` and ``header_info`` go on to the text rules
    (``parsed`` is true for them).
    """
    return _header_state(with_header(df)).select("artifact_id", "type", "severity", "weight", "header", "parsed")


def _header_state(h: DataFrame) -> DataFrame:
    n = F.col("header_len")
    bad_meta = (F.col("_meta_kind").isNotNull() & ~_is_object(F.col("_meta_kind"))
                & (F.col("_meta_kind") != "VOID"))
    state = (F.when(n.isNull(), "invalid_header").when(n > MAX_HEADER, "oversized_header")
             .when(n == 0, "empty_header").when(~F.col("_present"), "truncated_header")
             .when(F.col("_kind").isNull(), "invalid_json")
             .when(~_is_object(F.col("_kind")), "invalid_header_type")
             .when(bad_meta, "invalid_metadata_type").otherwise("header_info"))
    facts = F.create_map(*[x for name, sev, w in HEADER_STATES for x in (
        F.lit(name), F.struct(F.lit(sev).alias("severity"), F.lit(w).alias("weight")))])
    return (computed_once(h, type=state).withColumn("_f", facts[F.col("type")])
            .select("*", "_f.severity", "_f.weight", F.col("type").isin("invalid_metadata_type", "header_info").alias("parsed")).drop("_f"))


def metadata_values(df: DataFrame) -> DataFrame:
    """(artifact_id, key, value): the string values of ``__metadata__``."""
    return (with_header(df).select("artifact_id", F.explode("_meta").alias("m")).filter("m.kind = 'STRING'")
            .select("artifact_id", "m.key", "m.value"))


def metadata_rules(df: DataFrame) -> DataFrame:
    """Findings on header text and metadata values, as ``profile`` rows.

    engine: first URL and high entropy per value. inspector: five rules on the
    whole header text with occurrence counts, and over-long values. Over-long
    values are reported once each.
    """
    h = _header_state(with_header(df, bits=True))
    # one row per value and one for the header text, from one pass over the headers; header texts have no entropy rule
    strings = F.filter("_meta", lambda m: m["kind"] == "STRING")
    none = F.lit(None).cast("string")
    text_row = F.when(F.col("parsed"), F.array(F.struct(none.alias("key"), F.col("header").alias("value"), F.lit(0.0).alias("bits")))).otherwise(F.array())
    rows = h.select("artifact_id", F.inline(F.concat(*[
        F.transform(part, lambda m: F.struct(F.lit(whole).alias("whole"), m["key"].alias("key"), m["value"].alias("value"), m["bits"].alias("_counted")))
        for part, whole in ((strings, False), (text_row, True))])))
    one = ~F.col("whole")
    values = text_entropy(rows, "value", bits="_counted")
    url = F.regexp_extract("value", ENGINE_URL, 0)
    finding = lambda prof, kind, sev, **kw: F.struct(
        F.lit(prof).alias("profile"), F.lit(kind).alias("type"), F.lit(sev).alias("severity"),
        kw.get("pattern", F.lit(None).cast("string")).alias("pattern"),
        kw.get("count", F.lit(1).cast("bigint")).alias("hits"),
        F.lit(kw.get("weight", 0.0)).alias("weight"),
        F.lit(kw.get("cvss")).cast("double").alias("cvss_score"))
    of_value = F.array_compact(F.array(
        F.when(one & F.col("flagged"), finding("engine", "high_entropy_metadata", "high", cvss=7.5)),
        F.when(one & (url != ""), finding("engine", "suspicious_url_metadata", "medium", pattern=url, cvss=5.5)),
        F.when(one & (F.char_length("value") > LARGE_VALUE_CHARS), finding(
            "inspector", "large_metadata_value", "suspicious", weight=LARGE_VALUE_WEIGHT))))
    of_text = F.array(*[finding("inspector", "header_pattern", "malicious" if w >= 20 else "suspicious", pattern=F.lit(label), weight=w,
                                count=F.regexp_count("value", F.lit(f"(?iu){regex}")).cast("bigint"))
                        for label, regex, w in TEXT_RULES])
    return (values.select("artifact_id", "key", F.explode(F.when(one, of_value).otherwise(F.filter(of_text, lambda f: f["hits"] > 0))).alias("f"))
            .select("artifact_id", "key", "f.*"))


def safetensors_notes(df: DataFrame) -> DataFrame:
    """What the inspector notes without a score: (artifact_id, type, severity, detail) with the metadata's keys, the first ten of them
    in order, and the safety of the format where the text rules found nothing malicious."""
    h = _header_state(with_header(df)).filter("parsed")
    names = F.array_sort(F.array_distinct(F.transform("_meta", lambda m: m["key"])))
    keys = F.concat(F.format_string("__metadata__ contains %d key(s): ", F.size(names)), F.array_join(F.slice(names, 1, 10), ", "),
                    F.when(F.size(names) > 10, "…").otherwise(""))
    malicious = F.lit(False)
    for _, regex, weight in TEXT_RULES:
        if weight >= 20:
            malicious = malicious | F.col("header").rlike(f"(?iu){regex}")
    note = lambda kind, detail: F.struct(F.lit(kind).alias("type"), F.lit("clean").alias("severity"), detail.alias("detail"))
    safe = F.lit("SafeTensors format does not support arbitrary code execution. This is inherently safer than Pickle.")
    return h.select("artifact_id", F.inline(F.array_compact(F.array(
        F.when((F.col("type") == "header_info") & _is_object(F.col("_meta_kind")), note("metadata_info", keys)),
        F.when(~malicious, note("format_safety", safe))))))
