"""GGUF metadata as key-value rows, and the rules on its string values."""

from __future__ import annotations

import io
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from modelsieve.functions.once import computed_once

# Numpy codes of the scalar value types; 7 bool, 8 string, 9 array.
SCALARS = {0: "<u1", 1: "<i1", 2: "<u2", 3: "<i2", 4: "<u4", 5: "<i4", 6: "<f4", 7: "?", 10: "<u8", 11: "<i8", 12: "<f8"}
STRING, ARRAY = 8, 9
MAGIC = b"GGUF"
ITEMS_AT_ONCE = 1 << 16

KV_SCHEMA = "version bigint, tensors bigint, pairs bigint, position int, key string, vtype int, value string, template boolean"


class _Cursor:
    """Reads and skips in a stream of known end; nothing is ever read past it."""

    def __init__(self, stream):
        self.stream = stream
        here = stream.tell()
        self.end = stream.seek(0, io.SEEK_END)
        self.at = stream.seek(here)

    def take(self, size: int) -> bytes:
        data = self.stream.read(max(0, min(size, self.end - self.at)))
        self.at += len(data)
        return data

    def skip(self, size: int) -> None:
        self.at = self.stream.seek(min(self.end, self.at + size))

    def whole(self, width: int) -> int | None:
        """An unsigned number of ``width`` bytes, None where the file ends first."""
        data = self.take(width)
        return int.from_bytes(data, "little") if len(data) == width else None


def _nested(cursor: _Cursor, on_run, on_open, on_close) -> None:
    """Walk an array value, arrays inside it included, without recursion.

    ``on_run(type, count)`` consumes items of a plain type; the walk ends with the file.
    """
    todo: list[tuple[int, int]] = [(ARRAY, 1)]
    while todo:
        kind, count = todo.pop()
        if kind is None:
            on_close()
        elif kind != ARRAY:
            on_run(kind, count)
        elif count and cursor.at < cursor.end:
            inner, size = cursor.whole(4), cursor.whole(8)
            todo += [(ARRAY, count - 1), (None, 0)]
            on_open()
            if size is not None:
                todo.append((inner, size))


def _skip_value(cursor: _Cursor, vtype: int) -> None:
    def run(kind: int, count: int) -> None:
        if kind in SCALARS:
            cursor.skip(np.dtype(SCALARS[kind]).itemsize * count)
        elif kind == STRING:
            while count and cursor.at < cursor.end:
                cursor.skip(cursor.whole(8) or 0)
                count -= 1

    if vtype == ARRAY:
        _nested(cursor, run, lambda: None, lambda: None)
    else:
        run(vtype, 1)


def _read_value(cursor: _Cursor, vtype: int) -> str | None:
    """The value as text: strings as they are, all else as JSON. What a cut-off file lacks is left out, a cut-off
    number is 0. Unknown types have no value."""
    pieces: list[str] = []
    first = [True]

    def add(text: str) -> None:
        pieces.append(text if first[-1] else f", {text}")
        first[-1] = False

    def run(kind: int, count: int) -> None:
        if kind in SCALARS:
            width = np.dtype(SCALARS[kind]).itemsize
            while count and cursor.at < cursor.end:
                data = cursor.take(width * min(count, ITEMS_AT_ONCE))
                items = np.frombuffer(data[:len(data) // width * width], SCALARS[kind]).tolist()
                count -= max(1, len(items))
                if items:
                    add(json.dumps(items)[1:-1])
        elif kind == STRING:
            while count and cursor.at < cursor.end:
                add(json.dumps(_text(cursor), ensure_ascii=False))
                count -= 1

    def opened() -> None:
        add("[")
        first.append(True)

    def closed() -> None:
        pieces.append("]")
        first.pop()

    if vtype == STRING:
        return _text(cursor)
    if vtype == ARRAY:
        _nested(cursor, run, opened, closed)
        return "".join(pieces) or "[]"
    if vtype in SCALARS:
        run(vtype, 1)
        return "".join(pieces) or "0"
    return None


def _text(cursor: _Cursor) -> str:
    return cursor.take(cursor.whole(8) or 0).decode("utf-8", errors="replace")


def iter_kv(stream, layout: str = "u64") -> Iterator[tuple]:
    """Key-value rows of one file, headed by version and counts, values whole.

    ``layout`` is the width of the two counts: ``u64`` (format version 2 on) or
    ``u32``. A file without readable pairs gives one row with a null key; a
    file without a readable header gives none. A repeated key keeps its place
    and takes its last value.

    ``template`` marks the first key that holds a chat template (any case).

    Values are passed over once to find each key's last place, then read one at a
    time, so only keys and one value are held. Errors of the stream itself are raised.
    """
    cursor = _Cursor(stream)
    width = 8 if layout == "u64" else 4
    cursor.take(4)
    version, tensors, pairs = cursor.whole(4), cursor.whole(width), cursor.whole(width)
    if pairs is None:
        return
    places: dict[str, tuple[int, int]] = {}
    left = pairs
    while left and cursor.at < cursor.end:
        key = _text(cursor)
        vtype = cursor.whole(4) if key else None
        if vtype is None:
            break
        places[key] = (vtype, cursor.at)
        _skip_value(cursor, vtype)
        left -= 1
    limit = (1 << 63) - 1
    head = (version, min(tensors, limit), min(pairs, limit))
    template = next((k for k in places if "chat_template" in k.lower()), None)
    for position, (key, (vtype, place)) in enumerate(places.items()):
        cursor.at = cursor.stream.seek(place)
        yield (*head, position, key, min(vtype, (1 << 31) - 1), _read_value(cursor, vtype), key == template)
    if not places:
        yield (*head, None, None, None, None, None)


VALUES_PER_BATCH = 16 << 20


def kv_batches(batches, open_stream, key_field: pa.Field, layout: str, errors: tuple = ()):
    """Arrow batches of rows, bounded in characters; with ``errors`` (exception types) a last column tells why
    a file could not be read to the end."""
    types = [pa.int64()] * 3 + [pa.int32(), pa.string(), pa.int32(), pa.string(), pa.bool_()]
    names = [part.split()[0] for part in KV_SCHEMA.split(", ")]
    schema = pa.schema([key_field, *zip(names, types)] + ([("error", pa.string())] if errors else []))
    more = (None,) if errors else ()
    rows: list[tuple] = []

    def flush() -> pa.RecordBatch:
        batch = pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
        rows.clear()
        return batch

    for batch in batches:
        keys = batch.column("artifact_id")
        for i in range(batch.num_rows):
            size = 0
            try:
                with open_stream(batch, i) as stream:
                    for kv in iter_kv(stream, layout):
                        rows.append((keys[i].as_py(), *kv, *more))
                        size += len(kv[-2] or "")
                        if size > VALUES_PER_BATCH:
                            yield flush()
                            size = 0
            except errors as exc:
                rows.append((keys[i].as_py(), *[None] * 8, str(exc)))
            if rows:
                yield flush()


def gguf_metadata(df: DataFrame, layout: str = "u64") -> DataFrame:
    """Key-value rows of every GGUF artifact in a table with ``content``.

    The header sits at the front, so pass the leading bytes of large files.
    """
    key_type = df.schema["artifact_id"].dataType.simpleString()
    arrow_key = pa.field("artifact_id", pa.string() if key_type == "string" else pa.int64())

    def decode(batches):
        return kv_batches(batches, lambda b, i: io.BytesIO(b.column("content")[i].as_py() or b""),
                          arrow_key, layout)

    return (df.select("artifact_id", "content")
            .mapInArrow(decode, f"artifact_id {key_type}, {KV_SCHEMA}"))


def register_gguf_kv(spark: SparkSession, name: str = "gguf_kv") -> None:
    """Make the decoder callable from SQL: ``LATERAL gguf_kv(t.content)``."""

    @F.udtf(returnType=KV_SCHEMA)
    class GgufKv:
        def eval(self, content: bytes):
            yield from iter_kv(io.BytesIO(content or b""))

    spark.udtf.register(name, GgufKv)


def gguf_key_table(kv: DataFrame) -> DataFrame:
    """Corpus-wide use of each key: artifacts holding it and distinct values."""
    return (kv.filter("key is not null").groupBy("key", "vtype")
            .agg(F.countDistinct("artifact_id").alias("artifacts"),
                 # digests: values may be many megabytes
                 F.countDistinct(F.sha2("value", 256)).alias("distinct_values")))


# Label of the inspector's string rules, a literal that every match holds, regex; and weights.
STRING_RULES = [
    ("os.system()", "os.system", r"os\.system\s*\("), ("exec()", "exec", r"\bexec\s*\("), ("eval()", "eval", r"\beval\s*\("),
    ("subprocess", "subprocess.", r"subprocess\."), ("__import__()", "__import__", r"__import__\s*\("), ("open()", "open", r"\bopen\s*\("),
    ("os.popen()", "os.popen", r"os\.popen\s*\("), ("os.exec*()", "os.exec", r"os\.exec"), ("shutil", "shutil.", r"shutil\."),
    ("socket", "socket.", r"socket\."), ("requests", "requests.", r"requests\."), ("urllib", "urllib.", r"urllib\."),
    ("ctypes", "ctypes.", r"ctypes\."), ("<script>", "<script", r"<script"),
]
PATTERN_WEIGHT, TEMPLATE_WEIGHT = 25.0, 20.0


def folded(text: Column) -> Column:
    """Lower case in which every character that a caseless expression takes for an ASCII letter is that letter."""
    return F.lower(F.translate(text, "\u0130\u0131\u017f\u212a", "iisk"))


def gguf_metadata_rules(kv: DataFrame) -> DataFrame:
    """Rule hits on string values.

    A value is scanned under ``metadata[key]``; the first key that holds a chat
    template (any case, marked by the decoder) is reported once more as ``chat_template``. Sources that
    spell ``chat_template`` in lower case count as template injection.

    The values are decoded and looked through once. A rule's expression runs only where its literal occurs.
    """
    own = F.col("vtype") == STRING
    again = F.col("template") & (F.col("value") != "")
    source = lambda name, place: F.struct(name.alias("source"), place.alias("position"))
    sources = F.array_compact(F.array(
        F.when(own, source(F.concat(F.lit("metadata["), "key", F.lit("]")), F.col("position"))),
        F.when(again, source(F.lit("chat_template"), F.lit(None).cast("int")))))
    looked = computed_once(kv.filter(own | again), _folded=folded(F.col("value")))
    rules = F.array(*[F.struct(
        F.lit(label).alias("pattern"),
        F.when(F.contains("_folded", F.lit(literal)), F.regexp_count("value", F.lit(f"(?iuU){regex}"))).otherwise(0).cast("bigint").alias("hits"))
        for label, literal, regex in STRING_RULES])
    found = looked.select("artifact_id", F.filter(rules, lambda r: r["hits"] > 0).alias("_hits"), sources.alias("_sources")).filter(F.size("_hits") > 0)
    template = F.contains("source", F.lit("chat_template"))
    return (found.select("artifact_id", F.inline("_sources"), "_hits").select("artifact_id", "position", "source", F.explode("_hits").alias("r"))
            .select("artifact_id", "position", "source",
                    F.when(template, "chat_template_injection").otherwise("dangerous_pattern").alias("type"),
                    F.lit("malicious").alias("severity"), "r.pattern", "r.hits",
                    F.when(template, TEMPLATE_WEIGHT).otherwise(PATTERN_WEIGHT).alias("weight")))


def gguf_notes(kv: DataFrame) -> DataFrame:
    """What the inspector notes without a score: (artifact_id, type, severity, detail) with the header's counts, and the first
    key of any case that holds a chat template. One combined row per artifact is shuffled."""
    template = F.when(F.contains(F.lower("key"), F.lit("chat_template")), F.struct("position", "key", F.char_length("value").alias("chars")))
    seen = kv.groupBy("artifact_id").agg(F.max(F.struct("version", "tensors", "pairs")).alias("h"), F.min(template).alias("t"))
    note = lambda kind, detail: F.struct(F.lit(kind).alias("type"), F.lit("clean").alias("severity"), detail.alias("detail"))
    header = F.format_string("GGUF v%d — %d tensor(s), %d metadata key-value pair(s).", "h.version", "h.tensors", "h.pairs")
    found = F.format_string("Chat template found in key '%s' (%d chars).", "t.key", F.coalesce("t.chars", F.lit(0)))
    return seen.select("artifact_id", F.inline(F.array_compact(F.array(
        F.when(F.col("h.version").isNotNull(), note("header_info", header)), F.when(F.col("t").isNotNull(), note("chat_template_found", found))))))
