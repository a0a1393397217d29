"""Artifact files: listing, range reads in chunks, leading bytes, streams.

No file ever becomes one row of a shuffle. The listing does not read bytes;
executors read them through the data source of ``sources.reader``, each range in
its own row, and rows of one large file are spread over the cluster. Walkers of
a format (opcodes, key-value pairs, template blocks) stream through a file.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyarrow import fs
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from modelsieve.functions.slices import byte_slices
from modelsieve.operators.gguf import KV_SCHEMA, kv_batches
from modelsieve.operators.pickles import OPS_SCHEMA, ops_batches
from modelsieve.operators.safetensors import MAX_HEADER
from modelsieve.operators.templates import iter_blocks
from modelsieve.sources.reader import BYTES_PER_TASK, CHUNK, CONTEXT, MIB, READ_ERRORS, Stores, located, read_artifacts

DEFAULT_EXTENSIONS = ("gguf", "safetensors", "pkl", "pickle", "pt", "pth")

def artifact_manifest(spark: SparkSession, root: str, exts=DEFAULT_EXTENSIONS) -> DataFrame:
    """(path, filename, ext, length, modified) of the files below ``root``, which may hold wildcards.

    Folders are listed by tasks and no file is opened: a file costs a row, not a share of a read task or of the driver's memory.
    Left out are what Spark's readers leave out: hidden names and empty files (those are refused at upload anyway). A store that only
    Spark's readers know is listed by them.
    """
    roots = _matching(spark, root)
    try:
        located(roots[0])
    except READ_ERRORS:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    else:
        files = _listed(spark, roots)
    return describe_files(files, exts)


def _matching(spark: SparkSession, root: str) -> list[str]:
    """Full paths that ``root`` stands for; one that stands for none is an error."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
    if not found:
        raise AnalysisException(f"[PATH_NOT_FOUND] Path does not exist: {root}.")
    return [status.getPath().toString() for status in found]


def _hidden(name: str, folder: bool) -> bool:
    if folder and name.startswith(("_metadata", "_common_metadata")):
        return False
    return name.startswith((".", "_")) and not (name.startswith("_") and "=" in name) or name.endswith("._COPYING_")


def _entries(stores: Stores, path: str) -> Iterator[tuple[str, int, int, bool]]:
    """(path, length, modified, folder) of what lies in a folder, or of a file itself; a folder that is gone holds nothing."""
    system, inner = stores.locate(path)
    base = path if path.endswith("/") else f"{path}/"
    local = isinstance(system, fs.LocalFileSystem)
    own = system.get_file_info(inner.rstrip("/") or "/")
    if own.type == fs.FileType.File:
        yield path, own.size, own.mtime_ns // 1_000_000 * 1000, False
    elif local and own.type == fs.FileType.Directory:
        # read on as names come, however many the folder holds
        with os.scandir(inner) as found:
            for entry in found:
                try:
                    facts, folder = entry.stat(), entry.is_dir()
                except FileNotFoundError:
                    continue
                yield base + os.fsencode(entry.name).decode("utf-8", "replace"), facts.st_size, facts.st_mtime_ns // 1_000_000 * 1000, folder
    elif own.type == fs.FileType.Directory:
        for info in system.get_file_info(fs.FileSelector(inner, allow_not_found=True)):
            yield base + info.base_name, info.size or 0, (info.mtime_ns or 0) // 1_000_000 * 1000, info.type == fs.FileType.Directory


# A task lists upper folders until so many are open; these are dealt over the cluster, each with all below it.
OPEN_FOLDERS, LISTED_ROWS = 64, 10_000
LISTING = "path string, length bigint, micros bigint, folder boolean"


def _walk(enough: int | None):
    """Task that lists folders from the top down, and leaves those still open to others once ``enough`` are."""
    schema = pa.schema([("path", pa.string()), ("length", pa.int64()), ("micros", pa.int64()), ("folder", pa.bool_())])

    def run(batches):
        stores, rows = Stores(), []

        def flush() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(list(zip(*rows)) or [[]] * 4, schema)], schema=schema)
            rows.clear()
            return batch

        for batch in batches:
            level = []
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                (level if row[3] else rows).append(row[0] if row[3] else row)
            while level and (enough is None or len(level) < enough):
                below = []
                for path in level:
                    for entry in _entries(stores, path):
                        if _hidden(entry[0].rsplit("/", 1)[-1], entry[3]):
                            continue
                        if entry[3]:
                            below.append(entry[0])
                        elif entry[1] > 0:
                            rows.append(entry)
                        if len(rows) >= LISTED_ROWS:
                            yield flush()
                level = below
            rows += [(path, 0, 0, True) for path in level]
            yield flush()

    return run


def _listed(spark: SparkSession, roots: list[str]) -> DataFrame:
    """(path, length, modificationTime) of the files below the roots."""
    tasks = 4 * spark.sparkContext.defaultParallelism
    tops = spark.createDataFrame([(r, 0, 0, True) for r in roots], LISTING).coalesce(1).mapInArrow(_walk(OPEN_FOLDERS), LISTING)
    files = tops.repartition(tasks).mapInArrow(_walk(None), LISTING)
    return files.select("path", "length", F.timestamp_micros("micros").alias("modificationTime"))


def describe_files(files: DataFrame, exts=DEFAULT_EXTENSIONS) -> DataFrame:
    name = F.element_at(F.split("path", "/"), -1)
    ext = F.lower(F.regexp_extract(name, r"(?s)[^.].*(\.[^.]*)$", 1))
    return (files.select("path", name.alias("filename"), ext.alias("ext"), "length",
                         F.col("modificationTime").alias("modified"))
            .filter(F.col("ext").isin([f".{e.lower().lstrip('.')}" for e in exts])))


def artifact_id(path: Column, modified: Column, length: Column) -> Column:
    """Stable id of a file version, so that reruns name it the same."""
    return F.sha2(F.concat_ws("|", path, modified.cast("string"), length.cast("string")), 256)


def with_ids(manifest: DataFrame) -> DataFrame:
    return manifest.withColumn("artifact_id", artifact_id(F.col("path"), F.col("modified"), F.col("length")))


@contextmanager
def open_path(path: str):
    """Random-access read handle for a Spark path."""
    system, inner = located(path)
    handle = system.open_input_file(inner)
    try:
        yield handle
    finally:
        handle.close()


def write_files(table: DataFrame, root: str) -> None:
    """Write each row (filename, content) as a file below ``root``; a repeated task writes the same files again."""

    def run(batches):
        stores, made = Stores(), set()
        for batch in byte_slices(batches, "content"):
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                system, inner = stores.locate(f"{root.rstrip('/')}/{name}")
                folder = inner.rsplit("/", 1)[0]
                if folder not in made:
                    system.create_dir(folder, recursive=True)
                    made.add(folder)
                with system.open_output_stream(inner) as out:
                    out.write(content)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], names=["n"])

    table.select("filename", "content").mapInArrow(run, "n bigint").write.format("noop").mode("overwrite").save()


class _Prefix:
    """The first ``limit`` bytes of a handle as a stream."""

    def __init__(self, handle, limit: int):
        self.handle, self.limit = handle, limit

    def read(self, n: int = -1) -> bytes:
        left = self.limit - self.handle.tell()
        return self.handle.read(left if n is None or n < 0 else min(n, left)) if left > 0 else b""

    def readline(self) -> bytes:
        line = bytearray()
        while True:
            piece = self.read(256)
            if not piece:
                return bytes(line)
            cut = piece.find(b"\n")
            if cut >= 0:
                self.handle.seek(self.handle.tell() - len(piece) + cut + 1)
                return bytes(line + piece[:cut + 1])
            line += piece

    def seek(self, offset: int, whence: int = 0) -> int:
        base = self.handle.tell() if whence == 1 else self.limit if whence == 2 else 0
        return self.handle.seek(min(base + offset, self.limit))

    def tell(self) -> int:
        return self.handle.tell()


def spread_reads(files: DataFrame, bytes_col: Column, *keys: str) -> DataFrame:
    """Repartition read orders so that a task reads about ``BYTES_PER_TASK``.

    The orders are tiny next to the bytes they stand for, so the count must be
    set from those bytes: left to AQE, all orders would be merged into one task.
    The sum reads only the listing.
    """
    spark = files.sparkSession
    total = files.agg(F.sum(bytes_col)).first()[0] or 0
    tasks = max(spark.sparkContext.defaultParallelism, -(-int(total) // BYTES_PER_TASK))
    return files.repartition(tasks, *keys)


def artifact_chunks(manifest: DataFrame, limit: int | None = None, chunk: int = CHUNK, context: int = CONTEXT, facts: bool = False) -> DataFrame:
    """Chunk rows of every file, or of its first ``limit`` bytes; ``facts`` adds ``head`` and ``file_hash`` (in one row of each file).

    A range that cannot be read gives a row with ``error`` set instead of
    failing the job.
    """
    if "artifact_id" not in manifest.columns:
        manifest = with_ids(manifest)
    keep = ["artifact_id", "path", "filename", "ext", "length"]
    keep += [c for c in ("format",) if c in manifest.columns]
    made = ["file_len", "chunk_no", "base_offset", "own_start", "own_len", "content", *(["head", "file_hash"] if facts else []), "error"]
    return read_artifacts(manifest.select(*keep), made, limit, chunk=chunk, context=context)


def split_content(df: DataFrame, limit: int | None = None, chunk: int = CHUNK, context: int = CONTEXT) -> DataFrame:
    """The same chunk rows for a table that holds the bytes in ``content``.

    Here the shared bytes on both sides are ``context`` long.
    """
    size = F.octet_length("content").cast("bigint")
    size = size if limit is None else F.least(size, F.lit(limit).cast("bigint"))
    rows = (df.withColumn("file_len", size).withColumn("chunk_no", F.explode(F.sequence(
        F.lit(0).cast("bigint"), F.greatest(F.ceil(F.col("file_len") / chunk) - 1, F.lit(0))))))
    base = F.col("chunk_no") * chunk
    first = F.greatest(base - context, F.lit(0).cast("bigint"))
    last = F.least(base + chunk + context, F.col("file_len"))
    return (rows.withColumn("base_offset", first).withColumn("own_start", (base - first).cast("int"))
            .withColumn("own_len", F.greatest(F.least(F.lit(chunk).cast("bigint"), F.col("file_len") - base),
                                              F.lit(0).cast("bigint")).cast("int"))
            .withColumn("content", F.substring(F.col("content"), (first + 1).cast("int"),
                                               (last - first).cast("int"))))


def artifact_prefix(manifest: DataFrame, limit: int | None) -> DataFrame:
    """Add ``content``: the first ``limit`` bytes of each file, one file at a time.

    For the detectors that need a header or a template whole. Small limits
    (format detection reads 100 bytes) make this a cheap pass.
    """
    return _per_file(manifest, limit, {"content": ("binary", pa.binary())},
                     lambda handle, row: {"content": handle.read(row["length"] if limit is None else min(limit, row["length"]))})


def file_hashes(manifest: DataFrame) -> DataFrame:
    """Add ``file_hash``: SHA-256 of each whole file, streamed in blocks."""
    keep = [c for c in ("artifact_id", "path", "filename", "ext", "length", "format") if c in manifest.columns]
    return read_artifacts(manifest.select(*keep), ["file_hash", "error"])


def _read_bytes(limit: int | None) -> Column:
    return F.col("length") if limit is None else F.least(F.col("length"), F.lit(limit).cast("bigint"))


def _per_file(manifest: DataFrame, limit: int | None, added: dict, work) -> DataFrame:
    keep = [c for c in ("artifact_id", "path", "filename", "ext", "length", "format", "file_hash")
            if c in manifest.columns and c not in added]
    files = spread_reads(manifest.select(*keep), _read_bytes(limit), "path")
    types = {"string": pa.string(), "bigint": pa.int64()}
    schema = pa.schema([(f.name, types[f.dataType.simpleString()]) for f in files.schema.fields]
                       + [(n, t) for n, (_, t) in added.items()] + [("error", pa.string())])

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                result = dict.fromkeys(added) | {"error": None}
                try:
                    with open_path(row["path"]) as handle:
                        result |= work(handle, row)
                except READ_ERRORS as exc:
                    result["error"] = str(exc)
                yield pa.RecordBatch.from_pylist([row | result], schema=schema)

    sql = [f"{f.name} {f.dataType.simpleString()}" for f in files.schema.fields]
    sql += [f"{n} {k}" for n, (k, _) in added.items()] + ["error string"]
    return files.mapInArrow(run, ", ".join(sql))


@contextmanager
def _open_prefix(batch: pa.RecordBatch, i: int, limit: int | None):
    with open_path(batch.column("path")[i].as_py()) as handle:
        length = batch.column("length")[i].as_py()
        yield _Prefix(handle, length if limit is None else min(limit, length))


def pickle_ops_of_files(manifest: DataFrame, limit: int | None = None) -> DataFrame:
    """Opcode rows walked straight from the files, without holding a file in memory. A file that
    cannot be read to its end closes with a row whose op is READ_ERROR."""
    files = spread_reads(manifest.select("artifact_id", "path", "length"), _read_bytes(limit), "path")
    key = pa.field("artifact_id", pa.string())
    return files.mapInArrow(
        lambda batches: ops_batches(batches, lambda b, i: _open_prefix(b, i, limit), key, errors=READ_ERRORS),
        f"artifact_id string, {OPS_SCHEMA}")


def template_blocks_of_files(manifest: DataFrame) -> DataFrame:
    """(artifact_id, block, error): the distinct template blocks of every file, read as a stream."""
    files = spread_reads(manifest.select("artifact_id", "path", "length"), F.col("length"), "path")
    schema = pa.schema([("artifact_id", pa.string()), ("block", pa.string()), ("error", pa.string())])

    def run(batches):
        for batch in batches:
            for name, path in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                seen: set[bytes] = set()
                try:
                    with open_path(path) as handle:
                        for block in iter_blocks(handle.read):
                            digest = hashlib.sha256(block).digest()
                            if digest not in seen:
                                seen.add(digest)
                                yield pa.RecordBatch.from_pylist([{"artifact_id": name, "block": block.decode("latin-1")}], schema=schema)
                except READ_ERRORS as exc:
                    yield pa.RecordBatch.from_pylist([{"artifact_id": name, "error": str(exc)}], schema=schema)

    return files.mapInArrow(run, "artifact_id string, block string, error string")


def safetensors_heads(manifest: DataFrame) -> DataFrame:
    """Add ``content`` (length field and header, without the header if it is over the format's bound), ``file_len`` and ``error``."""

    def head(handle, row):
        data = handle.read(8)
        size = int.from_bytes(data, "little") if len(data) == 8 else 0
        return {"content": data + (handle.read(size) if size <= min(MAX_HEADER, row["length"] - 8) else b"")}

    return _per_file(manifest, MIB, {"content": ("binary", pa.binary())}, head).withColumn("file_len", F.col("length"))


def gguf_kv_of_files(manifest: DataFrame, limit: int | None = None, layout: str = "u64") -> DataFrame:
    """Key-value rows read straight from GGUF files; ``error`` is set in the last row of a file that cannot be read to its end."""
    files = spread_reads(manifest.select("artifact_id", "path", "length"), _read_bytes(limit), "path")
    key = pa.field("artifact_id", pa.string())
    return files.mapInArrow(
        lambda batches: kv_batches(batches, lambda b, i: _open_prefix(b, i, limit), key, layout, READ_ERRORS),
        f"artifact_id string, {KV_SCHEMA}, error string")
