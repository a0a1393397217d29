"""Bytes of artifact files as a Spark data source.

``artifact_files`` reads the files of a stored manifest (a Parquet table with path and length). Planning looks at the lengths
alone and cuts the files, in the manifest's order, into partitions of about the same bytes; a partition names rows of the
manifest, not files, so the plan stays small. The declared columns decide what is done:

* ``content`` makes a row per chunk, with the bytes around it that neighbours share; without it a file is one row;
* ``file_hash`` adds the SHA-256 of the whole file, in the row of its last chunk;
* ``head`` adds the first bytes of the file to each row;
* every other column is taken from the manifest.

A file is opened once by a task, and chunks, hash and head come from the same reading of it. Only a file over ``SPREAD`` bytes is cut over
several tasks, and if its hash is wanted, read once more from end to end by a task of its own, which gives a row without a chunk.
A file that cannot be read, or ends before its listed length, gives a row with ``error`` instead of failing the job.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull,
                                    LessThan, LessThanOrEqual)
from pyspark.sql.types import StructType

from modelsieve.session import shared_dir

MIB = 1 << 20
# What reading can fail with; everything else is a fault of the program.
READ_ERRORS = (OSError, pa.ArrowException)
CHUNK = 4 * MIB
# What neighbouring chunks share, on either side: matches up to this many non-blank bytes are found across a border. The built-in
# signatures are under 64 bytes without blanks; a catalogue with longer ones passes its own.
CONTEXT = 64 << 10
HEAD = 100
BYTES_PER_TASK = 256 * MIB
BATCH_BYTES, BATCH_ROWS = MIB, 1000     # a row that holds more goes alone
OPEN_COST = 64 << 10     # counted per file, so that very many small files are spread too
SPREAD = 64 * MIB
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"
_BLANK = b" \t\n\r\x0b\x0c"
_MADE = ("file_len", "chunk_no", "base_offset", "own_start", "own_len", "content", "head", "file_hash", "error")


def located(path: str) -> tuple[fs.FileSystem, str]:
    """Store and plain name of a Spark path (local, hdfs, s3, gs); names may hold blanks and any other characters."""
    if path.startswith("file:"):
        path = "/" + path[len("file:"):].lstrip("/")
    if path.startswith("/"):
        return fs.LocalFileSystem(), path
    scheme, _, rest = path.partition("://")
    authority, _, name = rest.partition("/")
    scheme = "s3" if scheme in ("s3a", "s3n") else scheme
    # The root has no path, so no name in it needs quoting.
    return fs.FileSystem.from_uri(f"{scheme}://{authority}")[0], f"/{name}" if scheme in ("hdfs", "viewfs") else f"{authority}/{name}"


class Stores:
    """Clients of the stores that one task meets, each made once."""

    def __init__(self) -> None:
        self.clients: dict[str, fs.FileSystem] = {}

    def locate(self, path: str) -> tuple[fs.FileSystem, str]:
        root = path.split("://")[0] + "://" + path.split("://")[1].split("/")[0] if "://" in path else ""
        if not root or path.startswith("file:"):
            return located(path)
        if root not in self.clients:
            self.clients[root], name = located(path)
            return self.clients[root], name
        rest = path.partition("://")[2]
        return self.clients[root], "/" + rest.partition("/")[2] if path.startswith(("hdfs", "viewfs")) else rest

    @contextmanager
    def open(self, path: str):
        system, name = self.locate(path)
        handle = system.open_input_file(name)
        try:
            yield handle
        finally:
            handle.close()


def read_range(handle, base: int, size: int, limit: int, context: int = CONTEXT) -> tuple[int, bytes]:
    """Bytes of one chunk with shared context; returns (context length, bytes).

    The context after the chunk runs on until it holds ``context`` non-blank
    bytes, so a match that starts in the chunk ends in it however much blank
    space it spans.
    """
    first = max(0, base - context)
    handle.seek(first)
    data = bytearray(handle.read(min(base + size, limit) - first))
    own = data[base - first:]
    if own.strip(_BLANK):
        text, at = 0, first + len(data)
        while text < context and at < limit:
            piece = handle.read(min(context - text, limit - at))
            if not piece:
                break
            data += piece
            at += len(piece)
            text += len(piece) - sum(piece.count(bytes([b])) for b in _BLANK)
    return base - first, bytes(data)


def _manifest_parts(manifest: str) -> list[str]:
    """Parquet files of a stored table, in order."""
    system, root = located(manifest)
    found = system.get_file_info(fs.FileSelector(root))
    return sorted(f.path for f in found if f.is_file and not f.base_name.startswith(("_", ".")))


def planned(lengths: np.ndarray, per_task: int, chunk: int, spread: int, chunks: bool, hashes: bool) -> list[tuple[int, int, int, int]]:
    """(first row, end row, first chunk, end chunk) of every partition; end chunk 0 stands for whole files, -1 for the hash of one."""
    out: list[tuple[int, int, int, int]] = []
    large = np.flatnonzero(lengths > spread)
    weights = np.where(lengths > spread, 0, lengths + OPEN_COST)
    group = np.cumsum(weights) // per_task
    cuts = np.unique(np.concatenate([[0, len(lengths)], np.flatnonzero(np.diff(group)) + 1, large, large + 1])).astype(int)
    alone = set(large.tolist())
    for first, end in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        if first not in alone or not chunks:
            out.append((first, end, 0, 0))
            continue
        count, step = -(-int(lengths[first]) // chunk), max(1, per_task // chunk)
        out += [(first, end, k, min(count, k + step)) for k in range(0, count, step)]
        if hashes:
            out.append((first, end, 0, -1))
    return out


class ArtifactReader(DataSourceReader):
    def __init__(self, schema: StructType, options) -> None:
        self.names = [f.name for f in schema]
        kinds = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "timestamp": pa.timestamp("us", tz="UTC")}
        self.schema = pa.schema([(f.name, kinds[f.dataType.simpleString()]) for f in schema])
        self.manifest = options["manifest"]
        self.chunk, self.context = int(options.get("chunk", CHUNK)), int(options.get("context", CONTEXT))
        self.limit = int(options["limit"]) if "limit" in options else None
        self.parallel = int(options.get("parallelism", 1))
        self.spread = int(options.get("spread", SPREAD))
        self.filters: list = []

    def _kept(self, rows: pa.Table) -> np.ndarray:
        """Which rows of a part of the manifest pass the filters that were pushed down."""
        compare = {EqualTo: pc.equal, GreaterThan: pc.greater, GreaterThanOrEqual: pc.greater_equal, LessThan: pc.less, LessThanOrEqual: pc.less_equal}
        mask = np.ones(rows.num_rows, bool)
        for f in self.filters:
            column = rows.column(f.attribute[0])
            if isinstance(f, IsNotNull):
                passed = pc.is_valid(column)
            elif isinstance(f, In):
                passed = pc.is_in(column, pa.array(list(f.value), column.type))
            else:
                passed = compare[type(f)](column, pa.scalar(f.value, column.type))
            mask &= passed.fill_null(False).to_numpy(zero_copy_only=False)
        return mask

    def _rows(self, part: str, columns: list[str]) -> pa.Table:
        system, _ = located(self.manifest)
        with system.open_input_file(part) as handle:
            return pq.read_table(handle, columns=columns)

    def partitions(self) -> list[InputPartition]:
        used = list(dict.fromkeys(["length", *(f.attribute[0] for f in self.filters)]))
        parts = [(part, self._rows(part, used)) for part in _manifest_parts(self.manifest)]
        sizes = []
        for part, rows in parts:
            kept = self._kept(rows)
            length = rows.column("length").to_numpy(zero_copy_only=False)
            # Rows that are filtered out weigh nothing and are left out again when the partition is read.
            sizes.append(np.where(kept, length if self.limit is None or "file_hash" in self.names else np.minimum(length, self.limit), 0))
        total = sum(int(s.sum()) + OPEN_COST * len(s) for s in sizes)
        per_task = max(self.chunk, min(BYTES_PER_TASK, -(-total // self.parallel)))
        out = []
        for (part, rows), size in zip(parts, sizes):
            own = size if self.limit is None else np.minimum(size, self.limit)
            plan = planned(own if "content" in self.names else size, per_task, self.chunk, max(per_task, self.spread), "content" in self.names,
                           "file_hash" in self.names)
            out += [InputPartition((part, *p)) for p in plan]
        return out

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if partition is None or partition.value is None:
            return
        part, first, end, begin, last = partition.value
        stores, given = Stores(), [n for n in self.names if n not in _MADE]
        filtered = [f.attribute[0] for f in self.filters]
        rows = self._rows(part, list(dict.fromkeys([*given, "path", "length", *filtered]))).slice(first, end - first)
        # small rows go together, so that a batch costs little next to what it carries
        held, size = [], 0
        for row in rows.filter(pa.array(self._kept(rows))).to_pylist():
            for made in self._file(stores, row, begin, last):
                held.append({n: made.get(n, row.get(n)) for n in self.names})
                size += len(made.get("content") or b"")
                if size >= BATCH_BYTES or len(held) >= BATCH_ROWS:
                    yield pa.RecordBatch.from_pylist(held, schema=self.schema)
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(held, schema=self.schema)

    def _file(self, stores: Stores, row: dict, begin: int, last: int) -> Iterator[dict]:
        """Rows of one file; what is not declared is not made."""
        length = row["length"]
        size = length if self.limit is None else min(length, self.limit)
        count = -(-size // self.chunk) or 1
        whole = last <= 0
        chunks = range(0) if "content" not in self.names or last < 0 else range(begin, count if whole else last)
        sha = hashlib.sha256() if "file_hash" in self.names and whole else None
        made = {"file_len": size, "error": None, "head": None, "file_hash": None}
        k = begin
        try:
            with stores.open(row["path"]) as handle:
                if "head" in self.names:
                    made["head"] = handle.read(HEAD)
                held = None
                for k in chunks:
                    base = k * self.chunk
                    lead, data = read_range(handle, base, self.chunk, size, self.context)
                    own = min(self.chunk, size - base)
                    if len(data) < lead + own:
                        raise OSError(f"ends at byte {base - lead + len(data)} of {length}")
                    if sha is not None:
                        sha.update(memoryview(data)[lead:lead + own])
                    if held is not None:
                        yield held
                    held = made | {"chunk_no": k, "base_offset": base - lead, "own_start": lead, "own_len": own, "content": data}
                if sha is not None:
                    done = size if held is not None else 0
                    handle.seek(done)
                    while block := handle.read(MIB):
                        sha.update(block)
                        done += len(block)
                    if done < length:
                        raise OSError(f"ends at byte {done} of {length}")
                    made["file_hash"] = sha.hexdigest()
                if held is None:
                    yield made | {"base_offset": 0, "own_start": 0, "own_len": 0, "content": b""}
                else:
                    yield held | {"file_hash": made["file_hash"]}
        except READ_ERRORS as exc:
            yield made | {"chunk_no": k if chunks else None, "base_offset": k * self.chunk, "own_start": 0, "own_len": 0, "content": b"",
                          "file_hash": None, "error": str(exc)}


class FilteringReader(ArtifactReader):
    """The reader where the session pushes filters down: those on columns of the manifest choose files before any is opened."""

    def pushFilters(self, filters):
        for f in filters:
            known = isinstance(f, (EqualTo, In, IsNotNull, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual))
            if known and len(f.attribute) == 1 and f.attribute[0] in self.names and f.attribute[0] not in _MADE:
                self.filters.append(f)
            else:
                yield f


class ArtifactFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "artifact_files"

    def schema(self) -> str:
        return ("path string, length bigint, file_len bigint, chunk_no bigint, base_offset bigint, own_start int, own_len int, "
                "content binary, head binary, file_hash string, error string")

    def reader(self, schema: StructType) -> DataSourceReader:
        return (FilteringReader if self.options.get("pushdown") == "true" else ArtifactReader)(schema, self.options)


KINDS = {"file_len": "bigint", "chunk_no": "bigint", "base_offset": "bigint", "own_start": "int", "own_len": "int", "content": "binary",
         "head": "binary", "file_hash": "string", "error": "string"}


def stored_manifest(manifest: DataFrame) -> str:
    """Write a manifest where the planner and the executors find it."""
    path = f"{shared_dir(manifest.sparkSession, 'manifest')}/manifest"
    manifest.hint("rebalance").write.option("maxRecordsPerFile", 100_000).parquet(path)
    return path


def read_artifacts(manifest: DataFrame, made: list[str], limit: int | None = None, **options) -> DataFrame:
    """The manifest's columns and those of ``made`` (content, file_hash, head, ...) for all its files; see the module."""
    spark: SparkSession = manifest.sparkSession
    spark.dataSource.register(ArtifactFiles)
    own = [f"{f.name} {f.dataType.simpleString()}" for f in manifest.schema if f.name not in KINDS]
    options |= {"manifest": stored_manifest(manifest.select(*[f.name for f in manifest.schema if f.name not in KINDS])),
                "parallelism": str(spark.sparkContext.defaultParallelism), "pushdown": spark.conf.get(PUSHDOWN, "false")}
    if limit is not None:
        options["limit"] = limit
    return spark.read.format("artifact_files").schema(", ".join([*own, *(f"{n} {KINDS[n]}" for n in made)])).options(**options).load()
