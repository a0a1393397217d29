"""What the operators of this folder share: scratch tables, grouped Arrow streams, connected components."""

from __future__ import annotations

import os
import sys
import tempfile
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Executors need not have this package installed: its functions travel inside the tasks.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder below ``spark.checkpoint.dir``, which all executors share.

    On one machine (a local master) an unset folder is replaced by a temporary
    one; on a cluster that is an error, as executors would not see each other's files.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        return tempfile.mkdtemp(prefix=f"llm-{name}-")
    return f"{base.rstrip('/')}/llm-{name}-{os.urandom(8).hex()}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a scratch table and read it back: computed once, and it survives lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sorted_groups(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Cut a stream that is sorted by whole-number ``keys`` into one table per key.

    Holds one group and one batch at a time.
    """
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        cuts = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in columns])) + 1
        if rest and any(rest[-1].column(k)[-1].as_py() != c[0] for k, c in zip(keys, columns)):
            yield pa.Table.from_batches(rest)
            rest = []
        begin = 0
        for cut in cuts.tolist():
            yield pa.Table.from_batches([*rest, batch.slice(begin, cut - begin)])
            rest, begin = [], cut
        rest.append(batch.slice(begin))
    if rest:
        yield pa.Table.from_batches(rest)


SLICE = 4 << 20


def slices(batches: Iterable[pa.RecordBatch], text: int, size: int = SLICE) -> Iterator[pa.RecordBatch]:
    """Cut batches into pieces of about ``size`` bytes of the string column number ``text``, so that what is derived from them stays
    small. A longer text is a piece of its own. The allocator gives back what it holds at the end."""
    for batch in batches:
        column = batch.column(text)
        ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset:column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int32)
        begin = 0
        while begin < len(column) or not len(column):
            end = max(begin + 1, int(np.searchsorted(ends, ends[begin] + size, side="right")) - 1)
            yield batch.slice(begin, end - begin)
            begin = end
            if not len(column):
                break
    pa.default_memory_pool().release_unused()


def each_text(batches: Iterable[pa.RecordBatch], work: Callable[[str], tuple], schema: pa.Schema,
              text: str = "_text") -> Iterator[pa.RecordBatch]:
    """Apply ``work`` to one text at a time; null is the empty text. Other columns pass through."""
    for batch in batches:
        at = batch.schema.get_field_index(text)
        rows = [work(value.as_py() or "") for value in batch.column(at)]
        kept = [batch.column(k) for k in range(batch.num_columns) if k != at]
        made = list(zip(*rows)) if rows else [()] * (len(schema) - len(kept))
        added = [pa.array(column, schema.field(len(kept) + k).type) for k, column in enumerate(made)]
        yield pa.RecordBatch.from_arrays(kept + added, schema=schema)


def _find(parent: dict[int, int], x: int) -> int:
    root = x
    while (up := parent.get(root, root)) != root:
        root = up
    while (up := parent.get(x, x)) != root:
        parent[x] = root
        x = up
    return root


def _contract(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replace a partition's edges by stars around the smallest node of each component."""
    parent: dict[int, int] = {}
    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = _find(parent, u), _find(parent, v)
            if a != b:
                parent[max(a, b)] = min(a, b)
    nodes = list(parent)
    roots = [_find(parent, x) for x in nodes]
    for k in range(0, len(nodes), 1 << 16):
        yield pa.RecordBatch.from_arrays([pa.array(nodes[k:k + (1 << 16)], pa.int64()),
                                          pa.array(roots[k:k + (1 << 16)], pa.int64())], names=["u", "v"])


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node in ``edges`` (u, v long); component is the smallest node reachable.

    Partitions are contracted first, then large-star and small-star steps run
    until nothing changes. Every step takes minima by partial aggregation and
    joins them back, so a node with very many edges needs no list of its
    neighbours. State goes through ``checkpoint()``, so lost executors cost no rework.
    """
    spark = edges.sparkSession
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or scratch(spark, "components"))
    pairs = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v")
    now = pairs.mapInArrow(_contract, "u long, v long").checkpoint()
    seen = None
    while True:
        mark = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if mark == seen or not mark[0]:
            return (now.select(F.col("u").alias("node"), F.col("v").alias("component"))
                    .unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()))
        seen = mark
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = (both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .filter("u <> v").distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        now = (joined.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")),
                                               F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
               .select("e.u", "e.v").filter("u <> v").distinct().checkpoint())
