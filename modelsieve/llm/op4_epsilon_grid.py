"""Embedding near-duplicates by an epsilon grid order join.

For unit vectors a cosine of ``c`` is a distance of sqrt(2 - 2c), the join's epsilon. Vectors are sorted
by their cells in a grid of that width over the leading principal directions, within their label; the
sorted sequence is cut into blocks. The join starts with the whole sequence against itself and descends:
two intervals are split into their parts, and pairs of parts whose boxes are farther apart than epsilon are
skipped, as no vectors in them can be close (a projection never lengthens distances). What is left are
pairs of blocks, compared exactly in double precision.

Equal vectors are one class with a count. Tasks give back link counts per class and edges that span what
a pair of blocks connects, so a dense group costs rows in proportion to its size, not its pairs.
"""

from __future__ import annotations

import sys
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from modelsieve.llm.common import components, stored

cloudpickle.register_pickle_by_value(sys.modules[__name__])

COSINE = 0.93
LEADING = 6      # principal directions that make the grid
BLOCK = 512
FAN_BITS = 3     # parts of an interval, as a power of two


def _raw(value: list[float | None] | None) -> bytes | None:
    """The vector as bytes of doubles, one form for equal vectors; None if it can link with nothing."""
    if not value or any(x is None for x in value):
        return None
    vector = np.array(value, np.float64) + 0.0
    return vector.tobytes() if np.isfinite(vector).all() and vector.any() else None


def vectors(table: DataFrame, key: str, embedding: str, label: str) -> DataFrame:
    """(_key, _label, raw) of every row; ``raw`` is null for vectors that link with nothing."""
    narrow = table.select(F.col(key).cast("long").alias("_key"), F.col(label).cast("string").alias("_label"),
                          F.col(embedding).cast("array<double>").alias("_v"))

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [_raw(x) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(raw, pa.binary())],
                                             names=["_key", "_label", "raw"])

    rows = narrow.mapInArrow(work, "_key long, _label string, raw binary")
    return rows.withColumn("raw", F.when(F.col("_label").isNotNull(), F.col("raw")))


def _matrix(raws: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(raws), np.float64).reshape(len(raws), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _products(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of products of the coordinates, one set per task and dimension."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        by_size: dict[int, list[bytes]] = {}
        for raw in batch.column(0).to_pylist():
            by_size.setdefault(len(raw) // 8, []).append(raw)
        for size, raws in by_size.items():
            x = _unit(_matrix(raws))
            sums[size] = sums.get(size, 0) + x.T @ x
    for size, table in sums.items():
        i, j = np.triu_indices(size)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), size)), pa.array(i), pa.array(j), pa.array(table[i, j])],
                                         names=["size", "i", "j", "s"])


def directions(classes: DataFrame, leading: int = LEADING) -> np.ndarray | None:
    """Leading principal directions of all vectors of the commonest dimension; d * d / 2 numbers come to the driver."""
    sized = classes.groupBy(F.octet_length("raw").alias("size")).count().orderBy(F.desc("count"), "size").first()
    if sized is None:
        return None
    size = sized["size"] // 8
    rows = (classes.filter(F.octet_length("raw") == size * 8).select("raw").mapInArrow(_products, "size long, i long, j long, s double")
            .groupBy("i", "j").agg(F.sum("s").alias("s")).collect())
    table = np.zeros((size, size))
    for r in rows:
        table[r["i"], r["j"]] = table[r["j"], r["i"]] = r["s"]
    return np.linalg.eigh(table)[1][:, ::-1][:, :leading].copy()


def _projected(raw: bytes, axes: np.ndarray | None) -> np.ndarray:
    unit = _unit(_matrix([raw]))[0]
    if axes is not None and len(unit) == len(axes):
        places = unit @ axes
        return np.pad(places, (0, LEADING - len(places)))
    return np.pad(unit[:LEADING], (0, max(0, LEADING - len(unit))))  # any orthonormal directions will do


def ordered_blocks(classes: DataFrame, axes: np.ndarray | None, width: float, size: int) -> DataFrame:
    """(_label, dim, seq parts, n, ids, weights, data, low, high): the sorted sequence in blocks of ``size`` classes."""
    cells = [f"c{k}" for k in range(LEADING)]

    def project(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raws = batch.column(batch.schema.get_field_index("raw")).to_pylist()
            at = np.floor(np.array([_projected(r, axes) for r in raws]).reshape(-1, LEADING) / width).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(c) for c in at.T]], names=[*batch.schema.names, *cells])

    fields = "id long, _label string, raw binary, n long, dim int"
    placed = stored(classes.mapInArrow(project, f"{fields}, {', '.join(c + ' int' for c in cells)}"), "cells")
    order = ["_label", "dim", *cells, "id"]
    # At least as many ranges as Spark would take; the id splits cells that hold very many vectors.
    ranges = int(placed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = placed.repartitionByRange(ranges, *order).sortWithinPartitions(*order).drop(*cells)

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, count = TaskContext.get().partitionId(), 0
        held: list[tuple] = []

        def flush() -> pa.RecordBatch:
            nonlocal count
            places = np.array([_projected(r[2], axes) for r in held])
            block = {"_label": held[0][1], "dim": held[0][4], "part": part, "line": count,
                     "ids": [r[0] for r in held], "weights": [r[3] for r in held], "data": b"".join(r[2] for r in held),
                     "low": places.min(0).tolist(), "high": places.max(0).tolist()}
            count += 1
            return pa.RecordBatch.from_pylist([block], schema=_block_schema())

        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                if held and (len(held) == size or (held[0][1], held[0][4]) != (row[1], row[4])):
                    yield flush()
                    held = []
                held.append(row)
        if held:
            yield flush()

    return stored(ranged.mapInArrow(cut, "_label string, dim int, part long, line long, ids array<long>, weights array<long>, "
                                         "data binary, low array<double>, high array<double>"), "blocks")


def _block_schema() -> pa.Schema:
    return pa.schema([("_label", pa.string()), ("dim", pa.int32()), ("part", pa.int64()), ("line", pa.int64()),
                      ("ids", pa.list_(pa.int64())), ("weights", pa.list_(pa.int64())), ("data", pa.binary()),
                      ("low", pa.list_(pa.float64())), ("high", pa.list_(pa.float64()))])


def near_blocks(blocks: DataFrame, epsilon: float) -> DataFrame:
    """(a, b): all pairs of blocks, a <= b, whose boxes are within epsilon, found by descending from the whole sequence."""
    top = blocks.agg(F.max("part").alias("p"), F.max("line").alias("l")).first()
    if top["p"] is None:
        return blocks.select(*[F.col(c).alias(f"{n}_{c}") for n in ("a", "b") for c in ("part", "line")])
    low_bits = max(1, int(top["l"]).bit_length())
    leaves = blocks.select("_label", "dim", F.shiftleft("part", low_bits).bitwiseOR(F.col("line")).alias("node"), "low", "high")
    depth = -(-(int(top["p"]).bit_length() + low_bits) // FAN_BITS)
    bounds = [f(F.col(c)[k]).alias(f"{c}{k}") for c, f in (("low", F.min), ("high", F.max)) for k in range(LEADING)]
    levels = [stored(leaves.groupBy("_label", "dim", F.shiftright("node", FAN_BITS * k).alias("node")).agg(*bounds), f"level-{k}")
              for k in range(depth + 1)]
    pairs = levels[depth].select("_label", "dim", F.col("node").alias("a"), F.col("node").alias("b"))
    for k in range(depth - 1, -1, -1):
        def side(name: str, level: DataFrame = levels[k]) -> DataFrame:
            return level.select("_label", "dim", F.shiftright("node", FAN_BITS).alias(name), F.col("node").alias(f"_{name}"),
                                *[F.col(f"{c}{i}").alias(f"{name}_{c}{i}") for c in ("low", "high") for i in range(LEADING)])

        gaps = [F.greatest(F.lit(0.0), F.col(f"a_low{i}") - F.col(f"b_high{i}"), F.col(f"b_low{i}") - F.col(f"a_high{i}"))
                for i in range(LEADING)]
        apart = sum((g * g for g in gaps[1:]), gaps[0] * gaps[0])
        met = pairs.join(side("a"), ["_label", "dim", "a"]).join(side("b"), ["_label", "dim", "b"])
        pairs = stored(met.filter((F.col("_a") <= F.col("_b")) & (apart <= epsilon * epsilon + 1e-9))
                       .select("_label", "dim", F.col("_a").alias("a"), F.col("_b").alias("b")), f"pairs-{k}")
    split = F.lit((1 << low_bits) - 1)
    ends = [x for n in ("a", "b") for x in (F.shiftright(n, low_bits).alias(f"{n}_part"), F.col(n).bitwiseAND(split).alias(f"{n}_line"))]
    return pairs.select(*ends)


def _spanning(linked: np.ndarray, same: bool) -> Iterator[tuple[int, int]]:
    """(row, column) edges that connect what the matrix connects; if ``same``, rows and columns are one set."""
    rows_left = linked.any(axis=1)
    fresh = np.ones(linked.shape[1], bool)
    if same:
        for start in range(len(linked)):
            if not (rows_left[start] and fresh[start]):
                continue
            fresh[start], todo = False, [start]
            while todo:
                row = todo.pop()
                found = np.flatnonzero(linked[row] & fresh)
                fresh[found] = False
                todo += found.tolist()
                yield from ((row, c) for c in found.tolist())
        return
    for start in range(len(linked)):
        if not rows_left[start]:
            continue
        rows_left[start], todo = False, [start]
        while todo:
            row = todo.pop()
            for c in np.flatnonzero(linked[row] & fresh).tolist():
                fresh[c] = False
                yield row, c
                more = np.flatnonzero(linked[:, c] & rows_left)
                rows_left[more] = False
                todo += more.tolist()
                yield from ((r, c) for r in more.tolist())
        # A column reached before may join this start to an earlier tree.
        for c in np.flatnonzero(linked[start] & ~fresh)[:1].tolist():
            yield start, c


def _compare(batches: Iterable[pa.RecordBatch], cosine: float) -> Iterator[pa.RecordBatch]:
    """Rows (u, n, null): u gained n links; rows (u, null, v): an edge."""
    schema = pa.schema([("u", pa.int64()), ("n", pa.int64()), ("v", pa.int64())])
    for batch in batches:
        for row in batch.to_pylist():
            ids = [np.array(row[f"{s}_ids"]) for s in "ab"]
            weights = [np.array(row[f"{s}_weights"]) for s in "ab"]
            a, b = (np.frombuffer(row[f"{s}_data"], np.float64).reshape(len(ids[k]), -1) for k, s in enumerate("ab"))
            a, b = _unit(a), _unit(b)
            same = (row["a_part"], row["a_line"]) == (row["b_part"], row["b_line"])
            linked = a @ b.T >= cosine
            if same:
                np.fill_diagonal(linked, False)
            gains = [(ids[0], linked @ weights[1])] + ([] if same else [(ids[1], weights[0] @ linked)])
            for own, n in gains:
                some = n > 0
                if some.any():
                    yield pa.RecordBatch.from_arrays([pa.array(own[some]), pa.array(n[some]), pa.nulls(int(some.sum()), pa.int64())], schema=schema)
            edges = np.array(list(_spanning(linked, same)), np.int64).reshape(-1, 2)
            if len(edges):
                yield pa.RecordBatch.from_arrays([pa.array(ids[0][edges[:, 0]]), pa.nulls(len(edges), pa.int64()),
                                                  pa.array(ids[1][edges[:, 1]])], schema=schema)


def near_duplicates(table: DataFrame, key: str = "vec_id", embedding: str = "embedding", label: str = "label",
                    cosine: float = COSINE, block: int = BLOCK) -> DataFrame:
    """(key, n_links, component_id, kept) of every row.

    Vectors of one label and one length link at ``cosine`` or more. Null labels, and vectors that are null, empty, zero or
    hold a null or non-finite component, link with nothing. Equal vectors and repeated rows link with each other.
    A row without a key gets the smallest key of its component, and is not kept.
    """
    rows = stored(vectors(table, key, embedding, label), "vectors")
    valid = rows.filter("raw is not null")
    classes = valid.groupBy("_label", "raw").agg(F.min("_key").alias("_least"), F.count("*").alias("n"))
    # Numbers given once, in a stored table: a hash could give two classes the same.
    classes = stored(classes.withColumn("id", F.monotonically_increasing_id()).withColumn("dim", (F.octet_length("raw") / 8).cast("int")), "classes")
    axes = directions(classes)
    epsilon = float(np.sqrt(2 - 2 * cosine))
    blocks = ordered_blocks(classes.select("id", "_label", "raw", "n", "dim"), axes, epsilon, block)
    pairs = near_blocks(blocks.drop("data", "ids", "weights"), epsilon)

    def side(name: str) -> DataFrame:
        return blocks.select(*[F.col(c).alias(f"{name}_{c}") for c in ("part", "line", "ids", "weights", "data")])

    met = pairs.join(side("a"), ["a_part", "a_line"]).join(side("b"), ["b_part", "b_line"])
    found = stored(met.mapInArrow(lambda batches: _compare(batches, cosine), "u long, n long, v long"), "links")
    gained = found.filter("n is not null").groupBy("u").agg(F.sum("n").alias("_gained"))
    roots = components(found.filter("v is not null").select("u", "v"))
    known = (classes.join(gained, classes.id == gained.u, "left").join(roots, classes.id == roots.node, "left")
             .select("_label", "raw", "id", "_least", "n", F.coalesce("_gained", F.lit(0)).alias("_gained"),
                     F.coalesce("component", "id").alias("_root")))
    least = known.groupBy("_root").agg(F.min("_least").alias("component_id"))
    of_class = known.join(least, "_root").select("id", "_label", "raw", "component_id", (F.col("_gained") + F.col("n") - 1).alias("n_links"))
    out = rows.join(of_class, ["_label", "raw"], "left")
    component = F.when(F.col("id").isNull(), F.col("_key")).otherwise(F.col("component_id"))
    return out.select(F.col("_key").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                      component.alias("component_id"), F.coalesce(component == F.col("_key"), F.lit(False)).alias("kept"))


def op4_epsilon_grid_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


SQL = """
WITH RECURSIVE vectors AS (
    SELECT vec_id, label, embedding::DOUBLE[] AS v, embedding IS NOT NULL AND len(embedding) > 0 AND label IS NOT NULL
        AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(embedding, lambda c: c <> 0)) > 0 AS sound
    FROM embeddings),
links AS (
    SELECT a.vec_id AS a, b.vec_id AS b FROM vectors a JOIN vectors b
        ON a.label = b.label AND a.vec_id <> b.vec_id AND a.sound AND b.sound AND len(a.v) = len(b.v)
    WHERE list_cosine_similarity(a.v, b.v) >= 0.93),
reached AS (SELECT a AS node, b AS other FROM links UNION SELECT r.node, l.b FROM reached r JOIN links l ON l.a = r.other),
least AS (SELECT node, min(other) AS component FROM reached GROUP BY node),
counted AS (SELECT a AS node, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(component, vec_id)) AS component_id,
    vec_id = least(vec_id, coalesce(component, vec_id)) AS kept
FROM vectors LEFT JOIN least ON least.node = vec_id LEFT JOIN counted ON counted.node = vec_id
"""
