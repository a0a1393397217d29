"""Merkle manifest of a dataset, upper proofs by butterfly exchange.

Every row is a leaf. The leaves of a group (a language) ascend by key and are cut into aligned blocks, a power of the
fanout long; a task hashes the subtree of a block. Then the blocks of a group meet in rounds: in round r, blocks whose
numbers differ only in digit r (in base fanout) swap the roots of the subtrees they hold so far, and every block of them
hashes the parent itself. After as many rounds as the block numbers have digits each block holds all siblings above it
and the group's root, so nothing is sent down the tree again. Where a group ends raggedly, the missing partners' part is
taken by the blocks that hold the same subtree, in turn, so no block answers for all.

The roots of the groups are the leaves of one more tree, built alike. All digests are lower-case hex SHA-256, and a parent is
the digest of its children's hex digests one after the other.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterable, Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from modelsieve.llm.common import sorted_groups, stored

cloudpickle.register_pickle_by_value(sys.modules[__name__])

FANOUT = 2
BLOCK = 4096
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def leaf(values: Iterable[Column]) -> Column:
    """Digest of a row: each value with its length in bytes before it, null as ``-``, so no two rows share an input."""
    def one(value: Column) -> Column:
        text = value.cast("string")
        return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))

    return F.sha2(F.concat(*[one(v) for v in values]), 256)


def levels(nodes: list[str], fanout: int, height: int) -> list[list[str]]:
    """The nodes of every level, leaves first, ``height`` levels above them."""
    out = [nodes]
    for _ in range(height):
        below = out[-1]
        out.append([digest("".join(below[k:k + fanout])) for k in range(0, len(below), fanout)])
    return out


def height(size: int, fanout: int) -> int:
    """Levels above ``size`` leaves until one node is left."""
    count = 0
    while size > 1:
        size, count = -(-size // fanout), count + 1
    return count


def fold(node: str, siblings: Iterator[str], rank: int, size: int, fanout: int = FANOUT) -> str:
    """The root that ``node`` at ``rank`` of ``size`` leaves and its siblings, level by level and left to right, lead to."""
    while size > 1:
        first = rank // fanout * fanout
        run = [node if k == rank else next(siblings) for k in range(first, min(first + fanout, size))]
        node, rank, size = digest("".join(run)), rank // fanout, -(-size // fanout)
    return node


def ranked(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """Add ``_g``, ``_rank`` and ``_size``: a number of the group that ascends with its value, the row's place in it, its rows.

    Rows are sorted by ranges, so a group of any size spans as many tasks as it needs; places follow from counts per task.
    """
    rows = rows.withColumn("_tie", F.monotonically_increasing_id())
    by = [F.col(c).asc_nulls_first() for c in (group, *order, "_tie")]
    ranged = rows.repartitionByRange(*by).sortWithinPartitions(*by).drop("_tie")
    at = ranged.columns.index(group)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranged.schema)

    def number(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, done, run, last = TaskContext.get().partitionId(), 0, 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            values = batch.column(at)
            codes = values.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
            steps = np.concatenate([[bool(done) and values[0].as_py() != last], codes[1:] != codes[:-1]])
            runs = run + np.cumsum(steps)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.full(batch.num_rows, part, np.int64)), pa.array(runs.astype(np.int64)),
                 pa.array(np.arange(done, done + batch.num_rows, dtype=np.int64))],
                names=[*batch.schema.names, "_part", "_run", "_pos"])
            done, run, last = done + batch.num_rows, int(runs[-1]), values[-1].as_py()

    numbered = stored(ranged.mapInArrow(number, f"{fields}, _part long, _run long, _pos long"), "ranked")
    runs = stored(numbered.groupBy("_part", "_run").agg(F.first(group).alias("_value"), F.min("_pos").alias("_low"), F.count("*").alias("_n")),
                  "runs")
    # One row per task of the sort.
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = runs.groupBy("_part").agg(F.sum("_n").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    runs = runs.join(parts, "_part").withColumn("_low", F.col("_low") + F.col("_base"))
    sizes = runs.groupBy("_value").agg(F.min("_low").alias("_g"), F.sum("_n").alias("_size")).withColumnRenamed("_value", "_of")
    runs = runs.join(sizes, F.col("_value").eqNullSafe(F.col("_of"))).select("_part", "_run", "_base", "_g", "_size")
    place = (F.col("_base") + F.col("_pos") - F.col("_g")).alias("_rank")
    return numbered.join(runs, ["_part", "_run"]).select(*ranged.columns, "_g", place, "_size")


SEALED = "_g long, _block long, _size long, keys array<long>, leaves binary, claims binary, node string"


def sealed(rows: DataFrame, fanout: int, block: int) -> DataFrame:
    """One row per block: the keys and digests of its leaves in order, and the root of its subtree."""
    schema = pa.schema([("_g", pa.int64()), ("_block", pa.int64()), ("_size", pa.int64()), ("keys", pa.list_(pa.int64())),
                        ("leaves", pa.binary()), ("claims", pa.binary()), ("node", pa.string())])
    deepest = height(block, fanout)

    def seal(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sorted_groups(batches, ["_g", "_block"]):
            made = part.column("_leaf").to_pylist()
            g, number, size = (part.column(c)[0].as_py() for c in ("_g", "_block", "_size"))
            node = levels([x.hex() for x in made], fanout, min(deepest, height(size, fanout)))[-1][0]
            yield pa.RecordBatch.from_pylist([{"_g": g, "_block": number, "_size": size, "keys": part.column("_key").to_pylist(), "node": node,
                                               "leaves": b"".join(made), "claims": b"".join(part.column("_claim").to_pylist())}], schema)

    cut = rows.withColumn("_block", F.floor(F.col("_rank") / block).cast("long")).select("_g", "_block", "_rank", "_size", "_key", "_leaf", "_claim")
    return stored(cut.repartition("_g", "_block").sortWithinPartitions("_g", "_block", "_rank").mapInArrow(seal, SEALED), "sealed")


def swap(state: DataFrame, width: int, fanout: int) -> DataFrame:
    """One round: blocks that differ in one digit of their numbers exchange roots of ``width`` blocks and hash the parent each for itself."""
    block, blocks = F.col("_block"), F.col("_blocks")
    own = F.floor(block / width) % fanout
    first = block - block % (width * fanout)
    asks = (state.select("_g", "_block", "_blocks", "node", own.alias("_own"), first.alias("_first"),
                         F.explode(F.array(*[F.lit(d).cast("long") for d in range(fanout)])).alias("_digit"))
            .withColumn("_start", F.col("_first") + F.col("_digit") * width).filter("_start < _blocks"))
    # A partner beyond the ragged end is replaced by one of those that hold the same subtree.
    partner = F.col("_start") + (block % width) % F.least(F.lit(width).cast("long"), blocks - F.col("_start"))
    asks = asks.withColumn("_source", F.when(F.col("_digit") == F.col("_own"), block).otherwise(partner))
    told = state.select("_g", F.col("_block").alias("_source"), F.col("node").alias("_told"))
    met = (asks.join(told, ["_g", "_source"]).groupBy("_g", "_block", "_blocks", "_own", "node")
           .agg(F.sort_array(F.collect_list(F.struct("_digit", "_told"))).alias("_run")))
    others = F.array_join(F.filter("_run", lambda x: x["_digit"] != F.col("_own"))["_told"], "")
    parent = F.sha2(F.array_join(F.col("_run._told"), "").cast("binary"), 256)
    return met.select("_g", "_block", "_blocks", others.alias("siblings"), F.when(blocks > width, parent).otherwise(F.col("node")).alias("node"))


def butterfly(blocks: DataFrame, fanout: int, block: int) -> DataFrame:
    """(_g, _block, above, subroot) of every block: the siblings above it and the root of its group."""
    state = blocks.select("_g", "_block", F.ceil(F.col("_size") / block).cast("long").alias("_blocks"), "node")
    most, width = state.agg(F.max("_blocks")).first()[0] or 0, 1
    rounds: list[DataFrame] = []
    while width < most:
        state = stored(swap(state, width, fanout), f"round-{len(rounds)}")
        rounds.append(state.select("_g", "_block", F.struct(F.lit(len(rounds)).alias("_round"), "siblings").alias("_met")))
        width *= fanout
    roots = state.select("_g", "_block", F.col("node").alias("subroot"))
    if not rounds:
        return roots.withColumn("above", F.lit(""))
    met = rounds[0]
    for more in rounds[1:]:
        met = met.unionByName(more)
    # As many entries per block as there were rounds.
    above = met.groupBy("_g", "_block").agg(F.sort_array(F.collect_list("_met")).alias("_met"))
    return roots.join(above.select("_g", "_block", F.array_join(F.col("_met.siblings"), "").alias("above")), ["_g", "_block"])


def each_leaf(row: dict, fanout: int, block: int) -> Iterator[tuple[int | None, int, str, str, list[str]]]:
    """(key, rank, leaf, claim, siblings inside the block) of a sealed block's leaves."""
    leaves, claims = ([raw[k:k + 32].hex() for k in range(0, len(raw), 32)] for raw in (row["leaves"], row["claims"]))
    tree = levels(leaves, fanout, min(height(block, fanout), height(row["_size"], fanout)))
    for at, key in enumerate(row["keys"]):
        siblings, place = [], at
        for level in tree[:-1]:
            first = place // fanout * fanout
            siblings += [level[k] for k in range(first, min(first + fanout, len(level))) if k != place]
            place //= fanout
        yield key, row["_block"] * block + at, leaves[at], claims[at], siblings


def _paths(rows: DataFrame, fields: pa.Schema, ddl: str, work: Callable[[dict, tuple], tuple], fanout: int, block: int) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                made = [work(row, found) for found in each_leaf(row, fanout, block)]
                for at in range(0, len(made), 1024):
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made[at:at + 1024]), fields)], schema=fields)

    return rows.mapInArrow(run, ddl)


def _split(hexes: str) -> list[str]:
    return [hexes[k:k + 64] for k in range(0, len(hexes), 64)]


def _tree(rows: DataFrame, group: str, fanout: int, block: int) -> tuple[DataFrame, DataFrame]:
    """Sealed blocks of rows (``group``, _key, _leaf, _claim), and what the butterfly adds to each."""
    blocks = sealed(ranked(rows, group, ["_key", "_leaf"]), fanout, block)
    return blocks, butterfly(blocks.select("_g", "_block", "_size", "node"), fanout, block)


def _whole(documents: DataFrame, key: str, group: str, fields: Iterable[str], claimed: dict[str, Column] | None, fanout: int,
           block: int) -> DataFrame:
    """Sealed blocks with all digests above them: above, subroot, _at, _groups, top, root."""
    if fanout < 2 or fanout ** height(block, fanout) != block:
        raise ValueError("block must be a power of the fanout, which is 2 or more")
    fields, claimed = list(fields), claimed or {}
    own = leaf(F.col(f"`{c}`") for c in fields)
    claim = leaf(claimed.get(c, F.col(f"`{c}`")) for c in fields)
    rows = documents.select(F.col(f"`{key}`").cast("long").alias("_key"), F.col(f"`{group}`").cast("string").alias("_group"),
                            F.unhex(own).alias("_leaf"), F.unhex(claim).alias("_claim"))
    blocks, upper = _tree(rows, "_group", fanout, block)
    upper = stored(upper, "upper")
    roots = upper.filter("_block = 0").select(F.lit(0).alias("_group"), F.col("_g").alias("_key"), F.unhex("subroot").alias("_leaf"))
    top, over = _tree(roots.withColumn("_claim", F.col("_leaf")), "_group", fanout, block)
    schema = pa.schema([("_g", pa.int64()), ("_at", pa.int64()), ("_groups", pa.int64()), ("top", pa.string()), ("root", pa.string())])
    tops = _paths(top.join(over, ["_g", "_block"]), schema, "_g long, _at long, _groups long, top string, root string",
                  lambda row, x: (x[0], x[1], row["_size"], "".join(x[4]) + row["above"], row["subroot"]), fanout, block)
    return blocks.join(upper, ["_g", "_block"]).join(stored(tops, "top"), "_g")


def proofs(documents: DataFrame, key: str = "doc_id", group: str = "lang", fields: Iterable[str] = FIELDS, fanout: int = FANOUT,
           block: int = BLOCK) -> DataFrame:
    """(key, leaf, rank, size, group_rank, groups, siblings, subroot, root) of every row.

    ``siblings`` holds hex digests level by level, left to right, first inside the group, then among the groups: ``fold`` with rank and
    size and then with group_rank and groups leads from the leaf to the root. Null keys come first in their group, rows of one
    key by their digest; equal rows are leaves of their own. The null group comes first, then by bytes. Keys are whole
    numbers. Other columns of the table play no part. An empty table gives no rows.
    """
    schema = pa.schema([(key, pa.int64()), ("leaf", pa.string()), ("rank", pa.int64()), ("size", pa.int64()), ("group_rank", pa.int64()),
                        ("groups", pa.int64()), ("siblings", pa.list_(pa.string())), ("subroot", pa.string()), ("root", pa.string())])

    def work(row: dict, found: tuple) -> tuple:
        at, rank, own, _, below = found
        return at, own, rank, row["_size"], row["_at"], row["_groups"], below + _split(row["above"]) + _split(row["top"]), row["subroot"], row["root"]

    ddl = f"`{key}` long, leaf string, rank long, size long, group_rank long, groups long, siblings array<string>, subroot string, root string"
    return _paths(_whole(documents, key, group, fields, None, fanout, block), schema, ddl, work, fanout, block)


def audit(documents: DataFrame, claimed: dict[str, Column], key: str = "doc_id", group: str = "lang", fields: Iterable[str] = FIELDS,
          fanout: int = FANOUT, block: int = BLOCK) -> DataFrame:
    """(key, leaf, subroot, root, proof_sha256, folded_root, verified) of every row.

    ``claimed`` replaces values of columns; the row so changed is folded with the original's siblings and verified against the root.
    Order, nulls, repeats and empty tables as in ``proofs``.
    """
    names = ("leaf", "subroot", "root", "proof_sha256", "folded_root")
    schema = pa.schema([(key, pa.int64()), *[(n, pa.string()) for n in names], ("verified", pa.bool_())])

    def work(row: dict, found: tuple) -> tuple:
        at, rank, own, claim, below = found
        siblings = below + _split(row["above"]) + _split(row["top"])
        walk = iter(siblings)
        root = fold(fold(claim, walk, rank, row["_size"], fanout), walk, row["_at"], row["_groups"], fanout)
        return at, own, row["subroot"], row["root"], digest("".join(siblings)), root, root == row["root"]

    ddl = f"`{key}` long, {', '.join(n + ' string' for n in names)}, verified boolean"
    return _paths(_whole(documents, key, group, fields, claimed, fanout, block), schema, ddl, work, fanout, block)


def op13_merkle_butterfly(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    claimed = F.when(tampered, F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    return audit(documents, {"n_chars": claimed})


#: crc32 from its polynomial; every level of the trees by grouping, proofs and folds along the same levels.
SQL = """
WITH RECURSIVE bits AS (
    SELECT i AS byte, i::BIGINT AS c, 0 AS k FROM range(256) r(i)
    UNION ALL SELECT byte, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
crc AS (SELECT list(c ORDER BY byte) AS t FROM bits WHERE k = 8),
raw AS (
    SELECT doc_id, lang, n_chars, source, text,
        CASE WHEN doc_id IS NULL THEN '-' ELSE octet_length(encode(doc_id::VARCHAR)) || ':' || doc_id END
        || CASE WHEN source IS NULL THEN '-' ELSE octet_length(encode(source)) || ':' || source END
        || CASE WHEN lang IS NULL THEN '-' ELSE octet_length(encode(lang)) || ':' || lang END AS head,
        CASE WHEN text IS NULL THEN '-' ELSE octet_length(encode(text)) || ':' || text END AS tail,
        xor(list_reduce(list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda k: ascii(substr(doc_id::VARCHAR, k, 1))::BIGINT),
            lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295::BIGINT), 4294967295) % 7 = 0 AS tampered
    FROM documents, crc),
leaves AS (
    SELECT doc_id, lang, sha256(head || CASE WHEN n_chars IS NULL THEN '-' ELSE length(n_chars::VARCHAR) || ':' || n_chars END || tail) AS leaf,
        sha256(head || CASE WHEN n_chars IS NULL THEN '-' ELSE length((n_chars + tampered::INT)::VARCHAR) || ':' || (n_chars + tampered::INT) END || tail) AS claim
    FROM (SELECT * REPLACE (coalesce(tampered, false) AS tampered) FROM raw)),
placed AS (
    SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n,
        dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS g FROM leaves),
tree AS (
    SELECT g, 0 AS level, pos, leaf AS node, n FROM placed
    UNION ALL
    SELECT g, level + 1, pos // 2, sha256(string_agg(node, '' ORDER BY pos)), max((n + 1) // 2) FROM tree WHERE n > 1 GROUP BY g, level, pos // 2),
subroots AS (SELECT g AS pos, node, count(*) OVER () AS n FROM tree WHERE n = 1),
top AS (
    SELECT 0 AS level, pos, node, n FROM subroots
    UNION ALL
    SELECT level + 1, pos // 2, sha256(string_agg(node, '' ORDER BY pos)), max((n + 1) // 2) FROM top WHERE n > 1 GROUP BY level, pos // 2),
walk AS (
    SELECT g, pos AS rank, 0 AS level, pos, n, claim AS node, '' AS proof FROM placed
    UNION ALL
    SELECT w.g, w.rank, w.level + 1, w.pos // 2, (w.n + 1) // 2,
        sha256(CASE WHEN s.node IS NULL THEN w.node WHEN w.pos % 2 = 0 THEN w.node || s.node ELSE s.node || w.node END), w.proof || coalesce(s.node, '')
    FROM walk w LEFT JOIN tree s ON s.g = w.g AND s.level = w.level AND s.pos = xor(w.pos, 1) WHERE w.n > 1),
climb AS (
    SELECT g, rank, 0 AS level, g AS pos, (SELECT count(*) FROM subroots) AS n, node, proof FROM walk WHERE n = 1
    UNION ALL
    SELECT w.g, w.rank, w.level + 1, w.pos // 2, (w.n + 1) // 2,
        sha256(CASE WHEN s.node IS NULL THEN w.node WHEN w.pos % 2 = 0 THEN w.node || s.node ELSE s.node || w.node END), w.proof || coalesce(s.node, '')
    FROM climb w LEFT JOIN top s ON s.level = w.level AND s.pos = xor(w.pos, 1) WHERE w.n > 1)
SELECT p.doc_id, p.leaf, s.node AS subroot, r.node AS root, sha256(c.proof) AS proof_sha256, c.node AS folded_root, c.node = r.node AS verified
FROM placed p JOIN climb c ON c.g = p.g AND c.rank = p.pos AND c.n = 1 JOIN subroots s ON s.pos = p.g, (SELECT node FROM top WHERE n = 1) r
"""
