"""SimHash near-duplicates, candidates by the pigeonring principle.

A fingerprint of 64 bits is cut into ``SEGMENTS`` consecutive parts on a ring. If two fingerprints
differ in at most ``t`` bits, then some part starts a chain of consecutive parts whose first 1, 2, 3,
... parts differ in at most ``t * length / SEGMENTS`` bits together. So:

* fingerprints meet by equal values of one part (chain of length one: no difference allowed);
* inside such a group the longer chains prune pairs before the full comparison;
* groups over ``GROUP`` rows are met again by two parts, the second within its budget of one bit; what
  is still too large is cut into tiles that compare block against block. No pair is lost or capped.

Tasks give back spanning edges, not pairs, so a large group of near copies costs rows in proportion
to its size.

For a given similarity of shingle sets (``one_of_each_similar``) a few bits are too few and many bits meet everything. There
texts also meet by equal passages, cut where the words themselves say so, each text with a few leaders of a passage; the
Hamming check with a wide limit prunes these pairs, and the exact similarity of the texts decides.
"""

from __future__ import annotations

import sys
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from modelsieve.llm.common import components, each_text, slices, sorted_groups, stored

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SEED = 42
SEGMENTS = 5
GROUP = 4096
CHUNK = 1 << 16


def fingerprint(text: str, width: int = 4) -> int:
    """Signed 64-bit SimHash of the word shingles of a whole text; zero without words."""
    words = text.encode("utf-8").lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    if len(words) < width:
        starts, ends = starts[:1], ends[-1:]
    else:
        starts, ends = starts[:len(words) - width + 1], ends[width - 1:]
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for k in range(0, len(starts), CHUNK):
        hashes = np.array([digest(line[a:b], SEED) for a, b in
                           zip(starts[k:k + CHUNK].tolist(), ends[k:k + CHUNK].tolist())], dtype="<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    set_bits = np.packbits(ones * 2 > len(starts), bitorder="little")
    return int(set_bits.view("<i8")[0])


def fingerprints(documents: DataFrame, key: str = "doc_id", text: str = "text", width: int = 4) -> DataFrame:
    """(key, fp) for every row; ``fp`` is a signed long. Null text counts as empty."""
    narrow = documents.select(F.col(key), F.col(text).alias("_text"))
    kind = narrow.schema[key].dataType
    schema = pa.schema([(key, pa.int64()), ("fp", pa.int64())])
    return (narrow.select(F.col(key).cast("long").alias(key), "_text")
            .mapInArrow(lambda batches: each_text(batches, lambda t: (fingerprint(t, width),), schema),
                        f"`{key}` long, fp long").withColumn(key, F.col(key).cast(kind)))


def _bounds() -> list[tuple[int, int]]:
    """(first bit, number of bits) of every part."""
    edges = [64 * k // SEGMENTS for k in range(SEGMENTS + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def _chains(at: int, limit: int) -> list[tuple[int, int]]:
    """(bit mask, budget) of the chains of two and more parts that start at ``at``."""
    out, mask = [], 0
    for k in range(SEGMENTS):
        first, size = _bounds()[(at + k) % SEGMENTS]
        mask |= ((1 << size) - 1) << first
        if k:
            out.append((mask, limit * (k + 1) // SEGMENTS))
    return out


def _spanning(fps: np.ndarray, block: np.ndarray, at: int, limit: int) -> list[tuple[int, int]]:
    """Edges that connect what the viable pairs of one group connect; blocks, if two, only across."""
    checks = [(np.uint64(m), b) for m, b in _chains(at, limit)]
    across = block[0] != block[-1]
    if len(fps) <= 64:
        diff = fps[:, None] ^ fps[None, :]
        mask, budget = checks[0]
        rows, cols = np.nonzero(np.triu(np.bitwise_count(diff & mask) <= budget, 1))
        for mask, budget in checks[1:]:
            keep = np.bitwise_count(diff[rows, cols] & mask) <= budget
            rows, cols = rows[keep], cols[keep]
        if across:
            keep = block[rows] != block[cols]
            rows, cols = rows[keep], cols[keep]
        return list(zip(rows.tolist(), cols.tolist()))
    edges, left = [], np.arange(len(fps))
    while len(left):
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            node = queue.pop()
            near = np.arange(len(left))
            for mask, budget in checks:
                near = near[np.bitwise_count((fps[left[near]] ^ fps[node]) & mask) <= budget]
            if across:
                near = near[block[left[near]] != block[node]]
            if len(near):
                found = left[near].tolist()
                edges += [(node, x) for x in found]
                queue += found
                left = np.delete(left, near)
    return edges


def _compare(batches: Iterable[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    made: tuple[list[int], list[int]] = ([], [])

    def flush() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in made], names=["u", "v"])
        made[0].clear(), made[1].clear()
        return batch

    for group in sorted_groups(batches, ["at", "part", "next", "tile_a", "tile_b"]):
        if group.num_rows < 2:
            continue
        fp = group.column("fp").to_numpy()
        block = group.column("block").to_numpy()
        order = np.argsort(block, kind="stable")
        fp, block = fp[order], block[order]
        for a, b in _spanning(fp.view(np.uint64), block, group.column("at")[0].as_py(), limit):
            made[0].append(int(fp[a])), made[1].append(int(fp[b]))
        if len(made[0]) > CHUNK:
            yield flush()
    yield flush()


def _part(at: Column) -> Column:
    """Value of part number ``at`` (a column) of ``fp``."""
    out = F.lit(None).cast("long")
    for k, (first, size) in enumerate(_bounds()):
        out = F.when(at == k, F.shiftrightunsigned("fp", first).bitwiseAND(F.lit((1 << size) - 1))).otherwise(out)
    return out


def _with_size(rows: DataFrame, keys: list[str], size: int) -> DataFrame:
    """Add ``n``: the rows of the group if they are over ``size``, else null."""
    large = rows.groupBy(*keys).agg(F.count("*").alias("n")).filter(F.col("n") > size)
    return rows.join(large, keys, "left")


def links(fps: DataFrame, limit: int = 4, size: int = GROUP) -> DataFrame:
    """(u, v): edges connecting the distinct values of ``fp`` just as all pairs within ``limit`` bits do."""
    if not 0 <= limit < SEGMENTS:
        raise ValueError(f"limit must be below {SEGMENTS}")
    at = F.col("at")
    rows = (fps.select("fp").distinct().select("fp", F.explode(F.array(*map(F.lit, range(SEGMENTS)))).alias("at"))
            .withColumn("part", _part(at)))
    sized = _with_size(rows, ["at", "part"], size)
    small = sized.filter("n is null").select("fp", "at", "part", F.lit(-1).cast("long").alias("next"))
    flips = F.concat(F.array(F.lit(0)), *[
        F.when(at == (k - 1) % SEGMENTS, F.array(*[F.lit(1 << b) for b in range(n)])).otherwise(F.array().cast("array<int>"))
        for k, (_, n) in enumerate(_bounds())]) if limit * 2 // SEGMENTS else F.array(F.lit(0))
    large = (sized.filter("n is not null")
             .select("fp", "at", "part", _part((at + 1) % SEGMENTS).alias("_own"), F.explode(flips).alias("_flip"))
             .select("fp", "at", "part", F.col("_own").bitwiseXOR(F.col("_flip").cast("long")).alias("next")))
    large = _with_size(large, ["at", "part", "next"], size)
    blocks = F.ceil(F.coalesce(F.col("n"), F.lit(1)) / size).cast("int")
    large = (large.withColumn("_blocks", blocks)
             .withColumn("block", F.pmod(F.xxhash64("fp"), F.col("_blocks")).cast("int"))
             .withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
             .select("fp", "at", "part", "next", "block", F.least("block", "_other").alias("tile_a"),
                     F.greatest("block", "_other").alias("tile_b")))
    zero = F.lit(0)
    keys = ["at", "part", "next", "tile_a", "tile_b"]
    met = (small.withColumns({"block": zero, "tile_a": zero, "tile_b": zero}).unionByName(large)
           .repartition(*keys).sortWithinPartitions(*keys))
    return met.mapInArrow(lambda batches: _compare(batches, limit), "u long, v long")


def near_duplicates(documents: DataFrame, key: str = "doc_id", text: str = "text", width: int = 4,
                    limit: int = 4) -> DataFrame:
    """(key, fingerprint, component_id) of every row.

    Fingerprints within ``limit`` bits link; ``component_id`` is the smallest key reachable. Null and
    empty texts have fingerprint zero and link like any other. Repeated rows each come back. A null
    key comes back with the smallest other key of its component, null if there is none.
    """
    fps = stored(fingerprints(documents, key, text, width), "fingerprints")
    by_fp = fps.groupBy("fp").agg(F.min(key).alias("_least"))
    classes = _rooted(by_fp, limit)
    least = classes.groupBy("_root").agg(F.min("_least").alias("component_id"))
    of_fp = classes.join(least, "_root").select("fp", "component_id")
    return (fps.join(of_fp, "fp")
            .select(key, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"))


def _rooted(by_fp: DataFrame, limit: int) -> DataFrame:
    """Rows of distinct ``fp`` with ``_root``, the smallest fingerprint reachable."""
    roots = components(links(by_fp, limit))
    return by_fp.join(roots, by_fp.fp == roots.node, "left").withColumn("_root", F.coalesce("component", "fp")).drop("node", "component")


def one_of_each(documents: DataFrame, key: str = "doc_id", text: str = "text", width: int = 4,
                limit: int = 4) -> DataFrame:
    """The rows of ``documents``, one per group of near duplicates: that with the smallest key.

    Groups are of rows, not of keys: unlike texts under one key both stay, and rows without a key go where another row is
    their near duplicate. Keys come before null, then the smallest digest of the text counts. All columns are kept.
    """
    mark, digest = "_mark", F.sha2(F.coalesce(F.col(text), F.lit("")), 256)
    marked = documents.select(F.col(key).alias("_key"), F.col(text).alias("_text"), digest.alias(mark))
    narrow = marked.select("_key", F.col("_key").cast("long").alias("_long"), mark, "_text")
    kind = narrow.schema["_key"].dataType.simpleString()
    schema = pa.schema([("_long", pa.int64()), (mark, pa.string()), ("fp", pa.int64())])
    fps = (narrow.drop("_key").mapInArrow(lambda batches: each_text(batches, lambda t: (fingerprint(t, width),), schema),
                                          f"_long long, {mark} string, fp long")
           .select(F.col("_long").cast(kind).alias("_key"), mark, "fp"))
    fps = stored(fps, "fingerprints")
    # Two minima, each combined before the shuffle: of a fingerprint, then of a component.
    first = F.struct(F.col("_key").isNull().alias("_none"), "_key", mark)
    classes = _rooted(fps.groupBy("fp").agg(F.min(first).alias("_first")), limit)
    keep = classes.groupBy("_root").agg(F.min("_first").alias("_first")).select("_first._key", F.col("_first." + mark).alias(mark))
    return _kept_rows(documents, keep, key, text)


def _kept_rows(documents: DataFrame, keep: DataFrame, key: str, text: str) -> DataFrame:
    """The rows whose key and digest of the text are in ``keep`` (_key, _mark), each once."""
    digest, number = F.sha2(F.coalesce(F.col(text), F.lit("")), 256), "_row_of_key"
    while number in documents.columns:
        number += "_"
    rows = documents.join(keep, documents[key].eqNullSafe(keep["_key"])
                          & (F.sha2(F.coalesce(documents[text], F.lit("")), 256) == keep["_mark"]), "left_semi")
    # Rows that repeat key and text: a group limit before the shuffle leaves one of each task.
    others = F.to_json(F.struct(*[F.col(c) for c in documents.columns if c != text]))
    same = Window.partitionBy(F.col(key), digest).orderBy(others)
    return rows.withColumn(number, F.row_number().over(same)).filter(F.col(number) == 1).drop(number)


WIDE = 22        # differing bits beyond which texts of similarity 0.8 are not expected: 10 on average, deviation 3
LEADERS = 4      # texts of a passage that all others of it are compared with
PASSAGE = 8      # least words of a passage; one word in as many ends it


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8").lower().split()


def passages(words: list[bytes]) -> list[int]:
    """Hashes of the passages of a text. A passage ends at a word whose hash says so, so an edit changes those around it alone."""
    out, begin = [], 0
    for k, word in enumerate(words):
        if k - begin + 1 >= PASSAGE and xxhash.xxh64_intdigest(word, 7) % PASSAGE == 0:
            out.append(xxhash.xxh64_intdigest(b" ".join(words[begin:k + 1]), SEED))
            begin = k + 1
    if begin < len(words):
        out.append(xxhash.xxh64_intdigest(b" ".join(words[begin:]), SEED))
    return [x - (1 << 64) if x >> 63 else x for x in dict.fromkeys(out)]


def shingles(text: str, width: int) -> set[bytes]:
    """Distinct word shingles; fewer words than ``width`` are one."""
    words = words_of(text)
    return {b" ".join(words[k:k + width]) for k in range(max(1, len(words) - width + 1))} if words else set()


def _similar(batches: Iterable[pa.RecordBatch], width: int, similarity: float) -> Iterator[pa.RecordBatch]:
    """Of pairs of texts (a, b, text of a, text of b) those that are similar enough."""
    last, held = None, set()
    for batch in batches:
        found: tuple[list[int], list[int]] = ([], [])
        for a, b, one, other in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3)):
            if a != last:
                last, held = a, shingles(one.as_py(), width)
            own = shingles(other.as_py(), width)
            both = len(held & own)
            if both >= similarity * (len(held) + len(own) - both):
                found[0].append(a), found[1].append(b)
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], names=["u", "v"])


def similar_texts(narrow: DataFrame, width: int = 5, similarity: float = 0.8, limit: int = 4, wide: int = WIDE,
                  leaders: int = LEADERS) -> tuple[DataFrame, DataFrame]:
    """((_id, _mark, _first) of every distinct text, edges (u, v) between ids), from (_key, _mark, _text).

    Edges are those of ``links`` for ``limit`` bits, and pairs of at least ``similarity`` among texts that share a passage, of which one
    is a leader of the passage: the least texts in ``leaders`` random orders. A passage that very many texts hold costs rows in
    proportion to them.
    """
    schema = pa.schema([("_key", pa.int64()), ("_mark", pa.string()), ("fp", pa.int64()), ("n", pa.int64()), ("passages", pa.list_(pa.int64()))])

    def work(text: str) -> tuple:
        return fingerprint(text, width), len(shingles(text, width)), passages(words_of(text))

    prints = (narrow.select("_key", "_mark", "_text")
              .mapInArrow(lambda batches: each_text(slices(batches, 2), work, schema), "_key long, _mark string, fp long, n long, passages array<long>")
              .groupBy("_mark").agg(F.min(F.struct(F.col("_key").isNull().alias("_none"), "_key", "_mark")).alias("_first"), F.min("fp").alias("fp"),
                                    F.min("n").alias("n"), F.min("passages").alias("passages"), F.count("*").alias("copies")))
    # Written once with its numbers, so all that follows sees the same.
    prints = stored(prints.withColumn("_id", F.monotonically_increasing_id()), "prints")
    by_fp = stored(prints.groupBy("fp").agg(F.min("_id").alias("_node")), "by-fp")
    ends = links(by_fp, limit)
    near = (ends.join(by_fp.select(F.col("fp").alias("u"), F.col("_node").alias("_u")), "u")
            .join(by_fp.select(F.col("fp").alias("v"), F.col("_node").alias("_v")), "v").select(F.col("_u").alias("u"), F.col("_v").alias("v")))
    equal = prints.join(by_fp, "fp").filter("_id <> _node").select(F.col("_id").alias("u"), F.col("_node").alias("v"))
    held = stored(prints.select("_id", "fp", "n", "copies", F.explode("passages").alias("passage")), "passages")
    orders = [-F.col("copies"), *[F.xxhash64("_id", "passage", F.lit(k)) for k in range(1, leaders)]]
    least = [F.min(F.struct(o.alias("_order"), "_id", "fp", "n")).alias(f"_l{k}") for k, o in enumerate(orders)]
    led = held.groupBy("passage").agg(F.count("*").alias("_texts"), *least).filter("_texts > 1").drop("_texts")
    met = (held.join(led, "passage").select("_id", "fp", "n", F.explode(F.array(*[f"_l{k}" for k in range(leaders)])).alias("l"))
           .filter((F.col("_id") != F.col("l._id")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("l.fp"))) <= wide)
                   & (F.least("n", "l.n") >= similarity * F.greatest("n", "l.n"))))
    pairs = stored(met.select(F.least("_id", "l._id").alias("a"), F.greatest("_id", "l._id").alias("b")).distinct(), "pairs")
    needed = pairs.select(F.col("a").alias("_id")).unionByName(pairs.select(F.col("b").alias("_id"))).distinct()
    marks = needed.join(prints.select("_id", "_mark"), "_id")
    texts = stored(narrow.select("_mark", "_text").join(marks, "_mark").groupBy("_id").agg(F.min(F.coalesce("_text", F.lit(""))).alias("_text")), "texts")
    both = (pairs.join(texts.select(F.col("_id").alias("a"), F.col("_text").alias("_one")), "a")
            .join(texts.select(F.col("_id").alias("b"), F.col("_text").alias("_other")), "b").select("a", "b", "_one", "_other"))
    alike = both.mapInArrow(lambda batches: _similar(batches, width, similarity), "u long, v long")
    edges = stored(near.unionByName(equal).unionByName(alike), "edges")
    return prints.select("_id", "_mark", "_first"), edges


def one_of_each_similar(documents: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, similarity: float = 0.8,
                        limit: int = 4) -> DataFrame:
    """The rows of ``documents``, one per group of texts of at least ``similarity``: that with the smallest key.

    Similarity is that of the sets of word shingles. Groups are what links reach, of rows and not of keys, as in ``one_of_each``; null and
    empty texts are equal. Keys are whole numbers, and come before null, then the smallest digest of the text counts. All columns are kept.
    """
    digest = F.sha2(F.coalesce(F.col(text), F.lit("")), 256)
    narrow = documents.select(F.col(key).cast("long").alias("_key"), digest.alias("_mark"), F.col(text).alias("_text"))
    classes, edges = similar_texts(narrow, width, similarity, limit)
    roots = components(edges)
    rooted = classes.join(roots, classes["_id"] == roots["node"], "left").withColumn("_root", F.coalesce("component", "_id"))
    keep = rooted.groupBy("_root").agg(F.min("_first").alias("_first")).select("_first._key", "_first._mark")
    return _kept_rows(documents, keep, key, text)


def op6_simhash_pigeonring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
