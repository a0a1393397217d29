"""Document fingerprints by a threshold-scaled sketch of word shingles.

A text's shingles (five words, A-Z lowered) are hashed to 64 bits, and every distinct hash below a fixed fraction of the
range is kept, so a sketch grows with its text and two texts are compared on the same part of the hash space however unequal
they are. Short texts would keep next to nothing, so a sketch holds its ``LEAST`` smallest hashes in any case. Either way it
is complete below a bound: that of the fraction, its largest hash, or none if it holds all hashes. Two sketches are
compared below the lesser bound, and the sketch of a union of texts follows from their sketches (``merge``).
"""

from __future__ import annotations

import sys
from collections.abc import Iterable, Iterator
from hashlib import md5, sha256

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from modelsieve.llm.common import each_text, scratch, slices

cloudpickle.register_pickle_by_value(sys.modules[__name__])

WIDTH = 5
FRACTION = 8     # one hash in so many is kept
LEAST = 16
CHUNK = 1 << 16
ALL = (1 << 64) - 1


def kept(hashes: np.ndarray, fraction: int = FRACTION, least: int = LEAST) -> np.ndarray:
    """Of any hashes, sorted: the distinct ones below the fraction, or the ``least`` smallest if that is more."""
    hashes = np.unique(hashes)
    below = int(np.searchsorted(hashes, np.uint64(ALL // fraction), side="right"))
    return hashes[:max(below, least)]


def merge(a: np.ndarray, b: np.ndarray, fraction: int = FRACTION, least: int = LEAST) -> np.ndarray:
    """Sketch of two texts' shingles together."""
    return kept(np.concatenate([a, b]), fraction, least)


def hashed(words: list[bytes], width: int = WIDTH) -> np.ndarray:
    """Hash of every shingle, in order. Fewer words than ``width`` are one shingle, no words none."""
    if not words:
        return np.empty(0, np.uint64)
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    if len(words) < width:
        starts, ends = starts[:1], ends[-1:]
    else:
        starts, ends = starts[:len(words) - width + 1], ends[width - 1:]
    out = np.empty(len(starts), np.uint64)
    for k in range(0, len(starts), CHUNK):
        raw = b"".join([md5(line[a:b]).digest() for a, b in zip(starts[k:k + CHUNK].tolist(), ends[k:k + CHUNK].tolist())])
        out[k:k + CHUNK] = np.frombuffer(raw, ">u8")[::2]
    return out


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8").lower().split()  # bytes: A-Z and ASCII white space only


def sketch(text: str, width: int = WIDTH, fraction: int = FRACTION, least: int = LEAST) -> np.ndarray:
    """Sorted kept hashes of a whole text; without words the sketch is empty."""
    return kept(hashed(words_of(text), width), fraction, least)


def rehashed(words: list[bytes], before: list[bytes], hashes: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """Hashes of ``words``, where they start like ``before`` taken from its ``hashes``."""
    common = next((k for k, (a, b) in enumerate(zip(words, before)) if a != b), min(len(words), len(before)))
    taken = max(0, common - width + 1)
    if len(words) < width or not taken:
        return hashed(words, width)
    rest = words[taken:]
    return np.concatenate([hashes[:taken], hashed(rest, width) if len(rest) >= width else np.empty(0, np.uint64)])


def bound(hashes: np.ndarray, fraction: int = FRACTION, least: int = LEAST) -> int:
    """The largest number up to which the sketch holds every hash of its text."""
    if len(hashes) < least:
        return ALL
    return max(ALL // fraction, int(hashes[-1]))


def _met(a: np.ndarray, b: np.ndarray, fraction: int, least: int) -> tuple[int, int, int]:
    """Hashes of a, of b, and of both, as far as both sketches are complete."""
    top = np.uint64(min(bound(a, fraction, least), bound(b, fraction, least)))
    a, b = (x[:int(np.searchsorted(x, top, side="right"))] for x in (a, b))
    return len(a), len(b), len(np.intersect1d(a, b, assume_unique=True))


def likeness(a: np.ndarray, b: np.ndarray, fraction: int = FRACTION, least: int = LEAST) -> float:
    """Estimated share of common shingles among all of two texts; 1 if neither has words."""
    of_a, of_b, both = _met(a, b, fraction, least)
    return both / (of_a + of_b - both) if of_a or of_b else 1.0


def containment(a: np.ndarray, b: np.ndarray, fraction: int = FRACTION, least: int = LEAST) -> float | None:
    """Estimated share of a's shingles that b has; None if a kept none in the part compared."""
    of_a, _, both = _met(a, b, fraction, least)
    return both / of_a if of_a else None


def written(hashes: np.ndarray) -> str:
    return hashes.astype(">u8").tobytes().hex()


def parsed(fingerprint: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(fingerprint), ">u8").astype(np.uint64)


def fingerprints(documents: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, fraction: int = FRACTION,
                 least: int = LEAST) -> DataFrame:
    """(key, n_chars, fingerprint) of every row: 16 hex digits per kept hash, ascending. Null text is empty; keys are whole numbers or null."""
    schema = pa.schema([(key, pa.int64()), ("n_chars", pa.int64()), ("fingerprint", pa.string())])
    narrow = documents.select(F.col(f"`{key}`").cast("long").alias(key), F.col(f"`{text}`").alias("_text"))
    work = lambda t: (len(t), written(sketch(t, width, fraction, least)))
    return narrow.mapInArrow(lambda batches: each_text(slices(batches, 1), work, schema), f"`{key}` long, n_chars long, fingerprint string")


def members(prints: DataFrame, by: str, fraction: int = FRACTION) -> DataFrame:
    """(by, hash): what documents of each ``by`` kept below the fraction, once each.

    This is the sketch of all their texts together, as rows, so it may be of any size; repeats go before the shuffle.
    """
    cut = "0x{:016x}".format(ALL // fraction)[2:]
    size = F.length("fingerprint")
    hashes = F.transform(F.sequence(F.lit(0), F.floor(size / 16).cast("int") - 1), lambda k: F.substring("fingerprint", k * 16 + 1, F.lit(16)))
    some = prints.filter(size > 0).select(F.col(f"`{by}`").alias(by), F.explode(hashes).alias("hash"))
    return some.filter(F.col("hash") <= cut).distinct()


def contained(prints: DataFrame, collections: DataFrame, by: str, key: str = "doc_id", fraction: int = FRACTION) -> DataFrame:
    """(key, by, n_hashes, share): estimated containment of each document in each collection it meets, collections from ``members``.

    Documents count their hashes below the fraction, of which unequal sizes keep the same part. Documents that keep none, or
    meet no collection, have no row. A key on several rows counts as one document.
    """
    own = members(prints, key, fraction)
    n = own.groupBy(key).agg(F.count("*").alias("n_hashes"))
    met = own.join(collections.select(F.col(f"`{by}`").alias(by), "hash"), "hash").groupBy(key, by).agg(F.count("*").alias("_met"))
    return met.join(n, key).select(key, by, "n_hashes", (F.col("_met") / F.col("n_hashes")).alias("share"))


DIGEST = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _edited(text: str, follower: str) -> str:
    cut = len(text) // 4
    return text[:len(text) - cut] + follower[:cut]


class _Held:
    """A text with what its own row and that of the document before it need."""

    def __init__(self, text: str, how: tuple[int, int, int]) -> None:
        self.text, self.words = text, words_of(text)
        self.hashes = hashed(self.words, how[0])
        self.sketch = kept(self.hashes, *how[1:])


def _digest(own: _Held, follower: _Held, how: tuple[int, int, int]) -> tuple:
    edited = _edited(own.text, follower.text)
    changed = kept(rehashed(words_of(edited), own.words, own.hashes, how[0]), *how[1:])
    return (len(own.text), sha256(edited.encode()).hexdigest(), written(own.sketch), written(changed), likeness(own.sketch, changed, *how[1:]),
            likeness(own.sketch, follower.sketch, *how[1:]))


def _packed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts compressed one by one, for the way through the shuffle."""
    for batch in slices(batches, 3):
        raw = [value.as_py().encode() for value in batch.column(3)]
        packed = [pa.compress(r, codec="zstd", asbytes=True) for r in raw]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(packed, pa.binary()), pa.array([len(r) for r in raw], pa.int64())],
                                         names=["_key", "_digest", "_tie", "_packed", "_bytes"])


def edits(documents: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, fraction: int = FRACTION,
          least: int = LEAST) -> DataFrame:
    """(key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every row.

    The edited text has its last quarter of code points replaced by the first of the next document's, the first document following
    the last. Null texts are empty. Null keys come first, rows of one key by the MD5 of their texts; equal rows follow one another.
    Keys are whole numbers. A lone row follows itself. Other columns play no part.

    Rows are sorted by ranges, so texts are shuffled once, compressed; a task streams through its range and holds two texts. Where one
    range ends and the next begins, the two texts at the border are set aside and met afterwards: two per task.
    """
    how = (width, fraction, least)
    narrow = documents.select(F.col(f"`{key}`").cast("long").alias("_key"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("_text"))
    by = [F.col("_key").asc_nulls_first(), F.col("_digest"), F.col("_tie")]
    packed = narrow.select("_key", F.md5(F.col("_text").cast("binary")).alias("_digest"), F.monotonically_increasing_id().alias("_tie"), "_text")
    ranged = (packed.mapInArrow(_packed, "_key long, _digest string, _tie long, _packed binary, _bytes long")
              .repartitionByRange(*by).sortWithinPartitions(*by).select("_key", "_packed", "_bytes"))
    names = [x.split()[0] for x in DIGEST.split(", ")]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    schema = pa.schema([("_part", pa.int64()), ("_end", pa.int32()), ("_key", pa.int64()), ("_text", pa.string()), *zip(names, kinds)])

    def stream(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, last, rows = TaskContext.get().partitionId(), None, []

        def flush() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
            rows.clear()
            return batch

        none = (None,) * len(names)
        for batch in slices(batches, 1):
            for at, value, size in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                now = _Held(pa.decompress(value.as_buffer(), size, "zstd", asbytes=True).decode(), how)
                if last is None:
                    rows.append((part, 0, at, now.text, *none))
                else:
                    rows.append((part, None, last[0], None, *_digest(last[1], now, how)))
                last = (at, now)
            if rows:
                yield flush()
        if last is not None:
            rows.append((part, 1, last[0], last[1].text, *none))
            yield flush()

    def meet(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = pa.schema([("_key", pa.int64()), *zip(names, kinds)])
        for batch in batches:
            for at, one, other in zip(*[c.to_pylist() for c in batch.columns]):
                row = (at, *_digest(_Held(one, how), _Held(other, how), how))
                yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, fields)], schema=fields)

    # Fingerprints are hex digits of hashes: only a codec with entropy coding makes them smaller.
    made = ranged.mapInArrow(stream, f"_part long, _end int, _key long, _text string, {DIGEST}")
    path = scratch(documents.sparkSession, "edits")
    made.write.option("compression", "zstd").parquet(path)
    done = documents.sparkSession.read.schema(made.schema).parquet(path)
    heads = done.filter("_end = 0").select(F.col("_part").alias("_next"), F.col("_text").alias("_follower"))
    # One number per task of the sort.
    after = Window.orderBy("_part")
    following = F.coalesce(F.lead("_part").over(after), F.first("_part").over(after))
    order = done.filter("_end = 0").select("_part").select("_part", following.alias("_next"))
    ends = done.filter("_end = 1").select("_part", "_key", "_text").join(order, "_part").join(heads, "_next")
    met = ends.select("_key", "_text", "_follower").mapInArrow(meet, f"_key long, {DIGEST}")
    return done.filter("_end IS NULL").select("_key", *names).unionByName(met).withColumnRenamed("_key", key)


def op11_threshold_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edits(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
WITH docs AS (
    SELECT doc_id, coalesce(text, '') AS text, count(*) OVER () AS n,
        row_number() OVER (ORDER BY doc_id NULLS FIRST, md5(coalesce(text, ''))) AS r FROM documents),
texts AS (
    SELECT a.doc_id, a.r, a.r % a.n + 1 AS next, a.text,
        substr(a.text, 1, length(a.text) - length(a.text) // 4) || substr(b.text, 1, length(a.text) // 4) AS edited
    FROM docs a JOIN docs b ON b.r = a.r % a.n + 1),
words AS (
    SELECT r, edited, regexp_extract_all(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
    FROM (SELECT r, false AS edited, text AS t FROM texts UNION ALL SELECT r, true, edited FROM texts)),
placed AS (SELECT r, edited, len(w) AS n, unnest(w) AS word, unnest(range(len(w))) AS k FROM words),
shingles AS (
    SELECT r, edited, n, k, concat_ws(' ', word, lead(word, 1) OVER p, lead(word, 2) OVER p, lead(word, 3) OVER p, lead(word, 4) OVER p) AS shingle
    FROM placed WINDOW p AS (PARTITION BY r, edited ORDER BY k)),
listed AS (
    SELECT r, edited, list_sort(list(DISTINCT substr(md5(shingle), 1, 16))) AS h FROM shingles WHERE k = 0 OR k <= n - 5 GROUP BY r, edited),
hashes AS (SELECT r, edited, coalesce(h, []) AS h FROM words LEFT JOIN listed USING (r, edited)),
sketches AS (
    SELECT r, edited, h[1:greatest(16, len(list_filter(h, lambda x: x < '2')))] AS s FROM hashes),
bounded AS (
    SELECT r, edited, s, CASE WHEN len(s) < 16 THEN 'ffffffffffffffff' ELSE greatest('1fffffffffffffff', s[len(s)]) END AS top FROM sketches),
pairs AS (
    SELECT t.r, b.edited AS with_edited, list_filter(a.s, lambda x: x <= least(a.top, b.top)) AS u,
        list_filter(b.s, lambda x: x <= least(a.top, b.top)) AS v
    FROM texts t JOIN bounded a ON a.r = t.r AND NOT a.edited
    JOIN bounded b ON b.r = CASE WHEN b.edited THEN t.r ELSE t.next END),
near AS (
    SELECT r, with_edited, CASE WHEN len(u) + len(v) = 0 THEN 1.0::DOUBLE
        ELSE len(list_intersect(u, v))::DOUBLE / (len(u) + len(v) - len(list_intersect(u, v))) END AS likeness FROM pairs)
SELECT t.doc_id, length(t.text) AS n_chars, sha256(t.edited) AS edited_sha256, array_to_string(a.s, '') AS fingerprint,
    array_to_string(b.s, '') AS edited_fingerprint, e.likeness AS near_edited, f.likeness AS near_next
FROM texts t JOIN bounded a ON a.r = t.r AND NOT a.edited JOIN bounded b ON b.r = t.r AND b.edited
JOIN near e ON e.r = t.r AND e.with_edited JOIN near f ON f.r = t.r AND NOT f.with_edited
"""
