"""Shannon entropy of fixed-size blocks and of text fields."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


# Block sizes, threshold and size floors of the engine profile.
BLOCK, ONNX_BLOCK = 8192, 4096
THRESHOLD = 7.8
MIN_FILE, MIN_BLOCK = 256, 64
TEXT_THRESHOLD, TEXT_MIN_CHARS = 7.0, 64
BYTES_AT_ONCE = 1 << 20


def _bits(counts: np.ndarray) -> np.ndarray:
    """Entropy in bits of each row of byte counts."""
    p = counts / counts.sum(axis=1, keepdims=True)
    logs = np.log2(p, out=np.zeros_like(p), where=p > 0)
    return -(p * logs).sum(axis=1)


def _block_entropies(data: np.ndarray, size: int) -> np.ndarray:
    """Entropy in bits of consecutive ``size``-byte blocks (the last may be short)."""
    blocks = -(-len(data) // size)
    cells = (np.arange(len(data)) // size) * 256 + data
    return _bits(np.bincount(cells, minlength=blocks * 256).reshape(blocks, 256).astype(float))


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def block_entropies(content: pd.Series, own_start: pd.Series, own_len: pd.Series,
                    size: pd.Series) -> pd.Series:
    """Entropy of each ``size``-byte block of the chunk's own bytes; none when size is 0."""
    out = []
    for raw, lo, length, block in zip(content, own_start, own_len, size):
        data = np.frombuffer(raw, dtype=np.uint8)[lo:lo + length]
        out.append(_block_entropies(data, int(block)) if len(data) and block else np.zeros(0))
    return pd.Series(out, dtype=object)


def value_bits(content: pa.Array) -> pa.Array:
    """Entropy in bits per byte of each binary or UTF-8 value; 0 for an empty one. Values are counted where they lie in the batch."""
    out = []
    for value in content:
        data = np.frombuffer(value.as_buffer() if value.is_valid else b"", dtype=np.uint8)
        counts = np.zeros(256)
        for k in range(0, len(data), BYTES_AT_ONCE):
            counts += np.bincount(data[k:k + BYTES_AT_ONCE], minlength=256)
        out.append(float(_bits(counts[None, :])[0]) if len(data) else 0.0)
    return pa.array(out, pa.float64())


@F.arrow_udf(T.DoubleType())
def entropy(content: pa.Array) -> pa.Array:
    return value_bits(content)


def chunk_entropy(chunks: DataFrame, size=BLOCK, threshold: float = THRESHOLD) -> DataFrame:
    """Entropy of every block of at least 64 bytes in artifacts of at least 256.

    ``size`` is an int or a column (formats differ). Chunk starts must be
    multiples of it, as those of the readers are, so that blocks line up with
    the file. ``flagged`` marks blocks above the threshold.
    """
    block = F.lit(size) if isinstance(size, int) else size
    rows = (chunks.filter(F.col("file_len") >= MIN_FILE).withColumn("_block", block)
            .select("artifact_id", "own_len", "_block",
                    (F.col("base_offset") + F.col("own_start")).alias("_at"),
                    F.posexplode(block_entropies("content", "own_start", "own_len", "_block"))
                    .alias("_i", "bits")))
    start = (F.col("_i") * F.col("_block")).cast("bigint")
    return (rows.select("artifact_id", (F.col("_at") + start).alias("offset"),
                        F.least(F.col("_block"), F.col("own_len") - start).cast("int").alias("size"), "bits")
            .filter(F.col("size") >= MIN_BLOCK)
            .select("artifact_id", "offset", "size", F.round("bits", 3).alias("entropy"),
                    (F.col("bits") > threshold).alias("flagged")))


def entropy_findings(blocks: DataFrame) -> DataFrame:
    hit = blocks.filter("flagged")
    return hit.select("artifact_id", F.lit("possible_encrypted_payload").alias("type"), "offset", "size",
                      "entropy", F.lit("high").alias("severity"),
                      F.format_string("High entropy chunk detected (%s). Possible encrypted payload.",
                                      F.col("entropy").cast("string")).alias("desc"))


def text_entropy(df: DataFrame, col: str, threshold: float = TEXT_THRESHOLD,
                 min_chars: int = TEXT_MIN_CHARS, bits: str | None = None) -> DataFrame:
    """Add ``entropy`` of the field's UTF-8 bytes and ``flagged``.

    ``bits`` names the column in which an earlier Python step has put the field's :func:`value_bits`; without it a step of its own counts them.
    """
    bits = F.col(bits) if bits else entropy(F.encode(F.col(col), "UTF-8"))
    return (df.withColumn("_bits", bits)
            .withColumn("flagged", (F.col("_bits") > threshold) & (F.char_length(col) > min_chars))
            .withColumn("entropy", F.round("_bits", 3)).drop("_bits"))
