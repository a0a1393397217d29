"""Pickle opcode audit: streams are walked, never loaded."""

from __future__ import annotations

import io
import pickletools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


# Imports considered harmless, scores, vectors and the texts of findings below.
SAFE_IMPORTS = [("numpy.core.multiarray", "_reconstruct"), ("numpy.core.multiarray", "scalar"),
                ("numpy", "dtype"), ("collections", "OrderedDict"),
                ("torch._utils", "_rebuild_tensor_v2")]
HIGH_MODULES = ["os", "subprocess", "sys", "builtins", "pty"]
SCORED_MODULES = ["os", "subprocess", "builtins"]
GLOBAL_SCORE, GLOBAL_REST_SCORE, REDUCE_SCORE, MALFORMED_SCORE = 8.4, 5.5, 9.8, 5.5
GLOBAL_VECTOR = "CVSS:3.1/AV:L/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H"
REDUCE_VECTOR = "CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H"
MALFORMED_VECTOR = "CVSS:3.1/AV:L/AC:L/PR:N/UI:N/S:U/C:N/I:L/A:H"

KEPT = ("GLOBAL", "REDUCE", "STACK_GLOBAL")
OPS_SCHEMA = "pos bigint, op string, arg string"


def iter_ops(stream) -> Iterator[tuple[int, str, str | None]]:
    """(pos, op, arg) of the opcodes the audit needs; a broken stream ends in MALFORMED.

    Errors of reading itself say nothing about the bytes and are raised.
    """
    try:
        for opcode, arg, pos in pickletools.genops(stream):
            if opcode.name in KEPT:
                yield pos, opcode.name, arg if opcode.name == "GLOBAL" else None
    except (OSError, pa.ArrowException):
        raise
    except Exception as exc:  # any error in untrusted bytes is itself the finding
        yield 0, "MALFORMED", str(exc)


def ops_batches(batches, open_stream, key_field: pa.Field, rows_per_batch: int = 10_000, errors: tuple = ()):
    """Arrow batches of opcode rows; ``open_stream(batch, i)`` gives row i's bytes. Of ``errors`` (exception types)
    one ends a file's rows with the op READ_ERROR."""
    schema = pa.schema([key_field, ("pos", pa.int64()), ("op", pa.string()), ("arg", pa.string())])
    rows: list[tuple] = []

    def flush() -> pa.RecordBatch:
        columns = list(zip(*rows)) if rows else [[], [], [], []]
        return pa.record_batch([pa.array(c, t.type) for c, t in zip(columns, schema)], schema=schema)

    for batch in batches:
        keys = batch.column("artifact_id")
        for i in range(batch.num_rows):
            try:
                with open_stream(batch, i) as stream:
                    for op in iter_ops(stream):
                        rows.append((keys[i].as_py(), *op))
                        if len(rows) >= rows_per_batch:
                            yield flush()
                            rows.clear()
            except errors as exc:
                rows.append((keys[i].as_py(), 0, "READ_ERROR", str(exc)))
    yield flush()


def pickle_ops(df: DataFrame) -> DataFrame:
    """(artifact_id, pos, op, arg) of a table with the streams in ``content``."""
    key_type = df.schema["artifact_id"].dataType.simpleString()
    arrow_key = pa.field("artifact_id", pa.string() if key_type == "string" else pa.int64())

    def walk(batches):
        return ops_batches(batches, lambda b, i: io.BytesIO(b.column("content")[i].as_py() or b""), arrow_key)

    return (df.select("artifact_id", "content")
            .mapInArrow(walk, f"artifact_id {key_type}, {OPS_SCHEMA}"))


def register_pickle_ops(spark: SparkSession, name: str = "pickle_ops") -> None:
    """Make the walk callable from SQL: ``SELECT ... FROM t, LATERAL pickle_ops(t.content)``."""

    @F.udtf(returnType=OPS_SCHEMA)
    class PickleOps:
        def eval(self, content: bytes):
            yield from iter_ops(io.BytesIO(content or b""))

    spark.udtf.register(name, PickleOps)


def opcode_findings(ops: DataFrame) -> DataFrame:
    """Rules on opcode rows: unsafe imports, REDUCE calls, broken streams."""
    safe = [f"{m} {n}" for m, n in SAFE_IMPORTS]
    module = F.substring_index("arg", " ", 1)
    op = F.col("op")
    kept = ops.filter(op.isin("REDUCE", "MALFORMED") | ((op == "GLOBAL") & ~F.col("arg").isin(safe)))
    is_global, is_reduce = op == "GLOBAL", op == "REDUCE"
    return kept.select(
        "artifact_id",
        F.when(is_global, "unsafe_global").when(is_reduce, "reduce_execution")
         .otherwise("malformed_pickle").alias("type"),
        F.when(is_global, "code_execution").when(is_reduce, "deserialization_exploit")
         .otherwise("obfuscation_payload").alias("category"),
        F.col("pos").alias("offset"),
        F.when(is_reduce, "critical").when(is_global & module.isin(HIGH_MODULES), "high")
         .otherwise("medium").alias("severity"),
        F.when(is_reduce, REDUCE_SCORE).when(~is_global, MALFORMED_SCORE)
         .when(module.isin(SCORED_MODULES), GLOBAL_SCORE).otherwise(GLOBAL_REST_SCORE).alias("cvss_score"),
        F.when(is_global, GLOBAL_VECTOR).when(is_reduce, REDUCE_VECTOR)
         .otherwise(MALFORMED_VECTOR).alias("cvss_vector"),
        F.when(is_global, F.concat(F.lit("Unsafe GLOBAL import: "), F.replace("arg", F.lit(" "), F.lit("."))))
         .when(is_reduce, "Execution of arbitrary callable via REDUCE opcode.")
         .otherwise(F.concat(F.lit("Pickle stream is malformed or intentionally corrupted: "), F.col("arg")))
         .alias("desc"),
        # malformed streams are reported after the findings made before the break
        F.when(op == "MALFORMED", 1).otherwise(0).alias("rule_no"))


def pickle_opcode_audit(df: DataFrame) -> DataFrame:
    return opcode_findings(pickle_ops(df))


def unsafe_imports(ops: DataFrame) -> DataFrame:
    """Corpus roll-up (module, name, artifacts, hits) of imports outside the safe list."""
    safe = [f"{m} {n}" for m, n in SAFE_IMPORTS]
    return (ops.filter((F.col("op") == "GLOBAL") & ~F.col("arg").isin(safe))
            .groupBy(F.substring_index("arg", " ", 1).alias("module"),
                     F.expr("substring(arg, instr(arg, ' ') + 1)").alias("name"))
            .agg(F.countDistinct("artifact_id").alias("artifacts"), F.count("*").alias("hits")))


def op_counts(ops: DataFrame) -> DataFrame:
    """Per artifact: imports by GLOBAL, by STACK_GLOBAL (which the rules do not see), REDUCE calls."""
    return ops.groupBy("artifact_id").agg(
        F.count_if(F.col("op") == "GLOBAL").alias("global_count"),
        F.count_if(F.col("op") == "STACK_GLOBAL").alias("stack_global_count"),
        F.count_if(F.col("op") == "REDUCE").alias("reduce_count"))
