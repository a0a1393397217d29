"""Admission: clean names, accept or reject with a reason, identify formats.

Everything here is a row-wise projection; none of it shuffles, apart from the
look-ups on user id in :func:`quota_admission`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values.
ADMITTED_EXTENSIONS = [".gguf", ".safetensors", ".pkl", ".pickle", ".pt", ".pth"]
ALLOWED_HOSTS = ["huggingface.co", "hf.co", "cdn-lfs.huggingface.co", "cdn-lfs-us-1.huggingface.co"]
MIB = 1 << 20
GUEST_LIMIT, FREE_LIMIT, PRO_LIMIT = 50 * MIB, 200 * MIB, 2048 * MIB
MAX_URL_CHARS = 2048
MAX_NAME_CHARS = 500

# What Python's str.isprintable rejects, the space aside.
_UNPRINTABLE = r"[\p{C}\p{Zl}\p{Zp}\p{Zs}&&[^ ]]"


def _strip(text: Column) -> Column:
    """Both ends cleaned of all whitespace, not only of spaces."""
    return F.regexp_replace(text, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def clean_name(name: Column) -> Column:
    base = _strip(F.element_at(F.split(name, "/"), -1))
    printable = F.regexp_replace(base, _UNPRINTABLE, "")
    return F.coalesce(F.nullif(F.substring(printable, 1, MAX_NAME_CHARS), F.lit("")), F.lit("unknown"))


def extension(name: Column) -> Column:
    """Lower-cased suffix with its dot; '' when there is none (leading dots do not count)."""
    return F.lower(F.regexp_extract(name, r"(?s)[^./][^/]*?(\.[^./]*)$", 1))


def sanitize_filename(df: DataFrame, col: str = "filename", out: str = "clean_name") -> DataFrame:
    return df.withColumn(out, clean_name(F.col(col)))


def admit_extension(df: DataFrame, col: str = "filename") -> DataFrame:
    """Add ``ext``, ``admitted`` and, for refused rows, ``reason``."""
    ext = extension(F.col(col))
    return (df.withColumn("ext", ext)
            .withColumn("admitted", F.col("ext").isin(ADMITTED_EXTENSIONS))
            .withColumn("reason", F.when(~F.col("admitted"), F.concat(
                F.lit("unsupported extension '"), F.col("ext"), F.lit("'")))))


def admit_url(df: DataFrame, url_col: str = "url", hosts: list[str] | None = None) -> DataFrame:
    """Add ``reason`` (null when admitted), ``filename`` and ``ext`` of a download URL.

    The rules are tried in order and the first that fails gives the reason.
    """
    hosts = hosts or ALLOWED_HOSTS
    url = _strip(F.col(url_col))
    shaped = df.withColumn("_url", url).withColumn(
        "_scheme", F.lower(F.regexp_extract("_url", r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1))
    ).withColumn(
        # user info and port are not part of the host
        "_host", F.lower(F.regexp_extract("_url", r"^[^:/?#]+://(?:[^/?#]*@)?([^/?#:]*)", 1))
    ).withColumn(
        "_path", F.regexp_extract("_url", r"^[^:/?#]+://[^/?#]*([^?#]*)", 1))
    last = F.regexp_extract(F.regexp_replace("_path", r"/+$", ""), r"([^/]*)$", 1)
    named = shaped.withColumn(
        "filename", F.when(last == "", F.lit("model_from_url")).otherwise(clean_name(last))
    ).withColumn("ext", extension(F.col("filename")))
    reason = (F.when(F.coalesce(F.col("_url"), F.lit("")) == "", "empty")
              .when(F.length("_url") > MAX_URL_CHARS, "too_long")
              .when(~F.col("_scheme").isin("http", "https"), "scheme")
              .when(~F.col("_host").isin(hosts), "host")
              .when(~F.col("ext").isin(ADMITTED_EXTENSIONS), "extension"))
    return (named.withColumn("reason", reason)
            .withColumn("admitted", F.col("reason").isNull())
            .withColumn("filename", F.when(F.col("admitted"), F.col("filename")))
            .withColumn("ext", F.when(F.col("admitted"), F.col("ext")))
            .drop("_url", "_scheme", "_host", "_path"))


def quota_admission(scans: DataFrame, users: DataFrame) -> DataFrame:
    """Size limit by plan. Users are unbounded, so the join strategy is left to
    AQE: it broadcasts the two user columns only when they measure small and
    splits hot user ids otherwise."""
    plans = users.select(F.col("id").alias("_uid"), F.col("plan"))
    joined = scans.join(plans, scans.user_id == plans._uid, "left")
    limit = (F.when(F.col("_uid").isNull(), GUEST_LIMIT)
             .when(F.col("plan") == "pro", PRO_LIMIT).otherwise(FREE_LIMIT)).cast("bigint")
    size = F.col("file_size")
    reason = F.when(size == 0, "empty").when(size > F.col("size_limit"), "too_large")
    return (joined.withColumn("size_limit", limit).withColumn("reason", reason)
            .withColumn("admitted", F.col("reason").isNull()).drop("_uid"))


def content_hash(df: DataFrame, col: str = "content", out: str = "file_hash") -> DataFrame:
    return df.withColumn(out, F.sha2(F.col(col), 256))


def format_of(content: Column, filename: Column) -> Column:
    """File format by leading bytes first, then by name. ``content`` needs only
    the first 100 bytes."""
    head = F.hex(F.substring(content, 1, 4))
    suffix = F.lower(F.regexp_extract(filename, r"([^.]*)$", 1))
    return (F.when(F.substring(head, 1, 4).isin("8002", "8003", "8004", "8005"), "pickle")
            .when(head == "47475546", "gguf")
            .when(filename.endswith(".safetensors"), "safetensors")
            .when((F.substring(head, 1, 2) == "08")
                  & F.contains(F.substring(content, 1, 100), F.lit(b"onnx")), "onnx")
            .when(suffix.isin("pkl", "pickle", "pt", "pth", "bin"), "pickle")
            .when(suffix == "gguf", "gguf")
            .when(suffix == "onnx", "onnx")
            .otherwise("unknown"))


def identify_format(df: DataFrame) -> DataFrame:
    return df.withColumn("format", format_of(F.col("content"), F.col("filename")))


# Leading bytes and what they stand for.
PICKLE_FAMILY_MAGIC = {
    "8002": "Pickle protocol 2", "8003": "Pickle protocol 3", "8004": "Pickle protocol 4",
    "8005": "Pickle protocol 5", "504B0304": "ZIP archive (PyTorch)",
}
# Score weights of the inspector's magic checks.
MAGIC_TOO_SMALL, MAGIC_UNKNOWN, MAGIC_GGUF_BAD = 20.0, 10.0, 30.0


def magic_check(df: DataFrame) -> DataFrame:
    """Inspector verdict on the first four bytes, one finding per artifact.

    GGUF names are held to the GGUF magic, all others to the pickle family.
    """
    head = F.hex(F.substring("content", 1, 4))
    short = F.length(head) < 8
    is_gguf = extension(F.col("filename")) == ".gguf"
    known = F.create_map(*[F.lit(x) for kv in PICKLE_FAMILY_MAGIC.items() for x in kv])
    label = F.coalesce(known[head], known[F.substring(head, 1, 4)])
    kind = (F.when(is_gguf & (short | (head != "47475546")), "invalid_magic")
            .when(is_gguf, "valid_magic")
            .when(short, "invalid_magic")
            .when(label.isNotNull(), "valid_magic").otherwise("unknown_magic"))
    return (df.withColumn("type", kind)
            .withColumn("detail", F.when(is_gguf & (F.col("type") == "valid_magic"), "GGUF")
                        .when(F.col("type") == "valid_magic", label)
                        .when(short, F.lit("file too small"))
                        .otherwise(F.concat(F.lit("0x"), head)))
            .withColumn("severity", F.when(F.col("type") == "valid_magic", "clean")
                        .when(F.col("type") == "unknown_magic", "suspicious").otherwise("malicious"))
            .withColumn("weight", F.when(F.col("type") == "valid_magic", 0.0)
                        .when(F.col("type") == "unknown_magic", MAGIC_UNKNOWN)
                        .when(is_gguf, MAGIC_GGUF_BAD).otherwise(MAGIC_TOO_SMALL)))


INSPECTOR_READ_LIMIT = 100 * MIB


def advisories(df: DataFrame, limit: int | None = INSPECTOR_READ_LIMIT, size_col: str = "file_size") -> DataFrame:
    """Score-free notes: pickle is unsafe by design, odd extension, and, where only the first ``limit`` bytes are read, that
    limit hit."""
    ext = extension(F.col("filename"))
    note = lambda kind, severity: F.struct(F.lit(kind).alias("type"), F.lit(severity).alias("severity"))
    notes = F.array(
        F.when(~ext.isin(".pkl", ".pickle", ".pt", ".pth"), note("extension_warning", "suspicious")),
        F.when(ext.isin(".pkl", ".pickle"), note("format_risk", "suspicious")),
        F.when(F.col(size_col) >= limit, note("scan_limit", "clean")) if limit is not None else F.lit(None))
    return (df.withColumn("_n", F.explode(F.filter(notes, lambda n: n.isNotNull())))
            .select("*", "_n.type", "_n.severity").drop("_n"))
