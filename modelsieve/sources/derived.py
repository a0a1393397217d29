"""Input views shaped like scan-platform tables, derived from the given tables.

Every view is a lazy projection or join of the parquet tables in ``sf_dir``.
Payloads are inert text; nothing here is ever executed or unpickled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from modelsieve.functions.bands import band
from modelsieve.functions.once import computed_once

EXTENSIONS = [".pkl", ".pickle", ".pt", ".pth", ".gguf", ".safetensors", ".onnx"]

# One planted text per doc_id % 23; the remainder stays unplanted.
PAYLOADS = [
    "os.system(", "EVAL  (", "exec(", '__import__("os")', "subprocess.Popen(",
    "__reduce__", "__reduce_ex__", "base64.b64decode(", "socket.socket(",
    "import urllib\nimport os", "requests.get(", "https://x.example/p",
    "<script src=a>", '{{ os.system("x") }}', "PyOp CustomOp",
    "eval(eval(eval(", "zlib.decompress(", "", "", "", "", "", "",
]

KEYWORDS = ["pickle", "pytorch", "tensorflow", "keras", "huggingface",
            "safetensors", "gguf", "onnx", "machine learning model"]


PICKLE_FAMILY = (".pkl", ".pickle", ".pt", ".pth")
PICKLE_FRAME = b"\x80\x02N.\n"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table; timestamps without zone are read as UTC instants."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    zoned = {f.name: F.col(f.name).cast("timestamp") for f in df.schema
             if f.dataType.simpleString() == "timestamp_ntz"}
    return df.withColumns(zoned) if zoned else df


def scan_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table for work that costs far more than a shuffle, in even parts: one row group of texts is otherwise one task."""
    return table(spark, sf_dir, name).hint("rebalance")


def _pick(values: list[str | None], index: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), index.cast("int"))


def v_artifacts(spark: SparkSession, d: str) -> DataFrame:
    doc = F.col("doc_id")
    ext = _pick(EXTENSIONS, doc % 7)
    body = F.concat(F.col("text"), F.lit(" "), _pick(PAYLOADS, doc % 23))
    return scan_table(spark, d, "documents").select(
        doc.alias("artifact_id"),
        F.concat(F.lit("model_"), doc.cast("string"), ext).alias("filename"),
        ext.alias("ext"),
        F.encode(body, "UTF-8").alias("content"))


def v_scans(spark: SparkSession, d: str) -> DataFrame:
    eid = F.col("event_id")
    exts = [".pkl", ".pickle", ".pt", ".pth", ".gguf", ".safetensors", None]
    score = F.when(eid % 3 == 0, F.lit(0.0)).otherwise(((eid * 37) % 101).cast("double"))
    threat = F.struct(
        F.lit("CODE-001").alias("pattern"), F.lit("critical").alias("severity"),
        F.lit("dynamic evaluation").alias("description"),
        F.concat(F.lit("scan_"), eid.cast("string")).alias("location"),
        F.lit("code_execution").alias("category"))
    return (table(spark, d, "events")
            .select(
                eid.cast("string").alias("scan_id"),
                F.concat(F.lit("scan_"), eid.cast("string"),
                         F.coalesce(_pick(exts, eid % 7), F.lit(""))).alias("filename"),
                F.floor(F.col("value") * 1048576).cast("bigint").alias("file_size"),
                _pick(exts, eid % 7).alias("file_extension"),
                F.sha2(F.concat(F.lit("h"), (eid % 500).cast("string")), 256).alias("file_hash"),
                score.alias("risk_score"),
                F.array_repeat(threat, (eid % 4).cast("int")).alias("threats"),
                F.when(eid % 4 == 0, F.lit(None)).when(eid % 4 == 1, F.lit(""))
                 .otherwise("SUSPICIOUS").cast("string").alias("ai_verdict"),
                F.when(eid % 2 == 0, (eid % 101).cast("int")).alias("ai_confidence"),
                F.when(eid % 5 != 0, F.col("user_id").cast("string")).alias("user_id"),
                F.when(eid % 9 != 0, F.concat(F.lit("10.0.0."), (F.col("user_id") % 40).cast("string")))
                 .alias("ip_address"),
                (eid % 10 != 0).alias("is_public"),
                F.col("ts").alias("created_at"))
            .withColumn("risk_level", band(F.col("risk_score"), "engine")))


FINDING_SPAN = 10 ** 13


def v_findings(spark: SparkSession, d: str) -> DataFrame:
    """Findings from order lines.

    ``ordinal`` is spelled from line number, part, supplier and quantity, so no
    window is needed to number an order's lines, however many it has. Lines that
    agree in all of these tie and are ranked by the finding's own fields.
    """
    qty = F.col("l_quantity")
    ordinal = (((F.col("l_linenumber").cast("bigint") * 10 ** 7 + F.col("l_partkey")) * 10 ** 6
                + F.col("l_suppkey")) * 100 + qty.cast("bigint"))
    lines = table(spark, d, "lineitem").withColumn("ordinal", ordinal)
    parts = table(spark, d, "part").select("p_partkey", "p_type")
    return (lines.join(parts, lines.l_partkey == parts.p_partkey)
            .select(
                F.col("l_orderkey").alias("artifact_id"), "ordinal",
                F.col("p_type").alias("pattern"),
                F.when(F.col("l_returnflag") != "R", qty / 5).alias("cvss_score"),
                F.when(qty >= 45, "critical").when(qty >= 35, "high")
                 .when(qty >= 20, "medium").otherwise("low").alias("severity"),
                F.col("l_linestatus").alias("category")))


def v_users(spark: SparkSession, d: str) -> DataFrame:
    seg = F.col("c_mktsegment")
    return table(spark, d, "customer").select(
        F.col("c_custkey").cast("string").alias("id"),
        F.concat("c_name", F.lit("@example.com")).alias("email"),
        F.col("c_name").alias("username"),
        F.col("c_name").alias("display_name"),
        F.lit(None).cast("string").alias("avatar_url"),
        F.lit("github").alias("provider"),
        F.concat(F.lit("p"), F.col("c_custkey").cast("string")).alias("provider_id"),
        F.when(seg == "BUILDING", "pro").when(seg == "FURNITURE", "enterprise")
         .otherwise("free").alias("plan"))


def v_cves(spark: SparkSession, d: str) -> DataFrame:
    doc = F.col("doc_id")
    docs = table(spark, d, "documents").select("doc_id", "text")
    labels = table(spark, d, "labels").select("doc_id", F.lit(True).alias("labelled"))
    return docs.join(labels, "doc_id", "left").select(
        F.concat(F.lit("CVE-2024-"), F.lpad(doc.cast("string"), 6, "0")).alias("cve_id"),
        F.col("text").alias("description"),
        F.when(F.col("labelled"), (doc % 101) / 10).alias("cvss_score"),
        F.when(doc % 29 != 0, F.timestamp_add(
            "DAY", (doc % 365).cast("int"), F.lit("2024-01-01").cast("timestamp")))
         .alias("published_date"),
        _pick(KEYWORDS, doc % 9).alias("affected_tech"))


def v_cve_feed(spark: SparkSession, d: str) -> DataFrame:
    """(keyword, pos, item JSON): each item is listed under two keywords."""
    doc = F.col("doc_id")
    score = F.struct(F.array(F.struct(F.struct(
        (((doc % 101) / 10).cast("double")).alias("baseScore")).alias("cvssData"))).alias("m"))
    entry = score["m"]
    none = F.lit(None)
    item = F.struct(F.struct(
        F.when(doc % 31 != 0, F.concat(F.lit("CVE-2025-"), F.lpad(doc.cast("string"), 6, "0"))).alias("id"),
        F.when(doc % 29 == 0, F.lit("not a date"))
         .otherwise(F.concat(F.date_format(F.date_add(F.lit("2025-01-01").cast("date"), (doc % 365).cast("int")),
                                           "yyyy-MM-dd"), F.lit("T00:00:00.000"))).alias("published"),
        F.array(F.struct(F.col("lang").alias("lang"), F.col("text").alias("value")))
         .alias("descriptions"),
        F.struct(F.when(doc % 4 == 0, entry).otherwise(none).alias("cvssMetricV31"),
                 F.when(doc % 4 == 1, entry).otherwise(none).alias("cvssMetricV30"),
                 F.when(doc % 4 == 2, entry).otherwise(none).alias("cvssMetricV2")).alias("metrics"),
    ).alias("cve"))
    return (table(spark, d, "documents")
            .select(doc, F.to_json(item).alias("item"))
            .select("*", F.explode(F.array(doc % 9, (doc + 4) % 9)).alias("k"))
            .select(_pick(KEYWORDS, F.col("k")).alias("keyword"), doc.alias("pos"), "item"))


def v_iocs(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("file_hash"))
    labels = table(spark, d, "labels").filter("toxic = 1").select("doc_id", "quality")
    return (docs.join(labels, "doc_id")
            .groupBy("file_hash")
            .agg(F.lit("malicious").alias("severity"),
                 F.bool_or(F.col("quality") == 1).alias("is_verified"),
                 F.timestamp_add("DAY", (F.min("doc_id") % 365).cast("int"),
                                 F.lit("2024-01-01").cast("timestamp")).alias("reported_at")))


def v_hashes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(
        F.col("doc_id").alias("artifact_id"), F.sha2("text", 256).alias("file_hash"))


def v_webhook_subs(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("c_custkey")
    return table(spark, d, "customer").select(
        key.alias("id"), (key % 150).cast("string").alias("user_id"),
        F.concat(F.lit("https://hooks.example/"), key.cast("string")).alias("url"),
        F.sha2("c_name", 256).alias("secret_token"),
        F.array(_pick(["scan.completed", "threat.critical", "all"], key % 3)).alias("events"),
        (F.col("c_acctbal") > 0).alias("is_active"))


def v_webhook_logs(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("o_orderkey")
    return table(spark, d, "orders").select(
        key.alias("id"), F.col("o_custkey").alias("subscription_id"),
        F.when(F.col("o_orderstatus") == "F", "threat.critical").otherwise("scan.completed").alias("event_type"),
        F.when(key % 8 == 0, 500).otherwise(200).cast("int").alias("response_status"),
        F.col("o_orderdate").alias("triggered_at"))


def v_requests(spark: SparkSession, d: str) -> DataFrame:
    kind = F.col("event_type")
    return table(spark, d, "events").select(
        "ts", F.concat(F.lit("10.0.0."), (F.col("user_id") % 40).cast("string")).alias("ip"),
        F.when(kind.isin("click", "view"), "scan_file").when(kind == "signup", "key_generate")
         .otherwise("scan_url").alias("endpoint"))


STAGES = {"view": "header_check", "click": "signature_scan", "signup": "ai_analysis",
          "purchase": "complete", "error": "error"}


def v_progress(spark: SparkSession, d: str) -> DataFrame:
    stage = F.create_map(*[F.lit(x) for kv in STAGES.items() for x in kv])[F.col("event_type")]
    return table(spark, d, "events").select(
        F.col("user_id").cast("string").alias("scan_id"), stage.alias("stage"),
        (F.col("event_id") % 101).cast("int").alias("progress"),
        F.col("ts").alias("timestamp"), F.col("event_id").alias("seq"))


def v_api_keys(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select(
        F.sha2("c_name", 256).alias("key_hash"), F.col("c_name").alias("name"),
        F.lit(500).alias("scans_limit"), (F.col("c_acctbal") > 0).alias("is_active"))


def v_urls(spark: SparkSession, d: str) -> DataFrame:
    page, url = F.col("page_id"), F.col("url")
    ext = _pick([".pkl", ".GGUF", ".zip", ".safetensors"], page % 4)
    made = (F.when(page % 5 == 0, F.concat(F.lit("https://huggingface.co/m/"), page.cast("string"), ext))
            .when(page % 5 == 1, F.concat(F.lit("ftp://huggingface.co/m/"), page.cast("string"), ext))
            .when(page % 5 == 2, F.concat(F.lit("https://hf.co/"), F.repeat(F.lit("x"), 2100), ext))
            .when(page % 5 == 3, F.lit("   "))
            .otherwise(F.concat(F.lit("  HTTPS://HF.CO/d/"), page.cast("string"), ext, F.lit("?v=1 "))))
    return (table(spark, d, "pages")
            .select(page, F.explode(F.array(F.struct(F.lit(0).alias("variant"), url.alias("url")),
                                            F.struct(F.lit(1).alias("variant"), made.alias("url")))).alias("u"))
            .select("page_id", "u.variant", "u.url"))


def _reversed_bytes(digits: Column, width: int) -> Column:
    """Bytes of a hex string, last byte first."""
    return F.unhex(F.concat(*[F.substring(digits, width * 2 - 1 - 2 * i, 2) for i in range(width)]))


def _le_bytes(number: Column, width: int) -> Column:
    """Little-endian bytes of a non-negative bigint."""
    return _reversed_bytes(F.lpad(F.hex(number), width * 2, "0"), width)


def v_safetensors(spark: SparkSession, d: str) -> DataFrame:
    doc, payload = F.col("doc_id"), F.lit("https://x.example/")
    note = F.regexp_replace("text", r'[^A-Za-z0-9 ]', "")
    note = F.when(doc % 11 == 6, F.concat(note, F.repeat(F.lit("ab-"), 3400))).otherwise(note)
    note = F.when(doc % 11 == 7, F.concat(note, F.lit(" eval (1) <script x> __import__ (")) ).otherwise(note)
    header = (F.when(doc % 11 == 1, F.lit('{"a": '))
              .when(doc % 11 == 2, F.lit("[1, 2]"))
              .when(doc % 11 == 3, F.lit('{"__metadata__":[1],"w":{"dtype":"F32"}}'))
              .otherwise(F.concat(
                  F.lit('{"__metadata__":{"note":"'), note, F.lit('","url":"'), payload,
                  doc.cast("string"), F.lit('"},"w":{"dtype":"F32"}}'))))
    size = F.octet_length("raw").cast("bigint")
    declared = F.when(doc % 11 == 0, size + 1000).when(doc % 11 == 4, F.lit(0).cast("bigint")).otherwise(size)
    docs = computed_once(scan_table(spark, d, "documents").select("doc_id", "text"), raw=F.encode(header, "UTF-8"))
    return computed_once(docs, declared=F.lpad(F.hex(declared), 16, "0")).select(
        doc.alias("artifact_id"),
        F.concat(F.lit("m_"), doc.cast("string"), F.lit(".safetensors")).alias("filename"),
        F.when(doc % 11 == 5, F.unhex(F.lit("00010203")))
         .otherwise(F.concat(_reversed_bytes(F.col("declared"), 8), F.col("raw"))).alias("content"))


PICKLE_IMPORTS = [("os", "getcwd"), ("collections", "OrderedDict"), ("numpy", "dtype"),
                  ("sys", "exit"), ("builtins", "len"), ("json", "dumps")]


def v_pickles(spark: SparkSession, d: str) -> DataFrame:
    doc = F.col("doc_id")
    module = _pick([m for m, _ in PICKLE_IMPORTS], doc % 6)
    name = _pick([n for _, n in PICKLE_IMPORTS], doc % 6)
    tail = F.when(doc % 7 == 0, F.lit(")R")).otherwise(")R.")
    return scan_table(spark, d, "documents").select(
        doc.alias("artifact_id"),
        F.concat(F.lit("m_"), doc.cast("string"), F.lit(".pkl")).alias("filename"),
        F.concat(F.unhex(F.lit("800258")), _le_bytes(F.octet_length("text").cast("bigint"), 4),
                 F.encode(F.concat(F.col("text"), F.lit("0c"), module, F.lit("\n"), name, F.lit("\n"), tail), "UTF-8")).alias("content"))


def v_gguf(spark: SparkSession, d: str) -> DataFrame:
    doc = F.col("doc_id")

    def text_field(value: Column) -> Column:
        raw = F.encode(value, "UTF-8")
        return F.concat(_le_bytes(F.octet_length(raw).cast("bigint"), 8), raw)

    string_type = F.unhex(F.lit("08000000"))
    return scan_table(spark, d, "documents").select(
        doc.alias("artifact_id"),
        F.concat(F.lit("m_"), doc.cast("string"), F.lit(".gguf")).alias("filename"),
        F.concat(
            F.encode(F.lit("GGUF"), "UTF-8"), F.unhex(F.lit("03000000")),
            _le_bytes(F.lit(0).cast("bigint"), 8), _le_bytes(F.lit(3).cast("bigint"), 8),
            text_field(F.lit("general.name")), string_type,
            text_field(F.concat(F.lit("model-"), (doc % 50).cast("string"))),
            text_field(F.lit("tokenizer.chat_template")), string_type,
            text_field(_pick(PAYLOADS, doc % 23)),
            text_field(F.lit("general.description")), string_type, text_field(F.col("text"))).alias("content"))


def v_responses(spark: SparkSession, d: str) -> DataFrame:
    """Model answers of mixed quality, one per event."""
    eid = F.col("event_id")
    full = F.concat(F.lit('{"verdict":"DANGEROUS","confidence":'), (eid % 101).cast("string"),
                    F.lit(',"summary_en":"seen '), F.col("event_type"),
                    F.lit('","key_risks":["a","b"]}'))
    raw = (F.when(eid % 5 == 0, full)
           .when(eid % 5 == 1, F.concat(F.lit("Here:\n```json\n"), full, F.lit("\n```\nDone")))
           .when(eid % 5 == 2, F.concat(F.lit("```\n"), full, F.lit("\n```")))
           .when(eid % 5 == 3, F.lit('{"summary_en":"short"}'))
           .otherwise(F.lit("no verdict today")))
    return table(spark, d, "events").select(eid.cast("string").alias("scan_id"), raw.alias("response"))
