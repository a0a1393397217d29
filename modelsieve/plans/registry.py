"""One query per operator, over the given tables and views derived from them."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from modelsieve.functions.matching import whole_content
from modelsieve.operators import (admission, analytics, entropy, gguf, intel, ioc, literals, notify, onnx,
                                  pickles, safetensors, scoring, signatures, templates)
from modelsieve.plans.dispatch import scan_corpus
from modelsieve.session import shared_dir
from modelsieve.sources import artifacts as files
from modelsieve.sources import derived as v
from modelsieve.sources import exports, feeds, tables
from modelsieve.streaming import ratelimits
from modelsieve.streaming.progress import latest_stage, open_scans

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
NOW = datetime(2024, 1, 20, 12, 0, 0)


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def chunks(spark, d) -> DataFrame:
    return whole_content(v.v_artifacts(spark, d))


# ---- sources and sinks -------------------------------------------------------

def _artifact_files(spark, d) -> DataFrame:
    """Manifest of the artifacts written as files, one each, below a folder all executors share; in subfolders, so that tasks
    neither wait for one folder to take a name nor list it alone."""
    root = shared_dir(spark, "files")
    place = F.format_string("%02x/%s", F.pmod(F.xxhash64("filename"), F.lit(256)), "filename")
    files.write_files(v.v_artifacts(spark, d).select(place.alias("filename"), "content"), root)
    return files.artifact_manifest(spark, root, exts=[*files.DEFAULT_EXTENSIONS, "onnx"])


@query
def artifact_manifest(spark, d):
    return _artifact_files(spark, d).select("filename", "ext", "length")


@query
def artifact_chunks(spark, d):
    return files.artifact_chunks(_artifact_files(spark, d), chunk=1024).select(
        "filename", "chunk_no", F.col("own_len").cast("bigint").alias("own_len"),
        F.sha2(F.substring("content", F.col("own_start") + 1, F.col("own_len")), 256).alias("chunk_hash"))


@query
def file_hashes(spark, d):
    return files.file_hashes(_artifact_files(spark, d)).select("filename", "length", "file_hash")


@query
def scan_store_read(spark, d):
    path = shared_dir(spark, "store") + "/scans"
    tables.conform(v.v_scans(spark, d).withColumn("scan_date", F.to_date("created_at")), "scans").write.partitionBy(
        "scan_date").parquet(path)
    return (tables.read_table(spark, "scans", path)
            .select("scan_id", "filename", "file_size", "risk_score", F.size("threats").cast("bigint").alias("n"),
                    "created_at"))


@query
def scan_store_append(spark, d):
    path = shared_dir(spark, "append") + "/scans"
    scans = v.v_scans(spark, d)
    tables.append_results(scans, path)
    tables.append_results(scans, path)      # a rerun must add nothing
    return (tables.read_table(spark, "scans", path)
            .groupBy(F.date_format("scan_date", "yyyy-MM-dd").alias("scan_day"))
            .agg(F.count("*").alias("scans"), F.sum("file_size").alias("bytes")))


@query
def cve_feed_read(spark, d):
    pages = (v.v_cve_feed(spark, d)
             .groupBy("keyword", F.floor(F.col("pos") / 20).alias("page"))
             .agg(F.concat(F.lit('{"vulnerabilities":['), F.array_join(F.transform(
                 F.sort_array(F.collect_list(F.struct("pos", "item"))), lambda r: r["item"]), ","),
                 F.lit("]}")).alias("response")))
    rows = feeds.parse_cve_responses(pages)
    return rows.groupBy("keyword").agg(
        F.count("*").alias("items"), F.countDistinct("item.cve.id").alias("ids"),
        F.count_if(F.col("item.cve.metrics.cvssMetricV31").isNotNull()).alias("v31"))


@query
def export_results_json(spark, d):
    results = v.v_scans(spark, d).select("scan_id", "filename", "file_size", "risk_level", "threats", "ai_verdict")
    return exports.result_documents(results)


# ---- admission ---------------------------------------------------------------

@query
def sanitize_filename(spark, d):
    name = F.concat(F.lit("../a/ "), "text", F.lit("\t\n"), F.col("doc_id").cast("string"),
                    F.lit(".pkl "))
    name = F.when(F.col("doc_id") % 13 == 0, F.lit("dir/  ")).otherwise(name)
    docs = v.table(spark, d, "documents").select("doc_id", name.alias("filename"))
    return admission.sanitize_filename(docs).select("doc_id", "clean_name")


@query
def admit_extension(spark, d):
    return admission.admit_extension(v.v_artifacts(spark, d).select("artifact_id", "filename")).select(
        "artifact_id", "ext", "admitted", "reason")


@query
def admit_url(spark, d):
    return admission.admit_url(v.v_urls(spark, d)).select(
        "page_id", F.col("variant").cast("bigint").alias("variant"), "admitted", "reason", "filename", "ext")


@query
def quota_admission(spark, d):
    scans = v.v_scans(spark, d).select("scan_id", "user_id", "file_size")
    return admission.quota_admission(scans, v.v_users(spark, d)).select(
        "scan_id", "file_size", "plan", "size_limit", "admitted", "reason")


@query
def content_hash(spark, d):
    return admission.content_hash(v.v_artifacts(spark, d)).select("artifact_id", "file_hash")


@query
def identify_format(spark, d):
    both = v.v_artifacts(spark, d).select("artifact_id", "filename", "content").unionByName(
        v.v_pickles(spark, d)).unionByName(v.v_gguf(spark, d))
    return admission.identify_format(both).select("artifact_id", "filename", "format")


@query
def magic_check(spark, d):
    both = v.v_pickles(spark, d).unionByName(v.v_gguf(spark, d)).unionByName(
        v.v_artifacts(spark, d).select("artifact_id", "filename", "content"))
    return admission.magic_check(both).select("artifact_id", "filename", "type", "severity", "weight")


@query
def format_risk_note(spark, d):
    return admission.advisories(v.v_scans(spark, d)).select("scan_id", "type", "severity")


# ---- detection ---------------------------------------------------------------

@query
def signature_catalog(spark, d):
    """Catalogue rows joined to the artifacts that hold their literal text."""
    catalog = signatures.signature_catalog(spark)
    counts = signatures.signature_hits(chunks(spark, d)).groupBy(F.col("pattern_id").alias("id")).agg(
        F.countDistinct("artifact_id").alias("artifacts"))
    return catalog.join(counts, "id", "left").select(
        "id", "category", "severity", "cvss_score", "cvss_severity", "cvss_vector",
        F.coalesce("artifacts", F.lit(0)).alias("artifacts"))


@query
def signature_hits(spark, d):
    return signatures.signature_hits(chunks(spark, d)).select(
        "artifact_id", "pattern_id", "category", "offset", "severity", "cvss_score", "cvss_vector")


@query
def signature_hit_counts(spark, d):
    return signatures.signature_hit_counts(signatures.signature_hits(chunks(spark, d)))


@query
def literal_presence(spark, d):
    return literals.literal_presence(v.v_artifacts(spark, d)).select(
        "artifact_id", "pattern", "severity", "category", "description")


@query
def weighted_pattern_counts(spark, d):
    return literals.weighted_pattern_counts(chunks(spark, d)).select(
        "artifact_id", "pattern", "hits", "weight", "severity")


@query
def chunk_entropy(spark, d):
    return entropy.chunk_entropy(chunks(spark, d)).select(
        "artifact_id", "offset", F.col("size").cast("bigint").alias("size"), "entropy", "flagged")


@query
def text_entropy(spark, d):
    docs = v.table(spark, d, "documents").select("doc_id", "text")
    return entropy.text_entropy(docs, "text", threshold=4.5).select("doc_id", "entropy", "flagged")


@query
def safetensors_header(spark, d):
    h = safetensors.safetensors_header(v.v_safetensors(spark, d))
    return h.select("artifact_id", "status", "header_len", F.col("n_tensors").cast("bigint").alias("n_tensors"),
                    F.col("metadata")["note"].alias("note"), F.col("metadata")["url"].alias("url"))


@query
def safetensors_header_rules(spark, d):
    return safetensors.safetensors_header_rules(v.v_safetensors(spark, d)).select(
        "artifact_id", "type", "severity", "weight")


@query
def metadata_rules(spark, d):
    return safetensors.metadata_rules(v.v_safetensors(spark, d)).select(
        "artifact_id", "profile", "key", "type", "severity", "pattern", "hits", "weight", "cvss_score")


@query
def pickle_opcode_audit(spark, d):
    return pickles.pickle_opcode_audit(v.v_pickles(spark, d)).select(
        "artifact_id", "type", "category", "offset", "severity", "cvss_score", "cvss_vector")


@query
def pickle_unsafe_imports(spark, d):
    return pickles.unsafe_imports(pickles.pickle_ops(v.v_pickles(spark, d)))


@query
def pickle_op_counts(spark, d):
    return pickles.op_counts(pickles.pickle_ops(v.v_pickles(spark, d)))


@query
def gguf_metadata(spark, d):
    return gguf.gguf_metadata(v.v_gguf(spark, d)).select(
        "artifact_id", "version", "tensors", "pairs", F.col("position").cast("bigint").alias("position"), "key",
        F.col("vtype").cast("bigint").alias("vtype"), "value")


@query
def gguf_key_table(spark, d):
    return gguf.gguf_key_table(gguf.gguf_metadata(v.v_gguf(spark, d))).select(
        "key", F.col("vtype").cast("bigint").alias("vtype"), "artifacts", "distinct_values")


@query
def gguf_metadata_rules(spark, d):
    return gguf.gguf_metadata_rules(gguf.gguf_metadata(v.v_gguf(spark, d))).select(
        "artifact_id", "source", "type", "severity", "pattern", "hits", "weight")


@query
def template_injection(spark, d):
    return templates.template_injection(v.v_artifacts(spark, d)).select(
        "artifact_id", "type", "severity", "cvss_score", "desc", "block")


@query
def onnx_op_indicators(spark, d):
    return onnx.onnx_ops(chunks(spark, d)).select("artifact_id", "op", "offset", "severity", "cvss_score", "desc")


@query
def ioc_screen(spark, d):
    flagged = ioc.ioc_flagged(v.v_hashes(spark, d), v.v_iocs(spark, d))
    return flagged.select("artifact_id", "file_hash", "pattern", F.col("risk_score").cast("bigint").alias("risk_score"), "risk_level")


@query
def scan_dispatch(spark, d):
    # Artifacts of the pickle family are a short valid stream with their text behind it.
    framed = F.concat(F.lit(v.PICKLE_FRAME), F.col("content"))
    mixed = (v.v_artifacts(spark, d).withColumn("content", F.when(F.col("ext").isin(*v.PICKLE_FAMILY), framed).otherwise(F.col("content")))
             .select("filename", "content").unionByName(v.v_pickles(spark, d).select("filename", "content"))
             .withColumn("artifact_id", F.col("filename")))
    return scan_corpus(mixed).select(
        "artifact_id", "type", "pattern_id", "category", "offset", "severity", "cvss_score", "ordinal")


@query
def scan_dispatch_sdk(spark, d):
    return scan_corpus(v.v_artifacts(spark, d), "sdk").select("artifact_id", "pattern", "severity")


@query
def scan_dispatch_inspector(spark, d):
    mixed = (v.v_pickles(spark, d).unionByName(v.v_gguf(spark, d)).unionByName(v.v_safetensors(spark, d))
             .withColumn("artifact_id", F.col("filename")))
    return scan_corpus(mixed, "inspector").select("artifact_id", "type", "severity", "pattern", "hits", "weight")


@query
def inspector_notes(spark, d):
    return gguf.gguf_notes(gguf.gguf_metadata(v.v_gguf(spark, d))).withColumn("format", F.lit("gguf")).unionByName(
        safetensors.safetensors_notes(v.v_safetensors(spark, d)).withColumn("format", F.lit("safetensors")))


# ---- scoring -----------------------------------------------------------------

def _metric_rows(spark, d) -> DataFrame:
    """Eight metrics per event, cycling through all values and some gaps."""
    eid = F.col("event_id")
    sets = {"av": "NALP", "ac": "LH", "pr": "NLH", "ui": "NR", "s": "UC", "c": "HLN", "i": "HLN", "a": "HLN"}
    parts, step = [], 1
    for name, letters in sets.items():
        pick = F.get(F.array(*[F.lit(x) for x in letters]), (F.floor(eid / step) % len(letters)).cast("int"))
        parts.append(F.when(eid % 17 == 0, F.lit(None)).otherwise(pick).alias(name))
        step *= len(letters)
    return v.table(spark, d, "events").select(eid, F.struct(*parts).alias("metrics"))


def _cvss(spark, d, mode):
    return scoring.cvss_base_score(_metric_rows(spark, d), mode=mode).select(
        "event_id", "cvss_score", "cvss_severity", "cvss_vector")


@query
def cvss_base_score(spark, d):
    return _cvss(spark, d, "reference")


@query
def cvss_base_score_spec(spark, d):
    return _cvss(spark, d, "spec")


@query
def artifact_cvss(spark, d):
    return scoring.artifact_cvss(v.v_findings(spark, d))


@query
def engine_risk(spark, d):
    scored = scoring.engine_risk(scoring.artifact_cvss(v.v_findings(spark, d)))
    return scored.select("artifact_id", "cvss_score", F.col("risk_score").cast("bigint").alias("risk_score"),
                         "risk_level")


@query
def sdk_risk(spark, d):
    arts = v.v_artifacts(spark, d)
    return scoring.sdk_risk(arts, literals.literal_presence(arts)).select(
        "artifact_id", "filename", F.col("risk_score").cast("bigint").alias("risk_score"), "threats_found",
        "risk_level")


@query
def inspector_risk(spark, d):
    found = safetensors.safetensors_header_rules(v.v_safetensors(spark, d)).select(
        "artifact_id", "type", "severity", "weight").unionByName(
        safetensors.metadata_rules(v.v_safetensors(spark, d)).filter("profile = 'inspector'")
        .select("artifact_id", "type", "severity", "weight"))
    return scoring.inspector_risk(found)


@query
def risk_bands(spark, d):
    scans = v.v_scans(spark, d).select("scan_id", F.when(F.col("risk_score") != 7, F.col("risk_score")).alias("score"))
    cve = scans.withColumn("tenth", F.col("score") / 10)
    banded = scoring.risk_bands(cve, "score", ["engine", "sdk", "inspector", "badge_label", "badge_color"])
    return scoring.risk_bands(banded, "tenth", ["cve"]).drop("tenth")


@query
def final_verdict(spark, d):
    scans = v.v_scans(spark, d).select("scan_id", "risk_score", F.nullif("ai_verdict", F.lit("")).alias("ai_verdict"),
                                       F.col("ai_verdict").isNotNull().alias("has_analysis"))
    return scoring.final_verdict(scans).select("scan_id", "verdict", "is_safe")


FINDING_TIES = ["pattern", "category", "cvss_score"]


@query
def rank_findings(spark, d):
    return scoring.rank_findings(v.v_findings(spark, d), ties=FINDING_TIES, span=v.FINDING_SPAN).select(
        "artifact_id", "rank", "ordinal", "severity", "pattern")


def _results(spark, d, page_size=None) -> DataFrame:
    orders = v.table(spark, d, "orders").select(
        F.col("o_orderkey").alias("artifact_id"),
        F.concat(F.lit("model_"), F.col("o_orderkey").cast("string"), F.lit(".pkl")).alias("filename"),
        F.lit(".pkl").alias("ext"), F.floor("o_totalprice").cast("bigint").alias("file_size"),
        F.lit("pickle").alias("format"))
    findings = v.v_findings(spark, d).select(
        "artifact_id", "ordinal", F.col("pattern").alias("pattern_id"), F.lit("pattern_match").alias("type"),
        "severity", F.when(F.col("category") == "O", F.col("category")).alias("category"), "cvss_score",
        F.lit(None).cast("string").alias("desc"))
    return scoring.assemble_results(orders, findings, page_size, v.FINDING_SPAN)


@query
def assemble_results(spark, d):
    return _results(spark, d).select(
        "artifact_id", "filename", F.col("page").cast("bigint").alias("page"),
        F.col("risk_score").cast("bigint").alias("risk_score"), "risk_level", "status", "threats_found", "details",
        F.array_join(F.transform("threats", lambda t: F.concat_ws("|", t["pattern"], t["severity"], t["category"])),
                     ";").alias("threat_list"),
        F.col("metadata")["extension"].alias("extension"))


@query
def assemble_results_paged(spark, d):
    """The same results with tiny pages: every threat is on exactly one page."""
    return _results(spark, d, 2).select(
        "artifact_id", F.col("page").cast("bigint").alias("page"),
        F.size("threats").cast("bigint").alias("threats_on_page"), "threats_found")


@query
def verdict_prompt_rows(spark, d):
    return scoring.verdict_prompt_rows(_results(spark, d), top=2).select(
        "artifact_id", F.col("threats_shown").cast("bigint").alias("threats_shown"), "prompt")


@query
def parse_verdict_responses(spark, d):
    return scoring.parse_verdict_responses(v.v_responses(spark, d)).select(
        "scan_id", "analysis.verdict", F.col("analysis.confidence").cast("bigint").alias("confidence"),
        "analysis.summary_en", F.array_join("analysis.key_risks", ",").alias("key_risks"), "analysis.recommendation")


# ---- threat intelligence -----------------------------------------------------

def _parsed_feed(spark, d) -> DataFrame:
    feed = v.v_cve_feed(spark, d).select("keyword", "pos", F.from_json("item", intel.ITEM_SCHEMA).alias("item"))
    return intel.cve_parse(feed)


@query
def cve_parse(spark, d):
    return _parsed_feed(spark, d)


@query
def cve_merge(spark, d):
    stored = _parsed_feed(spark, d).filter("pos % 3 = 0").select("cve_id")
    return intel.cve_merge(stored, _parsed_feed(spark, d))


@query
def cve_recent(spark, d):
    return intel.cve_recent(v.v_cves(spark, d), 50)


@query
def cve_search(spark, d):
    return intel.cve_search(v.v_cves(spark, d), "TH").select("cve_id", "affected_tech")


@query
def ioc_lookup(spark, d):
    return intel.ioc_lookup(v.v_hashes(spark, d), v.v_iocs(spark, d)).select(
        "artifact_id", "file_hash", "status", "severity", "is_verified", "reported_at")


@query
def ioc_merge(spark, d):
    reports = v.table(spark, d, "events").select(
        F.col("event_id").alias("report_id"),
        F.sha2(F.concat(F.lit("h"), (F.col("event_id") % 500).cast("string")), 256).alias("file_hash"),
        F.when(F.col("event_id") % 2 == 0, "critical").alias("severity"),
        F.col("user_id").cast("string").alias("reporter_id"), F.col("ts").alias("reported_at"))
    known = v.v_scans(spark, d).filter("risk_level = 'malicious' and risk_score > 60").select("file_hash").distinct()
    return intel.ioc_merge(known, reports).select("report_id", "file_hash", "severity", "reporter_id", "status")


def _patterns(spark, d) -> DataFrame:
    return v.table(spark, d, "part").groupBy(F.col("p_type").alias("pattern")).agg(
        F.lit("high").alias("severity"), F.lit("part").alias("category"), F.max("p_brand").alias("description_en"),
        F.min("p_brand").alias("description_ar"), F.sum("p_size").cast("bigint").alias("times_detected"),
        (F.count("*") % 3 != 0).alias("is_active"))


@query
def pattern_catalog_active(spark, d):
    return intel.pattern_catalog_active(_patterns(spark, d))


@query
def pattern_catalog_fallback(spark, d):
    return intel.pattern_catalog_active(_patterns(spark, d).withColumn("is_active", F.col("times_detected") < 0)).select(
        "pattern", "severity", "category", "source")


@query
def pattern_detection_counts(spark, d):
    return intel.pattern_detection_counts(v.v_findings(spark, d), _patterns(spark, d))


# ---- analytics ---------------------------------------------------------------

@query
def platform_stats(spark, d):
    return analytics.platform_stats(v.v_scans(spark, d))


@query
def overview(spark, d):
    return analytics.overview(v.v_scans(spark, d))


@query
def threat_statistics(spark, d):
    return analytics.threat_statistics(v.v_scans(spark, d), v.v_cves(spark, d), v.v_iocs(spark, d))


@query
def recent_scans(spark, d):
    return analytics.recent_scans(v.v_scans(spark, d), 10).withColumn(
        "threats_count", F.col("threats_count").cast("bigint"))


@query
def scan_detail(spark, d):
    ids = v.table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("scan_id"))
    told = F.col("risk_level") != "clean"
    scans = v.v_scans(spark, d).withColumns({
        "metadata_info": F.when(told, F.create_map(F.lit("file_size"), F.col("file_size").cast("string"))),
        "source_url": F.when(told, F.concat(F.lit("https://x.example/"), "scan_id")),
        "ai_summary_en": F.when(told, F.concat(F.lit("seen in "), "filename")), "ai_summary_ar": F.lit(""),
        "ai_key_risks": F.when(told, F.array("risk_level"))})
    return analytics.scan_detail(ids, scans).select(
        F.col("metadata")["file_size"].alias("metadata_size"), "source_url", "summary_en", "summary_ar", "recommendation", "recommendation_ar",
        F.array_join("key_risks", ",").alias("key_risks"), "scan_id", "found", "filename", "risk_score", "risk_level",
        F.size("threats").cast("bigint").alias("threats"), "created_at", "verdict",
        F.col("confidence").cast("bigint").alias("confidence"))


@query
def daily_trend(spark, d):
    return analytics.daily_trend(v.v_scans(spark, d), "7d", NOW)


@query
def daily_trend_90d(spark, d):
    return analytics.daily_trend(v.v_scans(spark, d), "90d", NOW)


@query
def level_pivot_by_day(spark, d):
    return analytics.level_pivot_by_day(v.v_scans(spark, d))


@query
def threats_by_extension(spark, d):
    return analytics.threats_by_extension(v.v_scans(spark, d))


@query
def severity_distribution(spark, d):
    return analytics.severity_distribution(v.v_scans(spark, d))


@query
def traffic_by_ip(spark, d):
    return analytics.traffic_by_ip(v.v_scans(spark, d))


@query
def compare_scans(spark, d):
    pairs = v.table(spark, d, "orders").select(
        F.col("o_orderkey").cast("string").alias("scan_a"), F.col("o_custkey").cast("string").alias("scan_b"))
    return analytics.compare_scans(pairs, v.v_scans(spark, d)).withColumns(
        {c: F.col(c).cast("bigint") for c in ("a_threat_count", "b_threat_count")})


@query
def badge_rows(spark, d):
    return analytics.badge_rows(v.v_scans(spark, d))


@query
def report_rows(spark, d):
    return analytics.report_rows(v.v_scans(spark, d).select("scan_id", "threats")).withColumn(
        "pos", F.col("pos").cast("bigint"))


@query
def policy_gate(spark, d):
    batches = v.v_scans(spark, d).withColumn("batch", F.col("ip_address"))
    strict = analytics.policy_gate(batches, fail_on_critical=True, fail_on_dangerous=True)
    lenient = analytics.policy_gate(batches).select(
        F.col("batch"), F.col("exit_code").alias("exit_critical"))
    return (strict.withColumnRenamed("exit_code", "exit_dangerous")
            .join(lenient, strict.batch.eqNullSafe(lenient.batch)).select(
                strict.batch, "scans", "failing", F.col("exit_critical").cast("bigint").alias("exit_critical"),
                F.col("exit_dangerous").cast("bigint").alias("exit_dangerous")))


# ---- usage and notifications -------------------------------------------------

@query
def key_usage(spark, d):
    usage = v.table(spark, d, "orders").join(
        v.table(spark, d, "customer").select("c_custkey", F.sha2("c_name", 256).alias("key_hash")),
        F.col("o_custkey") == F.col("c_custkey")).select("key_hash")
    presented = v.table(spark, d, "customer").select(
        F.col("c_custkey").alias("request_id"),
        F.when(F.col("c_custkey") % 7 == 0, "wrong").otherwise(F.col("c_name")).alias("raw_key"))
    return notify.key_usage(presented, v.v_api_keys(spark, d), usage).withColumn(
        "scans_limit", F.col("scans_limit").cast("bigint"))


def _scan_events(spark, d) -> DataFrame:
    return notify.scan_events(v.v_scans(spark, d))


@query
def scan_events(spark, d):
    return _scan_events(spark, d)


@query
def webhook_fanout(spark, d):
    return notify.webhook_fanout(_scan_events(spark, d).hint("rebalance"), v.v_webhook_subs(spark, d)).select(
        "scan_id", "subscription_id", "event_type", "payload", "signature")


@query
def delivery_log(spark, d):
    return notify.delivery_log(v.v_webhook_logs(spark, d), v.v_webhook_subs(spark, d), n=5).select(
        "user_id", F.col("rank").cast("bigint").alias("rank"), "id", "url", "event_type",
        F.col("response_status").cast("bigint").alias("response_status"), "triggered_at")


@query
def profile_merge(spark, d):
    """All users meet a newer and an older profile of every customer, half of them under an address of their own."""
    key, name = F.col("c_custkey"), F.concat(F.lit("New "), F.col("c_name"))
    domain = F.when(key % 2 == 0, "@example.com").otherwise("@new.example.com")
    customers = v.table(spark, d, "customer").withColumn("seen_at", F.explode(F.array(F.lit(1), F.lit(2))))
    newer = F.col("seen_at") == 2
    incoming = customers.select(
        F.concat(F.col("c_name"), domain).alias("email"), F.lit("").alias("username"),
        F.when(~newer, "Old").when(key % 4 == 0, "").otherwise(name).alias("display_name"),
        F.when(newer & (key % 6 == 0), "https://img.example/a").alias("avatar_url"),
        F.lit("google").alias("provider"), F.concat(F.when(newer, "g").otherwise("old"), key.cast("string")).alias("provider_id"), "seen_at")
    return notify.profile_merge(v.v_users(spark, d), incoming, "seen_at")


# ---- batch forms of the streaming operators ----------------------------------

@query
def scan_progress_state(spark, d):
    return latest_stage(v.v_progress(spark, d)).select(
        "scan_id", "stage", F.col("progress").cast("bigint").alias("progress"), "timestamp", "closed")


@query
def live_stats(spark, d):
    totals = analytics.overview(v.v_scans(spark, d)).select("total_scans", "threats_found")
    running = open_scans(v.v_progress(spark, d))
    names = ["total_scans", "threats_found", "active_scans"]
    return totals.unionByName(running, allowMissingColumns=True).agg(*[F.sum(c).alias(c) for c in names])


@query
def rate_limit_audit(spark, d):
    limits = {"scan_file": (1, "1 minute"), "scan_url": (1, "1 minute"), "key_generate": (1, "1 hour")}
    return ratelimits.rate_limit_audit(v.v_requests(spark, d), limits)
