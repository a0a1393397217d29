"""Scores, ranks and pages, hot groups included."""

import hashlib
import hmac
import json
import random

import pytest
from pyspark.sql import functions as F

from modelsieve.functions.hashing import hmac_pads, hmac_sha256
from modelsieve.operators import analytics, intel, notify, scoring
from modelsieve.sources.exports import export_json
from modelsieve.sources.tables import append_results, conform, read_table

VECTORS = [("LLUHHH", 8.4, 8.4), ("LLCHHH", 10.0, 9.3), ("NLUHHH", 9.8, 9.8), ("LHUHHH", 7.4, 7.4),
           ("NLUHNN", 7.5, 7.5), ("NLCHHH", 10.0, 10.0), ("LHULNN", 2.9, 2.9)]


@pytest.mark.parametrize("mode,column", [("reference", 1), ("spec", 2)])
def test_cvss_vectors(spark, mode, column):
    rows = [(v, (v[0], v[1], "N", "N", v[2], v[3], v[4], v[5])) for v, *_ in VECTORS]
    df = spark.createDataFrame(rows, "k string, metrics struct<av:string,ac:string,pr:string,ui:string,s:string,"
                                     "c:string,i:string,a:string>")
    got = {r["k"]: r["cvss_score"] for r in scoring.cvss_base_score(df, mode=mode).collect()}
    assert got == {v[0]: v[column] for v in VECTORS}


def findings(spark, n=3000, hot=2000):
    rng = random.Random(3)
    rows = [("hot" if k < hot else f"a{k % 97}", rng.randrange(1 << 24), rng.choice(["critical", "high", "low", None, "odd"]),
             rng.choice([None, 2.0, 9.8, 5.5]), f"p{k}") for k in range(n)]
    rows = list({(r[0], r[1]): r for r in rows}.values())
    return rows, spark.createDataFrame(rows, "artifact_id string, ordinal bigint, severity string, cvss_score double, "
                                             "pattern_id string").withColumns({
        "type": F.lit("t"), "desc": F.lit("d"), "category": F.lit(None).cast("string")})


RANK = {"critical": 4, "high": 3, "low": 1}


def test_rank_matches_sort_with_one_hot_artifact(spark):
    rows, df = findings(spark)
    got = {(r["artifact_id"], r["ordinal"]): r["rank"] for r in scoring.rank_findings(df).collect()}
    want = {}
    for key in {r[0] for r in rows}:
        ordered = sorted((r for r in rows if r[0] == key), key=lambda r: (-RANK.get(r[2], 0), r[1]))
        want |= {(key, r[1]): k for k, r in enumerate(ordered, 1)}
    assert got == want


def test_scores_take_first_finding_with_maximum(spark):
    rows, df = findings(spark)
    for r in scoring.artifact_cvss(df).collect():
        mine = sorted((x for x in rows if x[0] == r["artifact_id"]), key=lambda x: x[1])
        best = max((x[3] or 0.0 for x in mine), default=0.0)
        first = next((x[2] for x in mine if (x[3] or 0.0) == best), None) if best > 0 else "None"
        assert (r["cvss_score"], r["threats_found"]) == (best, len(mine))
        assert r["severity"] == (first or "None")


def test_pages_hold_every_threat_once(spark):
    rows, df = findings(spark)
    arts = spark.createDataFrame([(k, f"{k}.pkl", ".pkl", 5, "pickle") for k in {r[0] for r in rows} | {"none"}],
                                 "artifact_id string, filename string, ext string, file_size bigint, format string")
    res = scoring.assemble_results(arts, df, page_size=100).collect()
    hot = sorted((r for r in res if r["artifact_id"] == "hot"), key=lambda r: r["page"])
    assert [r["page"] for r in hot] == list(range(len(hot))) and all(len(r["threats"]) <= 100 for r in hot)
    shown = [t["pattern"] for r in hot for t in r["threats"]]
    ordered = sorted((r for r in rows if r[0] == "hot"), key=lambda r: (-RANK.get(r[2], 0), r[1]))
    assert shown == [r[4] for r in ordered] and hot[0]["threats_found"] == len(shown)
    empty = next(r for r in res if r["artifact_id"] == "none")
    assert (empty["status"], empty["risk_score"], empty["threats"]) == ("safe", 0, [])


@pytest.mark.parametrize("key", ["k", "s" * 64, "long" * 40, ""])
def test_hmac_equals_library(spark, key):
    row = spark.range(1).select(hmac_sha256(hmac_pads(F.encode(F.lit(key), "UTF-8")),
                                            F.encode(F.lit("påyload"), "UTF-8")).alias("h")).first()
    assert row["h"] == hmac.new(key.encode(), "påyload".encode(), hashlib.sha256).hexdigest()


def test_fanout_with_hot_user(spark):
    events = spark.range(500).select(F.col("id").cast("string").alias("scan_id"), F.lit("u").alias("user_id"),
                                     F.lit("scan.completed").alias("event_type"), F.lit("{}").alias("payload"))
    subs = spark.createDataFrame(
        [(1, "u", "x", "k", ["all"], True), (2, "u", "x", "k", ["threat.critical"], True),
         (3, "u", "x", "k", ["scan.completed"], False), (4, "v", "x", "k", ["all"], True)],
        "id int, user_id string, url string, secret_token string, events array<string>, is_active boolean")
    out = notify.webhook_fanout(events, subs)
    assert {r["subscription_id"] for r in out.collect()} == {1} and out.count() == 500


def test_verdict_answers(spark):
    answers = {"a": '```json\n{"verdict":"SAFE","confidence":1}\n``` x', "b": "[1]", "c": '{"confidence":"no"}',
               "d": '```\n{"verdict":"X"}```', "e": "```json\nbroken```", "f": '{"key_risks":["q"]}'}
    df = spark.createDataFrame(list(answers.items()), "k string, response string")
    got = {r["k"]: (r["analysis"]["verdict"], r["analysis"]["confidence"], r["analysis"]["key_risks"])
           for r in scoring.parse_verdict_responses(df).collect()}
    assert got == {"a": ("SAFE", 1, []), "b": ("UNKNOWN", 50, []), "c": ("SUSPICIOUS", 50, []), "d": ("X", 50, []),
                   "e": ("UNKNOWN", 50, []), "f": ("SUSPICIOUS", 50, ["q"])}


def test_cve_score_by_presence(spark):
    items = ['{"cve":{"id":"A","metrics":{"cvssMetricV31":[{"cvssData":{}}],"cvssMetricV2":[{"cvssData":{"baseScore":5}}]}}}',
             '{"cve":{"id":"B","descriptions":[{"lang":"fr","value":"x"},{"lang":"en","value":"y"}],'
             '"metrics":{"cvssMetricV2":[{"cvssData":{"baseScore":5}}]},"published":"2024-01-02T03:04:05.000"}}', "{}"]
    df = spark.createDataFrame([(i,) for i in items], "j string").select(F.from_json("j", intel.ITEM_SCHEMA).alias("item"))
    got = [(r["cve_id"], r["description"], r["cvss_score"]) for r in intel.cve_parse(df).collect()]
    assert got == [("A", intel.DEFAULT_TEXT, None), ("B", "y", 5.0), ("UNKNOWN", intel.DEFAULT_TEXT, None)]


def test_empty_inputs(spark):
    scans = conform(spark.range(0).select(F.lit(None).alias("scan_id")), "scans")
    assert analytics.platform_stats(scans).first().asDict() == {
        "total": 0, "clean": 0, "suspicious": 0, "malicious": 0, "critical": 0, "avg_risk_score": 0.0}
    from datetime import datetime
    assert analytics.daily_trend(scans, "7d", datetime(2024, 1, 1)).count() == 0
    assert [r["count"] for r in analytics.severity_distribution(scans).collect()] == [0, 0, 0, 0]
    with pytest.raises(ValueError):
        analytics.recent_scans(scans, 51)


def test_store_is_idempotent_and_typed(spark, tmp_path):
    rows = spark.range(10).select(F.col("id").cast("string").alias("scan_id"), F.lit(1.5).alias("risk_score"),
                                  F.timestamp_add("DAY", F.col("id").cast("int") % 3, F.lit("2024-01-01").cast("timestamp"))
                                  .alias("created_at"))
    path = str(tmp_path / "scans")
    append_results(rows.filter("id < 6") if "id" in rows.columns else rows.limit(6), path)
    append_results(rows.unionByName(rows), path)
    stored = read_table(spark, "scans", path)
    assert stored.count() == 10 and stored.select("scan_id").distinct().count() == 10
    assert dict(stored.dtypes)["threats"].startswith("array<struct<pattern")
    export_json(stored.select("scan_id", "risk_score", "filename"), str(tmp_path / "json"))
    docs = [json.loads(r["value"]) for r in spark.read.text(str(tmp_path / "json")).collect()]
    assert len(docs) == 10 and set(docs[0]) == {"scan_id", "risk_score", "filename"}
