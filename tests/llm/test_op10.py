import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from modelsieve.llm import op10_quality as op
from tests.conftest import SF

SF = SF.replace("0.001", "0.01")


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


def test_held_out_accuracy(spark, tables):
    docs, labels = tables
    known = op.acceptable(labels)
    part = F.pmod(F.xxhash64(F.lit("split"), "_key"), F.lit(4)) == 0
    shown = labels.join(known.filter(~part), labels.doc_id == F.col("_key"), "left_semi")
    rows = op.judged(docs, shown).join(known.filter(part), F.col("doc_id") == F.col("_key")).collect()
    assert len(rows) > 60
    clean = [r["kept"] for r in rows if r["good"] == 1]
    assert sum(clean) >= 0.97 * len(clean)
    assert np.mean([r["kept"] == (r["good"] == 1) for r in rows]) > 0.85


def test_rates_equal_plain_arithmetic(spark, tables):
    docs, labels = tables
    rows = op.judged(docs, labels).join(docs.select("doc_id", "source", "lang"), "doc_id").collect()
    good = {r["_key"]: r["good"] for r in op.acceptable(labels).collect()}
    model = op.fit(docs, labels)
    prior = np.log(model.rate / (1 - model.rate))
    seen = {r["doc_id"]: good.get(r["doc_id"], 1 / (1 + np.exp(-(r["evidence"] + prior)))) for r in rows}
    total, rate = len(rows), np.mean(list(seen.values()))
    by = lambda f: {k: [seen[r["doc_id"]] for r in rows if f(r) == k] for k in {f(r) for r in rows}}
    hosts, paths = by(lambda r: r["source"]), by(lambda r: (r["source"], r["lang"]))
    spread = sum(sum(v) ** 2 / len(v) for v in hosts.values()) / total - rate**2
    strong = op._strength(rate, spread, len(hosts), total)
    inner = sum(len(v) * (np.mean(v) - np.mean(hosts[k[0]])) ** 2 for k, v in paths.items()) / total
    firm = op._strength(rate, inner, len(paths), total)
    for r in rows:
        host, path, own = hosts[r["source"]], paths[r["source"], r["lang"]], seen[r["doc_id"]]
        host_rate = (sum(host) + strong * rate) / (len(host) + strong)
        path_rate = (sum(path) - own + firm * host_rate) / (len(path) - 1 + firm)
        assert abs(r["host_rate"] - host_rate) < 1e-6 and abs(r["path_rate"] - path_rate) < 1e-6
        logit = r["evidence"] + np.log(path_rate / (1 - path_rate))
        assert abs(r["probability"] - 1 / (1 + np.exp(-logit))) < 1e-6


def test_sparse_sites_lean_on_their_elders():
    assert op._strength(0.5, 0.2, 10, 10_000) < 2 < op._strength(0.5, 0.25 * 10 / 10_000, 10, 10_000)


def test_newton_fit_is_at_the_optimum():
    rng = np.random.default_rng(0)
    x = np.column_stack([rng.normal(size=(500, 3)), np.ones(500)])
    y = (rng.random(500) < 1 / (1 + np.exp(-x @ [1, -2, 0, 0.5]))).astype(float)
    w = op._fit(x, y)
    p = 1 / (1 + np.exp(-x @ w))
    assert np.abs(x.T @ (y - p) - np.array([1, 1, 1, 1e-6]) * w).max() < 1e-6


def test_presence_folds_case_and_marks():
    got = op.presence(pa.array(["An Idiot, there", "", "idiotic", "(IDIOT)"]), ("idiot", "there"))
    assert got.tolist() == [[1, 1], [0, 0], [0, 0], [1, 0]]


def test_odd_rows(spark, tables, odd_documents, no_documents):
    docs, labels = tables
    odd_labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (3, None, 0), (None, 1, 1), (4, 1, 0)], "doc_id long, quality int, toxic int")
    for given in (labels, odd_labels, odd_labels.limit(0)):
        rows = op.judged(odd_documents, given).collect()
        assert len(rows) == odd_documents.count() and all(0 <= r["probability"] <= 1 for r in rows)
        assert op.keep_good(odd_documents, given).columns == odd_documents.columns
    assert all(r["kept"] for r in rows)
    assert op.judged(no_documents, labels).count() == 0 and op.keep_good(no_documents, labels).count() == 0


def test_one_key_on_many_rows_counts_once_in_the_sample(spark, tables):
    docs, labels = tables
    hot = labels.filter("quality = 1 and toxic = 0").agg(F.min("doc_id")).first()[0]
    extra = spark.range(3000).select(F.lit(hot).alias("doc_id"), F.concat(F.lit("zebra crossing "), "id").alias("text"),
                                     F.lit("en").alias("lang"), F.lit("s0").alias("source"), F.lit(20).cast("long").alias("n_chars"))
    plain, model = op.fit(docs, labels), op.fit(docs.unionByName(extra), labels)
    assert "zebra" not in model.words and abs(model.rate - plain.rate) < 1e-9


def test_each_row_is_kept_by_its_own_result(spark, tables):
    docs, labels = tables
    found = op.judged(docs, labels).filter("evidence > 2").orderBy(F.desc("evidence")).limit(1).select("doc_id")
    good = docs.join(found, "doc_id").first()
    bad = docs.join(op.judged(docs, labels).orderBy("evidence").limit(1).select("doc_id"), "doc_id").first()
    rows = [(k, r["text"], r["lang"], r["source"], n) for k in (None, 10**9) for n, r in enumerate((good, bad))]
    more = docs.unionByName(spark.createDataFrame(rows, docs.schema))
    kept = {(r["doc_id"], r["n_chars"]) for r in op.keep_good(more, labels).filter("doc_id is null or doc_id = 1000000000").collect()}
    assert kept == {(None, 0), (10**9, 0)}
