import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from modelsieve.llm import op8_outliers as op
from tests.conftest import SF

SF = SF.replace("0.001", "0.01")


def slow_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[k:k + 3]) for k in range(len(words) - 2)]
    seen, covered = Counter(windows), set()
    for k, w in enumerate(windows):
        if seen[w] > 1:
            covered |= {k, k + 1, k + 2}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    dups = sum(x in lines[:k] for k, x in enumerate(lines)) if len(lines) < 3000 else len(lines) - len(set(lines))
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dups, len(covered))


def test_counts_equal_plain_form(spark):
    rng = random.Random(4)
    parts = ["a", "b", "é", "中文", " ", "  ", "\n", "\t", "#", "a b c ", " ", "\x0b", "\x85", "||"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(60))) for _ in range(400)] + ["", " ", "\n"]
    texts += [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").limit(80).collect()]
    assert [tuple(r[:5]) for r in op.text_counts(pa.array(texts)).tolist()] == [slow_counts(t) for t in texts]


def test_many_distinct_words_take_the_two_step_numbering():
    rng = np.random.default_rng(1)
    codes = rng.integers(0, 4, 300)
    assert op._repeated_words(codes, 4) == op._repeated_words(codes, 1 << 21)


def test_consistency_factor():
    rng = np.random.default_rng(1)
    d = np.sort((rng.normal(size=(200_000, 6)) ** 2).sum(1))[:150_000]
    assert abs(op._consistency(0.75) - 6 * 150_000 / d.sum()) < 0.01


def binned(values, width, share):
    bins = np.sort(np.floor(values / width))
    return bins[int(np.ceil(len(bins) * share)) - 1]


def inverse(cov):
    floors = np.array(op.FLOORS)
    values, vectors = np.linalg.eigh(cov / np.outer(floors, floors))
    values = np.maximum(values, 1)
    return (vectors / values) @ vectors.T / np.outer(floors, floors), np.log(values).sum()


def plain_starts(x):
    q = [np.array([(binned(c, 0.002, s) + 0.5) * 0.002 for c in x.T]) for s in (0.25, 0.5, 0.75)]
    spread = np.maximum((q[2] - q[0]) / 1.349, op.FLOORS)
    z = (x - q[1]) / spread
    u = z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)
    related = [np.eye(x.shape[1])]
    for cross in (np.cov(np.tanh(z).T, bias=True), u.T @ u / len(u)):
        size = np.sqrt(np.diag(cross))
        r = np.array([[1.0 if a == b else cross[a, b] / size[a] / size[b] if min(size[a], size[b]) > 1e-6 else 0.0
                       for b in range(len(size))] for a in range(len(size))])
        related.append(r)
    return [(q[1], inverse(np.outer(spread, spread) * r)[0], np.inf) for r in related]


def plain_step(x, centre, precision, _):
    d = np.log2(1 + np.einsum("ij,jk,ik->i", x - centre, precision, x - centre))
    near = x[d < (binned(d, 1 / 64, op.SUBSET) + 1) / 64]
    precision, log_det = inverse(np.cov(near.T, bias=True) * op._consistency(op.SUBSET))
    return near.mean(0), precision, log_det


def plain_mcd(x):
    """All starts and their steps on one array."""
    ends = []
    for best in plain_starts(x):
        while (after := plain_step(x, *best))[2] < best[2] - op.FALL:
            best = after
        ends.append(best)
    return min(ends, key=lambda m: round(m[2], 6))


def test_distances_equal_plain_estimate(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = op.judged(docs).join(docs.select("doc_id", "lang", "source"), "doc_id").collect()

    def stats(r):
        share = lambda a, b: np.arcsin(np.sqrt(min(1.0, r[a] / max(r[b], 1))))
        return [np.log(r["word_chars"] / r["n_words"]), share("n_symbols", "word_chars"), share("n_dup_lines", "n_lines"),
                share("n_repeat_words", "n_words"), share("n_capitals", "word_chars"), share("n_marks", "word_chars")]

    x = np.array([stats(r) for r in rows])
    langs, sites = np.array([r["lang"] for r in rows]), np.array([f"{r['lang']} {r['source']}" for r in rows])
    made = {}
    for k, r in enumerate(rows):
        group = sites == sites[k]
        name = sites[k] if group.sum() >= op.LEAST_ROWS else langs[k]
        group = group if name == sites[k] else langs == langs[k]
        if group.sum() < op.LEAST_ROWS:
            name, group = "all", np.ones(len(rows), bool)
        if name not in made:
            made[name] = plain_mcd(x[group])
        centre, precision, _ = made[name]
        want = np.sqrt((x[k] - centre) @ precision @ (x[k] - centre))
        assert abs(want - r["distance"]) < 1e-6, (name, want, r["distance"])
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        assert r["kept"] == (not r["base_failed"] and r["distance"] <= op.CUTOFF)


def site_rows(spark, x):
    """Rows of one pair that is its own site."""
    rows = spark.createDataFrame([("p", k % op.SALTS, *map(float, v)) for k, v in enumerate(x)],
                                 ", ".join(["_pair string, _salt int", *[f"{f} double" for f in op.FEATURES]]))
    return rows, spark.createDataFrame([("p", 0, "p")], "_pair string, level int, site string")


def test_the_start_with_the_least_determinant_wins(spark):
    rng = np.random.default_rng(3)
    mixed = np.linalg.qr(rng.normal(size=(6, 6)))[0] @ np.diag([3, 2, 1.5, 1.2, 1, 0.8])
    x = np.vstack([rng.normal(size=(360, 6)) @ mixed.T, rng.normal(size=(240, 6)) * 0.3 + 9 * mixed[:, 0]])
    rows, owned = site_rows(spark, x)
    found = op.estimates(rows, owned).first()
    centre, precision, log_det = plain_mcd(x)
    assert np.allclose(found["centre"], centre, atol=1e-8) and np.allclose(np.reshape(found["precision"], (6, 6)), precision, atol=1e-8)
    assert abs(found["log_det"] - log_det) < 1e-8
    assert found["log_det"] < inverse(np.cov(x.T, bias=True))[1]


def test_rows_without_spread_have_an_estimate(spark):
    rows, owned = site_rows(spark, np.ones((50, 6)))
    found = op.estimates(rows, owned).first()
    assert np.allclose(found["centre"], 1) and abs(found["log_det"]) < 1e-9


def test_no_key_of_a_join_holds_a_site(spark):
    rows, owned = site_rows(spark, np.random.default_rng(5).normal(size=(3200, 6)))
    met = rows.groupBy("_pair", "_salt").count().agg({"count": "max"}).first()[0]
    assert met == 100 and op._met(rows, owned, op._starts(rows, owned)).count() == 3 * 3200


def test_junk_goes_and_clean_text_stays(spark):
    rows = op.op8_mcd_outliers(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").collect()
    clean = [r for r in rows if r["quality"] == 1 and not r["base_failed"]]
    junk = [r for r in rows if r["quality"] == 0]
    assert all(r["kept"] for r in clean) and not any(r["kept"] for r in junk) and len(junk) > 20


def test_odd_rows(odd_documents, no_documents):
    rows = op.judged(odd_documents).collect()
    assert len(rows) == odd_documents.count() and not any(r["kept"] for r in rows)
    assert op.keep_good(odd_documents).columns == odd_documents.columns
    assert op.judged(no_documents).count() == 0 and op.keep_good(no_documents).count() == 0


def test_each_row_is_kept_by_its_own_result(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = op.judged(docs).filter("kept").limit(1).select("doc_id")
    good = docs.join(kept, "doc_id").first()
    rows = [(k, t, good["lang"], good["source"], n) for k in (None, 10**9) for n, t in enumerate((good["text"], "too short"))]
    found = op.keep_good(docs.unionByName(spark.createDataFrame(rows, docs.schema))).filter("doc_id is null or doc_id = 1000000000")
    assert {(r["doc_id"], r["n_chars"]) for r in found.collect()} == {(None, 0), (10**9, 0)}


def prose(rng, words):
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 8))) for _ in range(words))


def kept_of(spark, texts):
    """``kept`` of each text among 400 plain ones of its site."""
    rng = random.Random(7)
    rows = [(-k, prose(rng, 100 + k % 80), "en", "s") for k in range(1, 401)] + [(k, t, "en", "s") for k, t in enumerate(texts)]
    found = op.judged(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()
    assert all(r["kept"] for r in found if r["doc_id"] < 0) and not any(r["base_failed"] for r in found)
    return {r["doc_id"]: r["kept"] for r in found if r["doc_id"] >= 0}


def test_a_third_of_a_site_in_copies_of_junk_goes(spark):
    rng = random.Random(8)
    junk = " ".join("#" + prose(rng, 1).upper() + "$|" for _ in range(80))
    assert not any(kept_of(spark, [junk] * 200).values())


def test_repeated_lines_or_words_alone_are_rejected_under_the_base_rule(spark):
    rng = random.Random(9)
    lines = "\n".join(["Home"] * 60 + [prose(rng, 1000) for _ in range(3)])
    passage = prose(rng, 25)
    words = " ".join([passage, prose(rng, 52), passage])
    assert kept_of(spark, [lines, words]) == {0: False, 1: False}
