from hashlib import md5, sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from modelsieve.llm import op11_sketch as op
from tests.conftest import SF
from tools.check_oracle import connect, rows_of


def shingles(text):
    words = text.encode().lower().split()
    return {b" ".join(words[k:k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def plain_sketch(text, fraction=8, least=16):
    hashes = sorted({int(md5(s).hexdigest()[:16], 16) for s in shingles(text)})
    below = [h for h in hashes if h * fraction < 1 << 64]
    return below if len(below) > least else hashes[:least]


def plain_likeness(a, b):
    """Of texts; by the rule that both sketches are compared as far as both are complete."""
    hashes = [sorted({int(md5(s).hexdigest()[:16], 16) for s in shingles(t)}) for t in (a, b)]
    top = min((1 << 64 if len(h) < 16 else max(h[15], (1 << 61) - 1)) for h in hashes)
    x, y = ({v for v in h if v <= top} for h in hashes)
    return len(x & y) / len(x | y) if x | y else 1.0


def plain(rows):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, md5((r[1] or "").encode()).hexdigest()))
    out = []
    for k, (key, text) in enumerate(order):
        text, other = text or "", order[(k + 1) % len(order)][1] or ""
        cut = len(text) // 4
        edited = text[:len(text) - cut] + other[:cut]
        hexes = ["".join(f"{h:016x}" for h in plain_sketch(t)) for t in (text, edited)]
        out.append((str(key), len(text), sha256(edited.encode()).hexdigest(), *hexes, plain_likeness(text, edited), plain_likeness(text, other)))
    return sorted(out)


def made(documents):
    return sorted((str(r[0]), *r[1:]) for r in op.edits(documents).collect())


def test_whole_table_equals_plain_form(spark):
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    assert made(documents.repartition(7)) == plain([(r["doc_id"], r["text"]) for r in documents.collect()])


def test_query_equals_sql(spark):
    assert rows_of(op.op11_threshold_sketch(spark, SF).toPandas()) == rows_of(connect(SF).execute(op.SQL).df())


def test_odd_rows(spark, odd_documents, no_documents):
    clash = odd_documents.withColumn("_key", F.lit(1)).withColumn("_end", F.lit(0)).withColumn("fingerprint", F.lit("x"))
    assert made(clash) == plain([(r["doc_id"], r["text"]) for r in odd_documents.collect()])
    assert made(no_documents) == []
    lone = made(spark.createDataFrame([(1, "abcdefgh")], "doc_id long, text string"))
    assert lone == plain([(1, "abcdefgh")]) and lone[0][2] == sha256(b"abcdefab").hexdigest()


def test_sketch_merge_and_bounds():
    words = [f"w{k}" for k in range(5000)]
    a, b = " ".join(words[:3000]), " ".join(words[2000:])
    for text in (a, b, "one two", "x " * 900, " ".join(words[:22]), ""):
        assert op.sketch(text).tolist() == plain_sketch(text)
        assert op.parsed(op.written(op.sketch(text))).tolist() == plain_sketch(text)
    # Shingles of the joint text are those of both parts, as they overlap by more than a shingle.
    assert op.merge(op.sketch(a), op.sketch(b)).tolist() == plain_sketch(" ".join(words))
    assert abs(op.likeness(op.sketch(a), op.sketch(b)) - 0.2) < 0.05
    short = " ".join(words[100:400])
    assert op.containment(op.sketch(short), op.sketch(a)) == 1.0 and op.containment(op.sketch(a), op.sketch(short)) < 0.2
    assert op.likeness(op.sketch(""), op.sketch(" ")) == 1.0 and op.containment(op.sketch(""), op.sketch(a)) is None
    assert op.bound(op.sketch("one two")) == op.ALL and op.bound(np.arange(16, dtype=np.uint64)) == op.ALL // 8


@pytest.mark.parametrize("parts", [1, 6])
def test_containment_in_collections(spark, parts):
    words = [f"w{k}" for k in range(4000)]
    rows = [(1, "a", " ".join(words[:2000])), (2, "a", " ".join(words[1000:3000])), (3, "b", " ".join(words[2500:])), (4, "b", " ".join(words[:1000])), (5, "b", None)]
    documents = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(parts)
    prints = op.fingerprints(documents).join(documents.select("doc_id", "source"), "doc_id")
    found = {(r["doc_id"], r["source"]): r["share"] for r in op.contained(op.fingerprints(documents), op.members(prints, "source"), "source").collect()}
    sketches = {k: {h for h in plain_sketch(t or "") if h * 8 < 1 << 64} for k, _, t in rows}
    for source, own in (("a", (1, 2)), ("b", (3, 4, 5))):
        whole = set().union(*[sketches[k] for k in own])
        for key, hashes in sketches.items():
            share = len(hashes & whole) / len(hashes) if hashes else 0
            assert found.get((key, source), 0) == share
