import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from modelsieve.llm import op13_merkle as op
from tests.conftest import SF
from tools.check_oracle import connect, rows_of


def H(text):
    return sha256(text.encode()).hexdigest()


def plain_leaf(row):
    return H("".join("-" if row[c] is None else f"{len(str(row[c]).encode())}:{row[c]}" for c in op.FIELDS))


def plain_tree(nodes, fanout):
    """(root, proof of every leaf) by growing each level at once."""
    proofs, own = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [list(range(k, min(k + fanout, len(nodes)))) for k in range(0, len(nodes), fanout)]
        for leaf, at in enumerate(own):
            proofs[leaf] += [nodes[k] for k in runs[at // fanout] if k != at]
        nodes, own = [H("".join(nodes[k] for k in run)) for run in runs], [at // fanout for at in own]
    return nodes[0], proofs


def plain_fold(node, proof, at, n, fanout):
    proof = list(proof)
    while n > 1:
        low = at // fanout * fanout
        run = min(fanout, n - low)
        others, proof = proof[:run - 1], proof[run - 1:]
        others.insert(at - low, node)
        node, at, n = H("".join(others)), at // fanout, -(-n // fanout)
    assert not proof or n == 1
    return node, proof


def plain(rows, fanout=2):
    """Sorted (doc_id, leaf, subroot, root, proof digest, folded root, verified)."""
    first = lambda v: (v is not None, v.encode() if isinstance(v, str) else v)
    langs = sorted({r["lang"] for r in rows}, key=first)
    trees = {}
    for lang in langs:
        own = sorted((r for r in rows if r["lang"] == lang), key=lambda r: (first(r["doc_id"]), plain_leaf(r)))
        trees[lang] = (own, *plain_tree([plain_leaf(r) for r in own], fanout))
    if not langs:
        return []
    root, tops = plain_tree([trees[x][1] for x in langs], fanout)
    out = []
    for g, lang in enumerate(langs):
        own, subroot, proofs = trees[lang]
        for at, (row, proof) in enumerate(zip(own, proofs)):
            tampered = dict(row)
            if row["doc_id"] is not None and zlib.crc32(str(row["doc_id"]).encode()) % 7 == 0 and row["n_chars"] is not None:
                tampered["n_chars"] += 1
            whole = proof + tops[g]
            node, rest = plain_fold(plain_leaf(tampered), whole, at, len(own), fanout)
            node, rest = plain_fold(node, rest, g, len(langs), fanout)
            assert not rest
            out.append((str(row["doc_id"]), plain_leaf(row), subroot, root, H("".join(whole)), node, node == root))
    return sorted(out)


def audited(documents, **how):
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    claimed = {"n_chars": F.when(tampered, F.col("n_chars") + 1).otherwise(F.col("n_chars"))}
    return sorted((str(r[0]), *r[1:]) for r in op.audit(documents, claimed, **how).collect())


@pytest.mark.parametrize("fanout, block", [(2, 4), (3, 9)])
def test_butterfly_equals_plain_tree(spark, fanout, block):
    documents = spark.read.parquet(f"{SF}/documents.parquet").repartition(5)
    assert audited(documents, fanout=fanout, block=block) == plain([r.asDict() for r in documents.collect()], fanout)


def test_ragged_groups(spark):
    rows = [(100 * size + k, f"text {k}", f"l{size}" if k or size < 9 else None, "s", k) for size in (1, 2, 3, 5, 9, 17) for k in range(size)]
    documents = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert audited(documents, block=2) == plain([r.asDict() for r in documents.collect()])


def test_odd_rows(spark, odd_documents, no_documents):
    clash = odd_documents.withColumn("_leaf", F.lit(1)).withColumn("_g", F.lit("x")).withColumn("root", F.lit(2))
    assert audited(clash, block=2) == plain([r.asDict() for r in odd_documents.collect()])
    assert audited(no_documents) == [] and op.proofs(no_documents).collect() == []


def test_proofs_fold_to_the_root(spark):
    rows = op.proofs(spark.read.parquet(f"{SF}/documents.parquet"), fanout=4, block=16).collect()
    for r in rows:
        walk = iter(r["siblings"])
        below = op.fold(r["leaf"], walk, r["rank"], r["size"], 4)
        assert below == r["subroot"]
        assert op.fold(below, walk, r["group_rank"], r["groups"], 4) == r["root"] and next(walk, None) is None
    with pytest.raises(ValueError):
        op.proofs(spark.createDataFrame([], "doc_id long, lang string"), fanout=3, block=4096)


def test_query_equals_sql(spark):
    assert rows_of(op.op13_merkle_butterfly(spark, SF).toPandas()) == rows_of(connect(SF).execute(op.SQL).df())
