import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from modelsieve.llm import op9_packing
from modelsieve.llm.common import stored
from tests.conftest import SF
from tests.llm.test_op6 import similar_pairs
from tests.llm.test_op7 import plain
from tests.llm.test_op8 import slow_counts

SF = SF.replace("0.001", "0.01")


@pytest.fixture(scope="module")
def stages(spark):
    """The documents before the first stage and after each but the last."""
    docs = [spark.read.parquet(f"{SF}/documents.parquet")]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs.append(stored(stage(spark, docs[-1], SF), name))
    return docs


def texts(df):
    rows = df.collect()
    assert len({r["doc_id"] for r in rows}) == len(rows)
    return {r["doc_id"]: r["text"] for r in rows}


def test_all_but_the_last_keep_the_columns(stages):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_classifier", "quality_rules", "simhash_near_dedup", "secret_scan", "packing"]
    assert all(s.columns == stages[0].columns for s in stages)


def test_filters_drop_bad_documents_and_keep_clean_ones(spark, stages):
    labels = {r["doc_id"]: (r["quality"], r["toxic"]) for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    before, classified, ruled = (texts(s) for s in stages[:3])
    assert set(ruled) < set(classified) < set(before)
    clean = [d for d in before if labels.get(d) == (1, 0)]
    assert sum(d in classified for d in clean) >= 0.99 * len(clean)
    for d in clean:
        words, _, _, _, repeats = slow_counts(before[d])
        if d in classified and words >= 50 and 2 * repeats <= words:
            assert d in ruled
    bad = [d for d in before if d in labels and labels[d] != (1, 0)]
    assert sum(d in classified for d in bad) < 0.2 * len(bad)


def test_one_document_of_each_group_stays(stages):
    before, after = texts(stages[2]), texts(stages[3])
    pairs = similar_pairs(before)
    assert len(pairs) >= 50
    # Every pair from 0.8 on, by brute force, is in one group, of which the smallest stays.
    root = {d: d for d in before}
    for a, b in pairs:
        low, high = sorted((root[a], root[b]))
        root.update({d: low for d, r in root.items() if r == high})
    least = defaultdict(list)
    for d, r in root.items():
        least[r].append(d)
    assert set(after) == {min(g) for g in least.values()} and len(after) < len(before)


def test_secrets_are_marked(stages):
    before, after = texts(stages[3]), texts(stages[4])
    assert set(before) == set(after)
    for d, text in before.items():
        if not plain(text):
            assert after[d] == text
        else:
            assert "[SECRET]" in after[d] and not plain(after[d])
    assert all(r["n_chars"] == len(r["text"]) for r in stages[4].collect())


def test_packing_holds_every_token_once(spark, stages):
    tokenizer = Tokenizer.from_file(op9_packing.default_tokenizer())
    rows = corpus_pipeline.packing(spark, stages[4], SF).collect()
    by_doc = defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
    for d, text in texts(stages[4]).items():
        ids, at = [*tokenizer.encode(text, add_special_tokens=False).ids, 2], 0
        for r in sorted(by_doc[d], key=lambda r: r["start"]):
            assert r["start"] == at and r["ids_crc32"] == zlib.crc32(np.array(ids[at:at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(ids)


def test_run_equals_its_stages(spark, stages):
    def key(df):
        return sorted(tuple(r) for r in df.select("doc_id", "start", "length", "ids_crc32", "sequence_id", "offset").collect())

    assert key(corpus_pipeline.run(spark, SF)) == key(corpus_pipeline.packing(spark, stages[4], SF))


def test_odd_rows(spark, odd_documents, no_documents):
    for docs in (odd_documents, no_documents):
        now = docs
        for name, stage in corpus_pipeline.STAGES[:-1]:
            now = stored(stage(spark, now, SF), name)
            assert now.columns == docs.columns
        assert corpus_pipeline.packing(spark, now, SF).count() <= docs.count() + 20
