import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from modelsieve.llm import op9_packing as op
from tests.conftest import SF


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(op.default_tokenizer())


def test_chunks_encode_like_whole_texts(tokenizer):
    rng = random.Random(1)
    parts = ["Hello", "it's", " ", "\n", "\t\x0b\x0c ", "É", "é", "́x", "中文", "12", "<|endoftext|>", "!!", "ΑΣ", "  ", "İ", ""]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(30))) for _ in range(300)]
    got = [x.tolist() for x in op.ChunkEncoder(op.default_tokenizer()).encode(pa.array(texts))]
    for text, ids in zip(texts, got, strict=True):
        assert ids == tokenizer.encode(text, add_special_tokens=False).ids, text


def test_plan_covers_demand_exactly_and_is_near_the_bound():
    rng = np.random.default_rng(2)
    for demand in ({}, {5: 3}, {512: 4}, Counter(rng.integers(1, 513, 40).tolist()),
                   Counter(np.minimum(512, rng.lognormal(4, 1, 50_000).astype(int) + 1).tolist())):
        chosen = op.plan(dict(demand))
        covered = Counter()
        for pattern, times in chosen:
            assert sum(c * n for c, n in pattern) <= 512
            for c, n in pattern:
                covered[c] += n * times
        assert covered == Counter(demand)
        bound = sum(c * n for c, n in demand.items()) / 512
        assert sum(t for _, t in chosen) <= bound * 1.01 + 8


def check(rows, tokens):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    for doc, ids in tokens.items():
        at = 0
        for r in sorted(by_doc[doc], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            piece = np.array(ids[at:at + r["length"]], "<u4")
            assert r["ids_crc32"] == zlib.crc32(piece.tobytes())
            at += r["length"]
        assert at == len(ids)
    for parts in by_sequence.values():
        at = 0
        for r in sorted(parts, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= op.LENGTH
        assert {r["padded_length"] for r in parts} == {at if at & (at - 1) == 0 else op.LENGTH}
    return by_sequence


def test_whole_table(spark, tokenizer):
    sf = SF.replace("0.001", "0.01")
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    tokens = {d: [*tokenizer.encode(t, add_special_tokens=False).ids, 2] for d, t in texts.items()}
    rows = op.op9_packing_cutting_stock(spark, sf).collect()
    sequences = check(rows, tokens)
    used = sum(map(len, tokens.values()))
    assert used / (len(sequences) * op.LENGTH) > 0.98


def test_odd_rows(odd_documents, no_documents):
    rows = op.packed(odd_documents).collect()
    assert Counter(r["doc_id"] for r in rows if r["start"] == 0) == Counter(r["doc_id"] for r in odd_documents.collect())
    assert {r["doc_id"]: r["doc_tokens"] for r in rows}[3] == 1
    assert op.packed(no_documents).count() == 0
