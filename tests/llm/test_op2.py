import os
import random
import subprocess
import sys

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from modelsieve.llm import op2_sentencepiece as op
from tests.conftest import SF


@pytest.fixture(scope="module")
def lattice():
    return op.Lattice(op.default_model())


LATTICE = op.Lattice(op.default_model())


def all_paths(lattice, text):
    """Every segmentation of a short text by plain recursion: (score, ids)."""
    if not text:
        return [(0.0, ())]
    out = []
    for n in range(1, len(text) + 1):
        part = text[:n]
        if part in lattice.pieces:
            first = ((lattice.pieces[part][0],), lattice.pieces[part][1])
        elif n == 1:
            raw = (op.MARK if part == op.STAND_IN else part).encode()
            first = (tuple(lattice.byte_ids[b] for b in raw), lattice.unknown)
        else:
            continue
        out += [(first[1] + s, first[0] + ids) for s, ids in all_paths(lattice, text[n:])]
    return out


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["the", "in", " ", "  ", "a", "é", "ing", ".", "\n", "中", op.MARK, "x", "😀", "tion"]), max_size=5).map("".join))
def test_n_best_equal_all_paths(text):
    marked = op.MARK + text.replace(op.MARK, op.STAND_IN).replace(" ", op.MARK)
    if len(marked) > 13:
        return
    paths = sorted(all_paths(LATTICE, marked), reverse=True)
    scores = [s for s, _ in paths]
    for n in (1, 2, 5):
        whole = LATTICE.n_best(marked, n)
        assert [s for s, _ in whole] == scores[:n] and len({i for _, i in whole}) == len(whole)
        (ids, score, chained), = LATTICE.encode_all([text], n)
        assert [s for s, _ in chained] == scores[:n] and score == scores[0]
        known = set(paths)
        for s, i in chained:
            assert (s, tuple(np.frombuffer(i, "<u4").tolist())) in known
        assert len({i for _, i in chained}) == len(chained) and chained[0][1] == ids.tobytes()
        assert LATTICE.decode(ids).decode() == text


def test_batches_equal_single_texts_and_whole_lattice(lattice, spark):
    texts = [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").limit(12).collect()]
    together = list(lattice.encode_all(texts, 4))
    for text, (ids, score, best) in zip(texts, together):
        (one, s, b), = lattice.encode_all([text], 4)
        assert ids.tolist() == one.tolist() and score == s and best == b
        short = text[:400]
        marked = op.MARK + short.replace(" ", op.MARK)
        (_, _, chained), = lattice.encode_all([short], 4)
        assert [s for s, _ in chained] == [s for s, _ in lattice.n_best(marked, 4)]


def test_searching_many_segments_together_equals_one_by_one(spark):
    lattice = op.Lattice(op.default_model())
    texts = [r["text"].replace(" ", op.MARK) for r in spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect()]
    names = lattice.segments(texts)[0].dictionary.to_pylist()
    lattice.learn(names)
    assert len(names) > 2_000
    for name in names:
        assert lattice.known[name] == lattice.segment(name), name


def test_whole_table(spark):
    rows = op.op2_sentencepiece_n_best(spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    for r in rows:
        scores = [b["score"] for b in r["n_best"]]
        assert r["decoded"] and scores == sorted(scores, reverse=True) and scores[0] == r["score"]
        assert r["n_best"][0]["ids_crc32"] == r["ids_crc32"] and len({b["ids_crc32"] for b in r["n_best"]}) == len(scores)


def test_odd_rows(spark, odd_documents, no_documents):
    encoded = op.encode(odd_documents)
    back = op.decode(encoded).collect()
    want = sorted(((r["doc_id"], r["text"] or "") for r in odd_documents.collect()), key=str)
    assert sorted(((r["doc_id"], r["text"]) for r in back), key=str) == want
    assert op.encode(no_documents).count() == 0 and op.decode(op.encode(no_documents)).count() == 0


@pytest.mark.parametrize("text", ["a" * 7, "the" * 3 + "i" * 3, "ininin", "=" * 9])
@pytest.mark.parametrize("n", [3, 12])
def test_ties_give_distinct_paths_of_the_best_scores(lattice, text, n):
    paths = sorted(all_paths(lattice, op.MARK + text), reverse=True)
    found = lattice.n_best(op.MARK + text, n)
    assert [s for s, _ in found] == [s for s, _ in paths[:n]] and len(set(found)) == len(found) and set(found) <= set(paths)
    (ids, _, chained), = lattice.encode_all([text], n)
    assert [s for s, _ in chained] == [s for s, _ in paths[:n]] and chained[0][1] == ids.tobytes()


LONG = """
import base64, random, resource, sys
sys.path.insert(0, {repo!r})
from modelsieve.llm import op2_sentencepiece as op
lattice = op.Lattice(op.default_model())
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
for text in ("a" * {size}, base64.b64encode(random.Random(1).randbytes({size} * 3 // 4)).decode()):
    (ids, score, best), = lattice.encode_all([text], 4)
    assert lattice.decode(ids).decode() == text and len(best) == 4 and best[0][1] == ids.tobytes()
    assert [s for s, _ in best] == sorted((s for s, _ in best), reverse=True)
print("MB", (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) / 1024)
"""


def test_long_unbroken_text_needs_little_memory():
    """A run of one character and a line of base64, 200,000 characters each."""
    repo = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    done = subprocess.run([sys.executable, "-c", LONG.format(repo=repo, size=200_000)], capture_output=True, text=True, timeout=300)
    assert float(done.stdout.split("MB")[1]) < 250, done.stderr


def test_any_characters_survive(lattice):
    rng = random.Random(2)
    texts = ["".join(chr(rng.choice([rng.randrange(0x20, 0x3000), rng.randrange(0xE000, 0x10FFFF), 0x2581, 32, 10])) for _ in range(200)) for _ in range(30)]
    texts += [op.STAND_IN + op.MARK, op.MARK]
    for text, (ids, _, best) in zip(texts, lattice.encode_all(texts, 3)):
        assert all(lattice.decode(np.frombuffer(i, "<u4")).decode() == text for _, i in best)
