import hashlib
import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from modelsieve.llm import op7_secrets as op
from tests.conftest import SF

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def plain(text):
    out = []
    # re.I also folds two non-ASCII letters; the rule means ASCII letters only
    safe = text.replace("ſ", "é").replace("K", "é")
    out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(safe) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"-----BEGIN [A-Z ]*PRIVATE KEY-----", text)]
    return sorted(out)


PIECES = ["password", "PASSWD", "secret", "Token", "api_key", "apikey", '"', "'", " ", "  ", ":", "=", "x", "abc", "12345678",
          "AKIA", "ABCDEFGH", "0123456789abcdef", "deadbeef", "é", "中", "ſecret", "\n", "-", ".", "-----BEGIN RSA PRIVATE KEY-----"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=30).map("".join))
def test_spans_equal_regular_expressions(text):
    assert [s for s in op.scanner().spans([text])[0] if s[1] < 4] == plain(text)


def test_long_mixed_text():
    rng = random.Random(5)
    text = "".join(rng.choice(PIECES) for _ in range(60_000))
    assert [s for s in op.scanner().spans([text])[0] if s[1] < 4] == plain(text)


def test_used_up_characters_are_not_searched_again():
    assert op.scanner().spans(["token=secret: abcdefghij"]) == [[]]
    assert op.scanner().spans(["token==abcdefg"]) == [[(0, 0, 14)]]
    assert [k for _, k, _ in op.scanner().spans(["eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxMjM0In0.abc-DEF_123"])[0]] == [4]


def test_batches_equal_single_texts():
    rng = random.Random(6)
    texts = ["".join(rng.choice(PIECES) for _ in range(rng.randrange(200))) for _ in range(300)] + ["", "\n", "a" * 70_000]
    assert [[s for s in row if s[1] < 4] for row in op.scanner().spans(texts)] == [plain(t) for t in texts]


def test_automaton_is_small_and_minimal():
    table = op.scanner().combined.table
    rows = {table[k:k + 256] for k in range(0, len(table), 256)}
    assert len(table) // 256 < 4000 and len(rows) > 100


def test_whole_table(spark, SF=SF.replace("0.001", "0.01")):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = op.op7_secret_automaton(spark, SF).collect()
    assert len(rows) == len(texts) and sum(r["n_assign"] + r["n_access"] for r in rows) > 0
    for r in rows:
        want = [s for s in plain(texts[r["doc_id"]]) if s[1] < 3]
        joined = ",".join(f"{op.BASE[k]}:{a}:{b}" for a, k, b in want)
        assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(k == x for _, k, _ in want) for x in range(3)]


def test_odd_rows_and_redaction(odd_documents, no_documents):
    rows = op.scan(odd_documents).collect()
    assert len(rows) == odd_documents.count()
    assert {r["doc_id"]: len(r["found"]) for r in rows}[-7] == 2
    clean = op.redact(odd_documents)
    assert clean.schema == odd_documents.schema and clean.count() == odd_documents.count()
    got = {r["doc_id"]: r for r in clean.collect()}
    assert got[-7]["text"] == "[SECRET] é中 [SECRET]" and got[-7]["n_chars"] == 20
    assert got[3]["text"] is None and got[1]["n_chars"] == 13
    assert op.scan(no_documents).count() == 0 and op.redact(no_documents).count() == 0
