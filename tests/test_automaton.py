"""Many literals at once, and large user catalogues, against plain search."""

import random
import re

import pytest

from modelsieve.functions.automaton import Literals
from modelsieve.functions.matching import Rule, find_matches, whole_content
from modelsieve.plans.dispatch import byte_findings
from modelsieve.operators.signatures import Signature


@pytest.mark.parametrize("alphabet", [b"ab", bytes(range(256))])
def test_found_equals_substring_search(alphabet):
    rng = random.Random(4)
    some = lambda n: bytes(rng.choice(alphabet) for _ in range(n))
    for size in (0, 1, 5, 300, 50_000):
        text = some(size)
        words = list(dict.fromkeys([some(rng.randrange(1, 9)) for _ in range(200)] + [text[k:k + 7] for k in (0, 40, max(0, size - 7))] + [b""]))
        automaton = Literals(words)
        assert automaton.found(text) == [k for k, w in enumerate(words) if w in text]
    assert Literals([]).found(b"abc") == [] and Literals([b"he", b"she", b"hers", b"his"]).found(b"ushers") == [0, 1, 2]


def test_large_catalogue_equals_brute_force(spark):
    rng = random.Random(9)
    name = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(4, 9)))
    rules = [Rule(f"R{k}", rf"{n}\s*\(", n, k % 3 > 0) for k, n in enumerate(name() for _ in range(1500))]
    rules += [Rule("digits", r"\d{6}", None), Rule("last", "zzz", "zzz")]
    rows = []
    for k in range(40):
        parts = [rng.choice([name(), rng.choice(rules[:1500]).anchor + " (", rng.choice(rules[:1500]).anchor.upper() + "(", "123456", "\xff"]) for _ in range(60)]
        rows.append((f"a{k}", bytearray(" ".join(parts).encode("latin-1"))))
    df = spark.createDataFrame(rows, "artifact_id string, content binary")
    got = {(r["artifact_id"], r["rule_id"], r["offset"]) for r in find_matches(whole_content(df.repartition(3)), rules).collect()}
    want = {(i, r.rule_id, m.start()) for i, data in rows for r in rules
            for m in re.finditer(r.regex.encode(), bytes(data), (re.I if r.ignore_case else 0) | re.M)}
    assert got == want and len(want) > 100


def test_order_of_findings_with_very_many_rules(spark):
    vector = "AV:L/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H"
    signatures = [Signature(f"S{k}", "c", f"word{k}x", "low", vector, "d") for k in range(12_000)]
    df = spark.createDataFrame([("a", "x.onnx", bytearray(b"word11999x word3x" + b"\0" * 10))], "artifact_id string, filename string, content binary")
    from pyspark.sql import functions as F
    found = byte_findings(whole_content(df).withColumn("format", F.lit("onnx")), signatures).orderBy("ordinal").collect()
    assert [r["pattern_id"] for r in found] == ["S3", "S11999"] and all(r["ordinal"] < 10 ** 18 for r in found)
