import random

import xxhash

from modelsieve.llm import op6_simhash as op
from modelsieve.llm.common import components
from tests.conftest import SF


def slow_fingerprint(text):
    words = text.encode().lower().split()
    shingles = [b" ".join(words[k:k + 4]) for k in range(len(words) - 3)] if len(words) >= 4 else [b" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def groups(fps, limit):
    """Brute force over all pairs: fingerprint -> smallest fingerprint reachable."""
    fps = sorted(set(fps))
    root = {f: f for f in fps}
    for a in fps:
        for b in fps:
            if a < b and bin((a ^ b) & (2**64 - 1)).count("1") <= limit and root[a] != root[b]:
                low, high = sorted((root[a], root[b]))
                root.update({f: low for f, r in root.items() if r == high})
    return root


def similar_pairs(texts, similarity=0.8):
    """All pairs of keys whose five-word shingle sets are that similar, over an index of shingles."""
    sets = {}
    for key, text in texts.items():
        words = (text or "").encode().lower().split()
        sets[key] = {tuple(words[k:k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
    index, both = {}, {}
    for key, own in sets.items():
        for shingle in own or {()}:
            for other in index.setdefault(shingle, []):
                both[other, key] = both.get((other, key), 0) + 1
            index[shingle].append(key)
    return [(a, b) for (a, b), n in both.items() if n >= similarity * (max(1, len(sets[a])) + max(1, len(sets[b])) - n)]


def test_similar_texts_meet_and_others_stay(spark):
    """Families of edited copies, and a passage that all texts hold: each pair from 0.8 on in one group, unlike texts apart."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 8)))
    licence = " ".join(word() for _ in range(60))
    texts = {}
    for family in range(25):
        base = [word() for _ in range(rng.choice([40, 120, 400]))]
        for copy in range(rng.choice([1, 2, 6])):
            own = list(base)
            for _ in range(rng.choice([0, 1, len(base) // 60, len(base) // 25])):
                own[rng.randrange(len(own))] = word()
            texts[1000 * family + copy] = " ".join(own) + " " + licence
    rows = [(k, t, "x", 0) for k, t in texts.items()] + [(None, "", "x", 0), (None, None, "x", 0)]
    kept = op.one_of_each_similar(spark.createDataFrame(rows, "doc_id long, text string, _id string, fp int").repartition(5))
    got = [r["doc_id"] for r in kept.collect()]
    assert got.count(None) == 1 and kept.columns == ["doc_id", "text", "_id", "fp"]
    pairs = similar_pairs(texts)
    root = {k: k for k in texts}
    for a, b in pairs:
        low, high = sorted((root[a], root[b]))
        root.update({k: low for k, r in root.items() if r == high})
    want = set(root.values())
    assert len(pairs) > 60 and want <= set(got) and len(set(got) - want - {None}) <= 0.1 * (len(texts) - len(want))


def test_fingerprint_equals_plain_form(spark):
    for (text,) in spark.read.parquet(f"{SF}/documents.parquet").select("text").limit(40).collect():
        assert op.fingerprint(text) & (2**64 - 1) == slow_fingerprint(text)
    assert op.fingerprint("") == 0 and op.fingerprint(" \n\t") == 0
    assert op.fingerprint("one two") & (2**64 - 1) == xxhash.xxh64_intdigest(b"one two", 42)


def test_links_equal_brute_force_in_every_way_of_meeting(spark):
    rng = random.Random(3)
    fps = []
    for _ in range(40):
        base = rng.getrandbits(64)
        for _ in range(rng.choice([1, 2, 5, 12])):
            x = base
            for _ in range(rng.randrange(7)):
                x ^= 1 << rng.randrange(64)
            fps.append(x - (1 << 64) if x >> 63 else x)
    fps += [0, 1, 3, -1, -2, -(1 << 63)]
    table = spark.createDataFrame([(f,) for f in fps], "fp long")
    for limit in (0, 2, 4):
        want = groups(fps, limit)
        for size in (4096, 8, 2):
            found = {r["node"]: r["component"] for r in components(op.links(table, limit, size)).collect()}
            assert {f: found.get(f, f) for f in want} == want, (limit, size)


def test_dense_group_takes_the_search_path(spark):
    base = 0x5A5A5A5A12345678
    fps = [base ^ (1 << a) ^ (1 << b) for a in range(20) for b in range(30, 40)]
    table = spark.createDataFrame([(f,) for f in fps], "fp long")
    found = components(op.links(table)).collect()
    assert {r["component"] for r in found} == {min(fps)} and len({r["node"] for r in found}) == len(set(fps))


def test_whole_table_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r["doc_id"]: slow_fingerprint(r["text"] or "") for r in docs.select("doc_id", "text").collect()}
    root = groups(texts.values(), 4)
    least = {}
    for doc, fp in texts.items():
        least[root[fp]] = min(doc, least.get(root[fp], doc))
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in op.op6_simhash_pigeonring(spark, SF).collect()}
    assert got == {d: (f"{fp:016x}", least[root[fp]]) for d, fp in texts.items()}


def test_odd_rows(odd_documents, no_documents):
    rows = op.near_duplicates(odd_documents).collect()
    assert len(rows) == odd_documents.count()
    by_id = {r["doc_id"]: r for r in rows if r["doc_id"] is not None}
    assert by_id[2]["component_id"] == 1
    assert by_id[3]["fingerprint"] == "0" * 16 and by_id[3]["component_id"] == by_id[4]["component_id"] == by_id[6]["component_id"] == 3
    kept = op.one_of_each(odd_documents)
    assert kept.columns == odd_documents.columns
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == [-7, 1, 3, 5]
    assert op.near_duplicates(no_documents).count() == 0 and op.one_of_each(no_documents).count() == 0
    alike = op.one_of_each_similar(odd_documents)
    assert alike.columns == odd_documents.columns and op.one_of_each_similar(no_documents).count() == 0
    assert sorted(r["doc_id"] for r in alike.collect() if r["doc_id"] is not None) == [-7, 1, 3, 5]


def test_survivors_are_chosen_by_row(spark):
    rng = random.Random(5)
    one, two, three, four = (" ".join(str(rng.random()) for _ in range(60)) for _ in range(4))
    rows = [(1, one, "a"), (5, one, "b"), (5, two, "c"), (5, three, "d"), (5, three, "d"), (None, one, "e"), (None, four, "f"),
            (None, four, "f"), (None, three, "g")]
    kept = op.one_of_each(spark.createDataFrame(rows, "doc_id long, text string, note string")).collect()
    assert sorted(r["note"] for r in kept) == ["a", "c", "d", "f"]
