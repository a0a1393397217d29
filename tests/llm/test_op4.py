import numpy as np
import pytest

from modelsieve.llm import op4_epsilon_grid as op
from tests.conftest import SF


def slow(rows, cosine):
    """Brute force over all pairs: key -> (links, component)."""
    ok = {}
    for i, (key, v, label) in enumerate(rows):
        x = np.array([np.nan if y is None else y for y in v or []], float)
        if label is not None and len(x) and np.isfinite(x).all() and x.any():
            ok[i] = x / np.linalg.norm(x)
    root, links = list(range(len(rows))), [0] * len(rows)
    for i in ok:
        for j in ok:
            if i < j and rows[i][2] == rows[j][2] and len(ok[i]) == len(ok[j]) and ok[i] @ ok[j] >= cosine:
                links[i] += 1
                links[j] += 1
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    least = {}
    for i, (key, _, _) in enumerate(rows):
        if key is not None:
            least[root[i]] = min(key, least.get(root[i], key))
    return sorted(((key, links[i], least.get(root[i])) for i, (key, _, _) in enumerate(rows)), key=str)


SCHEMA = "vec_id long, embedding array<float>, label int, kept string, raw int"


@pytest.mark.parametrize("block", [512, 16, 3])
def test_small_fixture(spark, block):
    rng = np.random.default_rng(block)
    rows = []
    for k in range(12):
        centre = rng.normal(size=8)
        for _ in range(rng.integers(1, 14)):
            rows.append((centre + rng.normal(size=8) * 0.25, int(k % 3)))
    rows += [rows[0], rows[0], (rows[1][0], 7)]
    rows = [(k, v.astype(np.float32).tolist(), label) for k, (v, label) in enumerate(rows)]
    rows += [(900, None, 1), (901, [0.0] * 8, 1), (902, [float("nan")] * 8, 1), (903, [None, 1.0], 1), (904, rows[0][1], None),
             (905, [], 1), (None, rows[0][1], rows[0][2]), (906, [1.0, 2.0], 1), (907, [1.0, 2.0], 1), (906, [1.0, 2.0], 1), (908, [float("inf")] * 8, 0),
             (909, [-0.0, 1.0], 1), (910, [0.0, 1.0], 1), (None, None, None), (911, [3e38] * 8, 2), (912, [1e-38] * 8, 2)]
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    got = op.near_duplicates(table, block=block).collect()
    assert sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in got), key=str) == slow(rows, op.COSINE)
    assert all(r["kept"] == (r["vec_id"] is not None and r["vec_id"] == r["component_id"]) for r in got)


def test_whole_table(spark):
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    got = op.op4_epsilon_grid_join(spark, SF).collect()
    assert sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in got), key=str) == slow(rows, op.COSINE)


def test_empty_table(spark):
    assert op.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_spanning_edges_connect_like_all_pairs():
    rng = np.random.default_rng(9)
    for same in (True, False):
        for _ in range(60):
            m = rng.random((9, 9 if same else 7)) < 0.15
            m = (m | m.T) & ~np.eye(9, dtype=bool) if same else m

            def parts(edges):
                root = list(range(9 + 0 if same else 16))
                for r, c in edges:
                    a, b = root[r], root[c if same else 9 + c]
                    root = [min(a, b) if x in (a, b) else x for x in root]
                return root

            assert parts(op._spanning(m, same)) == parts(np.argwhere(m).tolist())
