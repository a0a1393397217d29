import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from modelsieve.llm import op12_whitening as op
from tests.conftest import SF

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows, components=4):
    """{row number: (n, deviation, |whitened| per component, explained per component)} by a full eigendecomposition."""
    sound = [(k, [math.floor(256 * c) for c in v]) for k, v in enumerate(rows) if v and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted(set(tuple(x) for _, x in sound))
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    centred = np.array(fit, float) - np.array(sums, float) / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    out = {}
    for k, x in sound:
        white = (np.array(x, float) - np.array(sums, float) / n) @ vectors / np.sqrt(values)
        out[k] = (n, sum((n * c - s) ** 2 for c, s in zip(x, sums)), np.abs(white), values / (centred**2).sum() * n)
    return out


def test_whole_table_equals_full_decomposition(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = table.collect()
    want = plain([r["embedding"] for r in rows])
    got = op.op12_jacobi_davidson_whitening(spark, SF).toPandas()
    assert len(got) == 4 * len(want) and (got.identity_error <= 1e-10).all() and got.residual.max() <= 1e-12 * 1e4
    at = {r["vec_id"]: k for k, r in enumerate(rows)}
    signs = {}
    for vec, component, n, deviation, white, explained in got[["vec_id", "component", "n", "deviation", "whitened", "explained"]].itertuples(index=False):
        w = want[at[vec]]
        assert (n, deviation) == w[:2]
        assert abs(abs(white) - w[2][component - 1]) < 1e-8 and abs(explained / w[3][component - 1] - 1) < 1e-10
        signs.setdefault(component, []).append(white)
    for values in signs.values():
        assert abs(np.mean(values)) < 0.2


def test_odd_vectors(spark):
    rng = np.random.default_rng(5)
    nan, inf = float("nan"), float("inf")
    good = [[float(c) for c in v] for v in rng.normal(size=(30, 6)).astype(np.float32)]
    good[3] = [-0.0, 0.0, 1.0, -1.0, 0.001, -0.001]
    rows = [(k, v, 0) for k, v in enumerate(good)]
    rows += [(5, good[5], 1), (5, good[5], 1), (None, good[6], None), (40, None, 1), (41, [], 1), (42, [1.0, None] * 3, 1), (43, [nan] * 6, 1),
             (44, [1.0, inf, 0.0, 0.0, 0.0, 0.0], 1), (45, [1.0, 2.0], 1), (46, [0.0] * 6, 1)]
    table = spark.createDataFrame(rows, SCHEMA).withColumn("x", F.lit("clash")).withColumn("component", F.lit(9)).repartition(4)
    got = op.whiten(table).collect()
    kept = good + [good[5], good[5], good[6], [0.0] * 6]
    want = plain(kept)
    assert len(got) == 4 * len(kept) and sum(r["vec_id"] == 5 for r in got) == 12 and sum(r["vec_id"] is None for r in got) == 4
    assert not {r["vec_id"] for r in got} & {40, 41, 42, 43, 44, 45}
    for r in got:
        if r["vec_id"] is not None and r["vec_id"] < 30:
            w = want[r["vec_id"]]
            assert (r["n"], r["deviation"]) == w[:2] and abs(abs(r["whitened"]) - w[2][r["component"] - 1]) < 1e-9


def test_little_variance_and_empty(spark):
    assert op.whiten(spark.createDataFrame([], SCHEMA)).collect() == []
    assert op.whiten(spark.createDataFrame([(1, [1.0, 2.0], 0), (2, [1.0, 2.0], 0)], SCHEMA)).collect() == []
    line = op.whiten(spark.createDataFrame([(k, [float(k), 2.0 * k, 3.0], 0) for k in range(5)], SCHEMA)).collect()
    assert {r["component"] for r in line} == {1} and all(abs(r["explained"] - 1) < 1e-12 for r in line)
    assert sorted(abs(round(r["whitened"], 9)) for r in line) == sorted(abs(round((k - 2) / math.sqrt(2), 9)) for k in range(5))
    huge = op.whiten(spark.createDataFrame([(1, [1e16, 0.0], 0), (2, [-1e16, 1.0], 0), (3, [0.0, 0.0], 0)], SCHEMA)).collect()
    assert {r["deviation"] for r in huge if r["vec_id"] == 1} == {None} and all(math.isfinite(r["whitened"]) for r in huge)


@pytest.mark.parametrize("values", [np.linspace(1, 2, 90), np.r_[np.full(6, 7.0), np.linspace(0, 6.9, 194)], np.r_[10.0 ** -np.arange(12), np.zeros(120)]])
def test_solver_on_close_repeated_and_missing_values(values):
    rng = np.random.default_rng(2)
    turn = np.linalg.qr(rng.normal(size=(len(values), len(values))))[0]
    matrix = (turn * values) @ turn.T
    matrix = (matrix + matrix.T) / 2
    found, vectors = op.jacobi_davidson(lambda v: matrix @ v, len(values), 4)
    assert np.abs(found - np.sort(values)[::-1][:4]).max() < 1e-12 * values.max()
    assert np.linalg.norm(matrix @ vectors - vectors * found, axis=0).max() < 1e-12 * values.max()
    assert np.abs(vectors.T @ vectors - np.eye(4)).max() < 1e-12


def test_minres_solves_columns_alike():
    rng = np.random.default_rng(3)
    half = rng.normal(size=(30, 30))
    matrix, right = half + half.T, rng.normal(size=(30, 3))
    right[:, 1] = 0
    assert np.abs(matrix @ op.minres(lambda v: matrix @ v, right, 200, 1e-13) - right).max() < 1e-8
