"""Whitening of embeddings; leading principal directions by a block Jacobi-Davidson method without a matrix.

The covariance is never formed. Spark multiplies it with a few vectors at a time: a pass over the fitted vectors centres each,
and adds up x (x . v) per task, then by coordinate. The driver holds a search space of at most ``SPACE`` columns of the
vectors' length and, in turns,

* takes the Ritz pairs of the search space (Rayleigh-Ritz), and locks those whose residual is at the level of double precision;
* solves for every other wanted pair (u, t) the correction equation (I - ZZ') (V - t) (I - ZZ') s = -r, Z the locked and current
  vectors, by a few steps of MINRES, all pairs in one pass per step;
* adds the corrections to the search space, which restarts from its best Ritz vectors when it is full.

What comes to the driver is as long as a vector, times the vectors of a block, however many rows there are.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from modelsieve.llm.common import stored

cloudpickle.register_pickle_by_value(sys.modules[__name__])

COMPONENTS = 4
SCALE = 256
SPACE = 64        # columns of the search space
INNER = 4         # MINRES steps per correction
OUTER = 200       # turns after which the best pairs are taken as they are
BLOCK_BYTES = 4 << 20
EPS = float(np.finfo(np.float64).eps)

Product = Callable[[np.ndarray], np.ndarray]


@dataclass
class Whitening:
    n: int
    sums: list[int]
    vectors: np.ndarray       # one column per component
    values: np.ndarray
    trace: float
    residuals: np.ndarray     # lengths of V u - e u, of the pairs as returned
    identity_error: float
    passes: int

    @property
    def mean(self) -> np.ndarray:
        return _mean(self.n, self.sums)


def _mean(n: int, sums: list[int]) -> np.ndarray:
    return np.array([float(Fraction(s, n)) for s in sums])


def grid(embedding: Column, scale: int = SCALE) -> Column:
    """floor(scale * c) of every component as long; null if the vector or a component is null or not finite, or there is none."""
    values = embedding.cast("array<double>")
    sound = F.forall(values, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & (F.size(values) > 0)
    return F.when(sound, F.transform(values, lambda c: F.floor(c * float(scale)).cast("long")))


def gridded(table: DataFrame, key: str, embedding: str, scale: int = SCALE) -> DataFrame:
    """(_key, x) of the rows that take part: sound vectors of the commonest length, the longer one of equally common ones."""
    rows = stored(table.select(F.col(f"`{key}`").cast("long").alias("_key"), grid(F.col(f"`{embedding}`"), scale).alias("x")).filter("x IS NOT NULL"), "grid")
    most = rows.groupBy(F.size("x").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    return rows.filter(F.size("x") == (most["size"] if most else 0))


def _blocks(rows: DataFrame) -> DataFrame:
    """Each distinct vector once, many to a row: (size, data), the components as 64-bit numbers."""
    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            step = max(1, BLOCK_BYTES // (8 * x.shape[1]))
            parts = [x[k:k + step].astype("<i8").tobytes() for k in range(0, len(x), step)]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(parts), x.shape[1])), pa.array(parts, pa.binary())], names=["size", "data"])

    return stored(rows.select("x").distinct().mapInArrow(pack, "size long, data binary"), "vectors")


def _each(batches: Iterable[pa.RecordBatch]) -> Iterator[np.ndarray]:
    for batch in batches:
        for size, data in zip(batch.column(0).to_pylist(), batch.column(1)):
            yield np.frombuffer(data.as_buffer(), "<i8").reshape(-1, size)


def summed(blocks: DataFrame, work: Callable[[np.ndarray], np.ndarray], shape: tuple[int, ...]) -> np.ndarray:
    """Sum of ``work`` over all blocks: added up in tasks, then by place; as many numbers as ``shape`` holds come to the driver."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for x in _each(batches):
            part = work(x)
            total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], names=["place", "value"])

    out = np.zeros(shape).ravel()
    for place, value in blocks.mapInArrow(run, "place long, value double").groupBy("place").agg(F.sum("value")).collect():
        out[place] = value
    return out.reshape(shape)


def _exact_sums(blocks: DataFrame) -> tuple[int, list[int]]:
    """Number of vectors and the sum of every component, in whole numbers."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, None
        for x in _each(batches):
            part = x.sum(axis=0, dtype=object) if np.abs(x.astype(np.float64)).max() * len(x) > 2.0**61 else x.sum(axis=0).astype(object)
            n, total = n + len(x), part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, len(total))), pa.array([str(v) for v in (n, *total)])], names=["place", "value"])

    found = blocks.mapInArrow(run, "place long, value string").groupBy("place").agg(F.sum(F.col("value").cast("decimal(38,0)"))).collect()
    by_place = {place: int(value) for place, value in found}
    return by_place.get(-1, 0), [by_place[k] for k in range(len(by_place) - 1)]


def minres(product: Product, right: np.ndarray, steps: int, relative: float) -> np.ndarray:
    """Approximate solutions of A x = right, column by column, for a symmetric A given by its product with a block."""
    x = np.zeros_like(right)
    v_old, v = np.zeros_like(right), right.copy()
    w_old, w = np.zeros_like(right), np.zeros_like(right)
    gamma = np.linalg.norm(v, axis=0)
    start, eta = gamma.copy(), gamma.copy()
    c_old = c = np.ones(len(gamma))
    s_old = s = np.zeros(len(gamma))
    live = gamma > 0
    for _ in range(steps):
        if not live.any():
            break
        v = v / np.where(live, gamma, 1)
        image = product(v)
        delta = (v * image).sum(axis=0)
        v_next = image - v * delta - v_old * gamma
        gamma_next = np.linalg.norm(v_next, axis=0)
        a0 = c * delta - c_old * s * gamma
        a1 = np.hypot(a0, gamma_next)
        a2 = s * delta + c_old * c * gamma
        a3 = s_old * gamma
        live &= a1 > 0
        safe = np.where(live, a1, 1)
        c_old, c, s_old, s = c, np.where(live, a0 / safe, 1), s, np.where(live, gamma_next / safe, 0)
        w_old, w = w, (v - w_old * a3 - w * a2) / safe
        x = x + np.where(live, c * eta, 0) * w
        eta = np.where(live, -s * eta, 0)
        live &= (np.abs(eta) > relative * start) & (gamma_next > EPS * np.abs(delta))
        v_old, v, gamma = v, np.where(live, v_next, 0), np.where(live, gamma_next, 1)
    return x


def _fresh(new: np.ndarray, *spaces: np.ndarray) -> np.ndarray:
    """An orthonormal basis of what ``new`` adds to spaces that are orthonormal."""
    kept: list[np.ndarray] = []
    for column in new.T:
        length = np.linalg.norm(column)
        if not length > 0 or not np.isfinite(length):
            continue
        column = column / length
        for _ in range(3):
            for space in spaces:
                column = column - space @ (space.T @ column)
            for other in kept:
                column = column - other * (other @ column)
            left = np.linalg.norm(column)
            if left < 1e-8:
                break
            column = column / left
        else:
            kept.append(column)
    return np.array(kept).T if kept else np.empty((len(new), 0))


def jacobi_davidson(product: Product, size: int, wanted: int, space: int = SPACE, inner: int = INNER) -> tuple[np.ndarray, np.ndarray]:
    """(values, vectors) of the ``wanted`` largest eigenvalues of a symmetric operator, falling."""
    rng = np.random.default_rng(12)
    basis = _fresh(rng.normal(size=(size, min(size, 2 * wanted))))
    image = product(basis)
    locked, values = np.empty((size, 0)), []
    for turn in range(OUTER):
        ritz, turned = np.linalg.eigh((basis.T @ image + image.T @ basis) / 2)
        ritz, turned = ritz[::-1], turned[:, ::-1]
        basis, image = basis @ turned, image @ turned
        missing = wanted - len(values)
        u, theta = basis[:, :missing], ritz[:missing]
        residual = image[:, :missing] - u * theta
        lengths = np.linalg.norm(residual, axis=0)
        limit = 4 * EPS * np.sqrt(size) * max(abs(ritz[0]), *map(abs, values), 0.0)
        full = basis.shape[1] + locked.shape[1] >= size or turn == OUTER - 1
        done = missing if full else int(np.argmax(lengths > limit)) if (lengths > limit).any() else missing
        locked, values = np.hstack([locked, u[:, :done]]), [*values, *theta[:done]]
        if len(values) >= wanted:
            break
        basis, image = basis[:, done:], image[:, done:]
        # The pairs next in line are corrected too: they cost no further pass, and hold close values apart.
        u, theta = basis[:, :missing - done + wanted], ritz[done:][:missing - done + wanted]
        residual = image[:, :u.shape[1]] - u * theta
        open_ = np.linalg.norm(residual, axis=0) > limit
        z = np.hstack([locked, u])

        def projected(block: np.ndarray) -> np.ndarray:
            block = block - z @ (z.T @ block)
            block = product(block) - block * theta[open_]
            return block - z @ (z.T @ block)

        right = -(residual[:, open_] - z @ (z.T @ residual[:, open_]))
        more = minres(projected, right, inner, 0.5 ** (turn + 1))
        if basis.shape[1] + more.shape[1] > space:
            keep = max(2 * wanted, space // 3)
            basis, image = basis[:, :keep], image[:, :keep]
        more = _fresh(more, locked, basis)
        if not more.shape[1]:
            more = _fresh(rng.normal(size=(size, 1)), locked, basis)
        basis, image = np.hstack([basis, more]), np.hstack([image, product(more)])
    order = np.argsort(values)[::-1]
    return np.array(values)[order], locked[:, order]


def fit(rows: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """Whitening fitted on each distinct x of ``gridded`` rows once; None without rows. Directions without variance are left out."""
    blocks = _blocks(rows)
    n, sums = _exact_sums(blocks)
    if not n:
        return None
    size, mean, passes = len(sums), _mean(n, sums), 0

    def product(v: np.ndarray) -> np.ndarray:
        nonlocal passes
        passes += 1

        def work(x: np.ndarray) -> np.ndarray:
            centred = x - mean
            return centred.T @ (centred @ v)

        return summed(blocks, work, v.shape) / n

    trace = float(summed(blocks, lambda x: ((x - mean) ** 2).sum(axis=0), (size,)).sum() / n)
    wanted = min(components, size)
    if not trace > 0:
        return Whitening(n, sums, np.empty((size, 0)), np.empty(0), 0.0, np.empty(0), 0.0, passes)
    _, vectors = jacobi_davidson(product, size, wanted)
    # Once more among the locked vectors, with their true images.
    vectors = np.linalg.qr(vectors)[0]
    image = product(vectors)
    values, turned = np.linalg.eigh((vectors.T @ image + image.T @ vectors) / 2)
    order = np.argsort(values)[::-1]
    values, vectors, image = values[order], vectors @ turned[:, order], image @ turned[:, order]
    some = values > 8 * EPS * size * trace
    values, vectors, image = values[some], vectors[:, some], image[:, some]
    residuals = np.linalg.norm(image - vectors * values, axis=0)
    scaled = vectors / np.sqrt(values)
    middle = summed(blocks, lambda x: ((x - mean) @ scaled).sum(axis=0), (len(values),)) / n

    def spread(x: np.ndarray) -> np.ndarray:
        white = (x - mean) @ scaled - middle
        return white.T @ white

    error = np.abs(summed(blocks, spread, (len(values), len(values))) / n - np.eye(len(values)))
    return Whitening(n, sums, vectors, values, trace, residuals, float(error.max(initial=0.0)), passes)


def deviation(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sum over the components of (n x - S)^2, exact; None beyond 64 bits."""
    most = n * float(np.abs(x.astype(np.float64)).max()) + max(abs(s) for s in sums)
    if most * most * len(sums) < 2.0**62:
        return ((n * x - np.array(sums, np.int64)) ** 2).sum(axis=1).tolist()
    made = [sum((n * v - s) ** 2 for v, s in zip(row, sums)) for row in x.tolist()]
    return [v if v < 1 << 63 else None for v in made]


WHITE = "component int, n long, deviation long, whitened double, explained double, identity_error double, residual double"


def whiten(table: DataFrame, key: str = "vec_id", embedding: str = "embedding", components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error, residual): a row per vector and component.

    Vectors that are null, empty, or hold null or non-finite components have no rows, nor have vectors of another length than the
    commonest. Equal vectors count once in the fit and each has its rows; null keys stay null, keys are whole numbers.
    There are as many components as directions with variance, ``components`` at most: one distinct vector alone, or an empty
    table, gives no rows. ``residual`` is the length of V u - e u.
    """
    rows = gridded(table, key, embedding, scale)
    model = fit(rows, components)
    schema = pa.schema([(key, pa.int64()), ("component", pa.int32()), ("n", pa.int64()), ("deviation", pa.int64()), ("whitened", pa.float64()),
                        ("explained", pa.float64()), ("identity_error", pa.float64()), ("residual", pa.float64())])
    ddl = f"`{key}` long, {WHITE}"
    if model is None or not len(model.values):
        return rows.sparkSession.createDataFrame([], ddl)
    mean, scaled, count = model.mean, model.vectors / np.sqrt(model.values), len(model.values)
    n, sums, explained, residuals, error = model.n, model.sums, model.values / model.trace, model.residuals, model.identity_error

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = batch.num_rows
            if not size:
                continue
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(size, -1)
            each = np.repeat(np.arange(size), count)
            columns = [batch.column(0).take(pa.array(each)), pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), size)),
                       pa.array(np.full(len(each), n)), pa.array(deviation(x, n, sums), pa.int64()).take(pa.array(each)),
                       pa.array(((x - mean) @ scaled).ravel()), pa.array(np.tile(explained, size)), pa.array(np.full(len(each), error)),
                       pa.array(np.tile(residuals, size))]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return rows.mapInArrow(run, ddl)


def op12_jacobi_davidson_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
