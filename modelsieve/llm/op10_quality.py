"""Quality classifier with hierarchical empirical Bayes.

A logistic model over text statistics and telling words gives each document its evidence, a log
likelihood ratio. Sites add what is known about their other documents: a host (``source``) is shrunk
toward the global rate, a path (``source`` and ``lang``) toward its host, each by a prior strength found from the
spread between groups (method of moments). Sparse sites thus lean on their elders, large ones on their
own record. The posterior of a document is its evidence on top of its path's rate without itself.

A document is acceptable if its label says good quality and not toxic. The model is fitted on at most
``SAMPLE`` labelled documents, the smallest by hash of their id, with at most ``WORDS`` words; all
else (scores, site sums, spreads) covers every document. Site sums are grouped aggregations that combine
before the shuffle.
"""

from __future__ import annotations

import sys
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from modelsieve.llm import op8_outliers
from modelsieve.llm.common import slices, stored
from modelsieve.llm.op8_outliers import COUNTS, rows_of, text_counts, text_mark

cloudpickle.register_pickle_by_value(sys.modules[__name__])
cloudpickle.register_pickle_by_value(op8_outliers)

SAMPLE = 8192
WORDS = 192
KEEP = 0.4               # least posterior probability of a kept document
LEAST_SEEN = 8           # documents of the sample that must hold a word
TRIMMED = ".,;:!?\"'()[]{}*#$%&|<>-"
#: A text of few words tells little: shares are taken as if this many words more had been unremarkable.
EXTRA_WORDS = 12


@dataclass(frozen=True)
class Model:
    words: tuple[str, ...]
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray     # statistics first, then words, then the constant
    rate: float             # of acceptable documents in the sample


def statistics(counts: np.ndarray) -> np.ndarray:
    """Columns for the linear model from rows of counts."""
    c = dict(zip(COUNTS, counts.T.astype(float)))
    chars = np.maximum(c["word_chars"], 1) + 5 * EXTRA_WORDS
    words = c["n_words"] + EXTRA_WORDS

    def share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
        return np.arcsin(np.sqrt(np.minimum(1, part / whole)))

    return np.column_stack([
        np.log((c["word_chars"] + 6 * EXTRA_WORDS) / words), share(c["n_symbols"], chars), share(c["n_capitals"], chars),
        share(c["n_marks"], chars), share(c["n_repeat_words"], words), share(c["n_dup_lines"], c["n_lines"] + 4),
        (c["n_words"] == 0).astype(float)])


def word_sets(texts: pa.Array) -> tuple[pa.Array, list[np.ndarray]]:
    """Folded words of a batch, and for each text the numbers of its distinct words."""
    lists = pc.ascii_split_whitespace(texts)
    coded = lists.flatten().dictionary_encode()
    folded = pc.utf8_trim(pc.utf8_lower(coded.dictionary), characters=TRIMMED).dictionary_encode()
    codes = folded.indices.to_numpy()[coded.indices.to_numpy()] if len(coded) else np.empty(0, np.int64)
    bounds = (lists.offsets.to_numpy() - lists.offsets[0].as_py()).tolist()
    return folded.dictionary, [codes[a:b] for a, b in zip(bounds, bounds[1:])]


def presence(texts: pa.Array, words: tuple[str, ...]) -> np.ndarray:
    """Which of ``words`` each text holds."""
    known, sets = word_sets(texts)
    place = pc.fill_null(pc.index_in(known, value_set=pa.array(words, pa.string())), -1).to_numpy(zero_copy_only=False)
    out = np.zeros((len(texts), len(words)))
    for row, codes in enumerate(sets):
        found = place[codes] if len(codes) else place[:0]
        out[row, found[found >= 0]] = 1
    return out


def _fit(x: np.ndarray, y: np.ndarray, penalty: float = 1.0, steps: int = 12) -> np.ndarray:
    """Logistic regression by Newton steps; the constant, the last column, is not penalised."""
    w = np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], penalty)
    ridge[-1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (y - p) - ridge * w
        curve = (x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge)
        move = np.linalg.solve(curve, slope)
        w += move
        if np.abs(move).max() < 1e-6:
            break
    return w


def acceptable(labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, good) where both labels are known; a document with several labels takes the worst."""
    good = (F.col("quality") == 1) & (F.col("toxic") == 0)
    return (labels.filter(F.col(key).isNotNull() & F.col("quality").isNotNull() & F.col("toxic").isNotNull())
            .groupBy(F.col(key).alias("_key")).agg(F.min(good.cast("double")).alias("good")))


def fit(documents: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text",
        sample: int = SAMPLE) -> Model | None:
    """The model, or None if the sample lacks one of the two classes."""
    known = acceptable(labels, key)
    ids = known.orderBy(F.xxhash64("_key"), "_key").limit(sample)
    # At most ``sample`` rows of two numbers.
    rows = documents.select(F.col(key).alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    # One text of each sampled key, that of the smallest hash, so that rows which share a key count once; combines before the shuffle.
    rows = (rows.join(F.broadcast(ids), "_key").groupBy("_key", "good")
            .agg(F.min_by("_text", F.xxhash64("_text")).alias("_text")))
    rows = stored(rows.select("_text", "good"), "sample")
    rate = rows.agg(F.avg("good"), F.count("*")).first()
    if not rate[1] or not 0 < rate[0] < 1:
        return None

    def distinct(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 0):
            known_words, sets = word_sets(batch.column(0))
            good = batch.column(1).to_numpy()
            for codes, y in zip(sets, good):
                words = known_words.take(pa.array(np.unique(codes)))
                yield pa.RecordBatch.from_arrays([words, pa.array(np.full(len(words), y))], names=["word", "good"])

    n, p = F.col("n"), F.lit(rate[0])
    counts = (rows.mapInArrow(distinct, "word string, good double").filter("word <> ''")
              .groupBy("word").agg(F.count("*").cast("double").alias("n"), F.sum("good").alias("k")).filter(n >= LEAST_SEEN))
    score = (F.col("k") - n * p) * (F.col("k") - n * p) / (n * p * (1 - p))
    # Beyond chance even among very many words.
    telling = counts.withColumn("score", score).filter("score > 25").orderBy(F.desc("score"), "word").limit(WORDS)
    words = tuple(sorted(r["word"] for r in telling.select("word").collect()))

    def design(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 0):
            x = np.column_stack([statistics(text_counts(batch.column(0))), presence(batch.column(0), words)])
            yield pa.RecordBatch.from_arrays([pa.array(x.tolist(), pa.list_(pa.float64())), batch.column(1)], names=["x", "good"])

    # At most ``sample`` rows of WORDS + 7 numbers.
    table = rows.mapInArrow(design, "x array<double>, good double").toArrow()
    x = np.array(table["x"].to_pylist())
    y = table["good"].to_numpy()
    x, y = _ordered(x, y)
    wide = x.shape[1] - len(words)
    mean, scale = np.zeros(x.shape[1]), np.ones(x.shape[1])
    mean[:wide], scale[:wide] = x[:, :wide].mean(0), np.maximum(x[:, :wide].std(0), 1e-3)
    weights = _fit(np.column_stack([(x - mean) / scale, np.ones(len(x))]), y)
    return Model(words, mean, scale, weights, float(rate[0]))


def _ordered(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows in an order of their own, so that sums do not depend on how tasks finish."""
    order = np.lexsort([*x.T, y])
    return x[order], y[order]


def evidence(documents: DataFrame, model: Model | None, carried: list[str], text: str) -> DataFrame:
    """``carried`` and ``evidence``: the log likelihood ratio of acceptable to not, by the text alone."""
    narrow = documents.select(*carried, F.coalesce(F.col(text), F.lit("")).alias("_text"))
    if model is None:
        return narrow.drop("_text").withColumn("evidence", F.lit(0.0))
    base = float(np.log(model.rate / (1 - model.rate)))

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, len(carried)):
            texts = batch.column(len(carried))
            x = np.column_stack([statistics(text_counts(texts)), presence(texts, model.words)])
            logit = ((x - model.mean) / model.scale) @ model.weights[:-1] + model.weights[-1] - base
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in range(len(carried))], pa.array(logit)],
                                             names=[*carried, "evidence"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in narrow.schema if f.name != "_text")
    return narrow.mapInArrow(work, f"{fields}, evidence double")


def _logit(p: Column) -> Column:
    safe = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(safe / (1 - safe))


def _strength(rate: float, spread: float, groups: int, rows: float) -> float:
    """Prior strength in documents from the weighted variance between group rates."""
    within = rate * (1 - rate)
    between = max(spread - within * groups / rows, within * 1e-6, 1e-12)
    return min(max(within / between - 1, 1.0), 1e6)


def judged(documents: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source",
           path: str = "lang", sample: int = SAMPLE) -> DataFrame:
    """(key, evidence, host_rate, path_rate, probability, kept) of every row.

    Null hosts and paths are groups of their own. Null and empty texts are judged by having no words. Without usable labels all
    evidence is zero and every row is kept. Repeated rows each come back and count as often as they occur.
    """
    return (_verdicts(documents, labels, key, text, host, path, sample)
            .select(F.col("_key").alias(key), "evidence", "host_rate", "path_rate", "probability", "kept"))


def _verdicts(documents: DataFrame, labels: DataFrame, key: str, text: str, host: str, path: str, sample: int) -> DataFrame:
    """(_key, _host, _path, _mark, evidence, host_rate, path_rate, probability, kept) of every row."""
    model = fit(documents, labels, key, text, sample)
    named = documents.select(F.col(key).alias("_key"), F.col(text).alias("_text"), F.col(host).cast("string").alias("_host"),
                             F.col(path).cast("string").alias("_path"), text_mark(F.col(text)).alias("_mark"))
    known = acceptable(labels, key).withColumnRenamed("_key", "_labelled")
    rows = evidence(named, model, ["_key", "_host", "_path", "_mark"], "_text")
    rows = rows.join(known, rows["_key"] == known["_labelled"], "left").drop("_labelled")
    prior = float(np.log(model.rate / (1 - model.rate))) if model else 30.0
    chance = 1 / (1 + F.exp(-(F.col("evidence") + F.lit(prior))))
    rows = stored(rows.withColumn("_seen", F.coalesce("good", chance)).drop("good"), "evidence")

    paths = rows.groupBy("_host", "_path").agg(F.count("*").alias("n"), F.sum("_seen").alias("k"))
    hosts = paths.groupBy("_host").agg(F.sum("n").alias("hn"), F.sum("k").alias("hk"))
    total = hosts.agg(F.sum("hn").alias("n"), F.sum("hk").alias("k"), F.count("*").alias("groups"),
                      F.sum(F.col("hk") * F.col("hk") / F.col("hn")).alias("squares")).first()
    count = float(total["n"] or 1)
    rate = min(max(float(total["k"] or 0) / count, 1e-6), 1 - 1e-6)
    strong = _strength(rate, float(total["squares"] or 0) / count - rate * rate, total["groups"], count)
    host_rate = (F.col("hk") + strong * rate) / (F.col("hn") + strong)
    hosts = hosts.withColumn("host_rate", host_rate)
    own = paths.join(hosts.withColumnRenamed("_host", "_h"), F.col("_host").eqNullSafe(F.col("_h"))).drop("_h")
    gap = F.col("k") / F.col("n") - F.col("hk") / F.col("hn")
    inner = own.agg(F.sum(F.col("n") * gap * gap).alias("spread"), F.count("*").alias("groups")).first()
    firm = _strength(rate, float(inner["spread"] or 0) / count, inner["groups"], count)
    own = own.select(F.col("_host").alias("_h"), F.col("_path").alias("_p"), "n", "k", "host_rate")
    met = rows.join(own, rows["_host"].eqNullSafe(own["_h"]) & rows["_path"].eqNullSafe(own["_p"]))
    path_rate = (F.col("k") - F.col("_seen") + firm * F.col("host_rate")) / (F.col("n") - 1 + firm)
    met = met.withColumn("path_rate", path_rate)
    probability = 1 / (1 + F.exp(-(F.col("evidence") + _logit(F.col("path_rate")))))
    met = met.withColumn("probability", probability)
    return met.select("_key", "_host", "_path", "_mark", "evidence", "host_rate", "path_rate", "probability",
                      (F.col("probability") >= KEEP).alias("kept"))


def keep_good(documents: DataFrame, labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """The rows of ``documents`` that are kept, all columns as they are. Each row stands by its own result."""
    found = _verdicts(documents, labels, key, "text", "source", "lang", SAMPLE)
    good = found.filter("kept").withColumnsRenamed({"_host": "_source", "_path": "_lang"})
    return rows_of(documents, good, key, "text", "lang", "source")


def op10_quality_bayes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
