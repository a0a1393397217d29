"""Quality rules: robust multivariate outliers per language and source.

Every text gives counts; ratios of counts are made comparable by the arcsine square-root transform.
For each (lang, source) the minimum covariance determinant estimate of centre and scatter is found by
concentration steps: the ``SUBSET`` share of rows nearest to a centre gives a new mean and covariance, and so a
determinant that falls until it settles. Three deterministic starts about the coordinate medians (quartile ranges
alone, with correlations of hyperbolic tangents, with correlations of spatial signs) are followed to their ends, and
the least determinant is taken. Rows far from the centre by Mahalanobis distance are rejected.

Quantiles come from counts over fine bins, so they are exact on the binned values, need no sample and do not
depend on the order of rows. Every step is a grouped aggregation with partial sums, and rows meet the models of their
sites by pair and salt: a group that holds a third of all rows, or all of them, costs no more than its share. Sites with fewer than ``LEAST_ROWS`` rows use the estimate of
their language, and languages that small the estimate of all rows.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from modelsieve.llm.common import slices, stored

cloudpickle.register_pickle_by_value(sys.modules[__name__])

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "n_marks")
FEATURES = ("word_length", "symbols", "dup_lines", "repeats", "capitals", "marks")
#: Half of the rows, so that a group of copies may hold up to half of a site without drawing the estimate to itself.
SUBSET = 0.5
#: A determinant falls as long as its logarithm does by this much.
FALL = 1e-3
#: A (language, source) pair meets its models in this many parts.
SALTS = 32
LEAST_ROWS = 200
#: Least standard deviation of each feature: statistics that hardly vary are not read more finely. With a centre near zero
#: repeated lines alone reject beyond 87 % of the lines, repeated words alone just under the base rule's half.
FLOORS = (0.08, 0.035, 0.2, 0.125, 0.04, 0.04)
#: Rows beyond this many (robust) standard deviations are rejected.
CUTOFF = 6.0

SYMBOLS = "#*$%&|<>"
_SPACE = b" \t\n\r\x0b\x0c"
_CAPITALS = bytes(range(65, 91))
_MARKS = bytes(b for b in range(33, 127) if not chr(b).isalnum())


def _repeated_words(codes: np.ndarray, size: int) -> int:
    """Words that lie in three-word windows found twice or more."""
    if len(codes) < 4:
        return 0
    if size >= 1 << 21:  # too many words for one number: number the pairs first
        pairs = np.unique(codes[:-1] * size + codes[1:], return_inverse=True)[1].reshape(-1)
        windows = pairs[:-1] * size + codes[2:]
    else:
        windows = (codes[:-2] * size + codes[1:-1]) * size + codes[2:]
    ordered = np.sort(windows)
    again = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(again):
        return 0
    at = np.minimum(np.searchsorted(again, windows), len(again) - 1)
    found = again[at] == windows
    covered = np.zeros(len(codes), bool)
    for k in range(3):
        covered[k:len(codes) - 2 + k] |= found
    return int(covered.sum())


def text_counts(texts: pa.Array) -> np.ndarray:
    """One row of ``COUNTS`` per text; no text may be null."""
    lists = pc.ascii_split_whitespace(texts)
    words = lists.flatten()
    coded = words.dictionary_encode()
    codes = coded.indices.to_numpy().astype(np.int64)
    filled = (pc.binary_length(coded.dictionary).to_numpy() > 0)  # splitting may give empty strings at the ends
    bounds = (lists.offsets.to_numpy() - lists.offsets[0].as_py()).tolist()
    out = np.zeros((len(texts), len(COUNTS)), np.int64)
    for row, value in enumerate(texts):
        text = value.as_py()
        data = text.encode("utf-8")
        own = codes[bounds[row]:bounds[row + 1]]
        own = own[filled[own]]
        lines = [x for x in text.split("\n") if x.strip(" \t\r\x0b\x0c")]
        out[row] = (len(own), len(text) - (len(data) - len(data.translate(None, _SPACE))), sum(map(text.count, SYMBOLS)),
                    len(lines) - len(set(lines)), _repeated_words(own, len(filled)), len(lines),
                    len(data) - len(data.translate(None, _CAPITALS)), len(data) - len(data.translate(None, _MARKS)))
    return out


def counted(documents: DataFrame, carried: list[str], text: str = "text") -> DataFrame:
    """The columns ``carried`` and the counts of every row; null text counts as empty."""
    narrow = documents.select(*[F.col(c) for c in carried], F.coalesce(F.col(text), F.lit("")).alias("_text"))

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, len(carried)):
            numbers = text_counts(batch.column(len(carried)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(k) for k in range(len(carried))] + [pa.array(c) for c in numbers.T],
                names=[*carried, *COUNTS])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in narrow.schema][:-1]
    return narrow.mapInArrow(work, ", ".join([*fields, *[f"{c} long" for c in COUNTS]]))


def features() -> dict[str, Column]:
    """Transformed statistics of a row with at least one word."""
    def share(count: str, whole: str) -> Column:
        return F.asin(F.sqrt(F.least(F.lit(1.0), F.col(count) / F.greatest(F.col(whole), F.lit(1)))))

    return {"word_length": F.log(F.col("word_chars") / F.col("n_words")), "symbols": share("n_symbols", "word_chars"),
            "dup_lines": share("n_dup_lines", "n_lines"), "repeats": share("n_repeat_words", "n_words"),
            "capitals": share("n_capitals", "word_chars"), "marks": share("n_marks", "word_chars")}


def _chi_square(x: float, half: int) -> float:
    """Distribution function for 2 * half degrees of freedom."""
    return 1 - math.exp(-x / 2) * sum((x / 2) ** k / math.factorial(k) for k in range(half))


def _consistency(share: float, half: int = len(FEATURES) // 2) -> float:
    """Factor that makes the covariance of the nearest ``share`` right for normal data."""
    low, high = 0.0, 1000.0
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if _chi_square(middle, half) < share else (low, middle)
    return share / _chi_square(low, half + 1)


def _bin_quantiles(bins: DataFrame, keys: list[str], width: float, shares: list[float]) -> DataFrame:
    """keys and an array: for each share the middle of the first bin up to which that share of the counts ``_n`` lies."""
    w = Window.partitionBy(*keys)
    bins = (bins.withColumn("_upto", F.sum("_n").over(w.orderBy("_bin")))
            .withColumn("_all", F.sum("_n").over(w)))
    firsts = [((F.min(F.when(F.col("_upto") >= F.col("_all") * s, F.col("_bin"))) + 0.5) * width) for s in shares]
    return bins.groupBy(*keys).agg(F.array(*firsts).alias("_q"))


def _quantiles(rows: DataFrame, keys: list[str], value: Column, width: float, shares: list[float]) -> DataFrame:
    """``_bin_quantiles`` of a value of rows."""
    return _bin_quantiles(rows.groupBy(*keys, F.floor(value / width).alias("_bin")).agg(F.count("*").alias("_n")), keys, width, shares)


def _log_distance(centre: str, precision: str) -> Column:
    """log2(1 + squared Mahalanobis distance) of the features."""
    p = len(FEATURES)
    gap = [F.col(f) - F.col(centre)[k] for k, f in enumerate(FEATURES)]
    terms = [gap[a] * gap[b] * F.col(precision)[a * p + b] * (1 if a == b else 2) for a in range(p) for b in range(a, p)]
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return F.log2(1 + F.greatest(total, F.lit(0.0)))


def _inverse(cov: np.ndarray) -> tuple[np.ndarray, float]:
    """Inverse and log determinant of a scatter matrix, both with a floor on every direction in units of the features' floors."""
    scale = np.outer(FLOORS, FLOORS)
    values, vectors = np.linalg.eigh((cov + cov.T) / 2 / scale)
    values = np.maximum(values, 1.0)
    return (vectors / values) @ vectors.T / scale, float(np.log(values).sum())


def _correlation(cross: np.ndarray) -> np.ndarray:
    """Correlations of a covariance; a feature that does not vary is correlated with none."""
    size = np.sqrt(np.maximum(np.diag(cross), 0))
    firm = size > 1e-6
    found = np.where(np.outer(firm, firm), cross / np.outer(np.where(firm, size, 1), np.where(firm, size, 1)), 0.0)
    np.fill_diagonal(found, 1.0)
    return found


MODEL = "site string, start int, log_det double, centre array<double>, precision array<double>"


def _first_models(groups: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The starts of each site: quartile ranges alone, then with the correlations of hyperbolic tangents and of spatial signs."""
    p = len(FEATURES)
    for frame in groups:
        made = []
        for row in frame.itertuples():
            spread, mean = np.asarray(row.spread, float), np.asarray(row.tangents, float) / row.n
            tangents = np.asarray(row.tangent_products, float).reshape(p, p) / row.n - np.outer(mean, mean)
            signs = np.asarray(row.sign_products, float).reshape(p, p) / row.n
            for start, related in enumerate((np.eye(p), _correlation(tangents), _correlation(signs))):
                inverse, _ = _inverse(np.outer(spread, spread) * related)
                made.append((row.site, start, math.inf, list(row.centre), inverse.reshape(-1).tolist()))
        yield pd.DataFrame(made, columns=["site", "start", "log_det", "centre", "precision"])


def _scatter(groups: Iterable[pd.DataFrame], factor: float) -> Iterator[pd.DataFrame]:
    """Log determinant, centre and precision matrix of each subset from its sums."""
    p = len(FEATURES)
    for frame in groups:
        made = []
        for row in frame.itertuples():
            mean = np.asarray(row.sums, float) / row.n
            cov = np.asarray(row.products, float).reshape(p, p) / row.n - np.outer(mean, mean)
            inverse, log_det = _inverse(cov * factor)
            made.append((row.site, row.start, log_det, mean.tolist(), inverse.reshape(-1).tolist()))
        yield pd.DataFrame(made, columns=["site", "start", "log_det", "centre", "precision"])


def _square(names: list[str]) -> Column:
    """Sums of all products of two columns, row by row of the matrix."""
    return F.array(*[F.sum(F.col(names[min(a, b)]) * F.col(names[max(a, b)])) for a in range(len(names)) for b in range(len(names))])


def _salt(*values: str) -> Column:
    return F.pmod(F.xxhash64(*values), F.lit(SALTS)).cast("int")


def _every_salt() -> Column:
    return F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt")


def _met(rows: DataFrame, owned: DataFrame, models: DataFrame) -> DataFrame:
    """The features of every row beside each entry of ``models`` (site, ...) that one of its sites has.

    A (language, source) pair takes the entries of its sites along, so that rows meet them by pair and salt: neither a
    large source nor the site of all rows is one key of this join.
    """
    wide = F.col("level") > 0  # sites of many pairs
    levels = (owned.withColumn("_salt", F.when(wide, _salt("_pair")).otherwise(0)))
    spread = models.join(owned.select("site", "level").distinct(), "site").withColumn(
        "_salt", F.explode(F.when(wide, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))))).drop("level")
    entries = (levels.join(spread, ["site", "_salt"]).groupBy("_pair")
               .agg(F.collect_list(F.struct(*models.columns)).alias("_m")))  # at most three sites by three starts
    entries = entries.select("_pair", "_m", _every_salt())
    return rows.join(entries, ["_pair", "_salt"]).select(*FEATURES, F.inline("_m"))


def _starts(rows: DataFrame, owned: DataFrame) -> DataFrame:
    """The first models of every site, about its coordinate medians."""
    long = rows.select("_pair", F.posexplode(F.array(*FEATURES)).alias("_k", "_v"))
    # counts over bins add up, so rows are counted by pair before their sites come in
    bins = long.groupBy("_pair", "_k", F.floor(F.col("_v") / 0.002).alias("_bin")).agg(F.count("*").alias("_n"))
    bins = bins.join(owned, "_pair").groupBy("site", "_k", "_bin").agg(F.sum("_n").alias("_n"))
    spread = _bin_quantiles(bins, ["site", "_k"], 0.002, [0.25, 0.5, 0.75])
    floor = F.array(*map(F.lit, FLOORS))[F.col("_k")]
    spread = spread.select("site", F.struct("_k", F.col("_q")[1].alias("_m"),
                                            F.greatest((F.col("_q")[2] - F.col("_q")[0]) / 1.349, floor).alias("_s")).alias("_f"))
    spread = (spread.groupBy("site").agg(F.array_sort(F.collect_list("_f")).alias("_all"))  # one entry a feature
              .select("site", F.transform("_all", lambda x: x["_m"]).alias("centre"), F.transform("_all", lambda x: x["_s"]).alias("spread")))
    spread = stored(spread, "spread")
    z = [f"_z{k}" for k in range(len(FEATURES))]
    t, u = [f"_t{k}" for k in range(len(FEATURES))], [f"_u{k}" for k in range(len(FEATURES))]
    near = _met(rows, owned, spread).withColumns({c: (F.col(f) - F.col("centre")[k]) / F.col("spread")[k] for k, (c, f) in enumerate(zip(z, FEATURES))})
    length = F.sqrt(sum((F.col(c) * F.col(c) for c in z), F.lit(0.0)))
    near = near.withColumn("_len", F.greatest(length, F.lit(1e-12)))
    near = near.withColumns({**{c: F.tanh(v) for c, v in zip(t, z)}, **{c: F.col(v) / F.col("_len") for c, v in zip(u, z)}})
    sums = near.groupBy("site").agg(F.count("*").alias("n"), F.array(*map(F.sum, t)).alias("tangents"),
                                    _square(t).alias("tangent_products"), _square(u).alias("sign_products"))
    return stored(sums.join(spread, "site").mapInPandas(_first_models, MODEL), "starts")


def _concentrated(rows: DataFrame, owned: DataFrame, models: DataFrame) -> DataFrame:
    """One concentration step of each model: mean and covariance of the ``SUBSET`` share of its site's rows nearest to it."""
    keys = ["site", "start"]
    far = _met(rows, owned, models).select(*keys, *FEATURES, _log_distance("centre", "precision").alias("_d"))
    limit = _quantiles(far, keys, F.col("_d"), 1 / 64, [SUBSET]).select(*keys, (F.col("_q")[0] + 1 / 128).alias("_limit"))
    # the models take their limits along, so rows meet both in the one salted join
    near = (_met(rows, owned, models.join(limit, keys)).withColumn("_d", _log_distance("centre", "precision"))
            .filter(F.col("_d") < F.col("_limit")))
    sums = near.groupBy(*keys).agg(F.count("*").alias("n"), F.array(*map(F.sum, FEATURES)).alias("sums"), _square(list(FEATURES)).alias("products"))
    factor = _consistency(SUBSET)
    return stored(sums.mapInPandas(lambda groups: _scatter(groups, factor), MODEL), "scatter")


def estimates(rows: DataFrame, owned: DataFrame) -> DataFrame:
    """(site, log_det, centre, precision): the minimum covariance determinant estimate of every site in ``owned``.

    ``rows`` are (_pair, _salt, features...), ``owned`` (_pair, level, site) names the sites of a pair. Each start takes
    steps until its determinant no longer falls by ``FALL`` in its logarithm; the logarithm has zero as its bound, by the
    floors, so this ends. Starts of a site that come to one determinant go on as one. The least determinant wins.
    """
    keys = ["site", "start"]
    kept = active = _starts(rows, owned)
    while True:
        after = _concentrated(rows, owned, active)
        before = kept.select(*keys, F.col("log_det").alias("_before"))
        fell = after.join(before, keys).filter(F.col("log_det") < F.col("_before") - FALL).drop("_before")
        first = F.min_by(F.struct(*fell.columns), "start").alias("m")
        active = stored(fell.groupBy("site", F.round("log_det", 6)).agg(first).select("m.*"), "active")
        if active.isEmpty():
            break
        kept = stored(kept.join(active, keys, "left_anti").unionByName(active), "kept")
    order = F.struct(F.round("log_det", 6), "start")
    return kept.groupBy("site").agg(F.min_by(F.struct("log_det", "centre", "precision"), order).alias("m")).select("site", "m.*")


def _site(*parts: Column) -> Column:
    """Null-safe text key."""
    return F.to_json(F.array(*parts), {"ignoreNullFields": "false"})


def _sites(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(_pair, level, site) of the sites whose estimates are needed, and (_pair, site) with the one that judges a pair.

    That is the first of source, language and all with ``LEAST_ROWS`` rows. Counts are taken by pair and added up.
    """
    levels = F.array(F.col("_pair"), _site(F.col("_lang")), F.lit("all"))
    pairs = stored(rows.groupBy("_lang", "_source", "_pair").agg(F.count("*").alias("n")).select("_pair", "n", F.posexplode(levels).alias("level", "site")), "pairs")
    large = pairs.groupBy("site").agg(F.sum("n").alias("_rows")).filter((F.col("_rows") >= LEAST_ROWS) | (F.col("site") == "all")).select("site")
    chosen = stored(pairs.join(large, "site", "left_semi").groupBy("_pair").agg(F.min_by("site", "level").alias("site")), "chosen")
    owned = pairs.join(chosen.select("site").distinct(), "site", "left_semi").select("_pair", "level", "site")
    return stored(owned, "owned"), chosen


def judged(documents: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang",
           source: str = "source", cutoff: float = CUTOFF) -> DataFrame:
    """(key, counts, base_failed, distance, kept) of every row.

    Rows without a word have no distance and fail the base rule. Null languages and sources are sites of
    their own. Repeated rows each come back and count as often as they occur.
    """
    return (_verdicts(documents, key, text, lang, source, cutoff)
            .select(F.col("_key").alias(key), *COUNTS, "base_failed", "distance", "kept"))


def text_mark(text: Column) -> Column:
    """Digest by which equal texts are told; null counts as empty."""
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def _verdicts(documents: DataFrame, key: str, text: str, lang: str, source: str, cutoff: float) -> DataFrame:
    """(_key, _lang, _source, _mark, counts, base_failed, distance, kept) of every row."""
    named = documents.select(F.col(key).alias("_key"), F.col(text).alias("_text"), F.col(lang).cast("string").alias("_lang"),
                             F.col(source).cast("string").alias("_source"), text_mark(F.col(text)).alias("_mark"))
    rows = counted(named, ["_key", "_lang", "_source", "_mark"], "_text")
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    rows = stored(rows.withColumn("base_failed", base).withColumns(
        {f: F.when(F.col("n_words") > 0, c) for f, c in features().items()}).withColumns(
        {"_pair": _site(F.col("_lang"), F.col("_source")), "_salt": _salt("_key", "_mark")}), "counts")
    worded = rows.filter("n_words > 0")
    owned, chosen = _sites(worded)
    known = chosen.join(estimates(worded.select("_pair", "_salt", *FEATURES), owned), "site").select("_pair", "centre", "precision", _every_salt())
    met = rows.join(known, ["_pair", "_salt"], "left")
    distance = F.sqrt(F.pow(F.lit(2.0), _log_distance("centre", "precision")) - 1)
    return (met.withColumn("distance", distance)
            .withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("distance") <= cutoff, F.lit(False)))
            .select("_key", "_lang", "_source", "_mark", *COUNTS, "base_failed", "distance", "kept"))


def rows_of(documents: DataFrame, good: DataFrame, key: str, text: str, lang: str, source: str) -> DataFrame:
    """The rows of ``documents`` whose key, language, source and text are those of a row of ``good``.

    These four decide a verdict, so each row stands by its own, also if rows share a key or have none.
    """
    good = good.select("_key", "_lang", "_source", "_mark").distinct()
    same = (documents[key].eqNullSafe(good["_key"]) & documents[lang].cast("string").eqNullSafe(good["_lang"])
            & documents[source].cast("string").eqNullSafe(good["_source"]) & (text_mark(documents[text]) == good["_mark"]))
    return documents.join(good, same, "left_semi")


def keep_good(documents: DataFrame, key: str = "doc_id") -> DataFrame:
    """The rows of ``documents`` that are kept, all columns as they are. Each row stands by its own result."""
    found = _verdicts(documents, key, "text", "lang", "source", CUTOFF)
    return rows_of(documents, found.filter("kept"), key, "text", "lang", "source")


def op8_mcd_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = judged(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                       "kept", F.round("distance", 6).alias("distance"))
