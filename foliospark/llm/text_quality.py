"""Problem 2: natural prose against lists, tables and junk, by robust Mahalanobis distance.

Mean and covariance of prose are fitted per language on all rows by concentration steps: start at the medians,
keep the rows nearest to them, fit again; then by reweighting steps: fit again on all rows that the distance so far
calls prose, so that the rarer styles of prose count too. Each step is one aggregation of sums and products (66
numbers per language); no text leaves its task.

A row is no prose if the statistics that deviate away from prose contribute more than CUTOFF to its distance.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..session import settled
from .common import FUNCTION_SETS
from .page_text import FLOOR, STATISTICS, page_statistics, prepared

D = len(STATISTICS)
#: Share of a language's rows taken as surely prose in each concentration step, and the number of steps.
CORE, STEPS = 0.5, 3
#: Fits on all rows that the last fit calls prose.
REWEIGHTINGS = 2
#: The fit of all languages together counts as so many rows in the fit of each one, so a language of a few pages is
#: close to the common fit and a large one has its own. Text of no known language is measured by the common fit.
PRIOR_ROWS = 30
COMMON = ""
#: A row is no prose beyond this squared distance (0.999 of chi-squared with 10 degrees of freedom), summed over the
#: contributions of the statistics that deviate away from prose.
CUTOFF = 29.6
#: The sign of a deviation away from prose. The other statistics differ between styles of prose: they shape the
#: covariance, but are no evidence by themselves.
AWAY = {"common_words": -1, "symbol_ratio": 1, "digit_ratio": 1, "marked_lines": 1, "broken_spacing": 1}
SIGNS = np.array([AWAY.get(k, 0) for k in STATISTICS])


def _chi_squared(x: float, degrees: int) -> float:
    """Distribution function for an even number of degrees of freedom."""
    return 1 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(degrees // 2))


def _widening(core: float) -> float:
    """By how much the covariance of the `core` nearest rows of a normal distribution is too small."""
    low, high = 0.0, 1000.0
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if _chi_squared(middle, D) < core else (low, middle)
    return core / _chi_squared(low, D + 2)


Fits = dict[str, tuple[np.ndarray, np.ndarray]]


def _sums(df: DataFrame, widening: float = 1.0) -> Fits:
    """Mean and covariance per language and of all; at most len(FUNCTION_SETS) rows reach the driver. {} for no rows."""
    s = [F.col("stats")[i] for i in range(D)]
    sums = [F.sum(x) for x in s] + [F.sum(s[i] * s[j]) for i in range(D) for j in range(i, D)]
    got = {r["lang"]: (r["n"], np.array(r["sums"])) for r in df.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.array(*sums).alias("sums")).collect()}
    if not got:
        return {}

    def moments(n, v):
        mean, cov = v[:D] / n, np.zeros((D, D))
        cov[np.triu_indices(D)] = v[D:] / n
        return mean, cov + np.triu(cov, 1).T - np.outer(mean, mean)

    mean, cov = moments(sum(n for n, _ in got.values()), sum(v for _, v in got.values()))
    fits = {COMMON: (mean, cov)}
    for k, (n, v) in got.items():
        m, c = moments(n, v)
        fits[k] = ((n * m + PRIOR_ROWS * mean) / (n + PRIOR_ROWS), (n * c + PRIOR_ROWS * cov) / (n + PRIOR_ROWS))
    return {k: (m, c * widening + np.diag(np.square(FLOOR))) for k, (m, c) in fits.items()}


def _distance(fits: Fits) -> Column:
    """struct<d2, away, contributions>: contributions z_j * (S^-1 z)_j add up to the squared distance, those away from prose to `away`."""
    models = {k: (m, np.linalg.inv(c)) for k, (m, c) in fits.items()}

    @F.pandas_udf("d2 double, away double, contributions array<double>")
    def distance(lang: pd.Series, stats: pd.Series) -> pd.DataFrame:
        x = np.stack(stats.to_numpy()) if len(stats) else np.zeros((0, D))
        share, away = np.zeros((len(x), D)), np.zeros(len(x))
        for k in lang.unique():
            mean, inv = models.get(k, models[COMMON])
            at = (lang == k).to_numpy()
            z = x[at] - mean
            share[at] = z * (z @ inv)
            away[at] = np.where(z * SIGNS > 0, share[at], 0.0).sum(1)
        return pd.DataFrame({"d2": share.sum(1), "away": away, "contributions": list(share)})

    return distance("lang", "stats")


def fit(stats: DataFrame) -> Fits:
    """Robust mean and covariance of each language's prose and of all; {} for no rows in a known language."""
    known = stats.where(F.col("lang").isin(list(FUNCTION_SETS))).select("lang", "stats")
    medians = [F.percentile_approx(F.col("stats")[i], 0.5) for i in range(D)]
    q = known.groupingSets([[F.col("lang")], []], "lang").agg(F.coalesce("lang", F.lit(COMMON)).alias("k"), F.count(F.lit(1)).alias("n"), F.array(*medians).alias("m")).where("n > 0").collect()
    if not q:
        return {}
    common = next(np.array(r["m"]) for r in q if r["k"] == COMMON)
    fits = {r["k"]: ((r["n"] * np.array(r["m"]) + PRIOR_ROWS * common) / (r["n"] + PRIOR_ROWS), np.diag(np.square(FLOOR) * 4)) for r in q}
    for _ in range(STEPS):
        near = known.select("lang", "stats", _distance(fits)["d2"].alias("d2"))
        cuts = {r[0]: r[1] for r in near.groupBy("lang").agg(F.percentile_approx("d2", CORE)).collect()}  # a row per language
        cut = F.coalesce(*[F.when(F.col("lang") == k, F.lit(c)) for k, c in cuts.items()])
        fits |= _sums(near.where(F.col("d2") <= cut), _widening(CORE))
    for _ in range(REWEIGHTINGS):
        fits |= _sums(known.select("lang", "stats", _distance(fits)["away"].alias("away")).where(F.col("away") <= CUTOFF))
    return fits


def measured(ocr: DataFrame, pages: DataFrame) -> DataFrame:
    """cache_seq, lang, kind, stats, d2, away, contributions of the rows with ocr_ok and text."""
    return distances(settled(lambda: page_statistics(prepared(ocr, pages))))


def distances(stats: DataFrame) -> DataFrame:
    fits = fit(stats)
    if not fits:
        return stats.withColumns({"d2": F.lit(None).cast("double"), "away": F.lit(None).cast("double"), "contributions": F.array().cast("array<double>")})
    return stats.select("*", _distance(fits).alias("m")).select("cache_seq", "lang", "kind", "stats", "m.d2", "m.away", "m.contributions")


def outliers(m: DataFrame) -> DataFrame:
    """cache_seq, kind of the rows that aren't prose."""
    return m.where(F.col("away") > CUTOFF).select("cache_seq", "kind")


def not_prose(ocr: DataFrame, pages: DataFrame) -> DataFrame:
    """cache_seq, kind (list, table or junk) of rows with ocr_ok and text whose own text isn't prose.

    Rows that failed, null or blank texts give none. A text of furniture only counts as junk.
    """
    return outliers(measured(ocr, pages))


def report(ocr: DataFrame, pages: DataFrame) -> DataFrame:
    """One row per measured row: each statistic, the distance, its part away from prose and each statistic's share of it."""
    m = measured(ocr, pages)
    cols = [F.col("stats")[i].alias(k) for i, k in enumerate(STATISTICS)] + [F.col("contributions")[i].alias(f"{k}_contribution") for i, k in enumerate(STATISTICS)]
    return m.select("cache_seq", "lang", "d2", "away", *cols)
