"""Intervals as column functions over aggregated counts; each row is a group, so Python sees few rows."""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracelink.stats import special

INTERVAL = T.StructType([T.StructField("low", T.DoubleType()), T.StructField("high", T.DoubleType())])


@F.pandas_udf(INTERVAL)
def jeffreys(k: pd.Series, n: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([special.jeffreys(int(a), int(b)) for a, b in zip(k, n)], columns=["low", "high"])


def excludes(interval: str, base: Column) -> Column:
    """Whether an interval leaves the overall rate out."""
    return (F.col(f"{interval}.low") > base) | (F.col(f"{interval}.high") < base)


@functools.lru_cache(maxsize=16)
def uniforms(resamples: int, seed: int, stream: str) -> np.ndarray:
    """A number in [0, 1) for each resample, from the md5 of seed, stream and its number: any engine can draw the same."""
    return np.array([int(hashlib.md5(f"{seed}:{stream}:{b}".encode()).hexdigest()[:13], 16) for b in range(resamples)]) / 2.0**52


def bootstrap_mean(resamples: int = 10_000, seed: int = 0):
    """Percentile interval of a 0/1 mean. A resample of n rows with k ones has a binomial count, so rows are not drawn."""

    @F.pandas_udf(INTERVAL)
    def interval(k: pd.Series, n: pd.Series) -> pd.DataFrame:
        out = []
        for a, b in zip(k, n):
            if b == 0:
                out.append((np.nan, np.nan))
                continue
            draws = special.binomial_quantiles(int(b), a / b, uniforms(resamples, seed, "a")) / b
            out.append(tuple(np.percentile(draws, [2.5, 97.5])))
        return pd.DataFrame(out, columns=["low", "high"])

    return interval


def bootstrap_ratio(rows: DataFrame, resamples: int = 10_000, seed: int = 0) -> DataFrame:
    """Risk ratio of two shares (k1, n1, k0, n0): ratio, low, high over the resamples whose denominator is not 0."""

    def run(batches):
        for batch in batches:
            out = []
            for r in batch.itertuples():
                top = special.binomial_quantiles(r.n1, r.k1 / r.n1, uniforms(resamples, seed, "a")) / r.n1
                bottom = special.binomial_quantiles(r.n0, r.k0 / r.n0, uniforms(resamples, seed, "b")) / r.n0
                ratio = top[bottom > 0] / bottom[bottom > 0]
                low, high = np.percentile(ratio, [2.5, 97.5]) if len(ratio) else (np.nan, np.nan)
                out.append((float(ratio.mean()) if len(ratio) else np.nan, low, high))
            yield pd.DataFrame(out, columns=["ratio", "low", "high"])

    return rows.select("k1", "n1", "k0", "n0").where("n1 > 0 AND n0 > 0").mapInPandas(run, "ratio double, low double, high double")


def bootstrap_f1(resamples: int = 10_000, seed: int = 0):
    """Interval of F1, 2 tp / (2 tp + fp + fn), from the counts (tp, fp, fn, n): a resample's tp is binomial, and of the
    other rows the number of wrong ones is."""

    @F.pandas_udf(INTERVAL)
    def interval(tp: pd.Series, fp: pd.Series, fn: pd.Series, n: pd.Series) -> pd.DataFrame:
        out = []
        for a, b, c, m in zip(tp, fp, fn, n):
            if m == 0:
                out.append((np.nan, np.nan))
                continue
            right = special.binomial_quantiles(int(m), a / m, uniforms(resamples, seed, "a"))
            wrong, u = np.zeros(resamples, np.int64), uniforms(resamples, seed, "b")
            for k in np.unique(right):
                wrong[right == k] = special.binomial_quantiles(int(m - k), (b + c) / max(m - a, 1), u[right == k])
            out.append(tuple(np.percentile(2 * right / np.maximum(2 * right + wrong, 1), [2.5, 97.5])))
        return pd.DataFrame(out, columns=["low", "high"])

    return interval
