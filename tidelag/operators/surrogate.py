"""Surrogate series: shuffled values, randomised phases, or a smooth trend with shuffled residuals."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelag.operators.series import numbered

METHODS = ("random_shuffle", "ebisuzaki", "seasonal")


def phases(x: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Series with the same amplitudes, random phases, mean 0 and the same standard deviation."""
    n = len(x)
    a = np.abs(np.fft.rfft(x))
    z = a * np.exp(1j * rng.uniform(0, 2 * np.pi, len(a)))
    z[0] = 0
    if n % 2 == 0 and n > 1:
        z[-1] = np.sqrt(2) * a[-1] * np.cos(2 * np.pi * rng.uniform())
    y = np.fft.irfft(z, n)
    s = y.std()
    return y * (x.std() / s) if s > 0 else y


def smoothed(y: np.ndarray, smooth: float) -> np.ndarray:
    """Penalised smoother (second differences, in the cosine domain) whose squared residuals sum to ``smooth``."""
    n = len(y)
    if n < 4:
        return y.copy()
    both = np.concatenate([y, y[::-1]])
    f = np.fft.rfft(both)
    g = (2 - 2 * np.cos(np.pi * np.arange(len(f)) / n)) ** 2
    fit = lambda lam: np.fft.irfft(f / (1 + lam * g), 2 * n)[:n]
    lo, hi = -12.0, 12.0
    for _ in range(60):
        mid = (lo + hi) / 2
        if ((y - fit(10**mid)) ** 2).sum() > smooth:
            hi = mid
        else:
            lo = mid
    return fit(10**lo)


def surrogates(df: DataFrame, column: str, method: str = "ebisuzaki", count: int = 10, alpha: float | None = None, smooth: float = 0.8, seed: int = 0, time=None, series=None, order=()) -> DataFrame:
    """series, row, time, surrogate (from 1), value (rounded to 8 places).

    'random_shuffle' permutes the values (as a join, in SQL), 'ebisuzaki' keeps the spectrum, 'seasonal' adds shuffled
    residuals and normal noise (deviation ``alpha``, a fifth of the range if None) to a smooth trend. The same seed gives
    the same surrogates. Missing values are permuted by the first method and left out by the others.
    """
    method = method.lower()
    if method not in METHODS:
        raise ValueError(f"method must be one of {METHODS}")
    base, alias = numbered(df, [column], time, series, order)
    base = base.select("series", "row", "time", F.col(alias[column]).alias("x"))
    each = base.withColumn("surrogate", F.explode(F.sequence(F.lit(1), F.lit(count))))
    if method == "random_shuffle":
        at = F.row_number().over(Window.partitionBy("series", "surrogate").orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), "surrogate", "row")), "row")).cast("bigint") - 1
        moved = each.select("series", "surrogate", at.alias("row"), F.round("x", 8).alias("value"))
        return each.drop("x").join(moved, ["series", "surrogate", "row"]).select("series", "row", "time", "surrogate", "value")

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("row")
        ok = pdf["x"].notna().to_numpy()
        x = pdf["x"].to_numpy(float)[ok]
        rng = np.random.default_rng([seed, int(key[1]), *str(key[0]).encode()])
        value = np.full(len(pdf), np.nan)
        if len(x):
            if method == "ebisuzaki":
                value[ok] = phases(x, rng)
            else:
                trend = smoothed(x, smooth)
                value[ok] = trend + rng.permutation(x - trend) + rng.normal(0, np.ptp(x) / 5 if alpha is None else alpha, len(x))
        return pdf.drop(columns="x").assign(value=np.round(value, 8))

    kind = base.schema["time"].dataType.simpleString()
    out = each.groupBy("series", "surrogate").applyInPandas(run, f"series string, row bigint, time {kind}, surrogate int, value double")
    return out.withColumn("value", F.when(~F.isnan("value"), F.col("value")))
