"""Rate of an exponential approach: rho(x) = y0 + b (1 - exp(-a x)) with 0 <= a <= 100 and 0 <= b, y0 <= 1."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelag.shared import ship


def _linear(x: np.ndarray, y: np.ndarray, a: float) -> float:
    """Least squared error over y0 and b in [0, 1] for a given rate."""
    g = 1 - np.exp(-a * x)
    err = lambda y0, b: float(((y - y0 - b * g) ** 2).sum())
    mg, my = g.mean(), y.mean()
    var = ((g - mg) ** 2).sum()
    b = float(((g - mg) * (y - my)).sum() / var) if var > 0 else 0.0
    y0 = my - b * mg
    if 0 <= b <= 1 and 0 <= y0 <= 1:
        return err(y0, b)
    edges = []
    gg = float((g * g).sum())
    for v in (0.0, 1.0):
        edges.append(err(v, float(np.clip(((y - v) * g).sum() / gg if gg > 0 else 0.0, 0, 1))))
        edges.append(err(float(np.clip(my - v * mg, 0, 1)), v))
    return min(edges)


def rate(x: np.ndarray, y: np.ndarray) -> float:
    """Best rate by a grid over [0, 100] and golden section around its best point; NaN below three values."""
    ok = np.isfinite(x) & np.isfinite(y)
    x, y = x[ok], y[ok]
    if len(x) < 3:
        return float("nan")
    grid = np.append(0.0, np.geomspace(1e-3, 100, 240))
    e = [_linear(x, y, a) for a in grid]
    i = int(np.argmin(e))
    lo, hi = grid[max(0, i - 1)], grid[min(len(grid) - 1, i + 1)]
    ratio = (5**0.5 - 1) / 2
    for _ in range(60):
        a, b = hi - ratio * (hi - lo), lo + ratio * (hi - lo)
        if _linear(x, y, a) <= _linear(x, y, b):
            hi = b
        else:
            lo = a
    return float((lo + hi) / 2)


def rates(df: DataFrame, keys: Sequence[str], lib_size: str, rho: str, rows: float) -> DataFrame:
    """``keys`` and ``exp_a`` of each group of (lib_size, rho); null where it can't be told."""
    ship(df.sparkSession)
    types = {f.name: f.dataType.simpleString() for f in df.schema}

    def fit(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        a = rate(pdf[lib_size].to_numpy(float) / rows, pdf[rho].to_numpy(float))
        return pd.DataFrame([[*key, a]], columns=[*keys, "exp_a"])

    out = df.select(*keys, lib_size, rho).groupBy(*keys).applyInPandas(fit, ", ".join(f"{k} {types[k]}" for k in keys) + ", exp_a double")
    return out.withColumn("exp_a", F.when(~F.isnan("exp_a"), F.col("exp_a")))
