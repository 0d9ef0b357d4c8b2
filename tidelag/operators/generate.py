"""Generative forecasts: each step's forecast is appended to the series and forecast from in turn."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelag.operators.series import Task, numbered
from tidelag.operators.neighbors import FLOOR
from tidelag.operators.smap import ranked, solve_block
from tidelag.operators.solvers import solver as as_solver


def _lib(t: Task, n: int) -> np.ndarray:
    rows = np.zeros(n, bool)
    pairs = t.lib or ((1, n),)
    for i, (a, b) in enumerate(pairs):
        a, b = (a + t.shift, b) if t.tau < 0 else (a, b - t.shift)
        if t.tp >= 0 and i == len(pairs) - 1:
            b -= t.tp
        rows[max(0, a - 1) : max(0, b)] = True
    return np.flatnonzero(rows)


def generated(df: DataFrame, t: Task, steps: int, theta: float | None = None, solver=None, concat: bool = False, time=None, series=None, order=()) -> DataFrame:
    """series, step, Time, Observations, Predictions, Pred_Variance (and coef, sing with a ``theta``) of ``steps`` forecasts.

    The first forecast is made from the last library row; the library does not grow. Without ``theta`` it is a simplex
    projection, else a locally weighted map. ``concat`` puts the observed series before (step below 1). One target that is
    its own predictor, not embedded; times must be numbers. Series run in parallel, steps one after the other.
    """
    if t.embedded or len({c for c, _ in t.dims}) != 1 or t.dims[0][0] != t.target:
        raise ValueError("generating needs one column that is its own target, not embedded")
    if t.tp < 1 or t.tau > 0:
        raise ValueError("generating needs Tp of at least 1 and a negative tau")
    base, alias = numbered(df, [t.target], time, series, order)
    base = base.select("series", "row", F.col("time").cast("double").alias("time"), F.col(alias[t.target]).alias("x"))
    solve = as_solver(solver)
    schema = "series string, step int, Time double, Observations double, Predictions double, Pred_Variance double" + (", coef array<double>, sing array<double>" if theta is not None else "")

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("row")
        n = len(pdf)
        x = np.append(pdf["x"].to_numpy(float), np.full(steps, np.nan))
        when = np.append(pdf["time"].to_numpy(float), np.full(steps, np.nan))
        delta = when[1] - when[0] if n > 1 else 1.0
        shifts = np.array([s for _, s in t.dims])
        lib = _lib(t, n)
        lib = lib[(lib + t.tp < n) & (lib + shifts.min() >= 0)]
        lx = x[lib[:, None] + shifts[None, :]]
        whole = np.isfinite(lx).all(axis=1)
        lib, lx = lib[whole], lx[whole]
        ly = x[lib + t.tp]
        end = (t.lib or ((1, n),))[-1][1] - 1
        out = []
        for step in range(steps):
            p = end + step
            value = variance = np.nan
            coef = sing = np.full(len(shifts) + 1, np.nan)
            px = x[p + shifts] if p + shifts.min() >= 0 else np.full(len(shifts), np.nan)
            if np.isfinite(px).all() and len(lib):
                k = t.knn or max(1, len(lib) - 1)
                o, d, usable = ranked(lx, lib, px[None, :], np.array([p]), t.radius, min(k, len(lib)))
                if theta is None:
                    m = min(t.knn, int(usable[0]))
                    if m:
                        d, y = d[0, :m], ly[o[0, :m]]
                        w = np.exp(-d / max(d.min(), FLOOR))
                        value = float((w * y).sum() / w.sum())
                        variance = float((w * (y - value) ** 2).sum() / w.sum())
                else:
                    v, s2, c, s = solve_block(o, d, usable, lx, ly, px[None, :], k, theta, solve)
                    value, variance, coef, sing = float(v[0]), float(s2[0]), c[0], s[0]
            at = p + t.tp
            now = when[at] if at < len(when) and np.isfinite(when[at]) else when[n - 1] + (at - n + 1) * delta
            seen = float(pdf["x"].iloc[at]) if at < n else np.nan
            x[n + step], when[n + step] = value, now
            out.append([key[0], step + 1, now, seen, value, variance, *([coef, sing] if theta is not None else [])])
        if concat:
            extra = [None, None] if theta is not None else []
            out = [[key[0], i - n + 1, a, b, np.nan, np.nan, *extra] for i, (a, b) in enumerate(zip(pdf["time"], pdf["x"]))] + out
        names = [c.split()[0] for c in schema.split(", ")]
        return pd.DataFrame(out, columns=names).astype({"step": "int32"})

    made = base.groupBy("series").applyInPandas(run, schema)
    return made.select(*(F.when(~F.isnan(c), F.col(c)).alias(c) if k == "double" else F.col(c) for c, k in made.dtypes))
