"""Locally weighted linear maps (S-Map): blocks of predicted rows are solved against the streamed library."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelag.operators.neighbors import CELLS, PIECE, PLACES, Piece, checked, chosen, near_band, pieces, streamed
from tidelag.operators.series import Prepared, Task, obs_mask
from tidelag.operators.solvers import lstsq, solver as as_solver


def ranked(lx: np.ndarray, lrow: np.ndarray, px: np.ndarray, prow: np.ndarray, radius: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k nearest library rows of each predicted row, their distances, and how many may be used.

    Usable ones stand first. They are in order of distance only where not all of the library is asked for.
    """
    d2 = np.zeros((len(px), len(lx)))
    for j in range(lx.shape[1]):
        off = px[:, j, None] - lx[None, :, j]
        off *= off
        d2 += off
    d = np.sqrt(d2, out=d2)
    bi, bj = near_band(prow, lrow, radius)
    d[bi, bj] = np.inf
    usable = np.full(len(px), len(lx)) - np.bincount(bi, minlength=len(px))
    if k >= len(lx):
        order = np.argsort(np.isinf(d), axis=1, kind="stable") if len(bi) else np.broadcast_to(np.arange(len(lx)), d.shape)
    elif (usable <= k).all():  # all that may be used are asked for
        order = np.argsort(np.isinf(d), axis=1, kind="stable")[:, :k]
    else:
        gap = np.abs(prow[:, None] - lrow[None, :])
        order = np.lexsort((np.broadcast_to(lrow, d.shape), gap, np.round(d, PLACES)), axis=-1)[:, :k]
    return order, np.take_along_axis(d, order, 1), usable


def solve_block(order, dist, usable, lx, ly, px, k: int, theta: float, solve) -> tuple[np.ndarray, ...]:
    """Prediction, variance, coefficients and singular values of each predicted row."""
    n, e = px.shape
    k = min(k, lx.shape[0])
    value, variance = np.full(n, np.nan), np.full(n, np.nan)
    coef, sing = np.full((n, e + 1), np.nan), np.full((n, e + 1), np.nan)
    order, dist = order[:, :k], dist[:, :k]
    used = np.minimum(usable, k)
    inside = np.arange(k)[None, :] < used[:, None]
    d = np.where(inside, dist, 0.0)
    with np.errstate(all="ignore"):
        mean = d.sum(axis=1) / used
        w = np.exp(-theta * np.where(mean[:, None] > 0, d / mean[:, None], 0.0)) if theta else np.ones_like(d)
    y = ly[order]
    ok = inside & np.isfinite(y)
    w_all = np.where(ok, w, 0.0)
    a = np.empty((n, k, e + 1))
    a[:, :, 0] = w_all
    a[:, :, 1:] = w_all[:, :, None] * lx[order]
    b = w_all * np.where(ok, y, 0.0)
    rows = ok.sum(axis=1)
    if solve is lstsq:
        u, s, vt = np.linalg.svd(a, full_matrices=False)
        cut = np.finfo(float).eps * np.maximum(rows, e + 1)[:, None] * s[:, :1]
        inv = np.where(s > cut, 1.0 / np.where(s > 0, s, 1.0), 0.0)
        c = np.einsum("nji,nj->ni", vt, inv * np.einsum("nkj,nk->nj", u, b))
        good = rows > 0
        coef[good] = c[good]
        m = s.shape[1]
        sing[good, :m] = s[good]
        sing[(np.arange(e + 1)[None, :] >= rows[:, None])] = np.nan
    else:
        for i in np.flatnonzero(rows > 0):
            c, s = solve(a[i][ok[i]], b[i][ok[i]])
            coef[i] = np.where(np.isnan(c), 0.0, c)
            sing[i, : len(s)] = s
    value = coef[:, 0] + (coef[:, 1:] * px).sum(axis=1)
    with np.errstate(all="ignore"):
        variance = (w_all * np.where(ok, (y - value[:, None]) ** 2, 0.0)).sum(axis=1) / w_all.sum(axis=1)
    return value, variance, coef, sing


def forecasts(p: Prepared, thetas: Sequence[float], solver=None) -> DataFrame:
    """series, task, theta, p, obs, predicted, variance, coef, sing of every predicted row, task and theta.

    A task with knn 0 uses one neighbour less than its library has. Neighbours without a target are left out of the
    solve but count for the mean distance. Distances are taken once for all thetas. As every row's fit is over the
    whole library, a task holds the library's numbers of its series (never its rows' pairs).
    """
    tasks: list[Task] = p.tasks
    strict = p.strict
    solve = as_solver(solver)
    thetas = [float(t) for t in thetas]
    slots = [p.slots(t) for t in tasks]
    valid = [p.valid.index(t.valid) if t.valid else None for t in tasks]
    aims = [p.ys.index((t.target, t.tp)) for t in tasks]
    sizes = len(p.dims), len(p.ys), len(p.valid), PIECE
    schema = "series string, task int, theta double, p bigint, obs double, predicted double, variance double, coef array<double>, sing array<double>"
    names = [c.split()[0] for c in schema.split(", ")]

    def lists(v: np.ndarray) -> pa.Array:
        n, w = v.shape
        return pa.ListArray.from_arrays(np.arange(0, n * w + 1, w, dtype=np.int32), pa.array(v.ravel(), from_pandas=True))

    def solved(parts: list[Piece]) -> Iterator[pa.RecordBatch]:
        own = parts[0].part(0, int(parts[0].own.sum()))
        at = np.argsort(np.concatenate([q.row for q in parts]), kind="stable")
        each = lambda f: np.concatenate([getattr(q, f) for q in parts])[at]
        lib = Piece(own.series, each("row"), own.n, each("own"), each("x"), each("y"), each("valid"), each("teaches"), each("predicted"), own.only)
        for i, t in enumerate(tasks):
            q, l = chosen(own, t, slots[i], valid[i], False), chosen(lib, t, slots[i], valid[i], True)
            if len(q):
                checked(t, len(l), t.knn, strict)
            if not len(q) or not len(l):
                continue
            target = aims[i]
            lx, ly, lrow = lib.x[l][:, slots[i]], lib.y[l, target], lib.row[l]
            k = min(t.knn or max(1, len(l) - 1), len(l))
            obs = np.where(obs_mask(t, own.row[q], own.n), own.y[q, target], np.nan)
            step = max(1, CELLS // (len(l) * (len(slots[i]) + 1)))
            for a in range(0, len(q), step):
                part = q[a : a + step]
                px, prow = own.x[part][:, slots[i]], own.row[part]
                order, dist, usable = ranked(lx, lrow, px, prow, t.radius, k)
                for theta in thetas:
                    value, variance, coef, sing = solve_block(order, dist, usable, lx, ly, px, k, theta, solve)
                    m = len(part)
                    cols = [pa.array([own.series] * m, pa.string()), pa.array(np.full(m, i, np.int32)), pa.array(np.full(m, theta)), pa.array(prow)]
                    cols += [pa.array(v, from_pandas=True) for v in (obs[a : a + step], value, variance)]
                    yield pa.RecordBatch.from_arrays([*cols, lists(coef), lists(sing)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[Piece] = []
        for first, piece in pieces(batches, *sizes):
            if first and parts:
                yield from solved(parts)
                parts = []
            parts.append(piece)
        if parts:
            yield from solved(parts)

    return streamed(p).mapInArrow(run, schema)
