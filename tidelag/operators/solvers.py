"""Least-squares solvers for locally weighted maps: (A, b) -> (coefficients, singular values).

``A`` holds a row per neighbour, each scaled by its weight, its first column being the weights themselves (the
intercept); ``b`` the targets scaled likewise. A solver returns one coefficient a column, the first the intercept.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np

Solver = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def lstsq(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Minimum-norm least squares, with singular values."""
    c, _, _, s = np.linalg.lstsq(a, b, rcond=None)
    return c, s


def _centred(a: np.ndarray, b: np.ndarray):
    x = a[:, 1:]
    mx, mb = x.mean(axis=0), b.mean()
    return x - mx, b - mb, mx, mb


def ols(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ordinary least squares on the weighted columns with an unweighted intercept."""
    x, y, mx, mb = _centred(a, b)
    c, _, _, s = np.linalg.lstsq(x, y, rcond=None)
    return np.append(mb - mx @ c, c), s


def ridge(alpha: float = 1.0) -> Solver:
    """Squared penalty on the coefficients, none on the intercept."""

    def solve(a, b):
        x, y, mx, mb = _centred(a, b)
        c = np.linalg.solve(x.T @ x + alpha * np.eye(x.shape[1]), x.T @ y)
        return np.append(mb - mx @ c, c), np.zeros(0)

    return solve


def elastic_net(alpha: float = 1.0, l1_ratio: float = 0.5, rounds: int = 1000, tol: float = 1e-8) -> Solver:
    """Mixed penalty by coordinate descent; minimises |y-Xc|^2/(2n) + alpha (l1 |c| + (1-l1) c^2 / 2)."""

    def solve(a, b):
        x, y, mx, mb = _centred(a, b)
        n = len(x)
        c, r = np.zeros(x.shape[1]), y.copy()
        norm = (x * x).sum(axis=0) / n
        for _ in range(rounds):
            most = 0.0
            for j in range(len(c)):
                if norm[j] == 0:
                    continue
                old = c[j]
                z = x[:, j] @ r / n + norm[j] * old
                c[j] = np.sign(z) * max(0.0, abs(z) - alpha * l1_ratio) / (norm[j] + alpha * (1 - l1_ratio))
                if c[j] != old:
                    r -= x[:, j] * (c[j] - old)
                    most = max(most, abs(c[j] - old))
            if most < tol:
                break
        return np.append(mb - mx @ c, c), np.zeros(0)

    return solve


def lasso(alpha: float = 1.0) -> Solver:
    """Absolute penalty."""
    return elastic_net(alpha, 1.0)


def _centred(a, b) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    x = a[:, 1:]
    mx, mb = x.mean(axis=0), b.mean()
    return x - mx, b - mb, mx, mb


def ridge_cv(alphas: Sequence[float] = (0.1, 1.0, 10.0)) -> Solver:
    """Squared penalty of the strength whose leave-one-out errors, which the singular values give, are least."""

    def solve(a, b):
        x, y, mx, mb = _centred(a, b)
        u, s, vt = np.linalg.svd(x, full_matrices=False)
        uy = u.T @ y
        best = None
        for alpha in alphas:
            d = s * s / (s * s + alpha)
            left = 1.0 - (u * u) @ d - 1.0 / len(y)
            e = float((((y - u @ (d * uy)) / np.where(np.abs(left) > 1e-12, left, 1e-12)) ** 2).mean())
            if best is None or e < best[0]:
                best = (e, alpha)
        c = vt.T @ (s / (s * s + best[1]) * uy)
        return np.append(mb - mx @ c, c), np.zeros(0)

    return solve


def elastic_net_cv(l1_ratio: float = 0.5, folds: int = 5, strengths: int = 30, least: float = 1e-3) -> Solver:
    """Mixed penalty of the strength with the least error over contiguous folds."""

    def solve(a, b):
        x, y, _, _ = _centred(a, b)
        top = np.abs(x.T @ y).max() / (len(y) * l1_ratio) if len(y) else 1.0
        grid = np.geomspace(max(top, 1e-12), max(top, 1e-12) * least, strengths)
        error = np.zeros(strengths)
        for out in np.array_split(np.arange(len(y)), min(folds, len(y))):
            keep = np.setdiff1d(np.arange(len(y)), out)
            if len(keep):
                for i, alpha in enumerate(grid):
                    c, _ = elastic_net(alpha, l1_ratio)(a[keep], b[keep])
                    error[i] += ((b[out] - c[0] - a[out, 1:] @ c[1:]) ** 2).sum()
        return elastic_net(float(grid[int(error.argmin())]), l1_ratio)(a, b)

    return solve


def lasso_cv() -> Solver:
    """Absolute penalty of the strength with the least error over contiguous folds."""
    return elastic_net_cv(1.0)


def lars(a, b):
    """Least angles, followed to the end of the path, where they are least squares."""
    return ols(a, b)[0], np.zeros(0)


def lasso_lars_ic(criterion: str = "aic") -> Solver:
    """Absolute penalty of the strength with the least information criterion."""

    def solve(a, b):
        x, y, _, _ = _centred(a, b)
        n = len(y)
        full, *_ = np.linalg.lstsq(x, y, rcond=None)
        noise = float(((y - x @ full) ** 2).sum()) / max(1, n - x.shape[1] - 1)
        top = max(np.abs(x.T @ y).max() / n, 1e-12)
        best = None
        for alpha in [*np.geomspace(top, top * 1e-4, 40), 0.0]:
            c = elastic_net(alpha, 1.0)(a, b)[0] if alpha else ols(a, b)[0]
            rest = float(((b - c[0] - a[:, 1:] @ c[1:]) ** 2).sum())
            score = rest / max(noise, 1e-300) + (2.0 if criterion == "aic" else np.log(n)) * np.count_nonzero(c[1:])
            if best is None or score < best[0]:
                best = (score, c)
        return best[1], np.zeros(0)

    return solve


def omp(nonzero: int | None = None) -> Solver:
    """Matching pursuit: takes the columns that fit what is left best, one after the other (a tenth of them if None)."""

    def solve(a, b):
        x, y, mx, mb = _centred(a, b)
        norm = np.sqrt((x * x).sum(axis=0))
        many = min(nonzero or max(1, x.shape[1] // 10), x.shape[1])
        picked: list[int] = []
        c = np.zeros(x.shape[1])
        for _ in range(many):
            fit = np.abs(x.T @ (y - x @ c)) / np.where(norm > 0, norm, np.inf)
            fit[picked] = -1.0
            picked.append(int(fit.argmax()))
            c[:] = 0.0
            c[picked] = np.linalg.lstsq(x[:, picked], y, rcond=None)[0]
        return np.append(mb - mx @ c, c), np.zeros(0)

    return solve


def sgd(alpha: float = 1e-4, rate: float = 0.01, epochs: int = 1000, tol: float = 1e-3, seed: int = 0) -> Solver:
    """Stochastic gradient descent on squared errors with a squared penalty; the steps shrink with the fourth root."""

    def solve(a, b):
        rng = np.random.default_rng(seed)
        x = a[:, 1:]
        c, c0, t, low, waited = np.zeros(x.shape[1]), 0.0, 0, np.inf, 0
        for _ in range(epochs):
            total = 0.0
            for i in rng.permutation(len(b)):
                t += 1
                step = rate / t**0.25
                e = float(x[i] @ c + c0 - b[i])
                total += e * e / 2
                c -= step * (e * x[i] + alpha * c)
                c0 -= step * e
            waited = waited + 1 if total > low - tol * len(b) else 0
            low = min(low, total)
            if waited >= 5 or not np.isfinite(total):
                break
        return np.append(c0, c), np.zeros(0)

    return solve


def from_estimator(model) -> Solver:
    """Solver from any object with ``fit``, ``coef_`` and ``intercept_``, such as those of scikit-learn."""

    def solve(a, b):
        m = model.fit(a[:, 1:], b)
        intercept = float(np.ravel(getattr(m, "intercept_", 0.0))[0])
        s = getattr(m, "singular_", np.zeros(0))
        return np.append(0.0 if np.isnan(intercept) else intercept, np.ravel(m.coef_)), np.asarray(s)

    return solve


MADE: dict[str, Callable[[], Solver]] = {
    "ridge": ridge, "lasso": lasso, "elastic_net": elastic_net, "ridge_cv": ridge_cv, "lasso_cv": lasso_cv, "elastic_net_cv": elastic_net_cv,
    "lasso_lars": lasso, "lasso_lars_cv": lasso_cv, "lasso_lars_ic": lasso_lars_ic, "omp": omp, "sgd": sgd,
}
SOLVERS: dict[str, Solver | Callable[[], Solver]] = {"lstsq": lstsq, "ols": ols, "lars": lars, "lars_cv": lars, **MADE}


def solver(x) -> Solver:
    """A solver from None, a name, a function or an estimator."""
    if x is None:
        return lstsq
    if isinstance(x, str):
        return MADE[x]() if x in MADE else SOLVERS[x]
    return from_estimator(x) if hasattr(x, "fit") else x
