"""k nearest of very many vectors, exactly: vectors learnt from lie in leaves, those predicted meet the leaves within reach.

Both sides are halved across their widest side. A group of predicted vectors keeps the leaves that may hold one of its k
nearest, which are fewer with every halving, and measures its distances to what is left of them. Equal vectors are one
point with its rows, so that copies cost nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

#: Points of a leaf at least, predicted vectors of a group at most, and those whose neighbours are put out at once.
LEAF, GROUP, STRETCH = 24, 64, 1 << 14
#: A group of more than so many vectors that meets more than so many points is halved again.
FEW, MANY = 8, 512
#: Values beyond which squares may not be finite.
MOST = 1e150
#: Part by which bounds of squared distances are widened, against rounding.
WIDER = 1e-9


@dataclass
class Tree:
    """Distinct vectors by leaf and the leaves' boxes, a column a row; ``rows`` has the places of all vectors, those of point i from ``first[i]`` on, ascending by row."""

    x: np.ndarray
    leaf: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    rows: np.ndarray
    first: np.ndarray


def fit(x: np.ndarray) -> bool:
    """Whether the squares of all distances are finite."""
    return not len(x) or bool(np.abs(x).max() < MOST)


def halved(x: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """An order of vectors (a column a row) in leaves of at least so many (all, if they are fewer), and where each leaf begins."""
    out, todo = [], [np.arange(x.shape[1])]
    while todo:
        at = todo.pop()
        if len(at) < 2 * least:
            out.append(at)
            continue
        v = x[:, at]
        mid = len(at) // 2
        o = np.argpartition(v[np.argmax(v.max(axis=1) - v.min(axis=1))], mid)
        todo += [at[o[mid:]], at[o[:mid]]]
    return np.concatenate(out), np.cumsum([0, *(len(a) for a in out[:-1])])


def grown(x: np.ndarray, k: int) -> Tree:
    """The tree of some vectors (a column a row; in the order of their rows), for searches of up to k."""
    o = np.lexsort(x[::-1])  # stable: equal vectors stay in the order of their rows
    new = np.ones(len(o), bool)
    new[1:] = (x[:, o[1:]] != x[:, o[:-1]]).any(axis=0)
    first = np.append(np.flatnonzero(new), len(o))
    points = x[:, o[first[:-1]]]
    at, leaf = halved(points, max(LEAF, k))
    size = np.diff(first)[at]
    begin = np.append(0, np.cumsum(size))
    rows = o[np.repeat(first[at] - begin[:-1], size) + np.arange(len(o))]
    points = points[:, at]
    return Tree(points, np.append(leaf, len(at)), np.minimum.reduceat(points, leaf, axis=1), np.maximum.reduceat(points, leaf, axis=1), rows, begin)


def between(t: Tree, leaves: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest squared distance of each leaf from a box."""
    near = far = 0.0
    for s in range(len(lo)):
        a, b = t.lo[s][leaves] - hi[s], lo[s] - t.hi[s][leaves]
        near = near + np.maximum(np.maximum(a, b), 0) ** 2
        far = far + np.minimum(a, b) ** 2
    return near, far


def outside(x: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Squared distances of vectors from a box."""
    out = 0.0
    for s in range(len(lo)):
        out = out + np.maximum(np.maximum(lo[s] - x[s], x[s] - hi[s]), 0) ** 2
    return out


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances, the columns added one by one."""
    out = None
    for s in range(len(a)):
        off = a[s][:, None] - b[s]
        off *= off
        if out is None:
            out = off
        else:
            out += off
    return out


def held_by(t: Tree, leaves: np.ndarray) -> np.ndarray:
    """The points of some leaves."""
    begin = t.leaf[leaves]
    size = t.leaf[leaves + 1] - begin
    return np.arange(int(size.sum())) + np.repeat(begin - (np.cumsum(size) - size), size)


def reached(d2: np.ndarray, k: int, slack: float) -> float:
    """A square that the k-th least of no row, and what equals it to within the slack, is beyond."""
    kth = np.partition(d2, k - 1, axis=1)[:, k - 1].max() if k <= d2.shape[1] else np.inf
    return float((np.sqrt(kth) + slack) ** 2 * (1 + WIDER))


def closest(t: Tree, q: np.ndarray, k: int, slack: float, cells: int, best) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(place in q, point, squared distance) of the k nearest points of each vector and of all at their distance to within the slack.

    ``best`` takes them out of a matrix of squared distances. They come in stretches; those of a vector come together.
    """


    def halves(at: np.ndarray, leaves: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        mid = len(at) // 2
        o = np.argpartition(x[np.argmax(hi - lo)], mid)
        return [(at[o[mid:]], leaves), (at[o[:mid]], leaves)]

    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    held = 0
    todo = [(np.arange(q.shape[1]), np.arange(len(t.leaf) - 1))] if q.size else []
    while todo:
        at, leaves = todo.pop()
        x = q[:, at]
        lo, hi = x.min(axis=1), x.max(axis=1)
        near, far = between(t, leaves, lo, hi)
        best_leaf = int(far.argmin())
        keep = near <= (np.sqrt(far[best_leaf]) + slack) ** 2 * (1 + WIDER)
        if len(at) > GROUP:
            todo += halves(at, leaves[keep])
            continue
        inner = keep & (near == 0)
        inner[best_leaf] = True
        within = reached(squared(x, t.x[:, held_by(t, leaves[inner])]), k, slack)
        leaves = leaves[keep & (near <= within)]
        point = held_by(t, leaves)
        y = t.x[:, point]
        some = np.flatnonzero(outside(y, lo, hi) <= within)
        point, y = point[some], y[:, some]
        if len(point) > MANY and len(at) > FEW and (hi > lo).any():
            todo += halves(at, leaves)
            continue
        step = max(1, cells // len(point))
        for a in range(0, len(at), step):
            d2 = squared(x[:, a : a + step], y)
            r, c = best(d2, k)
            found.append((at[a + r], point[c], d2[r, c]))
            held += min(step, len(at) - a)
        if held >= STRETCH or not todo:
            yield tuple(np.concatenate(z) for z in zip(*found))
            found, held = [], 0


def rows_near(t: Tree, row: np.ndarray, p: np.ndarray, point: np.ndarray, k: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(place in the pairs, place of a vector): of each pair's point the k rows before and the k after row p, beyond the radius.

    ``row`` has the rows of the vectors.
    """
    first, last = t.first[point], t.first[point + 1]
    if (last - first == 1).all():
        at = t.rows[first]
        ok = np.flatnonzero(np.abs(row[at] - p) > radius)
        return ok, at[ok]
    # rows by point, then by row: where p would stand among those of its point
    base, most = int(row.min()), int(row.max())
    wide = most - base + 2
    key = np.repeat(np.arange(len(t.first) - 1), np.diff(t.first)) * wide + (row[t.rows] - base) + 1
    lo = np.searchsorted(key, point * wide + np.clip(p - radius - base + 1, 0, wide), "left")
    hi = np.searchsorted(key, point * wide + np.clip(p + radius - base + 1, 0, wide - 1), "right")
    a, b = np.maximum(first, lo - k), np.minimum(last, hi + k)
    size = np.concatenate([lo - a, b - hi])
    begin = np.concatenate([a, hi])
    of = np.repeat(np.concatenate([np.arange(len(point))] * 2), size)
    return of, t.rows[np.arange(int(size.sum())) + np.repeat(begin - (np.cumsum(size) - size), size)]
