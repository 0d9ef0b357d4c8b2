"""Most similar vectors of every vector by collision counting on single-projection sorted arrays.

Vectors are projected on several directions; along the first a block of the collection is a sorted array. A query
opens a window around its own projection in every direction and counts in how many windows another vector falls;
those that reach the threshold are verified by their true distance. If fewer than k verified ones lie within the
windows' reach, the windows grow (virtual rehashing) and the count is taken again.

The directions come in frames at right angles. Of the d differences along a frame the squares sum to the squared
distance, so at most t of them exceed reach / sqrt(t + 1): a vector within the reach falls into at least d - t windows
of that half-width in every frame. Counted against that threshold nothing within the reach is lost: the
answer is exact. Narrower windows or another threshold are an option for many dimensions.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelag.shared import quoted, ship, written

#: Vectors the block boundaries are fitted on, at most; every vector is put into a block.
FIT_ROWS = 200_000
#: Vectors a block is meant to hold, most blocks that the driver fits, and visitors of a block that a task takes.
BLOCK, MOST_BLOCKS, VISITORS = 2048, 1 << 14, 1 << 14
#: Halvings by which each of those blocks is cut further where there are more vectors, and vectors of a final block that
#: such cuts are fitted on.
DEEPER, FIT_BLOCK = 6, 12
#: Queries whose windows are counted at once, and cells of such a count.
QUERIES, CELLS = 64, 1 << 18
#: Growth of the reach; share of a block's vectors that its first reach is meant to suffice for.
GROWTH, ENOUGH = 1.4, 0.8


def directions(dims: int, count: int, seed: int) -> np.ndarray:
    """Unit directions: frames at right angles to each other, one after the other."""
    rng = np.random.default_rng(seed)
    frames = [np.linalg.qr(rng.standard_normal((dims, dims)))[0].T for _ in range(-(-max(count, 1) // dims))]
    return np.vstack(frames)[: max(count, 1)]


def counting(dims: int) -> tuple[int, float, int]:
    """Projections, half-width of a window relative to the reach, and threshold of an exact search."""
    spare = min(1, dims - 1)
    frames = 2 if 1 < dims <= 8 else 1
    return frames * dims, (spare + 1) ** -0.5, frames * (dims - spare)


def projected(x: np.ndarray, dirs: np.ndarray) -> np.ndarray:
    """Projections, computed row by row alike whatever else is in the batch."""
    out = np.zeros((len(x), len(dirs)))
    for j, d in enumerate(dirs):
        for i in range(x.shape[1]):
            out[:, j] += x[:, i] * d[i]
    return out


def fitted_blocks(p: np.ndarray, depth: int, axes: int) -> tuple[np.ndarray, np.ndarray]:
    """Axis and threshold of each inner node of a tree of medians over the sample's projections."""
    axis, at = np.zeros(1 << depth, np.int64), np.full(1 << depth, np.inf)
    parts = {1: np.arange(len(p))}
    for node in range(1, 1 << depth):
        rows = parts.pop(node, np.zeros(0, int))
        if len(rows) > 1:
            spread = [np.subtract(*np.quantile(p[rows, a], (0.95, 0.05))) for a in range(axes)]
            axis[node] = int(np.argmax(spread))
            at[node] = np.median(p[rows, axis[node]])
            low = p[rows, axis[node]] <= at[node]
            parts[2 * node], parts[2 * node + 1] = rows[low], rows[~low]
    return axis, at


def grafted(axis: np.ndarray, at: np.ndarray, below: dict[int, tuple[np.ndarray, np.ndarray]], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The tree whose blocks are cut by the trees ``below``, of ``depth`` halvings each, on."""
    leaves = len(axis)
    out_axis, out_at = np.zeros(leaves << depth, np.int64), np.full(leaves << depth, np.inf)
    out_axis[:leaves], out_at[:leaves] = axis, at
    for leaf, (a, t) in below.items():
        for j in range(depth):
            node = (leaves + leaf) << j
            out_axis[node : node + (1 << j)], out_at[node : node + (1 << j)] = a[1 << j : 2 << j], t[1 << j : 2 << j]
    return out_axis, out_at


def block_of(p: np.ndarray, axis: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Block of each row of projections."""
    node = np.ones(len(p), np.int64)
    rows = np.arange(len(p))
    for _ in range(len(axis).bit_length() - 1):
        node = 2 * node + (p[rows, axis[node]] > at[node])
    return node - len(axis)


def blocks_within(p: np.ndarray, reach: np.ndarray, axis: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and block of every block that the window of a row touches."""
    row, node = np.arange(len(p)), np.ones(len(p), np.int64)
    for _ in range(len(axis).bit_length() - 1):
        v, r, t = p[row, axis[node]], reach[row], at[node]
        low, high = v - r <= t, v + r > t
        row, node = np.concatenate([row[low], row[high]]), np.concatenate([2 * node[low], 2 * node[high] + 1])
    return row, node - len(axis)


def _best(q: np.ndarray, cand: np.ndarray, d2: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each query by (distance, id), sorted, and the place of each."""
    o = np.lexsort((ids[cand], d2, q))
    q, cand, d2 = q[o], cand[o], d2[o]
    new = np.ones(len(q), bool)
    new[1:] = q[1:] != q[:-1]
    place = np.arange(len(q)) - np.maximum.accumulate(np.where(new, np.arange(len(q)), 0))
    keep = place < k
    return q[keep], cand[keep], d2[keep], place[keep]


def search(x: np.ndarray, p: np.ndarray, ids: np.ndarray, qx: np.ndarray, qp: np.ndarray, k: int, reach: np.ndarray, grow: bool, width: float, threshold: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query, vector and squared distance of the k nearest of each query among the vectors of one block.

    ``reach`` is the first reach of each query; with ``grow`` it grows until k verified vectors lie within it
    or the block is exhausted, else one count is taken.
    """
    n, m = p.shape
    sorted_ = np.argsort(p[:, 0], kind="stable")
    arrays = [np.ascontiguousarray(p[sorted_, j]) for j in range(m)]
    xs = x[sorted_]
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    active = np.argsort(qp[:, 0], kind="stable")
    reach = reach.astype(float).copy()
    while len(active):
        half = (width * reach * (1 + 1e-9) + 1e-12)[:, None]
        full = reach * (1 + 1e-9) + 1e-12
        again = []
        first = 0
        while first < len(active):
            q = active[first : first + QUERIES]
            lo = int(np.searchsorted(arrays[0], (qp[q, 0] - full[q]).min(), "left"))
            hi = int(np.searchsorted(arrays[0], (qp[q, 0] + full[q]).max(), "right"))
            q = q[: max(1, CELLS // max(1, hi - lo))]
            first += len(q)
            hits = np.zeros((len(q), hi - lo), np.int16)
            for j in range(m):
                off = arrays[j][None, lo:hi] - qp[q, j, None]
                hits += np.abs(off, out=off) <= half[q]
            r, c = np.divmod(np.flatnonzero(hits >= threshold), max(1, hi - lo))
            c += lo
            d2 = np.zeros(len(r))
            for i in range(x.shape[1]):
                off = qx[q[r], i] - xs[c, i]
                d2 += off * off
            near = d2 <= full[q[r]] ** 2
            r, c, d2 = r[near], c[near], d2[near]
            if grow:
                short = np.bincount(r, minlength=len(q)) < min(k, n)
                again.append(q[short])
                keep = ~short[r]
                r, c, d2 = r[keep], c[keep], d2[keep]
            r, c, d2, _ = _best(r, sorted_[c], d2, ids, k)
            found.append((q[r], c, d2))
        active = np.concatenate(again) if again else active[:0]
        reach[active] *= GROWTH
    if not found:
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0)
    q, cand, d2 = (np.concatenate(z) for z in zip(*found))
    o = np.argsort(q, kind="stable")
    return q[o], cand[o], d2[o]


def first_reach(x: np.ndarray, k: int) -> float:
    """Distance within which most of a block's vectors have k others, by a few of them."""
    if len(x) < 2:
        return 1e-12
    some = x[:: max(1, len(x) // 32)][:32]
    d2 = np.zeros((len(some), len(x)))
    for i in range(x.shape[1]):
        off = some[:, i, None] - x[None, :, i]
        d2 += off * off
    at = min(k, len(x)) - 1
    return max(float(np.sqrt(np.quantile(np.partition(d2, at, axis=1)[:, at], ENOUGH))), 1e-12)


def _lists(q: np.ndarray, cand: np.ndarray, d2: np.ndarray, queries: int, size: np.ndarray, flat: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all queries in turn: how many, the squared distances and the ids of the k nearest rows; a vector stands for its members."""
    begin = np.cumsum(size) - size
    c = size[cand]
    at = np.arange(int(c.sum())) - np.repeat(np.cumsum(c) - c, c) + np.repeat(begin[cand], c)
    q, d2, ids = np.repeat(q, c), np.repeat(d2, c), flat[at]
    o = np.lexsort((ids, d2, q))
    q, d2, ids = q[o], d2[o], ids[o]
    start = np.searchsorted(q, np.arange(queries + 1))
    keep = np.arange(len(q)) - start[q] < k
    return np.minimum(np.diff(start), k), d2[keep], ids[keep]


def _array(size: np.ndarray, flat: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(size)), pa.int32()), pa.array(flat, kind))


def _columns(t: pa.Table, names: Sequence[str]) -> np.ndarray:
    return np.stack([t[c].to_numpy() for c in names], axis=1) if t.num_rows else np.zeros((0, len(names)))


def _members(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """How many members each vector of a table has, and all of them."""
    m = t["members"].combine_chunks()
    return np.diff(m.offsets.to_numpy()), m.flatten().to_numpy()


def _cut_on(vectors: DataFrame, n: int, axis: np.ndarray, at: np.ndarray, deeper: int, dirs: np.ndarray, axes: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """The tree with each of its blocks cut ``deeper`` times more.

    A block's cuts are fitted by the task that has its sample, FIT_BLOCK vectors for each final block on average; what
    comes to the driver are the nodes, of which there are at most MOST_BLOCKS << DEEPER.
    """
    xs = vectors.columns

    @F.pandas_udf("int")
    def placed(v: pd.DataFrame) -> pd.Series:
        return pd.Series(block_of(projected(v.to_numpy(float), dirs), axis, at).astype(np.int32))

    def fit(t: pa.Table) -> pa.Table:
        a, c = fitted_blocks(projected(_columns(t, xs), dirs), deeper, axes)
        return pa.table({"b": pa.array([t["b"][0].as_py()], pa.int32()), "axis": pa.array([a], pa.list_(pa.int64())), "at": pa.array([c], pa.list_(pa.float64()))})

    some = vectors.sample(min(1.0, FIT_BLOCK * (len(axis) << deeper) / n), seed=seed)
    trees = some.withColumn("b", placed(F.struct(*xs))).groupBy("b").applyInArrow(fit, "b int, axis array<bigint>, at array<double>").collect()
    return grafted(axis, at, {r["b"]: (np.array(r["axis"]), np.array(r["at"])) for r in trees}, deeper)


def nearest(
    df: DataFrame, key: str, columns: Sequence[str], k: int = 5, below: float = np.inf, projections: int | None = None, width: float | None = None, threshold: int | None = None, seed: int = 1, block: int = BLOCK
) -> DataFrame:
    """For every distinct vector its rows and the k+1 nearest rows, its own among them.

    :param columns: numeric columns of the vector; rows with a null, NaN or infinite one, one whose size is
        ``below`` or more, or a null key are left out. Rows that repeat a key and its vector count once.
    :param projections, width, threshold: a window's half-width is ``width`` times the reach, and a vector is verified if
        it falls into ``threshold`` of the windows. Left to None they make the result exact (:func:`counting`); narrower windows
        are faster in many dimensions, also in the blocks that they touch, and may lose some.
    :returns: ``x0``, ``x1``, ... (the vector), ``members`` (the least k+1 keys with this vector), ``d2`` and ``ids``: squared distances and keys of the
        k+1 nearest rows in order of distance, then key. A member's own neighbours are this list without itself. A
        row beyond the least k+1 of its vector has the first k members as neighbours (:func:`neighbours_of`). Empty tables
        give no rows.

    Equal vectors are one point, so that no number of copies makes a block large. Blocks are cut by medians along
    the projections, fitted on at most FIT_ROWS vectors (from MOST_BLOCKS blocks on, each is cut further by a sample of its
    own); each vector is first searched in its own block, which bounds
    how far its neighbours can be, and then only in those blocks that its window touches.
    """
    ship(df.sparkSession)
    dims, top = len(columns), k + 1
    exact = counting(dims)
    m = projections or exact[0]
    threshold = threshold or (exact[2] if m == exact[0] else m)
    narrow = width is not None
    width = width if narrow else exact[1] if (m, threshold) == (exact[0], exact[2]) else 1.0
    dirs = directions(dims, m, seed)
    axes = min(m, dims)
    xs = [f"x{i}" for i in range(dims)]
    rows = df.select(quoted(key).cast("bigint").alias("id"), *(quoted(c).cast("double").alias(a) for a, c in zip(xs, columns))).where("id IS NOT NULL")
    for a in xs:
        rows = rows.where(F.col(a).isNotNull() & ~F.isnan(a) & (F.abs(a) < F.lit(float(below))))
    rows = rows.select("id", *((F.col(a) + 0.0).alias(a) for a in xs))
    least = Window.partitionBy(*xs).orderBy("id")
    few = rows.withColumn("r", F.dense_rank().over(least)).where(F.col("r") <= top)
    points = written(few.groupBy(*xs).agg(F.sort_array(F.collect_set("id")).alias("members")))
    n = points.count()
    sample = points.select(*xs)
    if n > FIT_ROWS:
        sample = sample.sample(FIT_ROWS / n * 0.95, seed=seed)
    want = max(0, int(np.ceil(np.log2(max(1, n) / block))))
    depth = min(want, MOST_BLOCKS.bit_length() - 1)
    axis, at = fitted_blocks(projected(sample.toPandas().to_numpy(float).reshape(-1, dims), dirs), depth, axes)
    deeper = min(want - depth, DEEPER)
    if deeper:
        axis, at = _cut_on(points.select(*xs), n, axis, at, deeper, dirs, axes, seed)

    @F.pandas_udf("int")
    def placed(v: pd.DataFrame) -> pd.Series:
        return pd.Series(block_of(projected(v.to_numpy(float), dirs), axis, at).astype(np.int32))

    points = written(points.withColumn("b", placed(F.struct(*xs))))
    vectors = ", ".join(f"{a} double" for a in xs)

    def own(t: pa.Table) -> pa.Table:
        size, flat = _members(t)
        x = _columns(t, xs)
        p = projected(x, dirs)
        ids = flat[np.cumsum(size) - size]
        q, cand, d2 = search(x, p, ids, x, p, top, np.full(len(x), first_reach(x, top)), True, width, threshold)
        held, dist, near = _lists(q, cand, d2, len(x), size, flat, top)
        last = np.cumsum(held) - 1
        reach = np.where(held >= top, np.sqrt(dist[last]), np.inf)
        row, other = blocks_within(p, (width if narrow else 1.0) * reach * (1 + 1e-9) + 1e-12, axis, at)
        away = other != t["b"].to_numpy()[row]
        row, other = row[away], other[away]
        o = np.argsort(row, kind="stable")
        cols = [*(t[a].combine_chunks() for a in xs), pa.array(ids), t["members"].combine_chunks(), pa.array(reach), _array(held, dist, pa.float64()), _array(held, near, pa.int64()), _array(np.bincount(row, minlength=len(x)), other[o], pa.int32())]
        return pa.Table.from_arrays(cols, names=[*xs, "id", "members", "reach", "d2", "ids", "others"])

    first = written(points.groupBy("b").applyInArrow(own, f"{vectors}, id bigint, members array<bigint>, reach double, d2 array<double>, ids array<bigint>, others array<int>"))
    visits = first.select("id", *xs, "reach", F.explode("others").alias("b"))
    # a block with many visitors stands in several parts, each of which takes some
    parts = visits.groupBy("b").agg(F.ceil(F.count("*") / VISITORS).cast("int").alias("parts"))
    parts = parts if deeper else F.broadcast(parts)  # a row for each of at most MOST_BLOCKS blocks
    visits = visits.join(parts, "b").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    hosts = points.join(parts, "b").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    hosts = hosts.select(*(F.col(c).alias(c) for c in [*xs, "members", "b", "part"]))
    visits = visits.select(*(F.col(c).alias(c) for c in ["id", *xs, "reach", "b", "part"]))

    def away(left: pa.Table, right: pa.Table) -> pa.Table:
        size, flat = _members(left)
        x, qx = _columns(left, xs), _columns(right, xs)
        if len(x) and len(qx):
            ids = flat[np.cumsum(size) - size]
            reach = np.minimum(right["reach"].to_numpy(), 1e300)
            q, cand, d2 = search(x, projected(x, dirs), ids, qx, projected(qx, dirs), top, reach, False, width, threshold)
            held, dist, near = _lists(q, cand, d2, len(qx), size, flat, top)
        else:
            held, dist, near = np.zeros(len(qx), int), np.zeros(0), np.zeros(0, np.int64)
        some = held > 0
        return pa.Table.from_arrays([right["id"].combine_chunks().filter(pa.array(some)), _array(held[some], dist, pa.float64()), _array(held[some], near, pa.int64())], names=["id", "d2", "ids"])

    met = hosts.groupBy("b", "part").cogroup(visits.groupBy("b", "part")).applyInArrow(away, "id bigint, d2 array<double>, ids array<bigint>")
    gathered = met.groupBy("id").agg(F.flatten(F.collect_list(F.arrays_zip("d2", "ids"))).alias("more"))
    all_ = first.join(gathered, "id", "left").select(*xs, "members", F.when(F.col("more").isNull(), F.arrays_zip("d2", "ids")).otherwise(F.slice(F.array_sort(F.concat(F.arrays_zip("d2", "ids"), "more")), 1, top)).alias("z"))
    return all_.select(*xs, "members", F.col("z.d2").alias("d2"), F.col("z.ids").alias("ids"))


def neighbour_rows(lists: DataFrame, k: int) -> DataFrame:
    """``id``, ``rank``, ``neighbour`` and ``distance`` of the members in the result of :func:`nearest`."""
    each = lists.select(F.explode("members").alias("id"), F.arrays_zip("ids", "d2").alias("z"))
    each = each.select("id", F.slice(F.filter("z", lambda x: x["ids"] != F.col("id")), 1, k).alias("z"))
    return each.select("id", F.posexplode("z").alias("rank", "n")).select("id", (F.col("rank") + 1).cast("bigint").alias("rank"), F.col("n.ids").alias("neighbour"), F.sqrt("n.d2").alias("distance"))


def neighbours_of(queries: DataFrame, lists: DataFrame, key: str, columns: Sequence[str], k: int) -> DataFrame:
    """``id``, ``rank``, ``neighbour`` and ``distance`` of the rows of ``queries``, found through their vectors in ``lists``.

    Query rows whose vector isn't in the lists have no row; repeated ones count once.
    """
    xs = [f"x{i}" for i in range(len(columns))]
    rows = queries.select(quoted(key).cast("bigint").alias("id"), *((quoted(c).cast("double") + 0.0).alias(a) for a, c in zip(xs, columns))).where("id IS NOT NULL").distinct()
    each = rows.join(lists, xs).select("id", F.arrays_zip("ids", "d2").alias("z")).select("id", F.slice(F.filter("z", lambda x: x["ids"] != F.col("id")), 1, k).alias("z"))
    return each.select("id", F.posexplode("z").alias("rank", "n")).select("id", (F.col("rank") + 1).cast("bigint").alias("rank"), F.col("n.ids").alias("neighbour"), F.sqrt("n.d2").alias("distance"))


def mutual(lists: DataFrame, k: int) -> DataFrame:
    """``a`` and ``b`` (a < b): rows each of which is among the k nearest of the other."""
    n = neighbour_rows(lists, k).select(F.least("id", "neighbour").alias("a"), F.greatest("id", "neighbour").alias("b"))
    return n.groupBy("a", "b").agg(F.count("*").alias("n")).where("n = 2").select("a", "b")
