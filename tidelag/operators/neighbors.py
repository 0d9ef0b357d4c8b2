"""k nearest library vectors of every predicted vector: blocks of predicted rows meet the library in pieces.

Predicted rows of a series are cut into blocks; a block's task gets the block and streams the library past it, keeping
the k best so far. No pair leaves the task and no series is held by one. All tasks of a plan (a sweep's values, a
multiview's combinations) are worked on where the rows lie: squared differences are shared by tasks whose
embeddings begin alike, and the whole distance by those that differ only in horizon, radius, k or rows. Blocks of a long
series are wider, and a tree of the library tells which of it is near (:mod:`tidelag.operators.tree`).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelag.operators import tree
from tidelag.operators.series import ArgumentError, Prepared, Task, lib_mask, lib_rows, obs_mask, pred_mask

#: Predicted rows of a block, library rows of a piece, and distances that are held at once.
BLOCK, PIECE, CELLS = 1024, 1 << 16, 1 << 17
#: Blocks of a long series: how many it is cut into, rows of one at most, rows that a task holds before it searches them,
#: predicted rows that are searched together, and neighbours up to which a tree is used.
SHARE, WIDE, HELD, SUB, TREE_K = 16, 1 << 19, 3 << 19, 1 << 14, 64
#: Fixed value: least distance that weights are scaled by.
FLOOR = 1e-6
#: Places that distances are compared to.
PLACES = 12


def streamed(p: Prepared, wider: bool = False) -> DataFrame:
    """Rows of use, by (series, blk): first the rows of the block itself (own), then the library of the whole series.

    Rows of the library stand in every block that a task predicts rows of, others only in their own. With ``wider`` a
    series of more than SHARE blocks is cut into so many, unless they pass WIDE rows.
    """
    spark = p.wide.sparkSession
    rule = lambda t: (t.lib, t.tp, t.tau, t.e, t.embedded)
    teach = F.lit(False)
    for t in {rule(t): t for t in p.tasks}.values():
        teach = teach | lib_rows(t)
    n = F.col("n")
    width = F.greatest(F.lit(BLOCK), F.least(F.lit(max(BLOCK, WIDE)), F.ceil(n / (SHARE * BLOCK)) * BLOCK)) if wider else F.lit(BLOCK)

    def predicted(b):
        ok = F.lit(False)
        for spans in {t.pred for t in p.tasks}:
            for lo, hi in spans or ((1, n),):
                ok = ok | ((b * width <= hi - 1) & (b * width + (width - 1) >= lo - 1))
        return ok

    own = F.floor(F.col("row") / width).cast("int")
    blocks = F.when(teach, F.sequence(F.lit(0), F.floor((n - 1) / width).cast("int"))).otherwise(F.array(own))
    rows = p.wide.withColumn("blk", F.explode(F.filter(blocks, predicted)))
    rows = rows.withColumn("own", F.col("blk") == own)
    parts = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism))
    # the blocks of a series go round the partitions, so that each has as many
    rows = rows.repartitionById(parts, F.pmod(F.pmod(F.xxhash64("series"), F.lit(parts)) + F.col("blk"), F.lit(parts)).cast("int"))
    return rows.sortWithinPartitions("series", "blk", F.col("own").desc(), "row")


@dataclass
class Piece:
    """Rows of one (series, blk)."""

    series: str | None
    row: np.ndarray
    n: int
    own: np.ndarray
    x: np.ndarray
    y: np.ndarray
    valid: np.ndarray
    teaches: np.ndarray
    predicted: np.ndarray
    only: set[int] | None

    def part(self, a: int, b: int) -> Piece:
        s = slice(a, b)
        return Piece(self.series, self.row[s], self.n, self.own[s], self.x[s], self.y[s], self.valid[s], self.teaches[s], self.predicted[s], self.only)

    @staticmethod
    def joined(parts: list[Piece]) -> Piece:
        """Pieces of one group as one, by row."""
        at = np.argsort(np.concatenate([p.row for p in parts]), kind="stable")  # own rows stand before the others
        every = lambda f: np.concatenate([getattr(p, f) for p in parts])[at]
        return Piece(parts[0].series, every("row"), parts[0].n, *(every(f) for f in ("own", "x", "y", "valid", "teaches", "predicted")), parts[0].only)


def changes(t: pa.Table, keys: Sequence[str]) -> np.ndarray:
    """Marks rows whose key differs from that of the row before, the first row always."""
    new = np.zeros(t.num_rows, bool)
    new[:1] = True
    for c in keys:
        col = t[c].combine_chunks()
        v = col.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False) if pa.types.is_string(col.type) or col.null_count else col.to_numpy(zero_copy_only=False)
        new[1:] |= v[1:] != v[:-1]
    return new


def by_group(batches: Iterator[pa.RecordBatch], keys: Sequence[str], piece: int) -> Iterator[tuple[tuple, pa.Table, np.ndarray]]:
    """Tables of whole groups and, at each one's end, of the beginning of the next; with the marks of :func:`changes`.

    Yields (key of the first row, table, starts). A group longer than a piece comes in several tables.
    """
    held: list[pa.RecordBatch] = []
    rows = 0

    def whole() -> pa.Table:
        return pa.Table.from_batches(held).combine_chunks()

    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        rows += b.num_rows
        if rows >= piece:
            t = whole()
            start = changes(t, keys)
            cut = int(np.flatnonzero(start)[-1])
            if cut == 0:
                yield tuple(t[c][0].as_py() for c in keys), t, start
                held, rows = [], 0
            else:
                yield tuple(t[c][0].as_py() for c in keys), t.slice(0, cut), start[:cut]
                left = t.slice(cut)
                held, rows = left.to_batches(), left.num_rows
    if rows:
        t = whole()
        yield tuple(t[c][0].as_py() for c in keys), t, changes(t, keys)


def numbers(t: pa.Table, names: Sequence[str]) -> np.ndarray:
    """Columns as a matrix of doubles, a row a row; null is NaN."""
    out = np.empty((t.num_rows, len(names)))
    for i, c in enumerate(names):
        out[:, i] = t[c].to_numpy()
    return out


def pieces(batches: Iterator[pa.RecordBatch], dims: int, ys: int, valid: int, piece: int) -> Iterator[tuple[bool, Piece]]:
    """(whether a new group begins, piece); the first piece of a group holds all of its own rows, unless its block is wider than a piece."""
    last = None
    for key, t, start in by_group(batches, ["series", "blk"], piece):
        at = np.flatnonzero(start)
        names = t["series"].take(pa.array(at)).to_pylist()
        row, n, own = t["row"].to_numpy(), t["n"].to_numpy(), t["own"].to_numpy()
        x, y = numbers(t, [f"d{i}" for i in range(dims)]), numbers(t, [f"y{i}" for i in range(ys)])
        v = np.stack([t[f"v{i}"].to_numpy() for i in range(valid)], axis=1).astype(bool) if valid else np.zeros((len(row), 0), bool)
        yes = np.ones(len(row), bool)
        teaches = t["lok"].to_numpy() if "lok" in t.column_names else yes
        predicted = t["pok"].to_numpy() if "pok" in t.column_names else yes
        for a, b, s in zip(at, np.append(at[1:], len(row)), names):
            only = set(t["only"][int(a)].as_py() or ()) if "only" in t.column_names else None
            first = not (a == 0 and key == last)
            yield first, Piece(s, row[a:b], int(n[a]), own[a:b], x[a:b], y[a:b], v[a:b], teaches[a:b], predicted[a:b], only)
        last = (names[-1], t["blk"][int(at[-1])].as_py())


def chosen(p: Piece, t: Task, slots: list[int], v: int | None, lib: bool) -> np.ndarray:
    """Places of the rows of a piece that a task learns from, or predicts."""
    ok = lib_mask(t, p.row, p.n) & p.teaches if lib else pred_mask(t, p.row, p.n) & p.predicted & p.own
    if lib and v is not None:
        ok = ok & p.valid[:, v]
    for s in slots:
        there = ~np.isnan(p.x[:, s])
        if not t.ignore_nan and (ok & ~there).any():
            raise ArgumentError("the embedding holds missing values (ignoreNan)")
        ok = ok & there
    return np.flatnonzero(ok)


def checked(t: Task, held: int, k: int, strict: bool) -> None:
    """Raises where the rows that meet a task's condition are fewer than the neighbours it asks for."""
    if strict and t.valid and held < max(1, k):
        raise ArgumentError(f"the valid library of {held} rows is smaller than knn={k}")


def near_band(prow: np.ndarray, lrow: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (predicted row, library row) of the pairs within the radius; library rows ascend."""
    lo, hi = np.searchsorted(lrow, prow - radius, "left"), np.searchsorted(lrow, prow + radius, "right")
    c = hi - lo
    return np.repeat(np.arange(len(prow)), c), np.arange(int(c.sum())) - np.repeat(np.cumsum(c) - c, c) + np.repeat(lo, c)


def view(at: np.ndarray, n: int) -> slice | np.ndarray:
    """Places as a slice where they are one stretch, which copies nothing."""
    return slice(int(at[0]), int(at[-1]) + 1) if len(at) and int(at[-1]) - int(at[0]) + 1 == len(at) else at


def trimmed(q, l, d, gap, y, k: int):
    """The k best of each predicted row by (rounded distance, nearness in time, row), in that order, and their place."""
    o = np.lexsort((l, gap, np.round(d, PLACES), q))
    q = q[o]
    new = np.ones(len(q), bool)
    new[1:] = q[1:] != q[:-1]
    place = np.arange(len(q)) - np.maximum.accumulate(np.where(new, np.arange(len(q)), 0))
    keep = place < k
    o = o[keep]
    return q[keep], l[o], d[o], gap[o], y[o], place[keep]


def best(d2: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the k least of each row, and of all that equal the k-th to within rounding; inf never counts."""
    if k < d2.shape[1]:
        kth = np.partition(d2, k - 1, axis=1)[:, k - 1]
        most = np.where(np.isfinite(kth), (np.sqrt(kth) + 2 * 10.0**-PLACES) ** 2 * (1 + 1e-15), np.finfo(float).max)
        at = np.flatnonzero(d2 <= most[:, None])
    else:
        at = np.flatnonzero(d2 < np.inf)
    return np.divmod(at, d2.shape[1])


def searched(p: Prepared, targets: list[list[int]], finish: Callable, schema: str) -> DataFrame:
    """Runs the search; ``finish(task, own rows, q, l, d, y, place)`` makes the columns put out for one task of a block.

    ``targets`` are, for each task, the places in ``p.ys`` of what is taken from its neighbours.
    """
    tasks, strict = p.tasks, p.strict
    slots = [p.slots(t) for t in tasks]
    valid = [p.valid.index(t.valid) if t.valid else None for t in tasks]
    order = sorted(range(len(tasks)), key=lambda i: (slots[i], i))
    sizes = len(p.dims), len(p.ys), len(p.valid), PIECE
    cells, part = CELLS, max(1, CELLS // 16)
    names = [c.split()[0] for c in schema.split(", ")]
    types = {c.split()[0]: {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "double": pa.float64()}[c.split()[1]] for c in schema.split(", ")}

    def search(block: Piece, mine: dict, piece: Piece, kept: dict, met: dict) -> None:
        """Adds the neighbours in a piece of the library to those kept."""
        libs: dict = {}
        for i in mine:
            key = (tasks[i].lib, tasks[i].valid, tasks[i].tp, tasks[i].tau, tasks[i].e, tasks[i].embedded, tuple(slots[i]))
            libs[i] = libs.get(key) if key in libs else chosen(piece, tasks[i], slots[i], valid[i], True)
            libs[key] = libs[i]
            met[i] = met.get(i, 0) + len(libs[i])
        step = max(1, cells // max(1, len(piece.row)))
        for a in range(0, len(block.row), step):
            x = block.x[a : a + step]
            stack: list[tuple[int, np.ndarray]] = []
            for i in order:
                if i not in mine or not len(libs[i]):
                    continue
                q = mine[i]
                q = q[np.searchsorted(q, a) : np.searchsorted(q, a + step)] - a
                if not len(q):
                    continue
                depth = 0
                while depth < len(stack) and depth < len(slots[i]) and stack[depth][0] == slots[i][depth]:
                    depth += 1
                del stack[depth:]
                for s in slots[i][depth:]:
                    off = x[:, s, None] - piece.x[None, :, s]
                    off *= off
                    stack.append((s, stack[-1][1] + off if stack else off))
                d2 = stack[len(slots[i]) - 1][1]
                l = libs[i]
                d2 = d2[view(q, len(x))][:, view(l, len(piece.row))]
                prow, lrow = block.row[a + q], piece.row[l]
                bi, bj = near_band(prow, lrow, tasks[i].radius)
                if len(bi):
                    d2 = d2.copy()
                    d2[bi, bj] = np.inf
                r, c = best(d2, tasks[i].knn)
                d = np.sqrt(d2[r, c])
                new = (a + q[r], lrow[c], d, np.abs(prow[r] - lrow[c]), piece.y[l[c]][:, targets[i]])
                kept.setdefault((i, 0), []).append(trimmed(*new, tasks[i].knn)[:5])
                if len(kept[i, 0]) > 1 and sum(len(z[0]) for z in kept[i, 0]) > cells:
                    kept[i, 0] = [trimmed(*(np.concatenate(z) for z in zip(*kept[i, 0])), tasks[i].knn)[:5]]

    def predicted_rows(block: Piece) -> dict:
        return {i: q for i, t in enumerate(tasks) if block.only is None or i in block.only for q in [chosen(block, t, slots[i], valid[i], False)] if len(q)}

    def search_tree(block: Piece, mine: dict, subs: dict, piece: Piece, kept: dict, met: dict) -> None:
        """As search, for many predicted rows and a large piece of the library."""
        trees: dict = {}
        for i in mine:
            t = tasks[i]
            q, l = mine[i], chosen(piece, t, slots[i], valid[i], True)
            met[i] = met.get(i, 0) + len(l)
            if not len(l):
                continue
            x, lx, lrow = np.stack([block.x[q, c] for c in slots[i]]), np.stack([piece.x[l, c] for c in slots[i]]), piece.row[l]
            around = np.searchsorted(lrow, block.row[q] + t.radius, "right") - np.searchsorted(lrow, block.row[q] - t.radius, "left")
            k = t.knn + int(around.max())  # as many points may have rows within the radius only
            key = (tuple(slots[i]), t.lib, t.valid, t.tp, t.tau, t.e, t.embedded, max(tree.LEAF, k))
            known = k <= TREE_K and tree.fit(x) and tree.fit(lx)
            if known and key not in trees:
                trees[key] = tree.grown(lx, k)
            if i not in subs:
                at, begin = tree.halved(x, max(1, SUB // 2)) if known else (np.arange(len(q)), np.arange(0, len(q), BLOCK))
                subs[i] = np.split(at, begin[1:])
            for s, at in enumerate(subs[i]):
                if known:
                    for of, point, d2 in tree.closest(trees[key], x[:, at], k, 2 * 10.0**-PLACES, cells, best):
                        pair, near = tree.rows_near(trees[key], lrow, block.row[q[at[of]]], point, t.knn, t.radius)
                        a = q[at[of[pair]]]
                        new = (a, lrow[near], np.sqrt(d2[pair]), np.abs(block.row[a] - lrow[near]), piece.y[l[near]][:, targets[i]])
                        kept.setdefault((i, s), []).append(trimmed(*new, t.knn))
                else:
                    some, found = np.sort(q[at]), {}
                    sub = block.part(int(some[0]), int(some[-1]) + 1)
                    for lo in range(0, len(piece.row), part):
                        search(sub, {i: some - some[0]}, piece.part(lo, lo + part), found, {})
                    kept.setdefault((i, s), []).extend((z[0] + some[0], *z[1:]) for z in found.get((i, 0), ()))
                if len(kept.get((i, s), ())) > 1:
                    kept[i, s] = [trimmed(*(np.concatenate(z) for z in zip(*(f[:5] for f in kept[i, s]))), t.knn)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[dict] = []
        rows = 0
        block = mine = kept = met = subs = None
        held: list[Piece] = []

        def search_held() -> None:
            nonlocal block, mine
            if not held:
                return
            piece = Piece.joined(held)
            held.clear()
            if block is None:
                block = piece.part(*(int(z) for z in np.searchsorted(piece.row, [piece.row[piece.own].min(), piece.row[piece.own].max() + 1]))) if piece.own.any() else piece.part(0, 0)
                mine = predicted_rows(block)
            if mine:
                search_tree(block, mine, subs, piece, kept, met)

        def close() -> None:
            nonlocal rows
            search_held()
            for i in mine or ():
                checked(tasks[i], met.get(i, 0), tasks[i].knn, strict)
            for (i, _), found in (kept or {}).items():
                t = found[0] if len(found) == 1 else tuple(np.concatenate(z) for z in zip(*found))
                got = finish(i, block, *(t if len(t) == 6 else trimmed(*t, tasks[i].knn)))
                m = len(got["p"])
                if m:
                    out.append({"series": pa.array([block.series] * m, pa.string()), "task": pa.array(np.full(m, i, np.int32)), **{c: pa.array(v, types[c], from_pandas=True) for c, v in got.items()}})
                    rows += m

        def put() -> Iterator[pa.RecordBatch]:
            nonlocal rows
            if out:
                yield pa.RecordBatch.from_arrays([pa.concat_arrays([o[c] for o in out]) for c in names], names=names)
            out.clear()
            rows = 0

        for first, piece in pieces(batches, *sizes):
            if first:
                close()
                if rows > 1 << 14:
                    yield from put()
                block = mine = None
                kept, met, subs = {}, {}, {}
                if piece.n <= SHARE * BLOCK:
                    block = piece.part(0, int(piece.own.sum()))
                    mine = predicted_rows(block)
            if piece.n > SHARE * BLOCK:
                held.append(piece)
                if sum(len(h.row) for h in held) >= HELD and not piece.own[-1]:
                    search_held()
            elif mine:
                piece = Piece.joined([piece])
                for lo in range(0, len(piece.row), part):
                    search(block, mine, piece.part(lo, lo + part), kept, met)
        close()
        yield from put()

    return streamed(p, True).mapInArrow(run, schema)


def nearest(p: Prepared) -> DataFrame:
    """The k nearest of each predicted row: series, task, p, rank, l, dist, y; equal distances go to the nearer row in time, then the earlier."""

    def finish(i, block, q, l, d, gap, y, place):
        return {"p": block.row[q], "rank": place + 1, "l": l, "dist": d, "y": y[:, 0]}

    targets = [[p.ys.index((t.target, t.tp))] for t in p.tasks]
    return searched(p, targets, finish, "series string, task int, p bigint, rank int, l bigint, dist double, y double")


def weighted(p: Prepared, targets: list[list[tuple[str, int]]] | None = None) -> DataFrame:
    """series, task, tgt, p, n_near, obs, predicted and variance: exponentially weighted mean of the neighbours' targets.

    ``tgt`` is the place of the target in the task's list (of its own target alone if None). A row without a
    neighbour has no row here; a neighbour without a target makes the prediction null.
    """
    tasks = p.tasks
    at = [[p.ys.index(y) for y in (targets[i] if targets else [(t.target, t.tp)])] for i, t in enumerate(tasks)]

    def finish(i, block, q, l, d, gap, y, place):
        start = np.flatnonzero(place == 0)
        if not len(start):
            return {"p": start}
        size = np.diff(np.append(start, len(q)))
        w = np.exp(-d / np.repeat(np.maximum(np.minimum.reduceat(d, start), FLOOR), size))
        total = np.add.reduceat(w, start)
        own = q[start]
        seen = obs_mask(tasks[i], block.row[own], block.n)
        cols: dict[str, list] = {c: [] for c in ("tgt", "p", "n_near", "obs", "predicted", "variance")}
        for j, place_ in enumerate(at[i]):
            m = np.add.reduceat(w * y[:, j], start) / total
            off = y[:, j] - np.repeat(m, size)
            obs = np.where(seen, block.y[own, place_], np.nan)
            for c, v in zip(cols, (np.full(len(own), j), block.row[own], size, obs, m, np.add.reduceat(w * off * off, start) / total)):
                cols[c].append(v)
        return {c: np.concatenate(v) for c, v in cols.items()}

    return searched(p, at, finish, "series string, task int, tgt int, p bigint, n_near bigint, obs double, predicted double, variance double")
