"""Convergent cross mapping: blocks of predicted rows, grids of library sizes and samples, moments that add up."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelag.functions.skill import LEAST_ERROR, LEAST_PEARSON
from tidelag.operators.neighbors import BLOCK, CELLS, FLOOR, PIECE, PLACES, best, by_group, near_band, numbers
from tidelag.operators.series import ArgumentError, beside, name_list, number_list, numbered


def library_sizes(x) -> list[int]:
    """Three values with an increment below the stop are a range (both ends included), others a list."""
    v = number_list(x)
    if len(v) == 3 and v[2] < v[1]:
        if v[2] < 1:
            raise ArgumentError("the increment of libSizes must be positive")
        return list(range(v[0], v[1] + 1, v[2]))
    return v


@lru_cache(maxsize=8)
def _hashed(rows: int, sample: int, seed) -> np.ndarray:
    """Places in the order of md5(seed:sample:place)."""
    head = hashlib.md5(f"{seed}:{sample}:".encode())

    def digest(i: int) -> bytes:
        h = head.copy()
        h.update(b"%d" % i)
        return h.digest()

    return np.argsort(np.array([digest(i) for i in range(rows)], dtype="S16"), kind="stable") if rows else np.zeros(0, int)


def drawn(rows: int, size: int, sample: int, sampler: str, seed, rng) -> np.ndarray:
    """Library rows (places among the valid rows), in order, without repeats."""
    if sampler == "numpy":
        return np.sort(rng.choice(rows, size=size, replace=False))
    return np.sort(_hashed(rows, sample, seed)[:size])


def cross_mapped(qx: np.ndarray, qt: np.ndarray, x: np.ndarray, t: np.ndarray, y: np.ndarray, k: int, radius: int, floored: bool = False) -> np.ndarray:
    """Predictions (columns of y) of the rows qx at times qt from a library x, t, y in order of time.

    Rows with fewer than k neighbours are NaN, or, if ``floored``, predicted from those they have, the least
    distance being FLOOR at least. Equal distances go to the earlier row, or, if ``floored``, to the nearer in time first.
    """
    out = np.full((len(qx), y.shape[1]), np.nan)
    step = max(1, CELLS // max(1, len(x)))
    for lo in range(0, len(qx), step):
        part = slice(lo, lo + step)
        d2 = np.zeros((len(qx[part]), len(x)))
        for j in range(x.shape[1]):
            off = qx[part, j, None] - x[None, :, j]
            off *= off
            d2 += off
        d2[near_band(qt[part], t, radius)] = np.inf
        q, l = best(d2, k)
        if not len(q):
            continue
        d = np.sqrt(d2[q, l])
        o = np.lexsort((l, np.abs(qt[lo + q] - t[l]), np.round(d, PLACES), q)) if floored else np.lexsort((l, d, q))
        q, l, d = q[o], l[o], d[o]
        new = np.append(True, q[1:] != q[:-1])
        place = np.arange(len(q)) - np.maximum.accumulate(np.where(new, np.arange(len(q)), 0))
        keep = place < k
        q, l, d, place = q[keep], l[keep], d[keep], place[keep]
        start = np.flatnonzero(place == 0)
        size = np.diff(np.append(start, len(q)))
        least = np.repeat(np.minimum.reduceat(d, start), size)
        with np.errstate(all="ignore"):
            w = np.exp(-d / np.maximum(least, FLOOR)) if floored else np.where(least > 0, np.exp(-d / np.where(least > 0, least, 1.0)), (d == 0).astype(float))
        made = np.add.reduceat(w[:, None] * y[l], start) / np.add.reduceat(w, start)[:, None]
        if not floored:
            made[size < k] = np.nan
        out[lo + q[start]] = made
    return out


@dataclass(frozen=True)
class Side:
    """One source: its embedding (columns and shifts) and the columns and rows ahead that it tells."""

    x: tuple[tuple[str, int], ...]
    y: tuple[tuple[str, int], ...]
    k: int
    skip: int = -1


#: What a block of predicted rows adds to the moments of one library: pairs, sums, squares and products, largest
#: error, absolute and squared errors.
SUMS = ("sa", "sb", "saa", "sbb", "sab", "cae", "sq")


def _crossed(base: DataFrame, alias: dict[str, str], sides: list[Side], sizes, per_size: bool, sample: int, radius: int, seed, sampler: str, one: bool, teach: Column | None = None, ok=None, floored: bool = False) -> DataFrame:
    """series, side, lib_size, sample, tgt, pairs, the moments of predictions and observations over all rows.

    A library is drawn from all rows of a side, and each block of rows is predicted from it by itself; only moments
    leave a task. Short series are spread over tasks by library and sample, long ones by their blocks.
    ``sizes(n)`` gives the library sizes of a series of n rows. ``per_size``: every size draws from a new generator.
    """
    wide = max(len(s.x) for s in sides)
    told = max(len(s.y) for s in sides)
    wanted = list(dict.fromkeys(x for s in sides for x in (*s.x, *s.y)))
    name = {x: f"z{i}" for i, x in enumerate(wanted)}
    rows = beside(base, {name[c, s]: (alias[c], s) for c, s in wanted})
    nan = F.lit(float("nan"))

    def one_side(i: int, s: Side) -> Column:
        keep = F.lit(True)
        for x in s.x:
            keep = keep & F.col(name[x]).isNotNull()
        if ok is not None:
            keep = keep & ok(i, lambda x: F.col(name[x]))
        cols = [F.col(name[x]).alias(f"x{j}") for j, x in enumerate(s.x)] + [F.lit(0.0).alias(f"x{j}") for j in range(len(s.x), wide)]
        cols += [F.coalesce(F.col(name[y]), nan).alias(f"y{j}") for j, y in enumerate(s.y)] + [nan.alias(f"y{j}") for j in range(len(s.y), told)]
        return F.struct(F.lit(i).alias("side"), keep.alias("keep"), *cols)

    block, piece = BLOCK, PIECE
    most = 4 * base.sparkSession.sparkContext.defaultParallelism
    blocks = F.floor((F.col("n") - 1) / block).cast("int") + 1
    groups = F.greatest(F.lit(1), F.least(F.lit(sample * 8), F.ceil(F.lit(most) / blocks).cast("int")))
    rows = rows.select("series", "row", "n", (teach if teach is not None else F.lit(True)).alias("teach"), F.explode(F.array(*(one_side(i, s) for i, s in enumerate(sides)))).alias("s"))
    rows = rows.where("s.keep").select("series", "s.side", "row", "n", "teach", *(f"s.x{j}" for j in range(wide)), *(f"s.y{j}" for j in range(told)))
    rows = rows.withColumn("of", groups).withColumn("blk", F.explode(F.sequence(F.lit(0), blocks - 1))).withColumn("grp", F.explode(F.sequence(F.lit(0), F.col("of") - 1)))
    keys = ["series", "side", "blk", "grp"]
    parts = max(1, min(int(base.sparkSession.conf.get("spark.sql.shuffle.partitions")), most))
    turn = F.pmod(F.xxhash64("series"), F.lit(parts)) + (F.col("side") + F.col("blk") * len(sides)) * F.col("of") + F.col("grp")
    rows = rows.repartitionById(parts, F.pmod(turn, F.lit(parts)).cast("int")).sortWithinPartitions(*keys, "row")
    schema = "series string, side int, lib_size int, sample int, tgt int, pairs bigint, sa double, sb double, saa double, sbb double, sab double, cae double, sq double, mae double"
    names = [c.split()[0] for c in schema.split(", ")]

    def unit(key: tuple, row, n: int, teaches, x, y, of: int) -> list[tuple]:
        series, side, blk, grp = key
        s = sides[side]
        x, y = x[:, : len(s.x)], y[:, : len(s.y)]
        lib_rows = np.flatnonzero(teaches)
        own = np.flatnonzero((row >= blk * block) & (row < (blk + 1) * block))
        seen = y[own]
        # a value of the column itself: sums of squares about it lose no places, and a flat column has none
        some = np.isfinite(y)
        centre = np.where(some.any(axis=0), y[some.argmax(axis=0), np.arange(y.shape[1])], 0.0)
        out = []
        rng = np.random.default_rng(np.random.SeedSequence(seed))
        of_series = sizes(n)
        if one and of_series and max(of_series) > n:
            raise ArgumentError(f"libSizes reach {max(of_series)} in a series of {n} rows")
        for a, size in enumerate(of_series):
            if per_size:
                rng = np.random.default_rng(np.random.SeedSequence(seed))
            m = min(size, len(lib_rows))
            k = s.k if floored else min(s.k, m - 1)
            for j in range(sample):
                mine = (a * sample + j) % of == grp
                usable = k >= 1 and (floored or len(lib_rows) >= s.k + 1) and m > 0
                lib = lib_rows[drawn(len(lib_rows), m, j, sampler, seed, rng)] if usable and (mine or sampler == "numpy") else None
                if not mine:
                    continue
                made = cross_mapped(x[own], row[own], x[lib], row[lib], y[lib], k, radius, floored) if usable and len(own) else np.full(seen.shape, np.nan)
                for g in range(y.shape[1]):
                    if g == s.skip:
                        continue
                    both = np.isfinite(made[:, g]) & np.isfinite(seen[:, g])
                    p, o = made[both, g] - centre[g], seen[both, g] - centre[g]
                    e = o - p
                    out.append((series, side, size, j, g, len(e), p.sum(), o.sum(), p @ p, o @ o, p @ o, np.abs(e).sum(), e @ e, e.max() if len(e) else None))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        at = None

        def close() -> Iterator[pa.RecordBatch]:
            if held:
                row, n, teaches, x, y, of = (np.concatenate(z) for z in zip(*held))
                got = unit(at, row, int(n[0]), teaches, x, y, int(of[0]))
                if got:
                    yield pa.RecordBatch.from_pylist([dict(zip(names, g)) for g in got], schema=arrow)
            held.clear()

        arrow = pa.schema([(c.split()[0], {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "double": pa.float64()}[c.split()[1]]) for c in schema.split(", ")])
        for _, t, start in by_group(batches, keys, piece):
            cols = [t["row"].to_numpy(), t["n"].to_numpy(), t["teach"].to_numpy(), numbers(t, [f"x{j}" for j in range(wide)]), numbers(t, [f"y{j}" for j in range(told)]), t["of"].to_numpy()]
            first = np.flatnonzero(start)
            labels = [t[c].take(pa.array(first)).to_pylist() for c in keys]
            for i, (a, b) in enumerate(zip(first, np.append(first[1:], t.num_rows))):
                key = tuple(v[i] for v in labels)
                if key != at:
                    yield from close()
                    at = key
                held.append([c[a:b] for c in cols])
        yield from close()

    made = rows.mapInArrow(run, schema)
    return made.groupBy("series", "side", "lib_size", "sample", "tgt").agg(F.sum("pairs").alias("pairs"), *(F.sum(c).alias(c) for c in SUMS), F.max("mae").alias("mae"))


def _correlation(flat: Column | None = None) -> Column:
    """Correlation from the moments; ``flat`` where either side does not vary."""
    n = F.col("pairs")
    va, vb = F.col("saa") - F.col("sa") * F.col("sa") / n, F.col("sbb") - F.col("sb") * F.col("sb") / n
    still = (va <= F.col("saa") * 1e-14) | (vb <= F.col("sbb") * 1e-14)
    return F.when(still, flat if flat is not None else F.lit(None).cast("double")).otherwise((F.col("sab") - F.col("sa") * F.col("sb") / n) / F.sqrt(va * vb))


def _rho() -> Column:
    """Correlation of the complete pairs: null below three, 0 without variation."""
    return F.when(F.col("pairs") >= LEAST_PEARSON, _correlation(F.lit(0.0)))


def _label(at: Column, names: Sequence[str]) -> Column:
    return F.element_at(F.array(*map(F.lit, names)), at + 1)


def _checked(columns, target, lib_sizes, sample: int, E: int, tau: int, embedded: bool) -> tuple[list[str], list[str], list[int], int]:
    columns, target = name_list(columns), name_list(target)
    sizes = library_sizes(lib_sizes)
    if embedded:
        E = max(len(columns), len(target))
    if not columns or not target or E < 1 or tau == 0:
        raise ArgumentError("columns, target, a positive E and a tau other than 0 are needed")
    if not sizes or sample < 1:
        raise ArgumentError("libSizes and a positive number of samples are needed")
    if min(sizes) < E + 2:
        raise ArgumentError(f"libSizes must be at least {E + 2}")
    return columns, target, sizes, E


def ccm(df: DataFrame, columns, target, lib_sizes, sample: int = 30, E: int = 1, Tp: int = 0, knn: int = 0, tau: int = -1, radius: int = 0, seed=None, embedded: bool = False, valid: str | None = None, time=None, series=None, order=(), sampler: str = "numpy", strict: bool = False) -> DataFrame:
    """series, direction, lib_size, sample, rho: skill of either side's embedding in telling the other side.

    Directions are 'columns[0]:target[0]' (columns' embedding predicts the target) and the reverse. Rows count whose
    embedding is complete, that are ``valid``, whose own first variable is there and whose target Tp rows on is there. A
    library is a random draw of the valid rows; each valid row is predicted from its nearest library rows, itself and
    those within the exclusion radius left out; a row with fewer than k is not predicted.

    ``sampler`` 'numpy' draws with numpy's generator, every library size and direction beginning with the same stream;
    'hash' draws by the order of md5(seed:sample:place), which any engine can repeat. A series with fewer than k+1 valid
    rows has null rho. A series with fewer rows than a library size uses what it has; with ``strict`` the task that
    meets one raises ValueError.
    """
    columns, target, sizes, E = _checked(columns, target, lib_sizes, sample, E, tau, embedded)
    base, alias = numbered(df, [*columns, *target], time, series, order, {"v": F.coalesce(F.expr(valid).cast("boolean"), F.lit(False))} if valid else {})
    shifts = [0] if embedded else [d * tau for d in range(E)]
    k = knn or E + 1
    pairs = [(columns, target), (target, columns)]
    sides = [Side(tuple((c, s) for c in own for s in shifts), ((other[0], Tp), (own[0], 0)), k, 1) for own, other in pairs]

    def ok(i: int, at) -> Column:
        there = at((pairs[i][1][0], Tp)).isNotNull() & at((pairs[i][0][0], 0)).isNotNull()
        return there & F.col("v") if valid else there

    made = _crossed(base, alias, sides, lambda n: sizes, True, sample, radius, seed, sampler, strict, ok=ok)
    return made.select("series", _label(F.col("side"), [f"{a[0]}:{b[0]}" for a, b in pairs]).alias("direction"), "lib_size", "sample", _rho().alias("rho"))


def lib_means(rows: DataFrame, columns, target, variances: bool = False, keys: Sequence[str] = ()) -> DataFrame:
    """LibSize and the mean rho of both directions, a row a library size; with ``variances`` the variance over samples too."""
    a, b = name_list(columns)[0], name_list(target)[0]
    both = [f"{a}:{b}", f"{b}:{a}"]
    of = lambda d: F.when(F.col("direction") == d, F.col("rho"))
    out = [F.avg(of(d)).alias(d) for d in both] + ([F.var_pop(of(d)).alias(f"{d}_var") for d in both] if variances else [])
    return rows.groupBy(*keys, F.col("lib_size").alias("LibSize")).agg(*out)


def ccm_matrix(df: DataFrame, columns, E, lib_sizes=None, p_lib_sizes=(10, 20, 80, 90), Tp: int = 0, tau: int = -1, radius: int = 0, sample: int = 30, seed=None, time=None, series=None, order=(), sampler: str = "numpy") -> DataFrame:
    """series, source, target, lib_size, rho for all ordered pairs of columns; rho is the mean over samples, null for a column itself.

    Neighbours and weights of a source are found once for each library and applied to all targets. ``E`` is one number or
    one for each column. Library sizes come from ``lib_sizes`` or as percentages of the rows, at least 2 and at most
    all rows. Rows whose target is missing stay in the library: what they would tell is left out pair by pair.
    """
    columns = name_list(columns)
    es = [int(E)] * len(columns) if np.isscalar(E) else [int(e) for e in E]
    if len(es) != len(columns) or min(es, default=0) < 1 or tau == 0:
        raise ArgumentError("a positive E for each column and a tau other than 0 are needed")
    base, alias = numbered(df, columns, time, series, order)
    fixed, percent = number_list(lib_sizes), list(p_lib_sizes)
    sides = [Side(tuple((c, d * tau) for d in range(e)), tuple((y, Tp) for y in columns), e + 1) for c, e in zip(columns, es)]

    def sizes(n: int) -> list[int]:
        return sorted({min(max(2, s), n) for s in (fixed or [int(q / 100 * n) for q in percent])})

    made = _crossed(base, alias, sides, sizes, False, sample, radius, seed, sampler, False)
    rho = made.withColumn("rho", _rho()).groupBy("series", "side", "lib_size", "tgt").agg(F.avg("rho").alias("rho"))
    return rho.select("series", _label(F.col("side"), columns).alias("source"), _label(F.col("tgt"), columns).alias("target"), "lib_size", F.when(F.col("side") != F.col("tgt"), F.col("rho")).alias("rho"))


def ccm_projected(df: DataFrame, columns, target, lib_sizes, sample: int = 30, E: int = 1, Tp: int = 0, knn: int = 0, tau: int = -1, radius: int = 0, seed=None, embedded: bool = False, time=None, series=None, order=(), strict: bool = False) -> DataFrame:
    """series, direction, lib_size, sample, rho, MAE, CAE, RMSE: cross mapping by simplex projection of all rows.

    The older form: the library is a random draw of the library rows, every row is predicted by projection with the
    least distance floored, the forecasts are moved Tp rows on and compared with what was observed there (skill
    rounded to five places). Both directions draw from the same stream, one library size after the other.
    """
    columns, target, sizes, E = _checked(columns, target, lib_sizes, sample, E, tau, embedded)
    base, alias = numbered(df, [*columns, *target], time, series, order)
    shifts = [0] if embedded else [d * tau for d in range(E)]
    shift = 0 if embedded else abs(tau) * (E - 1)
    row, n = F.col("row"), F.col("n")
    teach = (row >= (0 if tau > 0 else shift) + (0 if embedded else max(0, -Tp - 1))) & (row < n - (0 if tau < 0 else shift) - max(0, Tp)) & (row + Tp >= 0) & (row + Tp < n)
    pairs = [(columns, target), (target, columns)]
    sides = [Side(tuple((c, s) for s in shifts for c in own), ((other[0], Tp),), knn or len(own) * len(shifts) + 1) for own, other in pairs]
    made = _crossed(base, alias, sides, lambda n_: sizes, False, sample, radius, seed, "numpy", strict, teach, floored=True)
    some = lambda c: F.when(F.col("pairs") >= LEAST_ERROR, F.bround(c, 5))
    return made.select(
        "series", _label(F.col("side"), [f"{a[0]}:{b[0]}" for a, b in pairs]).alias("direction"), "lib_size", "sample",
        some(_correlation()).alias("rho"), some(F.col("mae")).alias("MAE"), some(F.col("cae")).alias("CAE"), some(F.sqrt(F.col("sq") / F.col("pairs"))).alias("RMSE"),
    )
