"""Irregular readings onto a regular grid, missing cells filled by low-rank factorisation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelag.shared import number, quoted, ship, written

#: Grid steps of one block of the source-by-time matrix; a source's part of a block is one row of it.
BLOCK = 4096
#: Blocks up to which the step factors are sent along with the tasks; beyond, they are joined to the rows.
FEW_BLOCKS = 64
STATUS = ["observed", "filled", "unsupported"]
OBSERVED, FILLED, UNSUPPORTED = range(3)
DAY = 86_400
#: Fixed value: the Monday from which weeks are counted, in days from 1970-01-01.
MONDAY = -3


def _solve(a: np.ndarray, b: np.ndarray, ridge: np.ndarray) -> np.ndarray:
    """Solutions of many small ridge systems: a is (n, r, r), b (n, r), ridge (r,)."""
    return np.linalg.solve(a + np.diag(ridge)[None], b[..., None])[..., 0]


def _flat(b: pa.RecordBatch, name: str) -> np.ndarray:
    return b.column(name).flatten().to_numpy(zero_copy_only=False)


def _cells(b: pa.RecordBatch, values: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row number, step within the block and value of every observed cell."""
    size = np.diff(b.column("steps").offsets.to_numpy())
    return np.repeat(np.arange(b.num_rows), size), _flat(b, "steps").astype(np.int64), _flat(b, values)


def _source_factors(row: np.ndarray, step: np.ndarray, val: np.ndarray, n: int, w: np.ndarray, ridge: np.ndarray) -> np.ndarray:
    """Least-squares factors of n sources given the factors of the steps."""
    r = w.shape[1]
    f = w[step]
    a = np.empty((n, r, r))
    b = np.empty((n, r))
    for i in range(r):
        b[:, i] = np.bincount(row, f[:, i] * val, n)
        for j in range(i, r):
            a[:, i, j] = a[:, j, i] = np.bincount(row, f[:, i] * f[:, j], n)
    return _solve(a, b, ridge)


def _first_factors(block: int, rank: int, period: float) -> np.ndarray:
    """Start of the step factors: a constant, then waves of the period and its parts."""
    t = np.arange(BLOCK) + block * BLOCK
    w = np.ones((BLOCK, rank))
    for k in range(1, rank):
        angle = 2 * np.pi * t * ((k + 1) // 2) / period
        w[:, k] = np.sin(angle) if k % 2 else np.cos(angle)
    return w


def regular(
    df: DataFrame,
    source: str,
    time: str,
    value: str,
    key: str,
    step: int = 7 * DAY,
    origin: int = MONDAY * DAY,
    rank: int = 3,
    rounds: int = 4,
    ridge: float = 2.0,
    period: float = 52.1775,
    support: int = 8,
) -> DataFrame:
    """A row for every step from the first to the last one with a reading of each source.

    A reading is a row with a time and a value (not null, not NaN). A step with readings keeps the last one's value
    exactly (latest time, then highest ``key``, then highest value) and has status 'observed'. The others are
    filled from a factorisation of the source-by-step matrix (signed logarithms, less each source's mean), found by
    alternating least squares: status 'filled'. A cell is left null with status 'unsupported' if its source has
    fewer than ``support`` observed steps in the block, or no source has one at that step.

    The matrix is cut into blocks of BLOCK steps, each with its own factors: a source's row of a block is bounded,
    however many readings it has. Sources are solved where they lie; the sums for the step factors are added
    up before the shuffle.

    :param time: TIMESTAMP column; steps are ``step`` seconds long and counted from ``origin`` seconds after 1970.
    :returns: source, step (BIGINT number), start (TIMESTAMP), value, status, n_readings (rows that repeat a reading
        key at the same time count once). A null source is a source of its own; an empty table gives no rows.
    """
    ship(df.sparkSession)
    at = F.floor((F.unix_micros(quoted(time)) - F.lit(origin * 1_000_000)) / F.lit(step * 1_000_000))
    rows = df.select(quoted(source).alias("src"), F.unix_micros(quoted(time)).alias("t"), quoted(key).alias("id"), number(quoted(value)).alias("v"), at.alias("step")).where("t IS NOT NULL AND v IS NOT NULL")
    cells = rows.groupBy("src", "step", "t", "id").agg(F.max("v").alias("v")).groupBy("src", "step").agg(F.max(F.struct("t", "id", "v")).alias("last"), F.count("*").alias("n"))
    cells = cells.select("src", "step", F.col("last.v").alias("v"), F.col("n"), F.floor(F.col("step") / BLOCK).cast("int").alias("block"))
    y = F.signum("v") * F.log1p(F.abs("v"))
    # a source's part of a block: at most BLOCK cells
    cell = F.struct((F.col("step") - F.col("block") * BLOCK).cast("int").alias("s"), y.alias("y"), F.col("v").alias("v"), F.col("n").alias("n"))
    matrix = written(cells.groupBy("src", "block").agg(F.min("step").alias("lo"), F.max("step").alias("hi"), F.count("*").alias("cells"), F.sum(y).alias("sum"), F.sum(y * y).alias("sq"), F.sort_array(F.collect_list(cell)).alias("c")))
    mean = F.sum("sum") / F.sum("cells")
    var = F.sum("sq") / F.sum("cells") - mean * mean
    ends = matrix.groupBy("src").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), mean.alias("mean"), F.when(var > 1e-12, F.sqrt(var)).otherwise(F.lit(1.0)).alias("sd"))
    # the blocks between the first and the last reading that hold none are rows too
    spans = ends.select(F.col("src").alias("_src"), "lo", "hi", "mean", "sd", F.explode(F.sequence(F.floor(F.col("lo") / BLOCK).cast("int"), F.floor(F.col("hi") / BLOCK).cast("int"))).alias("_block"))
    m = spans.join(matrix.select("src", "block", "c"), F.col("_src").eqNullSafe(F.col("src")) & (F.col("_block") == F.col("block")), "left")
    c = F.coalesce(F.col("c"), F.expr("array()").cast(matrix.schema["c"].dataType))
    m = m.select(F.col("_src").alias("src"), F.col("_block").alias("block"), "lo", "hi", "mean", "sd", c.alias("c"))
    m = written(m.select("src", "block", "lo", "hi", "mean", "sd", F.col("c.s").alias("steps"), F.transform(F.col("c.y"), lambda x: (x - F.col("mean")) / F.col("sd")).alias("values"), F.col("c.v").alias("exact"), F.col("c.n").alias("ns")))
    few = len(m.select("block").distinct().limit(FEW_BLOCKS + 1).collect()) <= FEW_BLOCKS
    keep = np.full(rank, ridge)

    def by_block(b: pa.RecordBatch, known) -> Iterator[tuple[int, pa.RecordBatch, np.ndarray | None]]:
        """The rows of each block, and its step factors: shipped with the task, beside the rows, or none yet."""
        of = b.column("block").to_numpy()
        for block in np.unique(of).tolist():
            part = b.filter(pa.array(of == block))
            w = known.value.get(block) if known is not None else None
            if "w" in b.schema.names and part.column("w")[0].is_valid:
                w = part.column("w")[0].values.to_numpy(zero_copy_only=False)
            yield block, part, None if w is None else np.asarray(w, float).reshape(BLOCK, rank)

    def sums(known, first: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Normal equations of the step factors, summed over the sources of a task."""
            total: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
            for batch in batches:
                for block, part, w in by_block(batch, known):
                    row, step_, val = _cells(part, "values")
                    if not len(row):
                        continue
                    w = _first_factors(block, rank, period) if first else w
                    u = _source_factors(row, step_, val, part.num_rows, w, keep)[row]
                    a, b, n = total.setdefault(block, (np.zeros((BLOCK, rank, rank)), np.zeros((BLOCK, rank)), np.zeros(BLOCK)))
                    n += np.bincount(step_, minlength=BLOCK)
                    for i in range(rank):
                        b[:, i] += np.bincount(step_, u[:, i] * val, BLOCK)
                        for j in range(rank):
                            a[:, i, j] += np.bincount(step_, u[:, i] * u[:, j], BLOCK)
            for block, (a, b, n) in total.items():
                s = np.flatnonzero(n)
                cols = [np.full(len(s), block, np.int32), s.astype(np.int32), *(a[s, i, j] for i in range(rank) for j in range(rank)), *(b[s, i] for i in range(rank)), n[s].astype(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], names=["block", "s", *names, "n"])

        return run

    names = [f"a{i}{j}" for i in range(rank) for j in range(rank)] + [f"b{i}" for i in range(rank)]
    sum_schema = "block int, s int, " + ", ".join(f"{c} double" for c in names) + ", n bigint"

    def factors(key_: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        """Step factors of a block; steps that no source observes have none (NaN)."""
        block = int(key_[0])
        a = pdf[[f"a{i}{j}" for i in range(rank) for j in range(rank)]].to_numpy().reshape(-1, rank, rank)
        prior = _first_factors(block, rank, period)[pdf["s"].to_numpy()]
        # drawn to the start, so that a step seen by few sources stays near the season
        b = pdf[[f"b{i}" for i in range(rank)]].to_numpy() + ridge * prior
        w = np.full((BLOCK, rank), np.nan)
        w[pdf["s"].to_numpy()] = _solve(a, b, keep)
        return pd.DataFrame({"block": [np.int32(block)], "w": [w.ravel()]})

    w = known = None
    sc = df.sparkSession.sparkContext
    for i in range(rounds):
        source_rows = m.select("block", "steps", "values")
        if w is not None:
            source_rows = source_rows.join(w, "block")
        added = source_rows.mapInArrow(sums(known, i == 0), sum_schema).groupBy("block", "s").agg(*(F.sum(c).alias(c) for c in names), F.sum("n").alias("n"))
        if few:  # at most FEW_BLOCKS x BLOCK sums come to the driver, and as many factors go to each task once
            known = sc.broadcast({int(b): factors((b,), part)["w"].iloc[0] for b, part in added.toPandas().groupby("block")})
        else:
            w = written(added.groupBy("block").applyInPandas(factors, "block int, w array<double>"))

    def filled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, part, w_ in by_block(batch, known):
                w_ = np.full((BLOCK, rank), np.nan) if w_ is None else w_
                row, step_, exact = _cells(part, "exact")
                u = _source_factors(row, step_, _flat(part, "values"), part.num_rows, np.nan_to_num(w_), keep) if len(row) else np.zeros((part.num_rows, rank))
                lo, hi, mean, sd = (part.column(c).to_numpy() for c in ("lo", "hi", "mean", "sd"))
                first, last = np.maximum(lo, block * BLOCK) - block * BLOCK, np.minimum(hi, block * BLOCK + BLOCK - 1) - block * BLOCK
                size = last - first + 1
                begin = np.cumsum(size) - size
                of = np.repeat(np.arange(part.num_rows), size)
                at = np.arange(int(size.sum())) - begin[of] + first[of]
                est = np.einsum("nr,nr->n", w_[at], u[of]) * sd[of] + mean[of]
                est = np.sign(est) * np.expm1(np.minimum(np.abs(est), 700.0))
                status = np.where(np.isnan(est) | (np.bincount(row, minlength=part.num_rows) < support)[of], UNSUPPORTED, FILLED)
                est[status == UNSUPPORTED] = np.nan
                n = np.zeros(len(at), np.int64)
                seen = begin[row] + step_ - first[row]
                est[seen], status[seen], n[seen] = exact, OBSERVED, _flat(part, "ns")
                yield pa.RecordBatch.from_arrays([part.column("src").take(pa.array(of)), pa.array(at + block * BLOCK), pa.array(est), pa.array(status.astype(np.int32)), pa.array(n)], names=["src", "step", "value", "status", "n_readings"])

    kind = m.schema["src"].dataType.simpleString()
    full = m.join(w, "block", "left") if w is not None else m
    out = full.mapInArrow(filled, f"src {kind}, step bigint, value double, status int, n_readings bigint")
    out = out.withColumn("status", F.element_at(F.array(*map(F.lit, STATUS)), F.col("status") + 1))
    start = F.timestamp_seconds(F.col("step") * step + origin)
    return out.select(F.col("src").alias(source), "step", start.alias("start"), F.when(~F.isnan("value"), F.col("value")).alias("value"), "status", "n_readings")
