"""Series tables: row numbers, spans, delay embedding, and the embedded vectors of a set of tasks."""

from __future__ import annotations

import warnings
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelag.shared import number, quoted, ship

Spans = tuple[tuple[int, int], ...]


class ArgumentError(ValueError, RuntimeError):
    """Arguments that don't go together, or not with the table."""


def name_list(x: str | Iterable[str] | None) -> list[str]:
    """Column names from a blank-separated string or any other iterable (names with blanks need the latter)."""
    return [] if x is None else x.split() if isinstance(x, str) else [str(c) for c in x]


def number_list(x: str | Iterable[float] | float | None, kind: type = int) -> list:
    if x is None:
        return []
    if isinstance(x, (int, float)):
        return [kind(x)]
    return [kind(float(v)) if kind is int else kind(v) for v in (x.replace(",", " ").split() if isinstance(x, str) else x)]


def span_list(x: str | Sequence[int] | None, what: str) -> Spans | None:
    """Pairs of first and last row, counted from 1, both included; None stands for all rows."""
    v = number_list(x)
    if not v:
        return None
    if len(v) % 2:
        raise ArgumentError(f"{what} must hold an even number of rows")
    pairs = tuple(zip(v[::2], v[1::2]))
    for a, b in pairs:
        if a < 1 or b < 1:
            raise ArgumentError(f"{what}: rows are counted from 1")
        if a >= b:
            raise ArgumentError(f"{what}: start must be below stop")
    return pairs


@dataclass(frozen=True)
class Task:
    """One forecast: an embedding, a target, and the rows it learns from and predicts."""

    dims: tuple[tuple[str, int], ...]
    target: str
    lib: Spans | None = None
    pred: Spans | None = None
    tp: int = 1
    knn: int = 1
    radius: int = 0
    e: int = 1
    tau: int = -1
    embedded: bool = False
    valid: str | None = None
    ignore_nan: bool = True
    label: dict = field(default_factory=dict, compare=False, hash=False)

    @property
    def shift(self) -> int:
        return 0 if self.embedded else abs(self.tau) * (self.e - 1)


def task(columns, target, lib=None, pred=None, E=0, Tp=1, knn=0, tau=-1, radius=0, embedded=False, valid=None, ignore_nan=True, label=None) -> Task:
    """A checked task. Raises ValueError for unusable arguments."""
    columns, targets = name_list(columns), name_list(target)
    if not columns or not targets:
        raise ArgumentError("columns and target are needed")
    if embedded:
        E = len(columns)
    if E < 1:
        raise ArgumentError("E must be positive")
    if tau == 0:
        raise ArgumentError("tau must not be 0")
    if radius < 0:
        raise ArgumentError("exclusionRadius must not be negative")
    dims = tuple((c, 0) for c in columns) if embedded else tuple((c, d * tau) for d in range(E) for c in columns)
    t = Task(dims, targets[0], span_list(lib, "lib"), span_list(pred, "pred"), Tp, knn or E + 1, radius, E, tau, embedded, valid, ignore_nan, label or {})
    if t.pred and tau < 0 and all(b <= t.shift for _, b in t.pred):
        warnings.warn("pred holds no row whose embedding is complete: nothing is predicted", stacklevel=3)
    return t


#: Estimated bytes of a table, and then its rows, from which rows are numbered in parallel; rows of a part in which
#: shifts are taken; ranges of the first order column.
BIG_BYTES, BIG_ROWS, SPAN, RANGES = 1 << 28, 1 << 20, 1 << 16, 64


def numbered(df: DataFrame, columns: Iterable[str], time: str | None = None, series: str | None = None, order: Sequence[str] = (), extra: dict[str, Column] | None = None, rows_known: int | None = None) -> tuple[DataFrame, dict[str, str]]:
    """series, row (from 0), n, time and the columns as doubles, and the internal name of each column.

    Rows are ordered by ``order`` if given, else by ``time``; a table has no other order. NaN becomes null. A large table
    is cut into ranges of the first order column: rows are numbered within a range, and each range's offset comes
    from the counts of those before, so that no series is ordered by one task. Whether it is large is told by its rows
    where these are known, else by an estimate.
    """
    ship(df.sparkSession)
    columns = list(dict.fromkeys(columns))
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ArgumentError(f"no such column: {missing}")
    if time is None and not order:
        raise ArgumentError("name the time column or the columns that give the order")
    alias = {c: f"c{i}" for i, c in enumerate(columns)}
    rows = df.select(
        (quoted(series).cast("string") if series else F.lit("")).alias("series"),
        *([quoted(time).alias("time")] if time else []),
        *(quoted(c).alias(f"_o{i}") for i, c in enumerate(order)),
        *(number(quoted(c)).alias(a) for c, a in alias.items()),
        *((v.alias(k)) for k, v in (extra or {}).items()),
    )
    by = [f"_o{i}" for i in range(len(order))] or ["time"]
    cuts = _cuts(rows, by[0], rows_known)
    if cuts is None:
        w = Window.partitionBy("series")
        rows = rows.withColumn("row", F.row_number().over(w.orderBy(*by)).cast("bigint") - 1).withColumn("n", F.count("*").over(w).cast("bigint"))
    else:
        at = _ordinal(F.col(by[0]), rows.schema[by[0]].dataType.typeName())
        rows = rows.withColumn("_k", F.coalesce(sum(((at > c).cast("int") for c in cuts), F.lit(0)), F.lit(0)))
        w = Window.partitionBy("series")
        held = rows.groupBy("series", "_k").agg(F.count("*").alias("_c"))
        held = held.select(F.col("series").alias("_s"), F.col("_k").alias("_h"), F.coalesce(F.sum("_c").over(w.orderBy("_k").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"), F.sum("_c").over(w).cast("bigint").alias("n"))
        rows = rows.withColumn("row", F.row_number().over(Window.partitionBy("series", "_k").orderBy(*by)).cast("bigint") - 1)
        rows = rows.join(held, F.col("series").eqNullSafe(F.col("_s")) & (F.col("_k") == F.col("_h"))).withColumn("row", F.col("row") + F.col("_off"))
    if not time:
        rows = rows.withColumn("time", F.col("row") + 1)
    return rows.select("series", "row", "n", "time", *alias.values(), *(extra or {})), alias


def _ordinal(c: Column, kind: str) -> Column | None:
    """A number in the order of the column, if its type has one."""
    if kind in ("timestamp", "timestamp_ntz"):
        return F.unix_micros(c.cast("timestamp")).cast("double")
    if kind == "date":
        return F.unix_date(c).cast("double")
    return None if kind in ("string", "boolean", "binary", "struct", "array", "map") else c.cast("double")


def _cuts(rows: DataFrame, first: str, known: int | None = None) -> list[float] | None:
    """Values at which a large table is cut; None if it is small, or its order column can't be cut."""
    at = _ordinal(F.col(first), rows.schema[first].dataType.typeName())
    if at is None or (estimated_bytes(rows) <= BIG_BYTES if known is None else known <= BIG_ROWS):
        return None
    n, q = rows.agg(F.count("*") if known is None else F.lit(known), F.percentile_approx(at, [i / RANGES for i in range(1, RANGES)], 1000)).first()
    return None if n <= BIG_ROWS or not q else sorted(set(q))


def estimated_bytes(df: DataFrame) -> int:
    """Size of a table by the optimizer's estimate, which runs nothing; 0 if there is none."""
    try:
        return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().toString())
    except Exception:  # sessions without a JVM at hand
        return 0


def beside(base: DataFrame, wanted: dict[str, tuple[str, int]], rows_known: int | None = None) -> DataFrame:
    """Adds columns by name: the value of a column so many rows later (earlier if negative).

    The rows of a large table are worked on in parts of SPAN rows, to which those that the shifts reach are added.
    """
    moves = [s for _, s in wanted.values()]
    if not any(moves) or (estimated_bytes(base) <= BIG_BYTES if rows_known is None else rows_known <= BIG_ROWS):
        return base.select("*", *(shifted(c, s).alias(a) for a, (c, s) in wanted.items()))
    lo, hi = min(0, *moves), max(0, *moves)
    part = base.withColumn("_b", F.explode(F.sequence(F.floor((F.col("row") - hi) / SPAN), F.floor((F.col("row") - lo) / SPAN))))
    w = Window.partitionBy("series", "_b").orderBy("row")
    return part.select("*", *(shifted(c, s, w).alias(a) for a, (c, s) in wanted.items())).where(F.col("_b") == F.floor(F.col("row") / SPAN)).drop("_b")


def shifted(c: str, by: int, w=None) -> Column:
    """Value of a column ``by`` rows later (earlier if negative)."""
    w = w or Window.partitionBy("series").orderBy("row")
    return F.lead(c, by).over(w) if by > 0 else F.lag(c, -by).over(w) if by < 0 else F.col(c)


def lib_rows(t: Task) -> Column:
    """Rows that a task may learn from, before missing values are left out."""
    out = F.lit(False)
    pairs = t.lib or (None,)
    for i, p in enumerate(pairs):
        start, stop = (F.lit(p[0]), F.lit(p[1])) if p else (F.lit(1), F.col("n"))
        if not t.embedded:
            start, stop = (start + t.shift, stop) if t.tau < 0 else (start, stop - t.shift)
            if t.tp < 0:
                start = start + max(0, abs(t.tp) - 1)
        if t.tp >= 0 and i == len(pairs) - 1:
            stop = stop - t.tp
        out = out | F.col("row").between(start - 1, stop - 1)
    # a row whose target lies outside the series teaches nothing
    return out & (F.col("row") + t.tp).between(0, F.col("n") - 1)


def pred_rows(t: Task) -> Column:
    out = F.lit(False)
    for p in t.pred or (None,):
        start, stop = (F.lit(p[0]), F.lit(p[1])) if p else (F.lit(1), F.col("n"))
        out = out | F.col("row").between(start - 1, stop - 1)
    return out


def obs_rows(t: Task) -> Column:
    """Whether the row a prediction lands on has an observation to compare it with.

    Rows reached beyond a span have none if any of them lies outside the series.
    """
    out = F.lit(False)
    for p in t.pred or (None,):
        a, b = (F.lit(p[0] - 1), F.lit(p[1] - 1)) if p else (F.lit(0), F.col("n") - 1)
        if not t.embedded:
            a, b = (F.greatest(a, F.lit(t.shift)), b) if t.tau < 0 else (a, F.least(b, F.col("n") - 1 - t.shift))
        at = F.col("row") + t.tp
        seen = (at <= b) | (b + t.tp < F.col("n")) if t.tp > 0 else (at >= a) | (a + t.tp >= 0)
        out = out | (F.col("row").between(a, b) & seen)
    return out


def lib_mask(t: Task, row: np.ndarray, n: int) -> np.ndarray:
    """:func:`lib_rows` of the rows of a series of n."""
    out = np.zeros(len(row), bool)
    pairs = t.lib or ((1, n),)
    for i, (start, stop) in enumerate(pairs):
        if not t.embedded:
            start, stop = (start + t.shift, stop) if t.tau < 0 else (start, stop - t.shift)
            start += max(0, abs(t.tp) - 1) if t.tp < 0 else 0
        stop -= t.tp if t.tp >= 0 and i == len(pairs) - 1 else 0
        out |= (row >= start - 1) & (row <= stop - 1)
    return out & (row + t.tp >= 0) & (row + t.tp < n)


def pred_mask(t: Task, row: np.ndarray, n: int) -> np.ndarray:
    """:func:`pred_rows` of the rows of a series of n."""
    out = np.zeros(len(row), bool)
    for start, stop in t.pred or ((1, n),):
        out |= (row >= start - 1) & (row <= stop - 1)
    return out


def obs_mask(t: Task, row: np.ndarray, n: int) -> np.ndarray:
    """:func:`obs_rows` of the rows of a series of n."""
    out = np.zeros(len(row), bool)
    for start, stop in t.pred or ((1, n),):
        a, b = start - 1, stop - 1
        if not t.embedded:
            a, b = (max(a, t.shift), b) if t.tau < 0 else (a, min(b, n - 1 - t.shift))
        seen = (row + t.tp <= b) | (b + t.tp < n) if t.tp > 0 else (row + t.tp >= a) | (a + t.tp >= 0)
        out |= (row >= a) & (row <= b) & seen
    return out


@dataclass
class Prepared:
    """A numbered series table and, beside each row, the distinct values that a set of tasks needs.

    ``wide`` has series, row, n, the shifted values d0, d1, ..., the targets y0, y1, ... and the validity v0, v1, ... of
    each row. Columns ``lok``, ``pok`` (whether a row may be learnt from or predicted) and ``only`` (tasks to run) may be added to it.
    """

    base: DataFrame
    wide: DataFrame
    tasks: list[Task]
    observed: dict[str, str]
    dims: list[tuple[str, int]]
    ys: list[tuple[str, int]]
    valid: list[str]
    strict: bool = False

    def slots(self, t: Task) -> list[int]:
        return [self.dims.index(x) for x in t.dims]


def prepared(df: DataFrame, tasks: list[Task], time: str | None = None, series: str | None = None, order: Sequence[str] = (), targets: Iterable[tuple[str, int]] = (), rows_known: int | None = None) -> Prepared:
    """The table of a set of tasks; ``targets`` (column and rows ahead) are put beside each row along with those of the tasks.

    With one series (strict) spans must lie within it, and a library with a condition must hold k rows: else the
    task that meets it raises. With many, a span ends where its series does. A task that doesn't ignore missing
    values (``ignore_nan`` False) raises where its library or its predicted rows hold one. ``rows_known`` is the number of
    the table's rows, where it has been counted.
    """
    valid = list(dict.fromkeys(t.valid for t in tasks if t.valid))
    columns = [c for t in tasks for c, _ in t.dims] + [t.target for t in tasks] + [c for c, _ in targets]
    base, alias = numbered(df, columns, time, series, order, {f"v{i}": F.coalesce(F.expr(v).cast("boolean"), F.lit(False)) for i, v in enumerate(valid)}, rows_known)
    dims = list(dict.fromkeys(x for t in tasks for x in t.dims))
    ys = list(dict.fromkeys([*((t.target, t.tp) for t in tasks), *targets]))
    wanted = {f"d{i}": (alias[c], s) for i, (c, s) in enumerate(dims)} | {f"y{i}": (alias[c], s) for i, (c, s) in enumerate(ys)}
    wide = beside(base, wanted, rows_known).select("series", "row", "n", *wanted, *(f"v{i}" for i in range(len(valid))))
    if series is None:
        last = max((b for t in tasks for spans in (t.lib, t.pred) for _, b in spans or ()), default=0)
        if last:
            # raised by the task that meets it, so that nothing runs before the table is asked for
            short = F.raise_error(F.concat(F.lit(f"lib or pred reach row {last} of a series of "), F.col("n"), F.lit(" rows")))
            wide = wide.withColumn("n", F.when(F.col("n") < last, short.cast("bigint")).otherwise(F.col("n")))
    return Prepared(base, wide, list(tasks), alias, dims, ys, valid, series is None)


def meet(a: DataFrame, b: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on keys of which null equals null; the keys of ``a`` stay."""
    other = b.withColumnsRenamed({k: f"_{k}_" for k in keys})
    on = [F.col(k).eqNullSafe(F.col(f"_{k}_")) if k == "series" else F.col(k) == F.col(f"_{k}_") for k in keys]
    return a.join(other, on, how).drop(*(f"_{k}_" for k in keys))


def used_rows(p: Prepared, t: Task, lib: bool) -> DataFrame:
    """series and row of the rows that a task learns from, or predicts."""
    ok = lib_rows(t) if lib else pred_rows(t)
    if lib and t.valid:
        ok = ok & F.col(f"v{p.valid.index(t.valid)}")
    for i in p.slots(t):
        ok = ok & F.col(f"d{i}").isNotNull()
    return p.wide.where(ok).select("series", "row")


def embed(df: DataFrame, E: int, tau: int = -1, columns=None, time: str | None = None, series: str | None = None, order: Sequence[str] = (), include_time: bool = False, plusminus: bool = False, keep_row: bool = False) -> DataFrame:
    """Delay embedding: each column shifted by 0, tau, 2 tau, ... rows, all columns of one shift together.

    Columns are named ``x(t-0)``, ``x(t-1)``, ... (``x(t+0)``, ... for positive tau), the number being the shift in
    rows; edge rows are null. ``plusminus`` gives past and future shifts side by side, the present one once.
    """
    columns = name_list(columns)
    if E < 1 or tau == 0 or not columns:
        raise ValueError("E must be positive, tau not 0, and columns are needed")
    base, alias = numbered(df, columns, time, series, order)
    shifts = [d * tau for d in range(E)]
    sign = "-" if tau < 0 else "+"
    out = [shifted(alias[c], s).alias(f"{c}(t{sign}{abs(s)})") for s in shifts for c in columns]
    if plusminus:
        other = "+" if tau < 0 else "-"
        out += [shifted(alias[c], -s).alias(f"{c}(t{other}{abs(s)})") for s in shifts[1:] for c in columns]
    head = (["series"] if series else []) + (["row"] if keep_row else [])
    return base.select(*head, *([F.col("time").alias(time)] if include_time and time else []), *out)


def with_task(t: Task, **changes) -> Task:
    return replace(t, **changes)
