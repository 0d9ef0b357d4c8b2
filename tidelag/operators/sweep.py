"""Parameter sweeps, cross maps and multiview ensembles: the grid is data, one plan for all of it."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from itertools import combinations
from math import floor, sqrt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelag.functions.skill import errors, pearson
from tidelag.operators import simplex, smap
from tidelag.operators.neighbors import weighted
from tidelag.operators.series import Task, meet, name_list, number_list, prepared, span_list, task, with_task

#: Tasks of one plan; more are put together by union.
PLAN_TASKS = 512
#: The sweeps' default grids.
RADII = [*range(11), 12, 14, 16, 18, 20, 25, 30]
THETAS = [0.01, 0.1, 0.3, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0, 8.0, 9.0, 10.0, 15.0, 20.0]


def labelled(df: DataFrame, tasks: list[Task], names: Sequence[str], kinds: Sequence[str]) -> DataFrame:
    """Puts each task's label columns beside its rows."""
    for name, kind in zip(names, kinds):
        df = df.withColumn(name, F.element_at(F.array(*(F.lit(t.label[name]).cast(kind) for t in tasks)), F.col("task") + 1))
    return df


def skills(df: DataFrame, tasks: list[Task], names: Sequence[str], kinds: Sequence[str], time=None, series=None, order=()) -> DataFrame:
    """series, the label columns, rho, MAE, CAE and RMSE of each task's simplex forecast."""
    out = None
    for lo in range(0, len(tasks), PLAN_TASKS):
        part = tasks[lo : lo + PLAN_TASKS]
        p = prepared(df, part, time, series, order)
        every = p.base.select("series").distinct().withColumn("task", F.explode(F.array(*map(F.lit, range(len(part))))))
        got = errors(simplex.forecasts(p), ["series", "task"], "obs", "predicted")
        one = labelled(meet(every, got, ["series", "task"], "left"), part, names, kinds).select("series", *names, "rho", "MAE", "CAE", "RMSE")
        out = one if out is None else out.unionByName(one)
    return out


def embed_dimension(df, columns, target, lib=None, pred=None, max_e=10, min_e=1, **kw) -> DataFrame:
    """series, E, rho for E from min_e to max_e."""
    place, arg = _split(kw)
    return skills(df, [task(columns, target, lib, pred, E=e, label={"E": e}, **arg) for e in range(min_e, max_e + 1)], ["E"], ["int"], **place).select("series", "E", "rho")


def predict_interval(df, columns, target, lib=None, pred=None, max_tp=10, **kw) -> DataFrame:
    """series, Tp, rho for Tp from 1 to max_tp."""
    place, arg = _split(kw)
    return skills(df, [task(columns, target, lib, pred, Tp=tp, label={"Tp": tp}, **arg) for tp in range(1, max_tp + 1)], ["Tp"], ["int"], **place).select("series", "Tp", "rho")


def predict_exclusion_radius(df, columns, target, lib=None, pred=None, radii: Iterable[int] | None = None, **kw) -> DataFrame:
    """series, radius, rho for each exclusion radius."""
    place, arg = _split(kw)
    return skills(df, [task(columns, target, lib, pred, radius=r, label={"radius": r}, **arg) for r in (RADII if radii is None else number_list(radii))], ["radius"], ["int"], **place).select("series", "radius", "rho")


def smap_sweep(df, tasks: list[Task], thetas, names, kinds, solver=None, time=None, series=None, order=()) -> DataFrame:
    """series, the label columns, theta and skill of locally weighted maps."""
    p = prepared(df, tasks, time, series, order)
    made = smap.forecasts(p, thetas, solver)
    return labelled(errors(made, ["series", "task", "theta"], "obs", "predicted"), tasks, names, kinds).select("series", *names, "theta", "rho", "MAE", "CAE", "RMSE")


def predict_nonlinear(df, columns, target, lib=None, pred=None, theta=None, knn=0, solver=None, **kw) -> DataFrame:
    """series, theta, rho; neighbours are ranked once for all thetas."""
    place, arg = _split(kw)
    t = with_task(task(columns, target, lib, pred, **arg), knn=knn)
    return smap_sweep(df, [t], THETAS if theta is None else number_list(theta, float), [], [], solver, **place).select("series", "theta", "rho")


def _split(kw: dict) -> tuple[dict, dict]:
    place = {k: kw.pop(k) for k in ("time", "series", "order") if k in kw}
    return place, kw


def cross_map_rows(df, columns, target=None, E: int | Sequence[int] = 1, lib=None, pred=None, time=None, series=None, order=(), **kw) -> tuple[DataFrame, list[Task]]:
    """Projections of each predictor (a column, or a list of columns) to a target, or to itself if that is None."""
    es = [int(E)] * len(columns) if isinstance(E, int) else [int(e) for e in E]
    tasks = []
    for c, e in zip(columns, es):
        own = name_list([c]) if isinstance(c, str) else list(c)
        to = name_list(target if target is not None else [own[0]])[0]
        tasks.append(task(own, [to], lib, pred, E=e, label={"columns": " ".join(own), "target": to}, **kw))
    return labelled(simplex.run(df, tasks, time, series, order), tasks, ["columns", "target"], ["string", "string"]), tasks


def cross_map_skill(df, columns, target=None, E: int | Sequence[int] = 1, lib=None, pred=None, time=None, series=None, order=(), **kw) -> DataFrame:
    """series, columns, target, rho, MAE, CAE, RMSE of each predictor."""
    es = [int(E)] * len(columns) if isinstance(E, int) else [int(e) for e in E]
    tasks = []
    for c, e in zip(columns, es):
        own = [c] if isinstance(c, str) else list(c)
        to = name_list(target if target is not None else [own[0]])[0]
        tasks.append(task(own, [to], lib, pred, E=e, label={"columns": " ".join(own), "target": to}, **kw))
    return skills(df, tasks, ["columns", "target"], ["string", "string"], time, series, order)


def cross_map_matrix(df, columns, E: int | Sequence[int] = 1, Tp=1, tau=-1, radius=0, lib=None, pred=None, threshold=None, time=None, series=None, order=()) -> DataFrame:
    """series, source, target, rho of all ordered pairs of columns.

    Each source's neighbours are found once; their rows are then looked up in all targets. Below ``threshold``
    rho is null; with a threshold so is the diagonal.
    """
    columns = name_list(columns)
    es = [int(E)] * len(columns) if isinstance(E, int) else [int(e) for e in E]
    tasks = [task([c], [c], lib, pred, E=e, Tp=Tp, tau=tau, radius=radius) for c, e in zip(columns, es)]
    every = [(c, Tp) for c in columns]
    p = prepared(df, tasks, time, series, order, every)
    both = weighted(p, [every] * len(tasks))
    rho = errors(both, ["series", "task", "tgt"], "obs", "predicted").select("series", "task", "tgt", "rho")
    name = lambda i: F.element_at(F.array(*map(F.lit, columns)), F.col(i) + 1)
    out = rho.select("series", name("task").alias("source"), name("tgt").alias("target"), "rho")
    if threshold is not None:
        out = out.withColumn("rho", F.when((F.col("rho") >= threshold) & (F.col("source") != F.col("target")), F.col("rho")))
    return out


def embed_dim_columns(df, columns, target=None, max_e=15, min_e=1, lib=None, pred=None, first_max=False, time=None, series=None, order=(), **kw) -> DataFrame:
    """series, column, target, E, rho: the embedding dimension with the best forecast of the target (or of itself).

    ``first_max`` takes the first E after which rho falls, else the highest rho counts, the smaller E at equal ones.
    Without any rho E is 0. rho is rounded to four places.
    """
    tasks = []
    for c in name_list(columns):
        to = c if target is None else name_list(target)[0]
        tasks += [task([c], [to], lib, pred, E=e, label={"column": c, "target": to, "E": e}, **kw) for e in range(min_e, max_e + 1)]
    s = skills(df, tasks, ["column", "target", "E"], ["string", "string", "int"], time, series, order).select("series", "column", "target", "E", "rho")
    keys = ["series", "column", "target"]
    if first_max:
        known = s.where("rho IS NOT NULL")
        w = Window.partitionBy(*keys).orderBy("E")
        known = known.withColumn("next", F.lead("rho").over(w)).where(F.col("next").isNull() | (F.col("next") < F.col("rho")))
        best = known.groupBy(*keys).agg(F.min(F.struct("E", "rho")).alias("b"))
    else:
        best = s.where("rho IS NOT NULL").groupBy(*keys).agg(F.max(F.struct("rho", (-F.col("E")).alias("smaller"), "E")).alias("b"))
    every = s.select(*keys).distinct()
    return meet(every, best, keys, "left").select(*keys, F.coalesce("b.E", F.lit(0)).alias("E"), F.bround("b.rho", 4).cast("float").alias("rho"))


def multiview(df, columns, target, lib=None, pred=None, D=0, E=1, Tp=1, tau=-1, views=0, radius=0, train_lib=True, exclude_target=False, rows: int | None = None, time=None, series=None, order=()) -> tuple[DataFrame, DataFrame]:
    """Mean forecast of the best embeddings of D dimensions, and the skill of each of them.

    All combinations of D of the columns' embedded coordinates are ranked by rho, over the library itself (``train_lib``) or
    the predicted rows; the best ``views`` (root of their number if 0) are averaged. Combinations without rho rank last,
    ties by their order. ``rows`` gives the number of rows where lib and pred are left to halves.
    :returns: (series, row, Time, Observations, Predictions) and (series, rank, Columns, rho, MAE, CAE, RMSE).
    """
    columns, target = name_list(columns), name_list(target)
    if train_lib and not lib and not pred:
        n = rows or df.count()
        lib, pred = [1, n // 2], [n // 2 + 1, n]
    D = min(D or len(columns), len(columns) * E)
    used = [c for c in columns if c not in target] if exclude_target else columns
    coords = [(c, d * tau) for d in range(E) for c in used]
    sign = "-" if tau < 0 else "+"
    label = lambda x: f"{x[0]}(t{sign}{abs(x[1])})"
    combos = list(combinations(coords, D))
    k = min(views if views >= 1 else floor(sqrt(len(combos))), len(combos))
    make = lambda c, rows_: Task(c, target[0], span_list(lib, "lib"), span_list(rows_, "pred"), Tp, D + 1, radius, D, tau, True)
    names = F.array(*(F.lit("(" + ", ".join(f"'{label(x)}'" for x in c) + ")") for c in combos))
    final = prepared(df, [make(c, pred) for c in combos], time, series, order)

    def scored(p):
        return errors(simplex.forecasts(p), ["series", "task"], "obs", "predicted")

    ranking = scored(prepared(df, [make(c, lib) for c in combos], time, series, order)) if train_lib else scored(final)
    w = Window.partitionBy("series").orderBy(F.col("rho").desc_nulls_last(), "task")
    top = ranking.select("series", "task", F.row_number().over(w).alias("rank"), "rho").where(F.col("rank") <= k).select("series", "task", "rank")
    if train_lib:
        some = top.groupBy(F.col("series").alias("_s")).agg(F.collect_list("task").alias("only"))  # at most the views' number
        final.wide = final.wide.join(some, F.col("series").eqNullSafe(F.col("_s"))).drop("_s")
    made = meet(simplex.forecasts(final), top, ["series", "task"])
    view = errors(made, ["series", "task", "rank"], "obs", "predicted").select("series", "rank", F.element_at(names, F.col("task") + 1).alias("Columns"), "rho", "MAE", "CAE", "RMSE")
    mean = made.groupBy("series", "p").agg(F.avg("predicted").alias("predicted")).withColumn("task", F.lit(0)).withColumn("variance", F.lit(None).cast("double"))
    one = prepared(df, [make(combos[0], pred)], time, series, order)
    return simplex.projection(one, mean).select("series", "row", "Time", "Observations", "Predictions"), view
