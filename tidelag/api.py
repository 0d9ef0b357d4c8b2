"""The public operations over Spark tables, a call each.

All take a table and return tables. Rows are ordered by the time column (the first one unless ``noTime``) or by the
columns ``order``, since a table has no other order; ``series`` names a column that splits the table into many series, all
of which run in one plan and whose results carry a ``series`` column. Arguments that steer processes or threads
elsewhere (numProcess, kdWorkers, mpMethod, chunksize, parallel, sharedMB) are accepted and have no meaning here. Spans or
library sizes beyond a single series, and libraries too small for knn, raise in the task that meets them.
"""

from __future__ import annotations

from collections.abc import Sequence
from types import SimpleNamespace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelag.functions import convergence, skill
from tidelag.operators import ccm as _ccm
from tidelag.operators import generate as _generate
from tidelag.operators import neighbors as _neighbors
from tidelag.operators import series as _series
from tidelag.operators import simplex as _simplex
from tidelag.operators import smap as _smap
from tidelag.operators import surrogate as _surrogate
from tidelag.operators import sweep as _sweep
from tidelag.sources import plots
from tidelag.sources import tables as _tables
from tidelag.sources.plots import plot_coefficients as PlotCoeff  # noqa: F401, N812
from tidelag.sources.plots import plot_matrix as PlotMatrix  # noqa: F401, N812
from tidelag.sources.plots import plot_obs_pred as PlotObsPred  # noqa: F401, N812


def _place(df: DataFrame, noTime: bool, order: Sequence[str], series: str | None, time: str | None = None) -> dict:
    if noTime:
        if not order:
            raise ValueError("noTime needs the columns that give the order of rows (order=[...])")
        return {"time": None, "order": list(order), "series": series}
    return {"time": time or next(c for c in df.columns if c != series), "order": list(order), "series": series}


def _out(df: DataFrame, series: str | None) -> DataFrame:
    return df if series else df.drop("series")


def _needed(lib, pred, series: str | None) -> None:
    """Raises where lib or pred is empty; None stands for all rows."""
    if series is None and any(x is not None and not _series.number_list(x) for x in (lib, pred)):
        raise _series.ArgumentError("lib and pred are needed (None stands for all rows)")


def _shown(df: DataFrame, show: bool, draw, *args) -> DataFrame:
    """The table, drawn before if that is asked for (which collects it and needs matplotlib)."""
    if show:
        draw(df, *args)
    return df


def MakeBlock(*_, **__):  # noqa: N802
    """Gone; use Embed."""
    raise RuntimeError("MakeBlock is no longer there; use Embed")


def Embed(dataFrame=None, E=0, tau=-1, columns="", includeTime=False, pathIn="./", dataFile=None, spark: SparkSession | None = None, order=(), series=None, keepRow=False) -> DataFrame:  # noqa: N802, N803
    """Delay embedding of columns; the table may be read from pathIn + dataFile."""
    if dataFrame is None:
        if not dataFile:
            raise ValueError("Embed needs a table or a file")
        dataFrame = _tables.read(spark or SparkSession.active(), pathIn + dataFile)
    return _series.embed(dataFrame, E, tau, columns, include_time=includeTime, keep_row=keepRow, **_place(dataFrame, False, order, series))


def Embedding(data, columns=None, E=2, tau=-1, outputFile=None, plusminus=False, verbose=False, order=(), series=None) -> DataFrame:  # noqa: N802, N803
    """Embedding with the time column; present values keep the bare column name. plusminus: past and future."""
    place = _place(data, False, order, series)
    columns = _series.name_list(columns) or [c for c in data.columns if c not in (place["time"], series)]
    out = _series.embed(data, E, tau, columns, include_time=True, plusminus=plusminus, **place)
    out = out.withColumnsRenamed({f"{c}(t{s}0)": c for c in columns for s in "+-"})
    if outputFile:
        _tables.write(out, outputFile)
    return out


def Simplex(dataFrame, columns="", target="", lib="", pred="", E=0, Tp=1, knn=0, tau=-1, exclusionRadius=0, embedded=False, validLib=None, noTime=False, generateSteps=0, generateConcat=False, ignoreNan=True, order=(), series=None, showPlot=False, returnObject=False, verbose=False, kdWorkers=-1) -> DataFrame:  # noqa: N802, N803
    """Simplex projection: Time, Observations, Predictions, Pred_Variance (and row, to sort by). validLib is a SQL condition.

    ``showPlot`` draws it. ``returnObject`` gives the projection with its neighbours and task instead.
    """
    _needed(lib, pred, series)
    t = _series.task(columns, target, lib, pred, E, Tp, knn, tau, exclusionRadius, embedded, validLib or None, ignoreNan)
    place = _place(dataFrame, noTime, order, series)
    if generateSteps:
        return _shown(_out(_generate.generated(dataFrame, t, generateSteps, concat=generateConcat, **place), series), showPlot, PlotObsPred)
    p = _series.prepared(dataFrame, [t], **place)
    out = _shown(_out(_simplex.projection(p, _simplex.forecasts(p)).drop("task"), series), showPlot, PlotObsPred)
    if returnObject:
        return SimpleNamespace(Projection=out, Neighbors=_out(_neighbors.nearest(p).drop("task"), series), task=t)
    return out


def SMap(dataFrame, columns="", target="", lib="", pred="", E=0, Tp=1, knn=0, tau=-1, theta=0, exclusionRadius=0, solver=None, embedded=False, validLib=None, noTime=False, generateSteps=0, generateConcat=False, ignoreNan=True, order=(), series=None, showPlot=False, returnObject=False, verbose=False, kdWorkers=-1) -> dict[str, DataFrame]:  # noqa: N802, N803
    """Locally weighted map: tables predictions, coefficients and singularValues (as attributes, with the task, by ``returnObject``)."""
    _needed(lib, pred, series)
    t = _series.task(columns, target, lib, pred, E, Tp, 1, tau, exclusionRadius, embedded, validLib or None, ignoreNan)
    if not embedded and len(_series.name_list(columns)) > 1:
        raise ValueError("several columns need embedded=True")
    t = _series.with_task(t, knn=knn)
    place = _place(dataFrame, noTime, order, series)
    if generateSteps:
        rows = _generate.generated(dataFrame, t, generateSteps, theta=float(theta), solver=solver, concat=generateConcat, **place)
        key = "step"
    else:
        p = _series.prepared(dataFrame, [t], **place)
        rows, key = _simplex.projection(p, _smap.forecasts(p, [theta], solver), ["coef", "sing"]), "row"
    sign = "-" if tau < 0 else "+"
    names = ["C0"] + [f"∂{t.target}/∂{c}" if embedded else f"∂{t.target}/∂{c}(t{sign}{abs(s)})" for c, s in t.dims]
    head = (["series"] if series else []) + [key, "Time"]
    out = {
        "predictions": rows.select(*head, "Observations", "Predictions", "Pred_Variance"),
        "coefficients": rows.select(*head, *(F.get("coef", F.lit(i)).alias(n) for i, n in enumerate(names))),
        "singularValues": rows.select(*head, *(F.get("sing", F.lit(i)).alias(f"C{i}") for i in range(len(names)))),
    }
    _shown(out["predictions"], showPlot, PlotObsPred)
    _shown(out["coefficients"].drop(key), showPlot and not series, PlotCoeff)
    return SimpleNamespace(**out, task=t) if returnObject else out


def CCM(dataFrame, columns="", target="", libSizes="", sample=30, E=0, Tp=0, knn=0, tau=-1, exclusionRadius=0, seed=None, embedded=False, validLib=None, includeData=False, noTime=False, legacy=False, sampler="numpy", order=(), series=None, mpMethod=None, parallel=True, sharedMB=0.01, verbose=False, showPlot=False, returnObject=False):  # noqa: N802, N803
    """Convergent cross mapping: LibSize and mean rho of both directions.

    includeData returns {'libMeans', 'PredictStats'}: the means with variances, and the rows of all samples.
    """
    place = _place(dataFrame, noTime, order, series)
    if legacy:
        rows = _ccm.ccm_projected(dataFrame, columns, target, libSizes, sample, E, Tp, knn, tau, exclusionRadius, seed, embedded, strict=series is None, **place)
    else:
        rows = _ccm.ccm(dataFrame, columns, target, libSizes, sample, E, Tp, knn, tau, exclusionRadius, seed, embedded, validLib or None, sampler=sampler, strict=series is None, **place)
    means = _ccm.lib_means(rows, columns, target, includeData, ["series"] if series else [])
    _shown(means, showPlot, plots.plot_lines, "LibSize")
    if returnObject:
        return SimpleNamespace(libMeans=means, PredictStats=_out(rows, series))
    return {"libMeans": means, "PredictStats": _out(rows, series)} if includeData else means


def Multiview(dataFrame, columns="", target="", lib="", pred="", D=0, E=1, Tp=1, knn=0, tau=-1, multiview=0, exclusionRadius=0, trainLib=True, excludeTarget=False, ignoreNan=True, order=(), series=None, numProcess=4, mpMethod=None, chunksize=1, kdWorkers=-1, verbose=False, showPlot=False, returnObject=False) -> dict[str, DataFrame]:  # noqa: N802, N803
    """Multiview ensemble: tables Predictions (Time is the row, from 1) and View."""
    place = _place(dataFrame, False, order, series)
    a, b = _sweep.multiview(dataFrame, columns, target, lib, pred, D, E, Tp, tau, multiview, exclusionRadius, trainLib, excludeTarget, **place)
    a = a.withColumn("Time", F.col("row") + 1).drop("row")
    out = {"Predictions": _shown(_out(a, series), showPlot, PlotObsPred), "View": _out(b, series)}
    return SimpleNamespace(**out) if returnObject else out


def _sweep_args(dataFrame, E, Tp, tau, radius, embedded, validLib, noTime, order, series, ignoreNan=True, knn=0, skip=()) -> dict:
    kw = {"E": E, "Tp": Tp, "tau": tau, "radius": radius, "embedded": embedded, "valid": validLib or None, "ignore_nan": ignoreNan, "knn": knn}
    return {k: v for k, v in kw.items() if k not in skip} | _place(dataFrame, noTime, order, series)


def EmbedDimension(dataFrame, columns="", target="", maxE=10, lib="", pred="", Tp=1, tau=-1, exclusionRadius=0, embedded=False, validLib=None, noTime=False, ignoreNan=True, order=(), series=None, numProcess=4, mpMethod=None, chunksize=1, kdWorkers=-1, verbose=False, showPlot=False) -> DataFrame:  # noqa: N802, N803
    """rho for E from 1 to maxE."""
    _needed(lib, pred, series)
    kw = _sweep_args(dataFrame, 0, Tp, tau, exclusionRadius, embedded, validLib, noTime, order, series, ignoreNan, skip=("E",))
    return _shown(_out(_sweep.embed_dimension(dataFrame, columns, target, lib, pred, maxE, **kw), series), showPlot, plots.plot_line, "E", "rho")


def PredictInterval(dataFrame, columns="", target="", lib="", pred="", maxTp=10, E=1, tau=-1, exclusionRadius=0, embedded=False, validLib=None, noTime=False, ignoreNan=True, order=(), series=None, numProcess=4, mpMethod=None, chunksize=1, kdWorkers=-1, verbose=False, showPlot=False) -> DataFrame:  # noqa: N802, N803
    """rho for Tp from 1 to maxTp."""
    _needed(lib, pred, series)
    kw = _sweep_args(dataFrame, E, 0, tau, exclusionRadius, embedded, validLib, noTime, order, series, ignoreNan, skip=("Tp",))
    return _shown(_out(_sweep.predict_interval(dataFrame, columns, target, lib, pred, maxTp, **kw), series), showPlot, plots.plot_line, "Tp", "rho")


def PredictExclusionRadius(dataFrame, columns="", target="", lib="", pred="", Tp=1, E=1, tau=-1, exclusionRadius=None, embedded=False, validLib=None, noTime=False, ignoreNan=True, order=(), series=None, numProcess=4, mpMethod=None, chunksize=1, kdWorkers=-1, verbose=False, showPlot=False) -> DataFrame:  # noqa: N802, N803
    """rho for each exclusion radius."""
    _needed(lib, pred, series)
    kw = _sweep_args(dataFrame, E, Tp, tau, 0, embedded, validLib, noTime, order, series, ignoreNan, skip=("radius",))
    out = _sweep.predict_exclusion_radius(dataFrame, columns, target, lib, pred, exclusionRadius, **kw).withColumnRenamed("radius", "Exclusion radius")
    return _shown(_out(out, series), showPlot, plots.plot_line, "Exclusion radius", "rho")


def PredictNonlinear(dataFrame, columns="", target="", theta=None, lib="", pred="", E=1, Tp=1, knn=0, tau=-1, exclusionRadius=0, solver=None, embedded=False, validLib=None, noTime=False, ignoreNan=True, order=(), series=None, numProcess=4, mpMethod=None, chunksize=1, kdWorkers=-1, verbose=False, showPlot=False) -> DataFrame:  # noqa: N802, N803
    """rho of the locally weighted map for each theta."""
    _needed(lib, pred, series)
    kw = _sweep_args(dataFrame, E, Tp, tau, exclusionRadius, embedded, validLib, noTime, order, series, ignoreNan, skip=("knn",))
    return _shown(_out(_sweep.predict_nonlinear(dataFrame, columns, target, lib, pred, theta, knn, solver, **kw), series), showPlot, plots.plot_line, "theta", "rho")


def ComputeError(df: DataFrame, obs="Observations", pred="Predictions", digits=6, keys=()) -> DataFrame:  # noqa: N802
    """rho, MAE (largest signed error), CAE and RMSE over complete pairs."""
    return skill.errors(df, keys, obs, pred, digits)


def SurrogateData(dataFrame, column, method="ebisuzaki", numSurrogates=10, alpha=None, smooth=0.8, outputFile=None, seed=0, order=(), series=None) -> DataFrame:  # noqa: N802, N803
    """Surrogate series, one column each (column_1, ...)."""
    place = _place(dataFrame, False, order, series)
    long = _surrogate.surrogates(dataFrame, column, method, numSurrogates, alpha, smooth, seed, **place)
    out = long.groupBy("series", "row", F.col("time").alias(place["time"])).pivot("surrogate", list(range(1, numSurrogates + 1))).agg(F.first("value"))
    out = _out(out.withColumnsRenamed({str(i): f"{column}_{i}" for i in range(1, numSurrogates + 1)}), series)
    if outputFile:
        _tables.write(out.drop("row"), outputFile)
    return out


def CrossMap_Matrix(data, E=1, Tp=1, tau=-1, exclusionRadius=0, lib=None, pred=None, threshold=None, columns=None, outputFile=None, returnValue="matrix", noTime=False, order=(), series=None, **_ignored) -> DataFrame:  # noqa: N802, N803
    """rho of every ordered pair: returnValue 'matrix' (a row a source) or 'long'."""
    place = _place(data, noTime, order, series)
    columns = _series.name_list(columns) or [c for c in data.columns if c not in (place["time"], series, *place["order"])]
    long = _sweep.cross_map_matrix(data, columns, E, Tp, tau, exclusionRadius, lib, pred, threshold, **place)
    out = _out(long, series) if returnValue == "long" or series else _tables.wide(long, columns=columns)
    if outputFile:
        _tables.write(out, outputFile)
    return out


def _predictors(data, columns, place, series):
    return list(columns) if columns else [c for c in data.columns if c not in (place["time"], series, *place["order"])]


def CrossMap_Columns(data, target=None, E=1, Evec=None, Tp=1, tau=-1, exclusionRadius=0, lib=None, pred=None, columns=None, returnError=False, outputFile=None, noTime=False, order=(), series=None, **_ignored) -> DataFrame:  # noqa: N802, N803
    """Each column's forecast of a target (or of itself): all rows, or with returnError a row of skill a column."""
    place = _place(data, noTime, order, series)
    columns = _predictors(data, columns, place, series)
    f = _sweep.cross_map_skill if returnError else lambda *a, **k: _sweep.cross_map_rows(*a, **k)[0]
    out = _out(f(data, [[c] for c in columns], target, Evec or E, lib, pred, Tp=Tp, tau=tau, radius=exclusionRadius, **place), series)
    if outputFile:
        _tables.write(out, outputFile)
    return out


def CrossMap_ColumnList(data, columns, target, E=1, Tp=1, tau=-1, exclusionRadius=0, lib=None, pred=None, embedded=False, outputFile=None, noTime=False, order=(), series=None, **_ignored) -> DataFrame:  # noqa: N802, N803
    """Forecasts of a target by each entry of a list of columns or groups of columns."""
    place = _place(data, noTime, order, series)
    own = [_series.name_list(c) if isinstance(c, str) else list(c) for c in columns]
    out = _out(_sweep.cross_map_rows(data, own, target, E, lib, pred, Tp=Tp, tau=tau, radius=exclusionRadius, embedded=embedded, **place)[0], series)
    if outputFile:
        _tables.write(out, outputFile)
    return out


def EmbedDim_Columns(data, target=None, maxE=15, minE=1, lib=None, pred=None, Tp=1, tau=-1, exclusionRadius=0, firstMax=False, validLib=None, columns=None, outputFile=None, noTime=False, order=(), series=None, **_ignored) -> DataFrame:  # noqa: N802, N803
    """column, target, E and rho: the best embedding dimension of each column."""
    place = _place(data, noTime, order, series)
    out = _out(_sweep.embed_dim_columns(data, _predictors(data, columns, place, series), target, maxE, minE, lib, pred, firstMax, Tp=Tp, tau=tau, radius=exclusionRadius, valid=validLib or None, **place), series)
    if outputFile:
        _tables.write(out, outputFile)
    return out


def CCM_Matrix(dataFrame, E=1, libSizes=None, pLibSizes=(10, 20, 80, 90), Tp=0, tau=-1, exclusionRadius=0, sample=30, seed=None, expConverge=False, columns=None, sampler="numpy", noTime=False, order=(), series=None, outputFile=None, **_ignored) -> dict:  # noqa: N802, N803
    """All-pairs cross mapping: tables rho (long), slope and, with expConverge, exp_a; and the columns."""
    place = _place(dataFrame, noTime, order, series)
    columns = _series.name_list(columns) or [c for c in dataFrame.columns if c not in (place["time"], series, *place["order"])]
    rho = _ccm.ccm_matrix(dataFrame, columns, E, libSizes, pLibSizes, Tp, tau, exclusionRadius, sample, seed, sampler=sampler, **place)
    n = dataFrame.count() if series is None else 1
    keys = ["series", "source", "target"]
    out = {"rho": _out(rho, series), "slope": _out(skill.slope(rho.where("source <> target"), keys, "lib_size", "rho", float(n)), series), "columns": columns}
    if expConverge:
        out["exp_a"] = _out(convergence.rates(rho.where("source <> target"), keys, "lib_size", "rho", float(n)), series)
    if outputFile:
        _tables.write_npz(out["rho"], outputFile, columns, out["slope"], out.get("exp_a")) if outputFile.endswith(".npz") else _tables.write(out["rho"], outputFile)
    return out


def SMap_theta(data, thetaList, target, column, E=1, tau=-1, Tp=1, exclusionRadius=0, lib=None, pred=None, knn=0, solver=None, embedded=False, noTime=False, order=(), series=None, **_ignored) -> DataFrame:  # noqa: N802, N803
    """theta, row, Time, Observations, Predictions, Pred_Variance, coef, sing: locally weighted maps for a list of thetas."""
    thetas = _series.number_list(thetaList, float)
    if not thetas:
        raise ValueError("thetaList is needed")
    t = _series.with_task(_series.task(column, target, lib, pred, E, Tp, 1, tau, exclusionRadius, embedded), knn=knn)
    p = _series.prepared(data, [t], **_place(data, noTime, order, series))
    made = _smap.forecasts(p, thetas, solver).withColumn("task", F.array_position(F.array(*map(F.lit, thetas)), F.col("theta")).cast("int") - 1)
    ts = [_series.replace(t, label={"theta": x}) for x in thetas]
    out = _sweep.labelled(_simplex.projection(_series.replace(p, tasks=ts), made, ["coef", "sing"]), ts, ["theta"], ["double"])
    return _out(out.select("series", "theta", "seg", "row", "Time", "Observations", "Predictions", "Pred_Variance", "coef", "sing"), series)


def SMap_Tp(data, TpList, target, column, E=1, tau=-1, theta=0, exclusionRadius=0, lib=None, pred=None, knn=0, solver=None, embedded=False, noTime=False, order=(), series=None, **_ignored) -> DataFrame:  # noqa: N802, N803
    """Tp, row, Time, Observations, Predictions, Pred_Variance, coef, sing: locally weighted maps for a list of horizons."""
    tps = _series.number_list(TpList)
    if not tps:
        raise ValueError("TpList is needed")
    ts = [_series.with_task(_series.task(column, target, lib, pred, E, tp, 1, tau, exclusionRadius, embedded, label={"Tp": tp}), knn=knn) for tp in tps]
    p = _series.prepared(data, ts, **_place(data, noTime, order, series))
    out = _sweep.labelled(_simplex.projection(p, _smap.forecasts(p, [theta], solver), ["coef", "sing"]), ts, ["Tp"], ["int"])
    return _out(out.select("series", "Tp", "seg", "row", "Time", "Observations", "Predictions", "Pred_Variance", "coef", "sing"), series)


def sampleData(spark: SparkSession, folder: str) -> _tables.SampleData:  # noqa: N802
    """Named tables of a folder."""
    return _tables.SampleData(spark, folder)


def Examples(spark: SparkSession, rows: int = 200) -> dict[str, DataFrame]:  # noqa: N802
    """A few calls on a made-up pair of waves."""
    w = spark.range(rows).select((F.col("id") + 1).alias("Time"), F.round(F.sin(F.col("id") * 0.21), 4).alias("x"), F.round(F.cos(F.col("id") * 0.21) + F.sin(F.col("id") * 0.07), 4).alias("y"))
    half = rows // 2
    return {
        "Simplex": Simplex(w, "x", "x", [1, half], [half + 1, rows - 1], 3),
        "SMap": SMap(w, "x", "y", [1, half], [half + 1, rows - 1], 3, theta=2)["predictions"],
        "EmbedDimension": EmbedDimension(w, "y", "y", 5, [1, half], [half + 1, rows - 1]),
        "CCM": CCM(w, "x", "y", [10, 50, 90], 5, 3, seed=1),
    }
