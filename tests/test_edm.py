import numpy as np
import pandas as pd
import pytest

from tidelag import api
from tidelag.functions import convergence
from tidelag.operators import ccm, generate, neighbors, series, simplex, smap, solvers, surrogate, sweep


def frame(n=120, seed=1, missing=(), decimals=2):
    rng = np.random.default_rng(seed)
    x = np.empty(n)
    x[0] = 0.4
    for i in range(1, n):
        x[i] = 3.8 * x[i - 1] * (1 - x[i - 1])
    y = np.roll(x, 1) * 0.7 + rng.normal(0, 0.05, n)
    f = pd.DataFrame({"Time": np.arange(n) + 5, "x": np.round(x, decimals), "y": np.round(y, decimals)})
    for c, rows in missing:
        f.loc[list(rows), c] = np.nan
    return f


def brute(f, columns, target, lib, pred, E=1, Tp=1, tau=-1, knn=0, radius=0, embedded=False, valid=None):
    """Neighbours and forecasts of every predicted row, straight from the rules."""
    n = len(f)
    E = len(columns) if embedded else E
    sh = 0 if embedded else abs(tau) * (E - 1)
    emb = np.full((n, len(columns) * (1 if embedded else E)), np.nan)
    k = 0
    for d in range(1 if embedded else E):
        for c in columns:
            for r in range(n):
                if 0 <= r + d * tau < n:
                    emb[r, k] = f[c].iloc[r + d * tau]
            k += 1
    rows = []
    for i, (a, b) in enumerate(zip(lib[::2], lib[1::2])):
        if not embedded:
            a, b = (a + sh, b) if tau < 0 else (a, b - sh)
            a += max(0, -Tp - 1) if Tp < 0 else 0
        b -= Tp if Tp >= 0 and i == len(lib) // 2 - 1 else 0
        rows += range(a - 1, b)
    y = f[target].to_numpy()
    rows = [r for r in rows if 0 <= r < n and 0 <= r + Tp < n and not np.isnan(emb[r]).any() and (valid is None or valid[r])]
    out = {}
    for a, b in zip(pred[::2], pred[1::2]):
        for p in range(a - 1, b):
            if np.isnan(emb[p]).any():
                continue
            c = sorted((round(float(np.sqrt(((emb[p] - emb[r]) ** 2).sum())), 12), abs(p - r), r) for r in rows if abs(p - r) > radius)[: knn or E + 1]
            if not c:
                continue
            d, t = np.array([z[0] for z in c]), np.array([y[z[2] + Tp] for z in c])
            w = np.exp(-d / max(d[0], 1e-6))
            v = (w * t).sum() / w.sum()
            out[p] = ([z[2] for z in c], v, (w * (t - v) ** 2).sum() / w.sum())
    return out


CASES = [
    dict(columns=["x"], target="x", lib=[1, 60], pred=[61, 119], E=3),
    dict(columns=["x"], target="y", lib=[1, 100], pred=[50, 80], E=2, Tp=-2),
    dict(columns=["x"], target="x", lib=[1, 120], pred=[1, 120], E=2, tau=2, Tp=0, radius=4),
    dict(columns=["x", "y"], target="y", lib=[1, 40, 61, 100], pred=[20, 30, 90, 120], E=2, Tp=2, tau=-2),
    dict(columns=["x", "y"], target="x", lib=[1, 80], pred=[60, 120], embedded=True, knn=7),
    dict(columns=["x"], target="x", lib=[1, 9], pred=[1, 30], E=2, knn=12, radius=2),
]


@pytest.mark.parametrize("case", CASES)
@pytest.mark.parametrize("missing", [(), (("x", (5, 6, 70)), ("y", (10, 95)))])
def test_simplex_equals_the_rules(spark, case, missing):
    f = frame(missing=missing)
    df = spark.createDataFrame(f)
    kw = dict(case)
    p = series.prepared(df, [series.task(**kw)], "Time")
    near = neighbors.nearest(p).toPandas()
    made = simplex.forecasts(p).toPandas().set_index("p")
    want = brute(f, **case)
    assert set(made.index) == set(want)
    for q, g in near.sort_values("rank").groupby("p"):
        assert g["l"].tolist() == want[q][0]
        assert g["rank"].tolist() == list(range(1, len(g) + 1))
        assert (g["dist"].diff().dropna() >= -1e-12).all()
        assert ((g["p"] - g["l"]).abs() > case.get("radius", 0)).all()
    for q, (_, v, s) in want.items():
        got = made.loc[q]
        assert (np.isnan(v) and pd.isna(got["predicted"])) or (abs(got["predicted"] - v) < 1e-9 and abs(got["variance"] - s) < 1e-9)


def test_projection_rows_times_and_observations(spark):
    df = spark.createDataFrame(frame(50))
    r = api.Simplex(df, "x", "x", [1, 30], [31, 50], 2, Tp=3).orderBy("row").toPandas()
    assert r["row"].tolist() == list(range(30, 53)) and r["Time"].tolist() == list(range(35, 58))
    assert r["Observations"].notna().sum() == 20 and r["Predictions"].isna().tolist() == [True] * 3 + [False] * 20
    r = api.Simplex(df, "x", "x", [1, 30], [31, 40], 2, Tp=3).orderBy("row").toPandas()
    assert r["Observations"].notna().all() and len(r) == 13
    r = api.Simplex(df, "x", "x", [10, 50], [1, 5], 1, Tp=-2).orderBy("row").toPandas()
    assert r["row"].tolist() == list(range(-2, 5)) and r["Time"].tolist() == list(range(3, 10))
    d = frame(30).assign(Time=[f"{x:%Y-%m-%d}" for x in pd.date_range("2020-01-06", periods=30, freq="7D")])
    r = api.Simplex(spark.createDataFrame(d), "x", "x", [1, 20], [21, 30], 2).orderBy("row").toPandas()
    assert r["Time"].iloc[-1] == "2020-08-03"


def test_valid_rows_many_series_and_no_time(spark):
    f = frame(100)
    valid = ((f["x"] > 0.5) | (f["x"] < 0.2)).tolist()
    p = series.prepared(spark.createDataFrame(f), [series.task("x", "x", [1, 100], [1, 99], 2, valid="x > 0.5 or x < 0.2")], "Time")
    made = simplex.forecasts(p).toPandas().set_index("p")["predicted"]
    want = brute(f, ["x"], "x", [1, 100], [1, 99], 2, valid=valid)
    assert all(abs(made[q] - v[1]) < 1e-9 for q, v in want.items())
    two = pd.concat([f.assign(s="a"), frame(80, 2).assign(s="b", x=lambda d: 1 - d["x"])]).sample(frac=1, random_state=1)
    both = api.Simplex(spark.createDataFrame(two), "x", "x", None, None, 2, series="s").toPandas()
    for s, part in (("a", f), ("b", two[two["s"] == "b"].sort_values("Time"))):
        one = api.Simplex(spark.createDataFrame(part[["Time", "x"]]), "x", "x", None, None, 2).orderBy("row").toPandas()
        assert np.allclose(both[both["series"] == s].sort_values("row")["Predictions"], one["Predictions"], equal_nan=True)
    n = api.Simplex(spark.createDataFrame(f), "x", "x", [1, 60], [61, 90], 2, noTime=True, order=["Time"]).orderBy("row").toPandas()
    assert n["Time"].tolist() == list(range(61, 92)) or n["Time"].tolist()[0] in (61, 62)


@pytest.mark.parametrize("bad", [dict(E=0), dict(tau=0, E=1), dict(lib=[5, 2], E=1), dict(lib=[1, 2, 3], E=1), dict(lib=[0, 5], E=1), dict(columns="", E=1), dict(columns="nope", E=1), dict(exclusionRadius=-1, E=1)])
def test_arguments_are_checked(spark, bad):
    kw = dict(columns="x", target="x", lib=[1, 50], pred=[51, 60]) | bad
    with pytest.raises(ValueError):
        api.Simplex(spark.createDataFrame(frame(60)), **kw)


def test_spans_sizes_and_libraries_are_checked(spark):
    df = spark.createDataFrame(frame(80))
    gappy = spark.createDataFrame(frame(80, missing=(("x", (30,)),)))
    bad = [
        lambda: api.Simplex(df, "x", "x", [1, 60], [61, 5000], 2),
        lambda: api.Simplex(df, "x", "x", [1, 81], [61, 70], 2),
        lambda: api.SMap(df, "x", "x", [1, 60], [61, 81], 2)["predictions"],
        lambda: api.EmbedDimension(df, "x", "x", 3, [1, 60], [61, 90]),
        lambda: api.CCM(df, "x", "y", [10, 500], 2, 2, seed=1),
        lambda: api.CCM(df, "x", "y", [10, 500], 2, 2, seed=1, legacy=True),
        lambda: api.Simplex(df, "x", "x", [1, 60], [61, 70], 2, validLib="Time < 8"),
        lambda: api.Simplex(df, "x", "x", [1, 60], [61, 70], 2, validLib="Time < 0"),
        lambda: api.SMap(df, "x", "x", [1, 60], [61, 70], 2, knn=20, validLib="Time < 15")["predictions"],
        lambda: api.Simplex(gappy, "x", "x", [1, 60], [61, 70], 2, ignoreNan=False),
    ]
    for f in bad:
        with pytest.raises(Exception, match="rows|missing values"):
            f().collect()
    assert api.Simplex(df, "x", "x", [1, 60], [61, 70], 2, ignoreNan=False).count() == 11
    for f in (lambda: api.Simplex(df, "x", "x", E=2), lambda: api.SMap(df, "x", "x", [1, 60], "", 2), lambda: api.PredictInterval(df, "x", "x", 3)):
        for kind in (ValueError, RuntimeError):
            with pytest.raises(kind):
                f()
    with pytest.warns(UserWarning):
        assert api.Simplex(df, "x", "x", [1, 60], [1, 3], 5).count() == 0
    o = api.Simplex(df, "x", "x", [1, 60], [61, 70], 2, returnObject=True)
    assert o.Projection.count() == 11 and o.Neighbors.count() == 30
    if not plots_at_hand():
        with pytest.raises(RuntimeError):
            api.Simplex(df, "x", "x", [1, 60], [61, 70], 2, showPlot=True)


def plots_at_hand():
    import importlib.util

    return importlib.util.find_spec("matplotlib") is not None


def test_more_solvers():
    rng = np.random.default_rng(1)
    a = rng.normal(size=(80, 11))
    c = np.array([2.0, 0, 0, 0, -1.5, 0, 0, 0, 0, 0])
    b = 3 + a[:, 1:] @ c + rng.normal(0, 0.05, 80)
    for name in solvers.SOLVERS:
        got = solvers.solver(name)(a, b)[0]
        assert len(got) == 11 and np.isfinite(got).all(), name
    for name in ("ridge_cv", "lasso_cv", "elastic_net_cv", "lars", "lasso_lars_ic", "sgd"):
        assert np.allclose(solvers.solver(name)(a, b)[0], np.append(3, c), atol=0.15), name
    one = solvers.omp()(a, b)[0]
    assert np.flatnonzero(one[1:]).tolist() == [0] and np.flatnonzero(solvers.omp(2)(a, b)[0][1:]).tolist() == [0, 4]


def test_smap_equals_least_squares(spark):
    f = frame(90, missing=(("y", (20,)),))
    E, theta = 3, 2.5
    got = api.SMap(spark.createDataFrame(f), "x", "y", [1, 60], [50, 85], E, theta=theta)
    pred, coef, sing = (got[k].orderBy("row").toPandas() for k in ("predictions", "coefficients", "singularValues"))
    assert list(coef.columns[2:]) == ["C0", "∂y/∂x(t-0)", "∂y/∂x(t-1)", "∂y/∂x(t-2)"]
    x, y = f["x"].to_numpy(), f["y"].to_numpy()
    rows = np.arange(2, 59)
    emb = lambda r: np.stack([x[r], x[r - 1], x[r - 2]], axis=-1)
    for p in range(49, 85):
        lib = rows[rows != p]
        d = np.sqrt(((emb(np.array([p])) - emb(lib)) ** 2).sum(axis=1))
        o = np.lexsort((lib, np.abs(p - lib), np.round(d, 12)))[: len(rows) - 1]
        d, l = d[o], lib[o]
        w = np.exp(-theta * d / d.mean())
        t = y[l + 1]
        ok = np.isfinite(t)
        a = w[ok, None] * np.column_stack([np.ones(ok.sum()), emb(l[ok])])
        c, _, _, s = np.linalg.lstsq(a, w[ok] * t[ok], rcond=None)
        v = c[0] + c[1:] @ emb(np.array([p]))[0]
        at = pred["row"] == p + 1
        assert abs(pred.loc[at, "Predictions"].iloc[0] - v) < 1e-8
        assert np.allclose(coef.loc[coef["row"] == p + 1].iloc[0, 2:].astype(float), c, atol=1e-7)
        assert np.allclose(sing.loc[sing["row"] == p + 1].iloc[0, 2:].astype(float), s, atol=1e-7)


def test_solvers(spark):
    rng = np.random.default_rng(0)
    a = rng.normal(size=(50, 4))
    b = 3 + a[:, 1:] @ np.array([1.0, -2.0, 0.0])
    assert np.allclose(solvers.ols(a, b)[0], [3, 1, -2, 0])
    assert np.allclose(solvers.ridge(0.0)(a, b)[0], [3, 1, -2, 0])
    assert np.allclose(solvers.elastic_net(1e-9)(a, b)[0], [3, 1, -2, 0], atol=1e-4)
    assert abs(solvers.lasso(0.5)(a, b)[0][3]) < 1e-9
    x = np.array([[1.0, 2.0, 4.0]] * 5)
    assert np.allclose(x @ solvers.lstsq(x, np.ones(5))[0], 1)
    df = spark.createDataFrame(frame(60))
    one = api.SMap(df, "x", "x", [1, 40], [41, 55], 2, theta=1, solver=lambda a, b: solvers.lstsq(a, b))["predictions"].orderBy("row").toPandas()
    two = api.SMap(df, "x", "x", [1, 40], [41, 55], 2, theta=1)["predictions"].orderBy("row").toPandas()
    assert np.allclose(one["Predictions"].astype(float), two["Predictions"].astype(float), equal_nan=True)


def test_cross_mapping(spark):
    f = frame(80, missing=(("y", (7,)),))
    df = spark.createDataFrame(f)
    r = ccm.ccm(df, "x", "y", [10, 40], 4, 2, seed=9, time="Time").toPandas()
    x, y = f["x"].to_numpy(), f["y"].to_numpy()
    rows = np.array([i for i in range(1, 80) if np.isfinite(y[i])])
    emb, t = np.column_stack([x[rows], x[rows - 1]]), y[rows]
    rng = np.random.default_rng(np.random.SeedSequence(9))
    for s in range(4):
        lib = np.sort(rng.choice(len(rows), 40, replace=False))
        made = []
        for i in range(len(rows)):
            c = sorted((float(np.sqrt(((emb[i] - emb[j]) ** 2).sum())), j) for j in lib if j != i)[:3]
            d = np.array([z[0] for z in c])
            w = np.exp(-d / d[0]) if d[0] > 0 else (d == 0).astype(float)
            made.append((w * t[[z[1] for z in c]]).sum() / w.sum())
        got = r[(r["direction"] == "x:y") & (r["lib_size"] == 40) & (r["sample"] == s)]["rho"].iloc[0]
        assert abs(got - np.corrcoef(made, t)[0, 1]) < 1e-9
    assert ccm.library_sizes([10, 30, 10]) == [10, 20, 30] and ccm.library_sizes("10 20 30 40") == [10, 20, 30, 40]
    m = api.CCM(df, "x", "y", [10, 40], 4, 2, seed=9, includeData=True)
    assert set(m["libMeans"].columns) == {"LibSize", "x:y", "y:x", "x:y_var", "y:x_var"}
    assert api.CCM(df, "x", "y", [10, 40], 3, 2, seed=9, legacy=True).count() == 2
    with pytest.raises(ValueError):
        ccm.ccm(df, "x", "y", [2], 4, 2, time="Time")
    few = ccm.ccm(df.limit(3), "x", "y", [10], 2, 2, time="Time").toPandas()
    assert few["rho"].isna().all()
    x3 = api.CCM_Matrix(df.select("Time", "x", "y"), 2, [10, 40, 70], sample=3, seed=9, expConverge=True)
    long = x3["rho"].toPandas()
    assert len(long) == 12 and long[long["source"] == long["target"]]["rho"].isna().all() and x3["slope"].count() == 2 and x3["exp_a"].count() == 2


def test_sweeps_and_maps(spark):
    f = frame(100)
    df = spark.createDataFrame(f)
    e = api.EmbedDimension(df, "x", "x", 4, [1, 60], [61, 95]).orderBy("E").toPandas()
    for row in e.itertuples():
        w = brute(f, ["x"], "x", [1, 60], [61, 95], row.E)
        o, p = zip(*[(f["x"].iloc[q + 1], v[1]) for q, v in w.items()])
        assert abs(row.rho - np.corrcoef(o, p)[0, 1]) < 1e-6
    m = api.CrossMap_Matrix(df, 2, lib=[1, 60], pred=[61, 95], returnValue="long").toPandas().set_index(["source", "target"])["rho"]
    c = api.CrossMap_Columns(df, "y", 2, lib=[1, 60], pred=[61, 95], returnError=True).toPandas().set_index("columns")["rho"]
    assert abs(m["x", "y"] - c["x"]) < 1e-9 and abs(m["y", "y"] - c["y"]) < 1e-9
    assert api.CrossMap_Matrix(df, 2, lib=[1, 60], pred=[61, 95], threshold=2.0).toPandas()[["x", "y"]].isna().all().all()
    assert set(api.CrossMap_ColumnList(df, ["x", ["x", "y"]], "y", 1, lib=[1, 60], pred=[61, 95]).select("columns").distinct().toPandas()["columns"]) == {"x", "x y"}
    best = api.EmbedDim_Columns(df, "x", 4, lib=[1, 60], pred=[61, 95], columns=["x"]).collect()[0]
    assert best.E == e.loc[e["rho"].idxmax(), "E"]
    flat = spark.createDataFrame(f.assign(x=1.0))
    assert api.EmbedDim_Columns(flat, "x", 3, lib=[1, 60], pred=[61, 95], columns=["x"]).collect()[0].E == 0
    n = api.PredictNonlinear(df, "x", "x", [0.5, 3], [1, 60], [61, 95], 2)
    assert n.count() == 2 and api.PredictInterval(df, "x", "x", [1, 60], [61, 95], 3, 2).count() == 3
    assert api.PredictExclusionRadius(df, "x", "x", [1, 60], [1, 60], E=2).count() == 18
    mv = api.Multiview(df, "x y", "x", [1, 60], [61, 95], E=2, trainLib=False)
    v = mv["View"].orderBy("rank").toPandas()
    assert len(v) == 2 and v["rho"].is_monotonic_decreasing and mv["Predictions"].count() == 36
    # rows as of a single map: ten predicted ones and the Tp that they reach beyond
    th = api.SMap_theta(df, [0, 2], "x", "x", 2, lib=[1, 60], pred=[61, 70]).orderBy("row").toPandas()
    assert len(th) == 22 and set(th["theta"]) == {0.0, 2.0}
    tp = api.SMap_Tp(df, [1, 2], "x", "x", 2, theta=2, lib=[1, 60], pred=[61, 70]).orderBy("row").toPandas()
    assert len(tp) == 11 + 12
    for theta, part in th.groupby("theta"):
        one = api.SMap(df, "x", "x", [1, 60], [61, 70], 2, theta=theta)["predictions"].orderBy("row").toPandas()
        for c in ("row", "Time", "Observations", "Predictions", "Pred_Variance"):
            assert np.allclose(part[c].astype(float), one[c].astype(float), equal_nan=True)
    assert np.allclose(tp[tp["Tp"] == 1]["Predictions"].astype(float), th[th["theta"] == 2]["Predictions"].astype(float), equal_nan=True)


def test_generate_and_surrogates(spark):
    f = frame(80)
    df = spark.createDataFrame(f)
    g = api.Simplex(df, "x", "x", [1, 80], [1, 2], 2, generateSteps=10).orderBy("step").toPandas()
    first = api.Simplex(df, "x", "x", [1, 80], [79, 80], 2).orderBy("row").toPandas()["Predictions"].iloc[-1]
    assert len(g) == 10 and abs(g["Predictions"].iloc[0] - first) < 1e-12 and g["Time"].tolist() == list(range(85, 95))
    assert api.SMap(df, "x", "x", [1, 80], [1, 2], 2, theta=3, generateSteps=5, generateConcat=True)["predictions"].count() == 85
    with pytest.raises(ValueError):
        generate.generated(df, series.task("x", "y", E=2), 3, time="Time")
    x = np.sort(f["x"])
    for method in surrogate.METHODS:
        s = api.SurrogateData(df, "x", method, 3, seed=4).toPandas()
        assert list(s.columns) == ["row", "Time", "x_1", "x_2", "x_3"] and len(s) == 80
        if method == "random_shuffle":
            assert np.allclose(np.sort(s["x_2"]), x)
        if method == "ebisuzaki":
            a, b = np.abs(np.fft.rfft(s.sort_values("row")["x_1"])), np.abs(np.fft.rfft(f["x"]))
            assert np.corrcoef(a[1:-1], b[1:-1])[0, 1] > 0.999
    y = np.sin(np.arange(200) / 9.0)
    assert abs(((surrogate.smoothed(y + 0.1, 0.8) - y - 0.1) ** 2).sum() - 0.8) < 0.01


def test_convergence_rate():
    x = np.linspace(0.05, 1, 12)
    for a in (0.5, 3.0, 20.0):
        assert abs(convergence.rate(x, 0.1 + 0.6 * (1 - np.exp(-a * x))) - a) < 0.02 * a
    assert np.isnan(convergence.rate(x[:2], x[:2]))


def test_embedding_names(spark):
    df = spark.createDataFrame(frame(10))
    assert api.Embed(df, 2, -1, "x y").columns == ["x(t-0)", "y(t-0)", "x(t-1)", "y(t-1)"]
    assert api.Embed(df, 3, 2, "x", includeTime=True).columns == ["Time", "x(t+0)", "x(t+2)", "x(t+4)"]
    assert api.Embedding(df, "x", 2, plusminus=True).columns == ["Time", "x", "x(t-1)", "x(t+1)"]
    odd = spark.createDataFrame(frame(10).rename(columns={"x": "a b.c"}))
    assert api.Embed(odd, 2, -1, ["a b.c"]).columns == ["a b.c(t-0)", "a b.c(t-1)"]
    with pytest.raises(RuntimeError):
        api.MakeBlock()
    assert sweep.RADII[-1] == 30 and smap.CELLS > 0
