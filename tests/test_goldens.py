"""Published results of the operations, as plain numbers: a circle sampled 200 times, and two yearly series."""

import numpy as np
import pandas as pd
import pytest

from tidelag import api

# Yearly anomalies from 1929 on.
ANCHOVY = [
    -0.00759874, -0.00960162, -0.00844418, -0.0083536, -0.00774971, -0.00953117, -0.00996395, -0.00780004, -0.00745783, 0.00347246, 0.0241555, 0.0872412, -0.0587879, -0.0633271, -0.0109906, 0.044919,
    -0.060197, -0.00119757, 0.381222, -0.193595, -0.180078, 0.0274466, 0.0393331, 1.10901, 0.67943, -1.00173, 0.0440333, 0.271627, -0.382782, -0.670421, -0.109504, -0.0565636,
    0.052538, -0.12137, 0.0331634, 0.00109718, 0.00917916, 1.28563, 0.159526, -0.889802, 2.37595, 1.30074, -2.35977, 1.10143, 2.89919, -2.29245, 3.46014, -1.5453,
    -0.623298, -4.53241, 1.88048, -0.307508, 0.454131, -0.510584, -1.91097, -0.0857413, -0.071862, -0.0127418, -0.0155096, -0.00372382, 0.0408327, 0.0301138, 0.0324589, -0.15393,
    0.0338881, -0.0168885, -0.00304948, 0.119509, 0.0573892, -0.223024, 0.179937, 0.323007, 0.367091, -0.741992, -0.157825, 0.249897, 0.213121, 0.0730902,
]
NP_SST = [
    -0.347846, 0.328734, 1.61027, 1.26534, 0.0400459, -0.691345, -0.586502, 0.665017, 0.421038, 0.551965, 0.441628, 0.777714, 1.63382, 1.59282, 1.38009, 0.331645,
    -0.0138251, -0.117138, 0.35607, -0.0844464, -0.525395, -1.14218, -1.04257, -1.48325, -1.70846, -2.21847, -2.19432, -2.07212, -1.10831, 0.268469, 1.61014, 1.44651,
    0.477878, -0.701946, -0.407587, -0.383447, -0.0187285, -0.0329409, 0.337691, 0.304107, 0.051485, -0.294818, -0.772071, -0.708921, -0.712736, -0.637847, -1.38128, -0.838455,
    -0.305491, 0.907717, 0.29779, -0.102225, -0.296162, -0.043215, 1.01859, 1.67348, 1.67402, 1.20355, 0.713725, 0.77306, 0.73088, 0.718023, 0.501144, 0.897233,
    1.28284, 1.96306, 0.791977, -0.307302, -0.0387739, 0.444062, -0.230065, -1.33349, -2.19937, -1.18642, -1.34262, -0.530206, -0.757965, -0.583363,
]


def circle(spark, missing=False):
    t = np.arange(1, 201)
    a = 4 * np.pi * (t - 1) / 199
    f = pd.DataFrame({"Time": t, "x": np.round(np.sin(a), 4), "y": np.round(np.cos(a), 4)})
    if missing:
        f.loc[[5, 6, 12], "x"] = np.nan
        f.loc[[10, 11, 17], "y"] = np.nan
    return spark.createDataFrame(f)


# arguments; rows, predictions, observations, first and last Time, sums of predictions and variances, three rows of (Time, prediction, variance)
SIMPLEX = [
    (dict(columns="x", target="x", lib=[1, 200], pred=[1, 200], E=2, validLib="x > 0.5 or x < -0.5"), False,
     (200, 199, 199, 2, 201, 1.288854, 1.076628), [(3, 0.5891157, 0.000431296), (102, 0.194217, 0.295576879), (201, -0.5467675, 0.004019509)]),
    (dict(columns="x", target="x", lib=[1, 40, 50, 130], pred=[80, 170], E=2, tau=-3), False,
     (92, 91, 92, 80, 171, 10.728283, 0.208754), [(81, -0.951636, 0.000523), (126, 0.99789, 0.000004), (171, -0.967678, 0.00009)]),
    (dict(columns="x", target="y", lib=[1, 100], pred=[21, 81], E=2, exclusionRadius=5), False,
     (62, 61, 62, 21, 82, 29.449534, 0.536956), [(22, -0.387607, 0.002034), (52, 0.985612, 0.000068), (82, -0.175724, 0.002327)]),
    (dict(columns="x", target="y", lib=[1, 100], pred=[1, 95], E=2), True,
     (95, 80, 92, 2, 96, -6.87721, 29.537313), [(3, -0.27715, 0.90803), (57, -0.301104, 0.791889), (96, 0.353929, 0.755584)]),
    (dict(columns="y", target="x", lib=[1, 200], pred=[1, 195], E=2), True,
     (195, 184, 192, 2, 196, -8.471405, 3.655871), [(3, 0.109745, 0.001357), (102, 0.116449, 0.001403), (196, -0.237889, 0.001289)]),
]
MAPS = [
    (dict(columns="x", target="x", lib=[1, 100], pred=[110, 160], E=4, theta=3), False,
     (52, 51, 52, 110, 161, 24.791243, 5.907696), [(111, 0.615563, 0.119682), (136, 0.783194, 0.074118), (161, -0.627871, 0.109233)]),
    (dict(columns=["x", "y"], target="x", lib=[1, 200], pred=[1, 200], E=2, theta=3, embedded=True), False,
     (201, 200, 200, 1, 201, 0.063111, 43.394075), [(2, 0.063108, 0.241006), (102, 0.094613, 0.240764), (201, 0.063107, 0.230591)]),
    (dict(columns="x", target="y", lib=[1, 50], pred=[1, 50], E=2, theta=3), True,
     (50, 44, 47, 2, 51, -6.27514, 38.41946), [(3, 0.991677, 2.020588), (30, -0.257191, 0.126606), (51, -1.000949, 1.855146)]),
    (dict(columns="x", target="y", lib=[1, 100], pred=[101, 150], E=2, theta=3, noTime=True, order=["Time"]), False,
     (51, 50, 51, 101, 151, -2.247351, 49.030884), [(102, 0.996528, 1.975426), (127, -0.102457, 0.264421), (151, -0.999296, 1.646614)]),
]


def check(df, total, three):
    d = df.orderBy("row").toPandas()
    p = d.dropna(subset=["Predictions"])
    got = (len(d), len(p), d["Observations"].notna().sum(), d["Time"].iloc[0], d["Time"].iloc[-1])
    assert got == total[:5]
    assert p["Predictions"].sum() == pytest.approx(total[5], abs=1e-4) and p["Pred_Variance"].sum() == pytest.approx(total[6], abs=1e-4)
    for t, value, variance in three:
        r = d[d["Time"] == t].iloc[0]
        assert r["Predictions"] == pytest.approx(value, abs=1e-6) and r["Pred_Variance"] == pytest.approx(variance, abs=1e-6)


@pytest.mark.parametrize("args,missing,total,three", SIMPLEX)
def test_simplex(spark, args, missing, total, three):
    check(api.Simplex(circle(spark, missing), **args), total, three)


@pytest.mark.parametrize("args,missing,total,three", MAPS)
def test_maps(spark, args, missing, total, three):
    got = api.SMap(circle(spark, missing), **args)
    check(got["predictions"], total, three)
    if args.get("embedded"):
        c = got["coefficients"].toPandas()
        assert round(c["∂x/∂x"].astype(float).mean(), 5) == 0.99801 and round(c["∂x/∂y"].astype(float).mean(), 5) == 0.06311


def test_cross_mapping_of_yearly_series(spark):
    df = spark.createDataFrame(pd.DataFrame({"year": np.arange(1929, 2007), "anchovy": ANCHOVY, "np_sst": NP_SST}))
    got = {r.LibSize: (r["anchovy:np_sst"], r["np_sst:anchovy"]) for r in api.CCM(df, "anchovy", "np_sst", "10 50 75", sample=100, E=3, seed=777).collect()}
    want = {10: (0.100812, -0.043532), 50: (0.198252, -0.056734), 75: (0.208565, -0.059819)}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-6) for k in want)


# equal distances on the circle may be settled another way: to half a thousandth
CIRCLES = [
    (dict(libSizes=[10, 100, 190], sample=20, Tp=5), True, {10: (0.185614, 0.158176), 100: (0.768996, 0.768001), 190: (0.987144, 0.993086)}),
    (dict(libSizes=[20, 120, 170], sample=10, Tp=-5), False, {20: (0.240346, 0.196157), 120: (0.827736, 0.876877), 170: (0.971572, 0.976172)}),
    (dict(libSizes=[20, 110, 200], sample=10, Tp=3, exclusionRadius=5), False, {20: (-0.201192, -0.183963), 110: (0.439434, 0.432667), 200: (0.936753, 0.994713)}),
    (dict(libSizes=[20, 110, 200], sample=10, tau=3), False, {20: (0.554269, 0.552337), 110: (0.997994, 0.998792), 200: (0.999952, 0.999955)}),
]


@pytest.mark.parametrize("args,missing,want", CIRCLES)
def test_cross_mapping_of_the_circle(spark, args, missing, want):
    got = {r.LibSize: (r["x:y"], r["y:x"]) for r in api.CCM(circle(spark, missing), "x", "y", E=2, seed=777, **args).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=5e-4) for k in want)
