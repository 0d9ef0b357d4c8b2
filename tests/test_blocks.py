"""Large tables take other ways than small ones: blocks, pieces and ranges so small that every way is taken change nothing."""

import numpy as np
import pandas as pd
import pytest

from tidelag.operators import ccm, neighbors, series, simplex, smap, sweep


def table(spark, seed=3):
    rng = np.random.default_rng(seed)
    parts = []
    for name, n in (("a", 130), ("b", 41), ("c", 3), (None, 64)):
        x = np.round(rng.normal(size=n).cumsum(), 1)
        x[rng.uniform(size=n) < 0.05] = np.nan
        parts.append(pd.DataFrame({"s": name, "t": np.arange(n) * 3, "x": x, "y": np.round(np.roll(x, 1) * 0.5 + rng.normal(size=n), 1)}))
    return spark.createDataFrame(pd.concat(parts).sample(frac=1, random_state=1), "s string, t long, x double, y double")


@pytest.fixture
def small(monkeypatch):
    def on():
        for name, v in (("BLOCK", 7), ("PIECE", 20), ("CELLS", 256)):
            monkeypatch.setattr(neighbors, name, v)
        monkeypatch.setattr(ccm, "BLOCK", 7)
        monkeypatch.setattr(ccm, "PIECE", 20)
        monkeypatch.setattr(smap, "CELLS", 64)
        monkeypatch.setattr(smap, "PIECE", 20)
        for name, v in (("BIG_BYTES", -1), ("BIG_ROWS", -1), ("SPAN", 9), ("RANGES", 6)):
            monkeypatch.setattr(series, name, v)

    return on


TASKS = [series.task("x", "x", E=3), series.task("x y", "y", [1, 30, 36, 60], [20, 64], E=2, Tp=-2, radius=3), series.task("x", "x", E=2, tau=3, Tp=0, knn=9), series.task("x", "y", E=3, radius=2, valid="y > 0"), series.task("x y", "x", embedded=True)]


def rows(df, *keys):
    cols = [c for c in df.columns if c not in keys]
    return {tuple(r[k] for k in keys): [r[c] for c in cols] for r in df.collect()}


def same(a, b):
    flat = lambda v: [x for y in v for x in (y if isinstance(y, list) else [y])]
    assert a.keys() == b.keys() and a
    for k in a:
        assert np.allclose(np.array(flat(a[k]), float), np.array(flat(b[k]), float), atol=1e-9, equal_nan=True), k


def test_neighbours_and_forecasts(spark, small):
    df = table(spark)

    def all_of():
        p = series.prepared(df, TASKS, "t", "s")
        q = series.prepared(df, [series.with_task(t, knn=0) for t in TASKS[:2]], "t", "s")
        return [
            rows(neighbors.nearest(p), "series", "task", "p", "rank"),
            rows(simplex.forecasts(p), "series", "task", "p"),
            rows(smap.forecasts(q, [0.0, 2.0]), "series", "task", "theta", "p"),
            rows(simplex.run(df, TASKS[:1], "t", "s"), "series", "seg", "row"),
            rows(sweep.cross_map_matrix(df, "x y", 2, Tp=1, time="t", series="s"), "series", "source", "target"),
            rows(series.embed(df, 2, -4, "x", "t", "s", keep_row=True), "series", "row"),
        ]

    want = all_of()
    small()
    for a, b in zip(want, all_of()):
        same(a, b)


@pytest.mark.parametrize("sampler", ["numpy", "hash"])
def test_cross_mapping(spark, small, sampler):
    df = table(spark)

    def all_of():
        return [
            rows(ccm.ccm(df, "x", "y", [6, 20, 40], 3, 2, Tp=1, radius=1, seed=5, time="t", series="s", sampler=sampler), "series", "direction", "lib_size", "sample"),
            rows(ccm.ccm_matrix(df, "x y", [2, 3], [6, 20], sample=2, seed=5, time="t", series="s", sampler=sampler), "series", "source", "target", "lib_size"),
            rows(ccm.ccm_projected(df, "x", "y", [6, 20], 2, 2, Tp=2, radius=1, seed=5, time="t", series="s"), "series", "direction", "lib_size", "sample"),
        ]

    want = all_of()
    small()
    for a, b in zip(want, all_of()):
        same(a, b)


def test_equal_times_and_missing_ones_in_ranges(spark, small):
    df = spark.createDataFrame([(None, 1.0), (5, 2.0), (5, 2.0), (7, 3.0), (9, 4.0), (9, 4.0)], "t long, x double")
    a = rows(series.numbered(df, ["x"], "t")[0], "row")
    small()
    assert rows(series.numbered(df, ["x"], "t")[0], "row") == a and len(a) == 6
    assert series.numbered(df.limit(0), ["x"], "t")[0].count() == 0
