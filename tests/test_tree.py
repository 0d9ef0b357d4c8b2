"""Long series: wide blocks meet a tree of the library, with the rows of the search by brute force."""

import numpy as np
import pandas as pd
import pytest

from tidelag.operators import neighbors, series, simplex, tree
from tidelag.plans import catalog


def made(kind, n, dims, rng):
    if kind == "even":
        return rng.normal(size=(n, dims))
    if kind == "far":  # long bad tails
        return np.round(rng.exponential(1.0, (n, dims)) ** 4, 2)
    if kind == "tied":
        return rng.integers(0, 4, (n, dims)).astype(float)
    return np.ones((n, dims))


@pytest.mark.parametrize("kind", ["even", "far", "tied", "one"])
@pytest.mark.parametrize("dims, radius", [(1, 0), (3, 0), (3, 6), (6, 2)])
def test_tree_equals_brute_force(monkeypatch, kind, dims, radius):
    for name, v in (("LEAF", 3), ("GROUP", 5), ("FEW", 2), ("MANY", 20), ("STRETCH", 64)):
        monkeypatch.setattr(tree, name, v)
    rng = np.random.default_rng(dims)
    x, row, k = made(kind, 300, dims, rng), np.arange(300) * 2 + 5, 4
    at = np.arange(0, 300, 3)  # these are predicted too, and lie within each other's radius
    q, p = np.concatenate([x[at], made(kind, 40, dims, rng)]), np.concatenate([row[at], 700 + np.arange(40)])
    most = k + 2 * radius + 1
    t = tree.grown(x.T, most)
    got = {}
    for of, point, d2 in tree.closest(t, q.T, most, 2e-12, 1 << 10, neighbors.best):
        pair, near = tree.rows_near(t, row, p[of], point, k, radius)
        a = of[pair]
        for i, l in zip(*neighbors.trimmed(a, row[near], np.sqrt(d2[pair]), np.abs(p[a] - row[near]), near[:, None], k)[:2]):
            got.setdefault(int(i), []).append(int(l))
    for i in range(len(q)):
        d = np.round(np.sqrt(tree.squared(q[i : i + 1].T, x.T)[0]), neighbors.PLACES)
        gap = np.abs(row - p[i])
        o = [j for j in np.lexsort((row, gap, d)) if gap[j] > radius][:k]
        assert got[i] == row[o].tolist(), i


def test_few_vectors(monkeypatch):
    t = tree.grown(np.array([[1.0, 1.0, 2.0]]), 5)
    assert [len(z) for z in next(tree.closest(t, np.zeros((1, 2)), 5, 0, 64, neighbors.best))] == [4, 4, 4]
    assert not list(tree.closest(t, np.zeros((1, 0)), 5, 0, 64, neighbors.best))
    assert not tree.fit(np.array([[1.0, np.inf]])) and tree.fit(np.array([[-3.0]]))


TASKS = [
    series.task("x", "x", E=3), series.task("x y", "y", [1, 300, 360, 600], [200, 640], E=2, Tp=-2, radius=3), series.task("x", "x", E=2, tau=3, Tp=0, knn=9),
    series.task("x", "y", E=3, radius=2, valid="y > 0"), series.task("x y", "x", embedded=True), series.task("x", "x", E=2, radius=70), series.task("x", "x", [1, 50], [51, 900], E=1),
]


@pytest.mark.parametrize("fit", [True, False])
def test_wide_blocks_change_nothing(spark, monkeypatch, fit):
    rng = np.random.default_rng(8)
    parts = []
    for name, n in (("a", 900), ("b", 640), ("c", 5), (None, 700)):
        x = np.round(rng.normal(size=n).cumsum(), 1)
        x[rng.uniform(size=n) < 0.05] = np.nan
        parts.append(pd.DataFrame({"s": name, "t": np.arange(n) * 3, "x": x, "y": np.round(np.roll(x, 1) * 0.5 + rng.normal(size=n), 1)}))
    df = spark.createDataFrame(pd.concat(parts).sample(frac=1, random_state=1), "s string, t long, x double, y double")

    def all_of():
        p = series.prepared(df, TASKS, "t", "s")
        near = {(r.series, r.task, r.p, r["rank"]): (r.l, r.dist, r.y) for r in neighbors.nearest(p).collect()}
        f = {(r.series, r.task, r.p): (r.n_near, r.obs, r.predicted, r.variance) for r in simplex.forecasts(p).collect()}
        return near, f

    want = all_of()
    for name, v in (("BLOCK", 8), ("PIECE", 32), ("SHARE", 4), ("WIDE", 190), ("HELD", 250), ("SUB", 40), ("CELLS", 256)):
        monkeypatch.setattr(neighbors, name, v)
    monkeypatch.setattr(tree, "LEAF", 4)
    if not fit:
        monkeypatch.setattr(neighbors, "TREE_K", 0)
    for a, b in zip(want, all_of()):
        assert a.keys() == b.keys() and a
        assert all(np.allclose(np.array(a[k], float), np.array(b[k], float), atol=1e-9, equal_nan=True) for k in a)


def test_library_of_a_long_series_moves_few_times(spark):
    """Before, it moved once for each 1024 predicted rows."""
    n = 60_000
    df = spark.range(n).selectExpr("id AS t", "pmod(id * 7919, 1009) / 10 AS x")
    p = series.prepared(df, [series.task("x", "x", [1, n // 10], [n // 10 + 1, n], E=3)], "t")
    # what the search is given: the rows of the plan below it
    given = neighbors.nearest(p)._jdf.queryExecution().analyzed().children().head()
    seen = spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(spark._jsparkSession, given).count()
    assert n * 0.9 <= seen <= n + 20 * n // 10


def test_long_query_equals_its_sql(spark, tmp_path):
    """A series of 40,000 events with copies and equal times; its SQL is met row by row."""
    duckdb = pytest.importorskip("duckdb")
    rng = np.random.default_rng(2)
    v = np.tile(np.round(rng.exponential(50, 4000), 0), 10)
    ts = pd.Timestamp("2024-01-01") + pd.to_timedelta(np.sort(rng.integers(0, 9000, len(v))), unit="s")
    spark.createDataFrame(pd.DataFrame({"event_id": rng.permutation(len(v)), "ts": ts, "value": v})).selectExpr("event_id", "cast(ts AS timestamp_ntz) AS ts", "value").write.parquet(str(tmp_path / "events.parquet"))
    got = {r.row: r.predicted for r in catalog.queries()["simplex_long_series"](spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = dict(con.sql(catalog.oracle_sql()["simplex_long_series"]).fetchall())
    assert got.keys() == want.keys() and len(got) == 36_000
    assert all(got[k] == pytest.approx(want[k], abs=2e-6) for k in want)
