import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from tidelag.functions.dates import parsed
from tidelag.operators import grid

READ = {
    "2020-01-02": "2020-01-02 00:00:00", " 2020/1/2 ": "2020-01-02 00:00:00", "20200102": "2020-01-02 00:00:00", "2020-01-02 03:04": "2020-01-02 03:04:00",
    "2020-01-02T03:04:05Z": "2020-01-02 03:04:05", "2020-01-02T03:04:05+05:30": "2020-01-01 21:34:05", "2020/01/02 03:04:05": "2020-01-02 03:04:05",
    "02-Jan-2020": "2020-01-02 00:00:00", "January 2, 2020 3:04": "2020-01-02 03:04:00", "2020-02-30": None, "2020-13-01": None, "1976-11": None, "n/a": None, "": None, None: None,
}


def test_dates(spark):
    df = spark.createDataFrame([(s,) for s in READ], "s string")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        got = {r.s: r.t for r in df.select("s", F.unix_seconds(parsed(F.col("s"))).alias("t")).collect()}
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    want = {k: None if v is None else int(dt.datetime.fromisoformat(v + "+00:00").timestamp()) for k, v in READ.items()}
    assert got == want


def weeks(spark, rows):
    return spark.createDataFrame(rows, "g string, at timestamp, v double, id long, step string, value string, src string")


def test_grid_edge_cases(spark):
    t = lambda d: dt.datetime(2020, 1, 6) + dt.timedelta(days=d)
    x = ("x", "x", "x")
    rows = [("a", t(0), 1.0, 1, *x), ("a", t(2), 2.0, 2, *x), ("a", t(2), 2.0, 2, *x), ("a", t(6.9), 3.0, 3, *x), ("a", t(28), 5.0, 4, *x), ("a", None, 9.0, 5, *x), ("a", t(14), None, 6, *x), ("a", t(14), float("nan"), 7, *x), (None, t(0), 4.0, 8, *x), ("b", None, 1.0, 9, *x)]
    got = grid.regular(weeks(spark, rows), "g", "at", "v", "id").orderBy("g", "step").collect()
    assert [(r.g, r.status, r.n_readings, r.value) for r in got if r.status == "observed"] == [(None, "observed", 1, 4.0), ("a", "observed", 3, 3.0), ("a", "observed", 1, 5.0)]
    assert [(r.g, r.start.day, r.status, r.value) for r in got if r.status != "observed"] == [("a", d, "unsupported", None) for d in (13, 20, 27)]
    assert grid.regular(weeks(spark, rows[:0]), "g", "at", "v", "id").count() == 0


def test_held_out_cells_are_filled_better_than_by_the_mean(spark):
    rng = np.random.default_rng(2)
    t0 = dt.datetime(2015, 1, 5)
    season, trend = np.sin(np.arange(150) * 2 * np.pi / 52), rng.normal(0, 1, 150).cumsum() * 0.1
    rows, truth = [], {}
    for g in range(40):
        level, a, b = rng.uniform(1, 6), rng.uniform(0.3, 1.5), rng.uniform(-1, 1)
        for w in range(150):
            y = float(np.expm1(max(0.1, level + a * season[w] + b * trend[w] + rng.normal(0, 0.05))))
            if 0 < w < 149 and rng.uniform() < 0.2:
                truth[f"g{g}", w] = y
            else:
                rows.append((f"g{g}", t0 + dt.timedelta(days=7 * w + int(rng.integers(0, 7))), y, g * 1000 + w, "", "", ""))
    got = grid.regular(weeks(spark, rows), "g", "at", "v", "id").toPandas()
    first = got["step"].min()
    made = {(r.g, r.step - first): r.value for r in got.itertuples() if r.status == "filled"}
    assert set(made) == set(truth)
    seen = got[got["status"] == "observed"]
    mean = {g: np.log1p(p["value"]).mean() for g, p in seen.groupby("g")}
    e = np.array([np.log1p(made[k]) - np.log1p(truth[k]) for k in truth])
    m = np.array([mean[k[0]] - np.log1p(truth[k]) for k in truth])
    assert np.sqrt((e**2).mean()) < 0.35 * np.sqrt((m**2).mean())
    assert {(r[0], r[3] % 1000): r[2] for r in rows} == {(r.g, r.step - first): r.value for r in seen.itertuples()}


def test_many_blocks_are_joined_to_the_rows(spark, monkeypatch):
    """Factors that go along with the tasks, and factors that are joined, fill alike."""
    rng = np.random.default_rng(2)
    x = ("x", "x", "x")
    t0 = dt.datetime(1900, 1, 1)
    rows = [(g, t0 + dt.timedelta(weeks=int(w)), float(10 + k + np.sin(w / 8)), int(1000000 * k + w), *x) for k, g in enumerate("abcd") for w in np.unique(rng.integers(0, 9000, 500))]
    rows += [(None, t0, 1.0, -1, *x), (None, t0 + dt.timedelta(weeks=9000), 1.0, -2, *x)]
    got = []
    for few in (64, 1):
        monkeypatch.setattr(grid, "FEW_BLOCKS", few)
        got.append({(r.g, r.step): (r.status, r.value) for r in grid.regular(weeks(spark, rows), "g", "at", "v", "id").collect()})
    assert got[0].keys() == got[1].keys() and len(got[0]) > 40_000
    assert all(a[0] == got[1][k][0] and (a[1] == got[1][k][1] or abs(a[1] - got[1][k][1]) < 1e-9) for k, a in got[0].items())
