import datetime as dt
import subprocess
import sys
from pathlib import Path

import numpy as np
import pytest

from tidelag.plans import catalog

NAMES = ["embed_lead", "csv_and_back", "feather_and_back", "simplex_beyond_the_end", "smap_variance_e1", "smap_coefficient_rows", "smap_theta_frames", "ccm_variances", "ccm_projected_full", "crossmap_threshold", "generate_simplex_steps", "disjoint_lib", "remove_nan", "knn_deficient", "simplex_missing", "simplex_projection_format", "simplex_every_series", "simplex_every_customer", "simplex_long_series", "smap_coefficients_e1", "smap_e2_embedded", "predict_interval", "predict_nonlinear", "smap_theta_rows_e1", "smap_tp_rows_e1", "ccm_hash_sample", "ccm_matrix_slope", "multiview_view", "multiview_predict", "multiview_train_lib", "crossmap_matrix", "embed_dim_columns_first", "surrogate_random_shuffle", "p3_found", "p3_observed"]


@pytest.mark.parametrize("name", NAMES)
def test_queries_equal_their_sql(spark, oracle, name):
    oracle(spark, catalog.queries()[name], catalog.oracle_sql()[name])


def test_every_sql_has_a_query():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) > 60


def test_core_does_without_the_subpackage():
    """Nothing outside the subpackage imports it."""
    root = Path(__file__).resolve().parent.parent
    code = "import sys; sys.modules['tidelag.llm'] = None; import __spark_entry__ as e, tidelag.api, tidelag.cli; assert 'p2_found' in e.queries() and 'p5_found' not in e.queries()"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=root)


def test_every_series_is_forecast(spark, tmp_path):
    """Users of any id, against brute force and the query's SQL."""
    duckdb = pytest.importorskip("duckdb")
    rng = np.random.default_rng(4)
    daily = {u: rng.integers(100, 9999, n) / 100 for u, n in ((3, 12), (39, 9), (40, 11), (41, 8), (5000, 14))}
    rows = [(u, f"2024-01-{i + 1:02} 0{h}:30:00", float(x) if h else 1.0) for u, v in daily.items() for i, x in enumerate(v) for h in (0, 5)]
    df = spark.createDataFrame(rows, "user_id long, ts string, value double")
    df.withColumn("ts", df["ts"].cast("timestamp_ntz")).write.parquet(str(tmp_path / "events.parquet"))
    want = {}
    for u, v in daily.items():
        v = np.round(v + 1.0, 2)
        for p in range(1, len(v)):
            near = [(np.hypot(v[p] - v[r], v[p - 1] - v[r - 1]), abs(p - r), r) for r in range(1, len(v) - 1) if r != p]
            dist, _, at = map(np.array, zip(*sorted(near)[:3]))
            w = np.exp(-dist / max(dist[0], 1e-6))
            want[str(u), p] = float((w * v[at + 1]).sum() / w.sum())
    got = {(r.series, r.row): r.predicted for r in catalog.queries()["simplex_every_series"](spark, str(tmp_path)).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=2e-6) for k in want)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    sql = {(s, p): x for s, p, x in con.sql(catalog.oracle_sql()["simplex_every_series"]).fetchall()}
    assert sql.keys() == want.keys() and all(sql[k] == pytest.approx(want[k], abs=2e-6) for k in want)


@pytest.mark.parametrize("name", ["generate_simplex", "generate_smap"])
def test_generation_learns_from_the_whole_series(spark, tmp_path, name):
    rng = np.random.default_rng(9)
    v = np.round(50 + 20 * np.sin(np.arange(1100) / 5) + rng.normal(0, 3, 1100), 2)
    day = dt.date(1992, 1, 1)
    spark.createDataFrame([(day + dt.timedelta(days=i), float(x)) for i, x in enumerate(v)], "o_orderdate date, o_totalprice double").write.parquet(str(tmp_path / "orders.parquet"))
    got = catalog.queries()[name](spark, str(tmp_path)).orderBy("step").collect()
    assert got[0].Time == (day - dt.date(1990, 1, 1)).days + 1100 and got[-1].Time == got[0].Time + len(got) - 1
    lib = np.arange(2, 1099)
    near = lambda r: np.array([v[r], v[r - 1], v[r - 2]]).T
    d = np.linalg.norm(near(lib) - near(np.array([1099])), axis=1)
    if name == "generate_simplex":
        at = np.argsort(d, kind="stable")[:4]
        w = np.exp(-d[at] / d[at[0]])
        assert got[0].Predictions == pytest.approx((w * v[lib[at] + 1]).sum() / w.sum(), rel=1e-9)
    else:
        w = np.exp(-2.0 * d / d.mean())[:, None]
        c = np.linalg.lstsq(w * np.column_stack([np.ones(len(lib)), near(lib)]), w[:, 0] * v[lib + 1], rcond=None)[0]
        assert got[0].Predictions == pytest.approx(float(c @ np.append(1.0, near(1099))), rel=1e-2)
