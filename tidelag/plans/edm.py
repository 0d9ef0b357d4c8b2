"""Queries over the series operators on the driver's tables, and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from math import isqrt
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelag import api
from tidelag.functions import convergence, skill
from tidelag.operators import ccm, generate, neighbors, series, simplex, smap, surrogate, sweep
from tidelag.shared import left_behind, shared_dir, table
from tidelag.sources import tables

KINDS = ["click", "error", "purchase", "signup", "view"]


class Part(NamedTuple):
    """A row (from 1) in terms of a series' n rows: n * num // den + plus."""

    num: int
    den: int
    plus: int = 0


#: Rows learnt from and rows predicted: three fifths of a series, and the rest of it.
LIB, PRED = [1, Part(3, 5)], [Part(3, 5, 1), Part(1, 1)]
WHOLE = [1, Part(1, 1)]


def span(x, n: int) -> list[int]:
    return [n * p.num // p.den + p.plus if isinstance(p, Part) else p for p in x]


def spans(kw: dict, n: int) -> dict:
    """The arguments of a task with its spans in rows of a series of n."""
    return kw | {k: span(kw[k], n) for k in ("lib", "pred") if k in kw}


def row_sql(p) -> str:
    return f"(n * {p.num} // {p.den} + {p.plus})" if isinstance(p, Part) else str(p)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


# ---- series of the tables ----


def hourly(spark, d) -> DataFrame:
    """Hourly sum of the events' values, in cents so that the order of addition leaves no trace."""
    return table(spark, d, "events").groupBy(F.date_trunc("hour", "ts").alias("time")).agg(F.round(F.sum("value"), 2).alias("v"))


def hourly_kinds(spark, d) -> DataFrame:
    """Hourly sums, a column for each kind of event."""
    e = table(spark, d, "events")
    return e.groupBy(F.date_trunc("hour", "ts").alias("time")).agg(*(F.round(F.sum(F.when(F.col("event_type") == k, F.col("value")).otherwise(0.0)), 2).alias(k) for k in KINDS))


def gappy(spark, d) -> DataFrame:
    """The hourly series with missing values."""
    h = hourly(spark, d)
    return h.withColumn("v", F.when(F.hour("time") % 11 != 5, F.col("v")))


def daily(spark, d) -> DataFrame:
    return table(spark, d, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.round(F.sum("o_totalprice"), 2).alias("total"))


H = "h AS (SELECT date_trunc('hour', ts) AS time, round(sum(value), 2) AS v FROM events GROUP BY 1)"
HM = "h AS (SELECT date_trunc('hour', ts) AS time, " + ", ".join(f"round(sum(CASE WHEN event_type = '{k}' THEN value ELSE 0 END), 2) AS {k}" for k in KINDS) + " FROM events GROUP BY 1)"
HG = "h0 AS (SELECT date_trunc('hour', ts) AS time, round(sum(value), 2) AS v FROM events GROUP BY 1), h AS (SELECT time, CASE WHEN hour(time) % 11 <> 5 THEN v END AS v FROM h0)"
ROWS = "s AS (SELECT *, row_number() OVER (ORDER BY time) - 1 AS row, count(*) OVER () AS n FROM h)"


# ---- SQL of a forecast ----


def shift_sql(c: str, by: int) -> str:
    return c if by == 0 else f"{'lead' if by > 0 else 'lag'}({c}, {abs(by)}) OVER (ORDER BY row)"


def span_sql(pairs, lo: int = 0, hi: int = 0, last: int = 0) -> str:
    return "(" + " OR ".join(f"row BETWEEN {row_sql(a)} - 1 + {lo} AND {row_sql(b)} - 1 - {hi} - {last if i == len(pairs) - 1 else 0}" for i, (a, b) in enumerate(pairs)) + ")"


def near_sql(source: str, columns, target, lib, pred, E=1, Tp=1, tau=-1, k=None, R=0, embedded=False, valid="true", tag="") -> str:
    """CTEs up to k{tag}: p, l, dist, y, obs, rk of the nearest rows."""
    dims = [(c, 0) for c in columns] if embedded else [(c, d * tau) for d in range(E) for c in columns]
    E = len(columns) if embedded else E
    sh = 0 if embedded else abs(tau) * (E - 1)
    k = k or E + 1
    pair = lambda x: list(zip(x[::2], x[1::2]))
    back = max(0, -Tp - 1) if not embedded and Tp < 0 else 0
    is_lib = span_sql(pair(lib), (sh if tau < 0 else 0) + back, sh if tau > 0 else 0, max(Tp, 0))
    x = [f"x{i}" for i in range(len(dims))]
    some = " AND ".join(f"{a} IS NOT NULL" for a in x)
    d2 = " + ".join(f"(q.{a} - l.{a}) * (q.{a} - l.{a})" for a in x)
    obs = []
    for a, b in pair(pred):
        a0, b0 = f"{row_sql(a)} - 1", f"{row_sql(b)} - 1"
        if not embedded:
            a0, b0 = (f"greatest({a0}, {sh})", b0) if tau < 0 else (a0, f"least({b0}, n - 1 - {sh})")
        t = f"row + {Tp}"
        seen = f"({t} <= {b0} OR {b0} + {Tp} < n)" if Tp > 0 else f"({t} >= {a0} OR {a0} + {Tp} >= 0)"
        obs.append(f"(row BETWEEN {a0} AND {b0} AND {seen})")
    shifts = ", ".join(f"{shift_sql(c, s)} AS {a}" for a, (c, s) in zip(x, dims))
    return f"""e{tag} AS (SELECT row, n, {shifts}, {shift_sql(target, Tp)} AS y, {valid} AS ok FROM {source}),
l{tag} AS (SELECT * FROM e{tag} WHERE {is_lib} AND row + {Tp} BETWEEN 0 AND n - 1 AND ok AND {some}),
q{tag} AS (SELECT *, CASE WHEN {' OR '.join(obs)} THEN y END AS obs FROM e{tag} WHERE {span_sql(pair(pred))} AND {some}),
k{tag} AS (SELECT q.row AS p, l.row AS l, sqrt({d2}) AS dist, l.y, q.obs,
  row_number() OVER (PARTITION BY q.row ORDER BY round(sqrt({d2}), 12), abs(q.row - l.row), l.row) AS rk
  FROM q{tag} q JOIN l{tag} l ON abs(q.row - l.row) > {R} QUALIFY rk <= {k})"""


def made_sql(tag="") -> str:
    """CTE f{tag}: p, obs, predicted, variance from k{tag}."""
    return f"""w{tag} AS (SELECT *, exp(-dist / greatest(min(dist) OVER (PARTITION BY p), 1e-6)) AS w FROM k{tag}),
m{tag} AS (SELECT *, sum(w * y) OVER (PARTITION BY p) / sum(w) OVER (PARTITION BY p) AS m FROM w{tag}),
f{tag} AS (SELECT p, max(obs) AS obs, CASE WHEN count(y) = count(*) THEN max(m) END AS predicted,
  CASE WHEN count(y) = count(*) THEN sum(w * (y - m) * (y - m)) / sum(w) END AS variance FROM m{tag} GROUP BY p)"""


def forecast_sql(base: str, **kw) -> str:
    return f"WITH {base}, {ROWS}, {near_sql('s', **kw)}, {made_sql()} SELECT p AS row, round(predicted, 6) AS predicted, round(variance, 4) AS variance FROM f"


def skill_sql(tag: str, labels: str) -> str:
    ok = "obs IS NOT NULL AND predicted IS NOT NULL"
    return f"""SELECT {labels}, CASE WHEN count(*) FILTER ({ok}) >= 5 THEN round(corr(obs, predicted) FILTER ({ok}), 6) END AS rho FROM f{tag}"""


def sweep_sql(base: str, variants: list[tuple[str, dict]]) -> str:
    parts = ", ".join(f"{near_sql('s', **kw, tag=i)}, {made_sql(str(i))}" for i, (_, kw) in enumerate(variants))
    return f"WITH {base}, {ROWS}, {parts} " + " UNION ALL ".join(skill_sql(str(i), lab) for i, (lab, _) in enumerate(variants))


def tidy(df: DataFrame) -> DataFrame:
    return df.select(F.col("p").alias("row"), F.round("predicted", 6).alias("predicted"), F.round("variance", 4).alias("variance"))


def forecast(spark, d, df, **kw) -> DataFrame:
    p = series.prepared(df, [series.task(**spans(kw, df.count()))], "time")
    p.strict = False  # small tables may have no row that meets a condition
    return tidy(simplex.forecasts(p))


# ---- embedding ----


@query(f"WITH {H}, {ROWS} SELECT row, v AS \"v(t-0)\", lag(v, 1) OVER (ORDER BY row) AS \"v(t-1)\", lag(v, 2) OVER (ORDER BY row) AS \"v(t-2)\" FROM s")
def embed_lag(spark, d):
    return series.embed(hourly(spark, d), 3, -1, "v", "time", keep_row=True)


@query(f"WITH {H}, {ROWS} SELECT row, v AS \"v(t+0)\", lead(v, 2) OVER (ORDER BY row) AS \"v(t+2)\", lead(v, 4) OVER (ORDER BY row) AS \"v(t+4)\" FROM s")
def embed_lead(spark, d):
    return series.embed(hourly(spark, d), 3, 2, "v", "time", keep_row=True)


@query(f"WITH {HM}, {ROWS} SELECT row, click AS \"click(t-0)\", view AS \"view(t-0)\", lag(click) OVER (ORDER BY row) AS \"click(t-1)\", lag(view) OVER (ORDER BY row) AS \"view(t-1)\" FROM s")
def embed_multivariate(spark, d):
    return series.embed(hourly_kinds(spark, d), 2, -1, "click view", "time", keep_row=True)


@query(f"WITH {H}, {ROWS} SELECT row, v AS \"v(t-0)\", lag(v) OVER (ORDER BY row) AS \"v(t-1)\", lead(v) OVER (ORDER BY row) AS \"v(t+1)\" FROM s")
def embed_plusminus(spark, d):
    return series.embed(hourly(spark, d), 2, -1, "v", "time", plusminus=True, keep_row=True)


@query(f"WITH {H}, {ROWS} SELECT time, v AS \"v(t-0)\", lag(v, 1) OVER (ORDER BY row) AS \"v(t-1)\" FROM s")
def embed_include_time(spark, d):
    return series.embed(hourly(spark, d), 2, -1, "v", "time", include_time=True)


# ---- reading and writing ----


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def sample_data(spark, d):
    """A table of a folder by its name."""
    return tables.SampleData(spark, d)["nation"].select("n_nationkey", "n_name", "n_regionkey")


def _and_back(spark, df: DataFrame, end: str) -> DataFrame:
    path = f"{shared_dir(spark)}/tidelag-{uuid.uuid4().hex}.{end}"
    local = path.removeprefix("file://") if end == "feather" else path
    tables.write(df, local)
    left_behind(spark, local)
    return tables.read(spark, local)


@query("SELECT c_custkey, c_acctbal, c_mktsegment FROM customer")
def csv_and_back(spark, d):
    return _and_back(spark, table(spark, d, "customer").select("c_custkey", "c_acctbal", "c_mktsegment"), "csv")


@query("SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def feather_and_back(spark, d):
    return _and_back(spark, table(spark, d, "supplier").select("s_suppkey", "s_name", "s_acctbal"), "feather")


# ---- spans and filters ----


def _lib(spark, d, df, **kw):
    p = series.prepared(df, [series.task(**spans(kw, df.count()))], "time")
    return series.used_rows(p, p.tasks[0], True).select("row")


def _lib_sql(base, **kw):
    return f"WITH {base}, {ROWS}, {near_sql('s', **kw)} SELECT row FROM l"


_SPAN = dict(columns=["v"], target="v", lib=LIB, pred=PRED, E=3, Tp=2, tau=-2)
_TWO = dict(columns=["v"], target="v", lib=[1, Part(1, 5), Part(3, 10, 1), Part(3, 5)], pred=PRED, E=2, Tp=3)
_NAN = dict(columns=["v"], target="v", lib=LIB, pred=PRED, E=3)


@query(_lib_sql(H, **_SPAN))
def span_lib_filter(spark, d):
    return _lib(spark, d, hourly(spark, d), **_SPAN)


@query(_lib_sql(H, **_TWO))
def disjoint_lib(spark, d):
    return _lib(spark, d, hourly(spark, d), **_TWO)


@query(f"WITH {HG}, {ROWS}, {near_sql('s', **_NAN)} SELECT 'lib' AS part, row FROM l UNION ALL SELECT 'pred', row FROM q")
def remove_nan(spark, d):
    g = gappy(spark, d)
    p = series.prepared(g, [series.task(**spans(_NAN, g.count()))], "time")
    return series.used_rows(p, p.tasks[0], True).select(F.lit("lib").alias("part"), "row").unionAll(series.used_rows(p, p.tasks[0], False).select(F.lit("pred"), "row"))


@query(_lib_sql(H, **_NAN, valid="(v > 1000)"))
def valid_lib(spark, d):
    return _lib(spark, d, hourly(spark, d), **_NAN, valid="v > 1000")


# ---- neighbours ----

_NEAR = dict(columns=["v"], target="v", lib=[1, Part(4, 5)], pred=PRED, E=3)


def _near(spark, d, df=None, **kw):
    h = df if df is not None else hourly(spark, d)
    n = neighbors.nearest(series.prepared(h, [series.task(**spans(kw, h.count()))], "time"))
    return n.select(F.col("p").alias("row"), F.col("rank").cast("bigint").alias("rank"), F.col("l").alias("neighbour"), F.round("dist", 6).alias("distance"))


def _near_sql(base=H, **kw):
    return f"WITH {base}, {ROWS}, {near_sql('s', **kw)} SELECT p AS row, rk AS rank, l AS neighbour, round(dist, 6) AS distance FROM k"


@query(_near_sql(**(_NEAR | {"pred": PRED, "lib": LIB})))
def knn_neighbors(spark, d):
    return _near(spark, d, **(_NEAR | {"pred": PRED, "lib": LIB}))


@query(_near_sql(**_NEAR))
def knn_self_exclusion(spark, d):
    return _near(spark, d, **_NEAR)


@query(_near_sql(**_NEAR, R=12))
def knn_exclusion_radius(spark, d):
    return _near(spark, d, **_NEAR, radius=12)


@query(_near_sql(**(_NEAR | {"lib": [1, 12]}), k=20))
def knn_deficient(spark, d):
    return _near(spark, d, **(_NEAR | {"lib": [1, 12]}), knn=20)


# ---- simplex ----

_BASIC = dict(columns=["v"], target="v", lib=LIB, pred=PRED, E=3)
_VARIANTS: dict[str, tuple[Callable, str, dict, dict]] = {
    "simplex_basic": (hourly, H, _BASIC, {}),
    "simplex_tp0": (hourly_kinds, HM, dict(columns=["click"], target="view", lib=LIB, pred=PRED, E=2, Tp=0), {}),
    "simplex_neg_tp": (hourly, H, _BASIC | {"Tp": -2}, {}),
    "simplex_pos_tau": (hourly, H, _BASIC | {"tau": 2}, {}),
    "simplex_embedded_mv": (hourly_kinds, HM, dict(columns=["click", "view", "error"], target="click", lib=LIB, pred=PRED, embedded=True), {}),
    "simplex_multivariate": (hourly_kinds, HM, dict(columns=["click", "view"], target="view", lib=LIB, pred=PRED, E=2), {}),
    "simplex_variance": (hourly, H, _BASIC | {"E": 4, "Tp": 3}, {}),
    "simplex_disjoint": (hourly, H, _BASIC | {"lib": _TWO["lib"], "pred": [Part(1, 5, 1), Part(7, 25), *PRED], "E": 2}, {}),
    "simplex_missing": (gappy, HG, _BASIC, {}),
}


def _variant(name, source, sql, kw):
    def f(spark, d):
        return forecast(spark, d, source(spark, d), **kw)

    f.__name__ = name
    QUERIES[name] = f
    ORACLE[name] = forecast_sql(sql, **kw)


for _name, (_source, _sql, _kw, _) in _VARIANTS.items():
    _variant(_name, _source, _sql, _kw)


@query(forecast_sql(H, **_BASIC, k=1))
def simplex_knn1(spark, d):
    return forecast(spark, d, hourly(spark, d), **_BASIC, knn=1)


@query(forecast_sql(H, **_BASIC, valid="(v > 1000)"))
def simplex_validlib(spark, d):
    return forecast(spark, d, hourly(spark, d), **_BASIC, valid="v > 1000")


_FORMAT = _BASIC | {"pred": [1, Part(1, 5)], "Tp": 2}


@query(
    f"WITH {H}, {ROWS}, {near_sql('s', **_FORMAT)}, {made_sql()}, "
    "o AS (SELECT unnest(range(2, (SELECT count(*) // 5 + 2 FROM s))) AS row) SELECT o.row, s.time AS \"Time\", s.v AS \"Observations\", round(predicted, 6) AS \"Predictions\", round(variance, 4) AS \"Pred_Variance\" "
    "FROM o JOIN s USING (row) LEFT JOIN f ON f.p = o.row - 2"
)
def simplex_projection_format(spark, d):
    h = hourly(spark, d)
    r = simplex.run(h, [series.task(**spans(_FORMAT, h.count()))], "time")
    return r.select("row", "Time", "Observations", F.round("Predictions", 6).alias("Predictions"), F.round("Pred_Variance", 4).alias("Pred_Variance"))


_BEYOND = _BASIC | {"pred": [Part(1, 10, 1), Part(1, 5), Part(4, 5, 1), Part(1, 1)], "Tp": 3}


@query(
    f"WITH {H}, {ROWS}, {near_sql('s', **_BEYOND)}, {made_sql()}, "
    "c AS (SELECT count(*) AS n, max(time) AS last FROM s), "
    "o AS (SELECT 0 AS seg, unnest(range(n // 10, n // 5 + 3)) AS row, n, last FROM c UNION ALL SELECT 1, unnest(range(n * 4 // 5, n + 3)), n, last FROM c) "
    "SELECT o.seg::INT AS seg, o.row, coalesce(s.time, last + to_hours(o.row - o.n + 1)) AS \"Time\", s.v AS \"Observations\", round(predicted, 6) AS \"Predictions\" "
    "FROM o LEFT JOIN s USING (row) LEFT JOIN f ON f.p = o.row - 3 AND f.p >= CASE seg WHEN 0 THEN o.n // 10 ELSE o.n * 4 // 5 END"
)
def simplex_beyond_the_end(spark, d):
    """Two spans, the second of which reaches beyond the series: its times are carried on."""
    h = hourly(spark, d)
    r = simplex.run(h, [series.task(**spans(_BEYOND, h.count()))], "time")
    return r.select("seg", "row", "Time", "Observations", F.round("Predictions", 6).alias("Predictions"))


_LONG = dict(columns=["v"], target="v", lib=[1, Part(1, 10)], pred=[Part(1, 10, 1), Part(1, 1)], E=3)


@query(
    f"WITH s AS (SELECT value AS v, row_number() OVER (ORDER BY ts, event_id) - 1 AS row, count(*) OVER () AS n FROM events), {near_sql('s', **_LONG)}, {made_sql()} "
    "SELECT p AS row, round(predicted, 6) AS predicted FROM f"
)
def simplex_long_series(spark, d):
    """All events as one series, which its first tenth forecasts: many blocks of predicted rows."""
    e = table(spark, d, "events").select("ts", "event_id", F.col("value").alias("v"))
    n = e.count()
    p = series.prepared(e, [series.task(**spans(_LONG, n))], order=["ts", "event_id"], rows_known=n)
    return simplex.forecasts(p).select(F.col("p").alias("row"), F.round("predicted", 6).alias("predicted"))


def _series_sql(source: str, key: str) -> str:
    return (
        f"WITH h AS ({source}), "
        f"s AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY time) - 1 AS row FROM h), "
        f"e AS (SELECT {key}, row, v AS x0, lag(v) OVER (PARTITION BY {key} ORDER BY row) AS x1, lead(v) OVER (PARTITION BY {key} ORDER BY row) AS y FROM s), "
        "g AS (SELECT * FROM e WHERE x1 IS NOT NULL), l AS (SELECT * FROM g WHERE y IS NOT NULL), "
        f"k AS (SELECT q.{key}, q.row AS p, l.row AS l, sqrt((q.x0 - l.x0) * (q.x0 - l.x0) + (q.x1 - l.x1) * (q.x1 - l.x1)) AS dist, l.y FROM g q JOIN l ON q.{key} = l.{key} AND q.row <> l.row "
        f"QUALIFY row_number() OVER (PARTITION BY q.{key}, q.row ORDER BY round(dist, 12), abs(q.row - l.row), l.row) <= 3), "
        f"w AS (SELECT *, exp(-dist / greatest(min(dist) OVER (PARTITION BY {key}, p), 1e-6)) AS w FROM k) "
        f"SELECT {key}::VARCHAR AS series, p AS row, round(sum(w * y) / sum(w), 6) AS predicted FROM w GROUP BY 1, 2"
    )


def _series(e: DataFrame, key: str) -> DataFrame:
    f = simplex.forecasts(series.prepared(e, [series.task("v", "v", E=2)], "time", key))
    return f.select("series", F.col("p").alias("row"), F.round("predicted", 6).alias("predicted"))


@query(_series_sql("SELECT user_id, date_trunc('day', ts) AS time, round(sum(value), 2) AS v FROM events GROUP BY 1, 2", "user_id"))
def simplex_every_series(spark, d):
    """One plan over the daily series of every user."""
    e = table(spark, d, "events").groupBy("user_id", F.date_trunc("day", "ts").alias("time"))
    return _series(e.agg(F.round(F.sum("value"), 2).alias("v")), "user_id")


@query(_series_sql("SELECT o_custkey, date_trunc('day', o_orderdate) AS time, round(sum(o_totalprice), 2) AS v FROM orders GROUP BY 1, 2", "o_custkey"))
def simplex_every_customer(spark, d):
    """One plan over the daily orders of every customer: very many short series."""
    o = table(spark, d, "orders").groupBy("o_custkey", F.date_trunc("day", "o_orderdate").alias("time"))
    return _series(o.agg(F.round(F.sum("o_totalprice"), 2).alias("v")), "o_custkey")


# ---- locally weighted maps ----


def smap_e1_sql(theta: float, what: str, base=H) -> str:
    kw = dict(columns=["v"], target="v", lib=LIB, pred=PRED, E=1)
    return f"""WITH {base}, {ROWS}, {near_sql('s', **kw, k='(SELECT count(*) - 1 FROM l)')},
a AS (SELECT k.*, q.x0 AS px, l.x0 AS lx, exp(-{theta} * dist / avg(dist) OVER (PARTITION BY p)) AS w FROM k JOIN q ON q.row = k.p JOIN l ON l.row = k.l),
b AS (SELECT p, any_value(px) AS px, sum(w * w) AS sw, sum(w * w * lx) AS sx, sum(w * w * lx * lx) AS sxx, sum(w * w * y) AS sy, sum(w * w * lx * y) AS sxy FROM a GROUP BY p),
c AS (SELECT p, px, (sw * sxy - sx * sy) / (sw * sxx - sx * sx) AS c1, (sy * sxx - sx * sxy) / (sw * sxx - sx * sx) AS c0 FROM b) {what}"""


def _smap(spark, d, theta, kw, source=hourly, solver=None):
    df = source(spark, d)
    t = series.with_task(series.task(**spans(kw, df.count())), knn=0)
    return smap.forecasts(series.prepared(df, [t], "time"), [theta], solver)


_E1 = dict(columns=["v"], target="v", lib=LIB, pred=PRED, E=1)


@query(smap_e1_sql(0, "SELECT p AS row, round(c0 + c1 * px, 4) AS predicted FROM c"))
def smap_theta0_e1(spark, d):
    return _smap(spark, d, 0, _E1).select(F.col("p").alias("row"), F.round("predicted", 4).alias("predicted"))


@query(smap_e1_sql(3, "SELECT p AS row, round(c0 + c1 * px, 4) AS predicted FROM c"))
def smap_theta3_e1(spark, d):
    return _smap(spark, d, 3, _E1).select(F.col("p").alias("row"), F.round("predicted", 4).alias("predicted"))


@query(smap_e1_sql(3, "SELECT p AS row, round(c0, 4) AS c0, round(c1, 6) AS c1 FROM c"))
def smap_coefficients_e1(spark, d):
    return _smap(spark, d, 3, _E1).select(F.col("p").alias("row"), F.round(F.get("coef", F.lit(0)), 4).alias("c0"), F.round(F.get("coef", F.lit(1)), 6).alias("c1"))


@query(smap_e1_sql(3, ", z AS (SELECT a.p, a.w, a.y, c0 + c1 * a.px AS m FROM a JOIN c ON a.p = c.p) SELECT p AS row, round(sum(w * (y - m) * (y - m)) / sum(w), 2) AS variance FROM z GROUP BY p"))
def smap_variance_e1(spark, d):
    return _smap(spark, d, 3, _E1).select(F.col("p").alias("row"), F.round("variance", 2).alias("variance"))


@query(smap_e1_sql(3, 'SELECT s.row, s.time AS "Time", round(c0, 4) AS "C0", round(c1, 6) AS "∂v/∂v(t-0)" FROM (SELECT unnest(range(count(*) * 3 // 5, count(*))) AS row FROM s) o JOIN s USING (row) LEFT JOIN c ON c.p = s.row - 1'))
def smap_coefficient_rows(spark, d):
    h = hourly(spark, d)
    n = h.count()
    r = api.SMap(h, "v", "v", span(LIB, n), span(PRED, n), 1, theta=3)["coefficients"].where(F.col("row") < n)
    return r.select("row", "Time", F.round("C0", 4).alias("C0"), F.round("∂v/∂v(t-0)", 6).alias("∂v/∂v(t-0)"))


_E2 = dict(columns=["click", "view"], target="click", lib=LIB, pred=PRED, embedded=True)


@query(f"""WITH {HM}, {ROWS}, {near_sql('s', **_E2, k='(SELECT count(*) - 1 FROM l)')},
a AS (SELECT k.*, q.x0 AS p0, q.x1 AS p1, l.x0 AS u, l.x1 AS v, exp(-2 * dist / avg(dist) OVER (PARTITION BY p)) AS g FROM k JOIN q ON q.row = k.p JOIN l ON l.row = k.l),
z AS (SELECT *, g * g AS w, sum(g * g * u) OVER (PARTITION BY p) / sum(g * g) OVER (PARTITION BY p) AS mu, sum(g * g * v) OVER (PARTITION BY p) / sum(g * g) OVER (PARTITION BY p) AS mv, sum(g * g * y) OVER (PARTITION BY p) / sum(g * g) OVER (PARTITION BY p) AS my FROM a),
b AS (SELECT p, any_value(p0) AS p0, any_value(p1) AS p1, any_value(mu) AS mu, any_value(mv) AS mv, any_value(my) AS my, sum(w * (u - mu) * (u - mu)) AS uu, sum(w * (u - mu) * (v - mv)) AS uv, sum(w * (v - mv) * (v - mv)) AS vv, sum(w * (u - mu) * (y - my)) AS uy, sum(w * (v - mv) * (y - my)) AS vy FROM z GROUP BY p)
SELECT p AS row, round(my + (p0 - mu) * (uy * vv - vy * uv) / (uu * vv - uv * uv) + (p1 - mv) * (vy * uu - uy * uv) / (uu * vv - uv * uv), 4) AS predicted FROM b""")
def smap_e2_embedded(spark, d):
    return _smap(spark, d, 2, _E2, hourly_kinds).select(F.col("p").alias("row"), F.round("predicted", 4).alias("predicted"))


@query()
def smap_e4(spark, d):
    r = _smap(spark, d, 3, _BASIC | {"E": 4})
    return r.select(F.col("p").alias("row"), "predicted", "variance", "coef", "sing")


def _solver_query(name):
    def f(spark, d):
        return _smap(spark, d, 1, _BASIC, solver=name).select(F.col("p").alias("row"), "predicted", "coef")

    f.__name__ = f"smap_solver_{name}"
    QUERIES[f.__name__] = f


for _name in ("lstsq", "ols", "ridge", "lasso", "elastic_net"):
    _solver_query(_name)


# ---- skill and sweeps ----

_SKILL = f"WITH {H}, {ROWS}, {near_sql('s', **_BASIC)}, {made_sql()} "


@query(_SKILL + "SELECT round(corr(obs, predicted), 6) AS rho, round(max(obs - predicted), 6) AS \"MAE\", round(sum(abs(obs - predicted)), 6) AS \"CAE\", round(sqrt(avg((obs - predicted) * (obs - predicted))), 6) AS \"RMSE\" FROM f WHERE obs IS NOT NULL AND predicted IS NOT NULL")
def compute_error(spark, d):
    h = hourly(spark, d)
    return skill.errors(simplex.forecasts(series.prepared(h, [series.task(**spans(_BASIC, h.count()))], "time")), [], "obs", "predicted")


@query("WITH x AS (SELECT c_nationkey AS k, c_acctbal AS a, lag(c_acctbal) OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS b FROM customer) SELECT k, CASE WHEN count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) < 3 THEN NULL ELSE round(corr(a, b), 6) END AS rho FROM x GROUP BY k")
def pearson_nan_safe(spark, d):
    from pyspark.sql import Window

    c = table(spark, d, "customer").select(F.col("c_nationkey").alias("k"), F.col("c_acctbal").alias("a"), F.lag("c_acctbal").over(Window.partitionBy("c_nationkey").orderBy("c_custkey")).alias("b"))
    return c.groupBy("k").agg(F.round(skill.pearson(F.col("a"), F.col("b")), 6).alias("rho"))


_S = dict(columns=["v"], target="v", lib=LIB, pred=PRED)


def _split(df: DataFrame) -> tuple[DataFrame, list[int], list[int]]:
    """A series, the rows to learn from and those to predict."""
    n = df.count()
    return df, span(LIB, n), span(PRED, n)


@query(sweep_sql(H, [(f"{e} AS \"E\"", _S | {"E": e}) for e in range(1, 7)]))
def embed_dimension(spark, d):
    h, lib, pred = _split(hourly(spark, d))
    return sweep.embed_dimension(h, "v", "v", lib, pred, max_e=6, time="time").drop("series")


@query(sweep_sql(H, [(f"{t} AS \"Tp\"", _S | {"E": 3, "Tp": t}) for t in range(1, 9)]))
def predict_interval(spark, d):
    h, lib, pred = _split(hourly(spark, d))
    return sweep.predict_interval(h, "v", "v", lib, pred, max_tp=8, E=3, time="time").drop("series")


@query(sweep_sql(H, [(f"{r} AS radius", dict(columns=["v"], target="v", lib=WHOLE, pred=WHOLE, E=3, R=r)) for r in (0, 2, 5, 12, 24)]))
def predict_exclusion_radius(spark, d):
    return sweep.predict_exclusion_radius(hourly(spark, d), "v", "v", None, None, [0, 2, 5, 12, 24], E=3, time="time").drop("series")


_PN = [0.1, 1.0, 3.0, 8.0]


@query(f"""WITH {H}, {ROWS}, {near_sql('s', **_E1, k='(SELECT count(*) - 1 FROM l)')},
t AS (SELECT unnest({_PN}) AS theta),
a AS (SELECT t.theta, k.*, q.x0 AS px, l.x0 AS lx, exp(-theta * dist / avg(dist) OVER (PARTITION BY theta, p)) AS w FROM k JOIN q ON q.row = k.p JOIN l ON l.row = k.l CROSS JOIN t),
b AS (SELECT theta, p, any_value(px) AS px, max(obs) AS obs, sum(w * w) AS sw, sum(w * w * lx) AS sx, sum(w * w * lx * lx) AS sxx, sum(w * w * y) AS sy, sum(w * w * lx * y) AS sxy FROM a GROUP BY ALL)
SELECT theta::DOUBLE AS theta, round(corr(obs, (sy * sxx - sx * sxy) / (sw * sxx - sx * sx) + px * (sw * sxy - sx * sy) / (sw * sxx - sx * sx)), 6) AS rho FROM b GROUP BY 1""")
def predict_nonlinear(spark, d):
    h, lib, pred = _split(hourly(spark, d))
    return sweep.predict_nonlinear(h, "v", "v", lib, pred, _PN, E=1, time="time").drop("series")


def _theta_rows(spark, d, kw, thetas):
    h = hourly(spark, d)
    t = series.with_task(series.task(**spans(kw, h.count())), knn=0)
    return smap.forecasts(series.prepared(h, [t], "time"), thetas)


def _tp_rows(spark, d, kw, horizons, theta):
    h = hourly(spark, d)
    n = h.count()
    ts = [series.with_task(series.task(**spans(kw | {"Tp": t}, n), label={"Tp": t}), knn=0) for t in horizons]
    return sweep.labelled(smap.forecasts(series.prepared(h, ts, "time"), [theta]), ts, ["Tp"], ["int"])


@query()
def smap_theta_rows(spark, d):
    return _theta_rows(spark, d, _BASIC, [0.5, 2.0, 5.0]).select("theta", "p", "predicted", "variance")


@query()
def smap_tp_rows(spark, d):
    return _tp_rows(spark, d, _BASIC, (1, 2, 4), 2.0).select("Tp", "p", "predicted", "variance")


_FIT = "sum(w * w) AS sw, sum(w * w * lx) AS sx, sum(w * w * lx * lx) AS sxx, sum(w * w * y) AS sy, sum(w * w * lx * y) AS sxy"
_MADE = "(sy * sxx - sx * sxy) / (sw * sxx - sx * sx) + px * (sw * sxy - sx * sy) / (sw * sxx - sx * sx)"


@query(f"""WITH {H}, {ROWS}, {near_sql('s', **_E1, k='(SELECT count(*) - 1 FROM l)')}, t AS (SELECT unnest([0.5, 2.0, 5.0]::DOUBLE[]) AS theta),
a AS (SELECT t.theta, k.*, q.x0 AS px, l.x0 AS lx, exp(-theta * dist / avg(dist) OVER (PARTITION BY theta, p)) AS w FROM k JOIN q ON q.row = k.p JOIN l ON l.row = k.l CROSS JOIN t),
b AS (SELECT theta, p, any_value(px) AS px, {_FIT} FROM a GROUP BY ALL) SELECT theta, p, round({_MADE}, 4) AS predicted FROM b""")
def smap_theta_rows_e1(spark, d):
    return _theta_rows(spark, d, _E1, [0.5, 2.0, 5.0]).select("theta", "p", F.round("predicted", 4).alias("predicted"))


@query(f"""WITH {H}, {ROWS}, {near_sql('s', **_E1, k='(SELECT count(*) - 1 FROM l)')}, t AS (SELECT unnest([0.5, 5.0]::DOUBLE[]) AS theta),
a AS (SELECT t.theta, k.*, q.x0 AS px, l.x0 AS lx, exp(-theta * dist / avg(dist) OVER (PARTITION BY theta, p)) AS w FROM k JOIN q ON q.row = k.p JOIN l ON l.row = k.l CROSS JOIN t),
b AS (SELECT theta, p, any_value(px) AS px, {_FIT} FROM a GROUP BY ALL), m AS (SELECT theta, p, {_MADE} AS made FROM b)
SELECT t.theta, s.row, s.time AS "Time", s.v AS "Observations", round(made, 4) AS "Predictions" FROM s CROSS JOIN t LEFT JOIN m ON m.theta = t.theta AND m.p = s.row - 1 WHERE s.row >= s.n * 3 // 5""")
def smap_theta_frames(spark, d):
    """The frames of a list of thetas, as of single maps."""
    h = hourly(spark, d)
    n = h.count()
    r = api.SMap_theta(h, [0.5, 5.0], "v", "v", 1, lib=span(LIB, n), pred=span(PRED, n)).where(F.col("row") < n)
    return r.select("theta", "row", "Time", "Observations", F.round("Predictions", 4).alias("Predictions"))


def _tp_sql(tp: int) -> str:
    near = near_sql("s", **(_E1 | {"Tp": tp}), k=f"(SELECT count(*) - 1 FROM l{tp})", tag=tp)
    return f"""{near}, a{tp} AS (SELECT k.*, q.x0 AS px, l.x0 AS lx, exp(-2 * dist / avg(dist) OVER (PARTITION BY p)) AS w FROM k{tp} k JOIN q{tp} q ON q.row = k.p JOIN l{tp} l ON l.row = k.l),
b{tp} AS (SELECT p, any_value(px) AS px, {_FIT} FROM a{tp} GROUP BY p)"""


@query(f"WITH {H}, {ROWS}, " + ", ".join(map(_tp_sql, (1, 2, 4))) + " " + " UNION ALL ".join(f'SELECT {t}::INT AS "Tp", p, round({_MADE}, 4) AS predicted FROM b{t}' for t in (1, 2, 4)))
def smap_tp_rows_e1(spark, d):
    return _tp_rows(spark, d, _E1, (1, 2, 4), 2.0).select("Tp", "p", F.round("predicted", 4).alias("predicted"))


# ---- convergent cross mapping ----


def ccm_sql(x: str, y: str, E: int, sizes, samples: int, seed: int, tag: str, keep_missing: bool = False) -> str:
    """CTE r{tag}: lib_size, sample, rho from the embedding of x to the target y; samples by md5 order, all rows if size is None."""
    xs = ", ".join(f"{shift_sql(x, -i)} AS x{i}" for i in range(E))
    some = " AND ".join(f"x{i} IS NOT NULL" for i in range(E))
    d2 = " + ".join(f"(q.x{i} - l.x{i}) * (q.x{i} - l.x{i})" for i in range(E))
    size = ", ".join(f"({s})" for s in sizes)
    return f"""e{tag} AS (SELECT row, n, {xs}, {y} AS y FROM s),
v{tag} AS (SELECT *, row_number() OVER (ORDER BY row) - 1 AS i FROM e{tag} WHERE {some} AND y IS NOT NULL),
z{tag} AS (SELECT v.*, sm, lib_size, row_number() OVER (PARTITION BY sm, lib_size ORDER BY md5('{seed}:' || sm || ':' || i)) AS o FROM v{tag} v, (SELECT unnest(range({samples})) AS sm), (VALUES {size}) t(lib_size)),
k{tag} AS (SELECT q.row AS p, l.sm, l.lib_size, sqrt({d2}) AS dist, l.y, q.y AS obs FROM v{tag} q JOIN z{tag} l ON l.o <= l.lib_size AND q.row <> l.row QUALIFY row_number() OVER (PARTITION BY q.row, l.sm, l.lib_size ORDER BY dist, l.row) <= {E + 1}),
w{tag} AS (SELECT *, CASE WHEN min(dist) OVER u > 0 THEN exp(-dist / min(dist) OVER u) ELSE (dist = 0)::INT END AS w FROM k{tag} WINDOW u AS (PARTITION BY p, sm, lib_size)),
f{tag} AS (SELECT p, sm, lib_size, any_value(obs) AS obs, sum(w * y) / sum(w) AS predicted FROM w{tag} GROUP BY 1, 2, 3 HAVING count(*) = {E + 1}),
r{tag} AS (SELECT lib_size, sm AS sample, corr(obs, predicted) AS rho FROM f{tag} GROUP BY 1, 2)"""


@query(f"WITH {HM}, {ROWS}, {ccm_sql('click', 'view', 3, ['(SELECT count(*) FROM s)'], 1, 1, 'a')}, {ccm_sql('view', 'click', 3, ['(SELECT count(*) FROM s)'], 1, 1, 'b')} SELECT 'click:view' AS direction, round(rho, 6) AS rho FROM ra UNION ALL SELECT 'view:click', round(rho, 6) FROM rb")
def ccm_full_library(spark, d):
    h = hourly_kinds(spark, d)
    return ccm.ccm(h, "click", "view", [h.count()], 1, 3, time="time", sampler="hash").select("direction", F.round("rho", 6).alias("rho"))


@query(f"WITH {HM}, {ROWS}, {ccm_sql('click', 'view', 2, [20, 100, 300], 3, 7, 'a')}, {ccm_sql('view', 'click', 2, [20, 100, 300], 3, 7, 'b')} "
       "SELECT 'click:view' AS direction, lib_size, sample::INT AS sample, round(rho, 6) AS rho FROM ra UNION ALL SELECT 'view:click', lib_size, sample::INT, round(rho, 6) FROM rb")
def ccm_hash_sample(spark, d):
    return ccm.ccm(hourly_kinds(spark, d), "click", "view", [20, 100, 300], 3, 2, seed=7, time="time", sampler="hash").select("direction", "lib_size", "sample", F.round("rho", 6).alias("rho"))


@query(f"WITH {HM}, {ROWS}, {ccm_sql('click', 'view', 2, [20, 100, 300], 3, 7, 'a')}, {ccm_sql('view', 'click', 2, [20, 100, 300], 3, 7, 'b')}, "
       "a AS (SELECT lib_size, avg(rho) AS rho FROM ra GROUP BY 1), b AS (SELECT lib_size, avg(rho) AS rho FROM rb GROUP BY 1) SELECT lib_size AS \"LibSize\", round(a.rho, 6) AS \"click:view\", round(b.rho, 6) AS \"view:click\" FROM a JOIN b USING (lib_size)")
def ccm_lib_means(spark, d):
    r = ccm.lib_means(ccm.ccm(hourly_kinds(spark, d), "click", "view", [20, 100, 300], 3, 2, seed=7, time="time", sampler="hash"), "click", "view")
    return r.select("LibSize", F.round("click:view", 6).alias("click:view"), F.round("view:click", 6).alias("view:click"))


@query(f"WITH {HM}, {ROWS}, {ccm_sql('click', 'view', 2, [20, 100, 300], 3, 7, 'a')}, {ccm_sql('view', 'click', 2, [20, 100, 300], 3, 7, 'b')}, "
       "a AS (SELECT lib_size, var_pop(rho) AS v FROM ra GROUP BY 1), b AS (SELECT lib_size, var_pop(rho) AS v FROM rb GROUP BY 1) SELECT lib_size AS \"LibSize\", round(a.v, 8) AS \"click:view_var\", round(b.v, 8) AS \"view:click_var\" FROM a JOIN b USING (lib_size)")
def ccm_variances(spark, d):
    r = ccm.lib_means(ccm.ccm(hourly_kinds(spark, d), "click", "view", [20, 100, 300], 3, 2, seed=7, time="time", sampler="hash"), "click", "view", True)
    return r.select("LibSize", F.round("click:view_var", 8).alias("click:view_var"), F.round("view:click_var", 8).alias("view:click_var"))


_ALL = dict(lib=WHOLE, pred=WHOLE, E=3, Tp=1)


@query(f"WITH {HM}, {ROWS}, {near_sql('s', ['click'], 'view', **_ALL, tag='a')}, {made_sql('a')}, {near_sql('s', ['view'], 'click', **_ALL, tag='b')}, {made_sql('b')} " + " UNION ALL ".join(
    f"SELECT '{x}' AS direction, round(corr(y, predicted), 5) AS rho, round(max(y - predicted), 5) AS \"MAE\", round(sum(abs(y - predicted)), 5) AS \"CAE\", round(sqrt(avg((y - predicted) * (y - predicted))), 5) AS \"RMSE\" FROM f{t} JOIN e{t} ON e{t}.row = f{t}.p WHERE y IS NOT NULL AND predicted IS NOT NULL"
    for x, t in (("click:view", "a"), ("view:click", "b"))))
def ccm_projected_full(spark, d):
    """The older form with the whole library, which leaves nothing to chance."""
    h = hourly_kinds(spark, d)
    return ccm.ccm_projected(h, "click", "view", [h.count()], 1, 3, Tp=1, seed=1, time="time").select("direction", "rho", "MAE", "CAE", "RMSE")


@query()
def ccm_numpy_seed(spark, d):
    return ccm.ccm(hourly_kinds(spark, d), "click", "view", [20, 200, 60], 5, 3, seed=777, time="time").drop("series")


@query()
def ccm_projected(spark, d):
    return ccm.ccm_projected(hourly_kinds(spark, d), "click", "view", [20, 200, 60], 5, 3, Tp=1, seed=777, time="time").drop("series")


_MX = KINDS
_MATRIX = [(a, b) for a in _MX for b in _MX if a != b]


def _matrix_sql(tail: str) -> str:
    parts = ", ".join(ccm_sql(a, b, 2, [50, 150, 400], 2, 3, f"{i}") for i, (a, b) in enumerate(_MATRIX))
    union = " UNION ALL ".join(f"SELECT '{a}' AS source, '{b}' AS target, lib_size, avg(rho) AS rho FROM r{i} GROUP BY lib_size" for i, (a, b) in enumerate(_MATRIX))
    return f"WITH {HM}, {ROWS}, {parts}, mx AS ({union}) {tail}"


def _matrix(spark, d):
    return ccm.ccm_matrix(hourly_kinds(spark, d), _MX, 2, [50, 150, 400], sample=2, seed=3, time="time", sampler="hash").drop("series")


@query(_matrix_sql("SELECT source, target, lib_size, round(rho, 6) AS rho FROM mx UNION ALL SELECT c, c, l, NULL FROM (SELECT unnest(['click', 'error', 'purchase', 'signup', 'view']) AS c), (SELECT unnest([50, 150, 400]) AS l)"))
def ccm_matrix(spark, d):
    return _matrix(spark, d).select("source", "target", "lib_size", F.round("rho", 6).alias("rho"))


@query(_matrix_sql("SELECT source, target, round(regr_slope(rho, lib_size / 500.0), 6) AS slope FROM mx GROUP BY 1, 2"))
def ccm_matrix_slope(spark, d):
    return skill.slope(_matrix(spark, d).where("source <> target"), ["source", "target"], "lib_size", "rho", 500.0).select("source", "target", F.round("slope", 6).alias("slope"))


@query()
def ccm_exp_converge(spark, d):
    m = ccm.ccm_matrix(hourly_kinds(spark, d), _MX, 2, [20, 50, 150, 300, 500], sample=2, seed=3, time="time", sampler="hash")
    return convergence.rates(m.where("source <> target"), ["source", "target"], "lib_size", "rho", 720.0)


# ---- multiview ----

_MV = KINDS
_COORDS = [(c, -d) for d in range(2) for c in _MV]


def _combos():
    from itertools import combinations

    return list(combinations(_COORDS, 2))


def _combo_sql(c, i, pred=PRED, tag="") -> str:
    cols = ", ".join(f"{shift_sql(x, s)} AS z{j}" for j, (x, s) in enumerate(c))
    return f"g{tag}{i} AS (SELECT row, n, click, {cols} FROM s), " + near_sql(f"g{tag}{i}", ["z0", "z1"], "click", LIB, pred, embedded=True, tag=f"{tag}{i}") + ", " + made_sql(f"{tag}{i}")


def _view_name(c) -> str:
    return "(" + ", ".join(f"'{x}(t-{abs(s)})'" for x, s in c) + ")"


def _multiview_sql(tail: str, train: bool = False) -> str:
    """CTEs t (the best combinations with their skill) and ev (all forecasts); ``train`` ranks over the library itself."""
    combos = _combos()
    parts = ", ".join([_combo_sql(c, i) for i, c in enumerate(combos)] + ([_combo_sql(c, i, LIB, "t") for i, c in enumerate(combos)] if train else []))
    ok = "FILTER (obs IS NOT NULL AND predicted IS NOT NULL)"
    err = f"round(corr(obs, predicted) {ok}, 6) AS rho, round(max(obs - predicted), 6) AS mae, round(sum(abs(obs - predicted)), 6) AS cae, round(sqrt(avg((obs - predicted) * (obs - predicted))), 6) AS rmse"
    skills = lambda tag: " UNION ALL ".join("SELECT {} AS task, '{}' AS name, {} FROM f{}{}".format(i, _view_name(c).replace("'", "''"), err, tag, i) for i, c in enumerate(combos))
    every = " UNION ALL ".join(f"SELECT {i} AS task, p, obs, predicted FROM f{i}" for i in range(len(combos)))
    best = f"(SELECT task, row_number() OVER (ORDER BY rho DESC NULLS LAST, task) AS rank FROM {'ut' if train else 'u'} QUALIFY rank <= {isqrt(len(combos))})"
    more = f", ut AS ({skills('t')})" if train else ""
    return f"WITH {HM}, {ROWS}, {parts}, u AS ({skills('')}){more}, t AS (SELECT u.*, rank FROM u JOIN {best} USING (task)), ev AS ({every}) {tail}"


def _multiview(spark, d):
    h, lib, pred = _split(hourly_kinds(spark, d))
    return sweep.multiview(h, _MV, "click", lib, pred, D=2, E=2, train_lib=False, time="time")


@query(_multiview_sql('SELECT rank, name AS "Columns", rho FROM t'))
def multiview_rank(spark, d):
    return _multiview(spark, d)[1].select(F.col("rank").cast("bigint").alias("rank"), "Columns", "rho")


@query(_multiview_sql('SELECT rank, name AS "Columns", rho, mae AS "MAE", cae AS "CAE", rmse AS "RMSE" FROM t'))
def multiview_view(spark, d):
    return _multiview(spark, d)[1].select(F.col("rank").cast("bigint").alias("rank"), "Columns", "rho", "MAE", "CAE", "RMSE")


@query(_multiview_sql('SELECT o.row, s.click AS "Observations", round(avg(ev.predicted), 6) AS "Predictions" FROM (SELECT unnest(range(count(*) * 3 // 5, count(*) + 1)) AS row FROM s) o LEFT JOIN s USING (row) LEFT JOIN (SELECT ev.* FROM ev JOIN t USING (task)) ev ON ev.p = o.row - 1 GROUP BY ALL'))
def multiview_predict(spark, d):
    return _multiview(spark, d)[0].select("row", "Observations", F.round("Predictions", 6).alias("Predictions"))


@query(_multiview_sql('SELECT rank, name AS "Columns", rho, mae AS "MAE", cae AS "CAE", rmse AS "RMSE" FROM t', True))
def multiview_train_lib(spark, d):
    h, lib, pred = _split(hourly_kinds(spark, d))
    return sweep.multiview(h, _MV, "click", lib, pred, D=2, E=2, time="time")[1].select(F.col("rank").cast("bigint").alias("rank"), "Columns", "rho", "MAE", "CAE", "RMSE")


# ---- cross maps ----


def _cross(cols, targets, E, Tp):
    return [(f"'{a}' AS columns, '{b}' AS target", dict(columns=[a], target=b, lib=LIB, pred=PRED, E=E, Tp=Tp)) for a in cols for b in targets]


@query(sweep_sql(HM, [(lab.replace("columns", "source"), kw) for lab, kw in _cross(_MX, _MX, 3, 0)]))
def crossmap_matrix(spark, d):
    h, lib, pred = _split(hourly_kinds(spark, d))
    return sweep.cross_map_matrix(h, _MX, 3, Tp=0, lib=lib, pred=pred, time="time").drop("series")


@query(f"SELECT source, target, CASE WHEN rho >= 0.05 AND source <> target THEN rho END AS rho FROM ({sweep_sql(HM, [(lab.replace('columns', 'source'), kw) for lab, kw in _cross(_MX, _MX, 3, 0)])})")
def crossmap_threshold(spark, d):
    h, lib, pred = _split(hourly_kinds(spark, d))
    return sweep.cross_map_matrix(h, _MX, 3, Tp=0, lib=lib, pred=pred, threshold=0.05, time="time").drop("series")


@query(sweep_sql(HM, _cross(KINDS, ["view"], 2, 1)))
def crossmap_columns(spark, d):
    h, lib, pred = _split(hourly_kinds(spark, d))
    return sweep.cross_map_skill(h, KINDS, "view", 2, lib, pred, Tp=1, time="time").select("columns", "target", "rho")


_LIST = [["click"], ["click", "error"], ["click", "error", "signup"]]


@query(sweep_sql(HM, [(f"'{' '.join(c)}' AS columns, 'view' AS target", dict(columns=c, target="view", lib=LIB, pred=PRED, E=1)) for c in _LIST]))
def crossmap_column_list(spark, d):
    h, lib, pred = _split(hourly_kinds(spark, d))
    return sweep.cross_map_skill(h, _LIST, "view", 1, lib, pred, time="time").select("columns", "target", "rho")


_ED = [(f"'{c}' AS \"column\", {e} AS \"E\"", dict(columns=[c], target="view", lib=LIB, pred=PRED, E=e)) for c in _MX for e in range(1, 6)]


def _embed_dim_sql(tail: str) -> str:
    sql = sweep_sql(HM, _ED)
    head, _, body = sql.partition(" SELECT 'click' AS \"column\"")
    return f"{head}, sw AS (SELECT 'click' AS \"column\"{body}) {tail}"


@query(_embed_dim_sql('SELECT "column", \'view\' AS target, arg_max("E", (rho, -"E")) AS "E", round(max(rho), 4) AS rho FROM sw WHERE rho IS NOT NULL GROUP BY 1'))
def embed_dim_columns(spark, d):
    h, lib, pred = _split(hourly_kinds(spark, d))
    r = sweep.embed_dim_columns(h, _MX, "view", 5, 1, lib, pred, time="time")
    return r.select("column", "target", "E", F.round(F.col("rho").cast("double"), 4).alias("rho"))


@query(_embed_dim_sql(', nx AS (SELECT *, lead(rho) OVER (PARTITION BY "column" ORDER BY "E") AS nr FROM sw) SELECT "column", \'view\' AS target, min("E") AS "E", round(arg_min(rho, "E"), 4) AS rho FROM nx WHERE nr IS NULL OR nr < rho GROUP BY 1'))
def embed_dim_columns_first(spark, d):
    h, lib, pred = _split(hourly_kinds(spark, d))
    r = sweep.embed_dim_columns(h, _MX, "view", 5, 1, lib, pred, first_max=True, time="time")
    return r.select("column", "target", "E", F.round(F.col("rho").cast("double"), 4).alias("rho"))


# ---- generation and surrogates ----


@query()
def generate_simplex(spark, d):
    return generate.generated(daily(spark, d).withColumn("t", F.datediff("day", F.lit("1990-01-01").cast("date"))), series.task("total", "total", E=3), 50, time="t")


@query("""WITH RECURSIVE h AS (SELECT date_trunc('day', o_orderdate) AS day, round(sum(o_totalprice), 2) AS x FROM orders GROUP BY 1),
s AS (SELECT *, row_number() OVER (ORDER BY day) - 1 AS row, count(*) OVER () AS n FROM h),
e AS (SELECT *, lag(x) OVER (ORDER BY row) AS x1, lag(x, 2) OVER (ORDER BY row) AS x2, lead(x) OVER (ORDER BY row) AS y FROM s),
l AS (SELECT * FROM e WHERE row BETWEEN 2 AND n - 2),
g AS (SELECT 0 AS step, x AS a, x1 AS b, x2 AS c FROM e WHERE row = n - 1
  UNION ALL SELECT step + 1, list_sum(list_transform(z, lambda k: exp(-k.d / greatest(list_min(list_transform(z, lambda q: q.d)), 1e-6)) * k.y)) / list_sum(list_transform(z, lambda k: exp(-k.d / greatest(list_min(list_transform(z, lambda q: q.d)), 1e-6)))), a, b
  FROM (SELECT step, a, b, c, arg_min({'d': d, 'y': y}, {'r': round(d, 12), 'l': -row}, 4) AS z
    FROM (SELECT g.step, g.a, g.b, g.c, l.row, l.y, sqrt((l.x - a) * (l.x - a) + (l.x1 - b) * (l.x1 - b) + (l.x2 - c) * (l.x2 - c)) AS d FROM g, l WHERE step < 50) GROUP BY step, a, b, c))
SELECT g.step::INT AS step, (date_diff('day', DATE '1990-01-01', day) + g.step * (SELECT date_diff('day', min(day), max(day)) FROM s WHERE row < 2))::DOUBLE AS "Time", round(a, 1) AS "Predictions" FROM g, s WHERE s.row = n - 1 AND g.step > 0""")
def generate_simplex_steps(spark, d):
    """Each forecast is forecast from in turn."""
    return generate_simplex(spark, d).select("step", "Time", F.round("Predictions", 1).alias("Predictions"))


@query()
def generate_smap(spark, d):
    return generate.generated(daily(spark, d).withColumn("t", F.datediff("day", F.lit("1990-01-01").cast("date"))), series.with_task(series.task("total", "total", E=3), knn=0), 30, theta=2.0, time="t").drop("coef", "sing")


@query("WITH h AS (SELECT date_trunc('hour', ts) AS time, round(sum(value), 2) AS v FROM events GROUP BY 1), s AS (SELECT row_number() OVER (ORDER BY time) - 1 AS row, v FROM h), "
       "o AS (SELECT n AS surrogate, v, row_number() OVER (PARTITION BY n ORDER BY md5('5:' || n || ':' || row), row) - 1 AS row FROM s, (SELECT unnest(range(1, 4)) AS n)) SELECT row, surrogate::INT AS surrogate, v AS value FROM o")
def surrogate_random_shuffle(spark, d):
    return surrogate.surrogates(hourly(spark, d), "v", "random_shuffle", 3, seed=5, time="time").select("row", "surrogate", "value")


@query()
def surrogate_ebisuzaki(spark, d):
    return surrogate.surrogates(hourly(spark, d), "v", "ebisuzaki", 3, seed=5, time="time").select("row", "surrogate", "value")


@query()
def surrogate_seasonal(spark, d):
    return surrogate.surrogates(hourly(spark, d), "v", "seasonal", 3, seed=5, time="time").select("row", "surrogate", "value")
