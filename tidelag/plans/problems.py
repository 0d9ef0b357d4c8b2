"""Queries of the general data-preparation problems, each over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelag.functions.dates import parsed
from tidelag.operators import grid, spikes
from tidelag.shared import once, quoted, table

FLOW = "S12.C.D.S333"
RULES = {
    "sumflow": spikes.Rule(ratio=5.0, low=0.0, high=9_000_000.0, zero_runs=True),
    "tentmap": spikes.Rule(low=-5000.0, high=5000.0),
    "sardine_anchovy_sst": spikes.Rule(low=-50.0, high=50.0),
}


def flags(spark: SparkSession, d: str) -> DataFrame:
    flow = table(spark, d, "sumflow")
    flow = flow.select("gauge_id", "reading_id", once(parsed(quoted("Date"))).alias("at"), quoted(FLOW).alias("flow"))
    return spikes.flagged(
        {
            "sumflow": (flow, "gauge_id", "at", "reading_id", "flow", RULES["sumflow"]),
            "tentmap": (table(spark, d, "tentmap"), "series_id", "Time", "reading_id", "TentMap", RULES["tentmap"]),
            "sardine_anchovy_sst": (table(spark, d, "sardine_anchovy_sst"), "station_id", "year", "reading_id", "np_sst", RULES["sardine_anchovy_sst"]),
        }
    )


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Every implausible reading of the three tables."""
    return flags(spark, d).select("table_name", "reading_id").distinct()


def weekly(spark: SparkSession, d: str) -> DataFrame:
    flow = table(spark, d, "sumflow").select("gauge_id", "reading_id", once(parsed(quoted("Date"))).alias("at"), quoted(FLOW).alias("flow"))
    w = grid.regular(flow, "gauge_id", "at", "flow", "reading_id")
    return w.withColumn("week_start", F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), (F.col("step") * 7 + grid.MONDAY).cast("int")), "yyyy-MM-dd"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Weeks without a reading between the first and the last reading of each gauge."""
    return weekly(spark, d).where("status <> 'observed'").select("gauge_id", "week_start")


def p3_observed(spark: SparkSession, d: str) -> DataFrame:
    """Weeks with a reading, with the last one's flow unchanged."""
    return weekly(spark, d).where("status = 'observed'").select("gauge_id", "week_start", F.col("value").alias("flow"), "n_readings")


def p3_series(spark: SparkSession, d: str) -> DataFrame:
    """Every week of every gauge: its flow as read, as filled by the factorisation, or marked as unsupported."""
    return weekly(spark, d).select("gauge_id", "week_start", F.round("value", 2).alias("flow"), "status", "n_readings")


#: Readings of sumflow with their time in microseconds; the notations are those that the table holds.
_READ_SQL = """u AS (SELECT reading_id, gauge_id, "S12.C.D.S333" AS v, translate(trim("Date", ' '), '/', '-') AS u FROM sumflow),
x AS (SELECT reading_id, gauge_id, v, CASE
  WHEN regexp_full_match(u, '[0-9]{4}-[0-9]{2}-[0-9]{2}') THEN try_cast(u AS TIMESTAMP)
  WHEN regexp_full_match(u, '[0-9]{8}') THEN try_strptime(u, '%Y%m%d')
  WHEN regexp_full_match(u, '[0-9]{2}-[A-Za-z]{3}-[0-9]{4}') THEN try_strptime(u, '%d-%b-%Y')
  WHEN regexp_full_match(u, '[0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}') THEN try_strptime(u, '%Y-%m-%d %H:%M')
  WHEN regexp_full_match(u, '[0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2}') THEN try_strptime(u, '%Y-%m-%d %H:%M:%S')
  WHEN regexp_full_match(u, '[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}Z') THEN try_strptime(u, '%Y-%m-%dT%H:%M:%SZ')
  WHEN regexp_full_match(u, '[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}[+-][0-9]{2}:[0-9]{2}')
    THEN try_strptime(left(u, 19), '%Y-%m-%dT%H:%M:%S') - (CASE WHEN u[20] = '-' THEN -1 ELSE 1 END) * to_minutes(60 * u[21:22]::INT + u[24:25]::INT) END AS t FROM u)"""
_FLOW_SQL = f"""{_READ_SQL},
r AS (SELECT *, floor((epoch_us(t) / 1000000 + 259200) / 604800)::BIGINT AS w FROM x WHERE t IS NOT NULL AND v IS NOT NULL AND NOT isnan(v))"""


def _spikes_sql(known: str, to: str) -> str:
    """CTE ``to``: spikes of the readings r, of which those in ``known`` are cases already.

    c counts the readings before one that are no cases; v holds their values, source by source.
    """
    apart = "CASE WHEN ratio THEN {v} > 5 * hi OR {v} * 5 < lo ELSE {v} > hi + 2 * (hi - lo) OR {v} < lo - 2 * (hi - lo) END"
    near = "list_concat(v[greatest(c - 4, 1):c], v[c + {skip} + 1:c + {skip} + 5])"
    return f"""n{to} AS (SELECT r.*, k.id IS NULL AS free FROM r LEFT JOIN {known} k USING (tab, src, id)),
c{to} AS (SELECT *, count(*) FILTER (free) OVER w - free::INT AS c, lead(x) OVER w AS x2, lead(fixed) OVER w AS fixed2, lead(free) OVER w AS free2 FROM n{to} WINDOW w AS (PARTITION BY tab, src ORDER BY pos)),
l{to} AS (SELECT tab, src, list(x ORDER BY pos) AS v FROM n{to} WHERE free GROUP BY 1, 2),
o{to} AS (SELECT *, free::INT AS s1, free::INT + free2::INT AS s2 FROM c{to} JOIN l{to} USING (tab, src)),
a{to} AS (SELECT *, least(c, 5) >= 3 AND len(v) - c - s1 >= 3 AS e1, least(c, 5) >= 3 AND len(v) - c - s2 >= 3 AND NOT fixed2 AS e2, {near.format(skip='s1')} AS w1, {near.format(skip='s2')} AS w2 FROM o{to} WHERE NOT fixed),
b{to} AS (SELECT *, (SELECT {apart.format(v='x')} FROM (SELECT list_max(w1) AS hi, list_min(w1) AS lo)) AND e1 AS one,
  (SELECT ({apart.format(v='x')}) AND ({apart.format(v='x2')}) FROM (SELECT list_max(w2) AS hi, list_min(w2) AS lo)) AND e2 AS two FROM a{to}),
d{to} AS (SELECT tab, src, id, pos FROM b{to} WHERE one UNION SELECT tab, src, id, pos FROM b{to} WHERE two UNION SELECT r.tab, r.src, r.id, r.pos FROM b{to} b JOIN r ON r.tab = b.tab AND r.src = b.src AND r.pos = b.pos + 1 WHERE b.two),
{to} AS (SELECT tab, src, id FROM (SELECT *, count(*) OVER (PARTITION BY tab, src, run) AS m FROM (SELECT *, pos - row_number() OVER (PARTITION BY tab, src ORDER BY pos) AS run FROM d{to})) WHERE m <= 2)"""


_CASES_SQL = f"""WITH {_READ_SQL},
q AS (SELECT DISTINCT 'sumflow' AS tab, gauge_id AS src, reading_id AS id, epoch_us(t) AS t, v AS x, true AS ratio, 0.0 AS low, 9000000.0 AS high, true AS dry FROM x WHERE t IS NOT NULL
  UNION ALL SELECT DISTINCT 'tentmap', series_id, reading_id, "Time"::BIGINT, "TentMap", false, -5000.0, 5000.0, false FROM tentmap WHERE "Time" IS NOT NULL
  UNION ALL SELECT DISTINCT 'sardine_anchovy_sst', station_id, reading_id, year::BIGINT, np_sst, false, -50.0, 50.0, false FROM sardine_anchovy_sst WHERE year IS NOT NULL),
p AS (SELECT *, row_number() OVER (PARTITION BY tab, src ORDER BY t, id) AS pos FROM q WHERE x IS NOT NULL AND NOT isnan(x)),
g AS (SELECT *, pos - row_number() OVER (PARTITION BY tab, src, x ORDER BY pos) AS run FROM p),
r AS (SELECT *, (count(*) OVER (PARTITION BY tab, src, x, run) >= 6 AND NOT (dry AND x = 0)) OR x < low OR x > high AS fixed FROM g),
k0 AS (SELECT tab, src, id FROM r WHERE fixed),
{_spikes_sql('k0', 's1')}, k1 AS (SELECT * FROM k0 UNION SELECT * FROM s1),
{_spikes_sql('k1', 's2')}, k2 AS (SELECT * FROM k0 UNION SELECT * FROM s2)
SELECT DISTINCT tab AS table_name, id AS reading_id FROM k2"""

ORACLE = {
    "p2_found": _CASES_SQL,
    "p3_found": f"""WITH {_FLOW_SQL},
e AS (SELECT gauge_id, unnest(range(min(w), max(w) + 1)) AS w FROM r GROUP BY 1)
SELECT gauge_id, strftime(DATE '1969-12-29' + (7 * w)::INT, '%Y-%m-%d') AS week_start FROM e ANTI JOIN r USING (gauge_id, w)""",
    "p3_observed": f"""WITH {_FLOW_SQL}
SELECT gauge_id, strftime(DATE '1969-12-29' + (7 * w)::INT, '%Y-%m-%d') AS week_start, arg_max(v, (t, reading_id, v)) AS flow, count(DISTINCT (t, reading_id)) AS n_readings
FROM r GROUP BY gauge_id, w""",
}
