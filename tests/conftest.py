import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

DATA = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def oracle():
    """Compares a query with its SQL over the smallest test tables."""
    duckdb = pytest.importorskip("duckdb")
    if not DATA.exists():
        pytest.skip("no test tables")
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for p in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")

    def same(spark, query, sql):
        a, b = query(spark, str(DATA)).toPandas(), con.sql(sql).df()
        assert sorted(a.columns) == sorted(b.columns)
        cols = sorted(a.columns)

        def plain(d):
            cell = lambda x: None if x is None or x != x else round(float(x), 6) + 0.0 if isinstance(x, float) else str(x)
            return sorted(repr(tuple(cell(x) for x in r)) for r in d[cols].itertuples(index=False, name=None))

        assert plain(a) == plain(b)

    return same
