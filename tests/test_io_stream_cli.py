import numpy as np
import pandas as pd
import pytest

from tidelag import api, cli
from tidelag.operators import series, simplex
from tidelag.shared import release, shared_dir, written
from tidelag.sources import plots, tables
from tidelag.streaming import resample


def test_read_write(spark, tmp_path):
    df = spark.createDataFrame([(1, 0.5), (2, None), (3, 1.5)], "Time long, x double")
    for end in ("csv", "parquet", "feather", "orc", "json"):
        tables.write(df, f"{tmp_path}/t.{end}")
        got = tables.read(spark, f"{tmp_path}/t.{end}").select("Time", "x").orderBy("Time").toPandas()
        assert got["Time"].tolist() == [1, 2, 3] and got["x"].isna().tolist() == [False, True, False]
    for f in (tables.read, lambda s, p: tables.write(df, p)):
        with pytest.raises(ValueError):
            f(spark, f"{tmp_path}/t.xls")
    tables.write(df, f"{tmp_path}/t.pkl")
    assert len(pd.read_pickle(f"{tmp_path}/t.pkl")) == 3
    s = tables.SampleData(spark, str(tmp_path))
    assert "t" in s and s["t"].count() == 3
    e = spark.createDataFrame([("a", 3), ("b", 5)], "column string, E int")
    assert tables.dimensions(e, ["b", "a"]) == [5, 3]
    with pytest.raises(ValueError):
        tables.dimensions(e, ["c"])
    m = spark.createDataFrame([("a", "b", 10, 0.5), ("b", "a", 10, 0.25)], "source string, target string, lib_size int, rho double")
    tables.write_npz(m, f"{tmp_path}/m.npz", ["a", "b"])
    assert np.load(f"{tmp_path}/m.npz")["tensor"][1, 0, 0] == 0.25
    assert sorted(tables.wide(m).columns) == ["a", "b", "source"]
    assert plots.obs_pred(df.selectExpr("Time", "x AS Observations", "x AS Predictions")).count() == 3


def test_written_tables_stay(spark):
    df = written(spark.range(10).selectExpr("id", "CAST(NULL AS STRING) AS n"))
    assert df.count() == 10 and shared_dir(spark) in df.inputFiles()[0]
    assert written(spark.range(0)).count() == 0


def test_written_tables_are_released(spark):
    import os

    df = written(spark.range(4))
    folder = os.path.dirname(df.inputFiles()[0]).removeprefix("file://")
    assert os.path.isdir(folder) and df.count() == 4
    assert release(spark) >= 1 and not os.path.isdir(folder) and release(spark) == 0


def test_command_line(spark, tmp_path):
    t = pd.DataFrame({"Time": range(1, 61), "x": np.round(np.sin(np.arange(60) * 0.7), 4), "y": np.round(np.cos(np.arange(60) * 0.7), 4)})
    t.to_csv(f"{tmp_path}/in.csv", index=False)
    cli.main(["simplex", "-i", f"{tmp_path}/in.csv", "-o", f"{tmp_path}/a.parquet", "--columns", "x", "--target", "y", "--lib", "1 40", "--pred", "41 55", "--E", "2"])
    assert tables.read(spark, f"{tmp_path}/a.parquet").count() == 16
    cli.main(["smap", "-i", f"{tmp_path}/in.csv", "-o", f"{tmp_path}/b.csv", "--columns", "x", "--target", "x", "--lib", "1 40", "--pred", "41 55", "--E", "2", "--theta", "2", "--part", "coefficients"])
    assert "C0" in tables.read(spark, f"{tmp_path}/b.csv").columns
    cli.main(["ccm", "-i", f"{tmp_path}/in.csv", "-o", f"{tmp_path}/c.parquet", "--columns", "x", "--target", "y", "--libSizes", "10 30 10", "--E", "2", "--sample", "2", "--seed", "1"])
    assert tables.read(spark, f"{tmp_path}/c.parquet").count() == 3


def test_command_line_takes_a_dimension_for_each_column(spark, tmp_path):
    t = pd.DataFrame({"Time": range(1, 61), "x": np.round(np.sin(np.arange(60) * 0.7), 4), "y": np.round(np.cos(np.arange(60) * 0.9), 4)})
    t.to_csv(f"{tmp_path}/in.csv", index=False)
    pd.DataFrame({"column": ["y", "x"], "E": [3, 2]}).to_csv(f"{tmp_path}/e.csv", index=False)
    for out, e in (("a", f"{tmp_path}/e.csv"), ("b", "2 3"), ("c", "2")):
        cli.main(["ccm-matrix", "-i", f"{tmp_path}/in.csv", "-o", f"{tmp_path}/{out}.parquet", "--E", e, "--libSizes", "10 40", "--sample", "2", "--seed", "1"])
    got = [tables.read(spark, f"{tmp_path}/{out}.parquet").orderBy("source", "target", "lib_size").toPandas()["rho"] for out in "abc"]
    assert got[0].equals(got[1]) and not got[0].equals(got[2])


def test_npz_holds_slopes_and_rates(spark, tmp_path):
    t = pd.DataFrame({"Time": range(1, 61), "x": np.sin(np.arange(60) * 0.7), "y": np.cos(np.arange(60) * 0.9)})
    r = api.CCM_Matrix(spark.createDataFrame(t), 2, [10, 25, 40], sample=2, seed=1, expConverge=True, outputFile=f"{tmp_path}/m.npz")
    z = np.load(f"{tmp_path}/m.npz")
    assert z["exp_a"].shape == z["slope"].shape == (2, 2) and z["tensor"].shape == (2, 2, 3) and r["exp_a"].count() == 2


def test_streams_equal_tables(spark, tmp_path):
    e = spark.createDataFrame(pd.DataFrame({"ts": pd.date_range("2024-01-01", periods=200, freq="7min"), "value": np.arange(200) * 1.0, "k": ["a", "b"] * 100}))
    e.repartition(4).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(e.schema).parquet(f"{tmp_path}/in")
    for name, f in (("w", lambda d: resample.windowed(d, "ts", "value", ("k",))), ("s", lambda d: resample.windowed(d, "ts", "value", (), "2 hours", "1 hour")), ("g", lambda d: resample.sessions(d, "ts", ("k",), "10 minutes"))):
        q = f(stream).writeStream.format("memory").outputMode("append" if name == "g" else "complete").queryName(name).start()
        q.processAllAvailable()
        q.stop()
        got, want = spark.table(name).collect(), f(e).collect()
        assert sorted(map(str, got)) == sorted(map(str, want)) if name != "g" else set(map(str, got)) <= set(map(str, want))


def test_scored_batches(spark, tmp_path):
    x = pd.DataFrame({"t": range(80), "x": np.round(np.sin(np.arange(80) * 0.9), 4)})
    lib, new = spark.createDataFrame(x[:60]), spark.createDataFrame(x[60:])
    new.coalesce(1).write.parquet(f"{tmp_path}/in")
    got = []
    q = resample.scored(spark.readStream.schema(new.schema).parquet(f"{tmp_path}/in"), lib, "x", "t", 2, lambda d, n: got.extend(d.collect())).start()
    q.processAllAvailable()
    q.stop()
    want = simplex.forecasts(series.prepared(spark.createDataFrame(x), [series.task("x", "x", [1, 60], [61, 80], 2)], "t")).toPandas().set_index("p")["predicted"]
    assert sorted(r.time for r in got) == list(range(60, 80))
    assert all(abs(r.predicted - want[r.time]) < 1e-9 for r in got)


def test_examples(spark):
    assert {k: v.count() for k, v in api.Examples(spark, 120).items()} == {"Simplex": 60, "SMap": 60, "EmbedDimension": 5, "CCM": 3}
