"""Reading and writing series tables and results."""

from __future__ import annotations

from collections.abc import Mapping
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelag.shared import quoted


def read(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """A table by the ending of its path: .csv (with a header), .parquet, .orc, .json, .feather or .arrow.

    Feather files are read by the driver, as they are a single machine's format. Raises ValueError for other endings.
    """
    kind = Path(path).suffix.lower()
    if kind == ".csv":
        r = spark.read.option("header", True)
        return r.schema(schema).csv(path) if schema else r.option("inferSchema", True).csv(path)
    if kind in (".parquet", ".orc", ".json"):
        r = spark.read.schema(schema) if schema else spark.read
        return r.format(kind[1:]).load(path)
    if kind in (".feather", ".arrow"):
        from pyarrow import feather

        return spark.createDataFrame(feather.read_table(path))
    raise ValueError(f"can't read files that end in {kind!r}")


def write(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Writes by the ending of the path; .feather and .pkl are collected by the driver (and .pkl is never read back), the others are written in parallel."""
    kind = Path(path).suffix.lower()
    if kind == ".csv":
        df.write.mode(mode).option("header", True).csv(path)
    elif kind in (".parquet", ".orc", ".json"):
        df.write.mode(mode).format(kind[1:]).save(path)
    elif kind in (".feather", ".arrow"):
        from pyarrow import feather

        feather.write_feather(df.toArrow(), path)
    elif kind in (".pkl", ".pickle"):
        df.toPandas().to_pickle(path)
    else:
        raise ValueError(f"can't write files that end in {kind!r}")


class SampleData(Mapping):
    """Named tables of a folder, read when they are asked for."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.paths = {p.stem: str(p) for p in sorted(Path(folder).iterdir()) if p.suffix.lower() in (".csv", ".parquet", ".feather")}

    def __getitem__(self, name: str) -> DataFrame:
        return read(self.spark, self.paths[name])

    def __iter__(self):
        return iter(self.paths)

    def __len__(self):
        return len(self.paths)

    def register(self) -> None:
        """Makes every table a view of its name."""
        for n in self:
            self[n].createOrReplaceTempView(n)


def dimensions(table: DataFrame, columns: list[str], column: str = "column", e: str = "E") -> list[int]:
    """Embedding dimension of each column from a table of (column, E). Raises ValueError if one is missing."""
    known = {r[0]: int(r[1]) for r in table.where(quoted(column).isin(columns)).select(quoted(column), quoted(e)).collect()}
    missing = [c for c in columns if c not in known]
    if missing:
        raise ValueError(f"no dimension for {missing}")
    return [known[c] for c in columns]


def wide(pairs: DataFrame, source: str = "source", target: str = "target", value: str = "rho", columns: list[str] | None = None) -> DataFrame:
    """Matrix of a long table of pairs: a row for each source, a column for each target."""
    p = pairs.groupBy(source).pivot(target, columns) if columns else pairs.groupBy(source).pivot(target)
    return p.agg(F.first(value))


def write_npz(pairs: DataFrame, path: str, columns: list[str], slope: DataFrame | None = None, exp_a: DataFrame | None = None) -> None:
    """Dense tensor (source, target, library size) as half floats, with columns, sizes, slopes and rates, in a compressed file.

    Collects columns x columns x sizes numbers; for many columns write the long table as parquet instead.
    """
    rows = pairs.select("source", "target", "lib_size", "rho").toPandas()
    sizes = sorted(rows["lib_size"].unique())
    at = {c: i for i, c in enumerate(columns)}
    out = np.full((len(columns), len(columns), len(sizes)), np.nan, np.float16)
    out[rows["source"].map(at), rows["target"].map(at), np.searchsorted(sizes, rows["lib_size"])] = rows["rho"].astype(float)
    more = {}
    for name, table in (("slope", slope), ("exp_a", exp_a)):
        if table is not None:
            s = table.toPandas()
            more[name] = np.full((len(columns), len(columns)), np.nan, np.float32)
            more[name][s["source"].map(at), s["target"].map(at)] = s[name].astype(float)
    np.savez_compressed(path, tensor=out, columns=np.array(columns), libSizes=np.array(sizes), **more)
