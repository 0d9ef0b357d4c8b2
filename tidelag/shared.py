"""Small helpers shared by all operators: table reading and cutting lineage."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the session's Python workers, once, so that they needn't have it installed."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    _shipped.add(sc.applicationId)
    root = Path(__file__).resolve().parent
    path = Path(tempfile.mkdtemp(prefix="tidelag-code-")) / "tidelag.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f"tidelag/{f.relative_to(root)}")
    sc.addPyFile(str(path))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one parquet table of a data directory."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quoted(name: str) -> Column:
    """Column by its literal name, whatever characters the name holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def shared_dir(spark: SparkSession) -> str:
    """Folder that all executors share.

    Taken from ``spark.checkpoint.dir``; a temporary folder is used only where that is unset and
    the session runs in this one process (tests). Raises ValueError on a cluster without it.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    where = tempfile.mkdtemp(prefix="tidelag-")
    spark.conf.set("spark.checkpoint.dir", where)
    return where


_left: dict[str, list[str]] = {}


def written(df: DataFrame) -> DataFrame:
    """Write ``df`` once as a parquet table in the shared folder and read it back (cuts the lineage).

    Survives the loss of executors, since no block of it lives on one of them. The folder is deleted when the
    driver ends, or by :func:`release`.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidelag-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    left_behind(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def left_behind(spark: SparkSession, path: str) -> None:
    """Has a path that was written deleted when the driver ends, or by :func:`release`."""
    _left.setdefault(spark.sparkContext.applicationId, []).append(path)
    fs, at = _file_system(spark, path)
    fs.deleteOnExit(at)


def _file_system(spark: SparkSession, path: str):
    sc = spark.sparkContext
    at = sc._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(sc._jsc.hadoopConfiguration()), at


def release(spark: SparkSession) -> int:
    """Deletes the tables that the session's operators wrote and tells how many; results not yet read need them."""
    paths = _left.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        fs, at = _file_system(spark, path)
        fs.delete(at, True)
    return len(paths)


def once(c: Column) -> Column:
    """The column, worked out once a row.

    A filter on it is not pushed below it, where it would be worked out again: the optimizer leaves an expression that
    calls for a random number where it is.
    """
    return F.when(F.rand(0) >= 0, c)


def number(c: Column) -> Column:
    """Double with NaN turned into null and -0.0 into 0.0."""
    d = c.cast("double")
    return F.when(~F.isnan(d), d + F.lit(0.0))
