"""Streams: regular sums over event time, and scoring of every batch against a fixed library."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from tidelag.operators import series as S
from tidelag.operators import simplex
from tidelag.shared import quoted


def windowed(stream: DataFrame, time: str, value: str, by: tuple[str, ...] = (), every: str = "1 hour", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Sum, mean and count of a value in windows of event time; readings later than ``late`` are dropped.

    Works on streams and on tables. With ``slide`` the windows overlap.
    """
    rows = stream.select(quoted(time).alias("t"), quoted(value).cast("double").alias("v"), *(quoted(c) for c in by))
    rows = rows.withWatermark("t", late) if stream.isStreaming else rows
    w = F.window("t", every, slide) if slide else F.window("t", every)
    g = rows.groupBy(w.alias("w"), *(quoted(c) for c in by)).agg(F.sum("v").alias("sum"), F.avg("v").alias("mean"), F.count("v").alias("readings"))
    return g.select(F.col("w.start").alias("time"), *(quoted(c) for c in by), "sum", "mean", "readings")


def sessions(stream: DataFrame, time: str, by: tuple[str, ...], gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Count of readings in each session (readings closer than ``gap``) of each source."""
    rows = stream.select(quoted(time).alias("t"), *(quoted(c) for c in by))
    rows = rows.withWatermark("t", late) if stream.isStreaming else rows
    g = rows.groupBy(F.session_window("t", gap).alias("w"), *(quoted(c) for c in by)).agg(F.count("*").alias("readings"))
    return g.select(F.col("w.start").alias("start"), F.col("w.end").alias("stop"), *(quoted(c) for c in by), "readings")


def scored(stream: DataFrame, library: DataFrame, column: str, time: str, E: int, sink: Callable[[DataFrame, int], None], tau: int = -1, Tp: int = 1) -> DataStreamWriter:
    """Writer that forecasts from the rows of every batch by their neighbours in a fixed library.

    The library is a table of (time, column). A batch is put after the library's last E-1 rows, so that its first rows
    have their past; only its own rows are predicted, and only the library teaches. ``sink`` gets the forecasts and the
    batch's number, which lets it write each batch once.
    """

    def batch(df: DataFrame, number: int) -> None:
        lib = library.select(quoted(time).alias("time"), quoted(column).alias("x"), F.lit(True).alias("known"))
        new = df.select(quoted(time).alias("time"), quoted(column).alias("x"), F.lit(False).alias("known"))
        both = lib.unionByName(new)
        t = S.task("x", "x", E=E, Tp=Tp, tau=tau, valid="known")
        p = S.prepared(both, [t], "time")
        known = p.base.where("v0").groupBy("series").agg(F.max("row").alias("last"))
        p.strict = False
        p.wide = p.wide.join(F.broadcast(known), "series").withColumn("pok", F.col("row") > F.col("last")).withColumn("lok", F.col("row") + Tp <= F.col("last")).drop("last")  # known is one row
        made = simplex.forecasts(p).join(p.base.select("series", F.col("row").alias("p"), "time"), ["series", "p"])
        sink(made.select("time", "predicted", "variance"), number)

    return stream.writeStream.foreachBatch(batch)
