"""Forecast skill as aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Pairs that the two kinds of skill need at least.
LEAST_ERROR, LEAST_PEARSON = 5, 3


def correlation(o: Column, q: Column) -> Column:
    """Aggregate: correlation of the pairs without a null; null where either side does not vary (in ANSI mode too)."""
    return F.try_divide(F.covar_pop(o, q), F.stddev_pop(o) * F.stddev_pop(q))


def errors(df: DataFrame, keys: Sequence[str] = (), obs: str = "Observations", pred: str = "Predictions", digits: int = 6) -> DataFrame:
    """rho, MAE, CAE and RMSE of each group over the pairs without a missing value.

    "MAE" is the largest signed error obs - pred, CAE the sum of absolute errors; fewer than five pairs give nulls.
    Groups without any pair keep a row of nulls.
    """
    ok = F.col(obs).isNotNull() & F.col(pred).isNotNull() & ~F.isnan(obs) & ~F.isnan(pred)
    o, q = F.when(ok, F.col(obs)), F.when(ok, F.col(pred))
    e = o - q
    n = F.count(e)
    some = lambda c: F.when(n >= LEAST_ERROR, F.bround(c, digits))
    return df.groupBy(*keys).agg(some(correlation(o, q)).alias("rho"), some(F.max(e)).alias("MAE"), some(F.sum(F.abs(e))).alias("CAE"), some(F.sqrt(F.avg(e * e))).alias("RMSE"))


def pearson(o: Column, q: Column) -> Column:
    """Aggregate: correlation of the complete pairs; null below three, 0 if either side does not vary."""
    ok = o.isNotNull() & q.isNotNull()
    o, q = F.when(ok, o), F.when(ok, q)
    n = F.count(o)
    flat = (F.var_pop(o) == 0) | (F.var_pop(q) == 0)
    return F.when(n < LEAST_PEARSON, None).when(flat, 0.0).otherwise(correlation(o, q))


def slope(df: DataFrame, keys: Sequence[str], lib_size: str, rho: str, rows: float) -> DataFrame:
    """Slope of rho over lib_size / rows of each group; a missing rho counts as its group's mean, one size gives null."""
    from pyspark.sql import Window

    filled = df.withColumn("_r", F.coalesce(rho, F.avg(rho).over(Window.partitionBy(*keys)))).withColumn("_x", F.col(lib_size) / rows)
    return filled.groupBy(*keys).agg(
        F.when(F.count_distinct("_x") < 2, None).when(F.count("_r") == 0, None).when(F.var_pop("_x") == 0, 0.0).otherwise(F.regr_slope("_r", "_x")).alias("slope")
    )
