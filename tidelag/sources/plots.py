"""Plots of results; matplotlib is imported only when one is drawn."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _axes():
    try:
        import matplotlib.pyplot as plt
    except ImportError as e:
        raise RuntimeError("plots need matplotlib") from e
    return plt.subplots()[1]


def obs_pred(projection: DataFrame):
    """Rows to plot: Time, Observations, Predictions, in time order."""
    return projection.select("Time", "Observations", "Predictions").orderBy("Time")


def plot_obs_pred(projection: DataFrame, title: str = ""):
    p = obs_pred(projection).toPandas()
    return p.plot("Time", ["Observations", "Predictions"], title=title, ax=_axes())


def plot_coefficients(coefficients: DataFrame, title: str = ""):
    p = coefficients.orderBy("Time").toPandas()
    return p.plot("Time", [c for c in p.columns if c != "Time"], title=title, subplots=True)


def plot_line(table: DataFrame, x: str, y: str, title: str = ""):
    return table.select(F.col(f"`{x}`"), y).orderBy(F.col(f"`{x}`")).toPandas().plot(x, y, title=title, ax=_axes())


def plot_lines(table: DataFrame, x: str, title: str = ""):
    """Every other column over one of them."""
    p = table.orderBy(F.col(x)).toPandas()
    return p.plot(x, [c for c in p.columns if c != x], title=title, ax=_axes())


def plot_matrix(wide: DataFrame, title: str = ""):
    p = wide.toPandas().set_index(wide.columns[0])
    ax = _axes()
    ax.imshow(p.to_numpy(float))
    ax.set_xticks(range(p.shape[1]), p.columns, rotation=90)
    ax.set_yticks(range(p.shape[0]), p.index)
    ax.set_title(title)
    return ax
