"""Simplex projection: exponentially weighted mean of the neighbours' targets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelag.operators.neighbors import weighted
from tidelag.operators.series import Prepared, Task, meet, prepared

def forecasts(p: Prepared) -> DataFrame:
    """series, task, p (the row predicted from), n_near, obs, predicted, variance."""
    return weighted(p).select("series", "task", "p", "n_near", "obs", "predicted", "variance")


def segments(t: Task):
    """Output rows of a task as an array of (seg, first, last, first and last with an observation)."""
    out = []
    for i, s in enumerate(t.pred or (None,)):
        a, b = (F.lit(s[0] - 1).cast("bigint"), F.lit(s[1] - 1).cast("bigint")) if s else (F.lit(0).cast("bigint"), F.col("n") - 1)
        if not t.embedded:
            if t.tau < 0:
                a = F.greatest(a, F.lit(t.shift).cast("bigint"))
            else:
                b = F.least(b, F.col("n") - 1 - t.shift)
        lo, hi, seen_lo, seen_hi = a, b, a, b
        if t.tp > 0:
            hi = b + t.tp
            seen_hi = F.when(hi < F.col("n"), hi).otherwise(b)
        elif t.tp < 0:
            lo = a + t.tp
            seen_lo = F.when(lo >= 0, lo).otherwise(a)
        out.append(F.struct(F.lit(i).alias("seg"), a.alias("a"), b.alias("b"), lo.alias("lo"), hi.alias("hi"), seen_lo.alias("slo"), seen_hi.alias("shi")))
    return F.filter(F.array(*out), lambda s: s["a"] <= s["b"])


def projection(p: Prepared, found: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """series, task, seg, row, Time, Observations, Predictions, Pred_Variance and the columns ``extra`` of ``found``.

    The prediction made from row p stands on row p + Tp. Each span of predicted rows is put out with the Tp rows it
    reaches beyond; those have no observation if any of them lies outside the series. Times outside are carried on
    with the step between the first two. ``found`` has series, task, p, predicted, variance.
    """
    meta = p.base.groupBy("series", "n").agg(F.min_by("time", "row").alias("t0"), F.max(F.when(F.col("row") == 1, F.col("time"))).alias("t1"), F.max_by("time", "row").alias("tn"))
    each = F.array(*(F.struct(F.lit(i).alias("task"), F.lit(t.tp).alias("tp"), segments(t).alias("segs")) for i, t in enumerate(p.tasks)))
    spans = meta.withColumn("x", F.explode(each)).select("*", "x.task", "x.tp", F.explode("x.segs").alias("s")).drop("x")
    rows = spans.select("series", "n", "t0", "t1", "tn", "task", "tp", F.col("s.seg").alias("seg"), F.col("s.a").alias("a"), F.col("s.b").alias("b"), F.col("s.slo").alias("slo"), F.col("s.shi").alias("shi"), F.explode(F.sequence("s.lo", "s.hi")).alias("row"))
    targets = F.create_map(*(x for i, t in enumerate(p.tasks) for x in (F.lit(i), F.col(p.observed[t.target])))) if len({t.target for t in p.tasks}) > 1 else None
    one = F.col(p.observed[p.tasks[0].target])
    seen = p.base.select("series", "row", "time", *( [targets.alias("obs")] if targets is not None else [one.alias("obs")]))
    out = meet(rows, seen, ["series", "row"], "left")
    obs = F.col("obs")[F.col("task")] if targets is not None else F.col("obs")
    kind = p.base.schema["time"].dataType.typeName()
    beyond = F.when(F.col("row") >= F.col("n"), F.col("row") - F.col("n") + 1).otherwise(F.col("row"))
    origin = F.when(F.col("row") >= F.col("n"), F.col("tn")).otherwise(F.col("t0"))
    if kind in ("timestamp", "timestamp_ntz"):
        step = F.unix_micros("t1") - F.unix_micros("t0") if kind == "timestamp" else None
        carried = F.timestamp_micros(F.unix_micros(origin) + beyond * step) if step is not None else F.lit(None).cast("timestamp_ntz")
    elif kind == "date":
        carried = F.date_add(origin, (beyond * F.datediff("t1", "t0")).cast("int"))
    elif kind == "string":
        day = F.date_add(origin.cast("date"), (beyond * F.datediff(F.col("t1").cast("date"), F.col("t0").cast("date"))).cast("int"))
        carried = day.cast("string")
    else:
        carried = (origin + beyond * (F.col("t1") - F.col("t0"))).cast(p.base.schema["time"].dataType)
    made = found.select("series", "task", F.col("p"), "predicted", "variance", *extra)
    out = out.withColumn("p", F.col("row") - F.col("tp"))
    out = meet(out, made, ["series", "task", "p"], "left")
    own = F.col("p").between(F.col("a"), F.col("b"))
    return out.select(
        "series", "task", "seg", "row",
        F.coalesce(F.col("time"), carried).alias("Time"),
        F.when(F.col("row").between(F.col("slo"), F.col("shi")), obs).alias("Observations"),
        F.when(own, F.col("predicted")).alias("Predictions"),
        F.when(own, F.col("variance")).alias("Pred_Variance"),
        *(F.when(own, F.col(c)).alias(c) for c in extra),
    )


def run(df: DataFrame, tasks: list[Task], time=None, series=None, order=()) -> DataFrame:
    """Projections of all tasks in one plan."""
    p = prepared(df, tasks, time, series, order)
    return projection(p, forecasts(p))
