"""One ranking from several differently scaled scores by outranking net flow."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelag.shared import quoted, written

#: Distinct values of one score in one group that a single ordered task takes; larger groups are cut into bins.
BIN_ROWS = 1 << 20
#: Quantiles at which such a group is cut; the cuts only spread the work, the ranks stay exact.
BINS = 256
#: Parts that the items of a larger group are spread over.
PARTS = 256


def _percentiles(long: DataFrame, keys: list[str], large: bool = True) -> DataFrame:
    """Distinct values of every (group, score) with how many rows lie below (lt), at (eq) and in all (n), and p.

    Equal values are counted before the shuffle; with ``large``, a group with more than BIN_ROWS distinct values of
    a score is cut at approximate quantiles, so that no task orders all of it, and the counts of
    the bins before are added to the place inside the bin.
    """
    values = long.groupBy(*keys, "j", "v").agg(F.count("*").alias("eq"))
    sizes = values.groupBy(*keys, "j").agg(F.sum("eq").alias("n"), F.count("*").alias("d"))
    if not large:
        # every group fits a task: its values are ordered where they lie
        w = Window.partitionBy(*keys, "j")
        ranked = values.withColumn("lt", F.sum("eq").over(w.orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("eq")).withColumn("n", F.sum("eq").over(w))
        return ranked.select(*keys, "j", "v", "eq", "lt", "n", F.round(_share(), 12).alias("p"))
    many = [r["_k"] for r in sizes.where(F.col("d") > BIN_ROWS).select(F.concat_ws("\x1f", *keys, "j").alias("_k")).collect()]  # at most rows / BIN_ROWS
    name = F.concat_ws("\x1f", *keys, "j")
    quantiles = values.where(name.isin(many)).groupBy(*keys, "j").agg(F.array_distinct(F.percentile_approx("v", [i / BINS for i in range(1, BINS)], 4 * BINS)).alias("q"))
    binned = values.join(sizes.drop("d"), [*keys, "j"]).join(F.broadcast(quantiles), [*keys, "j"], "left").withColumn("bin", F.coalesce(F.size(F.filter("q", lambda x: x < F.col("v"))), F.lit(0))).drop("q")
    inside = Window.partitionBy(*keys, "j", "bin").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    below = Window.partitionBy(*keys, "j").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    offsets = binned.groupBy(*keys, "j", "bin").agg(F.sum("eq").alias("c")).select(*keys, "j", "bin", F.coalesce(F.sum("c").over(below), F.lit(0)).alias("off"))
    ranked = binned.withColumn("lt", F.sum("eq").over(inside) - F.col("eq")).join(offsets, [*keys, "j", "bin"]).withColumn("lt", F.col("lt") + F.col("off"))
    return ranked.select(*keys, "j", "v", "eq", "lt", "n", F.round(_share(), 12).alias("p"))


def _share() -> Column:
    return F.when(F.col("n") > 1, (F.col("lt") + (F.col("eq") - 1) / 2) / (F.col("n") - 1)).otherwise(F.lit(0.5))


def _linear_flow(p: DataFrame, keys: list[str], q: float, full: float) -> DataFrame:
    """Adds the summed preference over the others (plus) and of the others (minus) of a linear preference.

    The preference of a over b is 0 up to a lead of ``q`` percentiles, 1 from ``full`` on and linear between.
    Its sum over all b is (G(p-q) - G(p-full)) / (full-q) with G(t) = sum of max(0, t-p_b), which two prefix
    sums over the sorted percentiles give: the values and the four points asked for stand in one order.
    """
    bins = F.greatest(F.lit(1), F.least(F.lit(4096), F.floor(F.col("n") / BIN_ROWS) + 1))
    asked = F.array(
        *(F.struct(F.lit(i).alias("what"), F.round(F.col("p") + d, 12).alias("t")) for i, d in enumerate((0.0, -q, -full, q, full)))
    )
    points = p.select(*keys, "j", "v", "eq", "n", "p", F.explode(asked).alias("x")).select(*keys, "j", "v", "n", "p", "x.what", "x.t", F.when(F.col("x.what") == 0, F.col("eq")).otherwise(0).alias("w"))
    points = points.withColumn("bin", F.floor(F.least(F.greatest(F.col("t"), F.lit(0.0)), F.lit(1.0)) * bins).cast("int"))
    inside = Window.partitionBy(*keys, "j", "bin").orderBy("t").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    below = Window.partitionBy(*keys, "j").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    sums = points.groupBy(*keys, "j", "bin").agg(F.sum("w").alias("c"), F.sum(F.col("w") * F.col("t")).alias("s"))
    sums = sums.select(*keys, "j", "bin", F.coalesce(F.sum("c").over(below), F.lit(0)).alias("c0"), F.coalesce(F.sum("s").over(below), F.lit(0.0)).alias("s0"))
    at = points.withColumns({"c": F.sum("w").over(inside), "s": F.sum(F.col("w") * F.col("t")).over(inside)}).where("what > 0").join(sums, [*keys, "j", "bin"])
    g = (F.col("c") + F.col("c0")) * F.col("t") - (F.col("s") + F.col("s0"))
    wide = at.groupBy(*keys, "j", "v", "n", "p").agg(*(F.max(F.when(F.col("what") == i, g)).alias(f"g{i}") for i in (1, 2, 3, 4)))
    # sum over b of max(0, p_b - t) = S - p_all*t + G(t), where the mean of all percentiles is one half
    plus = (F.col("g1") - F.col("g2")) / (full - q)
    over = lambda k, t: F.col(k) + F.col("n") * (F.lit(0.5) - (F.col("p") + t))
    minus = (over("g3", q) - over("g4", full)) / (full - q)
    return wide.select(*keys, "j", "v", "n", plus.alias("plus"), minus.alias("minus"))


def net_flow(
    df: DataFrame,
    group: Sequence[str],
    item: str,
    scores: Mapping[str, int],
    weights: Mapping[str, float] | None = None,
    indifference: float = 0.0,
    full: float = 0.0,
    valid: str | None = None,
) -> DataFrame:
    """Net flow of every item in its group: how much it is preferred to the others less how much they are to it.

    Each score is turned into percentiles of its group, so no unit or spread counts; ties share a percentile.
    Per score an item's preference over another is a function of the lead in percentiles: 0 up to
    ``indifference``, 1 from ``full`` on, linear between; with both 0 any lead counts 1. The preferences over
    all others come exactly from sorted prefix sums, never from pairs, and are weighted into one flow in [-1, 1].

    :param group: columns of the group, :param item: column that identifies an item in it.
    :param scores: score column -> 1 if high is good, -1 if low is good.
    :param weights: weight of each score, equal if absent; they are scaled to sum 1.
    :param valid: SQL condition; items that don't meet it, or with a null, NaN or infinite score, are left out.
    :returns: group, item, the scores, ``flow_<i>`` of each score in the order given, and ``net_flow``.
        Rows repeated under the same group and item count once (the least of each score). A group of
        one item has flow 0. Null groups and items are values like others. An empty table gives no rows.
    """
    plain, large, *_ = _flows(df, group, item, scores, weights, indifference, full, valid)
    back = [F.col(f"k{i}").alias(c) for i, c in enumerate(group)] + [F.col("item").alias(item)]
    back += [(F.col(f"v{i}") * (1.0 if scores[c] > 0 else -1.0) + 0.0).alias(c) for i, c in enumerate(scores)]
    both = [x.select(*back, *(F.col(f"f{i}").alias(f"flow_{i}") for i in range(len(scores))), "net_flow") for x in (plain, large) if x is not None]
    return both[0] if len(both) == 1 else both[0].unionAll(both[1])


def _large(rows: DataFrame, keys: list[str]) -> DataFrame | None:
    """Keys of the groups of more than BIN_ROWS rows, of which there are at most rows / BIN_ROWS; None if there are none."""
    big = rows.groupBy(*keys).count().where(F.col("count") > BIN_ROWS).select(*(F.col(k).alias(f"_{k}") for k in keys)).collect()
    return rows.sparkSession.createDataFrame(big, rows.select(*(F.col(k).alias(f"_{k}") for k in keys)).schema) if big else None


def _same(keys: list[str]) -> Column:
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return on


def _flows(df, group, item, scores, weights, indifference, full, valid) -> tuple[DataFrame, DataFrame | None, list[str]]:
    """Flows of the groups that fit a task, and of the others (None if there are none): k0, ..., item, v0, ..., f0, ..., net_flow."""
    group, names = list(group), list(scores)
    keys = [f"k{i}" for i in range(len(group))]
    m = len(names)
    w = {c: (weights or {}).get(c, 1.0 if weights is None else 0.0) for c in names}
    total = sum(w.values())
    if total <= 0 or not 0 <= indifference <= full or (full and indifference == full):
        raise ValueError("weights must have a positive sum, and 0 <= indifference < full (or both 0)")
    rows = df.where(valid) if valid else df
    rows = rows.select(*(quoted(c).alias(a) for a, c in zip(keys, group)), quoted(item).alias("item"), *(quoted(c).cast("double").alias(f"v{i}") for i, c in enumerate(names)))
    for i in range(m):
        rows = rows.where(F.col(f"v{i}").isNotNull() & ~F.isnan(f"v{i}") & (F.abs(f"v{i}") < float("inf")))
    once = [F.min(F.col(f"v{i}") * (1.0 if scores[c] > 0 else -1.0) + 0.0).alias(f"v{i}") for i, c in enumerate(names)]
    net = sum((F.col(f"f{i}") * (w[c] / total) for i, c in enumerate(names)), F.lit(0.0)).alias("net_flow")
    out = lambda x: x.select(*keys, "item", *(f"v{i}" for i in range(m)), *(f"f{i}" for i in range(m)), net)

    def by_values(rows: DataFrame, large: bool) -> DataFrame:
        """Through the distinct values of each group and score."""
        # nulls in keys become equal under a join through a key that holds them as a struct's text
        rows = rows.withColumn("g", F.to_json(F.struct(*keys)) if len(keys) > 1 else F.coalesce(F.concat(F.lit("="), F.col(keys[0]).cast("string")), F.lit("")))
        rows = written(rows.groupBy("g", *keys, "item").agg(*once))
        apart = F.posexplode(F.array(*(f"v{i}" for i in range(m)))).alias("j", "v")
        p = _percentiles(rows.select("g", apart), ["g"], large)
        if full == 0.0:
            flows = p.select("g", "j", "v", F.when(F.col("n") > 1, (2 * F.col("lt") + F.col("eq") - F.col("n")) / (F.col("n") - 1)).otherwise(0.0).alias("f"))
        else:
            flows = _linear_flow(p, ["g"], indifference, full).select("g", "j", "v", F.when(F.col("n") > 1, (F.col("plus") - F.col("minus")) / (F.col("n") - 1)).otherwise(0.0).alias("f"))
        each = rows.select("g", *keys, "item", apart).join(flows, ["g", "j", "v"])
        cols = [F.max(F.when(F.col("j") == i, F.col(c))).alias(f"{c}{i}") for c in "vf" for i in range(m)]
        return out(each.groupBy("g", *keys, "item").agg(*cols))

    hot = _large(rows, keys)
    plain = rows if hot is None else rows.join(F.broadcast(hot), _same(keys), "left_anti")
    large = None if hot is None else by_values(rows.join(F.broadcast(hot), _same(keys), "left_semi"), True)
    if full == 0.0:
        # one exchange: a group's rows are made distinct, and each score's ranks read off its order, where they lie
        plain = plain.repartition(*keys).groupBy(*keys, "item").agg(*once)
        n = F.count("*").over(Window.partitionBy(*keys))
        plain = plain.withColumn("n", n)
        for i in range(m):
            order = Window.partitionBy(*keys).orderBy(f"v{i}")
            upto = F.count("*").over(order.rangeBetween(Window.unboundedPreceding, Window.currentRow))
            plain = plain.withColumn(f"f{i}", (F.rank().over(order) - 1) - (F.col("n") - upto)).withColumn(f"f{i}", F.when(F.col("n") > 1, F.col(f"f{i}") / (F.col("n") - 1)).otherwise(0.0))
        plain = out(plain)
    else:
        plain = by_values(plain, False)
    return plain, large, keys


def _unbeaten(rows: DataFrame, keys: list[str]) -> Column:
    """Whether no other row of the same keys is at least as good in two of the scores v0, v1, v2.

    In the order of one score, then another, a row is beaten in these two if one before it has as much of the other.
    """
    ok = F.lit(True)
    for i, j in ((0, 1), (1, 2), (2, 0)):
        order = Window.partitionBy(*keys).orderBy(F.col(f"v{i}").desc(), F.col(f"v{j}").desc())
        before = F.max(f"v{j}").over(order.rowsBetween(Window.unboundedPreceding, -1))
        twin = F.coalesce((F.lead(f"v{i}").over(order) == F.col(f"v{i}")) & (F.lead(f"v{j}").over(order) == F.col(f"v{j}")), F.lit(False))
        ok = ok & (before.isNull() | (before < F.col(f"v{j}"))) & ~twin
    return ok


def majority_winners(df: DataFrame, group: str, item: str, scores: Mapping[str, int], valid: str | None = None) -> DataFrame:
    """``group`` and ``item`` of the item that is strictly better than every other of its group in at least two of three scores.

    The net flow of equal weights, any lead counting 1, nominates: such an item leads every rival in two of three scores, so
    its flow is at least 1/3 (0 if it is alone). An exact check follows: it is no winner if another item is at least as
    good in two of the scores, which the running maximum of one score in the order of another tells. A group too large for
    a task is split by the items' hash; as no two items can both win, each part leaves at most one, and the one
    that is left of those is compared with its whole group.
    """
    if len(scores) != 3:
        raise ValueError("three scores are needed")
    plain, large, keys = _flows(df, [group], item, scores, None, 0.0, 0.0, valid)
    v = ["v0", "v1", "v2"]
    nominated = F.col("net_flow") >= F.lit(1 / 3 - 1e-9)
    alone = F.count("*").over(Window.partitionBy(*keys)) == 1

    def settled(rows: DataFrame, by: list[str]) -> DataFrame:
        return rows.withColumn("ok", _unbeaten(rows, by)).where("ok")

    found = settled(plain.withColumn("nominated", nominated | alone), keys).where("nominated").select(*keys, "item")
    if large is not None:
        large = written(large.withColumn("part", F.pmod(F.xxhash64("item"), F.lit(PARTS))))
        left = settled(large.where(nominated), [*keys, "part"]).select(*keys, "item", *v)
        left = settled(left, keys).select(*(F.col(k).alias(f"_{k}") for k in keys), F.col("item").alias("_item"), *(F.col(x).alias(f"_{x}") for x in v))
        # one row of a large group, of which there are few
        better = sum(((F.col(f"_{x}") > F.col(x)).cast("int") for x in v), F.lit(0))
        held = large.join(F.broadcast(left), _same(keys)).groupBy(*(f"_{k}" for k in keys), "_item").agg(F.sum(F.when((better >= 2) | F.col("item").eqNullSafe(F.col("_item")), 0).otherwise(1)).alias("lost"))
        found = found.unionAll(held.where("lost = 0").select(*(f"_{k}" for k in keys), "_item"))
    return found.select(F.col(keys[0]).alias(group), F.col("item").alias(item))
