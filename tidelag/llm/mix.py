"""Mixing sources to target weights by Pareto order sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelag.llm import bpe
from tidelag.shared import quoted, written

#: Bins of the ranking variable; only the bin in which a source's sample ends is put in order.
BINS = 1 << 16


def uniform(key: Column, seed: int) -> Column:
    """A number in (0, 1) that depends on the key and the seed alone."""
    h = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string"))), 1, 12), 16, 10).cast("double")
    return (h + 0.5) / float(1 << 48)


def _plan(sizes: DataFrame, targets: DataFrame, total: float | None) -> DataFrame:
    """What each source gives: whole copies, and of the rest the slope of the inclusion probability and the sample's size.

    ``sizes`` holds how many records of each source have each size. A record of t tokens gets one more copy with
    probability min(1, c*t); c solves sum of t*min(1, c*t) = tokens still wanted, exactly: with the sizes in order the
    sum is linear in c between one size's reciprocal and the next, so prefix sums give the stretch and c in it.
    """
    own = sizes.groupBy("src").agg(F.sum(F.col("t") * F.col("m")).alias("own"), F.sum("m").alias("records"))
    t = targets.join(own, "src", "left").select("src", "weight", "repeats", F.coalesce("own", F.lit(0)).alias("own"), F.coalesce("records", F.lit(0)).alias("records"))
    everything = Window.partitionBy()
    t = t.withColumn("all", F.sum("own").over(everything) if total is None else F.lit(float(total)))
    t = t.withColumn("wanted", F.col("weight") * F.col("all"))
    t = t.withColumn("short", F.col("repeats") * F.col("own") < F.col("wanted"))
    t = t.withColumn("whole", F.when(F.col("short") | (F.col("own") == 0), F.col("repeats").cast("bigint")).otherwise(F.floor(F.col("wanted") / F.col("own"))))
    t = t.withColumn("rest", F.when(F.col("short") | (F.col("own") == 0), 0.0).otherwise(F.greatest(F.lit(0.0), F.col("wanted") - F.col("whole") * F.col("own"))))
    up = Window.partitionBy("src").orderBy("t").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    s = sizes.where("t > 0").join(t.where("rest > 0").select("src", "own", "rest"), "src")
    # with c = 1/t the records up to t are included in proportion, the longer ones surely
    s = s.withColumns({"q": F.sum(F.col("t") * F.col("t") * F.col("m")).over(up), "l": F.sum(F.col("t") * F.col("m")).over(up)})
    at_reciprocal = F.col("q") / F.col("t") + (F.col("own") - F.col("l"))
    # the largest size whose reciprocal still gives enough: above it nothing is sure to be included
    best = s.where(at_reciprocal >= F.col("rest")).groupBy("src").agg(F.max(F.struct("t", "q", "l", "own", "rest")).alias("b"))
    c = best.select("src", ((F.col("b.rest") - (F.col("b.own") - F.col("b.l"))) / F.col("b.q")).alias("c"))
    expected = sizes.where("t > 0").join(c, "src").groupBy("src").agg(F.round(F.sum(F.col("m") * F.least(F.lit(1.0), F.col("c") * F.col("t")))).cast("bigint").alias("sample"))
    return t.join(c, "src", "left").join(expected, "src", "left").withColumn("sample", F.coalesce("sample", F.lit(0)))


def mix(docs: DataFrame, targets: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", seed: int = 7, total: float | None = None, path: str = bpe.BYTE_BPE_50K) -> tuple[DataFrame, DataFrame]:
    """Chosen records with their copies, and a report a source.

    :param docs: records; a record's size is its tokens (null and empty texts have 0). :param targets: columns ``source``,
        ``weight`` (shares, sum 1) and ``max_repeats``; a source listed twice counts with its first row in order.
    :param total: size of the mix in tokens; if None, the tokens of all records of listed sources, each counted once.
    :returns: (key, source, n_tokens, copies) of the records in the mix, and (source, weight, max_repeats, own_tokens,
        wanted_tokens, falls_short, mix_tokens, share) of every listed source; ``share`` is of the mix as it came out.

    A source whose wanted tokens exceed ``max_repeats`` times its own falls short and gives all it may. Of the others
    every record gets the whole copies that fit; the rest is a sample of fixed size with inclusion probabilities in
    proportion to tokens: records are ordered by the odds of a random number over the odds of inclusion, and the first
    ones are taken. Records with a null or unlisted source take no part; rows that repeat a key and source count
    once. Which record is taken depends on key and seed alone, not on how the table is split. Empty tables give no rows.
    """
    listed = targets.select(quoted("source").alias("src"), F.col("weight").cast("double").alias("weight"), F.col("max_repeats").cast("bigint").alias("repeats")).where("src IS NOT NULL")
    listed = listed.groupBy("src").agg(F.min(F.struct("weight", "repeats")).alias("x")).select("src", "x.*")
    rows = docs.select(quoted(key).alias("k"), quoted(source).alias("src"), quoted(text).alias("x"))
    rows = rows.join(listed.select("src"), "src", "left_semi")
    counted = written(bpe.token_counts(rows, ["k", "src"], "x", path).groupBy("k", "src").agg(F.max("n_tokens").alias("t")))
    sizes = written(counted.groupBy("src", "t").agg(F.count("*").alias("m")))
    plan = written(_plan(sizes, listed, total))
    p = F.least(F.lit(1.0), F.col("c") * F.col("t"))
    u = uniform(F.col("k"), seed)
    # p/(1-p) may be infinite: such a record comes first
    odds = F.when((F.col("sample") == 0) | (F.col("t") == 0) | F.col("c").isNull(), None).when(p >= 1.0, 0.0).otherwise((u / (1 - u)) * ((1 - p) / p))
    scored = counted.join(plan.select("src", "whole", "c", "sample"), "src").withColumn("odds", odds)
    scored = scored.withColumn("bin", F.floor(F.col("odds") / (1 + F.col("odds")) * BINS).cast("int")).select("k", "src", "t", "whole", "sample", "odds", "bin")
    before = Window.partitionBy("src").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = scored.where("bin IS NOT NULL").groupBy("src", "sample", "bin").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    last = bins.where("before < sample AND before + n >= sample").select("src", F.col("bin").alias("last_bin"), (F.col("sample") - F.col("before")).alias("left"))
    scored = scored.join(last, "src", "left")
    ranked = scored.where("bin = last_bin").withColumn("rank", F.row_number().over(Window.partitionBy("src", "bin").orderBy("odds", "k")))
    taken = ranked.withColumn("extra", (F.col("rank") <= F.col("left")).cast("int")).drop("rank").unionByName(scored.where("bin IS NULL OR last_bin IS NULL OR bin <> last_bin").withColumn("extra", F.coalesce((F.col("bin") < F.coalesce("last_bin", F.lit(BINS + 1))).cast("int"), F.lit(0))))
    chosen = taken.withColumn("copies", F.col("whole") + F.col("extra")).where("copies > 0").select("k", "src", "t", "copies")
    chosen = written(chosen)
    got = chosen.groupBy("src").agg(F.sum(F.col("t") * F.col("copies")).alias("got"))
    report = plan.join(got, "src", "left").withColumn("got", F.coalesce("got", F.lit(0)))
    everything = F.sum("got").over(Window.partitionBy())
    return (
        chosen.select(F.col("k").alias(key), F.col("src").alias(source), F.col("t").alias("n_tokens"), "copies"),
        report.select(
            F.col("src").alias("source"), "weight", F.col("repeats").alias("max_repeats"), F.col("own").alias("own_tokens"), F.col("wanted").alias("wanted_tokens"),
            F.col("short").alias("falls_short"), F.col("got").alias("mix_tokens"), F.when(everything > 0, F.round(F.col("got") / everything, 6)).alias("share"),
        ),
    )
