"""Queries of the training-data problems, each over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelag.llm import bpe, knn, mix, outrank, spans, topn
from tidelag.shared import table

COMBO_SCORES = {"rho": 1, "MAE": -1, "RMSE": -1}
LAGS = ["x_t", "x_t-1", "x_t-2"]
ELIGIBLE = "rho BETWEEN -1 AND 1 AND RMSE >= 0"


def p1_ranking(spark: SparkSession, d: str) -> DataFrame:
    """Rank of every eligible combo in its run by net flow with a linear preference."""
    f = outrank.net_flow(table(spark, d, "multiview_combos"), ["run_id"], "combo_id", COMBO_SCORES, indifference=0.0, full=0.25, valid=ELIGIBLE)
    return f.select("run_id", "combo_id", F.round("net_flow", 6).alias("net_flow"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """The combo of each run that leads every other in two of the three scores."""
    return outrank.majority_winners(table(spark, d, "multiview_combos"), "run_id", "combo_id", COMBO_SCORES, ELIGIBLE)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Rows that are among each other's five nearest."""
    return knn.mutual(knn.nearest(table(spark, d, "block_3sp"), "row_id", LAGS, 5, 9000.0), 5).select(F.col("a").alias("row_id_a"), F.col("b").alias("row_id_b"))


def p4_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """The five nearest of every row whose id is divisible by 100, against all rows."""
    rows = table(spark, d, "block_3sp")
    n = knn.neighbours_of(rows.where("row_id % 100 = 0"), knn.nearest(rows, "row_id", LAGS, 5, 9000.0), "row_id", LAGS, 5)
    return n.select(F.col("id").alias("row_id"), "rank", "neighbour", F.round("distance", 9).alias("distance"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """The five best (column, E) of each target."""
    rows = table(spark, d, "embed_dim_columns").where("rho BETWEEN -1 AND 1")
    return topn.top_n(rows, "target", "rho", ["E", "column"], 5).select("target", "column", "E")


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    """Token ids of every document."""
    return bpe.encoded(table(spark, d, "documents"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Sources that fall short of their weight."""
    return mix.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))[1].where("falls_short").select("source")


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    """Wanted and actual share of each source in the mix."""
    return mix.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))[1]


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    """Documents of the mix with their copies."""
    return mix.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))[0]


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that share a stretch of 140 characters with another."""
    return spans.shared_spans(table(spark, d, "documents")).select("doc_id").distinct()


def p8_share(spark: SparkSession, d: str) -> DataFrame:
    """How much of each document is shared elsewhere."""
    return spans.shared_share(table(spark, d, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_ranking, p1_found, p4_found, p4_neighbours, p5_found, p6_ids, p7_found, p7_shares, p7_mix, p8_found, p8_share)}


def oracle_sql() -> dict[str, str]:
    from tidelag.llm.sql import ORACLE

    return dict(ORACLE)
