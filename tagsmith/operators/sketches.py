"""Mergeable summaries of results: how many different values and which quantiles of the score, by day, field and status.

A day's table is written once; any span of days is answered from the sketches, without the rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Distinct counts: 2**LG_K registers, a relative standard error of about 1.04 / sqrt(2**LG_K). Quantiles: ranks are off by about 1.33 % at K = 200.
LG_K, K = 12, 200


def daily_sketches(rows: DataFrame, keys: tuple, value: str, score: str, day: str = "day") -> DataFrame:
    """day, keys, n, values (sketch of different values), scores (sketch of quantiles; null without a score)."""
    agg = rows.groupBy(day, *keys).agg(F.count(F.lit(1)).alias("n"), F.hll_sketch_agg(value, LG_K).alias("values"), F.count(score).alias("n_scores"), F.kll_sketch_agg_double(F.col(score).cast("double"), F.lit(K)).alias("scores"))
    return agg.withColumn("scores", F.when(F.col("n_scores") > 0, F.col("scores")))


def merged_sketches(daily: DataFrame, keys: tuple) -> DataFrame:
    """keys, n, n_scores, values, scores over all days of daily: sketches of the whole, from the days' alone."""
    return daily.groupBy(*keys).agg(F.sum("n").alias("n"), F.hll_union_agg("values").alias("values"), F.sum("n_scores").alias("n_scores"), F.kll_merge_agg_double("scores").alias("scores"))


def answers(sketches: DataFrame, *shares: float) -> DataFrame:
    """sketches with distinct (estimate), and q<percent> for each share of the scores, in place of the sketches."""
    at = {f"q{round(s * 100)}": F.when(F.col("n_scores") > 0, F.kll_sketch_get_quantile_double("scores", F.lit(s))) for s in shares}
    return sketches.withColumns({"distinct": F.hll_sketch_estimate("values"), **at}).drop("values", "scores")
