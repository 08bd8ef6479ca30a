"""Ranking quality of scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from relfold.functions.columns import gini, score_round
from relfold.session import stored

#: Slices of the score range; any number gives the same result.
SLICES = 1024


def auc_by_rank(df: DataFrame, score: str, label: str, slices: int = SLICES) -> DataFrame:
    """One row (auc, gini, positives, negatives): the chance that a positive outranks a negative, ties
    counting half. Null when one class is absent. A row without a label, or with a null or NaN score, makes the
    job fail: it could only be left out.

    Rows are first reduced to one per distinct score. The running count of negatives is then taken in
    two steps, over slices of the score range and inside each slice, so no task has to order all
    scores; the slice totals are at most ``slices`` rows.
    """
    value, known = F.col(score).cast("double"), F.col(label).isNotNull()
    usable = value.isNotNull() & ~F.isnan(value)
    value = F.when(usable, value).otherwise(F.raise_error(f"{score} is null or NaN").cast("double"))
    positive = F.when(known, F.col(label) == 1).otherwise(F.raise_error(f"{label} is null").cast("boolean"))
    per_score = df.select(value.alias("score"), positive.alias("positive")).groupBy("score").agg(F.count_if("positive").alias("pos"), F.count_if(~F.col("positive")).alias("neg"))
    # Read twice, for the slice borders and for the count; scores may be costly predictions.
    per_score = stored(per_score)
    sliced = _slice_scores(per_score, slices)
    totals = sliced.groupBy("slice").agg(F.sum("neg").alias("slice_neg"))
    earlier = Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("slice", F.coalesce(F.sum("slice_neg").over(earlier), F.lit(0)).alias("neg_offset"))
    inside = Window.partitionBy("slice").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    ranked = sliced.join(offsets, "slice").withColumn(
        "neg_before", F.col("neg_offset") + F.coalesce(F.sum("neg").over(inside), F.lit(0))
    )
    sums = ranked.agg(
        F.sum(F.col("pos") * (F.col("neg_before") + F.col("neg") / F.lit(2.0))).alias("wins"),
        F.coalesce(F.sum("pos"), F.lit(0)).alias("positives"),
        F.coalesce(F.sum("neg"), F.lit(0)).alias("negatives"),
    )
    pairs = F.col("positives").cast("double") * F.col("negatives")
    auc = F.try_divide(F.col("wins"), pairs)
    return sums.select(
        score_round(auc).alias("auc"), score_round(gini(auc)).alias("gini"), "positives", "negatives"
    )


def _slice_scores(per_score: DataFrame, slices: int) -> DataFrame:
    """Number the slice of each distinct score; slices hold about equally many distinct scores."""
    cuts = _cut_points(per_score, slices)
    if not cuts:
        return per_score.withColumn("slice", F.lit(0))
    edges = [float("-inf"), *cuts, float("inf")]
    bucketizer = Bucketizer(splits=edges, inputCol="score", outputCol="slice", handleInvalid="keep")
    return bucketizer.transform(per_score)


def _cut_points(per_score: DataFrame, slices: int) -> Sequence[float]:
    if slices < 2:
        return []
    found = per_score.approxQuantile("score", [i / slices for i in range(1, slices)], 0.5 / slices)
    return sorted(set(found))
