"""How well scores tell labelled rows apart: area under the curve and calibration, exact, for any number of rows.

Scores are counted per distinct value first, on the map side, so a score that most rows share is one row. Distinct values go
into ranges of equal size, each is ranked on its own, and only the totals of ranges are added up in order: nothing
sorts all scores in one place, and no range grows with the way scores are spread.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.sources.storage import stored_table


def _stacked(rows: DataFrame, scores: list[str], positive: str) -> DataFrame:
    """detector, score, positive: a row for each score of a row. Rows without the label and scores that are no number don't count."""
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("detector"), F.col(c).cast("double").alias("score")) for c in scores])).alias("s")
    stacked = rows.select(F.col(positive).cast("boolean").alias("positive"), each).select("positive", "s.detector", "s.score")
    return stacked.filter(F.col("positive").isNotNull() & F.col("score").isNotNull() & ~F.isnan("score"))


def ranking_quality(rows: DataFrame, scores: list[str], positive: str) -> DataFrame:
    """detector, positives, negatives, auc: the chance that a positive row has a higher score than a negative one, ties counting
    half. Without rows of both kinds it is NULL."""
    counts = _stacked(rows, scores, positive).groupBy("detector", "score").agg(
        F.count_if("positive").alias("pos"), F.count_if(~F.col("positive")).alias("neg")
    )
    blocks = stored_table(counts.repartitionByRange("detector", "score").withColumn("block", F.spark_partition_id()), "ranked")
    totals = blocks.groupBy("detector", "block").agg(F.sum("neg").alias("block_neg"))
    earlier = Window.partitionBy("detector").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("detector", "block", F.coalesce(F.sum("block_neg").over(earlier), F.lit(0)).alias("before"))
    inside = Window.partitionBy("detector", "block").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    ranked = blocks.withColumn("below", F.coalesce(F.sum("neg").over(inside), F.lit(0))).join(totals, ["detector", "block"])
    # twice the number of pairs in the right order: whole numbers, which a sum of any order keeps
    right = F.col("pos").cast("decimal(38,0)") * (2 * (F.col("before") + F.col("below")) + F.col("neg")).cast("decimal(19,0)")
    summed = ranked.groupBy("detector").agg(F.sum("pos").alias("positives"), F.sum("neg").alias("negatives"), F.sum(right.cast("decimal(38,0)")).alias("right"))
    pairs = F.col("positives").cast("double") * F.col("negatives")
    return summed.select("detector", "positives", "negatives", F.when(pairs > 0, F.col("right").cast("double") / (2 * pairs)).alias("auc"))


def calibration(rows: DataFrame, scores: list[str], positive: str, bins: int = 10) -> DataFrame:
    """detector, bin, rows, mean_score, positive_share: for scores from 0 to 1 in ``bins`` equal widths, 1 in the last one. Scores
    outside count in the nearest bin."""
    slot = F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor(F.col("score") * bins))).cast("int")
    return _stacked(rows, scores, positive).groupBy("detector", slot.alias("bin")).agg(
        F.count(F.lit(1)).alias("rows"), F.avg("score").alias("mean_score"), F.avg(F.col("positive").cast("int")).alias("positive_share")
    )


def calibration_error(bins: DataFrame) -> DataFrame:
    """detector, calibration_error: how far mean score and share of positives are apart, by rows; of a ``calibration`` table."""
    off = F.sum(F.col("rows") * F.abs(F.col("mean_score") - F.col("positive_share")))
    return bins.groupBy("detector").agg((off / F.sum("rows")).alias("calibration_error"))
