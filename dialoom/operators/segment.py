"""From gap scores to segments: depth by windows, the deepest gaps, segments between them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def depth_scores(scores: DataFrame) -> DataFrame:
    """scores(dialogue_id, gap_idx, score) with depth. The climb to the left ends at the last place whose left neighbour is lower
    or missing; to the right likewise. Ties climb on. To 9 digits."""
    by = W.partitionBy("dialogue_id").orderBy("gap_idx")
    near = scores.withColumn("before", F.lag("score").over(by)).withColumn("after", F.lead("score").over(by))
    left_end = F.when(F.col("before").isNull() | (F.col("before") < F.col("score")), F.col("score"))
    right_end = F.when(F.col("after").isNull() | (F.col("after") < F.col("score")), F.col("score"))
    near = near.withColumn("left_end", left_end).withColumn("right_end", right_end)
    left = F.last("left_end", ignorenulls=True).over(by.rowsBetween(W.unboundedPreceding, 0))
    right = F.first("right_end", ignorenulls=True).over(by.rowsBetween(0, W.unboundedFollowing))
    out = near.withColumn("left_peak", left).withColumn("right_peak", right)
    depth = F.round(0.5 * (F.col("left_peak") + F.col("right_peak") - 2 * F.col("score")), 9)
    return out.select(*scores.columns, depth.alias("depth"))


def top_gaps(depths: DataFrame, k: str = "k") -> DataFrame:
    """The k deepest gaps of each dialogue, the later first where depths are equal. k names a column."""
    rank = F.row_number().over(W.partitionBy("dialogue_id").orderBy(F.desc("depth"), F.desc("gap_idx")))
    return depths.withColumn("rank", rank).where(F.col("rank") <= F.col(k))


def with_boundaries(utterances: DataFrame, boundaries: DataFrame) -> DataFrame:
    """utterances with hyp: how many of boundaries(dialogue_id, gap_idx) stand before each."""
    marks = boundaries.select("dialogue_id", F.col("gap_idx").alias("utt_idx")).withColumn("label", F.lit(1))
    rows = utterances.join(marks, ["dialogue_id", "utt_idx"], "left")
    before = W.partitionBy("dialogue_id").orderBy("utt_idx").rowsBetween(W.unboundedPreceding, -1)
    return rows.withColumn("hyp", F.coalesce(F.sum("label").over(before), F.lit(0)).cast("int")).drop("label")


def masses(rows: DataFrame, segment: str = "hyp") -> DataFrame:
    """dialogue_id and masses, the segments' lengths in order."""
    sizes = rows.groupBy("dialogue_id", F.col(segment).alias("seg")).agg(F.count(F.lit(1)).alias("mass"))
    return sizes.groupBy("dialogue_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seg", "mass"))), lambda x: x["mass"]).alias("masses"))


def predicted(utterances: DataFrame, scores: DataFrame, pick_num: int | None = None) -> DataFrame:
    """utterances with hyp. As many boundaries as the dialogue has, or `pick_num`."""
    if pick_num is None:
        counts = utterances.where("utt_idx = 0").select("dialogue_id", (F.col("n_seg") - 1).alias("k"))
        depths = depth_scores(scores).join(counts, "dialogue_id")
    else:
        depths = depth_scores(scores).withColumn("k", F.lit(pick_num))
    return with_boundaries(utterances, top_gaps(depths))
