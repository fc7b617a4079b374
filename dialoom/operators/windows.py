"""Ordered windows over utterances(dialogue_id, utt_idx, seg_rank, n_utt, text)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BY = ("dialogue_id",)


def ordered(*extra: str):
    return W.partitionBy(*BY, *extra).orderBy("utt_idx")


def context(text: Column, history: int) -> Column:
    """The last `history` texts up to the anchor; crosses segments."""
    return F.collect_list(text).over(ordered().rowsBetween(-(history - 1), 0))


def continuation(text: Column, history: int) -> Column:
    """Up to `history` texts from here on, inside the segment."""
    return F.collect_list(text).over(ordered("seg_rank").rowsBetween(0, history - 1))


def gap_windows(utterances: DataFrame, width: int = 2) -> DataFrame:
    """dialogue_id, gap_idx, context (the last `width` texts up to the gap) and following (the next `width`); crosses segments."""
    following = F.collect_list("text").over(ordered().rowsBetween(1, width))
    rows = utterances.select("dialogue_id", "utt_idx", "n_utt", context(F.col("text"), width).alias("context"), following.alias("following"))
    return rows.where("utt_idx < n_utt - 1").select("dialogue_id", F.col("utt_idx").alias("gap_idx"), "context", "following")


def segments(utterances: DataFrame) -> DataFrame:
    """dialogue_id, seg_rank, start, stop (exclusive) and mass."""
    out = utterances.groupBy("dialogue_id", "seg_rank").agg(F.min("utt_idx").alias("start"), (F.max("utt_idx") + 1).alias("stop"), F.count(F.lit(1)).alias("mass"))
    return out


def segment_starts(utterances: DataFrame) -> DataFrame:
    """dialogue_id and start of each segment, and the number of utterances as the last start."""
    before = F.lag("seg_rank").over(ordered())
    rows = utterances.withColumn("before", before).where("before is null or before <> seg_rank")
    starts = rows.select("dialogue_id", F.col("utt_idx").alias("start"))
    return starts.unionByName(utterances.where("utt_idx = 0").select("dialogue_id", F.col("n_utt").alias("start")))


def gold_boundaries(utterances: DataFrame) -> DataFrame:
    """dialogue_id and gap_idx of the last utterance of each segment but the last."""
    rows = utterances.withColumn("after", F.lead("seg_rank").over(ordered())).where("after <> seg_rank")
    return rows.select("dialogue_id", F.col("utt_idx").alias("gap_idx"))


def crops(utterances: DataFrame, reach: int) -> DataFrame:
    """For each anchor that is followed in its own segment (or in a dialogue of one segment): the texts of [i + 1 - reach, i + 1 +
    reach) and their segments, and mid, the place of i + 1 among them."""
    frame = ordered().rowsBetween(1 - reach, reach)
    rows = utterances.select(
        "dialogue_id",
        F.col("utt_idx").alias("anchor_idx"),
        "n_utt",
        "n_seg",
        (F.lead("seg_rank").over(ordered()) == F.col("seg_rank")).alias("same"),
        F.collect_list("text").over(frame).alias("texts"),
        F.collect_list("seg_rank").over(frame).alias("segs"),
    )
    rows = rows.where("anchor_idx < n_utt - 1 and (same or n_seg = 1)")
    mid = F.col("anchor_idx") + 1 - F.greatest(F.col("anchor_idx") + 1 - reach, F.lit(0))
    return rows.select("dialogue_id", "anchor_idx", mid.alias("mid"), "texts", "segs")
