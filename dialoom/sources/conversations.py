"""Utterances of sessions from a table conversations(conv_id, turn, role, text): `per_session` conversations make one session,
each being a segment of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def sessions(conversations: DataFrame, per_session: int = 4) -> DataFrame:
    """dialogue_id, utt_idx, seg_rank, n_utt, n_seg, conv_id, role, text. One shuffle, by dialogue_id; windows, aggregates and joins
    by dialogue_id that follow need no other."""
    own = conversations.select(F.floor(F.col("conv_id") / per_session).cast("long").alias("dialogue_id"), "conv_id", "turn", "role", "text")
    by = W.partitionBy("dialogue_id")
    out = own.select(
        "dialogue_id",
        (F.row_number().over(by.orderBy("conv_id", "turn", "role", "text")) - 1).alias("utt_idx"),
        (F.dense_rank().over(by.orderBy("conv_id")) - 1).alias("seg_rank"),
        "conv_id",
        "role",
        "text",
    )
    return out.withColumn("n_utt", F.count(F.lit(1)).over(by).cast("int")).withColumn("n_seg", (F.max("seg_rank").over(by) + 1).cast("int"))


def dialogues(conversations: DataFrame) -> DataFrame:
    """Each conversation as a single-topic dialogue: conv_id, n_turns and turns, an array of (turn, speaker, text) in order;
    user and assistant are the citizen and officer. A conversation's turns are held as one value."""
    speaker = F.when(F.col("role") == "user", "citizen").when(F.col("role") == "assistant", "officer").otherwise(F.col("role"))
    turn = F.struct("turn", speaker.alias("speaker"), "text")
    return conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"), F.count(F.lit(1)).alias("n_turns"))
