"""A stratified evaluation split: quartiles of the training sessions' lengths, as many candidates from each bucket."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dialoom.functions.sampling import rank_key


def token_counts(utterances: DataFrame) -> DataFrame:
    """dialogue_id and n_tokens, its white-space separated tokens."""
    n = F.size(F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), ""))
    return utterances.groupBy("dialogue_id").agg(F.sum(n).alias("n_tokens"))


def quartiles(counts: DataFrame) -> DataFrame:
    """One row q25, q50, q75: the values at places floor(p * n) of the sorted counts. Counts repeat, so equal ones are summed first
    and only the distinct values are put in order."""
    sizes = counts.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(W.orderBy("n_tokens").rowsBetween(W.unboundedPreceding, 0))  # distinct lengths only
    rows = sizes.select("n_tokens", upto.alias("upto"), F.sum("n").over(W.partitionBy()).alias("all"))
    return rows.agg(*[F.min(F.when(F.col("upto") > F.floor(F.col("all") * p), F.col("n_tokens"))).alias(q) for q, p in (("q25", 0.25), ("q50", 0.5), ("q75", 0.75))])


def bucketed(counts: DataFrame, points: DataFrame) -> DataFrame:
    """counts with bucket 0..3; a count on a point belongs below it."""
    n = F.col("n_tokens")
    bucket = F.when(n <= F.col("q25"), 0).when(n <= F.col("q50"), 1).when(n <= F.col("q75"), 2).otherwise(3)
    return counts.crossJoin(F.broadcast(points)).withColumn("bucket", bucket).drop("q25", "q50", "q75")  # points is one row


def stratified(buckets: DataFrame, target: int = 250, seed: str = "43") -> DataFrame:
    """The first target // 4 of each bucket in a drawn order, with their place in it."""
    place = F.row_number().over(W.partitionBy("bucket").orderBy(rank_key(seed, "dialogue_id")))
    return buckets.withColumn("place", place).where(F.col("place") <= target // 4)


def pool_by_suffix(dialogues: DataFrame, suffixes: DataFrame) -> DataFrame:
    """The dialogues whose id ends, after its last underscore, in one of suffixes(suffix)."""
    own = dialogues.withColumn("suffix", F.element_at(F.split("dialogue_id", "_"), -1))
    return own.join(suffixes.select("suffix").distinct(), "suffix", "left_semi").drop("suffix")


def joint_manifest(val: DataFrame, test: DataFrame) -> DataFrame:
    """The rows of both splits, each with the name of its own."""
    return val.withColumn("split", F.lit("val")).unionByName(test.withColumn("split", F.lit("test")))


def oversampled(sessions: DataFrame, candidates: int = 600, seed: str = "43") -> DataFrame:
    """sessions(dialogue_id, n_tokens) repeated, in a drawn order, until there are `candidates` of them: copy counts from 0. Where
    there are as many already, the first `candidates` in that order. Few sessions of one split: one task numbers them."""
    place = F.row_number().over(W.orderBy(rank_key(seed, F.lit("candidate"), "dialogue_id"))) - 1
    rows = sessions.withColumn("place", place).withColumn("n", F.count(F.lit(1)).over(W.partitionBy()))
    copies = F.floor((F.lit(candidates) - 1 - F.col("place")) / F.col("n")).cast("int")
    return rows.where(F.col("place") < candidates).withColumn("copy", F.explode(F.sequence(F.lit(0), copies))).drop("place", "n")
