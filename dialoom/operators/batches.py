"""Batches of encoded rows in a drawn order, and rows of a batch filled up to one length."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dialoom.functions.sampling import rank_key


def shuffled(rows: DataFrame, keys: list[str], size: int, seed: str = "shuffle", digits: int = 3) -> DataFrame:
    """rows with place (from 0, in the order of a hash of the keys and then the keys) and batch, `size` places each. Rows are ranked
    inside buckets by the first `digits` hex digits of the hash; the buckets' counts, 16 ** digits rows at most, are summed up before."""
    own = rows.withColumn("__h", rank_key(seed, *keys)).withColumn("__b", F.substring("__h", 1, digits))
    counts = own.groupBy("__b").agg(F.count(F.lit(1)).alias("__n"))
    ahead = F.coalesce(F.sum("__n").over(W.orderBy("__b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ranked = own.withColumn("__r", F.row_number().over(W.partitionBy("__b").orderBy("__h", *keys)) - 1)
    out = ranked.join(F.broadcast(counts.select("__b", ahead.alias("__ahead"))), "__b")
    place = F.col("__ahead") + F.col("__r")
    return out.withColumn("place", place).withColumn("batch", F.floor(place / size)).drop("__h", "__b", "__n", "__r", "__ahead")


def collated(rows: DataFrame, batch: str, pad: int = 0, type_pad: int = 1) -> DataFrame:
    """input_ids filled with the tokenizer's `pad` and type_ids with `type_pad` up to the longest row of the batch; attention_mask
    says which ids are the row's own, whatever `pad` is."""
    longest = rows.groupBy(batch).agg(F.max(F.size("input_ids")).alias("__longest"))
    out = rows.join(longest, batch)
    n = F.size("input_ids")
    room = F.col("__longest") - n
    filled = lambda c, value: F.concat(F.col(c), F.array_repeat(F.lit(value), room))
    mask = F.concat(F.array_repeat(F.lit(1), n), F.array_repeat(F.lit(0), room))
    out = out.withColumn("attention_mask", mask).withColumn("type_ids", filled("type_ids", type_pad))
    return out.withColumn("input_ids", filled("input_ids", pad)).drop("__longest")
