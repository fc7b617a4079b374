"""Pk (Beeferman et al. 1999) and WindowDiff (Pevzner and Hearst 2002) of segmentations, and boundaries by position alone.

k is half the mean reference segment, rounded half to even, at least 2. Each utterance i is compared with i + k; dialogues
without such a pair score 0, dialogues of fewer than two utterances are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dialoom.functions.arrays import even_boundaries, stride_boundaries
from dialoom.functions.sampling import rank_key
from dialoom.operators.segment import with_boundaries


def pk_windowdiff(rows: DataFrame, by: tuple[str, ...] = ("dialogue_id",)) -> DataFrame:
    """rows(by..., utt_idx, seg_rank, n_utt, n_seg, hyp) -> by..., n_utt, n_seg, pk, wd."""
    rows = rows.where("n_utt >= 2").withColumn("k", F.greatest(F.lit(2), F.bround(F.col("n_utt") / F.col("n_seg") / 2).cast("int")))
    here = rows.select(*by, F.col("utt_idx").alias("i"), (F.col("utt_idx") + F.col("k")).alias("j"), F.col("seg_rank").alias("r"), F.col("hyp").alias("h"), "n_utt", "n_seg")
    there = rows.select(*by, F.col("utt_idx").alias("j"), F.col("seg_rank").alias("r2"), F.col("hyp").alias("h2"))
    pairs = here.join(there, [*by, "j"], "left")
    miss = F.when(F.col("r2").isNotNull(), ((F.col("r") == F.col("r2")) != (F.col("h") == F.col("h2"))).cast("double"))
    diff = F.when(F.col("r2").isNotNull(), ((F.col("r2") - F.col("r")) != (F.col("h2") - F.col("h"))).cast("double"))
    zero = F.lit(0.0)
    return pairs.groupBy(*by, "n_utt", "n_seg").agg(F.coalesce(F.avg(miss), zero).alias("pk"), F.coalesce(F.avg(diff), zero).alias("wd"))


def macro(per_doc: DataFrame) -> DataFrame:
    """n_docs and the means of pk and wd; null means if there is no document."""
    return per_doc.agg(F.count(F.lit(1)).alias("n_docs"), F.avg("pk").alias("pk"), F.avg("wd").alias("wd"))


def baseline(utterances: DataFrame, kind: str, stride: int = 0, seeds: int = 20) -> DataFrame:
    """dialogue_id, n_utt, n_seg, pk, wd of boundaries that know positions only. even: as many as the dialogue has, evenly spread;
    stride: every `stride` utterances; random: as many as the dialogue has, mean over `seeds` draws."""
    k = F.least(F.col("n_seg") - 1, F.col("n_utt") - 1)
    if kind == "random":
        many = utterances.withColumn("seed", F.explode(F.sequence(F.lit(0), F.lit(seeds - 1))))
        rows = many.withColumn("gap", F.col("utt_idx") < F.col("n_utt") - 1)
        rows = rows.withColumn("place", F.row_number().over(W.partitionBy("dialogue_id", "seed", "gap").orderBy(rank_key("baseline", "seed", "dialogue_id", "utt_idx"))))
        before = W.partitionBy("dialogue_id", "seed").orderBy("utt_idx").rowsBetween(W.unboundedPreceding, -1)
        label = (F.col("gap") & (F.col("place") <= k)).cast("int")
        rows = rows.withColumn("label", label).withColumn("hyp", F.coalesce(F.sum("label").over(before), F.lit(0)).cast("int"))
        each = pk_windowdiff(rows, ("dialogue_id", "seed"))
        return each.groupBy("dialogue_id", "n_utt", "n_seg").agg(F.avg("pk").alias("pk"), F.avg("wd").alias("wd"))
    at = even_boundaries(F.col("n_utt"), k) if kind == "even" else stride_boundaries(F.col("n_utt"), F.lit(stride))
    marks = utterances.where("utt_idx = 0").select("dialogue_id", F.explode(at).alias("gap_idx"))
    return pk_windowdiff(with_boundaries(utterances, marks))


def train_stride(masses: DataFrame) -> int:
    """Mean segment length, rounded half to even, at least 1. One number."""
    mean = masses.agg(F.avg("mass")).first()[0]
    return max(1, round(mean)) if mean is not None else 1
