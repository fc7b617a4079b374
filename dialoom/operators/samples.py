"""Contrastive samples: for each anchor utterance the true continuation, one from another segment and a hard one.

The negative is drawn by its rank in the pool of utterances outside the anchor's segment, which are two ranges of positions; so
no pool is ever built or joined, and one equi-join fetches each continuation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dialoom.functions.sampling import below
from dialoom.functions.text import respace_punctuation
from dialoom.operators.windows import context, continuation, ordered, segments


def anchors(utterances: DataFrame, seed: str = "3407") -> DataFrame:
    """dialogue_id, anchor_idx, neg_idx, hard_idx. An anchor whose next utterance opens another segment has none, nor has the last.
    neg: uniform outside the anchor's segment. hard: the opener of the next segment, or else uniform in the segment before. In a
    dialogue of one segment both are uniform outside [i - 1, i + 2], or the anchor itself if nothing is there."""
    own = utterances.withColumn("same", F.lead("seg_rank").over(ordered()) == F.col("seg_rank")).where("same")
    spans = segments(utterances).select("dialogue_id", "seg_rank", "start", "stop")
    prior = spans.select("dialogue_id", (F.col("seg_rank") + 1).alias("seg_rank"), F.col("start").alias("p_start"), F.col("stop").alias("p_stop"))
    rows = own.join(spans, ["dialogue_id", "seg_rank"]).join(prior, ["dialogue_id", "seg_rank"], "left")
    i, n = F.col("utt_idx"), F.col("n_utt")
    r = below(n - (F.col("stop") - F.col("start")), seed, F.lit("neg"), "dialogue_id", "utt_idx")
    outside = F.when(r < F.col("start"), r).otherwise(r + F.col("stop") - F.col("start"))
    left, right = F.greatest(i - 1, F.lit(0)), F.greatest(n - (i + 3), F.lit(0))
    q = below(left + right, seed, F.lit("far"), "dialogue_id", "utt_idx")
    far = F.coalesce(F.when(q < left, q).otherwise(q - left + i + 3), i)
    back = F.col("p_start") + below(F.col("p_stop") - F.col("p_start"), seed, F.lit("hard"), "dialogue_id", "utt_idx")
    hard = F.when(F.col("stop") < n, F.col("stop")).otherwise(back)
    single = F.col("n_seg") == 1
    return rows.select("dialogue_id", i.alias("anchor_idx"), F.when(single, far).otherwise(outside).cast("int").alias("neg_idx"), F.when(single, far).otherwise(hard).cast("int").alias("hard_idx"))


def mine(utterances: DataFrame, history: int = 2, seed: str = "3407") -> DataFrame:
    """dialogue_id, anchor_idx, neg_idx, hard_idx and arrays of texts: context, pos, neg, hard, each of `history` utterances at most."""
    clean = utterances.withColumn("text", respace_punctuation(F.col("text")))
    runs = clean.select("dialogue_id", "utt_idx", continuation(F.col("text"), history).alias("run"))
    left = clean.select("dialogue_id", F.col("utt_idx").alias("anchor_idx"), context(F.col("text"), history).alias("context"))
    out = anchors(utterances, seed).join(left, ["dialogue_id", "anchor_idx"])
    for name, at in (("pos", F.col("anchor_idx") + 1), ("neg", F.col("neg_idx")), ("hard", F.col("hard_idx"))):
        own = runs.select("dialogue_id", F.col("utt_idx").alias("at"), F.col("run").alias(name))
        out = out.withColumn("at", at).join(own, ["dialogue_id", "at"]).drop("at")
    return out.select("dialogue_id", "anchor_idx", "neg_idx", "hard_idx", "context", "pos", "neg", "hard")


def pairs(samples: DataFrame) -> DataFrame:
    """Each sample as its two training pairs: dialogue_id, anchor_idx, pair, context, pos, other."""
    two = F.array(F.struct(F.lit("neg").alias("pair"), F.col("neg").alias("other")), F.struct(F.lit("hard").alias("pair"), F.col("hard").alias("other")))
    return samples.select("dialogue_id", "anchor_idx", "context", "pos", F.explode(two).alias("x")).select("dialogue_id", "anchor_idx", "x.pair", "context", "pos", "x.other")
