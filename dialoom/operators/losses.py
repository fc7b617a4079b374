"""Contrastive losses over embeddings as analytics: pairs are made inside a window or batch whose key stays in the join.

Input: rows(batch, dialogue_id, i, label, embedding), i the place in the dialogue.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dialoom.functions.vectors import cosine, hinge, norm, sigmoid
from dialoom.operators.segment import depth_scores, top_gaps


def mean_pool(rows: DataFrame, *by: str) -> DataFrame:
    """by, n and pooled: the mean of the embeddings, dimension by dimension."""
    dims = rows.select(*by, F.posexplode("embedding").alias("dim", "x"))
    means = dims.groupBy(*by, "dim").agg(F.avg(F.col("x").cast("double")).alias("mean"), F.count(F.lit(1)).alias("n"))
    pooled = F.transform(F.array_sort(F.collect_list(F.struct("dim", "mean"))), lambda x: x["mean"])
    return means.groupBy(*by).agg(F.max("n").alias("n"), pooled.alias("pooled"))


def pairwise_cosine(rows: DataFrame, window: str) -> DataFrame:
    """window, i, j, same (label) and cos for all i <> j of a window."""
    a = rows.select(window, "i", F.col("label").alias("la"), F.col("embedding").alias("ea"))
    b = rows.select(window, F.col("i").alias("j"), F.col("label").alias("lb"), F.col("embedding").alias("eb"))
    return a.join(b, window).where("i <> j").select(window, "i", "j", (F.col("la") == F.col("lb")).alias("same"), cosine(F.col("ea"), F.col("eb")).alias("cos"))


def margin_loss(pairs: DataFrame, window: str, margin: float = 1.0) -> DataFrame:
    """window, anchors, loss: for each anchor the mean hinge over its positive x negative pairs, then the mean over the anchors that
    have both. A window's pairs are bounded by its size."""
    pos = pairs.where("same").select(window, "i", F.col("cos").alias("p"))
    neg = pairs.where("not same").select(window, "i", F.col("cos").alias("n"))
    each = pos.join(neg, [window, "i"]).groupBy(window, "i").agg(F.avg(hinge(F.col("p"), F.col("n"), margin)).alias("loss"))
    return each.groupBy(window).agg(F.count(F.lit(1)).alias("anchors"), F.avg("loss").alias("loss"))


def supcon_loss(pairs: DataFrame, window: str, tau: float = 0.1) -> DataFrame:
    """window, anchors, loss: supervised contrastive loss over the anchors that have a positive and a negative. The sum of
    exponentials is taken from its largest term."""
    x = F.col("cos") / tau
    most = pairs.withColumn("x", x).withColumn("m", F.max(x).over(W.partitionBy(window, "i")))
    each = most.groupBy(window, "i").agg(
        (F.max("m") + F.log(F.sum(F.exp(F.col("x") - F.col("m"))))).alias("lse"),
        F.avg(F.when(F.col("same"), F.col("x"))).alias("pos"),
        F.sum(F.when(F.col("same"), 1).otherwise(0)).alias("n_pos"),
        F.sum(F.when(F.col("same"), 0).otherwise(1)).alias("n_neg"),
    )
    each = each.where("n_pos > 0 and n_neg > 0").withColumn("loss", F.col("lse") - F.col("pos"))
    return each.groupBy(window).agg(F.count(F.lit(1)).alias("anchors"), F.avg("loss").alias("loss"))


def _mean_of(frame) -> Column:
    """The mean vector of the window's rows (a few at most)."""
    many = F.collect_list("embedding").over(frame)
    zero = F.transform(F.col("embedding"), lambda x: F.lit(0.0))
    total = F.aggregate(many, zero, lambda s, v: F.zip_with(s, v, lambda a, b: a + b.cast("double")))
    return F.transform(total, lambda x: x / F.greatest(F.size(many), F.lit(1)))


def pseudo_starts(rows: DataFrame, train_split: int = 5) -> DataFrame:
    """dialogue_id, start: the `train_split` deepest valleys between the two rows before and the two from a place on; 0 counts too."""
    by = W.partitionBy("dialogue_id").orderBy("i")
    near = rows.select("dialogue_id", "i", _mean_of(by.rowsBetween(-1, 0)).alias("before"), _mean_of(by.rowsBetween(1, 2)).alias("after"), F.lead("i").over(by).alias("next"))
    scores = near.where("next is not null").select("dialogue_id", F.col("i").alias("gap_idx"), F.round(sigmoid(cosine(F.col("before"), F.col("after"))), 9).alias("score"))
    found = top_gaps(depth_scores(scores).withColumn("k", F.lit(train_split))).select("dialogue_id", (F.col("gap_idx") + 1).alias("start"))
    return found.unionByName(rows.select("dialogue_id", F.lit(0).alias("start")).distinct())


def topic_margin(rows: DataFrame, starts: DataFrame, window: int = 5, margin: float = 1.0) -> DataFrame:
    """batch, anchors, loss. starts(dialogue_id, start) cut dialogues into segments [left, right). Positives of an anchor: its segment
    within `window`, without itself. Negatives: all of the batch but the dialogue's range from min(left, i - window) to max(right,
    i + window + 1), clamped to the dialogue."""
    by = W.partitionBy("dialogue_id").orderBy("i")
    marks = starts.select("dialogue_id", F.col("start").alias("i")).distinct().withColumn("mark", F.col("i"))
    own = rows.join(marks, ["dialogue_id", "i"], "left")
    own = own.withColumn("left", F.coalesce(F.last("mark", ignorenulls=True).over(by.rowsBetween(W.unboundedPreceding, 0)), F.lit(0)))
    size = F.count(F.lit(1)).over(W.partitionBy("dialogue_id"))
    own = own.withColumn("right", F.coalesce(F.first("mark", ignorenulls=True).over(by.rowsBetween(1, W.unboundedFollowing)), size))
    a = own.select("batch", "dialogue_id", "i", "left", "right", F.col("embedding").alias("ea"))
    b = rows.select("batch", F.col("dialogue_id").alias("d2"), F.col("i").alias("j"), F.col("embedding").alias("eb"))
    same, i, j = F.col("dialogue_id") == F.col("d2"), F.col("i"), F.col("j")
    pos = same & (j >= F.greatest(F.col("left"), i - window)) & (j < F.least(F.col("right"), i + window + 1)) & (j != i)
    far = ~same | (j < F.least(F.col("left"), i - window)) | (j >= F.greatest(F.col("right"), i + window + 1))
    pairs = a.join(b, "batch").withColumn("same", F.when(pos, True).when(far, False)).where("same is not null")
    pairs = pairs.select("batch", F.struct("dialogue_id", "i").alias("i"), "same", cosine(F.col("ea"), F.col("eb")).alias("cos"))
    return margin_loss(pairs, "batch", margin)


def training_loss(samples: DataFrame, topic: DataFrame, weight: float = 1.0, margin: float = 1.0) -> DataFrame:
    """batch, n_samples, pair_loss, topic_loss and loss, their sum. samples(batch, pos_coherence, pos_cos, neg_coherence, neg_cos):
    the hinge over coherence + weight * cos of the true and the false continuation. topic(batch, loss); 0 where a batch has none."""
    score = lambda side: F.col(f"{side}_coherence") + weight * F.col(f"{side}_cos")
    pairs = samples.groupBy("batch").agg(F.count(F.lit(1)).alias("n_samples"), F.avg(hinge(score("pos"), score("neg"), margin)).alias("pair_loss"))
    out = pairs.join(topic.select("batch", F.col("loss").alias("topic_loss")), "batch", "left").withColumn("topic_loss", F.coalesce("topic_loss", F.lit(0.0)))
    return out.withColumn("loss", F.col("pair_loss") + F.col("topic_loss"))


def norms(rows: DataFrame) -> DataFrame:
    return rows.select("*", norm(F.col("embedding")).alias("norm"))
