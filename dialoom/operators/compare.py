"""Paired comparison of two runs over the same documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dialoom.functions.sampling import draw


def paired(base: DataFrame, candidate: DataFrame) -> DataFrame:
    """dialogue_id, metric, base, cand and diff = cand - base for the documents of both; each is (dialogue_id, pk, wd)."""
    both = base.select("dialogue_id", F.col("pk").alias("pk_b"), F.col("wd").alias("wd_b")).join(candidate.select("dialogue_id", F.col("pk").alias("pk_c"), F.col("wd").alias("wd_c")), "dialogue_id")
    metric = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"{m}_b").alias("base"), F.col(f"{m}_c").alias("cand")) for m in ("pk", "wd")]))
    out = both.select("dialogue_id", metric.alias("x")).select("dialogue_id", "x.*")
    return out.withColumn("diff", F.round(F.col("cand") - F.col("base"), 9))


def coverage(base: DataFrame, candidate: DataFrame) -> DataFrame:
    """n_base, n_candidate and n_shared documents."""
    both = base.select("dialogue_id", F.lit(1).alias("b")).join(candidate.select("dialogue_id", F.lit(1).alias("c")), "dialogue_id", "full")
    return both.agg(F.count("b").alias("n_base"), F.count("c").alias("n_candidate"), F.count(F.col("b") + F.col("c")).alias("n_shared"))


def win_tie_loss(diffs: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """A row for each metric: means and how many documents got better (lower), stayed and got worse."""
    d = F.col("diff")
    count = lambda cond: F.sum(F.when(cond, 1).otherwise(0))
    return diffs.groupBy("metric").agg(F.avg("base").alias("base"), F.avg("cand").alias("cand"), count(d < -tolerance).alias("wins"), count(F.abs(d) <= tolerance).alias("ties"), count(d > tolerance).alias("losses"))


def by_improvement(diffs: DataFrame, metric: str = "pk") -> DataFrame:
    """The documents from the most improved (lowest diff) to the least."""
    return diffs.where(F.col("metric") == metric).orderBy("diff", "dialogue_id")


#: Documents whose differences are broadcast; two numbers each.
MAX_PLACES = 500_000


def bootstrap(diffs: DataFrame, n_boot: int = 10_000, seed: str = "0") -> DataFrame:
    """metric, low, high (the middle 95 % of resampled means) and p_not_better (share of means >= 0). Each resample draws n of n
    documents with replacement. n_boot x n draws are made and summed in place: differences are broadcast up to MAX_PLACES after a
    count, so that only a sum for each resample leaves a task; beyond that, draws are counted and dealt by place."""
    place = F.row_number().over(W.partitionBy("metric").orderBy("dialogue_id")) - 1
    ranked = diffs.select("metric", "diff", place.alias("place"))
    sizes = ranked.groupBy("metric").agg(F.count(F.lit(1)).alias("n"))
    parts = int(diffs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slots = ranked.select("metric", F.col("place").alias("slot")).join(F.broadcast(sizes), "metric").repartition(parts, "metric", "slot")
    boots = slots.withColumn("boot", F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1))))
    drawn = boots.select("metric", "boot", "n", (draw(seed, "boot", "slot") % F.col("n")).cast("int").alias("place"))
    if ranked.limit(MAX_PLACES + 1).count() <= MAX_PLACES:
        times = drawn.join(F.broadcast(ranked), ["metric", "place"]).withColumn("times", F.lit(1))
    else:
        times = drawn.groupBy("metric", "boot", "place", "n").agg(F.count(F.lit(1)).alias("times")).join(ranked, ["metric", "place"])
    means = times.groupBy("metric", "boot").agg(F.round(F.sum(F.col("diff") * F.col("times")) / F.first("n"), 9).alias("mean"))
    ends = F.percentile("mean", F.array(F.lit(0.025), F.lit(0.975)))
    return means.groupBy("metric").agg(ends[0].alias("low"), ends[1].alias("high"), F.avg((F.col("mean") >= 0).cast("double")).alias("p_not_better"))


def wilcoxon(diffs: DataFrame) -> DataFrame:
    """metric, n (differences other than 0), w (the smaller rank sum), z (normal approximation with tie correction) and the
    two-sided p by the error function's approximation of Abramowitz and Stegun 7.1.26 (1.5e-7). All zero: p = 1."""
    rows = diffs.withColumn("a", F.abs("diff"))
    some = rows.where("a > 0")
    ties = some.groupBy("metric", "a").agg(F.count(F.lit(1)).alias("t"), F.sum(F.when(F.col("diff") > 0, 1).otherwise(0)).alias("up"))
    before = F.coalesce(F.sum("t").over(W.partitionBy("metric").orderBy("a").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ties = ties.withColumn("rank", before + (F.col("t") + 1) / 2)
    sums = ties.groupBy("metric").agg(F.sum("t").alias("n"), F.sum(F.col("rank") * F.col("up")).alias("plus"), F.sum(F.col("rank") * (F.col("t") - F.col("up"))).alias("minus"), F.sum(F.col("t") * F.col("t") * F.col("t") - F.col("t")).alias("tied"))
    n = F.col("n").cast("double")
    var = n * (n + 1) * (2 * n + 1) / 24 - F.col("tied") / 48
    z = (F.least("plus", "minus") - n * (n + 1) / 4) / F.sqrt(var)
    out = sums.select("metric", "n", F.least("plus", "minus").alias("w"), F.when(var > 0, z).otherwise(0.0).alias("z"))
    x = F.abs("z") / F.sqrt(F.lit(2.0))
    t = 1 / (1 + 0.3275911 * x)
    tail = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * F.exp(-x * x)
    out = out.withColumn("p", F.least(tail, F.lit(1.0)))
    names = rows.select("metric").distinct()
    return names.join(out, "metric", "left").select("metric", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("w", F.lit(0.0)).alias("w"), F.coalesce("z", F.lit(0.0)).alias("z"), F.coalesce("p", F.lit(1.0)).alias("p"))
