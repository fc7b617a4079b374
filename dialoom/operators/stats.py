"""Quality of dialogue corpora: diversity, lengths, leaks between splits, openers, closing cues and the gate over them.

Input: utterances(split, dialogue_id, utt_idx, seg_rank, n_utt, n_seg, text). A segment is known by a hash of its texts in order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dialoom.functions.text import has_closing_cue, normalized, opener_word


def segment_keys(utterances: DataFrame) -> DataFrame:
    """split, dialogue_id, seg_rank, mass, opener, seg_key. A segment's texts are hashed first, so what is gathered is small."""
    rows = F.array_sort(F.collect_list(F.struct("utt_idx", F.md5("text").alias("h"))))
    out = utterances.groupBy("split", "dialogue_id", "seg_rank").agg(F.count(F.lit(1)).alias("mass"), F.min_by("text", "utt_idx").alias("first"), rows.alias("rows"))
    key = F.md5(F.array_join(F.transform("rows", lambda x: x["h"]), ","))
    return out.select("split", "dialogue_id", "seg_rank", "mass", opener_word(F.col("first")).alias("opener"), key.alias("seg_key"))


def diversity(utterances: DataFrame) -> DataFrame:
    """A row for each split: sessions, segments, distinct ones, uses of a segment, repeats inside sessions, distinct utterances."""
    keys = segment_keys(utterances)
    uses = keys.groupBy("split", "seg_key").agg(F.count(F.lit(1)).alias("uses")).groupBy("split")
    uses = uses.agg(F.sum("uses").alias("segments"), F.count(F.lit(1)).alias("distinct_segments"), F.avg("uses").alias("mean_uses"), F.max("uses").alias("max_uses"))
    repeats = keys.groupBy("split", "dialogue_id", "seg_key").agg((F.count(F.lit(1)) - 1).alias("again"))
    repeats = repeats.groupBy("split").agg(F.countDistinct("dialogue_id").alias("sessions"), F.sum("again").alias("in_session_repeats"))
    texts = utterances.select("split", F.md5(normalized(F.col("text"))).alias("t")).distinct().groupBy("split").agg(F.count(F.lit(1)).alias("distinct_utterances"))
    return uses.join(repeats, "split").join(texts, "split")


def length_stats(utterances: DataFrame) -> DataFrame:
    """Mean, population deviation, least and most utterances of a segment, by split."""
    sizes = utterances.groupBy("split", "dialogue_id", "seg_rank").agg(F.count(F.lit(1)).alias("mass"))
    return sizes.groupBy("split").agg(F.avg("mass").alias("seg_len_mean"), F.stddev_pop("mass").alias("seg_len_std"), F.min("mass").alias("seg_len_min"), F.max("mass").alias("seg_len_max"))


def histograms(utterances: DataFrame) -> DataFrame:
    """split, kind (segment_length, boundaries), value, n."""
    sizes = utterances.groupBy("split", "dialogue_id", "seg_rank").agg(F.count(F.lit(1)).alias("value")).select("split", F.lit("segment_length").alias("kind"), "value")
    bounds = utterances.where("utt_idx = 0").select("split", F.lit("boundaries").alias("kind"), (F.col("n_seg") - 1).cast("long").alias("value"))
    return sizes.unionByName(bounds).groupBy("split", "kind", "value").agg(F.count(F.lit(1)).alias("n"))


def openers(utterances: DataFrame) -> DataFrame:
    """split, opener, n over segments, and their share of the split."""
    first = segment_keys(utterances).groupBy("split", "opener").agg(F.count(F.lit(1)).alias("n"))
    total = first.groupBy("split").agg(F.sum("n").alias("total"))
    return first.join(total, "split").select("split", "opener", "n", (F.col("n") / F.col("total")).alias("share"))


def opener_divergence(utterances: DataFrame, train: str = "train") -> DataFrame:
    """split, opener_js: Jensen-Shannon divergence (base 2) of each split's openers from the training split's."""
    own = openers(utterances).select("split", "opener", "share")
    base = own.where(F.col("split") == train).select("opener", F.col("share").alias("b"))
    others = own.where(F.col("split") != train)
    names = others.select("split").distinct()
    grid = base.crossJoin(F.broadcast(names))  # the list of splits is a handful
    both = others.withColumnRenamed("share", "a").join(grid, ["split", "opener"], "full")
    both = both.select("split", F.coalesce("a", F.lit(0.0)).alias("a"), F.coalesce("b", F.lit(0.0)).alias("b"))
    mid = (F.col("a") + F.col("b")) / 2
    part = F.when(F.col("a") > 0, 0.5 * F.col("a") * F.log2(F.col("a") / mid)).otherwise(0.0) + F.when(F.col("b") > 0, 0.5 * F.col("b") * F.log2(F.col("b") / mid)).otherwise(0.0)
    return both.groupBy("split").agg(F.sum(part).alias("opener_js"))


def closing_cue_rates(utterances: DataFrame, pattern: str | None = None) -> DataFrame:
    """split, final_rate, other_rate: share of last and other utterances of segments with a closing cue; 0 where there are none."""
    hit = (has_closing_cue(F.col("text"), pattern) if pattern else has_closing_cue(F.col("text"))).cast("double")
    last = utterances.groupBy("split", "dialogue_id", "seg_rank").agg(F.max_by(hit, "utt_idx").alias("f"), F.sum(hit).alias("all"), F.count(F.lit(1)).alias("n"))
    out = last.groupBy("split").agg(F.sum("f").alias("f"), F.count(F.lit(1)).alias("segs"), F.sum("all").alias("hits"), F.sum("n").alias("n"))
    other = F.col("n") - F.col("segs")
    return out.select("split", (F.col("f") / F.greatest(F.col("segs"), F.lit(1))).alias("final_rate"), ((F.col("hits") - F.col("f")) / F.greatest(other, F.lit(1))).alias("other_rate"))


def split_overlap(utterances: DataFrame) -> DataFrame:
    """split_a < split_b and how many distinct segments and utterances they share; pairs that share nothing are absent. For each
    key its splits are few, so pairs are made inside the key."""
    segs = segment_keys(utterances).select(F.lit("segments").alias("kind"), F.col("seg_key").alias("key"), "split")
    utts = utterances.select(F.lit("utterances").alias("kind"), F.md5(normalized(F.col("text"))).alias("key"), "split")
    by = segs.unionByName(utts).distinct().groupBy("kind", "key").agg(F.array_sort(F.collect_set("split")).alias("s")).where(F.size("s") > 1)
    pairs = by.select("kind", F.col("s"), F.explode("s").alias("split_a")).select("kind", "split_a", F.explode("s").alias("split_b")).where("split_a < split_b")
    return pairs.groupBy("split_a", "split_b").agg(F.sum((F.col("kind") == "segments").cast("long")).alias("shared_segments"), F.sum((F.col("kind") == "utterances").cast("long")).alias("shared_utterances"))


def gate(
    diversity: DataFrame,
    lengths: DataFrame,
    cues: DataFrame,
    overlap: DataFrame,
    divergence: DataFrame,
    baselines: DataFrame,
    train: str = "train",
    min_train_segments: int = 500,
    min_eval_segments: int = 40,
    max_uses: int = 5,
    min_position_pk: float = 0.2,
    max_opener_js: float = 0.3,
    max_closing_gap: float = 0.3,
) -> DataFrame:
    """rule, split, level (OK, WARN or FAIL) and value over the reports above; baselines(split, kind, pk). A few rows."""
    is_train = F.col("split") == train

    def rule(frame: DataFrame, name: str, level: str, value, ok) -> DataFrame:
        return frame.select(F.lit(name).alias("rule"), "split", F.when(ok, "OK").otherwise(level).alias("level"), value.cast("double").alias("value"))

    gap = F.col("final_rate") - F.col("other_rate")
    evals = diversity.where(~is_train).select("split")
    shared = overlap.where(F.col("split_a") == train).select(F.col("split_b").alias("split"), "shared_segments").unionByName(overlap.where(F.col("split_b") == train).select(F.col("split_a").alias("split"), "shared_segments"))
    shared = evals.join(shared, "split", "left").withColumn("shared_segments", F.coalesce("shared_segments", F.lit(0)))
    pairs = evals.select(F.col("split").alias("split_a")).crossJoin(F.broadcast(evals.select(F.col("split").alias("split_b")))).where("split_a < split_b")  # names of splits only
    pairs = pairs.join(overlap, ["split_a", "split_b"], "left").select(F.concat_ws("+", "split_a", "split_b").alias("split"), F.coalesce("shared_segments", F.lit(0)).alias("n"))
    parts = [
        rule(lengths.where(is_train), "segment_length_varies", "FAIL", F.col("seg_len_std"), F.col("seg_len_std") > 0),
        rule(diversity.where(is_train), "distinct_train_segments", "WARN", F.col("distinct_segments"), F.col("distinct_segments") >= min_train_segments),
        rule(diversity.where(is_train), "train_reuse", "WARN", F.col("max_uses"), F.col("max_uses") <= max_uses),
        rule(cues.where(is_train), "closing_cue_gap", "WARN", gap, gap <= max_closing_gap),
        rule(diversity.where(is_train), "in_session_repeats", "WARN", F.col("in_session_repeats"), F.col("in_session_repeats") == 0),
        rule(baselines.where(F.col("kind") == "even"), "even_baseline_pk", "FAIL", F.col("pk"), F.col("pk") >= min_position_pk),
        rule(baselines.where(F.col("kind") == "stride"), "stride_baseline_pk", "FAIL", F.col("pk"), F.col("pk") >= min_position_pk),
        rule(diversity.where(~is_train), "distinct_eval_segments", "WARN", F.col("distinct_segments"), F.col("distinct_segments") >= min_eval_segments),
        rule(shared, "shared_with_train", "FAIL", F.col("shared_segments"), F.col("shared_segments") == 0),
        rule(divergence, "opener_js", "WARN", F.col("opener_js"), F.col("opener_js") <= max_opener_js),
        rule(pairs, "shared_between_evals", "FAIL", F.col("n"), F.col("n") == 0),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
