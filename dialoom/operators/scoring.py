"""Gap scores. Scorers are pluggable: any frame of (dialogue_id, gap_idx, value) can stand in for the two lexical ones here, and
`with_pair_scorer` runs a model over gap windows in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dialoom.functions.arrays import count_cosine
from dialoom.functions.text import tokens
from dialoom.functions.vectors import sigmoid
from dialoom.operators.windows import gap_windows, ordered


def _tokenized(utterances: DataFrame) -> DataFrame:
    """dialogue_id, utt_idx, n_utt and words, sorted. Rows are put in order as texts, which take less memory than their words."""
    rows = utterances.select("dialogue_id", "utt_idx", "n_utt", "text").sortWithinPartitions("dialogue_id", "utt_idx")
    return rows.select("dialogue_id", "utt_idx", "n_utt", F.sort_array(tokens(F.col("text"))).alias("words"))


def _topic_cosine(width: int) -> Column:
    none = F.array().cast("array<string>")
    left = [F.coalesce(F.lag("words", i).over(ordered()), none) for i in range(width)]
    right = [F.coalesce(F.lead("words", i + 1).over(ordered()), none) for i in range(width)]
    return count_cosine(F.concat(*left), F.concat(*right))


def _coherence() -> Column:
    a, b = F.array_distinct("words"), F.array_distinct(F.lead("words").over(ordered()))
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def _at_gaps(utterances: DataFrame, **values: Column) -> DataFrame:
    rows = _tokenized(utterances).select("dialogue_id", F.col("utt_idx").alias("gap_idx"), "n_utt", *[v.alias(k) for k, v in values.items()])
    return rows.where("gap_idx < n_utt - 1").drop("n_utt")


def topic_cosine(utterances: DataFrame, width: int = 2) -> DataFrame:
    """dialogue_id, gap_idx, topic_cos: cosine of the term counts of the `width` utterances on either side. Counted gap by gap, so a
    task holds its texts and the words of one gap, never the terms of all."""
    return _at_gaps(utterances, topic_cos=_topic_cosine(width))


def coherence(utterances: DataFrame) -> DataFrame:
    """dialogue_id, gap_idx, coherence: shared part of the words of the utterances next to the gap."""
    return _at_gaps(utterances, coherence=_coherence())


def combined(coherences: DataFrame, topics: DataFrame, weight: float = 1.0) -> DataFrame:
    """dialogue_id, gap_idx, coherence, topic_cos, score = sigmoid(coherence + weight * topic_cos), to 9 digits."""
    out = coherences.join(topics, ["dialogue_id", "gap_idx"], "left").withColumn("topic_cos", F.coalesce("topic_cos", F.lit(0.0)))
    return out.withColumn("score", _score(weight))


def _score(weight: float) -> Column:
    return F.round(sigmoid(F.col("coherence") + weight * F.col("topic_cos")), 9)


def gap_scores(utterances: DataFrame, width: int = 2, weight: float = 1.0) -> DataFrame:
    """As `combined` of the two lexical scorers, in one pass without a join."""
    return _at_gaps(utterances, coherence=_coherence(), topic_cos=_topic_cosine(width)).withColumn("score", _score(weight))


def with_pair_scorer(utterances: DataFrame, scorer: Callable[[pd.Series, pd.Series], pd.Series], width: int = 2) -> DataFrame:
    """dialogue_id, gap_idx, coherence from a model: scorer(contexts, following), arrays of texts in batches."""
    model = F.pandas_udf(lambda a, b: scorer(a, b), "double")
    return gap_windows(utterances, width).select("dialogue_id", "gap_idx", model("context", "following").alias("coherence"))


def embedded(utterances: DataFrame, encoder: Callable[[pd.Series], pd.Series]) -> DataFrame:
    """dialogue_id, utt_idx, embedding: a model over texts, each distinct text once."""
    model = F.pandas_udf(lambda a: encoder(a), "array<float>")
    distinct = utterances.select("text").distinct().withColumn("embedding", model("text"))
    return utterances.select("dialogue_id", "utt_idx", "text").join(distinct, "text").drop("text")
