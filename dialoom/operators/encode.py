"""Fixed-length encodings of pairs. The tokenizer is pluggable; the default hashes white-space tokens into a fixed range, and
subword vocabularies of the tokenizers library and word segmenters run in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dialoom.functions.arrays import head, mask, padded, pair_budget, tail
from dialoom.functions.sampling import draw

CLS, SEP, FIRST, VOCABULARY = 101, 102, 1000, 30000


def hashed_ids(text: Column) -> Column:
    """An id from FIRST on for each white-space token."""
    words = F.array_remove(F.split(F.lower(text), r"[\x20\x09-\x0D]+"), "")
    return F.transform(words, lambda w: (draw("vocabulary", w) % VOCABULARY + FIRST).cast("int"))


def context_ids(texts: Column, ids=hashed_ids) -> Column:
    """The ids of all texts, each closed by SEP."""
    return F.flatten(F.transform(texts, lambda t: F.concat(ids(t), F.array(F.lit(SEP)))))


@lru_cache(maxsize=4)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def subword_context_ids(texts: Column, path: str, sep: int = SEP, max_len: int | None = None) -> Column:
    """context_ids() by the vocabulary file at `path`, which every executor must have: the ids of all texts (null as empty), each
    cut to `max_len` if that is given, and closed by `sep`."""

    def ids(many: pd.Series) -> pd.Series:
        flat = [t or "" for texts in many for t in ([] if texts is None else texts)]
        found = iter(_tokenizer(path).encode_batch(flat, add_special_tokens=False))
        return pd.Series([None if texts is None else [i for _ in texts for i in (*next(found).ids[:max_len], sep)] for texts in many])

    return F.pandas_udf(ids, "array<int>")(texts)


def segmented(text: Column, segmenter: Callable[[str], str], remembered: int = 100_000) -> Column:
    """Texts with their words marked by segmenter(text), null as null; a worker remembers the last `remembered` texts."""

    def words(many: pd.Series) -> pd.Series:
        return many.map(lru_cache(maxsize=remembered)(segmenter), na_action="ignore")

    return F.pandas_udf(words, "string")(text)


def truncated_pair(rows: DataFrame, context: str, following: str, max_len: int) -> DataFrame:
    """Adds input_ids and type_ids. context, following: arrays of ids. The context loses its begin, what follows its end."""
    keep, keep_next = pair_budget(F.col(context), F.col(following), max_len)
    rows = rows.withColumn("keep_context", keep).withColumn("keep_next", keep_next)
    ids = F.concat(F.array(F.lit(CLS)), tail(F.col(context), F.col("keep_context")), head(F.col(following), F.col("keep_next")), F.array(F.lit(SEP)))
    types = F.concat(F.array_repeat(F.lit(0), F.col("keep_context") + 1), F.array_repeat(F.lit(1), F.col("keep_next") + 1))
    return rows.withColumn("input_ids", ids).withColumn("type_ids", types)


def fixed_length(rows: DataFrame, length: int) -> DataFrame:
    """input_ids filled with 0, type_ids with 1, and attention_mask."""
    rows = rows.withColumn("input_ids", padded(F.col("input_ids"), length, 0)).withColumn("type_ids", padded(F.col("type_ids"), length, 1))
    return rows.withColumn("attention_mask", mask(F.col("input_ids")))


def trimmed(rows: DataFrame, batch: str) -> DataFrame:
    """Each batch's arrays cut to its longest row."""
    longest = rows.groupBy(batch).agg(F.max(F.aggregate("attention_mask", F.lit(0), lambda s, x: s + x)).alias("longest"))
    out = rows.join(longest, batch)
    for name in ("input_ids", "type_ids", "attention_mask"):
        out = out.withColumn(name, head(F.col(name), F.col("longest")))
    return out
