"""Array functions for fixed-length encodings and position-only boundaries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def head(a: Column, n: Column) -> Column:
    return F.slice(a, F.lit(1), F.greatest(n, F.lit(0)))


def tail(a: Column, n: Column) -> Column:
    """The last n elements, n at most the size."""
    return F.slice(a, F.greatest(F.size(a) - n + 1, F.lit(1)), F.greatest(n, F.lit(0)))


def padded(a: Column, length: int, pad: int) -> Column:
    """Cut or filled up at the end to `length`."""
    return F.slice(F.concat(a, F.array_repeat(F.lit(pad), length)), 1, length)


def mask(ids: Column) -> Column:
    return F.transform(ids, lambda x: (x > 0).cast("int"))


def pair_budget(context: Column, following: Column, max_len: int) -> tuple[Column, Column]:
    """How many context ids (from the end) and following ids (from the begin) a pair keeps beside three special ids, [CLS] and
    [SEP] at the end counted: each side has at least half if it needs it. The context's own separators are among its ids."""
    room = F.lit(max_len - 2)
    keep = F.least(F.size(context), F.greatest(room - F.size(following), F.lit((max_len - 2) // 2)))
    return keep, F.least(F.size(following), room - keep)


def even_boundaries(n: Column, k: Column) -> Column:
    """Gap indices of k boundaries spread evenly over n utterances: half-even rounding, distinct, inside the gaps."""
    at = F.transform(F.when(k > 0, F.sequence(F.lit(1), F.greatest(k, F.lit(1)))).otherwise(F.array().cast("array<int>")), lambda j: (F.bround(j * n / (k + 1)) - 1).cast("int"))
    return F.filter(F.array_distinct(at), lambda x: (x >= 0) & (x < n - 1))


def stride_boundaries(n: Column, stride: Column) -> Column:
    """Gap indices stride - 1, 2 stride - 1, ... below n - 1."""
    gaps = n - 1
    return F.when(stride <= gaps, F.sequence(stride - 1, F.greatest(gaps - 1, stride - 1), stride)).otherwise(F.array().cast("array<int>"))


def count_cosine(a: Column, b: Column, eps: float = 1e-8) -> Column:
    """Cosine of how often each string stands in a and in b. Equal strings are brought together by a sort and counted in one walk,
    so long arrays cost their sort and no more; sorted parts are merged."""
    names, zero, one = ("na", "nb", "ab", "aa", "bb"), F.lit(0).cast("long"), F.lit(1).cast("long")

    def marked(side: Column, own: Column) -> Column:
        return F.transform(side, lambda x: F.struct(x.alias("x"), own.alias("own")))

    def state(x: Column, *values: Column) -> Column:
        return F.struct(x.alias("x"), *[v.alias(n) for v, n in zip(values, names, strict=True)])

    def step(s: Column, e: Column) -> Column:
        x, own, (na, nb, ab, aa, bb) = e["x"], e["own"], (s[n] for n in names)
        new = state(x, own, one - own, ab, aa + own, bb + one - own)
        in_a, in_b = state(x, na + one, nb, ab + nb, aa + na + na + one, bb), state(x, na, nb + one, ab + na, aa, bb + nb + nb + one)
        return F.when(~s["x"].eqNullSafe(x), new).when(own == one, in_a).otherwise(in_b)

    def size(sum_of_squares: Column) -> Column:
        return F.greatest(F.sqrt(sum_of_squares.cast("double")), F.lit(eps))

    return F.aggregate(F.sort_array(F.concat(marked(a, one), marked(b, zero))), state(F.lit(None).cast("string"), *[zero] * 5), step, lambda s: s["ab"] / (size(s["aa"]) * size(s["bb"])))
