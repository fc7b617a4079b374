"""Mixing sources to target weights (DataFrame functions only): weighted fair queueing over shuffled documents.

Each source is a queue of its documents in a hash order, `epochs` times over. A document copy starts at the source's words before
it and finishes at start + size; divided by the source's target these are its virtual times. Serving copies by virtual finish
time serves all sources in proportion, and the total budget is used up at virtual time 1, since the targets add up to it: a
copy that finishes later is cut there, so each source gives its target to the word (rounded down).

Targets share the budget by weight, up to `epochs` times the source's size; the excess is shared again by weight. With sources
sorted by cap / weight, the level is the largest of (budget - caps before) / (weights from here on): the fixed point of resharing.

Each source's queue has its own order, and virtual times of different sources only decide who is served first: at virtual time 1
each has had its target, so `taken` is what a source's queue gives up to there, and the final sort by virtual finish is the order of
service (tests run the queue itself against this).

Scale: a source with a third of all documents is cut into buckets by the leading hex digits of its hash order, so running sums
are taken inside (source, bucket) and the buckets' own sums before it are added; only (id, source, size, order) is shuffled. Equal
rows are one entry with a count until the end, so one row repeated a million times is no hot bucket.

Defined cases: null text has size 0 and takes 0; null source is the last source; equal doc_ids are ordered by size; equal rows
follow each other; an empty table gives no rows; a source without words has target 0.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dialoom.llm.common import WORD, scratch, sized_join, stored

#: Documents that a bucket of the running sum holds on average, at most.
BUCKET_ROWS = 20_000


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(f"{WORD}+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), budget: float = 1.5, epochs: int = 2) -> DataFrame:
    """sizes(source, size), one row for each document -> source, source_size, docs, target. One row for each source: the windows
    over all of them hold aggregates, not documents."""
    total = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    one = W.partitionBy(F.lit(0))
    ranked = total.withColumn("__r", F.row_number().over(one.orderBy(F.asc_nulls_last("source"))))
    ranked = ranked.withColumn("__weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("__r") - 1) % len(weights) + 1).cast("double"))
    ranked = ranked.withColumn("__cap", F.col("source_size") * F.lit(float(epochs))).withColumn("__budget", F.sum("source_size").over(one) * F.lit(budget))
    order = one.orderBy(F.col("__cap") / F.col("__weight"), "__r")
    before = F.coalesce(F.sum("__cap").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    after = F.sum("__weight").over(order.rowsBetween(0, W.unboundedFollowing))
    ranked = ranked.withColumn("__level", (F.col("__budget") - before) / after)
    level = F.max("__level").over(one)
    return ranked.select("source", "source_size", "docs", F.least("__cap", F.col("__weight") * level).alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), budget: float = 1.5, epochs: int = 2, seed: str = "mix") -> DataFrame:
    """For each row of docs(doc_id, text, source): doc_id, size, source_size, target, taken, virtual_finish (of its first copy;
    null where the target is 0) and __key (a hash of the row), in the order in which first copies are served."""
    folder = scratch(docs.sparkSession, "mixing")
    key = F.xxhash64(docs["doc_id"], docs["text"], docs["source"])
    sizes = docs.select("doc_id", F.col("source").cast("string").alias("source"), size_of(F.col("text")).alias("size"), key.alias("__key"))
    sizes = stored(sizes, folder, "sizes")
    goal = stored(targets(sizes, weights, budget, epochs), folder, "targets")
    most = goal.agg(F.max("docs")).first()[0] or 0
    digits = min(8, max(1, math.ceil(math.log(max(1, most / BUCKET_ROWS), 16))))
    order = F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    host = F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))
    equal = sizes.withColumn("__source", host).groupBy("__source", "doc_id", "size", "__key").agg(F.count("*").alias("__times"))
    own = equal.withColumn("__o", order).withColumn("__b", F.substring("__o", 1, digits))
    sums = own.groupBy("__source", "__b").agg(F.sum(F.col("size") * F.col("__times")).alias("__s"))
    ahead = F.coalesce(F.sum("__s").over(W.partitionBy("__source").orderBy("__b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sums = stored(sums.select("__source", "__b", ahead.alias("__ahead")), folder, "buckets")
    inside = F.sum(F.col("size") * F.col("__times")).over(W.partitionBy("__source", "__b").orderBy("__o", "doc_id", "size", "__key").rowsBetween(W.unboundedPreceding, -1))
    run = sized_join(own.withColumn("__in", F.coalesce(inside, F.lit(0))), sums, ["__source", "__b"], "inner")
    run = sized_join(run, goal.select(host.alias("__source"), "source_size", "target"), ["__source"], "inner")
    run = run.withColumn("__copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__times") - 1)))
    start = F.col("__ahead") + F.col("__in") + F.col("__copy") * F.col("size")
    whole = F.floor("target")
    taken = F.lit(0)
    for k in range(epochs):
        taken = taken + F.least(F.greatest(whole - start - F.col("source_size") * k, F.lit(0)), F.col("size"))
    finish = F.try_divide((start + F.col("size")).cast("double"), F.col("target"))
    out = run.select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"), finish.alias("virtual_finish"), "__key")
    return out.orderBy(F.asc_nulls_last("virtual_finish"), "doc_id")


def mixed_rows(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), budget: float = 1.5, epochs: int = 2) -> DataFrame:
    """The mix as rows with the columns of docs: each row as often as it is taken, a last part of at least half counting as one.
    Equal rows share what all of them are given: each stands as often as comes out even, the rest is given to the first of them."""
    taken = mix(docs, weights, budget, epochs).where("size > 0")
    times = F.floor((F.col("taken") + F.floor(F.col("size") / 2)) / F.col("size")).cast("long")
    shared = taken.groupBy("__key").agg(F.sum(times).alias("__all"), F.count("*").alias("__rows")).where("__all > 0")
    shared = shared.select(F.col("__key").alias("__dl_key"), F.expr("__all div __rows").alias("__dl_each"), F.expr("__all % __rows").alias("__dl_rest"))
    shared = stored(shared, scratch(docs.sparkSession, "mixing"), "times")
    keyed = docs.withColumn("__dl_key", F.xxhash64(docs["doc_id"], docs["text"], docs["source"]))
    names = [F.col(f"`{c}`") for c in docs.columns]

    def repeated(rows: DataFrame, n: str) -> DataFrame:
        return rows.withColumn("__dl_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col(n)))).select(*names)

    even = repeated(sized_join(keyed, shared.where("__dl_each > 0"), ["__dl_key"], "inner", salts=1), "__dl_each")
    odd = shared.where("__dl_rest > 0")
    if odd.isEmpty():
        return even
    return even.union(repeated(sized_join(keyed, odd, ["__dl_key"], "inner", salts=1).dropDuplicates(["__dl_key"]), "__dl_rest"))


ORACLE = r"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '')), 0) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS r FROM s),
w AS (SELECT *, CAST([5, 2, 1][(r - 1) % 3 + 1] AS DOUBLE) AS weight, source_size * 2.0::DOUBLE AS cap, CAST(sum(source_size) OVER () AS BIGINT) * 1.5::DOUBLE AS budget FROM r),
l AS (SELECT *, (budget - coalesce(sum(cap) OVER (ORDER BY cap / weight, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0)) / sum(weight) OVER (ORDER BY cap / weight, r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
g AS (SELECT source, source_size, least(cap, weight * max(level) OVER ()) AS target FROM l),
p AS (SELECT d.doc_id, d.size, g.source_size, g.target, CAST(coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY md5('mix|' || coalesce(CAST(d.doc_id AS VARCHAR), 'null')), d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
      FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target,
  CAST(least(greatest(CAST(floor(target) AS BIGINT) - start, 0), size) + least(greatest(CAST(floor(target) AS BIGINT) - start - source_size, 0), size) AS BIGINT) AS taken
FROM p
"""
