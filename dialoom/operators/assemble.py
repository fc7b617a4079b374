"""Sessions put together from single-topic dialogues under a budget of uses. Each session changes the weights of the next, so a
split is one group; what travels is a row of ids for each dialogue, never texts. Everything after it is joins and windows."""

from __future__ import annotations

import hashlib
from bisect import bisect_left, bisect_right
from collections import defaultdict

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

PLAN = "split string, session_id string, position int, dialogue_id string, domain string, source_doc_id string"


def _draws(seed: str):
    n = 0
    while True:
        n += 1
        yield int(hashlib.md5(f"{seed}|{n}".encode()).hexdigest()[:8], 16) / 2**32


class _Weights:
    """Whole weights of some rows, all equal at first: sums and changes in logarithmic time (a binary indexed tree)."""

    def __init__(self, rows: list[int], weight: int):
        self.rows, self.total = rows, weight * len(rows)
        self.sums = [weight * (k & -k) for k in range(len(rows) + 1)]

    def add(self, row: int, change: int) -> None:
        self.total += change
        k = bisect_left(self.rows, row) + 1
        while k < len(self.sums):
            self.sums[k] += change
            k += k & -k

    def upto(self, row: int) -> int:
        k, total = bisect_right(self.rows, row), 0
        while k:
            total += self.sums[k]
            k &= k - 1
        return total


class _Pools:
    """The uses that dialogues have left, as weights of all of them, of each address, of each domain in it and each source in that;
    a dialogue that is in the session at hand weighs nothing until the session ends."""

    def __init__(self, rows: pd.DataFrame, budget: int):
        self.of = list(zip(rows["address"], rows["domain"], rows["source_doc_id"], strict=True))
        self.left = [budget] * len(rows)
        listed: dict[tuple, list[int]] = defaultdict(list)
        for i, path in enumerate(self.of):
            for depth in range(4):
                listed[path[:depth]].append(i)
        self.weights = {path: _Weights(own, budget) for path, own in listed.items()}

    def weigh(self, row: int, change: int) -> None:
        for depth in range(4):
            self.weights[self.of[row][:depth]].add(row, change)

    def size(self, within: tuple, without: tuple | None = None) -> int:
        return self.weights[within].total - (self.weights[without].total if without else 0)

    def draw(self, u: float, within: tuple, without: tuple | None = None) -> int:
        """The row at the share u of the weights within one path but not within another below it."""
        inner, outer = self.weights[within], self.weights[without] if without else None
        at, a, b = u * self.size(within, without), 0, len(inner.rows) - 1
        while a < b:
            mid = (a + b) // 2
            row = inner.rows[mid]
            if inner.upto(row) - (outer.upto(row) if outer else 0) > at:
                b = mid
            else:
                a = mid + 1
        return inner.rows[a]


def _assemble(rows: pd.DataFrame, budget: int, least: int, most: int, same_domain: float, seed: str) -> list[tuple]:
    rows = rows.sort_values("dialogue_id", kind="stable").reset_index(drop=True)
    split, pools = rows["split"].iloc[0], _Pools(rows, budget)
    names = list(zip(rows["dialogue_id"], rows["domain"], rows["source_doc_id"], strict=True))
    u = _draws(f"{seed}|{split}")
    out, number = [], 0
    while True:
        target = least + int(next(u) * (most - least + 1))
        if not pools.size(()):
            return out
        session: list[int] = []
        ways: list[tuple] = [((), None)]
        while ways and len(session) < target:
            row = pools.draw(next(u), *ways[0])
            pools.weigh(row, -pools.left[row])
            session.append(row)
            path = pools.of[row]
            if len(session) < target:
                ways = [(path[:2], path), (path[:1], path[:2])]  # the same domain from another source, another domain
                ways = [w for w in (ways if next(u) < same_domain else ways[::-1]) if pools.size(*w)]
        if len(session) < least:
            return out
        for place, row in enumerate(session):
            pools.left[row] -= 1
            pools.weigh(row, pools.left[row])
            out.append((split, f"{split}_{number:04d}", place, *names[row]))
        number += 1


def plan(dialogues: DataFrame, max_uses: int = 5, eval_max_uses: int = 3, min_segs: int = 3, max_segs: int = 8, same_domain: float = 0.3, seed: str = "42", shards: int = 1) -> DataFrame:
    """dialogues(split, dialogue_id, domain, source_doc_id, address) -> split, session_id, position, dialogue_id, domain,
    source_doc_id. A split ends with the first session that stays under `min_segs`. A choice takes the square of the logarithm of
    the dialogues; a split is one task all the same, so large ones can be cut into `shards` pools by a hash of the address, which
    run apart and number sessions apart."""

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        budget = max_uses if rows["split"].iloc[0].split("#")[0] == "train" else eval_max_uses
        return pd.DataFrame(_assemble(rows, budget, min_segs, max_segs, same_domain, seed), columns=[c.split()[0] for c in PLAN.split(", ")])

    own = dialogues.select("split", F.col("dialogue_id").cast("string").alias("dialogue_id"), F.col("domain").cast("string").alias("domain"), F.col("source_doc_id").cast("string").alias("source_doc_id"), F.coalesce(F.col("address").cast("string"), F.lit("")).alias("address"))
    if shards > 1:
        own = own.withColumn("split", F.concat_ws("#", "split", F.pmod(F.xxhash64("address"), F.lit(shards)).cast("string")))
    return own.groupBy("split").applyInPandas(build, PLAN).withColumn("split", F.split_part("split", F.lit("#"), F.lit(1)))


def without_closing(segments: DataFrame) -> DataFrame:
    """segments(session_id, position, turns): a last turn by the citizen is dropped from all but the last segment if it has over two."""
    last = F.max("position").over(W.partitionBy("session_id"))
    drop = (F.col("position") < last) & (F.size("turns") > 2) & (F.element_at("turns", -1)["speaker"] == "citizen")
    return segments.withColumn("turns", F.when(drop, F.slice("turns", 1, F.size("turns") - 1)).otherwise(F.col("turns")))


def sessions(planned: DataFrame, turns: DataFrame, drop_closing: bool = False) -> DataFrame:
    """planned joined with turns(dialogue_id, turns): a row for each session with utterances, gold_boundaries and sequences."""
    rows = planned.join(turns, "dialogue_id")
    rows = without_closing(rows) if drop_closing else rows
    one = F.array_sort(F.collect_list(F.struct("position", "turns", "domain", "source_doc_id", "dialogue_id")))
    out = rows.groupBy("session_id", "split").agg(one.alias("s"))
    ends = F.aggregate("s", F.array().cast("array<int>"), lambda a, x: F.concat(a, F.array(F.coalesce(F.get(a, F.size(a) - 1), F.lit(-1)) + F.size(x["turns"]))))
    out = out.select(
        "session_id",
        "split",
        F.size("s").alias("num_sub_dialogues"),
        F.flatten(F.transform("s", lambda x: x["turns"])).alias("utterances"),
        ends.alias("ends"),
        F.transform("s", lambda x: x["domain"]).alias("domain_sequence"),
        F.transform("s", lambda x: x["source_doc_id"]).alias("source_doc_ids"),
        F.transform("s", lambda x: x["dialogue_id"]).alias("source_dialogue_ids"),
    )
    return out.withColumn("num_turns", F.size("utterances")).withColumn("gold_boundaries", F.slice("ends", F.lit(1), F.size("ends") - 1)).drop("ends")


def manifest(sessions: DataFrame) -> DataFrame:
    return sessions.drop("utterances")


def adjacent_domain_rate(planned: DataFrame) -> DataFrame:
    """split, pairs, same_rate: neighbouring segments of a session that share a domain; 0 without pairs."""
    after = F.lead("domain").over(W.partitionBy("split", "session_id").orderBy("position"))
    rows = planned.withColumn("after", after)
    same = F.sum(F.when(F.col("after") == F.col("domain"), 1).otherwise(0))
    return rows.groupBy("split").agg(F.count("after").alias("pairs"), (same / F.greatest(F.count("after"), F.lit(1))).alias("same_rate"))


def unused(dialogues: DataFrame, planned: DataFrame) -> DataFrame:
    """split and how many of its dialogues no session uses."""
    rest = dialogues.join(planned.select("dialogue_id").distinct(), "dialogue_id", "left_anti")
    return rest.groupBy("split").agg(F.count(F.lit(1)).alias("n_unused"))


def session_sizes(planned: DataFrame) -> DataFrame:
    """split, n_segs and how many sessions have so many segments."""
    each = planned.groupBy("split", "session_id").agg(F.count(F.lit(1)).alias("n_segs"))
    return each.groupBy("split", "n_segs").agg(F.count(F.lit(1)).alias("n_sessions"))
