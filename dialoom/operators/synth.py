"""Synthetic dialogues: splits of source documents, generation jobs, and replies to them parsed, judged and ingested.

The language model itself stays outside: jobs go out as rows, (job_id, output) comes back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dialoom.functions.sampling import below, rank_key, unit, weighted
from dialoom.functions.text import MARKDOWN, unfenced

#: Weights of the first sentence's kind, and of the last one's for odd (citizen) and even (officer) numbers of turns.
OPENERS = ["greet", "direct", "situation", "follow_on", "paperwork"]
OPENER_WEIGHTS = [0.20, 0.25, 0.25, 0.15, 0.15]
CITIZEN_CLOSINGS, CITIZEN_WEIGHTS = ["thanks", "confirms", "plans"], [0.35, 0.35, 0.30]
OFFICER_CLOSINGS, OFFICER_WEIGHTS = ["advises", "stops"], [0.15, 0.85]
PERSONAS = ["student", "worker", "middle_aged", "elderly", "young_with_elder", "shop_owner", "for_parents", "migrant_worker"]
CLARIFY = 0.3


def assign_splits(docs: DataFrame, ood: list[str], min_docs: int = 3, seed: str = "42") -> DataFrame:
    """docs(doc_id, domain) -> doc_id, domain, split. Out-of-domain documents alternate val_ood and test_ood by rank; of every other
    domain with `min_docs` documents one drawn document is held out, alternating val_in and test_in over those domains."""
    rows = docs.select("doc_id", "domain").withColumn("is_ood", F.col("domain").isin(ood))
    per = rows.groupBy("domain").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(rank_key(seed, F.lit("held"), "doc_id").alias("h"), "doc_id")).alias("m"), F.first("is_ood").alias("o"))
    held = per.where((F.col("n") >= min_docs) & ~F.col("o")).withColumn("flip", F.row_number().over(W.orderBy("domain")) % 2)  # a row for each domain
    held = held.select("domain", F.col("m.doc_id").alias("held_id"), "flip")
    inside = rows.where("not is_ood").join(F.broadcast(held), "domain", "left")
    inside = inside.select("doc_id", "domain", F.when(F.col("doc_id") == F.col("held_id"), F.when(F.col("flip") == 1, "val_in").otherwise("test_in")).otherwise("train").alias("split"))
    rank = F.row_number().over(W.partitionBy("domain").orderBy("doc_id"))
    outside = rows.where("is_ood").select("doc_id", "domain", F.when(rank % 2 == 1, "val_ood").otherwise("test_ood").alias("split"))
    return inside.unionByName(outside)


def thin_domains(docs: DataFrame, ood: list[str], min_docs: int = 3) -> DataFrame:
    """Domains too small to hold a document out: domain, n_docs."""
    return docs.where(~F.col("domain").isin(ood)).groupBy("domain").agg(F.count(F.lit(1)).alias("n_docs")).where(F.col("n_docs") < min_docs)


def split_counts(jobs: DataFrame) -> DataFrame:
    return jobs.groupBy("split").agg(F.countDistinct("source_doc_id").alias("n_docs"), F.count(F.lit(1)).alias("n_jobs"))


def in_domains(docs: DataFrame, domains: list[str]) -> DataFrame:
    """The source documents of the named domains."""
    return docs.where(F.col("domain").isin(domains))


def accepted_by_split(judged: DataFrame) -> DataFrame:
    """judged(split, outcome, ...) -> split and how many dialogues it took in."""
    return judged.where("outcome = 'accepted'").groupBy("split").agg(F.count(F.lit(1)).alias("n_accepted"))


def jobs(splits: DataFrame, facts: DataFrame, per_doc: int = 8, min_turns: int = 3, max_turns: int = 12, seed: str = "42") -> DataFrame:
    """splits(doc_id, domain, split), facts(doc_id, facts array<string>) -> a row for each job with its drawn parameters."""
    rows = splits.join(facts, "doc_id").withColumn("idx", F.explode(F.sequence(F.lit(0), F.lit(per_doc - 1))))
    rows = rows.withColumn("job_id", F.concat_ws("_", F.col("doc_id").cast("string"), F.format_string("%02d", "idx")))
    rows = rows.withColumn("num_turns", (below(F.lit(max_turns - min_turns + 1), seed, F.lit("turns"), "job_id") + min_turns).cast("int"))
    wanted = F.greatest(F.floor(F.col("num_turns") / 2), F.lit(1)) + below(F.lit(3), seed, F.lit("facts"), "job_id") - 1
    k = F.greatest(F.lit(1), F.least(F.size("facts"), wanted)).cast("int")
    shuffled = F.transform(F.array_sort(F.transform("facts", lambda x: F.struct(F.md5(F.concat_ws("|", F.lit(seed), "job_id", x)).alias("h"), x.alias("x")))), lambda x: x["x"])
    rows = rows.withColumn("facts_used", F.slice(shuffled, F.lit(1), k))
    persona = F.element_at(F.array(*map(F.lit, PERSONAS)), (below(F.lit(len(PERSONAS)), seed, F.lit("persona"), "job_id") + 1).cast("int"))
    closing_at = unit(seed, F.lit("closing"), "job_id")
    closing = F.when(F.col("num_turns") % 2 == 1, weighted(CITIZEN_CLOSINGS, CITIZEN_WEIGHTS, closing_at)).otherwise(weighted(OFFICER_CLOSINGS, OFFICER_WEIGHTS, closing_at))
    clarify = (F.col("num_turns") >= 6) & (unit(seed, F.lit("clarify"), "job_id") < CLARIFY)
    rows = rows.withColumn("persona", persona).withColumn("opener", weighted(OPENERS, OPENER_WEIGHTS, unit(seed, F.lit("opener"), "job_id"))).withColumn("closing", closing).withColumn("clarify", clarify)
    prompt = F.format_string("Write exactly %d turns on %s as %s; begin: %s; end: %s. Facts: %s", "num_turns", "domain", "persona", "opener", "closing", F.array_join("facts_used", "; "))
    return rows.select("job_id", "split", "domain", F.col("doc_id").alias("source_doc_id"), "num_turns", "facts_used", "persona", "opener", "closing", "clarify", prompt.alias("prompt"))


def pending(jobs: DataFrame, done: DataFrame) -> DataFrame:
    return jobs.join(done.select("job_id").distinct(), "job_id", "left_anti")


def parsed(replies: DataFrame) -> DataFrame:
    """replies(job_id, output) with utts (array of speaker and text) and parse_error: no_json, bad_json or no_utterances."""
    rows = replies.withColumn("body", unfenced(F.col("output")))
    rows = rows.withColumn("v", F.try_parse_json("body"))
    listed = F.try_variant_get("v", "$.utterances", "array<variant>")
    rows = rows.withColumn("utts", F.transform(listed, lambda u: F.struct(F.try_variant_get(u, "$.speaker", "string").alias("speaker"), F.try_variant_get(u, "$.text", "string").alias("text"))))
    error = F.when(F.col("body").isNull(), "no_json").when(F.col("v").isNull(), "bad_json").when(F.col("utts").isNull() | (F.size("utts") == 0), "no_utterances")
    return rows.withColumn("parse_error", error).withColumn("utts", F.when(error.isNull(), F.col("utts"))).drop("body", "v")


def turn_fault(utts: Column) -> Column:
    """The first bad turn's fault: empty_turn, speaker_order or markdown; null if there is none."""

    def fault(u, i):
        empty = F.coalesce(F.trim(u["text"]), F.lit("")) == ""
        order = ~F.coalesce(u["speaker"] == F.when(i % 2 == 0, "citizen").otherwise("officer"), F.lit(False))
        return F.when(empty, "empty_turn").when(order, "speaker_order").when(u["text"].rlike(MARKDOWN), "markdown")

    return F.get(F.filter(F.transform(utts, fault), lambda x: x.isNotNull()), 0)


def outcomes(jobs: DataFrame, replies: DataFrame, existing: DataFrame, tolerance: int = 1) -> DataFrame:
    """jobs(job_id, num_turns, ...), replies(job_id, output; one for each job), existing(dialogue_id, text_key) -> jobs with utts,
    drift (turns got - asked, of any that parse), text_key and outcome. The earliest of equal accepted texts stays."""
    rows = jobs.withColumn("dialogue_id", F.concat(F.lit("d_"), "job_id"))
    rows = rows.join(existing.select("dialogue_id", F.lit(True).alias("is_done")), "dialogue_id", "left").join(parsed(replies).withColumn("has_reply", F.lit(True)), "job_id", "left")
    rows = rows.withColumn("drift", F.size("utts") - F.col("num_turns"))
    wrong = F.coalesce(turn_fault(F.col("utts")), F.when(F.abs("drift") > tolerance, "turn_count"))
    rows = rows.withColumn("reason", F.when(F.col("is_done"), "already_ingested").when(F.col("has_reply").isNull(), "missing_reply").otherwise(F.coalesce("parse_error", wrong)))
    rows = rows.withColumn("drift", F.when(F.col("is_done").isNull() & F.col("utts").isNotNull(), F.col("drift")))
    key = F.md5(F.to_json(F.transform("utts", lambda u: F.trim(u["text"]))))
    rows = rows.withColumn("text_key", F.when(F.col("reason").isNull(), key))
    known = existing.select("text_key", F.lit(True).alias("is_known")).where("text_key is not null").distinct()
    # the order of jobs: by `seq` where jobs have one, else by job_id with its numbers as numbers
    order = [F.col("seq")] if "seq" in jobs.columns else [F.transform(F.split("job_id", "_"), lambda x: F.lpad(x, 20, "0"))]
    good = rows.where("reason is null").join(known, "text_key", "left")  # failures have no key and stay out of the join
    first = F.row_number().over(W.partitionBy("text_key").orderBy(*order, "job_id"))
    good = good.withColumn("outcome", F.when(F.col("is_known") | (first > 1), "duplicate").otherwise("accepted"))
    bad = rows.where("reason is not null").withColumn("is_known", F.lit(None).cast("boolean")).withColumn("outcome", F.col("reason"))
    return good.unionByName(bad).drop("is_done", "has_reply", "parse_error", "is_known", "reason")


def retries(judged: DataFrame) -> DataFrame:
    return judged.where("outcome not in ('accepted', 'already_ingested')")
