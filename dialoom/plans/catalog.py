"""All queries of the engine by name, with the SQL that gives the same rows (dialoom.plans.sql).

Sessions stand in for dialogues: four conversations make one, each a gold segment. Splits go by session number; documents serve as
sources of generation jobs, their source as domain; embeddings as encoded utterances; events as steps of training runs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dialoom.functions import text as tx
from dialoom.operators import assemble, batches, compare, encode, evalsplit, losses, metrics, prompts, runlog, samples, scoring, segment, stats, synth, windows
from dialoom.plans.sql import ORACLE_SQL  # noqa: F401
from dialoom.sources import conversations as cv
from dialoom.sources import dialogue_text

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
OOD, BATCH, WINDOW = ["src0", "src1"], 64, 16


def query(f: Query) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return _plain(f(spark, folder))

    run.__name__, run.__doc__ = f.__name__, f.__doc__
    QUERIES[f.__name__] = run
    return f


def _plain(df: DataFrame) -> DataFrame:
    """Whole numbers as long, fractions to 6 digits, so that engines agree on values."""
    out = []
    for f in df.schema:
        c = F.col(f.name)
        if isinstance(f.dataType, T.IntegerType | T.ShortType | T.ByteType):
            c = c.cast("long")
        elif isinstance(f.dataType, T.DoubleType | T.FloatType):
            c = F.round(c.cast("double"), 6)
        out.append(c.alias(f.name))
    return df.select(*out)


def _joined(c: str | Column) -> Column:
    return F.array_join(c, " | ")


def _numbers(c: str | Column) -> Column:
    return F.array_join(F.transform(c, lambda x: x.cast("string")), ",")


def utterances(spark: SparkSession, folder: str) -> DataFrame:
    own = cv.sessions(cv.table(spark, folder, "conversations"))
    split = F.when(F.col("dialogue_id") % 5 == 3, "val").when(F.col("dialogue_id") % 5 == 4, "test").otherwise("train")
    return own.withColumn("split", split)


def _lexical(spark: SparkSession, folder: str) -> DataFrame:
    own = utterances(spark, folder)
    return segment.predicted(own, scoring.gap_scores(own))


def _per_doc(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.pk_windowdiff(_lexical(spark, folder))


def _vectors(spark: SparkSession, folder: str) -> DataFrame:
    v = F.col("vec_id")
    return cv.table(spark, folder, "embeddings").select(F.floor(v / BATCH).alias("batch"), F.floor(v / WINDOW).alias("dialogue_id"), F.floor(v / WINDOW).alias("win"), (v % WINDOW).cast("int").alias("i"), "label", "embedding")


def _sources(spark: SparkSession, folder: str) -> DataFrame:
    return cv.table(spark, folder, "documents").select("doc_id", F.col("source").alias("domain"), "lang", "n_chars")


def _jobs(spark: SparkSession, folder: str) -> DataFrame:
    docs = _sources(spark, folder)
    facts = F.array(F.concat(F.lit("lang: "), "lang"), F.concat(F.lit("source: "), "domain"), F.concat(F.lit("chars: "), F.col("n_chars").cast("string")), F.concat(F.lit("id: "), F.col("doc_id").cast("string")))
    return synth.jobs(synth.assign_splits(docs, OOD), docs.select("doc_id", facts.alias("facts")))


def _asked(spark: SparkSession, folder: str) -> DataFrame:
    """Conversations as replies to jobs: some asked twice, fenced, cut off, without turns, without JSON or missing."""
    own = cv.dialogues(cv.table(spark, folder, "conversations"))
    js = F.to_json(F.struct(F.transform("turns", lambda t: F.struct(t["speaker"].alias("speaker"), t["text"].alias("text"))).alias("utterances")))
    c = F.col("conv_id")
    jobs = own.select("conv_id", "n_turns", js.alias("js"), F.explode(F.when(c % 10 == 0, F.array(c, c + 500000000000)).otherwise(F.array(c))).alias("id"))
    kind = c % 11
    output = (
        F.when(kind == 1, F.concat(F.lit("Here: ```json\n"), "js", F.lit("\n``` done")))
        .when(kind == 2, F.concat(F.expr("left(js, length(js) - 3)"), F.lit("}")))
        .when(kind == 3, '{"other": 1}')
        .when(kind == 4, "no reply today")
        .when(kind != 0, F.col("js"))
    )
    asked = F.col("n_turns") + F.when(c % 7 == 3, 3).otherwise(0)
    return jobs.select(F.format_string("%012d", "id").alias("job_id"), "conv_id", asked.cast("int").alias("num_turns"), output.alias("output"))


def _existing(asked: DataFrame) -> DataFrame:
    done = asked.where("conv_id % 17 = 5 and job_id < '500'")
    return done.select("job_id", F.concat(F.lit("d_"), "job_id").alias("dialogue_id"), F.lit(None).cast("string").alias("text_key"))


def _judged(spark: SparkSession, folder: str) -> DataFrame:
    asked = _asked(spark, folder)
    replies = asked.where("output is not null").select("job_id", "output")
    return synth.outcomes(asked.select("job_id", "num_turns"), replies, _existing(asked))


def _pool(spark: SparkSession, folder: str) -> DataFrame:
    """Conversations as single-topic dialogues for sessions: a domain, a source and an address each."""
    c = F.col("conv_id")
    own = cv.table(spark, folder, "conversations").select("conv_id").distinct()
    split = F.when(c % 5 == 3, "val_in").when(c % 5 == 4, "test_in").otherwise("train")
    return own.select(split.alias("split"), F.format_string("d_%08d", c).alias("dialogue_id"), F.concat(F.lit("domain"), (c % 6).cast("string")).alias("domain"), F.concat(F.lit("doc"), F.floor(c / 2).cast("string")).alias("source_doc_id"), F.concat(F.lit("pair"), (c % 2).cast("string")).alias("address"))


def _plan(spark: SparkSession, folder: str) -> DataFrame:
    return assemble.plan(_pool(spark, folder))


def _diffs(spark: SparkSession, folder: str) -> DataFrame:
    return compare.paired(metrics.baseline(utterances(spark, folder), "even"), _per_doc(spark, folder))


def _encoded(spark: SparkSession, folder: str) -> DataFrame:
    rows = windows.gap_windows(utterances(spark, folder))
    rows = rows.withColumn("c", encode.context_ids(F.col("context"))).withColumn("f", encode.context_ids(F.col("following")))
    return encode.truncated_pair(rows, "c", "f", 64)


def _epochs(spark: SparkSession, folder: str) -> DataFrame:
    steps = cv.table(spark, folder, "events").select((F.col("user_id") % 5).alias("run"), (F.col("event_id") % 12).alias("epoch"), F.col("value").alias("val_pk"))
    return runlog.epoch_means(steps, "val_pk").withColumn("val_pk", F.round("val_pk", 9))


def _simple(name: str, f: Callable[[DataFrame], DataFrame]) -> None:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return f(utterances(spark, folder))

    run.__name__ = name
    query(run)


_simple("session_utterances", lambda u: u.select("dialogue_id", "utt_idx", "seg_rank", "role", "text"))
_simple("segment_masses", windows.segments)
_simple("segment_starts", windows.segment_starts)
_simple("gold_boundaries", windows.gold_boundaries)
_simple("context_windows", lambda u: u.select("dialogue_id", "utt_idx", _joined(windows.context(F.col("text"), 2)).alias("context")))
_simple("continuation_windows", lambda u: u.select("dialogue_id", "utt_idx", _joined(windows.continuation(F.col("text"), 2)).alias("continuation")))
_simple("gap_windows", lambda u: windows.gap_windows(u).select("dialogue_id", "gap_idx", _joined("context").alias("context"), _joined("following").alias("following")))
_simple("topic_windows", lambda u: windows.crops(u, 3).select("dialogue_id", "anchor_idx", "mid", F.md5(_joined("texts")).alias("texts"), _numbers("segs").alias("segs")))
_simple("opener_words", stats.openers)
_simple("top_openers", lambda u: stats.openers(u).groupBy("opener").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "opener").limit(8))
_simple("closing_cue_rates", stats.closing_cue_rates)
_simple("gap_scores", scoring.gap_scores)
_simple("depth_scores", lambda u: segment.depth_scores(scoring.gap_scores(u).select("dialogue_id", "gap_idx", "score")))
_simple("baseline_even", lambda u: metrics.baseline(u, "even"))
_simple("baseline_random", lambda u: metrics.baseline(u, "random"))
_simple("corpus_diversity", stats.diversity)
_simple("segment_length_stats", stats.length_stats)
_simple("histograms", stats.histograms)
_simple("split_overlap", stats.split_overlap)
_simple("opener_js", stats.opener_divergence)
_simple("session_lines", dialogue_text.session_lines)


@query
def clean_punctuation(spark: SparkSession, folder: str) -> DataFrame:
    return cv.table(spark, folder, "conversations").select("conv_id", "turn", tx.respace_punctuation(F.col("text")).alias("text"))


@query
def normalize_text(spark: SparkSession, folder: str) -> DataFrame:
    return cv.table(spark, folder, "conversations").select("conv_id", "turn", tx.normalized(F.col("text")).alias("text"))


@query
def topk_boundaries(spark: SparkSession, folder: str) -> DataFrame:
    own = utterances(spark, folder)
    depths = segment.depth_scores(scoring.gap_scores(own)).join(own.where("utt_idx = 0").select("dialogue_id", (F.col("n_seg") - 1).alias("k")), "dialogue_id")
    return segment.top_gaps(depths).select("dialogue_id", "gap_idx", "rank")


@query
def predicted_masses(spark: SparkSession, folder: str) -> DataFrame:
    return segment.masses(_lexical(spark, folder)).select("dialogue_id", _numbers("masses").alias("masses"))


@query
def pk_windowdiff_per_doc(spark: SparkSession, folder: str) -> DataFrame:
    return _per_doc(spark, folder)


@query
def pk_windowdiff_macro(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.macro(_per_doc(spark, folder))


def _stride(own: DataFrame) -> int:
    return metrics.train_stride(windows.segments(own.where("split = 'train'")))


@query
def baseline_stride(spark: SparkSession, folder: str) -> DataFrame:
    own = utterances(spark, folder)
    return metrics.baseline(own, "stride", _stride(own))


def _mined(spark: SparkSession, folder: str) -> DataFrame:
    return samples.mine(utterances(spark, folder))


@query
def mine_samples(spark: SparkSession, folder: str) -> DataFrame:
    return _mined(spark, folder).select("dialogue_id", "anchor_idx", "neg_idx", "hard_idx", *[_joined(c).alias(c) for c in ("context", "pos", "neg", "hard")])


@query
def sample_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return samples.pairs(_mined(spark, folder)).select("dialogue_id", "anchor_idx", "pair", *[_joined(c).alias(c) for c in ("context", "pos", "other")])


@query
def truncate_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return _encoded(spark, folder).select("dialogue_id", "gap_idx", "keep_context", "keep_next", _numbers("input_ids").alias("input_ids"))


@query
def pad_and_mask(spark: SparkSession, folder: str) -> DataFrame:
    n = F.aggregate("attention_mask", F.lit(0), lambda s, x: s + x)
    return encode.fixed_length(_encoded(spark, folder), 64).select("dialogue_id", "gap_idx", _numbers("input_ids").alias("input_ids"), _numbers("type_ids").alias("type_ids"), n.alias("n_mask"))


@query
def gate_checks(spark: SparkSession, folder: str) -> DataFrame:
    own = utterances(spark, folder)
    splits = own.where("utt_idx = 0").select("dialogue_id", "split")
    base = None
    for kind in ("even", "stride"):
        each = metrics.baseline(own, kind, _stride(own) if kind == "stride" else 0)
        part = each.join(splits, "dialogue_id").groupBy("split").agg(F.avg("pk").alias("pk")).withColumn("kind", F.lit(kind))
        base = part if base is None else base.unionByName(part)
    return stats.gate(stats.diversity(own), stats.length_stats(own), stats.closing_cue_rates(own), stats.split_overlap(own), stats.opener_divergence(own), base)


@query
def split_assignment(spark: SparkSession, folder: str) -> DataFrame:
    return synth.assign_splits(_sources(spark, folder), OOD)


@query
def gen_jobs(spark: SparkSession, folder: str) -> DataFrame:
    return _jobs(spark, folder).drop("prompt").withColumn("facts_used", F.array_join("facts_used", "; "))


@query
def split_counts(spark: SparkSession, folder: str) -> DataFrame:
    return synth.split_counts(_jobs(spark, folder))


@query
def thin_domains(spark: SparkSession, folder: str) -> DataFrame:
    return synth.thin_domains(_sources(spark, folder), OOD, 60)


@query
def pending_jobs(spark: SparkSession, folder: str) -> DataFrame:
    asked = _asked(spark, folder)
    return synth.pending(asked.select("job_id"), _existing(asked))


@query
def parse_replies(spark: SparkSession, folder: str) -> DataFrame:
    replies = _asked(spark, folder).where("output is not null").select("job_id", "output")
    return synth.parsed(replies).select("job_id", "parse_error", F.when(F.col("utts").isNotNull(), F.size("utts")).alias("n_utterances"))


@query
def validate_replies(spark: SparkSession, folder: str) -> DataFrame:
    replies = _asked(spark, folder).where("output is not null").select("job_id", "output")
    return synth.parsed(replies).where("utts is not null").select("job_id", F.size("utts").alias("got"), synth.turn_fault(F.col("utts")).alias("fault"))


@query
def ingest_outcomes(spark: SparkSession, folder: str) -> DataFrame:
    return _judged(spark, folder).select("job_id", "outcome")


@query
def outcome_counts(spark: SparkSession, folder: str) -> DataFrame:
    return _judged(spark, folder).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


@query
def turn_drift(spark: SparkSession, folder: str) -> DataFrame:
    return _judged(spark, folder).where("drift is not null").groupBy("drift").agg(F.count(F.lit(1)).alias("n"))


@query
def assemble_sessions(spark: SparkSession, folder: str) -> DataFrame:
    return _plan(spark, folder)


@query
def adjacent_domain_rate(spark: SparkSession, folder: str) -> DataFrame:
    return assemble.adjacent_domain_rate(_plan(spark, folder))


@query
def unused_dialogues(spark: SparkSession, folder: str) -> DataFrame:
    return assemble.unused(_pool(spark, folder), _plan(spark, folder))


@query
def drop_closing(spark: SparkSession, folder: str) -> DataFrame:
    own = cv.dialogues(cv.table(spark, folder, "conversations")).withColumn("dialogue_id", F.col("conv_id").cast("string"))
    planned = own.select(F.floor(F.col("conv_id") / 4).alias("session_id"), F.lit("all").alias("split"), F.col("conv_id").alias("position"), "dialogue_id", F.lit("").alias("domain"), F.lit("").alias("source_doc_id"))
    out = assemble.sessions(planned, own.select("dialogue_id", "turns"), drop_closing=True)
    return out.select("session_id", "num_turns", F.when(F.size("gold_boundaries") > 0, _numbers("gold_boundaries")).alias("gold_boundaries"))


def _buckets(spark: SparkSession, folder: str) -> DataFrame:
    own = utterances(spark, folder)
    points = evalsplit.quartiles(evalsplit.token_counts(own.where("split = 'train'")))
    return evalsplit.bucketed(evalsplit.token_counts(own.where("split <> 'train'")), points)


@query
def quartile_buckets(spark: SparkSession, folder: str) -> DataFrame:
    return _buckets(spark, folder)


@query
def stratified_split(spark: SparkSession, folder: str) -> DataFrame:
    return evalsplit.stratified(_buckets(spark, folder))


@query
def win_tie_loss(spark: SparkSession, folder: str) -> DataFrame:
    return compare.win_tie_loss(_diffs(spark, folder))


@query
def paired_bootstrap(spark: SparkSession, folder: str) -> DataFrame:
    return compare.bootstrap(_diffs(spark, folder))


@query
def wilcoxon(spark: SparkSession, folder: str) -> DataFrame:
    return compare.wilcoxon(_diffs(spark, folder)).select("metric", "n", "w", "z", "p")


@query
def pairwise_cosine(spark: SparkSession, folder: str) -> DataFrame:
    return losses.pairwise_cosine(_vectors(spark, folder), "win")


@query
def mean_pool(spark: SparkSession, folder: str) -> DataFrame:
    return losses.mean_pool(_vectors(spark, folder), "win", "label").select("win", "label", F.posexplode("pooled").alias("dim", "mean"))


@query
def margin_loss(spark: SparkSession, folder: str) -> DataFrame:
    return losses.margin_loss(losses.pairwise_cosine(_vectors(spark, folder), "win"), "win")


@query
def supcon_loss(spark: SparkSession, folder: str) -> DataFrame:
    return losses.supcon_loss(losses.pairwise_cosine(_vectors(spark, folder), "win"), "win")


def _topic_loss(spark: SparkSession, folder: str) -> DataFrame:
    rows = _vectors(spark, folder)
    by = F.lag("label").over(windows.W.partitionBy("dialogue_id").orderBy("i"))
    starts = rows.withColumn("before", by).where("before is null or before <> label").select("dialogue_id", F.col("i").alias("start"))
    return losses.topic_margin(rows, starts)


@query
def topic_margin_loss(spark: SparkSession, folder: str) -> DataFrame:
    return _topic_loss(spark, folder)


@query
def pseudo_boundaries(spark: SparkSession, folder: str) -> DataFrame:
    return losses.pseudo_starts(_vectors(spark, folder))


@query
def epoch_means(spark: SparkSession, folder: str) -> DataFrame:
    return _epochs(spark, folder)


@query
def early_stopping(spark: SparkSession, folder: str) -> DataFrame:
    return runlog.early_stopping(_epochs(spark, folder), "val_pk").select("run", "epoch", "val_pk", "best", "is_best", "bad", "stopped")


@query
def domain_documents(spark: SparkSession, folder: str) -> DataFrame:
    return synth.in_domains(_sources(spark, folder), ["src2", "src5"]).select("doc_id", "domain")


@query
def job_prompts(spark: SparkSession, folder: str) -> DataFrame:
    return prompts.with_prompts(_jobs(spark, folder)).select("job_id", F.md5("prompt").alias("prompt"), "own", "other")


@query
def addressed_dialogues(spark: SparkSession, folder: str) -> DataFrame:
    jobs = prompts.with_prompts(_jobs(spark, folder))
    jobs = jobs.withColumn("prompt", F.when(F.col("num_turns") == 5, F.lit("no form of address")).otherwise(F.col("prompt")))
    dialogues = jobs.select(F.concat(F.lit("d_"), "job_id", F.when(F.col("num_turns") == 7, "_lost").otherwise("")).alias("dialogue_id"), "domain")
    return prompts.with_address(dialogues, jobs)


@query
def fact_lines(spark: SparkSession, folder: str) -> DataFrame:
    js = F.to_json(F.struct("lang", F.struct(F.col("domain").alias("name"), F.array("n_chars", F.array("doc_id")[0]).alias("sizes")).alias("source")))
    return _sources(spark, folder).where("lang is not null and domain is not null").select("doc_id", prompts.fact_text(js).alias("facts"))


@query
def accepted_by_split(spark: SparkSession, folder: str) -> DataFrame:
    c = F.col("conv_id")
    split = _asked(spark, folder).select("job_id", F.when(c % 5 == 3, "val").when(c % 5 == 4, "test").otherwise("train").alias("split"))
    return synth.accepted_by_split(_judged(spark, folder).join(split, "job_id"))


@query
def suffix_pool(spark: SparkSession, folder: str) -> DataFrame:
    pool = _pool(spark, folder)
    suffixes = pool.where("split <> 'train'").select(F.element_at(F.split("dialogue_id", "_"), -1).alias("suffix"))
    return evalsplit.pool_by_suffix(pool, suffixes).select("dialogue_id", "split")


@query
def eval_manifest(spark: SparkSession, folder: str) -> DataFrame:
    own = _buckets(spark, folder).withColumn("s", F.col("dialogue_id") % 5)
    val, test = (evalsplit.stratified(own.where(F.col("s") == k).drop("s"), target=16) for k in (3, 4))
    return evalsplit.joint_manifest(val, test)


@query
def oversampled_sessions(spark: SparkSession, folder: str) -> DataFrame:
    counts = evalsplit.token_counts(utterances(spark, folder).where("split = 'val'"))
    return evalsplit.oversampled(counts)


@query
def session_sizes(spark: SparkSession, folder: str) -> DataFrame:
    own = utterances(spark, folder).select("split", F.col("dialogue_id").alias("session_id"), "seg_rank").distinct()
    return assemble.session_sizes(own)


@query
def documents_by_improvement(spark: SparkSession, folder: str) -> DataFrame:
    return compare.by_improvement(_diffs(spark, folder)).select("dialogue_id", "base", "cand", "diff")


@query
def comparison_coverage(spark: SparkSession, folder: str) -> DataFrame:
    return compare.coverage(metrics.baseline(utterances(spark, folder), "even"), _per_doc(spark, folder))


@query
def retry_jobs(spark: SparkSession, folder: str) -> DataFrame:
    return synth.retries(_judged(spark, folder)).select("job_id", "outcome")


@query
def vector_norms(spark: SparkSession, folder: str) -> DataFrame:
    return losses.norms(_vectors(spark, folder)).select("win", "i", "norm")


@query
def shuffled_batches(spark: SparkSession, folder: str) -> DataFrame:
    gaps = windows.gap_windows(utterances(spark, folder)).select("dialogue_id", "gap_idx")
    return batches.shuffled(gaps, ["dialogue_id", "gap_idx"], 16)


@query
def training_loss(spark: SparkSession, folder: str) -> DataFrame:
    """Of neighbouring vectors the next one is the true continuation and the one after it the false one; equal labels are coherent."""
    pairs = losses.pairwise_cosine(_vectors(spark, folder), "win").withColumn("coherence", F.col("same").cast("double"))
    pos = pairs.where("j = i + 1").select("win", "i", F.col("coherence").alias("pos_coherence"), F.col("cos").alias("pos_cos"))
    neg = pairs.where("j = i + 2").select("win", "i", F.col("coherence").alias("neg_coherence"), F.col("cos").alias("neg_cos"))
    samples = pos.join(neg, ["win", "i"]).withColumn("batch", F.floor(F.col("win") * WINDOW / BATCH))
    return losses.training_loss(samples, _topic_loss(spark, folder))
