"""Gap scores are made row by row: no step under them makes a row for each term, which one task would have to hold."""

import random
from collections import Counter
from math import isclose, sqrt

import pytest
from pyspark.sql import functions as F

from dialoom.functions.arrays import count_cosine
from dialoom.operators import scoring
from dialoom.plans import catalog

FOLDER = "/root/testdata/sf0.001"
NAMES = ["depth_scores", "documents_by_improvement", "gap_scores", "pk_windowdiff_macro", "pk_windowdiff_per_doc", "topk_boundaries", "wilcoxon", "win_tie_loss", "predicted_masses"]


def most_rows(plan):
    """The most rows that an operator of an executed plan gave out."""
    kind = plan.getClass().getSimpleName()
    below = [plan.executedPlan()] if kind == "AdaptiveSparkPlanExec" else [plan.plan()] if kind.endswith("QueryStageExec") else [plan.children().apply(i) for i in range(plan.children().size())]
    own = plan.metrics().get("numOutputRows")
    return max([own.get().value() if own.isDefined() else 0, *map(most_rows, below)])


def few_rows(spark, df):
    df.collect()
    n = spark.read.parquet(f"{FOLDER}/conversations.parquet").count()
    assert n <= most_rows(df._jdf.queryExecution().executedPlan()) <= 4 * n


@pytest.mark.parametrize("name", NAMES)
def test_no_row_for_each_term(spark, name):
    few_rows(spark, catalog.QUERIES[name](spark, FOLDER))


def test_differences_make_no_row_for_each_term(spark):
    """Those that paired_bootstrap draws from; the draws are rows of their own."""
    few_rows(spark, catalog._diffs(spark, FOLDER))


def test_cosine_of_counts(spark):
    draw = random.Random(7)
    some = lambda: [draw.choice("abcdeé") * draw.choice((1, 1, 2)) for _ in range(draw.choice((0, 1, 5, 40)))]
    pairs = [(i, some(), some()) for i in range(60)]
    got = dict(spark.createDataFrame(pairs, "i int, a array<string>, b array<string>").select("i", count_cosine(F.col("a"), F.col("b"))).collect())
    for i, a, b in pairs:
        p, q = Counter(a), Counter(b)
        size = max(sqrt(sum(n * n for n in p.values())), 1e-8) * max(sqrt(sum(n * n for n in q.values())), 1e-8)
        assert isclose(got[i], sum(p[t] * q[t] for t in p) / size, abs_tol=1e-12)


def test_one_pass_equals_the_joined_scorers(spark):
    texts = [("d", "a b a"), ("d", None), ("d", "A, c"), ("d", ""), ("d", "c c b"), ("e", "x"), ("f", "a"), ("f", "a")]
    rows = [(d, sum(e == d for e, _ in texts[:k]), sum(e == d for e, _ in texts), t) for k, (d, t) in enumerate(texts)]
    own = spark.createDataFrame(rows, "dialogue_id string, utt_idx int, n_utt int, text string")
    for width in (1, 2, 3):
        joined = scoring.combined(scoring.coherence(own), scoring.topic_cosine(own, width))
        got = scoring.gap_scores(own, width)
        assert sorted(got.collect()) == sorted(joined.select(got.columns).collect())
    cos = {(r.dialogue_id, r.gap_idx): r.topic_cos for r in scoring.topic_cosine(own).collect()}
    assert set(cos) == {("d", 0), ("d", 1), ("d", 2), ("d", 3), ("f", 0)}
    assert cos["f", 0] == 1 and isclose(cos["d", 0], 2 / (sqrt(5) * sqrt(2))) and isclose(cos["d", 3], 2 / (sqrt(2) * sqrt(5)))
