"""Sources and sinks of records, logs, pluggable models and batches on small fixtures."""

import hashlib
import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from dialoom.operators import assemble, batches, encode, losses, runlog, scoring
from dialoom.sources import dialogue_text, records


def test_records_are_read(spark, tmp_path):
    (tmp_path / "l.jsonl").write_text('{"job_id": "a", "output": "old", "seq": 1}\n{"job_id": "a", "output": "new", "seq": 2}\n{"job_id": "b", "output": "x", "seq": 3}\n')
    lines = records.read_lines(spark, str(tmp_path / "l.jsonl"), "job_id string, output string, seq long")
    assert lines.count() == 3
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "b.json").write_text('{"y":\n1}')
    (tmp_path / "f" / "c d.txt").write_text("plain")
    (tmp_path / "f" / "e.md").write_text("not read")
    folder = records.read_reply_folder(spark, str(tmp_path / "f"))
    assert {(r.job_id, r.output) for r in folder.collect()} == {("b", '{"y":\n1}'), ("c d", "plain")}
    last = {(r.job_id, r.output) for r in records.latest_replies(lines, folder).collect()}
    assert last == {("a", "new"), ("b", '{"y":\n1}'), ("c d", "plain")}
    (tmp_path / "o" / "below").mkdir(parents=True)
    (tmp_path / "o" / "1.json").write_text('{\n "doc_id": "1"\n}')
    (tmp_path / "o" / "below" / "2.json").write_text('{"doc_id": "2"}')
    assert {r.doc_id for r in records.read_objects(spark, str(tmp_path / "o"), "doc_id string").collect()} == {"1", "2"}


def test_records_are_written(spark, tmp_path):
    names = "session_id string, split string, utterances array<string>"
    records.write_sessions(spark.createDataFrame([("t0", "train", ["a"]), ("v0", "val", ["b"])], names), str(tmp_path / "s"))
    records.write_sessions(spark.createDataFrame([("v1", "val", ["c"])], names), str(tmp_path / "s"))
    got = records.read_lines(spark, str(tmp_path / "s"), names)
    assert {(r.session_id, r.split) for r in got.collect()} == {("t0", "train"), ("v1", "val")}
    assert assemble.manifest(got).columns == ["session_id", "split"]
    records.write_samples(spark.createDataFrame([(1, [1, 2]), (2, [])], "i int, ids array<int>"), str(tmp_path / "p"))
    assert {(r.i, tuple(r.ids)) for r in spark.read.parquet(str(tmp_path / "p")).collect()} == {(1, (1, 2)), (2, ())}


def test_reports_and_logs(spark):
    scores = spark.createDataFrame([(0.123456, 0.5), (None, None)], "pk double, wd double")
    assert [r.line for r in records.metric_line(scores).collect()] == ["0.1235\t0.5", None]
    stats = spark.createDataFrame([("train", 3, 9)], "split string, n int, _hidden int")
    checks = spark.createDataFrame([("r", "OK")], "rule string, level string")
    assert json.loads(records.report(stats, checks).first().report) == {"stats": [{"split": "train", "n": 3}], "checks": [{"rule": "r", "level": "OK"}]}
    files = spark.createDataFrame([(n,) for n in ("c.pt", "a.pt", "b.pt", "d.pt", "a.txt")], "name string")
    assert [r.name for r in runlog.checkpoints(files, 1, 3).collect()] == ["b.pt", "c.pt"]
    steps = spark.createDataFrame([(i,) for i in range(7)], "step int")
    assert [r.step for r in runlog.optimizer_steps(steps, 3).collect()] == [2, 5]


@pytest.fixture
def dialogues(spark, tmp_path):
    for split, texts in (("train", ["one\ntwo\n================\nthree\n", "x\n"]), ("val", ["p\nq\n"])):
        (tmp_path / split).mkdir()
        for i, t in enumerate(texts):
            (tmp_path / split / f"{i}.txt").write_text(t)
    return dialogue_text.read_splits(spark, {s: str(tmp_path / s) for s in ("train", "val")})


def test_splits_and_limits(spark, tmp_path, dialogues):
    assert {(r.split, r.text) for r in dialogues.collect()} == {("train", "one"), ("train", "two"), ("train", "three"), ("train", "x"), ("val", "p"), ("val", "q")}
    assert {r.text for r in dialogue_text.read_dialogues(spark, str(tmp_path / "train"), max_docs=1).collect()} == {"one", "two", "three"}


def test_models_plug_in(dialogues):
    def scorer(contexts, following):
        return pd.Series([float(10 * len(a) + len(b)) for a, b in zip(contexts, following, strict=True)])

    scored = {("/".join(r.dialogue_id.split("/")[-2:]), r.gap_idx): r.coherence for r in scoring.with_pair_scorer(dialogues, scorer, width=2).collect()}
    assert set(scored) == {("train/0.txt", 0), ("train/0.txt", 1), ("val/0.txt", 0)} and scored["train/0.txt", 1] == 21.0
    vectors = scoring.embedded(dialogues, lambda texts: texts.map(lambda t: [float(len(t))]))
    assert sorted(v for r in vectors.collect() for v in r.embedding) == [1.0, 1.0, 1.0, 3.0, 3.0, 5.0]


def test_subwords_and_segments(spark, tmp_path):
    vocabulary = {"type": "WordLevel", "vocab": {"[UNK]": 0, "red": 5, "blue": 6}, "unk_token": "[UNK]"}
    (tmp_path / "v.json").write_text(json.dumps({"version": "1.0", "truncation": None, "padding": None, "added_tokens": [], "normalizer": None, "pre_tokenizer": {"type": "Whitespace"}, "post_processor": None, "decoder": None, "model": vocabulary}))
    rows = spark.createDataFrame([(0, ["red blue red", None]), (1, []), (2, None), (3, ["green"])], "i int, t array<string>")
    got = {r.i: r.x for r in rows.select("i", encode.subword_context_ids(F.col("t"), str(tmp_path / "v.json"), 9, 2).alias("x")).collect()}
    assert got == {0: [5, 6, 9, 9], 1: [], 2: None, 3: [0, 9]}
    texts = spark.createDataFrame([("new york",), (None,)], "t string")
    assert [r.x for r in texts.select(encode.segmented(F.col("t"), lambda t: t.replace(" ", "_")).alias("x")).collect()] == ["new_york", None]


def test_batches(spark):
    rows = spark.createDataFrame([(i, list(range(i % 5 + 1)), [0] * (i % 5 + 1)) for i in range(50)], "i int, input_ids array<int>, type_ids array<int>")
    own = batches.shuffled(rows, ["i"], 8, digits=1)
    order = sorted(range(50), key=lambda i: hashlib.md5(f"shuffle|{i}".encode()).hexdigest())
    assert [(r.i, r.batch) for r in own.orderBy("place").collect()] == [(i, p // 8) for p, i in enumerate(order)]
    out = batches.collated(own, "batch", pad=7).collect()
    for r in out:
        n, most = r.i % 5 + 1, max(q.i % 5 + 1 for q in out if q.batch == r.batch)
        assert (r.input_ids, r.attention_mask, r.type_ids) == (list(range(n)) + [7] * (most - n), [1] * n + [0] * (most - n), [0] * n + [1] * (most - n))
    assert batches.shuffled(rows.limit(0), ["i"], 8).count() == 0
    fixed = encode.fixed_length(spark.createDataFrame([(0, [3, 4], [0, 0]), (0, [5], [0]), (1, [6], [0])], "b int, input_ids array<int>, type_ids array<int>"), 4)
    assert sorted((r.b, len(r.input_ids), len(r.attention_mask)) for r in encode.trimmed(fixed, "b").collect()) == [(0, 2, 2), (0, 2, 2), (1, 1, 1)]


def test_training_loss(spark):
    samples = spark.createDataFrame([(0, 1.0, 0.5, 0.2, 0.1), (0, 0.0, 0.0, 0.0, 1.0), (1, 5.0, 0.0, 0.0, 0.0)], "batch int, pos_coherence double, pos_cos double, neg_coherence double, neg_cos double")
    topic = spark.createDataFrame([(0, 0.25)], "batch int, loss double")
    got = {r.batch: (r.n_samples, round(r.pair_loss, 6), r.topic_loss, round(r.loss, 6)) for r in losses.training_loss(samples, topic).collect()}
    assert got == {0: (2, 1.0, 0.25, 1.25), 1: (1, 0.0, 0.0, 0.0)}


def test_splits_that_share_texts(spark):
    from dialoom.operators import stats

    rows = [("train", 0, 0, 0, "Hello"), ("train", 0, 1, 0, "there"), ("val", 1, 0, 0, "Hello"), ("val", 1, 1, 0, "there"), ("val", 1, 2, 1, "other"), ("test", 2, 0, 0, "hello"), ("test", 2, 1, 0, "alone")]
    own = spark.createDataFrame(rows, "split string, dialogue_id int, utt_idx int, seg_rank int, text string")
    got = {(r.split_a, r.split_b): (r.shared_segments, r.shared_utterances) for r in stats.split_overlap(own).collect()}
    assert got == {("train", "val"): (1, 2), ("test", "train"): (0, 1), ("test", "val"): (0, 1)}
