"""Small fixtures worked out by hand."""

import hashlib
import json
from collections import Counter
from itertools import count

from pyspark.sql import functions as F

from dialoom.functions import arrays, text
from dialoom.operators import assemble, compare, evalsplit, metrics, runlog, segment, synth
from dialoom.sources import dialogue_text, records
from dialoom.streaming.replies import ingest_available


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_depth_and_ties(spark):
    rows = [("d", i, s) for i, s in enumerate([0.5, 0.25, 0.25, 0.75, 0.5])]
    depths = segment.depth_scores(spark.createDataFrame(rows, "dialogue_id string, gap_idx int, score double"))
    assert [r.depth for r in depths.orderBy("gap_idx").collect()] == [0, 0.375, 0.375, 0, 0.125]
    assert segment.top_gaps(depths.withColumn("k", F.lit(1))).first().gap_idx == 2


def test_pk_and_windowdiff(spark):
    def score(ref, hyp):
        rows, n = [], sum(ref)
        for i in range(n):
            at = lambda m: next(k for k in range(len(m)) if i < sum(m[: k + 1]))
            rows.append(("d", i, at(ref), n, len(ref), at(hyp)))
        r = metrics.pk_windowdiff(spark.createDataFrame(rows, "dialogue_id string, utt_idx int, seg_rank int, n_utt int, n_seg int, hyp int")).first()
        return r.pk, r.wd

    assert score([3, 3], [2, 4]) == (0.5, 0.5)
    assert score([2, 2, 2], [2, 1, 3]) == (0.25, 0.5)
    assert score([2, 2], [2, 2]) == (0, 0)


def test_pair_budget(spark):
    def kept(a, b):
        ctx, nxt = arrays.pair_budget(F.array_repeat(F.lit(1), a), F.array_repeat(F.lit(1), b), 10)
        return one(spark, ctx), one(spark, nxt)

    assert [kept(6, 5), kept(2, 9), kept(9, 2), kept(3, 3)] == [(4, 4), (2, 6), (6, 2), (3, 3)]
    assert one(spark, arrays.tail(F.array(F.lit(1)), F.lit(0))) == []


def test_positions(spark):
    assert one(spark, arrays.even_boundaries(F.lit(10), F.lit(3))) == [1, 4, 7]
    assert one(spark, arrays.stride_boundaries(F.lit(10), F.lit(3))) == [2, 5, 8]
    assert one(spark, arrays.stride_boundaries(F.lit(3), F.lit(9))) == []


def test_quartiles(spark):
    counts = spark.createDataFrame([(i, i) for i in range(1, 9)], "dialogue_id int, n_tokens int")
    assert tuple(evalsplit.quartiles(counts).first()) == (3, 5, 7)


def test_text(spark):
    assert one(spark, text.respace_punctuation(F.lit("hi , there . ok ?"))) == "hi, there. ok?"
    assert one(spark, text.opener_word(F.lit("¡Ấy là"))) == "ấy"
    assert one(spark, text.has_closing_cue(F.lit("Chào chị."))) and not one(spark, text.has_closing_cue(F.lit("chào chị ạ")))
    assert one(spark, text.unfenced(F.lit('a ```json\n{"x": 1}\n``` b'))) == '{"x": 1}'
    assert one(spark, text.unfenced(F.lit("none"))) is None


def test_dialogue_folder(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\ntwo\n================\nthree\n", "utf-8")
    (tmp_path / "b.txt").write_text("================\nx\n================\n================\ny", "utf-8")
    rows = dialogue_text.read_dialogues(spark, str(tmp_path)).orderBy("dialogue_id", "utt_idx").collect()
    assert [(r.text, r.seg_rank, r.n_seg, r.n_utt) for r in rows] == [("one", 0, 2, 3), ("two", 0, 2, 3), ("three", 1, 2, 3), ("x", 0, 2, 2), ("y", 1, 2, 2)]
    lines = {r.lines for r in dialogue_text.session_lines(dialogue_text.read_dialogues(spark, str(tmp_path))).collect()}
    assert lines == {"one\ntwo\n================\nthree\n", "x\n================\ny\n"}
    dialogue_text.write_dialogues(dialogue_text.read_dialogues(spark, str(tmp_path)).withColumn("dialogue_id", F.regexp_extract("dialogue_id", r"(\w)\.txt", 1)), str(tmp_path / "out"))
    again = spark.read.text(str(tmp_path / "out"), wholetext=True).collect()
    assert {r.value for r in again} == lines


def test_replies_are_judged(spark):
    turns = [{"speaker": "citizen", "text": "a"}, {"speaker": "officer", "text": "b"}]
    jobs = spark.createDataFrame([(f"j{i}", 2) for i in range(8)], "job_id string, num_turns int")
    bad = [{"speaker": "officer", "text": "x"}]
    out = [("j0", json.dumps({"utterances": turns})), ("j1", json.dumps({"utterances": turns})), ("j2", "no"), ("j3", "{bad}"), ("j4", '{"utterances": []}'), ("j5", json.dumps({"utterances": bad})), ("j6", json.dumps({"utterances": turns * 3}))]
    existing = spark.createDataFrame([], "dialogue_id string, text_key string")
    got = {r.job_id: r.outcome for r in synth.outcomes(jobs, spark.createDataFrame(out, "job_id string, output string"), existing).collect()}
    assert got == {"j0": "accepted", "j1": "duplicate", "j2": "no_json", "j3": "bad_json", "j4": "no_utterances", "j5": "speaker_order", "j6": "turn_count", "j7": "missing_reply"}


def test_early_stopping(spark):
    rows = [(0, e, v) for e, v in enumerate([0.5, 0.4, 0.45, 0.41, 0.3])]
    out = runlog.early_stopping(spark.createDataFrame(rows, "run int, epoch int, val double"), "val", 2).orderBy("epoch").collect()
    assert [r.is_best for r in out] == [True, True, False, False, True]
    assert [r.stopped for r in out] == [False, False, False, False, True]


def test_record_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("d1", "x", "s"), ("d2", "y", "s")], "dialogue_id string, domain string, split string")
    records.write_dialogues(rows, str(tmp_path / "d"))
    records.write_dialogues(rows, str(tmp_path / "d"))
    assert spark.read.json(str(tmp_path / "d")).count() == 2


def test_reply_stream_runs_again(spark, tmp_path):
    (tmp_path / "in").mkdir()
    line = lambda j, stop: json.dumps({"job_id": j, "output": "{}", "stop_reason": stop}) + "\n"
    (tmp_path / "in" / "1.json").write_text(line("a", "end") + line("b", "max_tokens"))
    paths = [str(tmp_path / x) for x in ("in", "good", "bad", "ckpt")]
    ingest_available(spark, *paths)
    (tmp_path / "in" / "2.json").write_text(line("a", "end") + line("c", "end"))
    ingest_available(spark, *paths)
    assert sorted(r.job_id for r in spark.read.parquet(paths[1]).collect()) == ["a", "c"]
    assert [r.job_id for r in spark.read.parquet(paths[2]).collect()] == ["b"]


def test_the_last_reply_of_a_batch_stays(spark, tmp_path):
    from dialoom.streaming.replies import ingest_available

    (tmp_path / "in").mkdir()
    lines = ['{"job_id": "a", "output": "{\\"utterances\\": [%d]}"}' % k for k in range(3)]
    (tmp_path / "in" / "1.json").write_text("\n".join(lines))
    ingest_available(spark, f"{tmp_path}/in", f"{tmp_path}/good", f"{tmp_path}/bad", f"{tmp_path}/check")
    rows = [r.output for f in ("good", "bad") if (tmp_path / f).exists() for r in spark.read.parquet(f"{tmp_path}/{f}").collect()]
    assert rows == ['{"utterances": [2]}']


def test_prompts_are_filled_once_and_read_back(spark):
    from dialoom.operators import prompts
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([("1", 'tự xưng "em", gọi cán bộ là "chị".', "{b}"), ("2", "no", None), ("3", None, "x")], "job_id string, prompt string, a string")
    assert [r.address for r in prompts.addresses(rows).orderBy("dialogue_id").collect()] == ["em|chị", None, None]
    assert [r.x for r in rows.select(prompts.filled("<{a}|{b}>", {"a": F.col("a"), "b": F.lit("B")}).alias("x")).collect()] == ["<{b}|B>", "<|B>", "<x|B>"]
    facts = spark.createDataFrame([('{"a": [1, {"b": "c", "d": [true, null]}], "e": "é"}',), (None,), ("plain",)], "j string")
    assert [r.x for r in facts.select(prompts.fact_text("j").alias("x")).collect()] == ["a: 1; b: c; d: true; null; e: é", None, "plain"]


def test_duplicates_go_by_the_order_of_jobs(spark):
    from dialoom.operators import synth
    from pyspark.sql import functions as F

    reply = '{"utterances": [{"speaker": "citizen", "text": "hello"}, {"speaker": "officer", "text": "yes"}]}'
    jobs = spark.createDataFrame([("10_00", 2), ("2_00", 2), ("3_00", 2)], "job_id string, num_turns int")
    replies = spark.createDataFrame([("10_00", reply), ("2_00", reply)], "job_id string, output string")
    none = spark.createDataFrame([], "dialogue_id string, text_key string")
    assert {r.job_id: r.outcome for r in synth.outcomes(jobs, replies, none).collect()} == {"2_00": "accepted", "10_00": "duplicate", "3_00": "missing_reply"}
    turned = jobs.withColumn("seq", F.when(F.col("job_id") == "10_00", 0).otherwise(1))
    assert {r.job_id: r.outcome for r in synth.outcomes(turned, replies, none).collect()}["10_00"] == "accepted"



def test_coverage_counts_documents_of_either_side(spark):
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "dialogue_id int")
    assert tuple(compare.coverage(ids(1, 2, 3), ids(2, 3, 4, 5)).first()) == (3, 4, 2)
    assert tuple(compare.coverage(ids(), ids(7)).first()) == (0, 1, 0)


def _by_urn(rows, split, budget, least, most, same_domain, seed):
    """Sessions by drawing from an urn that holds each dialogue as often as it may still be used."""
    draw = (int(hashlib.md5(f"{seed}|{split}|{n}".encode()).hexdigest()[:8], 16) / 2**32 for n in count(1))
    left = Counter({r["dialogue_id"]: budget for r in rows})
    rows = sorted(rows, key=lambda r: r["dialogue_id"])

    def pull(among):
        urn = [r for r in among for _ in range(left[r["dialogue_id"]])]
        return urn[int(next(draw) * len(urn))]

    out = []
    for number in count():
        target = least + int(next(draw) * (most - least + 1))
        if not sum(left.values()):
            return out
        session = [pull(rows)]
        while len(session) < target:
            free = [r for r in rows if r not in session and left[r["dialogue_id"]] and (r["address"] or "") == (session[0]["address"] or "")]
            same = [r for r in free if r["domain"] == session[-1]["domain"] and r["source_doc_id"] != session[-1]["source_doc_id"]]
            other = [r for r in free if r["domain"] != session[-1]["domain"]]
            stay = next(draw) < same_domain
            if not same + other:
                break
            session.append(pull((same if stay else other) or (other if stay else same)))
        if len(session) < least:
            return out
        for p, r in enumerate(session):
            left[r["dialogue_id"]] -= 1
            out.append((split, f"{split}_{number:04d}", p, r["dialogue_id"], r["domain"], r["source_doc_id"]))


def test_sessions_are_assembled_as_by_an_urn(spark):
    names = "split string, dialogue_id string, domain string, source_doc_id string, address string, number int"
    rows = []
    for split, n in (("train", 60), ("val_in", 23), ("test_in", 2)):
        rows += [(split, f"{split}{i:03d}", f"dom{i * 7 % 5}", f"doc{i // 3}", (None, "a", "b")[i % 3], 1) for i in range(n)]
    dialogues = spark.createDataFrame(rows, names)
    keys = [c.split()[0] for c in names.split(", ")]
    for same_domain, seed in ((0.3, "42"), (0.9, "7"), (0.0, "1")):
        want = []
        for split, budget in (("train", 5), ("val_in", 3), ("test_in", 3)):
            own = [dict(zip(keys, r)) for r in rows if r[0] == split]
            want += _by_urn(own, split, budget, 3, 8, same_domain, seed)
        got = [tuple(r) for r in assemble.plan(dialogues, same_domain=same_domain, seed=seed).collect()]
        assert len(want) > 100 and sorted(got) == sorted(want)
    planned = assemble.plan(dialogues).cache()
    used = Counter(r.dialogue_id for r in planned.collect())
    assert assemble.unused(dialogues, planned).count() == len({r[0] for r in rows if r[1] not in used})
    assert all(n <= (5 if d.startswith("train") else 3) for d, n in used.items())
    apart = assemble.plan(dialogues, shards=4).join(dialogues.select("dialogue_id", "address"), "dialogue_id")
    assert assemble.plan(dialogues.limit(0)).count() == 0 and apart.count() > 0
