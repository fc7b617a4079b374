"""Folders of marker-delimited dialogues: one utterance in a line, a line that holds 16 equals signs closes a segment.

One reader for training and evaluation: lines are stripped, a last line without a line feed counts, empty files give no rows.
seg_rank is the rank of non-empty segments, so leading, trailing and doubled markers change nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

MARKER = "=" * 16


def is_marker(line: Column) -> Column:
    return line.contains(MARKER)


def parse(files: DataFrame) -> DataFrame:
    """files(dialogue_id, value), whole texts -> dialogue_id, utt_idx, seg_rank, n_utt, n_seg, text."""
    plain = F.regexp_replace("value", "\r\n?", "\n")
    lines = files.select("dialogue_id", F.posexplode(F.split(F.regexp_replace(plain, r"\n\z", ""), "\n")).alias("line_no", "line"))
    lines = lines.withColumn("text", F.trim("line"))
    by = W.partitionBy("dialogue_id").orderBy("line_no")
    lines = lines.withColumn("seg_id", F.sum(is_marker(F.col("text")).cast("int")).over(by)).where(~is_marker(F.col("text")))
    out = lines.where("text <> '' or line_no > 0").select(
        "dialogue_id",
        (F.row_number().over(by) - 1).alias("utt_idx"),
        (F.dense_rank().over(W.partitionBy("dialogue_id").orderBy("seg_id")) - 1).alias("seg_rank"),
        "text",
    )
    all_of = W.partitionBy("dialogue_id")
    return out.withColumn("n_utt", F.count(F.lit(1)).over(all_of).cast("int")).withColumn("n_seg", (F.max("seg_rank").over(all_of) + 1).cast("int"))


def read_dialogues(spark: SparkSession, *folders: str, max_docs: int | None = None) -> DataFrame:
    """All dialogues of the folders, or the first `max_docs` by path (a limit that callers ask for); dialogue_id is the file's
    path. Files whose names begin with a dot or underscore are not read."""
    files = spark.read.text(list(folders), wholetext=True).select(F.col("_metadata.file_path").alias("dialogue_id"), "value")
    if max_docs is not None:
        files = files.orderBy("dialogue_id").limit(max_docs)
    return parse(files)


def read_splits(spark: SparkSession, splits: dict[str, str], max_docs: int | None = None) -> DataFrame:
    """read_dialogues() of each split's folder with the split's name."""
    out = None
    for name, folder in splits.items():
        part = read_dialogues(spark, folder, max_docs=max_docs).withColumn("split", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def session_lines(utterances: DataFrame) -> DataFrame:
    """dialogue_id and lines: the text of a dialogue file. Line breaks inside an utterance become spaces."""
    line = F.regexp_replace("text", r"[\r\n]+", " ")
    after = F.when(F.lead("seg_rank").over(W.partitionBy("dialogue_id").orderBy("utt_idx")) != F.col("seg_rank"), F.array(line, F.lit(MARKER))).otherwise(F.array(line))
    rows = utterances.withColumn("own", after).groupBy("dialogue_id").agg(F.array_sort(F.collect_list(F.struct("utt_idx", "own"))).alias("rows"))
    return rows.select("dialogue_id", F.concat(F.array_join(F.flatten(F.transform("rows", lambda x: x["own"])), "\n"), F.lit("\n")).alias("lines"))


def write_dialogues(utterances: DataFrame, folder: str) -> None:
    """One folder for each dialogue with its file, written anew."""
    session_lines(utterances).select(F.col("dialogue_id").cast("string").alias("dialogue"), F.expr("rtrim('\n', lines)").alias("value")).write.mode("overwrite").partitionBy("dialogue").text(folder)
