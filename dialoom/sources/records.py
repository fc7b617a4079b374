"""Sources and sinks of records: JSON lines, folders of JSON files, replies, dialogues by domain, sessions by split, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

TURNS = "array<struct<speaker: string, text: string>>"
DIALOGUE = f"dialogue_id string, domain string, source_doc_id string, split string, target_turns int, persona string, opener string, utterances {TURNS}"
SESSION = f"session_id string, split string, num_sub_dialogues int, num_turns int, utterances {TURNS}, gold_boundaries array<int>, domain_sequence array<string>, source_doc_ids array<string>, source_dialogue_ids array<string>"
REPLY = "job_id string, output string, model string, stop_reason string, usage string"
#: Stop reasons of replies that are not whole.
FAILED_STOPS = ["refusal", "max_tokens", "length"]


def read_lines(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def read_objects(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """One JSON object in each .json file of a folder and those below it."""
    return spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(folder)


def read_reply_folder(spark: SparkSession, folder: str) -> DataFrame:
    """job_id and output of files <job_id>.json or <job_id>.txt."""
    files = spark.read.option("pathGlobFilter", "*.{json,txt}").text(folder, wholetext=True)
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    return files.select(F.regexp_replace(F.url_decode(name), r"\.(json|txt)$", "").alias("job_id"), F.col("value").alias("output"))


def latest_replies(lines: DataFrame, folder: DataFrame | None = None, order: str = "seq") -> DataFrame:
    """One reply for each job: the last by `order`; replies of a folder go before all lines."""
    own = lines.select("job_id", "output", F.col(order).cast("long").alias("seq"))
    if folder is not None:
        own = own.unionByName(folder.select("job_id", "output", F.lit((1 << 63) - 1).alias("seq")))
    last = F.row_number().over(W.partitionBy("job_id").orderBy(F.desc("seq"), "output"))
    return own.withColumn("place", last).where("place = 1").select("job_id", "output")


def whole_replies(replies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Replies that ended by themselves, and the others."""
    failed = F.coalesce(F.col("stop_reason").isin(FAILED_STOPS), F.lit(False)) | F.col("output").isNull()
    return replies.where(~failed), replies.where(failed)


def write_dialogues(dialogues: DataFrame, folder: str) -> None:
    """Appends dialogues that the folder does not have yet, by domain."""
    spark = dialogues.sparkSession
    fresh = dialogues
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        there = spark.read.schema("dialogue_id string").json(folder)
        fresh = dialogues.join(there, "dialogue_id", "left_anti")
    fresh.write.partitionBy("domain").mode("append").json(folder)


def write_sessions(sessions: DataFrame, folder: str) -> None:
    """Replaces the splits at hand and leaves others."""
    sessions.write.option("partitionOverwriteMode", "dynamic").partitionBy("split").mode("overwrite").json(folder)


def write_samples(samples: DataFrame, folder: str) -> None:
    """Samples or encoded pairs as Parquet, arrays without padding."""
    samples.write.mode("overwrite").parquet(folder)


def metric_line(metrics: DataFrame) -> DataFrame:
    """pk and wd of each row as one line, tab-separated, to 4 digits; null where nothing was scored."""
    return metrics.select(F.when(F.col("pk").isNotNull(), F.concat_ws("\t", F.round("pk", 4).cast("string"), F.round("wd", 4).cast("string"))).alias("line"))


def report(stats: DataFrame, checks: DataFrame) -> DataFrame:
    """One JSON text of the stats by split (columns that begin with _ left out) and the checks; both are a few rows."""
    keep = [c for c in stats.columns if not c.startswith("_")]
    a = stats.agg(F.collect_list(F.struct(*keep)).alias("stats"))
    b = checks.agg(F.collect_list(F.struct(*checks.columns)).alias("checks"))
    return a.crossJoin(F.broadcast(b)).select(F.to_json(F.struct("stats", "checks")).alias("report"))
