"""Replies as a stream of JSON lines files: each run takes what is new, drops jobs that are done and appends, then stops."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dialoom.sources.records import REPLY, whole_replies


def ingest_available(spark: SparkSession, incoming: str, replies: str, failed: str, checkpoint: str) -> None:
    """Appends whole replies of new files in `incoming` to the Parquet folder `replies`, others to `failed`; a job has one row.
    Run again after any failure: the checkpoint knows the files, and a batch that was written in part is found and left out."""

    def there(folder: str) -> DataFrame:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            return spark.read.schema(REPLY).parquet(folder)
        return spark.createDataFrame([], REPLY)

    def append(batch: DataFrame, _: int) -> None:
        good, bad = whole_replies(batch)
        # Lines of a file come in order, so the last of a job's replies stays, however often the batch is run.
        seq = F.monotonically_increasing_id()
        last = good.withColumn("seq", seq).groupBy("job_id").agg(F.max_by(F.struct(*good.columns), "seq").alias("x")).select("x.*")
        last.join(there(replies).select("job_id"), "job_id", "left_anti").write.mode("append").parquet(replies)
        bad.dropDuplicates(["job_id"]).join(there(failed).select("job_id"), "job_id", "left_anti").write.mode("append").parquet(failed)

    stream = spark.readStream.schema(REPLY).json(incoming)
    stream.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
