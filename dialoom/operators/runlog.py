"""Training logs as tables: epoch means, the best epoch so far, early stopping, choice of checkpoints and data-set names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def epoch_means(steps: DataFrame, *values: str) -> DataFrame:
    """run, epoch, n_steps and the mean of each value."""
    return steps.groupBy("run", "epoch").agg(F.count(F.lit(1)).alias("n_steps"), *[F.avg(v).alias(v) for v in values])


def early_stopping(epochs: DataFrame, value: str, patience: int = 2) -> DataFrame:
    """epochs(run, epoch, value) with best (least value so far), is_best (a new least), bad (epochs since then) and stopped: whether
    the run had ended before this epoch, `patience` bad epochs in a row having passed."""
    by = W.partitionBy("run").orderBy("epoch")
    upto = by.rowsBetween(W.unboundedPreceding, 0)
    rows = epochs.withColumn("before", F.min(value).over(by.rowsBetween(W.unboundedPreceding, -1)))
    rows = rows.withColumn("is_best", F.coalesce(F.col("before").isNull() | (F.col(value) < F.col("before")), F.lit(False)))
    rows = rows.withColumn("best", F.min(value).over(upto)).withColumn("island", F.sum(F.col("is_best").cast("int")).over(upto))
    rows = rows.withColumn("bad", F.row_number().over(W.partitionBy("run", "island").orderBy("epoch")) - 1)
    ended = F.coalesce(F.max((F.col("bad") >= patience).cast("int")).over(by.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("stopped", ended == 1).drop("before", "island")


def optimizer_steps(steps: DataFrame, accum: int) -> DataFrame:
    """Steps at which gradients gathered over `accum` steps are applied."""
    return steps.where((F.col("step") + 1) % accum == 0)


def checkpoints(files: DataFrame, start: int = 0, end: int = 3, suffix: str = ".pt") -> DataFrame:
    """The files(name) with the suffix, sorted, at places start .. end - 1."""
    place = F.row_number().over(W.orderBy("name")) - 1  # names of one run's files
    return files.where(F.col("name").endswith(suffix)).withColumn("place", place).where((F.col("place") >= start) & (F.col("place") < end))


def alias(name: Column, names: dict[str, str]) -> Column:
    """A known name's replacement, any other as it is."""
    pairs = [F.lit(x) for kv in names.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), name), name) if pairs else name
