"""What the operators of this subpackage share: the shared folder, table access, Arrow batches and size-checked joins."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Word separators of every contract here: space and the five ASCII controls from tab to carriage return.
WS = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]"
#: A broadcast side is measured first and has at most so many bytes; beyond that the join is dealt by key.
MAX_BROADCAST_BYTES = 16 << 20
#: Rows and bytes of an Arrow batch: whole texts travel in them, so few.
BATCH_ROWS, BATCH_BYTES = 500, 8 << 20
_watchers: list[list[str]] = []


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS, size: int = BATCH_BYTES) -> None:
    """Bounds the Arrow batches that carry whole texts to Python by rows and bytes; smaller bounds already set stay. Spark reads
    the bounds when a query runs, not when it is made, so they are the session's from then on."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", size)):
        now = int(spark.conf.get(key).rstrip("b"))
        if now <= 0 or now > most:
            spark.conf.set(key, str(most))


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors and the driver see, from spark.checkpoint.dir. Where that is unset, a new local one, but only
    for a local master (tests): on a cluster the executors would not see it."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[[^-]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="dialoom-shared-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder of this run inside the shared one. What a returned DataFrame still reads stays there; see made_inside()."""
    folder = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    for made in _watchers:
        made.append(folder)
    return folder


@contextmanager
def made_inside() -> Iterator[list[str]]:
    """The scratch folders made inside, so that whoever has written the results can drop() them."""
    made: list[str] = []
    _watchers.append(made)
    try:
        yield made
    finally:
        _watchers[:] = [x for x in _watchers if x is not made]


@contextmanager
def passing_shuffles(spark: SparkSession) -> Iterator[None]:
    """Queries made and run inside leave no shuffle files behind; for those that run once."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def stored(df: DataFrame, folder: str, name: str) -> DataFrame:
    """df as a table of the scratch folder: cuts the lineage, and survives lost executors."""
    with passing_shuffles(df.sparkSession):
        df.write.parquet(f"{folder}/{name}")
    return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/{name}")


def drop(spark: SparkSession, path: str) -> None:
    """Removes a folder that nothing will read any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def measured(side: DataFrame) -> int:
    """About how many bytes the rows of `side` take, in one pass over it."""
    size = F.lit(24)
    for f in side.schema:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            size = size + 8 + F.coalesce(F.octet_length(c), F.lit(0))
        elif isinstance(f.dataType, T.ArrayType):
            size = size + 24 + 8 * F.coalesce(F.size(c), F.lit(0))
        else:
            size = size + 8
    return side.agg(F.sum(size.cast("long"))).first()[0] or 0


def sized_join(big: DataFrame, side: DataFrame, on: list[str], how: str = "left", limit: int = MAX_BROADCAST_BYTES, salts: int = 32) -> DataFrame:
    """big joined with a stored side that has one row for each key. The side is measured: up to `limit` bytes it is broadcast, so a
    hot key of `big` is never moved; beyond that both are dealt by key and salt, so a hot key is spread over `salts` tasks."""
    if measured(side) <= limit:
        return big.join(F.broadcast(side), on, how)
    if salts == 1:
        return big.join(side, on, how)
    salted = side.withColumn("__dl_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    dealt = big.withColumn("__dl_salt", F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in big.columns]), F.lit(salts)).cast("int"))
    return dealt.join(salted, [*on, "__dl_salt"], how).drop("__dl_salt")


def texts(batch: pa.RecordBatch, column: str = "text") -> pa.Array:
    """The text column with null as empty, as large_string (64-bit offsets)."""
    col = batch.column(batch.schema.get_field_index(column)).cast(pa.large_string())
    return col.fill_null("") if col.null_count else col


def gathered(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Joins small batches up to about `most` bytes. A larger single batch is cut by rows; one row is never cut."""
    held: list[pa.RecordBatch] = []
    size = 0

    def joined() -> pa.RecordBatch:
        return pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    for batch in batches:
        while batch.num_rows:
            n = batch.num_rows
            if batch.nbytes > most and n > 1:
                n = max(1, int(n * most / batch.nbytes))
            part, batch = batch.slice(0, n), batch.slice(n)
            if held and size + part.nbytes > most:
                yield joined()
                held, size = [], 0
            held.append(part)
            size += part.nbytes
    if held:
        yield joined()


def vocabulary(name: str) -> str:
    """The place of a public vocabulary file: in DIALOOM_TOKENIZERS if that is set, else where the installed package has it."""
    if folder := os.environ.get("DIALOOM_TOKENIZERS"):
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)
