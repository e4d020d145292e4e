"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Rows of an Arrow batch at most: rows hold whole texts, of which the default of 10,000 fills tens of megabytes.
BATCH_ROWS = 1000
#: Bytes of (compressed) input whose texts one group of a grouped Python stage holds on average.
BUCKET_BYTES = 5 << 19


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's rows of an Arrow batch to BATCH_ROWS, which bounds what a Python worker holds at once."""
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(setting, "0")) <= BATCH_ROWS:
        spark.conf.set(setting, str(BATCH_ROWS))


def id_type(docs: DataFrame, name: str = "doc_id") -> str:
    """binary for binary ids, long for all others."""
    return "binary" if docs.schema[name].dataType.typeName() == "binary" else "long"


def texts(docs: DataFrame) -> DataFrame:
    """doc_id and text alone, so that no other column of the input can clash; a null text is empty."""
    small_batches(docs.sparkSession)
    return docs.select(
        docs["doc_id"].cast(id_type(docs)).alias("doc_id"),
        F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"),
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or one of our own where it is unset and all runs on this machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        context = spark.sparkContext
        if not context._jsc.sc().getCheckpointDir().isDefined():
            if not context.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            context.setCheckpointDir(os.path.join(tempfile.gettempdir(), f"codeloom-{uuid.uuid4().hex}"))
        found = context._jsc.sc().getCheckpointDir().get()
    return found


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing uses yet."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder with its lineage cut; survives lost executors."""
    spark = df.sparkSession
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def estimated_bytes(df: DataFrame) -> int:
    """The optimizer's estimate of df's size; for file scans the size of the files read."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def buckets_for(df: DataFrame, per_bucket: int = BUCKET_BYTES, most: int = 1 << 24) -> int:
    """How many hash buckets keep each one near per_bucket bytes; grows with the input."""
    return max(8, min(most, estimated_bytes(df) // per_bucket + 1))


def hex16(column: Column) -> Column:
    return F.lower(F.lpad(F.hex(column), 16, "0"))


#: Keys that are broadcast at most (16 bytes each); more are joined by an exchange.
BROADCAST_KEYS = 500_000


def keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with a column of 128-bit hashes of doc_id and text, which equal rows share, and that column's name, new to docs."""
    name = "_row_key"
    while name.lower() in (c.lower() for c in docs.columns):
        name += "_"
    of = docs["doc_id"].cast("long"), docs["text"].cast("string")
    key = F.unhex(F.concat(hex16(F.xxhash64(*of)), hex16(F.xxhash64(F.lit("second"), *of))))
    return docs.withColumn(name, key), name


def without(docs: DataFrame, key: str, gone: DataFrame) -> DataFrame:
    """keyed docs less the rows whose key is in gone(doc_id), with the key dropped. Few keys are broadcast, which leaves the texts where they are."""
    gone = cut(gone.select(F.col("doc_id").alias(key)).distinct())
    few = gone.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS
    return docs.join(F.broadcast(gone) if few else gone, key, "left_anti").drop(key)
