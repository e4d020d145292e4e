"""Cutting lineage in loops, in the folder that executors share; exchanges whose parts stay as small as they are set."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """df computed once, its lineage cut; spark.checkpoint.dir holds it, or a folder of our own where that is unset."""
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(df.sparkSession.conf.get("spark.checkpoint.dir", None) or os.path.join(tempfile.gettempdir(), f"codeloom-{uuid.uuid4().hex}"))
    return df.checkpoint(eager=True)


def parted(df: DataFrame, *columns: str, times: int = 1) -> DataFrame:
    """df exchanged by columns into times the set shuffle partitions; adaptive execution would put parts together by their
    compressed size, of which rows in a task's hash table take ten times as much."""
    return df.repartition(times * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *columns)
