"""Freshness: change events in micro-batches onto the engine's state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..engine import Engine
from ..sources import changes as C

EVENTS = "project string, path string, op string, priority int, seq long"
#: Who asked for a change; of several in one batch the highest decides.
MANUAL, GIT, FILES = 3, 2, 1


def read_events(spark: SparkSession, directory: str, files_a_batch: int = 64) -> DataFrame:
    """JSON change events dropped into a directory, as a stream."""
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_a_batch).json(directory)


def settled(batch: DataFrame) -> DataFrame:
    """One change for each project and path: the one of highest priority, then the last; a removal followed by a change is one change."""
    best = Window.partitionBy("project", "path").orderBy(F.desc("priority"), F.desc("seq"))
    return batch.withColumn("_k", F.row_number().over(best)).where("_k = 1").drop("_k")


class Applier:
    """Applies micro-batches, one project after the other in order of priority; a batch that was applied before is passed over.

    Clustering is left until a batch brings nothing for a project, or every deferral batches.
    """

    def __init__(self, engines: dict[str, Engine], deferral: int = 8, gate: bool = True, on_report: Callable | None = None):
        self.engines, self.deferral, self.gate, self.on_report = engines, deferral, gate, on_report
        self._stale: dict[str, int] = {}
        self._last = -1

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        if batch_id <= self._last:
            return
        batch = settled(batch).persist()
        ranks = batch.groupBy("project").agg(F.max("priority").alias("p"), F.min("seq").alias("s")).orderBy(F.desc("p"), "s").collect()
        for row in ranks:
            engine = self.engines.get(row["project"])
            if engine is None:
                continue
            own = batch.where(F.col("project") == row["project"])
            signals = own.where(F.col("priority") < MANUAL).select("path", "op")
            if self.gate:
                signals = C.gate(signals, engine.listing(deep=False), engine.store.load()["manifest"])
            changes = own.where(F.col("priority") >= MANUAL).select("path", "op").unionByName(signals)
            report = engine.apply(changes, recluster=False)
            if report.changed:
                self._stale[row["project"]] = self._stale.get(row["project"], 0) + 1
            if self.on_report:
                self.on_report(row["project"], report)
        seen = {r["project"] for r in ranks}
        for project, n in list(self._stale.items()):
            if project not in seen or n >= self.deferral:
                self.engines[project].recluster()
                del self._stale[project]
        for engine in self.engines.values():
            if getattr(engine.store, "due", lambda: False)():
                engine.store.flush()
        batch.unpersist()
        self._last = batch_id


def run(events: DataFrame, applier: Applier, checkpoint: str, once: bool = True) -> StreamingQuery:
    writer = events.writeStream.foreachBatch(applier).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 second")).start()
