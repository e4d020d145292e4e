"""Versioned Parquet state: each version a directory, the newest named by an atomically replaced pointer."""

from __future__ import annotations

import json
import os
import shutil
import time
from collections import OrderedDict

from pyspark.sql import DataFrame, SparkSession

TABLES = {
    "nodes": "id string, label string, kind string, source_file string, span_start int, span_end int, attrs map<string,string>",
    "edges": "source string, relation string, confidence string, target_id string, target_name string, recv string",
    "refs": "source string, relation string, name string, type_hint string, specifier string, imported string, recv_opaque boolean, recv_returns string, recv_returns_owner string",
    "exports": "file string, pos int, kind string, name string, specifier string, imported string",
    "projects": "root string, manifest string, name string, entry string, deps array<string>",
    "manifest": "path string, hash string, mtime_ns long, revision string",
    "partition": "node_id string, community_id long",
    "communities": "id long, label string, size long, cohesion_permille int",
}


class ShrinkRefused(RuntimeError):
    """The new state has fewer nodes than the stored one."""


def empty(spark: SparkSession) -> dict[str, DataFrame]:
    return {name: spark.createDataFrame([], schema) for name, schema in TABLES.items()}


def write_atomically(path: str, text: str) -> None:
    temporary = f"{path}.{os.getpid()}.tmp"
    with open(temporary, "w", encoding="utf-8") as f:
        f.write(text)
        f.flush()
        os.fsync(f.fileno())
    os.replace(temporary, path)


class Store:
    """State of one project under a shared directory; a reader sees a whole version or the one before."""

    def __init__(self, spark: SparkSession, directory: str, keep: int = 2):
        self.spark, self.directory, self.keep = spark, directory, keep

    def _pointer(self) -> dict:
        try:
            with open(os.path.join(self.directory, "CURRENT"), encoding="utf-8") as f:
                return json.load(f)
        except FileNotFoundError:
            return {"version": 0, "nodes": 0}

    def load(self) -> dict[str, DataFrame]:
        version = self._pointer()["version"]
        if not version:
            return empty(self.spark)
        return {name: self.spark.read.schema(schema).parquet(f"{self.directory}/v={version}/{name}") for name, schema in TABLES.items()}

    def save(self, state: dict[str, DataFrame], force: bool = False) -> int:
        """The new version's number. Fewer nodes than before are refused unless forced; a broken write leaves the old version."""
        now = self._pointer()
        version = now["version"] + 1
        target = f"{self.directory}/v={version}"
        shutil.rmtree(target, ignore_errors=True)
        nodes = state["nodes"].count()
        if nodes < now["nodes"] and not force:
            raise ShrinkRefused(f"{nodes} nodes, {now['nodes']} before")
        for name, schema in TABLES.items():
            columns = [c.split()[0] for c in schema.replace("map<string,string>", "map").split(", ")]
            state[name].select(*columns).write.mode("overwrite").parquet(f"{target}/{name}")
        write_atomically(os.path.join(self.directory, "CURRENT"), json.dumps({"version": version, "nodes": nodes}))
        for old in range(version - self.keep, 0, -1):
            path = f"{self.directory}/v={old}"
            if not os.path.exists(path):
                break
            shutil.rmtree(path, ignore_errors=True)
        return version


class MemoryStore:
    """State in the session alone."""

    def __init__(self, spark: SparkSession):
        self.state, self.nodes = empty(spark), 0

    def load(self) -> dict[str, DataFrame]:
        return self.state

    def save(self, state: dict[str, DataFrame], force: bool = False) -> int:
        nodes = state["nodes"].count()
        if nodes < self.nodes and not force:
            raise ShrinkRefused(f"{nodes} nodes, {self.nodes} before")
        self.state, self.nodes = state, nodes
        return 0


class DeferredStore:
    """Write-behind over another store: states are kept at once and written when idle or dirty for long enough."""

    def __init__(self, store: Store | MemoryStore, idle: float = 30.0, most: float = 300.0, clock=time.monotonic):
        self.store, self.idle, self.most, self.clock = store, idle, most, clock
        self._state: dict[str, DataFrame] | None = None
        self._dirty_since = self._touched = 0.0
        self._force = False

    def load(self) -> dict[str, DataFrame]:
        return self._state if self._state is not None else self.store.load()

    def save(self, state: dict[str, DataFrame], force: bool = False) -> int:
        now = self.clock()
        if self._state is None:
            self._dirty_since = now
        self._state, self._touched, self._force = state, now, self._force or force
        return 0

    def due(self) -> bool:
        now = self.clock()
        return self._state is not None and (now - self._touched >= self.idle or now - self._dirty_since >= self.most)

    def flush(self) -> bool:
        """Writes what is dirty; also to be called before the store is dropped."""
        if self._state is None:
            return False
        self.store.save(self._state, self._force)
        self._state, self._force = None, False
        return True


class StateCache:
    """The states used last, by project; one that is put out is flushed first."""

    def __init__(self, capacity: int = 8):
        self.capacity, self._held = capacity, OrderedDict()

    def get(self, key: str, make):
        if key in self._held:
            self._held.move_to_end(key)
            return self._held[key]
        found = self._held[key] = make()
        while len(self._held) > self.capacity:
            _, gone = self._held.popitem(last=False)
            if hasattr(gone, "flush"):
                gone.flush()
        return found

    def __contains__(self, key: str) -> bool:
        return key in self._held
