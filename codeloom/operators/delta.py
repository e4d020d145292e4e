"""Patches of the graph: multiset differences of edges, merging a delta, guards."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from . import filters
from .checkpoints import parted

EDGE_COLUMNS = ["source", "relation", "confidence", "target_id", "target_name"]


def edge_diff(prior: DataFrame, emitted: DataFrame, columns: list[str] = EDGE_COLUMNS) -> tuple[DataFrame, DataFrame]:
    """(removed, added): the least patch from one multiset of edges to another.

    Edges are nearly all distinct, so they are counted only after the exchange, where a task's share is small: counted
    before it, a task holds all that it reads.
    """

    def more(a: DataFrame, b: DataFrame) -> DataFrame:
        signed = a.select(*columns, F.lit(1).alias("_n")).unionByName(b.select(*columns, F.lit(-1).alias("_n")))
        left = parted(signed, *columns, times=2).groupBy(*columns).agg(F.sum("_n").alias("_n")).where("_n > 0")
        return left.select(*columns, F.explode(F.array_repeat(F.lit(0), F.col("_n").cast("int"))).alias("_k")).select(*columns)

    return more(prior, emitted), more(emitted, prior)


def subtract(edges: DataFrame, removed: DataFrame, columns: list[str] = EDGE_COLUMNS) -> DataFrame:
    """edges less one copy for each row of removed. Edges that no filter of removed hits stay as they are, and where they are."""
    edges, removed = edges.select(*columns), removed.select(*columns)
    n = removed.count()
    if n == 0:
        return edges
    if n > filters.MOST_FILTERED:
        return edges.exceptAll(removed)
    maybe = edges.crossJoin(F.broadcast(filters.made(removed, n))).withColumn("_hit", filters.hit(n, *map(F.col, columns)))  # one row
    return maybe.where("NOT _hit").select(*columns).unionByName(maybe.where("_hit").select(*columns).exceptAll(removed))


def merge(nodes: DataFrame, edges: DataFrame, nodes_removed: DataFrame, nodes_added: DataFrame, edges_removed: DataFrame, edges_added: DataFrame, columns: list[str] = EDGE_COLUMNS) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) with a delta applied: removals, then nodes of new ids, then edges as a multiset, dangling ones dropped."""
    from .graph import prune_dangling

    kept = nodes.join(nodes_removed.select("id"), "id", "left_anti").select(*nodes.columns)
    new = nodes_added.join(kept.select("id"), "id", "left_anti").select(*nodes.columns).dropDuplicates(["id"])
    merged = kept.unionByName(new)
    return merged, prune_dangling(subtract(edges, edges_removed, columns).unionByName(edges_added.select(*columns)), merged)


def carried(prior: DataFrame, dropped: DataFrame, sites: DataFrame) -> DataFrame:
    """Prior edges that neither start nor end at a dropped(id) node and aren't made at a site(source, relation) linked again."""
    ids = dropped.select("id")
    kept = prior.join(ids.withColumnRenamed("id", "source"), "source", "left_anti")
    kept = kept.join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_anti")
    return kept.join(sites.select("source", "relation").distinct(), ["source", "relation"], "left_anti").select(*prior.columns)


def shrink_violations(removed: DataFrame, dirty_files: DataFrame) -> DataFrame:
    """Removed nodes of files that no change touched; nodes without a file are exempt."""
    return removed.where(F.col("source_file").isNotNull()).join(dirty_files.select(F.col("path").alias("source_file")), "source_file", "left_anti")


def numbered(edges: DataFrame, columns: list[str] = EDGE_COLUMNS) -> DataFrame:
    """edges with ord among those of one source: a stable order by content."""
    rest = [c for c in columns if c != "source"]
    return edges.withColumn("ord", F.row_number().over(Window.partitionBy("source").orderBy(*rest)))
