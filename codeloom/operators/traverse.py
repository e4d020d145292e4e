"""Bounded traversals as loops over frontiers; no level holds more than the caller's budget or the level's distinct nodes."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions.relations import matches
from .checkpoints import cut, parted
from .filters import MOST_BROADCAST
from .retrieval import ranked, seed_scores


@dataclass(frozen=True)
class QueryOptions:
    depth: int = 2
    budget: int = 32
    mode: str = "bfs"
    relations: tuple[str, ...] = ()


def _ordered(edges: DataFrame) -> list[str]:
    return ["ord"] if "ord" in edges.columns else ["relation", "target_id", "confidence"]


def _kept(edges: DataFrame) -> DataFrame:
    """(source, target_id) persisted in even parts, so a hop's task reads as little as the set partitions say, a hub's edges
    in many of them; kept as they are read, a part is as large as a split of the files."""
    return parted(edges.select("source", "target_id"), "source", "target_id").persist()


def _step(frontier: DataFrame, pick: DataFrame) -> DataFrame:
    """(id): where the out-edges of frontier(id, hop) lead, once each. A small frontier goes to the edges."""
    near = frontier.select(F.col("id").alias("source"))
    near = F.broadcast(near) if frontier.count() <= MOST_BROADCAST else near
    return pick.join(near, "source").select(F.col("target_id").alias("id")).distinct()


def reach(edges: DataFrame, start: str, hops: int, relations: Iterable[str] = ()) -> DataFrame:
    """(id, hop): nodes that at most hops out-edges reach, start included, with the fewest hops. Cycles are safe."""
    spark = edges.sparkSession
    pick = _kept(edges.where(F.col("target_id").isNotNull() & matches(F.col("relation"), relations)))
    seen = spark.createDataFrame([(start, 0)], "id string, hop int")
    frontier = seen
    for hop in range(1, hops + 1):
        found = _step(frontier, pick)
        frontier = cut(found.join(seen.select("id"), "id", "left_anti").select("id", F.lit(hop).alias("hop")))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    pick.unpersist()
    return seen


def shortest_path(edges: DataFrame, nodes: DataFrame, source: str, target: str, max_hops: int = 8) -> list[str]:
    """The ids of a path of fewest out-edges, the least in id order among equals; empty if there is none within max_hops."""
    known = {r["id"] for r in nodes.where(F.col("id").isin(source, target)).select("id").distinct().collect()}
    if not {source, target} <= known:
        return []
    if source == target:
        return [source]
    pick = _kept(edges.where(F.col("target_id").isNotNull()))
    try:
        seen = edges.sparkSession.createDataFrame([(source, 0)], "id string, hop int")
        frontier = seen
        for hop in range(1, max_hops + 1):
            step = _step(frontier, pick)
            frontier = cut(step.join(seen.select("id"), "id", "left_anti").select("id", F.lit(hop).alias("hop")))
            if frontier.isEmpty():
                return []
            seen = seen.unionByName(frontier)
            if not frontier.where(F.col("id") == target).isEmpty():
                return _walk_back(seen, pick, source, target, hop)
        return []
    finally:
        pick.unpersist()


def _walk_back(seen: DataFrame, pick: DataFrame, source: str, target: str, hops: int) -> list[str]:
    """Of all shortest paths the least one: nodes that still lead to target are marked level by level, then followed greedily."""
    on = seen.sparkSession.createDataFrame([(target,)], "target_id string")
    levels = [on]
    for hop in range(hops - 1, 0, -1):
        at = seen.where(F.col("hop") == hop).select(F.col("id").alias("source"))
        on = cut(pick.join(on, "target_id", "left_semi").join(at, "source", "left_semi").select(F.col("source").alias("target_id")).distinct())
        levels.append(on)
    path, here = [source], source
    for on in reversed(levels):
        here = pick.where(F.col("source") == here).join(on, "target_id", "left_semi").agg(F.min("target_id").alias("t")).first()["t"]
        path.append(here)
    return path


def bfs(edges: DataFrame, seeds: DataFrame, options: QueryOptions) -> tuple[DataFrame, DataFrame]:
    """seeds(id, rank) -> (nodes(id, rank, depth), edges): the budgeted breadth-first region.

    Seeds come first in rank order; an expanded node offers its out-edges in edge order, and a node is taken by
    its first offer while the budget lasts. Edges of expanded nodes are returned even if their target isn't taken.
    """
    pick = edges.where(F.col("target_id").isNotNull() & matches(F.col("relation"), options.relations))
    order = _ordered(edges)
    level = cut(seeds.select("id", "rank").orderBy("rank").limit(options.budget).select("id", F.col("rank").cast("long").alias("rank"), F.lit(0).alias("depth")))
    taken, expanded, count = level, None, level.count()
    for depth in range(1, options.depth + 1):
        if level.isEmpty():
            break
        out = pick.join(F.broadcast(level.select(F.col("id").alias("source"), F.col("rank").alias("parent"))), "source")
        expanded = out if expanded is None else expanded.unionByName(out)
        room = options.budget - count
        if room <= 0:
            break
        offers = out.groupBy(F.col("target_id").alias("id")).agg(F.min(F.struct("parent", *order)).alias("at")).join(F.broadcast(taken.select("id")), "id", "left_anti")
        best = offers.orderBy("at", "id").limit(room)
        # at most the budget's rows are numbered
        level = cut(best.select("id", (F.row_number().over(Window.orderBy("at", "id")) + count).cast("long").alias("rank"), F.lit(depth).alias("depth")))
        count += level.count()
        taken = taken.unionByName(level)
    if expanded is None:
        expanded = pick.withColumn("parent", F.lit(0).cast("long")).limit(0)
    return taken, expanded.select(*edges.columns)


def dfs(edges: DataFrame, seeds: list[str], options: QueryOptions) -> tuple[list[tuple[str, int]], list[str]]:
    """(visited (id, depth) in order, ids expanded): the last seed first, then each node's last edge first.

    The stack holds one position for each node on it; the next edge is looked up when it is needed, a row at a time.
    """
    order = _ordered(edges)
    pick = edges.where(F.col("target_id").isNotNull() & matches(F.col("relation"), options.relations))
    visited: dict[str, int] = {}
    expanded: list[str] = []
    stack: list[list] = []  # [id, depth, targets not offered yet, as an iterator from the last edge]
    pending = [(s, 0) for s in seeds]

    def targets(node: str):
        rows = pick.where(F.col("source") == node).select("target_id", *(F.col(c).alias(f"o{k}") for k, c in enumerate(order)))
        return (r["target_id"] for r in rows.orderBy(*(F.desc(f"o{k}") for k in range(len(order)))).toLocalIterator())

    while (stack or pending) and len(visited) < options.budget:
        if stack:
            node = next(stack[-1][2], None)
            if node is None:
                stack.pop()
                continue
            depth = stack[-1][1] + 1
        else:
            node, depth = pending.pop()
        if node in visited:
            continue
        visited[node] = depth
        if depth < options.depth:
            expanded.append(node)
            stack.append([node, depth, targets(node)])
    return list(visited.items()), expanded


def query(nodes: DataFrame, edges: DataFrame, text: str, options: QueryOptions = QueryOptions()) -> tuple[DataFrame, DataFrame]:
    """(nodes(id, rank, depth), edges) around what text finds."""
    spark: SparkSession = nodes.sparkSession
    known = nodes.select(F.col("id").alias("target_id"))
    linked = edges.join(known, "target_id", "left_semi").select(*edges.columns)
    scores = seed_scores(nodes, text)
    if options.mode == "bfs":
        top = ranked(scores, options.budget)
        seeds = top.select("id", F.row_number().over(Window.orderBy(F.desc("score"), "label", "id")).alias("rank"))  # at most the budget's rows
        return bfs(linked, seeds, options)
    low = scores.orderBy("score", F.desc("label"), F.desc("id")).limit(options.budget).collect()
    visited, expanded = dfs(linked, [r["id"] for r in reversed(low)], options)
    rows = [(node, k + 1, depth) for k, (node, depth) in enumerate(visited)]
    out = linked.where(matches(F.col("relation"), options.relations) & F.col("source").isin(expanded))
    return spark.createDataFrame(rows, "id string, rank long, depth int"), out
