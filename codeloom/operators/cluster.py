"""Communities by modularity: order-true local moving for graphs of a checked size, synchronous moving beyond."""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from .checkpoints import cut
from .graph import cohesion, pair_weights

#: Pairs up to which the order-true pass runs in one task; a larger graph moves synchronously over the cluster.
MOST_PAIRS = 2_000_000


@dataclass(frozen=True)
class ClusterConfig:
    strategy: str = "simple"  # or "full": levels until none merges
    weighting: str = "uniform"  # or "confidence"
    resolution: float = 1.0
    most_pairs: int = MOST_PAIRS


def local_move(neighbors: list[dict[int, float]], degree: list[float], labels: list[int], total: float, resolution: float) -> list[int]:
    """Nodes in order take the community of greatest gain, candidates in ascending order, until a sweep changes nothing."""
    tot: dict[int, float] = defaultdict(float)
    for k, c in enumerate(labels):
        tot[c] += degree[k]
    moved = total > 0
    while moved:
        moved = False
        for k, near in enumerate(neighbors):
            own = labels[k]
            tot[own] -= degree[k]
            weight: dict[int, float] = defaultdict(float)
            weight[own] += 0.0
            for j, w in near.items():
                weight[labels[j]] += w
            scale = resolution * degree[k] / (2 * total)
            best, gain = own, weight[own] - scale * tot[own]
            for c in sorted(weight):
                g = weight[c] - scale * tot[c]
                if g > gain + 1e-12:
                    best, gain = c, g
            tot[best] += degree[k]
            if best != own:
                labels[k] = best
                moved = True
    return labels


def louvain(n: int, pairs: list[tuple[int, int, float]], start: list[int], config: ClusterConfig) -> list[int]:
    """Community of each of n nodes, numbered in first-seen order."""

    def dense(labels: list[int]) -> list[int]:
        seen: dict[int, int] = {}
        return [seen.setdefault(c, len(seen)) for c in labels]

    def level(size, links, degree, labels):
        near: list[dict[int, float]] = [{} for _ in range(size)]
        for a, b, w in links:
            near[a][b] = near[a].get(b, 0.0) + w
            near[b][a] = near[b].get(a, 0.0) + w
        return dense(local_move(near, degree, labels, total, config.resolution))

    degree = [0.0] * n
    for a, b, w in pairs:
        degree[a] += w
        degree[b] += w
    total = sum(w for *_, w in pairs)
    out = level(n, pairs, degree, list(start))
    if config.strategy == "simple":
        return out
    current, links = out, pairs
    while True:
        k = max(current, default=-1) + 1
        above, summed = [0.0] * k, defaultdict(float)
        for node, c in enumerate(current):
            above[c] += degree[node]
        for a, b, w in links:
            ca, cb = sorted((current[a], current[b]))
            if ca != cb:
                summed[ca, cb] += w
        links = [(a, b, w) for (a, b), w in sorted(summed.items())]
        degree = above
        nxt = level(k, links, degree, list(range(k)))
        if max(nxt, default=-1) + 1 == k:
            return out
        out = [nxt[c] for c in out]
        current = nxt


def _in_order(nodes: DataFrame, pairs: DataFrame, prior: DataFrame | None, config: ClusterConfig) -> DataFrame:
    """(node_id, group) by the order-true pass, nodes in id order, in one task: callers check the size."""
    start = nodes.select(F.col("id").alias("u"), F.lit(None).cast("string").alias("v"), F.lit(0.0).alias("w"))
    if prior is not None:
        start = start.join(prior.select(F.col("node_id").alias("u"), F.col("community_id").alias("c")), "u", "left")
    else:
        start = start.withColumn("c", F.lit(None).cast("long"))
    rows = start.unionByName(pairs.select("u", "v", "w", F.lit(None).cast("long").alias("c")))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ids = sorted(pdf.u[pdf.v.isna()])
        place = {node: k for k, node in enumerate(ids)}
        known = pdf[pdf.v.isna()].dropna(subset=["c"]).set_index("u").c.to_dict()
        shared: dict[int, int] = {}
        labels = []
        for k, node in enumerate(ids):
            labels.append(shared.setdefault(known[node], k) if node in known else k)
        links = pdf.dropna(subset=["v"]).sort_values(["u", "v"])
        pairs = [(place[a], place[b], w) for a, b, w in zip(links.u, links.v, links.w) if a in place and b in place]
        return pd.DataFrame({"node_id": ids, "group": pd.Series(louvain(len(ids), pairs, labels, config), dtype="int64")})

    return rows.withColumn("_one", F.lit(0)).groupBy("_one").applyInPandas(run, "node_id string, group long")


def _numbered(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ids(id, k, odd), both(u, v, w, odd)): nodes as numbers in id order, and each pair from either end. odd is of the id's hash."""
    ids = pairs.select(F.explode(F.array("u", "v")).alias("id")).distinct()
    ids = cut(ids.orderBy("id").select("id", F.monotonically_increasing_id().alias("k"), F.pmod(F.xxhash64("id"), F.lit(2)).cast("int").alias("odd")))
    ends = pairs
    for end in ("u", "v"):
        ends = ends.join(ids.select(F.col("id").alias(end), F.col("k").alias(f"{end}_k"), F.col("odd").alias(f"{end}_odd")), end).drop(end)
    side = lambda x, y: F.struct(F.col(f"{x}_k").alias("u"), F.col(f"{y}_k").alias("v"), "w", F.col(f"{x}_odd").alias("odd"))
    return ids, cut(ends.select(F.explode(F.array(side("u", "v"), side("v", "u"))).alias("e")).select("e.*"))


def _moved(both: DataFrame, labels: DataFrame, r: int, total: float, resolution: float) -> DataFrame:
    """labels(u, d, odd, c) after round r, with m where one moved: the nodes whose turn it is take the community of greatest gain."""
    turn = F.col("odd") == r % 2
    tot = labels.groupBy("c").agg(F.sum("d").alias("tot"))
    weights = both.where(turn).join(labels.select(F.col("u").alias("v"), "c"), "v").groupBy("u", "c").agg(F.sum("w").alias("k"))
    options = weights.join(tot, "c").join(labels.where(turn).select("u", "d", F.col("c").alias("own")), "u")
    rest = F.col("tot") - F.when(F.col("c") == F.col("own"), F.col("d")).otherwise(0.0)
    gain = F.col("k") - resolution * rest * F.col("d") / F.lit(total)
    best = options.groupBy("u").agg(F.max(F.struct(gain.alias("g"), (F.col("c") == F.col("own")).alias("o"), "c")).alias("b")).select("u", F.col("b.c").alias("best"))
    return cut(labels.join(best, "u", "left").select("u", "d", "odd", F.coalesce("best", "c").alias("c"), (F.coalesce("best", "c") != F.col("c")).alias("m")))


def _without_leaves(both: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(both, labels, leaves(u, y)) with the leaves of one node that move in the same rounds as one node y.

    A leaf has one neighbour, which has others. Its only option is that neighbour's community, so from its first turn on it
    and the leaves beside it have one label, and no round can tell them from one node of their weight.
    """
    at = both.groupBy("u").agg(F.count("*").alias("n"))
    single = both.join(at.where("n = 1").select("u"), "u", "left_semi")
    held = cut(single.join(at.where("n > 1").select(F.col("u").alias("v")), "v", "left_semi").join(labels.select("u", "d", "c"), "u").select("u", F.col("v").alias("p"), "odd", "d", "c", (-1 - 2 * F.col("v") - F.col("odd")).alias("y")))
    one = cut(held.groupBy("y", "p", "odd").agg(F.sum("d").alias("d"), F.max("c").alias("c")))
    gone = held.select("u")
    core = both.join(gone, "u", "left_anti").join(gone.withColumnRenamed("u", "v"), "v", "left_anti").select("u", "v", "w", "odd")
    owner = labels.select(F.col("u").alias("p"), F.col("odd").alias("p_odd"))
    core = core.unionByName(one.select(F.col("y").alias("u"), F.col("p").alias("v"), F.col("d").alias("w"), "odd"))
    core = core.unionByName(one.join(owner, "p").select(F.col("p").alias("u"), F.col("y").alias("v"), F.col("d").alias("w"), F.col("p_odd").alias("odd")))
    kept = labels.select("u", "d", "odd", "c").join(gone, "u", "left_anti").unionByName(one.select(F.col("y").alias("u"), "d", "odd", "c"))
    return cut(core), cut(kept), held.select("u", "y")


def _synchronous(nodes: DataFrame, pairs: DataFrame, config: ClusterConfig, rounds: int = 12) -> DataFrame:
    """(node_id, group string): in each round half of the nodes, in turns by hash, move to the community of greatest gain at once.

    Nodes are numbers in id order while they move. Both halves have had a turn after two rounds; then leaves are put together.
    """
    ids, both = _numbered(pairs)
    degree = both.groupBy("u", "odd").agg(F.sum("w").alias("d"))
    total = both.agg(F.sum("w")).first()[0] or 1.0
    labels, leaves = cut(degree.select("u", "d", "odd", F.col("u").alias("c"))), None
    still = 0
    for r in range(rounds):
        if r == 2:
            both, labels, leaves = _without_leaves(both, labels)
        moved = _moved(both, labels, r, total, config.resolution)
        labels = moved.drop("m")
        still = still + 1 if moved.where("m").isEmpty() else 0
        if still == 2:  # neither half has anything to move
            break
    labels = labels.select("u", "c")
    if leaves is not None:
        labels = labels.where("u >= 0").unionByName(leaves.join(labels.withColumnRenamed("u", "y"), "y").select("u", "c"))
    named = labels.join(ids.select(F.col("k").alias("u"), F.col("id").alias("node_id")), "u").join(ids.select(F.col("k").alias("c"), F.col("id").alias("group")), "c")
    return nodes.select(F.col("id").alias("node_id")).join(named.select("node_id", "group"), "node_id", "left").select("node_id", F.coalesce("group", "node_id").alias("group"))


def claims(overlaps: list[tuple[int, int, int]], order: list[int], prior_ids: list[int]) -> dict[int, int]:
    """Group -> community id. overlaps are (group, prior id, members shared); order lists groups by smallest member.

    Groups of greatest overlap choose first; each takes the free prior id that it shares most with, the smallest of
    equals. The others take the smallest ids that no prior community had.
    """
    by_group: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for group, prior, n in overlaps:
        by_group[group].append((-n, prior))
    place = {g: k for k, g in enumerate(order)}
    out, taken = {}, set()
    for group in sorted(by_group, key=lambda g: (min(by_group[g])[0], place[g])):
        for _, prior in sorted(by_group[group]):
            if prior not in taken:
                out[group] = prior
                taken.add(prior)
                break
    used, fresh = set(prior_ids) | taken, 0
    for group in order:
        if group not in out:
            while fresh in used:
                fresh += 1
            out[group] = fresh
            used.add(fresh)
    return out


def stabilize(groups: DataFrame, prior: DataFrame | None) -> DataFrame:
    """groups(node_id, group) -> (node_id, community_id), prior communities keeping their ids. Without a prior partition, ids
    number the groups by smallest member. Counts by group, never members, reach the driver."""
    least = groups.groupBy("group").agg(F.min("node_id").alias("first"))
    if prior is None or prior.isEmpty():
        ids = least.select("group", (F.row_number().over(Window.orderBy("first")) - 1).cast("long").alias("community_id"))  # a row for each community
    else:
        shared = groups.join(prior, "node_id").groupBy("group", "community_id").agg(F.count("*").alias("n")).collect()
        order = [r["group"] for r in least.orderBy("first").select("group").collect()]
        known = [r["community_id"] for r in prior.select("community_id").distinct().collect()]
        chosen = claims([(r["group"], r["community_id"], r["n"]) for r in shared], order, known)
        kind = dict(groups.dtypes)["group"]
        ids = groups.sparkSession.createDataFrame(list(chosen.items()), f"group {kind}, community_id long")
    return groups.join(ids, "group").select("node_id", "community_id")


def cluster(nodes: DataFrame, edges: DataFrame, config: ClusterConfig = ClusterConfig(), prior: DataFrame | None = None, prior_meta: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(partition(node_id, community_id), communities(id, label, size, cohesion_permille)) of the resolved edges of all relations."""
    pairs = cut(pair_weights(edges, config.weighting))
    if pairs.count() <= config.most_pairs and nodes.count() <= 2 * config.most_pairs:
        groups = _in_order(nodes, pairs, prior, config)
    else:
        groups = _synchronous(nodes, pairs, config)
    partition = cut(stabilize(cut(groups), prior))
    sizes = partition.groupBy("community_id").agg(F.count("*").alias("size"))
    meta = sizes.join(cohesion(pairs, partition), "community_id")
    meta = meta.join(prior_meta.select(F.col("id").alias("community_id"), F.col("label").alias("_kept")), "community_id", "left") if prior_meta is not None else meta.withColumn("_kept", F.lit(None).cast("string"))
    label = F.coalesce("_kept", F.concat(F.lit("Community "), F.col("community_id").cast("string")))
    return partition, meta.select(F.col("community_id").alias("id"), label.alias("label"), "size", F.col("permille").alias("cohesion_permille"))
