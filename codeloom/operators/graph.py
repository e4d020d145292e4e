"""Read operators on nodes(id, label, kind, ...), edges(source, relation, confidence, target_id, target_name, ...) and partition(node_id, community_id)."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.relations import AMBIGUOUS, EXTRACTED, INFERRED, is_structural, matches
from . import filters
from .checkpoints import cut


def _with_ends(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose source exists and whose target, if there is one, exists.

    Only ends travel, each once a task, to find the absent ones; edges are told apart where they are: by the absent ids, or
    by a filter of them and the few existing ids that it hits as well. Edges travel only if more ids are absent than a filter holds.
    """
    ids = nodes.select("id")
    ends = edges.select(F.explode(F.array("source", "target_id")).alias("id")).where(F.col("id").isNotNull()).distinct()
    absent = cut(ends.join(ids, "id", "left_anti"))
    n = absent.count()
    edges = edges.where(F.col("source").isNotNull())
    if n == 0:
        return edges
    renamed = lambda df, name: df.withColumnRenamed("id", name)
    if n <= filters.MOST_BROADCAST:
        kept = edges.join(F.broadcast(renamed(absent, "source")), "source", "left_anti")
        return kept.join(F.broadcast(renamed(absent, "target_id")), "target_id", "left_anti").select(*edges.columns)
    if n <= filters.MOST_FILTERED:
        bits = F.broadcast(filters.made(absent, n))  # one row
        there = cut(ids.crossJoin(bits).where(filters.hit(n, F.col("id"))).select("id").distinct())
        if there.count() <= filters.MOST_BROADCAST:
            tested = edges.crossJoin(bits).withColumn("_s", filters.hit(n, F.col("source"))).withColumn("_t", F.col("target_id").isNotNull() & filters.hit(n, F.col("target_id"))).drop("_bits")
            for end, mark in (("source", "_is"), ("target_id", "_it")):
                tested = tested.join(F.broadcast(renamed(there, end).withColumn(mark, F.lit(True))), end, "left")
            return tested.where((~F.col("_s") | F.col("_is").isNotNull()) & (~F.col("_t") | F.col("_it").isNotNull())).select(*edges.columns)
    kept = edges.join(renamed(ids, "source"), "source", "left_semi")
    named = kept.where(F.col("target_id").isNull())
    bound = kept.where(F.col("target_id").isNotNull()).join(renamed(ids, "target_id"), "target_id", "left_semi")
    return named.select(*edges.columns).unionByName(bound.select(*edges.columns))


def resolved(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose source and target both exist (the view that traversals and degrees use)."""
    return _with_ends(edges.where(F.col("target_id").isNotNull()), nodes)


def prune_dangling(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose source exists and whose target, if it is resolved, exists."""
    return _with_ends(edges, nodes)


def neighbors(edges: DataFrame, nodes: DataFrame, node_id: str, relations: Iterable[str] = (), direction: str = "both") -> DataFrame:
    """(direction, relation, confidence, id, label, kind): nodes one resolved edge away; a self loop is seen from both ends."""
    entries, parts = list(relations), []
    pick = edges.where(matches(F.col("relation"), entries) & F.col("target_id").isNotNull())
    if direction in ("out", "both"):
        parts.append(pick.where(F.col("source") == node_id).select(F.lit("out").alias("direction"), "relation", "confidence", F.col("target_id").alias("id")))
    if direction in ("in", "both"):
        parts.append(pick.where(F.col("target_id") == node_id).select(F.lit("in").alias("direction"), "relation", "confidence", F.col("source").alias("id")))
    found = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    known = nodes.join(F.broadcast(nodes.where(F.col("id") == node_id).limit(1).select(F.lit(1).alias("here"))), how="left_semi")
    return found.join(known.select("id", "label", "kind"), "id").select("direction", "relation", "confidence", "id", "label", "kind")


def unresolved_out(edges: DataFrame, node_id: str) -> DataFrame:
    """What a node names without a target."""
    return edges.where((F.col("source") == node_id) & F.col("target_id").isNull())


def unresolved_in_by_label(edges: DataFrame, nodes: DataFrame, label: str) -> DataFrame:
    """Nodes with an edge that names label without a target, a row for each edge."""
    named = edges.where(F.col("target_id").isNull() & (F.col("target_name") == label))
    return named.join(nodes.withColumnRenamed("id", "source"), "source").select(F.col("source").alias("id"), "label", "kind", "relation", "confidence")


def nodes_by_label(nodes: DataFrame, label: str, source: str | None = None) -> DataFrame:
    found = nodes.where(F.col("label") == label)
    return found if source is None else found.where(F.col("source_file") == source)


def ambiguous_labels(nodes: DataFrame) -> DataFrame:
    """(label, n, first_id) of labels that several nodes have."""
    return nodes.groupBy("label").agg(F.count("*").alias("n"), F.min("id").alias("first_id")).where(F.col("n") > 1)


def degrees(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, n_in, n_out): resolved edges in, all edges out, of every node."""
    ends = edges.select(F.col("source").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")).unionByName(
        edges.where(F.col("target_id").isNotNull()).select(F.col("target_id").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o"))
    )
    counted = ends.groupBy("id").agg(F.sum("i").alias("n_in"), F.sum("o").alias("n_out"))
    return nodes.select("id").join(counted, "id", "left").select("id", F.coalesce("n_in", F.lit(0)).alias("n_in"), F.coalesce("n_out", F.lit(0)).alias("n_out"))


def _semantic_ends(edges: DataFrame) -> DataFrame:
    """(id, degree): semantic resolved edges at either end."""
    pick = edges.where(~is_structural(F.col("relation")) & F.col("target_id").isNotNull())
    return pick.select(F.explode(F.array("source", "target_id")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))


def _degrees_of(nodes: DataFrame, counted: DataFrame) -> DataFrame:
    return nodes.select("id", "label", "kind").join(counted, "id", "left").select("id", "label", "kind", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))


def semantic_degrees(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, label, kind, degree): semantic resolved edges at either end; a self loop counts twice, a node without any has 0."""
    return _degrees_of(nodes, _semantic_ends(edges))


def god_nodes(edges: DataFrame, nodes: DataFrame, top: int = 10) -> DataFrame:
    """The top nodes by semantic degree over edges whose ends exist; ties by label, then id."""
    counted = cut(_semantic_ends(edges))
    if not counted.join(nodes.select("id"), "id", "left_anti").isEmpty():
        counted = _semantic_ends(resolved(edges, nodes))
    return _degrees_of(nodes, counted).orderBy(F.desc("degree"), "label", "id").limit(top)


def stats(nodes: DataFrame, edges: DataFrame, communities: DataFrame) -> DataFrame:
    """One row: nodes, edges, communities, and edges by confidence (an unresolved edge counts as extracted)."""
    by = [F.count(F.when(F.col("confidence") == c, 1)).alias(f"n_{c.lower()}") for c in (EXTRACTED, INFERRED, AMBIGUOUS)]
    parts = nodes.agg(F.count("*").alias("n_nodes")), edges.agg(F.count("*").alias("n_edges"), *by), communities.agg(F.count("*").alias("n_communities"))
    return parts[0].crossJoin(parts[1]).crossJoin(parts[2])  # one row each


def confidence_mix(edges: DataFrame) -> DataFrame:
    """(confidence, n, percent), percent rounded to whole numbers of all edges."""
    counted = edges.groupBy("confidence").agg(F.count("*").alias("n"))
    total = counted.agg(F.sum("n").alias("total"))
    return counted.crossJoin(F.broadcast(total)).select("confidence", "n", F.round(F.col("n") * 100.0 / F.col("total")).cast("int").alias("percent"))


def community_labels(edges: DataFrame, nodes: DataFrame, partition: DataFrame) -> DataFrame:
    """(community_id, label): the label of each community's node of most semantic edges, unresolved ones at their source
    included; ties by label."""
    pick = edges.where(~is_structural(F.col("relation")))
    ends = pick.select(F.col("source").alias("id")).unionByName(pick.where(F.col("target_id").isNotNull()).select(F.col("target_id").alias("id")))
    counted = ends.groupBy("id").agg(F.count("*").alias("degree"))
    members = partition.join(nodes.select(F.col("id").alias("node_id"), "label"), "node_id").join(counted.withColumnRenamed("id", "node_id"), "node_id", "left")
    rank = F.struct(-F.coalesce("degree", F.lit(0)), F.col("label"))
    return members.groupBy("community_id").agg(F.min_by("label", rank).alias("label"))


def pair_weights(edges: DataFrame, weighting: str = "uniform") -> DataFrame:
    """(u, v, w) with u < v: resolved edges of all relations without direction, the greatest weight of a pair's edges."""
    weight = F.lit(1.0) if weighting == "uniform" else F.when(F.col("confidence") == EXTRACTED, 1.0).when(F.col("confidence") == INFERRED, 0.5).otherwise(0.25)
    pick = edges.where(F.col("target_id").isNotNull() & (F.col("source") != F.col("target_id")))
    return pick.groupBy(F.least("source", "target_id").alias("u"), F.greatest("source", "target_id").alias("v")).agg(F.max(weight).alias("w"))


def cohesion(pairs: DataFrame, partition: DataFrame) -> DataFrame:
    """(community_id, permille): weight inside a community over that plus what leaves it; 1000 where there is neither."""
    u = partition.select(F.col("node_id").alias("u"), F.col("community_id").alias("cu"))
    v = partition.select(F.col("node_id").alias("v"), F.col("community_id").alias("cv"))
    at = pairs.join(u, "u").join(v, "v")
    same = F.col("cu") == F.col("cv")
    ends = at.select(F.explode(F.when(same, F.array("cu")).otherwise(F.array("cu", "cv"))).alias("community_id"), F.when(same, F.col("w")).otherwise(0.0).alias("inner"), F.when(same, 0.0).otherwise(F.col("w")).alias("outer"))
    summed = ends.groupBy("community_id").agg(F.sum("inner").alias("i"), F.sum("outer").alias("o"))
    share = F.when(F.coalesce(F.col("i") + F.col("o"), F.lit(0.0)) == 0, 1000.0).otherwise(F.col("i") * 1000.0 / (F.col("i") + F.col("o")))
    return partition.select("community_id").distinct().join(summed, "community_id", "left").select("community_id", F.round(share).cast("int").alias("permille"))


def community_members(nodes: DataFrame, partition: DataFrame, community_id: int) -> DataFrame:
    return partition.where(F.col("community_id") == community_id).join(nodes.withColumnRenamed("id", "node_id"), "node_id").select(F.col("node_id").alias("id"), "label", "kind")


def community_summaries(edges: DataFrame, nodes: DataFrame, partition: DataFrame) -> DataFrame:
    """(community_id, label, size, permille); a community's members are community_members' rows."""
    sizes = partition.groupBy("community_id").agg(F.count("*").alias("size"))
    return sizes.join(community_labels(edges, nodes, partition), "community_id", "left").join(cohesion(pair_weights(edges), partition), "community_id", "left").select("community_id", "label", "size", "permille")


def list_communities(summaries: DataFrame, limit: int = 20) -> DataFrame:
    """The largest communities with the number of all; ties by id."""
    total = summaries.agg(F.count("*").alias("n_total"))
    return summaries.crossJoin(F.broadcast(total)).orderBy(F.desc("size"), "community_id").limit(limit)


def bridges(edges: DataFrame, partition: DataFrame) -> DataFrame:
    """Semantic resolved edges from one community to another."""
    a = partition.select(F.col("node_id").alias("source"), F.col("community_id").alias("from_community"))
    b = partition.select(F.col("node_id").alias("target_id"), F.col("community_id").alias("to_community"))
    pick = edges.where(~is_structural(F.col("relation")) & F.col("target_id").isNotNull())
    return pick.join(a, "source").join(b, "target_id").where("from_community <> to_community").select("from_community", "to_community", "source", "target_id", "relation", "confidence")


def edge_between(edges: DataFrame, source: str, target: str, order: Column | None = None) -> DataFrame:
    """The first edge from source to target, for labelling a path's step."""
    found = edges.where((F.col("source") == source) & (F.col("target_id") == target))
    return found.orderBy(order if order is not None else F.col("relation"), "relation", "confidence").limit(1)


def symbol_index(nodes: DataFrame) -> DataFrame:
    """(label, id, source_file): what each name is defined by and where, a row for each, so a name that many share is no long list."""
    return nodes.select("label", "id", "source_file").distinct()


def edge_agreement(expected: DataFrame, found: DataFrame) -> DataFrame:
    """(n_expected, n_found, n_both, recall, precision) of the distinct (source, relation, target_id) of two edge sets; an empty side has 1."""
    key = ["source", "relation", "target_id"]
    a, b = expected.select(*key).distinct().withColumn("_a", F.lit(1)), found.select(*key).distinct().withColumn("_b", F.lit(1))
    counted = a.join(b, key, "full").agg(F.count("_a").alias("n_expected"), F.count("_b").alias("n_found"), F.count(F.when(F.col("_a").isNotNull() & F.col("_b").isNotNull(), 1)).alias("n_both"))
    share = lambda whole: F.when(F.col(whole) == 0, 1.0).otherwise(F.round(F.col("n_both") / F.col(whole), 6))
    return counted.select("*", share("n_expected").alias("recall"), share("n_found").alias("precision"))


def latest(manifest: DataFrame) -> DataFrame:
    return manifest.agg(F.max("revision").alias("revision"))


def agreement(a: DataFrame, b: DataFrame) -> DataFrame:
    """(n, nmi, ari) of two partitions(node_id, community_id) over the nodes that both have."""
    joined = a.select("node_id", F.col("community_id").alias("x")).join(b.select("node_id", F.col("community_id").alias("y")), "node_id")
    cells = joined.groupBy("x", "y").agg(F.count("*").cast("double").alias("n"))
    rows = cells.withColumn("nx", F.sum("n").over(Window.partitionBy("x"))).withColumn("ny", F.sum("n").over(Window.partitionBy("y")))
    xs, ys = cells.groupBy("x").agg(F.sum("n").alias("m")), cells.groupBy("y").agg(F.sum("n").alias("m"))
    pairs = lambda c: c * (c - 1) / 2
    side = lambda df, name: df.agg(F.sum("m").alias("total"), F.sum(F.col("m") * F.log("m")).alias("l"), F.sum(pairs(F.col("m"))).alias("p")).select("total", F.col("l").alias(f"l{name}"), F.col("p").alias(f"p{name}"))
    inner = rows.agg(F.sum(F.col("n") * F.log(F.col("n") / F.col("nx") / F.col("ny"))).alias("s"), F.sum(pairs(F.col("n"))).alias("pc"))
    one = inner.crossJoin(side(xs, "x")).crossJoin(side(ys, "y").drop("total"))  # one row each
    total = F.col("total")
    mutual, hx, hy = F.col("s") / total + F.log(total), F.log(total) - F.col("lx") / total, F.log(total) - F.col("ly") / total
    expected = F.col("px") * F.col("py") / pairs(total)
    most = (F.col("px") + F.col("py")) / 2
    nmi = F.when(hx + hy == 0, 1.0).otherwise(2 * mutual / (hx + hy))
    ari = F.when(most == expected, 1.0).otherwise((F.col("pc") - expected) / (most - expected))
    return one.select(total.cast("long").alias("n"), F.round(nmi, 6).alias("nmi"), F.round(ari, 6).alias("ari"))
