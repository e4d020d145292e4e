"""Connected components over links of long node ids, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import cut

#: Rounds after which contraction is given up; each round at least halves a component's hooks.
MAX_ROUNDS = 64


def connected_components(links: DataFrame) -> DataFrame:
    """links(a long, b long) -> (node long, root long): root is the smallest node of node's component.

    Each round hooks every node to its smallest neighbour if that is smaller, shortens the chains by
    pointer jumping until they are stars, and contracts each star to its root. Nodes are only in the
    result if they have a link; an empty input gives an empty result. Self links are dropped, repeated
    links and nulls do no harm. State is held in tables in the shared folder, never on the driver.
    """
    both = links.where("a <> b").select("a", "b")
    edges = cut(both.unionByName(both.selectExpr("b AS a", "a AS b")).distinct())
    labels = None
    for _ in range(MAX_ROUNDS):
        hooks = cut(edges.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("p")))
        if hooks.isEmpty():
            break
        while True:
            up = hooks.select(F.col("a").alias("p"), F.col("p").alias("q"))
            jumped = hooks.join(up, "p", "left").select("a", F.coalesce("q", "p").alias("p"), (F.col("q") < F.col("p")).alias("moved"))
            jumped = cut(jumped)
            hooks = jumped.select("a", "p")
            if jumped.where("moved").isEmpty():
                break
        if labels is None:
            labels = hooks.select(F.col("a").alias("node"), F.col("p").alias("root"))
        else:
            step = hooks.select(F.col("a").alias("root"), F.col("p").alias("next"))
            labels = cut(labels.join(step, "root", "left").select("node", F.coalesce("next", "root").alias("root")))
        left = hooks.select(F.col("a").alias("a"), F.col("p").alias("ra"))
        right = hooks.select(F.col("a").alias("b"), F.col("p").alias("rb"))
        edges = cut(edges.join(left, "a").join(right, "b").where("ra <> rb").select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct())
        if edges.isEmpty():
            return labels
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    return labels if labels is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
