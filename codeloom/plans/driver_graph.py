"""The star schema as a graph: the same views for Spark and, as SQL text, for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.checkpoints import parted


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _id(kind: str, column: str):
    return F.concat(F.lit(kind + ":"), F.col(column))


def _none():
    return F.lit(None).cast("string")


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, label, kind, source_file, project, impl)"""
    t = lambda name: _table(spark, sf_dir, name)

    def rows(df, key, kind, label, file=_none(), project=_none(), impl=_none(), prefix=None):
        return df.select(_id(prefix or kind, key).alias("id"), label.alias("label"), F.lit(kind).alias("kind"), file.alias("source_file"), project.alias("project"), impl.alias("impl"))

    return (
        rows(t("region"), "r_regionkey", "region", F.col("r_name"))
        .unionByName(rows(t("nation"), "n_nationkey", "nation", F.col("n_name")))
        .unionByName(rows(t("customer"), "c_custkey", "customer", F.col("c_name"), project=F.col("c_mktsegment")))
        .unionByName(rows(t("supplier"), "s_suppkey", "supplier", F.col("s_name")))
        .unionByName(rows(t("part"), "p_partkey", "function", F.col("p_name"), F.col("p_type"), F.col("p_brand"), F.col("p_size").cast("string"), "part"))
        .unionByName(rows(t("orders"), "o_orderkey", "order", F.concat(F.lit("Order#"), F.col("o_orderkey"))))
    )


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source, relation, confidence, target_id, target_name, opaque)"""
    t = lambda name: _table(spark, sf_dir, name)

    def rows(df, source, relation, target=_none(), confidence=F.lit("EXTRACTED"), name=_none(), opaque=F.lit(False)):
        return df.select(source.alias("source"), F.lit(relation).alias("relation"), confidence.alias("confidence"), target.alias("target_id"), name.alias("target_name"), opaque.alias("opaque"))

    # pairs of a line are nearly all distinct, so they are told apart after the exchange, where a task's share is small
    flag = F.when(F.col("l_returnflag") == "A", "EXTRACTED").when(F.col("l_returnflag") == "N", "INFERRED").otherwise("AMBIGUOUS")
    return (
        rows(t("nation"), _id("region", "n_regionkey"), "contains", _id("nation", "n_nationkey"))
        .unionByName(rows(t("customer"), _id("nation", "c_nationkey"), "contains", _id("customer", "c_custkey")))
        .unionByName(rows(t("supplier"), _id("nation", "s_nationkey"), "contains", _id("supplier", "s_suppkey")))
        .unionByName(rows(t("orders"), _id("customer", "o_custkey"), "calls", _id("order", "o_orderkey")))
        .unionByName(rows(t("lineitem"), _id("order", "l_orderkey"), "type/field", _id("part", "l_partkey"), flag))
        .unionByName(rows(parted(t("lineitem").select("l_suppkey", "l_partkey"), "l_suppkey", "l_partkey").distinct(), _id("supplier", "l_suppkey"), "implements", _id("part", "l_partkey")))
        .unionByName(rows(t("events").select("user_id", "event_type").distinct(), _id("customer", "user_id"), "calls", name=F.col("event_type"), opaque=F.col("event_type") == "error"))
    )


def partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(node_id, community_id)"""
    t = lambda name: _table(spark, sf_dir, name)
    rows = lambda df, node, community: df.select(node.alias("node_id"), community.cast("long").alias("community_id"))
    owned = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
    return (
        rows(t("nation"), _id("nation", "n_nationkey"), F.col("n_nationkey"))
        .unionByName(rows(t("customer"), _id("customer", "c_custkey"), F.col("c_nationkey")))
        .unionByName(rows(t("supplier"), _id("supplier", "s_suppkey"), F.col("s_nationkey")))
        .unionByName(rows(t("part"), _id("part", "p_partkey"), F.col("p_partkey") % 25))
        .unionByName(rows(owned, _id("order", "o_orderkey"), F.col("c_nationkey")))
    )


def refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source, relation, name, type_hint, recv_opaque): each order line names some other part."""
    part, line = _table(spark, sf_dir, "part"), _table(spark, sf_dir, "lineitem")
    n = part.agg(F.count("*").alias("n"))
    keyed = line.crossJoin(F.broadcast(n)).withColumn("k", (F.col("l_partkey") * 31 + F.col("l_linenumber") * 17) % F.col("n"))  # n is one row
    named = part.select(F.col("p_partkey").alias("k"), F.col("p_name").alias("name"), F.col("p_size").alias("size"))
    third = F.col("l_linenumber") % 3 == 0
    return (
        keyed.join(named, "k")
        .select(
            _id("part", "l_partkey").alias("source"), F.lit("calls").alias("relation"), "name",
            F.when(third, F.col("size").cast("string")).alias("type_hint"), (~third & (F.col("l_linenumber") % 2 == 0)).alias("recv_opaque"),
        )
        .distinct()
    )


#: The views as common table expressions for the oracle.
SQL = {
    "g_nodes": """SELECT 'region:'||r_regionkey AS id, r_name AS label, 'region' AS kind, CAST(NULL AS VARCHAR) AS source_file, CAST(NULL AS VARCHAR) AS project, CAST(NULL AS VARCHAR) AS impl FROM region
UNION ALL SELECT 'nation:'||n_nationkey, n_name, 'nation', NULL, NULL, NULL FROM nation
UNION ALL SELECT 'customer:'||c_custkey, c_name, 'customer', NULL, c_mktsegment, NULL FROM customer
UNION ALL SELECT 'supplier:'||s_suppkey, s_name, 'supplier', NULL, NULL, NULL FROM supplier
UNION ALL SELECT 'part:'||p_partkey, p_name, 'function', p_type, p_brand, CAST(p_size AS VARCHAR) FROM part
UNION ALL SELECT 'order:'||o_orderkey, 'Order#'||o_orderkey, 'order', NULL, NULL, NULL FROM orders""",
    "g_edges": """SELECT 'region:'||n_regionkey AS source, 'contains' AS relation, 'EXTRACTED' AS confidence, 'nation:'||n_nationkey AS target_id, CAST(NULL AS VARCHAR) AS target_name, false AS opaque FROM nation
UNION ALL SELECT 'nation:'||c_nationkey, 'contains', 'EXTRACTED', 'customer:'||c_custkey, NULL, false FROM customer
UNION ALL SELECT 'nation:'||s_nationkey, 'contains', 'EXTRACTED', 'supplier:'||s_suppkey, NULL, false FROM supplier
UNION ALL SELECT 'customer:'||o_custkey, 'calls', 'EXTRACTED', 'order:'||o_orderkey, NULL, false FROM orders
UNION ALL SELECT 'order:'||l_orderkey, 'type/field', CASE l_returnflag WHEN 'A' THEN 'EXTRACTED' WHEN 'N' THEN 'INFERRED' ELSE 'AMBIGUOUS' END, 'part:'||l_partkey, NULL, false FROM lineitem
UNION ALL SELECT DISTINCT 'supplier:'||l_suppkey, 'implements', 'EXTRACTED', 'part:'||l_partkey, CAST(NULL AS VARCHAR), false FROM lineitem
UNION ALL SELECT DISTINCT 'customer:'||user_id, 'calls', 'EXTRACTED', CAST(NULL AS VARCHAR), event_type, event_type = 'error' FROM events""",
    "g_partition": """SELECT 'nation:'||n_nationkey AS node_id, CAST(n_nationkey AS BIGINT) AS community_id FROM nation
UNION ALL SELECT 'customer:'||c_custkey, CAST(c_nationkey AS BIGINT) FROM customer
UNION ALL SELECT 'supplier:'||s_suppkey, CAST(s_nationkey AS BIGINT) FROM supplier
UNION ALL SELECT 'part:'||p_partkey, CAST(p_partkey % 25 AS BIGINT) FROM part
UNION ALL SELECT 'order:'||o_orderkey, CAST(c_nationkey AS BIGINT) FROM orders JOIN customer ON o_custkey = c_custkey""",
    "g_refs": """SELECT DISTINCT 'part:'||l_partkey AS source, 'calls' AS relation, t.p_name AS name,
CASE WHEN l_linenumber % 3 = 0 THEN CAST(t.p_size AS VARCHAR) END AS type_hint, (l_linenumber % 3 <> 0 AND l_linenumber % 2 = 0) AS recv_opaque
FROM lineitem JOIN part t ON t.p_partkey = (l_partkey * 31 + l_linenumber * 17) % (SELECT count(*) FROM part)""",
}


def with_views(sql: str, *views: str, recursive: bool = False) -> str:
    """sql with the named views before it; a query of its own common tables may follow a leading comma."""
    body = ",\n".join(f"{v} AS ({SQL[v]})" for v in views)
    return f"WITH {'RECURSIVE ' if recursive else ''}{body}{sql if sql.lstrip().startswith(',') else chr(10) + sql}"
