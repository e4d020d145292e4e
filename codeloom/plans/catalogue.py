"""The registered queries over the star schema's graph, each with SQL that an independent engine can run."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import relations as R
from ..operators import cluster, delta, graph, link, retrieval, traverse
from . import driver_graph as G
from .driver_graph import with_views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(query: Query) -> Query:
        QUERIES[name] = query
        if sql:
            ORACLE[name] = sql
        return query

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def big(*columns: str) -> list:
    return [F.col(c).cast("long").alias(c) for c in columns]


@register(
    "graph_stats",
    with_views(
        """SELECT (SELECT count(*) FROM g_nodes) AS n_nodes, count(*) AS n_edges, count(*) FILTER (confidence = 'EXTRACTED') AS n_extracted,
count(*) FILTER (confidence = 'INFERRED') AS n_inferred, count(*) FILTER (confidence = 'AMBIGUOUS') AS n_ambiguous,
(SELECT count(DISTINCT community_id) FROM g_partition) AS n_communities FROM g_edges""",
        "g_nodes", "g_edges", "g_partition",
    ),
)
def graph_stats(spark, sf):
    return graph.stats(G.nodes(spark, sf), G.edges(spark, sf), G.partition(spark, sf).select("community_id").distinct())


@register("stats_by_confidence", with_views("SELECT confidence, count(*) AS n, CAST(round(count(*) * 100.0 / (SELECT count(*) FROM g_edges)) AS INTEGER) AS percent FROM g_edges GROUP BY confidence", "g_edges"))
def stats_by_confidence(spark, sf):
    return graph.confidence_mix(G.edges(spark, sf))


_DEGREE = """, ends AS (SELECT source AS id FROM g_edges WHERE target_id IS NOT NULL AND relation NOT IN ('contains','imports','depends_on','has_variant')
UNION ALL SELECT target_id FROM g_edges WHERE target_id IS NOT NULL AND relation NOT IN ('contains','imports','depends_on','has_variant')),
degree AS (SELECT id, count(*) AS d FROM ends GROUP BY id)"""


@register("god_nodes", with_views(_DEGREE + " SELECT n.id, n.label, n.kind, coalesce(d, 0) AS degree FROM g_nodes n LEFT JOIN degree USING (id) ORDER BY degree DESC, label, id LIMIT 10", "g_nodes", "g_edges"))
def god_nodes(spark, sf):
    return graph.god_nodes(G.edges(spark, sf), G.nodes(spark, sf), 10)


@register("semantic_degrees", with_views(_DEGREE + " SELECT n.id, n.label, n.kind, coalesce(d, 0) AS degree FROM g_nodes n LEFT JOIN degree USING (id)", "g_nodes", "g_edges"))
def semantic_degrees(spark, sf):
    return graph.semantic_degrees(G.edges(spark, sf), G.nodes(spark, sf))


@register(
    "degree_all",
    with_views(
        """, i AS (SELECT target_id AS id, count(*) AS n FROM g_edges WHERE target_id IS NOT NULL GROUP BY 1), o AS (SELECT source AS id, count(*) AS n FROM g_edges GROUP BY 1)
SELECT g.id, coalesce(i.n, 0) AS n_in, coalesce(o.n, 0) AS n_out FROM g_nodes g LEFT JOIN i ON i.id = g.id LEFT JOIN o ON o.id = g.id""",
        "g_nodes", "g_edges",
    ),
)
def degree_all(spark, sf):
    return graph.degrees(G.edges(spark, sf), G.nodes(spark, sf)).select("id", *big("n_in", "n_out"))


def _neighbors(name: str, node: str, relations: list[str], direction: str, condition: str) -> None:
    sides = {
        "out": f"SELECT 'out' AS direction, relation, confidence, target_id AS id FROM g_edges WHERE source = '{node}' AND target_id IS NOT NULL AND ({condition})",
        "in": f"SELECT 'in' AS direction, relation, confidence, source AS id FROM g_edges WHERE target_id = '{node}' AND ({condition})",
    }
    body = " UNION ALL ".join(sides[d] for d in (("out", "in") if direction == "both" else (direction,)))
    sql = with_views(f", hit AS ({body}) SELECT direction, relation, confidence, id, label, kind FROM hit JOIN g_nodes USING (id)", "g_nodes", "g_edges")
    register(name, sql)(lambda spark, sf: graph.neighbors(G.edges(spark, sf), G.nodes(spark, sf), node, relations, direction))


_neighbors("neighbors_out", "nation:3", ["any"], "out", "true")
_neighbors("neighbors_in", "part:7", ["any"], "in", "true")
_neighbors("neighbors_both", "customer:12", ["any"], "both", "true")
_neighbors("neighbors_semantic", "supplier:5", R.normalized([]), "both", "relation NOT IN ('contains','imports','depends_on','has_variant')")
_neighbors("neighbors_family_type", "part:11", ["type"], "in", "relation LIKE 'type/%'")
_neighbors("neighbors_implementors", "part:11", *R.resolve_questions(["implementors"]), "relation = 'implements'")


@register("unresolved_out", with_views("SELECT source, relation, confidence, target_name, opaque FROM g_edges WHERE source = 'customer:8' AND target_id IS NULL", "g_edges"))
def unresolved_out(spark, sf):
    return graph.unresolved_out(G.edges(spark, sf), "customer:8").select("source", "relation", "confidence", "target_name", "opaque")


@register("unresolved_in_by_label", with_views("SELECT n.id, n.label, n.kind, e.relation, e.confidence FROM g_edges e JOIN g_nodes n ON n.id = e.source WHERE e.target_id IS NULL AND e.target_name = 'error'", "g_nodes", "g_edges"))
def unresolved_in_by_label(spark, sf):
    return graph.unresolved_in_by_label(G.edges(spark, sf), G.nodes(spark, sf), "error")


@register("nodes_by_label", with_views("SELECT id, label, kind, source_file FROM g_nodes WHERE label = 'red widget'", "g_nodes"))
def nodes_by_label(spark, sf):
    return graph.nodes_by_label(G.nodes(spark, sf), "red widget").select("id", "label", "kind", "source_file")


@register("nodes_by_label_and_file", with_views("SELECT id, label, kind, source_file FROM g_nodes WHERE label = 'red widget' AND source_file = 'PROMO'", "g_nodes"))
def nodes_by_label_and_file(spark, sf):
    return graph.nodes_by_label(G.nodes(spark, sf), "red widget", "PROMO").select("id", "label", "kind", "source_file")


@register("ambiguous_labels", with_views("SELECT label, count(*) AS n, min(id) AS first_id FROM g_nodes GROUP BY label HAVING count(*) > 1", "g_nodes"))
def ambiguous_labels(spark, sf):
    return graph.ambiguous_labels(G.nodes(spark, sf))


@register("symbol_index", with_views("SELECT DISTINCT label, id, source_file FROM g_nodes", "g_nodes"))
def symbol_index(spark, sf):
    return graph.symbol_index(G.nodes(spark, sf))


_GRAMS = "list_distinct(list_transform(range(1, greatest(len({x}) - 2, 1) + 1), lambda i: substring(lower({x}), i, 3)))"
_SEEDS = f""", gram AS (SELECT id, label, unnest({_GRAMS.format(x="label")}) AS g FROM g_nodes), wanted AS (SELECT unnest({_GRAMS.format(x="'red widgt'")}) AS g),
weight AS (SELECT g, ln(((SELECT count(*) FROM g_nodes) + 1) / (count(*) + 1)) + 1 AS idf FROM gram WHERE g IN (SELECT g FROM wanted) GROUP BY g),
seed AS (SELECT id, label, round(sum(idf), 6) AS score FROM gram JOIN weight USING (g) GROUP BY id, label)"""


@register("seed_scores", with_views(_SEEDS + " SELECT id, label, score FROM seed", "g_nodes"))
def seed_scores(spark, sf):
    return retrieval.seed_scores(G.nodes(spark, sf), "red widgt")


@register("seed_top", with_views(_SEEDS + " SELECT id, label, score FROM seed ORDER BY score DESC, label, id LIMIT 32", "g_nodes"))
def seed_top(spark, sf):
    return retrieval.ranked(retrieval.seed_scores(G.nodes(spark, sf), "red widgt"), 32)


_REACH = with_views(
    """, pick AS (SELECT DISTINCT source, target_id FROM g_edges WHERE target_id IS NOT NULL),
walk(id, hop) AS (SELECT '{0}', 0 UNION SELECT p.target_id, w.hop + 1 FROM walk w JOIN pick p ON p.source = w.id WHERE w.hop < {1})
SELECT id, CAST(min(hop) AS INTEGER) AS hop FROM walk GROUP BY id""",
    "g_edges", recursive=True,
)


@register("reach_k_hops", _REACH.format("nation:3", 3))
def reach_k_hops(spark, sf):
    return traverse.reach(G.edges(spark, sf), "nation:3", 3)


_PATH = with_views(
    """, pick AS (SELECT DISTINCT source, target_id FROM g_edges WHERE target_id IS NOT NULL),
ends AS (SELECT min('part:'||l_partkey) AS b FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey WHERE n_regionkey = 2),
walk(id, hop, path) AS (SELECT 'region:2', 0, 'region:2' UNION SELECT p.target_id, w.hop + 1, w.path || ' ' || p.target_id FROM walk w JOIN pick p ON p.source = w.id WHERE w.hop < 8)
SELECT path, CAST(hop AS INTEGER) AS hops FROM walk WHERE id = (SELECT b FROM ends) ORDER BY hop, path LIMIT 1""",
    "g_edges", recursive=True,
)


@register("shortest_path", _PATH)
def shortest_path(spark, sf):
    nation, customer, orders, line = (table(spark, sf, t) for t in ("nation", "customer", "orders", "lineitem"))
    held = line.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customer, F.col("o_custkey") == F.col("c_custkey")).join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    end = held.where("n_regionkey = 2").agg(F.min(F.concat(F.lit("part:"), "l_partkey")).alias("b")).first()["b"]
    found = traverse.shortest_path(G.edges(spark, sf), G.nodes(spark, sf), "region:2", end) if end else []
    rows = [(" ".join(found), len(found) - 1)] if found else []
    return spark.createDataFrame(rows, "path string, hops int")


@register(
    "query_bfs",
    with_views(
        _SEEDS + """, top AS (SELECT id FROM seed ORDER BY score DESC, label, id LIMIT 32)
SELECT e.source, e.relation, e.confidence, e.target_id FROM g_edges e WHERE e.target_id IS NOT NULL AND e.source IN (SELECT id FROM top)
UNION ALL SELECT id, 'node', 'EXTRACTED', id FROM top""",
        "g_nodes", "g_edges",
    ),
)
def query_bfs(spark, sf):
    """The query text finds more seeds than the budget holds, so the region is the best seeds and their edges."""
    nodes, edges = traverse.query(G.nodes(spark, sf), G.edges(spark, sf), "red widgt", traverse.QueryOptions(depth=2, budget=32, relations=("any",)))
    return edges.select("source", "relation", "confidence", "target_id").unionByName(nodes.select(F.col("id").alias("source"), F.lit("node").alias("relation"), F.lit("EXTRACTED").alias("confidence"), F.col("id").alias("target_id")))


@register(
    "bfs_region",
    with_views(
        """, pick AS (SELECT DISTINCT source, target_id FROM g_edges WHERE target_id IS NOT NULL AND relation IN ('contains', 'calls')),
l1 AS (SELECT DISTINCT target_id AS id FROM pick WHERE source = 'region:1'), l2 AS (SELECT DISTINCT target_id AS id FROM pick WHERE source IN (SELECT id FROM l1))
SELECT 'region:1' AS id, CAST(0 AS INTEGER) AS depth UNION ALL SELECT id, 1 FROM l1 UNION ALL SELECT id, 2 FROM l2 WHERE id NOT IN (SELECT id FROM l1)""",
        "g_edges",
    ),
)
def bfs_region(spark, sf):
    """The budget is never reached, so this is the whole region of two hops."""
    edges = G.edges(spark, sf)
    seeds = spark.createDataFrame([("region:1", 1)], "id string, rank long")
    nodes, _ = traverse.bfs(edges, seeds, traverse.QueryOptions(depth=2, budget=2_000_000, relations=("contains", "calls")))
    return nodes.select("id", "depth")


@register("query_dfs")
def query_dfs(spark, sf):
    nodes, _ = traverse.query(G.nodes(spark, sf), G.edges(spark, sf), "nation_1", traverse.QueryOptions(depth=2, budget=8, mode="dfs", relations=("any",)))
    return nodes


_LABELS = """, ends AS (SELECT source AS id FROM g_edges WHERE relation NOT IN ('contains','imports','depends_on','has_variant')
UNION ALL SELECT target_id FROM g_edges WHERE target_id IS NOT NULL AND relation NOT IN ('contains','imports','depends_on','has_variant')),
degree AS (SELECT id, count(*) AS d FROM ends GROUP BY id),
named AS (SELECT p.community_id, n.label, row_number() OVER (PARTITION BY p.community_id ORDER BY coalesce(d, 0) DESC, n.label) AS k FROM g_partition p JOIN g_nodes n ON n.id = p.node_id LEFT JOIN degree ON degree.id = n.id),
label AS (SELECT community_id, label FROM named WHERE k = 1)"""


@register("community_labels", with_views(_LABELS + " SELECT community_id, label FROM label", "g_nodes", "g_edges", "g_partition"))
def community_labels(spark, sf):
    return graph.community_labels(G.edges(spark, sf), G.nodes(spark, sf), G.partition(spark, sf))


_PAIRS = """, pair AS (SELECT least(source, target_id) AS u, greatest(source, target_id) AS v, max(CASE confidence WHEN 'EXTRACTED' THEN 1.0 WHEN 'INFERRED' THEN 0.5 ELSE 0.25 END) AS wc, 1.0 AS w
FROM g_edges WHERE target_id IS NOT NULL AND source <> target_id GROUP BY 1, 2)"""
_COHESION = (
    _PAIRS
    + """, meets AS (SELECT a.community_id AS cu, b.community_id AS cv, w FROM pair JOIN g_partition a ON a.node_id = u JOIN g_partition b ON b.node_id = v),
side AS (SELECT cu AS c, w AS i, 0.0 AS o FROM meets WHERE cu = cv UNION ALL SELECT cu, 0.0, w FROM meets WHERE cu <> cv UNION ALL SELECT cv, 0.0, w FROM meets WHERE cu <> cv),
summed AS (SELECT c, CAST(sum(i) AS DOUBLE) AS i, CAST(sum(o) AS DOUBLE) AS o FROM side GROUP BY c),
permille AS (SELECT community_id, CAST(round(CASE WHEN coalesce(i + o, 0) = 0 THEN 1000.0 ELSE i * 1000.0 / (i + o) END) AS INTEGER) AS permille FROM (SELECT DISTINCT community_id FROM g_partition) LEFT JOIN summed ON c = community_id)"""
)


@register("pair_weights", with_views(_PAIRS + " SELECT u, v, CAST(wc AS DOUBLE) AS w FROM pair", "g_edges"))
def pair_weights(spark, sf):
    return graph.pair_weights(G.edges(spark, sf), "confidence")


@register("cohesion", with_views(_COHESION + " SELECT community_id, permille FROM permille", "g_edges", "g_partition"))
def cohesion(spark, sf):
    return graph.cohesion(graph.pair_weights(G.edges(spark, sf)), G.partition(spark, sf))


_SUMMARIES = _LABELS + _COHESION + ", sizes AS (SELECT community_id, count(*) AS size FROM g_partition GROUP BY 1), summary AS (SELECT community_id, label, size, permille FROM sizes LEFT JOIN label USING (community_id) LEFT JOIN permille USING (community_id))"


@register("community_summaries", with_views(_SUMMARIES + " SELECT community_id, label, size, permille FROM summary", "g_nodes", "g_edges", "g_partition"))
def community_summaries(spark, sf):
    return graph.community_summaries(G.edges(spark, sf), G.nodes(spark, sf), G.partition(spark, sf))


@register("list_communities", with_views(_SUMMARIES + " SELECT community_id, label, size, permille, (SELECT count(*) FROM summary) AS n_total FROM summary ORDER BY size DESC, community_id LIMIT 20", "g_nodes", "g_edges", "g_partition"))
def list_communities(spark, sf):
    return graph.list_communities(graph.community_summaries(G.edges(spark, sf), G.nodes(spark, sf), G.partition(spark, sf)), 20)


@register("community_members", with_views("SELECT n.id, n.label, n.kind FROM g_partition p JOIN g_nodes n ON n.id = p.node_id WHERE p.community_id = 4", "g_nodes", "g_partition"))
def community_members(spark, sf):
    return graph.community_members(G.nodes(spark, sf), G.partition(spark, sf), 4)


@register(
    "bridges",
    with_views(
        """SELECT a.community_id AS from_community, b.community_id AS to_community, e.source, e.target_id, e.relation, e.confidence FROM g_edges e JOIN g_partition a ON a.node_id = e.source JOIN g_partition b ON b.node_id = e.target_id
WHERE e.relation NOT IN ('contains','imports','depends_on','has_variant') AND a.community_id <> b.community_id""",
        "g_edges", "g_partition",
    ),
)
def bridges(spark, sf):
    return graph.bridges(G.edges(spark, sf), G.partition(spark, sf))


@register(
    "partition_agreement",
    """WITH both_ AS (SELECT CAST(p_partkey % 25 AS BIGINT) AS x, p_brand AS y FROM part), cell AS (SELECT x, y, CAST(count(*) AS DOUBLE) AS n FROM both_ GROUP BY 1, 2),
m AS (SELECT n, sum(n) OVER (PARTITION BY x) AS nx, sum(n) OVER (PARTITION BY y) AS ny FROM cell),
xs AS (SELECT sum(m) AS total, sum(m * ln(m)) AS l, sum(m * (m - 1) / 2) AS p FROM (SELECT x, sum(n) AS m FROM cell GROUP BY x)),
ys AS (SELECT sum(m * ln(m)) AS l, sum(m * (m - 1) / 2) AS p FROM (SELECT y, sum(n) AS m FROM cell GROUP BY y)),
s AS (SELECT sum(n * ln(n / nx / ny)) AS s, sum(n * (n - 1) / 2) AS pc FROM m),
f AS (SELECT total, s / total + ln(total) AS mi, ln(total) - xs.l / total AS hx, ln(total) - ys.l / total AS hy, pc, xs.p * ys.p / (total * (total - 1) / 2) AS ex, (xs.p + ys.p) / 2 AS mx FROM xs, ys, s)
SELECT CAST(total AS BIGINT) AS n, round(2 * mi / (hx + hy), 6) AS nmi, round((pc - ex) / (mx - ex), 6) AS ari FROM f""",
)
def partition_agreement(spark, sf):
    part = table(spark, sf, "part")
    return graph.agreement(
        part.select(F.col("p_partkey").alias("node_id"), (F.col("p_partkey") % 25).alias("community_id")),
        part.select(F.col("p_partkey").alias("node_id"), F.col("p_brand").alias("community_id")),
    )


@register("louvain")
def louvain(spark, sf):
    """Communities of nations, customers and suppliers by their calls and containment: order-dependent, so no SQL."""
    edges = G.edges(spark, sf).where(F.col("relation").isin("contains", "calls") & F.col("target_id").isNotNull())
    return cluster.cluster(G.nodes(spark, sf).where(F.col("kind") != "function"), edges, cluster.ClusterConfig())[0]


# the linking cascade as plain joins, for comparison
_CAND = """, cand AS (SELECT label AS name, id, project, impl, source_file FROM g_nodes WHERE kind = 'function'),
r AS (SELECT g_refs.*, s.project AS sp, s.source_file AS sf FROM g_refs LEFT JOIN g_nodes s ON s.id = g_refs.source),
pool AS (SELECT r.source, r.relation, r.name, r.type_hint, r.recv_opaque, count(c.id) AS n, min(c.id) AS m,
count(c.id) FILTER (c.impl = r.type_hint) AS nt, min(c.id) FILTER (c.impl = r.type_hint) AS mt, count(c.id) FILTER (c.source_file = r.sf) AS ns, min(c.id) FILTER (c.source_file = r.sf) AS ms
FROM r LEFT JOIN cand c ON c.name = r.name AND c.project IS NOT DISTINCT FROM r.sp GROUP BY ALL),
linked AS (SELECT source, relation, name, recv_opaque, CASE WHEN n = 0 THEN NULL WHEN type_hint IS NOT NULL THEN mt WHEN ns > 0 THEN ms WHEN recv_opaque THEN NULL ELSE m END AS target_id,
CASE WHEN n = 0 THEN 'EXTRACTED' WHEN type_hint IS NOT NULL THEN CASE WHEN nt > 1 THEN 'AMBIGUOUS' ELSE 'EXTRACTED' END WHEN ns = 1 THEN 'EXTRACTED' WHEN ns > 1 THEN 'AMBIGUOUS' WHEN recv_opaque THEN 'EXTRACTED' WHEN n = 1 THEN 'INFERRED' ELSE 'AMBIGUOUS' END AS confidence FROM pool),
e AS (SELECT source, relation, confidence, target_id, CASE WHEN target_id IS NULL THEN name END AS target_name, CASE WHEN target_id IS NULL AND recv_opaque THEN 'opaque' END AS recv FROM linked)"""


def _linking(spark, sf):
    none = F.lit(None).cast("string")
    nodes = G.nodes(spark, sf).withColumn("returns", none)
    refs = G.refs(spark, sf).select("source", "relation", "name", "type_hint", none.alias("specifier"), none.alias("imported"), "recv_opaque", none.alias("recv_returns"), none.alias("recv_returns_owner"))
    return nodes, refs


@register("resolve_cascade", with_views(_CAND + " SELECT source, relation, confidence, target_id, target_name, recv FROM e", "g_nodes", "g_refs"))
def resolve_cascade(spark, sf):
    nodes, refs = _linking(spark, sf)
    return link.resolve(refs, nodes)


@register("resolve_confidence_mix", with_views(_CAND + " SELECT confidence, count(*) AS n, count(target_id) AS n_bound FROM e GROUP BY confidence", "g_nodes", "g_refs"))
def resolve_confidence_mix(spark, sf):
    nodes, refs = _linking(spark, sf)
    return link.resolve(refs, nodes).groupBy("confidence").agg(F.count("*").alias("n"), F.count("target_id").alias("n_bound"))


_RETURNS = """, fn AS (SELECT id, label AS name, project, impl, CASE WHEN TRY_CAST(replace(id, 'part:', '') AS BIGINT) % 3 = 0 THEN NULL ELSE 'Vec::' || kind || CAST(TRY_CAST(replace(id, 'part:', '') AS BIGINT) % 2 AS VARCHAR) || '<T>' END AS ret FROM g_nodes WHERE kind = 'function'),
one AS (SELECT name, project, min(ret) AS ret FROM fn WHERE ret IS NOT NULL GROUP BY name, project HAVING count(DISTINCT ret) = 1)
SELECT r.source, r.name, replace(replace(one.ret, 'Vec::', ''), '<T>', '') AS typed, one.ret IS NULL AS opaque FROM g_refs r JOIN g_nodes s ON s.id = r.source LEFT JOIN one ON one.name = r.name AND one.project IS NOT DISTINCT FROM s.project WHERE r.type_hint IS NULL"""


@register("return_type_inference", with_views(_RETURNS, "g_nodes", "g_refs"))
def return_type_inference(spark, sf):
    nodes, refs = _linking(spark, sf)
    key = F.regexp_replace("id", "^part:", "").cast("long")
    returns = F.when(F.col("kind") == "function", F.when(key % 3 != 0, F.concat(F.lit("Vec::"), "kind", (key % 2).cast("string"), F.lit("<T>"))))
    nodes = nodes.withColumn("returns", returns)
    deferred = refs.where(F.col("type_hint").isNull()).withColumn("recv_returns", F.col("name"))
    typed = link.with_receiver_types(link.with_sources(deferred, nodes), link.candidates(nodes))
    return typed.select("source", "name", F.col("type_hint").alias("typed"), F.col("recv_opaque").alias("opaque"))


_PATHS = """, path AS (SELECT 'src/' || replace(lower(p_brand), '#', '') || '/' || lower(p_type) || '/p' || p_partkey || '.rs' AS path FROM part),
root AS (SELECT DISTINCT 'src/' || replace(lower(p_brand), '#', '') AS root FROM part WHERE p_brand <> 'Brand#1' UNION SELECT DISTINCT 'src/' || replace(lower(p_brand), '#', '') || '/' || lower(p_type) FROM part WHERE p_type IN ('PROMO', 'SMALL'))"""


def _paths(spark, sf):
    part = table(spark, sf, "part")
    top = F.concat(F.lit("src/"), F.translate(F.lower("p_brand"), "#", ""))
    paths = part.select(F.concat(top, F.lit("/"), F.lower("p_type"), F.lit("/p"), "p_partkey", F.lit(".rs")).alias("path"))
    roots = part.where("p_brand <> 'Brand#1'").select(top.alias("root")).unionByName(part.where(F.col("p_type").isin("PROMO", "SMALL")).select(F.concat(top, F.lit("/"), F.lower("p_type")).alias("root"))).distinct()
    return paths, roots


@register("project_of_longest_prefix", "WITH x AS (SELECT 1)" + _PATHS + " SELECT path, arg_max(root, length(root)) FILTER (root IS NOT NULL) AS project FROM path LEFT JOIN root ON path.path = root.root OR starts_with(path.path, root.root || '/') GROUP BY path")
def project_of_longest_prefix(spark, sf):
    paths, roots = _paths(spark, sf)
    return link.project_of(paths, roots)


_PROJECTS = "WITH project AS (SELECT 'nation/' || n_nationkey AS root, n_name AS name, 'Cargo.toml' AS manifest, n_nationkey AS k FROM nation), dep AS (SELECT p.root, 'NATION_' || ((p.k * 7 + d) % 30) AS dep FROM project p, (SELECT unnest([0, 1, 5]) AS d)), depends AS (SELECT DISTINCT dep.root, q.root AS dep_root FROM dep JOIN project q ON q.name = dep.dep WHERE q.root <> dep.root)"


def _projects(spark, sf):
    return table(spark, sf, "nation").select(
        F.concat(F.lit("nation/"), "n_nationkey").alias("root"), F.lit("Cargo.toml").alias("manifest"), F.col("n_name").alias("name"), F.lit(None).cast("string").alias("entry"),
        F.array(*(F.concat(F.lit("NATION_"), ((F.col("n_nationkey") * 7 + d) % 30).cast("string")) for d in (0, 1, 5))).alias("deps"),
    )


@register("depends_on", _PROJECTS + " SELECT root, dep_root FROM depends")
def depends_on(spark, sf):
    return link.depends_on(_projects(spark, sf))


@register("project_graph", _PROJECTS + ", files AS (SELECT 'nation/' || c_nationkey AS root, count(*) AS files FROM customer GROUP BY 1) SELECT p.root, p.name, p.manifest, coalesce(f.files, 0) AS files, coalesce((SELECT string_agg(dep_root, ',' ORDER BY dep_root) FROM depends d WHERE d.root = p.root), '') AS depends_on FROM project p LEFT JOIN files f ON f.root = p.root")
def project_graph(spark, sf):
    projects = _projects(spark, sf)
    files = table(spark, sf, "customer").select(F.concat(F.lit("nation/"), "c_nationkey", F.lit("/c"), "c_custkey", F.lit(".rs")).alias("path"))
    return link.project_graph(projects, link.project_of(files, projects)).withColumn("depends_on", F.array_join("depends_on", ","))


@register("project_overlay", _PROJECTS + " SELECT 'project:' || root AS source, 'depends_on' AS relation, 'project:' || dep_root AS target_id FROM depends UNION ALL SELECT 'project:nation/' || c_nationkey, 'contains', 'file:nation/' || c_nationkey || '/c' || c_custkey || '.rs' FROM customer")
def project_overlay(spark, sf):
    projects = _projects(spark, sf)
    files = table(spark, sf, "customer").select(F.concat(F.lit("nation/"), "c_nationkey", F.lit("/c"), "c_custkey", F.lit(".rs")).alias("path"))
    held = link.project_of(files, projects).select(F.concat(F.lit("file:"), "path").alias("id"), "path", "project")
    return link.project_overlay(projects, held)[1].select("source", "relation", "target_id")


_EXT = ["", *("." + e for e in link.EXTENSIONS), *("/index." + e for e in link.EXTENSIONS)]


@register(
    "module_probe",
    f"""WITH file AS (SELECT 'lib/m' || p_partkey || CASE p_partkey % 4 WHEN 0 THEN '.ts' WHEN 1 THEN '/index.js' WHEN 2 THEN '' ELSE '.jsx' END AS path FROM part WHERE p_partkey % 5 <> 0
UNION SELECT 'lib/m' || p_partkey || '.js' FROM part WHERE p_partkey % 7 = 0), asked AS (SELECT 'lib/m' || p_partkey AS path FROM part),
suffix AS (SELECT unnest({_EXT!r}) AS s, unnest(range({len(_EXT)})) AS n)
SELECT a.path, arg_min(f.path, n) AS file FROM asked a LEFT JOIN (SELECT * FROM suffix, asked) x ON x.path = a.path LEFT JOIN file f ON f.path = x.path || x.s GROUP BY a.path""",
)
def module_probe(spark, sf):
    part, key = table(spark, sf, "part"), F.col("p_partkey")
    stem = F.concat(F.lit("lib/m"), key)
    tail = F.when(key % 4 == 0, ".ts").when(key % 4 == 1, "/index.js").when(key % 4 == 2, "").otherwise(".jsx")
    files = part.where(key % 5 != 0).select(F.concat(stem, tail).alias("path")).unionByName(part.where(key % 7 == 0).select(F.concat(stem, F.lit(".js")).alias("path")))
    return link.probe(part.select(stem.alias("path")), files)


@register("reference_dedup", with_views(", all_ AS (SELECT 'part:'||l_partkey AS source, 'calls' AS relation, 'order' || (l_orderkey % 100) AS name FROM lineitem), gone AS (SELECT 'part:'||p_partkey AS source FROM part WHERE p_size < 10) SELECT DISTINCT source, relation, name FROM all_ WHERE source NOT IN (SELECT source FROM gone) UNION SELECT source, relation, name FROM g_refs", "g_refs"))
def reference_dedup(spark, sf):
    none = F.lit(None).cast("string")
    full = lambda df: df.select("source", "relation", "name", none.alias("type_hint"), none.alias("specifier"), none.alias("imported"), F.lit(False).alias("recv_opaque"), none.alias("recv_returns"), none.alias("recv_returns_owner"))
    prior = table(spark, sf, "lineitem").select(F.concat(F.lit("part:"), "l_partkey").alias("source"), F.lit("calls").alias("relation"), F.concat(F.lit("order"), F.col("l_orderkey") % 100).alias("name"))
    gone = table(spark, sf, "part").where("p_size < 10").select(F.concat(F.lit("part:"), "p_partkey").alias("id"))
    return link.rebuild_refs(full(prior), gone, full(G.refs(spark, sf))).select("source", "relation", "name")


_CHANGED = ", was AS (SELECT source, relation, confidence, target_id, target_name FROM g_edges WHERE NOT (relation = 'type/field' AND confidence = 'INFERRED')), now AS (SELECT source, relation, CASE WHEN relation = 'calls' AND target_id IS NULL THEN 'AMBIGUOUS' ELSE confidence END AS confidence, target_id, target_name FROM g_edges WHERE source NOT LIKE 'supplier:1%')"


def _versions(spark, sf):
    edges = G.edges(spark, sf).drop("opaque")
    was = edges.where(~((F.col("relation") == "type/field") & (F.col("confidence") == "INFERRED")))
    doubt = (F.col("relation") == "calls") & F.col("target_id").isNull()
    return was, edges.where(~F.col("source").startswith("supplier:1")).withColumn("confidence", F.when(doubt, "AMBIGUOUS").otherwise(F.col("confidence")))


@register("edge_diff_removed", with_views(_CHANGED + " SELECT * FROM was EXCEPT ALL SELECT * FROM now", "g_edges"))
def edge_diff_removed(spark, sf):
    return delta.edge_diff(*_versions(spark, sf))[0]


@register("edge_diff_added", with_views(_CHANGED + " SELECT * FROM now EXCEPT ALL SELECT * FROM was", "g_edges"))
def edge_diff_added(spark, sf):
    return delta.edge_diff(*_versions(spark, sf))[1]


@register("prune_dangling", with_views(", kept AS (SELECT * FROM g_nodes WHERE NOT (kind = 'function' AND CAST(impl AS INTEGER) % 2 = 0)) SELECT source, relation, confidence, target_id, target_name FROM g_edges WHERE source IN (SELECT id FROM kept) AND (target_id IS NULL OR target_id IN (SELECT id FROM kept))", "g_nodes", "g_edges"))
def prune_dangling(spark, sf):
    kept = G.nodes(spark, sf).where(~F.coalesce((F.col("kind") == "function") & (F.col("impl").cast("int") % 2 == 0), F.lit(False)))
    return graph.prune_dangling(G.edges(spark, sf).drop("opaque"), kept)


@register(
    "graph_merge",
    with_views(
        """, kept AS (SELECT id FROM g_nodes WHERE kind <> 'supplier' UNION ALL SELECT 'new:' || n_nationkey FROM nation), e AS (SELECT source, relation, confidence, target_id, target_name FROM g_edges WHERE relation <> 'contains'
UNION ALL SELECT 'new:' || n_nationkey, 'calls', 'INFERRED', 'nation:' || n_nationkey, NULL FROM nation)
SELECT * FROM e WHERE source IN (SELECT id FROM kept) AND (target_id IS NULL OR target_id IN (SELECT id FROM kept))""",
        "g_nodes", "g_edges",
    ),
)
def graph_merge(spark, sf):
    nodes, edges, nation = G.nodes(spark, sf), G.edges(spark, sf), table(spark, sf, "nation")
    none, own = F.lit(None).cast("string"), F.concat(F.lit("new:"), "n_nationkey")
    new = nation.select(own.alias("id"), F.col("n_name").alias("label"), F.lit("struct").alias("kind"), none.alias("source_file"), none.alias("project"), none.alias("impl"))
    added = nation.select(own.alias("source"), F.lit("calls").alias("relation"), F.lit("INFERRED").alias("confidence"), F.concat(F.lit("nation:"), "n_nationkey").alias("target_id"), none.alias("target_name"))
    return delta.merge(nodes, edges, nodes.where("kind = 'supplier'"), new, edges.where("relation = 'contains'"), added)[1]


_IMPACT = """, touched AS (SELECT 'PROMO' AS path), dirty AS (SELECT DISTINCT label AS name FROM g_nodes WHERE kind = 'function' AND source_file IN (SELECT path FROM touched) AND project = 'Brand#7')
SELECT DISTINCT r.source, r.relation FROM g_refs r JOIN g_nodes s ON s.id = r.source WHERE s.source_file IN (SELECT path FROM touched) OR r.name IN (SELECT name FROM dirty)"""


@register("impact_sites", with_views(_IMPACT, "g_nodes", "g_refs"))
def impact_sites(spark, sf):
    nodes, refs = _linking(spark, sf)
    touched = spark.createDataFrame([("PROMO",)], "path string")
    changed = nodes.where((F.col("source_file") == "PROMO") & (F.col("project") == "Brand#7"))
    return link.impacted_sites(refs, nodes, touched, link.dirty_names(changed, changed.limit(0)))


@register(
    "healed_refs",
    with_views(
        """, prior AS (SELECT source, relation, target_id FROM g_edges WHERE relation = 'implements'), label AS (SELECT id, label FROM g_nodes),
ref AS (SELECT DISTINCT p.source, p.relation, l.label AS name FROM prior p JOIN label l ON l.id = p.target_id WHERE TRY_CAST(replace(p.target_id, 'part:', '') AS BIGINT) % 3 = 0),
site AS (SELECT source, relation, (SELECT count(*) FROM prior q WHERE q.source = r.source) - count(*) AS deficit FROM ref r GROUP BY source, relation),
free AS (SELECT DISTINCT p.source, p.relation, s.deficit, l.label AS name FROM prior p JOIN site s ON s.source = p.source AND s.deficit > 0 JOIN label l ON l.id = p.target_id WHERE NOT EXISTS (SELECT 1 FROM ref r WHERE r.source = p.source AND r.name = l.label))
SELECT source, relation, name FROM (SELECT *, row_number() OVER (PARTITION BY source, relation ORDER BY name) AS k FROM free) WHERE k <= deficit""",
        "g_nodes", "g_edges",
    ),
)
def healed_refs(spark, sf):
    nodes = G.nodes(spark, sf)
    prior = G.edges(spark, sf).where("relation = 'implements'").drop("opaque")
    third = prior.where(F.regexp_replace("target_id", "^part:", "").cast("long") % 3 == 0)
    refs = third.join(nodes.select(F.col("id").alias("target_id"), F.col("label").alias("name")), "target_id").select("source", "relation", "name").distinct()
    return link.healed_refs(refs, prior, nodes).select("source", "relation", "name")


@register("affected_count", with_views(", dirty AS (SELECT DISTINCT label AS name FROM g_nodes WHERE kind = 'function' AND impl = '7') SELECT (SELECT count(*) FROM g_nodes WHERE kind = 'function' AND impl = '7') + (SELECT count(*) FROM g_nodes WHERE kind = 'region') + (SELECT count(DISTINCT source) FROM g_refs WHERE name IN (SELECT name FROM dirty)) AS affected", "g_nodes", "g_refs"))
def affected_count(spark, sf):
    nodes, refs = _linking(spark, sf)
    new = nodes.where("kind = 'function' AND impl = '7'")
    return link.affected_count(new, nodes.where("kind = 'region'"), refs, link.dirty_names(new, new.limit(0)))


_MANIFEST = """WITH now AS (SELECT 'doc/' || doc_id || CASE doc_id % 3 WHEN 0 THEN '.py' WHEN 1 THEN '.rs' ELSE '.md' END AS path, substring(sha256(text), 1, 16) AS hash, doc_id FROM documents WHERE doc_id % 7 <> 1),
was AS (SELECT 'doc/' || doc_id || CASE doc_id % 3 WHEN 0 THEN '.py' WHEN 1 THEN '.rs' ELSE '.md' END AS path, CASE WHEN doc_id % 7 = 2 THEN 'stale' ELSE substring(sha256(text), 1, 16) END AS hash FROM documents WHERE doc_id % 7 <> 3)
SELECT coalesce(now.path, was.path) AS path, CASE WHEN now.path IS NULL THEN 'D' WHEN was.path IS NULL THEN 'A' ELSE 'M' END AS op FROM (SELECT * FROM now WHERE path NOT LIKE '%.md') now FULL JOIN was ON now.path = was.path WHERE now.path IS NULL AND was.path NOT IN (SELECT path FROM now) OR now.path IS NOT NULL AND (was.path IS NULL OR was.hash <> now.hash)"""


@register("manifest_reconcile", _MANIFEST)
def manifest_reconcile(spark, sf):
    from ..sources.changes import reconcile

    docs = table(spark, sf, "documents")
    key = F.col("doc_id")
    path = F.concat(F.lit("doc/"), key, F.when(key % 3 == 0, ".py").when(key % 3 == 1, ".rs").otherwise(".md"))
    digest = F.substring(F.sha2("text", 256), 1, 16)
    now = docs.where(key % 7 != 1).select(path.alias("path"), digest.alias("hash"), F.lit(2).cast("long").alias("mtime_ns"))
    was = docs.where(key % 7 != 3).select(path.alias("path"), F.when(key % 7 == 2, "stale").otherwise(digest).alias("hash"), F.lit(1).cast("long").alias("mtime_ns"))
    return reconcile(now, was).select("path", "op")


_SCOPE = """WITH export AS (SELECT 'b' || (p_partkey % 50) AS barrel, p_partkey AS k, p_name AS name FROM part), imp AS (SELECT 'part:' || p_partkey AS source, 'b' || (p_partkey % 60) AS barrel, p_name AS name FROM part)
SELECT imp.source AS file, imp.name, 'def:' || min(lpad(CAST(k AS VARCHAR), 8, '0')) AS def_id FROM imp JOIN export e ON e.barrel = imp.barrel AND e.name = imp.name GROUP BY 1, 2"""


@register("import_scope", _SCOPE)
def import_scope(spark, sf):
    """Each part's file imports its own name from a barrel that star-exports the modules that define names."""
    part, key = table(spark, sf, "part"), F.col("p_partkey")
    padded = F.lpad(key.cast("string"), 8, "0")
    none = F.lit(None).cast("string")
    barrel = F.concat(F.lit("b"), key % 50)
    module = F.concat(F.lit("m"), padded)
    files = part.select(F.concat(F.lit("f:"), "p_partkey").alias("id"), F.col("p_name").alias("label"), F.lit("file").alias("kind"), F.concat(F.lit("part:"), "p_partkey").alias("source_file"), none.alias("project"), none.alias("impl"), none.alias("returns"))
    defs = part.select(F.concat(F.lit("def:"), padded).alias("id"), F.col("p_name").alias("label"), F.lit("function").alias("kind"), module.alias("source_file"), none.alias("project"), none.alias("impl"), none.alias("returns"))
    refs = part.select(F.concat(F.lit("f:"), "p_partkey").alias("source"), F.lit("imports").alias("relation"), F.col("p_name").alias("name"), none.alias("type_hint"), F.concat(F.lit("./b"), key % 60).alias("specifier"), none.alias("imported"), F.lit(False).alias("recv_opaque"), none.alias("recv_returns"), none.alias("recv_returns_owner"))
    exports = part.select(barrel.alias("file"), key.cast("int").alias("pos"), F.lit("star").alias("kind"), none.alias("name"), F.concat(F.lit("./"), module).alias("specifier"), none.alias("imported"))
    exports = exports.unionByName(part.select(module.alias("file"), F.lit(0).alias("pos"), F.lit("local").alias("kind"), F.col("p_name").alias("name"), none.alias("specifier"), none.alias("imported")))
    modules = part.select(F.concat(F.lit("part:"), "p_partkey").alias("file"), F.concat(F.lit("./b"), key % 60).alias("specifier"), F.concat(F.lit("b"), key % 60).alias("target"))
    modules = modules.unionByName(part.select(barrel.alias("file"), F.concat(F.lit("./"), module).alias("specifier"), module.alias("target")))
    return link.import_scope(refs, files.unionByName(defs), exports, modules)


@register(
    "scalar_functions",
    """SELECT p_partkey AS k, trim(split_part(split_part('a::' || p_type || '<' || p_brand || '>', '<', 1), '::', -1)) AS bare, 'L' || p_size || CASE WHEN p_size % 2 = 0 THEN '-L' || (p_size + 3) ELSE '' END AS span,
p_type IN ('PROMO', 'SMALL') AS picked, substring(sha256(p_name), 1, 16) AS hash16 FROM part""",
)
def scalar_functions(spark, sf):
    part = table(spark, sf, "part")
    end = F.when(F.col("p_size") % 2 == 0, F.col("p_size") + 3).otherwise(F.col("p_size"))
    return part.select(
        F.col("p_partkey").alias("k"), R.norm_type(F.concat(F.lit("a::"), "p_type", F.lit("<"), "p_brand", F.lit(">"))).alias("bare"),
        R.render_span(F.col("p_size"), end).alias("span"), F.col("p_type").isin("PROMO", "SMALL").alias("picked"), F.substring(F.sha2("p_name", 256), 1, 16).alias("hash16"),
    )


@register("relation_filter", with_views("SELECT relation, count(*) AS n FROM g_edges WHERE relation = 'calls' OR relation LIKE 'type/%' GROUP BY relation", "g_edges"))
def relation_filter(spark, sf):
    return G.edges(spark, sf).where(R.matches(F.col("relation"), ["calls", "type/"])).groupBy("relation").agg(F.count("*").alias("n"))


@register("edge_between", with_views("SELECT source, relation, confidence, target_id FROM g_edges WHERE source = 'order:10' AND target_id = (SELECT min(target_id) FROM g_edges WHERE source = 'order:10') ORDER BY relation, confidence LIMIT 1", "g_edges"))
def edge_between(spark, sf):
    edges = G.edges(spark, sf)
    target = edges.where("source = 'order:10'").agg(F.min("target_id").alias("t")).first()["t"]
    return graph.edge_between(edges, "order:10", target or "").select("source", "relation", "confidence", "target_id")


@register("latest_revision", "SELECT max('r' || lpad(CAST(o_orderkey % 1000 AS VARCHAR), 4, '0')) AS revision FROM orders")
def latest_revision(spark, sf):
    return graph.latest(table(spark, sf, "orders").select(F.concat(F.lit("r"), F.lpad((F.col("o_orderkey") % 1000).cast("string"), 4, "0")).alias("revision")))
