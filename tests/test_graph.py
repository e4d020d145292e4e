import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from codeloom import render
from codeloom.functions import relations as R
from codeloom.operators import cluster, graph, traverse
from codeloom.operators.cluster import ClusterConfig
from codeloom.sources import store
from codeloom.view import Address, AmbiguousLabel, GraphView

EDGES = store.TABLES["edges"]


@pytest.mark.parametrize(
    "entry, relation, hit",
    [("any", "contains", True), ("semantic", "contains", False), ("semantic", "type/field", True), ("type", "type/field", True), ("type/", "type/param", True), ("type", "typechecks", False), ("calls", "calls", True), ("call", "calls", False), ("type/field", "type", False)],
)
def test_relation_filter(spark, entry, relation, hit):
    assert spark.range(1).select(R.matches(F.lit(relation), [entry]).alias("m")).first()["m"] is hit


def test_questions_and_spans(spark):
    assert R.resolve_questions(["callers"]) == (["calls"], "in")
    assert R.resolve_questions(["callers", "callees", "x"], "out") == (["calls", "x"], "both")
    assert R.resolve_questions(["x", "x"], "out") == (["x"], "out")
    one = spark.range(1).select(R.parse_span(F.lit("L3-L9")).alias("a"), R.parse_span(F.lit("L4")).alias("b"), R.parse_span(F.lit("x")).alias("c"), R.norm_type(F.lit(" a::B<c::D> ")).alias("t"), R.sanitize(F.lit("a\nb")).alias("s")).first()
    assert (tuple(one["a"]), tuple(one["b"]), one["c"], one["t"], one["s"]) == ((3, 9), (4, 4), None, "B", "ab")


def small(spark, rows):
    ids = sorted({i for r in rows for i in (r[0], r[2]) if i})
    nodes = spark.createDataFrame([(i, i.upper(), "function", f"{i}.rs", 1, 1, {}) for i in ids], store.TABLES["nodes"])
    edges = spark.createDataFrame([(s, rel, "EXTRACTED", t, None, None) for s, rel, t in rows], EDGES)
    return nodes, edges


def plain_bfs(edges, seeds, options):
    out, queue, visited, pushed = {}, deque((s, 0) for s in seeds), [], []
    for s, rel, t in sorted(edges, key=lambda e: (e[1], e[2])):
        out.setdefault(s, []).append((rel, t))
    while queue:
        node, depth = queue.popleft() if options.mode == "bfs" else queue.pop()
        if node in visited or len(visited) >= options.budget:
            continue
        visited.append(node)
        if depth >= options.depth:
            continue
        for rel, t in out.get(node, []):
            pushed.append((node, rel, t))
            queue.append((t, depth + 1))
    return visited, pushed


@pytest.mark.parametrize("seed, budget", [(0, 5), (1, 8), (2, 30)])
def test_budgeted_traversals(spark, seed, budget):
    rng = random.Random(seed)
    rows = sorted({(f"n{rng.randint(0, 19)}", "calls", f"n{rng.randint(0, 19)}") for _ in range(45)})
    nodes, edges = small(spark, rows)
    options = traverse.QueryOptions(depth=2, budget=budget)
    seeds = ["n3", "n1"]
    taken, expanded = traverse.bfs(edges, spark.createDataFrame([(s, k) for k, s in enumerate(seeds)], "id string, rank long"), options)
    visited, pushed = plain_bfs(rows, seeds, options)
    assert [r["id"] for r in taken.orderBy("rank").collect()] == visited
    assert sorted((r["source"], r["relation"], r["target_id"]) for r in expanded.collect()) == sorted(pushed)
    deep = traverse.QueryOptions(depth=2, budget=budget, mode="dfs")
    assert [n for n, _ in traverse.dfs(edges, seeds, deep)[0]] == plain_bfs(rows, seeds, deep)[0]


def test_shortest_path_is_least_of_the_shortest(spark):
    rows = [("a", "calls", "c"), ("a", "calls", "b"), ("b", "calls", "d"), ("c", "calls", "d"), ("d", "calls", "a"), ("d", "calls", "e"), ("z", "calls", "z")]
    nodes, edges = small(spark, rows)
    path = lambda *a, **k: traverse.shortest_path(edges, nodes, *a, **k)
    assert path("a", "e") == ["a", "b", "d", "e"] and path("a", "a") == ["a"] and path("a", "z") == [] and path("a", "e", max_hops=2) == [] and path("a", "nobody") == []
    assert {r["id"]: r["hop"] for r in traverse.reach(edges, "a", 9).collect()} == {"a": 0, "b": 1, "c": 1, "d": 2, "e": 3}


def test_clustering(spark):
    clique = lambda names: [(a, "calls", b) for a in names for b in names if a < b]
    rows = clique("abcd") + clique("wxyz") + [("d", "calls", "w")]
    nodes, edges = small(spark, rows)
    for config in (ClusterConfig(), ClusterConfig("full"), ClusterConfig(weighting="confidence"), ClusterConfig(most_pairs=0)):
        partition, meta = cluster.cluster(nodes, edges, config)
        groups = {}
        for r in partition.collect():
            groups.setdefault(r["community_id"], set()).add(r["node_id"])
        assert sorted(map(sorted, groups.values())) == [list("abcd"), list("wxyz")]
        assert {(r["size"], r["cohesion_permille"]) for r in meta.collect()} == {(4, 857)}
    known = spark.createDataFrame([(n, 7) for n in "wxyz"] + [(n, 3) for n in "abc"], "node_id string, community_id long")
    names = spark.createDataFrame([(7, "kept", 4, 0)], "id long, label string, size long, cohesion_permille int")
    partition, meta = cluster.cluster(nodes, edges, ClusterConfig(), known, names)
    assert {r["node_id"]: r["community_id"] for r in partition.collect()} == {**{n: 7 for n in "wxyz"}, **{n: 3 for n in "abcd"}}
    assert {r["id"]: r["label"] for r in meta.collect()} == {7: "kept", 3: "Community 3"}
    fine, _ = cluster.cluster(nodes, edges, ClusterConfig(resolution=9.0))
    assert fine.select("community_id").distinct().count() > 2


def plain_synchronous(ids, pairs, odd, rounds=12):
    near, label = {i: {} for i in ids}, {i: i for i in ids}
    for a, b, w in pairs:
        near[a][b] = near[b][a] = w
    degree, total = {i: sum(near[i].values()) for i in ids}, sum(w for *_, w in pairs)
    still = 0
    for r in range(rounds):
        tot, new = {}, dict(label)
        for i in ids:
            tot[label[i]] = tot.get(label[i], 0.0) + degree[i]
        for i in (i for i in ids if odd[i] == r % 2 and near[i]):
            k = {}
            for j, w in near[i].items():
                k[label[j]] = k.get(label[j], 0.0) + w
            new[i] = max((k[c] - (tot[c] - (degree[i] if c == label[i] else 0.0)) * degree[i] / (2 * total), c == label[i], c) for c in k)[2]
        still, label = (still + 1 if new == label else 0), new
        if still == 2:
            break
    return label


def test_synchronous_rounds_leave_out_leaves(spark, monkeypatch):
    """The same moves as in plain Python, and after two rounds no step holds the leaves of a node one by one."""
    rng = random.Random(5)
    links = {tuple(sorted(rng.sample([f"h{k}" for k in range(9)], 2))) for _ in range(16)} | {(f"h{rng.randint(0, 8)}", f"leaf{k}") for k in range(400)} | {("q1", "q2")}
    pairs = [(a, b, rng.choice([1.0, 0.5])) for a, b in sorted(links)]
    ids = sorted({i for link in links for i in link} | {"lone"})
    nodes = spark.createDataFrame([(i,) for i in ids], "id string")
    odd = {r["id"]: r["o"] for r in nodes.select("id", F.pmod(F.xxhash64("id"), F.lit(2)).alias("o")).collect()}
    sizes, cut = [], cluster.cut
    monkeypatch.setattr(cluster, "cut", lambda df: (done := cut(df), sizes.append(done.count()))[0])
    got = cluster._synchronous(nodes, spark.createDataFrame(pairs, "u string, v string, w double"), ClusterConfig())
    assert {r["node_id"]: r["group"] for r in got.collect()} == plain_synchronous(ids, pairs, odd)
    assert len(sizes) > 8 and max(sizes[-3:]) < 60


@pytest.mark.parametrize("most, filtered", [(200_000, 10_000_000), (2, 10_000_000), (20, 10_000_000), (2, 0)])
def test_edges_with_absent_ends_are_told_apart_where_they_are(spark, monkeypatch, most, filtered):
    """By the absent ids, by a filter of them, or by joins: the same edges; only the last way moves edges."""
    from codeloom.operators import delta, filters

    rng = random.Random(8)
    monkeypatch.setattr(filters, "MOST_BROADCAST", most)
    monkeypatch.setattr(filters, "MOST_FILTERED", filtered)
    monkeypatch.setattr(filters, "_BITS_A_KEY", 6 if most == 20 else 24)  # some existing ids are hit as well
    ids = [f"n{k}" for k in range(0, 60, 2)]
    rows = [(f"n{rng.randint(0, 59)}" if rng.random() < 0.97 else None, "calls", "EXTRACTED", None if rng.random() < 0.2 else f"n{rng.randint(0, 59)}", "x") for _ in range(600)]
    edges, nodes = spark.createDataFrame(rows, "source string, relation string, confidence string, target_id string, target_name string"), spark.createDataFrame([(i,) for i in ids], "id string")
    want = [r for r in rows if r[0] in ids and (r[3] is None or r[3] in ids)]
    same = lambda got, rows: sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, rows))
    found = graph.prune_dangling(edges, nodes)
    assert same(found, want) and same(graph.resolved(edges, nodes), [r for r in want if r[3]])
    if filtered:
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and "hashpartitioning" not in plan
    gone = rows[:50] + [("a", "calls", "EXTRACTED", "b", None)]
    left = list(rows)
    for r in gone:
        if r in left:
            left.remove(r)
    assert same(delta.subtract(edges, spark.createDataFrame(gone, edges.schema)), left)


def test_god_nodes_count_without_moving_edges(spark):
    """Edges are joined with nodes only where an end is absent, and then don't count."""
    rows = [("a", "calls", "b"), ("a", "calls", "b"), ("b", "calls", "c"), ("c", "contains", "a")]
    nodes, edges = small(spark, rows)
    found = graph.god_nodes(edges, nodes, 2)
    assert [(r["id"], r["degree"]) for r in found.collect()] == [("b", 3), ("a", 2)]
    assert "LeftSemi" not in found._jdf.queryExecution().optimizedPlan().toString()
    _, more = small(spark, [*rows, *[("c", "calls", "gone")] * 5, ("gone", "calls", "a")])
    assert [(r["id"], r["degree"]) for r in graph.god_nodes(more, nodes, 3).collect()] == [("b", 3), ("a", 2), ("c", 1)]


def test_edge_diff_counts_after_the_exchange(spark):
    """A multiset difference, nulls alike; no task counts the edges that it reads, and none gets parts put together."""
    from codeloom.operators import delta

    schema = "source string, relation string, confidence string, target_id string, target_name string"
    a = [("a", "calls", "EXTRACTED", "b", None)] * 3 + [("a", "calls", "EXTRACTED", None, "x")] * 2 + [(None, "calls", None, None, None)]
    b = [("a", "calls", "EXTRACTED", "b", None)] + [("a", "calls", "EXTRACTED", None, "x")] * 4 + [("c", "calls", "EXTRACTED", "b", None)]
    removed, added = delta.edge_diff(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema))
    assert sorted(map(str, map(tuple, removed.collect()))) == sorted(map(str, a[:2] + a[-1:]))
    assert sorted(map(str, map(tuple, added.collect()))) == sorted(map(str, b[1:3] + b[-1:]))
    for side in (removed, added):
        assert side.rdd.getNumPartitions() == 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_traversals_keep_edges_in_even_parts(spark):
    """Edges read as one part, most of them of one hub, are kept in as many as the session sets."""
    rows = [("hub", "calls", f"n{k}") for k in range(400)] + [("n7", "calls", "end")]
    edges = spark.createDataFrame([(s, rel, "EXTRACTED", t, None, None) for s, rel, t in rows], EDGES).coalesce(1)
    kept = traverse._kept(edges)
    sizes = kept.rdd.mapPartitions(lambda part: [sum(1 for _ in part)]).collect()
    assert len(sizes) == int(spark.conf.get("spark.sql.shuffle.partitions")) and max(sizes) < 200
    kept.unpersist()
    assert {r["id"]: r["hop"] for r in traverse.reach(edges, "hub", 3).collect()} == {"hub": 0, **{f"n{k}": 1 for k in range(400)}, "end": 2}


def test_claims():
    assert cluster.claims([(0, 5, 2), (1, 5, 3), (0, 2, 2)], [0, 1, 2], [5, 2]) == {1: 5, 0: 2, 2: 0}


def test_agreement(spark):
    a = spark.createDataFrame([(k, k % 3) for k in range(12)], "node_id long, community_id long")
    one = graph.agreement(a, a).first()
    assert (one["n"], one["nmi"], one["ari"]) == (12, 1.0, 1.0)
    other = graph.agreement(a, spark.createDataFrame([(k, k // 4) for k in range(12)], "node_id long, community_id long")).first()
    assert other["nmi"] < 0.2 and other["ari"] < 0.1


@pytest.fixture(scope="module")
def view(spark):
    nodes = spark.createDataFrame([("fn:a:go", "go", "function", "a.rs", 1, 2, {}), ("fn:b:go", "go", "function", "b.rs", 1, 2, {}), ("type:a:T", "T", "struct", "a.rs", 3, 4, {}), ("file:a.rs", "a.rs", "file", "a.rs", None, None, {})], store.TABLES["nodes"])
    edges = spark.createDataFrame(
        [("fn:a:go", "calls", "INFERRED", "fn:b:go", None, None), ("fn:b:go", "type/param", "EXTRACTED", "type:a:T", None, None), ("fn:b:go", "calls", "EXTRACTED", None, "T", "opaque"), ("file:a.rs", "contains", "EXTRACTED", "fn:a:go", None, None), ("type:a:T", "calls", "EXTRACTED", "gone", None, None)], EDGES,
    )
    partition = spark.createDataFrame([("fn:a:go", 0), ("fn:b:go", 1), ("type:a:T", 1)], "node_id string, community_id long")
    projects = spark.createDataFrame([("", "Cargo.toml", "top", None, [])], store.TABLES["projects"])
    communities = spark.createDataFrame([(0, "x", 1, 0), (1, "y", 2, 0)], store.TABLES["communities"])
    return GraphView(store.empty(spark) | {"nodes": nodes, "edges": edges, "partition": partition, "projects": projects, "communities": communities})


def test_view_questions(view):
    assert view.node("T").first()["id"] == "type:a:T" and view.node("go").count() == 2 and view.node(Address(label="go", source="b.rs")).count() == 1
    with pytest.raises(AmbiguousLabel):
        view.the_id("go")
    with pytest.raises(LookupError):
        view.the_id("none")
    assert {(r["direction"], r["id"]) for r in view.neighbors("fn:b:go", unresolved=True).collect()} == {("in", "fn:a:go"), ("out", "type:a:T"), ("out", "unresolved-T")}
    assert [r["id"] for r in view.neighbors("type:a:T", ["takes"]).collect()] == ["fn:b:go"] and view.unresolved_count("type:a:T") == 1
    assert [(s["id"], s["relation"]) for s in view.shortest_path("fn:a:go", "T")] == [("fn:a:go", None), ("fn:b:go", "calls"), ("type:a:T", "type/param")]
    assert [r["id"] for r in view.god_nodes(2).collect()] == ["fn:b:go", "type:a:T"]
    assert view.community(1).count() == 2 and view.communities(1).first()["n_total"] == 2
    assert view.stats().first()["n_edges"] == 5 and view.bridges().count() == 1
    assert [(r["root"], r["files"]) for r in view.project_graph().collect()] == [("", 1)]
    view.close()


def test_text(view):
    nodes, edges = view.query("go", relations=["any"])
    text = render.region_text(nodes.collect(), edges.collect(), 2000)
    assert "NODE go function fn:a:go (a.rs)" in text and "EDGE fn:a:go -calls-> fn:b:go INFERRED" in text
    assert render.region_text([], []) == "nothing matches\n"
    cut, left = render.within_budget("NODE a\nNODE b\nEDGE c\n", 3)
    assert (cut, left) == ("NODE a\n", 1)
    assert render.path_text([]) == "no path\n" and render.path_text(view.shortest_path("fn:a:go", "fn:b:go")) == "go -calls/INFERRED-> go\n"
    report = render.report_markdown(view.report())
    assert "## Bridges" in report and "| fn:b:go |" in report
