"""Command line: build or update a tree's state, and ask it."""

from __future__ import annotations

import argparse
import os

from pyspark.sql import SparkSession

from . import render
from .engine import Engine
from .operators.cluster import ClusterConfig
from .sources import graphjson
from .sources.files import OUTPUT
from .sources.store import Store, empty
from .view import GraphView


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="codeloom")
    parser.add_argument("command", choices=("build", "import", "export", "query", "node", "neighbors", "path", "god", "communities", "community", "projects", "stats", "report", "status"))
    parser.add_argument("words", nargs="*", help="what the command asks about")
    parser.add_argument("--root", default=".")
    parser.add_argument("--cluster", choices=("simple", "full", "none"), default="simple")
    parser.add_argument("--cluster-weight", choices=("uniform", "confidence"), default="uniform")
    parser.add_argument("--resolution", type=float, default=1.0)
    parser.add_argument("--scope", choices=("scoped", "global"), default="scoped")
    parser.add_argument("--force", action="store_true")
    parser.add_argument("--limit", type=int, default=10)
    parser.add_argument("--depth", type=int, default=2)
    parser.add_argument("--budget", type=int, default=32)
    parser.add_argument("--mode", choices=("bfs", "dfs"), default="bfs")
    parser.add_argument("--relations", nargs="*", default=[])
    parser.add_argument("--direction", choices=("in", "out", "both"), default="both")
    parser.add_argument("--tokens", type=int, default=2000)
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("codeloom").getOrCreate()
    store = Store(spark, os.path.join(os.path.abspath(args.root), OUTPUT))
    os.makedirs(store.directory, exist_ok=True)
    clusters = None if args.cluster == "none" else ClusterConfig(args.cluster, args.cluster_weight, args.resolution)
    engine = Engine(spark, args.root, store, args.scope, clusters)
    if args.command == "build":
        print(engine.index(args.force))
        return
    if args.command == "import":
        with open(args.words[0], encoding="utf-8") as f:
            store.save(empty(spark) | graphjson.load(spark, f.read()), args.force)
        return
    state = store.load()
    view = GraphView(state)
    if args.command == "export":
        print(graphjson.dump(state["nodes"], state["edges"], state["partition"]))
    elif args.command == "status":
        print(engine.status())
    elif args.command == "report":
        print(render.report_markdown(view.report(args.limit)))
    elif args.command == "query":
        nodes, edges = view.query(" ".join(args.words), args.depth, args.budget, args.mode, args.relations)
        print(render.region_text(nodes.collect(), edges.toLocalIterator(), args.tokens), end="")
    elif args.command == "path":
        print(render.path_text(view.shortest_path(args.words[0], args.words[1])), end="")
    elif args.command == "node":
        for row in view.node(args.words[0]).limit(args.limit).collect():
            print(render.node_line(row))
    else:
        answer = {
            "neighbors": lambda: view.neighbors(args.words[0], args.relations, args.direction, unresolved=True), "god": lambda: view.god_nodes(args.limit),
            "communities": lambda: view.communities(args.limit), "community": lambda: view.community(int(args.words[0])), "projects": view.project_graph, "stats": view.stats,
        }[args.command]()
        answer.show(args.limit if args.command != "stats" else 1, truncate=False)


if __name__ == "__main__":
    main()
