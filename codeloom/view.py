"""The read surface over a state: nine questions, status and a report, as DataFrames, small answers as Python values."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from .functions import relations as R
from .operators import graph, link, traverse
from .operators.traverse import QueryOptions


class AmbiguousLabel(LookupError):
    """Several nodes have the label; the message lists some."""


@dataclass(frozen=True)
class Address:
    """A node by id, or by label and perhaps source file. What holds a colon is an id."""

    id: str | None = None
    label: str | None = None
    source: str | None = None

    @classmethod
    def parse(cls, text: str, source: str | None = None) -> Address:
        return cls(id=text) if ":" in text else cls(label=text, source=source)


class GraphView:
    """Questions about one state (nodes, edges, partition, communities, projects ...); edges with missing ends are left out of traversals."""

    def __init__(self, state: dict[str, DataFrame]):
        self.state = state
        self.nodes, self.edges, self.partition = state["nodes"], state["edges"], state["partition"]
        self._resolved: DataFrame | None = None
        self._labels: DataFrame | None = None

    @property
    def resolved(self) -> DataFrame:
        """Edges with both ends, worked out once and kept for further questions."""
        if self._resolved is None:
            self._resolved = graph.resolved(self.edges, self.nodes).persist()
        return self._resolved

    @property
    def community_labels(self) -> DataFrame:
        if self._labels is None:
            self._labels = graph.community_labels(self.edges, self.nodes, self.partition).persist()
        return self._labels

    def close(self) -> None:
        for held in (self._resolved, self._labels):
            if held is not None:
                held.unpersist()
        self._resolved = self._labels = None

    # --- single nodes

    def node(self, address: Address | str) -> DataFrame:
        """The node's row with its community; all homonyms of a label."""
        address = Address.parse(address) if isinstance(address, str) else address
        found = self.nodes.where(F.col("id") == address.id) if address.id else graph.nodes_by_label(self.nodes, address.label or "", address.source)
        return found.join(self.partition.withColumnRenamed("node_id", "id"), "id", "left").join(self.community_labels.withColumnRenamed("label", "community"), "community_id", "left")

    def the_id(self, address: Address | str) -> str:
        """The one id that an address means."""
        address = Address.parse(address) if isinstance(address, str) else address
        if address.id:
            return address.id
        ids = [r["id"] for r in graph.nodes_by_label(self.nodes, address.label or "", address.source).select("id").orderBy("id").limit(9).collect()]
        if not ids:
            raise LookupError(f"no node is called {address.label}")
        if len(ids) > 1:
            raise AmbiguousLabel(f"{address.label} may be {', '.join(ids[:8])}{' ...' if len(ids) > 8 else ''}")
        return ids[0]

    def neighbors(self, address: Address | str, relations: Iterable[str] = (), direction: str = "both", unresolved: bool = False) -> DataFrame:
        """Adjacent nodes by relation family; named questions settle the direction. Unresolved names come as stubs if asked for."""
        id_ = self.the_id(address)
        entries, direction = R.resolve_questions(R.normalized(relations), direction)
        entries = R.normalized(entries)
        found = graph.neighbors(self.edges, self.nodes, id_, entries, direction)
        if not unresolved:
            return found
        wanted = R.matches(F.col("relation"), entries)
        if direction in ("out", "both"):
            out = graph.unresolved_out(self.edges, id_).where(wanted)
            found = found.unionByName(out.select(F.lit("out").alias("direction"), "relation", "confidence", F.concat(F.lit("unresolved-"), "target_name").alias("id"), F.col("target_name").alias("label"), F.lit("unresolved").alias("kind")))
        if direction in ("in", "both"):
            label = self.nodes.where(F.col("id") == id_).select("label").first()
            named = graph.unresolved_in_by_label(self.edges, self.nodes, label["label"] if label else "").where(wanted)
            found = found.unionByName(named.select(F.lit("in").alias("direction"), "relation", "confidence", "id", "label", "kind"))
        return found

    def unresolved_count(self, address: Address | str) -> int:
        """How many edges name the node's label without a target."""
        return graph.unresolved_in_by_label(self.edges, self.nodes, self.node(address).first()["label"]).count()

    # --- regions and paths

    def query(self, text: str, depth: int = 2, budget: int = 32, mode: str = "bfs", relations: Iterable[str] = ()) -> tuple[DataFrame, DataFrame]:
        """(nodes in visiting order with community, edges) around what text finds."""
        entries, _ = R.resolve_questions(R.normalized(relations))
        taken, edges = traverse.query(self.nodes, self.edges, text, QueryOptions(depth, budget, mode, tuple(entries)))
        nodes = taken.join(self.nodes, "id").join(self.partition.withColumnRenamed("node_id", "id"), "id", "left")
        return nodes.join(self.community_labels.withColumnRenamed("label", "community"), "community_id", "left").orderBy("rank"), edges

    def shortest_path(self, start: Address | str, end: Address | str, max_hops: int = 8) -> list[dict]:
        """The path's nodes in order, each with the relation and confidence that lead to it; empty if there is none."""
        ids = traverse.shortest_path(self.edges, self.nodes, self.the_id(start), self.the_id(end), max_hops)
        labels = {r["id"]: r["label"] for r in self.nodes.where(F.col("id").isin(ids)).select("id", "label").collect()} if ids else {}
        out = []
        for k, id_ in enumerate(ids):
            edge = graph.edge_between(self.edges, ids[k - 1], id_).first() if k else None
            out.append({"id": id_, "label": labels.get(id_), "relation": edge["relation"] if edge else None if not k else "?", "confidence": edge["confidence"] if edge else None})
        return out

    # --- rankings and summaries

    def god_nodes(self, limit: int = 10) -> DataFrame:
        return graph.god_nodes(self.edges, self.nodes, limit)

    def summaries(self) -> DataFrame:
        return graph.community_summaries(self.edges, self.nodes, self.partition)

    def communities(self, limit: int = 20) -> DataFrame:
        return graph.list_communities(self.summaries(), limit)

    def community(self, community_id: int) -> DataFrame:
        """Members in id order."""
        return graph.community_members(self.nodes, self.partition, community_id).orderBy("id")

    def stats(self) -> DataFrame:
        return graph.stats(self.nodes, self.edges, self.state["communities"])

    def bridges(self) -> DataFrame:
        return graph.bridges(self.edges, self.partition).orderBy("from_community", "to_community", "source", "target_id")

    def project_graph(self) -> DataFrame:
        projects = self.state["projects"]
        files = self.nodes.where("kind = 'file'").select(F.col("source_file").alias("path"))
        return link.project_graph(projects, link.project_of(files, projects)).orderBy("root")

    def report(self, top: int = 20) -> dict[str, DataFrame]:
        return {
            "projects": self.project_graph(), "stats": self.stats(), "confidence": graph.confidence_mix(self.edges), "god_nodes": self.god_nodes(top),
            "communities": self.communities(top), "bridges": self.bridges(),
        }
