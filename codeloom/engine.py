"""The incremental engine: a change set against a state gives a new state, equal to a cold build's.

State is a set of tables (sources.store.TABLES). A cold build is the first change set. Files are extracted alone, references
are linked by joins, and a warm run links again only the sites that the change may bind differently.
"""

from __future__ import annotations

import time
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F

from .operators import delta, graph, link, modules
from .operators.checkpoints import cut
from .operators.cluster import ClusterConfig, cluster
from .sources import changes as C, extract, files as W, manifests
from .sources.store import MemoryStore, Store, empty

State = dict[str, DataFrame]
EDGE_KEY = [*delta.EDGE_COLUMNS, "recv"]


class ShrinkGuard(RuntimeError):
    """Nodes of files that no change touched would vanish."""


@dataclass
class Report:
    changed: int = 0
    vanished: int = 0
    affected: int = 0
    full: bool = True
    sites: int = 0
    edges_removed: int = 0
    edges_added: int = 0
    seconds: dict[str, float] = field(default_factory=dict)


class Profiler:
    """Wall seconds by stage; Spark jobs carry the stage's name."""

    def __init__(self, spark: SparkSession, report: Report):
        self.context, self.report = spark.sparkContext, report

    @contextmanager
    def stage(self, name: str):
        began = time.monotonic()
        self.context.setJobDescription(name)
        try:
            yield
        finally:
            self.context.setJobDescription(None)
            self.report.seconds[name] = self.report.seconds.get(name, 0.0) + time.monotonic() - began


def attributed(nodes: DataFrame, projects: DataFrame) -> DataFrame:
    """nodes as the link operators take them, with project, impl and returns."""
    placed = link.project_of(nodes.select("source_file").where("source_file IS NOT NULL").distinct(), projects, "source_file")
    rows = nodes.join(placed, "source_file", "left")
    return rows.select(*"id label kind source_file project".split(), F.col("attrs")["impl"].alias("impl"), F.col("attrs")["returns"].alias("returns"))


class Engine:
    def __init__(self, spark: SparkSession, root: str, store: Store | MemoryStore | None = None, scope: str = "scoped", clusters: ClusterConfig | None = ClusterConfig()):
        self.spark, self.root, self.store = spark, root, store or MemoryStore(spark)
        self.scope, self.clusters = scope, clusters

    # --- change detection

    def listing(self, deep: bool = True) -> DataFrame:
        """(path, mtime_ns, language, hash) of the tree: only files whose mtime differs are read, all of them if deep."""
        listed = W.listing(self.spark, self.root)
        want = listed.where(C.is_indexable(F.col("path")))
        known = self.store.load()["manifest"].select("path", F.col("mtime_ns").alias("_m"), F.col("hash").alias("_h"))
        want = want.join(known, "path", "left")
        stale = want if deep else want.where(F.col("_m").isNull() | (F.col("_m") != F.col("mtime_ns")))
        paths = [r["path"] for r in stale.select("path").toLocalIterator()]
        read = W.contents(self.spark, self.root, paths)
        hashes = read.select("path", C.content_hash(F.col("content")).alias("_new"))
        return cut(listed.join(known, "path", "left").join(hashes, "path", "left").select("path", "mtime_ns", "language", F.coalesce("_new", F.when(F.col("_m") == F.col("mtime_ns"), F.col("_h"))).alias("hash")))

    def reconcile(self, deep: bool = True) -> DataFrame:
        """The change set between the tree and the state."""
        return C.reconcile(self.listing(deep), self.store.load()["manifest"], deep)

    def index(self, force: bool = False) -> Report:
        return self.apply(self.reconcile(), force)

    # --- apply

    def apply(self, change_set: DataFrame, force: bool = False, recluster: bool = True, revision: str | None = None) -> Report:
        """change_set(path, op in A/M/D) applied, linked, clustered and stored."""
        report = Report()
        profile = Profiler(self.spark, report)
        prior = self.store.load()
        with profile.stage("detect"):
            listed = W.listing(self.spark, self.root)
            changes = cut(C.fold_vanished(change_set.where(C.is_indexable(F.col("path"))).dropDuplicates(["path"]), listed))
            report.changed, report.vanished = changes.count(), changes.where("vanished").count()
        if not report.changed:
            return report
        with profile.stage("extract"):
            live = [r["path"] for r in changes.where("op <> 'D'").select("path").toLocalIterator()]
            read = cut(W.contents(self.spark, self.root, live))
            new = extract.split(cut(extract.extract(read)))
            touched = changes.select("path")
            dropped = prior["nodes"].join(touched.withColumnRenamed("path", "source_file"), "source_file", "left_semi").select(*prior["nodes"].columns)
            overlay = prior["nodes"].where("kind = 'project'").select("id")
            gone = cut(dropped.select("id").unionByName(overlay).distinct())
            survivors = prior["nodes"].join(gone, "id", "left_anti").select(*prior["nodes"].columns)
            nodes = cut(survivors.unionByName(new["nodes"].select(*survivors.columns)).dropDuplicates(["id"]))
        with profile.stage("front"):
            kept = prior["projects"].select("*", F.when(F.col("root") == "", F.col("manifest")).otherwise(F.concat("root", F.lit("/"), "manifest")).alias("path"))
            kept = kept.join(touched, "path", "left_anti").drop("path")
            fresh = manifests.projects(read)
            projects = cut(kept.join(fresh.select("root"), "root", "left_anti").select(*fresh.columns).unionByName(fresh))
            exports = cut(prior["exports"].join(touched.withColumnRenamed("path", "file"), "file", "left_anti").select(*prior["exports"].columns).unionByName(new["exports"].select(*prior["exports"].columns)))
            refs = cut(link.rebuild_refs(prior["refs"], gone, new["refs"]))
            manifest = self._manifest(prior["manifest"], changes, read, listed, revision)
        with profile.stage("link"):
            known = cut(attributed(nodes, projects))
            asked = self._asked(refs, known, exports)
            target_files = listed.select("path")
            module_of = modules.resolve_modules(asked, target_files, projects)
            scope = cut(link.import_scope(refs, known, exports, cut(module_of)))
            sites, full = self._impact(prior, projects, exports, refs, known, touched, dropped, new["nodes"])
            report.full = full
            todo = refs if full else refs.join(sites, ["source", "relation"], "left_semi").select(*refs.columns)
            linked = cut(link.resolve(todo, known, scope, projects))
            report.sites = sites.count() if sites is not None else refs.select("source", "relation").distinct().count()
        with profile.stage("diff"):
            old = prior["edges"].join(overlay.withColumnRenamed("id", "source"), "source", "left_anti").select(*prior["edges"].columns)
            again = todo.select("source", "relation").distinct()
            carried = delta.carried(old, gone, again)
            code = cut(carried.unionByName(new["edges"].select(*old.columns)).unionByName(linked.select(*old.columns)))
            code = cut(graph.prune_dangling(code, nodes))
            held = link.project_of(nodes.where("kind = 'file'").select("id", F.col("source_file").alias("path")), projects)
            over_nodes, over_edges = link.project_overlay(projects, held)
            blank = F.lit(None)
            over_nodes = over_nodes.select(*"id label kind".split(), blank.cast("string").alias("source_file"), blank.cast("int").alias("span_start"), blank.cast("int").alias("span_end"), "attrs")
            all_nodes = cut(nodes.unionByName(over_nodes.select(*nodes.columns)))
            all_edges = cut(code.unionByName(over_edges.withColumn("recv", blank.cast("string")).select(*code.columns)))
            removed, added = delta.edge_diff(prior["edges"], all_edges, EDGE_KEY)
            report.edges_removed, report.edges_added = removed.count(), added.count()
            vanished = prior["nodes"].join(all_nodes.select("id"), "id", "left_anti")
            if not force and not delta.shrink_violations(vanished, touched).isEmpty():
                raise ShrinkGuard("nodes of untouched files would vanish")
            dirty = link.dirty_names(dropped, new["nodes"])
            report.affected = link.affected_count(new["nodes"], dropped, refs, dirty).first()["affected"]
        with profile.stage("cluster"):
            partition, communities = prior["partition"], prior["communities"]
            if recluster and self.clusters:
                partition, communities = cluster(nodes, code, self.clusters, prior["partition"], prior["communities"])
            else:
                partition = partition.join(nodes.select(F.col("id").alias("node_id")), "node_id", "left_semi")
        with profile.stage("store"):
            state = {"nodes": all_nodes, "edges": all_edges, "refs": refs, "exports": exports, "projects": projects, "manifest": manifest, "partition": cut(partition), "communities": cut(communities)}
            # past the guard on files, fewer nodes than before are what the change set asked for
            self.store.save(state, force=True)
        return report

    def _manifest(self, prior: DataFrame, changes: DataFrame, read: DataFrame, listed: DataFrame, revision: str | None) -> DataFrame:
        kept = prior.join(changes.select("path"), "path", "left_anti").select(*prior.columns)
        live = changes.where("op <> 'D'").select("path").join(listed.select("path", "mtime_ns"), "path")
        return cut(kept.unionByName(W.with_hashes(live, read).withColumn("revision", F.lit(revision).cast("string")).select(*prior.columns)))

    @staticmethod
    def _asked(refs: DataFrame, known: DataFrame, exports: DataFrame) -> DataFrame:
        """(file, specifier) that imports and exports mention."""
        own = known.select(F.col("id").alias("source"), F.col("source_file").alias("file"))
        imports = refs.where((F.col("relation") == "imports") & F.col("specifier").isNotNull()).join(own, "source").select("file", "specifier")
        return imports.unionByName(exports.where(F.col("specifier").isNotNull()).select("file", "specifier")).where(F.col("file").isNotNull()).distinct()

    def _impact(self, prior: State, projects, exports, refs, known, touched, dropped, new_nodes) -> tuple[DataFrame | None, bool]:
        """(sites to link again, whether that is all of them). All, if a project or a touched file's exports changed, for then
        any name may bind differently; also if asked for, or on a cold build."""
        if self.scope == "global" or prior["nodes"].isEmpty():
            return None, True
        canonical = lambda df: df.select("root", "manifest", "name", "entry", F.array_sort("deps").alias("deps"))
        a, b = canonical(projects), canonical(prior["projects"])
        if not a.exceptAll(b).isEmpty() or not b.exceptAll(a).isEmpty():
            return None, True
        at = touched.withColumnRenamed("path", "file")
        x, y = (e.join(at, "file", "left_semi").select("file", "pos", "kind", "name", "specifier", "imported") for e in (exports, prior["exports"]))
        if not x.exceptAll(y).isEmpty() or not y.exceptAll(x).isEmpty():
            return None, True
        if not self._same_files(prior, touched):
            return None, True
        sites = link.impacted_sites(refs, known, touched, link.dirty_names(dropped, new_nodes), prior["edges"], prior["nodes"])
        return cut(sites), False

    def _same_files(self, prior: State, touched: DataFrame) -> bool:
        """Whether the touched files were there before and are there now: else specifiers may resolve to other files."""
        before = touched.join(prior["manifest"].select("path"), "path", "left_anti").isEmpty()
        after = touched.join(W.listing(self.spark, self.root).select("path"), "path", "left_anti").isEmpty()
        return before and after

    # --- clustering and state

    def recluster(self) -> None:
        """Communities of the stored graph again, for applies that left them."""
        state = self.store.load()
        nodes = state["nodes"].where("kind <> 'project'")
        code = state["edges"].where(~F.col("source").startswith("project:"))
        partition, communities = cluster(nodes, code, self.clusters or ClusterConfig(), state["partition"], state["communities"])
        self.store.save(state | {"partition": partition, "communities": communities}, True)

    def status(self) -> dict[str, object]:
        state = self.store.load()
        return {"files": state["manifest"].count(), "nodes": state["nodes"].count(), "edges": state["edges"].count(), "revision": graph.latest(state["manifest"]).first()["revision"]}

    def impact_report(self, change_set: DataFrame) -> DataFrame:
        """(source, relation) of sites that a change of these files may bind differently, were their definitions to change."""
        state = self.store.load()
        known = attributed(state["nodes"], state["projects"])
        touched = change_set.select("path")
        dropped = state["nodes"].join(touched.withColumnRenamed("path", "source_file"), "source_file", "left_semi")
        return link.impacted_sites(state["refs"], known, touched, link.dirty_names(dropped, dropped.limit(0)), state["edges"], state["nodes"])


def empty_state(spark: SparkSession) -> State:
    return empty(spark)
