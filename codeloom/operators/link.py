"""Linking references to definitions.

nodes(id, label, kind, source_file, project, impl, returns), refs(source, relation, name, type_hint, specifier, imported,
recv_opaque, recv_returns, recv_returns_owner). The cascade needs of a name's candidates only how many there are
and the least id, for a project, for an owner type, for a file; so candidates are aggregated to those keys and
joined by equality. A name that very many nodes share is one row for each key, never a list.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.relations import AMBIGUOUS, CONTAINS, DEPENDS_ON, EXTRACTED, INFERRED, LINKABLE, ancestors, norm_type

REF_COLUMNS = ["source", "relation", "name", "type_hint", "specifier", "imported", "recv_opaque", "recv_returns", "recv_returns_owner"]
REF_SCHEMA = "source string, relation string, name string, type_hint string, specifier string, imported string, recv_opaque boolean, recv_returns string, recv_returns_owner string"
_ALL = "*"


def _pool(project: Column) -> Column:
    return F.when(project.isNull(), F.lit("n")).otherwise(F.concat(F.lit("p:"), project))


def linkable(nodes: DataFrame) -> DataFrame:
    return nodes.where(F.col("kind").isin(*LINKABLE))


def candidates(nodes: DataFrame) -> dict[str, DataFrame]:
    """Counts and least ids of linkable nodes by (name, pool), with owner type, with file; distinct return types by
    (name, pool), with owner type. A pool is one project, no project, or all of them."""
    base = linkable(nodes).select(
        F.col("label").alias("name"), F.explode(F.array(_pool(F.col("project")), F.lit(_ALL))).alias("pool"), "id",
        norm_type(F.col("impl")).alias("owner"), F.col("source_file").alias("file"), "returns",
    )
    count = lambda keys, n, least: base.groupBy(*keys).agg(F.count("*").alias(n), F.min("id").alias(least))
    returning = base.where(F.col("returns").isNotNull())
    types = lambda keys: returning.groupBy(*keys).agg(F.min("returns").alias("r0"), F.max("returns").alias("r1"))
    one = lambda df, keys: df.where("r0 = r1").select(*keys, norm_type(F.col("r0")).alias("typed"))
    return {
        "pool": count(["name", "pool"], "n_pool", "id_pool"),
        "owner": count(["name", "pool", "owner"], "n_owner", "id_owner").where(F.col("owner").isNotNull()),
        "file": count(["name", "pool", "file"], "n_file", "id_file").where(F.col("file").isNotNull()),
        "returns": one(types(["name", "pool"]), ["name", "pool"]),
        "returns_owner": one(types(["name", "pool", "owner"]).where(F.col("owner").isNotNull()), ["name", "pool", "owner"]),
    }


def with_sources(refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """refs with src_project and src_file of the node that they are made in."""
    own = nodes.select(F.col("id").alias("source"), F.col("project").alias("src_project"), F.col("source_file").alias("src_file"))
    return refs.join(own, "source", "left")


def with_receiver_types(refs: DataFrame, found: dict[str, DataFrame]) -> DataFrame:
    """refs with type_hint and recv_opaque as the callee's return type settles them: the one type that all candidates
    of the source's project (and owner type) return, or an opaque receiver."""
    refs = refs.withColumn("_pool", _pool(F.col("src_project"))).withColumn("_owner", norm_type(F.col("recv_returns_owner")))
    named = found["returns"].select(F.col("name").alias("recv_returns"), F.col("pool").alias("_pool"), F.col("typed").alias("_t"))
    owned = found["returns_owner"].select(F.col("name").alias("recv_returns"), F.col("pool").alias("_pool"), F.col("owner").alias("_owner"), F.col("typed").alias("_to"))
    refs = refs.join(named, ["recv_returns", "_pool"], "left").join(owned, ["recv_returns", "_pool", "_owner"], "left")
    typed = F.when(F.col("recv_returns_owner").isNull(), F.col("_t")).otherwise(F.col("_to"))
    deferred = F.col("recv_returns").isNotNull()
    return (
        refs.withColumn("type_hint", F.when(deferred, typed).otherwise(F.col("type_hint")))
        .withColumn("recv_opaque", F.when(deferred, F.col("type_hint").isNull()).otherwise(F.coalesce("recv_opaque", F.lit(False))))
        .drop("_pool", "_owner", "_t", "_to")
    )


def crate_names(projects: DataFrame) -> DataFrame:
    """(crate, crate_root): project names with _ as -, the first root of each."""
    named = projects.where(F.col("name").isNotNull())
    return named.groupBy(F.translate("name", "_", "-").alias("crate")).agg(F.min("root").alias("crate_root"))


def attempts(refs: DataFrame, found: dict[str, DataFrame], projects: DataFrame | None) -> DataFrame:
    """refs with a row for each name to try in order: try_no, tried, cross (other projects allowed), crate_root.

    A name whose head is a project's is tried as it is if it has candidates; else without the head and then by its
    last segment, other projects allowed, and last as it is.
    """
    if projects is None:
        return refs.select("*", F.lit(0).alias("try_no"), F.col("name").alias("tried"), F.lit(False).alias("cross"), F.lit(None).cast("string").alias("crate_root"))
    refs = refs.withColumn("crate", F.when(F.instr("name", "::") > 0, F.translate(F.substring_index("name", "::", 1), "_", "-")))
    refs = refs.join(crate_names(projects), "crate", "left").withColumnRenamed("crate_root", "_root")
    whole = found["pool"].where(F.col("pool") == _ALL).select("name", F.lit(True).alias("_known"))
    refs = refs.join(whole, "name", "left")
    rest = F.expr("substring(name, instr(name, '::') + 2)")
    none = F.lit(None).cast("string")
    make = lambda n, tried, cross, root: F.struct(F.lit(n).alias("try_no"), tried.alias("tried"), F.lit(cross).alias("cross"), root.alias("crate_root"))
    plain = lambda root: F.array(make(0, F.col("name"), False, root))
    ladder = F.array(make(0, rest, True, F.col("_root")), make(1, F.substring_index("name", "::", -1), True, none), make(2, F.col("name"), False, none))
    short = F.array(make(0, rest, True, F.col("_root")), make(2, F.col("name"), False, none))
    tries = F.when(F.col("_root").isNull(), plain(none)).when(F.col("_known"), plain(F.col("_root"))).when(F.instr(rest, "::") > 0, ladder).otherwise(short)
    return refs.select("*", F.explode(tries).alias("_try")).select("*", "_try.*").drop("_try", "_root", "_known", "crate")


def resolve(refs: DataFrame, nodes: DataFrame, import_scope: DataFrame | None = None, projects: DataFrame | None = None) -> DataFrame:
    """(source, relation, confidence, target_id, target_name, recv): an edge for each row of refs.

    In this order: what the file imports by that name; no candidate in the project; a type hint decides by the owner
    type alone; the file's own definition; an opaque receiver declines; one candidate is inferred; of several the
    least id is ambiguous. An unresolved edge keeps the name and counts as extracted.
    """
    found = candidates(nodes)
    rows = with_receiver_types(with_sources(refs, nodes), found).withColumn("_ref", F.struct(*REF_COLUMNS) if set(REF_COLUMNS) <= set(refs.columns) else F.struct(*refs.columns))
    rows = attempts(rows, found, projects)
    every = found["pool"].where(F.col("pool") == _ALL).select(F.col("name").alias("tried"), F.col("n_pool").alias("n_all"))
    rows = rows.join(every, "tried", "left")
    home = _pool(F.col("src_project"))
    narrowed = F.col("crate_root").isNotNull() & (F.coalesce("n_all", F.lit(0)) > 1)
    crate = F.concat(F.lit("p:"), F.col("crate_root"))
    pool = F.when(narrowed, F.when(F.col("cross") | (crate == home), crate)).when(F.col("cross"), F.lit(_ALL)).otherwise(home)
    rows = rows.withColumn("pool", pool).withColumn("owner", norm_type(F.col("type_hint"))).withColumn("_narrow", narrowed).withColumn("_crate", F.when(narrowed, crate))
    key = lambda df: df.withColumnRenamed("name", "tried")
    rows = rows.join(key(found["pool"]), ["tried", "pool"], "left")
    rows = rows.join(key(found["owner"]), ["tried", "pool", "owner"], "left")
    rows = rows.join(key(found["file"]).withColumnRenamed("file", "src_file"), ["tried", "pool", "src_file"], "left")
    there = found["pool"].select(F.col("name").alias("tried"), F.col("pool").alias("_crate"), F.lit(True).alias("_in_crate"))
    rows = rows.join(there, ["tried", "_crate"], "left")
    if import_scope is not None:
        scope = import_scope.select(F.col("file").alias("src_file"), F.col("name").alias("tried"), F.col("def_id").alias("imported_id"))
        rows = rows.join(scope, ["src_file", "tried"], "left")
    else:
        rows = rows.withColumn("imported_id", F.lit(None).cast("string"))
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    choose = lambda node, confidence: F.struct(node.alias("t"), F.lit(confidence).alias("c"))
    symbol = choose(F.lit(None).cast("string"), EXTRACTED)
    hinted = F.col("type_hint").isNotNull()
    target = (
        F.when(F.col("_narrow") & F.col("_in_crate").isNull(), symbol)
        .when(F.col("imported_id").isNotNull(), choose(F.col("imported_id"), EXTRACTED))
        .when(n("n_pool") == 0, symbol)
        .when(hinted & (n("n_owner") == 0), symbol)
        .when(hinted & (n("n_owner") == 1), choose(F.col("id_owner"), EXTRACTED))
        .when(hinted, choose(F.col("id_owner"), AMBIGUOUS))
        .when(n("n_file") == 1, choose(F.col("id_file"), EXTRACTED))
        .when(n("n_file") > 1, choose(F.col("id_file"), AMBIGUOUS))
        .when(F.col("recv_opaque"), symbol)
        .when(n("n_pool") == 1, choose(F.col("id_pool"), INFERRED))
        .otherwise(choose(F.col("id_pool"), AMBIGUOUS))
    )
    rows = rows.withColumn("_e", target)
    if projects is not None:
        rank = F.struct(F.col("_e.t").isNull(), F.when(F.col("_e.t").isNull(), -F.col("try_no")).otherwise(F.col("try_no")))
        rows = rows.groupBy("_ref").agg(F.min_by(F.struct("source", "relation", "name", "recv_opaque", "_e"), rank).alias("_b")).select("_b.*")
    bound = F.col("_e.t").isNotNull()
    return rows.select(
        "source", "relation", F.col("_e.c").alias("confidence"), F.col("_e.t").alias("target_id"),
        F.when(~bound, F.col("name")).alias("target_name"), F.when(~bound & F.col("recv_opaque"), F.lit("opaque")).alias("recv"),
    )


def project_of(paths: DataFrame, projects: DataFrame, path: str = "path") -> DataFrame:
    """paths with project: the longest root that is the path or a directory above it; null if there is none."""
    roots = projects.select(F.col("root").alias("_up"))
    found = paths.select(path).distinct().select(path, F.explode(ancestors(F.col(path))).alias("_up")).join(roots, "_up")
    return paths.join(found.groupBy(path).agg(F.max_by("_up", F.length("_up")).alias("project")), path, "left")


def depends_on(projects: DataFrame) -> DataFrame:
    """(root, dep_root): dependencies that are projects themselves, none on itself; of one name the last root counts."""
    names = projects.where(F.col("name").isNotNull()).groupBy("name").agg(F.max("root").alias("dep_root"))
    wanted = projects.select("root", F.explode("deps").alias("name"))
    return wanted.join(names, "name").where("root <> dep_root").select("root", "dep_root").distinct()


def project_graph(projects: DataFrame, file_projects: DataFrame) -> DataFrame:
    """(root, name, manifest, files, depends_on array) with file_projects(path, project)."""
    files = file_projects.where(F.col("project").isNotNull()).groupBy(F.col("project").alias("root")).agg(F.count("*").alias("files"))
    deps = depends_on(projects).groupBy("root").agg(F.array_sort(F.collect_set("dep_root")).alias("depends_on"))
    found = projects.select("root", "name", "manifest").join(files, "root", "left").join(deps, "root", "left")
    return found.select("root", "name", "manifest", F.coalesce("files", F.lit(0)).alias("files"), F.coalesce("depends_on", F.array().cast("array<string>")).alias("depends_on"))


def project_overlay(projects: DataFrame, file_nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) for projects: one node each, depends_on between them, contains to each file. file_nodes(id, path, project)."""
    label = F.coalesce("name", F.when(F.col("root") == "", F.lit("<root>")).otherwise(F.col("root")))
    pid = lambda c: F.concat(F.lit("project:"), F.col(c))
    attrs = F.map_filter(F.create_map(F.lit("root"), F.col("root"), F.lit("manifest"), F.col("manifest"), F.lit("name"), F.col("name")), lambda _, v: v.isNotNull())
    nodes = projects.select(pid("root").alias("id"), label.alias("label"), F.lit("project").alias("kind"), attrs.alias("attrs"))
    edge = lambda df, source, relation, target: df.select(source.alias("source"), F.lit(relation).alias("relation"), F.lit(EXTRACTED).alias("confidence"), target.alias("target_id"), F.lit(None).cast("string").alias("target_name"))
    deps = edge(depends_on(projects), pid("root"), DEPENDS_ON, pid("dep_root"))
    held = edge(file_nodes.where(F.col("project").isNotNull()), pid("project"), CONTAINS, F.col("id"))
    return nodes, deps.unionByName(held)


EXTENSIONS = tuple("ts tsx mts cts js jsx mjs cjs json".split())


def probe(paths: DataFrame, files: DataFrame, path: str = "path") -> DataFrame:
    """paths with file: the path itself if it is in files(path), else with the first extension, else its index file with
    the first extension that is."""
    names = [F.lit(""), *(F.lit("." + e) for e in EXTENSIONS), *(F.lit("/index." + e) for e in EXTENSIONS)]
    tried = paths.select(path).distinct().select(path, F.posexplode(F.array(*names)).alias("_n", "_suffix"))
    known = files.select(F.col("path").alias("_file")).distinct()
    hit = tried.withColumn("_file", F.concat(path, "_suffix")).join(known, "_file")
    return paths.join(hit.groupBy(path).agg(F.min_by("_file", F.col("_n")).alias("file")), path, "left")


def joined_path(directory: Column, relative: Column) -> Column:
    """directory/relative with . and .. worked out."""
    parts = F.filter(F.split(F.concat(directory, F.lit("/"), relative), "/"), lambda p: (p != "") & (p != "."))
    step = lambda acc, p: F.when(p == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(p)))
    return F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")


def rebuild_refs(prior: DataFrame, dropped_sources: DataFrame, new: DataFrame) -> DataFrame:
    """Prior refs whose source(id) survives and new ones, each once."""
    gone = dropped_sources.select(F.col("id").alias("source"))
    return prior.join(gone, "source", "left_anti").select(*REF_COLUMNS).unionByName(new.select(*REF_COLUMNS)).distinct()


def merged_refs(prior: DataFrame, dropped_sources: DataFrame, added: DataFrame) -> DataFrame:
    return rebuild_refs(prior, dropped_sources, added)


def dirty_names(dropped: DataFrame, new: DataFrame) -> DataFrame:
    """(name) of linkable nodes that a change drops or makes."""
    return linkable(dropped).select(F.col("label").alias("name")).unionByName(linkable(new).select(F.col("label").alias("name"))).distinct()


def impacted_sites(refs: DataFrame, nodes: DataFrame, touched: DataFrame, dirty: DataFrame, prior_edges: DataFrame | None = None, prior_nodes: DataFrame | None = None) -> DataFrame:
    """(source, relation) of refs that a change of the touched(path) files may bind differently.

    Those made in a touched file; whose name, last segment, or receiver's callee is dirty; and those whose prior
    edge ends in a touched file, whatever name they used.
    """
    rows = with_sources(refs, nodes)
    names = dirty.select(F.col("name").alias("_n")).distinct()
    files = touched.select(F.col("path").alias("src_file")).distinct()
    site = lambda df: df.select("source", "relation")
    stripped = F.expr("CASE WHEN instr(name, '::') > 0 THEN substring(name, instr(name, '::') + 2) END")
    keys = F.explode(F.array_distinct(F.array_compact(F.array("name", F.substring_index("name", "::", -1), stripped, F.col("recv_returns"))))) if "recv_returns" in refs.columns else F.explode(F.array_distinct(F.array_compact(F.array("name", F.substring_index("name", "::", -1), stripped))))
    found = site(rows.join(files, "src_file", "left_semi")).unionByName(site(rows.withColumn("_n", keys).join(names, "_n", "left_semi")))
    if prior_edges is not None and prior_nodes is not None:
        there = prior_nodes.select(F.col("id").alias("target_id"), F.col("source_file").alias("path")).join(touched.select("path"), "path", "left_semi")
        found = found.unionByName(site(prior_edges.join(there, "target_id", "left_semi")).join(refs.select("source", "relation").distinct(), ["source", "relation"], "left_semi"))
    return found.distinct()


def affected_count(new: DataFrame, removed: DataFrame, refs: DataFrame, dirty: DataFrame) -> DataFrame:
    """One row: nodes new and removed, and distinct sources that name a dirty label."""
    referrers = refs.join(dirty, "name", "left_semi").agg(F.countDistinct("source").alias("r"))
    total = new.agg(F.count("*").alias("a")).crossJoin(removed.agg(F.count("*").alias("b"))).crossJoin(referrers)  # one row each
    return total.select((F.col("a") + F.col("b") + F.col("r")).alias("affected"))


def healed_refs(refs: DataFrame, prior_edges: DataFrame, prior_nodes: DataFrame, import_claims: DataFrame | None = None) -> DataFrame:
    """Refs to add where a site(source, relation) has more prior edges than refs: names of edges that no ref claims, in
    order, up to the difference. prior_edges are those of surviving sources."""
    from pyspark.sql import Window

    site = ["source", "relation"]
    have = refs.groupBy(*site).agg(F.count("*").alias("n_refs"))
    had = prior_edges.groupBy(*site).agg(F.count("*").alias("n_edges"))
    short = have.join(had, site).where("n_edges > n_refs").select(*site, (F.col("n_edges") - F.col("n_refs")).alias("deficit"))
    labels = prior_nodes.select(F.col("id").alias("target_id"), F.col("label").alias("_label"))
    edges = prior_edges.join(short, site).join(labels, "target_id", "left")
    opaque = F.col("recv").eqNullSafe(F.lit("opaque")) & F.col("target_id").isNull() if "recv" in prior_edges.columns else F.lit(False)
    named = edges.select(*site, "deficit", "target_id", F.when(F.col("target_id").isNull(), F.col("target_name")).otherwise(F.col("_label")).alias("name"), opaque.alias("recv_opaque")).where(F.col("name").isNotNull())
    free = named.join(refs.select(*site, "name").distinct(), [*site, "name"], "left_anti")
    if import_claims is not None:
        free = free.join(import_claims.select(*site, "target_id").distinct(), [*site, "target_id"], "left_anti")
    free = free.select(*site, "deficit", "name", "recv_opaque").distinct()
    ranked = free.withColumn("_k", F.row_number().over(Window.partitionBy(*site).orderBy("name", "recv_opaque"))).where(F.col("_k") <= F.col("deficit"))
    none = F.lit(None).cast("string")
    return ranked.select("source", "relation", "name", none.alias("type_hint"), none.alias("specifier"), none.alias("imported"), "recv_opaque", none.alias("recv_returns"), none.alias("recv_returns_owner"))


def _walk_cycles(asked: DataFrame, local: DataFrame, followed: DataFrame, stars: DataFrame) -> DataFrame:
    """asked(module, name) -> (module, name, def_id), every star export followed by (order, path) until none is open.

    A path never enters a (module, name) twice. Of paths that meet in one round the first in order goes on, and none that
    comes after its ask's best hit: the first path to a definition is first to each place on it too.
    """
    from .checkpoints import cut

    here = F.concat_ws("\u0001", "module", "name")
    ask = ["ask_module", "ask_name"]
    open_paths = cut(asked.select(F.col("module").alias("ask_module"), F.col("name").alias("ask_name"), "module", "name", F.array().cast("array<int>").alias("order"), F.array(here).alias("seen")))
    best = None
    while not open_paths.isEmpty():
        at = open_paths.join(local, ["module", "name"], "left").join(followed, ["module", "name"], "left")
        found = at.where(F.col("def_id").isNotNull()).select(*ask, F.struct("order", "def_id").alias("hit"))
        best = cut((found if best is None else best.unionByName(found)).groupBy(*ask).agg(F.min("hit").alias("hit")))
        rest = at.where(F.col("def_id").isNull())
        through = rest.where(F.col("follows") & F.col("to_module").isNotNull()).select(*ask, F.col("to_module").alias("module"), F.col("to_name").alias("name"), "order", "seen")
        spread = rest.where(F.col("follows").isNull()).join(stars, ["module", "name"]).select(*ask, F.col("star_module").alias("module"), "name", F.concat("order", F.array(F.col("star_pos").cast("int"))).alias("order"), "seen")
        step = through.unionByName(spread).where(~F.array_contains("seen", here)).groupBy(*ask, "module", "name").agg(F.min(F.struct("order", "seen")).alias("p"))
        step = step.select(*ask, "module", "name", F.col("p.order").alias("order"), F.concat("p.seen", F.array(here)).alias("seen"))
        open_paths = cut(step.join(best, ask, "left").where(F.col("hit").isNull() | (F.col("order") < F.col("hit.order"))).drop("hit"))
    if best is None:
        return asked.select("module", "name", F.lit(None).cast("string").alias("def_id")).limit(0)
    return best.select(F.col("ask_module").alias("module"), F.col("ask_name").alias("name"), F.col("hit.def_id").alias("def_id"))


def walk_exports(asked: DataFrame, exports: DataFrame, modules: DataFrame, defs: DataFrame) -> DataFrame:
    """asked(ask, module, name) -> (ask, def_id): the definition that module exports by that name.

    exports(file, pos, kind, name, specifier, imported), modules(file, specifier, target) what specifiers resolve to,
    defs(file, name, def_id). A local export of a definition ends the walk; a re-export is followed and nothing else;
    otherwise star exports are searched in order. What a walk misses, the first module's own definition gives.

    First the (module, name) that reach a definition are found, backwards from definitions, a round for each step. Then
    each asked (module, name), once, follows its first star export that does, so a barrel of very many modules is one row
    a name and no asked name is spread over them. Only where that runs into a cycle are all star exports walked.
    """
    from .checkpoints import cut

    pair = ["module", "name"]
    local = exports.where(F.col("kind") == "local").select("file", "name").distinct().join(defs, ["file", "name"])
    local = local.select(F.col("file").alias("module"), "name", "def_id")
    again = exports.where(F.col("kind") == "reexport").groupBy("file", "name").agg(F.max_by(F.struct("specifier", "imported"), "pos").alias("e"), F.max("pos").alias("e_pos"))
    last_local = exports.where(F.col("kind") == "local").groupBy("file", "name").agg(F.max("pos").alias("l_pos")).join(local.select(F.col("module").alias("file"), "name"), ["file", "name"], "left_semi")
    again = again.join(last_local, ["file", "name"], "left")
    wins = again.where(F.col("l_pos").isNull() | (F.col("e_pos") > F.col("l_pos")))
    resolved = modules.select("file", "specifier", "target")
    followed = cut(wins.select("file", "name", "e.specifier", "e.imported").join(resolved, ["file", "specifier"], "left").select(F.col("file").alias("module"), "name", F.lit(True).alias("follows"), F.col("target").alias("to_module"), F.col("imported").alias("to_name")))
    states = asked.select(*pair).distinct()
    names = states.select("name").unionByName(followed.select(F.col("to_name").alias("name"))).distinct()
    local = cut(local.join(followed.select(*pair), pair, "left_anti").join(names, "name", "left_semi").select(*pair, "def_id"))
    stars = exports.where(F.col("kind") == "star").select("file", "pos", "specifier").join(resolved, ["file", "specifier"]).where(F.col("target").isNotNull()).select(F.col("file").alias("module"), F.col("pos").alias("star_pos"), F.col("target").alias("star_module"))
    through = followed.where(F.col("to_module").isNotNull()).select(*pair, "to_module", "to_name")
    to = lambda df: df.select(F.col("module").alias("to_module"), F.col("name").alias("to_name"))
    starred = lambda df: stars.join(df.select(F.col("module").alias("star_module"), "name"), "star_module").join(followed.select(*pair), pair, "left_anti")
    fruitful = fresh = local.select(*pair).distinct()
    while not fresh.isEmpty():
        step = through.join(to(fresh), ["to_module", "to_name"], "left_semi").select(*pair).unionByName(starred(fresh).select(*pair))
        fresh = cut(step.distinct().join(fruitful, pair, "left_anti"))
        fruitful = fruitful.unionByName(fresh)
    spread = starred(fruitful).join(local.select(*pair), pair, "left_anti")
    first = spread.groupBy(*pair).agg(F.min_by("star_module", "star_pos").alias("to_module")).select(*pair, "to_module", F.col("name").alias("to_name"))
    leads = cut(through.join(to(fruitful), ["to_module", "to_name"], "left_semi").select(*pair, "to_module", "to_name").unionByName(first))
    begin = [F.col("module").alias("ask_module"), F.col("name").alias("ask_name")]
    here = F.concat_ws("\u0001", *pair)
    walking = cut(states.join(fruitful, pair, "left_semi").select(*begin, *pair, F.array(here).alias("seen")))
    ends, cycles = [], []
    while not walking.isEmpty():
        at = walking.join(local, pair, "left")
        ends.append(at.where(F.col("def_id").isNotNull()).select(F.col("ask_module").alias("module"), F.col("ask_name").alias("name"), "def_id"))
        moved = at.where(F.col("def_id").isNull()).drop("def_id").join(leads, pair).select("ask_module", "ask_name", F.col("to_module").alias("module"), F.col("to_name").alias("name"), "seen")
        moved = cut(moved.withColumn("_back", F.array_contains("seen", here)).withColumn("seen", F.concat("seen", F.array(here))))
        cycles.append(moved.where("_back").select(F.col("ask_module").alias("module"), F.col("ask_name").alias("name")))
        walking = moved.where("NOT _back").drop("_back")
    if cycles:
        round_ = reduce(DataFrame.unionByName, cycles)
        if not round_.isEmpty():
            ends.append(_walk_cycles(round_, local, followed, spread))
    found = reduce(DataFrame.unionByName, ends) if ends else states.select(*pair, F.lit(None).cast("string").alias("def_id")).limit(0)
    own = asked.join(defs.select(F.col("file").alias("module"), "name", F.col("def_id").alias("own")), pair, "left").join(found, pair, "left")
    return own.select("ask", F.coalesce("def_id", "own").alias("def_id")).where(F.col("def_id").isNotNull())


def import_scope(refs: DataFrame, nodes: DataFrame, exports: DataFrame, modules: DataFrame) -> DataFrame:
    """(file, name, def_id): what each file's imports bind. Of several imports of one name the last in order wins."""
    asks = with_sources(refs.where((F.col("relation") == "imports") & F.col("specifier").isNotNull()), nodes).where(F.col("src_file").isNotNull())
    asks = asks.select(F.col("src_file").alias("file"), "name", "specifier", F.coalesce("imported", "name").alias("wanted"), F.xxhash64("src_file", "name", "specifier", "imported").alias("ask")).distinct()
    there = asks.join(modules, ["file", "specifier"]).where(F.col("target").isNotNull())
    defs = linkable(nodes).where(F.col("source_file").isNotNull()).groupBy(F.col("source_file").alias("file"), F.col("label").alias("name")).agg(F.min("id").alias("def_id"))
    found = walk_exports(there.select("ask", F.col("target").alias("module"), F.col("wanted").alias("name")), exports, modules, defs)
    bound = there.select("ask", "file", "name", "specifier", "wanted").join(found, "ask")
    return bound.groupBy("file", "name").agg(F.max_by("def_id", F.struct("specifier", "wanted")).alias("def_id"))
