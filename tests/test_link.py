"""Linking operators against plain Python over random small workspaces."""

import random

import pytest
from pyspark.sql import functions as F

from codeloom.operators import delta, graph, link, modules

NODES = "id string, label string, kind string, source_file string, project string, impl string, returns string"
PROJECTS = "root string, manifest string, name string, entry string, deps array<string>"


def norm(t):
    return None if t is None else t.split("<")[0].split("::")[-1].strip()


def world(seed):
    rng = random.Random(seed)
    projects = [("p0", "Cargo.toml", "c-zero", None, []), ("p1", "Cargo.toml", "c_one", None, []), ("p2", "go.mod", None, None, [])]
    nodes = []
    for k in range(50):
        project = rng.choice(["p0", "p1", "p2", None])
        file = f"{project}/f{rng.randint(0, 2)}.rs" if project else rng.choice([f"f{rng.randint(0, 2)}.rs", None])
        kind = rng.choice(["function", "function", "struct", "enum_variant", "file"])
        nodes.append((f"n{k:02}", f"s{rng.randint(0, 7)}", kind, file, project, rng.choice([None, "A", "m::A<T>", "B"]), rng.choice([None, "A", "x::A<u8>", "B"])))
    refs = set()
    for _ in range(160):
        name = rng.choice([f"s{rng.randint(0, 9)}", f"c_zero::s{rng.randint(0, 9)}", f"c-one::m::s{rng.randint(0, 9)}", f"other::s{rng.randint(0, 9)}"])
        returned = rng.choice([None, None, f"s{rng.randint(0, 9)}"])
        refs.add((rng.choice(nodes)[0], rng.choice(["calls", "type/param"]), name, rng.choice([None, None, "A", "B<x>"]), None, None, rng.random() < 0.3, returned, rng.choice([None, "A"]) if returned else None))
    scope = {(f"p0/f{rng.randint(0, 2)}.rs", f"s{rng.randint(0, 9)}"): f"n{rng.randint(0, 49):02}" for _ in range(4)}
    return projects, nodes, sorted(refs, key=str), scope


def resolve(projects, nodes, refs, scope):
    by_id = {n[0]: n for n in nodes}
    cands = {}
    for n in sorted(nodes):
        if n[2] in ("function", "struct"):
            cands.setdefault(n[1], []).append(n)
    roots = {}
    for root, _, name, *_ in sorted(projects):
        if name:
            roots.setdefault(name.replace("_", "-"), root)

    def one(name, ref, pool, cross, crate):
        source = by_id[ref[0]]
        hint, opaque = ref[3], ref[6]
        if ref[7] is not None:
            found = [c for c in cands.get(ref[7], []) if c[4] == source[4] and (ref[8] is None or norm(c[5]) == norm(ref[8]))]
            types = {c[6] for c in found if c[6] is not None}
            hint, opaque = (norm(types.pop()), False) if len(types) == 1 else (None, True)
        none = (None, "EXTRACTED", opaque)
        if crate and pool and len(pool) > 1:
            pool = [c for c in pool if c[4] == crate]
            if not pool:
                return none
        if (source[3], name) in scope:
            return scope[source[3], name], "EXTRACTED", opaque
        pool = [c for c in pool or [] if cross or c[4] == source[4]]
        if not pool:
            return none
        if hint is not None:
            typed = [c for c in pool if c[5] is not None and norm(c[5]) == norm(hint)]
            return none if not typed else (typed[0][0], "EXTRACTED" if len(typed) == 1 else "AMBIGUOUS", opaque)
        same = [c for c in pool if c[3] is not None and c[3] == source[3]]
        if same:
            return same[0][0], "EXTRACTED" if len(same) == 1 else "AMBIGUOUS", opaque
        if opaque:
            return none
        return pool[0][0], "INFERRED" if len(pool) == 1 else "AMBIGUOUS", opaque

    out = []
    for ref in refs:
        name = ref[2]
        head, _, rest = name.partition("::")
        crate = roots.get(head.replace("_", "-")) if rest else None
        if crate is None or name in cands:
            target, confidence, opaque = one(name, ref, cands.get(name), False, crate)
        else:
            target, confidence, opaque = one(rest, ref, cands.get(rest), True, crate)
            if target is None and "::" in rest:
                last = rest.split("::")[-1]
                target, confidence, opaque = one(last, ref, cands.get(last), True, None)
            if target is None:
                target, confidence, opaque = one(name, ref, None, False, None)
        out.append((ref[0], ref[1], confidence, target, None if target else name, "opaque" if target is None and opaque else None))
    return out


@pytest.mark.parametrize("seed", range(4))
def test_cascade(spark, seed):
    projects, nodes, refs, scope = world(seed)
    frames = spark.createDataFrame(refs, link.REF_SCHEMA), spark.createDataFrame(nodes, NODES), spark.createDataFrame([(f, n, d) for (f, n), d in scope.items()], "file string, name string, def_id string"), spark.createDataFrame(projects, PROJECTS)
    got = [tuple(r) for r in link.resolve(*frames).collect()]
    assert sorted(map(str, got)) == sorted(map(str, resolve(projects, nodes, refs, scope)))


def test_provenance_table(spark):
    """One case for each rung of the cascade."""
    nodes = [
        ("f1", "src", "function", "a.rs", None, None, None), ("d1", "same", "function", "a.rs", None, None, None), ("d2", "other", "function", "b.rs", None, None, None), ("d3", "twice", "function", "b.rs", None, None, None),
        ("d4", "twice", "function", "c.rs", None, None, None), ("d5", "m", "function", "b.rs", None, "T", None), ("d6", "m", "function", "b.rs", None, "U", None), ("d7", "far", "function", "x/q.rs", "x", None, None), ("v", "variant", "enum_variant", "a.rs", None, None, None),
    ]
    ref = lambda name, hint=None, opaque=False: ("f1", "calls", name, hint, None, None, opaque, None, None)
    refs = [ref("same"), ref("other"), ref("twice"), ref("m", "T"), ref("m", "W"), ref("m", None, True), ref("far"), ref("variant"), ref("nothing")]
    got = {(r["target_name"] or r["target_id"], r["confidence"], r["target_id"], r["recv"]) for r in link.resolve(spark.createDataFrame(refs, link.REF_SCHEMA), spark.createDataFrame(nodes, NODES)).collect()}
    assert got == {
        ("d1", "EXTRACTED", "d1", None), ("d2", "INFERRED", "d2", None), ("d3", "AMBIGUOUS", "d3", None), ("d5", "EXTRACTED", "d5", None), ("m", "EXTRACTED", None, None), ("m", "EXTRACTED", None, "opaque"),
        ("far", "EXTRACTED", None, None), ("variant", "EXTRACTED", None, None), ("nothing", "EXTRACTED", None, None),
    }


@pytest.mark.parametrize("seed", range(3))
def test_export_walk(spark, seed):
    rng = random.Random(seed)
    files = [f"m{k}" for k in range(6)]
    defs = {(f, f"s{rng.randint(0, 3)}"): f"{f}-{k}" for k, f in enumerate(rng.choices(files, k=8))}
    exports, target = [], {}
    for f in files:
        for pos in range(rng.randint(0, 4)):
            kind, spec = rng.choice(["local", "reexport", "star"]), f"./{rng.choice(files + ['none'])}"
            target[f, spec] = spec[2:] if spec != "./none" else None
            exports.append((f, pos, kind, None if kind == "star" else f"s{rng.randint(0, 3)}", None if kind == "local" else spec, f"s{rng.randint(0, 3)}" if kind == "reexport" else None))
    table, stars = {}, {}
    for f, pos, kind, name, spec, imported in exports:
        if kind == "local" and (f, name) in defs:
            table[f, name] = ("def", defs[f, name])
        elif kind == "reexport":
            table[f, name] = ("to", spec, imported)
        elif kind == "star":
            stars.setdefault(f, []).append(spec)

    def walk(module, name, seen):
        if (module, name) in seen:
            return None
        seen = seen | {(module, name)}
        entry = table.get((module, name))
        if entry:
            if entry[0] == "def":
                return entry[1]
            return walk(target[module, entry[1]], entry[2], seen) if target.get((module, entry[1])) else None
        for spec in stars.get(module, []):
            found = walk(target[module, spec], name, seen) if target.get((module, spec)) else None
            if found:
                return found
        return None

    asked = [(n, f, f"s{s}") for n, (f, s) in enumerate((f, s) for f in files for s in range(4))]
    want = {n: d for n, f, s in asked if (d := walk(f, s, frozenset()) or defs.get((f, s)))}
    got = link.walk_exports(
        spark.createDataFrame(asked, "ask long, module string, name string"), spark.createDataFrame(exports, "file string, pos int, kind string, name string, specifier string, imported string"),
        spark.createDataFrame([(f, s, t) for (f, s), t in target.items()], "file string, specifier string, target string"), spark.createDataFrame([(f, n, d) for (f, n), d in defs.items()], "file string, name string, def_id string"),
    )
    assert {r["ask"]: r["def_id"] for r in got.collect()} == want


def test_export_walk_keeps_wide_barrels_small(spark, monkeypatch):
    """A barrel of many modules, asked for each of their names: no step holds more rows than the tables do, beside cycles of barrels."""
    from codeloom.operators import checkpoints

    n, sizes, cut = 300, [], checkpoints.cut
    monkeypatch.setattr(checkpoints, "cut", lambda df: (done := cut(df), sizes.append(done.count()))[0])
    exports = [(f"m{k}", 0, "local", f"s{k}", None, None) for k in range(n)] + [("b", k, "star", None, f"./m{k}", None) for k in range(n)] + [("top", 0, "star", None, "./ring", None), ("top", 1, "star", None, "./b", None), ("ring", 0, "star", None, "./top", None)]
    target = {(f, spec): spec[2:] for f, _, _, _, spec, _ in exports if spec}
    asked = [(k, "top" if k == 7 else "b", f"s{k}") for k in range(n)] + [(n, "ring", "s8")]
    got = link.walk_exports(
        spark.createDataFrame(asked, "ask long, module string, name string"), spark.createDataFrame(exports, "file string, pos int, kind string, name string, specifier string, imported string"),
        spark.createDataFrame([(f, s, t) for (f, s), t in target.items()], "file string, specifier string, target string"), spark.createDataFrame([(f"m{k}", f"s{k}", f"d{k}") for k in range(n)], "file string, name string, def_id string"),
    )
    assert {r["ask"]: r["def_id"] for r in got.collect()} == {**{k: f"d{k}" for k in range(n)}, n: "d8"}
    assert max(sizes) <= len(exports) + 3 * n


def test_module_resolution(spark):
    files = [(p,) for p in ("a/src/lib.rs", "a/src/x.rs", "a/src/d/mod.rs", "a/src/d/e.rs", "b/src/main.rs", "b/src/u.rs", "w/index.ts", "w/lib/k.tsx", "w/lib/dir/index.js", "w/own.js", "c/lib.rs", "c/q.rs")]
    projects = [("a", "Cargo.toml", "aa", None, []), ("b", "Cargo.toml", "bb", None, []), ("c", "Cargo.toml", "cc", None, []), ("w", "package.json", "@acme/ui", "own", []), ("v", "package.json", "@acme", None, []), ("", "go.mod", None, None, [])]
    cases = {
        ("a/src/x.rs", "crate"): "a/src/lib.rs", ("a/src/lib.rs", "crate::x"): "a/src/x.rs", ("a/src/x.rs", "crate::d"): "a/src/d/mod.rs", ("a/src/d/mod.rs", "self::e"): "a/src/d/e.rs", ("a/src/d/e.rs", "super"): "a/src/d/mod.rs",
        ("a/src/d/e.rs", "super::super::x"): None, ("a/src/x.rs", "bb::u"): "b/src/u.rs", ("a/src/x.rs", "bb"): "b/src/main.rs", ("a/src/x.rs", "std::fs"): None, ("c/lib.rs", "crate::q"): "c/q.rs",
        ("w/lib/k.tsx", "./dir"): "w/lib/dir/index.js", ("w/lib/k.tsx", "../own"): "w/own.js", ("w/index.ts", "./lib/k"): "w/lib/k.tsx", ("w/index.ts", "./none"): None,
        ("w/index.ts", "@acme/ui"): "w/own.js", ("z.ts", "@acme/ui/lib/k"): "w/lib/k.tsx", ("z.ts", "react"): None, ("z.ts", "@acme"): None,
    }
    got = modules.resolve_modules(spark.createDataFrame(list(cases), "file string, specifier string"), spark.createDataFrame(files, "path string"), spark.createDataFrame(projects, PROJECTS))
    assert {(r["file"], r["specifier"]): r["target"] for r in got.collect()} == {k: v for k, v in cases.items() if v}


def test_longest_root_equals_scan(spark):
    rng = random.Random(3)
    roots = ["", "a", "a/b", "ab", "a/b/c/d", "q"]
    paths = sorted({"/".join(rng.choice(["a", "b", "c", "d", "ab", "q"]) for _ in range(rng.randint(1, 6))) for _ in range(80)})
    for chosen in (roots, roots[1:]):
        got = link.project_of(spark.createDataFrame([(p,) for p in paths], "path string"), spark.createDataFrame([(r,) for r in chosen], "root string"))
        want = {p: max((r for r in chosen if r == "" or p == r or p.startswith(r + "/")), key=len, default=None) for p in paths}
        assert {r["path"]: r["project"] for r in got.collect()} == want


@pytest.mark.parametrize("seed", range(3))
def test_scoped_links_equal_global_ones(spark, seed):
    """A random edit of one file: edges carried and linked again are those of linking everything."""
    projects, nodes, refs, _ = world(seed + 10)
    rng = random.Random(seed)
    file = rng.choice([n[3] for n in nodes if n[3]])
    after = [n if n[3] != file else (n[0], rng.choice([n[1], "s1", "s2"]), *n[2:]) for n in nodes if n[3] != file or rng.random() < 0.8]
    ids = {n[0] for n in after}
    refs = [r for r in refs if r[0] in ids]
    make = lambda rows, schema: spark.createDataFrame(rows, schema)
    before_f, after_f, refs_f, projects_f = make(nodes, NODES), make(after, NODES), make(refs, link.REF_SCHEMA), make(projects, PROJECTS)
    prior = link.resolve(refs_f, before_f, None, projects_f)
    whole = link.resolve(refs_f, after_f, None, projects_f)
    touched = make([(file,)], "path string")
    dropped, new = before_f.where(F.col("source_file") == file), after_f.where(F.col("source_file") == file)
    sites = link.impacted_sites(refs_f, after_f, touched, link.dirty_names(dropped, new), prior, before_f)
    again = refs_f.join(sites, ["source", "relation"], "left_semi").select(*link.REF_COLUMNS)
    scoped = delta.carried(prior, dropped.select("id"), sites).unionByName(link.resolve(again, after_f, None, projects_f))
    assert sorted(map(str, map(tuple, scoped.collect()))) == sorted(map(str, map(tuple, whole.collect())))


def test_healing_restores_what_was_lost(spark):
    nodes = spark.createDataFrame([("a", "a", "function"), ("x", "x", "function"), ("y", "y", "function")], "id string, label string, kind string")
    edges = spark.createDataFrame([("a", "calls", "INFERRED", "x", None, None), ("a", "calls", "INFERRED", "y", None, None), ("a", "calls", "EXTRACTED", None, "z", "opaque"), ("a", "contains", "EXTRACTED", "x", None, None)], "source string, relation string, confidence string, target_id string, target_name string, recv string")
    refs = spark.createDataFrame([("a", "calls", "x", None, None, None, False, None, None)], link.REF_SCHEMA)
    got = {(r["relation"], r["name"], r["recv_opaque"]) for r in link.healed_refs(refs, edges, nodes).collect()}
    assert got == {("calls", "y", False), ("calls", "z", True)}
    assert link.healed_refs(refs.union(refs.withColumn("name", F.lit("y"))).union(refs.withColumn("name", F.lit("z"))), edges, nodes).collect() == []


def test_delta_keeps_multisets(spark):
    edge = lambda *rows: spark.createDataFrame([(s, "calls", "EXTRACTED", t, None) for s, t in rows], "source string, relation string, confidence string, target_id string, target_name string")
    prior, now = edge(("a", "b"), ("a", "b"), ("b", "a")), edge(("a", "b"), ("b", "b"), ("b", "b"))
    removed, added = delta.edge_diff(prior, now)
    assert (removed.count(), added.count()) == (2, 2)
    nodes = spark.createDataFrame([("a", "f.rs"), ("b", "g.rs")], "id string, source_file string")
    merged_nodes, merged = delta.merge(nodes, prior, nodes.limit(0), nodes, removed, added)
    assert merged_nodes.count() == 2 and sorted(map(str, merged.collect())) == sorted(map(str, now.select(*merged.columns).collect()))
    gone = nodes.where("id = 'b'")
    assert delta.shrink_violations(gone, spark.createDataFrame([("f.rs",)], "path string")).count() == 1
    assert graph.prune_dangling(prior, nodes.where("id = 'a'")).count() == 0
