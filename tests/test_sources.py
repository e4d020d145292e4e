import json
import os
import random

import pytest

from codeloom.sources import changes, files, graphjson, manifests, store
from codeloom.sources.extract import extract_file
from codeloom.sources.extract.base import fnv32


def tree(root, contents):
    for path, text in contents.items():
        os.makedirs(os.path.dirname(f"{root}/{path}") or str(root), exist_ok=True)
        with open(f"{root}/{path}", "w") as f:
            f.write(text)


def test_boundary_walk_and_matches_agree(tmp_path):
    rng = random.Random(1)
    names = ["a", "b", "build", "x.rs", "y.log", "keep.log", "target", ".hidden", "node_modules", "z.ts"]
    contents = {}
    for _ in range(120):
        depth = rng.randint(0, 3)
        contents["/".join([rng.choice(["a", "b", "build", "target", ".hidden", "lib"]) for _ in range(depth)] + [rng.choice(names) + str(rng.randint(0, 3))])] = ""
    contents = {p: "" for p in contents if not any(q != p and q.startswith(p + "/") for q in contents)}
    contents |= {".gitignore": "*.log*\n!keep.log1\n/build/\nb/**/z.ts?\n# no\n", "a/.gitignore": "!y.log2\nx.rs[12]\nlib/\n"}
    tree(tmp_path, contents)
    boundary = files.Boundary(str(tmp_path))
    every = sorted(os.path.relpath(os.path.join(d, f), tmp_path) for d, _, fs in os.walk(tmp_path) for f in fs)
    assert boundary.walk() == [p for p in every if boundary.matches(p)]
    assert not boundary.matches(".git/config") and not boundary.matches("target/x.rs") and not boundary.matches("")


@pytest.mark.parametrize(
    "rules, path, is_dir, verdict",
    [
        ("*.o", "x.o", False, True), ("*.o", "d/x.o", False, True), ("/x", "d/x", False, None), ("d/", "d", False, None), ("d/", "d", True, True), ("a/*", "a/b/c", False, None),
        ("a/**", "a/b/c", False, True), ("**/q", "a/q", False, True), ("a/**/b", "a/b", False, True), ("*\n!k", "k", False, False), ("\\!x", "!x", False, True), ("f ", "f", False, True), ("[!a]x", "bx", False, True),
    ],
)
def test_ignore_rules(rules, path, is_dir, verdict):
    assert files.IgnoreFile(rules).decide(path, is_dir) is verdict


@pytest.mark.parametrize(
    "base, text, want",
    [
        ("package.json", '{"name":"n","module":"m.js","dependencies":{"a":"1"},"peerDependencies":{"b":"2"}}', ("n", "m.js", ["a", "b"])),
        ("package.json", "{broken", (None, None, [])),
        ("deno.json", '{"exports":"./mod.ts"}', (None, "./mod.ts", [])),
        ("Cargo.toml", '[package]\nname = "c" # x\n[dependencies]\na = "1"\n[dependencies.sub]\nb = 1\n[workspace.dependencies]\nz = 1\n[dev-dependencies]\nd = "1"', ("c", None, ["a", "d"])),
        ("pyproject.toml", '[tool.poetry]\nname = "p"\n[dependencies]\nq = 1', ("p", None, [])),
        ("go.mod", "module example.org/m\nrequire (\n a v1\n b v2\n)\nrequire c v3\n", ("example.org/m", None, list("abc"))),
    ],
)
def test_manifests(base, text, want):
    assert manifests.parse(base, text.encode()) == want


def test_projects_of_one_directory(spark):
    rows = [("a/package.json", b'{"name":"js"}'), ("a/Cargo.toml", b'[package]\nname="rs"'), ("go.mod", b"module m"), ("a/x.rs", b"")]
    got = manifests.projects(spark.createDataFrame(rows, "path string, content binary"))
    assert {(r["root"], r["name"]) for r in got.collect()} == {("a", "js"), ("", "m")}


def test_change_detection(spark):
    now = spark.createDataFrame([("a.rs", "h1", 1), ("b.rs", "h2", 2), ("c.rs", "h3", 9), ("d.rs", "h4", 9), ("e.md", "x", 1), ("f.rs", None, 5), ("g.rs", "new", 1)], "path string, hash string, mtime_ns long")
    was = spark.createDataFrame([("a.rs", "other", 1), ("b.rs", "h2", 1), ("c.rs", "old", 1), ("z.rs", "h", 1), ("f.rs", "h", 1), ("g.rs", "old", 1)], "path string, hash string, mtime_ns long")
    ops = lambda df: {(r["path"], r["op"]) for r in df.collect()}
    assert ops(changes.reconcile(now, was)) == {("c.rs", "M"), ("d.rs", "A"), ("f.rs", "M"), ("z.rs", "D")}
    assert ops(changes.reconcile(now, was, deep=True)) == {("a.rs", "M"), ("c.rs", "M"), ("d.rs", "A"), ("f.rs", "M"), ("z.rs", "D"), ("g.rs", "M")}
    asked = changes.changes_frame(spark, [("a.rs", "M"), ("c.rs", "M"), ("q.rs", "A"), ("z.rs", "D")])
    assert ops(changes.gate(asked, now, was)) == {("c.rs", "M"), ("z.rs", "D")}
    folded = {(r["path"], r["op"], r["vanished"]) for r in changes.fold_vanished(asked, now).collect()}
    assert folded == {("a.rs", "M", False), ("c.rs", "M", False), ("q.rs", "D", True), ("z.rs", "D", False)}


def test_version_control_diff():
    raw = b"A\0new.rs\0M\0mod.rs\0D\0gone.rs\0R100\0from.rs\0to.rs\0C75\0src.rs\0copy.rs\0T\0typ.rs\0M\0.codeloom/x\0"
    assert changes.parse_name_status(raw) == [("copy.rs", "A"), ("from.rs", "D"), ("gone.rs", "D"), ("mod.rs", "M"), ("new.rs", "A"), ("to.rs", "A"), ("typ.rs", "M")]


def test_classification(spark):
    from pyspark.sql import functions as F

    rows = [("a.rs", "rust", True), ("b.tsx", "typescript", True), ("c.jsx", None, False), ("d/Cargo.toml", None, True), ("e.hpp", "cpp", True), ("f.md", None, False), ("rs", None, False)]
    got = spark.createDataFrame([(p,) for p, *_ in rows], "path string").select("path", changes.language(F.col("path")).alias("l"), changes.is_indexable(F.col("path")).alias("i")).collect()
    assert [tuple(r) for r in got] == rows


def test_graph_document_round_trip(spark):
    one = dict(id="p", label="P", kind="function", source_file="x.rs", source_location="L3-L9", community=2, abstract="true", n=1)
    text = json.dumps({"links": [dict(source="p", target="q", confidence="INFERRED"), dict(source="q", target="p", relation="calls", confidence="odd")], "nodes": [one, {"id": "q"}]})
    state = graphjson.load(spark, text)
    again = graphjson.load(spark, graphjson.dump(state["nodes"], state["edges"], state["partition"]))
    for name in state:
        assert sorted(map(str, state[name].collect())) == sorted(map(str, again[name].collect()))
    assert [tuple(r) for r in state["edges"].select("relation", "confidence").collect()] == [("relates", "INFERRED"), ("calls", "EXTRACTED")]
    with pytest.raises(ValueError):
        graphjson.load(spark, '{"edges":[]}')
    assert graphjson.parse_location("L7") == (7, 7) and graphjson.parse_location("7") == (None, None)


def test_store_versions_and_guards(spark, tmp_path):
    kept = store.Store(spark, str(tmp_path))
    node = lambda *ids: spark.createDataFrame([(i, i, "function", None, 1, 1, {}) for i in ids], store.TABLES["nodes"])
    assert kept.load()["nodes"].count() == 0
    for k, ids in enumerate(("a", "ab", "abc"), 1):
        assert kept.save(store.empty(spark) | {"nodes": node(*ids)}) == k
    assert kept.load()["nodes"].count() == 3 and not os.path.exists(tmp_path / "v=1")
    with pytest.raises(store.ShrinkRefused):
        kept.save(store.empty(spark) | {"nodes": node("a")})
    kept.save(store.empty(spark) | {"nodes": node("a")}, force=True)
    assert kept.load()["nodes"].count() == 1


def test_write_behind_and_cache(spark):
    time, inner = [0.0], store.MemoryStore(spark)
    behind = store.DeferredStore(inner, idle=30, most=300, clock=lambda: time[0])
    behind.save(store.empty(spark))
    assert not behind.due()
    time[0] = 31
    assert behind.due() and behind.flush() and not behind.flush()
    for t in range(31, 400, 20):
        time[0] = t
        behind.save(store.empty(spark))
    assert behind.due()
    cache, flushed = store.StateCache(2), []
    make = lambda k: type("S", (), {"flush": lambda self: flushed.append(k)})
    for k in "abac":
        cache.get(k, lambda k=k: make(k)())
    assert flushed == ["b"] and "a" in cache and "b" not in cache


def refs(built, relation="calls"):
    return {(r["source"].split(":")[-1], r["name"], r.get("type") or r.get("recv") or r.get("recv_returns")) for r in built.refs if r["relation"] == relation}


def test_rust():
    built = extract_file("s/a.rs", "rust", """
pub trait Show: Base { fn show(&self); fn dflt(&self) { self.show(); } }
pub struct Foo<T: Bar> { pub a: Baz, b: Vec<Qux>, c: T }
impl<T> Show for Foo<T> { fn show(&self) { let z: Baz = y(); z.go(); let q = make(); q.run(); let w = Wid::new(1); w.hop(); o.x(); println!("{}", hidden()); Self::mk(); crate::b::free(2) } }
impl<T> Foo<T> { fn mk() -> Self { } }
fn make() -> Baz { } fn dup() {} mod m { fn dup() { super::make(); } }
use crate::b::{c, d as e}; pub use self::x::Y; pub use crate::z::*;
""")
    assert refs(built) == {("dflt", "show", "Show"), ("show", "y", None), ("show", "go", "Baz"), ("show", "make", None), ("show", "run", "make"), ("show", "new", "Wid"), ("show", "hop", "Wid"), ("show", "x", "opaque"), ("show", "mk", "Foo"), ("show", "free", None), (f"dup#{fnv32('fn dup()')}~1", "make", None)}
    assert refs(built, "implements") == {("Foo", "Show", None)} and refs(built, "extends") == {("Show", "Base", None)}
    assert {n for _, n, _ in refs(built, "type/field")} == {"Baz", "Qux"} and {n for _, n, _ in refs(built, "type/bound")} == {"Bar"}
    assert [(e["kind"], e["name"], e["specifier"]) for e in built.exports] == [("local", "Show", None), ("local", "Foo", None), ("reexport", "Y", "self::x"), ("star", None, "crate::z")]
    assert {(r["name"], r.get("specifier"), r.get("imported")) for r in built.refs if r["relation"] == "imports"} == {("c", "crate::b", None), ("e", "crate::b", "d"), ("Y", "self::x", None)}
    owner = {e["target_id"]: e["source"] for e in built.edges}
    assert owner["fn:s/a.rs:Foo::mk"] == "type:s/a.rs:Foo" and owner["fn:s/a.rs:make"] == "file:s/a.rs"


def test_typescript():
    built = extract_file("a.ts", "typescript", """
import Def, { a as b } from './m'; import * as N from "pkg"; export { x, y as z } from './k'; export * from './s';
export abstract class Foo<T extends Bar> extends Base implements I1, I2 {
  private f: Map<string, Baz>
  g?: Qux
  constructor(private h: Zed) { this.init(h); }
  abstract go(x: A): B;
  init(z: Zed): void { const w = new Wid(); w.spin(); z.act(); q.bar(); Util.stat(); free(1); }
  arrow = (x: P): R => { x.call(); }
}
interface I1 extends I0 { m(a: A): B; p: Q }
export type Al = { u: U; v: V[] };
enum Col { Red, Green = 'g' }
export const fn1 = async (a: AA): Promise<BB> => { a.z(); other(); };
const short = x => foo(x);
""")
    assert refs(built) == {("constructor", "init", "Foo"), ("init", "spin", "Wid"), ("init", "act", "Zed"), ("init", "bar", None), ("init", "stat", "Util"), ("init", "free", None), ("arrow", "call", "P"), ("fn1", "z", "AA"), ("fn1", "other", None), ("short", "foo", None)}
    assert refs(built, "extends") == {("Foo", "Base", None), ("I1", "I0", None)} and {n for _, n, _ in refs(built, "implements")} == {"I1", "I2"}
    assert {(s, n) for s, n, _ in refs(built, "type/field")} == {("Foo", "Baz"), ("Foo", "Qux"), ("I1", "Q"), ("Al", "U"), ("Al", "V")}
    assert {n["label"]: n["kind"] for n in built.nodes if n["kind"] not in ("function", "file")} == {"Foo": "class", "I1": "interface", "Al": "type_alias", "Col": "enum", "Red": "enum_variant", "Green": "enum_variant"}
    assert {n["label"] for n in built.nodes if n["attrs"].get("abstract")} == {"Foo", "go", "I1", "m"}
    assert ("reexport", "z", "./k", "y") in [(e["kind"], e["name"], e["specifier"], e["imported"]) for e in built.exports]


def test_python():
    built = extract_file("a.py", "python", '''
from x import y as z
class Color(Enum):
    RED = 1
    _ignore_ = 2
class A(Base, ABC):
    f: "Foo"
    @abstractmethod
    def m(self, x: list[Bar]) -> Baz: ...
    def n(self):
        self.m(1); other(); q.z(); w: Wid = W(); w.spin(); Up.stat()
    def todo(self): raise NotImplementedError
    def empty(self): pass
''')
    assert refs(built) == {("n", "m", "A"), ("n", "other", None), ("n", "W", None), ("n", "spin", "Wid"), ("n", "stat", "Up")}
    assert {n["label"] for n in built.nodes if n["kind"] == "enum_variant"} == {"Color::RED"}
    assert {n["label"] for n in built.nodes if n["attrs"].get("abstract")} == {"A", "m", "todo"}
    assert {(n) for _, n, _ in refs(built, "type/param")} == {"Bar"} and [e["name"] for e in built.exports] == ["Color", "A"]
    assert "specifier" not in next(r for r in built.refs if r["relation"] == "imports")
    assert [n["kind"] for n in extract_file("b.py", "python", "def broken(:\n  call(1)\n").nodes] == ["file", "function"]


def test_any_text_is_survived():
    rng = random.Random(5)
    parts = ["fn ", "impl ", "class ", "{", "}", "(", ")", "<", ">", ";", "::", "=>", "use ", "import ", "from ", "'", '"', "`", "a", "T", ":", ",", "\n", "pub ", "export ", "enum ", "trait ", "where ", "#", "[", "]", "/*", "//", "é", "\0"]
    for _ in range(400):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 60)))
        for language in ("rust", "typescript", "python", "go"):
            extract_file("x", language, text)


def test_files_made_of_keys_are_parsed_by_many_tasks(spark, monkeypatch):
    """A table of keys is a few MB and so one task's; parsing what is made of them is spread by the number of files."""
    from codeloom.plans import sources_catalogue
    from codeloom.sources import extract

    monkeypatch.setattr(extract, "FILES_A_TASK", 40, raising=False)
    for name in ("rust", "typescript"):
        made = sources_catalogue.files(spark, "/root/testdata/sf0.001", name)
        assert made.rdd.getNumPartitions() >= made.count() / 40 > 1
        assert {r["tag"] for r in extract.extract(made, "ref").select("tag").distinct().collect()} == {"ref"}
