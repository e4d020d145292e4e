import json
import os

import pytest

from codeloom import streaming
from codeloom.engine import Engine
from codeloom.operators.delta import EDGE_COLUMNS
from codeloom.sources.store import Store


def write(root, contents):
    for path, text in contents.items():
        full = f"{root}/{path}"
        if text is None:
            os.remove(full)
            continue
        os.makedirs(os.path.dirname(full), exist_ok=True)
        with open(full, "w") as f:
            f.write(text)


START = {
    "a/Cargo.toml": '[package]\nname = "aa"\n[dependencies]\nbb = "1"\n',
    "b/Cargo.toml": '[package]\nname = "bb"\n',
    "a/src/lib.rs": "use bb::util::helper as h;\npub fn run() { h(); local(); missing(); }\nfn local() { let x = make(); x.go(); }\nfn make() -> Thing { }\n",
    "a/src/t.rs": "pub struct Thing;\nimpl Thing { pub fn go(&self) {} }\n",
    "b/src/util.rs": "pub fn helper() {}\n",
    "b/src/lib.rs": "pub mod util;\n",
    ".gitignore": "ignored/\n",
    "ignored/x.rs": "fn zz() {}\n",
}
#: An edit of an alias's target, a move of a definition, a removed file and a new homonym.
STEPS = [
    {"b/src/util.rs": "pub fn helper() { inner(); }\nfn inner() {}\n"},
    {"a/src/t.rs": "pub struct Thing;\nimpl Thing { pub fn went(&self) {} }\npub fn local() {}\n", "a/src/new.rs": "fn late() { local(); missing(); }\nfn missing() {}\n", "b/src/lib.rs": None},
]


def edges(engine):
    return sorted(str(tuple(r)) for r in engine.store.load()["edges"].select(*EDGE_COLUMNS, "recv").collect())


def nodes(engine):
    return sorted(str(tuple(r)) for r in engine.store.load()["nodes"].select("id", "label", "kind").collect())


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    root, state = tmp_path_factory.mktemp("tree"), tmp_path_factory.mktemp("state")
    write(root, START)
    engine = Engine(spark, str(root), Store(spark, str(state)))
    engine.index()
    return str(root), engine


def test_cold_build_and_scoped_edits_equal_a_cold_build(spark, built):
    root, engine = built
    found = {tuple(r) for r in engine.store.load()["edges"].where("relation = 'calls'").select("source", "confidence", "target_id", "target_name").collect()}
    assert found == {
        ("fn:a/src/lib.rs:run", "EXTRACTED", "fn:b/src/util.rs:helper", None), ("fn:a/src/lib.rs:run", "EXTRACTED", "fn:a/src/lib.rs:local", None), ("fn:a/src/lib.rs:run", "EXTRACTED", None, "missing"),
        ("fn:a/src/lib.rs:local", "EXTRACTED", "fn:a/src/lib.rs:make", None), ("fn:a/src/lib.rs:local", "EXTRACTED", "fn:a/src/t.rs:Thing::go", None),
    }
    assert "zz" not in str(nodes(engine)) and ("project:a", "project:b") in {(r["source"], r["target_id"]) for r in engine.store.load()["edges"].where("relation = 'depends_on'").collect()}
    reports = []
    for step in STEPS:
        write(root, step)
        reports.append(engine.apply(engine.reconcile()))
    assert not reports[0].full and reports[1].full and reports[1].changed == 3
    cold = Engine(spark, root, clusters=None)
    cold.index()
    assert edges(engine) == edges(cold) and nodes(engine) == nodes(cold)
    assert engine.reconcile().count() == 0
    assert engine.status()["files"] == 6
    members = engine.store.load()["partition"].count()
    assert members == engine.store.load()["nodes"].where("kind <> 'project'").count()


def test_stream_of_changes(spark, built, tmp_path):
    root, engine = built
    write(root, {"a/src/t.rs": "pub struct Thing;\npub fn streamed() {}\n"})
    os.makedirs(tmp_path / "in")
    events = [("p", "a/src/t.rs", "M", 1, 2), ("p", "a/src/t.rs", "D", 1, 1), ("p", "a/src/gone.rs", "A", 3, 3), ("p", "ignored/x.rs", "A", 1, 4), ("q", "z.rs", "A", 1, 5)]
    with open(tmp_path / "in" / "1.json", "w") as f:
        f.writelines(json.dumps(dict(zip(("project", "path", "op", "priority", "seq"), e))) + "\n" for e in events)
    seen = []
    applier = streaming.Applier({"p": engine}, deferral=1, on_report=lambda p, r: seen.append((p, r)))
    query = streaming.run(streaming.read_events(spark, str(tmp_path / "in")), applier, str(tmp_path / "checkpoint"))
    query.awaitTermination()
    assert [(p, r.changed, r.vanished) for p, r in seen] == [("p", 2, 1)]
    assert "fn:a/src/t.rs:streamed" in str(nodes(engine)) and "zz" not in str(nodes(engine))
    applier(spark.createDataFrame(events, streaming.EVENTS), 0)  # the same batch again
    assert len(seen) == 1
