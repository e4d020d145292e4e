"""Queries over source files made of the tables' rows: extraction, manifests, change detection, exports. Each row gives its own files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..operators import graph
from ..sources import changes, manifests
from ..sources.extract import extract, split, spread
from .catalogue import register, table

#: language: (path, content), both with {k} for the part's key and {n} for the next one's.
FILES = {
    "rust": ("src/p{k}.rs", "use crate::p{n}::S{n};\npub trait T{k} {{}}\npub struct S{k} {{ next: S{n} }}\nimpl T{k} for S{k} {{\n    fn run(&self) {{\n        helper{k}();\n    }}\n}}\nfn helper{k}() {{}}\n"),
    "python": ("lib/m{k}.py", "from m{n} import C{n}\nclass C{k}(C{n}):\n    def run(self):\n        return helper{k}()\ndef helper{k}():\n    pass\n"),
    "typescript": (
        "web/f{k}.ts",
        "import {{ K{n} }} from './f{n}';\nexport interface I{k} {{}}\nexport class K{k} extends K{n} implements I{k} {{\n  run(): void {{ helper{k}(); }}\n}}\nexport function helper{k}() {{}}\n"
        "export {{ K{n} as Again{k} }} from './f{n}';\nexport * from './g{n}';\n",
    ),
    "go": ("cmd/g{k}.go", "func start{k}() {{\n  helper{k}()\n}}\nfunc helper{k}() {{\n}}\n"),
}
_KEYS = "WITH p AS (SELECT p_partkey AS k, p_partkey + 1 AS n FROM part)"


def _filled(pattern: str) -> Column:
    text = F.lit(pattern.replace("{{", "\1").replace("}}", "\2"))
    for name in ("k", "n"):
        text = F.replace(text, F.lit("{" + name + "}"), F.col(name).cast("string"))
    return F.replace(F.replace(text, F.lit("\1"), F.lit("{")), F.lit("\2"), F.lit("}"))


def files(spark, sf: str, *languages: str) -> DataFrame:
    """(path, language, content binary): a file of each language for each part."""
    keys = spread(table(spark, sf, "part").select(F.col("p_partkey").alias("k")), "k").select("k", (F.col("k") + 1).alias("n"))
    out = None
    for name in languages:
        path, content = FILES[name]
        one = keys.select(_filled(path).alias("path"), _filled(content).cast("binary").alias("content"))
        out = one if out is None else out.unionByName(one)
    return out.select("path", changes.language(F.col("path")).alias("language"), "content")


def _sql(rows: list[tuple[str, ...]], names: list[str]) -> str:
    """SELECTs over p; in a value {k} and {n} stand for the keys, None is null."""

    def value(text: str | None) -> str:
        if text is None:
            return "CAST(NULL AS VARCHAR)"
        parts = text.replace("{k}", "\1k\1").replace("{n}", "\1n\1").split("\1")
        return " || ".join(("'" + x.replace("'", "''") + "'") if i % 2 == 0 else f"CAST({x} AS VARCHAR)" for i, x in enumerate(parts) if x) or "''"

    return _KEYS + " " + " UNION ALL ".join("SELECT " + ", ".join(f"{value(v)} AS {c}" for v, c in zip(row, names)) + " FROM p" for row in rows)


_NODES = {
    "rust": [("file:src/p{k}.rs", "src/p{k}.rs", "file"), ("type:src/p{k}.rs:T{k}", "T{k}", "trait"), ("type:src/p{k}.rs:S{k}", "S{k}", "struct"), ("fn:src/p{k}.rs:S{k}::run", "run", "function"), ("fn:src/p{k}.rs:helper{k}", "helper{k}", "function")],
    "python": [("file:lib/m{k}.py", "lib/m{k}.py", "file"), ("type:lib/m{k}.py:C{k}", "C{k}", "class"), ("fn:lib/m{k}.py:C{k}::run", "run", "function"), ("fn:lib/m{k}.py:helper{k}", "helper{k}", "function")],
    "typescript": [("file:web/f{k}.ts", "web/f{k}.ts", "file"), ("type:web/f{k}.ts:I{k}", "I{k}", "interface"), ("type:web/f{k}.ts:K{k}", "K{k}", "class"), ("fn:web/f{k}.ts:K{k}::run", "run", "function"), ("fn:web/f{k}.ts:helper{k}", "helper{k}", "function")],
    "go": [("file:cmd/g{k}.go", "cmd/g{k}.go", "file"), ("fn:cmd/g{k}.go:start{k}", "start{k}", "function"), ("fn:cmd/g{k}.go:helper{k}", "helper{k}", "function")],
}
_REFS = {
    "rust": [("file:src/p{k}.rs", "imports", "S{n}", "crate::p{n}"), ("type:src/p{k}.rs:S{k}", "type/field", "S{n}", None), ("fn:src/p{k}.rs:S{k}::run", "calls", "helper{k}", None), ("type:src/p{k}.rs:S{k}", "implements", "T{k}", None)],
    "typescript": [("file:web/f{k}.ts", "imports", "K{n}", "./f{n}"), ("type:web/f{k}.ts:K{k}", "extends", "K{n}", None), ("type:web/f{k}.ts:K{k}", "implements", "I{k}", None), ("fn:web/f{k}.ts:K{k}::run", "calls", "helper{k}", None)],
    "go": [("fn:cmd/g{k}.go:start{k}", "calls", "helper{k}", None)],
}
_PYTHON_REFS = [("type:lib/m{k}.py:C{k}", "inherits", "C{n}"), ("fn:lib/m{k}.py:C{k}::run", "calls", "helper{k}")]
_EDGES = {
    "rust": [("file:src/p{k}.rs", "type:src/p{k}.rs:T{k}"), ("file:src/p{k}.rs", "type:src/p{k}.rs:S{k}"), ("type:src/p{k}.rs:S{k}", "fn:src/p{k}.rs:S{k}::run"), ("file:src/p{k}.rs", "fn:src/p{k}.rs:helper{k}")],
    "python": [("file:lib/m{k}.py", "type:lib/m{k}.py:C{k}"), ("type:lib/m{k}.py:C{k}", "fn:lib/m{k}.py:C{k}::run"), ("file:lib/m{k}.py", "fn:lib/m{k}.py:helper{k}")],
    "typescript": [("file:web/f{k}.ts", "type:web/f{k}.ts:I{k}"), ("file:web/f{k}.ts", "type:web/f{k}.ts:K{k}"), ("type:web/f{k}.ts:K{k}", "fn:web/f{k}.ts:K{k}::run"), ("file:web/f{k}.ts", "fn:web/f{k}.ts:helper{k}")],
}


def _register_language(name: str) -> None:
    register(f"extract_{name}_nodes", _sql(_NODES[name], ["id", "label", "kind"]))(lambda spark, sf: split(extract(files(spark, sf, name), "node"))["nodes"].select("id", "label", "kind"))
    if name in _REFS:
        register(f"extract_{name}_refs", _sql(_REFS[name], ["source", "relation", "name", "specifier"]))(lambda spark, sf: split(extract(files(spark, sf, name), "ref"))["refs"].select("source", "relation", "name", "specifier"))
    if name in _EDGES:
        register(f"extract_{name}_contains", _sql(_EDGES[name], ["source", "target_id"]))(lambda spark, sf: split(extract(files(spark, sf, name), "edge"))["edges"].where("relation = 'contains'").select("source", "target_id"))


for _language in FILES:
    _register_language(_language)


@register("extract_python_refs", _sql(_PYTHON_REFS, ["source", "relation", "name"]))
def extract_python_refs(spark, sf):
    return split(extract(files(spark, sf, "python"), "ref"))["refs"].where("relation <> 'imports'").select("source", "relation", "name")


@register(
    "extract_spans",
    _KEYS + """ SELECT 'type:src/p' || k || '.rs:T' || k AS id, 2 AS first, 2 AS last FROM p UNION ALL SELECT 'fn:src/p' || k || '.rs:S' || k || '::run', 5, 7 FROM p
UNION ALL SELECT 'type:lib/m' || k || '.py:C' || k, 2, 4 FROM p UNION ALL SELECT 'type:web/f' || k || '.ts:K' || k, 3, 5 FROM p""",
)
def extract_spans(spark, sf):
    """Where the parsers say that definitions of several kinds begin and end."""
    found = split(extract(files(spark, sf, "rust", "python", "typescript"), "node"))["nodes"]
    wanted = found.where((F.col("kind").isin("trait", "class")) | (F.col("id").startswith("fn:src/") & F.col("id").endswith("::run")))
    return wanted.select("id", F.col("span_start").alias("first"), F.col("span_end").alias("last"))


@register(
    "extract_exports",
    _sql(
        [("web/f{k}.ts", "local", "I{k}", None, None), ("web/f{k}.ts", "local", "K{k}", None, None), ("web/f{k}.ts", "local", "helper{k}", None, None), ("web/f{k}.ts", "reexport", "Again{k}", "./f{n}", "K{n}"), ("web/f{k}.ts", "star", None, "./g{n}", None)],
        ["file", "kind", "name", "specifier", "imported"],
    ),
)
def extract_exports(spark, sf):
    return split(extract(files(spark, sf, "typescript"), "export"))["exports"].select("file", "kind", "name", "specifier", "imported")


@register(
    "extract_attributes",
    _KEYS + """ SELECT 'type:src/p' || k || '.rs:T' || k AS id, CAST(NULL AS VARCHAR) AS impl, 'true' AS abstract FROM p UNION ALL SELECT 'fn:src/p' || k || '.rs:S' || k || '::run', 'S' || k, NULL FROM p
UNION ALL SELECT 'type:web/f' || k || '.ts:I' || k, NULL, 'true' FROM p UNION ALL SELECT 'fn:web/f' || k || '.ts:K' || k || '::run', 'K' || k, NULL FROM p""",
)
def extract_attributes(spark, sf):
    """The owner of each method and what is abstract."""
    found = split(extract(files(spark, sf, "rust", "typescript"), "node"))["nodes"].select("id", F.col("attrs")["impl"].alias("impl"), F.col("attrs")["abstract"].alias("abstract"))
    return found.where("impl IS NOT NULL OR abstract IS NOT NULL")


_MANIFESTS = {
    "rs{k}/Cargo.toml": '[package]\nname = "crate{k}"\n[dependencies]\ncrate{n} = "1"\n[dev-dependencies]\nprobe = "2"\n',
    "js{k}/package.json": '\1"name":"pkg{k}","main":"index{k}.js","dependencies":\1"pkg{n}":"1"\2,"devDependencies":\1"lint":"2"\2\2',
    "go{k}/go.mod": 'module example.org/m{k}\nrequire (\n\texample.org/m{n} v1\n)\n',
    "py{k}/pyproject.toml": '[project]\nname = "dist{k}"\n',
}


@register(
    "project_manifests",
    _KEYS + """ SELECT 'rs' || k AS root, 'Cargo.toml' AS manifest, 'crate' || k AS name, CAST(NULL AS VARCHAR) AS entry, 'crate' || n || ',probe' AS deps FROM p
UNION ALL SELECT 'js' || k, 'package.json', 'pkg' || k, 'index' || k || '.js', 'pkg' || n || ',lint' FROM p
UNION ALL SELECT 'go' || k, 'go.mod', 'example.org/m' || k, NULL, 'example.org/m' || n FROM p UNION ALL SELECT 'py' || k, 'pyproject.toml', 'dist' || k, NULL, '' FROM p""",
)
def project_manifests(spark, sf):
    keys = spread(table(spark, sf, "part").select(F.col("p_partkey").alias("k")), "k").select("k", (F.col("k") + 1).alias("n"))
    parts = [keys.select(_filled(path).alias("path"), _filled(text.replace("\1", "{{").replace("\2", "}}")).cast("binary").alias("content")) for path, text in _MANIFESTS.items()]
    made = parts[0]
    for part in parts[1:]:
        made = made.unionByName(part)
    return manifests.projects(made).withColumn("deps", F.array_join("deps", ","))


_ENDS = ("rs", "py", "tsx", "mjs", "go", "hpp", "md", "txt", "bin")
_LISTED = "WITH f AS (SELECT o_orderkey % 9 AS e, 'd/o' || o_orderkey || '.' || (ARRAY['rs','py','tsx','mjs','go','hpp','md','txt','bin'])[o_orderkey % 9 + 1] AS path FROM orders)"


def _listed(spark, sf) -> DataFrame:
    end = F.element_at(F.array(*map(F.lit, _ENDS)), (F.col("o_orderkey") % 9 + 1).cast("int"))
    return table(spark, sf, "orders").select(F.concat(F.lit("d/o"), "o_orderkey", F.lit("."), end).alias("path"))


@register(
    "file_classes",
    _LISTED + """ SELECT path, CASE e WHEN 0 THEN 'rust' WHEN 1 THEN 'python' WHEN 2 THEN 'typescript' WHEN 3 THEN 'javascript' WHEN 4 THEN 'go' WHEN 5 THEN 'cpp' END AS language,
CASE WHEN e < 6 THEN 'code' WHEN e < 8 THEN 'doc' ELSE 'other' END AS kind, e < 6 AS indexable FROM f""",
)
def file_classes(spark, sf):
    path = F.col("path")
    return _listed(spark, sf).select("path", changes.language(path).alias("language"), changes.kind(path).alias("kind"), changes.is_indexable(path).alias("indexable"))


@register("content_hashes", "SELECT doc_id, substring(sha256(coalesce(text, '')), 1, 16) AS hash FROM documents")
def content_hashes(spark, sf):
    docs = table(spark, sf, "documents")
    return docs.select("doc_id", changes.content_hash(F.coalesce("text", F.lit("")).cast("binary")).alias("hash"))


_STATE = """WITH d AS (SELECT doc_id, 'doc/' || doc_id || '.py' AS path, sha256(coalesce(text, '')) AS hash FROM documents), now AS (SELECT * FROM d WHERE doc_id % 5 <> 0),
was AS (SELECT doc_id, path, CASE WHEN doc_id % 3 = 0 THEN 'old' ELSE hash END AS hash FROM d WHERE doc_id % 7 <> 0),
asked AS (SELECT doc_id, path, CASE WHEN doc_id % 4 = 0 THEN 'D' ELSE 'M' END AS op FROM d)"""


def _states(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.concat(F.lit("doc/"), "doc_id", F.lit(".py")).alias("path"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("hash"))
    now = d.where("doc_id % 5 <> 0").select("path", "hash", F.lit(2).cast("long").alias("mtime_ns"))
    was = d.where("doc_id % 7 <> 0").select("path", F.when(F.col("doc_id") % 3 == 0, "old").otherwise(F.col("hash")).alias("hash"), F.lit(1).cast("long").alias("mtime_ns"))
    return now, was, d.select("path", F.when(F.col("doc_id") % 4 == 0, "D").otherwise("M").alias("op"))


@register(
    "gate_changes",
    _STATE + """ SELECT a.path, a.op FROM asked a LEFT JOIN now n USING (path) LEFT JOIN was w USING (path)
WHERE a.op = 'D' OR (n.path IS NOT NULL AND (w.path IS NULL OR w.hash <> n.hash))""",
)
def gate_changes(spark, sf):
    now, was, asked = _states(spark, sf)
    return changes.gate(asked, now, was)


@register(
    "fold_vanished",
    _STATE + """ SELECT a.path, CASE WHEN a.op <> 'D' AND n.path IS NULL THEN 'D' ELSE a.op END AS op, a.op <> 'D' AND n.path IS NULL AS vanished FROM asked a LEFT JOIN now n USING (path)""",
)
def fold_vanished(spark, sf):
    now, _, asked = _states(spark, sf)
    return changes.fold_vanished(asked, now)


@register("dedup_states", _STATE + " SELECT n.path, CASE WHEN w.path IS NULL THEN 'new' WHEN w.hash = n.hash THEN 'unchanged' ELSE 'changed' END AS state FROM now n LEFT JOIN was w USING (path)")
def dedup_states(spark, sf):
    now, was, _ = _states(spark, sf)
    return changes.dedup(now, was, deep=True).select("path", "state")


@register(
    "edge_recall_precision",
    """WITH a AS (SELECT DISTINCT l_suppkey AS s, l_partkey AS t FROM lineitem), b AS (SELECT * FROM a WHERE t % 4 <> 0 UNION SELECT s, t + 1000000 FROM a WHERE t % 10 = 0)
SELECT (SELECT count(*) FROM a) AS n_expected, (SELECT count(*) FROM b) AS n_found, (SELECT count(*) FROM a JOIN b USING (s, t)) AS n_both,
round((SELECT count(*) FROM a JOIN b USING (s, t)) / (SELECT count(*) FROM a), 6) AS recall, round((SELECT count(*) FROM a JOIN b USING (s, t)) / (SELECT count(*) FROM b), 6) AS precision""",
)
def edge_recall_precision(spark, sf):
    """Recall and precision of a set of edges with some left out and some made up, against the whole."""
    edges = table(spark, sf, "lineitem").select(F.col("l_suppkey").cast("string").alias("source"), F.lit("implements").alias("relation"), F.col("l_partkey").alias("t"))
    found = edges.where("t % 4 <> 0").unionByName(edges.where("t % 10 = 0").withColumn("t", F.col("t") + 1000000))
    named = lambda df: df.select("source", "relation", F.col("t").cast("string").alias("target_id"))
    return graph.edge_agreement(named(edges), named(found)).select("n_expected", "n_found", "n_both", "recall", "precision")
