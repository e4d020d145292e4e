"""Which file an import's specifier means, as joins over candidate paths in order of preference."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.relations import ancestors, dirname
from .link import joined_path, probe, project_of

#: Entry files of a package that declares none, in order.
ENTRIES = tuple(p + f"index.{e}" for p in ("", "src/") for e in ("ts", "js")) + ("src/lib.rs", "src/main.rs")


def _joined(directory: Column, name: Column) -> Column:
    return F.when(directory == "", name).otherwise(F.concat(directory, F.lit("/"), name))


def _first_existing(rows: DataFrame, files: DataFrame, candidates: Column, key: list[str]) -> DataFrame:
    """rows' key with target: the first of candidates(array of paths) that is in files."""
    known = files.select(F.col("path").alias("_p")).distinct()
    spread = rows.select(*key, F.posexplode(candidates).alias("_n", "_p"))
    return spread.join(known, "_p").groupBy(*key).agg(F.min_by("_p", "_n").alias("target"))


def package_entries(projects: DataFrame, files: DataFrame) -> DataFrame:
    """(name, root, entry_file) of named projects, the last root of each name: the declared entry if a file of that name is
    there, else the first usual one."""
    named = projects.where(F.col("name").isNotNull()).groupBy("name").agg(F.max_by(F.struct("root", "entry"), "root").alias("p")).select("name", "p.*")
    declared = probe(named.where(F.col("entry").isNotNull()).select("name", joined_path(F.col("root"), F.col("entry")).alias("path")), files)
    usual = _first_existing(named, files, F.array(*(_joined(F.col("root"), F.lit(e)) for e in ENTRIES)), ["name"]).withColumnRenamed("target", "_usual")
    return named.join(declared.select("name", "file"), "name", "left").join(usual, "name", "left").select("name", "root", F.coalesce("file", "_usual").alias("entry_file"))


def crate_bases(roots: DataFrame, files: DataFrame) -> DataFrame:
    """(root, base): the directory of a crate's root module, src unless the root itself holds it."""
    marks = F.array(*(F.struct(F.lit(base).alias("b"), _joined(F.col("root"), F.lit(base + m)).alias("p")) for base in ("src/", "") for m in ("lib.rs", "main.rs")))
    spread = roots.select("root", F.explode(marks).alias("m")).select("root", "m.b", F.col("m.p").alias("path"))
    found = spread.join(files.select("path").distinct(), "path").groupBy("root").agg(F.max("b").alias("b"))
    here = F.when(F.col("b") == "", F.col("root")).otherwise(_joined(F.col("root"), F.lit("src")))
    return roots.select("root").distinct().join(found, "root", "left").select("root", here.alias("base"))


def _rust(asked: DataFrame, files: DataFrame, projects: DataFrame) -> DataFrame:
    """crate, self, super and workspace crates by the module-is-a-file convention."""
    bases = crate_bases(projects.select("root").distinct(), files)
    rows = project_of(asked, projects, "file").withColumnRenamed("project", "root").join(bases, "root", "left")
    crates = projects.where(F.col("name").isNotNull()).groupBy("name").agg(F.max("root").alias("root")).join(bases, "root")
    segments = F.filter(F.transform(F.split("specifier", "::"), lambda s: F.trim(s)), lambda s: s != "")
    rows = rows.withColumn("_seg", segments).where(F.size("_seg") > 0).withColumn("_head", F.col("_seg")[0])
    rows = rows.join(crates.select(F.col("name").alias("_head"), F.col("base").alias("_dep")), "_head", "left")
    inside = F.when(F.col("base") == "", F.col("file")).when(F.col("file").startswith(F.concat("base", F.lit("/"))), F.expr("substring(file, length(base) + 2)")).otherwise(F.col("file"))
    own = F.split(F.regexp_replace(inside, r"\.rs$", ""), "/")
    own = F.when(F.element_at(own, -1).isin("mod", "lib", "main"), F.slice(own, 1, F.size(own) - 1)).otherwise(own)
    up = F.slice(own, 1, F.greatest(F.size(own) - 1, F.lit(0)))
    empty = F.array().cast("array<string>")
    head = F.col("_head")
    prefix = F.when(head == "self", own).when(head == "super", up).otherwise(empty)
    base = F.when(head.isin("crate", "self", "super"), F.col("base")).otherwise(F.col("_dep"))
    rest = F.slice("_seg", 2, F.greatest(F.size("_seg") - 1, F.lit(0)))
    rows = rows.withColumn("_base", base).where(F.col("_base").isNotNull()).withColumn("_path", F.concat(prefix, rest))
    stem = _joined(F.col("_base"), F.array_join("_path", "/"))
    module = F.array(F.concat(stem, F.lit(".rs")), F.concat(stem, F.lit("/mod.rs")))
    top = F.array(*(_joined(F.col("_base"), F.lit(n)) for n in "lib.rs main.rs mod.rs".split()))
    return _first_existing(rows, files, F.when(F.size("_path") == 0, top).otherwise(module), ["file", "specifier"])


def resolve_modules(asked: DataFrame, files: DataFrame, projects: DataFrame) -> DataFrame:
    """asked(file, specifier) -> (file, specifier, target), with rows only for what resolves.

    A path from . is joined to the file's directory; a module path in a Rust file goes by crates; any other name is
    the longest project name that it is or lies under: that project's entry, or the rest below its root.
    """
    asked = asked.where(F.col("specifier").isNotNull()).select("file", "specifier").distinct()
    spec = F.col("specifier")
    rust = F.col("file").endswith(".rs") & ~spec.startswith(".") & ~spec.startswith("@") & (F.instr(spec, "/") == 0)
    key = ["file", "specifier"]
    relative = asked.where(spec.startswith(".")).withColumn("path", joined_path(dirname(F.col("file")), spec))
    by_path = probe(relative.withColumnRenamed("file", "_from"), files).select(F.col("_from").alias("file"), "specifier", F.col("file").alias("target"))
    by_crate = _rust(asked.where(rust), files, projects).select(*key, "target")
    entries = package_entries(projects, files)
    named = asked.where(~rust & ~spec.startswith("."))
    spread = named.select(*key, F.explode(F.filter(ancestors(spec), lambda a: a != "")).alias("name")).join(entries, "name")
    best = spread.groupBy(*key).agg(F.max_by(F.struct("name", "root", "entry_file"), F.length("name")).alias("p")).select(*key, "p.*")
    exact = best.where(F.col("name") == spec).select(*key, F.col("entry_file").alias("target"))
    under = best.where(F.col("name") != spec).select(F.col("file").alias("_from"), "specifier", _joined(F.col("root"), F.expr("substring(specifier, length(name) + 2)")).alias("path"))
    below = probe(under, files).select(F.col("_from").alias("file"), "specifier", F.col("file").alias("target"))
    return by_path.unionByName(by_crate).unionByName(exact).unionByName(below).where(F.col("target").isNotNull())
