"""Change capture: which files a listing or a version-control diff changes against a manifest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

LANGUAGES = {
    "rs": "rust", "py": "python", "js": "javascript", "mjs": "javascript", "cjs": "javascript", "ts": "typescript", "tsx": "typescript",
    "go": "go", "java": "java", "c": "c", "h": "c", "cpp": "cpp", "cc": "cpp", "hpp": "cpp",
}
DOCUMENTS = ("md", "rst", "txt")
MANIFESTS = tuple("pyproject.toml go.mod package.json deno.json deno.jsonc Cargo.toml".split())


def _extension(path: Column) -> Column:
    base = F.substring_index(path, "/", -1)
    return F.when(F.instr(base, ".") > 0, F.substring_index(base, ".", -1)).otherwise(F.lit(""))


def language(path: Column) -> Column:
    """The language of a code file by its extension; null for anything else."""
    table = F.create_map(*(F.lit(x) for pair in LANGUAGES.items() for x in pair))
    return F.try_element_at(table, _extension(path))


def kind(path: Column) -> Column:
    """code, doc or other."""
    return F.when(language(path).isNotNull(), "code").when(_extension(path).isin(*DOCUMENTS), "doc").otherwise("other")


def is_manifest(path: Column) -> Column:
    return F.substring_index(path, "/", -1).isin(*MANIFESTS)


def is_indexable(path: Column) -> Column:
    return language(path).isNotNull() | is_manifest(path)


def content_hash(content: Column) -> Column:
    """The first 16 hex digits of the SHA-256: an unsigned 64-bit number, for which there is no numeric type."""
    return F.substring(F.sha2(content, 256), 1, 16)


def dedup(now: DataFrame, manifest: DataFrame, deep: bool = False) -> DataFrame:
    """now(path, hash, mtime_ns) with state against manifest(path, hash, mtime_ns): new, unchanged or changed.

    An equal mtime is enough unless deep; an equal hash always is.
    """
    was = manifest.select("path", F.col("hash").alias("_hash"), F.col("mtime_ns").alias("_mtime"))
    same = F.col("hash") == F.col("_hash")
    if not deep:
        same = (F.col("mtime_ns") == F.col("_mtime")) | same
    return now.join(was, "path", "left").withColumn("state", F.when(F.col("_hash").isNull(), "new").when(same, "unchanged").otherwise("changed")).drop("_hash", "_mtime")


def reconcile(now: DataFrame, manifest: DataFrame, deep: bool = False) -> DataFrame:
    """(path, op in A/M/D): indexable files that are new, changed or unreadable (null hash), and manifest paths that the
    listing no longer has, files that have become ignored among them."""
    seen = dedup(now.where(is_indexable(F.col("path"))), manifest, deep).where(F.col("hash").isNull() | (F.col("state") != "unchanged"))
    changed = seen.select("path", F.when(F.col("state") == "new", "A").otherwise("M").alias("op"))
    return changed.unionByName(manifest.join(now.select("path"), "path", "left_anti").select("path", F.lit("D").alias("op")))


def gate(changes: DataFrame, now: DataFrame, manifest: DataFrame) -> DataFrame:
    """changes(path, op) less added and modified paths that are out of scope (not in now) or unchanged; removals pass."""
    state = dedup(now, manifest).select("path", "state")
    return changes.join(state, "path", "left").where((F.col("op") == "D") | (F.col("state").isNotNull() & (F.col("state") != "unchanged"))).select("path", "op")


def fold_vanished(changes: DataFrame, listing: DataFrame) -> DataFrame:
    """changes with added and modified paths that no longer exist as removals, marked vanished."""
    here = listing.select("path", F.lit(True).alias("_here")).distinct()
    gone = (F.col("op") != "D") & F.col("_here").isNull()
    return changes.join(here, "path", "left").select("path", F.when(gone, "D").otherwise(F.col("op")).alias("op"), gone.alias("vanished"))


def parse_name_status(raw: bytes, own_output: str = ".codeloom") -> list[tuple[str, str]]:
    """(path, op) of `git diff --name-status -z`: renames remove and add, copies add, odd letters modify; our own output is left out."""
    parts = [p for p in raw.decode("utf-8", "replace").split("\0") if p]
    out, k = set(), 0
    while k < len(parts):
        letter = parts[k][:1]
        if letter in "RC" and k + 2 < len(parts):
            if letter == "R":
                out.add((parts[k + 1], "D"))
            out.add((parts[k + 2], "A"))
            k += 3
        elif k + 1 < len(parts):
            out.add((parts[k + 1], {"A": "A", "D": "D"}.get(letter, "M")))
            k += 2
        else:
            break
    return sorted((p, op) for p, op in out if p.split("/")[0] != own_output)


def changes_frame(spark: SparkSession, rows: list[tuple[str, str]]) -> DataFrame:
    return spark.createDataFrame(rows, "path string, op string")
