"""Project manifests: name, entry and dependencies."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .changes import is_manifest

SCHEMA = "root string, manifest string, name string, entry string, deps array<string>"


def _json(text: str) -> tuple[str | None, str | None, list[str]]:
    try:
        found = json.loads(text)
    except ValueError:
        return None, None, []
    if not isinstance(found, dict):
        return None, None, []
    name = found.get("name")
    entry = next((found[k] for k in ("main", "module", "exports") if isinstance(found.get(k), str)), None)
    sections = (found.get(k) for k in ("dependencies", "devDependencies", "peerDependencies"))
    return name if isinstance(name, str) else None, entry, [d for s in sections if isinstance(s, dict) for d in s]


def _quoted(line: str, key: str) -> str | None:
    left, mark, right = line.partition("=")
    right = right.split("#")[0].strip()
    if not mark or left.strip() != key or len(right) < 2 or right[0] != '"' or right[-1] != '"':
        return None
    return right[1:-1]


def _toml(text: str, section: str) -> tuple[str | None, str | None, list[str]]:
    """The first name in a section; the keys of the dependency tables, not of sub-tables."""
    name, deps, here = None, [], ""
    for line in map(str.strip, text.splitlines()):
        if line.startswith("[") and line.endswith("]"):
            here = line[1:-1].strip()
        elif here == section and name is None and (found := _quoted(line, "name")) is not None:
            name = found
        elif here in ("dependencies", "dev-dependencies") and "=" in line:
            key = line.split("=", 1)[0].strip()
            if key and key[0] != "[":
                deps.append(key)
    return name, None, deps


def _go(text: str) -> tuple[str | None, str | None, list[str]]:
    name, deps, block = None, [], False
    for line in map(str.strip, text.splitlines()):
        if line.startswith("module "):
            name = name or line[7:].strip().strip('"').strip() or None
        elif line == "require (":
            block = True
        elif block and line == ")":
            block = False
        elif line.startswith("require ") or block:
            words = line.removeprefix("require ").split()
            deps += words[:1]
    return name, None, deps


def parse(basename: str, content: bytes) -> tuple[str | None, str | None, list[str]]:
    """(name, entry, deps); a garbled manifest has none of them but still marks a project."""
    text = content.decode("utf-8", "replace")
    if basename in "package.json deno.json deno.jsonc".split():
        return _json(text)
    if basename == "Cargo.toml":
        return _toml(text, "package")
    if basename == "pyproject.toml":
        return _toml(text, "project")[0] or _toml(text, "tool.poetry")[0], None, []
    if basename == "go.mod":
        return _go(text)
    return None, None, []


def projects(files: DataFrame) -> DataFrame:
    """files(path, content) -> (root, manifest, name, entry, deps), one project for each directory with a manifest: of
    several manifests in one the last by name."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch.path, batch.content):
                root, _, base = path.rpartition("/")
                name, entry, deps = parse(base, bytes(content))
                rows.append({"root": root, "manifest": base, "name": name, "entry": entry, "deps": deps})
            yield pd.DataFrame(rows, columns=["root", "manifest", "name", "entry", "deps"])

    found = files.where(is_manifest(F.col("path")) & F.col("content").isNotNull()).select("path", "content").mapInPandas(run, SCHEMA)
    best = found.groupBy("root").agg(F.max_by(F.struct("manifest", "name", "entry", "deps"), "manifest").alias("m"))
    return best.select("root", "m.*")
