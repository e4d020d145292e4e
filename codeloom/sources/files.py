"""Listing a source tree within its boundary: hidden, noise and ignored paths stay out."""

from __future__ import annotations

import os
import re
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import changes

OUTPUT = ".codeloom"
NOISE = frozenset((".git", "target", "node_modules", ".venv", "__pycache__", ".mypy_cache", OUTPUT))


@lru_cache(maxsize=4096)
def _pattern(glob: str) -> re.Pattern:
    """An ignore pattern's glob as a regular expression over a whole relative path."""
    out, k = [], 0
    while k < len(glob):
        c = glob[k]
        if glob.startswith("**/", k) and (k == 0 or glob[k - 1] == "/"):
            out.append("(?:.*/)?")
            k += 3
            continue
        if glob.startswith("/**", k) and k + 3 == len(glob):
            out.append("/.+")
            break
        if c == "*":
            while glob[k : k + 2] == "**":
                k += 1
            out.append("[^/]*")
        elif c == "?":
            out.append("[^/]")
        elif c == "[" and "]" in glob[k + 2 :]:
            stop = glob.index("]", k + 2)
            body = glob[k + 1 : stop]
            out.append("[" + ("^" + body[1:] if body[0] in "!^" else body).replace("\\", "\\\\") + "]")
            k = stop
        elif c == "\\" and k + 1 < len(glob):
            k += 1
            out.append(re.escape(glob[k]))
        else:
            out.append(re.escape(c))
        k += 1
    return re.compile("".join(out) + r"\Z", re.S)


class IgnoreFile:
    """The rules of one ignore file; the last one that matches decides."""

    def __init__(self, text: str):
        self.rules: list[tuple[re.Pattern, bool, bool]] = []  # pattern, whitelisted, directories only
        for line in text.splitlines():
            line = re.sub(r"(?<!\\)\s+$", "", line)
            if not line or line.startswith("#"):
                continue
            keep = line.startswith("!")
            line = line[1:] if keep else line
            only_dirs = line.endswith("/")
            line = line.rstrip("/")
            if not line:
                continue
            anchored = "/" in line
            line = line.lstrip("/")
            try:
                self.rules.append((_pattern(line if anchored else "**/" + line), keep, only_dirs))
            except re.error:
                continue

    def decide(self, path: str, is_dir: bool) -> bool | None:
        """True: ignored, False: kept, None: no rule. path is relative to the ignore file's directory."""
        for pattern, keep, only_dirs in reversed(self.rules):
            if (is_dir or not only_dirs) and pattern.match(path):
                return not keep
        return None


class Boundary:
    """Which files of a tree count: walk() lists them, matches() tells the same of one path."""

    def __init__(self, root: str):
        self.root = os.path.abspath(root)
        self._files: dict[str, IgnoreFile | None] = {}

    def _rules(self, directory: str) -> IgnoreFile | None:
        if directory not in self._files:
            try:
                with open(os.path.join(self.root, directory, ".gitignore"), encoding="utf-8", errors="replace") as f:
                    self._files[directory] = IgnoreFile(f.read())
            except OSError:
                self._files[directory] = None
        return self._files[directory]

    def _out(self, path: str, is_dir: bool) -> bool:
        """Whether the last component puts path out, its directories being in."""
        name = path.rsplit("/", 1)[-1]
        if name.startswith(".") or name in NOISE:
            return True
        verdict, parts = None, path.split("/")
        for depth in range(len(parts)):
            rules = self._rules("/".join(parts[:depth]))
            found = rules.decide("/".join(parts[depth:]), is_dir) if rules else None
            verdict = verdict if found is None else found
        return bool(verdict)

    def matches(self, path: str) -> bool:
        parts = [p for p in path.replace("\\", "/").removeprefix("./").split("/") if p and p != "."]
        return bool(parts) and not any(self._out("/".join(parts[: k + 1]), k < len(parts) - 1) for k in range(len(parts)))

    def walk(self) -> list[str]:
        out, stack = [], [""]
        while stack:
            directory = stack.pop()
            try:
                entries = list(os.scandir(os.path.join(self.root, directory)))
            except OSError:
                continue
            for entry in entries:
                path = f"{directory}/{entry.name}" if directory else entry.name
                try:
                    path.encode()
                except UnicodeEncodeError:  # a name that no change set could carry
                    continue
                is_dir = entry.is_dir(follow_symlinks=False)
                if self._out(path, is_dir):
                    continue
                if is_dir:
                    stack.append(path)
                elif entry.is_file(follow_symlinks=False):
                    out.append(path)
        return sorted(out)


def listing(spark: SparkSession, root: str, paths: list[str] | None = None) -> DataFrame:
    """(path, mtime_ns, language) of a tree's files, without their bytes."""
    rows = []
    for path in Boundary(root).walk() if paths is None else paths:
        try:
            rows.append((path, os.stat(os.path.join(root, path)).st_mtime_ns))
        except OSError:
            continue
    return spark.createDataFrame(rows, "path string, mtime_ns long").withColumn("language", changes.language(F.col("path")))


def contents(spark: SparkSession, root: str, paths: list[str]) -> DataFrame:
    """(path, language, content) of the given files: read by executors, which share the tree."""
    if not paths:
        return spark.createDataFrame([], "path string, language string, content binary")
    base = "file://" + os.path.abspath(root)
    found = spark.read.format("binaryFile").load([f"{base}/{p}" for p in paths])
    relative = F.substring(F.regexp_replace("path", "^file:/+", "/"), len(os.path.abspath(root)) + 2, 100_000)
    return found.select(relative.alias("path"), "content").withColumn("language", changes.language(F.col("path")))


def with_hashes(listed: DataFrame, read: DataFrame) -> DataFrame:
    """listed with the content's hash from read(path, content); null where a file couldn't be read."""
    return listed.join(read.select("path", changes.content_hash(F.col("content")).alias("hash")), "path", "left")
