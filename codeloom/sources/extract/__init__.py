"""Extraction: each file alone, by its language, into tagged rows."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from . import lines, python, rust, typescript
from .base import Builder

Extractor = Callable[[str, str | None, str], Builder]
EXTRACTORS: dict[str, Extractor] = {"rust": rust.extract, "python": python.extract, "typescript": typescript.extract, "javascript": typescript.extract}
#: Files that one task parses, a second or so.
FILES_A_TASK = 2_000
ROW_SCHEMA = "path string, tag string, pos long, body string"
NODE_SCHEMA = "id string, label string, kind string, source_file string, span_start int, span_end int, attrs map<string,string>"
EDGE_SCHEMA = "source string, relation string, target_id string"
REF_SCHEMA = "source string, relation string, name string, type string, specifier string, imported string, recv string, recv_returns string, recv_returns_owner string"
EXPORT_SCHEMA = "pos int, kind string, name string, specifier string, imported string"


def extract_file(path: str, language: str | None, content: bytes | str) -> Builder:
    """One file by the first extractor for its language; languages without a parser go by lines."""
    text = content.decode("utf-8", "replace") if isinstance(content, (bytes, bytearray)) else content
    return EXTRACTORS.get(language or "", lines.extract)(path, language, text)


def spread(rows: DataFrame, key: str) -> DataFrame:
    """rows over as many tasks as their number asks for: a table of keys is a few MB, which Spark reads in a task or two,
    however long the parsing of what is made of them takes."""
    return rows.repartition(max(1, math.ceil(rows.count() / FILES_A_TASK)), key)


def extract(files: DataFrame, *tags: str) -> DataFrame:
    """files(path, language, content binary) -> tagged rows, or only those of some tags (node, edge, ref, export); a null
    language or content gives none. No exchange: callers spread the files."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows: list[dict] = []
            for path, language, content in zip(batch.path, batch.language, batch.content):
                if language is not None and content is not None:
                    rows += extract_file(path, language, bytes(content)).rows(tags or None)
            yield pd.DataFrame(rows, columns=["path", "tag", "pos", "body"])

    return files.where("language IS NOT NULL").select("path", "language", "content").mapInPandas(run, ROW_SCHEMA)


def split(rows: DataFrame) -> dict[str, DataFrame]:
    """nodes, edges, refs and exports of tagged rows."""

    def part(tag: str, schema: str) -> DataFrame:
        return rows.where(F.col("tag") == tag).select("path", F.from_json("body", schema).alias("b")).select("path", "b.*")

    refs = part("ref", REF_SCHEMA)
    refs = refs.select(
        "source", "relation", "name", F.col("type").alias("type_hint"), "specifier", "imported", F.coalesce(F.col("recv") == "opaque", F.lit(False)).alias("recv_opaque"), "recv_returns", "recv_returns_owner",
    )
    none = F.lit(None).cast("string")
    return {
        "nodes": part("node", NODE_SCHEMA).drop("path"),
        "edges": part("edge", EDGE_SCHEMA).select("source", "relation", F.lit("EXTRACTED").alias("confidence"), "target_id", none.alias("target_name"), none.alias("recv")),
        "refs": refs,
        "exports": part("export", EXPORT_SCHEMA).withColumnRenamed("path", "file"),
    }
