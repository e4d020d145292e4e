"""Relation taxonomy, filters and small string functions as Column builders."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, functions as F

CALLS, CONTAINS, IMPORTS, DEPENDS_ON = "calls", "contains", "imports", "depends_on"
IMPLEMENTS, EXTENDS, INHERITS, HAS_VARIANT = "implements", "extends", "inherits", "has_variant"
TYPE_FAMILY = "type/"
STRUCTURAL = (CONTAINS, IMPORTS, DEPENDS_ON, HAS_VARIANT)
ANY, SEMANTIC = "any", "semantic"
LINKABLE = tuple("class enum function interface struct trait type_alias".split())
EXTRACTED, INFERRED, AMBIGUOUS = "EXTRACTED", "INFERRED", "AMBIGUOUS"
WEIGHTS = {EXTRACTED: 1.0, INFERRED: 0.5, AMBIGUOUS: 0.25}

#: A named question is a relation and the direction in which it is asked.
QUESTIONS = {
    "callers": (CALLS, "in"), "callees": (CALLS, "out"), "implementors": (IMPLEMENTS, "in"), "subtypes": (EXTENDS, "in"),
    "supertypes": (EXTENDS, "out"), "takes": ("type/param", "in"), "produces": ("type/return", "in"),
    "stores": ("type/field", "in"), "bounded_by": ("type/bound", "in"),
}


def is_structural(relation: Column) -> Column:
    return relation.isin(*STRUCTURAL)


def is_type_family(relation: Column) -> Column:
    return relation.startswith(TYPE_FAMILY)


def matches(relation: Column, entries: Iterable[str]) -> Column:
    """Whether any entry selects the relation: itself, its family, `any` or `semantic`. No entry selects everything."""

    def one(entry: str) -> Column:
        if entry == ANY:
            return F.lit(True)
        if entry == SEMANTIC:
            return ~is_structural(relation)
        family = entry[:-1] if entry.endswith("/") else entry
        return (relation == F.lit(entry)) | relation.startswith(family + "/")

    found = [one(e) for e in entries]
    return reduce(lambda a, b: a | b, found) if found else F.lit(True)


def normalized(entries: Iterable[str] | None) -> list[str]:
    """What a read surface asks for: semantic relations unless told otherwise."""
    return list(entries or ()) or [SEMANTIC]


def resolve_questions(entries: Iterable[str], direction: str = "both") -> tuple[list[str], str]:
    """Entries with named questions replaced; these fix the direction, and both directions if they disagree."""
    out, asked = [], set()
    for entry in entries:
        relation, way = QUESTIONS.get(entry, (entry, None))
        if relation not in out:
            out.append(relation)
        if way:
            asked.add(way)
    return out, direction if not asked else asked.pop() if len(asked) == 1 else "both"


def norm_type(name: Column) -> Column:
    """A type's bare name: generics cut off, last path segment, trimmed."""
    return F.trim(F.substring_index(F.substring_index(name, "<", 1), "::", -1))


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dirname(path: Column) -> Column:
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit(""))


def ancestors(path: Column) -> Column:
    """The path, each directory above it, and the root ''."""
    parts = F.split(path, "/")
    return F.concat(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/")), F.array(F.lit("")))


def trigrams(text: Column) -> Column:
    """The distinct three-character windows of the lower-cased text; a shorter text is its own, an empty one has none."""
    low = F.lower(text)
    windows = F.transform(F.sequence(F.lit(1), F.greatest(F.length(low) - 2, F.lit(1))), lambda k: F.substring(low, k, 3))
    return F.when(F.length(low) > 0, F.array_distinct(windows)).otherwise(F.array().cast("array<string>"))


def sanitize(text: Column) -> Column:
    return F.substring(F.regexp_replace(text, r"\p{Cc}", ""), 1, 256)


def render_span(start: Column, end: Column) -> Column:
    return F.when(start == end, F.concat(F.lit("L"), start)).otherwise(F.concat(F.lit("L"), start, F.lit("-L"), end))


def parse_span(text: Column) -> Column:
    """L7 or L7-L9 as struct(start, end); null for anything else."""
    start = F.regexp_extract(text, r"^L(\d+)(?:-L\d+)?$", 1)
    end = F.regexp_extract(text, r"^L\d+-L(\d+)$", 1)
    first = F.when(start != "", start.cast("int"))
    return F.when(first.isNotNull(), F.struct(first.alias("start"), F.when(end != "", end.cast("int")).otherwise(first).alias("end")))


def edge_key(hints: str | None = None) -> Column:
    """One string for an edge's whole identity, by which edges form a multiset."""
    pairs = F.array_sort(F.map_entries(F.col(hints))) if hints else F.lit(None)
    return F.to_json(F.struct(F.col("source").alias("s"), F.col("relation").alias("r"), F.col("confidence").alias("c"), F.col("target_id").alias("t"), F.col("target_name").alias("n"), pairs.alias("h")))
