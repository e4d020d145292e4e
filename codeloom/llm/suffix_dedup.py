"""Byte-level deduplication of repeated substrings by suffix sorting with bucket-pointer refinement.

Suffixes that can begin a repeated window start from buckets of an anchor gram of 32 bytes, spread over the cluster
by its hash, and are refined inside their task by sorting on the identifiers of later offsets (windows._refined).
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from .windows import Spec, remove_repeats

LENGTH, GRAM = 100, 32


def remove_repeated_bytes(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """docs(doc_id, text, ...) -> (doc_id, n_bytes, n_removed, n_spans, kept_sha256), a row for every row of docs.

    Removed is each byte covered by a string of length bytes that also starts earlier: in a document with a smaller
    doc_id, or before in the same one. remove_repeats states what null, repeated and empty input gives.
    """
    return remove_repeats(docs, Spec(length, gram, words=False, strict=False)).withColumnRenamed("n_units", "n_bytes")
