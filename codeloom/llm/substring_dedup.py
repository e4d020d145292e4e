"""Word-level deduplication of repeated windows with a count-min prefilter."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .windows import Spec, _bucket, _split_by, _table, anchor_counts, remove_repeats

LENGTH, GRAM = 50, 16
#: Rows of the sketch, and a row's cells for each anchor that a bucket of 2.5 MB is expected to hold: some 40,000.
ROWS, CELLS_AN_ANCHOR, ANCHORS_A_BUCKET = 2, 8, 40_000
#: Cells whose counts one task merges, as bits of a cell's number.
SECTION_BITS = 22
_SALTS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)


class CountMin:
    """A count-min sketch of all buckets' anchors, held in sections over the cluster, never in one place.

    A row's cells grow with the input, a section's don't. Each bucket sends each section which of its cells its anchors
    fall in, once or more often; a section adds them up, two meaning two or more, and answers each bucket for the cells
    that it sent. Counts are never below the anchors' own, so an anchor is dropped only if some row counts it once.
    """

    def __init__(self, cells: int, section_bits: int = SECTION_BITS):
        self.section_bits = section_bits
        self.bits = max(section_bits, (cells - 1).bit_length())

    def _sections(self, hashes: np.ndarray):
        """(row * 2**32 + section, the distinct cells inside it in order, whether each holds one anchor, each anchor's place among them, the anchors)."""
        for row in range(ROWS):
            with np.errstate(over="ignore"):
                cells = (hashes ^ hashes >> np.uint64(29)) * _SALTS[row] >> np.uint64(64 - self.bits)
            section, local = (cells >> np.uint64(self.section_bits)).astype(np.int64), (cells & np.uint64((1 << self.section_bits) - 1)).astype("<u4")
            for at, inside, which in _split_by(section, local, np.arange(len(hashes))):
                yield row << 32 | at, inside, which

    def masks(self, held: DataFrame, spec: Spec) -> DataFrame:
        sent = "section long, bucket int, once int, packed binary"

        def sketch(table: pa.Table) -> pa.Table:
            at, out = table.column("bucket")[0].as_py(), []
            hashes, counts = anchor_counts(_bucket(table), spec)
            for section, inside, which in self._sections(hashes):
                cells, back = np.unique(inside, return_inverse=True)
                once = np.bincount(back, weights=counts[which]) == 1
                out.append((section, at, int(once.sum()), cells[once].tobytes() + cells[~once].tobytes()))
            return _table(sent, out)

        def merge(table: pa.Table) -> pa.Table:
            counts, out = np.zeros(1 << self.section_bits, np.uint8), []
            rows = list(zip(table.column("bucket").to_pylist(), table.column("once").to_pylist(), table.column("packed").to_pylist()))
            for _, once, packed in rows:
                cells = np.frombuffer(packed, "<u4")
                counts[cells[:once]] = np.minimum(counts[cells[:once]] + 1, 2)
                counts[cells[once:]] = 2
            section = table.column("section")[0].as_py()
            for bucket, once, packed in rows:
                again = np.sort(np.frombuffer(packed, "<u4", once)[counts[np.frombuffer(packed, "<u4", once)] > 1])
                if len(again) or once < len(packed) // 4:
                    out.append((section, bucket, 0, np.sort(np.r_[again, np.frombuffer(packed, "<u4")[once:]]).astype("<u4").tobytes()))
            return _table(sent, out)

        return held.groupBy("bucket").applyInArrow(sketch, sent).groupBy("section").applyInArrow(merge, sent)

    def keep(self, hashes: np.ndarray, masks: pa.Table) -> np.ndarray:
        repeated = dict(zip(masks.column("section").to_pylist(), masks.column("packed").to_pylist()))
        rows = np.zeros(len(hashes), np.int8)
        for section, inside, which in self._sections(hashes):
            if section in repeated:
                rows[which] += np.isin(inside, np.frombuffer(repeated[section], "<u4"))
        return rows == ROWS


def remove_repeated_words(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, cells: int | None = None) -> DataFrame:
    """docs(doc_id, text, ...) -> (doc_id, n_words, n_removed, n_spans, kept_sha256), a row for every row of docs.

    Removed is each word covered by a window of length words that also starts in a document with a smaller doc_id.
    A count-min sketch of the windows' anchors, whose counts are never below the windows' own, drops what can't
    repeat before anything is grouped; the rest is grouped exactly, so a sketch of few cells costs time but no window.
    remove_repeats states what null, repeated and empty input gives.
    """
    spec = Spec(length, gram, words=True, strict=True)
    return remove_repeats(docs, spec, lambda buckets: CountMin(cells or buckets * ANCHORS_A_BUCKET * CELLS_AN_ANCHOR)).withColumnRenamed("n_units", "n_words")
