"""SimHash near-duplicate groups: pigeonhole blocks, join on blocks, verified Hamming distance."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from .common import cut, hex16, texts
from .components import connected_components

#: Differing bits up to which two fingerprints link.
DISTANCE = 2
#: A fingerprint is split into so many blocks; a pair within DISTANCE agrees on at least BLOCKS - DISTANCE of them.
BLOCKS = 5
#: Buckets with more fingerprints than this list the neighbours of each one instead of joining it with itself.
HOT_BUCKET = 700
SEED = 42
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def fingerprint(text: bytes, size: int = 3, seed: int = SEED) -> int:
    """The 64-bit SimHash of text as a signed long: a bit is set if it is set in over half the shingles' hashes.

    A-Z are lower-cased, words are split at ASCII white space, shingles of size words count as often as
    they occur; fewer words than size make one shingle, none makes fingerprint zero.
    """
    words = text.translate(_LOWER).split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) <= size:
        hashes = np.array([digest(b" ".join(words), seed)], "<u8")
    else:
        shingles = map(b" ".join, zip(*(words[k:] for k in range(size))))
        hashes = np.array([digest(s, seed) for s in shingles], "<u8")
    return majority(hashes)


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the unsigned hashes, as a signed long; of no hashes zero."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):
        part = hashes[at : at + 65536]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, fp long), a row for every row. A null or empty text has fingerprint 0."""

    def run(batches):
        for batch in batches:
            found = [fingerprint(t.as_py().encode()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.int64())], names=["doc_id", "fp"])

    return texts(docs).mapInArrow(run, "doc_id long, fp long")


def _bits(lo: int, hi: int) -> int:
    value = ((1 << hi) - 1) ^ ((1 << lo) - 1)
    return value - (1 << 64) if value >> 63 else value


def _masks(blocks: int, distance: int) -> list[int]:
    """A mask for each choice of blocks - distance blocks that may agree."""
    edges = [64 * k // blocks for k in range(blocks + 1)]
    whole = [_bits(edges[k], edges[k + 1]) & (2**64 - 1) for k in range(blocks)]
    masks = [sum(whole[k] for k in chosen) for chosen in combinations(range(blocks), blocks - distance)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _flips(mask: int, distance: int) -> list[int]:
    """All changes of up to distance bits outside mask, none excluded."""
    free = [k for k in range(64) if not (mask >> k) & 1]
    out = []
    for n in range(1, distance + 1):
        for chosen in combinations(free, n):
            v = sum(1 << k for k in chosen)
            out.append(v - (1 << 64) if v >> 63 else v)
    return out


def _distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def links(distinct: DataFrame, distance: int = DISTANCE, blocks: int = BLOCKS, hot: int = HOT_BUCKET) -> DataFrame:
    """distinct(fp) -> (a, b): all pairs a < b of fingerprints with at most distance differing bits.

    Pairs meet in a bucket of each choice of agreeing blocks. A bucket of more than hot fingerprints is not
    joined with itself: there each fingerprint lists its neighbours that differ outside the agreeing blocks,
    a fixed number whatever the bucket holds, and looks them up by equality.
    """
    masks = _masks(blocks, distance)
    keyed = F.explode(F.array(*(F.struct(F.lit(k).alias("block"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for k, m in enumerate(masks))))
    keys = distinct.select("fp", keyed.alias("k")).select("fp", "k.block", "k.key")
    crowded = keys.groupBy("block", "key").count().where(F.col("count") > hot).select("block", "key")
    crowded = cut(crowded)
    pairs = None
    if crowded.isEmpty():
        light = keys
    else:
        light = keys.join(crowded, ["block", "key"], "left_anti")
        heavy = keys.join(crowded, ["block", "key"], "left_semi")
        for k, mask in enumerate(masks):
            flips = F.array(*(F.lit(v) for v in _flips(mask, distance)))
            near = heavy.where(F.col("block") == k).select(F.col("fp").alias("a"), F.explode(flips).alias("x"))
            near = near.select("a", F.col("a").bitwiseXOR(F.col("x")).alias("b")).where("a < b")
            found = near.join(distinct.select(F.col("fp").alias("b")), "b").select("a", "b")
            pairs = found if pairs is None else pairs.unionByName(found)
    other = light.select(F.col("fp").alias("b"), "block", "key")
    met = light.withColumnRenamed("fp", "a").join(other, ["block", "key"]).where(F.col("a") < F.col("b")).where(_distance(F.col("a"), F.col("b")) <= distance).select("a", "b")
    return (met if pairs is None else pairs.unionByName(met)).distinct()


def near_duplicates(docs: DataFrame, distance: int = DISTANCE, blocks: int = BLOCKS) -> DataFrame:
    """docs(doc_id, text, ...) -> (doc_id, fp, fingerprint, component_id), a row for every row of docs.

    Copies meet as one fingerprint and are never expanded into pairs. component_id is the smallest doc_id
    that links reach, the document's own included. Null or empty texts have fingerprint zero and link like
    any other; rows with a null doc_id stay and take part, but give no component_id (null if the component
    has no other). Repeated rows stay repeated; an empty table gives an empty result.
    """
    prints = cut(fingerprints(docs))
    groups = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = connected_components(links(groups.select("fp"), distance, blocks))
    linked = groups.join(roots.withColumnRenamed("node", "fp"), "fp")
    least = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    reached = roots.join(least, "root").select(F.col("node").alias("fp"), "component_id")
    ids = groups.join(reached, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"))
    return prints.join(ids, "fp").select("doc_id", "fp", hex16(F.col("fp")).alias("fingerprint"), "component_id")
