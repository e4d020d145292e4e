"""Near-duplicate groups by the Jaccard similarity of word shingles: SimHash fingerprints by blocks, the rest by shared prefixes, exact check.

Fingerprints of a few differing bits meet by pigeonhole blocks. Similar texts may differ in more bits than blocks can
join on: those meet by shared prefixes in one order of all shingles. Each pair is checked on its texts, so nothing depends
on chance. Document ids may be long or binary.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import BROADCAST_KEYS, cut, id_type, texts
from .components import connected_components
from .simhash import _LOWER, _distance, _masks, majority

#: Words of a shingle, and the similarity from which two texts link.
SIZE, SIMILARITY = 5, 0.8
#: Differing bits up to which fingerprints meet by blocks. Pairs of more bits meet by prefixes.
DISTANCE = 6
#: Unlike texts that agree on a choice of blocks, about, at most; with more texts more blocks must agree.
CHANCE = 256
#: Common shingles that two texts of that many must have in their prefixes; a prefix is that much longer.
SHARED = 8
#: Distinct texts, about, whose shingles tell which are common, and most shingles so listed. They only order: no result depends on them.
SAMPLE, MOST_COMMON = 5000, 100_000
#: Texts of a bucket up to which all its pairs are looked at; a larger one first links to its first text.
SMALL = 8


def shingles(text: bytes, size: int = SIZE) -> set[bytes]:
    """The distinct shingles of size words: A-Z lower-cased, split at ASCII white space. Fewer words make one shingle, none makes none."""
    words = text.translate(_LOWER).split()
    if len(words) <= size:
        return {b" ".join(words)} if words else set()
    return set(map(b" ".join, zip(*(words[k:] for k in range(size)))))


def alike(a: set[bytes], b: set[bytes], similarity: float = SIMILARITY) -> bool:
    shared = len(a & b)
    return shared >= similarity * (len(a) + len(b) - shared) - 1e-9


def _hashes(text: str, size: int) -> np.ndarray:
    found = shingles(text.encode(), size)
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, found), "<u8", len(found)).view("<i8"))


def _common(rows: DataFrame, size: int) -> np.ndarray:
    """Hashes of shingles that several texts of a sample hold, the most frequent last."""
    n = rows.count()
    if n > SAMPLE:
        rows = rows.where(F.xxhash64("text") < int(-(1 << 63) + (1 << 64) * (SAMPLE / n)))

    def run(batches):
        for batch in batches:
            for t in batch.column("text"):
                yield pa.RecordBatch.from_arrays([pa.array(_hashes(t.as_py(), size))], names=["h"])

    found = rows.select("text").distinct().mapInArrow(run, "h long").groupBy("h").count().where("count > 1")
    return np.array([r["h"] for r in found.orderBy(F.desc("count"), "h").limit(MOST_COMMON).collect()][::-1], np.int64)


def _prints(rows: DataFrame, size: int, similarity: float) -> DataFrame:
    """rows(doc_id, text) -> (doc_id, content, n, rare, fp, prefix), a row for every row.

    content is the hash of the words, n the number of distinct shingles, fp their SimHash fingerprint. prefix is the first of them, rare ones first, of
    which there are rare: texts that share at least similarity * n of theirs have their first SHARED common shingles in
    both prefixes. A content's fp and prefix are given once a task, else null.
    """
    late = _common(rows, size)
    by_hash = np.argsort(late)
    known = late[by_hash]
    kind = id_type(rows)

    def run(batches):
        seen = set()
        for batch in batches:
            contents, sizes, rares, prints, prefixes = [], [], [], [], []
            for t in batch.column("text"):
                text = t.as_py()
                found = _hashes(text, size)
                content = xxhash.xxh64_intdigest(b" ".join(text.encode().translate(_LOWER).split()))
                at = np.minimum(np.searchsorted(known, found), max(len(known) - 1, 0))
                common = known[at] == found if len(known) else np.zeros(len(found), bool)
                order = np.concatenate([found[~common], late[np.sort(by_hash[at[common]])]]) if len(known) else found
                contents.append(content - (1 << 64) if content >> 63 else content)
                sizes.append(len(found))
                rares.append(len(found) - int(common.sum()))
                prints.append(None if content in seen else majority(found.view("<u8")))
                prefixes.append(None if content in seen else order[: len(found) - math.ceil(similarity * len(found) - 1e-9) + SHARED])
                seen.add(content)
            columns = [batch.column("doc_id"), pa.array(contents, pa.int64()), pa.array(sizes, pa.int32()), pa.array(rares, pa.int32()), pa.array(prints, pa.int64()), pa.array(prefixes, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "content", "n", "rare", "fp", "prefix"])

    return rows.mapInArrow(run, f"doc_id {kind}, content long, n int, rare int, fp long, prefix array<long>")


def _alike_sizes(na: Column, pa_: Column, nb: Column, pb: Column, similarity: float) -> Column:
    """Whether two texts may reach the similarity, by their sizes and by what can follow a shingle shared at these places."""
    most = F.least(na - pa_, nb - pb) + SHARED - 1
    needed = similarity / (1 + similarity) * (na + nb) - 1e-6
    return (na >= similarity * nb - 1e-6) & (nb >= similarity * na - 1e-6) & (most >= needed)


def _buckets(prints: DataFrame) -> DataFrame:
    """prints -> (key, content, n, at, first, size) for each prefix shingle that several texts have; first is the bucket's first text.

    Rare shingles are exchanged once. Common ones, which a third of all texts may hold, aren't: their first texts, at
    most MOST_COMMON, are aggregated where they are and sent to them.
    """
    keys = prints.where(F.col("prefix").isNotNull()).select("content", "n", "rare", F.posexplode("prefix").alias("at", "key"))
    first, last, size = F.min(F.struct("content", "n", "at")), F.max("content"), F.count("*")
    whole = Window.partitionBy("key")
    rare = keys.where("at < rare").select("key", "content", "n", "at").repartition("key")
    rare = rare.select("*", first.over(whole).alias("first"), last.over(whole).alias("last"), size.over(whole).alias("size"))
    often = keys.where("at >= rare").select("key", "content", "n", "at")
    often = often.join(F.broadcast(often.groupBy("key").agg(first.alias("first"), last.alias("last"), size.alias("size"))), "key")
    return cut(rare.unionByName(often.select(rare.columns)).where("first.content < last").drop("last"))


def _stars(buckets: DataFrame, small: int, similarity: float) -> DataFrame:
    """(a, b): in each bucket of over small texts the first one with each other one: one pair a text."""
    met = buckets.where((F.col("size") > small) & (F.col("content") != F.col("first.content")))
    met = met.where(_alike_sizes(F.col("n"), F.col("at"), F.col("first.n"), F.col("first.at"), similarity))
    return met.select(F.col("first.content").alias("a"), F.col("content").alias("b")).distinct()


def _blocks(n: int, distance: int) -> int:
    """Blocks of a fingerprint: so many that on those that must agree few of n unlike texts do."""
    agreeing = 2
    while n > CHANCE << 64 * agreeing // (distance + agreeing):
        agreeing += 1
    return distance + agreeing


def _near(contents: DataFrame, labels: DataFrame, distance: int, blocks: int) -> DataFrame:
    """contents(content, fp) -> (a, b): all pairs a < b of texts not linked yet whose fingerprints differ in at most distance bits.

    They agree on blocks - distance blocks and meet in the bucket of that choice, as in _between: a bucket of one group
    gives none.
    """
    named = contents.join(labels.withColumnRenamed("node", "content"), "content", "left").select("content", "fp", F.coalesce("root", "content").alias("group"))
    choices = F.array(*(F.xxhash64(F.lit(k), F.col("fp").bitwiseAND(F.lit(m))) for k, m in enumerate(_masks(blocks, distance))))
    keys = named.select(F.explode(choices).alias("key"), "content", "fp", "group").repartition("key")
    whole = Window.partitionBy("key")
    mixed = keys.select("*", F.min("group").over(whole).alias("main"), F.max("group").over(whole).alias("last")).where("main < last")
    left = mixed.where("group <> main").select("key", F.col("content").alias("x"), F.col("fp").alias("fx"), F.col("group").alias("gx"))
    right = mixed.select("key", F.col("content").alias("y"), F.col("fp").alias("fy"), F.col("group").alias("gy"), "main")
    met = left.join(right, "key").where((F.col("gx") != F.col("gy")) & ((F.col("gy") == F.col("main")) | (F.col("x") < F.col("y"))))
    met = met.where(_distance(F.col("fx"), F.col("fy")) <= distance)
    return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _far(pairs: DataFrame, contents: DataFrame, distance: int) -> DataFrame:
    """The pairs(a, b) whose fingerprints differ in more than distance bits; _near has the others."""
    a, b = (contents.select(F.col("content").alias(n), F.col("fp").alias(f"f{n}")) for n in ("a", "b"))
    return pairs.join(a, "a").join(b, "b").where(_distance(F.col("fa"), F.col("fb")) > distance).select("a", "b")


def _between(buckets: DataFrame, labels: DataFrame, similarity: float) -> DataFrame:
    """(a, b): pairs a < b of texts not linked yet that may reach the similarity: their prefixes share enough shingles.

    In a bucket those outside the first text's group meet the others. A bucket of one group gives none, so a cluster
    of copies costs nothing here whatever its size.
    """
    named = buckets.join(labels.withColumnRenamed("node", "content"), "content", "left").withColumn("group", F.coalesce("root", "content")).drop("root", "size", "first")
    main = named.groupBy("key").agg(F.min("group").alias("main"), F.max("group").alias("last")).where("main < last").drop("last")
    mixed = cut(named.join(main, "key"))
    left = mixed.where("group <> main").select("key", F.col("content").alias("x"), F.col("n").alias("nx"), F.col("group").alias("gx"))
    right = mixed.select("key", F.col("content").alias("y"), F.col("n").alias("ny"), F.col("group").alias("gy"), "main")
    met = left.join(right, "key").where((F.col("gx") != F.col("gy")) & ((F.col("gy") == F.col("main")) | (F.col("x") < F.col("y"))))
    met = met.where((F.col("nx") >= similarity * F.col("ny") - 1e-6) & (F.col("ny") >= similarity * F.col("nx") - 1e-6))
    # all they share lies in both prefixes but for what follows the prefix that ends first
    after = F.greatest(F.lit(0), F.ceil(similarity * F.greatest("nx", "ny") - 1e-9) - SHARED)
    enough = similarity / (1 + similarity) * (F.col("nx") + F.col("ny")) - 1e-6 - after
    met = met.select("key", "x", "y", "nx", "ny").distinct()  # a content's keys come once a task
    counted = met.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.count("*").alias("shared"), F.first(enough).alias("enough"))
    return counted.where("shared >= enough").select("a", "b")


def _verified(candidates: DataFrame, rows: DataFrame, prints: DataFrame, size: int, similarity: float) -> DataFrame:
    """The pairs of candidates(a, b) whose shingle sets reach the similarity, each checked on its texts."""
    pairs = cut(candidates)
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("content")).distinct()
    holders = cut(prints.select("content", "doc_id").join(wanted, "content", "left_semi").groupBy("content").agg(F.min("doc_id").alias("doc_id")))
    few = holders.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS  # then only texts of candidates move
    found = rows.join(F.broadcast(holders) if few else holders, "doc_id").select("content", "text").dropDuplicates(["content"])
    found = cut(found.select("content", "text"))

    def run(batches):
        for batch in batches:
            keep = [alike(shingles(x.as_py().encode(), size), shingles(y.as_py().encode(), size), similarity) for x, y in zip(batch.column("x"), batch.column("y"))]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    both = pairs.join(found.select(F.col("content").alias("a"), F.col("text").alias("x")), "a").join(found.select(F.col("content").alias("b"), F.col("text").alias("y")), "b")
    return cut(both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long"))


def links(rows: DataFrame, prints: DataFrame, size: int = SIZE, similarity: float = SIMILARITY, small: int = SMALL, distance: int = DISTANCE) -> DataFrame:
    """(a, b): pairs of contents whose shingle sets reach the similarity, enough that each group of linked ones is connected.

    First crowded buckets link to their first text; then only pairs between different groups are looked at, all of them:
    those within distance bits by their fingerprints' blocks, the others by their prefixes.
    """
    contents = cut(prints.where(F.col("prefix").isNotNull() & (F.col("n") > 0)).select("content", "fp").distinct())
    buckets = _buckets(prints)
    stars = _verified(_stars(buckets, small, similarity), rows, prints, size, similarity)
    labels = connected_components(stars)
    near = _near(contents, labels, distance, _blocks(contents.count(), distance))
    far = _far(_between(buckets, labels, similarity), contents, distance)
    return stars.unionByName(_verified(near.unionByName(far), rows, prints, size, similarity))


def near_duplicates(docs: DataFrame, size: int = SIZE, similarity: float = SIMILARITY) -> DataFrame:
    """docs(doc_id, text, ...) -> (doc_id, component_id), a row for every row of docs; doc_id isn't null.

    Texts of the same words meet as one content. component_id is the smallest doc_id that links reach, the document's
    own included. Texts without a word are one content that links to no other. Repeated rows stay repeated; an empty
    table gives an empty result.
    """
    rows = texts(docs)
    prints = cut(_prints(rows, size, similarity))
    groups = cut(prints.groupBy("content").agg(F.min("doc_id").alias("least")))
    roots = connected_components(links(rows, prints, size, similarity))
    linked = groups.join(roots.withColumnRenamed("node", "content"), "content")
    least = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    reached = roots.join(least, "root").select(F.col("node").alias("content"), "component_id")
    ids = groups.join(reached, "content", "left").select("content", F.coalesce("component_id", "least").alias("component_id"))
    return prints.select("doc_id", "content").join(ids, "content").select("doc_id", "component_id")
