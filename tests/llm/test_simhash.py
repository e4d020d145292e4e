import random

import pytest
import xxhash

from codeloom.llm import simhash
from codeloom.llm.components import connected_components


def plain(text):
    words = (text or "").encode().translate(simhash._LOWER).split()
    shingles = [b" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def components(pairs, nodes):
    up = {n: n for n in nodes}

    def find(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_fingerprint_is_the_contract(rows):
    for _, text in rows:
        assert simhash.fingerprint((text or "").encode()) & (2**64 - 1) == plain(text)
    assert simhash.fingerprint(b"ONE Two") == simhash.fingerprint(b"one two")


def test_shingle_hash_is_sparks_xxhash64(spark):
    from pyspark.sql import functions as F

    for text in ("a b c", "", "é" * 50):
        got = spark.range(1).select(F.xxhash64(F.lit(text)).alias("h")).first()["h"]
        assert got & (2**64 - 1) == xxhash.xxh64_intdigest(text.encode(), 42)


def test_groups_equal_brute_force(messy, rows):
    got = simhash.near_duplicates(messy).collect()
    prints = [(d, plain(t)) for d, t in rows]
    assert sorted(((r["doc_id"] is None, r["doc_id"], r["fingerprint"]) for r in got), key=str) == sorted(((d is None, d, f"{p:016x}") for d, p in prints), key=str)
    distinct = sorted({p for _, p in prints})
    root = components([(a, b) for a in distinct for b in distinct if a < b and (a ^ b).bit_count() <= 2], distinct)
    for r in got:
        same = [d for d, p in prints if root[p] == root[int(r["fingerprint"], 16)] and d is not None]
        assert r["component_id"] == (min(same) if same else None)


@pytest.mark.parametrize("hot", [700, 3])
def test_links_lose_none_in_crowded_buckets(spark, hot):
    rng = random.Random(hot)
    base = [rng.getrandbits(64) for _ in range(6)]
    prints = sorted({b ^ sum(1 << rng.randrange(64) for _ in range(rng.randint(0, 3))) & (2**64 - 1) for b in base for _ in range(25)})
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    got = {(r["a"], r["b"]) for r in simhash.links(spark.createDataFrame([(s,) for s in signed], "fp long"), hot=hot).collect()}
    want = {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 2}
    assert got == want


def test_components_on_chains_stars_and_cliques(spark):
    rng = random.Random(1)
    chain = list(range(100, 160))
    rng.shuffle(chain)
    pairs = list(zip(chain, chain[1:])) + [(5, k) for k in range(10, 40)] + [(a, b) for a in range(50, 58) for b in range(50, 58)] + [(7, 7), (None, 3)]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    clean = [(a, b) for a, b in pairs if a is not None and a != b]
    assert got == components(clean, {n for p in clean for n in p})


def test_empty(nothing, spark):
    assert simhash.near_duplicates(nothing).collect() == []
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []
