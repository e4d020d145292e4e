import random
import zlib

import pytest

from codeloom.llm import sharding


def check(got, shards, slack):
    sizes = [0] * shards
    slots = [[] for _ in range(shards)]
    for r in got:
        sizes[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots)
    mean = sum(sizes) / shards
    assert all(abs(s - mean) <= slack for s in sizes), sizes


def test_sizes_near_equal_and_slots_gapless(spark):
    rng = random.Random(6)
    docs = [(k, "z" * rng.randint(0, 400)) for k in range(600)] + [(1000 + k, "the same text") for k in range(400)] + [(None, None)] * 3
    got = sharding.histogram_shards(spark.createDataFrame(docs, "doc_id long, text string"), 7).collect()
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in got) == sorted((str(d), len(t or "") + 8, zlib.crc32((t or "").encode())) for d, t in docs)
    check(got, 7, 410)


def test_equal_texts_stay_together_where_they_fit(spark):
    docs = [(k, f"text {k % 200}") for k in range(2000)]
    got = sharding.histogram_shards(spark.createDataFrame(docs, "doc_id long, text string"), 4, tolerance=0.05).collect()
    home = {}
    for r in got:
        home.setdefault(r["h"], set()).add(r["shard"])
    assert sum(len(s) > 1 for s in home.values()) == 0


def test_hot_ranges_are_split(spark):
    rows = spark.createDataFrame([(7 if k % 3 == 0 else k * 2654435761 % 2**62, k, 10) for k in range(3000)], "h long, doc_id long, size long")
    got = sharding.shard_rows(rows, 5, rows_a_task=50).collect()
    assert len(got) == 3000
    check(got, 5, 40)


def test_shards_are_cuts_of_the_sorted_keys(spark):
    """Against sorting everything: shards follow the key's order, and each cut is the best one within the tolerance."""
    rng = random.Random(12)
    rows = [(rng.getrandbits(64) - 2**63, k, rng.randint(8, 60)) for k in range(1500)]
    got = sharding.shard_rows(spark.createDataFrame(rows, "h long, doc_id long, size long"), 6, tolerance=0.01).collect()
    ordered = sorted(got, key=lambda r: (r["h"] & (2**64 - 1), r["doc_id"]))
    shards = [r["shard"] for r in ordered]
    assert shards == sorted(shards)
    total = sum(r["size"] for r in ordered)
    for k in range(1, 6):
        cut = sum(r["size"] for r in ordered if r["shard"] < k)
        assert abs(cut - total * k // 6) <= max(0.01 * total / 6, 60)


def test_salts_follow_each_ranges_own_count(spark, monkeypatch):
    """Few ranges, all crowded: groups stay near one for rows_a_task rows, where a salt of all rows' number would give one a row."""
    rows = spark.createDataFrame([(k * 0x9E3779B97F4A7C15 % 2**64 - 2**63, k, 10) for k in range(8000)], "h long, doc_id long, size long")
    groups = []
    plain = sharding.Window.partitionBy

    def spy(*names):
        groups.append(names)
        return plain(*names)

    monkeypatch.setattr(sharding.Window, "partitionBy", spy)
    monkeypatch.setattr(sharding, "RANGE_BITS", 3)
    got = sharding.shard_rows(rows, 2, rows_a_task=100)
    assert groups[1] == ("shard", "range", "salt")
    check(got.collect(), 2, 40)
    ranges = {}
    for r in got.collect():
        ranges[r["h"] >> 61] = ranges.get(r["h"] >> 61, 0) + 1
    assert len(ranges) == 8 and sum(-(-n // 100) for n in ranges.values()) < 100


@pytest.mark.parametrize("n", [0, 1, 3])
def test_few_rows(spark, n):
    got = sharding.histogram_shards(spark.createDataFrame([(k, "t") for k in range(n)], "doc_id long, text string"), 24).collect()
    assert len(got) == n and all(0 <= r["shard"] < 24 for r in got)


def test_messy(messy, rows):
    got = sharding.histogram_shards(messy, 5).collect()
    assert sorted(r["size"] for r in got) == sorted(len((t or "").encode()) + 8 for _, t in rows)
