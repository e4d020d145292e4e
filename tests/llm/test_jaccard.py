import random

import pytest

import corpus_pipeline
from codeloom.llm import jaccard

from .test_simhash import components


def grouped(rows):
    """component of each row by comparing all pairs."""
    sets = [jaccard.shingles((t or "").encode()) for _, t in rows]
    pairs = [(a, b) for a in range(len(rows)) for b in range(a) if jaccard.alike(sets[a], sets[b])]
    root = components(pairs, range(len(rows)))
    return sorted((d, min(e for k, (e, _) in enumerate(rows) if root[k] == root[n])) for n, (d, _) in enumerate(rows))


def near_copies():
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefg") for _ in range(5)) for _ in range(2000)]
    banner, rows = " ".join(rng.choice(words) for _ in range(12)), []
    for k in range(40):
        base = [rng.choice(words) for _ in range(rng.randint(30, 400))]
        rows.append((10 * k, f"{banner} {' '.join(base)}"))
        for j in range(1, 5):
            copy = list(base)
            for _ in range(rng.randint(1, max(1, len(base) * j // 60))):
                copy[rng.randrange(len(copy))] = "changed"
            rows.append((10 * k + j, f"{banner} {' '.join(copy)}"))
    return rows + [(901, ""), (902, None), (903, " \n"), (904, "one"), (905, "ONE"), (905, "ONE"), (906, "two words")]


def test_groups_equal_brute_force(spark):
    rows = near_copies()
    got = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    want = grouped(rows)
    assert sorted((r["doc_id"], r["component_id"]) for r in got) == want
    assert 60 < sum(d != c for d, c in want) < 160


def test_a_large_cluster_is_linked_by_stars(spark, monkeypatch):
    """Hundreds of different near copies: pairs that are looked at stay near one a text, and groups are whole."""
    rng = random.Random(11)
    base = [f"w{rng.randint(0, 5000)}" for _ in range(150)]
    rows = [(k, " ".join(base[:70] + [f"x{k}"] + base[71:])) for k in range(300)]
    rows += [(1000 + k, " ".join(base[:12] + [f"o{k}_{j}" for j in range(60)])) for k in range(40)]  # share a banner only
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    seen, plain = [], jaccard._verified

    def counted(candidates, *rest):
        seen.append(candidates.count())
        return plain(candidates, *rest)

    monkeypatch.setattr(jaccard, "_verified", counted)
    got = {r["doc_id"]: r["component_id"] for r in jaccard.near_duplicates(docs).collect()}
    assert {got[k] for k in range(300)} == {0} and all(got[1000 + k] == 1000 + k for k in range(40))
    assert len(seen) == 2 and sum(seen) < 3000


def test_groups_do_not_depend_on_the_stars(spark):
    docs = spark.createDataFrame(near_copies(), "doc_id long, text string").repartition(3)
    rows = jaccard.texts(docs)
    prints = jaccard.cut(jaccard._prints(rows, jaccard.SIZE, jaccard.SIMILARITY))
    for small in (1, 10**6):
        found = jaccard.links(rows, prints, small=small)
        roots = {r["node"]: r["root"] for r in jaccard.connected_components(found).collect()}
        groups = {}
        for r in prints.collect():
            groups.setdefault(roots.get(r["content"], r["content"]), []).append(r["doc_id"])
        want = {}
        for d, c in grouped(near_copies()):
            want.setdefault(c, []).append(d)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_empty(nothing):
    assert jaccard.near_duplicates(nothing).collect() == []


def test_stage_drops_near_copies(spark):
    rows = near_copies()
    want = {d for d, c in grouped(rows) if d == c}
    docs = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()} == want


@pytest.mark.parametrize("agreeing", [2, 3])
def test_near_fingerprints_meet_by_blocks(spark, agreeing):
    rng = random.Random(agreeing)
    base = [rng.getrandbits(64) for _ in range(8)]
    prints = [base[k % 8] ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 6))) for k in range(160)]
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    group = [k % 8 if k % 3 == 0 else k for k in range(160)]  # some are linked already, within a base
    contents = spark.createDataFrame(list(enumerate(signed)), "content long, fp long").repartition(3)
    labels = spark.createDataFrame([(k, g) for k, g in enumerate(group) if g != k], "node long, root long")
    got = [(r["a"], r["b"]) for r in jaccard._near(contents, labels, jaccard.DISTANCE, jaccard.DISTANCE + agreeing).collect()]
    want = {(a, b) for b in range(160) for a in range(b) if group[a] != group[b] and (prints[a] ^ prints[b]).bit_count() <= jaccard.DISTANCE}
    assert set(got) == want and len(got) == len(want) > 300


def test_more_texts_need_more_blocks():
    assert [jaccard._blocks(n, 6) for n in (0, 1 << 24, (1 << 24) + 1, 1 << 34)] == [8, 8, 9, 11]


def test_links_come_by_fingerprints_and_by_prefixes(spark, monkeypatch):
    """Pairs of few differing bits come by blocks alone, others by prefixes alone: each way links texts that the other doesn't."""
    rows = near_copies()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    whole, none = grouped(rows), lambda pairs, *_: spark.createDataFrame([], "a long, b long")

    def groups():
        return sorted((r["doc_id"], r["component_id"]) for r in jaccard.near_duplicates(docs).collect())

    assert groups() == whole
    for way in ("_near", "_far"):
        with monkeypatch.context() as m:
            m.setattr(jaccard, way, none)
            assert sum(d != c for d, c in groups()) < sum(d != c for d, c in whole)
