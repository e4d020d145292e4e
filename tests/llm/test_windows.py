import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
import zstandard

from codeloom.llm import substring_dedup, suffix_dedup, windows
from codeloom.llm.windows import Spec


def brute(docs, spec):
    """docs of (order, doc_id, text) -> {order: (units, removed, spans, sha256)}"""
    parts = [(o, d, t.encode().split() if spec.words else t.encode()) for o, d, t in sorted(docs)]
    first, size, out = {}, spec.window, {}
    for o, d, u in parts:
        for p in range(len(u) - size + 1):
            first.setdefault(tuple(u[p : p + size]), (o, p, d))
    for o, d, u in parts:
        cover = bytearray(len(u))
        for p in range(len(u) - size + 1):
            fo, fp, fd = first[tuple(u[p : p + size])]
            if fd < d if spec.strict else (fo, fp) != (o, p):
                cover[p : p + size] = b"\1" * size
        kept = [x for x, c in zip(u, cover) if not c]
        rest = b" ".join(kept) if spec.words else bytes(kept)
        spans = sum(1 for k in range(len(u)) if cover[k] and not (k and cover[k - 1]))
        out[o] = (len(u), sum(cover), spans, hashlib.sha256(rest).hexdigest())
    return out


def by_hand(spec, docs, hot, buckets=3):
    """The stages on plain tables, all anchors taken as repeated, those of hot as shared by many."""
    pack, held = zstandard.ZstdCompressor(), [[] for _ in range(buckets)]
    for doc, text in docs:
        digest = hashlib.sha256(text.encode()).digest()
        held[int.from_bytes(digest[:4], "big") * buckets >> 32].append((digest, doc, pack.compress(text.encode())))
    tables = [pa.table({"bucket": pa.array([k] * len(h), pa.int32()), "digest": pa.array([x[0] for x in h], pa.binary()), "doc_id": pa.array([x[1] for x in h], pa.int64()), "packed": pa.array([x[2] for x in h], pa.binary())}) for k, h in enumerate(held)]
    made = [windows._bucket(t) for t in tables]
    hashes = np.unique(np.concatenate([windows.anchors(s, e, spec)[3] for b in made for _, s, _, e, _ in windows._parts(b, spec)]))
    heavy = hashes[:: hot] if hot else hashes[:0]
    light = np.setdiff1d(hashes, heavy)
    sent = pa.concat_tables([windows._contexts(k, b, spec, light, heavy, 4) for k, b in enumerate(made)])
    runs = [windows._find_runs(sent.filter(pa.compute.equal(sent["range"], r)), spec) for r in range(4)]
    out = {}
    for k, b in enumerate(made):
        own = [np.frombuffer(p, windows._RUN) for t in runs for bucket, p in zip(t["bucket"].to_pylist(), t["packed"].to_pylist()) if bucket == k]
        for row in windows._removed(b, np.concatenate([np.zeros(0, windows._RUN), *own]), spec).to_pylist():
            out[row["first_id"]] = (row["n_units"], row["n_removed"], row["n_spans"], row["kept_sha256"])
    return out


@pytest.mark.parametrize("words", [False, True])
@pytest.mark.parametrize("hot", [0, 1, 2])
def test_stages_equal_brute_force(words, hot):
    rng = random.Random(hot)
    spec = Spec(10, 4, words, strict=words)
    alphabet = ["a", "b", "ab "] if not words else ["a ", "b "]
    piece = lambda n: "".join(rng.choice(alphabet) for _ in range(n))
    shared = [piece(30) for _ in range(4)]
    docs = {k: piece(rng.randint(0, 12)) + rng.choice(shared)[: rng.randint(8, 90)] + piece(rng.randint(0, 12)) for k in range(60)}
    docs = {k: t for k, t in docs.items() if list(docs.values()).index(t) == list(docs).index(k)}
    got = by_hand(spec, list(docs.items()), hot)
    assert got == brute([(k, k, t) for k, t in docs.items()], spec)


@pytest.mark.parametrize("words", [False, True])
def test_whole_operator(messy, rows, words):
    run = substring_dedup.remove_repeated_words if words else suffix_dedup.remove_repeated_bytes
    spec = Spec(50, 16, True, True) if words else Spec(100, 32, False, False)
    plain = {}
    for d, t in rows:
        t = t or ""
        order = (-1 if d is None else d, hashlib.sha256(t.encode()).digest())
        plain[order] = (order, -(2**63) if d is None else d, t)
    want = brute(list(plain.values()), spec)
    unit = "n_words" if words else "n_bytes"
    got = sorted((str(r["doc_id"]), r[unit], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in run(messy).collect())
    assert got == sorted((str(d), *want[(-1 if d is None else d, hashlib.sha256((t or "").encode()).digest())]) for d, t in rows)


@pytest.mark.parametrize("words", [False, True])
def test_long_texts_in_pieces(words, monkeypatch):
    monkeypatch.setattr(windows, "PIECE", 23)
    monkeypatch.setattr(windows, "PART", 40)
    rng = random.Random(7)
    spec = Spec(10, 4, words, strict=words)
    piece = lambda n: "".join(rng.choice(["a ", "b "] if words else "ab") for _ in range(n))
    passage = piece(70)
    docs = [(k, piece(rng.randint(0, 90)) + passage + piece(rng.randint(0, 90))) for k in range(8)]
    assert by_hand(spec, docs, 0) == by_hand(spec, docs, 2) == brute([(k, k, t) for k, t in docs], spec)


def test_orders_and_measures():
    rng = np.random.default_rng(3)
    for kind, sort in ((np.uint8, windows._suffix_order), (np.uint64, windows._suffix_order), (np.uint64, windows._row_order)):
        columns = rng.integers(0, 2, (300, 21)).astype(kind)
        group = rng.integers(0, 4, 300)
        order, shared = sort(columns, group)
        keys = [(group[k], columns[k].tolist()) for k in order]
        assert keys == sorted(keys)
        for (b0, c0), (b1, c1), n in zip(keys, keys[1:], shared[1:]):
            assert n == (0 if b0 != b1 else next((k for k in range(21) if c0[k] != c1[k]), 21))


def test_refinement_reads_updated_pointers():
    """Two rows that differ in their last gram alone: each earlier suffix can only tell them apart by its successor's new pointer."""
    columns = np.full((3, 40), 7, np.uint8)
    columns[1, 39] = 9
    pointer = windows._pointers(columns)
    assert pointer.shape == (3, 5)
    for step in range(5):
        assert pointer[0, step] == pointer[2, step] < pointer[1, step]
    rng = np.random.default_rng(5)
    columns = rng.integers(0, 2, (200, 33)).astype(np.uint8)
    pointer = windows._pointers(columns)
    for step in range(pointer.shape[1]):
        rests = [columns[k, 8 * step :].tobytes() for k in range(200)]
        assert [sorted(set(rests)).index(r) for r in rests] == pointer[:, step].tolist()


@pytest.mark.parametrize("bits", [4, 22])
def test_sketch_never_underestimates(spark, bits):
    sketch = substring_dedup.CountMin(1 << 12, bits)
    assert sketch.bits == max(12, bits)
    spec, rng, held = Spec(5, 2, True, True), random.Random(bits), []
    for k in range(9):
        text = " ".join(f"w{rng.randint(0, 300 if k else 10)}" for _ in range(400)).encode()
        held.append(windows.Bucket([bytes([k])], [k], [text]))
    counts, kept, single = {}, [], 0
    for b in held:
        for h, n in zip(*(a.tolist() for a in windows.anchor_counts(b, spec))):
            counts[h] = counts.get(h, 0) + n
    pack = zstandard.ZstdCompressor()
    frame = spark.createDataFrame([(k, b.digests[0], k, pack.compress(b.texts[0])) for k, b in enumerate(held)], "bucket int, digest binary, doc_id long, packed binary")
    masks = sketch.masks(frame, spec).toArrow()
    for k, b in enumerate(held):
        hashes = windows.anchor_counts(b, spec)[0]
        keep = sketch.keep(hashes, masks.filter(pa.compute.equal(masks["bucket"], k)))
        assert all(keep[n] for n, h in enumerate(hashes.tolist()) if counts[h] > 1)
        kept.append(keep.mean())
        single += sum(1 for n, h in enumerate(hashes.tolist()) if counts[h] == 1 and not keep[n])
    assert single > (0 if bits == 4 else 20)


def test_sketch_of_few_cells_loses_nothing(spark, messy):
    narrow = substring_dedup.remove_repeated_words(messy, cells=16).collect()
    assert sorted(map(str, narrow)) == sorted(map(str, substring_dedup.remove_repeated_words(messy).collect()))


def test_empty(nothing):
    assert suffix_dedup.remove_repeated_bytes(nothing).collect() == []
    assert substring_dedup.remove_repeated_words(nothing).collect() == []
