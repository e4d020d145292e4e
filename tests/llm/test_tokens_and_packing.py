import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest

from codeloom.llm import packing, token_counts
from codeloom.llm.common import fresh_path
from codeloom.llm.tokenizers import ByteBPE, PieceCounter

PIECES, BYTES = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_50k.json")
ODD = [" ", "  ", "\n", " \n", "\t", "\xa0", " ", "\x85", "\x1c", "a", "The", "n't", "é", "漢字", "😀", "123", "<|endoftext|>", "<s>", "▁", "!!", "‍", "\x00", "x" * 70, "<0x0A>", "﻿"]


@pytest.fixture(scope="module")
def both():
    return ByteBPE(BYTES), PieceCounter(PIECES)


def test_fast_paths_equal_the_libraries(both):
    bytes_, pieces = both
    rng = random.Random(2)
    for _ in range(3000):
        text = "".join(rng.choice(ODD) + rng.choice(["", "", " "]) for _ in range(rng.randint(0, 14)))
        assert np.frombuffer(bytes_.encode(text), "<u4").tolist() == bytes_.library.encode(text, add_special_tokens=False).ids
        assert pieces.count(text) == len(pieces.library.encode(text))


def test_a_full_memo_changes_nothing(both, monkeypatch):
    from codeloom.llm import tokenizers

    monkeypatch.setattr(tokenizers, "MEMO", 3)
    for text in ("a b c d e f g h", "h g f e d c b a a b"):
        assert both[1].count(text) == len(both[1].library.encode(text))
        assert len(both[0].encode(text)) // 4 == len(both[0].library.encode(text, add_special_tokens=False).ids)


def test_counts_and_cache(spark, messy, rows, both):
    path = fresh_path(spark, "cache")
    for _ in range(2):  # the second time everything is in the cache
        got = sorted(((r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in token_counts.count_tokens(messy, PIECES, path, limit=100).collect()), key=str)
        want = sorted(((d, len((t or "").encode()), n := both[1].whole(t or ""), n > 100) for d, t in rows), key=str)
        assert got == want
        assert spark.read.parquet(path).count() == len({t or "" for _, t in rows})
    more = spark.createDataFrame([(99, "something new"), (98, "one")], "doc_id long, text string")
    assert token_counts.count_tokens(more, PIECES, path).count() == 2
    assert spark.read.parquet(path).count() == len({t or "" for _, t in rows}) + 1


def test_many_misses_are_exchanged(spark, messy, rows, both, monkeypatch):
    monkeypatch.setattr(token_counts, "BROADCAST_DIGESTS", 0)
    path = fresh_path(spark, "cache")
    got = sorted(((r["doc_id"], r["n_tokens"]) for r in token_counts.count_tokens(messy, PIECES, path).collect()), key=str)
    assert got == sorted(((d, both[1].whole(t or "")) for d, t in rows), key=str)
    assert spark.read.parquet(path).count() == len({t or "" for _, t in rows})


def test_empty_counts(spark, nothing):
    assert token_counts.count_tokens(nothing, PIECES, fresh_path(spark, "cache")).collect() == []


def whole(pieces, limits):
    used = defaultdict(list)
    for s, sequence in enumerate(pieces):
        assert sum(n for *_, n in sequence) <= limits.tokens and len(sequence) <= limits.segments
        for item, start, n in sequence:
            used[item].append((start, n))
    return used


@pytest.mark.parametrize("limits", [packing.Limits(64, 100, 64), packing.Limits(64, 3, 64), packing.Limits(64, 5, 20)])
def test_vector_packing_keeps_limits_and_tokens(limits):
    rng = random.Random(limits.segments)
    items = [(rng.randint(0, 9), rng.randint(1, 63)) for _ in range(200)]
    prompts = [rng.choice([0, 0, 10, 50]) for _ in items]
    out = packing.pack(items, prompts, limits)
    used = whole(out, limits)
    for k, (start, n) in enumerate(items):
        at = start
        for s, length in sorted(used[k]):
            assert s == at
            at += length
        assert at == start + n
    for sequence in out:
        assert sum(packing._loss(s, n, prompts[i]) for i, s, n in sequence) <= limits.loss
    if limits.segments == 100:
        assert len(out) <= sum(n for _, n in items) / 64 + 1


def test_packed_documents(messy, rows, both):
    got = packing.pack_documents(messy, BYTES, packing.Limits(tokens=256)).collect()
    want = sorted(len(both[0].encode(t or "")) // 4 + 1 for _, t in rows)
    sequences = defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append(r)
    for pieces in sequences.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= 256
    assert sum(r["length"] for r in got) == sum(want)
    texts = dict(rows)
    for doc in (7, 8, 12, 10):
        ids = both[0].encode(texts[doc]) + bytes(4)
        at = 0
        for p in sorted((r for r in got if r["doc_id"] == doc), key=lambda p: p["start"]):
            assert (p["start"], p["doc_tokens"]) == (at, len(ids) // 4) and p["ids_crc32"] == zlib.crc32(ids[4 * at : 4 * (at + p["length"])])
            at += p["length"]
        assert at == len(ids) // 4


def test_prompts_bear_no_loss(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g h", 3), (2, "x y z", None)], "doc_id long, text string, prompt long")
    got = {r["doc_id"]: r["loss_tokens"] for r in packing.pack_documents(docs, BYTES, prompt_tokens="prompt").collect()}
    assert got == {1: 9 - 3, 2: 4}


def test_empty_packing(nothing):
    assert packing.pack_documents(nothing, BYTES).collect() == []
