import hashlib
import zlib

import numpy as np
import pytest

from codeloom.llm import media


@pytest.mark.parametrize("text", [b"", b"a", b"x" * 192, bytes(range(256)) * 9, b"\xff\x00" * 300])
def test_round_trip(text):
    kept = media.store(text)
    usec, frames = media.read_avi(kept.media)
    assert usec == 40_000 and kept.payload_bytes == 192 * max(1, -(-len(text) // 192))
    decoded = media.decode_frames(frames)
    assert decoded.tobytes() == text + b" " * (kept.payload_bytes - len(text))
    general = np.stack([media._blocks_of_any(*media._scan_of(f)) for f in frames])
    assert (general == decoded).all()


def test_broken_containers():
    good = media.store(b"abc").media
    with pytest.raises(ValueError):
        media.read_avi(b"RIFF....WAVE")
    with pytest.raises(ValueError):
        media.read_avi(good[:12])
    at = good.index(b"idx1") + 8
    with pytest.raises(ValueError):
        media.read_avi(good[: at + 8] + b"\xff\xff\x00\x00" + good[at + 12 :])


def test_shots_follow_the_picture():
    rng = np.random.default_rng(0)
    scene = lambda lo: rng.integers(lo, lo + 30, (20, 192)).astype(np.uint8)
    assert media.shots(np.concatenate([scene(0), scene(100), scene(200)])) == [0, 20, 40]
    assert media.shots(np.zeros((0, 192), np.uint8)) == []


def test_features_and_clips(messy, rows, nothing):
    got = {(r["doc_id"], r["n_bytes"]): r for r in media.media_features(messy).collect()}
    for d, t in rows:
        text = (t or "").encode()
        r = got[d, len(text)]
        payload = text + b" " * (-len(text) % 192 if text else 192)
        assert (r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert r["media_sha256"] == hashlib.sha256(media.store(text).media).hexdigest()
    stored = media.store_texts(messy)
    cut = media.clips(stored).where("doc_id = 7").orderBy("clip").collect()
    assert cut[0]["start_ms"] == 0 and all(a["end_frame"] == b["start_frame"] for a, b in zip(cut, cut[1:]))
    assert media.media_features(nothing).collect() == [] == media.clips(media.store_texts(nothing)).collect()
