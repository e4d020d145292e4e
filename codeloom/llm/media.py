"""Media columns: AVI motion-JPEG written and read without loss, with shots cut by adaptive histogram differences.

A sample is the brightness of one 8x8 block, so a frame of 16 x 12 blocks holds 192 samples. Blocks are flat
(a DC coefficient with quantiser 8 and no AC), which a baseline decoder returns as the sample in all 64 pixels.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import texts

WIDE, HIGH = 16, 12
SAMPLES = WIDE * HIGH
FPS = 25
#: A cut needs a histogram difference over the mean of the last WINDOW ones plus DEVIATIONS of their deviations.
WINDOW, DEVIATIONS, LEAST, BINS = 12, 2.5, 0.35, 16


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _dht(kind: int, lengths: dict[int, list[int]]) -> bytes:
    return bytes([kind]) + bytes(len(lengths.get(n, [])) for n in range(1, 17)) + bytes(v for n in range(1, 17) for v in lengths.get(n, []))


#: A DC difference of category c takes a code of 9 - c bits and c bits, always 9; the end of a block takes 1.
_DC = _dht(0x00, {9 - c: [c] for c in range(9)})
_AC = _dht(0x10, {1: [0x00]})
_HEAD = (
    b"\xff\xd8"
    + _segment(0xDB, b"\x00" + bytes([8] * 64))
    + _segment(0xC0, struct.pack(">BHHB", 8, HIGH * 8, WIDE * 8, 1) + b"\x01\x11\x00")
    + _segment(0xC4, _DC)
    + _segment(0xC4, _AC)
    + _segment(0xDA, b"\x01\x01\x00\x00\x3f\x00")
)
_TAIL = b"\xff\xd9"


def _words() -> tuple[np.ndarray, np.ndarray]:
    """The 9-bit word of each difference + 255, and back."""
    to, back = np.zeros(511, np.uint64), np.zeros(512, np.int16)
    for d in range(-255, 256):
        c = abs(d).bit_length()
        prefix = ((1 << (8 - c)) - 1) << 1
        word = prefix << c | (d if d >= 0 else d + (1 << c) - 1)
        to[d + 255], back[word] = word, d
    return to, back


_TO, _BACK = _words()


def encode_frames(samples: np.ndarray) -> list[bytes]:
    """uint8 samples, a multiple of SAMPLES, as one JPEG for each frame."""
    frames = samples.reshape(-1, SAMPLES).astype(np.int16)
    codes = (_TO[np.diff(frames, axis=1, prepend=np.int16(128)) + 255] << np.uint64(1)).reshape(-1, 4)
    packed = codes[:, 0] << np.uint64(30) | codes[:, 1] << np.uint64(20) | codes[:, 2] << np.uint64(10) | codes[:, 3]
    scans = np.ascontiguousarray(packed.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 3:]).tobytes()
    step = SAMPLES * 10 // 8
    return [_HEAD + scans[k : k + step].replace(b"\xff", b"\xff\x00") + _TAIL for k in range(0, len(scans), step)]


def write_avi(frames: list[bytes]) -> bytes:
    """Frames as an AVI with one motion-JPEG stream and an index."""
    chunks, index, at = [], [], 4
    for frame in frames:
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(frame)))
        body = struct.pack("<4sI", b"00dc", len(frame)) + frame + b"\0" * (len(frame) & 1)
        chunks.append(body)
        at += len(body)
    largest = max(map(len, frames), default=0)
    avih = struct.pack("<14I", 1_000_000 // FPS, 0, 0, 0x10, len(frames), 0, 1, largest, WIDE * 8, HIGH * 8, 0, 0, 0, 0)
    strh = struct.pack("<4s4sIHHIIIIIIII4H", b"vids", b"MJPG", 0, 0, 0, 0, 1, FPS, 0, len(frames), largest, 0, 0, 0, 0, WIDE * 8, HIGH * 8)
    strf = struct.pack("<IiiHH4sIiiII", 40, WIDE * 8, HIGH * 8, 1, 24, b"MJPG", WIDE * HIGH * 64 * 3, 0, 0, 0, 0)
    riff = lambda kind, body: struct.pack("<4sI", kind, len(body)) + body
    strl = riff(b"LIST", b"strl" + riff(b"strh", strh) + riff(b"strf", strf))
    hdrl = riff(b"LIST", b"hdrl" + riff(b"avih", avih) + strl)
    return riff(b"RIFF", b"AVI " + hdrl + riff(b"LIST", b"movi" + b"".join(chunks)) + riff(b"idx1", b"".join(index)))


def read_avi(media: bytes) -> tuple[int, list[bytes]]:
    """(microseconds a frame, the frames in the index's order); a broken container raises ValueError."""
    if len(media) < 12 or media[:4] != b"RIFF" or media[8:12] != b"AVI ":
        raise ValueError("not an AVI")
    pos, end, usec, movi, index = 12, min(len(media), 8 + struct.unpack_from("<I", media, 4)[0]), 0, 0, b""
    while pos + 8 <= end:
        kind, size = struct.unpack_from("<4sI", media, pos)
        if kind == b"LIST" and media[pos + 8 : pos + 12] == b"movi":
            movi = pos + 8
        elif kind == b"LIST" and media[pos + 8 : pos + 12] == b"hdrl" and media[pos + 12 : pos + 16] == b"avih":
            usec = struct.unpack_from("<I", media, pos + 20)[0]
        elif kind == b"idx1":
            index = media[pos + 8 : pos + 8 + size]
        pos += 8 + size + (size & 1)
    if not movi or len(index) % 16:
        raise ValueError("no movi list, or a broken index")
    frames = []
    for kind, flags, at, size in struct.iter_unpack("<4sIII", index):
        if kind[2:] not in (b"dc", b"db"):
            continue
        if not flags & 0x10:
            raise ValueError("not an intra frame")
        if movi + at + 8 + size > len(media) or struct.unpack_from("<4sI", media, movi + at) != (kind, size):
            raise ValueError("index and movi list differ")
        frames.append(media[movi + at + 8 : movi + at + 8 + size])
    return usec, frames


def _scan_of(frame: bytes) -> tuple[int, int, int, dict[int, bytes], bytes]:
    """(width, height, DC quantiser, Huffman tables by class and id, scan without stuffing) of a baseline grey JPEG."""
    pos, wide, high, quant, tables = 2, 0, 0, 0, {}
    while True:
        if frame[pos] != 0xFF:
            raise ValueError("marker expected")
        marker, size = frame[pos + 1], struct.unpack_from(">H", frame, pos + 2)[0]
        body = frame[pos + 4 : pos + 2 + size]
        if marker == 0xDB:
            quant = body[1]
        elif marker == 0xC0:
            _, high, wide, parts = struct.unpack_from(">BHHB", body)
            if parts != 1:
                raise ValueError("one component expected")
        elif marker == 0xC4:
            while body:
                n = 17 + sum(body[1:17])
                tables[body[0]], body = body[:n], body[n:]
        elif marker == 0xDA:
            return wide, high, quant, tables, frame[pos + 2 + size : frame.rindex(b"\xff\xd9")].replace(b"\xff\x00", b"\xff")
        pos += 2 + size


def _codes(table: bytes) -> dict[tuple[int, int], int]:
    code, at, out = 0, 17, {}
    for n in range(1, 17):
        for _ in range(table[n]):
            out[n, code] = table[at]
            code, at = code + 1, at + 1
        code <<= 1
    return out


def _blocks_of_any(wide: int, high: int, quant: int, tables: dict[int, bytes], scan: bytes) -> np.ndarray:
    """The brightness of each block of a frame with any Huffman tables: its DC coefficient, AC passed over."""
    bits, pos, last, out = np.unpackbits(np.frombuffer(scan, np.uint8)).tolist(), 0, 0, []
    dc, ac = _codes(tables[0x00]), _codes(tables[0x10])

    def symbol(codes):
        nonlocal pos
        code = 0
        for n in range(1, 17):
            code, pos = code << 1 | bits[pos], pos + 1
            if (n, code) in codes:
                return codes[n, code]
        raise ValueError("bad code")

    def number(n):
        nonlocal pos
        v = int("".join(map(str, bits[pos : pos + n])) or "0", 2)
        pos += n
        return v if not n or v >> (n - 1) else v - (1 << n) + 1

    for _ in range((wide + 7) // 8 * ((high + 7) // 8)):
        last += number(symbol(dc))
        out.append(last)
        k = 1
        while k < 64:
            s = symbol(ac)
            if s == 0:
                break
            number(s & 15)
            k += (s >> 4) + 1
    return np.clip(np.round(np.array(out) * quant / 8 + 128), 0, 255).astype(np.uint8)


def decode_frames(frames: list[bytes]) -> np.ndarray:
    """Intra frames -> uint8 samples, a row for each frame."""
    start, step = len(_HEAD), SAMPLES * 10 // 8
    scans = []
    for frame in frames:
        scan = frame[start:-2].replace(b"\xff\x00", b"\xff") if frame.startswith(_HEAD) else b""
        if len(scan) != step:
            return np.stack([_blocks_of_any(*_scan_of(f)) for f in frames])
        scans.append(scan)
    raw = np.frombuffer(b"".join(scans), np.uint8).reshape(-1, 5)
    wide = np.zeros((len(raw), 8), np.uint8)
    wide[:, 3:] = raw
    packed = wide.view(">u8").astype(np.uint64).ravel()
    codes = np.stack([packed >> np.uint64(s) & np.uint64(1023) for s in (30, 20, 10, 0)], axis=1).reshape(-1, SAMPLES)
    return (np.cumsum(_BACK[codes >> np.uint64(1)], axis=1, dtype=np.int16) + 128).astype(np.uint8)


def shots(frames: np.ndarray) -> list[int]:
    """The frames that begin a shot, 0 among them: those whose histogram differs from the last one's by more than
    LEAST and by more than the mean and DEVIATIONS deviations of the WINDOW differences before."""
    n = len(frames)
    if not n:
        return []
    flat = (np.arange(n)[:, None] * BINS + (frames.reshape(n, -1) >> 4)).ravel()
    histogram = np.bincount(flat, minlength=n * BINS).reshape(n, BINS) / frames.reshape(n, -1).shape[1]
    change = np.abs(np.diff(histogram, axis=0)).sum(axis=1) / 2
    sums, squares = np.cumsum(np.r_[0, change]), np.cumsum(np.r_[0, change * change])
    hi = np.arange(n - 1)
    lo = np.maximum(0, hi - WINDOW)
    count = np.maximum(1, hi - lo)
    mean = (sums[hi] - sums[lo]) / count
    deviation = np.sqrt(np.maximum(0, (squares[hi] - squares[lo]) / count - mean * mean))
    return [0, *(np.nonzero((change > LEAST) & (change > mean + DEVIATIONS * deviation))[0] + 1).tolist()]


@dataclass(frozen=True)
class Stored:
    payload_bytes: int
    media: bytes


def store(text: bytes) -> Stored:
    """text with spaces up to a positive multiple of SAMPLES, as an AVI."""
    payload = text + b" " * (-len(text) % SAMPLES if text else SAMPLES)
    return Stored(len(payload), write_avi(encode_frames(np.frombuffer(payload, np.uint8))))


def store_texts(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text, ...) -> (doc_id, n_bytes, media binary). A null text is empty: one frame of spaces."""

    def run(batches):
        for batch in batches:
            for k, doc in enumerate(batch.column("doc_id").to_pylist()):
                text = batch.column("text")[k].as_py().encode()
                yield pa.RecordBatch.from_pylist([{"doc_id": doc, "n_bytes": len(text), "media": store(text).media}], schema)

    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])
    return texts(docs).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def clips(media: DataFrame) -> DataFrame:
    """media(doc_id, media binary, ...) -> a row for each shot: doc_id, clip, start_frame, end_frame (exclusive), start_ms, end_ms.

    A null medium has no clips; one that isn't an AVI of intra frames fails the job.
    """
    names = ["doc_id", "clip", "start_frame", "end_frame", "start_ms", "end_ms"]
    schema = pa.schema([(n, pa.int64()) for n in names])

    def run(batches):
        for batch in batches:
            rows = []
            for k, doc in enumerate(batch.column("doc_id").to_pylist()):
                blob = batch.column("media")[k].as_py()
                if blob is None:
                    continue
                usec, frames = read_avi(blob)
                cuts = [*shots(decode_frames(frames)), len(frames)] if frames else []
                rows += [(doc, n, a, b, a * usec // 1000, b * usec // 1000) for n, (a, b) in enumerate(zip(cuts, cuts[1:]))]
            yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows], schema)

    return media.select(media["doc_id"].cast("long").alias("doc_id"), media["media"].cast("binary").alias("media")).mapInArrow(run, ", ".join(f"{n} long" for n in names))


def media_features(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text, ...) -> what storing each whole text as an AVI and reading it back gives, a row for every row.

    feature lists the frames, the milliseconds and the frames at which clips start. Equal texts give equal
    values, null texts those of empty ones; repeated rows stay, an empty table gives an empty result.
    """
    fields = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    schema = pa.schema([(f.split()[0], pa.int64() if f.endswith("long") else pa.string()) for f in fields.split(", ")])

    def row(doc: int | None, text: bytes) -> dict:
        kept = store(text)
        usec, frames = read_avi(kept.media)
        decoded = decode_frames(frames)
        payload = decoded.tobytes()
        feature = f"frames={len(frames)};ms={len(frames) * usec // 1000};clips={','.join(map(str, shots(decoded)))}"
        return {
            "doc_id": doc, "n_bytes": len(text), "payload_bytes": len(payload), "payload_sha256": hashlib.sha256(payload).hexdigest(),
            "tail_crc32": zlib.crc32(payload[-16:]), "media_bytes": len(kept.media), "media_sha256": hashlib.sha256(kept.media).hexdigest(), "feature": feature,
        }

    def run(batches):
        for batch in batches:
            found = [row(doc, batch.column("text")[k].as_py().encode()) for k, doc in enumerate(batch.column("doc_id").to_pylist())]
            yield pa.RecordBatch.from_pylist(found, schema)

    return texts(docs).mapInArrow(run, fields)
