"""Which windows of a fixed length also start earlier in a corpus: the engine of both substring deduplications.

A window of `window` symbols (bytes or words) is represented by its anchor, the least-hashed gram of `gram`
symbols inside it; equal windows have equal anchors at equal offsets, so windows are compared only where their
anchors meet, and about one symbol in (window - gram) / 2 is an anchor. Distinct texts are held in buckets by
digest, a few megabytes each, and all stages work on whole buckets:

1. anchors: each bucket lists its distinct anchor hashes, in ranges of the hash; a range tells each bucket which
   of them occur twice in the corpus;
2. contexts: each bucket sends the surroundings of those anchors, once for equal ones, to ranges of the hash;
3. a range finds for each window the first one equal to it and returns runs of windows that aren't first;
4. each bucket removes what its runs cover.

Anchors that more than HOT places share are split by the whole window's digest, so that a passage in a third of all
documents is at most one short row from each bucket.

Bytes are sorted by bucket-pointer refinement. Words aren't: there the method is the prefilter, and rows that soon differ
are cheaper to sort one symbol after the other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, functions as F

from .common import buckets_for, cut, texts

HOT = 20_000
#: Symbols that are searched for anchors at once, those of one piece of a longer text, and contexts that are classed at once.
PART, PIECE, CHUNK = 1 << 18, 1 << 24, 20_000
_NULL = -(1 << 63)
_POSITION = np.uint64((1 << 28) - 1)
_TABLE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B, _M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_EMPTY = hashlib.sha256(b"").hexdigest()

_RESULT = "digest binary, first_id long, n_units long, n_removed long, n_spans long, kept_sha256 string"
_SENT = "range int, bucket int, n_ctx int, n_split int, n_run int, packed binary"


@dataclass(frozen=True)
class Spec:
    """words: symbols are words, not bytes. strict: only a smaller doc_id counts as earlier."""

    window: int
    gram: int
    words: bool
    strict: bool

    @property
    def left(self) -> int:
        return self.window - self.gram

    @property
    def width(self) -> int:
        return self.left + self.window

    @property
    def type(self) -> np.dtype:
        return np.dtype("<u8") if self.words else np.dtype(np.uint8)


class Prefilter(Protocol):
    """Tells each bucket which of its anchors may occur twice in the corpus; it may err only by keeping one that doesn't."""

    def masks(self, held: DataFrame, spec: Spec) -> DataFrame:
        """Distinct texts -> rows (bucket, ...) that keep reads."""

    def keep(self, hashes: np.ndarray, masks: pa.Table) -> np.ndarray:
        """Which of a bucket's distinct hashes to keep, by the bucket's rows of masks."""


def _symbols(text: bytes, spec: Spec) -> np.ndarray:
    if not spec.words:
        return np.frombuffer(text, np.uint8)
    digest = xxhash.xxh64_intdigest
    return np.array([digest(w) for w in text.split()], "<u8")


def _grams(symbols: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of each gram of size symbols, size a power of two, by doubling."""
    h = _TABLE[symbols] if symbols.dtype == np.uint8 else symbols * _B
    step, base = 1, _M1
    with np.errstate(over="ignore"):
        while step < size:
            h = h[:-step] * base + h[step:]
            base, step = base * base, step * 2
        h ^= h >> np.uint64(31)
        h *= _M2
        h ^= h >> np.uint64(29)
    return h


def _sliding_least(values: np.ndarray, size: int) -> np.ndarray:
    span = 1
    while span * 2 <= size:
        values = np.minimum(values[:-span], values[span:])
        span *= 2
    return np.minimum(values[: len(values) - (size - span)], values[size - span :]) if span < size else values


def anchors(symbols: np.ndarray, ends: np.ndarray, spec: Spec) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of texts joined in symbols and ending at ends: each anchor's place, its first and last window, its hash.

    A window's anchor is the leftmost of its least grams, so it depends on nothing outside the window.
    """
    n, size = len(symbols), spec.window
    none = np.zeros(0, np.int64)
    if n < size:
        return none, none, none, none.astype(np.uint64)
    h = _grams(symbols, spec.gram)
    ranked = (h & ~_POSITION) | np.arange(len(h), dtype=np.uint64)
    at = (_sliding_least(ranked, size - spec.gram + 1) & _POSITION).astype(np.int64)
    over = np.zeros(n + 1, np.int32)  # windows that reach over an end
    starts = np.r_[0, ends[:-1]]
    np.add.at(over, np.maximum(starts, ends - size + 1), 1)
    np.add.at(over, ends, -1)
    place = np.nonzero(np.cumsum(over)[: len(at)] == 0)[0]
    if not len(place):
        return none, none, none, none.astype(np.uint64)
    at = at[place]
    new = np.r_[True, (at[1:] != at[:-1]) | (place[1:] != place[:-1] + 1)]
    first = np.nonzero(new)[0]
    last = np.r_[first[1:], len(place)] - 1
    return at[first], place[first], place[last], h[at[first]]


@dataclass
class Bucket:
    """The distinct texts of a bucket in digest order, each with its least doc_id."""

    digests: list[bytes]
    ids: list[int]
    texts: list[bytes]


def _bucket(rows: pa.Table) -> Bucket:
    least: dict[bytes, int] = {}
    packed: dict[bytes, int] = {}
    column = rows.column("packed")
    for k, (digest, doc) in enumerate(zip(rows.column("digest").to_pylist(), rows.column("doc_id").to_pylist())):
        least[digest] = min(doc, least.get(digest, doc))
        if digest not in packed and column[k].is_valid:
            packed[digest] = k
    unpack, digests = zstandard.ZstdDecompressor(), sorted(least)
    return Bucket(digests, [least[d] for d in digests], [unpack.decompress(column[packed[d]].as_py()) for d in digests])


def _parts(bucket: Bucket, spec: Spec):
    """(rows, symbols, starts, ends, bases) of texts in document order, some PART symbols at a time; short texts have no window.

    A text of over PIECE symbols comes in pieces that begin bases symbols into it and share window - 1 symbols with the
    next, so each window lies in one piece and places inside a part stay small whatever a text's length.
    """
    order = sorted(range(len(bucket.ids)), key=lambda k: (bucket.ids[k], k))
    rows, arrays, bases, total = [], [], [], 0

    def part():
        ends = np.cumsum([len(a) for a in arrays])
        return np.array(rows), np.concatenate(arrays), np.r_[0, ends[:-1]], ends, np.array(bases)

    for k in order:
        array = _symbols(bucket.texts[k], spec)
        for base in range(0, max(1, len(array) - spec.window + 1), PIECE):
            piece = array[base : base + PIECE + spec.window - 1]
            if len(piece) >= spec.window:
                rows.append(k)
                arrays.append(piece)
                bases.append(base)
                total += len(piece)
            if total >= PART:
                yield part()
                rows, arrays, bases, total = [], [], [], 0
    if rows:
        yield part()


def _range_of(hashes: np.ndarray, ranges: int) -> np.ndarray:
    """Mixed first: anchors are least hashes, which crowd the low end of the numbers."""
    with np.errstate(over="ignore"):
        mixed = (hashes ^ hashes >> np.uint64(29)) * _B >> np.uint64(32)
    return (mixed * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)


def _split_by(keys: np.ndarray, *arrays: np.ndarray):
    """(key, the arrays' parts) for each distinct key."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    edges = np.r_[0, np.nonzero(keys[1:] != keys[:-1])[0] + 1, len(keys)]
    arrays = tuple(a[order] for a in arrays)
    for a, b in zip(edges, edges[1:]):
        if b > a:
            yield int(keys[a]), *(x[a:b] for x in arrays)


def _table(fields: str, rows: list[tuple]) -> pa.Table:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string()}
    schema = pa.schema([(f.split()[0], kinds[f.split()[1]]) for f in fields.split(", ")])
    columns = list(zip(*rows)) or [()] * len(schema)
    return pa.Table.from_arrays([pa.array(c, t.type) for c, t in zip(columns, schema)], schema=schema)


def distinct_texts(docs: DataFrame, buckets: int) -> DataFrame:
    """docs(doc_id, digest, text) -> (bucket, digest, doc_id, packed): each text once a task and the least doc_id of each.

    bucket follows the digest's order. A further row without the text corrects the doc_id of an earlier one.
    """

    def run(batches):
        least: dict[bytes, int] = {}
        pack = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            rows, text = [], batch.column("text")
            for k, (doc, digest) in enumerate(zip(batch.column("doc_id").to_pylist(), batch.column("digest").to_pylist())):
                known = least.get(digest)
                if known is None or doc < known:
                    least[digest] = doc
                    packed = pack.compress(text[k].as_py().encode()) if known is None else None
                    rows.append((int.from_bytes(digest[:4], "big") * buckets >> 32, digest, doc, packed))
            yield from _table("bucket int, digest binary, doc_id long, packed binary", rows).to_batches()

    return docs.mapInArrow(run, "bucket int, digest binary, doc_id long, packed binary")


def anchor_counts(bucket: Bucket, spec: Spec) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashes of a bucket's anchors, in order, and how often each occurs."""
    found = [anchors(symbols, ends, spec)[3] for _, symbols, _, ends, _ in _parts(bucket, spec)]
    return np.unique(np.concatenate(found) if found else np.zeros(0, np.uint64), return_counts=True)


def repeated_anchors(held: DataFrame, spec: Spec, ranges: int, prefilter: Prefilter | None = None) -> DataFrame:
    """(bucket, n_run int, packed): for each bucket the anchor hashes that occur at least twice, the last n_run of them at
    more than HOT places. prefilter may drop hashes that occur once in the corpus before they leave their bucket."""

    def list_hashes(rows: pa.Table, masks: pa.Table | None = None) -> pa.Table:
        fields = "range int, bucket int, packed binary"
        if not len(rows):
            return _table(fields, [])
        at = rows.column("bucket")[0].as_py()
        hashes, counts = anchor_counts(_bucket(rows), spec)
        if masks is not None:
            kept = prefilter.keep(hashes, masks)
            hashes, counts = hashes[kept], counts[kept]
        out = [(r, at, h.astype("<u8").tobytes() + np.minimum(c, HOT + 1).astype("<u2").tobytes()) for r, h, c in _split_by(_range_of(hashes, ranges), hashes, counts)]
        return _table(fields, out)

    def find_repeated(rows: pa.Table) -> pa.Table:
        hashes, counts, owners = [], [], []
        for bucket, packed in zip(rows.column("bucket").to_pylist(), rows.column("packed").to_pylist()):
            n = len(packed) // 10
            hashes.append(np.frombuffer(packed, "<u8", n))
            counts.append(np.frombuffer(packed, "<u2", n, 8 * n))
            owners.append(np.full(n, bucket, np.int64))
        h, inverse = np.unique(np.concatenate(hashes), return_inverse=True)
        total = np.bincount(inverse, weights=np.concatenate(counts))[inverse]
        bucket, h = np.concatenate(owners), h[inverse]
        out = []
        repeated = total > 1
        for b, part, n in _split_by(bucket[repeated], h[repeated], total[repeated]):
            part = np.r_[part[n <= HOT], part[n > HOT]]
            out.append((b, int((n > HOT).sum()), part.astype("<u8").tobytes()))
        return _table("bucket int, n_run int, packed binary", out)

    by_bucket, fields = held.groupBy("bucket"), "range int, bucket int, packed binary"
    if prefilter:
        listed = by_bucket.cogroup(prefilter.masks(held, spec).groupBy("bucket")).applyInArrow(list_hashes, fields)
    else:
        listed = by_bucket.applyInArrow(lambda rows: list_hashes(rows), fields)
    return listed.groupBy("range").applyInArrow(find_repeated, "bucket int, n_run int, packed binary")


_ROW, _SPLIT, _RUN = (
    np.dtype([("hash", "<u8"), ("doc", "<i8"), ("row", "<i4"), ("at", "<u4"), ("low", "u1"), ("high", "u1")]),
    np.dtype([("key", "<u8"), ("key2", "<u8"), ("doc", "<i8"), ("row", "<i4"), ("at", "<u4")]),
    np.dtype([("row", "<i4"), ("start", "<u4"), ("end", "<u4")]),
)


def _contexts(bucket_id: int, bucket: Bucket, spec: Spec, light: np.ndarray, heavy: np.ndarray, ranges: int) -> pa.Table:
    """The surroundings of repeated anchors, and the runs that repeat inside the bucket."""
    rows, contexts, splits, runs = [np.zeros(0, _ROW)], [np.zeros((0, spec.width), spec.type)], [], []
    seen: dict[bytes, int] = {}
    wanted = np.sort(np.r_[light, heavy])
    ids = np.array(bucket.ids, np.int64)
    column = np.arange(spec.width)
    for of, symbols, starts, ends, bases in _parts(bucket, spec):
        at, low, high, hashes = anchors(symbols, ends, spec)
        chosen = np.isin(hashes, wanted)
        at, low, high, hashes = at[chosen], low[chosen], high[chosen], hashes[chosen]
        if not len(at):
            continue
        text = np.searchsorted(starts, at, "right") - 1
        place = np.empty(len(at), _ROW)
        begin = starts - bases  # where the texts themselves begin
        place["hash"], place["doc"], place["row"], place["at"] = hashes, ids[of[text]], of[text], at - begin[text]
        place["low"], place["high"] = at - high, at - low
        hot = np.isin(hashes, heavy) if len(heavy) else np.zeros(len(at), bool)
        for n in np.nonzero(hot)[0].tolist():
            doc, row, first = int(place["doc"][n]), int(place["row"][n]), int(begin[text[n]])
            for p in range(int(low[n]), int(high[n]) + 1):
                key = hashlib.blake2b(symbols[p : p + spec.window].tobytes(), digest_size=16).digest()
                if key in seen and (not spec.strict or seen[key] < doc):
                    runs.append((row, p - first, p - first + spec.window))
                else:
                    seen.setdefault(key, doc)
                    splits.append((*np.frombuffer(key, "<u8").tolist(), doc, row, p - first))
        padded = np.concatenate([np.zeros(spec.left, spec.type), symbols, np.zeros(spec.window, spec.type)])
        view = np.lib.stride_tricks.sliding_window_view(padded, spec.width)
        size = spec.width * spec.type.itemsize
        calm = np.nonzero(~hot)[0]
        for a in range(0, len(calm), CHUNK):
            which = calm[a : a + CHUNK]
            part = place[which]
            around = view[at[which]].copy()
            lows, highs = part["low"].astype(int), part["high"].astype(int)
            around[(column < (spec.left - highs)[:, None]) | (column >= (spec.left - lows + spec.window)[:, None])] = 0
            raw, kept = around.tobytes(), []
            for k, (doc, row, x, lo, hi) in enumerate(zip(*(v.tolist() for v in (part["doc"], part["row"], part["at"], lows, highs)))):
                key = hashlib.blake2b(raw[k * size : k * size + size] + bytes((lo, hi)), digest_size=16).digest()
                if key in seen and (not spec.strict or seen[key] < doc):
                    runs.append((row, x - hi, x - lo + spec.window))
                else:
                    seen.setdefault(key, doc)
                    kept.append(k)
            rows.append(part[kept])
            contexts.append(around[kept])
    return _pack(bucket_id, np.concatenate(rows), np.concatenate(contexts), np.array(splits, _SPLIT), _merged(np.array(runs, _RUN)), ranges)


def _pack(bucket: int, rows: np.ndarray, contexts: np.ndarray, splits: np.ndarray, runs: np.ndarray, ranges: int) -> pa.Table:
    pack, out = zstandard.ZstdCompressor(level=1), []
    if len(rows):
        for r, part, which in _split_by(_range_of(rows["hash"], ranges), rows, np.arange(len(rows))):
            out.append((r, bucket, len(part), 0, 0, pack.compress(part.tobytes() + contexts[which].tobytes())))
    if len(splits):
        for r, part in _split_by(_range_of(splits["key"], ranges), splits):
            out.append((r, bucket, 0, len(part), 0, pack.compress(part.tobytes())))
    if len(runs):
        out.append((bucket % ranges, bucket, 0, 0, len(runs), pack.compress(runs.tobytes())))
    return _table(_SENT, out)


def _merged(runs: np.ndarray) -> np.ndarray:
    """Runs sorted, those that touch or overlap joined."""
    if len(runs) < 2:
        return runs
    runs = runs[np.lexsort((runs["end"], runs["start"], runs["row"]))]
    # rows don't overlap once each is shifted by more than any end
    shift = runs["row"].astype(np.int64) * (int(runs["end"].max()) + 1)
    start, end = runs["start"] + shift, np.maximum.accumulate(runs["end"] + shift)
    new = np.r_[True, (start[1:] > end[:-1]) | (runs["row"][1:] != runs["row"][:-1])]
    first = np.nonzero(new)[0]
    last = np.r_[first[1:], len(runs)] - 1
    out = runs[first].copy()
    out["end"] = end[last] - shift[last]
    return out


def _pointers(columns: np.ndarray) -> np.ndarray:
    """Bucket-pointer refinement of the suffixes that begin q symbols apart in each row: (row, suffix) -> its bucket's pointer.

    Suffixes start in the buckets of their first q symbols. From the last one backwards a suffix is refined by sorting on
    (its bucket, the pointer of the suffix q symbols later); its new pointer replaces the old one and is what the suffix
    before it is sorted by, so no symbol is compared twice. Equal pointers of one suffix mean equal rests of the rows.
    """
    n, width = columns.shape
    size = 8 // columns.dtype.itemsize
    steps = -(-width // size)
    padded = np.zeros((n, steps * size), columns.dtype)
    padded[:, :width] = columns
    pointer = np.empty((n, steps), np.int64)
    grams = padded.view(">u8").reshape(n, steps) if size > 1 else padded
    for step in range(steps):
        pointer[:, step] = np.unique(grams[:, step], return_inverse=True)[1]
    for step in range(steps - 2, -1, -1):
        pointer[:, step] = np.unique(pointer[:, step] * n + pointer[:, step + 1], return_inverse=True)[1]
    return pointer


def _shared(columns: np.ndarray, group: np.ndarray, order: np.ndarray) -> np.ndarray:
    """How many columns each row shares with the one before in order, 0 at a group's first."""
    shared = np.zeros(len(order), np.int64)
    if len(order) > 1:
        differ = columns[order[1:]] != columns[order[:-1]]
        shared[1:] = np.where(differ.any(axis=1), differ.argmax(axis=1), columns.shape[1])
        value = group[order]
        shared[1:][value[1:] != value[:-1]] = 0
    return shared


def _suffix_order(columns: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows sorted inside their groups by the refined pointers of their first suffixes, and what neighbours share."""
    order = np.lexsort((_pointers(columns)[:, 0], group))
    return order, _shared(columns, group, order)


def _row_order(columns: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows sorted inside their groups symbol by symbol, rows alone in their bucket taking no further part, and what neighbours share."""
    n, width = columns.shape
    order = np.argsort(group, kind="stable")
    value = group[order]
    begins = np.r_[True, value[1:] != value[:-1]]
    bucket = np.empty(n, np.int64)
    bucket[order] = np.maximum.accumulate(np.where(begins, np.arange(n), 0))
    for step in range(width):
        where = bucket[order]
        crowd = np.zeros(n, bool)
        same = where[1:] == where[:-1]
        crowd[1:] |= same
        crowd[:-1] |= same
        places = np.nonzero(crowd)[0]
        if not len(places):
            break
        rows = order[places]
        symbol = columns[rows, step]
        by = np.lexsort((symbol, bucket[rows]))
        rows, symbol, held = rows[by], symbol[by], bucket[rows][by]
        order[places] = rows
        begins = np.r_[True, (held[1:] != held[:-1]) | (symbol[1:] != symbol[:-1])]
        bucket[rows] = places[np.maximum.accumulate(np.where(begins, np.arange(len(rows)), 0))]
    return order, _shared(columns, group, order)


def later_windows(context: np.ndarray, group: np.ndarray, low: np.ndarray, high: np.ndarray, doc: np.ndarray, spec: Spec) -> tuple[np.ndarray, np.ndarray]:
    """(row, offset) of each window that isn't the first of its kind. Rows are in document order inside their groups; a
    row's windows begin low to high symbols before its anchor.

    Two windows of a group at one offset are equal if their rows share enough symbols to the right of the anchor
    and enough to the left: both sorted orders are cut where neighbours share too few.
    """
    n = len(context)
    sort = _row_order if spec.words else _suffix_order
    right, after = sort(context[:, spec.left :], group)
    left, before = sort(np.ascontiguousarray(context[:, : spec.left][:, ::-1]), group)
    begins_right = np.r_[True, group[right][1:] != group[right][:-1]]
    begins_left = np.r_[True, group[left][1:] != group[left][:-1]]
    rows_out, offsets_out = [], []
    of_right, of_left = np.empty(n, np.int64), np.empty(n, np.int64)
    for offset in range(int(low.min()), int(high.max()) + 1):
        rows = np.nonzero((low <= offset) & (offset <= high))[0]
        if len(rows) < 2:
            continue
        of_right[right] = np.cumsum(begins_right | (after < spec.window - offset))
        of_left[left] = np.cumsum(begins_left | (before < offset))
        kind = of_right[rows] * (n + 1) + of_left[rows]
        _, first, inverse = np.unique(kind, return_index=True, return_inverse=True)
        first = rows[first[inverse]]
        later = doc[first] < doc[rows] if spec.strict else first != rows
        rows_out.append(rows[later])
        offsets_out.append(np.full(int(later.sum()), offset))
    if not rows_out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(rows_out), np.concatenate(offsets_out)


def _find_runs(table: pa.Table, spec: Spec) -> pa.Table:
    """All rows of a range -> runs of windows that aren't first, by bucket."""
    unpack = zstandard.ZstdDecompressor()
    rows, contexts, owners, splits, split_owners, found = [], [], [], [], [], []
    for bucket, a, b, c, packed in zip(*(table.column(n).to_pylist() for n in ("bucket", "n_ctx", "n_split", "n_run", "packed"))):
        raw = unpack.decompress(packed)
        if a:
            rows.append(np.frombuffer(raw, _ROW, a))
            contexts.append(np.frombuffer(raw, spec.type, a * spec.width, a * _ROW.itemsize).reshape(a, spec.width))
            owners.append(np.full(a, bucket, np.int64))
        if b:
            splits.append(np.frombuffer(raw, _SPLIT, b))
            split_owners.append(np.full(b, bucket, np.int64))
        if c:
            found.append((np.full(c, bucket, np.int64), np.frombuffer(raw, _RUN, c)))
    if rows:
        row, context, owner = np.concatenate(rows), np.concatenate(contexts), np.concatenate(owners)
        order = np.lexsort((row["at"], row["row"], owner, row["doc"], row["hash"]))
        row, owner = row[order], owner[order]
        edges = np.r_[0, np.nonzero(row["hash"][1:] != row["hash"][:-1])[0] + 1, len(row)]
        at = 0
        while at < len(edges) - 1:
            to = max(at + 1, int(np.searchsorted(edges, edges[at] + CHUNK, "right")) - 1)
            part = slice(edges[at], edges[to])
            group = np.repeat(np.arange(to - at), np.diff(edges[at : to + 1]))
            r = row[part]
            which, offset = later_windows(context[order[part]], group, r["low"].astype(int), r["high"].astype(int), r["doc"], spec)
            runs = np.empty(len(which), _RUN)
            runs["row"], runs["start"] = r["row"][which], r["at"][which] - offset
            runs["end"] = runs["start"] + spec.window
            found.append((owner[part][which], runs))
            at = to
    if splits:
        split, owner = np.concatenate(splits), np.concatenate(split_owners)
        order = np.lexsort((split["at"], split["row"], owner, split["doc"], split["key2"], split["key"]))
        split, owner = split[order], owner[order]
        new = np.r_[True, (split["key"][1:] != split["key"][:-1]) | (split["key2"][1:] != split["key2"][:-1])]
        first = np.maximum.accumulate(np.where(new, np.arange(len(split)), 0))
        later = split["doc"][first] < split["doc"] if spec.strict else ~new
        runs = np.empty(int(later.sum()), _RUN)
        runs["row"], runs["start"] = split["row"][later], split["at"][later]
        runs["end"] = runs["start"] + spec.window
        found.append((owner[later], runs))
    if not found:
        return _table("bucket int, packed binary", [])
    owner, runs = np.concatenate([o for o, _ in found]), np.concatenate([r for _, r in found])
    return _table("bucket int, packed binary", [(b, _merged(part).tobytes()) for b, part in _split_by(owner, runs)])


def _removed(bucket: Bucket, runs: np.ndarray, spec: Spec) -> pa.Table:
    runs = _merged(runs)
    edges = np.searchsorted(runs["row"], np.arange(len(bucket.ids) + 1))
    out = []
    for k, text in enumerate(bucket.texts):
        own = runs[edges[k] : edges[k + 1]]
        units = text.split() if spec.words else text
        kept, at = [], 0
        for _, start, end in own.tolist():
            kept.append(units[at:start])
            at = end
        kept.append(units[at:])
        rest = b" ".join(w for part in kept for w in part) if spec.words else b"".join(kept)
        removed = int((own["end"].astype(np.int64) - own["start"]).sum())
        out.append((bucket.digests[k], bucket.ids[k], len(units), removed, len(own), hashlib.sha256(rest).hexdigest()))
    return _table(_RESULT, out)


def remove_repeats(docs: DataFrame, spec: Spec, prefilter: Callable[[int], Prefilter] | None = None) -> DataFrame:
    """docs(doc_id, text, ...) -> (doc_id, n_units, n_removed, n_spans, kept_sha256), a row for every row of docs.

    Removed is each symbol that a window covers which also starts earlier, judged on the input. Null texts are
    empty. A null doc_id comes before all others. Rows that repeat a doc_id and its text are one document; different
    texts with one doc_id are ordered by their SHA-256. A text may have up to 2**32 symbols. An empty table gives an empty result.
    """
    buckets = buckets_for(docs)
    rows = texts(docs).select(F.coalesce("doc_id", F.lit(_NULL)).alias("doc_id"), F.unhex(F.sha2(F.col("text"), 256)).alias("digest"), "text")
    held = distinct_texts(rows, buckets)
    repeated = repeated_anchors(held, spec, buckets // 4 + 8, prefilter(buckets) if prefilter else None)
    ranges = 2 * buckets + 8

    def send(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left):
            return _table(_SENT, [])
        light, heavy = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
        for n, packed in zip(right.column("n_run").to_pylist(), right.column("packed").to_pylist()):
            hashes = np.frombuffer(packed, "<u8")
            light.append(hashes[: len(hashes) - n])
            heavy.append(hashes[len(hashes) - n :])
        return _contexts(left.column("bucket")[0].as_py(), _bucket(left), spec, np.concatenate(light), np.concatenate(heavy), ranges)

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left):
            return _table(_RESULT, [])
        runs = np.concatenate([np.zeros(0, _RUN), *(np.frombuffer(p, _RUN) for p in right.column("packed").to_pylist())])
        return _removed(_bucket(left), runs, spec)

    by_bucket = held.groupBy("bucket")
    sent = by_bucket.cogroup(repeated.groupBy("bucket")).applyInArrow(send, _SENT)
    runs = sent.groupBy("range").applyInArrow(lambda table: _find_runs(table, spec), "bucket int, packed binary")
    results = held.groupBy("bucket").cogroup(runs.groupBy("bucket")).applyInArrow(finish, _RESULT)
    joined = rows.select("doc_id", "digest").join(results, "digest")
    copy = (F.col("doc_id") > F.col("first_id")) & (F.col("n_units") >= spec.window)
    return joined.select(
        F.when(F.col("doc_id") != _NULL, F.col("doc_id")).alias("doc_id"),
        "n_units",
        F.when(copy, F.col("n_units")).otherwise(F.col("n_removed")).alias("n_removed"),
        F.when(copy, F.lit(1).cast("long")).otherwise(F.col("n_spans")).alias("n_spans"),
        F.when(copy, F.lit(_EMPTY)).otherwise(F.col("kept_sha256")).alias("kept_sha256"),
    )
