"""Benchmark passages in documents: CGK embedding, repeated bit-sampling LSH over item-sized windows, exact edit verification.

Symbols are words: lower-cased, ASCII punctuation as white space; in scripts without spaces they are characters. An item of n words is found where the edit distance
in words between it and some stretch of a document is at most (1 - SIMILARITY) * n.

The CGK random walk embeds window and item so that few edits give few differing places. A repetition is a walk and a word of
the item from which it begins: it samples SAMPLED places of the next steps, and all items' samples stand in one table for each
walk. A document's samples from each of its words are looked up there; a sample that agrees with one taken o words into an
item places the item-sized window o words before, and each window so placed is verified exactly. A document is walked once
for each walk, whatever the items' number and lengths. Walks are added for each class of lengths until its mutated items at
the full distance reach RECALL; items that don't reach it are verified against whole texts.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import id_type, texts

SIMILARITY, RECALL = 0.8, 0.995
#: Steps of a walk at most, places that a repetition samples of them, and most walks.
STEPS, SAMPLED, MOST_WALKS = 8, 4, 24
#: Mutated items that a class's walks are calibrated on at least, and no walks at all.
TRIALS, WHOLE = 400, 0
#: Words that are walked at once, pairs that are verified at once, and bits of the codes that the filter sees.
CHUNK, PAIRS, FILTER_BITS = 1 << 16, 1 << 20, 20
_MIX = np.uint64(0x9E3779B97F4A7C15)
#: Bytes of items that are broadcast at once; a larger benchmark is done in blocks of this size.
BLOCK_BYTES = 16 << 20
_PLAIN = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in range(256))


#: Scripts that are written without spaces: each character is a symbol. Their punctuation is white space, like ASCII's.
_UNSPACED = re.compile("[\u0e00-\u0eff\u0f40-\u0fbc\u1000-\u109f\u1780-\u17d3\u3005-\u3007\u3021-\u312f\u31a0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff]")
_UNSPACED_MARKS = re.compile("[\u3001-\u3004\u3008-\u3020\u30fb\uff01-\uff0f\uff1a-\uff20\uff3b-\uff40\uff5b-\uff65]")


def words(text: str) -> list[bytes]:
    if not text.isascii() and _UNSPACED.search(text):
        text = _UNSPACED.sub(r" \g<0> ", _UNSPACED_MARKS.sub(" ", text))
    return text.lower().encode().translate(_PLAIN).split()


#: What one walk's codes of one number of steps find: a filter by the codes' upper bits, the sorted codes, their items and places.
Table = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


@dataclass(frozen=True)
class Index:
    ids: list[int]
    items: list[np.ndarray]
    edits: list[int]
    vocabulary: dict[bytes, int]
    walks: list[int]
    tables: dict[tuple[int, int], Table]


def allowed(n: int, similarity: float = SIMILARITY) -> int:
    return int((1 - similarity) * n + 1e-9)


def _steps(n: int, k: int) -> int:
    """Steps of an item's walks: about twice the run of words that k edits leave intact, as a step moves on every other time,
    and few enough that a walk can begin in either half of a short item."""
    return min(STEPS, 2 * -(-(n - k) // (k + 1)), (n + 1) // 2) if k else min(STEPS, n)


@lru_cache(maxsize=256)
def _walk(walk: int) -> tuple[np.ndarray, dict[int, list[int]]]:
    """A walk's shared random bits (for each step and symbol, whether it moves on), and the places that are sampled of so many steps."""
    rng = np.random.default_rng((20240229, walk))
    bits = rng.integers(0, 2, (STEPS, 1024))
    return bits, {n: sorted(rng.choice(n, min(SAMPLED, n), replace=False).tolist()) for n in range(1, STEPS + 1)}


def sampled(symbols: np.ndarray, low: int, high: int, walk: int, sizes: set[int]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each number of steps in sizes: the code of the sampled places of the CGK embedding from each of symbols[low:high],
    0 where one holds an unknown symbol, and how many different words were sampled.

    At each step the walk writes its symbol and stays or moves on. symbols ends with STEPS zeros, so no walk passes the end.
    """
    bits, places = _walk(walk)
    position = np.arange(low, high)
    out = {n: [np.zeros(high - low, np.uint64), np.ones(high - low, bool), np.zeros(high - low, np.int8), np.full(high - low, -1)] for n in sizes}
    with np.errstate(over="ignore"):
        for step in range(max(sizes, default=0)):
            symbol = symbols[position]
            for n, state in out.items():
                if step in places[n]:
                    state[0] = state[0] * _MIX + symbol.view(np.uint64)
                    state[1] &= symbol > 0
                    state[2] += position != state[3]
                    state[3] = position
            position = np.minimum(position + bits[step][symbol & 1023], len(symbols) - 1)
        return {n: (np.where(known, (code ^ code >> np.uint64(31)) * _MIX | np.uint64(1), np.uint64(0)), words) for n, (code, known, words, _) in out.items()}


def _joined(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """parts as one array with STEPS zeros behind each, where each begins, and whose each place is."""
    gap = np.zeros(STEPS, np.int64)
    lengths = np.array([len(p) + STEPS for p in parts], np.int64)
    begins = np.cumsum(lengths) - lengths
    return np.concatenate([x for p in parts for x in (p, gap)]) if parts else gap[:0], begins, np.repeat(np.arange(len(parts)), lengths)


def _entries(items: list[np.ndarray], edits: list[int], walk: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code, item, place) of what a walk of size steps samples from each place of the items that has so many words ahead.

    Where edits are allowed, samples of hardly any words are left out: they would meet everywhere.
    """
    symbols, begins, of = _joined(items)
    if not len(symbols):
        return np.zeros(0, np.uint64), of, of
    code, words = sampled(symbols, 0, len(symbols), walk, {size})[size]
    place, ahead = np.arange(len(symbols)) - begins[of], np.array([len(i) for i in items])[of]
    use = (place + size <= ahead) & ((words >= min(3, (size + 1) // 2)) | (np.array(edits)[of] == 0))
    return code[use], of[use], place[use]


def edit_distance(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """(least edit distance of item to any stretch of text, where the first such stretch ends), by Myers' bit vectors."""
    n = len(item)
    masks: dict[int, int] = {}
    for k, s in enumerate(item.tolist()):
        masks[s] = masks.get(s, 0) | 1 << k
    full, top = (1 << n) - 1, 1 << (n - 1)
    plus, minus, score = full, 0, n
    best, end = n, 0
    for j, s in enumerate(text.tolist()):
        eq = masks.get(s, 0) if s else 0
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        hp, hm = minus | ~(xh | plus) & full, plus & xh
        if hp & top:
            score += 1
        elif hm & top:
            score -= 1
        hp, hm = hp << 1 & full, hm << 1 & full
        plus, minus = hm | ~(xv | hp) & full, hp & xv
        if score < best:
            best, end = score, j + 1
    return best, end


def _mutated(item: np.ndarray, k: int, rng: random.Random) -> np.ndarray:
    out = item.tolist()
    for _ in range(k):
        at, how = rng.randrange(len(out)), rng.randrange(3)
        if how == 0:
            out[at] = 0
        elif how == 1:
            out.insert(at, 0)
        elif len(out) > 1:
            del out[at]
    return np.array(out, np.int64)


def _repetitions(items: list[np.ndarray], edits: list[int], recall: float) -> list[int]:
    """For each item the fewest walks with which mutated items of its class meet it at the target recall.

    A class holds the items of about one length; each item of it is tried, and TRIALS are made at least (fewer of very long
    ones). WHOLE stands where MOST_WALKS miss the target: such an item is verified against whole texts.
    """
    classes: dict[tuple[int, int], list[int]] = {}
    for k, item in enumerate(items):
        classes.setdefault((int(np.log(len(item)) / np.log(1.25)), _steps(len(item), edits[k])), []).append(k)
    out = [WHOLE] * len(items)
    for (_, size), members in classes.items():
        rng, longest = random.Random(7), max(len(items[k]) for k in members)
        tried = [members[k % len(members)] for k in range(max(len(members), min(TRIALS, 2_000_000 // longest)))]
        changed, _, owner = _joined([_mutated(items[k], edits[k], rng) for k in tried])
        missed = np.ones(len(tried), bool)
        for walk in range(MOST_WALKS):
            codes, of, _ = _entries([items[k] for k in tried], [edits[k] for k in tried], walk, size)
            found = sampled(changed, 0, len(changed), walk, {size})[size][0]
            with np.errstate(over="ignore"):  # a code meets only its own trial's
                met = np.isin(found + owner.astype(np.uint64) * _MIX, codes + of.astype(np.uint64) * _MIX) & (found > 0)
            missed[owner[met]] = False
            if missed.sum() <= (1 - recall) * len(tried):
                for k in members:
                    out[k] = walk + 1
                break
    return out


def build_index(rows: list[tuple[int, str]], similarity: float = SIMILARITY, recall: float = RECALL) -> Index:
    """Items with their samples; items of fewer than five words allow no edits, those without a word are left out."""
    vocabulary: dict[bytes, int] = {}
    ids, items, edits = [], [], []
    for item_id, text in rows:
        found = words(text or "")
        if found:
            ids.append(item_id)
            items.append(np.array([vocabulary.setdefault(w, len(vocabulary) + 1) for w in found], np.int64))
            edits.append(allowed(len(found), similarity))
    walks, tables = _repetitions(items, edits, recall), {}
    for walk in range(max(walks, default=0)):
        by_size: dict[int, list[int]] = {}
        for k, item in enumerate(items):
            if walk < walks[k]:
                by_size.setdefault(_steps(len(item), edits[k]), []).append(k)
        for size, members in by_size.items():
            codes, of, at = _entries([items[k] for k in members], [edits[k] for k in members], walk, size)
            order = np.argsort(codes, kind="stable")
            filled = np.zeros(1 << FILTER_BITS, bool)
            filled[codes >> np.uint64(64 - FILTER_BITS)] = True
            tables[walk, size] = filled, codes[order], np.array(members)[of[order]], at[order]
    return Index(ids, items, edits, vocabulary, walks, tables)


def _distinct(parts: list[np.ndarray]) -> np.ndarray:
    """The rows of parts, sorted, each once."""
    rows = np.concatenate(parts)
    rows = rows[np.lexsort(rows.T[::-1])]
    return rows[np.r_[True, (rows[1:] != rows[:-1]).any(axis=1)]]


def _met(texts: list[np.ndarray], index: Index) -> Iterator[np.ndarray]:
    """(item, text, where the item-sized window starts) of windows whose samples agree in some repetition, sorted, some at a time in the texts' order."""
    symbols, begins, owner = _joined(texts)
    sizes: dict[int, set[int]] = {}
    for walk, size in index.tables:
        sizes.setdefault(walk, set()).add(size)
    for low in range(0, len(symbols), CHUNK):
        high, parts = min(low + CHUNK, len(symbols)), []
        for walk, wanted in sizes.items():
            for size, (code, _) in sampled(symbols, low, high, walk, wanted).items():
                filled, codes, of, at = index.tables[walk, size]
                here = np.nonzero(filled[code >> np.uint64(64 - FILTER_BITS)] & (code > 0))[0]
                first, last = np.searchsorted(codes, code[here], "left"), np.searchsorted(codes, code[here], "right")
                here, first, count = here[last > first], first[last > first], (last - first)[last > first]
                while len(here):  # a sample that many items share is expanded PAIRS at a time
                    n = max(1, int(np.searchsorted(np.cumsum(count), PAIRS, "right")))
                    which = np.repeat(first[:n], count[:n]) + np.arange(count[:n].sum()) - np.repeat(np.cumsum(count[:n]) - count[:n], count[:n])
                    place = np.repeat(here[:n] + low, count[:n])
                    parts.append(np.stack([of[which], owner[place], place - begins[owner[place]] - at[which]], axis=1))
                    here, first, count = here[n:], first[n:], count[n:]
                    if sum(map(len, parts)) >= PAIRS:
                        yield _distinct(parts)
                        parts = []
        if parts:
            yield _distinct(parts)


def _stretches(starts: list[int], n: int, most: int) -> Iterator[tuple[int, int]]:
    """The words to verify around each start, overlapping ones as one stretch."""
    low = high = None
    for start in starts:
        a, b = max(0, start - 2 * most), max(0, start + n + 2 * most)
        if low is not None and a <= high:
            high = max(high, b)
            continue
        if low is not None:
            yield low, high
        low, high = a, b
    if low is not None:
        yield low, high


def search_all(texts: list[np.ndarray], index: Index) -> list[list[tuple[int, int, int]]]:
    """For each text (item's place in the index, distance, last word's place + 1) of each item within its distance, at its nearest place."""
    best: list[dict[int, tuple[int, int]]] = [{} for _ in texts]
    for met in _met(texts, index):
        edges = np.r_[0, np.nonzero((met[1:, :2] != met[:-1, :2]).any(axis=1))[0] + 1, len(met)]
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
            item, text = met[a, :2].tolist()
            _verify(item, met[a:b, 2].tolist(), texts[text], index, best[text])
    for item, walks in enumerate(index.walks):
        if walks == WHOLE:
            for k, text in enumerate(texts):
                found = edit_distance(index.items[item], text)
                if found[0] <= index.edits[item]:
                    best[k][item] = found
    return [sorted((item, *found) for item, found in b.items()) for b in best]


def _verify(item: int, starts: list[int], text: np.ndarray, index: Index, best: dict[int, tuple[int, int]]) -> None:
    wanted, most = index.items[item], index.edits[item]
    for low, high in _stretches(starts, len(wanted), most):
        if best.get(item, (1, 0))[0] == 0:  # starts are in order, so no other copy ends before this one
            return
        distance, end = edit_distance(wanted, text[low:high])
        if distance <= most:
            best[item] = min(best.get(item, (distance, low + end)), (distance, low + end))


def search(symbols: np.ndarray, index: Index) -> list[tuple[int, int, int]]:
    return search_all([symbols], index)[0]


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The benchmark's rows in blocks of at most about BLOCK_BYTES, streamed to the driver one after the other."""
    rows = benchmark.select(benchmark["item_id"].cast("long").alias("i"), benchmark["text"].cast("string").alias("t"))
    block, size = [], 0
    for i, t in rows.where(F.col("t").isNotNull()).distinct().toLocalIterator():
        block.append((i, t))
        size += 4 * len(t)
        if size >= BLOCK_BYTES:
            yield sorted(block, key=lambda r: (r[0] is None, r))
            block, size = [], 0
    yield sorted(block, key=lambda r: (r[0] is None, r))


def contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """docs(doc_id, text, ...), benchmark(item_id, text, ...) -> (doc_id, item_id, distance, item_words, last_word): a row for
    each document row and item that lies in it within the distance, at its nearest and first place.

    The benchmark is broadcast in blocks of bounded size and each document is searched whole, alone, without an
    exchange. Very long texts are walked and their windows verified some at a time. Null and empty texts hold nothing; items under five words are found as exact word sequences, those without a word nowhere; repeated rows of docs give
    repeated rows, those of benchmark one; empty tables give an empty result.
    """
    rows, out = texts(docs), None
    kind = id_type(rows)
    fields = f"doc_id {kind}, item_id long, distance long, item_words long, last_word long"
    schema = pa.schema([(f.split()[0], pa.binary() if f.endswith("binary") else pa.int64()) for f in fields.split(", ")])
    context = docs.sparkSession.sparkContext
    for block in _blocks(benchmark):
        shared = context.broadcast(build_index(block, similarity, recall))

        def run(batches, shared=shared):
            index = shared.value
            known = index.vocabulary.get
            for batch in batches:
                here = [np.array(list(map(known, words(t.as_py()), repeat(0))), np.int64) for t in batch.column("text")]
                rows = zip(batch.column("doc_id").to_pylist(), search_all(here, index))
                found = [(doc, index.ids[i], distance, len(index.items[i]), end) for doc, every in rows for i, distance, end in every]
                columns = list(zip(*found)) or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

        part = rows.mapInArrow(run, fields)
        out = part if out is None else out.unionByName(part)
    return out
