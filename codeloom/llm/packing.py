"""Vector bin packing of token pieces into sequences under limits on tokens, segments and loss-bearing tokens."""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import small_batches
from .tokenizers import ByteBPE

#: Documents whose remainders are packed together; bounds a task's memory and the work of a placement.
BLOCK = 4096
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss_tokens long"


@dataclass(frozen=True)
class Limits:
    tokens: int = 1024
    segments: int = 128
    loss: int = 1024


def _loss(start: int, length: int, prompt: int) -> int:
    return max(0, start + length - max(start, prompt))


def _most(start: int, length: int, prompt: int, tokens: int, loss: int) -> int:
    """The longest piece from start within both limits."""
    return min(length, tokens, max(0, prompt - start) + loss)


def pack(items: list[tuple[int, int]], prompts: list[int], limits: Limits) -> list[list[tuple[int, int, int]]]:
    """items (start, length) of one document each, with the tokens before which none bears loss -> sequences of (item, start, length).

    A sequence takes the item whose demand has the greatest dot product with the room left, both as shares of
    the limits, among those that fit; once none fits whole, the best one is cut to the room. Each token of
    each item is in exactly one piece. Ties go to the earlier item.
    """
    start = np.array([s for s, _ in items], np.int64)
    length = np.array([n for _, n in items], np.int64)
    prompt = np.array(prompts, np.int64)
    alive = np.arange(len(items))
    sequences: list[list[tuple[int, int, int]]] = []
    t, m = limits.tokens, limits.loss
    while len(alive):
        tokens, segments, loss, here = t, limits.segments, m, []
        s, n, p = start[alive], length[alive], prompt[alive]
        bearing = np.maximum(0, s + n - np.maximum(s, p))
        live = np.ones(len(alive), bool)
        while tokens and segments:
            score = n * (tokens / t / t) + bearing * (loss / m / m)
            fits = live & (n <= tokens) & (bearing <= loss)
            if fits.any():
                k = int(np.argmax(np.where(fits, score, -1.0)))
                take = int(n[k])
            else:
                room = np.where(live, np.minimum(np.minimum(n, tokens), np.maximum(0, p - s) + loss), 0)
                k = int(np.argmax(room))
                take = int(room[k])
                if not take:
                    break
            here.append((int(alive[k]), int(s[k]), take))
            tokens -= take
            segments -= 1
            loss -= _loss(int(s[k]), take, int(p[k]))
            s[k] += take
            n[k] -= take
            bearing[k] = _loss(int(s[k]), int(n[k]), int(p[k]))
            live[k] = n[k] > 0
        start[alive], length[alive] = s, n
        alive = alive[live]
        sequences.append(here)
    return sequences


def _pack_block(block: list[tuple[int | None, bytes, int]], limits: Limits, next_id: int) -> tuple[pa.RecordBatch, int]:
    rows: list[tuple] = []
    items, owners, prompts = [], [], []

    def emit(k: int, start: int, length: int, sequence: int, offset: int) -> None:
        doc, ids, prompt = block[k]
        piece = memoryview(ids)[4 * start : 4 * (start + length)]
        rows.append((doc, start, length, zlib.crc32(piece), len(ids) // 4, sequence, offset, _loss(start, length, prompt)))

    for k, (_, ids, prompt) in enumerate(block):
        at, end = 0, len(ids) // 4
        while True:
            full = _most(at, end - at, prompt, limits.tokens, limits.loss)
            if full < limits.tokens or end == at:
                break
            emit(k, at, full, next_id, 0)
            next_id += 1
            at += full
        if at < end:
            items.append((at, end - at))
            owners.append(k)
            prompts.append(prompt)
    for sequence in pack(items, prompts, limits):
        offset = 0
        for item, start, length in sequence:
            emit(owners[item], start, length, next_id, offset)
            offset += length
        next_id += 1
    columns = list(zip(*rows)) or [()] * 8
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names), next_id


def pack_documents(docs: DataFrame, tokenizer_path: str, limits: Limits = Limits(), prompt_tokens: str | None = None, end_id: int = 0) -> DataFrame:
    """docs(doc_id, text, ...) -> a row for every piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, loss_tokens.

    A document is its ids and end_id. prompt_tokens names a column with how many of a document's first tokens
    bear no loss (absent or null: all tokens do). Whole sequences are cut off a document first; what is left is
    packed in blocks inside the task that read it, so nothing is exchanged, no group of rows is ever gathered,
    and a lost task is simply run again. sequence_id is the task's partition in the upper bits and a count in
    the lower 33. A null or empty text is end_id alone; null doc_ids and repeated rows are packed like others;
    an empty table gives no pieces.
    """
    prompt = F.coalesce(docs[prompt_tokens].cast("long"), F.lit(0)) if prompt_tokens else F.lit(0).cast("long")
    small_batches(docs.sparkSession)
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"), prompt.alias("prompt"))
    end = int(end_id).to_bytes(4, "little")

    def run(batches):
        encoder, block = ByteBPE(tokenizer_path), []
        next_id = TaskContext.get().partitionId() << 33
        for batch in batches:
            text = batch.column("text")
            for k, (doc, p) in enumerate(zip(batch.column("doc_id").to_pylist(), batch.column("prompt").to_pylist())):
                block.append((doc, encoder.encode(text[k].as_py()) + end, p))
                if len(block) >= BLOCK:
                    out, next_id = _pack_block(block, limits, next_id)
                    block = []
                    yield out
        if block:
            yield _pack_block(block, limits, next_id)[0]

    return rows.mapInArrow(run, SCHEMA)
