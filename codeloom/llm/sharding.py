"""Histogram sort: splitters refined by exact byte counts until shards are near equal, then one exchange."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import cut

#: A splitter settles once the bytes below it are this share of a shard from its target.
TOLERANCE = 0.002
#: Bits of the key that one round of probes resolves.
FIRST_BITS, NEXT_BITS = 12, 8
#: Rows that one task numbers at most on average.
ROWS_A_TASK = 100_000
#: Ranges of the key that rows are numbered in, as bits, at most.
RANGE_BITS = 16
_TOP = -(1 << 63)


def _unsigned(signed: int) -> int:
    return signed & (2**64 - 1)


def _signed(unsigned: int) -> int:
    return unsigned - (1 << 64) if unsigned >> 63 else unsigned


def _probe(keys: DataFrame, key: Column, prefixes: list[int], known: int, bits: int) -> dict[int, tuple[int, int, int, int]]:
    """Exact (bytes, rows, least key, greatest key) of each prefix of known + bits bits whose first known bits are in prefixes."""
    if known:
        keys = keys.where(F.shiftrightunsigned(key, 64 - known).isin([_signed(p) for p in prefixes]))
    flipped = key.bitwiseXOR(F.lit(_TOP))
    counted = keys.groupBy(F.shiftrightunsigned(key, 64 - known - bits).alias("prefix")).agg(
        F.sum("size").alias("bytes"), F.count("*").alias("rows"), F.min(flipped).alias("least"), F.max(flipped).alias("most")
    )
    return {_unsigned(r["prefix"]): (r["bytes"], r["rows"], _unsigned(r["least"] ^ _TOP), _unsigned(r["most"] ^ _TOP)) for r in counted.collect()}


def _refine(keys: DataFrame, key: Column, targets: dict[int, tuple[int, int]], slack: int) -> dict[int, tuple[int, int | None, int]]:
    """For each target of (bytes wanted below, bytes already below): (boundary from which keys lie above, None or
    the crowded key that the target falls in, bytes below the boundary).

    Each round counts bytes below evenly spaced probes in every open splitter's interval: at most 2**12 rows
    in the first round and 2**8 for each splitter in later ones reach the driver, whatever the input.
    """
    settled: dict[int, tuple[int, int | None, int]] = {}
    open_at = {k: (0, below) for k, (_, below) in targets.items()}
    known, bits = 0, FIRST_BITS
    while open_at:
        found = _probe(keys, key, sorted({p for p, _ in open_at.values()}), known, bits)
        ordered = sorted(found)
        for k, (prefix, below) in list(open_at.items()):
            want = targets[k][0]
            settled[k] = ((prefix + 1) << (64 - known), None, below)  # unless a probe reaches the target
            for q in ordered:
                if q >> bits != prefix:
                    continue
                size, rows, least, most = found[q]
                after = below + size
                if after < want:
                    below = after
                    settled[k] = ((prefix + 1) << (64 - known), None, below)
                    continue
                if want - below <= min(slack, after - want) or rows == 1 and want - below <= after - want:
                    settled[k] = (least, None, below)
                elif after - want <= slack or rows == 1:
                    settled[k] = (most + 1, None, after)
                elif least == most:
                    settled[k] = (least, least, below)
                else:
                    open_at[k] = (q, below)
                    del settled[k]
                break
            if k in settled:
                del open_at[k]
        known += bits
        bits = min(NEXT_BITS, 64 - known)
    return settled


def splitters(keys: DataFrame, shards: int, tolerance: float = TOLERANCE) -> list[tuple[int, int]]:
    """keys(h, doc_id, size) -> shards - 1 boundaries (h, doc_id): a row belongs above those that it isn't below.

    h is compared unsigned, doc_id as a signed long with null first. A boundary between equal h is only made
    where a group of equal texts is larger than the tolerance allows to keep whole.
    """
    total = keys.agg(F.sum("size").alias("s")).first()["s"] or 0
    slack = int(total / shards * tolerance)
    wanted = {k: (total * k // shards, 0) for k in range(1, shards)}
    first = _refine(keys, F.col("h"), wanted, slack)
    inside: dict[int, list[int]] = {}
    for k, (_, at, _) in first.items():
        if at is not None:
            inside.setdefault(at, []).append(k)
    out = {k: (low, _TOP) for k, (low, at, _) in first.items() if at is None}
    for h, ks in inside.items():
        group = keys.where(F.col("h") == _signed(h))
        order = F.coalesce("doc_id", F.lit(_TOP)).bitwiseXOR(F.lit(_TOP))
        second = _refine(group, order, {k: (wanted[k][0], first[k][2]) for k in ks}, slack)
        for k, (low, at, _) in second.items():
            out[k] = (h + 1, _TOP) if low >> 64 else (h, _signed(low ^ (1 << 63)))
    return [out[k] for k in range(1, shards)]


def _shard(bounds: list[tuple[int, int]]) -> Column:
    """The number of boundaries that a row isn't below, as nested comparisons in generated code."""
    h = F.col("h").bitwiseXOR(F.lit(_TOP))
    doc = F.coalesce("doc_id", F.lit(_TOP))
    shard = F.lit(0)
    for low, at in bounds:
        if low >> 64:
            continue
        limit = F.lit(_signed(low ^ (1 << 63)))
        shard = shard + F.when((h > limit) | ((h == limit) & (doc >= F.lit(at))), 1).otherwise(0)
    return shard.cast("int")


def shard_rows(rows: DataFrame, shards: int, tolerance: float = TOLERANCE, rows_a_task: int = ROWS_A_TASK) -> DataFrame:
    """rows(h long, doc_id long, size long, ...) -> rows with shard int and slot long, sizes near equal over shards.

    Histogram sort on the key (h, doc_id): splitters are refined by exact counts, then rows are exchanged
    once, to ranges of the key far smaller than a shard, and numbered there; slots follow the key except
    inside a range that is split further by its count. Rows that repeat doc_id, text and size share a salt. Slots of a shard run
    gapless from 0. Empty input gives an empty result; null doc_ids sort first; repeated rows each get a slot of their own.
    """
    bounds = splitters(rows, shards, tolerance)
    n = rows.count()
    bits = max(1, min(RANGE_BITS, (max(1, n // rows_a_task) * 8).bit_length()))
    ranged = rows.withColumn("shard", _shard(bounds)).withColumn("range", F.shiftrightunsigned("h", 64 - bits))
    # A range of many rows is split by its own count, so that no task numbers many more than rows_a_task. At most 2**RANGE_BITS ranges.
    ranges = ranged.groupBy("range").count().where(F.col("count") > 4 * rows_a_task)
    ranges = cut(ranges.select("range", F.ceil(F.col("count") / rows_a_task).cast("long").alias("salts")))
    salt = F.when(F.col("salts").isNull(), 0).otherwise(F.pmod(F.xxhash64("doc_id", "h", "size"), F.col("salts"))).cast("long")
    ranged = ranged.join(F.broadcast(ranges), "range", "left").withColumn("salt", salt).drop("salts")
    # shards, ranges and salts: a table of counts, a row for some rows_a_task rows or range, not for each row
    counts = ranged.groupBy("shard", "range", "salt").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("range", "salt").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("shard", "range", "salt", F.coalesce(before, F.lit(0)).alias("offset"))
    inside = Window.partitionBy("shard", "range", "salt").orderBy(F.col("h").bitwiseXOR(F.lit(_TOP)), "doc_id", "size")
    numbered = ranged.withColumn("within", F.row_number().over(inside))
    return numbered.join(offsets, ["shard", "range", "salt"]).withColumn("slot", (F.col("offset") + F.col("within") - 1).cast("long")).drop("range", "salt", "within", "offset")


def histogram_shards(docs: DataFrame, shards: int = 24, tolerance: float = TOLERANCE) -> DataFrame:
    """docs(doc_id, text, ...) -> (doc_id, size, text_crc32, h, shard, slot): every row in one of shards shards.

    size is the text's UTF-8 bytes plus 8 (null text: 8). The key's first part is a hash of the text, so
    equal texts stay neighbours and a shard boundary only parts them where the tolerance leaves no choice. Texts of any length
    count by their bytes alone; an empty table gives an empty result.
    """
    text = docs["text"].cast("string")
    keys = docs.select(
        F.xxhash64(text).alias("h"),
        docs["doc_id"].cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
    )
    return shard_rows(cut(keys), shards, tolerance).select("doc_id", "size", "text_crc32", "h", "shard", "slot")
