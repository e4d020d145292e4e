"""Token counts through a digest cache: only distinct contents that the cache lacks are encoded."""

from __future__ import annotations

import pyarrow as pa
import zstandard
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import cut, texts
from .tokenizers import PieceCounter, file_digest

CACHE_SCHEMA = "digest binary, n_tokens long, tokenizer string"
LIMIT = 4096
#: Digests of misses that are broadcast at most (32 bytes each).
BROADCAST_DIGESTS = 30_000


def read_cache(spark: SparkSession, path: str, tokenizer: str) -> DataFrame:
    """(digest, n_tokens) of one tokenizer version; an absent cache is empty, twice stored counts are one."""
    try:
        stored = spark.read.schema(CACHE_SCHEMA).parquet(path)
    except AnalysisException as absent:
        if "PATH_NOT_FOUND" not in str(absent):
            raise
        stored = spark.createDataFrame([], CACHE_SCHEMA)
    return stored.where(F.col("tokenizer") == tokenizer).groupBy("digest").agg(F.min("n_tokens").alias("n_tokens"))


def _first_of_task(batches):
    """Each content once for each task, compressed for the exchange."""
    seen, pack = set(), zstandard.ZstdCompressor(level=1)
    for batch in batches:
        keep, packed = [], []
        digests = batch.column("digest").to_pylist()
        for k, digest in enumerate(digests):
            if digest not in seen:
                seen.add(digest)
                keep.append(digest)
                packed.append(pack.compress(batch.column("text")[k].as_py().encode()))
        yield pa.RecordBatch.from_arrays([pa.array(keep, pa.binary()), pa.array(packed, pa.binary())], names=["digest", "packed"])


def count_tokens(docs: DataFrame, model_path: str, cache_path: str, limit: int = LIMIT) -> DataFrame:
    """docs(doc_id, text, ...) -> (doc_id, n_bytes, n_tokens, over_limit), a row for every row of docs.

    A content's digest is the SHA-256 of its UTF-8 bytes, null as empty; nothing else is normalised, for any
    other change could change the count. The tokenizer's version is the digest of its model file. Digests that
    the cache at cache_path lacks are encoded once each and appended to it; then counts are joined to rows.
    A warm cache costs an exchange of digests, not of texts. Copies cross the exchange at most once a task, so a content that fills a third of the table is no hot spot
    there, and the last join is one that adaptive execution splits. Repeated rows stay repeated; an empty
    table gives an empty result.
    """
    spark, version = docs.sparkSession, file_digest(model_path)
    rows = texts(docs).withColumn("digest", F.unhex(F.sha2(F.col("text"), 256)))
    keys = cut(rows.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "digest"))
    absent = cut(keys.select("digest").distinct().join(read_cache(spark, cache_path, version).select("digest"), "digest", "left_anti"))
    few = absent.limit(BROADCAST_DIGESTS + 1).count() <= BROADCAST_DIGESTS
    # digests alone are looked up; then only texts that lack a count move: where the misses are few, none but theirs
    contents = rows.join(F.broadcast(absent), "digest", "left_semi") if few else rows
    contents = contents.select("digest", "text").mapInArrow(_first_of_task, "digest binary, packed binary").repartition("digest")
    misses = contents if few else contents.join(absent, "digest", "left_semi")

    def encode(batches):
        seen, counter, unpack = set(), PieceCounter(model_path), zstandard.ZstdDecompressor()
        for batch in batches:
            keep, counts = [], []
            packed = batch.column("packed")
            for k, digest in enumerate(batch.column("digest").to_pylist()):
                if digest not in seen:
                    seen.add(digest)
                    keep.append(digest)
                    counts.append(counter.count(unpack.decompress(packed[k].as_py()).decode()))
            yield pa.RecordBatch.from_arrays([pa.array(keep, pa.binary()), pa.array(counts, pa.int64())], names=["digest", "n_tokens"])

    counted = misses.mapInArrow(encode, "digest binary, n_tokens long")
    counted.withColumn("tokenizer", F.lit(version)).write.mode("append").parquet(cache_path)
    found = keys.join(read_cache(spark, cache_path, version), "digest")
    return found.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
