"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import decontaminate, langid, media, packing, pii, sharding, simhash, substring_dedup, suffix_dedup, token_counts
from .common import fresh_path, table


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"), fresh_path(spark, "token-counts"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.remove_repeated_bytes(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_features(table(spark, sf_dir, "documents"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.remove_repeated_words(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify_pages(table(spark, sf_dir, "pages"), langid.fit(table(spark, sf_dir, "documents")))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.histogram_shards(table(spark, sf_dir, "documents"), 24)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(table(spark, sf_dir, "documents")).drop("redacted")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json")).drop("loss_tokens")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_simhash": op1_simhash,
        "op2_token_counts": op2_token_counts,
        "op3_suffix_dedup": op3_suffix_dedup,
        "op4_decontamination": op4_decontamination,
        "op5_media": op5_media,
        "op6_substring_dedup": op6_substring_dedup,
        "op7_language_id": op7_language_id,
        "op8_sharding": op8_sharding,
        "op9_personal_data": op9_personal_data,
        "op10_packing": op10_packing,
    }


#: Every byte or word of every window, without anchors, sketches or buckets: for tables small enough.
OP3_SQL = """WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
win AS (SELECT doc_id, i, array_slice(b, i, i + 99) AS s FROM (SELECT doc_id, b, unnest(range(1, octet_length(b) - 98)) AS i FROM d)),
ranked AS (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS k FROM win),
cover AS (SELECT DISTINCT doc_id, unnest(range(i, i + 100)) AS p FROM ranked WHERE k > 1),
span AS (SELECT doc_id, count(*) AS n_removed, count(*) FILTER (p - last > 1 OR last IS NULL) AS n_spans FROM (SELECT doc_id, p, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS last FROM cover) GROUP BY doc_id),
byte AS (SELECT doc_id, p, substring(h, 2 * p - 1, 2) AS x FROM (SELECT doc_id, hex(b) AS h, unnest(range(1, octet_length(b) + 1)) AS p FROM d WHERE doc_id IN (SELECT doc_id FROM cover))),
kept AS (SELECT doc_id, string_agg(x, '' ORDER BY p) AS h FROM byte ANTI JOIN cover USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, octet_length(b) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
CASE WHEN span.doc_id IS NULL THEN sha256(b) ELSE sha256(unhex(coalesce(h, ''))) END AS kept_sha256
FROM d LEFT JOIN span ON span.doc_id = d.doc_id LEFT JOIN kept ON kept.doc_id = d.doc_id"""

OP6_SQL = r"""WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 49], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d)),
first AS (SELECT s, min(doc_id) AS m FROM win GROUP BY s),
cover AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM win JOIN first USING (s) WHERE m < doc_id),
word AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS x FROM d),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS t FROM word ANTI JOIN cover USING (doc_id, p) GROUP BY doc_id),
gone AS (SELECT doc_id, count(*) AS n FROM cover GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(gone.n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept ON kept.doc_id = d.doc_id LEFT JOIN gone ON gone.doc_id = d.doc_id"""


def oracle_sql() -> dict[str, str]:
    """The others need hashes, tokenizers, codecs, fitted models or splitters that SQL has not: tests/llm checks them."""
    return {"op3_suffix_dedup": OP3_SQL, "op6_substring_dedup": OP6_SQL}
