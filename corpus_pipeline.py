"""The corpus pipeline: language, near-duplicates, benchmark passages, personal data, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept; it is written as Parquet to the
shared folder and read again. All but the last return the columns of docs. Null and repeated rows, empty texts and
further columns are handled as the operators' docstrings say; rows are told apart by a hash of doc_id and text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from codeloom.llm import decontaminate, jaccard, langid, packing, pii
from codeloom.llm.common import cut, fresh_path, keyed, table, without
from codeloom.llm.queries import tokenizer_path


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or whose text no language of the table explains, go; so do null and empty texts."""
    rows, key = keyed(docs)
    found = langid.identify_documents(rows.select(F.col(key).alias("doc_id"), "text", "lang", "source"), langid.fit(docs))
    return without(rows, key, found.where(~F.col("accepted")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts linked by five-word shingles at a similarity of 0.8 or more the document with the smallest doc_id stays, and once if it is repeated.

    Null and empty texts are one group; a null doc_id comes last.
    """
    rows, key = keyed(docs)
    groups = cut(jaccard.near_duplicates(rows.select(F.col(key).alias("doc_id"), "text")).select(F.col("doc_id").alias(key), "component_id"))
    ids = rows.select(key, "doc_id").join(groups.distinct(), key)
    first = ids.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", key)).alias("f")).select(F.col(f"f.{key}").alias(key))
    gone = groups.join(first, key, "left_anti").select(F.col(key).alias("doc_id"))
    if not groups.groupBy(key).count().where("count > 1").join(first, key, "left_semi").isEmpty():
        rows = rows.dropDuplicates([key])
    return without(rows, key, gone)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item within its edit distance go; null and empty texts hold none."""
    rows, key = keyed(docs)
    found = decontaminate.contaminated(rows.select(F.col(key).alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    return without(rows, key, found.select("doc_id"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data are replaced by their kind in brackets; n_chars follows."""
    return pii.redact_texts(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left as token pieces in sequences."""
    return packing.pack_documents(docs, tokenizer_path("byte_bpe_50k.json")).drop("loss_tokens")


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("benchmark_passages", benchmark_passages),
    ("personal_data", personal_data),
    ("pack", pack),
]
#: Near-duplicate groups, edit distances and tokenizers are beyond SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES over documents, each written and read again but the last."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = fresh_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
