import shutil

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from codeloom.llm import decontaminate, jaccard, pii, queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """What each stage returns over the small documents, in order."""
    docs, out, base = spark.read.parquet(f"{SF}/documents.parquet"), [], tmp_path_factory.mktemp("stages")
    out.append(docs)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{base}/{k}")
        docs = spark.read.parquet(f"{base}/{k}")
        out.append(docs)
    return [(d.columns, d.collect()) for d in out]


def test_columns_and_shrinking(stages):
    for columns, _ in stages[1:-1]:
        assert columns == stages[0][0]
    sizes = [len(rows) for _, rows in stages]
    assert sizes[0] >= sizes[1] >= sizes[2] >= sizes[3] == sizes[4] > 0


def test_each_stage_against_brute_force(stages, spark):
    ids = [{r["doc_id"] for r in rows} for _, rows in stages[:5]]
    sets = {r["doc_id"]: jaccard.shingles((r["text"] or "").encode()) for r in stages[1][1]}
    up = {d: d for d in sets}

    def find(d):
        while up[d] != d:
            d = up[d]
        return d

    for a in sets:
        for b in sets:
            if a < b and jaccard.alike(sets[a], sets[b]):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    assert ids[2] == {d for d in sets if find(d) == d}
    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    index = decontaminate.build_index(bench)
    for r in stages[2][1]:
        import numpy as np

        symbols = np.array([index.vocabulary.get(w, 0) for w in decontaminate.words(r["text"] or "")], np.int64)
        leak = any(decontaminate.edit_distance(i, symbols)[0] <= k for i, k in zip(index.items, index.edits))
        assert (r["doc_id"] in ids[3]) == (not leak)
    before = {r["doc_id"]: r["text"] for r in stages[3][1]}
    for r in stages[4][1]:
        base = pii.base_spans(before[r["doc_id"]])
        assert r["n_chars"] == len(r["text"]) and (r["text"] != before[r["doc_id"]] or not base)
        assert not pii.base_spans(r["text"])


def test_run(spark, stages):
    assert corpus_pipeline.run(spark, SF).count() == len(stages[5][1])


def test_messy_rows(spark, messy, tmp_path):
    docs = messy.withColumn("n_chars", F.length("text").cast("long"))
    sf = str(tmp_path)
    shutil.copy(f"{SF}/benchmark.parquet", f"{sf}/benchmark.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        stage(spark, docs, sf).write.parquet(f"{sf}/{k}")
        docs = spark.read.parquet(f"{sf}/{k}")
        if name == "near_duplicates":
            assert docs.where("doc_id = 1").count() == 1 and docs.where("doc_id = 2").count() == 0
        if name != "pack":
            assert docs.columns == before.columns
    assert docs.count() > 0
    empty = messy.withColumn("n_chars", F.lit(0).cast("long")).limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf).count() == 0


def test_registered():
    names = list(queries.queries())
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "benchmark_passages", "personal_data", "pack"]
