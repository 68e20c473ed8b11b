"""The pipeline's stages, each on what the one before kept."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from brindle.llm import common, decontam, mixing, neardup, sharding, toxicity

from .helpers import AWKWARD, frame

SMALL = "/root/testdata/sf0.001"


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        docs = common.cut(stage(spark, before, SMALL), name)
        if i < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == list(corpus_pipeline.COLUMNS)
        ids, old = Counter(r.doc_id for r in docs.collect()), Counter(r.doc_id for r in before.collect())
        if name == "near-dedup":
            assert ids == Counter(r.doc_id for r in neardup.near_components(before).filter("kept").collect())
        if name == "decontamination":
            bad = {r.doc_id for r in decontam.find_leaks(before, spark.read.parquet(f"{SMALL}/benchmark.parquet")).collect()}
            assert ids == Counter({d: n for d, n in old.items() if d not in bad})
        if name == "mixing":
            sized = common.cut(before.withColumn("w", mixing.word_count()), "t")
            want = {r.doc_id: round(r["__mix_taken"] / r.w + 1e-9) for r in mixing.curriculum_mix(sized, "w").collect() if r["__mix_taken"]}
            assert ids == Counter({d: n for d, n in want.items() if n})
        if name == "sharding":
            assert ids == old
    assert Counter(r.doc_id for r in corpus_pipeline.run(spark, SMALL).collect()) == ids


def test_toxic_documents_go(spark):
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    model = toxicity.fit(docs, spark.read.parquet(f"{d}/labels.parquet"))
    gone = {r.doc_id for r in toxicity.score_documents(docs, model).filter("predicted = 1").collect()}
    kept = {r.doc_id for r in corpus_pipeline.drop_toxic(spark, docs, d).collect()}
    assert gone and kept == {r.doc_id for r in docs.select("doc_id").collect()} - gone


@pytest.mark.parametrize("extra", [False, True])
def test_stages_take_awkward_rows(spark, extra):
    docs, n = frame(spark, extra=extra), 0
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before, docs = docs, common.cut(stage(spark, docs, SMALL), name)
        if i < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == before.columns
        n = docs.count()
        assert {r.doc_id for r in docs.select("doc_id").collect()} <= {r[0] for r in AWKWARD}
    assert n > 0 and sorted(r.row_number for r in docs.collect()) == list(range(n))


def test_stages_take_empty_tables(spark):
    for name, stage in corpus_pipeline.STAGES:
        empty = common.cut(frame(spark, extra=False).limit(0), "empty")
        assert common.cut(stage(spark, empty, SMALL), name).count() == 0


def test_last_stage_keeps_training_order(spark):
    docs = common.cut(spark.read.parquet(f"{SMALL}/documents.parquet"), "docs")
    mixed = common.cut(mixing.repeat_taken(docs), "mixed")
    out = corpus_pipeline.shard(spark, mixed, SMALL).orderBy("row_number").collect()
    sized = common.cut(docs.withColumn("w", mixing.word_count()), "sized")
    want = [r.doc_id for r in mixing.curriculum_mix(sized, "w", each_copy=True).orderBy("__mix_position", F.md5(F.col("doc_id").cast("string"))).collect()]
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert [r.doc_id for r in out] == want and all(r.text == texts[r.doc_id] for r in out)
    assert all((r.shard, r.slot) == sharding.locate(r.row_number, len(out), 16) for r in out)
