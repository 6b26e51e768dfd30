"""Registered text queries and the pipeline."""

import os
import sys

from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

import corpus_pipeline
from wearframe.llm import decontaminate, language, mixing, simhash
from wearframe.llm.common import staged, words_in


def test_registered():
    import __spark_entry__ as entry

    named = entry.queries()
    assert [n for n in range(1, 11) if not any(k.startswith(f"op{n}_") for k in named)] == [] and "pipeline" in named
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_dedup", "decontaminate", "mix", "shard"]


def test_stages_on_awkward_documents(spark, data, awkward_docs, no_docs):
    for start in (awkward_docs, no_docs):
        docs = start
        for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
            docs = staged(stage(spark, docs, data), f"test-{name}")
            assert docs.columns[: len(start.columns) - 2] == [c for c in start.columns if c not in ("shard", "slot")][: len(start.columns) - 2] or i < 4 and docs.columns == start.columns
        assert (docs.count() > 0) == (start is awkward_docs)


def test_each_stage_takes_effect(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, staged(stage(spark, docs, data), f"effect-{name}")
        seen[name] = (before, docs)
    before, after = seen["language"]
    wanted = language.identify(before).filter((F.col("lang_pred") != "und") & (F.col("score") >= 0.4)).select("doc_id")
    assert sorted(after.select("doc_id").collect()) == sorted(wanted.collect())
    before, after = seen["near_dedup"]
    assert sorted(r.doc_id for r in after.collect()) == sorted(r.component_id for r in simhash.mark_near_copies(before).select("component_id").distinct().collect())
    before, after = seen["decontaminate"]
    leaks = decontaminate.find_leaks(before, spark.read.parquet(f"{data}/benchmark.parquet"))
    assert sorted(r.doc_id for r in after.collect()) == sorted(r.doc_id for r in leaks.filter("leak.n_hit = 0").collect())
    before, after = seen["mix"]
    mixed = mixing.mix(before, words_in(F.col("text"))).filter("copies > 0")
    assert {(r.doc_id, r["count"]) for r in after.groupBy("doc_id").count().collect()} == {(r.doc_id, r.copies) for r in mixed.collect()}
    before, after = seen["shard"]
    assert after.count() == before.count() and after.groupBy("shard").agg((F.max("slot") + 1 == F.count("slot")).alias("ok")).filter("not ok").count() == 0
