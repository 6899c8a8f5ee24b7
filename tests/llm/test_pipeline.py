"""The pipeline on the smallest tables: each stage keeps what its own operator leaves."""

import os
import re

import pytest

import corpus_pipeline
from evalspark.llm import decontaminate, suffixdedup
from evalspark.session import stage

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test data not here")


def shingled(text) -> set:
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def alike(a: set, b: set) -> bool:
    return 10 * len(a & b) >= 8 * len(a | b)


def test_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, before = docs.columns, docs
    for name, function in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, stage(function(spark, docs, FOLDER), spark)
        assert docs.columns == columns and docs.count() <= before.count(), name
        assert docs.count() == docs.select("doc_id").distinct().count() > 0
        if name == "near_dedup":
            # No two that stay are similar, and each that went hangs on one that stayed by its texts.
            texts = {r.doc_id: shingled(r.text) for r in before.collect()}
            kept = {r.doc_id for r in docs.collect()}
            assert not [1 for a in kept for b in kept if a < b and alike(texts[a], texts[b])]
            assert all(any(alike(texts[d], texts[o]) for o in texts if o < d) for d in set(texts) - kept)
        if name == "repeats":
            told = suffixdedup.suffix_dedup(before)
            assert docs.count() == told.filter("n_removed < n_bytes OR n_bytes = 0").count()
        if name == "decontamination":
            clean = decontaminate.report(before, spark.read.parquet(f"{FOLDER}/benchmark.parquet")).filter("NOT contaminated")
            same = before.join(clean.select("doc_id"), "doc_id").select("doc_id", "text").exceptAll(docs.select("doc_id", "text"))
            assert same.count() == 0
    last = corpus_pipeline.run(spark, FOLDER).select("doc_id", "size", "taken").collect()
    assert {r.doc_id for r in last} == {r.doc_id for r in docs.collect()}
    assert all(r.taken in (0, r.size, 2 * r.size) for r in last)
