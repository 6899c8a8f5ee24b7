"""Inputs on which an operator once did less than the whole job."""

import random

from pyspark.sql import functions as F

from evalspark.llm import mixing, repeats, suffixdedup


def test_hot_windows_are_combined(spark, monkeypatch):
    """A footer in ever new surroundings: each of its windows is one place, not one per document."""
    monkeypatch.setattr(repeats, "HOT_KEY", 1)
    rng = random.Random(3)
    make = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    footer = make(150)
    texts = [make(150) + footer + make(150) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    kind = suffixdedup.kind()
    work = repeats.work_table(kind, docs, repeats.flagged(repeats.sketch(kind, docs, spark)), spark)
    found = repeats.segments(kind, work.withColumn("tid", F.xxhash64("cid")))
    alone, sharded = repeats.dealt(kind, found, 3000)
    windows = alone.agg(F.sum("size")).first()[0] + (sharded.agg(F.sum("size")).first()[0] or 0)
    different = {bytes(r.segment[j : j + 100]) for r in found.collect() for j in range(r["size"])}
    assert windows == len(different)
    got = {r.doc_id: (r.n_removed, r.kept_sha256) for r in suffixdedup.suffix_dedup(docs).collect()}
    seen: set = set()
    for i, text in enumerate(texts):
        gone = [False] * len(text)
        for a in range(len(text) - 99):
            w = text[a : a + 100]
            if w in seen:
                gone[a : a + 100] = [True] * 100
            seen.add(w)
        assert got[i][0] == sum(gone)
    assert got[0][0] == 0 and got[1][0] >= 150


def test_gap_is_filled_from_later_blocks(spark):
    """One document of half the source: what it leaves open is filled by short ones elsewhere."""
    short = [(i, "a", "w " * (5 + i % 7)) for i in range(1, 200)]
    for long in (700, 701, 702, 703):
        docs = spark.createDataFrame([(0, "a", "w " * long), *short], "doc_id bigint, source string, text string")
        plan = mixing.mix_plan(docs, total=0.4, block_words=300, shard_words=300).drop("text").collect()
        gap = plan[0].target - sum(r.taken for r in plan)
        assert -1 <= gap < min(r["size"] for r in plan if not r.taken) + 1
        assert all(r.taken in (0, r["size"]) and len(r.shards) * r["size"] == r.taken for r in plan)
        assert len({s for r in plan for s in r.shards}) <= 4


def test_gap_takes_several_steps(spark):
    """Documents of ever smaller size, most of them too long for what is left."""
    rng = random.Random(8)
    rows = [(i, "ab"[i % 2], "w " * max(1, int(1000 * rng.random() ** 6))) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, text string")
    plan = mixing.mix_plan(docs, total=0.7, block_words=200, shard_words=2000, seed="s").drop("text").collect()
    for s in "ab":
        mine = [r for r in plan if r.source == s]
        gap = mine[0].target - sum(r.taken for r in mine)
        missing = [r["size"] for r in mine if r.taken % (2 * r["size"]) == 0]
        assert -1 <= gap and (not missing or gap < min(missing) + 1)
        assert all(len(r.shards) * r["size"] == r.taken for r in mine)
