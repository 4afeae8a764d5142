"""The pipeline on small tables: stage by stage against plain versions."""

from __future__ import annotations

import hashlib
import math
import os
from collections import Counter

import pytest
from brute import leaks, near_groups
from pyspark.sql import functions as F
from test_operators import DOCS, docs, prose

import corpus_pipeline
from textquarry.llm import mixing, sharding
from textquarry.llm.common import shared_folder

WORDS = "the of and with that in for was which there their have been said"


def sentence(seed: int, n: int) -> str:
    import random

    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS.split()) + rng.choice(["ing", "er", "tion", ""]) + rng.choice(["", "ly", "able", "ness", "ist", "or"]) for _ in range(n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("tables"))
    item = sentence(1, 25)
    rows = [(i, sentence(100 + i, 60), "en", f"src{i % 3}") for i in range(40)]
    rows += [(50, rows[3][1], "en", "src0"), (51, rows[4][1] + " extra", "en", "src0"), (52, item + " tail", "en", "src1"), (53, sentence(7, 80) + " " + item, "en", "src2"), (54, None, "en", "src0"), (55, "", "en", None), (56, "123 456", "en", "src0"), (None, sentence(8, 50), None, "src1")]
    docs(spark, rows).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at


def test_stages(spark, folder):
    start = spark.read.parquet(f"{folder}/documents.parquet")
    now, seen = start, {}
    for name, stage in corpus_pipeline.STAGES:
        before = now.collect()
        now = stage(spark, now, folder)
        seen[name] = (before, now.collect())
        now = spark.createDataFrame(seen[name][1], now.schema)
        if name != "shard":
            assert now.columns == start.columns
    before, after = seen["language_id"]
    assert {r.doc_id for r in before} - {r.doc_id for r in after} == {54, 55, 56}
    before, after = seen["near_dedup"]
    rows = [(r.doc_id, r.text) for r in before]
    want = {rows[i][0] for g in near_groups(rows) for i in g} - {min(rows[i][0] for i in g) for g in near_groups(rows)}
    assert {r.doc_id for r in before} - {r.doc_id for r in after} == want and want >= {50, 51}
    before, after = seen["decontaminate"]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    assert {r.doc_id for r in before} - {r.doc_id for r in after} == {52}
    assert not any(leaks(r.text, items) for r in after)
    before, after = seen["mix"]
    assert {r.doc_id for r in after} <= {r.doc_id for r in before} and max(Counter(r.doc_id for r in after).values()) <= 3
    before, after = seen["shard"]
    assert len(before) == len(after) and {r.shard for r in after} <= set(sharding.SHARDS)


def test_run_gives_what_the_stages_give(spark, folder):
    now = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        now = spark.createDataFrame(stage(spark, now, folder).collect(), stage(spark, now, folder).schema)
    assert Counter(map(tuple, corpus_pipeline.run(spark, folder).collect())) == Counter(map(tuple, now.collect()))


def test_run_leaves_only_its_result(spark, folder):
    def written() -> set[str]:
        return {x for x in os.listdir(shared_folder(spark)) if os.listdir(f"{shared_folder(spark)}/{x}")}

    before = written()
    out = corpus_pipeline.run(spark, folder)
    (left,) = written() - before
    assert out.count() > 0 and [x for x in os.listdir(f"{shared_folder(spark)}/{left}") if not x.startswith(".")] == [str(len(corpus_pipeline.STAGES))]


def test_mix_and_shard_stages_by_hand(spark, folder):
    """Copies and shards of every row as plain Python computes them."""
    rows = spark.read.parquet(f"{folder}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    docs_ = rows.collect()

    def unit(*parts: str) -> float:
        return (int(hashlib.md5("|".join(parts).encode()).hexdigest()[:13], 16) + 0.5) / 2**52

    sizes = Counter()
    for r in docs_:
        sizes[r.source] += len(r.text or "")
    weights = {s: mixing.WEIGHTS.get(s, mixing.DEFAULT_WEIGHT) for s in sizes if sizes[s]}
    total, clamped, cap = mixing.BUDGET * sum(sizes.values()), set(), mixing.MAX_EPOCHS
    while True:
        free = [s for s in weights if s not in clamped]
        left = total - sum(cap * sizes[s] for s in clamped)
        epochs = {s: left * weights[s] / sum(weights[x] for x in free) / sizes[s] for s in free}
        over = {s for s in free if epochs[s] > cap}
        if not over:
            break
        clamped |= over
    epochs |= dict.fromkeys(clamped, cap) | {s: 1.0 for s in sizes if not sizes[s]}
    name = lambda r: "\\N" if r.doc_id is None else str(r.doc_id)
    want = Counter()
    for r in docs_:
        n = int(epochs[r.source]) + (unit(str(mixing.SEED), name(r)) < epochs[r.source] % 1)
        want[tuple(r)] += n
    assert Counter(map(tuple, stages["mix"](spark, rows, folder).collect())) == +want
    best = lambda r: min((-math.log(unit("0", str(k), name(r))) / w, k) for k, w in sharding.SHARDS.items())[1]
    assert Counter(map(tuple, stages["shard"](spark, rows, folder).collect())) == Counter((*r, best(r)) for r in docs_)


#: Rows that each stage keeps of the awkward table below, by number of the row.
AWKWARD = {"language_id": {3}, "near_dedup": {0, 1, 2, 3}, "decontaminate": {0, 1, 2, 3}, "mix": {0, 1, 2, 3}, "shard": {0, 1, 2, 3}}


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stage_on_empty_and_awkward_tables(spark, folder, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    assert stage(spark, spark.createDataFrame([], DOCS), folder).collect() == []
    rows = [(None,) * 5] * 2 + [(1, "", None, None, None), (2, prose(1, 50_000), "en", None, None)]
    out = stage(spark, spark.createDataFrame(rows, DOCS).withColumn("cid", F.lit(1)).withColumn("shard", F.lit(2)), folder)
    found = out.drop("shard", "cid").collect()
    assert Counter(map(tuple, found)) == Counter(rows[i] for i in AWKWARD[name]) and "cid" in out.columns and "shard" in out.columns
