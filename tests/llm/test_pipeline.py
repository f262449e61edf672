import os
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from test_buckets import tokens
from test_minhash import brute, near_copies
from test_mixing import targets
from transitlake.llm.common import materialize, on_workers, table

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """The output of each stage, from the pipeline's own functions."""
    docs, out = table(spark, SF, "documents"), {}
    out["documents"] = docs
    for name, stage in corpus_pipeline.STAGES:
        docs = out[name] = materialize(stage(spark, docs, SF), f"test-{name}")
    return out


def test_stages_keep_the_columns_and_each_takes_effect(spark, stages):
    names = list(stages)
    for name in names[:-1]:
        assert stages[name].schema.simpleString() == stages["documents"].schema.simpleString()
    n = {k: v.count() for k, v in stages.items()}
    assert n["quality"] < n["documents"] and n["near-dup"] < n["quality"] and n["secrets"] == n["near-dup"] and n["packing"] >= n["mixing"]
    assert stages["near-dup"].exceptAll(stages["quality"]).count() == stages["quality"].exceptAll(stages["documents"]).count() == 0


def test_quality_rejects_what_is_labelled_low(spark, stages):
    labels = {r["doc_id"]: r["quality"] for r in table(spark, SF, "labels").collect()}
    kept = {r["doc_id"] for r in stages["quality"].collect()}
    right = [(d in kept) == (q == 1) for d, q in labels.items()]
    assert np.mean(right) > 0.9


def test_near_duplicates_against_brute_force(stages):
    before = sorted((r["doc_id"], r["text"]) for r in stages["quality"].collect())
    want = set(brute(before)[0].values())
    assert len(want ^ {r["doc_id"] for r in stages["near-dup"].collect()}) <= 2


def test_mixing_takes_each_source_near_its_target(stages):
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    before, after = stages["secrets"].collect(), stages["mixing"].collect()
    sources = sorted({r["source"] for r in before})
    size, taken = Counter(), Counter()
    for r in before:
        size[r["source"]] += words(r["text"])
    for r in after:
        taken[r["source"]] += words(r["text"])
    goal = targets([size[s] for s in sources], [i % 3 + 1 for i in range(len(sources))])
    for s, t in zip(sources, goal):
        assert abs(taken[s] - t) <= max(30, 0.05 * t)
    assert max(Counter(r["doc_id"] for r in after).values()) <= 3
    assert {tuple(r) for r in after} <= {tuple(r) for r in before}


def test_packing_keeps_every_token(stages):
    want = Counter()
    for r in stages["mixing"].collect():
        want[r["doc_id"]] += tokens(r["text"])
    got = Counter()
    for r in stages["packing"].collect():
        got[r["doc_id"]] += r["length"]
    assert got == want


def test_nulls_repeats_and_extra_columns(spark):
    on_workers(spark)
    rows = [(i, t, "en", "s%d" % (i % 3), len(t), 7) for i, t in near_copies()[:60]]
    rows += [rows[0], (None, None, None, None, None, None), (900, "", "en", None, 0, 1), (901, "key token=abcdefghij0 " * 3, None, "s1", 5, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, size int")
    for name, stage in corpus_pipeline.STAGES[1:]:
        before, docs = docs, materialize(stage(spark, docs, SF), f"test-{name}")
        if name != "packing":
            assert docs.schema.simpleString() == before.schema.simpleString()
        if name == "secrets":
            assert docs.count() == before.count() and docs.where(F.col("text").contains("abcdefghij0")).count() == 0
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES:
        empty = materialize(stage(spark, empty, SF), f"test-{name}")
        assert empty.count() == 0


def test_run_is_the_stages_one_after_the_other(spark, stages):
    got = corpus_pipeline.run(spark, SF)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, stages["packing"].collect()))


def test_a_query_built_before_a_pipeline_run_still_reads(spark, stages):
    from transitlake.llm.registry import op9_secret_scan
    before = op9_secret_scan(spark, SF)
    docs = table(spark, SF, "documents").limit(20)
    for _, stage in corpus_pipeline.STAGES[1:]:
        docs = materialize(stage(spark, docs, SF), "test-run")
    assert before.count() == table(spark, SF, "documents").count()


def test_a_stage_deletes_the_tables_of_the_one_before(spark, tmp_path):
    docs = table(spark, SF, "documents")
    corpus_pipeline.STAGES[2][1](spark, docs, SF).count()
    left = corpus_pipeline._LEFT[spark.sparkContext.applicationId]
    assert left and all(os.path.exists(p.removeprefix("file:")) for p in left)
    corpus_pipeline.STAGES[4][1](spark, docs, SF).count()
    assert not any(os.path.exists(p.removeprefix("file:")) for p in left)


@pytest.mark.parametrize("name", ["spans", "blob", "text_", "row", "ids", "h", "pos", "copies", "skey"])
def test_columns_of_any_name_pass_through(spark, name):
    on_workers(spark)
    rows = [(1, "plain words here " * 3, "en", "s", 5, 11), (2, "password: hunter2222 and more", "en", "s", 9, 12), (3, None, None, None, None, 13)]
    docs = spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, n_chars long, {name} int")
    for step, stage in corpus_pipeline.STAGES[2:4]:
        out = materialize(stage(spark, docs, SF), "test-names")
        assert out.columns == docs.columns and {(r["doc_id"], r[name]) for r in out.collect()} <= {(1, 11), (2, 12), (3, 13)}
        if step == "secrets":
            assert {r["doc_id"]: r["text"] for r in out.collect()} == {1: rows[0][1], 2: "[SECRET] and more", 3: None}
