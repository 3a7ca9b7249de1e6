"""Batch classification by a ledger of shards: a run stopped part way goes on without doing a shard twice."""

import tempfile

import pytest

from commitgauge.operators import batches, bayes

TRAIN = [("cheap pills buy now", "spam"), ("meeting at noon today", "ham"), ("buy cheap watches", "spam"),
         ("lunch with the team", "ham"), ("win money now", "spam"), ("notes from the meeting", "ham")]


class Stop(Exception):
    pass


def test_a_stopped_run_goes_on_and_agrees_with_one_pass(spark):
    model = bayes.train_naive_bayes(spark.createDataFrame(TRAIN, "text string, label string"))
    rows = [(i, f"{'cheap buy' if i % 3 else 'team meeting'} {i}") for i in range(300)]
    rows += [(7, "a second text of id seven about money"), (7, "a second text of id seven about money"), (None, "no id, cheap")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    folder = tempfile.mkdtemp(prefix="ledger-")
    done = []

    def stop_after_two(g):
        done.append(g)
        if len(done) == 2:
            raise Stop

    with pytest.raises(Stop):
        batches.classify_in_shards(model, docs, "doc_id", folder, shards=16, per_job=4, after_group=stop_after_two)
    again = []
    found = batches.classify_in_shards(model, docs, "doc_id", folder, shards=16, per_job=4, after_group=again.append)
    assert sorted(done + again) == [0, 1, 2, 3] and not set(done) & set(again)
    got = sorted(((r.doc_id is None, r.doc_id or 0), r.text_sha256, r.predicted) for r in found.collect())
    assert len(got) == 302  # id 7 twice (two texts), the repeated row once, the row without id kept
    unique = spark.createDataFrame([r for r in rows if r[0] != 7 and r[0] is not None], docs.schema)
    plain = {r.doc_id: r.predicted for r in bayes.classify(model, unique, "doc_id").collect()}
    mine = {k[1]: p for k, _, p in got if not k[0] and k[1] != 7}
    assert mine == plain


def test_an_empty_table_gives_no_rows(spark):
    model = bayes.train_naive_bayes(spark.createDataFrame(TRAIN, "text string, label string"))
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert batches.classify_in_shards(model, empty, "doc_id", tempfile.mkdtemp(prefix="ledger-"), shards=4, per_job=2).count() == 0


def test_the_model_is_trained_once_and_kept(spark, monkeypatch):
    """Every group classifies with the stored model: no group's plan trains it again, nor does a rerun."""
    examples = spark.createDataFrame(TRAIN, "text string, label string")
    docs = spark.createDataFrame([(i, "cheap buy" if i % 3 else "team meeting") for i in range(40)], "doc_id long, text string")
    folder, plain, plans = tempfile.mkdtemp(prefix="ledger-"), bayes.classify, []

    def seen(model, *rest):
        plans.append(model._jdf.queryExecution().optimizedPlan().toString())
        return plain(model, *rest)

    monkeypatch.setattr(bayes, "classify", seen)
    model = bayes.train_naive_bayes(examples)
    found = batches.classify_in_shards(model, docs, "doc_id", folder, shards=4, per_job=2)
    assert {(r.doc_id, r.predicted) for r in found.collect()} == {(r.doc_id, r.predicted) for r in plain(model, docs, "doc_id").collect()}
    assert len(plans) == 2 and not [p for p in plans if "Aggregate" in p]
    assert spark.read.parquet(f"{folder}/model").count() == model.count()
