"""Hand-made labels and their comparison with predictions."""

import hashlib

import pytest

from commitgauge import fixed_values as V
from commitgauge.operators import labels, sampling


def compared(spark, rows):
    """(label category, model category, label feature, model feature, label comp, model comp)"""
    gold = [(str(i), r[0], "False", r[2], r[4]) for i, r in enumerate(rows)]
    model = [(str(i), r[1], "FALSE", r[3], r[5]) for i, r in enumerate(rows)]
    names = "category", "is_security", "is_feature", "complexity"

    def frame(data, side):
        return spark.createDataFrame(data, "commit_id string, " + ", ".join(f"{side}_{n} string" for n in names))

    return frame(gold, "label"), frame(model, "model")


def test_match_rules(spark):
    gold, model = compared(
        spark,
        [
            (V.LOGIC, V.LOGIC, "FALSE", "False", "3", "3.0"),
            (V.LOGIC, V.BUILD, "FALSE ", "False", "3", "2.0"),
        ],
    )
    rows = labels.gold_vs_model(gold, model).orderBy("commit_id").collect()
    flags = [(r.category_match, r.is_security_match, r.is_feature_match, r.complexity_match) for r in rows]
    assert flags == [(True, True, True, True), (False, True, False, False)]
    trimmed = labels.gold_vs_model(gold, model, trim=True).orderBy("commit_id").collect()
    assert [r.is_feature_match for r in trimmed] == [True, True]


def test_agreement_and_kappa(spark):
    pairs = [(V.LOGIC, V.LOGIC)] * 4 + [(V.LOGIC, V.BUILD)] + [(V.BUILD, V.BUILD)] * 3 + [(V.BUILD, V.LOGIC)] * 2
    gold, model = compared(spark, [(a, b, "FALSE", "False", "1", "2.0") for a, b in pairs])
    both = labels.gold_vs_model(gold, model)
    row = labels.agreement(both).first()
    assert (row.n, row.category_agreement, row.complexity_mae, row.complexity_bias) == (10, 0.7, 1.0, 1.0)
    assert (row.complexity_within_one, row.complexity_agreement) == (1.0, 0.0)
    kappa = labels.category_kappa(both).first()
    assert (kappa.observed, kappa.chance) == (pytest.approx(0.7), pytest.approx(0.5))
    assert kappa.kappa == pytest.approx(0.4)
    cells = {(r.label_category, r.model_category): r.n for r in labels.confusion(both).collect()}
    assert cells == {(V.LOGIC, V.LOGIC): 4, (V.LOGIC, V.BUILD): 1, (V.BUILD, V.BUILD): 3, (V.BUILD, V.LOGIC): 2}
    totals = {r.category: (r.correct, r.labelled, r.predicted) for r in labels.category_totals(both).collect()}
    assert totals == {V.LOGIC: (4, 5, 6), V.BUILD: (3, 5, 4)}


@pytest.mark.parametrize("n", [2, 20])
def test_tail_rewrite(spark, n):
    rows = [(f"f{i % 2}", i, f"id{i}", "old") for i in range(10)]
    df = spark.createDataFrame(rows, "file string, ordinal bigint, commit_id string, synthetic_commit_id string")
    out = labels.tail_rewrite(df, "file", "ordinal", n=n)
    assert "synthetic_commit_id" not in out.columns
    for row in out.collect():
        tail = row.ordinal >= 10 - 2 * n
        real = f"id{row.ordinal}"
        expect = hashlib.sha1(f"synth:{row.file}:{real}".encode()).hexdigest() if tail else real
        assert (row.commit_id, row.is_synthetic_commit_id) == (expect, tail)


def test_tail_rewrite_keeps_flags_and_null_files(spark):
    rows = [(None, 1, "a", True), ("f", 2, "b", True), ("f", 3, "c", False)]
    df = spark.createDataFrame(rows, "file string, ordinal bigint, commit_id string, is_synthetic_commit_id boolean")
    out = {r.ordinal: (r.commit_id, r.is_synthetic_commit_id) for r in labels.tail_rewrite(df, "file", "ordinal", n=1).collect()}
    assert out[1] == ("a", True) and out[2] == ("b", True) and out[3][1] and len(out[3][0]) == 40


def test_merge(spark):
    c = spark.createDataFrame([("1", "x")], "commit_id string, label_reasoning string")
    r = spark.createDataFrame([("2",)], "commit_id string")
    rows = labels.merge_labeled({"C": c, "Rust": r, "Go": None}).orderBy("commit_id").collect()
    assert [(x.commit_id, x.label_reasoning, x.language_inferred) for x in rows] == [("1", "x", "C"), ("2", None, "Rust")]
    with pytest.raises(ValueError):
        labels.merge_labeled({"C": None})


def test_votes(spark):
    rows = [("a", 1, "x"), ("a", 2, "y"), ("a", 3, "y"), ("b", 1, "x"), ("b", 2, "y"), ("b", 3, "z")]
    df = spark.createDataFrame(rows, "commit_id string, priority int, label string")
    got = {r.commit_id: (r.label, r.votes) for r in labels.majority_vote(df).collect()}
    assert got == {"a": ("y", 2), "b": ("x", 1)}


def sample_frame(spark, n, copies=0):
    rows = [("c", "r", f"id{i}", "fix it" if i % 4 == 0 else "other", "d") for i in range(n)]
    rows += [("c", "r", "id0", "fix it", "d")] * copies
    return spark.createDataFrame(rows, "language string, repo string, commit_id string, message string, diff string")


def expected_sample(df, frac, cap, seed="42"):
    """The sampling rule row by row."""
    rows = [r for r in df.collect()]
    key = lambda r: (hashlib.md5(f"{seed}:{r.commit_id}".encode()).hexdigest(), r.commit_id)
    ordered = sorted(rows, key=key)
    drawn = [r.commit_id for r in ordered[: round(frac * len(rows))]]
    telling = [r.commit_id for r in ordered if "fix" in r.message]
    return list(dict.fromkeys(drawn + telling))[:cap]


@pytest.mark.parametrize("n, copies, cap", [(100, 0, 10), (100, 0, 1000), (30, 60, 8), (30, 60, 100), (10, 0, 100)])
def test_gold_sample(spark, n, copies, cap):
    df = sample_frame(spark, n, copies)
    rows = sampling.gold_sample(df, frac=0.05, cap=cap).orderBy("sample_rank").collect()
    assert [r.commit_id for r in rows] == expected_sample(df, 0.05, cap)


def test_rows_to_label(spark):
    df = spark.createDataFrame([("1", "m", "d", 2, 3)], "commit_id string, message string, diff string, entropy int, churn int")
    row = sampling.to_label(df).first()
    assert (row.label_category, row.label_reasoning, row.diff_preview, row.entropy) == ("", "", "d", 2)


def test_split_share(spark):
    df = spark.range(4000).selectExpr("cast(id as string) commit_id")
    counts = {r["split"]: r["count"] for r in sampling.holdout_split(df).groupBy("split").count().collect()}
    assert counts["train"] + counts["holdout"] == 4000 and abs(counts["train"] / 4000 - 0.8) < 0.03
