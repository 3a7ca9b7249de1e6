"""Diffs stored as parts: the segmented scan gives the lines and paths of the whole-row reading."""

import pytest
from pyspark.sql import functions as F

from commitgauge.operators import diff_parts, diffs

DIFFS = [
    (1, "diff --git a/x.c b/x.c\nindex 1..2\n--- a/x.c\n+++ b/x.c\n@@ -1,3 +1,3 @@\n a\n-b\n+c\n d\n@@ -10,2 +10,3 @@\n e\n+f\n g\n"),
    (2, "stray\n@@ -1 +1 @@\n+x\ndiff --git a/old.txt b/new.txt\nsimilarity index 90%\nrename from old.txt\n"
        "@@ -1,2 +1,2 @@\n-a\n+b\n c\n\\ No newline at end of file\nextra after the declared end\n"),
    (3, "diff --git a/n.py b/n.py\nnew file mode 100644\n--- /dev/null\n+++ b/n.py\n@@ -0,0 +1,2 @@\n+one\n+two"),
    (4, "diff --git a/gone.rs b/gone.rs\ndeleted file mode 100644\n--- a/gone.rs\n+++ /dev/null\n@@ -1,2 +0,0 @@\n-p\n-q\n\n"),
    (5, "diff --git a/broken b/broken\n@@ -1,5 +1,5 @@\n a\n+b\ndiff --git \"a/q t\" \"b/q t\"\n@@ -1 +1 @@\n-x\n+y\n"),
    (6, None),
    (7, ""),
    (None, "diff --git a/k b/k\n@@ -1,1 +1,1 @@\n-1\n+2\n"),
    (8, "diff --git a/big b/big\n@@ -1,300 +1,300 @@\n" + "\n".join(("+" if i % 3 == 0 else "-" if i % 3 == 1 else " ") + f"l{i}" for i in range(450))),
]


def whole(spark):
    df = spark.createDataFrame(DIFFS, "commit_id long, diff_raw string")
    rows = diffs.explode_diff_lines(df).collect()
    return sorted(((r.commit_id is None, r.commit_id or 0), r.file_no, r.hunk_no, r.path, r.line_no, r.text, r.kind) for r in rows)


@pytest.mark.parametrize("size", [1, 2, 3, 7, 256])
def test_parts_give_the_lines_of_whole_diffs(spark, size):
    df = spark.createDataFrame(DIFFS, "commit_id long, diff_raw string")
    parts = diff_parts.cut_into_parts(df, lines=size)
    lines = diff_parts.lines_of_parts(parts)
    paths = diff_parts.file_paths(parts)
    joined = lines.alias("l").join(
        paths.alias("p"), F.col("l.commit_id").eqNullSafe(F.col("p.commit_id")) & (F.col("l.file_no") == F.col("p.file_no"))
    ).select("l.*", "p.path")
    found = sorted(((r.commit_id is None, r.commit_id or 0), r.file_no, r.hunk_no, r.path, r.line_no, r.text, r.kind) for r in joined.collect())
    assert found == whole(spark)


def test_parts_of_a_long_diff_join_back(spark):
    df = spark.createDataFrame(DIFFS, "commit_id long, diff_raw string")
    parts = diff_parts.cut_into_parts(df, lines=4).collect()
    texts = {}
    for r in sorted(parts, key=lambda r: (r.commit_id or -1, r.part)):
        texts.setdefault(r.commit_id, []).append(r.text)
    assert {k: "\n".join(v) for k, v in texts.items()} == {k: v for k, v in DIFFS if v is not None}
    empty = spark.createDataFrame([], "commit_id long, diff_raw string")
    assert diff_parts.lines_of_parts(diff_parts.cut_into_parts(empty)).count() == 0


def test_lines_are_placed_without_their_texts(spark):
    """No job at planning time, and no window over lines: their texts are dealt once and meet their places at the end."""
    parts = diff_parts.cut_into_parts(spark.createDataFrame(DIFFS, "commit_id long, diff_raw string"), lines=3)
    spark.sparkContext.setJobGroup("planning", "lines_of_parts")
    lines = diff_parts.lines_of_parts(parts)
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup("planning")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    plan = lines._jdf.queryExecution().optimizedPlan().toString()
    windows = [x for x in plan.splitlines() if x.lstrip(" +-:").startswith("Window")]
    assert windows and not [x for x in windows if "line#" in x or "text#" in x]


def test_parts_that_come_twice_are_read_side_by_side(spark):
    row = (1, DIFFS[0][1].replace("index 1..2\n", ""))
    df = spark.createDataFrame([row, row], "commit_id long, diff_raw string")
    parts = diff_parts.cut_into_parts(df, lines=3)
    found = sorted(tuple(r) for r in diff_parts.lines_of_parts(parts).collect())
    assert found == [(1, 2, 4, 4, " e", "context")] * 2 + [(1, 2, 4, 5, "+f", "added")] * 2
    assert sorted(tuple(r) for r in diff_parts.file_paths(parts).collect()) == [(1, 1, "x.c"), (1, 2, "x.c")]
