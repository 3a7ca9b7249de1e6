"""Diff reading and condensing on small literal diffs, checked line by line."""

import pytest
from pyspark.sql import functions as F

from commitgauge import fixed_values as V
from commitgauge.functions.text import count_added, count_removed
from commitgauge.operators import diffs


def file_diff(path, *hunks, new=None, extra="", old=None):
    """A git file section; each hunk is a list of lines, sizes are counted."""
    old = old or f"a/{path}"
    new = new or f"b/{path}"
    text = f"diff --git a/{path} b/{path}\n{extra}--- {old}\n+++ {new}\n"
    for lines in hunks:
        n_old = sum(not x.startswith(("+", "\\")) for x in lines)
        n_new = sum(not x.startswith(("-", "\\")) for x in lines)
        text += f"@@ -1,{n_old} +1,{n_new} @@ where\n" + "\n".join(lines) + "\n"
    return text


def condense(spark, raw):
    df = spark.createDataFrame([("c", raw)], "commit_id string, diff_raw string")
    return diffs.condense_diffs(df).first()["diff"]


def context(n):
    return [f" line {i}" for i in range(n)]


def test_line_counts(spark):
    added = "+++ b/x.c\n+b\n+\n+  @@ z\n++e\n+++f"
    removed = "--- a/x.c\n-c\n--d"
    df = spark.createDataFrame([(added, removed)], "a string, r string")
    assert df.select(count_added(F.col("a")), count_removed(F.col("r"))).first()[:] == (2, 1)


@pytest.mark.parametrize(
    "path, kind",
    [
        ("Cargo.lock", "noise"),
        ("a/logo.svg", "noise"),
        ("src/Makefile", "artifact"),
        ("docs/x.c", "artifact"),
        ("ChangeLog", "log"),
        ("src/newsletter.c", "log"),
        ("src/x.c", "code"),
        ("mydocs/x.c", "code"),
    ],
)
def test_file_kind(spark, path, kind):
    df = spark.createDataFrame([("c", file_diff(path, ["+x"]))], "commit_id string, diff_raw string")
    row = diffs.list_files(df).first()
    assert (row["path"], row["file_kind"], row["lines_added"]) == (path, kind, 1)


def test_noise_and_artifact(spark):
    assert condense(spark, file_diff("a/logo.svg", ["+x"])) == (
        "File: a/logo.svg (Binary/Asset - Content Skipped)"
    )
    body = ["-old", "+new", " keep  ", " more", " last"]
    assert condense(spark, file_diff("src/Makefile", body)) == (
        "File: src/Makefile (Build/Doc Artifact - 1 lines added, 1 lines removed)\n"
        "   -old\n   +new\n    keep\n   ... [REMAINING ARTIFACT SKIPPED] ..."
    )


def test_status_tags(spark):
    assert condense(spark, file_diff("x.c", ["-a"], new="/dev/null", extra="deleted file mode 100644\n")) == (
        "File: x.c [DELETED]\n-a"
    )
    assert condense(spark, file_diff("x.c", ["+a"], old="/dev/null", extra="new file mode 100644\n")) == (
        "File: x.c [NEW]\n+a"
    )
    assert condense(spark, file_diff("x.c", ["+a", " b"], new="b/y.c")) == "File: y.c [RENAMED]\n+a\n b"
    empty_new = "diff --git a/e.c b/e.c\nnew file mode 100644\nindex 000..111\n"
    assert condense(spark, empty_new) == "File: e.c [NEW]"


@pytest.mark.parametrize("n, cut", [(50, False), (51, True)])
def test_log_hunks(spark, n, cut):
    lines = [f"+{i} note" for i in range(n)]
    out = condense(spark, file_diff("ChangeLog", lines)).split("\n")[1:]
    expect = lines[:10] + ["   ... [SNIPPED 31 LINES OF LOG] ..."] + lines[-10:] if cut else lines
    assert out == expect


@pytest.mark.parametrize("changes, cut", [(4, True), (5, False)])
def test_sparse_code_hunks(spark, changes, cut):
    lines = context(60)
    for i in range(changes):
        lines[20 + i] = f"-gone {i}"
    out = condense(spark, file_diff("x.c", lines)).split("\n")[1:]
    expect = lines[:10] + ["   ... [SNIPPED 40 LINES OF CONTEXT/BODY] ..."] + lines[-10:] if cut else lines
    assert out == expect


@pytest.mark.parametrize("n, cut", [(200, False), (201, True)])
def test_huge_code_hunks(spark, n, cut):
    lines = [f"+w{i} x" for i in range(n)]
    out = condense(spark, file_diff("x.c", lines)).split("\n")[1:]
    assert len(out) == (21 if cut else n)


@pytest.mark.parametrize("same, repetitive", [(16, False), (17, True)])
def test_repetitive_hunks(spark, same, repetitive):
    lines = [f"+use m{i};" for i in range(same)] + [f"+w{i} z" for i in range(20 - same)]
    out = condense(spark, file_diff("x.rs", lines)).split("\n")[1:]
    expect = lines[:5] + ["   ... [SNIPPED 10 REPETITIVE LINES] ..."] + lines[-5:] if repetitive else lines
    assert out == expect


def test_repetition_needs_twenty_added_and_counts_blank_lines(spark):
    nineteen = ["+use a;"] * 19
    assert condense(spark, file_diff("x.rs", nineteen)).count("use a") == 19
    blanks = ["+use a;"] * 16 + ["+"] * 4
    assert condense(spark, file_diff("x.rs", blanks)).count("use a") == 16
    only_blank = ["+"] * 30
    assert condense(spark, file_diff("x.rs", only_blank)).count("+") == 30


def test_blank_broken_and_plain_text(spark):
    assert condense(spark, " \n") == V.EMPTY_DIFF
    stray = "@@ -1,1 +1,1 @@\n-a\n+b" + "x" * 2000
    assert condense(spark, stray) == stray[:1000] + V.BROKEN_END
    short = "diff --git a/x b/x\n--- a/x\n+++ b/x\n@@ -1,3 +1,1 @@\n a\n"
    assert condense(spark, short) == short + V.BROKEN_END
    overshoot = "diff --git a/x b/x\n--- a/x\n+++ b/x\n@@ -1,1 +1,2 @@\n a\n b\n"
    assert condense(spark, overshoot) == overshoot + V.BROKEN_END
    trailing = "diff --git a/x b/x\n--- a/x\n+++ b/x\n@@ -1,2 +1,2 @@\n a\n-b\n+c\n\nfooter\n"
    assert condense(spark, trailing) == "File: x\n a\n-b\n+c"


def test_fetch_error(spark):
    df = spark.createDataFrame([("c", None, "gone")], "commit_id string, diff_raw string, error string")
    assert diffs.condense_diffs(df, error="error").first()["diff"] == "[Error fetching diff: gone]"


@pytest.mark.parametrize("n, cut", [(40000, False), (40001, True)])
def test_length_limit(spark, n, cut):
    head = "File: x.c\n+"
    line = "+" + "y" * (n - len(head))
    out = condense(spark, file_diff("x.c", [line]))
    assert out == (head + "y" * (n - len(head)))[:40000] + (V.TOO_LONG_END if cut else "")


def test_lines_stats_and_marker(spark):
    raw = file_diff("x.c", [" a", "-b", "+c", "\\ No newline at end of file"], ["+--d", "+", ""]) + file_diff(
        "y.c", ["-- z", "+++ q"]
    )
    df = spark.createDataFrame([("c", raw)], "commit_id string, diff_raw string")
    rows = diffs.explode_diff_lines(df).orderBy("file_no", "hunk_no", "line_no").collect()
    assert [(r.file_no, r.hunk_no, r.line_no, r.kind, r.text) for r in rows] == [
        (1, 1, 1, "context", " a"),
        (1, 1, 2, "removed", "-b"),
        (1, 1, 3, "added", "+c"),
        (1, 1, 4, "marker", "\\ No newline at end of file"),
        (1, 2, 1, "added", "+--d"),
        (1, 2, 2, "added", "+"),
        (1, 2, 3, "context", ""),
        (2, 1, 1, "removed", "-- z"),
        (2, 1, 2, "added", "+++ q"),
    ]
    stats = diffs.commit_stats(df).first()
    assert (stats["entropy"], stats["churn"]) == (2, 6)


def test_file_chunks(spark):
    raw = file_diff("x.c", ["+a", "-b"]) + file_diff("gone.c", ["-a"], new="/dev/null")
    df = spark.createDataFrame([("c", "m", raw), ("d", "m", None)], "commit_id string, message string, diff string")
    rows = diffs.split_file_chunks(df).collect()
    assert [r.asDict() for r in rows] == [
        {"commit_id": "c", "file": "x.c", "lines_added": 1, "lines_removed": 1}
    ]


def test_no_shuffle(spark):
    df = spark.createDataFrame([("c", "x")], "commit_id string, diff_raw string")
    plan = diffs.condense_diffs(df)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
