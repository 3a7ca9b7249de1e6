"""Round trips of every stored table."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from commitgauge import schemas
from commitgauge.operators import commits, labels, packages, predictions
from commitgauge.plans import activity as activity_plan
from commitgauge.plans import answers, history
from commitgauge.sources import sinks, tables

UTC = datetime.timezone.utc
MESSAGE = 'first "quoted", line\nsecond, line\n'


def commit_rows(spark, prefix="x"):
    when = datetime.datetime(2020, 1, 2, 3, 4, 5)
    rows = [
        (f"{prefix}1", MESSAGE, "diff\n+a", "Ann", when, 2, 3),
        (f"{prefix}2", None, None, "Bo", when, 1, 0),
        (f"{prefix}3", "  spaced ", "d", None, None, None, None),
    ]
    return spark.createDataFrame(rows, schemas.COMMITS)


def test_commit_csv_round_trip(spark, tmp_path):
    path = str(tmp_path / "full_commit_sqlite.csv")
    sinks.write_csv(commit_rows(spark), path)
    back = tables.read_commits_csv(spark, path).orderBy("commit_id").collect()
    expect = commit_rows(spark).orderBy("commit_id").collect()
    assert [r.commit_id for r in back] == ["x1", "x2", "x3"]
    assert back[0] == expect[0]
    assert (back[2].message, back[2].entropy) == ("  spaced ", None)


def write_library(tmp_path, language, library, rows):
    folder = tmp_path / "data" / language
    folder.mkdir(parents=True, exist_ok=True)
    lines = ["commit_id,message,diff,author,date,entropy,churn"]
    lines += [f'{i},"m ""q""\nnext",d,Ann,2020-01-01T00:00:00Z,{e},{c}' for i, e, c in rows]
    (folder / f"full_commit_{library}.csv").write_text("\n".join(lines) + "\n")


def test_library_tree(spark, tmp_path):
    write_library(tmp_path, "c", "coreutils", [("1", 2, 30), ("2", 1, 5)])
    write_library(tmp_path, "rust", "coreutils", [("3", 4, 50)])
    (tmp_path / "data" / "notes.txt").write_text("not a table")
    base = str(tmp_path / "data")
    meta = tables.read_source_metadata(spark, base)
    assert sorted(tuple(r) for r in meta.collect()) == [
        ("1", 2, 30, "coreutils", "c"), ("2", 1, 5, "coreutils", "c"), ("3", 4, 50, "coreutils", "rust"),
    ]
    assert "message" not in meta._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[1]
    assert tables.read_library_tables(spark, base).where("message = 'm \"q\"\nnext'").count() == 3


def test_unreadable_file(spark, tmp_path):
    write_library(tmp_path, "c", "good", [("1", 2, 30)])
    (tmp_path / "data" / "c" / "full_commit_bad.csv").write_text("other,columns\n1,2\n")
    base = str(tmp_path / "data")
    with pytest.raises(Exception, match="header|Header"):
        tables.read_source_metadata(spark, base).collect()
    rows = tables.read_source_metadata(spark, base, skip_unreadable=True).collect()
    assert [r.repo for r in rows] == ["good"]


def test_labels_are_text(spark, tmp_path):
    path = tmp_path / "gold.csv"
    path.write_text("commit_id,label_category,label_is_feature\n001,Logic,TRUE\n2,,\n")
    names = ["commit_id", "label_category", "label_is_feature"]
    rows = tables.read_labels_csv(spark, str(path), names).orderBy("commit_id").collect()
    assert [tuple(r) for r in rows] == [("001", "Logic", "TRUE"), ("2", "", "")]
    ordered = tables.read_labels_in_order(spark, str(path), names)
    out = labels.tail_rewrite(ordered, "file", "ordinal", n=1).orderBy("ordinal").collect()
    assert [(r.file, r.is_synthetic_commit_id) for r in out] == [("gold", False), ("gold", True)]
    assert out[0].commit_id == "001"


def test_merge_request_files(spark, tmp_path):
    for folder, name, text in [
        ("c", "BATCH_input_b.jsonl", '{"k":2}\n\n{"k":3}'),
        ("c", "BATCH_input_a.jsonl", '{"k":1}\n  \n'),
        ("rust", "BATCH_input_z.jsonl", "".join(f'{{"k":{i}}}\n' for i in range(4, 60))),
        ("rust", "other.jsonl", '{"k":99}\n'),
    ]:
        (tmp_path / "in" / folder).mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / folder / name).write_text(text)
    out = tmp_path / "merged"
    sinks.merge_jsonl(spark, str(tmp_path / "in"), str(out))
    parts = sorted(p for p in out.iterdir() if p.name.startswith("part-"))
    lines = [line for p in parts for line in p.read_text().splitlines()]
    assert [json.loads(x)["k"] for x in lines] == list(range(1, 60))
    with pytest.raises(ValueError):
        sinks.merge_jsonl(spark, str(tmp_path / "in"), str(tmp_path / "none"), glob="nothing*")


def test_requests(spark, tmp_path):
    df = commits.bind_libraries({("c", "sqlite"): commit_rows(spark)})
    path = tmp_path / "requests"
    sinks.write_jsonl(sinks.llm_requests(df, "Be brief."), str(path))
    text = "".join(p.read_text() for p in sorted(path.iterdir()) if p.name.startswith("part-"))
    by_key = {json.loads(x)["key"]: json.loads(x)["request"] for x in text.splitlines()}
    assert set(by_key) == {"c_sqlite_x1", "c_sqlite_x2", "c_sqlite_x3"}
    request = by_key["c_sqlite_x1"]
    assert request["systemInstruction"] == {"role": "system", "parts": [{"text": "Be brief."}]}
    assert request["contents"] == [
        {"role": "user", "parts": [{"text": f"Lang: c Msg: {MESSAGE}\nDiff:\ndiff\n+a"}]}
    ]
    assert by_key["c_sqlite_x2"]["contents"][0]["parts"][0]["text"] == "Lang: c Msg: \nDiff:\n"
    back = spark.read.schema(schemas.REQUESTS).json(str(path))
    assert back.where("request.systemInstruction.role = 'system'").count() == 3


def test_tuning_examples(spark, tmp_path):
    rows = [
        ("1", " msg\r\nmore ", "2", "3", "memory", "TRUE", "no", "4.0", "because\nof x", "+d\r\n", "C"),
        ("2", "m", "1", "1", "  ", "", "", "", "", "", "Rust"),
    ]
    names = [*schemas.GOLD_LABELS.fieldNames(), "language_inferred"]
    df = spark.createDataFrame(rows, names)
    path = tmp_path / "tuning"
    sinks.write_jsonl(sinks.tuning_examples(df, "I"), str(path))
    lines = [x for p in path.iterdir() if p.name.startswith("part-") for x in p.read_text().splitlines()]
    assert len(lines) == 1
    user, model = json.loads(lines[0])["contents"]
    assert user == {"role": "user", "parts": [{"text": "Lang: C Msg: msg\nmore\nDiff:\n+d"}]}
    assert json.loads(model["parts"][0]["text"]) == {
        "cat": "Memory Safety & Robustness", "feat": False, "sec": True, "comp": 4, "reas": "because of x",
    }
    back = spark.read.schema(schemas.TUNING_EXAMPLES).json(str(path))
    answer = F.from_json(back["contents"][1]["parts"][0]["text"], schemas.MODEL_ANSWER)
    assert back.select(answer.alias("a")).first().a.comp == 4


def test_partitioned_output_prunes(spark, tmp_path):
    path = str(tmp_path / "by_repo")
    df = commits.bind_libraries({("c", "a"): commit_rows(spark, "p"), ("rust", "b"): commit_rows(spark, "q")})
    sinks.write_by_repo(df, path)
    one = spark.read.parquet(path).where("repo = 'b'")
    assert one.count() == 3 and {r.commit_id for r in one.collect()} == {"q1", "q2", "q3"}
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(repo" in plan


def test_extract_or_load(spark, tmp_path):
    path = str(tmp_path / "extract")
    calls = []

    def build():
        calls.append(1)
        return commit_rows(spark)

    for _ in range(2):
        rows = tables.extract_or_load(spark, path, build).orderBy("commit_id").collect()
        assert (rows[1].message, rows[1].diff, rows[2].author) == ("", "", None)
    assert calls == [1]


def test_package_docs(spark, tmp_path):
    (tmp_path / "numpy.json").write_text('{"stars": 5,\n "forks": 2, "language": "C", "contributions_count": 9, "x": 1}')
    (tmp_path / "pandas.json").write_text('{"stars": 7}')
    docs = packages.fill_package_docs(tables.read_package_docs(spark, str(tmp_path), ["numpy", "pandas", "gone"]))
    assert sorted(tuple(r) for r in docs.collect()) == [("numpy", 5, 2, "C", 9), ("pandas", 7, 0, "N/A", 0)]
    metrics = spark.createDataFrame([("numpy", 0.1, 0.5), ("flask", 0.2, 0.9)], schemas.PACKAGE_METRICS)
    joined = {r.package: r.stars for r in packages.join_package_docs(metrics, docs).collect()}
    assert joined == {"numpy": 5, "flask": None}
    assert packages.top_packages(metrics, 1).first().package == "flask"


def test_pages(spark):
    empty = commits.concat_pages([], schemas.API_COMMITS, spark.range(1))
    assert empty.count() == 0 and empty.columns == schemas.API_COMMITS.fieldNames()
    page = spark.createDataFrame([("1", "t")], "id string, title string")
    assert commits.concat_pages([page, page], schemas.API_COMMITS, page).count() == 2


def test_history_to_scores(spark, tmp_path):
    """Raw history to requests, answers to scores, in the order a user runs them."""
    raw = (
        "diff --git a/x.c b/x.c\n--- a/x.c\n+++ b/x.c\n@@ -1,2 +1,3 @@\n keep\n-old\n+new\n+newer\n"
        "diff --git a/y.lock b/y.lock\n--- a/y.lock\n+++ b/y.lock\n@@ -1,1 +1,1 @@\n-1\n+2\n"
    )
    df = spark.createDataFrame(
        [("id1", " msg ", raw, "Ann", "c", "sqlite")],
        "commit_id string, message string, diff_raw string, author string, language string, repo string",
    )
    slim = history.condensed_commits(df)
    row = slim.first()
    assert (row.entropy, row.churn, row.message) == (2, 5, "msg")
    assert row.diff == "File: x.c\n keep\n-old\n+new\n+newer\nFile: y.lock (Binary/Asset - Content Skipped)"
    key = history.requests_for_history(df, "I").first().key
    answer = json.dumps({"cat": "Memory Safety", "comp": 2})
    line = json.dumps({"key": key, "response": {"candidates": [{"content": {"parts": [{"text": answer}]}}]}})
    folder = tmp_path / "answers"
    folder.mkdir()
    (folder / "a.jsonl").write_text(line + "\n\nbroken\n")
    lines = tables.read_predictions_jsonl(spark, str(folder))
    scored = answers.scored_answers(lines, slim, ["commit_id", "repo", "language"]).first()
    assert scored.ccs_score == pytest.approx(2 + 0.5 * 0.30103 + 0.5 * 0.69897, abs=1e-5)
    assert answers.library_focus(lines).first().library == "c / sqlite"
    assert predictions.unusable_lines(lines).count() == 1


def test_activity_tables(spark):
    raw = "diff --git a/x.c b/x.c\n--- a/x.c\n+++ b/x.c\n@@ -1,1 +1,2 @@\n-old\n+new\n+newer\n"
    df = spark.createDataFrame(
        [("1", "m", raw, "Ann", "2020-05-01 10:00:00")],
        "commit_id string, message string, diff string, author_name string, authored_datetime string",
    ).withColumn("authored_datetime", F.col("authored_datetime").cast("timestamp"))
    slim = activity_plan.activity_table(commits.rename_older(df)).first()
    assert (slim.lines_added, slim.lines_removed, slim.net_lines, slim.year) == (2, 1, 1, 2020)
    assert "diff" not in slim and "message" not in slim
    files = activity_plan.file_activity_table(commits.rename_older(df)).first()
    assert (files.file, files.lines_added) == ("x.c", 2)


def test_csv_files_are_bounded(spark, tmp_path):
    path = str(tmp_path / "bounded")
    sinks.write_csv(spark.range(25).coalesce(1), path, max_rows=10)
    assert len(list((tmp_path / "bounded").glob("*.csv"))) == 3
    assert spark.read.option("header", True).csv(path).count() == 25
