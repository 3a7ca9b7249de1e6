"""Response lines to predictions, flaw by flaw."""

import json

import pytest
from pyspark.sql import functions as F

from commitgauge import fixed_values as V
from commitgauge.functions import answers as A
from commitgauge.operators import predictions


def response(text, key="c_libcurl_ab"):
    return json.dumps(
        {"key": key, "response": {"candidates": [{"content": {"parts": [{"text": text}]}}]}}
    )


def lines_df(spark, lines):
    return spark.createDataFrame([(x,) for x in lines], "value string")


def parse(spark, *lines):
    return predictions.parse_predictions(lines_df(spark, lines)).collect()


def field(spark, name, texts):
    """Field of the prediction of each answer text, told apart by their keys."""
    lines = [response(t, f"c_r_{i}") for i, t in enumerate(texts)]
    return [r[name] for r in sorted(parse(spark, *lines), key=lambda r: int(r.commit_id))]


def test_fenced_answer(spark):
    text = '```json\n{"cat": "CI", "feat": false, "sec": true, "comp": 4, "reas": "why not"}\n```'
    assert [r.asDict() for r in parse(spark, response(text))] == [
        {
            "language": "c", "repo": "libcurl", "commit_id": "ab", "category": V.BUILD,
            "is_feature": False, "is_security": True, "complexity": 4, "reasoning": "why not",
        }
    ]


@pytest.mark.parametrize(
    "line, status",
    [
        ('{"key": ', "dropped"),
        (response('{"cat": '), "dropped"),
        (response(""), "dropped"),
        (response('{"cat": "CI"} thanks'), "dropped"),
        (response('{"cat": "CI"}}'), "dropped"),
        (response('{"cat": "CI"}]'), "dropped"),
        (response('{"cat": "CI"},{"cat": "CI"}'), "dropped"),
        (response('{"cat": "CI"}],["#"'), "dropped"),
        (response(None), "dropped"),
        (response(3), "dropped"),
        ('{"key": "a_b_c"}', "dropped"),
        ('{"key": "a_b_c", "response": {}}', "dropped"),
        (response("[1]"), "quarantined"),
        (response('"text"'), "quarantined"),
        ("[1]", "quarantined"),
        ('{"key": "a_b_c", "response": {"candidates": []}}', "quarantined"),
        ('{"key": "a_b_c", "response": null}', "quarantined"),
        ('{"key": "a_b_c", "response": {"candidates": [{"content": {"parts": []}}]}}', "quarantined"),
        (response("{}", key=5), "quarantined"),
    ],
)
def test_unusable(spark, line, status):
    df = lines_df(spark, [line])
    assert predictions.parse_predictions(df).count() == 0
    assert [r["status"] for r in predictions.unusable_lines(df).collect()] == [status]


def test_blank_lines_vanish(spark):
    df = lines_df(spark, ["", "  ", "\t"])
    assert predictions.parse_predictions(df).count() == 0
    assert predictions.unusable_lines(df).count() == 0


def test_keys(spark):
    rows = parse(spark, response("{}", "nokey"), response("{}", "rust_quick-xml_a_b"))
    assert [(r.language, r.repo, r.commit_id) for r in rows] == [
        ("unknown", "unknown", "nokey"), ("rust", "quick-xml", "a_b"),
    ]


def test_categories(spark):
    texts = ["thread safety", "race fix", "perf", "CI", "xyz", None, 5, {"a": "memory"}]
    answers = [json.dumps({"cat": t}) for t in texts] + ["{}"]
    assert field(spark, "category", answers) == [
        V.MEMORY, V.CONCURRENCY, V.FEATURE, V.BUILD, V.LOGIC, V.LOGIC, V.LOGIC, V.MEMORY, V.LOGIC,
    ]


def test_complexities(spark):
    raw = ["3.7", '"3"', '" 3 "', '"3.7"', "null", "true", "9", "0", "-2", '"+4"', '"x"', "[2]", "1e400", "1" + "0" * 30]
    answers = ['{"comp": %s}' % r for r in raw] + ["{}"]
    assert field(spark, "complexity", answers) == [3, 3, 3, 1, 1, 1, 5, 1, 1, 4, 1, 1, 1, 5, 1]


def test_flags(spark):
    raw = ["true", '"True"', "1", '"1"', '"yes"', "1.0", "null", "[true]", "false"]
    answers = ['{"feat": %s, "sec": %s}' % (r, r) for r in raw] + ["{}"]
    expect = [True] * 4 + [False] * 6
    assert field(spark, "is_feature", answers) == expect
    assert field(spark, "is_security", answers) == expect


def test_reasoning(spark):
    assert field(spark, "reasoning", ['{"reas": "x\\ny"}', '{"reas": null}', "{}"]) == ["x\ny", None, ""]


def test_one_parse_no_shuffle(spark):
    plan = predictions.parse_predictions(lines_df(spark, ["x"]))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate") == 1 and "Repartition" not in plan


def test_parse_json_alone(spark):
    df = spark.createDataFrame([("1",), ("1 2",), ("null",), ("",), ('{"a": [1, {"b": null}]}',)], "x string")
    got = [r[0] for r in df.select(A.parse_json(F.col("x")).isNotNull()).collect()]
    assert got == [True, False, True, False, True]


def test_last_value_of_a_repeated_key(spark):
    got = parse(spark, response('{"cat": "CI", "comp": 2, "comp": 4}'))
    assert [(r.category, r.complexity) for r in got] == [(V.BUILD, 4)]
