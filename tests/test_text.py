"""Column functions on literal values."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from commitgauge import fixed_values as V
from commitgauge.functions import stats as S
from commitgauge.functions import text as X


def apply(spark, function, *values):
    """One result per value."""
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r[0] for r in df.orderBy("i").select(function(F.col("x"))).collect()]


def test_strip_knows_python_whitespace(spark):
    samples = ["  a　", "\x1f\x1ca b\x85", " \r\n", "", "x\ty"]
    assert apply(spark, X.strip, *samples) == [s.strip() for s in samples]
    assert apply(spark, X.rstrip, *samples) == [s.rstrip() for s in samples]


def test_whitespace_constant_is_complete():
    import sys

    found = {chr(c) for c in range(sys.maxunicode + 1) if chr(c).isspace()}
    assert set(V.PY_WHITESPACE) == found
    assert {c for c in map(chr, range(0x3001)) if re.fullmatch(f"[{X.WHITESPACE}]", c)} == found


def test_sanitize(spark):
    df = spark.createDataFrame([(bytearray(b"a\xe9b"),), (None,)], "x binary")
    fixed = df.select(X.sanitize_text(F.col("x").cast("string"))).collect()
    assert [r[0] for r in fixed] == ["a�b", ""]


def test_clean_text(spark):
    assert apply(spark, X.clean_text, "\r\n a\r\nb \t", None) == ["a\nb", ""]


def test_reasoning(spark):
    fifteen = " ".join(f"w{i}" for i in range(15))
    assert apply(spark, X.clean_reasoning, fifteen, fifteen + "\nlast", "a  b\nc", None) == [
        fifteen,
        fifteen + "...",
        "a  b c",
        "",
    ]


def test_label_category(spark):
    samples = [" memory ", "Thread Safety", "Maintenance", "???", "FEAT", V.LOGIC, V.LOGIC.lower(), None]
    assert apply(spark, X.normalize_label_category, *samples) == [
        V.MEMORY, V.CONCURRENCY, V.BUILD, V.BUILD, V.FEATURE, V.LOGIC, V.BUILD, V.BUILD,
    ]


def test_predicted_category(spark):
    samples = ["thread safety", "race fix", "perf", "CI", "xyz", "none", " Logic & Correctness", "block", "decision"]
    assert apply(spark, X.normalize_predicted_category, *samples) == [
        V.MEMORY, V.CONCURRENCY, V.FEATURE, V.BUILD, V.LOGIC, V.LOGIC, V.LOGIC, V.CONCURRENCY, V.BUILD,
    ]


def test_booleans(spark):
    samples = ["TRUE", "t", "1", "Yes ", "y", "False", "", "1.0", None]
    assert apply(spark, X.parse_bool, *samples) == [True] * 5 + [False] * 4
    assert apply(spark, X.as_logical, "T", "true", "TRUE", "False", "F", "yes", None) == [
        True, True, True, False, False, None, None,
    ]


def test_label_complexity(spark):
    samples = ["3.0", "3.7", "", "9", " 2 ", "-1.5", "4d", "abc", "1e2", None]
    assert apply(spark, X.label_complexity, *samples) == [3, 3, 1, 9, 2, -1, 1, 1, 100, 1]


def test_key(spark):
    parsed = apply(spark, X.parse_key, "c_libcurl_ab", "rust_quick-xml_a_b", "nokey", "a_b")
    assert [tuple(p) for p in parsed] == [
        ("c", "libcurl", "ab"), ("rust", "quick-xml", "a_b"),
        ("unknown", "unknown", "nokey"), ("unknown", "unknown", "a_b"),
    ]


def test_fence(spark):
    assert apply(spark, X.strip_markdown_fence, '```json\n{"a":1}\n```', "x") == ['{"a":1}', "x"]


def test_synthetic_id(spark):
    expect = hashlib.sha1(b"synth:a:b").hexdigest()
    assert expect == "0c1d05b443ed4c7fe65732da4102ea31935c7a7b"
    assert apply(spark, lambda x: X.synthetic_id(x, F.lit("a")), "b") == [expect]


def test_interesting(spark):
    df = spark.createDataFrame(
        [("Fix it", None), (None, "an UNSAFE block"), ("nothing", "here"), (None, None)], "m string, d string"
    )
    rows = df.select(X.is_interesting(F.col("m"), F.col("d"))).collect()
    assert [r[0] for r in rows] == [True, True, False, False]


def test_small_ones(spark):
    assert apply(spark, X.work_type, V.FEATURE, V.LOGIC) == ["Feature", "Maintenance"]
    assert apply(spark, X.domain_of, "hyper", "nothing") == ["HTTP/Net", None]
    assert apply(spark, X.fill_author, "a", None) == ["a", "<unknown>"]
    assert apply(spark, X.is_missing_text, None, " \n", "x") == [True, True, False]
    one = spark.range(1)
    assert one.select(X.library_label(F.lit("c"), F.lit("sqlite"))).first()[0] == "c / sqlite"
    assert one.select(X.unique_key(F.lit("c"), F.lit("r"), F.lit("1"))).first()[0] == "c_r_1"
    assert one.select(X.model_input(F.lit("c"), F.lit("m%s"), F.lit("d"))).first()[0] == "Lang: c Msg: m%s\nDiff:\nd"
    assert one.select(X.format_range(F.lit(1999), F.lit(2004))).first()[0] == "1999–2004"
    assert one.select(X.percent_change(F.lit(8), F.lit(9))).first()[0] == 12.5
    committed, authored = F.lit(None).cast("string"), F.lit("2024-01-01T03:00:00+05:00")
    assert one.select(F.year(X.commit_timestamp(committed, authored))).first()[0] == 2023
    assert one.select(X.commit_timestamp(F.lit("soon"), authored)).first()[0] is None
    for text in ("2020", "2020-05", "2020-05-01"):
        assert one.select(X.commit_timestamp(F.lit(text), authored)).first()[0] is None
    for text in ("20200501 101112", "2020-05-01T10:11:12", "2020/05/01 10:11:12", "20200501101112"):
        got = one.select(X.commit_timestamp(F.lit(text), authored).cast("string")).first()[0]
        assert got == "2020-05-01 10:11:12", text


@pytest.mark.parametrize(
    "complexity, files, lines, plus_one, expect",
    [
        (3, 10, 100, False, 4.5),
        (1, 0, 0, False, 1.0),
        (2, float("nan"), 10, False, 2.5),
        (2, None, 10, False, 2.5),
        (None, 1, 1, False, None),
        (1, 9, 99, True, 2.5),
    ],
)
def test_score(spark, complexity, files, lines, plus_one, expect):
    row = [(complexity, None if files is None else float(files), lines)]
    df = spark.createDataFrame(row, "c int, f double, l bigint")
    got = df.select(S.ccs_score(F.col("c"), F.col("f"), F.col("l"), plus_one=plus_one)).first()[0]
    assert got == (None if expect is None else pytest.approx(expect))


@pytest.mark.parametrize(
    # Two-sided values of Student's t from its closed forms and standard tables.
    "t, df, p",
    [
        (1.0, 1, 0.5),
        (2.0, 2, 1 - 2 / 6**0.5),
        (2.570582, 5, 0.05),
        (3.169273, 10, 0.01),
        (-2.042272, 30, 0.05),
        (2.021075, 41, 0.049815),
    ],
)
def test_t_test(spark, t, df, p):
    got = spark.range(1).select(S.t_test_p_value(F.lit(t), F.lit(df))).first()[0]
    assert got == pytest.approx(p, abs=2e-5)
