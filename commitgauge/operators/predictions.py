"""Classifier answers to typed predictions.

A line is read by one nested array expression, so it is parsed once however
many fields are taken, and unusable lines disappear in the same step.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from commitgauge import fixed_values as V
from commitgauge.functions import answers as A
from commitgauge.functions import text as X
from commitgauge.functions.text import let

# The way to the answer text, outermost first.
OBJECT_STEPS = ("$.response", "$.response.candidates[0].content")
LIST_STEPS = ("$.response.candidates", "$.response.candidates[0].content.parts")
ANSWER_PATH = "$.response.candidates[0].content.parts[0].text"


def _is_well_formed(outer: Column) -> Column:
    """An object whose present parts have the expected shape; parts may be missing."""
    good = A.is_object(outer)
    for path in OBJECT_STEPS:
        good = good & F.coalesce(A.kind(outer, path).startswith("OBJECT"), F.lit(True))
    for path in LIST_STEPS:
        first_is_object = F.coalesce(A.kind(outer, path + "[0]").startswith("OBJECT"), F.lit(False))
        good = good & (A.kind(outer, path).isNull() | first_is_object)
    return good & F.coalesce(A.kind(outer, "$.key") == "STRING", F.lit(True))


def read_answer(line: Column) -> Column:
    """Key, answer text, parsed answer and status of one response line.

    The status is ok, dropped (blank line, broken outer or inner JSON, no answer)
    or quarantined (valid JSON of the wrong shape).
    """

    def outer_part(outer: Column) -> Column:
        # Where the way leads to a text, all parts on it have the right shape: only the key is left to judge.
        is_text = F.coalesce(A.kind(outer, ANSWER_PATH) == "STRING", F.lit(False))
        usual = is_text & (A.kind(outer, "$.key") == "STRING")
        return F.struct(
            F.coalesce(A.text_at(outer, "$.key"), F.lit("")).alias("key"),
            F.when(is_text, X.strip_markdown_fence(A.text_at(outer, ANSWER_PATH))).alias("text"),
            F.when(outer.isNull(), "dropped")
            .when(usual, None)
            .when(~_is_well_formed(outer), "quarantined")
            .alias("status"),
        )

    def inner_part(part: Column) -> Column:
        return let(
            A.parse_json(part["text"]),
            lambda answer: F.struct(
                part["key"].alias("key"),
                part["text"].alias("text"),
                answer.alias("answer"),
                F.coalesce(
                    part["status"],
                    F.when(answer.isNull(), "dropped")
                    .when(~A.is_object(answer), "quarantined")
                    .otherwise("ok"),
                ).alias("status"),
            ),
        )

    return let(let(A.parse_json(X.strip(line)), outer_part), inner_part)


def _prediction(read: Column) -> Column:
    a = read["answer"]
    id_ = X.parse_key(read["key"])
    shape = A.kind(a, "$.cat")
    category = (
        F.when(shape.isNull(), V.LOGIC)
        .when(shape == "VOID", "none")
        .otherwise(
            F.coalesce(A.text_at(a, "$.cat"), F.to_json(F.try_variant_get(a, "$.cat", "variant")))
        )
    )
    reasoning = F.when(A.kind(a, "$.reas").isNull(), F.lit("")).otherwise(A.text_at(a, "$.reas"))
    return F.struct(
        id_["language"].alias("language"),
        id_["repo"].alias("repo"),
        id_["commit_id"].alias("commit_id"),
        let(category, X.normalize_predicted_category).alias("category"),
        A.truth_at(a, "$.feat").alias("is_feature"),
        A.truth_at(a, "$.sec").alias("is_security"),
        A.complexity_at(a, "$.comp").alias("complexity"),
        reasoning.alias("reasoning"),
    )


def parse_predictions(lines: DataFrame, line: str = "value") -> DataFrame:
    """Prediction rows of all usable response lines; the last value of a repeated key counts.

    Sets ``spark.sql.variant.allowDuplicateKeys`` in the session of ``lines``.
    """
    A.keep_last_keys(lines.sparkSession)
    usable = F.filter(F.array(read_answer(F.col(line))), lambda r: r["status"] == "ok")
    return lines.select(F.inline(F.transform(usable, _prediction)))


def unusable_lines(lines: DataFrame, line: str = "value") -> DataFrame:
    """Lines that give no prediction, with the reason; blank lines are left out."""
    A.keep_last_keys(lines.sparkSession)
    filled = lines.where(~X.is_missing_text(F.col(line)))
    reasons = F.filter(F.array(read_answer(F.col(line))["status"]), lambda s: s != "ok")
    return filled.select(line, F.explode(reasons).alias("status"))
