"""Lenient but type-faithful reading of JSON classifier answers."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from commitgauge import fixed_values as V
from commitgauge.functions.text import let, strip


def parse_json(text: Column) -> Column:
    """The one JSON value in ``text`` as a variant, NULL for anything else.

    The parser stops after the first value, so the text is placed in front of a
    mark in an array: trailing text or a second value then displaces the mark.
    Text with repeated keys in one object is broken unless the session allows it
    (see ``keep_last_keys``).
    """

    def whole(marked: Column) -> Column:
        alone = (F.try_variant_get(marked, "$[1]", "string") == "#") & F.try_variant_get(
            marked, "$[2]", "string"
        ).isNull()
        return F.when(alone, F.try_variant_get(marked, "$[0]", "variant"))

    return let(F.try_parse_json(F.concat(F.lit("["), text, F.lit(',"#"]'))), whole)


def keep_last_keys(spark: SparkSession) -> None:
    """Let the parser of this session keep the last value of a repeated key."""
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")


def kind(value: Column, path: str) -> Column:
    """Type name at ``path``: VOID for a JSON null, NULL where there is nothing."""
    return F.schema_of_variant(F.try_variant_get(value, path, "variant"))


def text_at(value: Column, path: str) -> Column:
    return F.try_variant_get(value, path, "string")


def is_object(value: Column) -> Column:
    return F.schema_of_variant(value).startswith("OBJECT")


def truth_at(value: Column, path: str) -> Column:
    """True, 1 and their text forms are true; other numbers, words and gaps are false."""
    shape = kind(value, path)
    return F.coalesce(
        F.when(
            shape.isin("BOOLEAN", "BIGINT", "STRING"),
            F.lower(text_at(value, path)).isin(*V.PREDICTION_TRUE),
        ),
        F.lit(False),
    )


def complexity_at(value: Column, path: str, low: int = 1, high: int = 5) -> Column:
    """Integer clamped to ``low..high``: numbers are truncated, text has to be a whole number."""
    shape = kind(value, path)
    digits = F.replace(strip(text_at(value, path)), F.lit("_"), F.lit(""))
    whole_number = strip(text_at(value, path)).rlike(r"\A[+-]?[0-9]+(_[0-9]+)*\z")
    number = F.when(
        shape.startswith("BIGINT") | shape.startswith("DECIMAL") | shape.startswith("DOUBLE"),
        F.try_variant_get(value, path, "double"),
    ).when((shape == "STRING") & whole_number, digits.try_cast("double"))
    usable = number.isNotNull() & (F.abs(number) < F.lit(float("inf")))
    bounded = F.least(F.lit(float(high)), F.greatest(F.lit(float(low)), number)).cast("int")
    return F.when(usable, bounded).otherwise(F.lit(1))
