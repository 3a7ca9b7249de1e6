"""From response lines to scored commits and the comparison of both languages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from commitgauge.operators.focus import category_share_by_library
from commitgauge.operators.predictions import parse_predictions
from commitgauge.operators.scoring import score_predictions


def scored_answers(
    lines: DataFrame,
    metadata: DataFrame,
    on: Sequence[str] = ("commit_id", "repo"),
    line: str = "value",
    carry: Sequence[str] = (),
) -> DataFrame:
    return score_predictions(parse_predictions(lines, line), metadata, on, carry=carry)


def library_focus(lines: DataFrame, line: str = "value") -> DataFrame:
    return category_share_by_library(parse_predictions(lines, line))
