"""From raw history to condensed commits and classifier requests."""

from __future__ import annotations

from pyspark.sql import DataFrame

from commitgauge.operators.commits import sanitize_commits
from commitgauge.operators.diffs import condense_diffs
from commitgauge.sources.sinks import llm_requests


def condensed_commits(history: DataFrame, diff: str = "diff_raw") -> DataFrame:
    """Commits with clean text, size figures and condensed diff; each diff is read once, no shuffle."""
    return sanitize_commits(condense_diffs(history, diff, stats=True)).drop(diff)


def requests_for_history(history: DataFrame, instruction: str, diff: str = "diff_raw") -> DataFrame:
    return llm_requests(condensed_commits(history, diff), instruction)
