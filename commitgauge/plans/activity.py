"""From commits with raw diffs to the slim table behind all activity figures."""

from __future__ import annotations

from pyspark.sql import DataFrame

from commitgauge.operators.commits import with_net_lines, with_year
from commitgauge.operators.diffs import add_loc, split_file_chunks


def activity_table(commits: DataFrame, diff: str = "diff") -> DataFrame:
    """Line counts, day and year without the text columns; worth persisting when reused."""
    return with_year(with_net_lines(add_loc(commits, diff)))


def file_activity_table(commits: DataFrame, diff: str = "diff") -> DataFrame:
    return with_year(split_file_chunks(commits, diff))
