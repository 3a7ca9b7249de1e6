"""Tables between steps have as many files as their rows ask for, however many tasks a shuffle deals to."""

import math
import os
from collections import Counter
from contextlib import contextmanager

import pytest

from commitgauge.llm import common, graph, minhash_dedup


@pytest.fixture
def folder(tmp_path, monkeypatch):
    """The folder of stored tables."""
    monkeypatch.setattr(common, "shared_folder", lambda spark: str(tmp_path))
    return tmp_path


@contextmanager
def _dealt(spark, tasks):
    """All shuffles deal to so many tasks."""
    setting = {"spark.sql.shuffle.partitions": str(tasks), "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in setting}
    for k, v in setting.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _files(folder):
    """The most files of a table of each label."""
    most = Counter()
    for table in os.listdir(folder):
        n = sum(f.endswith(".parquet") for f in os.listdir(folder / table))
        label = table.rpartition("-")[0]
        most[label] = max(most[label], n)
    return most


def test_stored_rows_are_merged_by_their_number_and_no_row_is_lost(spark, folder, monkeypatch):
    monkeypatch.setattr(common, "ROWS_PER_FILE", 300)
    with _dealt(spark, 16):
        df = spark.range(2000).selectExpr("id % 1000 AS id").distinct()
        for label, rows in (("unknown", None), ("none", 0), ("all", 1000), ("many", 10**9)):
            kept = common.stored(df, label, rows)
            assert sorted(r.id for r in kept.collect()) == list(range(1000))
    assert _files(folder) == {"unknown": 16, "none": 1, "all": math.ceil(1000 / 300), "many": 16}


def test_components_of_few_edges_write_one_file_a_turn(spark, folder):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(i, i) for i in (3, 99)], "a long, b long")
    with _dealt(spark, 16):
        found = {r.node: r.component for r in graph.components(edges, "turns").collect()}
    assert found == dict.fromkeys(range(61), 0)
    assert _files(folder) == {"turns": 1}


def test_near_duplicates_write_few_files(spark, folder):
    def text(group, edit):
        return " ".join(f"g{group}w{i}" for i in range(80)) + f" edit{edit}"

    rows = [(group * 10 + edit, text(group, edit)) for group in range(40) for edit in range(3)]
    docs = spark.createDataFrame([*rows, (None, text(0, 0)), (5000, None)], "doc_id long, text string")
    with _dealt(spark, 16):
        found = {r.doc_id: (r.component_id, r.kept) for r in minhash_dedup.near_duplicates(docs).collect()}
    expected = {group * 10 + edit: (group * 10, edit == 0) for group in range(40) for edit in range(3)}
    assert found == expected | {None: (None, True), 5000: (5000, True)}
    files = _files(folder)
    small = ("components", "hubs", "labels", "likely", "links", "pairs")
    assert {label: files[f"dedup-{label}"] for label in small} == dict.fromkeys(small, 1)
