"""Every registered query against its SQL on the small driver tables."""

import pytest

from commitgauge.checks.compare import connect, differences
from commitgauge.checks.oracles import ORACLES
from commitgauge.checks.queries import QUERIES
from commitgauge.operators import model


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


def test_every_oracle_has_a_query():
    assert set(ORACLES) == set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, con, sf_dir, name):
    assert differences(spark, con, QUERIES[name], ORACLES[name], sf_dir) == []


def test_differences_are_found(spark, con, sf_dir):
    wrong = ORACLES["category_counts"].replace("count(*) AS n", "count(*) + 1 AS n")
    assert differences(spark, con, QUERIES["category_counts"], wrong, sf_dir) != []


def test_classifier_covers_all_documents(spark, sf_dir):
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    known = spark.read.parquet(f"{sf_dir}/labels.parquet").selectExpr("doc_id", "cast(quality as string) as label")
    rows = model.batch_classify(model.train_commit_classifier(documents.join(known, "doc_id")), documents)
    assert rows.count() == documents.count()
    assert {r.predicted for r in rows.select("predicted").distinct().collect()} <= {"0", "1"}
