"""Every registered query against its SQL on the smallest tables."""

import pytest
from conftest import SMALL
from oracle_check import compare

import __spark_entry__ as contract
from inkstream.plans import REGISTRY

QUERIES = {name: q.run for name, q in REGISTRY.items()}
SQL = {name: q.sql for name, q in REGISTRY.items() if q.sql}
#: Fitted models and statistics have their own tests with small inputs.
ROWS_ONLY = {
    "confidence_interval", "significance", "experiment_report", "fit_document_classifier",
    "fit_sentiment_classifier", "fit_language_detector", "cross_validate", "predict",
}


def test_only_known_queries_have_no_sql():
    assert set(QUERIES) - set(SQL) == ROWS_ONLY


@pytest.mark.parametrize("name", [n for n in QUERIES if n in SQL])
def test_query(spark, duck, name):
    # sparse windows may be empty in both engines on the smallest tables
    assert compare(spark, duck, SMALL, name, QUERIES[name], SQL[name]) in (None, "both empty")


def test_the_contract_holds_every_query():
    assert set(QUERIES) <= set(contract.queries())
    assert set(SQL) <= set(contract.oracle_sql())
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_entry(spark):
    assert contract.entry(spark).count() > 0
