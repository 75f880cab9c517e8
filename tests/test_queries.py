"""Every registered query against its SQL in a second engine."""

import pytest
from compare import connect, difference

import __spark_entry__ as entry
from weakloom.plans import oracles, queries

QUERIES, ORACLES = queries.all_queries(), oracles.all_oracles()
WITHOUT_SQL = {"augmented_documents", "baseline_model_scores", "dependent_posteriors", "experiment_losses", "fitted_class_scores", "indexed_neighbours", "rule_dependencies", "end_model_predictions", "end_model_scores", "label_model_posteriors", "noisy_labels",
               "state_likelihoods", "topic_mixtures"}


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


def test_catalogue():
    assert set(QUERIES) - set(ORACLES) == WITHOUT_SQL
    assert set(ORACLES) <= set(QUERIES)
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, con, sf_dir, name):
    assert difference(spark, con, sf_dir, QUERIES[name], ORACLES[name]) is None


@pytest.mark.parametrize("name", sorted(WITHOUT_SQL))
def test_runs(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() == 35
