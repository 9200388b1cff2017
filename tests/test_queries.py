"""Every registered query against its SQL statement, on the smallest driver tables."""
import pytest

import __spark_entry__ as entry
from larder import registry
from oracle import compare, connect

SF = "/root/testdata/sf0.001"
registry.load()
QUERIES, ORACLES = registry.QUERIES, registry.ORACLES
# Trained models; their jobs are exercised once in test_models.py.
TRAINED = {"point_gbm", "quantile_forest", "quantile_gbm", "feature_importance", "point_floor", "point_gate", "unconstrain_floor", "unconstrain_gate", "day_ahead_run", "newsvendor_trained", "calibration_trained"}


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("key", sorted(ORACLES))
def test_matches_sql(spark, con, key):
    problem, rows = compare(spark, con, QUERIES[key], ORACLES[key], SF)
    assert problem == ""


def test_only_trained_models_lack_sql():
    assert set(QUERIES) - set(ORACLES) == TRAINED


def test_entry_returns_rows(spark):
    assert entry.entry(spark).count() > 0
