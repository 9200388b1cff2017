"""Queries that train models or run a plugged-in model. Training has no SQL form; tests compare it with a
plain version of the same algorithm.

The library trains 300 rounds at 0.05, and forests of 100 trees, by default. The registered queries train
``ROUNDS`` larger steps and 20 trees, so that each ends within a minute or two on one machine;
``spark.larder.rounds`` in the session overrides the rounds.
"""
from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..operators import features, folds as fold_ops, models as ops
from ..operators.boosting import Settings
from ..operators import scoring
from ..plans import calibration, floors
from ..sources.driver_views import Views
from ..sources.staging import stage
from . import query
from .common_sql import KEYS, SERIES as S_KEYS
from .demand import clean, staged_clean, truth_of, walk_forward


ROUNDS = 40


def settings(v: Views) -> Settings:
    """As many rounds as the session or ROUNDS says, at the total step of the defaults as far as a step of a
    quarter allows."""
    rounds = int(v.spark.conf.get("spark.larder.rounds", str(ROUNDS)))
    full = Settings()
    return Settings(rounds=rounds, step=min(0.25, full.step * full.rounds / rounds))


def staged_features(v: Views) -> DataFrame:
    base = staged_clean(v)
    return stage(features.feature_frame(base, fold_ops.walk_forward_folds(base), v.menu_eras), "features")


@query("point_gbm")
def point_gbm(v: Views) -> DataFrame:
    return ops.point_gbm(staged_features(v), 4, settings=settings(v))


@query("quantile_forest")
def quantile_forest(v: Views) -> DataFrame:
    return ops.forest_by_fold(staged_features(v), 4, trees=20)


@query("quantile_gbm")
def quantile_gbm(v: Views) -> DataFrame:
    return ops.boosted_quantiles(staged_features(v), settings=settings(v))


@query("feature_importance")
def feature_importance(v: Views) -> DataFrame:
    rows = ops.boosted_inputs(staged_features(v), F.col("fold"))
    return ops.feature_importance(ops.fit_boosted(rows, settings=settings(v)), v.spark)


def _median(history: pd.DataFrame, cells: pd.DataFrame) -> pd.Series:
    return pd.Series(float(history["demand"].median()) if len(history) else 0.0, index=cells.index)


@query(
    "model_contract",
    f"""SELECT {KEYS}, f.fold, 'median' AS model, «m» AS forecast FROM clean_demand JOIN folds f USING (restaurant_id)
        JOIN (SELECT {S_KEYS}, fold, median(demand) AS m FROM clean_demand JOIN folds USING (restaurant_id)
              WHERE business_date <= train_end GROUP BY ALL) h USING ({S_KEYS}, fold)
        WHERE business_date BETWEEN test_start AND test_end""",
)
def model_contract(v: Views) -> DataFrame:
    run = walk_forward(v)
    return ops.model_contract(run.demand, run.targets, _median, "median")


@query("point_floor")
def point_floor(v: Views) -> DataFrame:
    return floors.point_floor(clean(v), v.item_economics, v.menu_eras, settings=settings(v))


@query("point_gate")
def point_gate(v: Views) -> DataFrame:
    scores = floors.point_floor(clean(v), v.item_economics, v.menu_eras, settings=settings(v))
    return scoring.dollar_gate(scoring.totals_by_model(scores), "gbm")


@query("unconstrain_floor")
def unconstrain_floor(v: Views) -> DataFrame:
    base = staged_clean(v)
    return floors.unconstrain_floor(base, truth_of(base), v.item_economics, v.menu_eras, settings=settings(v))


@query("unconstrain_gate")
def unconstrain_gate(v: Views) -> DataFrame:
    base = staged_clean(v)
    scores = floors.unconstrain_floor(base, truth_of(base), v.item_economics, v.menu_eras, settings=settings(v))
    return floors.unconstrain_gate(scores)


@query("newsvendor_trained")
def newsvendor_trained(v: Views) -> DataFrame:
    return floors.newsvendor_trained(clean(v), v.item_economics, v.menu_eras, settings=settings(v))


@query("calibration_trained")
def calibration_trained(v: Views) -> DataFrame:
    base = staged_clean(v)
    found = calibration.trained_inputs(base, v.menu_eras, settings=settings(v), economics=v.item_economics)
    return calibration.calibration_run(base, truth_of(base), v.item_economics, found)


@query("day_ahead_run")
def day_ahead_run(v: Views) -> DataFrame:
    return floors.day_ahead_run(clean(v), v.item_economics, v.menu_eras, settings=settings(v))
