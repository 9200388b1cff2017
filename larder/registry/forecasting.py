"""Queries over forecast distributions: quantiles, prep quantities and calibration."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators import KEY
from ..operators import quantiles as ops, scoring
from ..plans import calibration, floors
from ..sources.driver_views import Views
from . import query
from .common_sql import KEYS
from .demand import SCORE_COLUMNS, clean, staged_clean, truth_of


def inputs(v: Views) -> calibration.Calibration:
    return calibration.calibration_inputs(clean(v), v.item_economics)


def policy(v: Views) -> DataFrame:
    run = floors.end_anchored(floors.recovered(clean(v)))
    return ops.empirical_policy(ops.weekday_samples(run.demand, run.folds), run.targets, v.item_economics)


@query("required_levels", "SELECT restaurant_id, quantile FROM levels")
def required_levels(v: Views) -> DataFrame:
    return ops.required_levels(v.item_economics)


@query("quantile_model", f"SELECT {KEYS}, fold, quantile, «forecast» AS forecast FROM quantile_forecasts")
def quantile_model(v: Views) -> DataFrame:
    return inputs(v).quantiles


@query(
    "noncrossing",
    f"""WITH mixed AS (SELECT {KEYS}, fold, quantile, CASE WHEN quantile > 0.4::DOUBLE AND quantile < 0.6::DOUBLE THEN -forecast ELSE forecast END AS forecast FROM quantile_forecasts)
        SELECT {KEYS}, fold, a.quantile, «b.forecast» AS forecast FROM (
          SELECT {KEYS}, fold, quantile, row_number() OVER (PARTITION BY {KEYS}, fold ORDER BY quantile) AS place FROM mixed) a
        JOIN (SELECT {KEYS}, fold, greatest(forecast, 0) AS forecast, row_number() OVER (PARTITION BY {KEYS}, fold ORDER BY greatest(forecast, 0)) AS place FROM mixed) b
        USING ({KEYS}, fold, place)""",
)
def noncrossing(v: Views) -> DataFrame:
    """Curves whose middle levels are turned negative, then put back in order."""
    middle = (F.col("quantile") > 0.4) & (F.col("quantile") < 0.6)
    mixed = inputs(v).quantiles.withColumn("forecast", F.when(middle, -F.col("forecast")).otherwise(F.col("forecast")))
    return ops.noncrossing(mixed)


@query("quantile_curve", f"SELECT {KEYS}, fold, CAST(level AS DOUBLE) AS level, «value» AS value FROM anchors")
def quantile_curve(v: Views) -> DataFrame:
    return ops.curve_anchors(inputs(v).quantiles)


@query("prep_quantity", f"SELECT {KEYS}, fold, «prep» AS prep_quantity FROM prep")
def prep_quantity(v: Views) -> DataFrame:
    return policy(v).select(*KEY, "fold", "prep_quantity")


WASTE = "CASE WHEN prep <= x_min THEN 0 ELSE waste END"
STOCKOUT = """CASE WHEN prep >= x_max THEN 0 ELSE (x_max - x_min - full_area) - (greatest(prep, x_min) - x_min - waste) END"""


@query("expected_waste", f"SELECT {KEYS}, fold, «{WASTE}» AS expected_waste FROM waste")
def expected_waste(v: Views) -> DataFrame:
    return policy(v).select(*KEY, "fold", "expected_waste")


@query("expected_stockout", f"SELECT {KEYS}, fold, «{STOCKOUT}» AS expected_stockout FROM waste")
def expected_stockout(v: Views) -> DataFrame:
    return policy(v).select(*KEY, "fold", "expected_stockout")


@query(
    "newsvendor_policy",
    f"""SELECT {KEYS}, fold, «r» AS critical_ratio, «prep» AS prep_quantity, «{WASTE}» AS expected_waste, «{STOCKOUT}» AS expected_stockout FROM waste""",
)
def newsvendor_policy(v: Views) -> DataFrame:
    return policy(v)


@query("newsvendor_floor", f"SELECT {SCORE_COLUMNS} FROM newsvendor_scores")
def newsvendor_floor(v: Views) -> DataFrame:
    return floors.newsvendor_floor(clean(v), v.item_economics)


@query(
    "newsvendor_gate",
    """SELECT restaurant_id, 'point_as_mean' AS best_model, «p» AS best_cost, 'quantile_newsvendor' AS challenger, «q» AS challenger_cost, «p - q» AS win, q < p AS passed
       FROM (SELECT restaurant_id, sum(dollar_cost) FILTER (model = 'point_as_mean') AS p, sum(dollar_cost) FILTER (model = 'quantile_newsvendor') AS q
             FROM newsvendor_scores GROUP BY 1) x""",
)
def newsvendor_gate(v: Views) -> DataFrame:
    totals = scoring.totals_by_model(floors.newsvendor_floor(clean(v), v.item_economics))
    return scoring.dollar_gate(totals, "quantile_newsvendor")


@query("coverage", "SELECT restaurant_id, quantile, nominal, «empirical» AS empirical, n FROM coverage")
def coverage(v: Views) -> DataFrame:
    base = staged_clean(v)
    found = calibration.calibration_inputs(base, v.item_economics)
    return scoring.coverage(found.quantiles, truth_of(base))


@query(
    "underage_per_item",
    "SELECT restaurant_id, item_id, q_star, nominal_underage, «empirical_underage» AS empirical_underage, n FROM underage",
)
def underage_per_item(v: Views) -> DataFrame:
    base = staged_clean(v)
    found = calibration.calibration_inputs(base, v.item_economics)
    return scoring.underage_per_item(found.quantiles, truth_of(base), v.item_economics)


@query("pit", f"SELECT {KEYS}, fold, «pit» AS pit FROM pit")
def pit(v: Views) -> DataFrame:
    base = staged_clean(v)
    found = calibration.calibration_inputs(base, v.item_economics)
    return scoring.pit(found.quantiles, truth_of(base))


@query(
    "conformal",
    "SELECT restaurant_id, confidence_level, «empirical_coverage» AS empirical_coverage, n, «mean_interval_width» AS mean_interval_width FROM conformal",
)
def conformal(v: Views) -> DataFrame:
    base = staged_clean(v)
    found = calibration.calibration_inputs(base, v.item_economics)
    return calibration.conformal(found, truth_of(base))


@query(
    "calibration_gate",
    """SELECT restaurant_id, «worst_deviation» AS worst_deviation, worst_quantile, «shortfall» AS upper_tail_shortfall, «confidence_level - empirical_coverage» AS conformal_gap,
         round(worst_deviation, 9) <= 0.15::DOUBLE AND round(confidence_level - empirical_coverage, 9) <= 0.10::DOUBLE AS passed
       FROM (SELECT restaurant_id, max(abs(empirical - nominal)) AS worst_deviation, arg_max(quantile, (round(abs(empirical - nominal), 9), -quantile)) AS worst_quantile,
               max(nominal - empirical) FILTER (quantile >= 0.75::DOUBLE AND empirical < nominal) AS shortfall FROM coverage GROUP BY 1) c
       JOIN conformal USING (restaurant_id)""",
)
def calibration_gate(v: Views) -> DataFrame:
    base = staged_clean(v)
    truth = truth_of(base)
    found = calibration.calibration_inputs(base, v.item_economics)
    return scoring.calibration_gate(scoring.coverage(found.quantiles, truth), calibration.conformal(found, truth))


@query(
    "calibration_run",
    f"""SELECT restaurant_id, 'coverage' AS section, printf('%.6f', quantile) AS label, «empirical» AS value, n FROM coverage
        UNION ALL SELECT restaurant_id, 'coverage_by_fold', CAST(fold AS VARCHAR) || '/' || printf('%.6f', quantile),
          «avg(CASE WHEN true_demand <= forecast THEN 1 ELSE 0 END)», count(*) FROM quantile_forecasts JOIN truth_demand USING ({KEYS}) GROUP BY restaurant_id, fold, quantile
        UNION ALL SELECT restaurant_id, 'pit', 'mean', «avg(pit)», count(*) FROM pit GROUP BY 1
        UNION ALL SELECT restaurant_id, 'pit', 'std', «stddev_pop(pit)», count(*) FROM pit GROUP BY 1
        UNION ALL SELECT restaurant_id, 'underage', item_id, «empirical_underage», n FROM underage
        UNION ALL SELECT restaurant_id, 'conformal', 'coverage', «empirical_coverage», n FROM conformal""",
)
def calibration_run(v: Views) -> DataFrame:
    base = staged_clean(v)
    return calibration.calibration_run(base, truth_of(base), v.item_economics)
