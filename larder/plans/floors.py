"""Dollar floors: walk-forward backtests of baselines, point models and the newsvendor policy.

A job stages the demand grid once; folds, training rows, targets and actuals all read that table.
"""
from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from ..functions.money import dollar_loss
from ..operators import KEY, SERIES
from ..operators.baselines import baseline_croston, long_forecasts, naive_forecasts
from ..operators.features import day_ahead_features, feature_frame, lag_fill_rate
from ..operators.folds import assert_no_leakage, forecast_frame, tail_folds, test_rows, walk_forward_folds
from ..operators.joins import salted_join
from ..operators.boosting import Settings
from ..operators.models import POINT_MODELS, boosted_point, boosted_quantiles, encode, point_gbm, predict_point, series_levels
from ..operators.quantiles import (
    CELL,
    WEEK,
    at_targets,
    long_quantiles,
    newsvendor_policy,
    required_levels,
    route_batch,
    weekday_means,
    weekday_quantiles,
    weekday_samples,
)
from ..operators.scoring import fold_scores, oracle_actual, score_join, touching_folds
from ..operators.unconstrain import unconstrain
from ..sources.staging import stage, stage_by_key

BASELINES = ["lag7", "rolling28", "chef_gut"]


@dataclass
class Backtest:
    """Demand, folds, cells to predict and actuals of one walk-forward run."""

    demand: DataFrame
    folds: DataFrame
    targets: DataFrame
    actuals: DataFrame


def prepare(demand: DataFrame, folds: DataFrame) -> Backtest:
    checked = assert_no_leakage(folds)
    return Backtest(demand, checked, forecast_frame(demand, checked), test_rows(demand, checked))


def walk_forward(demand: DataFrame, **windows) -> Backtest:
    return prepare(demand, stage(walk_forward_folds(demand, **windows), "folds"))


def end_anchored(demand: DataFrame, **windows) -> Backtest:
    return prepare(demand, stage(tail_folds(demand, **windows), "folds"))


def baseline_forecasts(run: Backtest, models: Sequence[str] = tuple(BASELINES)) -> DataFrame:
    naive = [m for m in models if m in BASELINES]
    out = long_forecasts(naive_forecasts(run.demand, run.targets, run.folds), naive)
    if "croston" in models:
        out = out.unionByName(baseline_croston(run.demand, run.targets, run.folds))
    return out


def backtest(
    demand: DataFrame, economics: DataFrame, models: Sequence[str] = tuple(BASELINES), **windows
) -> DataFrame:
    """Fold scores of the baselines, all folds and models in one plan."""
    run = walk_forward(stage_by_key(demand, "demand", SERIES), **windows)
    return fold_scores(score_join(run.actuals, baseline_forecasts(run, models), economics, list(models)))


def point_floor(
    demand: DataFrame, economics: DataFrame, eras: DataFrame, kind: str = "gbm", n_folds: int = 4, settings: Settings = Settings()
) -> DataFrame:
    """The global point model against the baselines, on clean demand."""
    run = walk_forward(stage_by_key(demand.select(*KEY, "demand"), "demand", SERIES), n_folds=n_folds)
    features = stage(feature_frame(run.demand, run.folds, eras), "features")
    point = stage(point_gbm(features, n_folds, kind, settings=settings), "forecasts")
    forecasts = baseline_forecasts(run).unionByName(point)
    return fold_scores(score_join(run.actuals, forecasts, economics, [*BASELINES, kind]))


def unconstrain_floor(
    clean: DataFrame, truth: DataFrame, economics: DataFrame, eras: DataFrame, n_folds: int = 4, settings: Settings = Settings()
) -> DataFrame:
    """The boosted point model trained on clean against recovered demand, both scored on one ruler.

    Folds of both arms are parts of one training.

    Only items with a sold-out cell can differ; ``touching`` marks the (fold, item) pairs whose
    test window holds one.
    """
    clean = stage_by_key(clean, "clean", SERIES)
    ruler = stage(oracle_actual(clean, truth), "ruler")
    run = end_anchored(ruler, n_folds=n_folds)
    arms = {"clean": clean.select(*KEY, "demand"), "unconstrained": unconstrain(clean).select(*KEY, "demand")}
    framed = [feature_frame(target, run.folds, eras).withColumn("arm", F.lit(i)) for i, target in enumerate(arms.values())]
    features = stage(framed[0].unionByName(framed[1]), "features")
    point = boosted_point(features, "", settings, F.col("arm") * n_folds + F.col("fold"), (*CELL, "arm"))
    names = F.array(*[F.lit(name) for name in arms])
    forecasts = stage(point.withColumn("model", F.get(names, F.col("arm"))).drop("arm"), "forecasts")
    scores = fold_scores(score_join(run.actuals, forecasts, economics, list(arms)))
    touched = touching_folds(clean, run.folds).withColumn("touching", F.lit(True))
    popular = clean.where("censored").select("restaurant_id", "item_id").distinct()
    return (
        scores.join(popular, ["restaurant_id", "item_id"], "left_semi")
        .join(touched, ["restaurant_id", "fold", "item_id"], "left")
        .withColumn("touching", F.coalesce("touching", F.lit(False)))
    )


def unconstrain_gate(scores: DataFrame) -> DataFrame:
    """Popular-item cost of both arms, split by touching or not, with the verdict."""

    def cost(model: str, *conditions):
        hit = F.col("model") == model
        for condition in conditions:
            hit = hit & condition
        return F.coalesce(F.sum(F.when(hit, F.col("dollar_cost"))), F.lit(0.0))

    out = scores.groupBy("restaurant_id").agg(
        cost("clean").alias("clean_cost"),
        cost("unconstrained").alias("unconstrained_cost"),
        cost("clean", F.col("touching")).alias("clean_touching"),
        cost("unconstrained", F.col("touching")).alias("unconstrained_touching"),
        cost("clean", ~F.col("touching")).alias("clean_rest"),
        cost("unconstrained", ~F.col("touching")).alias("unconstrained_rest"),
    )
    gain = F.col("clean_cost") - F.col("unconstrained_cost")
    return out.withColumns({"improvement": gain, "passed": gain > 0})


def recovered(clean: DataFrame) -> DataFrame:
    """Recovered demand, staged by series; ``unconstrain`` leaves it partitioned that way."""
    return stage_by_key(unconstrain(clean).select(*KEY, "demand"), "unconstrained", SERIES, aligned=True)


def newsvendor_scored(clean: DataFrame, economics: DataFrame, **windows) -> DataFrame:
    """Batch items only: prep at the distribution's mean against prep at the critical ratio.

    Both are decided once per series, fold and weekday and then looked up by the targets.
    """
    batch = route_batch(economics)
    run = end_anchored(recovered(clean), **windows)
    wanted = batch.select("restaurant_id", "item_id")
    targets = run.targets.join(wanted, ["restaurant_id", "item_id"], "left_semi")
    actuals = run.actuals.join(wanted, ["restaurant_id", "item_id"], "left_semi")
    samples = weekday_samples(run.demand.join(wanted, ["restaurant_id", "item_id"], "left_semi"), run.folds)
    curves = long_quantiles(weekday_quantiles(samples, required_levels(batch)), WEEK)
    policy = newsvendor_policy(curves, batch, WEEK).select(*WEEK, F.col("prep_quantity").alias("forecast"))
    weekly = (
        weekday_means(samples)
        .withColumn("model", F.lit("point_as_mean"))
        .unionByName(policy.withColumn("model", F.lit("quantile_newsvendor")))
    )
    forecasts = at_targets(weekly, targets).select(*CELL, "model", "forecast")
    return score_join(actuals, forecasts, batch, ["point_as_mean", "quantile_newsvendor"])


def newsvendor_floor(clean: DataFrame, economics: DataFrame, **windows) -> DataFrame:
    return fold_scores(newsvendor_scored(clean, economics, **windows))


#: Levels of a trained curve; prep quantities are read between them.
CURVE_LEVELS = (0.05, 0.10, 0.25, 0.40, 0.50, 0.60, 0.65, 0.70, 0.75, 0.80, 0.85, 0.90, 0.95, 0.99)


def newsvendor_trained(clean: DataFrame, economics: DataFrame, eras: DataFrame, n_folds: int = 4, settings: Settings = Settings()) -> DataFrame:
    """The same comparison with trained models: prep at the boosted point forecast against prep at the
    critical ratio of the boosted quantiles, both fitted on recovered demand."""
    batch = route_batch(economics)
    wanted = batch.select("restaurant_id", "item_id")
    run = end_anchored(recovered(clean), n_folds=n_folds)
    features = stage(feature_frame(run.demand, run.folds, eras), "features")
    curves = stage(boosted_quantiles(features, CURVE_LEVELS, settings), "curves")
    policy = newsvendor_policy(curves, batch).select(*CELL, F.col("prep_quantity").alias("forecast"))
    point = boosted_point(features, "point_as_mean", settings)
    forecasts = stage(point.unionByName(policy.withColumn("model", F.lit("quantile_newsvendor"))), "forecasts")
    forecasts = forecasts.join(wanted, ["restaurant_id", "item_id"], "left_semi")
    actuals = run.actuals.join(wanted, ["restaurant_id", "item_id"], "left_semi")
    return fold_scores(score_join(actuals, forecasts, batch, ["point_as_mean", "quantile_newsvendor"]))


def day_ahead_run(
    demand: DataFrame,
    economics: DataFrame,
    eras: DataFrame,
    test_days: int = 14,
    min_train_weeks: int = 12,
    kind: str = "gbm",
    settings: Settings = Settings(),
) -> DataFrame:
    """The last ``test_days`` days scored one day ahead: each day sees all earlier actuals.

    Strict-past windows over the actual series give every row that view at once, so nothing is
    replayed day by day.
    """
    demand = stage_by_key(demand.select(*KEY, "demand"), "demand", SERIES)
    days = demand.select("restaurant_id", "business_date").distinct()
    last = days.groupBy("restaurant_id").agg(
        F.sort_array(F.collect_list("business_date"), asc=False).alias("days")
    )
    short = F.size("days") < min_train_weeks * 7 + test_days
    cut = F.when(short, F.raise_error(F.lit("not enough history for a day-ahead run")).cast("date"))
    cut = last.select("restaurant_id", cut.otherwise(F.get("days", F.lit(test_days - 1))).alias("first_test_day"))
    features = stage(salted_join(day_ahead_features(demand, eras), cut, ["restaurant_id"], ["business_date"]), "features")
    train = features.where("business_date < first_test_day")
    test = features.where("business_date >= first_test_day")
    if kind == "gbm":
        role = F.when(F.col("business_date") < F.col("first_test_day"), "train").otherwise("test")
        forecasts = boosted_point(features.withColumn("role", role), kind, settings, F.lit(0), (*KEY, "demand"))
    else:
        levels = series_levels(train)
        forecasts = predict_point(POINT_MODELS[kind](encode(train, levels)), encode(test, levels))
    fill = lag_fill_rate(test, ["restaurant_id", "business_date"])
    costs = economics.select("restaurant_id", "item_id", "co", "cu")
    actual = F.col("demand").cast("double")
    return (
        forecasts.join(costs, ["restaurant_id", "item_id"])
        .join(fill, ["restaurant_id", "business_date"])
        .select(
            *KEY,
            "forecast",
            actual.alias("actual"),
            dollar_loss(F.col("forecast"), actual, F.col("co"), F.col("cu")).alias("dollar_cost"),
            "lag_1_fill",
            "lag_7_fill",
            "rolling_mean_7_fill",
        )
    )
