"""Dollar scores, gates and accuracy measures."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.money import dollar_loss
from . import KEY, SERIES
from .joins import salted_join
from .quantiles import CELL, level_of, q_star, quantile_curve


def score_join(actuals: DataFrame, forecasts: DataFrame, economics: DataFrame, models: Sequence[str]) -> DataFrame:
    """Forecast next to actual with its dollar cost, one row per fold, model and cell.

    A missing forecast falls back to the item's mean demand in that test window, a group bounded by
    the window's days. Items without costs keep a null cost.
    """
    names = F.array(*[F.lit(m) for m in models])
    wanted = actuals.select(*CELL, "train_end", "test_start", "test_end", F.col("demand").cast("double").alias("actual"))
    rows = wanted.withColumn("model", F.explode(names)).join(
        forecasts.select(*CELL, "model", "forecast"), [*CELL, "model"], "left"
    )
    window = Window.partitionBy("restaurant_id", "item_id", "fold", "model")
    rows = rows.withColumn("forecast", F.coalesce("forecast", F.avg("actual").over(window)))
    costs = economics.select("restaurant_id", "item_id", "co", "cu")
    rows = rows.join(costs, ["restaurant_id", "item_id"], "left")
    cost = dollar_loss(F.col("forecast"), F.col("actual"), F.col("co"), F.col("cu"))
    return rows.withColumn("dollar_cost", cost)


def fold_scores(scored: DataFrame) -> DataFrame:
    """Cost, weighted absolute error, bias and day count per fold, model and costed item."""
    error = F.col("forecast") - F.col("actual")
    return (
        scored.where("co is not null and cu is not null")
        .groupBy("restaurant_id", "fold", "model", "item_id")
        .agg(
            F.max("train_end").alias("train_end"),
            F.max("test_start").alias("test_start"),
            F.max("test_end").alias("test_end"),
            F.coalesce(F.sum("dollar_cost"), F.lit(0.0)).alias("dollar_cost"),
            F.try_divide(F.sum(F.abs(error)), F.sum(F.abs("actual"))).alias("wape"),
            F.avg(error).alias("bias"),
            F.count_distinct("business_date").alias("n_days"),
        )
    )


def totals_by_model(scores: DataFrame, n_folds: int = 4) -> DataFrame:
    """Total cost per model, with one column per fold."""
    per_fold = [
        F.sum(F.when(F.col("fold") == i, F.col("dollar_cost"))).alias(f"fold_{i}") for i in range(n_folds)
    ]
    return scores.groupBy("restaurant_id", "model").agg(F.sum("dollar_cost").alias("total_cost"), *per_fold)


def best_model(totals: DataFrame) -> DataFrame:
    """Cheapest model per tenant; equal totals go to the first name."""
    rank = F.struct(F.round("total_cost", 6), "model")
    return totals.groupBy("restaurant_id").agg(
        F.min_by("model", rank).alias("best_model"), F.min("total_cost").alias("best_cost")
    )


def dollar_gate(totals: DataFrame, challenger: str) -> DataFrame:
    """Does the challenger cost less than the best of the other models?"""
    rivals = best_model(totals.where(F.col("model") != challenger))
    own = totals.where(F.col("model") == challenger).select(
        "restaurant_id", F.col("model").alias("challenger"), F.col("total_cost").alias("challenger_cost")
    )
    return rivals.join(own, "restaurant_id").select(
        "restaurant_id",
        "best_model",
        "best_cost",
        "challenger",
        "challenger_cost",
        (F.col("best_cost") - F.col("challenger_cost")).alias("win"),
        (F.col("challenger_cost") < F.col("best_cost")).alias("passed"),
    )


def cleaning_floor_gap(dirty: DataFrame, clean: DataFrame) -> DataFrame:
    """Best baseline on raw demand against best baseline on clean demand."""
    first = best_model(dirty).select(
        "restaurant_id", F.col("best_model").alias("dirty_model"), F.col("best_cost").alias("dirty_cost")
    )
    second = best_model(clean).select(
        "restaurant_id", F.col("best_model").alias("clean_model"), F.col("best_cost").alias("clean_cost")
    )
    return first.join(second, "restaurant_id").withColumn("gap", F.col("dirty_cost") - F.col("clean_cost"))


def oracle_actual(demand: DataFrame, truth: DataFrame) -> DataFrame:
    """Common scoring ruler: the truth on sold-out cells, the observed value elsewhere. A sold-out
    cell without a truth row fails the job."""
    joined = demand.join(truth.select(*KEY, "true_demand"), KEY, "left")
    missing = F.raise_error(F.lit("sold-out cell without a truth row")).cast("double")
    value = (
        F.when(F.col("censored") & F.col("true_demand").isNull(), missing)
        .when(F.col("censored"), F.col("true_demand").cast("double"))
        .otherwise(F.col("demand").cast("double"))
    )
    return joined.withColumn("demand", value).select(*KEY, "demand")


def touching_folds(demand: DataFrame, folds: DataFrame) -> DataFrame:
    """(fold, item) pairs with a sold-out cell in the test window."""
    cut = demand.where("censored").select("restaurant_id", "item_id", "business_date").distinct()
    day = F.col("business_date")
    return (
        salted_join(cut, folds, ["restaurant_id"], ["business_date"])
        .where(day.between(F.col("test_start"), F.col("test_end")))
        .select("restaurant_id", "fold", "item_id")
        .distinct()
    )


def mae_bias(demand: DataFrame, truth: DataFrame) -> DataFrame:
    """Mean absolute error and signed bias against the truth; a missing cell counts as zero."""
    seen = demand.select(*KEY, F.col("demand").cast("double").alias("demand"))
    error = F.coalesce("demand", F.lit(0.0)) - F.col("true_demand")
    return (
        truth.select(*KEY, "true_demand")
        .join(seen, KEY, "left")
        .groupBy("restaurant_id")
        .agg(F.avg(F.abs(error)).alias("mae"), F.avg(error).alias("bias"), F.count("*").alias("n"))
    )


def unconstrain_gap(demand: DataFrame, recovered: DataFrame, stockouts: DataFrame) -> DataFrame:
    """Error of capped and of recovered demand on the sold-out cells the log shows, next to the
    number of all true stock-outs. A visible cell without its truth fails the job."""
    cut = demand.where("censored").select(*KEY, F.col("demand").cast("double").alias("observed"))
    fixed = recovered.select(*KEY, F.col("demand").alias("recovered"))
    rows = cut.join(stockouts.select(*KEY, "true_demand"), KEY, "left").join(fixed, KEY, "left")
    missing = F.raise_error(F.lit("visible stock-out without truth or recovery")).cast("double")
    truth = F.when(F.col("true_demand").isNull() | F.col("recovered").isNull(), missing).otherwise(F.col("true_demand"))
    capped, after = F.col("observed") - truth, F.col("recovered") - truth
    gap = rows.groupBy("restaurant_id").agg(
        F.count("*").alias("n_observable_rows"),
        F.avg(F.abs(capped)).alias("capped_mae"),
        F.avg(capped).alias("capped_bias"),
        F.avg(F.abs(after)).alias("recovered_mae"),
        F.avg(after).alias("recovered_bias"),
    )
    total = stockouts.groupBy("restaurant_id").agg(F.count("*").alias("n_total_truth_stockouts"))
    return gap.join(total, "restaurant_id")


def coverage(quantiles: DataFrame, truth: DataFrame, keys: Sequence[str] = ("restaurant_id", "quantile")) -> DataFrame:
    """Share of truths at or below the forecast of each level."""
    joined = quantiles.join(truth.select(*KEY, "true_demand"), KEY)
    covered = (F.col("true_demand") <= F.col("forecast")).cast("int")
    out = joined.groupBy(*keys).agg(F.avg(covered).alias("empirical"), F.count("*").alias("n"))
    return out.withColumn("nominal", F.col("quantile"))


def underage_per_item(quantiles: DataFrame, truth: DataFrame, economics: DataFrame) -> DataFrame:
    """Share of truths above the forecast at the item's own critical ratio; an item whose level
    was not forecast has no row."""
    own = economics.select("restaurant_id", "item_id", q_star().alias("quantile"))
    at_ratio = quantiles.withColumn("quantile", F.round("quantile", 6)).join(
        own, ["restaurant_id", "item_id", "quantile"]
    )
    missed = (F.col("true_demand") > F.col("forecast")).cast("int")
    return (
        at_ratio.join(truth.select(*KEY, "true_demand"), KEY)
        .groupBy("restaurant_id", "item_id", F.col("quantile").alias("q_star"))
        .agg(F.avg(missed).alias("empirical_underage"), F.count("*").alias("n"))
        .withColumn("nominal_underage", F.round(1 - F.col("q_star"), 6))
    )


def pit(quantiles: DataFrame, truth: DataFrame) -> DataFrame:
    """Where each truth falls in its own forecast distribution, 0 to 1."""
    joined = quantile_curve(quantiles).join(truth.select(*KEY, "true_demand"), KEY)
    return joined.select(*CELL, level_of(F.col("curve"), F.col("true_demand").cast("double")).alias("pit"))


def pit_summary(values: DataFrame) -> DataFrame:
    return values.groupBy("restaurant_id").agg(
        F.count("*").alias("n"), F.avg("pit").alias("pit_mean"), F.stddev_pop("pit").alias("pit_std")
    )


def item_bias(scored: DataFrame) -> DataFrame:
    return scored.groupBy("restaurant_id", "model", "item_id").agg(
        F.avg("forecast").alias("pred_mean"),
        F.avg("actual").alias("actual_mean"),
        F.avg(F.col("forecast") - F.col("actual")).alias("bias"),
    )


# Tolerances of the calibration check.
COVERAGE_TOLERANCE = 0.15
CONFORMAL_UNDERSHOOT = 0.10
UPPER_TAIL_FROM = 0.75


def calibration_gate(levels: DataFrame, conformal: DataFrame) -> DataFrame:
    """Worst level, conformal undershoot and the upper-tail caveat, with the verdict."""
    deviation = F.abs(F.col("empirical") - F.col("nominal"))
    short = F.when(
        (F.col("quantile") >= UPPER_TAIL_FROM) & (F.col("empirical") < F.col("nominal")),
        F.col("nominal") - F.col("empirical"),
    )
    rank = F.struct(F.round(deviation, 9), -F.col("quantile"))
    worst = levels.groupBy("restaurant_id").agg(
        F.max(deviation).alias("worst_deviation"),
        F.max_by("quantile", rank).alias("worst_quantile"),
        F.max(short).alias("upper_tail_shortfall"),
    )
    gap = F.col("confidence_level") - F.col("empirical_coverage")
    both = worst.join(conformal, "restaurant_id").withColumn("conformal_gap", gap)
    passed = (F.round("worst_deviation", 9) <= COVERAGE_TOLERANCE) & (F.round("conformal_gap", 9) <= CONFORMAL_UNDERSHOOT)
    return both.select(
        "restaurant_id", "worst_deviation", "worst_quantile", "upper_tail_shortfall", "conformal_gap", passed.alias("passed")
    )
