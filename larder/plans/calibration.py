"""Does the forecast distribution match what happened?"""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from ..operators import KEY
from ..operators.boosting import Settings
from ..operators.conformal import conformal_coverage, conformal_intervals, held_scores, split_days, widened
from ..operators.features import feature_frame
from ..operators.folds import train_rows
from ..operators.joins import salted_join
from ..operators.models import boosted_inputs, fit_boosted, level_rows
from ..operators.quantiles import CELL, checked_levels, empirical_quantiles, required_levels, weekday_samples
from ..operators.scoring import coverage, pit, pit_summary, underage_per_item
from ..sources.staging import stage
from .floors import CURVE_LEVELS, Backtest, end_anchored, recovered


@dataclass
class Calibration:
    run: Backtest
    quantiles: DataFrame
    #: Conformal intervals of the last fold, where they come from trained models.
    intervals: DataFrame | None = None


def calibration_inputs(clean: DataFrame, economics: DataFrame, **windows) -> Calibration:
    """Quantile forecasts of all end-anchored folds on recovered demand."""
    run = end_anchored(recovered(clean), **windows)
    samples = weekday_samples(run.demand, run.folds)
    quantiles = empirical_quantiles(samples, run.targets, required_levels(economics))
    return Calibration(run, quantiles)


def trained_inputs(
    clean: DataFrame,
    eras: DataFrame,
    n_folds: int = 4,
    confidence: float = 0.8,
    settings: Settings = Settings(),
    economics: DataFrame | None = None,
) -> Calibration:
    """The same with boosted quantiles, and conformalised intervals of the last fold.

    The last fold is trained once more on its earlier days; its later days give the scores that move the
    two ends of the interval. Folds and this extra part, at all levels, are one training. With ``economics``
    the levels include every item's own critical ratio; a tenant's curves have those of its items, whatever
    other tenants ask for.
    """
    run = end_anchored(recovered(clean), n_folds=n_folds)
    own = run.folds.select("restaurant_id").distinct().withColumn("own", F.array().cast("array<double>"))
    ratios: list[float] = []
    if economics is not None:
        needed = checked_levels(required_levels(economics, CURVE_LEVELS)).where("quantile is not null")
        needed = stage(needed.groupBy("restaurant_id").agg(F.collect_set("quantile").alias("needed")), "levels")
        own = own.join(needed, "restaurant_id", "left").select("restaurant_id", F.coalesce("needed", "own").alias("own"))
        # One model is trained per level, so the driver holds their names whatever the input.
        ratios = needed.select(F.explode("needed").alias("q")).agg(F.collect_set("q").alias("levels")).first()["levels"]
    features = stage(feature_frame(run.demand, run.folds, eras), "features")
    latest = run.folds.groupBy("restaurant_id").agg(F.max("fold").alias("fold"))
    last = salted_join(features, latest, ["restaurant_id", "fold"], ["business_date"])
    split = split_days(last.where("role = 'train'"))
    last = salted_join(last, split, ["restaurant_id"], ["business_date"])
    held = (F.col("role") == "train") & (F.col("business_date") >= F.col("split_day"))
    # Held-back rows keep their demand in ``actual`` and are predicted like test rows.
    last = last.withColumns({"role": F.when(held, "held").otherwise(F.col("role")), "demand": F.when(~held, F.col("demand"))}).drop("split_day")
    parts = features.withColumn("_part", F.col("fold")).unionByName(last.withColumn("_part", F.lit(n_folds)))
    rows = stage(boosted_inputs(parts, F.col("_part")).drop("_part"), "boosted-rows")
    tails = (round((1 - confidence) / 2, 6), round(1 - (1 - confidence) / 2, 6))
    common = sorted({*CURVE_LEVELS, *tails})
    levels = tuple(sorted({*common, *ratios}))
    model = fit_boosted(rows, levels, settings)
    done = stage(model.predict(rows.where("role <> 'train'"), [*CELL, "part", "role", "actual"]), "quantiles")
    wanted = F.array_union(F.array(*map(F.lit, common)), "own")
    curves = salted_join(done.where(F.col("part") < n_folds), own, ["restaurant_id"], ["business_date"])
    curves = level_rows(curves, levels, [*CELL, "own"], wanted)
    curves = curves.where(F.col("quantile").isin(*CURVE_LEVELS) | F.array_contains("own", F.col("quantile"))).drop("own")
    in_order = F.sort_array(F.array(*[F.get("forecasts", F.lit(levels.index(q))) for q in common]))
    ends = done.where(F.col("part") == n_folds).withColumns({name: F.get(in_order, F.lit(common.index(q))) for name, q in zip(("lo", "hi"), tails)})
    scores = stage(held_scores(ends.where("role = 'held'").withColumn("demand", F.col("actual"))), "held-scores")
    return Calibration(run, curves, widened(ends.where("role = 'test'"), scores, confidence))


def last_fold(folds: DataFrame) -> DataFrame:
    latest = folds.groupBy("restaurant_id").agg(F.max("fold").alias("fold"))
    return folds.join(latest, ["restaurant_id", "fold"]).select(folds.columns)


def conformal(inputs: Calibration, truth: DataFrame, confidence: float = 0.8) -> DataFrame:
    """Independent interval check on the most recent fold."""
    if inputs.intervals is not None:
        return conformal_coverage(inputs.intervals, truth, confidence)
    final = last_fold(inputs.run.folds)
    train = train_rows(inputs.run.demand, final).select(*KEY, "demand")
    targets = inputs.run.targets.join(final.select("restaurant_id", "fold"), ["restaurant_id", "fold"], "left_semi")
    return conformal_coverage(conformal_intervals(train, targets, confidence), truth, confidence)


def calibration_run(
    clean: DataFrame, truth: DataFrame, economics: DataFrame, inputs: Calibration | None = None, **windows
) -> DataFrame:
    """All checks in one long table: section, label, value and row count per tenant."""
    inputs = inputs or calibration_inputs(clean, economics, **windows)
    quantiles = stage(inputs.quantiles, "quantiles")

    def section(df: DataFrame, name: str, label, value: str) -> DataFrame:
        return df.select("restaurant_id", F.lit(name).alias("section"), label.alias("label"), F.col(value).alias("value"), "n")

    level = F.format_string("%.6f", F.col("quantile"))
    by_fold = coverage(quantiles, truth, ["restaurant_id", "fold", "quantile"])
    fold_level = F.concat(F.col("fold").cast("string"), F.lit("/"), level)
    spread = pit_summary(pit(quantiles, truth))
    per_item = underage_per_item(quantiles, truth, economics)
    parts = [
        section(coverage(quantiles, truth), "coverage", level, "empirical"),
        section(by_fold, "coverage_by_fold", fold_level, "empirical"),
        section(spread, "pit", F.lit("mean"), "pit_mean"),
        section(spread, "pit", F.lit("std"), "pit_std"),
        section(per_item, "underage", F.col("item_id"), "empirical_underage"),
        section(conformal(inputs, truth), "conformal", F.lit("coverage"), "empirical_coverage"),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
