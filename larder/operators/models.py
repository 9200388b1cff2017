"""Global forecasting models, and the contract for plugging in others.

One model learns from all tenants and series at once: boosted trees with a count loss or with one loss per
quantile level (``boosting``), which train all folds in one pass, or Poisson regression and a quantile forest
from Spark ML, which train fold by fold. Trees see an item as a category; items beyond the most frequent
ones are told apart by the level of their series alone, so the number of inputs does not grow with the menu.
"""
from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from multiprocessing.pool import ThreadPool

import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.ml import PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GeneralizedLinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.storagelevel import StorageLevel

from . import KEY, SERIES, boosting
from .joins import salted_join, shuffle_width
from .quantiles import CELL, STANDARD_LEVELS, noncrossing

SEED = 42
_PAST = ["lag_1", "lag_7", "lag_14", "rolling_mean_7", "rolling_std_7", "rolling_mean_28"]
_CALENDAR = ["daypart", "day_of_week", "is_weekend", "week_of_year", "month", "era_id", "era_days_elapsed"]
TREE_INPUTS = ["level", *_CALENDAR, *_PAST, *[f"{c}_missing" for c in _PAST]]
BOOSTED_NUMBERS = ["level", "is_weekend", "week_of_year", "month", "era_days_elapsed", *_PAST]
BOOSTED_CATEGORIES = ["item", "service_period", "day_of_week", "era_id"]
LINEAR_INPUTS = ["log_level", "is_dinner", *[f"dow_{d}" for d in range(1, 7)], "log_mean_28", "log_lag_7"]


def series_levels(train: DataFrame) -> DataFrame:
    """Mean training demand per series, and a number for its daypart: the mean rank of that daypart's
    demand among those of its item, so that any number of dayparts stays apart."""
    levels = train.groupBy(SERIES).agg(F.avg("demand").alias("level"))
    item = Window.partitionBy("restaurant_id", "item_id").orderBy("level", "service_period")
    ranked = levels.withColumn("place", F.row_number().over(item))
    dayparts = ranked.groupBy("restaurant_id", "service_period").agg(F.avg("place").alias("daypart"))
    return levels.join(dayparts, ["restaurant_id", "service_period"])


def encode(features: DataFrame, levels: DataFrame) -> DataFrame:
    """Numeric inputs; an unknown lag becomes -1 with its own indicator."""
    rows = features.join(levels, SERIES, "left").withColumns(
        {
            "level": F.coalesce("level", F.lit(0.0)),
            "daypart": F.coalesce("daypart", F.lit(0.0)),
            "is_dinner": (F.col("service_period") == "dinner").cast("int"),
        }
    )
    rows = rows.withColumns({f"{c}_missing": F.col(c).isNull().cast("int") for c in _PAST})
    rows = rows.withColumns({f"dow_{d}": (F.col("day_of_week") == d).cast("int") for d in range(1, 7)})
    rows = rows.withColumns(
        {
            "log_level": F.log1p("level"),
            "log_mean_28": F.log1p(F.coalesce("rolling_mean_28", "level")),
            "log_lag_7": F.log1p(F.coalesce("lag_7", "level")),
        }
    )
    return rows.fillna(-1.0, subset=_PAST)


def _fit(train: DataFrame, inputs: list[str], estimator) -> PipelineModel:
    """Fit on rows spread over all tasks and kept, on disk if need be, while the learner iterates."""
    assembler = VectorAssembler(inputCols=inputs, outputCol="inputs")
    rows = assembler.transform(train).select(*KEY, "inputs", "demand")
    rows = rows.repartition(shuffle_width(rows), *KEY).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        model = estimator.setFeaturesCol("inputs").setLabelCol("demand").fit(rows)
    finally:
        rows.unpersist()
    return PipelineModel([assembler, model])


def fit_poisson(train: DataFrame, rounds: int = 25) -> PipelineModel:
    """Poisson regression with a log link over all series."""
    glm = GeneralizedLinearRegression(family="poisson", link="log", maxIter=rounds, regParam=1e-6)
    return _fit(train, LINEAR_INPUTS, glm)


def boosted_inputs(features: DataFrame, part: Column) -> DataFrame:
    """Rows with their part and the inputs of the boosted trees. ``role`` tells a part's training rows; the
    level of a series is its mean demand among those."""
    rows = features.withColumn("part", part.cast("int"))
    levels = rows.where("role = 'train'").groupBy("part", *SERIES).agg(F.avg("demand").alias("level"))
    texts = {c: F.col(c).cast("string") for c in BOOSTED_CATEGORIES[1:]}
    item = F.to_json(F.array("restaurant_id", "item_id"))
    return rows.join(levels, ["part", *SERIES], "left").withColumns({**texts, "item": item, "is_weekend": F.col("is_weekend").cast("int")})


def fit_boosted(rows: DataFrame, levels: tuple[float, ...] | None = None, settings: boosting.Settings = boosting.Settings()) -> boosting.Boosted:
    """All parts of ``boosted_inputs`` trained side by side: for counts, or for the quantile ``levels``."""
    return boosting.train(rows.where("role = 'train'"), "demand", BOOSTED_NUMBERS, BOOSTED_CATEGORIES, levels, settings)


def boosted_point(
    features: DataFrame, name: str = "gbm", settings: boosting.Settings = boosting.Settings(), part: Column | None = None, keep: tuple[str, ...] = tuple(CELL)
) -> DataFrame:
    """Count forecasts of the test rows, every fold by the model of its own training rows."""
    rows = boosted_inputs(features, F.col("fold") if part is None else part)
    done = fit_boosted(rows, None, settings).predict(rows.where("role = 'test'"), keep)
    return done.select(*keep, F.get("forecasts", F.lit(0)).alias("forecast"), F.lit(name).alias("model"))


def level_rows(forecasts: DataFrame, levels: tuple[float, ...], cell: list[str], wanted: Column | None = None) -> DataFrame:
    """A row per level from an array of forecasts, in order: the sorted forecasts go to the sorted levels.
    ``wanted`` has the levels to be told per row, all by default; forecasts at others do not change them."""
    names, found = F.array(*[F.lit(q) for q in sorted(levels)]), F.col("forecasts")
    if wanted is not None:
        found = F.filter(found, lambda _, i: F.array_contains(wanted, F.get(names, i)))
        names = F.filter(names, lambda q: F.array_contains(wanted, q))
    pairs = F.arrays_zip(names.alias("quantile"), F.sort_array(found).alias("forecast"))
    return forecasts.select(*cell, F.inline(pairs)).toDF(*cell, "quantile", "forecast")


def boosted_quantiles(features: DataFrame, levels: tuple[float, ...] = STANDARD_LEVELS, settings: boosting.Settings = boosting.Settings()) -> DataFrame:
    """Quantile forecasts of the test rows: one model per fold and level, all trained in one pass."""
    rows = boosted_inputs(features, F.col("fold"))
    return level_rows(fit_boosted(rows, levels, settings).predict(rows.where("role = 'test'"), CELL), levels, CELL)


POINT_MODELS: dict[str, Callable[[DataFrame], PipelineModel]] = {"poisson": fit_poisson}


def predict_point(model: PipelineModel, rows: DataFrame) -> DataFrame:
    return model.transform(rows).withColumn("forecast", F.greatest("prediction", F.lit(0.0)))


def fold_split(features: DataFrame, fold: int) -> tuple[DataFrame, DataFrame]:
    """Encoded train and test rows of one fold; levels come from its training rows only."""
    of_fold = features.where(F.col("fold") == fold)
    train = of_fold.where("role = 'train'")
    levels = series_levels(train)
    return encode(train, levels), encode(of_fold.where("role = 'test'"), levels)


def point_gbm(
    features: DataFrame, n_folds: int, kind: str = "gbm", name: str | None = None, settings: boosting.Settings = boosting.Settings()
) -> DataFrame:
    """Point forecasts of every fold's test cells. ``features`` should be a staged feature frame.

    ``gbm`` trains all folds in one pass. Spark ML models train one fold each, side by side.
    """
    if kind == "gbm":
        return boosted_point(features, name or kind, settings)

    def forecast(fold: int) -> DataFrame:
        train, test = fold_split(features, fold)
        return predict_point(POINT_MODELS[kind](train), test).select(*CELL, "forecast")

    with ThreadPool(n_folds) as pool:
        parts = pool.map(inheritable_thread_target(features.sparkSession)(forecast), range(n_folds))
    return reduce(DataFrame.unionByName, parts).withColumn("model", F.lit(name or kind))


def forest_by_fold(features: DataFrame, n_folds: int, levels: tuple[float, ...] = STANDARD_LEVELS, trees: int = 100) -> DataFrame:
    """Quantile forecasts of every fold's test cells, one forest per fold."""
    parts = [forest_quantiles(*fold_split(features, fold), levels, trees) for fold in range(n_folds)]
    return reduce(DataFrame.unionByName, parts)


def feature_importance(model: boosting.Boosted, spark) -> DataFrame:
    """Inputs of every part's trees, ranked by their share of the splits."""
    rows = [(part, name, share) for part, _, name, share in model.importance()]
    return spark.createDataFrame(rows, "fold int, feature string, importance double").orderBy("fold", F.desc("importance"), "feature")


def fit_forest(train: DataFrame, trees: int = 100, depth: int = 5) -> PipelineModel:
    forest = RandomForestRegressor(numTrees=trees, maxDepth=depth, minInstancesPerNode=5, seed=SEED, leafCol="leaves")
    return _fit(train, TREE_INPUTS, forest)


def _leaf_rows(model: PipelineModel, rows: DataFrame) -> DataFrame:
    leaves = vector_to_array("leaves")
    return model.transform(rows).select("*", F.posexplode(leaves).alias("tree", "leaf"))


def forest_quantiles(
    train: DataFrame, test: DataFrame, levels: tuple[float, ...] = STANDARD_LEVELS, trees: int = 100, depth: int = 5
) -> DataFrame:
    """Quantile forest: percentiles of the training demand in each leaf, averaged over the trees.

    ``percentile`` counts equal values on the map side, so a leaf holding most rows costs one entry
    per distinct demand. The leaf table has at most trees x 2^depth rows, which bounds the
    broadcast.
    """
    model = fit_forest(train, trees, depth)
    grid = F.array(*[F.lit(q) for q in levels])
    by_leaf = _leaf_rows(model, train).groupBy("tree", "leaf").agg(F.percentile("demand", grid).alias("xs"))
    reached = _leaf_rows(model, test).select(*CELL, "tree", "leaf")
    means = reached.join(F.broadcast(by_leaf), ["tree", "leaf"]).groupBy(CELL).agg(
        *[F.avg(F.get("xs", F.lit(i))).alias(f"x{i}") for i in range(len(levels))]
    )
    pairs = F.array(
        *[F.struct(F.lit(q).alias("quantile"), F.col(f"x{i}").alias("forecast")) for i, q in enumerate(levels)]
    )
    return noncrossing(means.select(*CELL, F.inline(pairs)))


def model_contract(
    demand: DataFrame,
    targets: DataFrame,
    predict: Callable[[pd.DataFrame, pd.DataFrame], pd.Series],
    name: str,
) -> DataFrame:
    """Run any per-series model: ``predict(history, cells)`` returns one forecast per cell.

    ``history`` holds a fold's training rows of one series (business_date, demand), ``cells`` the
    days to predict. A series has at most one row per calendar day, so a group always fits a task.
    """
    schema = targets.select(*CELL).schema.add("forecast", "double")
    columns = schema.names

    def run(history: pd.DataFrame, cells: pd.DataFrame) -> pd.DataFrame:
        past = history[["business_date", "demand"]].sort_values("business_date", ignore_index=True)
        cells = cells.sort_values("business_date", ignore_index=True)
        forecast = pd.Series(predict(past, cells[["business_date"]])).astype(float)
        return cells.assign(forecast=forecast.clip(lower=0.0).to_numpy())[columns]

    group = [*SERIES, "fold"]
    bounds = targets.select("restaurant_id", "fold", "train_start", "train_end").distinct()
    history = salted_join(demand, bounds, ["restaurant_id"], ["business_date"]).where(
        F.col("business_date").between(F.col("train_start"), F.col("train_end"))
    )
    # Both sides may stem from one table; fresh column identities keep the pairing unambiguous.
    past_side = history.select(*[F.col(c).alias(c) for c in [*CELL, "demand"]])
    return (
        past_side.groupBy(*group)
        .cogroup(targets.select(*[F.col(c).alias(c) for c in CELL]).groupBy(*group))
        .applyInPandas(run, schema)
        .withColumn("model", F.lit(name))
    )
