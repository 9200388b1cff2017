import datetime as dt
import math

import pandas as pd
from pyspark.sql import functions as F

from larder.operators import models
from larder.operators.boosting import Settings
from larder.operators.features import feature_frame
from larder.operators.folds import forecast_frame, walk_forward_folds
from larder.plans import floors
from larder.sources.staging import stage

DAY = dt.date(2024, 1, 1)
FEW = Settings(rounds=12, step=0.25, depth=4)


def weekly(spark):
    rows = [
        ("r0", DAY + dt.timedelta(d), item, period, int(base + 4 * math.sin(d % 7)) + d % 3, d % 20 == 5)
        for d in range(200)
        for item, base in (("rib", 20), ("cod", 6))
        for period in ("lunch", "dinner")
    ]
    return spark.createDataFrame(rows, "restaurant_id string, business_date date, item_id string, service_period string, demand bigint, censored boolean")


def test_models_learn_the_level_and_stay_in_range(spark):
    demand = stage(weekly(spark), "weekly")
    eras = spark.createDataFrame([(DAY, 0)], "start_date date, era_id int")
    folds = walk_forward_folds(demand)
    features = stage(feature_frame(demand, folds, eras), "weekly-features")
    for kind in ("gbm", "poisson"):
        errors = (
            models.point_gbm(features, 4, kind, settings=FEW)
            .join(features.where("role = 'test'"), [*models.KEY, "fold"])
            .agg(F.avg(F.abs(F.col("forecast") - F.col("actual"))).alias("mae"), F.min("forecast").alias("low"), F.count("*").alias("n"))
            .first()
        )
        assert errors.n == 4 * 28 * 4 and errors.low >= 0 and errors.mae < 3
    train, test = models.fold_split(features, 3)
    curves = models.forest_quantiles(train, test, (0.1, 0.5, 0.9), trees=5)
    wide = curves.groupBy(*models.CELL).pivot("quantile", [0.1, 0.5, 0.9]).agg(F.first("forecast"))
    assert wide.where("`0.1` > `0.5` or `0.5` > `0.9` or `0.1` < 0").count() == 0 and wide.count() == 28 * 4
    rows = stage(models.boosted_inputs(features, F.col("fold")), "weekly-rows")
    top = models.feature_importance(models.fit_boosted(rows, settings=Settings(rounds=3)), spark).collect()
    assert len(top) == 4 * len(models.BOOSTED_NUMBERS + models.BOOSTED_CATEGORIES) and abs(sum(r.importance for r in top) - 4) < 1e-6


def test_plugged_in_model_sees_only_its_history(spark):
    demand = stage(weekly(spark), "weekly")
    folds = walk_forward_folds(demand)

    def newest(history: pd.DataFrame, cells: pd.DataFrame) -> pd.Series:
        assert history["business_date"].max() < cells["business_date"].min()
        return pd.Series(len(history), index=cells.index)

    out = models.model_contract(demand, forecast_frame(demand, folds), newest, "count").collect()
    assert {(r.fold, r.forecast) for r in out} == {(f, 84.0 + 28 * f) for f in range(4)}


def test_jobs(spark):
    demand = weekly(spark)
    eras = spark.createDataFrame([(DAY, 0)], "start_date date, era_id int")
    economics = spark.createDataFrame([("r0", "rib", "batch", 4.0, 6.0), ("r0", "cod", "made_to_order", 3.0, 9.0)], "restaurant_id string, item_id string, prep_type string, co double, cu double")
    truth = demand.select(*models.KEY, (F.col("demand") + F.col("censored").cast("int") * 3).alias("true_demand"))
    gate = floors.unconstrain_gate(floors.unconstrain_floor(demand, truth, economics, eras, settings=FEW)).first()
    assert abs(gate.clean_cost - gate.clean_touching - gate.clean_rest) < 1e-6 and gate.passed == (gate.improvement > 0)
    ahead = floors.day_ahead_run(demand, economics, eras, settings=FEW)
    assert ahead.count() == 14 * 4 and ahead.where("lag_1_fill < 1 or dollar_cost < 0").count() == 0
    trained = floors.newsvendor_trained(demand, economics, eras, settings=FEW)
    assert {(r.item_id, r.model) for r in trained.collect()} == {("rib", "point_as_mean"), ("rib", "quantile_newsvendor")}
    policy = floors.newsvendor_floor(demand, economics)
    assert {r.item_id for r in policy.select("item_id").collect()} == {"rib"}
    assert {r.model for r in floors.backtest(demand, economics, ["lag7", "croston"]).collect()} == {"lag7", "croston"}
