"""Model features: calendar, menu era, lags and rolling statistics of the strict past."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.calendar import calendar_columns
from . import KEY, SERIES
from .asof import asof_join
from .folds import with_folds

# The feature columns, in the order models read them.
FEATURES = [
    "item_id",
    "service_period",
    "day_of_week",
    "is_weekend",
    "week_of_year",
    "month",
    "era_id",
    "era_days_elapsed",
    "lag_1",
    "lag_7",
    "lag_14",
    "rolling_mean_7",
    "rolling_std_7",
    "rolling_mean_28",
]


def era_asof(rows: DataFrame, eras: DataFrame) -> DataFrame:
    """Last menu reprint on or before the day; days before the first belong to the first.

    Configured eras of all tenants are a handful of rows. A scalar subquery turns them into one sorted
    array, which every row searches without a join. Eras with a ``restaurant_id`` are a table of any
    size; they are joined as of the day, and rows of a tenant without eras get nulls.
    """
    if "restaurant_id" in eras.columns:
        starts = eras.select("restaurant_id", F.col("start_date").alias("_start"), "era_id")
        found = asof_join(rows, starts, ["restaurant_id"], "business_date", "_start", unit="year", before_first=True)
        elapsed = F.greatest(F.lit(0), F.datediff("business_date", "_start"))
        return found.withColumn("era_days_elapsed", F.when(F.col("_start").isNotNull(), elapsed)).drop("_start")
    era = F.struct(F.col("start_date").alias("s"), F.col("era_id").alias("e"))
    joined = rows.withColumn("_eras", eras.agg(F.array_sort(F.collect_list(era))).scalar())
    started = F.filter("_eras", lambda era: era["s"] <= F.col("business_date"))
    era = F.when(F.size(started) > 0, F.element_at(started, -1)).otherwise(F.element_at("_eras", 1))
    elapsed = F.greatest(F.lit(0), F.datediff(F.col("business_date"), era["s"]))
    return joined.withColumns({"era_id": era["e"], "era_days_elapsed": elapsed}).drop("_eras")


def _past(days: str, value: str, keys: list[str]):
    order = Window.partitionBy(*keys).orderBy(days)
    y = F.col(value).cast("double")

    def lag(k: int) -> Column:
        return F.max(y).over(order.rangeBetween(-k, -k))

    week, month = order.rangeBetween(-7, -1), order.rangeBetween(-28, -1)
    return {
        "lag_1": lag(1),
        "lag_7": lag(7),
        "lag_14": lag(14),
        "rolling_mean_7": F.avg(y).over(week),
        "rolling_std_7": F.stddev_samp(y).over(week),
        "rolling_mean_28": F.avg(y).over(month),
    }


def history_columns(rows: DataFrame, value: str = "demand", keys: list[str] = SERIES) -> DataFrame:
    """Lags by calendar day and rolling statistics. Frames end the day before, so a row never sees
    its own value; a window holds one series, at most one row per calendar day."""
    dated = rows.withColumn("_day", F.unix_date("business_date"))
    return dated.withColumns(_past("_day", value, keys)).drop("_day")


def lag_features(rows: DataFrame, value: str = "demand", keys: list[str] = SERIES) -> DataFrame:
    past = history_columns(rows, value, keys)
    return past.drop("rolling_mean_7", "rolling_std_7", "rolling_mean_28")


def rolling_features(rows: DataFrame, value: str = "demand", keys: list[str] = SERIES) -> DataFrame:
    return history_columns(rows, value, keys).drop("lag_1", "lag_7", "lag_14")


def _with_calendar(rows: DataFrame, eras: DataFrame) -> DataFrame:
    return era_asof(rows.withColumns(calendar_columns(F.col("business_date"))), eras)


def feature_frame(demand: DataFrame, folds: DataFrame, eras: DataFrame) -> DataFrame:
    """Features of all training and test rows of every fold.

    Test rows enter the windows without their demand, so deep in a test window the lags are empty,
    exactly as when a whole block is predicted at once. ``demand`` is null on test rows; the
    actual stays in ``actual``.
    """
    day = F.col("business_date")
    is_train = day.between(F.col("train_start"), F.col("train_end"))
    is_test = day.between(F.col("test_start"), F.col("test_end"))
    rows = with_folds(demand, folds).where(is_train | is_test)
    actual = F.col("demand").cast("double")
    rows = rows.select(
        *KEY,
        "fold",
        F.when(is_train, "train").otherwise("test").alias("role"),
        actual.alias("actual"),
        F.when(is_train, actual).alias("demand"),
    )
    past = history_columns(rows, "demand", [*SERIES, "fold"])
    return _with_calendar(past, eras).select(
        "restaurant_id", "business_date", "fold", "role", "actual", "demand", *FEATURES
    )


def day_ahead_features(demand: DataFrame, eras: DataFrame) -> DataFrame:
    """Features when every earlier day is already known: one strict-past pass over the actuals.

    A repeated cell counts once, with its last value by ``seq`` where the column exists.
    """
    order = F.col("seq") if "seq" in demand.columns else F.lit(0)
    once = demand.groupBy(KEY).agg(F.max_by("demand", F.struct(order, "demand")).alias("demand"))
    return _with_calendar(history_columns(once), eras).select("restaurant_id", "business_date", "demand", *FEATURES)


def lag_fill_rate(features: DataFrame, keys: list[str]) -> DataFrame:
    """Share of rows with a known lag."""
    columns = ["lag_1", "lag_7", "rolling_mean_7"]
    return features.groupBy(*keys).agg(
        *[F.avg(F.col(c).isNotNull().cast("int")).alias(f"{c}_fill") for c in columns]
    )
