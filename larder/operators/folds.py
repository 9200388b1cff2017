"""Walk-forward folds: windows per tenant, row assignment, leakage check, target frames."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from . import KEY
from .joins import salted_join

FOLD_COLUMNS = ["restaurant_id", "fold", "train_start", "train_end", "test_start", "test_end"]


def _spans(demand: DataFrame) -> DataFrame:
    return demand.groupBy("restaurant_id").agg(
        F.min("business_date").alias("first_day"), F.max("business_date").alias("last_day")
    )


def _windows(spans: DataFrame, n_folds: int, test_days: int, train_days: Column, stretch_last: bool) -> DataFrame:
    total = F.datediff("last_day", "first_day") + 1
    needed = train_days + n_folds * test_days
    message = F.concat(
        F.lit("not enough history for "),
        F.col("restaurant_id"),
        F.lit(": need "),
        needed.cast("string"),
        F.lit(" days, have "),
        total.cast("string"),
    )
    checked = F.when(total < needed, F.raise_error(message).cast("int")).otherwise(train_days)
    folds = spans.withColumn("train_days", checked).withColumn(
        "slot", F.explode(F.sequence(F.lit(0), F.lit(n_folds - 1)))
    )
    start = F.date_add("first_day", (F.col("train_days") + F.col("slot") * test_days).cast("int"))
    end = F.date_add(start, test_days - 1)
    if stretch_last:
        end = F.when(F.col("slot") == n_folds - 1, F.greatest(end, F.col("last_day"))).otherwise(end)
    return folds.select("restaurant_id", "slot", "first_day", start.alias("from_day"), end.alias("to_day"))


def _on_actual_days(windows: DataFrame, demand: DataFrame) -> DataFrame:
    """Report the first and last day that really has rows; a window without any is dropped."""
    days = demand.select("restaurant_id", "business_date").distinct()
    day = F.col("business_date")
    train, test = day < F.col("from_day"), day.between(F.col("from_day"), F.col("to_day"))
    found = (
        days.join(windows, "restaurant_id")
        .where(day.between(F.col("first_day"), F.col("to_day")))
        .groupBy("restaurant_id", "slot")
        .agg(
            F.min(F.when(train, day)).alias("train_start"),
            F.max(F.when(train, day)).alias("train_end"),
            F.min(F.when(test, day)).alias("test_start"),
            F.max(F.when(test, day)).alias("test_end"),
        )
        .where("train_end is not null and test_end is not null")
    )
    number = F.row_number().over(Window.partitionBy("restaurant_id").orderBy("slot")) - 1
    return found.withColumn("fold", number).select(FOLD_COLUMNS)


def _check_count(n_folds: int) -> None:
    if n_folds < 4:
        raise ValueError(f"n_folds must be at least 4, got {n_folds}")


def walk_forward_folds(
    demand: DataFrame, n_folds: int = 4, test_weeks: int = 4, min_train_weeks: int = 12
) -> DataFrame:
    """Expanding training windows from each tenant's first day, test always strictly after."""
    _check_count(n_folds)
    windows = _windows(_spans(demand), n_folds, test_weeks * 7, F.lit(min_train_weeks * 7), stretch_last=False)
    return _on_actual_days(windows, demand)


def tail_folds(demand: DataFrame, n_folds: int = 4, test_weeks: int = 4) -> DataFrame:
    """Folds that end at each tenant's last day; the last test window is stretched to reach it."""
    _check_count(n_folds)
    days = F.datediff("last_day", "first_day") + 1
    weeks = F.greatest(F.lit(1), F.floor((days - n_folds * test_weeks * 7) / 7)).cast("int")
    return _on_actual_days(
        _windows(_spans(demand), n_folds, test_weeks * 7, weeks * 7, stretch_last=True), demand
    )


def with_folds(rows: DataFrame, folds: DataFrame) -> DataFrame:
    """Rows repeated once per fold of their tenant; a tenant with most rows is spread by day."""
    return salted_join(rows, folds, ["restaurant_id"], ["business_date"])


def fold_range_join(rows: DataFrame, folds: DataFrame) -> DataFrame:
    """Assign rows to the train or test side of every fold they fall in."""
    day = F.col("business_date")
    role = F.when(day.between(F.col("train_start"), F.col("train_end")), "train").when(
        day.between(F.col("test_start"), F.col("test_end")), "test"
    )
    return with_folds(rows, folds).withColumn("role", role).where("role is not null")


def train_rows(rows: DataFrame, folds: DataFrame) -> DataFrame:
    return with_folds(rows, folds).where(F.col("business_date").between(F.col("train_start"), F.col("train_end")))


def test_rows(rows: DataFrame, folds: DataFrame) -> DataFrame:
    return with_folds(rows, folds).where(F.col("business_date").between(F.col("test_start"), F.col("test_end")))


def forecast_frame(demand: DataFrame, folds: DataFrame) -> DataFrame:
    """Cells to predict: every test day x item x daypart of the tenant.

    The item and daypart lists of a tenant travel as one array row and are unfolded next to the
    days, so no product is shuffled.
    """
    menu = demand.groupBy("restaurant_id").agg(
        F.collect_set("item_id").alias("items"), F.collect_set("service_period").alias("periods")
    )
    days = test_rows(demand.select("restaurant_id", "business_date").distinct(), folds)
    cells = salted_join(days, menu, ["restaurant_id"], ["business_date"]).withColumn("item_id", F.explode("items"))
    return cells.withColumn("service_period", F.explode("periods")).select(
        *KEY, "fold", "train_start", "train_end", "test_start", "test_end"
    )


def leakage_canary(folds: DataFrame) -> DataFrame:
    """Folds whose last training day is not before the first test day."""
    return folds.where(F.col("train_end") >= F.col("test_start"))


def assert_no_leakage(folds: DataFrame) -> DataFrame:
    """Pass folds through; a leaking one fails the job when it is read."""
    message = F.concat(F.lit("training data reaches into the test window of fold "), F.col("fold").cast("string"))
    end = F.when(F.col("train_end") >= F.col("test_start"), F.raise_error(message).cast("date"))
    return folds.withColumn("train_end", end.otherwise(F.col("train_end")))
