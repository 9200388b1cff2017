"""Naive forecasts every model has to beat, for all folds and series in one plan.

Targets carry KEY, ``fold``, ``train_start`` and ``train_end``. A forecast only ever looks at
training days of its fold.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.money import chef_round
from . import KEY, SERIES
from .folds import train_rows
from .joins import salted_join

# Weeks walked back for the same weekday, weeks averaged, Croston smoothing.
LAG_WEEKS = 7
ROLLING_WEEKS = 4
CROSTON_ALPHA = 0.10


def series_means(demand: DataFrame, folds: DataFrame) -> DataFrame:
    return train_rows(demand, folds).groupBy(*SERIES, "fold").agg(F.avg("demand").alias("series_mean"))


def same_weekday_history(demand: DataFrame, targets: DataFrame, group: list[str]) -> DataFrame:
    """One equi-join fetches the last seven same weekdays of every target.

    ``group`` names a target. Where targets carry a training window only days in it are seen.
    """
    day = F.date_sub("business_date", F.col("k") * 7)
    windowed = "train_start" in targets.columns
    visible = day.between(F.col("train_start"), F.col("train_end")) if windowed else F.lit(True)
    asked = targets.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(LAG_WEEKS)))).withColumn(
        "past_day", F.when(visible, day)
    )
    past = demand.select(*SERIES, F.col("business_date").alias("past_day"), F.col("demand").cast("double").alias("past"))
    known = F.col("past").isNotNull()
    return (
        asked.join(past, [*SERIES, "past_day"], "left")
        .groupBy(*group)
        .agg(
            F.min_by("past", F.when(known, F.col("k"))).alias("last_same_weekday"),
            F.min(F.when(known, F.col("k"))).alias("weeks_back"),
            F.avg(F.when(F.col("k") <= ROLLING_WEEKS, F.col("past"))).alias("mean_same_weekday"),
        )
    )


def naive_forecasts(demand: DataFrame, targets: DataFrame, folds: DataFrame) -> DataFrame:
    """Columns lag7, rolling28 and chef_gut per target; no history at all forecasts zero."""
    history = same_weekday_history(demand, targets, [*KEY, "fold"])
    both = history.join(series_means(demand, folds), [*SERIES, "fold"], "left")
    fallback = F.coalesce("series_mean", F.lit(0.0))
    lag7 = F.greatest(F.coalesce("last_same_weekday", fallback), F.lit(0.0))
    rolling = F.greatest(F.coalesce("mean_same_weekday", fallback), F.lit(0.0))
    return both.select(
        *KEY, "fold", lag7.alias("lag7"), rolling.alias("rolling28"), chef_round(rolling).alias("chef_gut")
    )


def long_forecasts(wide: DataFrame, models: list[str]) -> DataFrame:
    return wide.unpivot([*KEY, "fold"], models, "model", "forecast")


def baseline_lag7(demand: DataFrame, targets: DataFrame, folds: DataFrame) -> DataFrame:
    return long_forecasts(naive_forecasts(demand, targets, folds), ["lag7"])


def baseline_rolling28(demand: DataFrame, targets: DataFrame, folds: DataFrame) -> DataFrame:
    return long_forecasts(naive_forecasts(demand, targets, folds), ["rolling28"])


def baseline_chef_gut(demand: DataFrame, targets: DataFrame, folds: DataFrame) -> DataFrame:
    return long_forecasts(naive_forecasts(demand, targets, folds), ["chef_gut"])


#: Occurrences per slice of a series; a slice is one linear map of the smoothing state.
SLICE = 64


def _sliced(values: str, of) -> Column:
    """``of(slice number)`` for every slice of an array column, the last one possibly empty."""
    return F.transform(F.sequence(F.lit(0), F.floor(F.size(values) / SLICE).cast("int")), of)


def _slice_maps(values: str, alpha: float) -> Column:
    """What each slice adds to the state; what came in is multiplied by ``(1 - alpha) ** SLICE``."""

    def added(number: Column) -> Column:
        inside = F.slice(values, number * SLICE + 1, SLICE)
        return F.aggregate(inside, F.lit(0.0), lambda state, x: alpha * x + (1 - alpha) * state)

    return _sliced(values, added)


def _smoothed(values: str, maps: str, n: Column, alpha: float) -> Column:
    """Smoothing from zero over the first ``n`` values: whole slices by their maps, then the rest."""
    whole = F.floor(n / SLICE).cast("int")
    head = F.aggregate(F.slice(maps, 1, whole), F.lit(0.0), lambda state, m: m + (1 - alpha) ** SLICE * state)
    rest = F.slice(values, whole * SLICE + 1, n - whole * SLICE)
    return F.aggregate(rest, head, lambda state, x: alpha * x + (1 - alpha) * state)


def _slice_ends(values: str) -> Column:
    return _sliced(values, lambda number: F.get(values, number * SLICE + SLICE - 1))


def _count_upto(values: str, ends: str, bound: Column) -> Column:
    """How many of an ascending array's values are at most ``bound``, looking into one slice only."""
    whole = F.size(F.filter(ends, lambda x: x <= bound)) * SLICE
    return whole + F.size(F.filter(F.slice(values, whole + 1, SLICE), lambda x: x <= bound))


def croston_rates(demand: DataFrame, folds: DataFrame, alpha: float = CROSTON_ALPHA, textbook: bool = False) -> DataFrame:
    """One rate per fold and series: smoothed demand size over smoothed interval.

    By default the interval is looked up by day position, not by occurrence number, which keeps
    results comparable; ``textbook`` pairs each occurrence with its own interval.

    A smoothing step is a linear map, so a slice of occurrences is one map too. A series is put in
    order and cut into slices once per start of training; every fold that starts there then combines
    the maps before its end and a part of one slice. A series holds at most one value per calendar
    day, which bounds its array; a series that never sold rates zero.
    """
    point = F.struct("business_date", F.col("demand").cast("double").alias("demand"))
    whole = demand.groupBy(SERIES).agg(F.array_sort(F.collect_list(point)).alias("days"))
    ends = F.collect_list(F.struct("fold", "train_end"))
    spans = folds.groupBy("restaurant_id", "train_start").agg(ends.alias("ends"))
    seen = F.filter("days", lambda d: d["business_date"] >= F.col("train_start"))
    placed = F.transform("seen", lambda d, i: F.struct(i.alias("place"), d["business_date"].alias("day"), d["demand"].alias("size")))
    steps = F.transform("hits", lambda h, i: h["place"] - F.when(i == 0, F.lit(0)).otherwise(F.get("hits", i - 1)["place"]))
    series = (
        salted_join(whole, spans, ["restaurant_id"], SERIES)
        .withColumn("seen", seen)
        .withColumn("hits", F.filter(placed, lambda h: h["size"] > 0))
        .withColumn("gaps", F.filter(steps, lambda gap: gap > 0))
        .withColumns(
            {
                "dates": F.transform("hits", lambda h: h["day"]),
                "sizes": F.transform("hits", lambda h: h["size"]),
                "places": F.transform("hits", (lambda h, i: i) if textbook else (lambda h: h["place"])),
                # The day a series starts on is no interval; every later occurrence ends one.
                "dropped": F.size("hits") - F.size("gaps"),
            }
        )
        .withColumn("paired", F.transform("places", lambda place: F.coalesce(F.get("gaps", place).cast("double"), F.lit(1.0))))
        .withColumns(
            {
                "date_ends": _slice_ends("dates"),
                "place_ends": _slice_ends("places"),
                "size_maps": _slice_maps("sizes", alpha),
                "gap_maps": _slice_maps("paired", alpha),
            }
        )
    )
    kept = F.lit(1 - alpha)

    def counted(end: Column) -> Column:
        return F.struct(end["fold"].alias("fold"), _count_upto("dates", "date_ends", end["train_end"]).alias("n"))

    def split(fold: Column) -> Column:
        """Occurrences that have an interval of their own before the window's last one; the rest share that."""
        last = fold["n"] - F.col("dropped") - 1
        own = F.least(_count_upto("places", "place_ends", last - 1), fold["n"])
        gap = F.coalesce(F.get("gaps", F.greatest(last, F.lit(-1))).cast("double"), F.lit(1.0))
        return F.struct(fold["fold"].alias("fold"), fold["n"].alias("n"), own.alias("own"), gap.alias("gap"))

    def rate(fold: Column) -> Column:
        size = F.pow(kept, fold["n"]) * F.get("sizes", F.lit(0)) + _smoothed("sizes", "size_maps", fold["n"], alpha)
        shared = F.pow(kept, fold["n"] - fold["own"])
        gap = F.pow(kept, fold["n"]) + shared * _smoothed("paired", "gap_maps", fold["own"], alpha) + fold["gap"] * (1 - shared)
        known = F.when(fold["n"] > 0, size / F.greatest(gap, F.lit(1.0))).otherwise(0.0)
        return F.struct(fold["fold"].alias("fold"), known.alias("forecast"))

    per_fold = series.withColumn("ends", F.transform("ends", counted)).withColumn("ends", F.transform("ends", split))
    return per_fold.select(*SERIES, F.inline(F.transform("ends", rate)))


def baseline_croston(
    demand: DataFrame, targets: DataFrame, folds: DataFrame, alpha: float = CROSTON_ALPHA, textbook: bool = False
) -> DataFrame:
    rates = croston_rates(demand, folds, alpha, textbook)
    return targets.join(rates, [*SERIES, "fold"], "left").select(
        *KEY, "fold", F.lit("croston").alias("model"), F.coalesce("forecast", F.lit(0.0)).alias("forecast")
    )
