"""Predictive distributions as sampled quantiles, and the prep decision read off them.

A quantile table holds one row per cell and level: the cell's key columns, ``quantile`` and
``forecast``. Curves are grouped per cell, so a group never holds more rows than there are levels.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.money import critical_ratio
from . import KEY, SERIES
from .folds import train_rows
from .joins import salted_join

# Quantile levels every model serves.
STANDARD_LEVELS = (0.05, 0.10, 0.25, 0.50, 0.75, 0.90, 0.95, 0.99)
CELL = [*KEY, "fold"]


def route_batch(economics: DataFrame) -> DataFrame:
    """Items prepped in batches; the others never get a portion count."""
    return economics.where(F.col("prep_type") == "batch")


def q_star() -> Column:
    return F.round(critical_ratio(F.col("co"), F.col("cu")), 6)


def required_levels(economics: DataFrame, standard: tuple[float, ...] = STANDARD_LEVELS) -> DataFrame:
    """Standard levels and every item's own critical ratio, once per tenant."""
    own = economics.select("restaurant_id", q_star().alias("quantile"))
    grid = F.array(*[F.lit(round(q, 6)) for q in standard])
    fixed = economics.select("restaurant_id").distinct().withColumn("quantile", F.explode(grid))
    return fixed.unionByName(own).distinct()


def checked_levels(levels: DataFrame) -> DataFrame:
    """Levels rounded, distinct and strictly between 0 and 1; anything else fails the job."""
    q = F.round("quantile", 6)
    bad = F.concat(F.lit("quantile level outside (0, 1): "), q.cast("string"))
    ok = F.when((q <= 0) | (q >= 1), F.raise_error(bad).cast("double")).otherwise(q)
    return levels.select("restaurant_id", ok.alias("quantile")).distinct()


def interpolated(sorted_values: Column, q: Column) -> Column:
    """Linear percentile of a sorted array."""
    place = q * (F.size(sorted_values) - 1)
    low = F.floor(place).cast("int")
    high = F.least(low + 1, F.size(sorted_values) - 1)
    a, b = F.get(sorted_values, low), F.get(sorted_values, high)
    return a + (b - a) * (place - low)


#: Keys of one distribution: what all cells of a series, fold and weekday share.
WEEK = [*SERIES, "fold", "day_of_week"]


def weekday_samples(demand: DataFrame, folds: DataFrame) -> DataFrame:
    """Per fold and series, ``whole``: its sorted training demand, and ``fine``: the same per weekday.

    One aggregate; both hold at most one value per calendar day. Demand staged by series is not shuffled.
    """
    y = F.struct(F.col("demand").cast("double").alias("y"), F.weekday("business_date").alias("day_of_week"))
    rows = train_rows(demand, folds).groupBy(*SERIES, "fold").agg(F.sort_array(F.collect_list(y)).alias("days"))
    values = lambda days: F.transform(days, lambda d: d["y"])
    fine = F.transform(
        F.sequence(F.lit(0), F.lit(6)), lambda n: values(F.filter("days", lambda d: d["day_of_week"] == n))
    )
    return rows.select(*SERIES, "fold", values(F.col("days")).alias("whole"), fine.alias("fine"))


def _per_weekday(samples: DataFrame, read, name: str, min_history: int) -> DataFrame:
    """``read(sample)`` for every weekday; one with fewer than ``min_history`` days borrows the whole series."""
    whole = samples.withColumn("_whole", read(F.col("whole")))
    days = F.transform(
        "fine",
        lambda sample, n: F.struct(
            n.alias("day_of_week"), F.when(F.size(sample) >= min_history, read(sample)).otherwise(F.col("_whole")).alias(name)
        ),
    )
    return whole.select(*SERIES, "fold", F.inline(days))


def at_targets(weekly: DataFrame, targets: DataFrame) -> DataFrame:
    """What is known per WEEK, at every target of that series, fold and weekday."""
    return targets.withColumn("day_of_week", F.weekday("business_date")).join(weekly, WEEK)


def weekday_quantiles(samples: DataFrame, levels: DataFrame, min_history: int = 8) -> DataFrame:
    """Per WEEK the array ``pairs`` of (quantile, forecast) at the tenant's levels.

    Levels meet a series once, before its weekdays are unfolded, so no sample is copied.
    """
    per_tenant = checked_levels(levels).groupBy("restaurant_id").agg(F.sort_array(F.collect_list("quantile")).alias("qs"))

    def read(sample: Column) -> Column:
        return F.transform(
            "qs",
            lambda q: F.struct(q.alias("quantile"), F.greatest(interpolated(sample, q), F.lit(0.0)).alias("forecast")),
        )

    return _per_weekday(salted_join(samples, per_tenant, ["restaurant_id"], SERIES), read, "pairs", min_history)


def long_quantiles(curves: DataFrame, cell: list[str] = CELL) -> DataFrame:
    """One row per level of ``pairs``."""
    return curves.select(*cell, F.inline("pairs"))


def empirical_quantiles(samples: DataFrame, targets: DataFrame, levels: DataFrame) -> DataFrame:
    """Forecast table from the empirical distribution of each series and weekday.

    Curves travel as one row each and are unfolded at their targets.
    """
    return long_quantiles(at_targets(weekday_quantiles(samples, levels), targets))


def weekday_means(samples: DataFrame, min_history: int = 8) -> DataFrame:
    """Point forecast from the same distributions, per WEEK: the mean of each sample."""

    def mean(sample: Column) -> Column:
        return F.greatest(F.aggregate(sample, F.lit(0.0), lambda total, y: total + y) / F.size(sample), F.lit(0.0))

    return _per_weekday(samples, mean, "forecast", min_history)


def empirical_policy(samples: DataFrame, targets: DataFrame, economics: DataFrame) -> DataFrame:
    """Prep quantities of the empirical distributions: decided once per WEEK, not once per target."""
    weekly = long_quantiles(weekday_quantiles(samples, required_levels(economics)), WEEK)
    return at_targets(newsvendor_policy(weekly, economics, WEEK), targets).select(
        *CELL, "critical_ratio", "prep_quantity", "expected_waste", "expected_stockout"
    )


def noncrossing(quantiles: DataFrame, cell: list[str] = CELL) -> DataFrame:
    """Per cell, hand the sorted forecasts to the sorted levels, never below zero."""
    row = F.struct("quantile", "forecast")
    curves = quantiles.groupBy(cell).agg(
        F.sort_array(F.collect_list("quantile")).alias("q"),
        F.sort_array(F.collect_list(F.greatest("forecast", F.lit(0.0)))).alias("x"),
    )
    pairs = F.explode(F.arrays_zip("q", "x")).alias("pair")
    return curves.select(*cell, pairs).select(
        *cell, F.col("pair.q").alias("quantile"), F.col("pair.x").alias("forecast")
    )


def crossing_cells(quantiles: DataFrame, cell: list[str] = CELL) -> DataFrame:
    """Cells whose forecasts fall somewhere along the levels."""
    prior = F.lag("forecast").over(Window.partitionBy(*cell).orderBy("quantile"))
    drops = quantiles.withColumn("fall", prior - F.col("forecast")).where(F.col("fall") > 1e-9)
    return drops.groupBy(cell).agg(F.max("fall").alias("worst_fall"))


def quantile_curve(quantiles: DataFrame, cell: list[str] = CELL) -> DataFrame:
    """One row per cell with its CDF anchors, an array of (q, x) starting at (0, 0) when the lowest
    forecast is above zero. Crossing forecasts fail the job."""
    point = F.struct(F.col("quantile").alias("q"), F.col("forecast").cast("double").alias("x"))
    curves = quantiles.groupBy(cell).agg(F.array_sort(F.collect_list(point)).alias("pts"))
    origin = F.array(F.struct(F.lit(0.0).alias("q"), F.lit(0.0).alias("x")))
    pts = F.col("pts")
    anchored = F.when(F.get(pts, F.lit(0))["x"] > 0, F.concat(origin, pts)).otherwise(pts)
    falls = F.exists(
        F.sequence(F.lit(1), F.greatest(F.size(pts) - 1, F.lit(1))),
        lambda i: F.coalesce(F.get(pts, i)["x"] - F.get(pts, i - 1)["x"] < -1e-9, F.lit(False)),
    )
    checked = F.when(falls, F.raise_error(F.lit("quantile forecasts cross")).cast("array<struct<q:double,x:double>>"))
    return curves.select(*cell, checked.otherwise(anchored).alias("curve"))


def curve_anchors(quantiles: DataFrame, cell: list[str] = CELL) -> DataFrame:
    """The same anchors, one row each."""
    return quantile_curve(quantiles, cell).select(*cell, F.explode("curve").alias("a")).select(
        *cell, F.col("a.q").alias("level"), F.col("a.x").alias("value")
    )


def _interp(curve: Column, at: Column, by: str, out: str) -> Column:
    """Piecewise-linear read of the curve, clamped at both ends; a repeated ``by`` value takes the
    last anchor."""
    below = F.filter(curve, lambda p: p[by] <= at)
    above = F.filter(curve, lambda p: p[by] > at)
    lo, hi = F.get(below, F.size(below) - 1), F.get(above, F.lit(0))
    slope = (hi[out] - lo[out]) / (hi[by] - lo[by])
    return (
        F.when(F.size(below) == 0, F.get(curve, F.lit(0))[out])
        .when(F.size(above) == 0, lo[out])
        .otherwise(slope * (at - lo[by]) + lo[out])
    )


def prep_at(curve: Column, ratio: Column) -> Column:
    bad = F.concat(F.lit("critical ratio outside (0, 1): "), ratio.cast("string"))
    checked = F.when((ratio <= 0) | (ratio >= 1), F.raise_error(bad).cast("double")).otherwise(ratio)
    return _interp(curve, checked, "q", "x")


def level_of(curve: Column, value: Column) -> Column:
    first, last = F.get(curve, F.lit(0))["x"], F.get(curve, F.size(curve) - 1)["x"]
    return _interp(curve, F.least(F.greatest(value, first), last), "x", "q")


def _area(curve: Column, upto: Column) -> Column:
    """Integral of the CDF from its lowest value up to ``upto``."""
    pairs = F.transform(
        F.sequence(F.lit(1), F.size(curve) - 1),
        lambda i: F.struct(F.get(curve, i - 1).alias("a"), F.get(curve, i).alias("b")),
    )

    def segment(p: Column) -> Column:
        a, b = p["a"], p["b"]
        width = F.greatest(F.least(upto, b["x"]) - a["x"], F.lit(0.0))
        slope = F.when(b["x"] > a["x"], (b["q"] - a["q"]) / (b["x"] - a["x"])).otherwise(0.0)
        return a["q"] * width + slope * width * width / 2.0

    total = F.aggregate(F.transform(pairs, segment), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(curve) > 1, total).otherwise(0.0)


def waste_at(curve: Column, prep: Column) -> Column:
    first = F.get(curve, F.lit(0))["x"]
    return F.when(prep <= first, 0.0).otherwise(_area(curve, prep))


def stockout_at(curve: Column, prep: Column) -> Column:
    """Expected missed portions. The top level counts as the end of the distribution, so the value
    is slightly low near that end."""
    first, last = F.get(curve, F.lit(0))["x"], F.get(curve, F.size(curve) - 1)["x"]
    start = F.greatest(prep, first)
    above = ((last - first) - _area(curve, last)) - ((start - first) - _area(curve, start))
    return F.when(prep >= last, 0.0).otherwise(above)


def newsvendor_policy(quantiles: DataFrame, economics: DataFrame, cell: list[str] = CELL) -> DataFrame:
    """Prep quantity of every cell at its item's critical ratio, with the expected waste and missed
    sales of preparing that many. Items without costs get no row."""
    ratios = economics.select(
        "restaurant_id", "item_id", critical_ratio(F.col("co"), F.col("cu")).alias("critical_ratio")
    )
    decided = quantile_curve(quantiles, cell).join(ratios, ["restaurant_id", "item_id"])
    prep = prep_at(F.col("curve"), F.col("critical_ratio"))
    decided = decided.withColumn("prep_quantity", prep)
    return decided.select(
        *cell,
        "critical_ratio",
        "prep_quantity",
        waste_at(F.col("curve"), F.col("prep_quantity")).alias("expected_waste"),
        stockout_at(F.col("curve"), F.col("prep_quantity")).alias("expected_stockout"),
    )
