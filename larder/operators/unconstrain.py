"""Recover the demand a sell-out cut off, from the same series' earlier uncut days."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.tails import tail_mean
from . import KEY, SERIES
from .joins import shuffle_width

MIN_HISTORY = 8


def expanding_stats(demand: DataFrame) -> DataFrame:
    """Mean, sample variance and count of earlier uncensored demand, per weekday and overall.

    Both windows share the series partitioning, so there is one shuffle. A series holds at most
    one row per calendar day.
    """
    missing = {*KEY, "demand", "censored"} - set(demand.columns)
    if missing:
        raise ValueError(f"expanding_stats: missing required columns {sorted(missing)}")
    rows = demand.withColumns(
        {
            "day_of_week": F.weekday("business_date"),
            "uncut": F.when(~F.col("censored"), F.col("demand").cast("double")),
        }
    )

    def stats(prefix: str, keys: list[str]):
        before = Window.partitionBy(*keys).orderBy("business_date").rowsBetween(Window.unboundedPreceding, -1)
        return {
            f"{prefix}_mean": F.avg("uncut").over(before),
            f"{prefix}_var": F.var_samp("uncut").over(before),
            f"{prefix}_n": F.count("uncut").over(before),
        }

    coarse = rows.withColumns(stats("coarse", SERIES))
    return coarse.withColumns(stats("fine", [*SERIES, "day_of_week"])).drop("uncut")


def unconstrain(demand: DataFrame, min_history: int = MIN_HISTORY) -> DataFrame:
    """Demand with sold-out cells lifted to the expected demand above what was sold.

    The weekday history decides when it has ``min_history`` days, else the whole series, else the
    cell stays. Only censored cells move, and never down.
    """
    rows = expanding_stats(demand.repartition(shuffle_width(demand), *SERIES))
    use_fine = F.col("fine_n") >= min_history
    use_coarse = F.col("coarse_n") >= min_history
    mean = F.when(use_fine, F.col("fine_mean")).otherwise(F.col("coarse_mean"))
    variance = F.coalesce(F.when(use_fine, F.col("fine_var")).otherwise(F.col("coarse_var")), F.lit(0.0))
    seen = F.col("demand").cast("double")
    lifted = F.greatest(seen, tail_mean(mean, variance, seen))
    return rows.withColumn(
        "demand", F.when(F.col("censored") & (use_fine | use_coarse), lifted).otherwise(seen)
    ).select(*KEY, "demand", "censored")
