"""Split-conformal intervals, over empirical or trained quantiles."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..sources.staging import stage
from . import KEY, SERIES
from .joins import salted_join
from .quantiles import interpolated


def split_days(train: DataFrame, conformalize_share: float = 0.2) -> DataFrame:
    """Per tenant, the first day of the part held back for conformalising.

    Days are ranked among the distinct days of a tenant, a group bounded by its calendar.
    """
    days = train.select("restaurant_id", "business_date").distinct()
    by_day = Window.partitionBy("restaurant_id").orderBy("business_date")
    ranked = days.withColumns(
        {
            "place": F.row_number().over(by_day) - 1,
            "n_days": F.count("*").over(Window.partitionBy("restaurant_id")),
        }
    )
    first = F.floor(F.col("n_days") * F.lit(1 - conformalize_share))
    message = F.lit("not enough history to split for conformalising")
    short = F.when((first < 1) | (first >= F.col("n_days")), F.raise_error(message).cast("date"))
    cut = ranked.where(F.col("place") >= first)
    return cut.groupBy("restaurant_id").agg(F.min(short.otherwise(F.col("business_date"))).alias("split_day"))


#: Bits of a score told apart per counting round.
DIGIT = 16


def kth_smallest(values: DataFrame, group: list[str], value: str, rank: DataFrame) -> DataFrame:
    """Exact k-th smallest value per group; ``rank`` holds (group, k). Values have at most nine decimals
    and are read once per round, so they should be staged.

    Values become ordered 64-bit keys. Four counting rounds fix 16 bits of the answer each: rows whose
    higher bits are right are counted by their next bits, at most 2^16 counts per group, and only those
    counts are put in order. However alike the values are, no task sorts or gathers a group's rows.
    """
    keyed = values.select(*group, F.rint(F.col(value) * 1e9).cast("bigint").alias("_key"))
    found = rank.select(*group, "k")
    for shift in range(64 - DIGIT, -1, -DIGIT):
        at = F.shiftright("_key", shift)
        if shift == 64 - DIGIT:
            mine = keyed
        else:
            some = salted_join(keyed, found.select(*group, "_found"), group, ["_key"])
            mine = some.where(F.shiftright("_key", shift + DIGIT) == F.col("_found")).drop("_found")
        counts = mine.groupBy(*group, at.alias("_digit")).agg(F.count("*").alias("n"))
        upto = Window.partitionBy(*group).orderBy("_digit").rowsBetween(Window.unboundedPreceding, 0)
        totals = counts.withColumn("total", F.sum("n").over(upto)).join(found.select(*group, "k"), group)
        here = totals.where("total >= k and total - n < k")
        found = here.select(*group, F.col("_digit").alias("_found"), (F.col("k") - F.col("total") + F.col("n")).alias("k"))
    return found.select(*group, (F.col("_found") / 1e9).alias(value))


def _band(samples: DataFrame, confidence: float) -> DataFrame:
    tail = (1 - confidence) / 2
    sample = F.col("sample")
    return samples.select(
        *SERIES,
        "day_of_week",
        interpolated(sample, F.lit(tail)).alias("lo"),
        interpolated(sample, F.lit(1 - tail)).alias("hi"),
    )


def held_scores(held: DataFrame) -> DataFrame:
    """(restaurant_id, score) of held-back rows (restaurant_id, demand, lo, hi): how far outside the band."""
    y = F.col("demand").cast("double")
    return held.select("restaurant_id", F.round(F.greatest(F.col("lo") - y, y - F.col("hi")), 9).alias("score"))


def widened(targets: DataFrame, scores: DataFrame, confidence: float = 0.8) -> DataFrame:
    """Bands (KEY, lo, hi) moved outwards by the ceil((n + 1) * confidence)-th smallest score of their tenant.
    ``scores`` should be staged."""
    n = scores.groupBy("restaurant_id").agg(F.count("*").alias("n"))
    rank = n.select(
        "restaurant_id", F.least(F.ceil(F.round((F.col("n") + 1) * confidence, 9)), F.col("n")).alias("k")
    )
    widen = kth_smallest(scores, ["restaurant_id"], "score", rank)
    return salted_join(targets, widen, ["restaurant_id"], ["business_date"]).select(
        *KEY,
        F.greatest(F.col("lo") - F.col("score"), F.lit(0.0)).alias("lower"),
        F.greatest(F.col("hi") + F.col("score"), F.lit(0.0)).alias("upper"),
    )


def conformal_intervals(
    train: DataFrame, targets: DataFrame, confidence: float = 0.8, conformalize_share: float = 0.2
) -> DataFrame:
    """Intervals for the targets, widened by the conformal quantile of held-back misses.

    The earlier training days give the band per series and weekday, the later ones the scores.
    """
    rows = salted_join(train, split_days(train, conformalize_share), ["restaurant_id"], ["business_date"]).withColumn(
        "day_of_week", F.weekday("business_date")
    )
    fit = rows.where("business_date < split_day")
    held = rows.where("business_date >= split_day")
    y = F.col("demand").cast("double")
    samples = fit.groupBy(*SERIES, "day_of_week").agg(F.sort_array(F.collect_list(y)).alias("sample"))
    band = stage(_band(samples, confidence), "band")
    scores = stage(held_scores(held.join(band, [*SERIES, "day_of_week"])), "held-scores")
    keyed = targets.select(KEY).withColumn("day_of_week", F.weekday("business_date"))
    return widened(keyed.join(band, [*SERIES, "day_of_week"]), scores, confidence)


def conformal_coverage(intervals: DataFrame, truth: DataFrame, confidence: float = 0.8) -> DataFrame:
    joined = intervals.join(truth.select(*KEY, "true_demand"), KEY)
    inside = F.col("true_demand").between(F.col("lower"), F.col("upper")).cast("int")
    return joined.groupBy("restaurant_id").agg(
        F.lit(confidence).alias("confidence_level"),
        F.avg(inside).alias("empirical_coverage"),
        F.count("*").alias("n"),
        F.avg(F.col("upper") - F.col("lower")).alias("mean_interval_width"),
    )
