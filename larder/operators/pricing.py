"""Ingredient price history: latest prices, trends, moves and retention."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .asof import asof_join

INGREDIENT = ["restaurant_id", "ingredient_id"]
# Days a price must be older to count as prior, move worth reporting, days kept.
LOOKBACK_DAYS = 7
SIGNIFICANT = 0.10
RETENTION_DAYS = 400


def latest_price(prices: DataFrame) -> DataFrame:
    """Newest price per ingredient; of two on one day the one ingested later wins."""
    return latest_of_days(daily_price(prices))


def latest_of_days(days: DataFrame) -> DataFrame:
    """The newest row of every ingredient in a table of daily prices."""
    row = F.struct("ingredient_name", "unit_price", "observed_date")
    newest = days.groupBy(INGREDIENT).agg(F.max_by(row, "observed_date").alias("last"))
    return newest.select(*INGREDIENT, "last.*")


def daily_price(prices: DataFrame) -> DataFrame:
    """Last price of every ingredient and day. Later steps work on this table, which holds at most
    one row per ingredient and calendar day however many invoices there are.

    ``seq`` numbers a tenant's rows in ingest order. The first aggregation keeps only numbers in
    its buffers, so it combines raw rows by hashing; the few spellings left per day are then
    reduced to the last one.
    """
    spelled = prices.groupBy(*INGREDIENT, "ingredient_name", "observed_date").agg(
        F.max("seq").alias("seq"), F.max_by("unit_price", "seq").alias("unit_price")
    )
    row = F.struct("ingredient_name", "unit_price")
    days = spelled.groupBy(*INGREDIENT, "observed_date").agg(F.max_by(row, "seq").alias("last"))
    return days.select(*INGREDIENT, "observed_date", "last.*")


def price_asof(prices: DataFrame, as_of: str | None = None, lookback_days: int = LOOKBACK_DAYS) -> DataFrame:
    """Price on or before the as-of day, and the newest one at least ``lookback_days`` older.

    ``as_of`` defaults to each ingredient's last observation. An ingredient without a price old enough
    has no row.
    """
    days = daily_price(prices)
    if as_of is not None:
        days = days.where(F.col("observed_date") <= F.lit(as_of).cast("date"))
    return pair_of_days(days, lookback_days)


def pair_of_days(days: DataFrame, lookback_days: int = LOOKBACK_DAYS) -> DataFrame:
    """Current and prior price from a table of daily prices, which has one row per calendar day."""
    point = F.struct("observed_date", "unit_price", "ingredient_name")
    newest = F.max("observed_date").over(Window.partitionBy(*INGREDIENT))
    old_enough = F.when(F.col("observed_date") <= F.date_sub("newest", lookback_days), F.col("observed_date"))
    pairs = days.withColumn("newest", newest).groupBy(INGREDIENT).agg(
        F.max_by(point, "observed_date").alias("current"), F.max_by(point, old_enough).alias("prior")
    )
    return pairs.where("prior is not null").select(
        *INGREDIENT,
        F.col("current.ingredient_name").alias("ingredient_name"),
        F.col("current.unit_price").alias("current_price"),
        F.col("prior.unit_price").alias("prior_price"),
        F.col("current.observed_date").alias("current_observed_date"),
        F.col("prior.observed_date").alias("prior_observed_date"),
    )


def price_on(rows: DataFrame, prices: DataFrame, at: str) -> DataFrame:
    """Every row with its ingredient's price on the day ``at``: the last one observed by then.

    Rows before the first observation, or without a day, get nulls. Adds ``unit_price`` and
    ``observed_date``.
    """
    days = daily_price(prices).drop("ingredient_name")
    return asof_join(rows, days, INGREDIENT, at, "observed_date")


def price_trend(prices: DataFrame, as_of: str | None = None, lookback_days: int = LOOKBACK_DAYS) -> DataFrame:
    return trend_of_pairs(price_asof(prices, as_of, lookback_days))


def trend_of_pairs(pairs: DataFrame) -> DataFrame:
    change = (F.col("current_price") - F.col("prior_price")) / F.col("prior_price")
    direction = F.when(F.col("pct_change") > 0, "up").when(F.col("pct_change") < 0, "down").otherwise("flat")
    return pairs.withColumn("pct_change", change).withColumn("direction", direction)


def significant_moves(trend: DataFrame, threshold: float = SIGNIFICANT) -> DataFrame:
    return trend.where(F.abs("pct_change") >= threshold)


def ranked_moves(trend: DataFrame, threshold: float = SIGNIFICANT) -> DataFrame:
    """Moves for presentation, biggest first."""
    return significant_moves(trend, threshold).orderBy(F.abs("pct_change").desc(), *INGREDIENT)


def retention(prices: DataFrame, as_of: str, retention_days: int = RETENTION_DAYS) -> DataFrame:
    """Rows of the last ``retention_days`` days, plus each ingredient's newest day whatever its age.

    Recent rows pass through untouched. Only old rows are matched, against the few ingredients
    that have no recent price at all.
    """
    cutoff = F.date_sub(F.lit(as_of).cast("date"), retention_days)
    newest = prices.groupBy(INGREDIENT).agg(F.max("observed_date").alias("observed_date"))
    stale = newest.where(F.col("observed_date") < cutoff)
    recent = prices.where(F.col("observed_date") >= cutoff)
    old = prices.where(F.col("observed_date") < cutoff)
    return recent.unionByName(old.join(stale, [*INGREDIENT, "observed_date"], "left_semi"))
