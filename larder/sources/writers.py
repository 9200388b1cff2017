"""Writers for the captured legs: full replace per tenant, append without duplicates, CSV export."""
from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from . import schemas
from .staging import discard

PRICE_KEYS = ["restaurant_id", "ingredient_id", "observed_date", "unit_price", "source_invoice"]


def write_snapshot_leg(df: DataFrame, root: str, leg: str) -> None:
    """Replace the tenants present in ``df``; other tenants' partitions stay untouched."""
    if df.isEmpty():
        raise ValueError(f"write_snapshot_leg: no {leg} rows to write")
    (
        df.select(schemas.LEGS[leg].names)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("restaurant_id")
        .parquet(f"{root}/{leg}")
    )


def write_food_cost(df: DataFrame, root: str) -> None:
    """Replace the derived food-cost leg as a whole; when no dish costs, the leg becomes empty."""
    (
        df.select(schemas.LEGS["food_cost"].names)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "static")
        .partitionBy("restaurant_id")
        .parquet(f"{root}/food_cost")
    )


def append_prices_dedup(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Price history after an invoice: equal rows collapse to the last one ingested.

    ``max_by`` combines on the map side, so a resubmitted invoice of any size shuffles one row per
    key and task. Null invoices count as equal.
    """
    rest = [c for c in existing.columns if c not in PRICE_KEYS]
    both = existing.unionByName(new)
    last = both.groupBy(PRICE_KEYS).agg(
        F.max_by(F.struct(*rest), F.struct("seq", "ingredient_name")).alias("kept")
    )
    return last.select(*PRICE_KEYS, "kept.*").select(existing.columns)


HISTORY = "price_history"
JOURNAL = "_price_append"
MARKER = "_SUCCESS"
MONTHLY = ["restaurant_id", "month"]
_DATED = StructType([*schemas.LEGS["price_observations"].fields, StructField("month", StringType())])


def _by_month(prices: DataFrame) -> DataFrame:
    month = F.coalesce(F.date_format("observed_date", "yyyy-MM"), F.lit("none"))
    return prices.select(schemas.LEGS["price_observations"].names).withColumn("month", month)


def read_price_history(spark: SparkSession, root: str) -> DataFrame:
    """The history that ``append_prices`` keeps, with its partition column ``month``; empty before the first append.

    A filter on ``restaurant_id`` or ``month`` prunes folders.
    """
    try:
        return spark.read.schema(_DATED).parquet(f"{root}/{HISTORY}").select(_DATED.names)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], _DATED)


def _replay(spark: SparkSession, root: str) -> None:
    """Put the months of a complete journal into the history, then delete the journal.

    Whole months are replaced by what the journal holds, so replaying it twice changes nothing. The
    marker goes first, so a journal that is half deleted is never replayed.
    """
    journal = f"{root}/{JOURNAL}"
    try:
        spark.read.text(f"{journal}/{MARKER}")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return
    merged = spark.read.schema(_DATED).parquet(journal)
    (
        merged.hint("rebalance", *MONTHLY)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*MONTHLY)
        .parquet(f"{root}/{HISTORY}")
    )
    discard(spark, f"{journal}/{MARKER}")
    discard(spark, journal)


def append_prices(new: DataFrame, root: str) -> None:
    """Add invoice rows to the price history under ``root``; only the months they touch are rewritten.

    The history is partitioned by tenant and month. Equal rows fall into one month, so each touched
    month is merged with its new rows by ``append_prices_dedup`` alone and all others are neither read
    nor written. The merged months are first written as a journal, whose success marker commits the
    append; then they replace the old ones. A run that ends before the marker has changed nothing; one
    that ends after it is finished by the next append, or by running it again, which adds nothing twice.
    Rows without a day have a month of their own. One append at a time may run on a ``root``.

    The driver holds the touched tenants and months, as Spark does for the folders it replaces.
    """
    spark = new.sparkSession
    _replay(spark, root)
    rows = _by_month(new)
    touched = rows.select(MONTHLY).distinct()
    names = [F.collect_set(c).alias(c) for c in MONTHLY]
    named = touched.agg(*names, F.count_if(F.col("restaurant_id").isNull()).alias("unnamed")).first()
    if not named["month"]:
        raise ValueError("append_prices: no price rows to write")
    if named["unnamed"]:
        raise ValueError("append_prices: rows without a restaurant_id")
    history = read_price_history(spark, root).where(F.col("restaurant_id").isin(named["restaurant_id"]))
    old = history.where(F.col("month").isin(named["month"])).join(touched, MONTHLY, "left_semi")
    merged = append_prices_dedup(old.drop("month"), rows.drop("month"))
    marked = _by_month(merged).write.mode("overwrite").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "true")
    marked.parquet(f"{root}/{JOURNAL}")
    _replay(spark, root)


def export_leg_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
