"""From point-of-sale lines to a zero-filled daily demand grid."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.calendar import PERIODS, daypart, flag, log_hour
from . import KEY
from .joins import salted_join
from .quality import config_name_drift


def void_flag() -> Column:
    return flag(F.col("void_flag"))


def comp_flag() -> Column:
    return flag(F.col("comp_flag"))


def zero_qty_anomaly() -> Column:
    """A zero quantity that neither a void nor a comp explains."""
    return (F.col("qty") == 0) & ~void_flag() & ~comp_flag()


def staff_line(staff: Sequence[str]) -> Column:
    return F.coalesce(F.col("server_id").isin(list(staff)), F.lit(False))


def drop_voids(lines: DataFrame) -> DataFrame:
    return lines.where(~void_flag())


def drop_staff(lines: DataFrame, staff: Sequence[str]) -> DataFrame:
    return lines.where(~staff_line(staff))


def quarantine_zero_qty(lines: DataFrame) -> DataFrame:
    return lines.where(F.coalesce(zero_qty_anomaly(), F.lit(False)))


def kept_lines(lines: DataFrame, staff: Sequence[str]) -> DataFrame:
    """Lines that count as guest demand. Comped dishes were cooked and served, so they stay."""
    anomaly = F.coalesce(zero_qty_anomaly(), F.lit(False))
    return lines.where(~anomaly & ~void_flag() & ~staff_line(staff))


def cleaning_report(lines: DataFrame, staff: Sequence[str]) -> DataFrame:
    """Per-tenant counts of what cleaning removes, each line counted at its first reason."""
    anomaly = F.coalesce(zero_qty_anomaly(), F.lit(False))
    void = ~anomaly & void_flag()
    by_staff = ~anomaly & ~void_flag() & staff_line(staff)
    kept = ~anomaly & ~void_flag() & ~staff_line(staff)
    report = lines.groupBy("restaurant_id").agg(
        F.count("*").alias("n_raw"),
        F.count_if(anomaly).alias("n_zero_qty"),
        F.count_if(void).alias("n_void"),
        F.count_if(by_staff).alias("n_staff"),
        F.count_if(kept & comp_flag()).alias("n_comp_kept"),
        F.count_if(kept).alias("n_kept"),
    )
    share = (F.col("n_raw") - F.col("n_kept")) / F.col("n_raw") * 100
    return report.withColumn("pct_excluded", F.round(share, 6))


def _known_item(name: Column, item_id: Column) -> Column:
    """The item id; a name without one fails the job, a null name passes as null."""
    message = F.concat(F.lit("item name not in the alias map: "), name)
    return F.when(name.isNotNull() & item_id.isNull(), F.raise_error(message).cast("string")).otherwise(item_id)


def alias_map(aliases: DataFrame) -> DataFrame:
    """One row per tenant and display name with its item id; a name of two items fails the job."""
    names = aliases.groupBy("restaurant_id", F.col("alias").alias("item_name")).agg(
        F.min("item_id").alias("item_id"), F.max("item_id").alias("other")
    )
    message = F.concat(F.lit("alias of two items: "), F.col("item_name"))
    known = F.when(F.col("item_id").eqNullSafe(F.col("other")), F.col("item_id")).otherwise(F.raise_error(message).cast("string"))
    return names.select("restaurant_id", "item_name", known.alias("item_id"))


def reconcile_names(rows: DataFrame, aliases: DataFrame) -> DataFrame:
    """Replace the drifting display name by the stable item id.

    ``rows`` are sums per name and day, so one name holds no more rows than there are days.
    """
    joined = rows.join(alias_map(aliases), ["restaurant_id", "item_name"], "left")
    return joined.withColumn("item_id", _known_item(F.col("item_name"), F.col("item_id")))


def with_daypart(lines: DataFrame) -> DataFrame:
    return lines.withColumn("service_period", daypart(F.hour("sold_at")))


def daily_item_sales(lines: DataFrame, aliases: DataFrame) -> DataFrame:
    """Portions per day, item and daypart; item id is null where the export had no name.

    Lines are summed per display name before the alias join, so the join and everything after it
    sees at most one row per day, name and daypart, however busy a dish is. The result is
    partitioned by day, which the grid needs too.
    """
    per_name = (
        with_daypart(lines)
        .groupBy("restaurant_id", "business_date", "item_name", "service_period")
        .agg(F.sum("qty").alias("qty"))
    )
    per_day = reconcile_names(per_name, aliases).repartition("restaurant_id", "business_date")
    return per_day.groupBy(KEY).agg(F.sum("qty").alias("qty"))


def _menu(aliases: DataFrame) -> DataFrame:
    """One row per tenant holding its item ids (as many as its menu has)."""
    return aliases.groupBy("restaurant_id").agg(F.collect_set("item_id").alias("menu"))


def demand_grid(daily: DataFrame, aliases: DataFrame, periods: DataFrame | Sequence[str] = PERIODS) -> DataFrame:
    """Every selling day x menu item x daypart, zero where nothing sold.

    A day's few sold cells travel as one row and its zero cells are added next to them. Days of
    a large tenant meet their menu spread over tasks. ``periods`` is either the configured list or
    a table (restaurant_id, periods).
    """
    cell = F.struct("item_id", "service_period", F.col("qty").cast("bigint").alias("qty"))
    days = daily.groupBy("restaurant_id", "business_date").agg(
        F.collect_list(F.when(F.col("item_id").isNotNull(), cell)).alias("sold")
    )
    menu = _menu(aliases)
    if isinstance(periods, DataFrame):
        menu = menu.join(periods, "restaurant_id")
    else:
        menu = menu.withColumn("periods", F.array(*[F.lit(p) for p in sorted(periods)]))
    days = salted_join(days, menu, ["restaurant_id"], ["business_date"])
    empty = F.flatten(
        F.transform(
            "menu",
            lambda item: F.transform(
                "periods",
                lambda period: F.struct(
                    item.alias("item_id"), period.alias("service_period"), F.lit(0).cast("bigint").alias("qty")
                ),
            ),
        )
    )
    cells = days.select("restaurant_id", "business_date", F.inline(F.concat("sold", empty)))
    return cells.groupBy(KEY).agg(F.sum("qty").alias("demand"))


def observed_demand(lines: DataFrame, aliases: DataFrame) -> DataFrame:
    """Naive demand: voids out, names reconciled, grid over the dayparts each tenant sold in."""
    return observed_grid(daily_item_sales(drop_voids(lines), aliases), aliases)


def observed_grid(daily: DataFrame, aliases: DataFrame) -> DataFrame:
    """The same from daily sums. They are read twice, so a job over many raw lines stages them."""
    periods = daily.groupBy("restaurant_id").agg(F.collect_set("service_period").alias("periods"))
    return demand_grid(daily, aliases, periods)


def censored_keys(log: DataFrame, aliases: DataFrame) -> DataFrame:
    """Distinct (day, item, daypart) sold out according to the log; unknown names are dropped."""
    entries = log.select(
        "restaurant_id", "business_date", "item_name", daypart(log_hour(F.col("time_86d"))).alias("service_period")
    ).distinct()
    return entries.join(alias_map(aliases), ["restaurant_id", "item_name"]).select(KEY).distinct()


def censor_tag(demand: DataFrame, log: DataFrame, aliases: DataFrame) -> DataFrame:
    """Mark sold-out cells; a dinner entry leaves that day's lunch alone."""
    keys = censored_keys(log, aliases).withColumn("censored", F.lit(True))
    return demand.join(keys, KEY, "left").withColumn("censored", F.coalesce("censored", F.lit(False)))


def refuse_drift(aliases: DataFrame, economics: DataFrame) -> DataFrame:
    """The alias map; a configured item name that no alias carries fails the job."""
    drifted = config_name_drift(economics, aliases).groupBy("restaurant_id").agg(F.min("name").alias("drifted"))
    message = F.concat(F.lit("configured name without an alias: "), F.col("drifted"))
    item = F.when(F.col("drifted").isNull(), F.col("item_id")).otherwise(F.raise_error(message).cast("string"))
    return aliases.join(drifted, "restaurant_id", "left").select("restaurant_id", item.alias("item_id"), "alias")


def clean_demand(
    lines: DataFrame, log: DataFrame, aliases: DataFrame, staff: Sequence[str], economics: DataFrame | None = None
) -> DataFrame:
    """Demand grid over the configured dayparts without voids and staff meals, sell-outs marked.

    With ``economics`` (restaurant_id, item_id, name) its names have to be known as aliases.
    """
    if economics is not None:
        aliases = refuse_drift(aliases, economics)
    daily = daily_item_sales(kept_lines(lines, staff), aliases)
    return censor_tag(demand_grid(daily, aliases), log, aliases).select(*KEY, "demand", "censored")
