"""What kitchens use up between two orders."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

# Fixed value: weekdays on which is ordered (Monday is 0).
ORDER_WEEKDAYS = (0, 3)


def ingredient_depletion(demand: DataFrame, recipes: DataFrame) -> DataFrame:
    """Ingredient used up between order days: portions times recipe quantity, summed per cycle.

    A cycle ends on its order day, the next Monday or Thursday on or after the day itself; that day
    follows from the calendar, so no running count over the history is needed.
    """
    per_item = demand.groupBy("restaurant_id", "business_date", "item_id").agg(F.sum("demand").alias("portions"))
    monday = F.date_sub("business_date", F.weekday("business_date"))
    weekday = F.weekday("business_date")
    order_day = (
        F.when(weekday == ORDER_WEEKDAYS[0], F.col("business_date"))
        .when(weekday <= ORDER_WEEKDAYS[1], F.date_add(monday, ORDER_WEEKDAYS[1]))
        .otherwise(F.date_add(monday, 7 + ORDER_WEEKDAYS[0]))
    )
    cycles = per_item.select("restaurant_id", "item_id", order_day.alias("order_day"), "portions")
    weekly = cycles.groupBy("restaurant_id", "item_id", "order_day").agg(F.sum("portions").alias("portions"))
    used = weekly.join(recipes, ["restaurant_id", "item_id"])
    return used.groupBy("restaurant_id", "ingredient_id", "order_day").agg(
        F.sum(F.col("portions") * F.col("qty_per_portion")).alias("depleted_qty")
    )
