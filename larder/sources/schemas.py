"""Column layouts of every table that crosses a file boundary. Nothing is inferred."""
from __future__ import annotations

from pyspark.sql import types as T

_TYPES = {
    "STRING": T.StringType(),
    "DATE": T.DateType(),
    "TIMESTAMP_NTZ": T.TimestampNTZType(),
    "DOUBLE": T.DoubleType(),
    "INT": T.IntegerType(),
    "BIGINT": T.LongType(),
}


def _ddl(text: str) -> T.StructType:
    """Schema from "name TYPE, ..."; Spark's own DDL parser would need a running session."""
    columns = (column.split() for column in text.split(","))
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in columns])


POS_SALES = _ddl(
    "restaurant_id STRING, check_id STRING, line_id STRING, business_date DATE, sold_at TIMESTAMP_NTZ, "
    "item_name STRING, category STRING, menu_price DOUBLE, qty INT, modifiers STRING, "
    "discount_amount DOUBLE, comp_flag STRING, void_flag STRING, server_id STRING"
)
EIGHTYSIX_LOG = _ddl("restaurant_id STRING, business_date DATE, item_name STRING, time_86d STRING")
TRUTH_DEMAND = _ddl(
    "restaurant_id STRING, business_date DATE, service_period STRING, item_id STRING, true_demand BIGINT"
)
TRUTH_STOCKOUTS = _ddl(
    "restaurant_id STRING, business_date DATE, service_period STRING, item_id STRING, "
    "cap BIGINT, true_demand BIGINT, observed_demand BIGINT"
)

LEGS = {
    "bom": _ddl(
        "dish_id STRING, dish_name STRING, ingredient_id STRING, ingredient_name STRING, qty DOUBLE, "
        "recipe_unit STRING, canonical_unit STRING, yield_factor DOUBLE, restaurant_id STRING"
    ),
    "sales_export": _ddl(
        "seq BIGINT, dish_name STRING, count BIGINT, period_start DATE, period_end DATE, restaurant_id STRING"
    ),
    "price_observations": _ddl(
        "seq BIGINT, ingredient_id STRING, ingredient_name STRING, unit_price DOUBLE, "
        "source_invoice STRING, observed_date DATE, restaurant_id STRING"
    ),
    "food_cost": _ddl(
        "dish_id STRING, dish_name STRING, food_cost DOUBLE, computed_at DATE, restaurant_id STRING"
    ),
}

CATALOG = {
    "ingredients": _ddl(
        "restaurant_id STRING, id STRING, name STRING, canonical_unit STRING, yield_factor DOUBLE, notes STRING"
    ),
    "dishes": _ddl(
        "restaurant_id STRING, id STRING, name STRING, menu_price DOUBLE, service_period STRING, is_active STRING"
    ),
    "recipe_lines": _ddl(
        "restaurant_id STRING, line_no BIGINT, dish_id STRING, ingredient_id STRING, qty DOUBLE, recipe_unit STRING"
    ),
    "prices": _ddl(
        "restaurant_id STRING, seq BIGINT, ingredient_id STRING, unit_price DOUBLE, "
        "source_invoice STRING, observed_date DATE"
    ),
}
