"""Data-quality gates: row rules that report every bad row, name checks and missing-value counts.

Raw uploads arrive as all-text columns plus ``seq``, the row's position in its file.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import blank_to_null, normalize_name, strip
from .joins import salted_join

# Number and date spellings an upload may use.
_WHOLE_NUMBER = r"^\s*[+-]?\d+(\.0*)?\s*$"
_NUMBER = r"^\s*[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|(?i:inf|infinity|nan))\s*$"
_ISO_DATE = r"^\s*\d{4}-\d{2}-\d{2}\s*$"


# A failed try_cast is far dearer than a pattern, so text is matched before it is cast.


def parse_whole(text: Column) -> Column:
    return F.when(text.rlike(_WHOLE_NUMBER), F.substring_index(text, ".", 1).try_cast("bigint"))


def parse_number(text: Column) -> Column:
    return F.when(text.rlike(_NUMBER), text.try_cast("double"))


def parse_date(text: Column) -> Column:
    return F.when(text.rlike(_ISO_DATE), text.try_cast("date"))


def _is_blank(text: Column) -> Column:
    return F.coalesce(text, F.lit("")) == ""


def _rule(broken: Column, message: str) -> Column:
    return F.when(F.coalesce(broken, F.lit(True)), F.lit(message))


def _label(kind: str, *names: Column) -> Column:
    shown = [F.coalesce(blank_to_null(n), F.lit("?")) for n in names]
    return F.concat(F.lit(f"{kind} row "), F.col("seq").cast("string"), F.lit(" ("), F.concat_ws(" / ", *shown), F.lit(")"))


def _with_rules(raw: DataFrame, required: list[str], label: Column, parsed: dict[str, Column], rules) -> DataFrame:
    missing = sorted(set(required) - set(raw.columns))
    if missing:
        raise ValueError(f"missing column(s): {', '.join(missing)}")
    rows = raw.withColumns(parsed)
    rows = rows.withColumn("message", F.concat_ws("; ", *rules))
    return rows.withColumn("row_label", F.when(F.col("message") != "", label))


def valid_rows(checked: DataFrame) -> DataFrame:
    return checked.where(F.col("message") == "")


def rejected_rows(checked: DataFrame) -> DataFrame:
    """Every bad row once, with all its messages.

    Unfolding the message instead of filtering on it keeps the rules from being copied into a
    filter, where every parsed value would be worked out again for each rule that uses it.
    """
    bad = F.explode(F.when(F.col("message") != "", F.array("message"))).alias("message")
    return checked.select("restaurant_id", "seq", "row_label", bad)


def validate_sales(raw: DataFrame) -> DataFrame:
    col = F.col
    return _with_rules(
        raw,
        ["dish_name", "count", "period_start", "period_end"],
        _label("Sales", col("dish_name")),
        {
            "p_count": parse_whole(col("count")),
            "p_start": parse_date(col("period_start")),
            "p_end": parse_date(col("period_end")),
        },
        [
            _rule(_is_blank(col("dish_name")), "dish_name: must not be empty"),
            _rule(col("p_count").isNull(), "count: must be a whole number"),
            F.when(col("p_count") < 0, F.lit("count: must be 0 or more")),
            _rule(col("p_start").isNull(), "period_start: must be a date"),
            _rule(col("p_end").isNull(), "period_end: must be a date"),
            F.when(col("p_end") < col("p_start"), F.lit("period_end is before period_start")),
        ],
    )


def validate_bom(raw: DataFrame) -> DataFrame:
    """Recipe lines; ids are derived from the names, the sheet carries none."""
    col = F.col
    checked = _with_rules(
        raw,
        ["dish_name", "ingredient_name", "qty", "recipe_unit", "canonical_unit", "yield_factor"],
        _label("Recipe", col("dish_name"), col("ingredient_name")),
        {
            "dish_name": strip(F.coalesce(col("dish_name"), F.lit(""))),
            "ingredient_name": strip(F.coalesce(col("ingredient_name"), F.lit(""))),
            "p_qty": parse_number(col("qty")),
            "p_yield": parse_number(col("yield_factor")),
        },
        [
            _rule(col("dish_name") == "", "dish_name: must not be empty"),
            _rule(col("ingredient_name") == "", "ingredient_name: must not be empty"),
            _rule(col("p_qty").isNull() | F.isnan("p_qty"), "qty: must be a number"),
            F.when(col("p_qty") <= 0, F.lit("qty: must be greater than 0")),
            _rule(_is_blank(col("recipe_unit")), "recipe_unit: must not be empty"),
            _rule(_is_blank(col("canonical_unit")), "canonical_unit: must not be empty"),
            _rule(col("p_yield").isNull() | F.isnan("p_yield"), "yield_factor: must be a number"),
            F.when(col("p_yield") <= 0, F.lit("yield_factor: must be greater than 0")),
            F.when((col("p_yield") > 1) & ~F.isnan("p_yield"), F.lit("yield_factor: must be 1 or less")),
        ],
    )
    return checked.withColumns(
        {"dish_id": normalize_name(col("dish_name")), "ingredient_id": normalize_name(col("ingredient_name"))}
    )


def validate_prices(raw: DataFrame) -> DataFrame:
    col = F.col
    checked = _with_rules(
        raw,
        ["ingredient_name", "unit_price", "source_invoice", "observed_date"],
        _label("Invoice", col("ingredient_name")),
        {
            "ingredient_name": strip(F.coalesce(col("ingredient_name"), F.lit(""))),
            "source_invoice": blank_to_null(col("source_invoice")),
            "p_price": parse_number(col("unit_price")),
            "p_date": parse_date(col("observed_date")),
        },
        [
            _rule(col("ingredient_name") == "", "ingredient_name: must not be empty"),
            _rule(col("p_price").isNull() | F.isnan("p_price"), "unit_price: must be a number"),
            F.when(col("p_price") <= 0, F.lit("unit_price: must be greater than 0")),
            _rule(col("p_date").isNull(), "observed_date: must be a date"),
        ],
    )
    return checked.withColumn("ingredient_id", normalize_name(col("ingredient_name")))


def validate_economics(items: DataFrame) -> DataFrame:
    """One row per broken rule: bad costs, lead time or prep type, repeated ids or names.

    The item list is configuration, so repeats are found by counting per id and per name key.
    """
    col = F.col
    name_key = normalize_name(col("name"))
    rules = F.array_compact(
        F.array(
            _rule(_is_blank(col("item_id")), "id: must not be empty"),
            _rule(_is_blank(col("name")), "name: must not be empty"),
            _rule(~col("prep_type").isin("batch", "made_to_order"), "prep_type: unknown"),
            _rule(~(col("co") > 0), "co: must be greater than 0"),
            _rule(~(col("cu") > 0), "cu: must be greater than 0"),
            _rule(~(col("lead_time_days") >= 1), "lead_time_days: must be 1 or more"),
        )
    )
    label = F.coalesce(blank_to_null(col("name")), blank_to_null(col("item_id")), F.lit("?"))
    broken = items.select("restaurant_id", label.alias("item"), F.explode(rules).alias("message"))
    same_id = (
        items.groupBy("restaurant_id", col("item_id").alias("item"))
        .count()
        .where("count > 1")
        .select("restaurant_id", "item", F.lit("id: duplicate").alias("message"))
    )
    same_name = (
        items.groupBy("restaurant_id", name_key.alias("item"))
        .count()
        .where("count > 1")
        .select("restaurant_id", "item", F.lit("name: duplicate").alias("message"))
    )
    return broken.unionByName(same_id).unionByName(same_name)


def validate_food_cost(rows: DataFrame) -> DataFrame:
    """Rows of the derived cost leg that may not be written."""
    bad = _is_blank(F.col("dish_id")) | _is_blank(F.col("dish_name")) | ~(F.col("food_cost") > 0)
    return rows.where(F.coalesce(bad, F.lit(True)))


def alias_ambiguity(aliases: DataFrame) -> DataFrame:
    """Display names claimed by more than one item."""
    return (
        aliases.groupBy("restaurant_id", "alias")
        .agg(F.count_distinct("item_id").alias("n_items"), F.min("item_id").alias("first_item"), F.max("item_id").alias("last_item"))
        .where("n_items > 1")
    )


def config_name_drift(economics: DataFrame, aliases: DataFrame) -> DataFrame:
    """Configured items whose name matches no known alias."""
    known = aliases.select("restaurant_id", normalize_name(F.col("alias")).alias("name_key")).distinct()
    return (
        economics.withColumn("name_key", normalize_name(F.col("name")))
        .join(known, ["restaurant_id", "name_key"], "left_anti")
        .select("restaurant_id", "item_id", "name")
    )


def unknown_items(lines: DataFrame, aliases: DataFrame) -> DataFrame:
    """Names rung up that no alias explains, with their line counts. Null names are exempt."""
    counts = lines.where(F.col("item_name").isNotNull()).groupBy("restaurant_id", "item_name").agg(F.count("*").alias("n_lines"))
    known = aliases.select("restaurant_id", F.col("alias").alias("item_name")).distinct()
    return counts.join(known, ["restaurant_id", "item_name"], "left_anti")


def missingness_report(df: DataFrame) -> DataFrame:
    """Null count and share per tenant and column, in one pass over the data."""
    columns = [c for c in df.columns if c != "restaurant_id"]
    counted = df.groupBy("restaurant_id").agg(
        F.count("*").alias("n_rows"), *[F.count_if(F.col(c).isNull()).alias(c) for c in columns]
    )
    long = counted.unpivot(["restaurant_id", "n_rows"], columns, "column_name", "n_null")
    return long.withColumn("pct_null", F.round(F.col("n_null") / F.col("n_rows") * 100, 6))


def _name_keys(df: DataFrame, name: str, order: Column | None = None) -> DataFrame:
    """One display name per key: the last one by ``order``, as a later row overwrites. Each raw
    spelling is normalized once."""
    place = F.max(order) if order is not None else F.lit(0)
    spelled = df.groupBy("restaurant_id", name).agg(place.alias("place"))
    return spelled.groupBy("restaurant_id", normalize_name(F.col(name)).alias("name_key")).agg(
        F.max_by(F.col(name), F.struct("place", name)).alias("name")
    )


def xref_dishes(bom: DataFrame, sales: DataFrame) -> DataFrame:
    """Dish names found on one side only: likely typos, reported and never blocking."""
    in_bom = _name_keys(bom, "dish_name")
    in_sales = _name_keys(sales, "dish_name", F.col("seq"))
    keys = ["restaurant_id", "name_key"]
    only_bom = in_bom.join(in_sales, keys, "left_anti").withColumn("side", F.lit("only_in_bom"))
    only_sales = in_sales.join(in_bom, keys, "left_anti").withColumn("side", F.lit("only_in_sales"))
    return only_bom.unionByName(only_sales).select("restaurant_id", "side", "name")


def xref_ingredients(prices: DataFrame, bom: DataFrame) -> DataFrame:
    """Invoiced ingredients no recipe uses."""
    spelled = prices.groupBy("restaurant_id", "ingredient_id", "ingredient_name").agg(F.max("seq").alias("seq"))
    invoiced = spelled.groupBy("restaurant_id", "ingredient_id").agg(F.max_by("ingredient_name", "seq").alias("name"))
    known = bom.select("restaurant_id", "ingredient_id").distinct()
    return invoiced.join(known, ["restaurant_id", "ingredient_id"], "left_anti").select("restaurant_id", "name")


def denormalize_bom(recipe_lines: DataFrame, dishes: DataFrame, ingredients: DataFrame) -> DataFrame:
    """Recipe lines with dish and ingredient attributes. A staple ingredient may sit in most lines
    of a tenant, so that join is salted."""
    dish = dishes.select("restaurant_id", F.col("id").alias("dish_id"), F.col("name").alias("dish_name"))
    ingredient = ingredients.select(
        "restaurant_id",
        F.col("id").alias("ingredient_id"),
        F.col("name").alias("ingredient_name"),
        "canonical_unit",
        "yield_factor",
    )
    named = recipe_lines.join(dish, ["restaurant_id", "dish_id"])
    return salted_join(named, ingredient, ["restaurant_id", "ingredient_id"], ["dish_id"]).select(
        "restaurant_id",
        "dish_id",
        "dish_name",
        "ingredient_id",
        "ingredient_name",
        "qty",
        "recipe_unit",
        "canonical_unit",
        "yield_factor",
    )
