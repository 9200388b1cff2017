"""Recipe cost, margin grid, menu prices and the findings a price move causes."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.money import food_cost_pct_display, food_cost_tier, round_quarter
from ..functions.text import headline, normalize_name, strip
from ..functions.units import convert_units
from ..sources.staging import stage
from .joins import salted_join
from .pricing import INGREDIENT, daily_price, latest_of_days, latest_price, pair_of_days, significant_moves, trend_of_pairs

DISH = ["restaurant_id", "dish_id"]

# Quadrant order on the grid and the two reasons a dish is not on it.
QUADRANTS = ["Star", "Plowhorse", "Puzzle", "Dog"]
NO_COST = "Ingredient cost not yet available (a price or a convertible unit is missing)."
NO_MENU_PRICE = "No menu price set yet."


def active_dishes(dishes: DataFrame) -> DataFrame:
    return dishes.where("is_active")


def line_quantity() -> Column:
    """Purchased quantity a recipe line needs, in the unit prices are quoted in."""
    return convert_units(F.col("qty"), F.col("recipe_unit"), F.col("canonical_unit")) / F.col("yield_factor")


def bom_price_join(bom: DataFrame, latest: DataFrame) -> DataFrame:
    """Recipe lines with the ingredient's latest price and the as-used cost; null where either the
    price or the unit conversion is missing."""
    prices = latest.select(*INGREDIENT, "unit_price")
    lines = salted_join(bom, prices, INGREDIENT, ["dish_id"], "left")
    return lines.withColumn("line_qty", line_quantity()).withColumn(
        "line_cost", F.col("line_qty") * F.col("unit_price")
    )


def dish_ingredient_cost(priced_lines: DataFrame) -> DataFrame:
    """Cost per dish; a dish with any uncosted line is left out rather than understated."""
    return (
        priced_lines.groupBy(DISH)
        .agg(
            F.min("dish_name").alias("dish_name"),
            F.sum("line_cost").alias("cost"),
            F.bool_and(F.col("line_cost").isNotNull()).alias("costed"),
        )
        .where("costed")
        .drop("costed")
    )


def food_cost_leg(bom: DataFrame, prices: DataFrame, as_of: str) -> DataFrame:
    """Every fully costable dish, with or without a menu price."""
    cost = dish_ingredient_cost(bom_price_join(bom, latest_price(prices)))
    return cost.select(
        *DISH, "dish_name", F.col("cost").alias("food_cost"), F.lit(as_of).cast("date").alias("computed_at")
    )


def plate_cost(
    recipe_lines: DataFrame, dishes: DataFrame, ingredients: DataFrame, latest: DataFrame
) -> DataFrame:
    """Cost of every active catalog dish, or the first reason, by recipe order, it has none."""
    keyed = recipe_lines.join(
        active_dishes(dishes).select("restaurant_id", F.col("id").alias("dish_id"), F.col("name").alias("dish_name")),
        DISH,
        "right",
    )
    known = ingredients.select(
        "restaurant_id",
        F.col("id").alias("ingredient_id"),
        F.col("name").alias("ingredient_name"),
        "canonical_unit",
        "yield_factor",
    ).join(latest.select(*INGREDIENT, "unit_price"), INGREDIENT, "left")
    lines = salted_join(keyed, known, INGREDIENT, ["dish_id"], "left").withColumn("line_qty", line_quantity())
    reason = (
        F.when(F.col("line_no").isNull(), F.lit("no recipe lines"))
        .when(F.col("ingredient_name").isNull(), F.concat(F.lit("unknown ingredient "), "ingredient_id"))
        .when(F.col("unit_price").isNull(), F.concat(F.lit("no price for "), "ingredient_name"))
        .when(
            F.col("line_qty").isNull(),
            F.concat(F.lit("no conversion from "), "recipe_unit", F.lit(" to "), "canonical_unit"),
        )
    )
    lines = lines.withColumn("reason", reason)
    broken = F.col("reason").isNotNull()
    return (
        lines.groupBy(*DISH, "dish_name")
        .agg(
            F.sum(F.col("line_qty") * F.col("unit_price")).alias("total"),
            F.min_by("reason", F.when(broken, F.coalesce("line_no", F.lit(0)))).alias("reason"),
        )
        .select(*DISH, "dish_name", F.when(F.col("reason").isNull(), F.col("total")).alias("cost"), "reason")
    )


def covers_by_dish(sales: DataFrame) -> DataFrame:
    """Covers per normalized dish name, shown under the first spelling on record. Sums are taken
    per raw spelling first, so each spelling is normalized once."""
    spelled = sales.groupBy("restaurant_id", "dish_name").agg(F.sum("count").alias("covers"), F.min("seq").alias("seq"))
    return spelled.groupBy("restaurant_id", normalize_name(F.col("dish_name")).alias("dish_key")).agg(
        F.sum("covers").alias("covers"), F.min_by(strip(F.col("dish_name")), "seq").alias("display_name")
    )


def covers_join(dishes: DataFrame, covers: DataFrame) -> DataFrame:
    """Dishes with their covers, zero where nothing was sold under the name."""
    keyed = dishes.withColumn("dish_key", normalize_name(F.col("dish_name")))
    sold = covers.select("restaurant_id", "dish_key", "covers")
    return keyed.join(sold, ["restaurant_id", "dish_key"], "left").withColumn(
        "covers", F.coalesce("covers", F.lit(0))
    )


def covers_report(costed: DataFrame, menu: DataFrame, covers: DataFrame) -> DataFrame:
    """Costed dishes no sale matches, and sales no menu dish explains."""
    keys = ["restaurant_id", "dish_key"]
    graded = costed.withColumn("dish_key", normalize_name(F.col("dish_name")))
    on_menu = menu.select("restaurant_id", normalize_name(F.col("dish_name")).alias("dish_key")).distinct()
    unmatched = graded.join(covers, keys, "left_anti").groupBy(keys).agg(F.max("dish_name").alias("name"))
    orphaned = covers.join(on_menu, keys, "left_anti").select(*keys, F.col("display_name").alias("name"))
    return (
        unmatched.withColumn("kind", F.lit("unmatched_dish"))
        .unionByName(orphaned.withColumn("kind", F.lit("orphaned_sale")))
        .select("restaurant_id", "kind", "name")
    )


def menu_price_entries(entries: DataFrame, bom: DataFrame) -> DataFrame:
    """Submitted form values: blanks are skipped, ids no longer in the BOM ignored, the rest is
    either a price or a rejection that names the dish."""
    names = bom.groupBy(DISH).agg(F.min("dish_name").alias("dish_name"))
    text = strip(F.col("value"))
    price = text.try_cast("double")
    rows = entries.where(F.coalesce(text, F.lit("")) != "").join(names, DISH, "left")
    bad = price.isNull() | F.isnan(price) | (price <= 0)
    label = F.coalesce("dish_name", "dish_id")
    message = F.concat(label, F.lit(": menu price must be a positive number."))
    return rows.select(
        *DISH,
        "dish_name",
        F.when(~bad, price).alias("menu_price"),
        F.when(bad, message).alias("error"),
        "updated_at",
    ).where("dish_name is not null or error is not null")


def menu_price_latest(saved: DataFrame) -> DataFrame:
    """Newest valid price per normalized dish name."""
    valid = saved.where((strip(F.col("dish_name")) != "") & (F.col("menu_price") > 0))
    return valid.groupBy("restaurant_id", normalize_name(F.col("dish_name")).alias("dish_id")).agg(
        F.max_by("menu_price", F.struct("updated_at", "menu_price")).alias("menu_price")
    )


def menu_price_form(bom: DataFrame, saved: DataFrame) -> DataFrame:
    names = bom.groupBy(DISH).agg(F.min("dish_name").alias("dish_name"))
    return names.join(menu_price_latest(saved), DISH, "left")


def menu_grid(costed: DataFrame, covers: DataFrame) -> DataFrame:
    """Popularity against margin. ``costed`` holds dish, cost and menu price.

    High means at or above the tenant's mean; comparisons ignore the ninth decimal, which depends
    on the order of addition. The means are one aggregated row per tenant joined back, so a tenant
    with most dishes is never gathered in one task.
    """
    rows = covers_join(costed, covers).withColumns(
        {
            "margin": F.col("menu_price") - F.col("cost"),
            "food_cost_pct": F.col("cost") / F.col("menu_price"),
        }
    )
    means = rows.groupBy("restaurant_id").agg(
        F.round(F.avg("covers"), 9).alias("mean_covers"), F.round(F.avg("margin"), 9).alias("mean_margin")
    )
    popular = F.col("covers") >= F.col("mean_covers")
    rich = F.round("margin", 9) >= F.col("mean_margin")
    quadrant = (
        F.when(popular & rich, "Star").when(popular, "Plowhorse").when(rich, "Puzzle").otherwise("Dog")
    )
    return (
        salted_join(rows, means, ["restaurant_id"], ["dish_id"])
        .withColumns({"quadrant": quadrant, "food_cost_tier": food_cost_tier(F.round("food_cost_pct", 9))})
        .drop("mean_covers", "mean_margin", "dish_key")
    )


def ordered_grid(grid: DataFrame) -> DataFrame:
    """The grid as shown: by quadrant, then margin, best first."""
    place = F.array_position(F.array(*[F.lit(q) for q in QUADRANTS]), F.col("quadrant"))
    return grid.orderBy("restaurant_id", place, F.col("margin").desc(), "dish_id")


def priced_dishes(bom: DataFrame, prices: DataFrame, saved: DataFrame) -> DataFrame:
    """Dishes that have both a cost and a menu price."""
    cost = dish_ingredient_cost(bom_price_join(bom, latest_price(prices)))
    return cost.join(menu_price_latest(saved), DISH)


def unpriced_dishes(bom: DataFrame, prices: DataFrame, saved: DataFrame) -> DataFrame:
    """Captured dishes missing from the grid, with the reason; a missing cost is named first."""
    lines = bom_price_join(bom, latest_price(prices))
    dishes = lines.groupBy(DISH).agg(
        F.min("dish_name").alias("dish_name"), F.bool_and(F.col("line_cost").isNotNull()).alias("costed")
    )
    rows = dishes.join(menu_price_latest(saved), DISH, "left")
    reason = F.when(~F.col("costed"), NO_COST).when(F.col("menu_price").isNull(), NO_MENU_PRICE)
    return rows.withColumn("reason", reason).where("reason is not null").select("restaurant_id", "dish_name", "reason")


def display_grid(grid: DataFrame) -> DataFrame:
    """The grid with chef-facing numbers: cost on the quarter-dollar grid, margin and tier derived
    from that same rounded cost. Quadrants keep the exact margin."""
    shown = grid.withColumn("cost_display", round_quarter(F.round("cost", 9)))
    share = food_cost_pct_display(F.col("cost_display"), F.col("menu_price"))
    return shown.select(
        *DISH,
        F.col("dish_name").alias("name"),
        "menu_price",
        "cost_display",
        (F.col("menu_price") - F.col("cost_display")).alias("margin_display"),
        share.alias("food_cost_pct"),
        food_cost_tier(share).alias("food_cost_tier"),
        "covers",
        "quadrant",
    )


def grid_footer(displayed: DataFrame) -> DataFrame:
    """Total covers and the average displayed margin per cover."""
    totals = displayed.groupBy("restaurant_id").agg(
        F.sum("covers").alias("total_covers"), F.sum(F.col("margin_display") * F.col("covers")).alias("margin")
    )
    return totals.select(
        "restaurant_id", "total_covers", F.try_divide("margin", "total_covers").alias("avg_margin_per_cover")
    )


def dish_detail(bom: DataFrame, prices: DataFrame, saved: DataFrame) -> DataFrame:
    """Every recipe line with its exact cost, next to the dish total rounded once; the total is
    null when any line has no cost. A dish's lines are bounded by its recipe."""
    lines = bom_price_join(bom, latest_price(prices))
    total = lines.groupBy(DISH).agg(
        F.when(F.bool_and(F.col("line_cost").isNotNull()), round_quarter(F.round(F.sum("line_cost"), 9))).alias(
            "cost_display"
        )
    )
    dishes = total.join(menu_price_latest(saved), DISH, "left")
    share = food_cost_pct_display(F.col("cost_display"), F.col("menu_price"))
    dishes = dishes.withColumns(
        {
            "margin_display": F.col("menu_price") - F.col("cost_display"),
            "food_cost_pct": share,
            "food_cost_tier": F.when(share.isNotNull(), food_cost_tier(share)),
        }
    )
    shown = lines.select(
        *DISH, "dish_name", "ingredient_name", "qty", "recipe_unit", F.col("line_cost").alias("as_used_cost")
    )
    return shown.join(dishes, DISH)


def data_summary(bom: DataFrame, sales: DataFrame, prices: DataFrame, food_cost: DataFrame) -> DataFrame:
    """What each tenant has on record, leg by leg; a missing leg counts zero."""
    legs = [
        bom.groupBy("restaurant_id").agg(
            F.count_distinct("dish_name").alias("dish_count"), F.count("*").alias("bom_row_count")
        ),
        sales.groupBy("restaurant_id").agg(
            F.count("*").alias("sales_row_count"),
            F.sum("count").alias("total_covers"),
            F.min("period_start").alias("period_start"),
            F.max("period_end").alias("period_end"),
        ),
        prices.groupBy("restaurant_id").agg(
            F.count("*").alias("price_observation_count"),
            F.count_distinct("ingredient_id").alias("priced_ingredient_count"),
        ),
        food_cost.groupBy("restaurant_id").agg(F.count("*").alias("food_cost_dish_count")),
    ]
    out = legs[0]
    for leg in legs[1:]:
        out = out.join(leg, "restaurant_id", "full")
    counts = [c for c in out.columns if c.endswith("count") or c == "total_covers"]
    return out.withColumns({c: F.coalesce(c, F.lit(0)) for c in counts})


def upload_summary(bom: DataFrame, sales: DataFrame) -> DataFrame:
    """Counts for a staged recipe sheet and sales export; a dish counts as costable when both files
    name it."""
    in_bom, in_sales = (
        df.select("restaurant_id", "dish_name").distinct().select(
            "restaurant_id", normalize_name(F.col("dish_name")).alias("k")
        )
        for df in (bom, sales)
    )
    shared = in_bom.intersect(in_sales).groupBy("restaurant_id").agg(F.count("*").alias("costable_dish_count"))
    recipes = bom.groupBy("restaurant_id").agg(
        F.count_distinct("dish_name").alias("dish_count"), F.count("*").alias("recipe_line_count")
    )
    sold = sales.groupBy("restaurant_id").agg(
        F.count("*").alias("sales_row_count"),
        F.sum("count").alias("total_covers"),
        F.min("period_start").alias("period_start"),
        F.max("period_end").alias("period_end"),
    )
    out = recipes.join(sold, "restaurant_id").join(shared, "restaurant_id", "left")
    return out.withColumn("costable_dish_count", F.coalesce("costable_dish_count", F.lit(0)))


def invoice_summary(prices: DataFrame) -> DataFrame:
    return prices.groupBy("restaurant_id").agg(
        F.count("*").alias("row_count"),
        F.count_distinct("ingredient_id").alias("ingredient_count"),
        F.min("observed_date").alias("period_start"),
        F.max("observed_date").alias("period_end"),
    )


def affected_dishes(bom: DataFrame, prices: DataFrame, threshold: float = 0.10) -> DataFrame:
    """Every dish touched by a significant price move, with its cost before and after.

    Other ingredients stay at their latest price. A dish's latest total is computed once; swapping
    the moving ingredient's prior price into it gives the earlier cost, so a move never unfolds
    into all lines of its dishes. Dishes with an uncosted line stay in, marked uncosted. The price
    history is read once: the daily prices are staged, and latest and prior prices come from them.
    """
    days = stage(daily_price(prices), "daily-price")
    lines = bom_price_join(bom, latest_of_days(days))
    totals = lines.groupBy(DISH).agg(
        F.min("dish_name").alias("dish_name"),
        F.sum("line_cost").alias("latest_cost"),
        F.bool_and(F.col("line_cost").isNotNull()).alias("costed"),
    )
    usage = lines.groupBy(*DISH, "ingredient_id").agg(
        F.sum("line_qty").alias("used_qty"), F.sum("line_cost").alias("used_cost")
    )
    moves = significant_moves(trend_of_pairs(pair_of_days(days)), threshold)
    rows = salted_join(usage, moves, INGREDIENT, ["dish_id"]).join(totals, DISH)
    others = F.col("latest_cost") - F.col("used_cost")
    priced = F.col("costed")
    return rows.withColumns(
        {
            "prior_cost": F.when(priced, others + F.col("used_qty") * F.col("prior_price")),
            "new_cost": F.when(priced, others + F.col("used_qty") * F.col("current_price")),
        }
    ).withColumn("delta", F.col("new_cost") - F.col("prior_cost"))


def opportunity_totals(affected: DataFrame) -> DataFrame:
    """One row per move: dollar impact and how many of its dishes could be costed. A move none of
    whose dishes costs is dropped."""
    keys = [
        *INGREDIENT,
        "ingredient_name",
        "pct_change",
        "direction",
        "current_price",
        "prior_price",
        "current_observed_date",
        "prior_observed_date",
    ]
    out = affected.groupBy(keys).agg(
        F.count_if("costed").alias("costed_dish_count"),
        F.count_if(~F.col("costed")).alias("uncosted_dish_count"),
        F.sum(F.abs("delta")).alias("impact"),
    )
    days = F.datediff("current_observed_date", "prior_observed_date")
    return out.where("costed_dish_count > 0").withColumn("days_span", days)


def opportunities(bom: DataFrame, prices: DataFrame, threshold: float = 0.10) -> DataFrame:
    """Costed dishes of every move, with the move's total impact: the flat findings table."""
    affected = stage(affected_dishes(bom, prices, threshold), "affected")
    totals = opportunity_totals(affected).select(
        *INGREDIENT, "days_span", "impact", "costed_dish_count", "uncosted_dish_count"
    )
    dishes = affected.where("costed").select(
        *INGREDIENT,
        "ingredient_name",
        "pct_change",
        "direction",
        "current_price",
        "prior_price",
        "dish_id",
        "dish_name",
        "prior_cost",
        "new_cost",
        "delta",
    )
    return dishes.join(totals, INGREDIENT)


def headlines(totals: DataFrame) -> DataFrame:
    text = headline(
        F.col("ingredient_name"),
        F.col("pct_change"),
        F.col("direction"),
        F.col("days_span"),
        F.col("costed_dish_count"),
        F.col("uncosted_dish_count"),
    )
    return totals.select(*INGREDIENT, text.alias("headline"))


def findings(bom: DataFrame, prices: DataFrame, threshold: float = 0.10) -> DataFrame:
    """Findings for presentation: one row per move with its dishes as an array, biggest impact
    first. A move's dishes are bounded by the tenant's menu."""
    every = stage(affected_dishes(bom, prices, threshold), "affected")
    affected = every.where("costed")
    prior, new = (round_quarter(F.round(c, 9)) for c in ("prior_cost", "new_cost"))
    dish = F.struct(
        (-F.abs("delta")).alias("rank"),
        "dish_name",
        prior.alias("prior_cost"),
        new.alias("new_cost"),
        (new - prior).alias("delta"),
    )
    dishes = affected.groupBy(INGREDIENT).agg(F.array_sort(F.collect_list(dish)).alias("affected_dishes"))
    totals = opportunity_totals(every)
    return (
        totals.join(headlines(totals), INGREDIENT)
        .join(dishes, INGREDIENT)
        .orderBy("restaurant_id", F.col("impact").desc(), "ingredient_id")
    )
