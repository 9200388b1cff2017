import datetime as dt

import pytest
from pyspark.sql import functions as F

from larder.operators import costing as ops, pricing, quality
from larder.sources import readers, schemas, writers
from larder.sources.staging import stage_path

D = dt.date


@pytest.fixture()
def bom(spark):
    rows = [
        ("steak", "Steak", "beef", "Beef", 6.0, "oz", "oz", 0.9, "r0"),
        ("taco", "Taco", "beef", "Beef", 4.0, "oz", "oz", 1.0, "r0"),
        ("stew", "Stew", "beef", "Beef", 8.0, "oz", "oz", 1.0, "r0"),
        ("stew", "Stew", "carrot", "Carrot", 1.0, "each", "g", 1.0, "r0"),
    ]
    return spark.createDataFrame(rows, schemas.LEGS["bom"])


def prices(spark, rows):
    full = [(i, name, name.title(), price, None, day, "r0") for i, (name, price, day) in enumerate(rows)]
    return spark.createDataFrame(full, schemas.LEGS["price_observations"])


def test_dish_cost_with_yield_and_margin(spark, bom):
    history = prices(spark, [("beef", 3.0, D(2024, 1, 1)), ("carrot", 1.0, D(2024, 1, 1))])
    lines = ops.bom_price_join(bom, pricing.latest_price(history))
    cost = {r.dish_id: r.cost for r in ops.dish_ingredient_cost(lines).collect()}
    assert cost == pytest.approx({"steak": 20.0, "taco": 12.0})  # the stew's carrot has no convertible unit
    saved = spark.createDataFrame(
        [("r0", " STEAK", 30.0, dt.datetime(2023, 1, 1)), ("r0", "Steak", 25.0, dt.datetime(2024, 1, 1))],
        "restaurant_id string, dish_name string, menu_price double, updated_at timestamp_ntz",
    )
    sales = spark.createDataFrame(
        [(1, " steak ", 3, D(2024, 1, 1), D(2024, 1, 7), "r0"), (2, "Steak", 4, D(2024, 1, 1), D(2024, 1, 7), "r0")],
        schemas.LEGS["sales_export"],
    )
    grid = ops.menu_grid(ops.priced_dishes(bom, history, saved), ops.covers_by_dish(sales))
    row = ops.display_grid(grid).first()
    assert (row.menu_price, row.cost_display, row.margin_display, row.covers, row.quadrant) == (25.0, 20.0, 5.0, 7, "Star")
    why = {r.dish_name: r.reason for r in ops.unpriced_dishes(bom, history, saved).collect()}
    assert why == {"Stew": ops.NO_COST, "Taco": ops.NO_MENU_PRICE}
    detail = ops.dish_detail(bom, history, saved).where("dish_id = 'stew'").collect()
    assert len(detail) == 2 and all(r.cost_display is None for r in detail)


def test_price_move_and_tie_break(spark):
    history = prices(spark, [("beef", 3.0, D(2024, 1, 1)), ("beef", 9.0, D(2024, 1, 8)), ("beef", 3.48, D(2024, 1, 8)), ("egg", 1.0, D(2024, 1, 7)), ("egg", 2.0, D(2024, 1, 8))])
    trend = pricing.price_trend(history).collect()
    assert len(trend) == 1  # the egg has no price a week old
    assert trend[0].pct_change == pytest.approx(0.16) and trend[0].direction == "up"
    assert pricing.price_trend(history, as_of="2024-01-02").count() == 0
    latest = {r.ingredient_id: r.unit_price for r in pricing.latest_price(history).collect()}
    assert latest == {"beef": 3.48, "egg": 2.0}


def test_opportunities(spark, bom):
    history = prices(spark, [("beef", 3.0, D(2024, 1, 1)), ("beef", 3.48, D(2024, 1, 8))])
    simple = bom.where("dish_id <> 'steak'")
    flat = ops.opportunities(simple.where("ingredient_id = 'beef'"), history).orderBy(F.desc("delta")).collect()
    assert [(r.dish_id, round(r.delta, 6)) for r in flat] == [("stew", 3.84), ("taco", 1.92)]
    partly = ops.findings(simple, history).first()
    assert partly.uncosted_dish_count == 1 and [d.dish_name for d in partly.affected_dishes] == ["Taco"]
    assert partly.headline == "Beef +16% this week — 2 dishes affected (1 not yet fully priced)"
    assert ops.opportunities(simple.where("dish_id = 'stew'"), history).count() == 0


def test_retention_keeps_each_newest_price(spark):
    history = prices(spark, [("beef", 1.0, D(2020, 1, 1)), ("beef", 2.0, D(2024, 1, 1)), ("salt", 1.0, D(2019, 1, 1)), ("salt", 2.0, D(2020, 1, 1)), ("salt", 3.0, D(2020, 1, 1))])
    kept = pricing.retention(history, "2024-02-01").collect()
    assert sorted((r.ingredient_id, r.unit_price) for r in kept) == [("beef", 2.0), ("salt", 2.0), ("salt", 3.0)]


def test_resubmitted_invoice_changes_nothing(spark):
    history = prices(spark, [("beef", 3.0, D(2024, 1, 1)), ("egg", 1.0, D(2024, 1, 2))])
    once = writers.append_prices_dedup(history, history.limit(0))
    again = writers.append_prices_dedup(once, history.withColumn("seq", F.col("seq") + 100))
    assert again.count() == 2 and {r.seq for r in again.collect()} == {100, 101}


def test_snapshot_replaces_only_its_tenants(spark, bom):
    root = stage_path(spark, "raw")
    other = bom.withColumn("restaurant_id", F.lit("r9"))
    writers.write_snapshot_leg(bom.unionByName(other), root, "bom")
    writers.write_snapshot_leg(bom.limit(1), root, "bom")
    assert readers.read_leg(spark, root, "bom", "r0").count() == 1
    assert readers.read_leg(spark, root, "bom", "r9").count() == 4
    with pytest.raises(ValueError, match="no bom rows"):
        writers.write_snapshot_leg(bom.limit(0), root, "bom")
    with pytest.raises(ValueError, match="invalid restaurant_id"):
        readers.read_leg(spark, root, "bom", "../r9")


def test_food_cost_leg_is_cleared_when_nothing_costs(spark, bom):
    root = stage_path(spark, "raw")
    priced = prices(spark, [("beef", 3.0, D(2024, 1, 1))])
    writers.write_food_cost(ops.food_cost_leg(bom, priced, "2024-02-01"), root)
    assert readers.read_leg(spark, root, "food_cost").count() == 2
    writers.write_food_cost(ops.food_cost_leg(bom, priced.limit(0), "2024-02-01"), root)
    assert readers.read_leg(spark, root, "food_cost").count() == 0


def test_truth_is_read_from_truth_folders_only(spark):
    with pytest.raises(ValueError, match="_truth"):
        readers.read_truth(spark, "/tmp/raw", "truth_demand")


def raw(spark, rows, columns):
    return spark.createDataFrame([("r0", i, *r) for i, r in enumerate(rows)], f"restaurant_id string, seq bigint, {columns}")


def messages(checked):
    return {r.seq: r.message for r in quality.rejected_rows(checked).collect()}


def test_sales_rules(spark):
    rows = [("Cod", "5", "2024-01-01", "2024-01-07"), ("", "-5", "2024-01-01", "2024-01-07"), ("Cod", "lots", "soon", "2024-01-07"), ("Cod", " 7.0 ", "2024-01-08", "2024-01-07"), ("Cod", "7.5", "2024-1-1", None)]
    bad = messages(quality.validate_sales(raw(spark, rows, "dish_name string, count string, period_start string, period_end string")))
    assert bad == {
        1: "dish_name: must not be empty; count: must be 0 or more",
        2: "count: must be a whole number; period_start: must be a date",
        3: "period_end is before period_start",
        4: "count: must be a whole number; period_start: must be a date; period_end: must be a date",
    }
    with pytest.raises(ValueError, match="missing column"):
        quality.validate_sales(raw(spark, [("x",)], "dish_name string"))


def test_bom_rules(spark):
    rows = [("Cod", "Fish", "1", "oz", "oz", "1.0"), ("Cod", "Fish", "0", "oz", "oz", "1.4"), (" ", None, "nan", "", "oz", "0"), ("Cod", "Fish", "2d", "oz", None, "x")]
    checked = quality.validate_bom(raw(spark, rows, "dish_name string, ingredient_name string, qty string, recipe_unit string, canonical_unit string, yield_factor string"))
    bad = messages(checked)
    assert set(bad) == {1, 2, 3} and bad[1] == "qty: must be greater than 0; yield_factor: must be 1 or less"
    assert bad[3] == "qty: must be a number; canonical_unit: must not be empty; yield_factor: must be a number"
    assert quality.valid_rows(checked).first().dish_id == "cod"


def test_menu_price_entries(spark, bom):
    rows = [("r0", "steak", " 25 "), ("r0", "taco", "free"), ("r0", "stew", ""), ("r0", "gone", "9"), ("r0", "stew", "-1")]
    entries = spark.createDataFrame(rows, "restaurant_id string, dish_id string, value string").withColumn("updated_at", F.lit("2024-01-01").cast("timestamp_ntz"))
    got = sorted((r.dish_id, r.menu_price, r.error) for r in ops.menu_price_entries(entries, bom).collect())
    assert got == [
        ("steak", 25.0, None),
        ("stew", None, "Stew: menu price must be a positive number."),
        ("taco", None, "Taco: menu price must be a positive number."),
    ]


def test_plate_cost_names_the_first_failure(spark):
    lines = spark.createDataFrame(
        [("r0", 2, "stew", "ghost", 1.0, "oz"), ("r0", 1, "stew", "salt", 1.0, "oz"), ("r0", 1, "steak", "beef", 6.0, "oz"), ("r0", 1, "pie", "beef", 1.0, "cup")],
        schemas.CATALOG["recipe_lines"].names and "restaurant_id string, line_no bigint, dish_id string, ingredient_id string, qty double, recipe_unit string",
    )
    dishes = spark.createDataFrame([("r0", d, d.title(), True) for d in ("stew", "steak", "pie", "air")] + [("r0", "off", "Off", False)], "restaurant_id string, id string, name string, is_active boolean")
    ingredients = spark.createDataFrame([("r0", "beef", "Beef", "oz", 0.9), ("r0", "salt", "Salt", "oz", 1.0)], "restaurant_id string, id string, name string, canonical_unit string, yield_factor double")
    latest = pricing.latest_price(prices(spark, [("beef", 3.0, D(2024, 1, 1))]))
    got = {r.dish_id: (r.cost, r.reason) for r in ops.plate_cost(lines, dishes, ingredients, latest).collect()}
    assert got["steak"][0] == pytest.approx(20.0)
    assert {k: v[1] for k, v in got.items()} == {"steak": None, "stew": "no price for Salt", "pie": "no conversion from cup to oz", "air": "no recipe lines"}
