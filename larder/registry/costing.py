"""Queries over recipes, invoice prices, sales counts and menu prices."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.money import food_cost_pct_display, food_cost_tier, round_quarter
from ..functions.text import normalize_name
from ..functions.units import convert_units
from ..operators import costing as ops, pricing, quality
from ..sources import readers, writers
from ..sources.driver_views import Views
from ..sources.staging import stage_path
from . import query
from .common_sql import norm, strip, tier

AS_OF = "2001-12-31"
BOM_COLUMNS = "restaurant_id, dish_id, dish_name, ingredient_id, ingredient_name, qty, recipe_unit, canonical_unit, yield_factor"
PRICE_COLUMNS = "restaurant_id, seq, ingredient_id, ingredient_name, «unit_price» AS unit_price, source_invoice, observed_date"

# ---- reading and writing legs


@query("read_leg", f"SELECT {BOM_COLUMNS} FROM bom WHERE restaurant_id = 'r0'")
def read_leg(v: Views) -> DataFrame:
    root = stage_path(v.spark, "raw")
    writers.write_snapshot_leg(v.bom, root, "bom")
    return readers.read_leg(v.spark, root, "bom", "r0")


@query(
    "write_snapshot_leg",
    f"""SELECT restaurant_id, 'bom' AS leg, count(*) AS n_rows, «sum(qty)» AS total FROM bom
          WHERE restaurant_id = 'r0' OR qty <= 10 GROUP BY 1
        UNION ALL SELECT restaurant_id, 'sales_export', count(*), sum(count) FROM sales_export GROUP BY 1""",
)
def write_snapshot_leg(v: Views) -> DataFrame:
    """Write every tenant, then replace r1 alone; r0 has to survive."""
    root = stage_path(v.spark, "raw")
    writers.write_snapshot_leg(v.bom, root, "bom")
    writers.write_snapshot_leg(v.bom.where("restaurant_id = 'r1' and qty <= 10"), root, "bom")
    writers.write_snapshot_leg(v.sales_export, root, "sales_export")
    total = {"bom": F.sum("qty"), "sales_export": F.sum("count").cast("double")}
    parts = [
        readers.read_leg(v.spark, root, leg)
        .groupBy("restaurant_id")
        .agg(F.lit(leg).alias("leg"), F.count("*").alias("n_rows"), value.alias("total"))
        for leg, value in total.items()
    ]
    return parts[0].unionByName(parts[1])


@query(
    "append_prices_dedup",
    """SELECT restaurant_id, arg_max(seq, (seq, ingredient_name)) AS seq, ingredient_id,
         arg_max(ingredient_name, (seq, ingredient_name)) AS ingredient_name, «unit_price» AS unit_price, source_invoice, observed_date
       FROM price_observations GROUP BY restaurant_id, ingredient_id, price_observations.unit_price, source_invoice, observed_date""",
)
def append_prices_dedup(v: Views) -> DataFrame:
    """Resubmit every second row of the history: the result is the history itself, once."""
    again = v.price_observations.where("seq % 2 = 0")
    return writers.append_prices_dedup(v.price_observations, again)


@query(
    "append_prices_monthly",
    """SELECT restaurant_id, CASE WHEN observed_date IS NULL THEN 'none' ELSE strftime(observed_date, '%Y-%m') END AS month,
         count(*) AS n_rows, max(seq) AS last_seq, «sum(unit_price)» AS total FROM (
           SELECT restaurant_id, max(seq) AS seq, unit_price, observed_date FROM price_observations
           GROUP BY restaurant_id, ingredient_id, price_observations.unit_price, source_invoice, observed_date) h
       GROUP BY ALL""",
)
def append_prices_monthly(v: Views) -> DataFrame:
    """All invoices but those of the latest year, then the rest, then every second row of it again."""
    root = stage_path(v.spark, "prices")
    late = F.col("observed_date") >= "2001-01-01"
    for part in (~late, late, late & (F.col("seq") % 2 == 0)):
        writers.append_prices(v.price_observations.where(part), root)
    months = writers.read_price_history(v.spark, root).groupBy("restaurant_id", "month")
    return months.agg(F.count("*").alias("n_rows"), F.max("seq").alias("last_seq"), F.sum("unit_price").alias("total"))


@query("export_leg_csv", f"SELECT {BOM_COLUMNS} FROM bom")
def export_leg_csv(v: Views) -> DataFrame:
    from ..sources import schemas

    path = stage_path(v.spark, "bom-csv")
    columns = schemas.LEGS["bom"].names
    writers.export_leg_csv(v.bom.select(columns), path)
    return v.spark.read.schema(schemas.LEGS["bom"]).option("header", True).option("escape", '"').csv(path)


def catalog(v: Views) -> dict[str, DataFrame]:
    """The recipe tables in catalog form, ids included, and lines of an ingredient that is not listed."""
    bom = v.bom
    unknown = bom.where("ingredient_id = 'brand#25'").withColumn("ingredient_id", F.lit("brand#98"))
    ingredients = bom.groupBy("restaurant_id", "ingredient_id").agg(
        F.min("ingredient_name").alias("name"), F.min("yield_factor").alias("yield_factor")
    )
    dishes = bom.groupBy("restaurant_id", "dish_id").agg(F.min("dish_name").alias("name"))
    return {
        "ingredients": ingredients.select(
            "restaurant_id",
            F.col("ingredient_id").alias("id"),
            "name",
            F.lit("oz").alias("canonical_unit"),
            "yield_factor",
            F.when(F.col("ingredient_id") == "brand#2", "  ").otherwise("stocked").alias("notes"),
        ),
        "dishes": dishes.select(
            "restaurant_id",
            F.col("dish_id").alias("id"),
            "name",
            (F.length("name") * 2.5).alias("menu_price"),
            F.when(F.length("name") % 2 == 0, "dinner").otherwise(" ").alias("service_period"),
            F.when(F.length("name") % 5 == 0, " False ").otherwise("yes").alias("is_active"),
        ),
        "recipe_lines": bom.unionByName(unknown).select(
            "restaurant_id",
            F.expr("cast(substring(ingredient_id, 7) as bigint)").alias("line_no"),
            "dish_id",
            "ingredient_id",
            "qty",
            "recipe_unit",
        ),
        "prices": v.price_observations.select(
            "restaurant_id", "seq", "ingredient_id", "unit_price", "source_invoice", "observed_date"
        ),
    }


CATALOG_SQL = """WITH ingredients AS (
  SELECT restaurant_id, ingredient_id AS id, min(ingredient_name) AS name, 'oz' AS canonical_unit, min(yield_factor) AS yield_factor,
         CASE WHEN ingredient_id <> 'brand#2' THEN 'stocked' END AS notes
  FROM bom GROUP BY ALL
), dishes AS (
  SELECT restaurant_id, dish_id AS id, min(dish_name) AS name, length(min(dish_name)) * 2.5::DOUBLE AS menu_price,
         CASE WHEN length(min(dish_name)) % 2 = 0 THEN 'dinner' END AS service_period, length(min(dish_name)) % 5 <> 0 AS is_active
  FROM bom GROUP BY restaurant_id, dish_id
), recipe_lines AS (
  SELECT restaurant_id, CAST(substr(ingredient_id, 7) AS BIGINT) AS line_no, dish_id, ingredient_id, qty, recipe_unit FROM (
    SELECT * FROM bom UNION ALL SELECT * REPLACE ('brand#98' AS ingredient_id) FROM bom WHERE ingredient_id = 'brand#25')
)
"""


@query(
    "load_catalog",
    CATALOG_SQL
    + """SELECT restaurant_id, 'ingredient' AS kind, id, name, «yield_factor» AS number, notes AS note, CAST(NULL AS BOOLEAN) AS is_active FROM ingredients
         UNION ALL SELECT restaurant_id, 'dish', id, name, «menu_price», service_period, is_active FROM dishes
         UNION ALL SELECT restaurant_id, 'line', dish_id, ingredient_id, «qty», recipe_unit, NULL FROM recipe_lines
         UNION ALL SELECT restaurant_id, 'price', ingredient_id, CAST(seq AS VARCHAR), «unit_price», source_invoice, NULL FROM price_observations""",
)
def load_catalog(v: Views) -> DataFrame:
    root = stage_path(v.spark, "catalog")
    for name, df in catalog(v).items():
        df.write.option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option(
            "ignoreTrailingWhiteSpace", False
        ).csv(f"{root}/{name}")
    tables = readers.load_catalog(v.spark, root)
    none = F.lit(None).cast("boolean")
    col = F.col
    parts = [
        tables["ingredients"].select("restaurant_id", F.lit("ingredient").alias("kind"), "id", "name", col("yield_factor").alias("number"), col("notes").alias("note"), none.alias("is_active")),
        tables["dishes"].select("restaurant_id", F.lit("dish").alias("kind"), "id", "name", col("menu_price").alias("number"), col("service_period").alias("note"), "is_active"),
        tables["recipe_lines"].select("restaurant_id", F.lit("line").alias("kind"), col("dish_id").alias("id"), col("ingredient_id").alias("name"), col("qty").alias("number"), col("recipe_unit").alias("note"), none.alias("is_active")),
        tables["prices"].select("restaurant_id", F.lit("price").alias("kind"), col("ingredient_id").alias("id"), col("seq").cast("string").alias("name"), col("unit_price").alias("number"), col("source_invoice").alias("note"), none.alias("is_active")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@query(
    "denormalize_bom",
    CATALOG_SQL
    + """SELECT l.restaurant_id, l.dish_id, d.name AS dish_name, l.ingredient_id, i.name AS ingredient_name, l.qty, l.recipe_unit,
           i.canonical_unit, «i.yield_factor» AS yield_factor
         FROM recipe_lines l JOIN dishes d ON d.restaurant_id = l.restaurant_id AND d.id = l.dish_id
         JOIN ingredients i ON i.restaurant_id = l.restaurant_id AND i.id = l.ingredient_id""",
)
def denormalize_bom(v: Views) -> DataFrame:
    tables = catalog(v)
    return quality.denormalize_bom(tables["recipe_lines"], tables["dishes"], tables["ingredients"])


@query("active_dishes", CATALOG_SQL + "SELECT restaurant_id, id, name FROM dishes WHERE is_active")
def active_dishes(v: Views) -> DataFrame:
    dishes = catalog(v)["dishes"].withColumn("is_active", F.lower(F.trim("is_active")) != "false")
    return ops.active_dishes(dishes).select("restaurant_id", "id", "name")


@query(
    "plate_cost",
    CATALOG_SQL
    + """SELECT restaurant_id, dish_id, dish_name, CASE WHEN count(reason) = 0 THEN «sum(line_cost)» END AS cost,
           arg_min(reason, line_no) FILTER (reason IS NOT NULL) AS reason
         FROM (
           SELECT d.restaurant_id, d.id AS dish_id, d.name AS dish_name, l.line_no,
             CASE WHEN l.recipe_unit = i.canonical_unit THEN l.qty WHEN u.family = 'w' THEN l.qty * u.factor / 1.0 END / i.yield_factor * p.unit_price AS line_cost,
             CASE WHEN i.id IS NULL THEN 'unknown ingredient ' || l.ingredient_id WHEN p.unit_price IS NULL THEN 'no price for ' || i.name
                  WHEN l.recipe_unit <> 'oz' AND coalesce(u.family, 'v') = 'v' THEN 'no conversion from ' || l.recipe_unit || ' to oz' END AS reason
           FROM dishes d JOIN recipe_lines l ON l.restaurant_id = d.restaurant_id AND l.dish_id = d.id
           LEFT JOIN ingredients i ON i.restaurant_id = l.restaurant_id AND i.id = l.ingredient_id
           LEFT JOIN latest p ON p.restaurant_id = l.restaurant_id AND p.ingredient_id = l.ingredient_id
           LEFT JOIN units u ON u.unit = l.recipe_unit WHERE d.is_active
         ) x GROUP BY 1, 2, 3""",
)
def plate_cost(v: Views) -> DataFrame:
    tables = catalog(v)
    dishes = tables["dishes"].withColumn("is_active", F.lower(F.trim("is_active")) != "false")
    latest = pricing.latest_price(v.price_observations)
    return ops.plate_cost(tables["recipe_lines"], dishes, tables["ingredients"], latest)


# ---- upload gates


def raw_sales(v: Views) -> DataFrame:
    """The sales export as uploaded text, with every kind of mistake somewhere in it."""
    s = F.col("seq")
    text = {c: F.col(c).cast("string") for c in ("count", "period_start", "period_end")}
    rows = v.sales_export.withColumns(text)
    return rows.withColumns(
        {
            "dish_name": F.when(s % 109 == 0, "").otherwise(F.col("dish_name")),
            "count": F.when(s % 101 == 0, "lots").when(s % 103 == 0, "-5").when(s % 2 == 0, F.concat("count", F.lit(".0"))).otherwise(F.col("count")),
            "period_start": F.when(s % 113 == 0, "soon").otherwise(F.col("period_start")),
            "period_end": F.when(s % 107 == 0, "1990-01-01").otherwise(F.col("period_end")),
        }
    )


RAW_SALES = """raw AS (SELECT restaurant_id, seq, CASE WHEN seq % 109 = 0 THEN '' ELSE dish_name END AS dish_name,
  seq % 101 = 0 AS not_number, seq % 103 = 0 AND seq % 101 <> 0 AS negative, seq % 113 = 0 AS no_start, seq % 107 = 0 AS early FROM sales_export)"""


def _messages(rules: list[tuple[str, str]]) -> str:
    parts = ", ".join(f"CASE WHEN {test} THEN '{text}' END" for test, text in rules)
    return f"array_to_string(list_filter([{parts}], lambda x: x IS NOT NULL), '; ')"


@query(
    "validate_sales",
    f"""WITH {RAW_SALES}
    SELECT restaurant_id, seq, 'Sales row ' || CAST(seq AS VARCHAR) || ' (' || CASE WHEN {strip("dish_name")} = '' THEN '?' ELSE {strip("dish_name")} END || ')' AS row_label, message
    FROM (SELECT *, {_messages([("dish_name = ''", "dish_name: must not be empty"), ("not_number", "count: must be a whole number"),
      ("negative", "count: must be 0 or more"), ("no_start", "period_start: must be a date"),
      ("early AND NOT no_start", "period_end is before period_start")])} AS message FROM raw) x WHERE message <> ''""",
)
def validate_sales(v: Views) -> DataFrame:
    return quality.rejected_rows(quality.validate_sales(raw_sales(v)))


def raw_bom(v: Views) -> DataFrame:
    n, q = F.length("dish_name"), F.col("qty").cast("int")
    seq = F.col("qty").cast("bigint") * 100 + F.expr("cast(substring(ingredient_id, 7) as bigint)")
    rows = v.bom.withColumn("seq", seq)
    return rows.select(
        "restaurant_id",
        "seq",
        F.when(q % 11 == 3, " \t").otherwise(F.concat(F.lit(" "), "dish_name")).alias("dish_name"),
        "ingredient_name",
        F.when(q % 7 == 2, "0").when(q % 7 == 4, "some").otherwise(F.col("qty").cast("string")).alias("qty"),
        F.when(n % 7 == 0, "").otherwise(F.col("recipe_unit")).alias("recipe_unit"),
        "canonical_unit",
        F.when(q % 5 == 1, "1.4").when(q % 5 == 2, "0").otherwise(F.col("yield_factor").cast("string")).alias("yield_factor"),
    )


@query(
    "validate_bom",
    f"""WITH raw AS (SELECT *, CAST(qty AS INTEGER) AS q, CAST(qty AS BIGINT) * 100 + CAST(substr(ingredient_id, 7) AS BIGINT) AS seq FROM bom)
    SELECT restaurant_id, seq, 'Recipe row ' || CAST(seq AS VARCHAR) || ' (' || CASE WHEN q % 11 = 3 THEN '?' ELSE dish_name END || ' / ' || ingredient_name || ')' AS row_label, message
    FROM (SELECT *, {_messages([("q % 11 = 3", "dish_name: must not be empty"), ("q % 7 = 4", "qty: must be a number"),
      ("q % 7 = 2", "qty: must be greater than 0"), ("length(dish_name) % 7 = 0", "recipe_unit: must not be empty"),
      ("q % 5 = 2", "yield_factor: must be greater than 0"), ("q % 5 = 1", "yield_factor: must be 1 or less")])} AS message FROM raw) x WHERE message <> ''""",
)
def validate_bom(v: Views) -> DataFrame:
    return quality.rejected_rows(quality.validate_bom(raw_bom(v)))


def raw_prices(v: Views) -> DataFrame:
    s = F.col("seq")
    return v.price_observations.select(
        "restaurant_id",
        "seq",
        F.when(s % 89 == 0, " ").otherwise(F.col("ingredient_name")).alias("ingredient_name"),
        F.when(s % 83 == 0, "0").when(s % 79 == 0, "n/a").otherwise(F.col("unit_price").cast("string")).alias("unit_price"),
        F.coalesce("source_invoice", F.lit("  ")).alias("source_invoice"),
        F.when(s % 73 == 0, "2001-13-01").otherwise(F.col("observed_date").cast("string")).alias("observed_date"),
    )


@query(
    "validate_prices",
    f"""WITH checked AS (SELECT *, {_messages([("seq % 89 = 0", "ingredient_name: must not be empty"), ("seq % 79 = 0 AND seq % 83 <> 0", "unit_price: must be a number"),
      ("seq % 83 = 0", "unit_price: must be greater than 0"), ("seq % 73 = 0", "observed_date: must be a date")])} AS message FROM price_observations)
    SELECT restaurant_id, seq, source_invoice, message = '' AS valid, message FROM checked""",
)
def validate_prices(v: Views) -> DataFrame:
    checked = quality.validate_prices(raw_prices(v))
    return checked.select(
        "restaurant_id",
        "seq",
        "source_invoice",
        (F.col("message") == "").alias("valid"),
        "message",
    )


@query(
    "xref_dishes",
    f"""WITH b AS (SELECT DISTINCT restaurant_id, {norm("dish_name")} AS k, dish_name FROM bom),
       s AS (SELECT restaurant_id, {norm("dish_name")} AS k, arg_max(dish_name, (seq, dish_name)) AS dish_name FROM sales_export GROUP BY ALL)
       SELECT restaurant_id, 'only_in_bom' AS side, dish_name AS name FROM b ANTI JOIN s USING (restaurant_id, k)
       UNION ALL SELECT restaurant_id, 'only_in_sales', dish_name FROM s ANTI JOIN b USING (restaurant_id, k)""",
)
def xref_dishes(v: Views) -> DataFrame:
    return quality.xref_dishes(v.bom, v.sales_export)


@query(
    "xref_ingredients",
    """SELECT restaurant_id, max(ingredient_name) AS name FROM (SELECT restaurant_id, ingredient_id, ingredient_name FROM price_observations
         UNION ALL SELECT restaurant_id, 'old ' || ingredient_id, 'Old ' || ingredient_name FROM price_observations WHERE seq % 7 = 0) p
       WHERE NOT EXISTS (SELECT 1 FROM bom b WHERE b.restaurant_id = p.restaurant_id AND b.ingredient_id = p.ingredient_id)
       GROUP BY restaurant_id, ingredient_id""",
)
def xref_ingredients(v: Views) -> DataFrame:
    """All invoices, and some more of ingredients that no recipe names."""
    unused = v.price_observations.where("seq % 7 = 0").withColumns(
        {"ingredient_id": F.concat(F.lit("old "), "ingredient_id"), "ingredient_name": F.concat(F.lit("Old "), "ingredient_name")}
    )
    return quality.xref_ingredients(v.price_observations.unionByName(unused), v.bom)


# ---- scalar rules


@query("normalize_name", f"SELECT restaurant_id, {norm('dish_name')} AS name_key, count(*) AS n FROM sales_export GROUP BY ALL")
def normalize_name_query(v: Views) -> DataFrame:
    spelled = v.sales_export.groupBy("restaurant_id", "dish_name").agg(F.count("*").alias("n"))
    return spelled.groupBy("restaurant_id", normalize_name(F.col("dish_name")).alias("name_key")).agg(
        F.sum("n").alias("n")
    )


@query(
    "convert_units",
    """SELECT DISTINCT p_size AS qty, f.unit AS from_unit, t.unit AS to_unit,
         «CASE WHEN f.unit = t.unit THEN p_size WHEN f.family = t.family THEN p_size * f.factor / t.factor END» AS converted
       FROM part, units f, (SELECT * FROM units) t""",
)
def convert_units_query(v: Views) -> DataFrame:
    from ..functions.units import VOLUME_FLOZ, WEIGHT_OZ

    names = F.array(*[F.lit(u) for u in [*WEIGHT_OZ, *VOLUME_FLOZ]])
    sizes = v.table("part").select(F.col("p_size").alias("qty")).distinct()
    pairs = sizes.withColumn("from_unit", F.explode(names)).withColumn("to_unit", F.explode(names))
    spelled = F.concat(F.lit(" "), F.upper("from_unit"))
    return pairs.withColumn("converted", convert_units(F.col("qty").cast("double"), spelled, F.col("to_unit")))


@query(
    "round_quarter",
    "SELECT DISTINCT p_size, round_even(p_size / 8.0::DOUBLE * 4, 0) / 4 AS rounded FROM part",
)
def round_quarter_query(v: Views) -> DataFrame:
    """Eighths of a dollar: every other value is an exact half, which goes to the even quarter."""
    sizes = v.table("part").select("p_size").distinct()
    return sizes.withColumn("rounded", round_quarter(F.col("p_size") / 8.0))


@query("food_cost_tier", f"SELECT restaurant_id, dish_id, «food_cost_pct» AS share, {tier('round(food_cost_pct, 9)')} AS tier FROM grid_rows")
def food_cost_tier_query(v: Views) -> DataFrame:
    rows = ops.priced_dishes(v.bom, v.price_observations, v.menu_prices)
    share = F.col("cost") / F.col("menu_price")
    return rows.select("restaurant_id", "dish_id", share.alias("share"), food_cost_tier(F.round(share, 9)).alias("tier"))


@query(
    "food_cost_pct_display",
    f"""SELECT restaurant_id, dish_id, pct, {tier("pct")} AS tier FROM (
          SELECT *, round_even(round(cost, 9) / menu_price * 100, 0) / 100 AS pct FROM grid_rows) x""",
)
def food_cost_pct_display_query(v: Views) -> DataFrame:
    rows = ops.priced_dishes(v.bom, v.price_observations, v.menu_prices)
    pct = food_cost_pct_display(F.round("cost", 9), F.col("menu_price"))
    return rows.select("restaurant_id", "dish_id", pct.alias("pct"), food_cost_tier(pct).alias("tier"))


# ---- prices


@query("latest_price", "SELECT restaurant_id, ingredient_id, ingredient_name, «unit_price» AS unit_price, observed_date FROM latest")
def latest_price(v: Views) -> DataFrame:
    return pricing.latest_price(v.price_observations)


TREND_COLUMNS = """restaurant_id, ingredient_id, ingredient_name, «current_price» AS current_price, «prior_price» AS prior_price,
  current_observed_date, prior_observed_date"""


@query("price_asof", f"SELECT {TREND_COLUMNS} FROM trend")
def price_asof(v: Views) -> DataFrame:
    return pricing.price_asof(v.price_observations)


@query("price_trend", f"SELECT {TREND_COLUMNS}, «pct_change» AS pct_change, direction FROM trend")
def price_trend(v: Views) -> DataFrame:
    return pricing.price_trend(v.price_observations)


@query(
    "significant_moves",
    f"SELECT {TREND_COLUMNS}, «pct_change» AS pct_change, direction FROM trend WHERE abs(pct_change) >= 0.10::DOUBLE",
)
def significant_moves(v: Views) -> DataFrame:
    return pricing.ranked_moves(pricing.price_trend(v.price_observations))


@query(
    "retention",
    f"""SELECT {PRICE_COLUMNS} FROM (SELECT *, max(observed_date) OVER (PARTITION BY restaurant_id, ingredient_id) AS newest FROM (
          SELECT * FROM price_observations UNION ALL SELECT * REPLACE (-seq AS seq, 'brand#77' AS ingredient_id)
          FROM price_observations WHERE ingredient_id = 'brand#7' AND observed_date < DATE '2000-01-01') h) x
        WHERE observed_date >= DATE '{AS_OF}' - 400 OR observed_date = newest""",
)
def retention(v: Views) -> DataFrame:
    """One more ingredient was invoiced early only, so its newest day is far older than the cutoff."""
    early = v.price_observations.where("ingredient_id = 'brand#7' and observed_date < date '2000-01-01'")
    early = early.withColumns({"seq": -F.col("seq"), "ingredient_id": F.lit("brand#77")})
    return pricing.retention(v.price_observations.unionByName(early), AS_OF)


# ---- costs and the grid


@query(
    "bom_price_join",
    """SELECT restaurant_id, dish_id, ingredient_id, «unit_price» AS unit_price, «line_qty» AS line_qty, «line_cost» AS line_cost FROM bom_lines""",
)
def bom_price_join(v: Views) -> DataFrame:
    lines = ops.bom_price_join(v.bom, pricing.latest_price(v.price_observations))
    return lines.select("restaurant_id", "dish_id", "ingredient_id", "unit_price", "line_qty", "line_cost")


@query("dish_ingredient_cost", "SELECT restaurant_id, dish_id, dish_name, «cost» AS cost FROM dish_costs")
def dish_ingredient_cost(v: Views) -> DataFrame:
    return ops.dish_ingredient_cost(ops.bom_price_join(v.bom, pricing.latest_price(v.price_observations)))


@query(
    "food_cost_leg",
    f"SELECT restaurant_id, dish_id, dish_name, «cost» AS food_cost, DATE '{AS_OF}' AS computed_at FROM dish_costs",
)
def food_cost_leg(v: Views) -> DataFrame:
    root = stage_path(v.spark, "raw")
    writers.write_food_cost(ops.food_cost_leg(v.bom, v.price_observations, AS_OF), root)
    return readers.read_leg(v.spark, root, "food_cost")


@query("covers_by_dish", "SELECT restaurant_id, dish_key, covers, display_name FROM covers")
def covers_by_dish(v: Views) -> DataFrame:
    return ops.covers_by_dish(v.sales_export)


@query(
    "covers_join",
    f"""SELECT d.restaurant_id, d.dish_id, coalesce(c.covers, 0) AS covers FROM (SELECT DISTINCT restaurant_id, dish_id, dish_name FROM bom) d
        LEFT JOIN covers c ON c.restaurant_id = d.restaurant_id AND c.dish_key = {norm("d.dish_name")}""",
)
def covers_join(v: Views) -> DataFrame:
    dishes = v.bom.select("restaurant_id", "dish_id", "dish_name").distinct()
    return ops.covers_join(dishes, ops.covers_by_dish(v.sales_export)).select("restaurant_id", "dish_id", "covers")


@query(
    "covers_report",
    f"""WITH sold AS (SELECT * FROM covers),
        menu AS (SELECT DISTINCT restaurant_id, {norm("dish_name")} AS dish_key FROM bom)
        SELECT restaurant_id, 'unmatched_dish' AS kind, max(dish_name) AS name FROM dish_costs d
          WHERE NOT EXISTS (SELECT 1 FROM sold s WHERE s.restaurant_id = d.restaurant_id AND s.dish_key = {norm("d.dish_name")})
          GROUP BY restaurant_id, {norm("dish_name")}
        UNION ALL SELECT restaurant_id, 'orphaned_sale', display_name FROM sold ANTI JOIN menu USING (restaurant_id, dish_key)""",
)
def covers_report(v: Views) -> DataFrame:
    costed = ops.dish_ingredient_cost(ops.bom_price_join(v.bom, pricing.latest_price(v.price_observations)))
    return ops.covers_report(costed, v.bom, ops.covers_by_dish(v.sales_export))


@query("menu_price_latest", "SELECT restaurant_id, dish_id, menu_price FROM saved_prices")
def menu_price_latest(v: Views) -> DataFrame:
    return ops.menu_price_latest(v.menu_prices)


@query(
    "menu_price_form",
    "SELECT restaurant_id, dish_id, dish_name, menu_price FROM (SELECT DISTINCT restaurant_id, dish_id, dish_name FROM bom) b LEFT JOIN saved_prices USING (restaurant_id, dish_id)",
)
def menu_price_form(v: Views) -> DataFrame:
    return ops.menu_price_form(v.bom, v.menu_prices)


@query(
    "unpriced_dishes",
    f"""SELECT restaurant_id, dish_name, CASE WHEN NOT costed THEN '{ops.NO_COST}' ELSE '{ops.NO_MENU_PRICE}' END AS reason
        FROM (SELECT restaurant_id, dish_id, min(dish_name) AS dish_name, count(line_cost) = count(*) AS costed FROM bom_lines GROUP BY 1, 2) d
        LEFT JOIN saved_prices USING (restaurant_id, dish_id) WHERE NOT costed OR menu_price IS NULL""",
)
def unpriced_dishes(v: Views) -> DataFrame:
    return ops.unpriced_dishes(v.bom, v.price_observations, v.menu_prices)


FORM = """WITH form AS (SELECT *, CASE WHEN length(dish_name) % 4 = 0 THEN '' WHEN length(dish_name) % 4 = 1 THEN 'free'
    WHEN length(dish_name) % 4 = 2 THEN '-' || length(dish_name) ELSE ' ' || length(dish_name) || '.50 ' END AS value
  FROM (SELECT DISTINCT restaurant_id, dish_id, dish_name FROM bom) b)
"""


@query(
    "menu_price_entries",
    FORM
    + """SELECT restaurant_id, CASE WHEN known THEN dish_name END AS dish_name, CASE WHEN known THEN dish_id ELSE 'gone ' || dish_id END AS dish_id,
           CASE WHEN length(dish_name) % 4 = 3 THEN length(dish_name) + 0.5::DOUBLE END AS menu_price,
           CASE WHEN length(dish_name) % 4 <> 3 THEN CASE WHEN known THEN dish_name ELSE 'gone ' || dish_id END || ': menu price must be a positive number.' END AS error
         FROM form, (SELECT unnest([true, false]) AS known) k
         WHERE value <> '' AND (known OR dish_name LIKE 'red%' AND length(dish_name) % 4 <> 3)""",
)
def menu_price_entries(v: Views) -> DataFrame:
    """A price form over all dishes, and over some that the BOM no longer has."""
    dishes = v.bom.select("restaurant_id", "dish_id", "dish_name").distinct()
    n = F.length("dish_name")
    value = (
        F.when(n % 4 == 0, "").when(n % 4 == 1, "free").when(n % 4 == 2, F.concat(F.lit("-"), n.cast("string")))
        .otherwise(F.concat(F.lit(" "), n.cast("string"), F.lit(".50 ")))
    )
    now = F.lit("2024-06-01 09:00:00").cast("timestamp_ntz").alias("updated_at")
    entries = dishes.select("restaurant_id", "dish_id", value.alias("value"), now)
    gone = entries.where(F.col("dish_id").startswith("red")).withColumn("dish_id", F.concat(F.lit("gone "), "dish_id"))
    return ops.menu_price_entries(entries.unionByName(gone), v.bom).drop("updated_at")


@query(
    "validate_food_cost",
    """SELECT restaurant_id, dish_id, dish_name, «CASE WHEN cost > 100 THEN -cost ELSE cost END» AS food_cost FROM dish_costs
       WHERE cost > 100""",
)
def validate_food_cost(v: Views) -> DataFrame:
    """The derived cost leg with expensive dishes turned negative: exactly those are refused."""
    leg = ops.food_cost_leg(v.bom, v.price_observations, AS_OF)
    broken = F.when(F.col("food_cost") > 100, -F.col("food_cost")).otherwise(F.col("food_cost"))
    return quality.validate_food_cost(leg.withColumn("food_cost", broken)).drop("computed_at")


def grid(v: Views) -> DataFrame:
    priced = ops.priced_dishes(v.bom, v.price_observations, v.menu_prices)
    return ops.menu_grid(priced, ops.covers_by_dish(v.sales_export))


@query(
    "menu_grid",
    """SELECT restaurant_id, dish_id, dish_name, «cost» AS cost, menu_price, covers, «margin» AS margin, «food_cost_pct» AS food_cost_pct,
         quadrant, food_cost_tier FROM grid""",
)
def menu_grid(v: Views) -> DataFrame:
    return ops.ordered_grid(grid(v))


@query(
    "costed_grid",
    """SELECT restaurant_id, dish_id, dish_name AS name, menu_price, cost_display, «margin_display» AS margin_display,
         food_share AS food_cost_pct, shown_tier AS food_cost_tier, covers, quadrant FROM shown""",
)
def costed_grid(v: Views) -> DataFrame:
    return ops.display_grid(grid(v))


@query(
    "grid_footer",
    """SELECT restaurant_id, CAST(sum(covers) AS BIGINT) AS total_covers,
         «CASE WHEN sum(covers) <> 0 THEN sum(margin_display * covers) / sum(covers) END» AS avg_margin_per_cover FROM shown GROUP BY 1""",
)
def grid_footer(v: Views) -> DataFrame:
    return ops.grid_footer(ops.display_grid(grid(v)))


@query(
    "dish_detail",
    f"""SELECT l.restaurant_id, l.dish_id, l.dish_name, l.ingredient_name, l.qty, l.recipe_unit, «l.line_cost» AS as_used_cost, cost_display, menu_price,
          «menu_price - cost_display» AS margin_display, pct AS food_cost_pct, CASE WHEN pct IS NOT NULL THEN {tier("pct")} END AS food_cost_tier
        FROM bom_lines l JOIN (SELECT *, round_even(cost_display / menu_price * 100, 0) / 100 AS pct FROM (
          SELECT restaurant_id, dish_id, CASE WHEN count(line_cost) = count(*) THEN round_even(round(sum(line_cost), 9) * 4, 0) / 4 END AS cost_display
          FROM bom_lines GROUP BY 1, 2) t LEFT JOIN saved_prices USING (restaurant_id, dish_id)) d USING (restaurant_id, dish_id)""",
)
def dish_detail(v: Views) -> DataFrame:
    return ops.dish_detail(v.bom, v.price_observations, v.menu_prices)


# ---- summaries and findings


@query(
    "data_summary",
    """SELECT restaurant_id, dish_count, bom_row_count, sales_row_count, total_covers, period_start, period_end, price_observation_count,
         priced_ingredient_count, coalesce(n_costed, 0) AS food_cost_dish_count
       FROM (SELECT restaurant_id, count(DISTINCT dish_name) AS dish_count, count(*) AS bom_row_count FROM bom GROUP BY 1) b
       JOIN (SELECT restaurant_id, count(*) AS sales_row_count, CAST(sum(count) AS BIGINT) AS total_covers, min(period_start) AS period_start,
               max(period_end) AS period_end FROM sales_export GROUP BY 1) s USING (restaurant_id)
       JOIN (SELECT restaurant_id, count(*) AS price_observation_count, count(DISTINCT ingredient_id) AS priced_ingredient_count
             FROM price_observations GROUP BY 1) p USING (restaurant_id)
       LEFT JOIN (SELECT restaurant_id, count(*) AS n_costed FROM dish_costs GROUP BY 1) c USING (restaurant_id)""",
)
def data_summary(v: Views) -> DataFrame:
    food_cost = ops.food_cost_leg(v.bom, v.price_observations, AS_OF)
    return ops.data_summary(v.bom, v.sales_export, v.price_observations, food_cost)


@query(
    "upload_summary",
    f"""SELECT restaurant_id, dish_count, recipe_line_count, sales_row_count, total_covers, period_start, period_end, costable_dish_count
       FROM (SELECT restaurant_id, count(DISTINCT dish_name) AS dish_count, count(*) AS recipe_line_count FROM bom GROUP BY 1) b
       JOIN (SELECT restaurant_id, count(*) AS sales_row_count, CAST(sum(count) AS BIGINT) AS total_covers, min(period_start) AS period_start,
               max(period_end) AS period_end FROM sales_export GROUP BY 1) s USING (restaurant_id)
       JOIN (SELECT restaurant_id, count(*) AS costable_dish_count FROM (
               SELECT restaurant_id, {norm("dish_name")} FROM bom INTERSECT SELECT restaurant_id, {norm("dish_name")} FROM sales_export) x GROUP BY 1) c USING (restaurant_id)""",
)
def upload_summary(v: Views) -> DataFrame:
    return ops.upload_summary(v.bom, v.sales_export)


@query(
    "invoice_summary",
    """SELECT restaurant_id, count(*) AS row_count, count(DISTINCT ingredient_id) AS ingredient_count, min(observed_date) AS period_start,
         max(observed_date) AS period_end FROM price_observations GROUP BY 1""",
)
def invoice_summary(v: Views) -> DataFrame:
    return ops.invoice_summary(v.price_observations)


@query(
    "opportunities",
    """SELECT restaurant_id, ingredient_id, a.ingredient_name, «a.pct_change» AS pct_change, a.direction, «a.current_price» AS current_price,
         «a.prior_price» AS prior_price, dish_id, dish_name, «prior_cost» AS prior_cost, «new_cost» AS new_cost, «new_cost - prior_cost» AS delta,
         days_span, «impact» AS impact, costed_dish_count, uncosted_dish_count
       FROM affected a JOIN moves m USING (restaurant_id, ingredient_id) WHERE a.costed""",
)
def opportunities(v: Views) -> DataFrame:
    return ops.opportunities(v.bom, v.price_observations)


@query(
    "headline",
    """SELECT restaurant_id, ingredient_id, upper(substr(ingredient_name, 1, 1)) || lower(substr(ingredient_name, 2)) || ' '
         || CASE direction WHEN 'up' THEN '+' WHEN 'down' THEN '-' ELSE '' END || CAST(CAST(round_even(abs(pct_change) * 100, 0) AS BIGINT) AS VARCHAR) || '% '
         || CASE WHEN days_span <= 10 THEN 'this week' ELSE 'over the last ' || CAST(days_span AS VARCHAR) || ' days' END || ' — '
         || CAST(costed_dish_count + uncosted_dish_count AS VARCHAR) || CASE WHEN costed_dish_count + uncosted_dish_count = 1 THEN ' dish' ELSE ' dishes' END || ' affected'
         || CASE WHEN uncosted_dish_count > 0 THEN ' (' || CAST(uncosted_dish_count AS VARCHAR) || ' not yet fully priced)' ELSE '' END AS headline
       FROM moves""",
)
def headline(v: Views) -> DataFrame:
    affected = ops.affected_dishes(v.bom, v.price_observations)
    return ops.headlines(ops.opportunity_totals(affected))


_ROUNDED = "round_even(round({0}, 9) * 4, 0) / 4"


@query(
    "findings",
    f"""SELECT restaurant_id, ingredient_id, m.direction, «m.impact» AS impact, dish_name,
          «{_ROUNDED.format("prior_cost")}» AS prior_cost, «{_ROUNDED.format("new_cost")}» AS new_cost,
          «{_ROUNDED.format("new_cost")} - {_ROUNDED.format("prior_cost")}» AS delta
        FROM affected a JOIN moves m USING (restaurant_id, ingredient_id) WHERE a.costed""",
)
def findings(v: Views) -> DataFrame:
    """The findings as presented, one row per dish of each."""
    found = ops.findings(v.bom, v.price_observations)
    rows = found.select("restaurant_id", "ingredient_id", "direction", "impact", F.explode("affected_dishes").alias("dish"))
    return rows.select("restaurant_id", "ingredient_id", "direction", "impact", "dish.dish_name", "dish.prior_cost", "dish.new_cost", "dish.delta")
