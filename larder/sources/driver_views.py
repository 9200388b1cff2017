"""The library's input tables, derived from the driver's star schema.

Every view is a lazy DataFrame over the whole tables. Tenants are ``r0`` and ``r1``.
"""
from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from ..functions.text import normalize_name
from ..operators.joins import dimension_join

# Menu reprints, staff accounts.
MENU_ERAS = """
    (DATE '1995-06-01', 0), (DATE '1996-03-01', 1), (DATE '1997-01-01', 2),
    (DATE '1998-01-01', 3), (DATE '1999-06-01', 4), (DATE '2000-09-01', 5)
"""
STAFF = ("S001", "S002")
PRICE_DIVISOR = 40000.0


class Views:
    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark = spark
        self.sf_dir = sf_dir
        # Schemas already read from the files' footers; the data itself is never kept.
        self._schemas: dict[str, StructType] = {}

    def table(self, name: str) -> DataFrame:
        path = f"{self.sf_dir}/{name}.parquet"
        if path not in self._schemas:
            self._schemas[path] = self.spark.read.parquet(path).schema
        return self.spark.read.schema(self._schemas[path]).parquet(path)

    def literals(self, rows: str, columns: str) -> DataFrame:
        return self.spark.sql(f"SELECT * FROM (VALUES {rows}) AS t({columns})")

    @cached_property
    def tenants(self) -> DataFrame:
        return self.literals("('r0'), ('r1')", "restaurant_id")

    def _per_tenant(self, df: DataFrame) -> DataFrame:
        both = F.explode(F.array(F.lit("r0"), F.lit("r1"))).alias("restaurant_id")
        return df.select(both, *df.columns)

    @cached_property
    def lines(self) -> DataFrame:
        """Order lines with their part. Name keys are made per part."""
        part = self.table("part").withColumnRenamed("p_partkey", "l_partkey")
        part = part.withColumn("brand_key", normalize_name(F.col("p_brand")))
        joined = dimension_join(self.table("lineitem"), part, ["l_partkey"])
        place = (F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 1000000
        return joined.withColumns(
            {
                "restaurant_id": F.concat(F.lit("r"), (F.col("l_suppkey") % 2).cast("string")),
                "business_date": F.col("l_shipdate").cast("date"),
                "seq": place + (F.col("l_partkey") * 1000 + F.col("l_suppkey")) % 1000000,
            }
        )

    @cached_property
    def pos_sales(self) -> DataFrame:
        key = F.col("l_orderkey")
        hour = 11 + key % 11
        line_id = F.concat_ws(
            "-", key, "l_linenumber", "l_partkey", "l_suppkey", F.col("business_date").cast("string")
        )
        name = (
            F.when(key % 3 == 0, F.col("p_type"))
            .when(key % 3 == 1, F.concat(F.lit("House "), "p_type"))
            .otherwise(F.concat("p_type", F.lit(" plate")))
        )
        return self.lines.select(
            "restaurant_id",
            F.concat(F.lit("C"), key.cast("string")).alias("check_id"),
            line_id.alias("line_id"),
            "business_date",
            (F.col("business_date").cast("timestamp_ntz") + F.make_dt_interval(hours=hour.cast("int"))).alias("sold_at"),
            name.alias("item_name"),
            F.col("p_brand").alias("category"),
            F.col("p_retailprice").alias("menu_price"),
            F.when(key % 97 == 0, 0).otherwise(F.col("l_quantity").cast("int")).alias("qty"),
            F.lit(None).cast("string").alias("modifiers"),
            (F.col("l_extendedprice") * F.col("l_discount")).alias("discount_amount"),
            F.when(F.col("l_discount") >= 0.09, F.lit("True")).alias("comp_flag"),
            F.when(key % 61 == 0, "True").when(key % 67 == 0, "1").otherwise("False").alias("void_flag"),
            F.concat(F.lit("S"), F.lpad((F.col("l_suppkey") % 10).cast("string"), 3, "0")).alias("server_id"),
        )

    @cached_property
    def eightysix_log(self) -> DataFrame:
        sold_out = self.pos_sales.where(F.substring("check_id", 2, 20).cast("bigint") % 53 == 7)
        return sold_out.select(
            "restaurant_id",
            "business_date",
            "item_name",
            F.concat(F.hour("sold_at").cast("string"), F.lit(":30")).alias("time_86d"),
        )

    @cached_property
    def item_aliases(self) -> DataFrame:
        kinds = self.table("part").select("p_type").distinct()
        names = F.explode(
            F.array(
                F.col("p_type"), F.concat(F.lit("House "), "p_type"), F.concat("p_type", F.lit(" plate"))
            )
        )
        return self._per_tenant(kinds.select(F.lower("p_type").alias("item_id"), names.alias("alias")))

    @cached_property
    def menu_eras(self) -> DataFrame:
        return self.literals(MENU_ERAS, "start_date, era_id")

    @cached_property
    def item_economics(self) -> DataFrame:
        """One item per kind of part; what waste and shortage cost follows from the average price."""
        cents = F.rint(F.col("p_retailprice") * 100).cast("bigint")
        kinds = self.table("part").groupBy("p_type").agg(F.sum(cents).alias("s"), F.count("*").alias("n"))
        price, kind = F.expr("s div n"), F.col("p_type")
        k = F.ascii(kind) + F.length(kind)
        spelled = F.when(k % 3 == 1, F.upper(kind)).when(k % 3 == 2, F.concat(F.lit("House "), F.upper(kind)))
        return self._per_tenant(
            kinds.select(
                F.lower(kind).alias("item_id"),
                spelled.otherwise(F.concat(F.lit(" "), F.lower(kind))).alias("name"),
                F.when(k % 3 == 0, "made_to_order").otherwise("batch").alias("prep_type"),
                (3.0 + price % 1100 / 100.0).alias("co"),
                (4.0 + price % 1700 / 100.0).alias("cu"),
                F.when(k % 4 == 0, 2).otherwise(1).alias("lead_time_days"),
                F.when(k % 7 == 0, "braise starts the prior afternoon").alias("notes"),
            )
        )

    @cached_property
    def bom(self) -> DataFrame:
        """Recipe lines. Besides the dishes of ``part`` there are dishes nobody sells or prices yet
        ("new old ..."), and in r1 lines of an ingredient nobody invoices (Brand#99)."""
        lines = self.table("part").groupBy("p_name", "p_brand").agg(F.min("p_size").alias("size"))
        fresh = lines.where(F.col("p_name").startswith("old")).withColumn("p_name", F.concat(F.lit("new "), "p_name"))
        unseen = lines.where(F.length("p_name") % 4 == 1).groupBy("p_name").agg(F.min("size").alias("size"))
        unseen = unseen.select("p_name", F.lit("Brand#99").alias("p_brand"), "size", F.lit("r1").alias("restaurant_id"))
        lines = self._per_tenant(lines.unionByName(fresh)).unionByName(unseen)
        size = F.col("size")
        unit = (
            F.when(size == 50, "each")
            .when(size % 4 == 0, "oz")
            .when(size % 4 == 1, "lb")
            .when(size % 4 == 2, "cup")
            .otherwise("g")
        )
        canonical = (
            F.when(size == 50, "g")
            .when(size % 4 == 2, "fl oz")
            .when(size % 4 == 3, "kg")
            .otherwise("oz")
        )
        return lines.select(
            "restaurant_id",
            normalize_name(F.col("p_name")).alias("dish_id"),
            F.col("p_name").alias("dish_name"),
            normalize_name(F.col("p_brand")).alias("ingredient_id"),
            F.col("p_brand").alias("ingredient_name"),
            size.cast("double").alias("qty"),
            unit.alias("recipe_unit"),
            canonical.alias("canonical_unit"),
            ((50 + size) / 100.0).cast("double").alias("yield_factor"),
        )

    @cached_property
    def price_observations(self) -> DataFrame:
        return self.lines.select(
            "restaurant_id",
            "seq",
            F.col("brand_key").alias("ingredient_id"),
            F.col("p_brand").alias("ingredient_name"),
            (F.col("l_extendedprice") / (F.col("l_quantity") * PRICE_DIVISOR)).alias("unit_price"),
            F.when(F.col("l_orderkey") % 10 != 0, F.concat(F.lit("INV"), F.col("l_orderkey").cast("string"))).alias(
                "source_invoice"
            ),
            F.col("business_date").alias("observed_date"),
        )

    @cached_property
    def sales_export(self) -> DataFrame:
        """One row per line, and one more of a dish that is on no menu for every 101st order."""
        odd = F.col("l_orderkey") % 2 == 1
        week_start = F.date_sub("business_date", F.weekday("business_date"))
        spelled = F.when(odd, F.concat(F.lit(" "), F.upper("p_name"), F.lit("\t"))).otherwise(F.col("p_name"))
        listed = F.struct(F.col("seq"), spelled.alias("dish_name"))
        special = F.struct((-F.col("seq")).alias("seq"), F.concat(F.lit("Special "), "p_name").alias("dish_name"))
        rows = F.when(F.col("l_orderkey") % 101 == 0, F.array(listed, special)).otherwise(F.array(listed))
        return self.lines.select(
            "restaurant_id",
            F.inline(rows),
            F.col("l_quantity").cast("bigint").alias("count"),
            week_start.cast("date").alias("period_start"),
            F.date_add(week_start, 6).alias("period_end"),
        )

    @cached_property
    def menu_prices(self) -> DataFrame:
        """Every saved price, newest last."""
        cents = F.rint(F.col("p_retailprice") * 100).cast("bigint")
        priced = self.table("part").groupBy("p_name").agg(F.sum(cents).alias("s"), F.count("*").alias("n"))
        price = F.expr("s div n") / 100.0
        current = F.struct(
            F.col("p_name").alias("dish_name"),
            price.cast("double").alias("menu_price"),
            F.lit("2024-06-01 09:00:00").cast("timestamp_ntz").alias("updated_at"),
        )
        older = F.struct(
            F.upper("p_name").alias("dish_name"),
            (price - 50).cast("double").alias("menu_price"),
            F.lit("2023-06-01 09:00:00").cast("timestamp_ntz").alias("updated_at"),
        )
        rows = F.when(F.length("p_name") % 3 == 0, F.array(older, current)).otherwise(F.array(current))
        return self._per_tenant(priced.select(F.inline(rows)))
