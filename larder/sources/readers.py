"""Typed readers for the point-of-sale export, the captured legs and the scoring-only truth tables."""
from __future__ import annotations

import re
from functools import reduce
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.text import blank_to_null, strip
from . import schemas


_OPTIONS = {"header": True, "escape": '"'}


def _named(spark: SparkSession, paths: str | list[str], sample: str, schema: StructType) -> DataFrame:
    """The schema's columns of files that all have the header of ``sample``; a malformed line fails the read."""
    header = spark.read.options(**_OPTIONS).csv(sample).columns or schema.names
    missing = sorted(set(schema.names) - set(header))
    if missing:
        raise ValueError(f"{sample}: missing columns {missing}")
    found = StructType([schema[name] if name in schema.names else StructField(name, StringType()) for name in header])
    read = spark.read.schema(found).options(**_OPTIONS, mode="FAILFAST", enforceSchema=False)
    return read.csv(paths).select(*schema.names)


def files_by_header(spark: SparkSession, path: str) -> dict[str, list[str]]:
    """The files under ``path`` by their first line that is not blank; files without one are left out.

    One pass over the lines, not parsed; a file's first line is found within its first block and only one
    line per file is shuffled. The driver holds the file names, as Spark's own listing does.
    """
    lines = spark.read.text(path).select("value", "_metadata.file_path", "_metadata.file_block_start")
    lines = lines.where((F.col("file_block_start") == 0) & F.col("value").rlike(r"\S"))
    lines = lines.withColumn("place", F.monotonically_increasing_id())
    first = lines.groupBy("file_path").agg(F.min_by("value", "place").alias("header"))
    groups = first.groupBy("header").agg(F.array_sort(F.collect_list("file_path")).alias("files"))
    return {row.header: [unquote(file) for file in row.files] for row in groups.orderBy("header").collect()}


def _csv(spark: SparkSession, path: str, schema: StructType, mixed: bool = False) -> DataFrame:
    """The schema's columns, found by their header names; other columns are left out.

    Every file under ``path`` has to have the header of the first, or the read fails. With ``mixed``
    each file's own header counts, for one more pass over the lines; files of one header are read
    together, and the groups are united by name.
    """
    if not mixed:
        return _named(spark, path, path, schema)
    parts = [_named(spark, files, files[0], schema) for files in files_by_header(spark, path).values()]
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], schema)


def read_pos_sales(spark: SparkSession, path: str, mixed: bool = False) -> DataFrame:
    """Point-of-sale lines from CSV, dates and timestamps typed; a malformed line fails the read.

    ``mixed`` allows files of different column orders, as exports of several tills have.
    """
    return _csv(spark, path, schemas.POS_SALES, mixed)


def read_86_log(spark: SparkSession, path: str, mixed: bool = False) -> DataFrame:
    """Stock-out log; a missing file is an empty log, since not every kitchen keeps one."""
    try:
        return _csv(spark, path, schemas.EIGHTYSIX_LOG, mixed)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schemas.EIGHTYSIX_LOG)


def check_tenant(restaurant_id: str) -> str:
    """Refuse an id that is no bare slug before it reaches a path or a filter."""
    # Fixed value: same slug rule as functions.text.TENANT_SLUG, in Python syntax.
    if not re.fullmatch(r"[A-Za-z0-9_-]{1,64}", restaurant_id):
        raise ValueError(f"invalid restaurant_id {restaurant_id!r}")
    return restaurant_id


def read_leg(spark: SparkSession, root: str, leg: str, restaurant_id: str | None = None) -> DataFrame:
    """One captured leg; a tenant filter prunes to that tenant's directory."""
    df = spark.read.schema(schemas.LEGS[leg]).parquet(f"{root}/{leg}")
    if restaurant_id is None:
        return df
    return df.where(F.col("restaurant_id") == check_tenant(restaurant_id))


def load_catalog(spark: SparkSession, root: str, mixed: bool = False) -> dict[str, DataFrame]:
    """Ingredients, dishes, recipe lines and prices from CSV, with the casts the catalog needs."""
    tables = {name: _csv(spark, f"{root}/{name}", schema, mixed) for name, schema in schemas.CATALOG.items()}
    active = F.coalesce(F.lower(strip(F.col("is_active"))) != "false", F.lit(True))
    tables["ingredients"] = tables["ingredients"].withColumn("notes", blank_to_null(F.col("notes")))
    tables["dishes"] = tables["dishes"].withColumns(
        {"service_period": blank_to_null(F.col("service_period")), "is_active": active}
    )
    tables["prices"] = tables["prices"].withColumn("source_invoice", blank_to_null(F.col("source_invoice")))
    return tables


_TRUTH = {"truth_demand": schemas.TRUTH_DEMAND, "truth_stockouts": schemas.TRUTH_STOCKOUTS}


def read_truth(spark: SparkSession, path: str, table: str, mixed: bool = False) -> DataFrame:
    """Hidden truth, for scoring jobs only; any folder not named ``_truth`` is refused."""
    if path.rstrip("/").rsplit("/", 1)[-1] != "_truth":
        raise ValueError(f"truth tables are read from a _truth folder only, refused {path!r}")
    return _csv(spark, f"{path.rstrip('/')}/{table}", _TRUTH[table], mixed)
