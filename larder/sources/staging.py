"""Intermediate tables in the shared folder, so lost executors never cost a job its lineage."""
from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from ..operators.joins import shuffle_width


_private: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder the cluster names in ``spark.checkpoint.dir``.

    Where it is unset, a local master (tests) gets a private folder; a cluster has to name one.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        app = spark.sparkContext.applicationId
        folder = _private.get(app) or _private.setdefault(app, tempfile.mkdtemp(prefix="larder-"))
    return folder.rstrip("/")


def stage_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/larder/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet and read it back.

    Used where a job reads the same derived table several times: the raw scan then runs once, and
    the file sizes give Spark exact statistics for choosing joins.
    """
    return stage_at(df, name)[0]


def stage_at(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """The same, and where it is stored, to be discarded later."""
    path = stage_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def stage_by_key(df: DataFrame, name: str, keys: Sequence[str], aligned: bool = False) -> DataFrame:
    """The same, hashed into one file per shuffle partition by ``keys``.

    Aggregates and windows over the keys, or over more columns besides them, then read the table without
    an exchange. ``aligned`` says that ``df`` is already partitioned by exactly these keys and this
    width, so it is written as it stands. The catalog entry that carries the layout is dropped at once: the
    returned DataFrame keeps what it resolved, and nothing is left in a shared catalog.
    """
    spark = df.sparkSession
    width = shuffle_width(df)
    path = stage_path(spark, name)
    table = f"larder_staged_{uuid.uuid4().hex}"
    rows = df if aligned else df.repartition(width, *keys)
    rows.write.bucketBy(width, *keys).option("path", path).saveAsTable(table, format="parquet")
    staged = spark.table(table)
    spark.sql(f"DROP TABLE {table}")
    return staged


def discard(spark: SparkSession, path: str) -> None:
    """Delete a staged table that nothing will read any more."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
