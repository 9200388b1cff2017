"""Joins whose big side may hold a third of its rows under one key."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

SALTS = 16


def shuffle_width(df: DataFrame) -> int:
    """Configured number of shuffle partitions. Naming it keeps a shuffle of few but expensive rows
    from being merged into one task."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def salted_join(
    big: DataFrame,
    small: DataFrame,
    keys: Sequence[str],
    salt_by: Sequence[str],
    how: str = "inner",
    salts: int = SALTS,
) -> DataFrame:
    """Equi-join that spreads each key of ``big`` over ``salts`` tasks.

    ``salt_by`` names columns of ``big`` that tell the rows of one key apart; only they are read
    for the salt, and the same row always gets the same one, also when a lost task runs again.
    ``small`` must hold few rows per key; it is repeated once per salt. Works for inner, left,
    left_semi and left_anti joins. No broadcast is forced: Spark broadcasts ``small`` only when its
    own size check says it fits, and otherwise shuffles on the salted key.
    """
    salt = F.pmod(F.xxhash64(*salt_by), F.lit(salts)).cast("int")
    left = big.withColumn("_salt", salt)
    right = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [*keys, "_salt"], how).drop("_salt")


def dimension_join(big: DataFrame, dimension: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join of raw lines with a stored dimension table.

    Left to Spark: a small dimension is broadcast by its size check, and where both sides are shuffled,
    adaptive execution splits the partitions of a hot key, as neither side is aggregated below the join.
    """
    return big.join(dimension, list(keys))
