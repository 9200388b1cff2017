"""As-of joins between tables of any size."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F


def asof_join(
    rows: DataFrame,
    changes: DataFrame,
    keys: Sequence[str],
    at: str,
    since: str,
    unit: str = "month",
    order: Sequence[str] = (),
    before_first: bool = False,
) -> DataFrame:
    """Every row of ``rows`` with the columns of the last change of its key at or before its moment.

    ``at`` and ``since`` name date or timestamp columns. Of several changes of a key at one moment the
    last by ``order`` counts, then the greatest by the remaining columns. A row earlier than all changes
    of its key gets nulls, or the key's first change with ``before_first``; so do rows without a moment or
    key, always nulls. All rows stay, repeated ones too. Changes without a moment never hold.

    Only the distinct moments of ``rows`` meet the changes, so a busy day costs one event. They are
    sorted with the changes inside time slices of one ``unit`` ("month", "day", "hour"), whose moments
    of one key have to fit a task; the value at a slice's end is carried over its borders by a window
    over one row per key and slice. The join back has as many values per key as the key has moments,
    and neither of its sides is aggregated below it on those keys alone, so adaptive execution can
    split a busy one. ``rows`` is read twice, the first time only for its keys and moments.
    """
    keys = list(keys)
    found = [c for c in changes.columns if c not in keys]
    if clash := sorted(set(found) & set(rows.columns)):
        raise ValueError(f"asof_join: columns on both sides: {clash}")
    rest = [c for c in found if c not in order]
    value = F.struct(*[F.col(c) for c in [*order, *rest]])
    kind = changes.select(value.alias("_value")).schema["_value"].dataType

    asked = rows.select(*keys, F.col(at).alias("_at"), F.lit(None).cast(kind).alias("_value")).where(F.col("_at").isNotNull())
    starts = changes.where(F.col(since).isNotNull()).groupBy(*keys, F.col(since).alias("_at")).agg(F.max(value).alias("_value"))
    events = asked.distinct().unionByName(starts).withColumn("_slice", F.date_trunc(unit, F.col("_at")))

    held = F.when(F.col("_value").isNotNull(), F.col("_at"))
    ends = events.groupBy(*keys, "_slice").agg(
        F.max_by("_value", held).alias("_last"), F.min_by("_value", held).alias("_start")
    )
    slices = Window.partitionBy(*keys).orderBy("_slice")
    earlier = F.last("_last", ignorenulls=True).over(slices.rowsBetween(Window.unboundedPreceding, -1))
    first = F.first("_start", ignorenulls=True).over(slices.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    carried = ends.select(*keys, "_slice", earlier.alias("_earlier"), first.alias("_first"))

    # A range frame ends with all events of the moment, so a change holds from its own moment on.
    sofar = Window.partitionBy(*keys, "_slice").orderBy("_at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    inside = events.withColumns(
        {"_in": F.last("_value", ignorenulls=True).over(sofar), "_asked": F.col("_value").isNull()}
    )
    choices = ["_in", "_earlier", "_first"] if before_first else ["_in", "_earlier"]
    answers = inside.where("_asked").join(carried, [*keys, "_slice"], "left").select(
        *keys, F.col("_at").alias(at), F.coalesce(*choices).alias("_found")
    )
    return rows.join(answers, [*keys, at], "left").select(*[rows[c] for c in rows.columns], *[F.col(f"_found.{c}") for c in found])
