"""Names for helper columns beside whatever columns a table brings, and values computed once."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once a row, even where ``body`` names it for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def unused(table: DataFrame, name: str) -> str:
    """``name``, with underscores added until the table has no such column."""
    taken = {c.lower() for c in table.columns}
    while name.lower() in taken:
        name += "_"
    return name
