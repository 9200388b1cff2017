"""Recipe-unit conversion as a column expression: the unit table is a constant, so no join is needed."""
from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, functions as F

from .text import strip

# Ounces per weight unit, fluid ounces per volume unit.
WEIGHT_OZ = {
    "oz": 1.0,
    "lb": 16.0,
    "kg": 35.274,
    "g": 0.035274,
}
VOLUME_FLOZ = {
    "fl oz": 1.0,
    "cup": 8.0,
    "pint": 16.0,
    "qt": 32.0,
    "gal": 128.0,
    "tbsp": 0.5,
    "tsp": 1.0 / 6.0,
    "l": 33.814,
    "ml": 0.033814,
}


def _factor(unit: Column, table: dict[str, float]) -> Column:
    literals = F.create_map(*[F.lit(x) for x in chain.from_iterable(table.items())])
    return F.try_element_at(literals, unit)


def convert_units(qty: Column, from_unit: Column, to_unit: Column) -> Column:
    """``qty`` in ``to_unit``; null when the two units share no measurement family."""
    source, target = strip(F.lower(from_unit)), strip(F.lower(to_unit))
    result = F.when(source == target, qty)
    for table in (WEIGHT_OZ, VOLUME_FLOZ):
        have, want = _factor(source, table), _factor(target, table)
        result = result.when(have.isNotNull() & want.isNotNull(), qty * have / want)
    return result
