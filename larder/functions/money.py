"""Money and rounding rules. All halves round to even, as the price grid requires."""
from __future__ import annotations

from pyspark.sql import Column, functions as F

# Food-cost share below which a dish counts as strong, then as ok.
STRONG_BELOW = 0.25
OK_BELOW = 0.35


def round_quarter(value: Column) -> Column:
    return F.rint(value * 4) / 4


def chef_round(value: Column) -> Column:
    """Nearest five portions, never below zero."""
    return F.greatest(F.rint(value / 5.0) * 5.0, F.lit(0.0))


def food_cost_tier(share: Column) -> Column:
    """strong / ok / thin; a share outside 0..1 is thin."""
    return (
        F.when((share >= 0.0) & (share < STRONG_BELOW), "strong")
        .when((share >= STRONG_BELOW) & (share < OK_BELOW), "ok")
        .otherwise("thin")
    )


def food_cost_pct_display(cost: Column, menu_price: Column) -> Column:
    """Share rounded to a whole percent before it picks a tier, so label and number agree."""
    return F.rint(cost / menu_price * 100) / 100


def _positive_costs(co: Column, cu: Column, value: Column) -> Column:
    message = F.concat(
        F.lit("overage and underage cost must be positive, got "),
        F.coalesce(co.cast("string"), F.lit("null")),
        F.lit(" and "),
        F.coalesce(cu.cast("string"), F.lit("null")),
    )
    return F.when((co <= 0) | (cu <= 0), F.raise_error(message).cast("double")).otherwise(value)


def dollar_loss(prep: Column, demand: Column, co: Column, cu: Column) -> Column:
    """Cost of wasted portions plus cost of missed sales; null when the item has no costs."""
    over = F.greatest(F.lit(0.0), prep - demand)
    under = F.greatest(F.lit(0.0), demand - prep)
    loss = F.when(prep.isNull() | demand.isNull(), F.lit(None).cast("double")).otherwise(co * over + cu * under)
    return _positive_costs(co, cu, loss)


def critical_ratio(co: Column, cu: Column) -> Column:
    """Service level that balances waste against missed sales."""
    return _positive_costs(co, cu, cu / (co + cu))
