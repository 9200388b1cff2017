"""Name keys and chef-facing text."""
from __future__ import annotations

from pyspark.sql import Column, functions as F

# Characters Python's str.strip removes that Spark's trim leaves in place.
_EDGE_SPACE = r"^[\s\p{Z}\x0B\x1C-\x1F\x85]+|[\s\p{Z}\x0B\x1C-\x1F\x85]+$"

# Letters whose case fold differs from their lower case form.
_FOLDS = {
    "ß": "ss",
    "ſ": "s",
    "ς": "σ",
    "µ": "μ",
    "ﬀ": "ff",
    "ﬁ": "fi",
    "ﬂ": "fl",
    "ﬃ": "ffi",
    "ﬄ": "ffl",
    "ﬅ": "st",
    "ﬆ": "st",
}

# Fixed value: a tenant id is a bare path-safe slug.
TENANT_SLUG = r"^[A-Za-z0-9_-]{1,64}\z"


def strip(text: Column) -> Column:
    """Remove all leading and trailing white space, tabs and no-break spaces included."""
    return F.regexp_replace(text, _EDGE_SPACE, "")


def normalize_name(text: Column) -> Column:
    """Join key for display names: stripped and case-folded."""
    key = F.lower(strip(text))
    for letter, folded in _FOLDS.items():
        key = F.replace(key, F.lit(letter), F.lit(folded))
    return key


def valid_tenant(restaurant_id: Column) -> Column:
    return F.coalesce(restaurant_id.rlike(TENANT_SLUG), F.lit(False))


def blank_to_null(text: Column) -> Column:
    return F.nullif(strip(text), F.lit(""))


def title_case(text: Column) -> Column:
    """Capitalise every run of letters, also after hyphens and digits."""
    runs = F.regexp_extract_all(text, F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1))
    return F.array_join(F.transform(runs, F.initcap), "")


def headline(
    ingredient_name: Column,
    pct_change: Column,
    direction: Column,
    days_span: Column,
    costed: Column,
    uncosted: Column,
) -> Column:
    """One plain sentence per price move. Only a span of ten days or less is "this week"."""
    sign = F.when(direction == "up", "+").when(direction == "down", "-").otherwise("")
    percent = F.rint(F.abs(pct_change) * 100).cast("bigint").cast("string")
    span = F.when(days_span <= 10, F.lit("this week")).otherwise(
        F.concat(F.lit("over the last "), days_span.cast("string"), F.lit(" days"))
    )
    total = costed + uncosted
    dishes = F.concat(
        total.cast("string"), F.when(total == 1, F.lit(" dish")).otherwise(F.lit(" dishes")), F.lit(" affected")
    )
    pending = F.when(
        uncosted > 0, F.concat(F.lit(" ("), uncosted.cast("string"), F.lit(" not yet fully priced)"))
    ).otherwise("")
    return F.concat(
        title_case(ingredient_name), F.lit(" "), sign, percent, F.lit("% "), span, F.lit(" — "), dishes, pending
    )
