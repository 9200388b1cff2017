"""As-of joins against a plain search, and their plans."""
import datetime as dt
import random
import re

import pytest

from larder.operators.asof import asof_join
from larder.operators.features import era_asof
from larder.operators.pricing import price_on

DAY = dt.date(2024, 1, 1)


def search(row, changes, before_first):
    key, at = row
    own = sorted(c for c in changes if key is not None and c[0] == key and c[1] is not None)
    past = [c for c in own if at is not None and c[1] <= at]
    if past:
        return past[-1][1:]
    return own[0][1:] if own and at is not None and before_first else (None, None, None)


@pytest.mark.parametrize("unit", ["day", "month", "year"])
@pytest.mark.parametrize("before_first", [False, True])
def test_equals_a_search_per_row(spark, unit, before_first):
    rng = random.Random(7)
    keys = ["hot"] * 6 + ["a", "b", "none", None]
    moment = lambda: None if rng.random() < 0.03 else DAY + dt.timedelta(rng.randrange(500))
    rows = [(rng.choice(keys), moment()) for _ in range(600)]
    changes = [(rng.choice(["hot", "hot", "a", "b", "unasked", None]), moment(), i, rng.randrange(99)) for i in range(60)]
    # The greatest per key and moment is the one with the last seq.
    got = asof_join(
        spark.createDataFrame(rows, "k string, at date"),
        spark.createDataFrame(changes, "k string, since date, seq int, price int"),
        ["k"], "at", "since", unit, ["seq"], before_first,
    )
    assert got.columns == ["k", "at", "since", "seq", "price"]
    want = [(*row, *search(row, changes, before_first)) for row in rows]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))


def test_timestamps_ties_and_borders(spark):
    at = lambda text: dt.datetime.fromisoformat(f"2024-01-{text}")
    rows = [("k", at("01 23:59:59.999999")), ("k", at("02 00:00:00")), ("k", at("02 00:00:00")), ("k", at("09 12:00:00"))]
    changes = [("k", at("01 10:00:00"), 1, "old"), ("k", at("02 00:00:00"), 3, "last"), ("k", at("02 00:00:00"), 2, "zzz")]
    got = asof_join(
        spark.createDataFrame(rows, "k string, at timestamp_ntz"),
        spark.createDataFrame(changes, "k string, since timestamp_ntz, seq int, v string"),
        ["k"], "at", "since", "hour", ["seq"],
    )
    assert sorted((r.at, r.v) for r in got.collect()) == [(rows[0][1], "old"), (rows[1][1], "last"), (rows[1][1], "last"), (rows[3][1], "last")]


def test_empty_sides_and_clashing_names(spark):
    rows = spark.createDataFrame([("k", DAY)], "k string, at date")
    changes = spark.createDataFrame([], "k string, since date, v int")
    (row,) = asof_join(rows, changes, ["k"], "at", "since", before_first=True).collect()
    assert (row.since, row.v) == (None, None)
    assert asof_join(rows.limit(0), changes, ["k"], "at", "since").count() == 0
    with pytest.raises(ValueError, match="at"):
        asof_join(rows, changes.withColumnRenamed("v", "at"), ["k"], "at", "since")


def test_eras_per_tenant(spark):
    days = spark.createDataFrame([(r, DAY + dt.timedelta(d)) for r in ("r0", "r1", "r2") for d in (0, 10, 60)], "restaurant_id string, business_date date")
    eras = [("r0", DAY + dt.timedelta(5), 1), ("r0", DAY + dt.timedelta(50), 2), ("r1", DAY, 7)]
    got = era_asof(days, spark.createDataFrame(eras, "restaurant_id string, start_date date, era_id int"))
    assert sorted((r.restaurant_id, r.era_id, r.era_days_elapsed) for r in got.collect() if r.restaurant_id != "r2") == [
        ("r0", 1, 0), ("r0", 1, 5), ("r0", 2, 10), ("r1", 7, 0), ("r1", 7, 10), ("r1", 7, 60),
    ]
    assert [(r.era_id, r.era_days_elapsed) for r in got.where("restaurant_id = 'r2'").collect()] == [(None, None)] * 3


def test_price_on_a_day_and_its_plan(spark):
    prices = spark.createDataFrame(
        [("r0", 1, "egg", "Egg", 1.0, None, DAY), ("r0", 2, "egg", "Egg", 2.0, None, DAY), ("r0", 3, "egg", "Egg", 9.0, None, DAY + dt.timedelta(40))],
        "restaurant_id string, seq long, ingredient_id string, ingredient_name string, unit_price double, source_invoice string, observed_date date",
    )
    rows = spark.createDataFrame([("r0", "egg", DAY + dt.timedelta(d)) for d in (-1, 0, 39, 40, 400)], "restaurant_id string, ingredient_id string, day date")
    got = price_on(rows, prices, "day")
    assert [r.unit_price for r in got.orderBy("day").collect()] == [None, 2.0, 2.0, 9.0, 9.0]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"CartesianProduct|BroadcastNestedLoopJoin|Python|MapIn", plan)
