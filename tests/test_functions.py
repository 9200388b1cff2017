import math

import pytest
from pyspark.sql import functions as F

from larder.functions.calendar import flag
from larder.functions.money import chef_round, critical_ratio, dollar_loss, food_cost_pct_display, food_cost_tier, round_quarter
from larder.functions.tails import tail_mean
from larder.functions.text import headline, normalize_name, title_case, valid_tenant
from larder.functions.units import convert_units


def values(spark, rows, schema, column):
    return [r[0] for r in spark.createDataFrame(rows, schema).coalesce(1).select(column).collect()]


def test_normalize_name_strips_and_folds(spark):
    names = ["  Braised\tShort Rib  ", "STRASSE", "Straße", "ﬁlet", None]
    got = values(spark, [(n,) for n in names], "x string", normalize_name(F.col("x")))
    assert got == ["braised\tshort rib", "strasse", "strasse", "filet", None]


def test_flag_accepts_exported_spellings(spark):
    got = values(spark, [(x,) for x in ["True", "1", "true", "False", "0", None, "yes"]], "x string", flag(F.col("x")))
    assert got == [True, True, True, False, False, False, False]


def test_tenant_slug(spark):
    got = values(spark, [(x,) for x in ["r-1_A", "../x", "", "a" * 65, "r1\n", None]], "x string", valid_tenant(F.col("x")))
    assert got == [True, False, False, False, False, False]


def test_halves_round_to_even(spark):
    rows = [(0.125,), (0.375,), (2.5,), (7.5,), (12.5,), (-3.0,)]
    assert values(spark, rows[:2], "x double", round_quarter(F.col("x"))) == [0.0, 0.5]
    assert values(spark, rows[2:], "x double", chef_round(F.col("x"))) == [0.0, 10.0, 10.0, 0.0]


def test_tier_follows_displayed_percent(spark):
    shares = [(0.2499,), (0.25,), (0.35,), (-0.1,), (1.2,)]
    assert values(spark, shares, "x double", food_cost_tier(F.col("x"))) == ["strong", "ok", "thin", "thin", "thin"]
    rows = [(24.8, 100.0), (24.4, 100.0)]
    assert values(spark, rows, "c double, p double", food_cost_pct_display(F.col("c"), F.col("p"))) == [0.25, 0.24]


def test_units(spark):
    rows = [(1.0, " LB", "oz"), (1.0, "kg", "g"), (2.0, "cup", "tbsp"), (3.0, "Each", "each"), (1.0, "each", "g"), (1.0, "oz", "fl oz")]
    got = values(spark, rows, "q double, f string, t string", convert_units(F.col("q"), F.col("f"), F.col("t")))
    assert got[0] == 16.0 and got[1] == pytest.approx(1000.0) and got[2] == 32.0 and got[3:] == [3.0, None, None]


def test_dollar_loss_and_ratio(spark):
    rows = [(10.0, 7.0, 4.0, 6.0), (7.0, 10.0, 4.0, 6.0), (5.0, 5.0, None, None)]
    schema = "p double, d double, co double, cu double"
    cost = dollar_loss(F.col("p"), F.col("d"), F.col("co"), F.col("cu"))
    assert values(spark, rows, schema, cost) == [12.0, 18.0, None]
    assert values(spark, rows[:1], schema, critical_ratio(F.col("co"), F.col("cu"))) == [0.6]
    with pytest.raises(Exception, match="must be positive"):
        values(spark, [(1.0, 1.0, 0.0, 2.0)], schema, cost)


def test_headline(spark):
    rows = [("extra-virgin oil", 0.16, "up", 7, 1, 1), ("beef", -0.125, "down", 45, 1, 0), ("x", 0.0, "flat", 10, 3, 0)]
    schema = "n string, p double, d string, s int, c bigint, u bigint"
    got = values(spark, rows, schema, headline(*[F.col(c) for c in "npdscu"]))
    assert got == [
        "Extra-Virgin Oil +16% this week — 2 dishes affected (1 not yet fully priced)",
        "Beef -12% over the last 45 days — 1 dish affected",
        "X 0% this week — 3 dishes affected",
    ]
    assert values(spark, [("it's 2nd",)], "x string", title_case(F.col("x"))) == ["It'S 2Nd"]


def brute_tail(mean, var, cap):
    if mean <= 0:
        return cap
    if var > mean:
        size = mean * mean / (var - mean)
        log = lambda k: math.lgamma(k + size) - math.lgamma(k + 1) - math.lgamma(size) + size * math.log(size / (size + mean)) + k * math.log(mean / (size + mean))
    else:
        log = lambda k: k * math.log(mean) - mean - math.lgamma(k + 1)
    top = int(mean + 60 * math.sqrt(max(mean, var))) + int(cap) + 400
    tail = [(k, math.exp(log(k))) for k in range(int(cap) + 1, top)]
    mass = sum(p for _, p in tail)
    return cap + 1 if mass < 1e-9 else sum(k * p for k, p in tail) / mass


def test_tail_mean_against_brute_force(spark):
    cases = [(11.5, 6.0, 7.0), (10.0, 10.57, 8.0), (1.125, 0.41, 50.0), (0.0, 0.0, 3.0), (20.0, 150.0, 5.0), (20.0, 150.0, 0.0), (4.0, 9.0, 12.0), (900.0, 850.0, 880.0), (900.0, 4000.0, 1000.0)]
    got = values(spark, cases, "m double, v double, c double", tail_mean(F.col("m"), F.col("v"), F.col("c")))
    assert got == pytest.approx([brute_tail(*c) for c in cases], rel=1e-6)


def test_tail_mean_at_any_size(spark):
    cases = [(2000.0, 1e8, 60000.0, 95546.960758), (100.0, 1e4, 300.0, 400.213935), (3.0, 1e5, 2.0, 3740.419748), (1000.0, 1000.0, 1150.0, 1157.106436), (1.1, 0.5, 50.0, 51.0), (0.0, 0.0, 4.0, 4.0)]
    rows = spark.createDataFrame(cases, "m double, v double, c double, want double").withColumn("got", tail_mean(F.col("m"), F.col("v"), F.col("c")))
    assert all(abs(r.got - r.want) < 1e-5 for r in rows.collect())
