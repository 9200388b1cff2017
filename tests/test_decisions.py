import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from larder.operators import quantiles as ops, scoring
from larder.operators.conformal import kth_smallest

DAY = dt.date(2024, 1, 1)
LEVELS = [round(i / 100, 6) for i in range(1, 100)]


def curve(spark, points, item="rib"):
    rows = [("r0", DAY, item, "dinner", 0, float(q), float(x)) for q, x in points]
    return spark.createDataFrame(rows, "restaurant_id string, business_date date, item_id string, service_period string, fold int, quantile double, forecast double")


def economics(spark, co=4.0, cu=6.0, item="rib", kind="batch"):
    return spark.createDataFrame([("r0", item, kind, co, cu)], "restaurant_id string, item_id string, prep_type string, co double, cu double")


def test_uniform_demand_matches_the_closed_forms(spark):
    row = ops.newsvendor_policy(curve(spark, [(q, 100 * q) for q in LEVELS]), economics(spark)).first()
    assert row.prep_quantity == pytest.approx(60.0)
    assert row.expected_waste == pytest.approx(18.0)
    assert row.expected_stockout == pytest.approx((99 - 60) - (99**2 - 60**2) / 200)


def test_prep_is_clamped_to_the_grid(spark):
    points = curve(spark, [(0.5, 10.0), (0.6, 12.0)])
    assert ops.newsvendor_policy(points, economics(spark, 1.0, 9.0)).first().prep_quantity == 12.0
    low = ops.newsvendor_policy(points, economics(spark, 9.0, 1.0)).first()
    assert low.prep_quantity == pytest.approx(2.0)  # on the line from the origin to (0.5, 10)
    flat = curve(spark, [(0.5, 0.0), (0.6, 12.0)])
    assert ops.newsvendor_policy(flat, economics(spark, 9.0, 1.0)).first().prep_quantity == 0.0
    assert ops.newsvendor_policy(points, economics(spark, item="other")).count() == 0


def test_crossing_curves_are_found_fixed_or_refused(spark):
    crossed = curve(spark, [(0.1, 5.0), (0.5, 3.0), (0.9, -2.0)])
    assert ops.crossing_cells(crossed).count() == 1
    with pytest.raises(Exception, match="cross"):
        ops.quantile_curve(crossed).collect()
    fixed = ops.noncrossing(crossed).orderBy("quantile").collect()
    assert [(r.quantile, r.forecast) for r in fixed] == [(0.1, 0.0), (0.5, 3.0), (0.9, 5.0)]


def test_pit_takes_the_highest_level_at_a_repeated_value(spark):
    quantiles = curve(spark, [(0.2, 4.0), (0.5, 4.0), (0.9, 8.0)])
    truth = lambda y: spark.createDataFrame([("r0", DAY, "rib", "dinner", y)], "restaurant_id string, business_date date, item_id string, service_period string, true_demand bigint")
    assert scoring.pit(quantiles, truth(4)).first().pit == 0.5
    assert scoring.pit(quantiles, truth(6)).first().pit == pytest.approx(0.7)
    assert scoring.pit(quantiles, truth(2)).first().pit == pytest.approx(0.1)
    assert scoring.pit(quantiles, truth(99)).first().pit == 0.9


def test_levels(spark):
    both = economics(spark).unionByName(economics(spark, 1.0, 2.0, "cod", "made_to_order"))
    got = sorted(r.quantile for r in ops.required_levels(both).collect())
    assert got == [0.05, 0.1, 0.25, 0.5, 0.6, 0.666667, 0.75, 0.9, 0.95, 0.99]
    assert ops.route_batch(both).count() == 1
    with pytest.raises(Exception, match="outside"):
        ops.checked_levels(spark.createDataFrame([("r0", 1.0)], "restaurant_id string, quantile double")).collect()


def test_kth_smallest_is_exact_under_a_hot_group(spark):
    rng = random.Random(1)
    values = {g: [round(rng.gauss(0, 5), 2) for _ in range(n)] + [0.25] * n for g, n in (("hot", 900), ("cold", 7))}
    rows = spark.createDataFrame([(g, v) for g, vs in values.items() for v in vs], "g string, v double")
    for share in (0.01, 0.5, 0.8, 1.0):
        rank = {g: max(1, math.ceil(len(vs) * share)) for g, vs in values.items()}
        ranks = spark.createDataFrame(list(rank.items()), "g string, k bigint")
        got = {r.g: r.v for r in kth_smallest(rows, ["g"], "v", ranks).collect()}
        assert got == {g: sorted(vs)[rank[g] - 1] for g, vs in values.items()}


def test_missing_forecast_uses_the_items_test_mean(spark):
    rows = [("r0", DAY + dt.timedelta(i), "rib", "dinner", 0, DAY, DAY, DAY, d) for i, d in enumerate([2, 4, 9])]
    actuals = spark.createDataFrame(rows, "restaurant_id string, business_date date, item_id string, service_period string, fold int, train_end date, test_start date, test_end date, demand bigint")
    forecasts = actuals.limit(1).select(*ops.CELL, F.lit("m").alias("model"), F.lit(2.0).alias("forecast"))
    scored = scoring.score_join(actuals, forecasts, economics(spark), ["m"])
    assert sorted(r.forecast for r in scored.collect()) == [2.0, 5.0, 5.0]
    score = scoring.fold_scores(scored).first()
    assert score.dollar_cost == pytest.approx(4 * 1 + 6 * 4) and score.wape == pytest.approx(5 / 15) and score.n_days == 3
    assert scoring.fold_scores(scoring.score_join(actuals, forecasts, economics(spark, item="x"), ["m"])).count() == 0


def test_oracle_ruler_needs_truth_on_censored_cells(spark):
    demand = spark.createDataFrame([("r0", DAY, "rib", "dinner", 5, True), ("r0", DAY, "rib", "lunch", 4, False)], "restaurant_id string, business_date date, item_id string, service_period string, demand bigint, censored boolean")
    truth = spark.createDataFrame([("r0", DAY, "rib", "dinner", 8), ("r0", DAY, "rib", "lunch", 9)], "restaurant_id string, business_date date, item_id string, service_period string, true_demand bigint")
    got = {r.service_period: r.demand for r in scoring.oracle_actual(demand, truth).collect()}
    assert got == {"dinner": 8.0, "lunch": 4.0}
    with pytest.raises(Exception, match="without a truth row"):
        scoring.oracle_actual(demand, truth.where("service_period = 'lunch'")).collect()


def test_weekday_distributions_against_numpy(spark):
    """Percentiles and means per weekday; one with fewer than eight training days borrows the whole series.
    Tenants have levels of their own, and equal values and zeros are kept."""
    start = dt.date(2024, 1, 1)
    sold = {("r0", "a"): [n * 7 % 11 for n in range(90)], ("r0", "b"): [n % 2 for n in range(30)], ("r1", "a"): [3] * 60}
    rows = [(t, i, "dinner", start + dt.timedelta(n), x) for (t, i), values in sold.items() for n, x in enumerate(values)]
    demand = spark.createDataFrame(rows, "restaurant_id string, item_id string, service_period string, business_date date, demand bigint")
    ends = {0: 27, 1: 70}
    folds = spark.createDataFrame(
        [(t, f, start, start + dt.timedelta(end)) for t in ("r0", "r1") for f, end in ends.items()],
        "restaurant_id string, fold int, train_start date, train_end date",
    )
    wanted = {"r0": [0.1, 0.5, 0.731], "r1": [0.25]}
    levels = spark.createDataFrame([(t, q) for t, qs in wanted.items() for q in qs], "restaurant_id string, quantile double")
    samples = ops.weekday_samples(demand, folds)
    means = {(r.restaurant_id, r.item_id, r.fold, r.day_of_week): r.forecast for r in ops.weekday_means(samples).collect()}
    curves = {
        (r.restaurant_id, r.item_id, r.fold, r.day_of_week): [(p.quantile, p.forecast) for p in r.pairs]
        for r in ops.weekday_quantiles(samples, levels).collect()
    }
    assert len(means) == len(curves) == len(sold) * len(ends) * 7
    for (tenant, item), values in sold.items():
        for fold, end in ends.items():
            train = values[: end + 1]
            for weekday in range(7):
                fine = train[weekday::7]
                sample = fine if len(fine) >= 8 else train
                key = tenant, item, fold, weekday
                assert means[key] == pytest.approx(np.mean(sample))
                assert [q for q, _ in curves[key]] == wanted[tenant]
                assert [x for _, x in curves[key]] == pytest.approx([np.quantile(sample, q) for q in wanted[tenant]])
    targets = demand.withColumn("fold", F.lit(1))
    found = ops.empirical_quantiles(samples, targets, levels)
    assert found.count() == 120 * 3 + 60
    assert ops.empirical_quantiles(samples.where("false"), targets, levels).count() == 0
