"""Boosted trees against a plain version of the same algorithm, and their quantiles, intervals and jobs."""
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from larder.operators import boosting, models
from larder.operators.conformal import held_scores, kth_smallest, widened
from larder.plans import calibration
from larder.sources.staging import stage
from test_models import DAY, weekly

SMALL = boosting.Settings(rounds=5, step=0.3, depth=3, least_rows=4)
NUMBERS, CATEGORIES = ["a", "b"], ["c", "d"]


def sample(n=900, seed=4):
    rng = np.random.default_rng(seed)
    df = pd.DataFrame({"part": rng.integers(0, 3, n), "a": rng.normal(size=n).round(2), "b": rng.integers(0, 9, n).astype(float), "c": rng.choice(list("pqrst"), n), "d": rng.choice([f"i{k}" for k in range(40)], n)})
    df.loc[rng.random(n) < 0.1, "a"] = None
    df.loc[rng.random(n) < 0.05, "c"] = None
    rate = np.exp(0.4 * df.a.fillna(0) + 0.1 * df.b + (df.c == "q") * 0.9 + df.d.str[1:].astype(int) % 5 * 0.2)
    df["y"] = rng.poisson(rate).astype(float)
    df["i"] = range(n)
    return df


class Plain:
    """One model, row lists instead of histograms, written from the description of the algorithm."""

    def __init__(self, codes, y, level, s, bounds):
        self.level, self.s, self.bounds = level, s, bounds
        self.start = math.log(y.mean()) if level is None else self.quantile(y)
        raw = np.full(len(y), self.start)
        self.trees = []
        for _ in range(s.rounds):
            if level is None:
                g = [round((math.exp(f) - t) * boosting.GRAIN) for f, t in zip(raw, y)]
                h = [round(math.exp(f) * math.exp(s.max_delta) * boosting.GRAIN) for f in raw]
            else:
                g = [round((1 - level if f > t else -level) * boosting.GRAIN) for f, t in zip(raw, y)]
                h = [boosting.GRAIN] * len(y)
            tree = self.grow(codes, list(range(len(y))), g, h, y - raw, 0)
            self.trees.append(tree)
            raw = self.moved(raw, tree, codes)

    def quantile(self, residuals):
        grid = sorted(np.rint(np.asarray(residuals) * boosting.GRID))
        return grid[max(1, math.ceil(self.level * len(grid) - 1e-9)) - 1] / boosting.GRID

    def moved(self, raw, tree, codes):
        raw = raw + np.array([self.walk(tree, row) for row in codes])
        return raw if self.level is None else raw.clip(*self.bounds)

    def walk(self, tree, row):
        while isinstance(tree, tuple):
            tree = tree[2] if row[tree[0]] in tree[1] else tree[3]
        return tree

    def leaf(self, rows, g, h, residuals):
        if self.level is None:
            return -sum(g[r] for r in rows) / boosting.GRAIN / (sum(h[r] for r in rows) / boosting.GRAIN + self.s.ridge) * self.s.step
        return round(self.quantile(residuals[rows]) * self.s.step * boosting.GRID) / boosting.GRID

    def grow(self, codes, rows, g, h, residuals, depth):
        if depth == self.s.depth:
            return self.leaf(rows, g, h, residuals)
        total = lambda some: (sum(g[r] for r in some) / boosting.GRAIN, sum(h[r] for r in some) / boosting.GRAIN)
        score = lambda gh: gh[0] * gh[0] / (gh[1] + self.s.ridge)
        best = (1e-9, None)
        for i in range(codes.shape[1]):
            order = list(range(256))
            if i >= len(NUMBERS):
                means = {}
                for k in set(codes[rows, i]):
                    own = [r for r in rows if codes[r, i] == k]
                    means[k] = sum(g[r] for r in own) / (sum(h[r] for r in own) + self.s.cat_smooth * boosting.GRAIN)
                order = sorted(means, key=lambda k: (means[k], k))
            for cut in range(len(order)):
                if order[cut] not in codes[rows, i]:
                    continue
                left = set(order[: cut + 1])
                lows = [r for r in rows if codes[r, i] in left]
                highs = [r for r in rows if codes[r, i] not in left]
                if min(len(lows), len(highs)) >= self.s.least_rows:
                    gain = score(total(lows)) + score(total(highs)) - score(total(rows))
                    if gain > best[0]:
                        best = (gain, (i, left, lows, highs))
        if best[1] is None:
            return self.leaf(rows, g, h, residuals)
        i, left, lows, highs = best[1]
        return (i, left, self.grow(codes, lows, g, h, residuals, depth + 1), self.grow(codes, highs, g, h, residuals, depth + 1))

    def scores(self, codes):
        raw = np.full(len(codes), self.start)
        for tree in self.trees:
            raw = self.moved(raw, tree, codes)
        return np.maximum(np.exp(raw) if self.level is None else raw, 0)


@pytest.mark.parametrize("levels", [None, (0.2, 0.75)])
def test_equals_the_plain_algorithm(spark, levels):
    df = sample()
    rows = spark.createDataFrame(df)
    model = boosting.train(rows, "y", NUMBERS, CATEGORIES, levels, SMALL)
    got = {r["i"]: r["forecasts"] for r in model.predict(rows, ["i"]).collect()}
    for part, own in df.groupby("part"):
        table = spark.createDataFrame(own).select(*NUMBERS, *CATEGORIES).toArrow()
        codes = model.coder.codes(part, {c: table.column(c).combine_chunks() for c in model.coder.inputs})
        for j, level in enumerate(levels or (None,)):
            want = Plain(codes, own.y.to_numpy(), level, SMALL, (df.y.min(), df.y.max())).scores(codes)
            assert np.allclose([got[i][j] for i in own.i], want, rtol=1e-9, atol=1e-9)


@pytest.mark.parametrize("levels", [None, (0.1, 0.5, 0.9)])
def test_same_trees_however_rows_and_parts_are_spread(spark, levels, monkeypatch):
    df = sample(3000)
    rows = spark.createDataFrame(df)
    whole = boosting.train(rows, "y", NUMBERS, CATEGORIES, levels, SMALL)
    monkeypatch.setattr(boosting, "BLOCK", 400)
    spread = boosting.train(rows.repartition(7), "y", NUMBERS, CATEGORIES, levels, SMALL)
    alone = boosting.train(rows.where("part = 1"), "y", NUMBERS, CATEGORIES, levels, SMALL)
    one = {r["i"]: r["forecasts"] for r in whole.predict(rows, ["i"]).collect()}
    assert one == {r["i"]: r["forecasts"] for r in spread.predict(rows, ["i"]).collect()}
    lone = {r["i"]: r["forecasts"] for r in alone.predict(rows.where("part = 1"), ["i"]).collect()}
    if levels is None:  # quantile scores are kept between the targets of all parts
        assert lone == {i: f for i, f in one.items() if i in lone}


def test_jobs_do_not_grow_with_parts_or_levels(spark):
    def jobs(rows, levels):
        spark.sparkContext.setJobGroup(name := f"boost-{np.random.random()}", "")
        boosting.train(rows, "y", NUMBERS, CATEGORIES, levels, SMALL)
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))

    rows = spark.createDataFrame(sample())
    assert jobs(rows, None) == jobs(rows.where("part = 0"), None) and jobs(rows, (0.1, 0.5, 0.9)) == jobs(rows.where("part = 0"), (0.5,))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_more_rounds_fit_unseen_counts_better(spark):
    df, unseen = spark.createDataFrame(sample(3000)), spark.createDataFrame(sample(1500, seed=5))

    def deviance(settings):
        model = boosting.train(df, "y", NUMBERS, CATEGORIES, None, settings)
        rows = model.predict(unseen, ["y"]).collect()
        return sum(f - y * math.log(f) for y, (f,) in rows) / len(rows)

    constant, few, more = (deviance(boosting.Settings(rounds=r, step=0.2, depth=4)) for r in (0, 3, 20))
    assert more < few < constant


def test_quantiles_hold_their_share_of_unseen_rows(spark):
    rows, unseen = spark.createDataFrame(sample(4000)), spark.createDataFrame(sample(3000, seed=6))
    model = boosting.train(rows, "y", NUMBERS, CATEGORIES, (0.1, 0.5, 0.9), boosting.Settings(rounds=15, step=0.2, depth=3))
    done = model.predict(unseen, ["y"]).collect()
    below = np.array([[r["y"] <= f for f in r["forecasts"]] for r in done]).mean(axis=0)
    assert (np.abs(below - [0.1, 0.5, 0.9]) < [0.13, 0.1, 0.05]).all()  # counts are coarse at the low end


def test_odd_training_rows(spark):
    rows = spark.createDataFrame([(0, None, None, 3.0), (0, float("nan"), "x", 3.0), (1, 1.0, None, 0.0)], "part int, a double, c string, y double")
    for levels in (None, (0.5,)):
        model = boosting.train(rows, "y", ["a"], ["c"], levels, SMALL)
        done = sorted((r["part"], round(r["forecasts"][0], 6)) for r in model.predict(rows, ["part"]).collect())
        assert done == [(0, 3.0), (0, 3.0), (1, 0.0)]
    with pytest.raises(ValueError, match="no training rows"):
        boosting.train(rows.limit(0), "y", ["a"], ["c"])
    with pytest.raises(Exception, match="no target"):
        boosting.train(rows.withColumn("y", F.lit(None).cast("double")), "y", ["a"], ["c"])


def test_kth_smallest_of_ten_million(spark):
    n = 10_000_000
    scores = stage(spark.range(n).select(F.lit("r").alias("g"), ((F.col("id") * 7919 % n) / 1e9 + 2 - (F.col("id") % 2) * 4).alias("score")), "scores")
    rank = spark.createDataFrame([("r", 1), ("s", 1)], "g string, k bigint")
    at = lambda k: kth_smallest(scores, ["g"], "score", rank.withColumn("k", F.lit(k).cast("bigint"))).collect()[0]["score"]
    values = np.sort(((np.arange(n) * 7919 % n) / 1e9 + 2 - (np.arange(n) % 2) * 4).round(9))
    for k in (1, n // 2, 8_000_001, n):
        assert at(k) == pytest.approx(values[k - 1], abs=1e-12)


def test_intervals_of_trained_ends(spark):
    demand = weekly(spark).withColumn("censored", F.lit(False))
    eras = spark.createDataFrame([(DAY, 0)], "start_date date, era_id int")
    found = calibration.trained_inputs(demand, eras, settings=boosting.Settings(rounds=15, step=0.3, depth=3))
    truth = demand.select(*models.KEY, F.col("demand").alias("true_demand"))
    # The test window lacks the lags that the held-back days have, so coverage may fall short of 0.8 here.
    row = calibration.conformal(found, truth).first()
    assert row.n == 128 and row.empirical_coverage > 0.5 and 0 < row.mean_interval_width < 20
    curves = found.quantiles.groupBy(*models.CELL).agg(F.sort_array(F.collect_list(F.struct("quantile", "forecast"))).alias("c")).collect()
    assert all(a["forecast"] <= b["forecast"] for r in curves for a, b in zip(r["c"], r["c"][1:])) and len(curves[0]["c"]) == 14


def test_trained_curves_have_every_items_own_ratio(spark):
    demand = weekly(spark).withColumn("censored", F.lit(False))
    eras = spark.createDataFrame([(DAY, 0)], "start_date date, era_id int")
    items = sorted((r.restaurant_id, r.item_id) for r in demand.select("restaurant_id", "item_id").distinct().collect())
    costs = [(tenant, item, 1.0, 1.0 + k / 7) for k, (tenant, item) in enumerate(items)]
    economics = spark.createDataFrame([*costs, ("elsewhere", "other", 5.0, 1.0)], "restaurant_id string, item_id string, co double, cu double")
    truth = demand.select(*models.KEY, F.col("demand").alias("true_demand"))
    small = boosting.Settings(rounds=3, step=0.3, depth=2)
    found = calibration.trained_inputs(demand, eras, settings=small, economics=economics)
    rows = calibration.calibration_run(demand, truth, economics, found).collect()
    assert sorted((r.restaurant_id, r.label) for r in rows if r.section == "underage") == items
    own = {(tenant, round(cu / (co + cu), 6)) for tenant, _, co, cu in costs}
    levels = {(r.restaurant_id, r["quantile"]) for r in found.quantiles.select("restaurant_id", "quantile").distinct().collect()}
    assert levels == own | {(tenant, q) for tenant, _ in items for q in calibration.CURVE_LEVELS}
    # Other items' levels leave the intervals as they were.
    plain = calibration.trained_inputs(demand, eras, settings=small)
    assert sorted(found.intervals.collect()) == sorted(plain.intervals.collect())


def test_widening_takes_the_exact_rank(spark):
    rng = np.random.default_rng(8)
    columns = "restaurant_id string, business_date date, item_id string, service_period string, demand double, lo double, hi double"
    rows = [(r, DAY, f"i{k}", "dinner", float(rng.normal(50, 10)), 47.0, 52.0) for r, n in (("r0", 137), ("r1", 3), ("r2", 2000)) for k in range(n)]
    held = spark.createDataFrame(rows, columns)
    got = {}
    for r in widened(held, held_scores(held)).collect():
        got.setdefault(r.restaurant_id, set()).add((r.lower, r.upper))
    for tenant in ("r0", "r1", "r2"):
        scores = sorted(round(max(x[5] - x[4], x[4] - x[6]), 9) for x in rows if x[0] == tenant)
        move = scores[min(len(scores), math.ceil(round((len(scores) + 1) * 0.8, 9))) - 1]
        assert [(round(a, 9), round(b, 9)) for a, b in got[tenant]] == [(round(47 - move, 9), round(52 + move, 9))]
    share = np.mean([lower <= x[4] <= upper for x in rows if x[0] == "r2" for lower, upper in got["r2"]])
    assert 0.8 <= share < 0.802


def test_leaf_counts_stay_in_the_tasks(spark, monkeypatch):
    brought = []
    collect = boosting.RDD.collect
    monkeypatch.setattr(boosting.RDD, "collect", lambda self: brought.append(collect(self)) or brought[-1])
    rows = spark.createDataFrame(sample().assign(y=lambda df: df.y * 1000))
    boosting.train(rows, "y", NUMBERS, CATEGORIES, (0.1, 0.5, 0.9), SMALL)
    sizes = [len(boosting.pickle.dumps(found)) / len(found) for found in brought]
    # Two numbers for each of 8 leaves, or the splits of 4 nodes; counts by digit would be 8 x 2^9 numbers and more.
    assert sizes and max(sizes) < 4096


def test_whole_parts_move_no_sums(spark):
    rows = spark.createDataFrame(sample())
    coder = boosting.fit_coder(rows, NUMBERS, CATEGORIES)
    blocks = boosting.pack(rows, coder, "y", 1, 3, whole=True)
    homes = blocks.map(lambda b: [part for part, *_ in b.spans]).glom().map(lambda own: {p for b in own for p in b}).collect()
    assert sorted(p for own in homes for p in own) == [0, 1, 2]
    assert sum(len(b.y) for b in blocks.collect()) == 900
