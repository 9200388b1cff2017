import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from larder.operators import demand as ops
from larder.operators.baselines import croston_rates, naive_forecasts
from larder.operators.exogenous import ingredient_depletion
from larder.operators.features import day_ahead_features, era_asof, feature_frame, history_columns
from larder.operators.folds import assert_no_leakage, forecast_frame, tail_folds, walk_forward_folds
from larder.operators.joins import dimension_join, salted_join
from larder.operators.unconstrain import unconstrain
from larder.sources import readers, schemas

D = dt.date
DAY = D(2024, 1, 1)  # a Monday


def line(n, day, hour, name, qty, comp=None, void="False", server="S009", tenant="r0"):
    return (tenant, f"C{n}", f"L{n}", day, dt.datetime(day.year, day.month, day.day, hour), name, "main", 10.0, qty, None, 0.0, comp, void, server)


@pytest.fixture()
def aliases(spark):
    rows = [("r0", "rib", "Short Rib"), ("r0", "rib", "Braised Short Rib"), ("r0", "cod", "Cod"), ("r1", "rib", "Short Rib")]
    return spark.createDataFrame(rows, "restaurant_id string, item_id string, alias string")


def cells(df, value="demand"):
    return {(r.restaurant_id, r.business_date, r.item_id, r.service_period): r[value] for r in df.collect()}


def test_clean_demand(spark, aliases):
    lines = spark.createDataFrame(
        [
            line(1, DAY, 12, "Short Rib", 3),
            line(2, DAY, 12, "Braised Short Rib", 2, comp="True"),
            line(3, DAY, 19, "Short Rib", 9, void="1"),
            line(4, DAY, 19, "Short Rib", 4, server="S001"),
            line(5, DAY, 16, "Short Rib", 1, server=None),
            line(6, D(2024, 1, 3), 12, None, 5),
            line(7, D(2024, 1, 4), 12, "Cod", 0),
            line(8, DAY, 13, "Short Rib", 7, tenant="r1"),
        ],
        schemas.POS_SALES,
    )
    log = spark.createDataFrame(
        [("r0", DAY, "Short Rib", "20:15"), ("r0", DAY, "Unheard Of", "12:00")], schemas.EIGHTYSIX_LOG
    )
    out = ops.clean_demand(lines, log, aliases, ("S001", "S002"))
    got = cells(out)
    assert got[("r0", DAY, "rib", "lunch")] == 5 and got[("r0", DAY, "rib", "dinner")] == 1
    assert got[("r1", DAY, "rib", "lunch")] == 7
    # the nameless line still makes its day a selling day; the quarantined line does not
    assert {d for r, d, _, _ in got if r == "r0"} == {DAY, D(2024, 1, 3)}
    assert len(got) == 2 * 2 * 2 + 1 * 1 * 2 and got[("r0", D(2024, 1, 3), "cod", "dinner")] == 0
    assert [k for k, c in cells(out, "censored").items() if c] == [("r0", DAY, "rib", "dinner")]
    report = ops.cleaning_report(lines, ("S001", "S002")).where("restaurant_id = 'r0'").first()
    assert (report.n_raw, report.n_zero_qty, report.n_void, report.n_staff, report.n_comp_kept, report.n_kept) == (7, 1, 1, 1, 1, 4)


def test_observed_demand_keeps_only_sold_dayparts(spark, aliases):
    lines = spark.createDataFrame([line(1, DAY, 19, "Cod", 2), line(2, DAY, 20, "Cod", 4, server="S001")], schemas.POS_SALES)
    assert cells(ops.observed_demand(lines, aliases)) == {("r0", DAY, "cod", "dinner"): 6, ("r0", DAY, "rib", "dinner"): 0}


def test_unknown_name_fails(spark, aliases):
    lines = spark.createDataFrame([line(1, DAY, 12, "Mystery", 1)], schemas.POS_SALES)
    with pytest.raises(Exception, match="not in the alias map: Mystery"):
        ops.observed_demand(lines, aliases).collect()


def series(spark, values, start=DAY, censored=(), item="rib", step=1):
    rows = [("r0", start + dt.timedelta(days=i * step), item, "dinner", v, i in censored) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "restaurant_id string, business_date date, item_id string, service_period string, demand bigint, censored boolean")


def test_walk_forward_folds(spark):
    demand = series(spark, list(range(200)))
    folds = walk_forward_folds(demand).orderBy("fold").collect()
    assert [(f.fold, f.train_end, f.test_start, f.test_end) for f in folds] == [
        (i, DAY + dt.timedelta(83 + 28 * i), DAY + dt.timedelta(84 + 28 * i), DAY + dt.timedelta(111 + 28 * i)) for i in range(4)
    ]
    tail = tail_folds(demand).orderBy("fold").collect()
    assert tail[-1].test_end == DAY + dt.timedelta(199) and all(f.train_end < f.test_start for f in tail)
    with pytest.raises(Exception, match="need 196 days, have 195"):
        walk_forward_folds(series(spark, list(range(195)))).collect()
    with pytest.raises(ValueError, match="at least 4"):
        walk_forward_folds(demand, n_folds=3)
    leaking = walk_forward_folds(demand).withColumn("train_end", F.col("test_start"))
    with pytest.raises(Exception, match="reaches into the test window"):
        assert_no_leakage(leaking).collect()


def test_naive_forecasts_see_training_days_only(spark):
    demand = series(spark, [d % 7 + d // 7 for d in range(196)])
    folds = walk_forward_folds(demand)
    got = naive_forecasts(demand, forecast_frame(demand, folds), folds).where("fold = 0").collect()
    truth = {DAY + dt.timedelta(d): d % 7 + d // 7 for d in range(84)}
    for r in got:
        past = [truth.get(r.business_date - dt.timedelta(7 * k)) for k in range(1, 8)]
        assert r.lag7 == next(p for p in past if p is not None)
        month = [p for p in past[:4] if p is not None]
        expected = sum(month) / len(month) if month else sum(truth.values()) / len(truth)
        assert r.rolling28 == pytest.approx(expected)
        assert r.chef_gut == round(r.rolling28 / 5) * 5


def croston(demands, alpha=0.1, textbook=False):
    hits = [i for i, d in enumerate(demands) if d > 0]
    if not hits:
        return 0.0
    gaps = [g for g in (b - a for a, b in zip([0] + hits, hits)) if g > 0]
    z, p = float(demands[hits[0]]), 1.0
    for n, i in enumerate(hits):
        z = alpha * demands[i] + (1 - alpha) * z
        p = alpha * (gaps[min(n if textbook else i, len(gaps) - 1)] if gaps else 1.0) + (1 - alpha) * p
    return z / max(p, 1.0)


@pytest.mark.parametrize("pattern", [[0, 0, 3, 0, 5, 0, 0, 0, 2], [4, 0, 0, 1], [0], [7], [0, 2]])
def test_croston(spark, pattern):
    values = [pattern[i % len(pattern)] for i in range(196)]
    demand = series(spark, values)
    got = {r.fold: r.forecast for r in croston_rates(demand, walk_forward_folds(demand)).collect()}
    assert got == pytest.approx({f: croston(values[: 84 + 28 * f]) for f in range(4)})


@pytest.mark.parametrize("textbook", [False, True])
def test_croston_over_many_slices_folds_and_starts(spark, textbook):
    """700 days are up to eleven slices; ends fall on, before and behind a slice's last occurrence."""
    rng = random.Random(3)
    chances = [0, 0.02, 0.2, 0.5, 0.9, 1]
    sold = {f"i{n}": [rng.randint(1, 9) * (rng.random() < chance) for _ in range(700)] for n, chance in enumerate(chances)}
    spans = [(0, 0), (0, 63), (0, 64), (0, 65), (0, 500), (0, 699), (37, 300), (37, 699)]
    at = lambda day: DAY + dt.timedelta(day)
    rows = [("r0", item, "dinner", at(day), units) for item, values in sold.items() for day, units in enumerate(values)]
    demand = spark.createDataFrame(rows, "restaurant_id string, item_id string, service_period string, business_date date, demand bigint")
    folds = spark.createDataFrame([("r0", f, at(a), at(b)) for f, (a, b) in enumerate(spans)], "restaurant_id string, fold int, train_start date, train_end date")
    got = {(r.item_id, r.fold): r.forecast for r in croston_rates(demand, folds, textbook=textbook).collect()}
    want = {(item, f): croston(values[a : b + 1], textbook=textbook) for item, values in sold.items() for f, (a, b) in enumerate(spans)}
    assert got == pytest.approx(want)


def test_lags_use_calendar_days_and_the_strict_past(spark):
    demand = series(spark, [10] * 30 + [99])
    last = history_columns(demand).orderBy(F.desc("business_date")).first()
    assert (last.lag_1, last.lag_7, last.rolling_mean_7, last.rolling_std_7) == (10.0, 10.0, 10.0, 0.0)
    gappy = history_columns(series(spark, [1, 2, 3], step=2)).orderBy("business_date").collect()
    assert [r.lag_1 for r in gappy] == [None, None, None] and gappy[2].rolling_mean_7 == 1.5
    assert gappy[1].rolling_std_7 is None


def test_block_features_hide_test_actuals(spark):
    demand = series(spark, list(range(196)))
    eras = spark.createDataFrame([(DAY + dt.timedelta(10), 5), (DAY + dt.timedelta(50), 6)], "start_date date, era_id int")
    rows = feature_frame(demand, walk_forward_folds(demand), eras).where("fold = 0 and role = 'test'").orderBy("business_date").collect()
    assert rows[0].lag_1 == 83.0 and rows[1].lag_1 is None and rows[6].lag_7 == 83.0 and rows[7].lag_7 is None
    assert all(r.demand is None and r.actual is not None for r in rows)
    ahead = day_ahead_features(demand, eras).orderBy("business_date").collect()
    assert all(r.lag_1 == i for i, r in enumerate(ahead[1:]))
    era = era_asof(demand, eras).orderBy("business_date").collect()
    assert [(era[i].era_id, era[i].era_days_elapsed) for i in (0, 10, 49, 50, 60)] == [(5, 0), (5, 0), (5, 39), (6, 0), (6, 10)]


@pytest.mark.parametrize(
    "values, step, cap, expected",
    [
        ([10, 12, 8, 14, 11, 9, 13, 15], 7, 7, None),
        ([10, 20, 30, 40, 5, 15, 25, 14], 1, 5, None),
        ([10, 10, 11, 9, 10, 10, 11, 9], 7, 8, None),
        ([1, 2, 1, 0, 1, 2, 1, 1], 7, 50, 51.0),
        ([], 1, 3, 3.0),
    ],
)
def test_unconstrain_hand_cases(spark, values, step, cap, expected):
    from test_functions import brute_tail

    demand = series(spark, [*values, cap], censored={len(values)}, step=step)
    got = unconstrain(demand).orderBy("business_date").collect()
    assert [r.demand for r in got[:-1]] == [float(v) for v in values]
    if expected is None:
        mean = sum(values) / len(values)
        var = sum((v - mean) ** 2 for v in values) / (len(values) - 1)
        expected = max(cap, brute_tail(mean, var, float(cap)))
    assert got[-1].demand == pytest.approx(expected) and got[-1].demand >= cap


def test_salted_joins_equal_plain_ones(spark):
    big = spark.range(3000).select((F.col("id") % 3).alias("k"), "id")  # one key holds a third
    small = spark.createDataFrame([(0, "a"), (1, "b"), (7, "c")], "k bigint, name string")
    for how in ("inner", "left", "left_semi", "left_anti"):
        want = sorted(map(tuple, big.join(small, "k", how).collect()), key=str)
        assert sorted(map(tuple, salted_join(big, small, ["k"], ["id"], how).collect()), key=str) == want
    assert dimension_join(big, small, ["k"]).count() == 2000


def test_depletion(spark):
    demand = series(spark, [10, 20, 30])
    recipes = spark.createDataFrame([("r0", "rib", "beef", 0.5)], "restaurant_id string, item_id string, ingredient_id string, qty_per_portion double")
    used = ingredient_depletion(demand, recipes).orderBy("order_day").collect()
    assert [(r.order_day, r.depleted_qty) for r in used] == [(DAY, 5.0), (D(2024, 1, 4), 25.0)]


def sold_line(spark, qty, name):
    return spark.createDataFrame(
        [("r0", DAY, dt.datetime(2024, 1, 1, 12), name, qty, None, "False", "S9")],
        "restaurant_id string, business_date date, sold_at timestamp_ntz, item_name string, qty int, comp_flag string, void_flag string, server_id string",
    )


ALIASES = "restaurant_id string, item_id string, alias string"
LOG = "restaurant_id string, business_date date, item_name string, time_86d string"
ECONOMICS = "restaurant_id string, item_id string, name string"


def test_alias_of_two_items_stops_the_job(spark):
    aliases = spark.createDataFrame([("r0", "a", "Soup"), ("r0", "b", "Soup")], ALIASES)
    clean = ops.clean_demand(sold_line(spark, 5, "Soup"), spark.createDataFrame([], LOG), aliases, [])
    with pytest.raises(Exception, match="alias of two items: Soup"):
        clean.collect()
    twice = spark.createDataFrame([("r0", "a", "Soup"), ("r0", "a", "Soup")], ALIASES)
    rows = ops.clean_demand(sold_line(spark, 5, "Soup"), spark.createDataFrame([], LOG), twice, []).collect()
    assert sum(r.demand for r in rows) == 5


def test_drifted_configuration_stops_the_job(spark):
    aliases = spark.createDataFrame([("r0", "a", "Soup")], ALIASES)
    log = spark.createDataFrame([], LOG)
    known = spark.createDataFrame([("r0", "a", " SOUP")], ECONOMICS)
    assert ops.clean_demand(sold_line(spark, 5, "Soup"), log, aliases, [], known).count() == 2
    drifted = spark.createDataFrame([("r0", "a", "Stew")], ECONOMICS)
    with pytest.raises(Exception, match="configured name without an alias: Stew"):
        ops.clean_demand(sold_line(spark, 5, "Soup"), log, aliases, [], drifted).collect()


def test_csv_columns_are_found_by_name(spark, tmp_path):
    path = tmp_path / "log.csv"
    path.write_text("time_86d,note,item_name,business_date,restaurant_id\n19:30,x,Soup,2024-01-01,r0\n")
    (row,) = readers.read_86_log(spark, str(path)).collect()
    assert (row.item_name, row.time_86d, row.business_date) == ("Soup", "19:30", DAY)
    assert readers.read_86_log(spark, str(tmp_path / "none.csv")).count() == 0
    path.write_text("restaurant_id,business_date,item_name\nr0,2024-01-01,Soup\n")
    with pytest.raises(ValueError, match="time_86d"):
        readers.read_86_log(spark, str(path))


def test_every_file_has_its_own_header(spark, tmp_path):
    folder = tmp_path / "a folder 100%"
    folder.mkdir()
    (folder / "one.csv").write_text("restaurant_id,business_date,item_name,time_86d\nr0,2024-01-01,Soup,19:30\nr0,2024-01-01,Stew,12:00\n")
    (folder / "two.csv").write_text("\ntime_86d,note,item_name,business_date,restaurant_id\n20:15,x,Soup,2024-01-02,r1\n")
    (folder / "three é.csv").write_text("restaurant_id,business_date,item_name,time_86d\nr2,2024-01-03,Pie,\n")
    (folder / "empty.csv").write_text("")
    got = readers.read_86_log(spark, str(folder), mixed=True).collect()
    assert sorted((r.restaurant_id, r.item_name, r.time_86d) for r in got) == [
        ("r0", "Soup", "19:30"), ("r0", "Stew", "12:00"), ("r1", "Soup", "20:15"), ("r2", "Pie", None),
    ]
    with pytest.raises(Exception, match="(?i)header"):
        readers.read_86_log(spark, str(folder)).collect()
    assert readers.read_86_log(spark, str(tmp_path / "none"), mixed=True).count() == 0
    (folder / "four.csv").write_text("restaurant_id,business_date,item_name\nr0,2024-01-01,Soup\n")
    with pytest.raises(ValueError, match="time_86d"):
        readers.read_86_log(spark, str(folder), mixed=True)


def test_grid_of_one_large_tenant(spark):
    days = [(("r0" if d % 20 else "r1"), DAY + dt.timedelta(d), "a", "lunch", d % 5) for d in range(400)]
    daily = spark.createDataFrame(days, "restaurant_id string, business_date date, item_id string, service_period string, qty int")
    aliases = spark.createDataFrame([(r, i, i) for r in ("r0", "r1") for i in "abc"], ALIASES)
    grid = ops.demand_grid(daily, aliases)
    assert grid.count() == 400 * 3 * 2 and grid.agg(F.sum("demand")).first()[0] == sum(d[4] for d in days)
