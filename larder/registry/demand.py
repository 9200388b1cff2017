"""Queries over point-of-sale data: reading, gates, cleaning, the demand grid, folds and baselines."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.calendar import calendar_columns, flag, to_business_date
from ..functions.money import chef_round, critical_ratio, dollar_loss
from ..operators import KEY, SERIES, baselines, demand as ops, exogenous, features, folds as fold_ops, pricing, quality, scoring
from ..operators.quantiles import route_batch
from ..operators.unconstrain import expanding_stats, unconstrain
from ..plans import floors
from ..sources import readers
from ..sources.driver_views import STAFF, Views
from ..sources.staging import stage, stage_by_key, stage_path
from . import query
from .common_sql import CALENDAR, COMP, FEATURES, KEYS, SERIES as S_KEYS, STAFF as STAFF_SQL, VOID, ANOMALY, norm, past


def observed(v: Views) -> DataFrame:
    daily = stage(ops.daily_item_sales(ops.drop_voids(v.pos_sales), v.item_aliases), "daily")
    return ops.observed_grid(daily, v.item_aliases)


def clean(v: Views) -> DataFrame:
    return ops.clean_demand(v.pos_sales, v.eightysix_log, v.item_aliases, STAFF, v.item_economics)


def staged_clean(v: Views) -> DataFrame:
    return stage_by_key(clean(v), "clean", SERIES)


def truth_of(clean_demand: DataFrame) -> DataFrame:
    """Scoring-only truth: three more portions wherever the log shows a sell-out."""
    return clean_demand.select(
        *KEY, (F.col("demand") + F.when(F.col("censored"), 3).otherwise(0)).cast("bigint").alias("true_demand")
    )


def caps_of(clean_demand: DataFrame) -> DataFrame:
    per_item = clean_demand.groupBy("restaurant_id", "item_id").agg(
        (F.sum("demand") * 2).alias("s"), F.count("*").alias("n")
    )
    return per_item.select("restaurant_id", "item_id", F.expr("s div n").alias("cap"))


def stockouts_of(clean_demand: DataFrame) -> DataFrame:
    rows = clean_demand.join(caps_of(clean_demand), ["restaurant_id", "item_id"])
    truth = (F.col("demand") + F.when(F.col("censored"), 3).otherwise(0)).cast("bigint")
    cap = F.rint(F.col("cap") * 0.94).cast("bigint")
    rows = rows.withColumns({"true_demand": truth, "cap": cap})
    return rows.where("censored or true_demand > cap").select(
        *KEY, "cap", "true_demand", F.col("demand").alias("observed_demand")
    )


POS_COLUMNS = """restaurant_id, check_id, line_id, business_date, sold_at, item_name, category, menu_price, qty, modifiers,
  «discount_amount» AS discount_amount, comp_flag, void_flag, server_id"""


@query("read_pos_sales", f"SELECT {POS_COLUMNS} FROM pos_sales")
def read_pos_sales(v: Views) -> DataFrame:
    path = stage_path(v.spark, "pos-csv")
    v.pos_sales.write.option("header", True).option("escape", '"').csv(path)
    return readers.read_pos_sales(v.spark, path)


@query("read_86_log", "SELECT * FROM eightysix_log")
def read_86_log(v: Views) -> DataFrame:
    path = stage_path(v.spark, "log-csv")
    v.eightysix_log.write.option("header", True).csv(path)
    absent = readers.read_86_log(v.spark, path + "-absent")
    return readers.read_86_log(v.spark, path).unionByName(absent)


@query("read_mixed_headers", f"SELECT {POS_COLUMNS} FROM pos_sales")
def read_mixed_headers(v: Views) -> DataFrame:
    """Exports of two tills whose columns stand in different orders, one with a column more."""
    path = stage_path(v.spark, "pos-mixed")
    first = F.col("server_id") < "S005"
    v.pos_sales.where(first).write.option("header", True).option("escape", '"').csv(f"{path}/till=1")
    turned = v.pos_sales.where(~first).select(F.lit("x").alias("till_note"), *reversed(v.pos_sales.columns))
    turned.write.option("header", True).option("escape", '"').csv(f"{path}/till=2")
    return readers.read_pos_sales(v.spark, path, mixed=True)


@query(
    "read_truth",
    f"""SELECT {KEYS}, true_demand, FALSE AS stockout FROM truth_demand
        UNION ALL SELECT {KEYS}, true_demand, TRUE FROM truth_stockouts""",
)
def read_truth(v: Views) -> DataFrame:
    root = stage_path(v.spark, "store") + "/_truth"
    base = staged_clean(v)
    order = ["restaurant_id", "business_date", "service_period", "item_id"]
    truth_of(base).select(*order, "true_demand").write.option("header", True).csv(f"{root}/truth_demand")
    stockouts_of(base).select(*order, "cap", "true_demand", "observed_demand").write.option("header", True).csv(
        f"{root}/truth_stockouts"
    )
    demand = readers.read_truth(v.spark, root, "truth_demand").withColumn("stockout", F.lit(False))
    outs = readers.read_truth(v.spark, root, "truth_stockouts").withColumn("stockout", F.lit(True))
    columns = [*KEY, "true_demand", "stockout"]
    return demand.select(columns).unionByName(outs.select(columns))


@query(
    "tenant_filter",
    """SELECT restaurant_id, count(*) AS n_lines, CAST(sum(qty) AS BIGINT) AS qty FROM pos_sales
       WHERE regexp_full_match(restaurant_id, '[A-Za-z0-9_-]{1,64}') AND restaurant_id = 'r1' GROUP BY 1""",
)
def tenant_filter(v: Views) -> DataFrame:
    from ..functions.text import valid_tenant

    own = v.pos_sales.where(F.col("restaurant_id") == readers.check_tenant("r1"))
    return own.where(valid_tenant(F.col("restaurant_id"))).groupBy("restaurant_id").agg(
        F.count("*").alias("n_lines"), F.sum("qty").alias("qty")
    )


BROKEN_ECONOMICS = """
    SELECT restaurant_id, item_id, name, CASE WHEN item_id = 'promo' THEN 'fried' ELSE prep_type END AS prep_type,
           CASE WHEN item_id = 'small' THEN 0.0 ELSE co END AS co, CASE WHEN item_id = 'large' THEN -1.0 ELSE cu END AS cu,
           CASE WHEN item_id = 'medium' THEN 0 ELSE lead_time_days END AS lead_time_days FROM item_economics
    UNION ALL SELECT restaurant_id, 'economy', ' Standard ', prep_type, co, cu, lead_time_days FROM item_economics
      WHERE item_id = 'standard' AND restaurant_id = 'r0'
"""


@query(
    "validate_economics",
    f"""WITH items AS ({BROKEN_ECONOMICS})
    SELECT restaurant_id, item, message FROM (
      SELECT restaurant_id, trim(name) AS item, 'prep_type: unknown' AS message FROM items WHERE prep_type NOT IN ('batch', 'made_to_order')
      UNION ALL SELECT restaurant_id, trim(name), 'co: must be greater than 0' FROM items WHERE NOT co > 0
      UNION ALL SELECT restaurant_id, trim(name), 'cu: must be greater than 0' FROM items WHERE NOT cu > 0
      UNION ALL SELECT restaurant_id, trim(name), 'lead_time_days: must be 1 or more' FROM items WHERE NOT lead_time_days >= 1
      UNION ALL SELECT restaurant_id, item_id, 'id: duplicate' FROM items GROUP BY 1, 2 HAVING count(*) > 1
      UNION ALL SELECT restaurant_id, lower(trim(name)), 'name: duplicate' FROM items GROUP BY 1, 2 HAVING count(*) > 1
    ) x""",
)
def validate_economics(v: Views) -> DataFrame:
    items = v.item_economics
    col = F.col
    broken = items.select(
        "restaurant_id",
        "item_id",
        "name",
        F.when(col("item_id") == "promo", "fried").otherwise(col("prep_type")).alias("prep_type"),
        F.when(col("item_id") == "small", 0.0).otherwise(col("co")).alias("co"),
        F.when(col("item_id") == "large", -1.0).otherwise(col("cu")).alias("cu"),
        F.when(col("item_id") == "medium", 0).otherwise(col("lead_time_days")).alias("lead_time_days"),
    )
    again = items.where("item_id = 'standard' and restaurant_id = 'r0'").select(
        "restaurant_id", F.lit("economy").alias("item_id"), F.lit(" Standard ").alias("name"),
        "prep_type", "co", "cu", "lead_time_days",
    )
    return quality.validate_economics(broken.unionByName(again))


def ambiguous_aliases(v: Views) -> DataFrame:
    """The alias map plus every brand as an alias of the kinds sold under it."""
    brands = v.table("part").select("p_brand", F.lower("p_type").alias("item_id")).distinct()
    tenants = F.explode(F.array(F.lit("r0"), F.lit("r1"))).alias("restaurant_id")
    extra = brands.select(tenants, "item_id", F.col("p_brand").alias("alias"))
    return v.item_aliases.unionByName(extra)


@query(
    "alias_ambiguity",
    """WITH a AS (SELECT restaurant_id, item_id, alias FROM item_aliases UNION ALL
         SELECT unnest(['r0', 'r1']), item_id, p_brand FROM (SELECT DISTINCT p_brand, lower(p_type) AS item_id FROM part) x)
       SELECT restaurant_id, alias, count(DISTINCT item_id) AS n_items, min(item_id) AS first_item, max(item_id) AS last_item
       FROM a GROUP BY 1, 2 HAVING count(DISTINCT item_id) > 1""",
)
def alias_ambiguity(v: Views) -> DataFrame:
    return quality.alias_ambiguity(ambiguous_aliases(v))


@query(
    "config_name_drift",
    f"""SELECT e.restaurant_id, e.item_id, e.name FROM (SELECT restaurant_id, item_id, name FROM item_economics
           UNION ALL SELECT restaurant_id, 'former ' || item_id, 'Former ' || name FROM item_economics) e WHERE NOT EXISTS (
         SELECT 1 FROM item_aliases a WHERE a.restaurant_id = e.restaurant_id AND {norm("a.alias")} = {norm("e.name")})""",
)
def config_name_drift(v: Views) -> DataFrame:
    """The configured items, and as many that the menu no longer has."""
    former = v.item_economics.withColumns({c: F.concat(F.lit(p), c) for c, p in (("item_id", "former "), ("name", "Former "))})
    return quality.config_name_drift(v.item_economics.unionByName(former), v.item_aliases)


@query(
    "unknown_items",
    """SELECT p.restaurant_id, p.item_name, count(*) AS n_lines FROM (SELECT restaurant_id, item_name FROM pos_sales
         UNION ALL SELECT restaurant_id, 'Old ' || item_name FROM pos_sales WHERE qty > 40) p
       WHERE NOT EXISTS (SELECT 1 FROM item_aliases a WHERE a.restaurant_id = p.restaurant_id AND a.alias = p.item_name) GROUP BY 1, 2""",
)
def unknown_items(v: Views) -> DataFrame:
    """All lines, and some more under names no alias carries."""
    renamed = v.pos_sales.where("qty > 40").withColumn("item_name", F.concat(F.lit("Old "), "item_name"))
    return quality.unknown_items(v.pos_sales.unionByName(renamed), v.item_aliases)


@query(
    "missingness_report",
    """SELECT restaurant_id, n_rows, column_name, n_null, «n_null / n_rows * 100» AS pct_null FROM (
         SELECT restaurant_id, count(*) AS n_rows,
           """
    + ", ".join(
        f"count(*) FILTER ({c} IS NULL) AS {c}"
        for c in "check_id line_id business_date sold_at item_name category menu_price qty modifiers discount_amount comp_flag void_flag server_id".split()
    )
    + """ FROM pos_sales GROUP BY 1) t
       UNPIVOT (n_null FOR column_name IN (check_id, line_id, business_date, sold_at, item_name, category, menu_price, qty,
                modifiers, discount_amount, comp_flag, void_flag, server_id))""",
)
def missingness_report(v: Views) -> DataFrame:
    return quality.missingness_report(v.pos_sales)


@query(
    "flag_coerce",
    f"SELECT restaurant_id, void_flag, comp_flag, {VOID} AS is_void, {COMP} AS is_comp, count(*) AS n FROM pos_sales GROUP BY ALL",
)
def flag_coerce(v: Views) -> DataFrame:
    flags = {"is_void": flag(F.col("void_flag")), "is_comp": flag(F.col("comp_flag"))}
    return v.pos_sales.withColumns(flags).groupBy("restaurant_id", "void_flag", "comp_flag", *flags).agg(
        F.count("*").alias("n")
    )


@query("drop_voids", f"SELECT restaurant_id, line_id, qty FROM pos_sales WHERE NOT {VOID}")
def drop_voids(v: Views) -> DataFrame:
    return ops.drop_voids(v.pos_sales).select("restaurant_id", "line_id", "qty")


@query("drop_staff", f"SELECT restaurant_id, line_id, server_id FROM pos_sales WHERE NOT {STAFF_SQL}")
def drop_staff(v: Views) -> DataFrame:
    return ops.drop_staff(v.pos_sales, STAFF).select("restaurant_id", "line_id", "server_id")


@query("quarantine_zero_qty", f"SELECT restaurant_id, line_id, qty, void_flag FROM pos_sales WHERE {ANOMALY}")
def quarantine_zero_qty(v: Views) -> DataFrame:
    return ops.quarantine_zero_qty(v.pos_sales).select("restaurant_id", "line_id", "qty", "void_flag")


@query(
    "keep_comps",
    f"""SELECT restaurant_id, {COMP} AS is_comp, count(*) AS n_lines, CAST(sum(qty) AS BIGINT) AS qty
        FROM kept_lines GROUP BY ALL""",
)
def keep_comps(v: Views) -> DataFrame:
    kept = ops.kept_lines(v.pos_sales, STAFF).withColumn("is_comp", ops.comp_flag())
    return kept.groupBy("restaurant_id", "is_comp").agg(F.count("*").alias("n_lines"), F.sum("qty").alias("qty"))


@query(
    "cleaning_report",
    f"""SELECT *, «(n_raw - n_kept) / n_raw * 100» AS pct_excluded FROM (
          SELECT restaurant_id, count(*) AS n_raw, count(*) FILTER ({ANOMALY}) AS n_zero_qty,
            count(*) FILTER (NOT {ANOMALY} AND {VOID}) AS n_void,
            count(*) FILTER (NOT {ANOMALY} AND NOT {VOID} AND {STAFF_SQL}) AS n_staff,
            count(*) FILTER (NOT {ANOMALY} AND NOT {VOID} AND NOT {STAFF_SQL} AND {COMP}) AS n_comp_kept,
            count(*) FILTER (NOT {ANOMALY} AND NOT {VOID} AND NOT {STAFF_SQL}) AS n_kept
          FROM pos_sales GROUP BY 1) x""",
)
def cleaning_report(v: Views) -> DataFrame:
    return ops.cleaning_report(v.pos_sales, STAFF)


@query("route_batch", "SELECT restaurant_id, item_id, name, «co» AS co, «cu» AS cu FROM item_economics WHERE prep_type = 'batch'")
def route_batch_query(v: Views) -> DataFrame:
    return route_batch(v.item_economics).select("restaurant_id", "item_id", "name", "co", "cu")


@query(
    "reconcile_names",
    """SELECT p.restaurant_id, p.item_name, a.item_id, count(*) AS n_lines, CAST(sum(qty) AS BIGINT) AS qty
       FROM pos_sales p JOIN item_aliases a ON a.restaurant_id = p.restaurant_id AND a.alias = p.item_name GROUP BY ALL""",
)
def reconcile_names(v: Views) -> DataFrame:
    counts = v.pos_sales.groupBy("restaurant_id", "item_name").agg(F.count("*").alias("n_lines"), F.sum("qty").alias("qty"))
    return ops.reconcile_names(counts, v.item_aliases)


@query(
    "daypart",
    """SELECT restaurant_id, line_id, CASE WHEN hour(sold_at) < 16 THEN 'lunch' ELSE 'dinner' END AS service_period FROM pos_sales""",
)
def daypart_query(v: Views) -> DataFrame:
    return ops.with_daypart(v.pos_sales).select("restaurant_id", "line_id", "service_period")


@query("demand_grid", f"SELECT {KEYS}, demand FROM clean_grid")
def demand_grid(v: Views) -> DataFrame:
    daily = ops.daily_item_sales(ops.kept_lines(v.pos_sales, STAFF), v.item_aliases)
    return ops.demand_grid(daily, v.item_aliases)


@query("censor_tag", f"SELECT {KEYS}, demand, censored FROM clean_demand WHERE censored")
def censor_tag(v: Views) -> DataFrame:
    return clean(v).where("censored")


@query("observed_demand", f"SELECT {KEYS}, demand FROM observed_demand")
def observed_demand(v: Views) -> DataFrame:
    return observed(v)


@query("clean_demand", f"SELECT {KEYS}, demand, censored FROM clean_demand")
def clean_demand(v: Views) -> DataFrame:
    return clean(v)


@query(
    "date_coerce",
    """SELECT restaurant_id, CAST(CAST(business_date AS VARCHAR) AS DATE) AS from_text, CAST(sold_at AS DATE) AS from_timestamp,
       count(*) AS n FROM pos_sales GROUP BY ALL""",
)
def date_coerce(v: Views) -> DataFrame:
    text = F.col("business_date").cast("string")
    return v.pos_sales.groupBy(
        "restaurant_id",
        to_business_date(text).alias("from_text"),
        to_business_date(F.col("sold_at")).alias("from_timestamp"),
    ).agg(F.count("*").alias("n"))


@query(
    "calendar_features",
    f"SELECT DISTINCT business_date, {CALENDAR} FROM (SELECT CAST(l_shipdate AS DATE) AS business_date FROM lineitem) d",
)
def calendar_features(v: Views) -> DataFrame:
    days = v.table("lineitem").select(F.col("l_shipdate").cast("date").alias("business_date")).distinct()
    return days.withColumns(calendar_columns(F.col("business_date")))


@query("era_asof", "SELECT business_date, era_id, era_days_elapsed FROM era_days")
def era_asof(v: Views) -> DataFrame:
    days = ops.kept_lines(v.pos_sales, STAFF).select("business_date").distinct()
    return features.era_asof(days, v.menu_eras)


# ---- folds and baselines


@query("walk_forward_folds", "SELECT * FROM folds")
def walk_forward_folds(v: Views) -> DataFrame:
    return fold_ops.walk_forward_folds(staged_clean(v))


@query("tail_folds", "SELECT * FROM end_folds")
def tail_folds(v: Views) -> DataFrame:
    return fold_ops.tail_folds(staged_clean(v))


@query(
    "fold_range_join",
    """SELECT restaurant_id, fold, role, item_id, count(*) AS n_rows, CAST(sum(demand) AS BIGINT) AS demand,
         min(business_date) AS first_day, max(business_date) AS last_day
       FROM (SELECT *, CASE WHEN business_date <= train_end THEN 'train' ELSE 'test' END AS role
             FROM clean_demand JOIN folds USING (restaurant_id) WHERE business_date <= test_end) x GROUP BY ALL""",
)
def fold_range_join(v: Views) -> DataFrame:
    base = staged_clean(v)
    rows = fold_ops.fold_range_join(base, fold_ops.walk_forward_folds(base))
    return rows.groupBy("restaurant_id", "fold", "role", "item_id").agg(
        F.count("*").alias("n_rows"),
        F.sum("demand").alias("demand"),
        F.min("business_date").alias("first_day"),
        F.max("business_date").alias("last_day"),
    )


@query(
    "leakage_canary",
    """SELECT restaurant_id, fold, CAST(train_end + 7 * fold AS DATE) AS train_end, test_start FROM folds
       WHERE train_end + 7 * fold >= test_start""",
)
def leakage_canary(v: Views) -> DataFrame:
    """Folds shifted on purpose, so that the later ones leak and are found."""
    shifted = fold_ops.walk_forward_folds(staged_clean(v)).withColumn(
        "train_end", F.date_add("train_end", F.col("fold") * 7)
    )
    return fold_ops.leakage_canary(shifted).select("restaurant_id", "fold", "train_end", "test_start")


@query(
    "forecast_frame",
    f"""SELECT {KEYS}, fold, train_start, train_end, test_start, test_end FROM clean_demand JOIN folds USING (restaurant_id)
        WHERE business_date BETWEEN test_start AND test_end""",
)
def forecast_frame(v: Views) -> DataFrame:
    base = staged_clean(v)
    return fold_ops.forecast_frame(base, fold_ops.walk_forward_folds(base))


def walk_forward(v: Views) -> floors.Backtest:
    return floors.walk_forward(staged_clean(v))


@query("baseline_lag7", f"SELECT {KEYS}, fold, 'lag7' AS model, «lag7» AS forecast FROM naive")
def baseline_lag7(v: Views) -> DataFrame:
    run = walk_forward(v)
    return baselines.baseline_lag7(run.demand, run.targets, run.folds)


@query(
    "lag7_lookup",
    f"""SELECT {KEYS}, CAST(arg_min(past, back) AS DOUBLE) AS last_same_weekday, CAST(min(back) // 7 AS INTEGER) AS weeks_back FROM (
          SELECT t.restaurant_id, t.business_date, t.item_id, t.service_period, h.demand AS past, t.business_date - h.business_date AS back
          FROM clean_demand t JOIN clean_demand h ON h.restaurant_id = t.restaurant_id AND h.item_id = t.item_id
           AND h.service_period = t.service_period AND h.business_date < t.business_date AND h.business_date >= t.business_date - 49
           AND (t.business_date - h.business_date) % 7 = 0) x GROUP BY ALL""",
)
def lag7_lookup(v: Views) -> DataFrame:
    """Every cell of the series with its most recent same weekday, up to seven weeks back."""
    base = staged_clean(v)
    found = baselines.same_weekday_history(base, base.select(KEY), KEY)
    return found.where("weeks_back is not null").select(*KEY, "last_same_weekday", "weeks_back")


@query("baseline_rolling28", f"SELECT {KEYS}, fold, 'rolling28' AS model, «rolling28» AS forecast FROM naive")
def baseline_rolling28(v: Views) -> DataFrame:
    run = walk_forward(v)
    return baselines.baseline_rolling28(run.demand, run.targets, run.folds)


@query("baseline_chef_gut", f"SELECT {KEYS}, fold, 'chef_gut' AS model, «chef_gut» AS forecast FROM naive")
def baseline_chef_gut(v: Views) -> DataFrame:
    run = walk_forward(v)
    return baselines.baseline_chef_gut(run.demand, run.targets, run.folds)


@query(
    "baseline_croston",
    f"""SELECT {KEYS}, f.fold, 'croston' AS model, «coalesce(rate, 0)» AS forecast
        FROM clean_demand JOIN folds f USING (restaurant_id) LEFT JOIN croston_rates c USING ({S_KEYS}, fold)
        WHERE business_date BETWEEN test_start AND test_end""",
)
def baseline_croston(v: Views) -> DataFrame:
    run = walk_forward(v)
    return baselines.baseline_croston(run.demand, run.targets, run.folds)


@query(
    "chef_round",
    "SELECT DISTINCT l_quantity AS portions, greatest(round_even(l_quantity / 5.0::DOUBLE, 0) * 5, 0) AS rounded FROM lineitem",
)
def chef_round_query(v: Views) -> DataFrame:
    portions = v.table("lineitem").select(F.col("l_quantity").alias("portions")).distinct()
    return portions.withColumn("rounded", chef_round(F.col("portions")))


SCORED_COLUMNS = f"{KEYS}, fold, model, «forecast» AS forecast, actual, «dollar_cost» AS dollar_cost"


@query("score_join", f"SELECT {SCORED_COLUMNS} FROM scored")
def score_join(v: Views) -> DataFrame:
    run = walk_forward(v)
    scored = scoring.score_join(run.actuals, floors.baseline_forecasts(run), v.item_economics, floors.BASELINES)
    return scored.select(*KEY, "fold", "model", "forecast", "actual", "dollar_cost")


@query(
    "dollar_loss",
    f"""SELECT {KEYS}, «co * greatest(0, lag_7 - demand) + cu * greatest(0, demand - lag_7)» AS dollar_loss
        FROM past_all JOIN item_economics USING (restaurant_id, item_id) WHERE lag_7 IS NOT NULL""",
)
def dollar_loss_query(v: Views) -> DataFrame:
    """Cost of prepping last week's demand on every day of every series."""
    rows = features.lag_features(clean(v)).where("lag_7 is not null")
    rows = rows.join(v.item_economics.select("restaurant_id", "item_id", "co", "cu"), ["restaurant_id", "item_id"])
    cost = dollar_loss(F.col("lag_7"), F.col("demand").cast("double"), F.col("co"), F.col("cu"))
    return rows.select(*KEY, cost.alias("dollar_loss"))


@query(
    "critical_ratio",
    "SELECT restaurant_id, item_id, «cu / (co + cu)» AS q_star FROM item_economics",
)
def critical_ratio_query(v: Views) -> DataFrame:
    return v.item_economics.select("restaurant_id", "item_id", critical_ratio(F.col("co"), F.col("cu")).alias("q_star"))


SCORE_COLUMNS = """restaurant_id, fold, model, item_id, train_end, test_start, test_end, «dollar_cost» AS dollar_cost,
  «wape» AS wape, «bias» AS bias, n_days"""


@query("fold_scores", f"SELECT {SCORE_COLUMNS} FROM scores")
@query("backtest", f"SELECT {SCORE_COLUMNS} FROM scores")
@query("dollar_floor_clean", f"SELECT {SCORE_COLUMNS} FROM scores")
def dollar_floor_clean(v: Views) -> DataFrame:
    return floors.backtest(clean(v), v.item_economics)


@query("dollar_floor_dirty", f"SELECT {SCORE_COLUMNS} FROM dirty_scores")
def dollar_floor_dirty(v: Views) -> DataFrame:
    return floors.backtest(observed(v), v.item_economics)


@query(
    "totals_by_model",
    """SELECT restaurant_id, model, «sum(dollar_cost)» AS total_cost, """
    + ", ".join(f"«sum(CASE WHEN fold = {i} THEN dollar_cost END)» AS fold_{i}" for i in range(4))
    + " FROM scores GROUP BY ALL",
)
def totals_by_model(v: Views) -> DataFrame:
    return scoring.totals_by_model(floors.backtest(clean(v), v.item_economics))


@query(
    "dollar_gate",
    """SELECT restaurant_id, d.best_model AS dirty_model, «d.best_cost» AS dirty_cost, c.best_model AS clean_model,
         «c.best_cost» AS clean_cost, «d.best_cost - c.best_cost» AS gap
       FROM best_dirty d JOIN best_clean c USING (restaurant_id)""",
)
def dollar_gate(v: Views) -> DataFrame:
    """Best baseline on raw demand against best baseline on clean demand."""
    totals = [scoring.totals_by_model(floors.backtest(d, v.item_economics)) for d in (observed(v), clean(v))]
    return scoring.cleaning_floor_gap(*totals)


@query(
    "item_bias",
    """SELECT restaurant_id, model, item_id, «avg(forecast)» AS pred_mean, «avg(actual)» AS actual_mean,
         «avg(forecast - actual)» AS bias FROM scored GROUP BY ALL""",
)
def item_bias(v: Views) -> DataFrame:
    run = walk_forward(v)
    scored = scoring.score_join(run.actuals, floors.baseline_forecasts(run), v.item_economics, floors.BASELINES)
    return scoring.item_bias(scored)


# ---- features and recovered demand


@query("lag_features", f"SELECT {KEYS}, demand, censored, lag_1, lag_7, lag_14 FROM past_all")
def lag_features(v: Views) -> DataFrame:
    return features.lag_features(clean(v))


@query(
    "rolling_features",
    f"""SELECT {KEYS}, demand, censored, «rolling_mean_7» AS rolling_mean_7, «rolling_std_7» AS rolling_std_7,
        «rolling_mean_28» AS rolling_mean_28 FROM past_all""",
)
def rolling_features(v: Views) -> DataFrame:
    return features.rolling_features(clean(v))


@query(
    "feature_frame",
    f"""SELECT restaurant_id, business_date, fold, role, CAST(actual AS DOUBLE) AS actual, y AS demand, {FEATURES}
        FROM (SELECT *, {past(S_KEYS + ", fold")}, {CALENDAR} FROM (
          SELECT {KEYS}, fold, demand AS actual, CASE WHEN business_date <= train_end THEN 'train' ELSE 'test' END AS role,
                 CASE WHEN business_date <= train_end THEN CAST(demand AS DOUBLE) END AS y
          FROM clean_demand JOIN folds USING (restaurant_id) WHERE business_date <= test_end) x) p
        JOIN era_days USING (business_date)""",
)
def feature_frame(v: Views) -> DataFrame:
    base = staged_clean(v)
    return features.feature_frame(base, fold_ops.walk_forward_folds(base), v.menu_eras)


@query(
    "day_ahead_features",
    f"""SELECT restaurant_id, business_date, demand, {FEATURES} FROM (SELECT *, {CALENDAR} FROM past_all) p
        JOIN era_days USING (business_date)""",
)
def day_ahead_features(v: Views) -> DataFrame:
    return features.day_ahead_features(clean(v), v.menu_eras)


@query(
    "lag_fill_rate",
    """SELECT restaurant_id, business_date, «avg(CASE WHEN lag_1 IS NOT NULL THEN 1 ELSE 0 END)» AS lag_1_fill,
         «avg(CASE WHEN lag_7 IS NOT NULL THEN 1 ELSE 0 END)» AS lag_7_fill,
         «avg(CASE WHEN rolling_mean_7 IS NOT NULL THEN 1 ELSE 0 END)» AS rolling_mean_7_fill
       FROM past_all GROUP BY 1, 2""",
)
def lag_fill_rate(v: Views) -> DataFrame:
    return features.lag_fill_rate(features.history_columns(clean(v)), ["restaurant_id", "business_date"])


@query(
    "expanding_stats",
    f"""SELECT {KEYS}, demand, censored, day_of_week, «coarse_mean» AS coarse_mean, «coarse_var» AS coarse_var, coarse_n,
        «fine_mean» AS fine_mean, «fine_var» AS fine_var, fine_n FROM expanding""",
)
def expanding_stats_query(v: Views) -> DataFrame:
    return expanding_stats(clean(v))


@query("tail_mean", f"SELECT {KEYS}, cap, «m» AS mean, «v» AS variance, «estimate» AS tail_mean FROM tails")
def tail_mean_query(v: Views) -> DataFrame:
    from ..functions.tails import tail_mean

    rows = expanding_stats(clean(v)).where("censored and (fine_n >= 8 or coarse_n >= 8)")
    fine = F.col("fine_n") >= 8
    mean = F.when(fine, F.col("fine_mean")).otherwise(F.col("coarse_mean"))
    variance = F.coalesce(F.when(fine, F.col("fine_var")).otherwise(F.col("coarse_var")), F.lit(0.0))
    rows = rows.select(*KEY, F.col("demand").cast("double").alias("cap"), mean.alias("mean"), variance.alias("variance"))
    return rows.withColumn("tail_mean", tail_mean(F.col("mean"), F.col("variance"), F.col("cap")))


@query("unconstrain", f"SELECT {KEYS}, «demand» AS demand, censored FROM unconstrained")
def unconstrain_query(v: Views) -> DataFrame:
    return unconstrain(clean(v))


# ---- checks against the truth


@query(
    "oracle_actual",
    f"""SELECT {KEYS}, CAST(CASE WHEN censored THEN true_demand ELSE demand END AS DOUBLE) AS demand
        FROM truth_cells""",
)
def oracle_actual(v: Views) -> DataFrame:
    base = staged_clean(v)
    return scoring.oracle_actual(base, truth_of(base))


@query(
    "touching_folds",
    """SELECT DISTINCT restaurant_id, fold, item_id FROM clean_demand JOIN end_folds USING (restaurant_id)
       WHERE censored AND business_date BETWEEN test_start AND test_end""",
)
def touching_folds(v: Views) -> DataFrame:
    base = staged_clean(v)
    return scoring.touching_folds(base, fold_ops.tail_folds(base))


MAE = """SELECT restaurant_id, '{name}' AS series, «avg(abs(coalesce(d.demand, 0) - true_demand))» AS mae,
  «avg(coalesce(d.demand, 0) - true_demand)» AS bias, count(*) AS n
FROM truth_demand t LEFT JOIN {view} d USING (""" + KEYS + ") GROUP BY 1"


@query("mae_bias", MAE.format(name="clean", view="clean_demand"))
def mae_bias(v: Views) -> DataFrame:
    base = staged_clean(v)
    return scoring.mae_bias(base, truth_of(base)).withColumn("series", F.lit("clean"))


@query("cleaning_gap", MAE.format(name="clean", view="clean_demand") + " UNION ALL " + MAE.format(name="dirty", view="observed_demand"))
def cleaning_gap(v: Views) -> DataFrame:
    base = staged_clean(v)
    truth = truth_of(base)
    parts = {"clean": base, "dirty": observed(v)}
    scored = [scoring.mae_bias(d, truth).withColumn("series", F.lit(name)) for name, d in parts.items()]
    return scored[0].unionByName(scored[1])


@query(
    "unconstrain_gap",
    f"""SELECT restaurant_id, count(*) AS n_observable_rows, «avg(abs(c.demand - true_demand))» AS capped_mae,
          «avg(c.demand - true_demand)» AS capped_bias, «avg(abs(u.demand - true_demand))» AS recovered_mae,
          «avg(u.demand - true_demand)» AS recovered_bias, any_value(n_total) AS n_total_truth_stockouts
        FROM clean_demand c JOIN truth_stockouts USING ({KEYS}) JOIN unconstrained u USING ({KEYS})
        JOIN (SELECT restaurant_id, count(*) AS n_total FROM truth_stockouts GROUP BY 1) n USING (restaurant_id)
        WHERE c.censored GROUP BY 1""",
)
def unconstrain_gap(v: Views) -> DataFrame:
    base = staged_clean(v)
    return scoring.unconstrain_gap(base, unconstrain(base), stockouts_of(base))


# ---- ingredient use


DEPLETION = f"""SELECT restaurant_id, ingredient_id, order_day, :total AS depleted_qty FROM (
          SELECT restaurant_id, item_id, demand AS portions,
            CASE WHEN isodow(business_date) IN (1, 4) THEN business_date
                 WHEN isodow(business_date) < 4 THEN CAST(business_date + CAST(4 - isodow(business_date) AS INTEGER) AS DATE)
                 ELSE CAST(business_date + CAST(8 - isodow(business_date) AS INTEGER) AS DATE) END AS order_day
          FROM clean_demand) d JOIN (
          SELECT lower(p_type) AS item_id, {norm("p_brand")} AS ingredient_id, min(p_size) / 10.0::DOUBLE AS qty_per_portion
          FROM part GROUP BY 1, 2) r USING (item_id) GROUP BY ALL"""


def depletion(v: Views) -> DataFrame:
    from ..functions.text import normalize_name

    recipes = v.table("part").groupBy(
        F.lower("p_type").alias("item_id"), normalize_name(F.col("p_brand")).alias("ingredient_id")
    ).agg((F.min("p_size") / 10.0).alias("qty_per_portion"))
    tenants = F.explode(F.array(F.lit("r0"), F.lit("r1"))).alias("restaurant_id")
    return exogenous.ingredient_depletion(clean(v), recipes.select(tenants, "*"))


@query("ingredient_depletion", DEPLETION.replace(":total", "«sum(portions * qty_per_portion)»"))
def ingredient_depletion(v: Views) -> DataFrame:
    return depletion(v)


@query(
    "depletion_cost",
    f"""SELECT d.restaurant_id, d.ingredient_id, d.order_day, p.observed_date, «p.unit_price» AS unit_price,
          «d.depleted_qty» AS depleted_qty, «d.depleted_qty * p.unit_price» AS cost
        FROM ({DEPLETION.replace(":total", "sum(portions * qty_per_portion)")}) d ASOF LEFT JOIN (
          SELECT restaurant_id, ingredient_id, observed_date, unit_price FROM price_observations
          QUALIFY row_number() OVER (PARTITION BY restaurant_id, ingredient_id, observed_date ORDER BY seq DESC, unit_price DESC) = 1) p
        ON d.restaurant_id = p.restaurant_id AND d.ingredient_id = p.ingredient_id AND d.order_day >= p.observed_date""",
)
def depletion_cost(v: Views) -> DataFrame:
    """What each order of an ingredient cost at the price known on the order day."""
    used = stage(depletion(v), "depletion")
    priced = pricing.price_on(used, v.price_observations, "order_day")
    return priced.withColumn("cost", F.col("depleted_qty") * F.col("unit_price"))


@query(
    "tenant_era_asof",
    """WITH own AS (SELECT restaurant_id, CAST(start_date + CASE restaurant_id WHEN 'r0' THEN 0 ELSE 45 END AS DATE) AS start_date, era_id
         FROM menu_eras, (SELECT unnest(['r0', 'r1']) AS restaurant_id) b),
       days AS (SELECT restaurant_id, business_date, count(*) AS n_lines FROM pos_sales GROUP BY 1, 2),
       first AS (SELECT restaurant_id, min(start_date) AS start_date, arg_min(era_id, start_date) AS era_id FROM own GROUP BY 1)
       SELECT d.restaurant_id, d.business_date, d.n_lines, coalesce(o.era_id, f.era_id) AS era_id,
         CAST(greatest(0, d.business_date - coalesce(o.start_date, f.start_date)) AS INTEGER) AS era_days_elapsed
       FROM days d ASOF LEFT JOIN own o ON d.restaurant_id = o.restaurant_id AND d.business_date >= o.start_date
       JOIN first f ON f.restaurant_id = d.restaurant_id""",
)
def tenant_era_asof(v: Views) -> DataFrame:
    """Lines a day under each tenant's own menu reprints; r1 reprints 45 days later."""
    late = F.when(F.col("restaurant_id") == "r0", 0).otherwise(45)
    tenants = F.explode(F.array(F.lit("r0"), F.lit("r1"))).alias("restaurant_id")
    own = v.menu_eras.select(tenants, "start_date", "era_id").withColumn("start_date", F.date_add("start_date", late))
    days = v.pos_sales.groupBy("restaurant_id", "business_date").agg(F.count("*").alias("n_lines"))
    return features.era_asof(stage(days, "days"), own)
