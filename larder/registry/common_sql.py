"""Shared SQL views, written independently of the Spark code, for checking results in DuckDB.

``compose`` puts the views a statement mentions in front of it as common table expressions.
``«x»`` stands for x rounded to six decimals.
"""
from __future__ import annotations

import re

from ..sources.driver_views import MENU_ERAS


def norm(x: str) -> str:
    return rf"lower(regexp_replace({x}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g'))"


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"


VOID = "coalesce(lower(void_flag) IN ('true', '1'), false)"
COMP = "coalesce(lower(comp_flag) IN ('true', '1'), false)"
ANOMALY = f"(qty = 0 AND NOT {VOID} AND NOT {COMP})"
STAFF = "coalesce(server_id IN ('S001', 'S002'), false)"
BOTH = "(SELECT unnest(['r0', 'r1']) AS restaurant_id)"
KEYS = "restaurant_id, business_date, item_id, service_period"
SERIES = "restaurant_id, item_id, service_period"

VIEWS: dict[str, str] = {}

VIEWS["lines"] = """
SELECT *, 'r' || CAST(l_suppkey % 2 AS VARCHAR) AS restaurant_id, CAST(l_shipdate AS DATE) AS business_date,
       (l_orderkey * 8 + l_linenumber) * 1000000 + (l_partkey * 1000 + l_suppkey) % 1000000 AS seq
FROM lineitem JOIN part ON l_partkey = p_partkey
"""
VIEWS["pos_sales"] = """
SELECT restaurant_id, 'C' || CAST(l_orderkey AS VARCHAR) AS check_id,
       concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(business_date AS VARCHAR)) AS line_id,
       business_date,
       CAST(business_date AS TIMESTAMP) + to_hours(11 + l_orderkey % 11) AS sold_at,
       CASE l_orderkey % 3 WHEN 0 THEN p_type WHEN 1 THEN 'House ' || p_type ELSE p_type || ' plate' END AS item_name,
       p_brand AS category, p_retailprice AS menu_price,
       CASE WHEN l_orderkey % 97 = 0 THEN 0 ELSE CAST(l_quantity AS INTEGER) END AS qty,
       CAST(NULL AS VARCHAR) AS modifiers, l_extendedprice * l_discount AS discount_amount,
       CASE WHEN l_discount >= 0.09::DOUBLE THEN 'True' END AS comp_flag,
       CASE WHEN l_orderkey % 61 = 0 THEN 'True' WHEN l_orderkey % 67 = 0 THEN '1' ELSE 'False' END AS void_flag,
       'S' || lpad(CAST(l_suppkey % 10 AS VARCHAR), 3, '0') AS server_id
FROM lines
"""
VIEWS["eightysix_log"] = """
SELECT restaurant_id, business_date, item_name, CAST(hour(sold_at) AS VARCHAR) || ':30' AS time_86d
FROM pos_sales WHERE CAST(substr(check_id, 2) AS BIGINT) % 53 = 7
"""
VIEWS["item_aliases"] = f"""
SELECT b.restaurant_id, lower(p_type) AS item_id, alias
FROM (SELECT DISTINCT p_type FROM part) p, {BOTH} b,
     LATERAL (SELECT unnest([p_type, 'House ' || p_type, p_type || ' plate']) AS alias) names
"""
VIEWS["menu_eras"] = f"SELECT * FROM (VALUES {MENU_ERAS}) AS t(start_date, era_id)"
VIEWS["item_economics"] = f"""
SELECT b.restaurant_id, lower(p_type) AS item_id,
  CASE k % 3 WHEN 1 THEN upper(p_type) WHEN 2 THEN 'House ' || upper(p_type) ELSE ' ' || lower(p_type) END AS name,
  CASE WHEN k % 3 = 0 THEN 'made_to_order' ELSE 'batch' END AS prep_type,
  3.0::DOUBLE + price % 1100 / 100.0::DOUBLE AS co, 4.0::DOUBLE + price % 1700 / 100.0::DOUBLE AS cu,
  CASE WHEN k % 4 = 0 THEN 2 ELSE 1 END AS lead_time_days, CASE WHEN k % 7 = 0 THEN 'braise starts the prior afternoon' END AS notes
FROM (SELECT p_type, ascii(p_type) + length(p_type) AS k, CAST(sum(CAST(round_even(p_retailprice * 100, 0) AS BIGINT)) // count(*) AS BIGINT) AS price
      FROM part GROUP BY p_type) t, {BOTH} b
"""
VIEWS["kept_lines"] = f"SELECT * FROM pos_sales WHERE NOT {ANOMALY} AND NOT {VOID} AND NOT {STAFF}"
VIEWS["unvoided_lines"] = f"SELECT * FROM pos_sales WHERE NOT {VOID}"


def _grid(lines: str, periods: str) -> str:
    return f"""
SELECT d.restaurant_id, d.business_date, i.item_id, p.service_period, CAST(coalesce(s.demand, 0) AS BIGINT) AS demand
FROM (SELECT DISTINCT restaurant_id, business_date FROM {lines}) d
JOIN (SELECT DISTINCT restaurant_id, item_id FROM item_aliases) i USING (restaurant_id)
JOIN ({periods}) p USING (restaurant_id)
LEFT JOIN (
  SELECT l.restaurant_id, business_date, item_id,
         CASE WHEN hour(sold_at) < 16 THEN 'lunch' ELSE 'dinner' END AS service_period, sum(qty) AS demand
  FROM {lines} l JOIN item_aliases a ON a.restaurant_id = l.restaurant_id AND a.alias = l.item_name
  GROUP BY ALL
) s ON s.restaurant_id = d.restaurant_id AND s.business_date = d.business_date
   AND s.item_id = i.item_id AND s.service_period = p.service_period
"""


VIEWS["observed_demand"] = _grid(
    "unvoided_lines",
    "SELECT DISTINCT restaurant_id, CASE WHEN hour(sold_at) < 16 THEN 'lunch' ELSE 'dinner' END AS service_period "
    "FROM unvoided_lines",
)
VIEWS["clean_grid"] = _grid(
    "kept_lines", f"SELECT restaurant_id, unnest(['dinner', 'lunch']) AS service_period FROM {BOTH} b"
)
VIEWS["censored_keys"] = """
SELECT DISTINCT e.restaurant_id, business_date, item_id,
       CASE WHEN CAST(split_part(time_86d, ':', 1) AS INTEGER) < 16 THEN 'lunch' ELSE 'dinner' END AS service_period
FROM eightysix_log e JOIN item_aliases a ON a.restaurant_id = e.restaurant_id AND a.alias = e.item_name
"""
VIEWS["clean_demand"] = f"""
SELECT g.*, c.restaurant_id IS NOT NULL AS censored
FROM clean_grid g LEFT JOIN censored_keys c USING ({KEYS})
"""
VIEWS["truth_cells"] = f"""
SELECT {KEYS}, demand, censored, demand + CASE WHEN censored THEN 3 ELSE 0 END AS true_demand FROM clean_demand
"""
VIEWS["truth_demand"] = f"""
SELECT {KEYS}, true_demand FROM truth_cells
"""
VIEWS["item_caps"] = f"""
SELECT restaurant_id, item_id, CAST(sum(demand) * 2 // count(*) AS BIGINT) AS cap FROM clean_demand GROUP BY ALL
"""
VIEWS["truth_stockouts"] = f"""
SELECT {KEYS}, CAST(round_even(cap * 0.94::DOUBLE, 0) AS BIGINT) AS cap, true_demand, demand AS observed_demand
FROM truth_demand JOIN clean_demand USING ({KEYS}) JOIN item_caps USING (restaurant_id, item_id)
WHERE censored OR true_demand > round_even(cap * 0.94::DOUBLE, 0)
"""


def _folds(source: str, train_days: str, stretch: bool) -> str:
    stretched = "CASE WHEN fold = 3 THEN greatest(to_day, last_day) ELSE to_day END" if stretch else "to_day"
    return f"""
SELECT restaurant_id, fold,
       min(business_date) FILTER (business_date < from_day) AS train_start,
       max(business_date) FILTER (business_date < from_day) AS train_end,
       min(business_date) FILTER (business_date BETWEEN from_day AND last_test) AS test_start,
       max(business_date) FILTER (business_date BETWEEN from_day AND last_test) AS test_end
FROM (
  SELECT *, {stretched} AS last_test FROM (
    SELECT restaurant_id, last_day, CAST(f.fold AS INTEGER) AS fold,
           first_day + CAST({train_days} + f.fold * 28 AS INTEGER) AS from_day,
           first_day + CAST({train_days} + f.fold * 28 + 27 AS INTEGER) AS to_day
    FROM (SELECT restaurant_id, min(business_date) AS first_day, max(business_date) AS last_day FROM {source} GROUP BY 1) s,
         range(4) f(fold)
  ) x
) w JOIN (SELECT DISTINCT restaurant_id, business_date FROM {source}) d USING (restaurant_id)
GROUP BY restaurant_id, fold
"""


_TAIL_DAYS = "(greatest(1, ((last_day - first_day + 1) - 112) // 7) * 7)"
VIEWS["folds"] = _folds("clean_demand", "84", False)
VIEWS["dirty_folds"] = _folds("observed_demand", "84", False)
VIEWS["end_folds"] = _folds("clean_demand", _TAIL_DAYS, True)


def _naive(demand: str, folds: str) -> str:
    """lag7, rolling28, chef_gut per target cell."""
    return f"""
SELECT {KEYS}, fold, train_end, test_start, test_end, actual, lag7, rolling28,
       greatest(round_even(rolling28 / 5.0::DOUBLE, 0) * 5, 0) AS chef_gut
FROM (
  SELECT t.restaurant_id, t.business_date, t.item_id, t.service_period, f.fold, f.train_end, f.test_start, f.test_end,
         CAST(t.demand AS DOUBLE) AS actual,
         coalesce(arg_min(CAST(h.demand AS DOUBLE), (t.business_date - h.business_date)) FILTER (t.business_date - h.business_date <= 49),
                  any_value(m.mean), 0) AS lag7,
         coalesce(avg(h.demand) FILTER (t.business_date - h.business_date <= 28), any_value(m.mean), 0) AS rolling28
  FROM {demand} t
  JOIN {folds} f ON f.restaurant_id = t.restaurant_id AND t.business_date BETWEEN f.test_start AND f.test_end
  LEFT JOIN {demand} h ON h.restaurant_id = t.restaurant_id AND h.item_id = t.item_id AND h.service_period = t.service_period
       AND h.business_date <= f.train_end AND h.business_date >= t.business_date - 49
       AND (t.business_date - h.business_date) % 7 = 0
  LEFT JOIN (
    SELECT {SERIES}, fold, avg(demand) AS mean
    FROM {demand} JOIN {folds} USING (restaurant_id) WHERE business_date <= train_end GROUP BY ALL
  ) m ON m.restaurant_id = t.restaurant_id AND m.item_id = t.item_id AND m.service_period = t.service_period AND m.fold = f.fold
  GROUP BY ALL
) x
"""


VIEWS["naive"] = _naive("clean_demand", "folds")
VIEWS["dirty_naive"] = _naive("observed_demand", "dirty_folds")
VIEWS["croston_days"] = f"""
SELECT {SERIES}, fold, business_date, demand,
       row_number() OVER (PARTITION BY {SERIES}, fold ORDER BY business_date) - 1 AS pos
FROM clean_demand JOIN folds USING (restaurant_id) WHERE business_date <= train_end
"""
VIEWS["croston_hits"] = f"""
SELECT *, pos - coalesce(lag(pos) OVER w, 0) AS gap, row_number() OVER w AS j, count(*) OVER (PARTITION BY {SERIES}, fold) AS n
FROM croston_days WHERE demand > 0 WINDOW w AS (PARTITION BY {SERIES}, fold ORDER BY pos)
"""
VIEWS["croston_gaps"] = f"""
SELECT {SERIES}, fold, gap, row_number() OVER (PARTITION BY {SERIES}, fold ORDER BY pos) - 1 AS g,
       count(*) OVER (PARTITION BY {SERIES}, fold) AS n_gaps
FROM croston_hits WHERE gap > 0
"""
VIEWS["croston_rates"] = f"""
SELECT {SERIES}, fold, size / greatest(gap, 1) AS rate FROM (
  SELECT {SERIES}, h.fold,
         sum(0.1::DOUBLE * pow(0.9::DOUBLE, n - j) * demand) + max(pow(0.9::DOUBLE, n)) * max(demand) FILTER (j = 1) AS size,
         sum(0.1::DOUBLE * pow(0.9::DOUBLE, n - j) * coalesce(x.gap, 1)) + max(pow(0.9::DOUBLE, n)) AS gap
  FROM croston_hits h LEFT JOIN (
    SELECT *, max(n_gaps) OVER (PARTITION BY {SERIES}, fold) AS top FROM croston_gaps
  ) x USING ({SERIES}, fold)
  WHERE x.g IS NULL OR x.g = least(h.pos, x.top - 1)
  GROUP BY {SERIES}, h.fold
) z
"""


def _scored(forecast_rows: str) -> str:
    return f"""
SELECT s.restaurant_id, s.fold, s.model, s.business_date, s.item_id, s.service_period, s.train_end, s.test_start, s.test_end,
       s.forecast, s.actual, e.co, e.cu,
       e.co * greatest(0, s.forecast - s.actual) + e.cu * greatest(0, s.actual - s.forecast) AS dollar_cost
FROM ({forecast_rows}) s LEFT JOIN item_economics e USING (restaurant_id, item_id)
"""


def _scores(scored: str) -> str:
    return f"""
SELECT restaurant_id, fold, model, item_id, max(train_end) AS train_end, max(test_start) AS test_start,
       max(test_end) AS test_end, sum(dollar_cost) AS dollar_cost,
       CASE WHEN sum(abs(actual)) > 0 THEN sum(abs(forecast - actual)) / sum(abs(actual)) END AS wape,
       avg(forecast - actual) AS bias, count(DISTINCT business_date) AS n_days
FROM {scored} WHERE co IS NOT NULL GROUP BY ALL
"""


def _unpivot(view: str) -> str:
    return f"""SELECT {KEYS}, fold, train_end, test_start, test_end, actual, model, forecast
FROM {view} UNPIVOT (forecast FOR model IN (lag7, rolling28, chef_gut))"""


VIEWS["scored"] = _scored(_unpivot("(SELECT * REPLACE (CAST(lag7 AS DOUBLE) AS lag7) FROM naive)"))
VIEWS["dirty_scored"] = _scored(_unpivot("(SELECT * REPLACE (CAST(lag7 AS DOUBLE) AS lag7) FROM dirty_naive)"))
VIEWS["scores"] = _scores("scored")
VIEWS["dirty_scores"] = _scores("dirty_scored")


def _best(scores: str) -> str:
    return f"""
SELECT restaurant_id, arg_min(model, (round(total_cost, 6), model)) AS best_model, min(total_cost) AS best_cost
FROM (SELECT restaurant_id, model, sum(dollar_cost) AS total_cost FROM {scores} GROUP BY ALL) t GROUP BY restaurant_id
"""


VIEWS["best_clean"] = _best("scores")
VIEWS["best_dirty"] = _best("dirty_scores")

VIEWS["era_days"] = """
SELECT d.business_date, coalesce(arg_max(e.era_id, e.start_date), any_value(f.era_id)) AS era_id,
       CAST(greatest(0, d.business_date - coalesce(max(e.start_date), any_value(f.start_date))) AS INTEGER) AS era_days_elapsed
FROM (SELECT DISTINCT business_date FROM clean_demand) d
LEFT JOIN menu_eras e ON e.start_date <= d.business_date,
(SELECT era_id, start_date FROM menu_eras ORDER BY start_date LIMIT 1) f
GROUP BY d.business_date
"""


def past(keys: str) -> str:
    frames = [
        ("lag_1", "max(y) OVER (s RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING)"),
        ("lag_7", "max(y) OVER (s RANGE BETWEEN INTERVAL 7 DAY PRECEDING AND INTERVAL 7 DAY PRECEDING)"),
        ("lag_14", "max(y) OVER (s RANGE BETWEEN INTERVAL 14 DAY PRECEDING AND INTERVAL 14 DAY PRECEDING)"),
        ("rolling_mean_7", "avg(y) OVER (s RANGE BETWEEN INTERVAL 7 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING)"),
        ("rolling_std_7", "stddev_samp(y) OVER (s RANGE BETWEEN INTERVAL 7 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING)"),
        ("rolling_mean_28", "avg(y) OVER (s RANGE BETWEEN INTERVAL 28 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING)"),
    ]
    window = f"PARTITION BY {keys} ORDER BY business_date"
    return ", ".join(f"{expr.replace('(s RANGE', f'({window} RANGE')} AS {name}" for name, expr in frames)


CALENDAR = """CAST(isodow(business_date) - 1 AS INTEGER) AS day_of_week,
       CASE WHEN isodow(business_date) >= 6 THEN 1 ELSE 0 END AS is_weekend,
       CAST(weekofyear(business_date) AS INTEGER) AS week_of_year, CAST(month(business_date) AS INTEGER) AS month"""
FEATURES = """item_id, service_period, day_of_week, is_weekend, week_of_year, month, era_id, era_days_elapsed,
       «lag_1» AS lag_1, «lag_7» AS lag_7, «lag_14» AS lag_14, «rolling_mean_7» AS rolling_mean_7,
       «rolling_std_7» AS rolling_std_7, «rolling_mean_28» AS rolling_mean_28"""
VIEWS["past_all"] = f"SELECT *, {past(SERIES)} FROM (SELECT *, CAST(demand AS DOUBLE) AS y FROM clean_demand) d"

VIEWS["expanding"] = f"""
SELECT *, CAST(isodow(business_date) - 1 AS INTEGER) AS day_of_week,
  avg(u) OVER c AS coarse_mean, var_samp(u) OVER c AS coarse_var, count(u) OVER c AS coarse_n,
  avg(u) OVER f AS fine_mean, var_samp(u) OVER f AS fine_var, count(u) OVER f AS fine_n
FROM (SELECT *, CASE WHEN NOT censored THEN CAST(demand AS DOUBLE) END AS u FROM clean_demand) d
WINDOW c AS (PARTITION BY {SERIES} ORDER BY business_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
       f AS (PARTITION BY {SERIES}, isodow(business_date) ORDER BY business_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
"""
VIEWS["tail_inputs"] = f"""
SELECT {KEYS}, CAST(demand AS DOUBLE) AS cap,
       CASE WHEN fine_n >= 8 THEN fine_mean ELSE coarse_mean END AS m,
       coalesce(CASE WHEN fine_n >= 8 THEN fine_var ELSE coarse_var END, 0) AS v
FROM expanding WHERE censored AND (fine_n >= 8 OR coarse_n >= 8)
"""


def tail_sql(source: str, keys: str) -> str:
    """E[D | D > cap] by summing exact probabilities from lgamma; ``source`` has keys, cap, m, v."""
    return f"""
SELECT {keys}, any_value(cap) AS cap, any_value(m) AS m, any_value(v) AS v,
  CASE WHEN any_value(m) <= 0 THEN any_value(cap)
       WHEN coalesce(sum(p) FILTER (k > cap), 0) < 1e-9 THEN any_value(cap) + 1
       ELSE sum(k * p) FILTER (k > cap) / sum(p) FILTER (k > cap) END AS estimate
FROM (
  SELECT s.*, ks.k,
    CASE WHEN v > m THEN exp(lgamma(k + m * m / (v - m)) - lgamma(k + 1) - lgamma(m * m / (v - m))
                             + (m * m / (v - m)) * ln(m / v) + k * ln(1 - m / v))
         WHEN m > 0 THEN exp(k * ln(m) - m - lgamma(k + 1)) ELSE 0 END AS p
  FROM {source} s, LATERAL (SELECT unnest(range(CAST(s.cap AS BIGINT) + 1, CAST(s.cap AS BIGINT) + 200 + CAST(10 * s.m + 10 * sqrt(s.v) + CASE WHEN s.m > 0 THEN 60 * s.v / s.m ELSE 0 END AS BIGINT))) AS k) ks
) x GROUP BY {keys}
"""


VIEWS["tails"] = tail_sql("tail_inputs", KEYS)
VIEWS["unconstrained"] = f"""
SELECT {KEYS}, greatest(CAST(d.demand AS DOUBLE), coalesce(t.estimate, 0)) AS demand, d.censored
FROM clean_demand d LEFT JOIN tails t USING ({KEYS})
"""

VIEWS["levels"] = """
SELECT restaurant_id, quantile FROM (SELECT DISTINCT restaurant_id FROM item_economics) r,
  LATERAL (SELECT unnest([0.05, 0.10, 0.25, 0.50, 0.75, 0.90, 0.95, 0.99]::DOUBLE[]) AS quantile) q
UNION SELECT restaurant_id, round(cu / (co + cu), 6) FROM item_economics
"""
VIEWS["batch_levels"] = """
SELECT restaurant_id, quantile FROM (SELECT DISTINCT restaurant_id FROM item_economics) r,
  LATERAL (SELECT unnest([0.05, 0.10, 0.25, 0.50, 0.75, 0.90, 0.95, 0.99]::DOUBLE[]) AS quantile) q
UNION SELECT restaurant_id, round(cu / (co + cu), 6) FROM item_economics WHERE prep_type = 'batch'
"""
VIEWS["train_end_anchored"] = f"""
SELECT u.*, f.fold, isodow(business_date) AS dow FROM unconstrained u JOIN end_folds f USING (restaurant_id)
WHERE business_date <= train_end
"""
VIEWS["end_samples"] = f"""
SELECT c.restaurant_id, c.item_id, c.service_period, c.fold, dow, CASE WHEN len(f.ys) >= 8 THEN f.ys ELSE c.ys END AS ys
FROM (SELECT {SERIES}, fold, list_sort(list(demand)) AS ys FROM train_end_anchored GROUP BY ALL) c
CROSS JOIN (SELECT unnest(range(1, 8)) AS dow) w
LEFT JOIN (SELECT {SERIES}, fold, dow, list_sort(list(demand)) AS ys FROM train_end_anchored GROUP BY ALL) f
  USING ({SERIES}, fold, dow)
"""


def interp(ys: str, q: str) -> str:
    place = f"({q} * (len({ys}) - 1))"
    lo = f"CAST(floor({place}) AS BIGINT)"
    return (
        f"({ys}[{lo} + 1] + ({ys}[least({lo} + 2, len({ys}))] - {ys}[{lo} + 1]) * ({place} - floor({place})))"
    )


VIEWS["end_cells"] = f"""
SELECT {KEYS}, fold, train_end, test_start, test_end, demand AS actual
FROM unconstrained JOIN end_folds USING (restaurant_id) WHERE business_date BETWEEN test_start AND test_end
"""
VIEWS["quantile_forecasts"] = f"""
SELECT {KEYS}, fold, quantile, greatest(x, 0) AS forecast
FROM end_cells c JOIN (
  SELECT {SERIES}, fold, dow, quantile, {interp("ys", "quantile")} AS x FROM end_samples JOIN levels USING (restaurant_id)
) q USING ({SERIES}, fold) WHERE dow = isodow(business_date)
"""
VIEWS["anchors"] = f"""
SELECT {KEYS}, fold, quantile AS level, forecast AS value FROM quantile_forecasts
UNION ALL
SELECT {KEYS}, fold, 0, 0 FROM quantile_forecasts GROUP BY ALL HAVING arg_min(forecast, quantile) > 0
"""
VIEWS["prep"] = f"""
SELECT {KEYS}, fold, r, CASE
    WHEN below IS NULL THEN above.value WHEN above IS NULL THEN below.value
    WHEN above.level = below.level THEN below.value
    ELSE below.value + (above.value - below.value) * (r - below.level) / (above.level - below.level) END AS prep
FROM (
  SELECT {KEYS}, fold, any_value(cu / (co + cu)) AS r,
    max({{level: level, value: value}}) FILTER (level <= cu / (co + cu)) AS below,
    min({{level: level, value: value}}) FILTER (level > cu / (co + cu)) AS above
  FROM anchors JOIN item_economics USING (restaurant_id, item_id) GROUP BY {KEYS}, fold
) b
"""
VIEWS["segments"] = f"""
SELECT * FROM (
  SELECT *, lag(level) OVER w AS q0, lag(value) OVER w AS x0 FROM anchors
  WINDOW w AS (PARTITION BY {KEYS}, fold ORDER BY level)
) s WHERE q0 IS NOT NULL
"""
VIEWS["waste"] = f"""
SELECT {KEYS}, fold, any_value(r) AS r, any_value(prep) AS prep, min(x0) AS x_min, max(value) AS x_max,
  sum(q0 * w + CASE WHEN value > x0 THEN (level - q0) / (value - x0) ELSE 0 END * w * w / 2) AS waste,
  sum(q0 * (value - x0) + (level - q0) * (value - x0) / 2) AS full_area
FROM (SELECT *, greatest(least(prep, value) - x0, 0) AS w FROM segments JOIN prep USING ({KEYS}, fold)) s
GROUP BY {KEYS}, fold
"""
VIEWS["pit"] = f"""
SELECT {KEYS}, fold, CASE WHEN above IS NULL OR above.value = below.value THEN below.level
    ELSE below.level + (above.level - below.level) * (y - below.value) / (above.value - below.value) END AS pit
FROM (
  SELECT {KEYS}, fold, any_value(y) AS y,
    max({{value: value, level: level}}) FILTER (value <= y) AS below,
    min({{value: value, level: level}}) FILTER (value > y) AS above
  FROM anchors JOIN (
    SELECT {KEYS}, fold, least(greatest(any_value(CAST(true_demand AS DOUBLE)), min(value)), max(value)) AS y
    FROM anchors JOIN truth_demand USING ({KEYS}) GROUP BY {KEYS}, fold
  ) t USING ({KEYS}, fold)
  GROUP BY {KEYS}, fold
) b
"""
VIEWS["last_train"] = """
SELECT t.* FROM train_end_anchored t WHERE fold = 3
"""
VIEWS["split"] = """
SELECT restaurant_id, min(business_date) AS split_day FROM (
  SELECT *, row_number() OVER (PARTITION BY restaurant_id ORDER BY business_date) - 1 AS place,
         count(*) OVER (PARTITION BY restaurant_id) AS n
  FROM (SELECT DISTINCT restaurant_id, business_date FROM last_train) d
) x WHERE place >= floor(n * 0.8::DOUBLE) GROUP BY 1
"""
VIEWS["band"] = f"""
SELECT {SERIES}, dow, {interp("ys", "0.1::DOUBLE")} AS lo, {interp("ys", "0.9::DOUBLE")} AS hi FROM (
  SELECT {SERIES}, dow, list_sort(list(demand)) AS ys FROM last_train JOIN split USING (restaurant_id)
  WHERE business_date < split_day GROUP BY ALL
) s
"""
VIEWS["widen"] = f"""
SELECT restaurant_id, score FROM (
  SELECT restaurant_id, round(greatest(lo - demand, demand - hi), 9) AS score,
         row_number() OVER (PARTITION BY restaurant_id ORDER BY greatest(lo - demand, demand - hi)) AS place,
         count(*) OVER (PARTITION BY restaurant_id) AS n
  FROM last_train JOIN split USING (restaurant_id) JOIN band USING ({SERIES}, dow) WHERE business_date >= split_day
) x WHERE place = least(ceil(round((n + 1) * 0.8::DOUBLE, 9)), n)
"""
VIEWS["conformal"] = f"""
SELECT restaurant_id, 0.8::DOUBLE AS confidence_level,
       avg(CASE WHEN true_demand BETWEEN lower AND upper THEN 1 ELSE 0 END) AS empirical_coverage,
       count(*) AS n, avg(upper - lower) AS mean_interval_width
FROM (
  SELECT {KEYS}, greatest(lo - score, 0) AS lower, greatest(hi + score, 0) AS upper
  FROM end_cells JOIN band USING ({SERIES}) JOIN widen USING (restaurant_id) WHERE fold = 3 AND dow = isodow(business_date)
) i JOIN truth_demand USING ({KEYS}) GROUP BY 1
"""
VIEWS["coverage"] = f"""
SELECT restaurant_id, quantile, quantile AS nominal, avg(CASE WHEN true_demand <= forecast THEN 1 ELSE 0 END) AS empirical, count(*) AS n
FROM quantile_forecasts JOIN truth_demand USING ({KEYS}) GROUP BY restaurant_id, quantile
"""
VIEWS["underage"] = f"""
SELECT restaurant_id, item_id, round(cu / (co + cu), 6) AS q_star, round(1 - round(cu / (co + cu), 6), 6) AS nominal_underage,
       avg(CASE WHEN true_demand > forecast THEN 1 ELSE 0 END) AS empirical_underage, count(*) AS n
FROM quantile_forecasts JOIN item_economics USING (restaurant_id, item_id) JOIN truth_demand USING ({KEYS})
WHERE quantile = round(cu / (co + cu), 6) GROUP BY ALL
"""
VIEWS["newsvendor_scored"] = _scored(f"""
SELECT {KEYS}, fold, train_end, test_start, test_end, actual, 'point_as_mean' AS model, list_avg(ys) AS forecast
FROM end_cells JOIN end_samples USING ({SERIES}, fold)
WHERE dow = isodow(business_date) AND item_id IN (SELECT item_id FROM item_economics WHERE prep_type = 'batch')
UNION ALL
SELECT {KEYS}, fold, train_end, test_start, test_end, actual, 'quantile_newsvendor', prep
FROM end_cells JOIN batch_prep USING ({KEYS}, fold)
""")
VIEWS["batch_quantiles"] = f"""
SELECT c.restaurant_id, c.business_date, c.item_id, c.service_period, c.fold, quantile, greatest(x, 0) AS forecast, cu / (co + cu) AS r
FROM end_cells c JOIN (
  SELECT {SERIES}, fold, dow, quantile, {interp("ys", "quantile")} AS x FROM end_samples JOIN batch_levels USING (restaurant_id)
) q USING ({SERIES}, fold) JOIN item_economics e USING (restaurant_id, item_id)
WHERE dow = isodow(c.business_date) AND prep_type = 'batch'
"""
VIEWS["batch_prep"] = f"""
SELECT {KEYS}, fold, CASE WHEN above.q = below.q THEN below.x
    ELSE below.x + (above.x - below.x) * (r - below.q) / (above.q - below.q) END AS prep
FROM (
  SELECT {KEYS}, fold, any_value(r) AS r, max({{q: quantile, x: forecast}}) FILTER (quantile <= r) AS below,
    min({{q: quantile, x: forecast}}) FILTER (quantile >= r) AS above
  FROM batch_quantiles GROUP BY {KEYS}, fold
) b
"""
VIEWS["newsvendor_scores"] = _scores("newsvendor_scored")

VIEWS["kinds"] = "SELECT p_name, p_brand, min(p_size) AS size FROM part GROUP BY ALL"
VIEWS["bom"] = f"""
SELECT {norm("p_name")} AS dish_id, p_name AS dish_name, {norm("p_brand")} AS ingredient_id, p_brand AS ingredient_name,
       CAST(size AS DOUBLE) AS qty,
       CASE WHEN size = 50 THEN 'each' ELSE ['oz', 'lb', 'cup', 'g'][size % 4 + 1] END AS recipe_unit,
       CASE WHEN size = 50 THEN 'g' ELSE ['oz', 'oz', 'fl oz', 'kg'][size % 4 + 1] END AS canonical_unit,
       (50 + size) / 100.0::DOUBLE AS yield_factor, restaurant_id
FROM (
  SELECT p_name, p_brand, size, restaurant_id FROM kinds, {BOTH} b
  UNION ALL SELECT 'new ' || p_name, p_brand, size, restaurant_id FROM kinds, {BOTH} b WHERE p_name LIKE 'old%'
  UNION ALL SELECT p_name, 'Brand#99', min(size), 'r1' FROM kinds WHERE length(p_name) % 4 = 1 GROUP BY p_name
) p
"""
VIEWS["price_observations"] = f"""
SELECT seq, {norm("p_brand")} AS ingredient_id, p_brand AS ingredient_name,
       l_extendedprice / (l_quantity * 40000.0::DOUBLE) AS unit_price,
       CASE WHEN l_orderkey % 10 <> 0 THEN 'INV' || CAST(l_orderkey AS VARCHAR) END AS source_invoice,
       business_date AS observed_date, restaurant_id
FROM lines
"""
VIEWS["sales_export"] = r"""
SELECT seq, CASE WHEN l_orderkey % 2 = 1 THEN ' ' || upper(p_name) || chr(9) ELSE p_name END AS dish_name,
       CAST(l_quantity AS BIGINT) AS count, CAST(date_trunc('week', business_date) AS DATE) AS period_start,
       CAST(date_trunc('week', business_date) AS DATE) + 6 AS period_end, restaurant_id
FROM lines
UNION ALL
SELECT -seq, 'Special ' || p_name, CAST(l_quantity AS BIGINT), CAST(date_trunc('week', business_date) AS DATE),
       CAST(date_trunc('week', business_date) AS DATE) + 6, restaurant_id
FROM lines WHERE l_orderkey % 101 = 0
"""
VIEWS["menu_prices"] = f"""
SELECT restaurant_id, u.dish_name, u.menu_price, u.updated_at FROM (
  SELECT p_name, CAST(sum(CAST(round_even(p_retailprice * 100, 0) AS BIGINT)) // count(*) AS BIGINT) / 100.0::DOUBLE AS price
  FROM part GROUP BY p_name
) p, {BOTH} b, LATERAL (
  SELECT p.p_name AS dish_name, p.price AS menu_price, TIMESTAMP '2024-06-01 09:00:00' AS updated_at
  UNION ALL
  SELECT upper(p.p_name), p.price - 50, TIMESTAMP '2023-06-01 09:00:00' WHERE length(p.p_name) % 3 = 0
) u
"""
VIEWS["saved_prices"] = f"""
SELECT restaurant_id, {norm("dish_name")} AS dish_id, arg_max(menu_price, updated_at) AS menu_price FROM menu_prices GROUP BY ALL
"""
VIEWS["latest"] = """
SELECT restaurant_id, ingredient_id, ingredient_name, unit_price, observed_date FROM price_observations
QUALIFY row_number() OVER (PARTITION BY restaurant_id, ingredient_id ORDER BY observed_date DESC, seq DESC, unit_price DESC) = 1
"""
VIEWS["units"] = """
SELECT * FROM (VALUES ('oz', 'w', 1.0::DOUBLE), ('lb', 'w', 16.0), ('kg', 'w', 35.274), ('g', 'w', 0.035274), ('fl oz', 'v', 1.0),
  ('cup', 'v', 8.0), ('pint', 'v', 16.0), ('qt', 'v', 32.0), ('gal', 'v', 128.0), ('tbsp', 'v', 0.5), ('tsp', 'v', 1.0::DOUBLE / 6),
  ('l', 'v', 33.814), ('ml', 'v', 0.033814)) AS t(unit, family, factor)
"""
VIEWS["bom_lines"] = """
SELECT b.*, p.unit_price,
  CASE WHEN recipe_unit = canonical_unit THEN qty WHEN f.family = t.family THEN qty * f.factor / t.factor END / yield_factor AS line_qty,
  line_qty * unit_price AS line_cost
FROM bom b LEFT JOIN units f ON f.unit = b.recipe_unit LEFT JOIN units t ON t.unit = b.canonical_unit
LEFT JOIN latest p USING (restaurant_id, ingredient_id)
"""
VIEWS["dish_costs"] = """
SELECT restaurant_id, dish_id, min(dish_name) AS dish_name, sum(line_cost) AS cost FROM bom_lines
GROUP BY restaurant_id, dish_id HAVING count(line_cost) = count(*)
"""
VIEWS["covers"] = f"""
SELECT restaurant_id, {norm("dish_name")} AS dish_key, CAST(sum(count) AS BIGINT) AS covers,
       arg_min({strip("dish_name")}, (seq, dish_name)) AS display_name
FROM sales_export GROUP BY ALL
"""
VIEWS["grid_rows"] = f"""
SELECT c.restaurant_id, c.dish_id, c.dish_name, c.cost, m.menu_price, coalesce(s.covers, 0) AS covers,
       m.menu_price - c.cost AS margin, c.cost / m.menu_price AS food_cost_pct
FROM dish_costs c JOIN saved_prices m USING (restaurant_id, dish_id)
LEFT JOIN covers s ON s.restaurant_id = c.restaurant_id AND s.dish_key = {norm("c.dish_name")}
"""


def tier(x: str) -> str:
    return f"CASE WHEN {x} >= 0 AND {x} < 0.25::DOUBLE THEN 'strong' WHEN {x} >= 0 AND {x} < 0.35::DOUBLE THEN 'ok' ELSE 'thin' END"


VIEWS["grid"] = f"""
SELECT g.*, CASE WHEN covers >= mc AND round(margin, 9) >= mm THEN 'Star' WHEN covers >= mc THEN 'Plowhorse'
                 WHEN round(margin, 9) >= mm THEN 'Puzzle' ELSE 'Dog' END AS quadrant,
       {tier("round(food_cost_pct, 9)")} AS food_cost_tier
FROM grid_rows g JOIN (
  SELECT restaurant_id, round(avg(covers), 9) AS mc, round(avg(margin), 9) AS mm FROM grid_rows GROUP BY 1
) a USING (restaurant_id)
"""
VIEWS["shown"] = f"""
SELECT *, {tier("food_share")} AS shown_tier, menu_price - cost_display AS margin_display FROM (
  SELECT *, round_even(cost_display / menu_price * 100, 0) / 100 AS food_share FROM (
    SELECT *, round_even(round(cost, 9) * 4, 0) / 4 AS cost_display FROM grid
  ) a
) b
"""
VIEWS["trend"] = """
SELECT *, (current_price - prior_price) / prior_price AS pct_change,
       CASE WHEN current_price > prior_price THEN 'up' WHEN current_price < prior_price THEN 'down' ELSE 'flat' END AS direction
FROM (
  SELECT l.restaurant_id, l.ingredient_id, l.ingredient_name, l.unit_price AS current_price, p.unit_price AS prior_price,
         l.observed_date AS current_observed_date, p.observed_date AS prior_observed_date
  FROM latest l JOIN price_observations p ON p.restaurant_id = l.restaurant_id AND p.ingredient_id = l.ingredient_id
   AND p.observed_date <= l.observed_date - 7
  QUALIFY row_number() OVER (PARTITION BY l.restaurant_id, l.ingredient_id
                             ORDER BY p.observed_date DESC, p.seq DESC, p.unit_price DESC) = 1
) x
"""
VIEWS["affected"] = """
SELECT m.restaurant_id, m.ingredient_id, m.ingredient_name, m.pct_change, m.direction, m.current_price, m.prior_price,
       m.current_observed_date, m.prior_observed_date, b.dish_id, min(b.dish_name) AS dish_name,
       count(*) = count(b.line_qty * CASE WHEN b.ingredient_id = m.ingredient_id THEN m.prior_price ELSE b.unit_price END) AS costed,
       sum(b.line_qty * CASE WHEN b.ingredient_id = m.ingredient_id THEN m.prior_price ELSE b.unit_price END) AS prior_cost,
       sum(b.line_qty * CASE WHEN b.ingredient_id = m.ingredient_id THEN m.current_price ELSE b.unit_price END) AS new_cost
FROM (SELECT * FROM trend WHERE abs(pct_change) >= 0.10::DOUBLE) m
JOIN (SELECT DISTINCT restaurant_id, ingredient_id, dish_id FROM bom) u
  ON u.restaurant_id = m.restaurant_id AND u.ingredient_id = m.ingredient_id
JOIN bom_lines b ON b.restaurant_id = u.restaurant_id AND b.dish_id = u.dish_id
GROUP BY ALL
"""
VIEWS["moves"] = """
SELECT restaurant_id, ingredient_id, ingredient_name, pct_change, direction,
       count(*) FILTER (costed) AS costed_dish_count, count(*) FILTER (NOT costed) AS uncosted_dish_count,
       sum(abs(new_cost - prior_cost)) FILTER (costed) AS impact,
       CAST(any_value(current_observed_date - prior_observed_date) AS INTEGER) AS days_span
FROM affected GROUP BY ALL HAVING count(*) FILTER (costed) > 0
"""


def _expand(text: str) -> str:
    return re.sub(r"«([^»]*)»", r"(round_even(round_even((\1) * 1e9, 0) / 1e9 * 1e6, 0) / 1e6 + 0::DOUBLE)", text)


def _mentioned(text: str, skip: str = "") -> list[str]:
    words = set(re.findall(r"\b[a-z_]\w*\b", text))
    return [v for v in VIEWS if v in words and v != skip]


def compose(sql: str) -> str:
    """The statement with every view it needs, in dependency order, in front of it."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name in order:
            return
        for other in _mentioned(_from_clauses(VIEWS[name]), name):
            visit(other)
        order.append(name)

    for name in _mentioned(_from_clauses(sql)):
        visit(name)
    head = ",\n".join(f"{name} AS MATERIALIZED ({_expand(VIEWS[name]).strip()})" for name in order)
    body = _expand(sql).strip()
    if not order:
        return body
    if body.startswith("WITH "):
        return f"WITH {head},\n{body.removeprefix('WITH ')}"
    return f"WITH {head}\n{body}"


def _from_clauses(text: str) -> str:
    """Only names that follow FROM, JOIN or a comma-separated table position can be views."""
    return " ".join(re.findall(r"(?:FROM|JOIN)\s+\(?\s*([a-z_]\w*)", text))
