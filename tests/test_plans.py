"""Shape of the physical plans, and what feature and model code may touch."""
import pathlib
import re

import pytest

from larder import registry
from larder.operators import SERIES
from larder.operators.baselines import croston_rates
from larder.operators.quantiles import weekday_samples
from larder.operators.unconstrain import expanding_stats
from larder.sources.staging import stage, stage_by_key

SF = "/root/testdata/sf0.001"
ROOT = pathlib.Path(__file__).resolve().parents[1] / "larder"
registry.load()
QUERIES = registry.QUERIES
SHAPED = [
    "clean_demand", "observed_demand", "unconstrain", "feature_frame", "day_ahead_features", "baseline_lag7", "baseline_croston",
    "fold_scores", "newsvendor_policy", "coverage", "latest_price", "price_trend", "retention", "covers_by_dish", "menu_grid",
    "dish_detail", "opportunities", "data_summary", "validate_sales", "append_prices_dedup", "ingredient_depletion",
    "tenant_era_asof", "depletion_cost",
]


@pytest.mark.parametrize("key", SHAPED)
def test_no_python_rows_no_products_no_global_windows(spark, key):
    plan = QUERIES[key](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"CartesianProduct|BroadcastNestedLoopJoin|BatchEvalPython|ArrowEvalPython|MapInPandas", plan)
    for window in re.findall(r"Window \[.*", plan):
        assert re.search(r"\], \[restaurant_id#\d+", window), window


def test_scan_reads_only_needed_columns(spark):
    plan = QUERIES["clean_demand"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    scans = [s for s in re.findall(r"FileScan parquet \[([^\]]*)\]", plan) if "l_orderkey" in s]
    needed = {"l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_shipdate", "l_discount"}
    assert scans and all({c.split("#")[0] for c in scan.split(",")} <= needed for scan in scans)


def test_model_code_never_reads_truth():
    for name in ("features", "models", "baselines", "unconstrain", "quantiles", "demand", "folds"):
        text = (ROOT / "operators" / f"{name}.py").read_text()
        assert "truth" not in text and "sources" not in text


def test_library_never_collects():
    for path in ROOT.rglob("*.py"):
        if "llm" in path.parts:
            continue  # an optional part with bounded samples of its own
        text = path.read_text()
        if path.name == "boosting.py":  # collects splits, bins and counts, bounded by models x nodes x inputs
            assert not re.search(r"toPandas|localCheckpoint|crossJoin", text)
            continue
        assert not re.search(r"\.collect\(|toPandas|localCheckpoint|crossJoin|\.rdd\b", text), path


def test_series_work_on_keyed_demand_needs_no_exchange(spark):
    """Croston, weekday distributions and history windows read a table staged by series as it lies."""
    days = spark.range(300).selectExpr(
        "'r0' AS restaurant_id", "concat('i', id % 3) AS item_id", "'dinner' AS service_period",
        "date_add(DATE '2024-01-01', cast(id div 3 AS int)) AS business_date", "id % 5 AS demand", "id % 7 = 0 AS censored",
    )
    folds = stage(spark.sql("SELECT 'r0' AS restaurant_id, 0 AS fold, DATE '2024-01-01' AS train_start, DATE '2024-03-01' AS train_end"), "folds")
    keyed, plain = stage_by_key(days, "demand", SERIES), stage(days, "demand")
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("larder_staged")]
    assert sorted(keyed.collect()) == sorted(plain.collect())

    def series_exchanges(df):
        plan = df._jdf.queryExecution().executedPlan().toString()
        return len(re.findall(r"Exchange hashpartitioning\(restaurant_id#\d+, item_id#\d+, service_period#\d+", plan))

    jobs = [lambda d: croston_rates(d, folds), lambda d: weekday_samples(d, folds), expanding_stats]
    for job in jobs:
        assert series_exchanges(job(keyed)) == 0 < series_exchanges(job(plain))
        as_text = [sorted(map(str, job(d).collect())) for d in (keyed, plain)]
        assert as_text[0] == as_text[1]


def test_prep_is_decided_before_targets_are_met(spark):
    """The curves of a series are aggregated per weekday; no aggregate above them is keyed by day."""
    plan = QUERIES["newsvendor_policy"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    curves = [line for line in plan.splitlines() if "Aggregate [" in line and "collect_list(struct(q," in line]
    assert curves and all("business_date" not in line.split("], [")[0] for line in curves)
