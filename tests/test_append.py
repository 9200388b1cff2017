"""The price history in months: what an append touches, repeats, and interrupted appends."""
import datetime as dt
import os

import pytest

from larder.sources import writers
from larder.sources.schemas import LEGS

SCHEMA = LEGS["price_observations"]


def prices(spark, *rows):
    """Rows of (tenant, seq, ingredient, price, invoice, day)."""
    return spark.createDataFrame([(q, i, i.title(), p, inv, day, r) for r, q, i, p, inv, day in rows], SCHEMA)


def held(spark, root):
    columns = ["restaurant_id", "seq", "ingredient_id", "unit_price", "source_invoice", "observed_date"]
    return sorted(map(str, map(tuple, writers.read_price_history(spark, root).select(columns).collect())))


def files(root):
    return {os.path.join(d, f) for d, _, names in os.walk(f"{root}/{writers.HISTORY}") for f in names if f.startswith("part")}


def day(month, d=1):
    return dt.date(2024, month, d)


FIRST = [("r0", 1, "egg", 1.0, "A", day(1)), ("r0", 2, "egg", 1.5, None, day(2)), ("r1", 3, "egg", 1.0, "A", day(2)), ("r1", 4, "oil", 2.0, None, None)]
LATER = [("r0", 9, "egg", 1.5, None, day(2)), ("r0", 10, "oil", 7.0, "B", day(2, 28)), ("r0", 11, "oil", 7.0, "B", day(2, 28))]


def test_only_touched_months_are_rewritten(spark, tmp_path):
    root = str(tmp_path)
    assert held(spark, root) == []
    writers.append_prices(prices(spark, *FIRST), root)
    assert held(spark, root) == sorted(str(r) for r in FIRST)
    before = files(root)
    writers.append_prices(prices(spark, *LATER), root)
    gone = before - files(root)
    assert len(gone) == 1 and all("restaurant_id=r0/month=2024-02" in f for f in gone)
    want = [FIRST[0], FIRST[2], FIRST[3], LATER[0], LATER[2]]
    assert held(spark, root) == sorted(map(str, want))
    assert not os.path.exists(f"{root}/{writers.JOURNAL}")
    writers.append_prices(prices(spark, *LATER), root)
    assert held(spark, root) == sorted(map(str, want))


def test_agrees_with_the_whole_history_merge(spark, tmp_path):
    writers.append_prices(prices(spark, *FIRST), str(tmp_path))
    writers.append_prices(prices(spark, *LATER), str(tmp_path))
    whole = writers.append_prices_dedup(prices(spark, *FIRST), prices(spark, *LATER)).select(SCHEMA.names)
    kept = writers.read_price_history(spark, str(tmp_path)).select(SCHEMA.names)
    assert sorted(map(str, kept.collect())) == sorted(map(str, whole.collect()))


def test_an_interrupted_append_is_finished_or_forgotten(spark, tmp_path, monkeypatch):
    root = str(tmp_path)
    writers.append_prices(prices(spark, *FIRST), root)
    before = held(spark, root)

    # Lost before the marker: the next append knows nothing of it.
    incomplete = f"{root}/{writers.JOURNAL}"
    writers._by_month(prices(spark, ("r0", 99, "egg", 99.0, "X", day(1)))).write.parquet(incomplete)
    os.remove(f"{incomplete}/{writers.MARKER}")
    writers.append_prices(prices(spark, FIRST[0]), root)
    assert held(spark, root) == before

    # Lost after the marker, with the old month already gone: the next append restores it.
    replay, calls = writers._replay, []
    monkeypatch.setattr(writers, "_replay", lambda *a: calls.append(a) or (replay(*a) if len(calls) == 1 else None))
    writers.append_prices(prices(spark, *LATER), root)
    monkeypatch.undo()
    for name in files(root):
        if "restaurant_id=r0/month=2024-02" in name:
            os.remove(name)
    writers.append_prices(prices(spark, ("r1", 20, "egg", 3.0, "C", day(5))), root)
    want = [FIRST[0], FIRST[2], FIRST[3], LATER[0], LATER[2], ("r1", 20, "egg", 3.0, "C", day(5))]
    assert held(spark, root) == sorted(map(str, want))


def test_nothing_to_write_and_unnamed_tenants(spark, tmp_path):
    with pytest.raises(ValueError, match="no price rows"):
        writers.append_prices(prices(spark), str(tmp_path))
    with pytest.raises(ValueError, match="restaurant_id"):
        writers.append_prices(prices(spark, (None, 1, "egg", 1.0, None, day(1))), str(tmp_path))
