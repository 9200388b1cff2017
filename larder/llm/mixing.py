"""Mixing sources to target weights with the cube method.

Every source has a rate, its target by its size. The whole part of the rate is taken of every document;
the fraction left is its inclusion probability. The flight phase moves these probabilities through the
null space of two balancing equations, words and documents, until only a few per group are neither 0
nor 1. Groups are hash buckets of a source; what is left of them meets in larger and larger groups until
one per source remains, where a small landing problem gives up the document count and fits the words.
"""
from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..sources.staging import stage

WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
MOST_COPIES = 2.0
#: Rows of a group in the first flight.
GROUP_ROWS = 8192
#: Smallest documents a group passes on besides the two its flight leaves.
HELD_BACK = 14
#: Probabilities this close to 0 or 1 are 0 or 1.
NEAR = 1e-9


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit("[^\\x20\\x09-\\x0D]+")).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST_COPIES) -> DataFrame:
    """One row per source: source, rank, n, source_size, target.

    Sources sorted by code point, null last, take the weights in turn. Sources are filled in proportion
    to their weights and stop at ``most`` times their size. Sorted by the level at which they stop, the
    level of the others follows from running sums: no rounds of resharing.
    """
    sums = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    # From here on one row per source.
    by_name = Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    ranked = sums.withColumn("rank", F.row_number().over(by_name) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = ranked.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(most))
    ranked = ranked.withColumn("stop", F.col("cap") / F.col("weight"))
    whole = Window.partitionBy(F.lit(0))
    order = whole.orderBy("stop", "rank")
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    still = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    ranked = ranked.withColumn("level", (F.sum("source_size").over(whole) * F.lit(share) - before) / still).withColumn("place", F.row_number().over(order))
    level = F.min(F.when(F.col("level") <= F.col("stop"), F.struct("place", "level"))).over(whole)["level"]
    target = F.least(F.col("cap"), F.coalesce(level * F.col("weight"), F.col("cap")))
    return ranked.select("source", "rank", "n", "source_size", target.alias("target"))


def _step(p: np.ndarray, u: np.ndarray, draw: float) -> np.ndarray:
    """One random move along ``u`` to a face of the cube; expectations stay."""
    with np.errstate(divide="ignore", invalid="ignore"):
        up = np.min(np.where(u > 0, (1 - p) / u, np.where(u < 0, -p / u, np.inf)))
        down = np.min(np.where(u > 0, p / u, np.where(u < 0, (p - 1) / u, np.inf)))
    moved = p + up * u if draw * (up + down) < down else p - down * u
    moved[moved < NEAR] = 0.0
    moved[moved > 1 - NEAR] = 1.0
    return moved


def _direction(sizes: np.ndarray) -> np.ndarray:
    """A move of three units that changes neither their words nor their number."""
    u = np.array([sizes[1] - sizes[2], sizes[2] - sizes[0], sizes[0] - sizes[1]], dtype=float)
    return u if u.any() else np.array([1.0, -1.0, 0.0])


def _fly_pool(out: np.ndarray, sizes: np.ndarray, units: list[int], rng: np.random.Generator) -> list[int]:
    """Move ``units`` in turn, three at a time; the two at most that are left."""
    pool: list[int] = []
    waiting = iter(units)
    while True:
        while len(pool) < 3 and (unit := next(waiting, None)) is not None:
            pool.append(unit)
        if len(pool) < 3:
            return pool
        out[pool] = _step(out[pool], _direction(sizes[pool]), rng.random())
        pool = [k for k in pool if 0 < out[k] < 1]


def _subsets(n: int) -> np.ndarray:
    return (np.arange(1 << n)[:, None] >> np.arange(n)) & 1


def _land(out: np.ndarray, sizes: np.ndarray, units: np.ndarray) -> None:
    """The landing problem: of all ways to settle a few units the one nearest in words, then in documents."""
    ways = _subsets(len(units))
    off_words = np.abs(ways @ sizes[units] - out[units] @ sizes[units])
    off_count = np.abs(ways.sum(axis=1) - out[units].sum())
    out[units] = ways[np.lexsort((off_count, np.rint(off_words)))[0]]


def _settle(out: np.ndarray, sizes: np.ndarray, left: list[int], rest: np.ndarray) -> bool:
    """Round ``left`` and spread the words this adds or takes over ``rest``; False where it has no room."""
    ways = _subsets(len(left))
    offs = ways @ sizes[left] - out[left] @ sizes[left]
    best = int(np.argmin(np.abs(offs)))
    room = np.minimum(out[rest], 1 - out[rest])
    words = float(room @ sizes[rest])
    if abs(offs[best]) > 0.9 * words:
        return False
    out[left] = ways[best]
    if offs[best]:
        out[rest] -= offs[best] / words * room
    return True


def flight(p: np.ndarray, sizes: np.ndarray, rng: np.random.Generator, land: bool) -> np.ndarray:
    """Probabilities after the flight, for units from the largest to the smallest.

    With ``land`` the larger half of the words flies first, the two units left are rounded, and what that
    changes is spread over the smaller half, which flies next; the landing problem is the last few units,
    small enough to try every way.
    Without it the two left and the smallest units are passed on.
    """
    out = p.astype(float).copy()
    units = np.flatnonzero((out > 0) & (out < 1))
    if not land:
        _fly_pool(out, sizes, units[: max(0, len(units) - HELD_BACK)].tolist(), rng)
        return out
    carried: list[int] = []
    while len(units) > HELD_BACK:
        room = np.cumsum((sizes * np.minimum(out, 1 - out))[units])
        cut = max(1, int(np.searchsorted(room, room[-1] / 2)))
        left = _fly_pool(out, sizes, [*carried, *units[:cut].tolist()], rng)
        units = units[cut:]
        carried = [] if _settle(out, sizes, left, units) else left
        units = units[(out[units] > 0) & (out[units] < 1)]
    _land(out, sizes, np.array([*carried, *units], dtype=int))
    return out


def _fly(level: int, seed: int):
    def fly(key: tuple, rows: pa.Table) -> pa.Table:
        rank, bucket = key[0].as_py(), key[1].as_py()
        rows = rows.take(pc.sort_indices(rows, sort_keys=[("size", "descending"), ("doc_id", "ascending")]))
        rng = np.random.default_rng([seed, level, rank, bucket])
        land = rows.column("groups")[0].as_py() == 1
        p = flight(rows.column("p").to_numpy(), rows.column("size").to_numpy(), rng, land)
        return rows.set_column(rows.schema.get_field_index("p"), "p", pa.array(p))

    return fly


def mix_sources(
    docs: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    share: float = SHARE,
    most: float = MOST_COPIES,
    text: str = "text",
    source: str = "source",
    id_column: str = "doc_id",
    group_rows: int = GROUP_ROWS,
    seed: int = 7,
) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies, taken.

    ``copies`` is how often the mix takes the document and ``taken`` its words times that; it is
    at most ``most`` (a whole number) times the size. The same rows give the same result, however they
    are laid out.

    A null text has no words, a null source is a source of its own and comes last. Documents without
    words are drawn like any other. Repeated rows are documents of their own. A source without words has
    the target 0. No rows give no rows. Other columns are not read.
    """
    sizes = stage(docs.select(F.col(id_column).alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size")), "mix-sizes")
    targets = stage(source_targets(sizes, weights, share, most), "mix-targets")
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most)))).otherwise(0.0)
    known = targets.select(
        F.col("source").alias("name"), "rank", "source_size", "target", F.floor(rate).alias("whole"), (rate - F.floor(rate)).alias("p"), F.ceil(F.col("n") / group_rows).alias("groups")
    )
    rows = sizes.join(known, F.col("source").eqNullSafe(F.col("name"))).select(
        "doc_id", "source", "size", "rank", "source_size", "target", "whole", "p", "groups", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "size"), F.col("groups")).alias("bucket")
    )
    most_groups = known.agg(F.max("groups")).first()[0] or 1
    done, level = [], 0
    while True:
        flown = stage(rows.groupBy("rank", "bucket").applyInArrow(_fly(level, seed), rows.schema), "mix-flight")
        if most_groups == 1:
            done.append(flown)
            break
        open_rows = (F.col("p") > 0) & (F.col("p") < 1)
        done.append(flown.filter(~open_rows))
        fan = group_rows // (HELD_BACK + 2)  # groups that meet in the next one
        level, most_groups = level + 1, -(-most_groups // fan)
        rows = flown.filter(open_rows).withColumn("groups", F.ceil(F.col("groups") / fan)).withColumn("bucket", F.floor(F.col("bucket") / fan))
    whole = done[0]
    for more in done[1:]:
        whole = whole.unionByName(more)
    copies = (F.col("whole") + F.col("p")).cast("long")
    return whole.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (F.col("size") * copies).alias("taken"))
