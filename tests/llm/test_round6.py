"""Near copies: joins that are not broadcast, rows picked by bits, common shingles, crowds of far texts."""
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from larder.llm import simhash


def words(rng, n):
    return [f"w{rng.randrange(10**9)}" for _ in range(n)]


def edited(rng, base, n):
    out = list(base)
    for at in rng.sample(range(len(out)), n):
        out[at] = f"e{rng.randrange(10**9)}"
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, " ".join(r)) for i, r in enumerate(rows)], "row bigint, text string").repartition(3).cache()


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_exploded_rows_are_never_broadcast(spark):
    kinds = "centre bigint, shingle bigint, row bigint, label bigint, size bigint, apart bigint, over double, unit double, near boolean, place int, inner boolean, outer boolean"
    met = spark.createDataFrame([(1, 5, k, k, 100, 40, 20.0, 10.0, False, 0, True, True) for k in (1, 2)], kinds)
    assert "Broadcast" not in plan(simhash._meeting(met, 0.8)) and simhash._meeting(met, 0.8).count() == 1
    slots = spark.createDataFrame([(k, [7, k]) for k in range(4)], "row bigint, slots array<bigint>")
    found = simhash.slot_pairs(slots)
    assert "SortMergeJoin [slot" in plan(found) and {(r["a"], r["b"]) for r in found.collect()} >= {(1, 0), (2, 0), (3, 0)}


def test_rows_are_picked_by_their_bits(spark):
    some = [0, 63, 64, 5, 5, 1 << 33, (1 << 33) + 62, (3 << 33) + 127]
    rows = simhash.Rows.of(spark.createDataFrame([(k,) for k in some], "row bigint"))
    asked = np.array(sorted({*some, *(k + 1 for k in some)}), np.int64)
    assert asked[rows.has(asked)].tolist() == sorted(set(some)) and len(rows.blocks) == 5  # the last one is none
    none = simhash.Rows.of(spark.createDataFrame([], "row bigint"))
    assert not none.has(asked).any() and len(none.has(asked[:0])) == 0


def test_a_passage_of_many_texts_is_not_rare(spark):
    rng = random.Random(4)
    passage = words(rng, 60)
    texts = frame(spark, [words(rng, 150) + (passage if k % 2 else []) for k in range(60)])
    rank = simhash.Rarity.of(texts, 5, 4).rank  # 16 buckets tell nothing
    shared = rank(simhash.shingle_set(" ".join(passage)))
    assert shared.min() > max(rank(simhash.shingle_set(" ".join(words(rng, 500)))).max(), 0)
    none = spark.createDataFrame([], "node bigint, label bigint")
    assert simhash.prefix_pairs(texts, none, 0.8, 5, 4, crowd=simhash.CROWD).count() == 0


def two_families(spark):
    """Texts of two families that share a passage, so that all meet in its shingles; far texts with it, and their copies."""
    rng = random.Random(9)
    passage = words(rng, 40)
    rows = []
    for base in (words(rng, 200), words(rng, 200)):
        for k in range(14):
            rows.append(passage + edited(rng, base, 2 + k))
            if k % 3 == 0:
                rows.append(edited(rng, rows[-1], 2))
    for _ in range(8):
        rows.append(passage + words(rng, 120))
        rows.append(edited(rng, rows[-1], 3))
    return frame(spark, rows)


@pytest.mark.parametrize("crowd", [0, 2, simhash.CROWD])
@pytest.mark.parametrize("bits", [4, simhash.SEEN_BITS])
def test_far_texts_of_a_crowd_lose_no_group(spark, monkeypatch, crowd, bits):
    monkeypatch.setattr(simhash, "COMMON", 0)  # the passage counts as rare
    texts = two_families(spark)
    none = spark.createDataFrame([], "node bigint, label bigint")
    found = simhash.similar_pairs(simhash.prefix_pairs(texts, none, 0.8, 5, bits, crowd=crowd), texts, 0.8, 5).collect()
    sets = {r["row"]: set(simhash.shingle_set(r["text"]).tolist()) for r in texts.collect()}
    want = [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]

    def groups(pairs):
        a, b = (np.array([p[k] for p in pairs], np.int64) for k in (0, 1))
        return simhash.components(len(sets), a, b).tolist()

    assert groups([(r["a"], r["b"]) for r in found]) == groups(want) and want


def test_far_texts_bring_no_differences(spark):
    rng = random.Random(2)
    base = words(rng, 150)
    rows = [base, edited(rng, base, 2), edited(rng, base, 6)] + [base[:20] + words(rng, 150) for _ in range(5)]
    texts = frame(spark, rows)
    members = spark.createDataFrame([(0, k, k) for k in range(len(rows))], "centre bigint, row bigint, label bigint")
    centres = spark.createDataFrame([(0, 0)], "row bigint, of bigint")
    rarity = spark.sparkContext.broadcast(simhash.Rarity.of(texts, 5, 10))
    sizes = {r["row"]: (r["linked"], r["n"]) for r in simhash._differences(members, centres, texts, 0.8, 5, rarity, True).withColumn("n", F.size("shingles")).collect()}
    assert sizes[1][0] and sizes[1][1] > 0 and not sizes[2][0] and sizes[2][1] > 0
    assert all(sizes[k] == (False, 0) for k in range(3, 8))
