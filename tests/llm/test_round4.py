"""Counting in the pipeline's near-copy stage: what a task reports is bounded whatever the input."""
import random

import pytest
from pyspark.sql import functions as F

from larder.llm import simhash


def texts_of(spark, n, words=60, seed=3):
    rng = random.Random(seed)
    base = [str(rng.random()) for _ in range(words)]
    rows = []
    for i in range(n):
        own = base[:] if i % 3 == 0 else [str(rng.random()) for _ in range(words)]
        own[rng.randrange(words)] = f"edit{i}"
        rows.append((i, " ".join(own)))
    return spark.createDataFrame(rows, "row bigint, text string")


def test_as_many_buckets_for_any_input(spark, monkeypatch):
    used, seen = [], simhash._seen
    monkeypatch.setattr(simhash, "_seen", lambda texts, shingle, bits: used.append(bits) or seen(texts, shingle, bits))
    few = texts_of(spark, 30, 20)
    many = spark.range(40).select(F.col("id").alias("row"), F.concat_ws(" ", F.transform(F.sequence(F.lit(0), F.lit(40_000)), lambda i: F.hash(i, "id"))).alias("text"))
    for texts in (few, many):
        simhash.drop_near_duplicates(texts, id_column="row").count()
    assert len(used) == 2 and used[0] == used[1]


@pytest.mark.parametrize("bits", [4, 10, simhash.SEEN_BITS])
def test_buckets_change_no_result(spark, bits):
    texts = texts_of(spark, 90).repartition(3)
    assert simhash._seen(texts, 5, bits).count() <= texts.rdd.getNumPartitions() << bits
    none = spark.createDataFrame([], "node bigint, label bigint")
    found = simhash.similar_pairs(simhash.prefix_pairs(texts, none, 0.8, 5, bits), texts, 0.8, 5)
    sets = {r["row"]: set(simhash.shingle_set(r["text"]).tolist()) for r in texts.collect()}
    want = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    assert want and {(r["a"], r["b"]) for r in found.collect()} == want
