"""A family of copies among texts edited further: the near-copy stage pairs few of them and loses no link."""
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from larder.llm import simhash

WORDS = 150


def family(spark, copies, edited, seed=5):
    """Row 0, copies with three words changed, and texts with eight to fourteen, every third with a copy of its own."""
    rng = random.Random(seed)
    base = [str(rng.random()) for _ in range(WORDS)]
    rows = [base]

    def change(words, n):
        out = words[:]
        for at in rng.sample(range(WORDS), n):
            out[at] = str(rng.random())
        return out

    rows += [change(base, 3) for _ in range(copies)]
    for i in range(edited):
        rows.append(change(base, rng.randint(8, 14)))
        if i % 3 == 0:
            rows.append(change(rows[-1], 2))
    texts = spark.createDataFrame([(i, " ".join(words)) for i, words in enumerate(rows)], "row bigint, text string").repartition(3).cache()
    labels = spark.range(copies + 1).select(F.col("id").alias("node"), F.lit(0).cast("bigint").alias("label"))
    return texts, labels


def edges(df):
    return [(r["a"], r["b"]) for r in df.collect()]


def components(n, pairs):
    a, b = (np.array([p[k] for p in pairs], np.int64) for k in (0, 1))
    return simhash.components(n, a, b).tolist()


@pytest.mark.parametrize("crowd", [0, simhash.CROWD, None])
def test_no_link_between_groups_is_lost(spark, crowd):
    texts, labels = family(spark, 25, 18)
    found = simhash.similar_pairs(simhash.prefix_pairs(texts, labels, 0.8, 5, crowd=crowd), texts, 0.8, 5)
    sets = {r["row"]: set(simhash.shingle_set(r["text"]).tolist()) for r in texts.collect()}
    want = [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    known = [(r["node"], 0) for r in labels.collect()]
    assert components(len(sets), known + edges(found)) == components(len(sets), known + want)
    assert len(set(components(len(sets), known + want))) < len(sets) - 25


@pytest.mark.parametrize("copies, edited", [(100, 60), (300, 180)])
def test_a_family_makes_about_a_pair_a_text(spark, copies, edited):
    texts, labels = family(spark, copies, edited)
    assert simhash.prefix_pairs(texts, labels, 0.8, 5, crowd=simhash.CROWD).count() <= 2 * texts.count()
