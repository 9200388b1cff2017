"""SimHash near-duplicates, linked exactly with vantage-point trees.

Distinct fingerprints are dealt into shards by a vantage-point tree that is built on a bounded sample: at
each node a point goes inside or outside a ball, and an inside point so near the boundary that the
triangle inequality allows a partner outside is copied there as well. So every linked pair meets in
a shard. Inside a shard the same splitting goes on until parts are small enough to compare all of them.
A shard reports a star per component, never its pairs; stars are joined to components by contraction.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..sources.staging import stage
from .batches import slices
from .columns import unused

SHINGLE_WORDS = 3
MAX_BITS = 2
SEED = 42
#: Fingerprints the tree is built on; all are then dealt by it.
SAMPLE = 1 << 18
#: Hash values that the draw tells apart.
_DRAW = 1 << 40
#: Fingerprints of a shard that the tree aims at.
SHARD = 4096
#: Fingerprints that are compared all with all.
PART = 1024
#: Vantage points tried at a node.
TRIED = 12
#: Neighbours listed at a time where points lie too close to be split.
_NEIGHBOURS = 1 << 23

#: (vantage point, radius, inside, outside), or the number of a shard
Node = tuple


# ---- fingerprints


def shingle_hashes(text: str, shingle: int = SHINGLE_WORDS, seed: int = SEED) -> np.ndarray:
    """XXH64 of every shingle, repeats included; fewer words are one shingle, no words none."""
    words = text.encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    width = min(shingle, len(words))
    starts, ends = (ends - sizes)[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[s:e], seed) for s, e in zip(starts, ends)], np.uint64)


def majority(hashes: np.ndarray) -> int:
    """The bits set in over half of the hashes; 0 without any."""
    votes = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        some = hashes[at : at + (1 << 16)].astype("<u8")
        votes += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: str, shingle: int = SHINGLE_WORDS, seed: int = SEED) -> int:
    return majority(shingle_hashes(text, shingle, seed))


def fingerprints(docs: DataFrame, text: str = "text", id_column: str = "doc_id", shingle: int = SHINGLE_WORDS, seed: int = SEED) -> DataFrame:
    """(doc_id, fp) of every row; fp holds the 64 bits as a signed long."""
    picked = docs.select(F.col(id_column).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t, shingle, seed) for t in batch.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    return picked.mapInArrow(run, f"doc_id {picked.schema['doc_id'].dataType.simpleString()}, fp bigint")


# ---- vantage-point trees


def distances(points: np.ndarray, centre: np.uint64) -> np.ndarray:
    return np.bitwise_count(points ^ centre)


def choose_split(points: np.ndarray, radius: int) -> tuple[np.uint64, int] | None:
    """The ball that copies the fewest points, of those that keep a quarter to three quarters inside."""
    best = None
    step = max(1, len(points) // TRIED)
    for centre in points[::step][:TRIED]:
        counts = np.bincount(distances(points, centre), minlength=65)
        inside = np.cumsum(counts)
        for r in range(64):
            if 0.25 <= inside[r] / len(points) <= 0.75:
                copied = inside[r] - (inside[r - radius] if r >= radius else 0)
                cost = (copied + 0.2 * abs(2 * inside[r] - len(points)), int(centre), r)
                best = min(best, cost) if best else cost
    return (np.uint64(best[1]), best[2]) if best else None


def build_tree(sample: np.ndarray, depth: int, radius: int) -> tuple[Node, int]:
    """The tree over ``sample`` and its number of shards."""
    shards = 0

    def grow(points: np.ndarray, left: int) -> Node:
        nonlocal shards
        split = choose_split(points, radius) if left > 0 and len(points) >= 32 else None
        if split is None:
            shards += 1
            return (shards - 1,)
        centre, r = split
        d = distances(points, centre)
        return centre, r, grow(points[d <= r], left - 1), grow(points[d > r], left - 1)

    return grow(sample, depth), shards


def deal(points: np.ndarray, tree: Node, radius: int) -> Iterator[tuple[int, np.ndarray]]:
    """(shard, places in ``points``): each point's own shard, and those it is copied to."""
    todo = [(tree, np.arange(len(points)))]
    while todo:
        node, at = todo.pop()
        if not len(at):
            continue
        if len(node) == 1:
            yield node[0], at
            continue
        centre, r, inside, outside = node
        d = distances(points[at], centre).astype(np.int64)
        todo += [(inside, at[d <= r]), (outside, at[d > r - radius])]


def components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest member of each node's component, for edges a-b among n nodes."""
    label = np.arange(n)
    while True:
        x, y = label[a], label[b]
        if (x == y).all():
            return label
        low = np.minimum(x, y)
        np.minimum.at(label, x, low)
        np.minimum.at(label, y, low)
        while (label[label] != label).any():
            label = label[label]


def _compare_all(points: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    near = np.bitwise_count(points[:, None] ^ points[None, :]) <= radius
    np.fill_diagonal(near, False)
    some = np.flatnonzero(near.any(axis=1))
    if not len(some):
        return some, some
    near = near[np.ix_(some, some)]
    label = np.arange(len(some))
    while True:
        low = np.minimum(label, np.where(near, label[None, :], len(some)).min(axis=1))
        if (low == label).all():
            break
        label = low
    return some, some[label]


def _by_neighbours(points: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Stars of points too close together to be split, in time that grows with their number.

    Two points differ in at most 2 bits exactly if some value differs from either in at most 1, so the
    points are joined through the values around them. For other radii they are compared in blocks.
    """
    n = len(points)
    label = np.arange(n)
    if radius != 2:
        for at in range(0, n, PART):
            i, j = np.nonzero(np.bitwise_count(points[at : at + PART, None] ^ points[None, :]) <= radius)
            label = components(n, np.concatenate((np.arange(n), i + at)), np.concatenate((label, j)))
        return np.arange(n), label
    flips = np.concatenate(([0], np.uint64(1) << np.arange(64, dtype=np.uint64))).astype(np.uint64)
    passes = -(-65 * n // _NEIGHBOURS)
    for k in range(passes):
        values, owners = [], []
        for flip in flips:
            value = points ^ flip
            mine = np.flatnonzero(((value * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)) % np.uint64(passes) == k)
            values.append(value[mine])
            owners.append(mine)
        value, owner = np.concatenate(values), np.concatenate(owners)
        order = np.argsort(value, kind="stable")
        value, owner = value[order], owner[order]
        same = np.flatnonzero(value[1:] == value[:-1])
        label = components(n, np.concatenate((np.arange(n), owner[same])), np.concatenate((label, owner[same + 1])))
    return np.arange(n), label


def link_shard(points: np.ndarray, radius: int = MAX_BITS) -> np.ndarray:
    """For distinct points the place of the smallest member of each one's component."""
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    todo = [np.arange(len(points))]
    while todo:
        at = todo.pop()
        part = points[at]
        if len(at) <= PART:
            i, j = _compare_all(part, radius)
        else:
            split = choose_split(part, radius)
            if split is not None:
                d = distances(part, split[0]).astype(np.int64)
                inside, outside = at[d <= split[1]], at[d > split[1] - radius]
                if max(len(inside), len(outside)) <= 0.85 * len(at):
                    todo += [inside, outside]
                    continue
            i, j = _by_neighbours(part, radius)
        a.append(at[i])
        b.append(at[j])
    return components(len(points), np.concatenate(a), np.concatenate(b))


# ---- links between shards


def _stars(points: DataFrame, tree: Node, radius: int) -> DataFrame:
    """(a, b) with b < a: within each shard every linked fingerprint with the first of its component."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            signed = batch.column("fp").to_numpy()
            for shard, at in deal(signed.view(np.uint64), tree, radius):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), shard, np.int32)), pa.array(signed[at])], names=["shard", "fp"])

    def link(rows: pa.Table) -> pa.Table:
        signed = np.sort(rows.column("fp").to_numpy())
        first = link_shard(signed.view(np.uint64), radius)
        linked = np.flatnonzero(first != np.arange(len(first)))
        return pa.table({"a": signed[linked], "b": signed[first[linked]]})

    return points.select("fp").mapInArrow(spread, "shard int, fp bigint").groupBy("shard").applyInArrow(link, "a bigint, b bigint")


def connected(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of the edges (a, b): one label per component.

    Each round moves every node to its smallest neighbour and keeps the edges between different places,
    so at least half of the nodes that still have an edge go; only sums per node are grouped.
    """
    edges = stage(edges.filter("a <> b").distinct(), "near-edges")
    labels = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        moved = stage(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("to")), "near-moved")
        if labels is None:
            labels = moved.select("node", F.col("to").alias("label"))
        else:
            step = moved.withColumnRenamed("node", "label")
            labels = stage(labels.join(step, "label", "left").select("node", F.coalesce("to", "label").alias("label")), "near-labels")
        ends = edges.join(moved.select(F.col("node").alias("a"), F.col("to").alias("x")), "a").join(moved.select(F.col("node").alias("b"), F.col("to").alias("y")), "b")
        edges = stage(ends.filter("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), "near-edges")
    return labels if labels is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("label"))


def near_duplicates(
    docs: DataFrame,
    text: str = "text",
    id_column: str = "doc_id",
    shingle: int = SHINGLE_WORDS,
    max_bits: int = MAX_BITS,
    seed: int = SEED,
    shard: int = SHARD,
    sample: int = SAMPLE,
) -> DataFrame:
    """One row per document: doc_id, fp, component_id.

    ``fp`` is the fingerprint as a signed long, ``component_id`` the smallest id reachable over links of
    at most ``max_bits`` differing bits, the document's own included.

    Texts are lower-cased in A-Z; words are parted by ASCII blanks; fewer words than a shingle are one
    shingle. Null and empty texts have the fingerprint 0 and are linked like any other. Rows without id
    take part; a component of such rows only has a null id. Repeated rows are members like any other. No
    rows give no rows. Other columns are not read.

    The tree is built on about ``sample`` fingerprints, those with the smallest hashes; all are dealt by it.
    """
    return linked(stage(fingerprints(docs, text, id_column, shingle, seed), "near-members"), max_bits, shard, sample)


def _tree_of(points: DataFrame, max_bits: int, shard: int, sample: int) -> Node:
    """The tree over distinct fingerprints. Each is drawn by its own hash, so no task sorts or gathers them all."""
    total = points.count()
    share = min(1.0, sample / max(1, total))
    chosen = F.pmod(F.xxhash64("fp"), F.lit(_DRAW)) < F.lit(int(share * _DRAW))
    drawn = np.sort(points.where(chosen).select("fp").toArrow().column("fp").to_numpy())
    return build_tree(drawn.view(np.uint64), max(0, int(np.ceil(np.log2(max(1, total) / shard)))), max_bits)[0]


def linked(members: DataFrame, max_bits: int = MAX_BITS, shard: int = SHARD, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, fp, component_id) for a stored table of (doc_id, fp)."""
    points = stage(members.groupBy("fp").agg(F.min("doc_id").alias("least")), "near-points")
    labels = connected(_stars(points, _tree_of(points, max_bits, shard, sample), max_bits))
    named = points.join(labels.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("label", "fp").alias("label"))
    named = stage(named, "near-named")
    first = stage(named.groupBy("label").agg(F.min("least").alias("component_id")), "near-first")
    owners = stage(named.join(first, "label").select("fp", "component_id"), "near-owners")
    return members.join(owners, "fp").select("doc_id", "fp", "component_id")


# ---- copies further apart than a few bits

#: Five-word shingles shared by two near copies, by all they have.
SIMILARITY = 0.8
COPY_SHINGLE_WORDS = 5
#: Each slot is a sample of SLOT_SIZE shingles; two texts at 0.8 share none of the slots once in 90,000 times.
SLOTS = 16
SLOT_SIZE = 3
#: 2 ** SEEN_BITS buckets tell how rare a shingle is. As many for any input: a task reports each at most once.
SEEN_BITS = 18
#: Shingles of a task among which repeated ones are counted by themselves, how often they then have to come, and how
#: many of the most frequent ones are told apart. They only change which shingles are taken for rare.
HELD_SHINGLES = 1 << 22
OFTEN = 2
COMMON = 1 << 19
#: Texts that are paired where they meet in a shingle; larger crowds are seen from one of their texts.
CROWD = 8
#: Times as many of a crowd are paired if they are not linked to the text it is seen from.
LOOSE = 8
_ODD = (np.random.default_rng(11).integers(0, 1 << 63, SLOTS, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)


def shingle_set(text: str, shingle: int = COPY_SHINGLE_WORDS, seed: int = SEED) -> np.ndarray:
    """Sorted distinct hashes of the shingles."""
    return np.unique(shingle_hashes(text, shingle, seed))


def slots_of(shingles: np.ndarray) -> np.ndarray:
    """One number per slot: the shingles that come first in an order of its own."""
    if not len(shingles):
        return np.zeros(0, np.uint64)
    out = np.empty(SLOTS, np.uint64)
    for k, odd in enumerate(_ODD):
        order = shingles * odd
        first = np.sort(np.partition(order, SLOT_SIZE - 1)[:SLOT_SIZE] if len(order) > SLOT_SIZE else order)
        out[k] = xxhash.xxh64_intdigest(first.tobytes(), k)
    return out


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    """A list column that shares one flat array."""
    ends = np.cumsum([0, *map(len, arrays)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *arrays])))


def _marks(texts: DataFrame, shingle: int) -> DataFrame:
    """(row, fp, size, slots) of (row, text), in one pass over the texts; size is that of the shingle set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chain.from_iterable(map(slices, batches)):
            marks, sizes, slots = [], [], []
            for text in batch.column("text").to_pylist():
                hashes = shingle_hashes(text, shingle)
                marks.append(majority(hashes))
                distinct = np.unique(hashes)
                sizes.append(len(distinct))
                slots.append(slots_of(distinct).view(np.int64))
            fp = pa.array(np.array(marks, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("row"), fp, pa.array(sizes, pa.int64()), _lists(slots)], names=["row", "fp", "size", "slots"])

    return texts.mapInArrow(run, "row bigint, fp bigint, size bigint, slots array<bigint>")


@dataclass(frozen=True)
class Rows:
    """A set of row numbers, as the bits of blocks of 64: rows are numbered closely, so it takes a quarter of a byte
    a text at most. Texts are picked by it where they lie; to be joined, all of them would have to move."""

    blocks: np.ndarray
    bits: np.ndarray

    @staticmethod
    def of(rows: DataFrame) -> Rows:
        """Those in column ``row``; they may repeat."""
        block = F.expr("row div 64").alias("block")
        bits = F.expr("bit_or(shiftleft(1L, cast(row % 64 AS int)))").alias("bits")
        found = rows.groupBy(block).agg(bits).toArrow()
        blocks = found.column("block").to_numpy()
        order = np.argsort(blocks)
        return Rows(np.append(blocks[order], -1), np.append(found.column("bits").to_numpy()[order], 0))

    def has(self, rows: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.blocks[:-1], rows >> 6)
        return (self.blocks[at] == rows >> 6) & (self.bits[at] >> (rows & 63) & 1 == 1)


def _in(rows: Broadcast, row: Column) -> Column:
    """Whether a row number is among the ``Rows``."""

    @F.pandas_udf("boolean")
    def has(numbers: pd.Series) -> pd.Series:
        return pd.Series(rows.value.has(numbers.to_numpy()))

    return has(row)


def _sets(texts: DataFrame, shingle: int, wanted: Broadcast) -> DataFrame:
    """(row, shingles) of those (row, text) that are among the ``wanted`` Rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chain.from_iterable(map(slices, batches)):
            batch = batch.filter(pa.array(wanted.value.has(batch.column("row").to_numpy())))
            made = [shingle_set(t, shingle).view(np.int64) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("row"), _lists(made)], names=["row", "shingles"])

    return texts.mapInArrow(run, "row bigint, shingles array<bigint>")


def fingerprint_pairs(marks: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(a, b) of rows to be compared: each with the first of its fingerprint, and these along the stars."""
    points = stage(marks.groupBy("fp").agg(F.min("row").alias("first")), "near-points")
    stars = _stars(points, _tree_of(points, max_bits, SHARD, SAMPLE), max_bits)
    ends = stars.join(points.select(F.col("fp").alias("a"), F.col("first").alias("x")), "a").join(points.select(F.col("fp").alias("b"), F.col("first").alias("y")), "b")
    same = marks.join(points, "fp").select(F.col("row").alias("a"), F.col("first").alias("b"))
    return same.filter("a <> b").unionByName(ends.select(F.col("x").alias("a"), F.col("y").alias("b")))


def slot_pairs(slots: DataFrame) -> DataFrame:
    """(a, b) of rows to be compared that share a slot.

    ``slots`` is a table of (row, slots). A text is compared with three members
    of every slot group it is in, never with all: the first one, the one whose groups are largest in
    sum, which in a family of copies is the text they were made from, and one that a hash picks anew for
    every slot, so that small families are compared almost completely.
    """
    spread = slots.select("row", F.posexplode("slots").alias("slot", "value"))
    sizes = stage(spread.groupBy("slot", "value").agg(F.count("*").alias("n")).filter("n > 1"), "near-sizes")
    # Neither side of these joins is broadcast: Spark takes what it explodes, or reads packed, for much smaller than it is.
    shared = stage(spread.join(sizes.hint("merge"), ["slot", "value"]), "near-shared")
    weight = stage(shared.groupBy("row").agg(F.sum("n").alias("weight")), "near-weight")
    shared = shared.join(weight, "row")
    heads = shared.groupBy("slot", "value").agg(
        F.min("row").alias("first"),
        F.max(F.struct("weight", (-F.col("row")).alias("row"))).alias("centre"),
        F.min(F.struct(F.xxhash64("slot", "row").alias("hash"), "row")).alias("any"),
    )
    heads = stage(heads.select("slot", "value", F.array_distinct(F.array("first", -F.col("centre.row"), "any.row")).alias("heads")), "near-heads")
    return shared.join(heads.hint("merge"), ["slot", "value"]).select(F.col("row").alias("a"), F.explode("heads").alias("b")).filter("a <> b")


def similar_pairs(pairs: DataFrame, texts: DataFrame, similarity: float = SIMILARITY, shingle: int = COPY_SHINGLE_WORDS) -> DataFrame:
    """Those of the pairs (a, b) that share at least ``similarity`` of their shingles; ``texts`` has (row, text)."""
    pairs = stage(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "near-pairs")
    needed = Rows.of(pairs.select(F.col("a").alias("row")).union(pairs.select("b")))
    sets = stage(_sets(texts, shingle, texts.sparkSession.sparkContext.broadcast(needed)), "near-sets")
    both = pairs.join(sets.select(F.col("row").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("row").alias("b"), F.col("shingles").alias("y")), "b")
    common = F.size(F.array_intersect("x", "y"))
    return both.filter(common >= similarity * (F.size("x") + F.size("y") - common)).select("a", "b")


def _seen(texts: DataFrame, shingle: int, bits: int) -> DataFrame:
    """(bucket, n): how many shingles of a task's sets fall into each of 2 ** bits buckets, where any do."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(1 << bits, np.int64)
        for batch in chain.from_iterable(map(slices, batches)):
            for text in batch.column("text").to_pylist():
                np.add.at(count, (shingle_set(text, shingle) >> np.uint64(64 - bits)).astype(np.int64), 1)
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(count[some])], names=["bucket", "n"])

    return texts.mapInArrow(run, "bucket int, n bigint")


def _bucket_sums(seen: DataFrame, bits: int) -> np.ndarray:
    """The counts of all tasks, by bucket."""
    rows = seen.groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(1 << bits, np.int64)
    out[rows["bucket"].to_numpy(np.int64)] = rows["n"].to_numpy(np.int64)
    return out


def _common(texts: DataFrame, shingle: int) -> DataFrame:
    """(shingle, n): how many texts have it, of shingles that come often among some texts of a task."""

    def counted(held: list[np.ndarray]) -> pa.RecordBatch:
        found, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *held]), return_counts=True)
        often = n >= OFTEN
        return pa.RecordBatch.from_arrays([pa.array(found[often].view(np.int64)), pa.array(n[often])], names=["shingle", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in chain.from_iterable(map(slices, batches)):
            for text in batch.column("text").to_pylist():
                held.append(shingle_set(text, shingle))
                size += len(held[-1])
                if size >= HELD_SHINGLES:
                    yield counted(held)
                    held, size = [], 0
        yield counted(held)

    return texts.mapInArrow(run, "shingle bigint, n bigint").groupBy("shingle").agg(F.sum("n").alias("n"))


@dataclass(frozen=True)
class Rarity:
    """An order of all shingles, the rare ones first: by the counts of the buckets, after them the most common
    shingles by counts of their own, as a passage that many texts share does not stand out in a bucket."""

    bits: int
    buckets: np.ndarray
    common: np.ndarray
    counts: np.ndarray

    @staticmethod
    def of(texts: DataFrame, shingle: int, bits: int) -> Rarity:
        buckets = _bucket_sums(_seen(texts, shingle, bits), bits)
        common = stage(_common(texts, shingle), "near-common")
        by_count = common.groupBy("n").agg(F.count("*").alias("of")).toPandas().sort_values("n", ascending=False)
        fit = by_count["n"][by_count["of"].cumsum() <= COMMON]
        kept = common.filter(F.col("n") >= int(fit.min())).toPandas() if len(fit) else pd.DataFrame({"shingle": [], "n": []})
        shingles = kept["shingle"].to_numpy(np.int64).view(np.uint64)
        order = np.argsort(shingles)
        return Rarity(bits, buckets, shingles[order], kept["n"].to_numpy(np.int64)[order])

    def rank(self, of: np.ndarray) -> np.ndarray:
        out = self.buckets[(of >> np.uint64(64 - self.bits)).astype(np.int64)]
        if len(self.common):
            at = np.minimum(np.searchsorted(self.common, of), len(self.common) - 1)
            out = out + np.where(self.common[at] == of, self.counts[at] + int(self.buckets.max()), 0)
        return out


def _longest(n: float, shared: float) -> int:
    """How many of n elements in a common order hold the first of at least ``shared`` common ones, and at least one."""
    # The small number keeps rounding from making a prefix too short.
    return int(n) - max(1, int(np.ceil(shared - 1e-6))) + 1


#: What is known of a row where it is met: the text it is seen from, its label and size, how many shingles tell it
#: from that text, these beyond what its size allows, the unit such surpluses are dealt by, whether it is in that
#: text's group, and its place in the order.
_MET = ["centre", "shingle", "row", "label", "size", "apart", "over", "unit", "near", "place", "inner", "outer"]


def _prefixes(texts: DataFrame, similarity: float, shingle: int, rarity: Broadcast) -> DataFrame:
    """(row, size, shingle, place, inner): the rarest shingles of every set, rarest as far as ``rarity`` tells.

    Any order common to all sets will do. Of two sets at ``similarity`` the larger one has, among its first
    size - similarity * size + 1 shingles, one of the smaller one's first size - 2 * similarity /
    (1 + similarity) * size + 1, which are ``inner``. So a passage that many share is met only where it
    makes the texts that share it copies, or nearly.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chain.from_iterable(map(slices, batches)):
            rows, sizes, found, place, inner = [], [], [], [], []
            for row, text in zip(batch.column("row").to_pylist(), batch.column("text").to_pylist()):
                own = shingle_set(text, shingle)
                n = len(own)
                if not n:
                    continue
                outer = _longest(n, similarity * n)
                order = np.lexsort((own, rarity.value.rank(own)))[:outer]
                found.append(own[order])
                rows.append(np.full(len(order), row, np.int64))
                sizes.append(np.full(len(order), n, np.int64))
                place.append(np.arange(len(order), dtype=np.int32))
                inner.append(place[-1] < _longest(n, 2 * similarity / (1 + similarity) * n))
            if rows:
                columns = [np.concatenate(rows), np.concatenate(sizes), np.concatenate(found).view(np.int64), np.concatenate(place), np.concatenate(inner)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["row", "size", "shingle", "place", "inner"])

    return texts.mapInArrow(run, "row bigint, size bigint, shingle bigint, place int, inner boolean")


def _heads(crowded: DataFrame) -> DataFrame:
    """(shingle, head): of each crowd the row that meets the most others.

    In a family of copies that is the text they were made from, for nearly all shingles alike.
    """
    weight = stage(crowded.groupBy("row").agg(F.sum("n").alias("weight")), "near-weight")
    heads = crowded.join(weight, "row").groupBy("shingle").agg(F.max(F.struct("weight", (-F.col("row")).alias("row"))).alias("head"))
    return stage(heads.select("shingle", (-F.col("head.row")).alias("head")), "near-heads")


def _differences(members: DataFrame, centres: DataFrame, texts: DataFrame, similarity: float, shingle: int, rarity: Broadcast, linked_only: bool) -> DataFrame:
    """(centre, row, label, size, apart, over, unit, near, linked, inner, outer, shingles) of (centre, row, label).
    ``centres`` has (row, of) with their labels.

    Two sets x and e are at ``similarity`` where they differ in at most slack * (|x| + |e|) shingles. With X and E
    for what tells them from the centre they share at least (over(x) + over(e)) / 2 of X and E, where over(x) is
    |X| - slack * |x|. If that asks for none, both are linked to the centre; so of a pair to be found, one, e, is
    not, and over(e) exceeds slack * |centre|. X then has one of E among its first ``inner`` shingles, in an order
    common to the centre's rows, and E that one among its first ``outer``: what a text has beside its centre
    comes first, as its copies lack the same passages sooner than they add them.

    With ``linked_only`` the shingles of pairs that hold a row linked to the centre are told, no others. The distance of
    two sets, what they do not share of all they have, obeys the triangle inequality: a row more than twice as far from
    the centre as a linked one may be is linked to none of these, and has no shingles.
    """
    slack = (1 - similarity) / (1 + similarity)
    wanted = Rows.of(members.select("row").union(centres.select("row")))
    texts = texts.filter(_in(texts.sparkSession.sparkContext.broadcast(wanted), F.col("row")))
    middle = stage(texts.join(centres, "row").select(F.col("row").alias("centre"), "of", F.col("text").alias("whole")), "near-middle")
    # Texts travel, not their shingles, which take more room and cannot be packed.
    both = texts.join(members, "row").join(middle.hint("merge"), "centre").select("centre", "row", "label", (F.col("label") == F.col("of")).alias("same"), "text", "whole")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, y, rank = None, None, rarity.value.rank
        for batch in chain.from_iterable(map(slices, batches)):
            made, shown = {c: [] for c in ("size", "apart", "over", "unit", "near", "linked", "inner", "outer")}, []
            for i in range(batch.num_rows):
                x = shingle_set(batch.column("text")[i].as_py(), shingle)
                if centre != batch.column("centre")[i].as_py():
                    centre, y = batch.column("centre")[i].as_py(), shingle_set(batch.column("whole")[i].as_py(), shingle)
                more, less = np.setdiff1d(x, y, assume_unique=True), np.setdiff1d(y, x, assume_unique=True)
                size, apart, common = len(x), len(more) + len(less), len(x) - len(more)
                linked = common >= similarity * (size + len(y) - common)
                near, over = linked or batch.column("same")[i].as_py(), apart - slack * size
                # What many rows lack is seen less often, so of the centre's own shingles the frequent ones come first.
                order = np.concatenate((more[np.lexsort((more, rank(more)))], less[np.lexsort((less, -rank(less)))]))
                inner = _longest(apart, (over + slack * len(y)) / 2 if near else over)
                outer = 0 if near else _longest(apart, over - slack * size / similarity)
                if linked_only:
                    inner = inner if linked else 0
                    outer = outer if common >= (2 * similarity - 1) * (size + len(y) - common) - 1e-6 else 0
                shown.append(order[: max(0, inner, outer)].view(np.int64))
                for name, value in zip(made, (size, apart, over, slack * max(1, len(y)), near, linked, inner, outer)):
                    made[name].append(value)
            kinds = dict(size=pa.int64(), apart=pa.int64(), over=pa.float64(), unit=pa.float64(), near=pa.bool_(), linked=pa.bool_(), inner=pa.int32(), outer=pa.int32())
            columns = [batch.column(c) for c in ("centre", "row", "label")] + [pa.array(made[c], kinds[c]) for c in made]
            yield pa.RecordBatch.from_arrays([*columns, _lists(shown)], names=["centre", "row", "label", *made, "shingles"])

    kind = "centre bigint, row bigint, label bigint, size bigint, apart bigint, over double, unit double, near boolean, linked boolean, inner int, outer int, shingles array<bigint>"
    return both.mapInArrow(run, kind)


def _meeting(met: DataFrame, similarity: float) -> DataFrame:
    """(a, b) of the rows that meet in a shingle and may be at ``similarity``.

    The first shingle that two rows share stands so early in both that enough may follow: place + (over + over) / 2
    <= apart. So its place bounds how far over a partner may be, and a row is put only where such partners are, by
    two units: narrower bands would repeat the rows more often than they part them.
    """
    slack = (1 - similarity) / (1 + similarity)
    band = lambda over: F.floor(over / (2 * F.col("unit")))
    most = 2 * (F.col("apart") - F.col("place")) - F.col("over") + 1e-6
    x = met.filter("inner").withColumn("low", F.when(F.col("near"), F.col("unit")).otherwise(F.col("over")) - 1e-6)
    y = met.filter("outer").withColumn("low", F.col("over") - 2 * slack / similarity * F.col("size") - 1e-6)
    x, y = (t.filter(F.col("low") <= most).withColumn("own", band(F.col("over"))).withColumn("met", F.explode(F.sequence(band(F.col("low")), band(most)))) for t in (x, y))
    x = x.select("centre", "shingle", F.col("own").alias("p"), F.col("met").alias("q"), *[F.col(c).alias(f"x_{c}") for c in _MET[2:10]])
    y = y.select("centre", "shingle", F.col("met").alias("p"), F.col("own").alias("q"), *[F.col(c).alias(f"y_{c}") for c in _MET[2:10]])
    before = (F.col("x_over") < F.col("y_over")) | ((F.col("x_over") == F.col("y_over")) & (F.col("x_row") < F.col("y_row")))
    sizes = F.least("x_size", "y_size") >= similarity * F.greatest("x_size", "y_size") - 1e-6
    shared = (F.col("x_over") + F.col("y_over")) / 2 - 1e-6
    early = (F.col("x_place") + shared <= F.col("x_apart")) & (F.col("y_place") + shared <= F.col("y_apart"))
    near = (F.col("x_label") != F.col("y_label")) & (F.col("x_near") | before) & sizes & early
    # Exploded, so never broadcast: Spark takes either side for as large as the table before.
    return x.join(y.hint("merge"), ["centre", "shingle", "p", "q"]).filter(near).select(F.col("x_row").alias("a"), F.col("y_row").alias("b"))


def _met(rows: DataFrame, *by: str) -> DataFrame:
    """The rows, with their number n, that meet others in several groups: one group only says nothing new, however large."""
    of = Window.partitionBy(*by)
    outer = F.max("outer").over(of) if "outer" in rows.columns else F.lit(True)
    open_ = {"_low": F.min("label").over(of), "_high": F.max("label").over(of), "_x": F.max("inner").over(of), "_y": outer, "n": F.count("*").over(of)}
    met = rows.withColumns(open_).filter("_low <> _high and _x and _y").drop("_low", "_high", "_x", "_y")
    return stage(met, "near-left")


def prefix_pairs(texts: DataFrame, labels: DataFrame, similarity: float, shingle: int, bits: int = SEEN_BITS, crowd: int | None = None) -> DataFrame:
    """(a, b) of all rows not yet in one group that may share ``similarity`` of their shingles: none is left out.

    ``labels`` has (node, label) of the rows already grouped. The number of buckets, 2 ** ``bits``, only
    changes which shingles are taken for rare, not what is left after the exact comparison.

    With ``crowd``, rows linked to one text are paired with it only, so what is left out follows from other links:
    up to ``crowd`` rows that meet in a shingle are paired; more are seen from one of them. Rows not linked to it but
    near enough meet linked ones where they differ from it in the same way, which in a family of copies few do. Those
    not linked to it are paired with each other up to ``LOOSE`` crowds, and beyond that meet by such differences, too.
    """
    slack = (1 - similarity) / (1 + similarity)
    rarity = texts.sparkSession.sparkContext.broadcast(Rarity.of(texts, shingle, bits))
    first = _prefixes(texts, similarity, shingle, rarity).join(labels.withColumnRenamed("node", "row"), "row", "left")
    met = _met(first.withColumn("label", F.coalesce("label", "row")), "shingle")
    # Seen from no text, all of a set is a difference. Few meet here, so they are not dealt by how far over they are.
    size = F.col("size")
    given = {"centre": F.lit(-1).cast("long"), "apart": size, "over": (1 - slack) * size, "unit": F.lit(float("inf")), "near": F.lit(False), "outer": F.lit(True)}
    met = met.select(*[given.get(c, F.col(c)).alias(c) for c in _MET], "n")
    few = _meeting(met if crowd is None else met.filter(F.col("n") <= crowd), similarity)
    if crowd is None:
        rarity.destroy()
        return few
    heads = _heads(met.filter(F.col("n") > crowd))
    crowded = stage(met.filter(F.col("n") > crowd).drop("n").join(heads.hint("merge"), "shingle"), "near-crowded")
    members = stage(crowded.select(F.col("head").alias("centre"), "row", "label").distinct(), "near-centres")
    centres = members.filter("row = centre").select("row", F.col("label").alias("of"))

    def told_apart(members: DataFrame, linked_only: bool) -> tuple[DataFrame, DataFrame]:
        """The differences from the centres, and the pairs they name."""
        apart = stage(_differences(members, centres, texts, similarity, shingle, rarity, linked_only), "near-apart")
        rows = apart.select("*", F.posexplode("shingles").alias("place", "shingle"))
        rows = rows.withColumn("inner", F.col("place") < F.col("inner")).withColumn("outer", F.col("place") < F.col("outer"))
        return apart, _meeting(_met(rows.select(*_MET), "centre", "shingle"), similarity)

    apart, found = told_apart(members, True)
    linked = apart.filter("linked and row <> centre").select(F.col("centre").alias("a"), F.col("row").alias("b"))
    # Rows not linked to the head of a crowd meet each other as before, unless they are a crowd of their own.
    loose = apart.filter("not linked").select(F.col("centre").alias("head"), "row")
    loose = _met(crowded.join(loose.hint("merge"), ["head", "row"]), "shingle")
    found = found.unionByName(_meeting(loose.filter(F.col("n") <= LOOSE * crowd), similarity))
    many = stage(loose.filter(F.col("n") > LOOSE * crowd).select(F.col("head").alias("centre"), "row", "label").distinct(), "near-centres")
    if not many.isEmpty():
        found = found.unionByName(told_apart(many, False)[1])
    rarity.destroy()
    return few.unionByName(found).unionByName(linked)


def drop_near_duplicates(docs: DataFrame, text: str = "text", id_column: str = "doc_id", similarity: float = SIMILARITY, shingle: int = COPY_SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: one of each group, that with the smallest id.

    Groups are joined by pairs of texts that share ``similarity`` of their distinct five-word shingles.
    Fingerprints at most ``max_bits`` apart only name texts to compare, and so do shared slots: edits of a
    few words move more bits than a vantage-point tree can search. Texts that are then still apart are
    compared wherever their rarest shingles meet, which leaves no pair out.

    A null id comes last in its group. Null and empty texts are one group. Rows that repeat an id are
    documents of their own. ``docs`` is read several times and has to give the same rows in the same
    order each time, as a stored table does.
    """
    key = unused(docs, "_row")
    numbered = docs.withColumn(key, F.monotonically_increasing_id())
    texts = numbered.select(F.col(key).alias("row"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    marks = stage(_marks(texts, shingle), "near-marks")
    empty = marks.filter(F.size("slots") == 0).select("row")
    blank = empty.crossJoin(F.broadcast(empty.agg(F.min("row").alias("b")))).select(F.col("row").alias("a"), "b")
    tried = fingerprint_pairs(marks, max_bits).unionByName(slot_pairs(marks.select("row", "slots")))
    edges = stage(blank.unionByName(similar_pairs(tried, texts, similarity, shingle)), "near-found")
    rest = prefix_pairs(texts, connected(edges), similarity, shingle, crowd=CROWD)
    labels = connected(edges.unionByName(similar_pairs(rest, texts, similarity, shingle)))
    grouped = marks.select("row").join(labels.withColumnRenamed("node", "row"), "row", "left").select("row", F.coalesce("label", "row").alias("label"))
    ids = numbered.select(F.col(key).alias("row"), F.col(id_column).alias("id"))
    named = stage(grouped.join(ids, "row"), "near-grouped")
    first = named.groupBy("label").agg(F.min(F.struct(F.col("id").isNull().alias("last"), "id", "row")).alias("first"))
    first = stage(first.select("label", F.col("first.row").alias("stays")), "near-first")
    copies = Rows.of(named.join(first, "label").filter("row <> stays").select("row"))
    return numbered.filter(~_in(docs.sparkSession.sparkContext.broadcast(copies), F.col(key))).drop(key)
