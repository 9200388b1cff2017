"""Gradient-boosted trees by histograms: many models learn in one pass over the rows.

Rows carry the number of the part they train (a fold, or an arm and a fold); each part trains one model
per objective: a count model with a log link, or one model per quantile level. A tree level is one Spark job,
whatever the number of models: every task adds up gradient, curvature and rows per (model, node, input,
bin) over its rows, the sums meet per model, and only the chosen splits come back. So the rows stay
where they are, and what passes through the driver is bounded by models x 2^depth.

Inputs are coded once into at most 255 bins. Gradients are added up as whole numbers, so a result does not
depend on how rows are spread over tasks. Array sums have no SQL aggregate, hence the RDD steps.
"""
from __future__ import annotations

import math
import pickle
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame, Window, functions as F

from ..sources.staging import shared_dir, stage
from .joins import shuffle_width

#: Bins of a number beside the one for missing; categories that keep a bin of their own, by frequency.
BINS, CATEGORIES = 63, 254
#: Rows of a block, the unit that tasks work on.
BLOCK = 1 << 16
#: Gradients are whole multiples of 1 / GRAIN, quantile forecasts of 1 / GRID.
GRAIN, GRID = 1 << 20, 1 << 12
#: Rounds after which scores are written to the shared folder, which cuts their lineage.
CHECKPOINT = 25
#: Bits told apart in one counting pass of the leaf quantiles, at most.
DIGIT = 11


@dataclass(frozen=True)
class Settings:
    """Size of an ensemble: trees, shrinkage, levels of splits, rows a leaf needs."""

    rounds: int = 300
    step: float = 0.05
    depth: int = 5
    least_rows: int = 5
    ridge: float = 1e-3
    cat_smooth: float = 10.0
    #: Log steps of the count model are damped as if they were up to this long.
    max_delta: float = 0.7


@dataclass(frozen=True)
class Coder:
    """Bins of every input, per part, learned from that part's training rows."""

    numbers: tuple[str, ...]
    categories: tuple[str, ...]
    edges: dict[int, list[np.ndarray]]
    known: dict[int, list[dict[str, int]]]

    @property
    def inputs(self) -> list[str]:
        return [*self.numbers, *self.categories]

    @property
    def bins(self) -> int:
        """Bins of the input that has most, at most 256."""
        return max([1, *(len(e) + 2 for of in self.edges.values() for e in of), *(len(k) + 1 for of in self.known.values() for k in of)])

    def codes(self, part: int, columns: dict[str, pa.Array]) -> np.ndarray:
        """(row, input) bins; 0 for a missing number and for a category without a bin."""
        n = len(next(iter(columns.values())))
        out = np.zeros((n, len(self.inputs)), np.uint8)
        for i, (name, edges) in enumerate(zip(self.numbers, self.edges[part])):
            x = columns[name].cast(pa.float64()).to_numpy(zero_copy_only=False)
            out[:, i] = np.where(np.isnan(x), 0, 1 + np.searchsorted(edges, x))
        for i, (name, known) in enumerate(zip(self.categories, self.known[part]), len(self.numbers)):
            out[:, i] = [known.get(v, 0) for v in columns[name].to_pylist()]
        return out


def fit_coder(rows: DataFrame, numbers: Sequence[str], categories: Sequence[str], bins: int = BINS) -> Coder:
    """``rows``: part, the numbers, and the categories as strings. One aggregate for all numbers, one count
    per category; both results are bounded by parts x inputs x 255."""
    at = [k / bins for k in range(1, bins)]
    cuts = rows.groupBy("part").agg(*[F.percentile_approx(F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")), at).alias(c) for c in numbers])
    edges = {r["part"]: [np.unique(np.array(r[c] or [], float)) for c in numbers] for r in cuts.collect()}
    known: dict[int, list[dict[str, int]]] = {p: [{} for _ in categories] for p in edges}
    pairs = rows.select("part", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(c).alias("v")) for i, c in enumerate(categories)])).alias("c"))
    counts = pairs.where("c.v is not null").groupBy("part", "c.i", "c.v").agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy("part", "i").orderBy(F.desc("n"), "v"))
    for r in counts.withColumn("place", place).where(F.col("place") <= CATEGORIES).collect():
        known[r["part"]][r["i"]][r["v"]] = r["place"]
    return Coder(tuple(numbers), tuple(categories), edges, known)


@dataclass
class Block:
    """Coded rows, those of one part together: ``spans`` holds (part, first, last)."""

    spans: list[tuple[int, int, int]]
    codes: np.ndarray
    y: np.ndarray
    #: Score per row and objective.
    raw: np.ndarray


def pack(rows: DataFrame, coder: Coder, target: str, objectives: int, width: int, whole: bool = False) -> RDD:
    """The training rows as blocks, evenly over ``width`` partitions, or with ``whole`` those of a part together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, np.ndarray, np.ndarray]] = []

        def emptied() -> pa.RecordBatch:
            held.sort(key=lambda piece: piece[0])
            spans, start = [], 0
            for part, _, y in held:
                spans.append((part, start, start + len(y)))
                start += len(y)
            block = Block(spans, np.concatenate([c for _, c, _ in held]), np.concatenate([y for *_, y in held]), np.zeros((start, objectives)))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([pickle.dumps(block)], pa.binary())], names=["block"])

        n = 0
        for batch in batches:
            parts = batch.column("part").to_numpy()
            for part in np.unique(parts).tolist():
                some = batch.filter(pa.array(parts == part))
                codes = coder.codes(part, {c: some.column(c) for c in coder.inputs})
                held.append((part, codes, some.column(target).to_numpy(zero_copy_only=False).astype(float)))
            n += batch.num_rows
            if n >= BLOCK:
                yield emptied()
                n = 0
        if held:
            yield emptied()

    picked = rows.select("part", F.col(target).cast("double").alias(target), *coder.numbers, *coder.categories)
    spread = picked.repartitionById(width, F.pmod("part", F.lit(width)).cast("int")) if whole else picked.repartition(width)
    return spread.mapInArrow(run, "block binary").rdd.map(lambda r: pickle.loads(r["block"]))


@dataclass
class Tree:
    """Splits per level: the input of each node and its bins that go left. Leaves have ``2^depth`` numbers;
    below a node that is not split everything goes left."""

    features: list[np.ndarray] = field(default_factory=list)
    left: list[np.ndarray] = field(default_factory=list)
    values: np.ndarray | None = None

    def nodes(self, codes: np.ndarray) -> np.ndarray:
        node = np.zeros(len(codes), np.int64)
        flat, rows = codes.reshape(-1), np.arange(len(codes)) * codes.shape[1]
        for features, left in zip(self.features, self.left):
            right = (~left).reshape(-1)
            node = 2 * node + right.take(node * left.shape[1] + flat.take(rows + features.take(node)))
        return node


def _gradients(y: np.ndarray, raw: np.ndarray, level: float | None, settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Whole numbers: first and second derivative times GRAIN."""
    if level is not None:
        return np.rint(np.where(raw > y, 1 - level, -level) * GRAIN), np.full(len(y), float(GRAIN))
    mean = np.exp(raw)
    return np.rint((mean - y) * GRAIN), np.rint(mean * math.exp(settings.max_delta) * GRAIN)


def _models(block: Block, levels: Sequence[float | None]) -> Iterator[tuple[int, int, slice]]:
    """(model, objective, rows) of everything a block trains."""
    for part, first, last in block.spans:
        for j in range(len(levels)):
            yield part * len(levels) + j, j, slice(first, last)


def histograms(block: Block, trees: dict[int, Tree], levels: Sequence[float | None], bins: int, settings: Settings) -> Iterator[tuple[int, np.ndarray]]:
    """(model, sums): gradient, curvature and rows by node, input and bin."""
    for model, j, at in _models(block, levels):
        tree, codes = trees[model], block.codes[at]
        nodes = tree.nodes(codes) * bins
        count = 1 << len(tree.features)
        out = np.zeros((3, count, codes.shape[1], bins), np.int64)
        if levels[j] is not None:
            # Two gradients and one curvature: rows above and below their target are counted, not added up.
            (above, below), (curve, _) = _gradients(np.array([0.0, 0.0]), np.array([1.0, 0.0]), levels[j], settings)
            nodes = 2 * nodes + (block.raw[at, j] > block.y[at])
            for i in range(codes.shape[1]):
                under, over = np.bincount(nodes + 2 * codes[:, i].astype(np.int64), minlength=2 * count * bins).reshape(count, bins, 2).transpose(2, 0, 1)
                out[0, :, i], out[1, :, i], out[2, :, i] = over * int(above) + under * int(below), (over + under) * int(curve), over + under
            yield model, out
            continue
        g, h = _gradients(block.y[at], block.raw[at, j], None, settings)
        for i in range(codes.shape[1]):
            key = nodes + codes[:, i]
            for k, weights in enumerate((g, h, None)):
                out[k, :, i] = np.bincount(key, weights, count * bins).reshape(count, bins)
        yield model, out


def choose(sums: np.ndarray, categorical: np.ndarray, settings: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best split of every node: its input, the bins that go left, and the leaf values of both sides.

    Bins of a category are first put in order of their mean gradient. A split must leave enough rows on
    either side and lower the loss; the first input and the first cut win ties.
    """
    bins = sums.shape[-1]
    order = np.broadcast_to(np.arange(bins), sums.shape[1:]).copy()
    g, h, n = sums[:, :, categorical]
    mean = np.where(n > 0, g / (h + settings.cat_smooth * GRAIN), np.inf)
    order[:, categorical] = np.argsort(mean, axis=2, kind="stable")
    # Sums of whole numbers stay exact; they are scaled afterwards.
    gl, hl, nl = np.take_along_axis(sums, order[None], axis=3).cumsum(axis=3)
    gl, hl = gl / GRAIN, hl / GRAIN
    g_all, h_all, n_all = gl[..., -1:], hl[..., -1:], nl[..., -1:]
    score = lambda a, b: a * a / (b + settings.ridge)
    gain = score(gl, hl) + score(g_all - gl, h_all - hl) - score(g_all, h_all)
    gain = np.where((nl >= settings.least_rows) & (n_all - nl >= settings.least_rows), gain, 0.0)
    flat = gain.reshape(len(gain), -1)
    best = flat.argmax(axis=1)
    feature, cut = best // bins, best % bins
    nodes = np.arange(len(best))
    split = flat[nodes, best] > 1e-9
    rank = np.argsort(order[nodes, feature], axis=1)
    left = np.where(split[:, None], rank <= cut[:, None], True)
    value = lambda a, b: -a / (b + settings.ridge)
    gl, hl, g_all, h_all = gl[nodes, feature, cut], hl[nodes, feature, cut], g_all[:, 0, 0], h_all[:, 0, 0]
    lefts = np.where(split, value(gl, hl), value(g_all, h_all))
    rights = np.where(split, value(g_all - gl, h_all - hl), 0.0)
    return np.where(split, feature, 0), left, np.stack([lefts, rights], axis=1).reshape(-1)


def digits(block: Block, trees: dict[int, Tree], levels: Sequence[float], found: dict[int, np.ndarray], shift: int, digit: int, offset: int) -> Iterator[tuple[int, np.ndarray]]:
    """(model, counts): rows by leaf and by the next ``digit`` bits of their residual, among those whose
    higher bits are the ``found`` ones."""
    for model, j, at in _models(block, levels):
        residual = np.rint((block.y[at] - block.raw[at, j]) * GRID).astype(np.int64) + offset
        leaf = trees[model].nodes(block.codes[at])
        mine = residual >> (shift + digit) == found[model][leaf]
        count = len(found[model])
        key = (leaf[mine] << digit) + (residual[mine] >> shift & (1 << digit) - 1)
        yield model, np.bincount(key, minlength=count << digit).reshape(count, -1)


def _summed(blocks: RDD, emit, models: int, whole: bool = False) -> RDD:
    """What ``emit`` yields per block, added up per model: in each partition, then, if a model's rows may lie
    in several (not with ``whole``), across them."""

    def run(some: Iterator[Block]) -> Iterator[tuple[int, np.ndarray]]:
        sums: dict[int, np.ndarray] = {}
        for block in some:
            for model, found in emit(block):
                sums[model] = sums[model] + found if model in sums else found
        return iter(sums.items())

    parts = blocks.mapPartitions(run)
    width = blocks.getNumPartitions()
    return parts if whole or width == 1 else parts.reduceByKey(np.add, min(models, width))


def next_digit(count: np.ndarray, found: np.ndarray, wanted: np.ndarray | None, level: float, digit: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``found`` bits of every leaf with the next ``digit`` ones, and the rank still ``wanted`` among the rows
    that share them. ``count`` has rows by leaf and digit; the first pass, which wants nothing yet, sets the ranks."""
    below = count.cumsum(axis=1)
    if wanted is None:
        wanted = np.maximum(1, np.ceil(level * below[:, -1] - 1e-9)).astype(np.int64)
        found = np.where(below[:, -1] > 0, 0, -1)  # a leaf without rows stays negative
    next_bits = (below < wanted[:, None]).sum(axis=1)
    before = np.take_along_axis(below, np.maximum(next_bits - 1, 0)[:, None], axis=1)[:, 0]
    wanted = wanted - np.where(next_bits > 0, before, 0)
    return found << digit | np.minimum(next_bits, (1 << digit) - 1), wanted


def leaf_quantiles(blocks: RDD, trees: dict[int, Tree], levels: Sequence[float], bits: int, offset: int, whole: bool = False) -> dict[int, np.ndarray]:
    """Exact lower quantile of the residuals in every leaf (0 where there are none), to 1 / GRID.

    Some bits of it a pass, from the top: a fixed number of counting passes, in which no task sorts or
    gathers rows. Counts are read where they were added up; two numbers a leaf come back.
    """
    passes = -(-bits // DIGIT)
    digit = -(-bits // passes)
    found = {m: np.zeros(1 << len(t.features), np.int64) for m, t in trees.items()}
    wanted: dict[int, np.ndarray] = {}
    for shift in range((passes - 1) * digit, -1, -digit):
        counts = _summed(blocks, lambda b, f=dict(found), s=shift: digits(b, trees, levels, f, s, digit, offset), len(trees), whole)

        def read(item: tuple[int, np.ndarray], found=dict(found), wanted=dict(wanted)) -> tuple[int, tuple[np.ndarray, np.ndarray]]:
            model, count = item
            return model, next_digit(count, found[model], wanted.get(model), levels[model % len(levels)], digit)

        for model, (bits_so_far, rank) in counts.map(read).collect():
            found[model], wanted[model] = bits_so_far, rank
    return {model: np.where(f < 0, 0.0, (f - offset) / GRID) for model, f in found.items()}


def _moved(block: Block, trees: dict[int, Tree], levels: Sequence[float | None], bounds: tuple[float, float] | None) -> Block:
    raw = block.raw.copy()
    for model, j, at in _models(block, levels):
        raw[at, j] += trees[model].values[trees[model].nodes(block.codes[at])]
    return Block(block.spans, block.codes, block.y, raw if bounds is None else raw.clip(*bounds))


@dataclass
class Boosted:
    """Fitted models. ``levels`` has the quantiles, or a single None for counts."""

    coder: Coder
    levels: tuple[float | None, ...]
    start: dict[int, float]
    trees: list[dict[int, Tree]]
    bounds: tuple[float, float] | None

    def scores(self, part: int, codes: np.ndarray) -> np.ndarray:
        """(row, objective) forecasts, never below zero."""
        out = np.zeros((len(codes), len(self.levels)))
        for j in range(len(self.levels)):
            model = part * len(self.levels) + j
            raw = np.full(len(codes), self.start[model])
            for trees in self.trees:
                raw += trees[model].values[trees[model].nodes(codes)]
                if self.bounds is not None:
                    raw = raw.clip(*self.bounds)
            out[:, j] = np.exp(raw) if self.bounds is None else raw
        return np.maximum(out, 0.0)

    def predict(self, rows: DataFrame, keep: Sequence[str]) -> DataFrame:
        """The columns ``keep`` and ``forecasts``, one per objective. Rows of a part without training rows
        fail the job."""
        sent = rows.sparkSession.sparkContext.broadcast(self)
        kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            fitted: Boosted = sent.value
            for batch in batches:
                parts = batch.column("_part").to_numpy()
                for part in np.unique(parts).tolist():
                    some = batch.filter(pa.array(parts == part))
                    codes = fitted.coder.codes(part, {c: some.column(f"_in_{c}") for c in fitted.coder.inputs})
                    scores = fitted.scores(part, codes)
                    yield pa.RecordBatch.from_arrays([*(some.column(c) for c in keep), pa.array(scores.tolist(), pa.list_(pa.float64()))], names=[*keep, "forecasts"])

        picked = rows.select(*keep, F.col("part").alias("_part"), *[F.col(c).alias(f"_in_{c}") for c in self.coder.inputs])
        return picked.mapInArrow(run, f"{kinds}, forecasts array<double>")

    def importance(self) -> list[tuple[int, float | None, str, float]]:
        """(part, level, input, share of the splits)."""
        out = []
        for model in sorted(self.start):
            uses = np.zeros(len(self.coder.inputs))
            for trees in self.trees:
                for features, left in zip(trees[model].features, trees[model].left):
                    np.add.at(uses, features, ~left.all(axis=1))
            part, j = divmod(model, len(self.levels))
            out += [(part, self.levels[j], name, float(u / max(1.0, uses.sum()))) for name, u in zip(self.coder.inputs, uses)]
        return out


def grow(blocks: RDD, models: Sequence[int], levels: Sequence[float | None], categorical: np.ndarray, bins: int, settings: Settings, whole: bool = False) -> dict[int, Tree]:
    """One tree for every model, a job a level; leaves get the Newton step of their sums."""
    trees = {m: Tree() for m in models}
    for _ in range(settings.depth):
        sums = _summed(blocks, lambda b, t=trees: histograms(b, t, levels, bins, settings), len(trees), whole)
        grown = dict(trees)
        for model, (features, left, values) in sums.mapValues(lambda s: choose(s, categorical, settings)).collect():
            old = trees[model]
            grown[model] = Tree([*old.features, features], [*old.left, left], values * settings.step)
        trees = grown
    return trees


def train(rows: DataFrame, target: str, numbers: Sequence[str], categories: Sequence[str], levels: Sequence[float] | None = None, settings: Settings = Settings()) -> Boosted:
    """Fit one ensemble per part and objective. ``rows``: part (from 0), target, inputs; counts unless
    quantile ``levels`` are given. Rows without a target fail the job."""
    spark = rows.sparkSession
    bad = F.when(F.col(target).isNull(), F.raise_error(F.lit("a training row has no target")).cast("double"))
    checked = rows.select("part", bad.otherwise(F.col(target).cast("double")).alias(target), *numbers, *categories)
    checked = stage(checked, "boosting-rows")  # read by the coder, the sums and the packing
    coder = fit_coder(checked, numbers, categories)
    stats = {r["part"]: r for r in checked.groupBy("part").agg(F.count("*").alias("n"), F.avg(target).alias("mean"), F.min(target).alias("low"), F.max(target).alias("high")).collect()}
    if not stats:
        raise ValueError("no training rows")
    objectives = (None,) if levels is None else tuple(levels)
    models = [part * len(objectives) + j for part in sorted(stats) for j in range(len(objectives))]
    # Parts that a block holds stay whole: a task then adds up its own models, and no sums move.
    whole = max(r["n"] for r in stats.values()) <= BLOCK
    width = max(1, min(shuffle_width(rows), len(stats) if whole else -(-sum(r["n"] for r in stats.values()) // BLOCK)))
    categorical = np.array([False] * len(numbers) + [True] * len(categories))
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(f"{shared_dir(spark)}/larder/{sc.applicationId}/boosting")
    blocks = pack(checked, coder, target, len(objectives), width, whole).persist(StorageLevel.MEMORY_AND_DISK)
    bounds, bits, offset = None, 0, 0
    if levels is None:
        start = {m: math.log(max(stats[m]["mean"], 1e-9)) for m in models}
    else:
        bounds = (min(r["low"] for r in stats.values()), max(r["high"] for r in stats.values()))
        # Scores move from 0 first, then stay between the targets.
        offset = math.ceil(max(bounds[1], 0) - min(bounds[0], 0) + 1) * GRID
        bits = (2 * offset).bit_length()
        root = {m: Tree() for m in models}
        start = {m: float(v[0]) for m, v in leaf_quantiles(blocks, root, objectives, bits, offset, whole).items()}
    first = {m: Tree(values=np.array([start[m]])) for m in models}
    done: list[dict[int, Tree]] = []
    trees = first
    for number in range(settings.rounds):
        last, blocks = blocks, blocks.map(lambda b, t=trees: _moved(b, t, objectives, bounds)).persist(StorageLevel.MEMORY_AND_DISK)
        if number % CHECKPOINT == CHECKPOINT - 1:
            blocks.checkpoint()
        trees = grow(blocks, models, objectives, categorical, coder.bins, settings, whole)
        last.unpersist()
        if levels is not None:
            exact = leaf_quantiles(blocks, trees, objectives, bits, offset, whole)
            for model, tree in trees.items():
                tree.values = np.rint(exact[model] * settings.step * GRID) / GRID
        done.append(trees)
    blocks.unpersist()
    return Boosted(coder, objectives, start, done, bounds)
