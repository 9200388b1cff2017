"""Product codes of vectors: each of four parts is replaced by the index of its nearest codebook entry.

Nearest entries are found through memoised grid cells. Integer space is cut into boxes; for the box a part
lies in, entries whose least distance to the box exceeds the smallest greatest distance of any entry cannot
be nearest to anything inside. The others are kept under the box, and only they are measured exactly.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from ..sources.staging import stage

PARTS = 4
ENTRIES = 256
ROUNDS = 4
#: Components are counted in parts of a unit.
SCALE = 1024
#: Side of a box, as a power of two.
CELL_BITS = 5
#: Boxes a task remembers for one part; beyond, it starts anew, which changes no result.
HELD_CELLS = 20_000
#: Rows measured together.
ROWS = 2048
#: Components beyond this would not leave room for exact distances.
LIMIT = 1 << 27


class Grid:
    """Exact nearest entries of one codebook (entries x width), by box."""

    def __init__(self, entries: np.ndarray, cell_bits: int = CELL_BITS, held: int = HELD_CELLS):
        self.entries, self.bits, self.held = entries, cell_bits, held
        self.cells: dict[bytes, np.ndarray] = {}

    def candidates(self, cells: np.ndarray) -> list[np.ndarray]:
        """Indexes, ascending, of the entries that can be nearest to a point of each box."""
        keys = [c.tobytes() for c in cells]
        new = [i for i, k in enumerate(keys) if k not in self.cells]
        if len(self.cells) + len(new) > self.held:
            self.cells, new = {}, list(range(len(keys)))
        for at in range(0, len(new), 64):
            some = new[at : at + 64]
            low = (cells[some] << self.bits)[:, None, :]
            before, after = low - self.entries, self.entries - (low + (1 << self.bits) - 1)
            least = (np.maximum(np.maximum(before, after), 0) ** 2).sum(axis=2)
            most = (np.maximum(np.abs(before), np.abs(after)) ** 2).sum(axis=2)
            possible = least <= most.min(axis=1, keepdims=True)
            for i, row in zip(some, possible):
                self.cells[keys[i]] = np.flatnonzero(row)
        return [self.cells[k] for k in keys]

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index and squared distance of every point's nearest entry, the lower index where two are."""
        if not points.shape[1]:
            return np.zeros(len(points), np.int64), np.zeros(len(points), np.int64)
        cells, of = np.unique(points >> self.bits, axis=0, return_inverse=True)
        lists = self.candidates(cells)
        of = of.reshape(-1)
        counts = np.array([len(x) for x in lists])[of]
        starts = np.cumsum(counts) - counts
        tried = np.concatenate([lists[c] for c in of])
        apart = ((np.repeat(points, counts, axis=0) - self.entries[tried]) ** 2).sum(axis=1)
        best = np.minimum.reduceat(apart, starts)
        hits = np.flatnonzero(apart == np.repeat(best, counts))
        return tried[hits[np.searchsorted(hits, starts)]], best


def integers(vectors: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """floor(SCALE * x) of the vectors without null or non-finite components, and their row numbers."""
    values = vectors.flatten()
    sizes = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False)
    flat = values.cast(pa.float64()).to_numpy(zero_copy_only=False)  # a null turns into NaN
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
    ends = np.cumsum(sizes)
    valid = pc.is_valid(vectors).to_numpy(zero_copy_only=False)
    kept = np.flatnonzero(valid & (bad[ends] == bad[ends - sizes]))
    widths = set(sizes[kept].tolist())
    if len(widths) > 1 or any(w % PARTS for w in widths):
        raise ValueError(f"vectors need one common length that {PARTS} divides, found {sorted(widths)}")
    width = widths.pop() if widths else 0
    scaled = np.floor(SCALE * flat[(ends - sizes)[kept][:, None] + np.arange(width)])
    if scaled.size and np.abs(scaled).max() >= LIMIT:
        raise ValueError(f"components from {LIMIT // SCALE} on are too large for exact distances")
    return scaled.astype(np.int64), kept


def _pieces(batches: Iterator[pa.RecordBatch], vector: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Rows that stay, some at a time, with their components."""
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS):
            part = batch.slice(start, ROWS)
            points, kept = integers(part.column(vector))
            if len(kept):
                yield part.take(pa.array(kept)), points


def _split(points: np.ndarray) -> np.ndarray:
    """(part, row, component)."""
    return points.reshape(len(points), PARTS, -1).transpose(1, 0, 2)


def first_entries(rows: DataFrame, entries: int) -> np.ndarray | None:
    """Codebooks (part, entry, component) cut from the rows with the smallest ids; None without rows."""
    kind = rows.schema["vec_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, points in _pieces(batches, "vector"):
            yield pa.RecordBatch.from_arrays([part.column("vec_id"), pa.array(points.tolist(), pa.list_(pa.int64()))], names=["vec_id", "points"])

    kept = rows.mapInArrow(run, f"vec_id {kind}, points array<bigint>")
    first = kept.orderBy(F.asc_nulls_last("vec_id"), "points").limit(entries).collect()
    widths = {len(r["points"]) for r in first}
    if len(widths) > 1:
        raise ValueError(f"vectors need one common length, found {sorted(widths)}")
    return _split(np.array([r["points"] for r in first], np.int64)).copy() if first else None


def refined(rows: DataFrame, books: np.ndarray, cell_bits: int) -> np.ndarray:
    """Every entry replaced by floor(sum / count) of the parts nearest to it; unused entries stay.

    Each task adds up its own parts, so what is shuffled and read back is as large as the codebooks.
    """
    n_entries, width = books.shape[1:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grids = [Grid(book, cell_bits) for book in books]
        sums = np.zeros((PARTS, n_entries, width + 1), np.int64)  # the last one counts
        for _, points in _pieces(batches, "vector"):
            for p, part in enumerate(_split(points)):
                code, _ = grids[p].nearest(part)
                np.add.at(sums[p], code, np.pad(part, ((0, 0), (0, 1)), constant_values=1))
        place = np.flatnonzero(sums)
        if len(place):
            yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(sums.reshape(-1)[place])], names=["place", "total"])

    found = rows.mapInArrow(run, "place bigint, total bigint").groupBy("place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    sums = np.zeros(books.shape[:2] + (width + 1,), object)
    for row in found.collect():
        sums.reshape(-1)[row["place"]] = int(row["total"])
    out, used = books.copy(), sums[..., -1] > 0
    out[used] = (sums[used][:, :-1] // sums[used][:, -1:]).astype(np.int64)
    return out


def encoded(rows: DataFrame, books: np.ndarray, cell_bits: int) -> DataFrame:
    """(vec_id, label, code, error) of every row that stays."""
    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("vec_id", "label")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grids = [Grid(book, cell_bits) for book in books]
        for part, points in _pieces(batches, "vector"):
            found = [grids[p].nearest(piece) for p, piece in enumerate(_split(points))]
            codes = np.stack([f[0] for f in found], axis=1).astype(np.uint8)
            code = pa.array([row.tobytes().hex() for row in codes])
            yield pa.RecordBatch.from_arrays([part.column("vec_id"), part.column("label"), code, pa.array(sum(f[1] for f in found))], names=["vec_id", "label", "code", "error"])

    return rows.mapInArrow(run, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error bigint")


def compress_vectors(
    table: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", entries: int = ENTRIES, rounds: int = ROUNDS, cell_bits: int = CELL_BITS
) -> DataFrame:
    """Rows (vec_id, code, error, label_error, codebooks_sha256).

    ``code`` has two hex digits per part, ``error`` is the squared distance to the entries named by it,
    ``label_error`` that error summed over the rows with the same label. Codebooks start from the
    ``entries`` (at most 256) rows with the smallest ids and are refined ``rounds`` times; with fewer rows
    they are shorter. They are all that passes through the driver.

    Null vectors and vectors with null or non-finite components are dropped. The others need one common
    length that four divides, and components below 131,072 in size; else the job fails. An empty vector has
    error 0. Repeated rows each count; among equal ids the smaller vector comes first, and a missing id
    last. Rows without a label are one group. An empty table gives no rows. Other columns are not read.
    """
    if not 0 < entries <= 256:
        raise ValueError("a code has two hex digits, so 1 to 256 entries")
    rows = table.select(F.col(vec_id).alias("vec_id"), F.col(vector).alias("vector"), F.col(label).alias("label"))
    books = first_entries(rows, entries)
    if books is None:
        books = np.zeros((PARTS, 1, 0), np.int64)
    for _ in range(rounds if books.size else 0):
        books = refined(rows, books, cell_bits)
    digest = hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()
    done = stage(encoded(rows, books, cell_bits), "vector-codes")
    # A missing label is a group of its own: the second column keeps it apart from every real one.
    key = [F.col("label").isNull().alias("unlabelled"), F.col("label").cast("string").alias("label_key")]
    done = done.select("vec_id", "code", "error", key[0], F.coalesce(key[1], F.lit("")).alias("label_key"))
    sums = done.groupBy("unlabelled", "label_key").agg(F.sum("error").alias("label_error"))
    return done.join(sums, ["unlabelled", "label_key"]).select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
