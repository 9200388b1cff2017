"""Benchmark decontamination with suffix arrays over training shards.

Documents are read in shards of bounded size. A task sorts the word suffixes of its shard into a suffix
array and binary-searches every test suffix in it; the hits, joined along their diagonals, are the
longest verbatim matches with their places. Only suffixes that begin like some test suffix are sorted,
the others could not be found. Words are looked up by a 64-bit hash; every word inside a hit is then
compared as bytes.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, functions as F

from ..sources.staging import stage
from .columns import unused

WINDOW_WORDS = 10
#: Text of a shard; one document alone may be larger.
SHARD_BYTES = 4 << 20
#: Test words searched in one pass over the documents. More of them are searched in several passes.
BLOCK_WORDS = 1 << 20
#: Bytes hashed at a time.
_PIECE = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)

_BYTES = np.arange(256)
_LOWER = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, _BYTES).astype(np.uint8)
_IN_WORD = ((_BYTES >= 48) & (_BYTES <= 57)) | ((_LOWER >= 97) & (_LOWER <= 122)) | (_BYTES >= 128)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        up, down = np.full(n, _BASE, np.uint64), np.full(n, inverse, np.uint64)
        up[0] = down[0] = 1
        return np.cumprod(up), np.cumprod(down)


def words_of(data: np.ndarray, cuts: np.ndarray, powers: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, hashes) of the words in ``data``; no word reaches over a place in ``cuts``."""
    inside = _IN_WORD[data]
    joined = inside[1:] & inside[:-1]
    joined[cuts[(cuts > 0) & (cuts < len(data))] - 1] = False
    starts = np.flatnonzero(inside & ~np.concatenate(([False], joined)))
    ends = np.flatnonzero(inside & ~np.concatenate((joined, [False]))) + 1
    hashes = np.empty(len(starts), np.uint64)
    up, down = powers
    at = 0
    while at < len(starts):
        # As many whole words as fit into the piece, one at least.
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + _PIECE, "right")))
        low, high = starts[at], ends[to - 1]
        if high - low >= len(up):
            up, down = _powers(int(high - low) + 1)
        with np.errstate(over="ignore"):
            sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((_LOWER[data[low:high]].astype(np.uint64) + np.uint64(1)) * up[: high - low])))
            hashes[at:to] = (sums[ends[at:to] - low] - sums[starts[at:to] - low]) * down[starts[at:to] - low] + (ends - starts)[at:to].astype(np.uint64) * _BASE
        at = to
    return starts, ends, hashes


def _keys(matrix: np.ndarray) -> np.ndarray:
    """Rows of word numbers as byte strings in the same order."""
    return np.ascontiguousarray(matrix.astype(">u4")).view(f"S{4 * matrix.shape[1]}").ravel()


def _ranges(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which range, element) of every element of the half-open ranges."""
    sizes = high - low
    which = np.repeat(np.arange(len(low)), sizes)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + low[which]


@dataclass
class TestIndex:
    """The suffixes of the test items of one block, as far as a window reaches."""

    vocabulary: np.ndarray  # sorted word hashes; a word's number is its place + 1
    words: list[bytes]
    windows: np.ndarray  # distinct windows, a row each, 0 after a short one
    lengths: np.ndarray
    first: np.ndarray  # places in a posting list of (item, place in the item), by window
    items: np.ndarray
    places: np.ndarray
    names: list[str]

    @classmethod
    def build(cls, rows: list[tuple[str, str]], window: int) -> TestIndex:
        texts, names = [], []
        powers = _powers(_PIECE + 1)
        hashes: dict[bytes, int] = {}
        for name, text in rows:
            raw = text.encode()
            starts, ends, hashed = words_of(np.frombuffer(raw, np.uint8), np.zeros(0, int), powers)
            low = raw.lower()
            found = [low[s:e] for s, e in zip(starts.tolist(), ends.tolist())]
            if found:
                hashes.update(zip(found, hashed.tolist()))
                texts.append(found)
                names.append(name)
        if not texts:
            none = np.zeros(0, np.int64)
            return cls(none.astype(np.uint64), [], np.zeros((0, window), np.int64), none, np.zeros(1, np.int64), none, none, [])
        order = sorted(hashes, key=hashes.__getitem__)
        if len(set(hashes.values())) < len(order):
            raise ValueError("two test words share a hash")
        numbers = {w: k + 1 for k, w in enumerate(order)}
        distinct = sorted(set(names))
        rank = {n: k for k, n in enumerate(distinct)}
        rows_, items, places = [], [], []
        for name, found in zip(names, texts):
            ids = [numbers[w] for w in found]
            for at in range(max(1, len(ids) - window + 1)):
                rows_.append((ids[at : at + window] + [0] * window)[:window])
                items.append(rank[name])
                places.append(at)
        matrix = np.array(rows_, np.int64)
        keys = _keys(matrix)
        _, example, of = np.unique(keys, return_index=True, return_inverse=True)
        by_window = np.argsort(of, kind="stable")
        windows = matrix[example]
        return cls(
            np.array([hashes[w] for w in order], np.uint64),
            order,
            windows,
            (windows > 0).sum(axis=1),
            np.concatenate(([0], np.cumsum(np.bincount(of, minlength=len(example))))),
            np.array(items)[by_window],
            np.array(places)[by_window],
            distinct,
        )

    def starts_like(self, ids: np.ndarray) -> np.ndarray:
        """Places in ``ids`` whose next words begin some window."""
        if not self.words:
            return np.zeros(0, np.int64)
        depth = min(3, int(self.lengths.min()))
        size = len(self.words) + 1
        known = np.zeros(size, bool)
        known[self.windows[:, 0]] = True
        at = np.flatnonzero(known[ids[: len(ids) - depth + 1]])
        for k in range(2, depth + 1):
            mix = lambda columns: sum(c.astype(np.uint64) * _BASE ** np.uint64(j) for j, c in enumerate(columns))
            with np.errstate(over="ignore"):
                have = np.unique(mix([self.windows[:, j] for j in range(k)]))
                seen = mix([ids[at + j] for j in range(k)])
            near = np.minimum(np.searchsorted(have, seen), len(have) - 1)
            at = at[have[near] == seen]
        return at


def search_shard(index: TestIndex, ids: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(window number, place) of every occurrence in a shard's word numbers, by its suffix array."""
    padded = np.concatenate((ids, np.zeros(window, ids.dtype)))
    suffixes = index.starts_like(padded)
    keys = _keys(padded[suffixes[:, None] + np.arange(window)]) if len(suffixes) else np.zeros(0, f"S{4 * window}")
    order = np.argsort(keys, kind="stable")
    array, keys = suffixes[order], keys[order]
    above = np.where(index.windows > 0, index.windows, 0xFFFFFFFF)
    which, at = _ranges(np.searchsorted(keys, _keys(index.windows), "left"), np.searchsorted(keys, _keys(above), "right"))
    return which, array[at]


def _shards(offsets: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    low = 0
    while low < len(offsets) - 1:
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + limit, "right")) - 1)
        yield low, high
        low = high


def _scan_shard(index: TestIndex, data: np.ndarray, offsets: np.ndarray, window: int, powers: tuple[np.ndarray, np.ndarray]) -> list[dict]:
    """A dict per document of the shard: n_words, hits, matches."""
    n = len(offsets) - 1
    starts, ends, hashes = words_of(data, offsets, powers)
    doc = np.searchsorted(offsets, starts, "right") - 1
    words = np.bincount(doc, minlength=n)
    number = np.zeros(len(starts), np.int64)
    if index.words:
        near = np.minimum(np.searchsorted(index.vocabulary, hashes), len(index.words) - 1)
        number = np.where(index.vocabulary[near] == hashes, near + 1, 0)
    first = np.concatenate(([0], np.cumsum(words)))
    place = np.arange(len(starts)) + doc  # a 0 between documents
    ids = np.zeros(len(starts) + n, np.int64)
    ids[place] = number
    while True:
        which, at = search_shard(index, ids, window)
        span = np.zeros(len(ids) + 1, np.int64)
        np.add.at(span, at, 1)
        np.add.at(span, at + index.lengths[which], -1)
        hit = np.cumsum(span)[:-1] > 0
        covered = np.flatnonzero(hit[place])
        wrong = [k for k in covered.tolist() if data[starts[k] : ends[k]].tobytes().lower() != index.words[number[k] - 1]]
        if not wrong:
            break
        ids[place[wrong]] = 0  # another word with the hash of a test word
    # Occurrences to (document, item, diagonal), each run of neighbours one match.
    entry, post = _ranges(index.first[which], index.first[which + 1])
    where, item, inner = at[entry], index.items[post], index.places[post]
    length = index.lengths[which[entry]]
    owner = np.searchsorted(first + np.arange(n + 1), where, "right") - 1
    order = np.lexsort((where, where - inner, item, owner))
    owner, item, inner, where, length = (a[order] for a in (owner, item, inner, where, length))
    new = np.ones(len(where), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (item[1:] != item[:-1]) | (where[1:] - inner[1:] != where[:-1] - inner[:-1]) | (where[1:] != where[:-1] + 1)
    heads = np.flatnonzero(new)
    tails = np.concatenate((heads[1:], [len(where)])) - 1 if len(heads) else heads
    edge = np.flatnonzero(np.diff(np.concatenate(([0], hit.astype(np.int8), [0]))))
    hit_start, hit_end = edge[::2], edge[1::2]
    hit_owner = np.searchsorted(first + np.arange(n + 1), hit_start, "right") - 1
    out: list[dict] = [{"n_words": w, "hits": [], "matches": []} for w in words.tolist()]
    for d, s, e in zip(hit_owner.tolist(), hit_start.tolist(), hit_end.tolist()):
        base = int(first[d]) + d
        out[d]["hits"].append({"start": s - base, "end": e - base})
    for h, t in zip(heads.tolist(), tails.tolist()):
        d = int(owner[h])
        base = int(first[d]) + d
        out[d]["matches"].append(
            {"item_id": index.names[item[h]], "item_start": int(inner[h]), "start": int(where[h]) - base, "words": int(where[t] + length[t] - where[h])}
        )
    return out


_HITS = "array<struct<start: int, end: int>>"
_MATCHES = "array<struct<item_id: string, item_start: int, start: int, words: int>>"
_HITS_ARROW = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
_MATCHES_ARROW = pa.list_(pa.struct([("item_id", pa.string()), ("item_start", pa.int32()), ("start", pa.int32()), ("words", pa.int32())]))


def _scan(docs: DataFrame, index, window: int, shard_bytes: int) -> DataFrame:
    """One pass: the shards of ``docs`` (row, doc_id, text) against one block of test items."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tests = index.value
        powers = _powers(_PIECE + 1)
        for batch in batches:
            texts = batch.column("text").cast(pa.large_binary())
            offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
            data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
            found: list[dict] = []
            for low, high in _shards(offsets, shard_bytes):
                piece = data[offsets[low] : offsets[high]]
                found += _scan_shard(tests, piece, offsets[low : high + 1] - offsets[low], window, powers)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("row"),
                    batch.column("doc_id"),
                    pa.array([f["n_words"] for f in found], pa.int64()),
                    pa.array([f["hits"] for f in found], _HITS_ARROW),
                    pa.array([f["matches"] for f in found], _MATCHES_ARROW),
                ],
                names=["row", "doc_id", "n_words", "hits", "matches"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(scan, f"row bigint, doc_id {kind}, n_words bigint, hits {_HITS}, matches {_MATCHES}")


def _covered(hits: Column) -> Column:
    """Words inside the union of the intervals."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("to"))

    def add(state: Column, hit: Column) -> Column:
        more = F.greatest(F.lit(0), hit["end"] - F.greatest(state["to"], hit["start"]))
        return F.struct((state["n"] + more).alias("n"), F.greatest(state["to"], hit["end"]).alias("to"))

    return F.aggregate(F.array_sort(hits), start, add, lambda s: s["n"])


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    id_column: str = "doc_id",
    item_text: str = "text",
    item_id: str = "item_id",
    window: int = WINDOW_WORDS,
    shard_bytes: int = SHARD_BYTES,
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, items, matches.

    A window is ``window`` neighbouring words of an item, or all words of a shorter one. ``n_hit`` counts
    the document's words inside any occurrence, ``items`` are the ids (as strings, sorted) of the items
    with occurring windows, and ``matches`` the longest verbatim matches: item_id, item_start, start and
    words, counted in words.

    A null text has no words; an item without words has no window; an item without id is listed as an
    empty id, items that repeat an id are one. Repeated documents are searched each on its own row. An
    empty benchmark hits nothing, no documents give no rows. Other columns are not read.

    The benchmark is read in blocks of about ``block_words`` words, and each block is sent to the tasks:
    its size is bounded, and a larger benchmark takes more passes over the documents. Then ``docs`` has
    to give the same rows in the same order each time, as a stored table does.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_column).alias("doc_id"), F.col(text).alias("text"))
    found, _ = _contamination(rows, benchmark, item_text, item_id, window, shard_bytes, block_words)
    names = F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["item_id"])))
    return found.select("doc_id", "n_words", _covered(F.col("hits")).alias("n_hit"), names.alias("items"), "matches")


def _contamination(docs: DataFrame, benchmark: DataFrame, item_text: str, item_id: str, window: int, shard_bytes: int, block_words: int) -> tuple[DataFrame, list[Broadcast]]:
    """(row, doc_id, n_words, hits, matches) of (row, doc_id, text), and what was sent to the tasks for it."""
    spark = docs.sparkSession
    rows = docs.withColumn("text", F.coalesce(F.col("text"), F.lit("")))
    tests = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("name"), F.coalesce(F.col(item_text), F.lit("")).alias("text"))
    total = tests.agg(F.sum(F.regexp_count("text", F.lit("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+")))).first()[0] or 0
    n_blocks = max(1, -(-int(total) // block_words))
    passes, sent = [], []
    for block in range(n_blocks):
        part = tests.filter(F.pmod(F.xxhash64("name", "text"), F.lit(n_blocks)) == block)
        index = TestIndex.build([(r[0], r[1]) for r in part.toLocalIterator()], window)
        sent.append(spark.sparkContext.broadcast(index))
        passes.append(_scan(rows, sent[-1], window, shard_bytes))
    found = passes[0]
    if len(passes) > 1:
        for more in passes[1:]:
            found = found.unionByName(more)
        found = found.groupBy("row", "doc_id").agg(
            F.max("n_words").alias("n_words"), F.flatten(F.collect_list("hits")).alias("hits"), F.flatten(F.collect_list("matches")).alias("matches")
        )
    return found, sent


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` without any hit, with all their columns. Rows that repeat an id, or have none,
    are judged each on its own. ``docs`` is read twice and has to give the same rows in the same order
    each time, as a stored table does."""
    key = unused(docs, "_row")
    numbered = docs.withColumn(key, F.monotonically_increasing_id())
    rows = numbered.select(F.col(key).alias("row"), F.col(id_column).alias("doc_id"), F.col(text).alias("text"))
    found, sent = _contamination(rows, benchmark, "text", "item_id", WINDOW_WORDS, SHARD_BYTES, BLOCK_WORDS)
    # Stored first, so that Spark knows its size and moves the documents only if it is large.
    hit = stage(found.filter(F.size("hits") > 0).select(F.col("row").alias(key)).distinct(), "hit-rows")
    for index in sent:
        index.destroy()
    return numbered.join(hit, key, "left_anti").drop(key)
