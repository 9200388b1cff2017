"""Language identification by unigrams of pieces, summed over every segmentation of a text.

Each language has a probability for every piece of a fixed public vocabulary. A word may be cut into pieces
in many ways; its probability is the sum over all of them of the product of the pieces' probabilities, which
the forward algorithm adds up from left to right. A text is the product of its words. The probabilities are
learned by expectation maximisation: the forward-backward algorithm gives how often each piece is expected
in each word, over all segmentations, and a round replaces the probabilities by those expected shares.
"""
from __future__ import annotations

import base64
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import cache
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from ..sources.staging import stage
from .batches import slices
from .quality import held_out

#: A byte-level vocabulary, one base64 piece and its rank a line; any word can be spelled with it.
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
ROUNDS = 2
#: Occurrences every piece has in every language from the start.
PRIOR = 0.1
#: Expected counts are added up as whole parts of this, so that their order does not matter.
PARTS = 1 << 20
#: Longer runs of letters are cut after every so many.
WORD = 32
#: Language of texts without a letter.
UNKNOWN = "und"
#: Words a task holds before it hands their counts on, and words measured together.
HELD, TOGETHER = 200_000, 4096

_RUN = regex.compile(r"\p{L}[\p{L}\p{M}]{0,%d}" % (WORD - 1))


@cache
def _plain_run() -> re.Pattern:
    """The same runs for texts without characters from U+10000 on, several times as fast."""

    def of(kinds: str) -> str:
        found = [c for c in range(0x10000) if unicodedata.category(chr(c))[0] in kinds]
        starts = [c for c, before in zip(found, [-1, *found]) if c != before + 1]
        ends = [c for c, after in zip(found, [*found[1:], -1]) if after != c + 1]
        return "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in zip(starts, ends))

    return re.compile(f"[{of('L')}][{of('LM')}]{{0,{WORD - 1}}}")


def words(text: str) -> list[str]:
    """Runs of letters in lower case. The vocabulary has most of them after a space, which is added before a
    word is measured."""
    low = text.lower()
    plain = low.isascii() or len(low.encode("utf-16-le")) == 2 * len(low)
    return (_plain_run() if plain else _RUN).findall(low)


class Pieces:
    """The vocabulary as a trie whose edges lie in one sorted array."""

    def __init__(self, pieces: list[bytes]):
        self.size = len(pieces)
        step: dict[int, int] = {}
        piece_of = [-1]
        for number, piece in enumerate(pieces):
            node = 0
            for byte in piece:
                node = step.setdefault(node << 8 | byte, len(piece_of))
                if node == len(piece_of):
                    piece_of.append(-1)
            piece_of[node] = number
        self.longest = max(map(len, pieces), default=1)
        self.keys = np.array(sorted(step), np.int64)
        self.nodes = np.array([step[k] for k in self.keys.tolist()], np.int64)
        self.piece_of = np.array(piece_of, np.int64)

    def edges(self, spelled: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(start, end, rows, pieces) of all pieces in words of one length (rows x bytes)."""
        n = spelled.shape[1]
        for start in range(n):
            rows, node = np.arange(len(spelled)), np.zeros(len(spelled), np.int64)
            for end in range(start + 1, min(n, start + self.longest) + 1):
                key = node << 8 | spelled[rows, end - 1]
                at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                there = self.keys[at] == key
                rows, node = rows[there], self.nodes[at[there]]
                if not len(rows):
                    break
                found = self.piece_of[node]
                yield start, end, rows[found >= 0], found[found >= 0]


def load_pieces(path: str) -> list[bytes]:
    """Pieces of a vocabulary file by rank; single bytes it lacks are added, so every word has a spelling."""
    with open(path, "rb") as lines:
        pieces = [base64.b64decode(line.split()[0]) for line in lines if line.strip()]
    return [*pieces, *sorted({bytes([b]) for b in range(256)} - set(pieces))]


def by_length(found: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of words in ``found`` and their bytes, words of equal length together."""
    raw = [w.encode() for w in found]
    order = sorted(range(len(raw)), key=lambda i: len(raw[i]))
    start = 0
    for at in range(1, len(order) + 1):
        if at == len(order) or len(raw[order[at]]) > len(raw[order[start]]) or at - start == TOGETHER:
            some = order[start:at]
            yield np.array(some), np.frombuffer(b"".join(raw[i] for i in some), np.uint8).reshape(len(some), -1).astype(np.int64)
            start = at


def _add_logs(total: np.ndarray, rows: np.ndarray, more: np.ndarray) -> None:
    total[rows] = np.logaddexp(total[rows], more)


def log_probabilities(found: list[str], pieces: Pieces, logs: np.ndarray) -> np.ndarray:
    """Forward algorithm: (word, language) log-probabilities over all segmentations; logs: (piece, language).

    Words too short for their least probable spelling to fall below the range of doubles need no logarithms
    on the way.
    """
    out = np.zeros((len(found), logs.shape[1]))
    shares, short = np.exp(logs), 690 / max(1.0, -logs.min(initial=0.0))
    for places, spelled in by_length(found):
        if spelled.shape[1] <= short:
            alpha = np.zeros((spelled.shape[1] + 1, len(places), logs.shape[1]))
            alpha[0] = 1
            for start, end, rows, which in pieces.edges(spelled):
                if len(rows) == len(places):
                    alpha[end] += alpha[start] * shares[which]
                else:
                    alpha[end][rows] += alpha[start][rows] * shares[which]
            out[places] = np.log(alpha[-1])
            continue
        alpha = np.full((spelled.shape[1] + 1, len(places), logs.shape[1]), -np.inf)
        alpha[0] = 0
        for start, end, rows, which in pieces.edges(spelled):
            _add_logs(alpha[end], rows, alpha[start][rows] + logs[which])
        out[places] = alpha[-1]
    return out


def expected(found: list[str], language: np.ndarray, times: np.ndarray, pieces: Pieces, logs: np.ndarray) -> np.ndarray:
    """(language, piece) expected occurrences, in whole PARTS, of words in their own languages."""
    out = np.zeros(logs.shape[::-1], np.int64)
    for places, spelled in by_length(found):
        own, n = language[places], spelled.shape[1]
        alpha, beta = np.full((2, n + 1, len(places)), -np.inf)
        alpha[0], beta[n] = 0, 0
        edges = [(start, end, rows, which, logs[which, own[rows]]) for start, end, rows, which in pieces.edges(spelled)]
        for start, end, rows, _, log in edges:
            _add_logs(alpha[end], rows, alpha[start][rows] + log)
        for start, end, rows, _, log in reversed(edges):
            _add_logs(beta[start], rows, beta[end][rows] + log)
        for start, end, rows, which, log in edges:
            share = np.exp(alpha[start][rows] + log + beta[end][rows] - alpha[n][rows])
            np.add.at(out, (own[rows], which), np.rint(share * PARTS).astype(np.int64) * times[places[rows]])
    return out


def word_counts(docs: DataFrame) -> DataFrame:
    """(lang, word, n) over all rows (lang, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = defaultdict(Counter)

        def emptied() -> Iterator[pa.RecordBatch]:
            for lang, counts in held.items():
                columns = [pa.array([lang] * len(counts), pa.string()), pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["lang", "word", "n"])
            held.clear()

        for batch in batches:
            for part in slices(batch):
                for row in part.to_pylist():
                    held[row["lang"]].update(words(row["text"]))
                if sum(map(len, held.values())) > HELD:
                    yield from emptied()
        yield from emptied()

    return docs.mapInArrow(run, "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def learn(docs: DataFrame, path: str, rounds: int, prior: float) -> tuple[list[str], Pieces, np.ndarray]:
    """Languages in byte order, the vocabulary, and its log-probabilities (piece, language).

    Every distinct word is kept with its count, in a table; only (language, piece) sums come back, which are
    bounded by the vocabulary and the number of languages.
    """
    spark = docs.sparkSession
    vocabulary = load_pieces(path)
    pieces = Pieces(vocabulary)
    # Learned languages include those whose texts have no letters at all.
    langs = sorted((r["lang"] for r in docs.select("lang").distinct().collect()), key=str.encode)
    place = {lang: i for i, lang in enumerate(langs)}
    logs = np.full((pieces.size, len(langs)), -np.log(pieces.size))
    counts = stage(word_counts(docs), "language-words") if langs else None
    for _ in range(rounds if langs else 0):
        sent = spark.sparkContext.broadcast((pieces, logs))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            pieces, logs = sent.value
            sums = np.zeros(logs.shape[::-1], np.int64)
            for batch in batches:
                language = np.array([place[x] for x in batch.column("lang").to_pylist()], np.int64)
                sums += expected([" " + w for w in batch.column("word").to_pylist()], language, batch.column("n").to_numpy(), pieces, logs)
            at = np.flatnonzero(sums)
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums.reshape(-1)[at])], names=["place", "total"])

        found = counts.mapInArrow(run, "place bigint, total bigint").groupBy("place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
        sums = np.full(logs.shape[::-1], prior)
        for row in found.collect():
            sums.reshape(-1)[row["place"]] += float(row["total"]) / PARTS
        sent.destroy()
        logs = np.log(sums / sums.sum(axis=1, keepdims=True)).T.copy()
    return langs, pieces, logs


def identify_languages(
    docs: DataFrame, text: str = "text", lang: str = "lang", id_column: str = "doc_id", vocabulary: str = VOCABULARY, rounds: int = ROUNDS, prior: float = PRIOR
) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score.

    Models are learned from the text and language of rows that are not held out; a prediction sees only the
    text. ``score`` is the language's posterior probability among the learned ones, all equally likely
    beforehand; among equals the first in byte order is taken.

    A null text, one without a letter, and any text when nothing could be learned are ``und`` with score 0.
    Rows without a language are predicted, not learned from; rows without an id are learned from. Repeated
    rows each count. No rows give no rows. Runs of letters longer than 32 are cut into words of 32. Other
    columns are not read. ``vocabulary`` is read on the driver and sent to the tasks.
    """
    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    known = rows.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")
    langs, pieces, logs = learn(known, vocabulary, rounds, prior)
    sent = rows.sparkSession.sparkContext.broadcast((pieces, logs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, logs = sent.value
        place: dict[str, int] = {}  # words of earlier slices, with their rows of ``known``
        known = np.zeros((0, len(langs)))
        for batch in batches:
            for part in slices(batch):
                if len(place) > HELD:
                    place, known = {}, known[:0]
                texts = [words(t or "") for t in part.column("text").to_pylist()]
                lengths = [len(t) for t in texts]
                totals = np.zeros((part.num_rows, len(langs)))
                if langs and any(lengths):
                    of = np.repeat(np.arange(part.num_rows), lengths)
                    found = np.fromiter((place.setdefault(w, len(place)) for t in texts for w in t), np.int64, len(of))
                    new = [" " + w for w in islice(place, len(known), None)]
                    known = np.concatenate([known, log_probabilities(new, pieces, logs)])
                    for k in range(len(langs)):
                        totals[:, k] = np.bincount(of, known[found, k], part.num_rows)
                labels, scores = [], []
                for total, length in zip(totals, lengths):
                    if not langs or not length:
                        labels.append(UNKNOWN)
                        scores.append(0.0)
                        continue
                    best = int(total.argmax())
                    labels.append(langs[best])
                    scores.append(round(float(1 / np.exp(total - total[best]).sum()), 12))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(labels, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    scored = rows.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
