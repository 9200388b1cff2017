"""Languages, vector codes and source divergence: brute force, held-out accuracy and edge cases."""
import collections
import hashlib
import itertools
import math
import random
import re
import string

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from larder.llm import batches, divergence, langid, queries, vector_code

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
CLASHING = "term n docs digest copies sources item value rank part p q none word label error code vector place total held_out score lang_pred unlabelled".split()


def clashing(df):
    return df.withColumns({c: F.lit("clash") for c in CLASHING if c not in df.columns})


def test_slices_hold_every_row_once():
    batch = pa.RecordBatch.from_pydict({"text": ["a" * 10, None, "b" * 3, "", "c" * 50, "d"], "i": range(6)})
    parts = list(batches.slices(batch, most=12))
    assert [p.column("i").to_pylist() for p in parts] == [[0, 1], [2, 3], [4], [5]]
    assert not list(batches.slices(batch.slice(0, 0)))


# ---- languages


@pytest.fixture(scope="module")
def pieces():
    vocabulary = [b" ", b"a", b"b", b"ab", b" a", b" ab", b"ba", b"aba"]
    return vocabulary, langid.Pieces(vocabulary)


def segmentations(word, vocabulary):
    if not word:
        yield []
    for k, piece in enumerate(vocabulary):
        if word.startswith(piece):
            for rest in segmentations(word[len(piece) :], vocabulary):
                yield [k, *rest]


def test_forward_sums_all_segmentations(pieces):
    vocabulary, trie = pieces
    rng = np.random.default_rng(5)
    p = rng.dirichlet(np.ones(len(vocabulary)), 3).T
    found = [" " + "".join(w) for n in range(1, 7) for w in itertools.product("ab", repeat=n)]
    got = langid.log_probabilities(found, trie, np.log(p))
    tiny = np.where(np.arange(len(vocabulary)) < 3, -300.0, -200.0)  # forces the way by logarithms
    for word, row in zip(found, langid.log_probabilities(found, trie, tiny[:, None])):
        assert np.isclose(row[0], np.logaddexp.reduce([tiny[cut].sum() for cut in segmentations(word.encode(), vocabulary)]))
    for word, row in zip(found, got):
        want = sum(np.prod(p[cut], axis=0) for cut in segmentations(word.encode(), vocabulary))
        assert np.allclose(row, np.log(want), rtol=1e-12)


def test_expected_counts_equal_enumeration(pieces):
    vocabulary, trie = pieces
    rng = np.random.default_rng(6)
    p = rng.dirichlet(np.ones(len(vocabulary)), 2).T
    found = [" abab", " b", " aba", " abab", " bbab"]
    language, times = np.array([0, 1, 1, 1, 0]), np.array([3, 1, 2, 1, 1])
    want = np.zeros((2, len(vocabulary)))
    for word, own, n in zip(found, language, times):
        cuts = list(segmentations(word.encode(), vocabulary))
        weights = np.array([np.prod(p[c, own]) for c in cuts])
        for cut, w in zip(cuts, weights / weights.sum()):
            np.add.at(want[own], cut, n * w)
    got = langid.expected(found, language, times, trie, np.log(p)) / langid.PARTS
    assert np.allclose(got, want, atol=1e-4)


def test_words_of_a_long_run_are_all_there():
    text = "Straße" + "ß" * 100 + " 42 İx"
    joined = "".join(langid.words(text))
    assert joined == "".join(re.findall(r"[^\W\d_]|̇", text.lower())) and max(map(len, langid.words(text))) == langid.WORD
    assert langid.words(text + " ² Ⅷ नमस्ते") == langid._RUN.findall((text + " नमस्ते").lower()) and langid.words("𝒳y ²z") == ["𝒳y", "z"]


def test_unseen_documents_are_told_apart(spark):
    sf = "/root/testdata/sf0.01"
    rows = queries.op11_language_id(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    unseen = [r for r in rows if r["held_out"]]
    assert len(rows) == 1000 and len(unseen) > 100
    assert sum(r["lang"] == r["lang_pred"] for r in unseen) / len(unseen) > 0.97


LANG_ROWS = [
    (1, "the cat and the dog", "en", None, None),
    (1, "the cat and the dog", "en", None, None),
    (3, "le chat et le chien", "fr", "s", 1),
    (4, None, "fr", "s", 1),
    (5, "", None, "s", 1),
    (6, "12 34 ²!", "en", "s", 1),
    (7, "the dog", None, "s", 1),
    (None, "le chien", None, None, None),
    (None, "x" * 200_000 + " the " * 50_000, "en", None, None),
    (9, "…", "", "s", 1),
]


def test_language_edges(spark):
    docs = clashing(spark.createDataFrame(LANG_ROWS, SCHEMA))
    rows = langid.identify_languages(docs).collect()
    assert len(rows) == len(LANG_ROWS)
    found = sorted((r["doc_id"] or 0, r["lang_pred"], r["score"] > 0.5) for r in rows)
    assert found == sorted(
        [(1, "en", True)] * 2 + [(3, "fr", True), (4, "und", False), (5, "und", False), (6, "und", False), (7, "en", True), (0, "fr", True), (0, "en", True), (9, "und", False)]
    )
    assert all(r["score"] == 0 for r in rows if r["lang_pred"] == "und") and not [r for r in rows if r["doc_id"] is None and r["held_out"] is not False]
    assert langid.identify_languages(docs.limit(0)).collect() == []
    unlearned = langid.identify_languages(docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {(r["lang_pred"], r["score"]) for r in unlearned} == {("und", 0.0)}


# ---- vector codes


def plain_codes(rows, entries, rounds=4):
    """rows: (vec_id, components, label) that stay; the contract word by word."""
    ints = [[math.floor(1024 * x) for x in v] for _, v, _ in rows]
    width = len(ints[0]) // 4
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, ints[i]))
    cut = lambda v, p: v[p * width : (p + 1) * width]
    books = [[cut(ints[i], p) for i in order[:entries]] for p in range(4)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(book))
    for _ in range(rounds):
        for p, book in enumerate(books):
            members = collections.defaultdict(list)
            for v in ints:
                members[near(cut(v, p), book)[1]].append(cut(v, p))
            books[p] = [[sum(c) // len(members[k]) for c in zip(*members[k])] if k in members else e for k, e in enumerate(book)]
    out = []
    for v, (key, _, label) in zip(ints, rows):
        found = [near(cut(v, p), books[p]) for p in range(4)]
        out.append((key, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found), label))
    sums = collections.Counter()
    for *_, error, label in out:
        sums[label] += error
    digest = hashlib.sha256(",".join(str(c) for book in books for e in book for c in e).encode()).hexdigest()
    return sorted(((key, code, error, sums[label], digest) for key, code, error, label in out), key=str)


@pytest.mark.parametrize("spread,cell_bits,entries", [(0.05, 5, 256), (0.5, 7, 16), (0.002, 1, 30), (2.0, 0, 256)])
def test_codes_equal_brute_force(spark, spread, cell_bits, entries):
    rng = np.random.default_rng(int(spread * 1000))
    rows = [(i, [float(np.float32(x)) for x in rng.normal(0, spread, 8)], [None, 1, 2][i % 3]) for i in range(300)]
    rows += [(300 + i, rows[7][1], 1) for i in range(100)]  # copies tie everywhere
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").repartition(5)
    got = vector_code.compress_vectors(table, entries=entries, cell_bits=cell_bits).collect()
    assert sorted((tuple(r) for r in got), key=str) == plain_codes(rows, entries)


def test_a_cell_keeps_every_nearest_entry():
    rng = np.random.default_rng(2)
    for bits in (0, 3, 6, 12):
        entries = rng.integers(-200, 200, (40, 4))
        entries[7] = entries[3]
        points = rng.integers(-300, 300, (500, 4))
        grid = vector_code.Grid(entries, bits, held=50)
        code, error = grid.nearest(points)
        apart = ((points[:, None] - entries) ** 2).sum(axis=2)
        assert (code == apart.argmin(axis=1)).all() and (error == apart.min(axis=1)).all()
        assert len(grid.cells) <= max(50, len(np.unique(points >> bits, axis=0)))


def test_vector_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(3, [0.5, 1.0, -1.0, 0.25], None), (3, [0.5, 1.0, -1.0, 0.0], 1), (1, [nan, 0.0, 0.0, 0.0], 1), (2, [0.0, inf, 0.0, 0.0], 1)]
    rows += [(4, None, 2), (5, [0.0, None, 0.0, 0.0], 2), (None, [0.1, 0.2, 0.3, 0.4], None), (3, [0.5, 1.0, -1.0, 0.25], None)]
    table = clashing(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int"))
    good = [(k, [float(np.float32(x)) for x in v], label) for k, v, label in (rows[0], rows[1], rows[6], rows[7])]
    for entries in (1, 2, 256):
        got = vector_code.compress_vectors(table, entries=entries).collect()
        assert sorted((tuple(r) for r in got), key=str) == plain_codes(good, entries)
    assert vector_code.compress_vectors(table.limit(0)).collect() == []
    assert vector_code.compress_vectors(table.where("embedding is null")).collect() == []
    empty = spark.createDataFrame([(1, [], 1), (2, [], None)], "vec_id bigint, embedding array<float>, label int")
    assert [(r["code"], r["error"], r["label_error"]) for r in vector_code.compress_vectors(empty).collect()] == [("00000000", 0, 0)] * 2
    with pytest.raises(Exception, match="common length"):
        vector_code.compress_vectors(spark.createDataFrame([(1, [0.0] * 4, 1), (2, [0.0] * 8, 1)], table.select("vec_id", "embedding", "label").schema)).collect()


# ---- source divergence


TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def plain_divergence(rows, least=3, top=200):
    """Dense evaluation: every kept term of every group."""
    docs = [(lang or "", source or "", [w.translate(LOWER) for w in TERM.findall(text or "")]) for text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        spread = collections.Counter(t for d in own for t in set(d[2]))
        kept = sorted(t for t, n in spread.items() if n >= least)
        tables = {}
        for source in [None, *{d[1] for d in own}]:
            n = collections.Counter(t for d in own if source in (None, d[1]) for t in d[2] if spread[t] >= least)
            total = sum(n.values()) + len(kept)
            tables[source] = n, {t: 1 + 1_000_000_000 * (n[t] + 1) // total for t in kept}
        cost = lambda p, q: (p - q) ** 2 // q
        for source in [s for s in tables if s is not None]:
            n, p = tables[source]
            pairs = [(other, sum(cost(p[t], tables[other][1][t]) for t in kept)) for other in tables if other not in (None, source)]
            terms = [(t, cost(p[t], tables[None][1][t])) for t in kept if n[t] and p[t] > tables[None][1][t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                ranked = sorted(found, key=lambda x: (-x[1], x[0].encode()))[:most]
                out += [(lang, source, part, item, value, i + 1) for i, (item, value) in enumerate(ranked)]
    return sorted(out)


def divergence_of(spark, rows, **options):
    docs = clashing(spark.createDataFrame([(i, *row, None) for i, row in enumerate(rows)], SCHEMA)).repartition(4)
    return sorted(tuple(r) for r in divergence.source_divergence(docs, **options).collect())


def test_divergence_equals_dense_evaluation(spark):
    pick = random.Random(9)
    vocabulary = ["the", "The", "cat", "dog", "éa", "日本", "x" * 300, "ÿ", "z", "\U0001f600"] + [f"w{chr(97 + i)}" for i in range(26)]
    texts = [" ".join(pick.choices(vocabulary, k=pick.randint(0, 40))) for _ in range(120)]
    texts += ["copied text of many a page"] * 5
    rows = [(pick.choice(texts), pick.choice(["en", "en", "fr", None]), pick.choice(["a", "b", "c", "￿", "\U0001f600", None])) for _ in range(400)]
    rows += [("copied text of many a page", "en", "a")] * 300
    rows += [(None, "de", "a"), ("", "de", "b"), ("rare words only", "de", "c"), ("lone", "xx", "alone")]
    assert divergence_of(spark, rows) == plain_divergence(rows)
    assert divergence_of(spark, rows, least_docs=1, top_terms=2) == plain_divergence(rows, 1, 2)
    assert divergence_of(spark, rows[:0] or [("x", "l", "s")]) == plain_divergence([("x", "l", "s")])


def test_divergence_edges(spark):
    docs = clashing(spark.createDataFrame([], SCHEMA))
    assert divergence.source_divergence(docs).collect() == []
    long = " ".join(f"w{i % 977}x{i % 7}" for i in range(300_000))
    rows = [(long, "en", s) for s in "ab"] + [("wx", "en", "a"), ("w", "en", "b")]
    assert divergence_of(spark, rows, least_docs=2) == plain_divergence(rows, 2)


def test_equal_texts_are_tokenized_once(spark):
    docs = spark.createDataFrame([("same text", "en", s) for s in "aab"] + [("same text", "fr", "a"), (None, "en", "a"), ("", "en", "a")], "text string, lang string, source string")
    found = {(r["lang"], r["text"]): {(s["source"], s["copies"]) for s in r["sources"]} for r in divergence.distinct_texts(docs).collect()}
    assert found == {("en", "same text"): {("a", 2), ("b", 1)}, ("fr", "same text"): {("a", 1)}, ("en", ""): {("a", 2)}}
