"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns."""
import hashlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from larder.llm import chat, decontam, exact_dedup, hpylm, mixing, quality, secret_scan, simhash, url_filter, warc

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LONG = " ".join(f"w{i % 977} x{i}" for i in range(60_000))
ROWS = [
    (1, "alpha beta gamma delta epsilon", "en", "a", 1),
    (2, "alpha  beta\tgamma\ndelta epsilon", "en", None, None),
    (3, None, None, "b", None),
    (4, "", "en", "b", 0),
    (4, "", "en", "b", 0),
    (5, " \n\t ", "en", None, 4),
    (6, LONG, "en", "a", len(LONG)),
    (None, "no id here", "en", "a", 10),
    (None, "no id there either", "en", "a", 10),
    (None, "no id here", "en", "a", 10),
    (7, "İstanbul \U0001f600 café naïve", "fr", "￿", 9),
]
#: Names the operators use inside.
CLASHING = "row fp size name block word label hits spans component_id keys pos n head heads a b bucket rank p groups features score kept keep_id _row _id _sha _kept_id _hit_id shard held_out".split()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).withColumns({c: F.lit("clash") for c in CLASHING})


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, 0) for i in range(8)] + [(None, 1, 0), (3, None, 0)], "doc_id bigint, quality int, toxic int")


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, "beta GAMMA"), (2, None), (3, ""), (None, "x59999"), (1, "no id THERE")], "item_id bigint, text string")


def by_id(rows):
    return sorted(rows, key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0))


def test_secrets(docs):
    rows = by_id(secret_scan.scan_secrets(docs).collect())
    assert len(rows) == len(ROWS) and all(r["spans"] == [] for r in rows)


def test_exact(docs):
    rows = exact_dedup.exact_duplicates(docs).collect()
    found = {(r["doc_id"], r["text_sha256"]): r for r in rows}
    assert len(rows) == len(ROWS)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert found[2, sha("alpha beta gamma delta epsilon")]["keep_id"] == 1
    empty = [r for r in rows if r["text_sha256"] == sha("")]
    assert {r["keep_id"] for r in empty} == {3} and {r["group_size"] for r in empty} == {3} and sum(r["kept"] for r in empty) == 1
    assert found[5, sha(" ")]["kept"]
    nameless = [r for r in rows if r["text_sha256"] == sha("no id here")]
    assert [r["keep_id"] for r in nameless] == [None, None] and sum(r["kept"] for r in nameless) == 1
    kept = exact_dedup.drop_exact_duplicates(docs)
    assert kept.columns == docs.columns and kept.count() == 7


def test_near(docs):
    rows = simhash.near_duplicates(docs).collect()
    assert len(rows) == len(ROWS)
    zero = [r for r in rows if r["fp"] == 0]
    assert len(zero) == 4 and {r["component_id"] for r in zero} == {3}
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "3", "6", "7", "None", "None"]


def test_decontamination(docs, benchmark):
    rows = decontam.find_contamination(docs, benchmark).collect()
    hit = sorted((str(r["doc_id"]), r["n_hit"], tuple(r["items"])) for r in rows if r["n_hit"])
    assert hit == [("1", 2, ("1",)), ("2", 2, ("1",)), ("6", 1, ("",)), ("None", 3, ("1",))]
    assert {r["n_words"] for r in rows if r["doc_id"] in (3, 4, 5)} == {0}
    kept = decontam.drop_contaminated(docs, benchmark)
    assert kept.columns == docs.columns
    assert [r["doc_id"] for r in by_id(kept.collect())] == [3, 4, 4, 5, 7, None, None]  # the clean rows without id stay


def test_mixing(docs):
    rows = mixing.mix_sources(docs).collect()
    assert len(rows) == len(ROWS)
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in rows)
    targets = {r["source"]: r["target"] for r in rows}
    assert set(targets) == {"a", "b", "￿", None} and targets["b"] == 0
    assert {r["size"] for r in rows if r["doc_id"] in (3, 4, 5)} == {0}


def test_quality(docs, labels):
    rows = quality.score_quality(docs, labels).collect()
    assert len(rows) == len(ROWS) and all(0 <= r["score"] <= 1 for r in rows)
    assert len({r["score"] for r in rows if r["doc_id"] in (3, 4)}) == 1
    kept = quality.keep_quality(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(r["predicted"] for r in rows)
    no_positive = quality.score_quality(docs, labels.filter("quality = 0"))
    assert {r["score"] for r in no_positive.collect()} == {1.0}
    assert {r["score"] for r in quality.score_quality(docs, labels.limit(0)).collect()} == {1.0}


def test_language_model(docs):
    rows = by_id(hpylm.score_texts(docs.drop("held_out")).collect())
    assert len(rows) == len(ROWS)
    empty = [r for r in rows if r["doc_id"] in (3, 4, 5)]
    assert all(r["n_tokens"] == 1 and r["n_known"] == 1 and r["score"] < 0 for r in empty)
    nothing = hpylm.score_texts(docs, aside=F.lit(True)).collect()
    assert {r["train_tokens"] for r in nothing} == {0} and {r["n_known"] for r in nothing} == {0} and {r["score"] for r in nothing} == {0.0}


def test_warc(spark):
    pages = spark.createDataFrame(
        [
            (1, "http://a.com/\r\nX: y", None, "clash"),
            (2, None, "", "clash"),
            (3, "http://a.com/", "x" * 200_000, "clash"),
            (4, "http://a.com/", "x" * 200_000, "clash"),
            (4, "http://a.com/", "x" * 200_000, "clash"),
            (3, "http://a.com/", "x" * 200_000, "clash"),
            (None, "u", "\r\n\r\nWARC/1.1\r\né", "clash"),
            (9, "u", "\r\n\r\nWARC/1.1\r\né", "clash"),
        ],
        "page_id bigint, url string, html string, payload string",
    ).withColumns({c: F.lit(1) for c in ("sha", "first", "record", "refers_to")})
    path = warc.archive_path(spark)
    warc.write_archives(pages, path)
    rows = sorted((str(r["page_id"]), r["record_type"], r["refers_to"], r["payload_bytes"]) for r in warc.read_archives(spark, path).collect())
    assert rows == [
        ("1", "response", None, 0),
        ("2", "revisit", 1, 0),
        ("3", "response", None, 200_000),
        ("3", "response", None, 200_000),
        ("4", "revisit", 3, 200_000),
        ("4", "revisit", 3, 200_000),
        ("9", "response", None, 16),
        ("None", "revisit", 9, 16),
    ]


def test_urls(spark):
    rules = [("allow", "com", "/"), ("block", "net", "/")]
    urls = ["http://A.com/x", "http://b.net/y?q", None, "", "no scheme", "ftp://h", "://", "http://ü.org/" + "z" * 50_000, "http://A.com/x"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string").withColumns({c: F.lit("clash") for c in ("row", "gram", "host", "rule", "ruled", "step", "path")})
    rows = {r["page_id"]: r for r in url_filter.judge_urls(pages, rules).collect()}
    assert len(rows) == len(urls)
    assert (rows[0]["host"], rows[0]["path"], rows[0]["rule"], rows[0]["verdict"]) == ("a.com", "/x", "com/", "allow")
    assert (rows[1]["path"], rows[1]["verdict"]) == ("/y", "block")
    assert all((rows[k]["host"], rows[k]["path"], rows[k]["rule"]) == ("", "", None) for k in (2, 3, 4, 6))
    assert rows[0][1:] == rows[8][1:]
    without = url_filter.judge_urls(pages, [("allow", "com", "/")]).collect()
    assert {r["verdict"] for r in without} == {"allow"}


def test_chat(spark):
    turns = spark.createDataFrame(
        [
            (1, 0, "user", None, "c"),
            (1, 1, None, "x\\<|im_end|>", "c"),
            (1, 1, None, "x\\<|im_end|>", "c"),
            (1, None, "assistant", "first", "c"),
            (None, 0, "a\n|\\n\\role", "<\\\\|<|<\\|im_start|>" * 3, "c"),
            (2, 0, "assistant", "y" * 500_000, "c"),
            (3, 0, "assistant", "", "c"),
        ],
        "conv_id bigint, turn bigint, role string, text string, turns string",
    ).withColumns({c: F.lit("clash") for c in ("t", "written", "parts", "formatted")})
    done = chat.format_conversations(turns).select("conv_id", chat.parse_conversation(F.col("formatted")).alias("turns"), chat.loss_text(F.col("parts")).alias("loss"))
    rows = {r["conv_id"]: ([tuple(t) for t in r["turns"]], r["loss"]) for r in done.collect()}
    assert rows[1] == ([("assistant", "first"), ("user", ""), ("", "x\\<|im_end|>"), ("", "x\\<|im_end|>")], "first")
    assert rows[None] == ([("a\n|\\n\\role", "<\\\\|<|<\\|im_start|>" * 3)], "")
    assert rows[2][1] == "y" * 500_000 and rows[3] == ([("assistant", "")], "")


def test_empty_tables(spark, labels, benchmark):
    none = spark.createDataFrame([], SCHEMA)
    for made in (
        secret_scan.scan_secrets(none),
        exact_dedup.exact_duplicates(none),
        exact_dedup.drop_exact_duplicates(none),
        simhash.near_duplicates(none),
        simhash.drop_near_duplicates(none),
        decontam.find_contamination(none, benchmark),
        decontam.drop_contaminated(none, benchmark),
        mixing.mix_sources(none),
        quality.score_quality(none, labels),
        quality.keep_quality(none, labels),
        hpylm.score_texts(none),
        url_filter.judge_urls(spark.createDataFrame([], "page_id bigint, url string"), [("allow", "com", "/")]),
        chat.format_conversations(spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")),
    ):
        assert made.count() == 0
    path = warc.archive_path(spark)
    warc.write_archives(spark.createDataFrame([], "page_id bigint, url string, html string"), path)
    assert warc.read_archives(spark, path).count() == 0


def test_empty_benchmark(docs, benchmark):
    assert decontam.find_contamination(docs, benchmark.limit(0)).agg(F.sum("n_hit")).first()[0] == 0


def test_pipeline_over_edges(spark, docs, labels, benchmark, tmp_path):
    folder = str(tmp_path)
    docs.write.parquet(f"{folder}/documents.parquet")
    labels.write.parquet(f"{folder}/labels.parquet")
    benchmark.write.parquet(f"{folder}/benchmark.parquet")
    rows = corpus_pipeline.run(spark, folder).collect()
    assert {r["doc_id"] for r in rows} <= {3, 7, None}
