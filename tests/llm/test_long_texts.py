"""Very long texts, lines, URLs and constants end within seconds."""
import time

import pytest
from pyspark.sql import functions as F

from larder.llm import exact_dedup, secret_scan, url_filter


@pytest.fixture(autouse=True)
def seconds(spark):
    start = time.time()
    yield
    assert time.time() - start < 60


def test_long_urls(spark):
    urls = ["http://a.com/" + "ab" * 100_000, "http://b.net/" + "cd" * 25_000, "http://x.org/abab", None]
    rows = url_filter.judge_urls(spark.createDataFrame(list(enumerate(urls)), "page_id int, url string"), [("allow", "com", "/"), ("block", "net", "/")]).collect()
    assert len(rows) == 4 and {(r["page_id"], r["verdict"]) for r in rows} >= {(0, "allow"), (1, "block")}


def test_trigrams_overlap(spark):
    row = spark.range(1).select(url_filter.trigrams(F.lit("aBcé")).alias("g")).first()
    e, o = url_filter.EDGE, url_filter.OTHER
    signs = e * 2 + "abc" + o + e
    assert row["g"] == [signs[i : i + 3] for i in range(len(signs) - 2)]


def test_long_documents(spark):
    docs = spark.range(3).select(F.col("id").alias("doc_id"), F.repeat(F.when(F.col("id") == 1, F.lit("word  and \n")).otherwise(F.lit("word and ")), 2_000_000).alias("text"))
    rows = exact_dedup.exact_duplicates(docs).collect()
    assert {(r["doc_id"], r["keep_id"], r["group_size"]) for r in rows} == {(0, 0, 3), (1, 0, 3), (2, 0, 3)}


def test_long_line_of_assignments():
    line = "&".join(f"k{i}={i}" for i in range(120_000)) + "&api_token=kJh8sd7fKJH21&z=1"
    found = {line[s:e] for s, e in secret_scan.literals(line)}
    assert any(v.startswith("kJh8sd7fKJH21") for v in found)
    secret_scan.literals("token=1&" * 120_000)
    secret_scan.literals("x" * 1_000_000 + " token = y")


def test_constants_put_into_themselves():
    text = 'a = "kJh8sd7f"\n' + "a = a + a\n" * 100 + "db_password = a\n"
    assert {text[s:e] for s, e in secret_scan.literals(text)} == {"kJh8sd7f"}
    grown = 'q = "kJh8sd7f"\n' + "".join(f'q = q + "part{i}"\n' for i in range(20_000))
    assert not secret_scan.literals(grown)


def test_literals_further_from_their_name():
    found = lambda text: {text[s:e] for s, e in secret_scan.literals(text)}
    for text in ("db_secret_value" + " " * 500 + "= 'kJh8sd7fKJH21'", 'db_pw = [\n  "kJh8sd7fKJH21"]', 'db_password = """kJh8sd7fKJH21"""', 'auth_token: str = ("kJh8sd7fKJH21")', "a." * 200 + "api_key.x = 'kJh8sd7fKJH21'"):
        assert found(text) == {"kJh8sd7fKJH21"} or "db_pw" in text and found(text.replace("db_pw", "db_password")) == {"kJh8sd7fKJH21"}, text
    assert found("token=QUJDRA12kk=") == {"QUJDRA12kk="}
