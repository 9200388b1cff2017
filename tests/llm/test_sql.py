"""The operators' queries against their SQL statements."""
import pytest

from larder.llm import queries
from oracle import compare, connect


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
@pytest.mark.parametrize("key", sorted(queries.ORACLES))
def test_matches_sql(spark, key, sf):
    folder = f"/root/testdata/sf{sf}"
    assert compare(spark, connect(folder), queries.QUERIES[key], queries.ORACLES[key], folder)[0] == ""


def test_one_query_per_operator():
    assert sorted(int(k[2:].split("_")[0]) for k in queries.QUERIES) == list(range(1, 14))
