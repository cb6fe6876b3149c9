"""Registered queries against their SQL on small tables made for a finding."""

import duckdb
import pytest

from siltstone.plans import catalog, more, served, states, writes  # noqa: F401
from siltstone.plans.registry import ORACLES, QUERIES
from tests.test_catalog import rows

PLAIN = "ocean maple river stone the cloud grape piano horse lemon tiger chair bread license version"


def agrees(spark, folder, name, **tables):
    duck = duckdb.connect()
    for table, (values, schema) in tables.items():
        spark.createDataFrame(values, schema).coalesce(1).write.parquet(f"{folder}/{table}.parquet")
        duck.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    wanted = rows(duck.execute(ORACLES[name]).df())
    assert len(wanted[1]) and rows(QUERIES[name](spark, str(folder)).toPandas()) == wanted


DOCS = "doc_id long, text string, lang string, source string, n_chars long"
CHATS = "conv_id long, turn int, role string, text string"


@pytest.mark.parametrize("name", ["evidence_spans", "search_tool_bounded", "search_tool_question"])
def test_served_reads_of_plain_words(spark, tmp_path, name):
    """Runs of plain words look like seed phrases, of which the SQL knows nothing."""
    chats = [(50 + i, t, "user", PLAIN) for i in range(3) for t in range(4)] + [(60, 0, "assistant", "The short one that says the least")]
    docs = [(i, f"{PLAIN}\nreleased", "en", "s", 10) for i in range(4)]
    agrees(spark, tmp_path, name, documents=(docs, DOCS), conversations=(chats, CHATS))


@pytest.mark.parametrize("body", [f"see {PLAIN}", "token = abcdefghijklmnop", "The page. " * 8000])
def test_get_page_tells_the_length_of_the_page(spark, tmp_path, body):
    agrees(spark, tmp_path, "get_page", documents=([(i, body, "en", "s", 10) for i in range(9)], DOCS))
