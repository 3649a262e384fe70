import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from llm_helpers import ODD_TEXTS  # noqa: E402

from procsig.sources.tables import TABLES  # noqa: E402


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


@pytest.fixture()
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


@pytest.fixture()
def odd_docs(spark):
    """Odd texts under NULL, repeated and plain ids, with extra columns that clash with inner names."""
    rows = [(None if i % 7 == 3 else i // 2 * 2, t, None if i % 3 else "en", "s", 1, i) for i, t in enumerate(ODD_TEXTS)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, fp int, w int")
