import pathlib
import sys

import pytest
from odd_rows import ODD

sys.path.append(str(pathlib.Path(__file__).resolve().parents[2]))


@pytest.fixture(scope="session")
def spark():
    from ledgerline.session import get_session

    s = get_session("local[4]", app="ledgerline-llm-tests", **{"spark.sql.shuffle.partitions": "4", "spark.default.parallelism": "4"})
    s.sparkContext.setLogLevel("ERROR")
    yield s


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def documents(spark, sf):
    """Every (doc_id, text) of the smallest tables."""
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]


@pytest.fixture(scope="session")
def odd(spark):
    """The odd rows, with extra columns whose names clash with inner ones."""
    names = ["digest", "fp", "kept", "chunk", "spans", "row", "doc", "id", "best", "n", "lang2"]
    rows = [(i, t, g, "s", 0, *["?"] * len(names)) for i, t, g in ODD]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in names)
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)
