"""Every registered query against its SQL counterpart on the smallest tables."""

import math
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
duckdb = pytest.importorskip("duckdb")

import __spark_entry__ as spark_entry  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def other_engine():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def key(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    return f"{type(v).__name__}:{v}"


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(key(r[i]) for i in order) for r in rows)


QUERIES = spark_entry.queries()
SQL = spark_entry.oracle_sql()


@pytest.mark.parametrize("name", [name for name in QUERIES if name in SQL])
def test_query(spark, other_engine, name):
    df = QUERIES[name](spark, FOLDER)
    mine = table(df.columns, df.collect())
    result = other_engine.execute(SQL[name])
    assert mine == table([c[0] for c in result.description], result.fetchall())


def test_entry(spark):
    df = spark_entry.entry(spark)
    assert df.columns == ["index_id", "sex", "n", "mean"] and df.count() > 47


def test_every_sql_is_compared(request):
    """No comparison is lost on the way to the run, as by two files of one name."""
    if request.config.option.keyword or any("::" in arg for arg in request.config.args):
        pytest.skip("a selection of tests")
    compared = {item.callspec.params["name"] for item in request.session.items if item.path == Path(__file__) and hasattr(item, "callspec")}
    assert compared == set(SQL) <= set(QUERIES)
