"""Every query with SQL gives the rows of that SQL."""

import duckdb
import pytest

from nearfield.operators import knn
from nearfield.plans import catalogue

SF_DIR = "/root/testdata/sf0.001"
TABLES = "events documents embeddings benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF_DIR)
    columns = sorted(df.columns)
    got = sorted(repr(tuple(r[c] for c in columns)) for r in df.collect())
    if name in catalogue.ORACLES:
        cursor = duck.execute(catalogue.ORACLES[name])
        named = [d[0] for d in cursor.description]
        assert sorted(named) == columns
        assert got == sorted(repr(tuple(r[named.index(c)] for c in columns)) for r in cursor.fetchall())
    else:
        assert got


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 10
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_int8_lists_reach_the_target_recall(spark):
    at = "/root/testdata/sf0.01"
    df = catalogue.corpus(spark, at)
    truth = knn.knn_join(catalogue.every_row(df), df, catalogue.K, "dot", "vec_id", "embedding")
    found = catalogue.QUERIES["ivf_int8_knn"](spark, at)
    assert knn.recall(truth, found, catalogue.K, "vec_id").first()["recall"] >= catalogue.TARGET_RECALL
