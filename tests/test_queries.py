"""Every registered query of the library against its SQL, on the small tables."""

import os

import duckdb
import pytest

from textmill.plans import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return c


def rows(values, columns):
    def plain(x):
        return round(x, 6) if isinstance(x, float) else x

    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in values), key=repr)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    got = [tuple(r) for r in df.collect()]
    assert got
    if name in ORACLES:
        cursor = con.execute(ORACLES[name])
        columns = [c[0] for c in cursor.description]
        assert sorted(df.columns) == sorted(columns)
        assert rows(got, df.columns) == rows(cursor.fetchall(), columns)


def test_token_loss_reads_later_turns(spark, tmp_path):
    turns = [(1, 0, "system", "s"), (1, 1, "user", "a b"), (1, 2, "assistant", "a"), (1, 3, "user", "c c d"), (1, 4, "assistant", "c"), (1, 5, "user", "e")]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = QUERIES["token_loss_pairs"](spark, str(tmp_path)).collect()
    assert sorted(tuple(r) for r in got) == [(1, 1, 1), (1, 3, 2)]


def test_safe_names_reads_whole_texts(spark, tmp_path):
    spark.createDataFrame([(1, "a" + " " * 300 + "b")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert QUERIES["safe_names"](spark, str(tmp_path)).first().name == "a b"
