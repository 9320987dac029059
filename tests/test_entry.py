import sys

import __spark_entry__
import duckdb
import pytest
from isogloss.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(row):
    return repr(tuple(round(v, 6) if isinstance(v, float) else v for v in row))


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_query_gives_the_rows_of_its_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = registry.QUERIES[name](spark, SF)
    found = con.execute(registry.ORACLE[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(df.columns)
    assert sorted(map(norm, df.select(*columns).collect())) == sorted(map(norm, found.fetchall()))


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 100
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_queries_without_a_library_of_the_optional_subpackage(monkeypatch):
    for name in [n for n in sys.modules if n.startswith(("isogloss.llm", "corpus_pipeline"))]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "isogloss.llm", None)
    assert set(__spark_entry__.queries()) == set(registry.QUERIES)
    assert set(__spark_entry__.oracle_sql()) == set(registry.ORACLE)
