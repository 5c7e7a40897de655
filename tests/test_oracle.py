import duckdb
import pytest

import __spark_entry__ as entry
import oracle_check as oc
from sediment.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, name):
    df = registry.QUERIES[name](spark, SF)
    got = [tuple(r) for r in df.collect()]
    if name not in registry.ORACLE_SQL:
        assert got
        return
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in oc.TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    rel = con.execute(registry.ORACLE_SQL[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == sorted(df.columns)
    assert oc.rows_of(df.columns, got) == oc.rows_of(names, rel.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
