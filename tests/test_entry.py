import duckdb
import pytest

import __spark_entry__ as entry
from lacustra.plans.oracle import ORACLE_SQL
from lacustra.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def same(df, sql):
    db = duckdb.connect()
    for t in TABLES:
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    rel = db.sql(sql)
    columns = sorted(rel.columns)
    assert columns == sorted(df.columns)
    norm = lambda r: tuple(round(v, 6) if isinstance(v, float) else v for v in r)
    expected = sorted(map(norm, rel.project(", ".join(f'"{c}"' for c in columns)).fetchall()), key=repr)
    got = sorted((norm(r) for r in df.select(*columns).collect()), key=repr)
    assert len(got) == len(expected)
    for g, x in zip(got, expected, strict=True):
        assert g == pytest.approx(x, abs=2e-6) if all(isinstance(v, (int, float)) for v in x) else g == x


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, SF)
    if name in ORACLE_SQL:
        same(df, ORACLE_SQL[name])
    else:
        assert df.count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(ORACLE_SQL) <= set(entry.oracle_sql()) <= set(entry.queries())
