"""Every query with a SQL twin equals it on the smallest tables."""

import duckdb
import pytest

from docketry.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    clean = lambda v: round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else v
    return sorted(str([clean(row[i]) for i in order]) for row in values)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_equals_oracle(spark, name):
    found = catalog.queries()[name](spark, SF)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    wanted = con.execute(catalog.oracle_sql()[name])
    names = [c[0] for c in wanted.description]
    assert sorted(found.columns) == sorted(names)
    assert rows(found.columns, [tuple(r) for r in found.collect()]) == rows(names, wanted.fetchall())
