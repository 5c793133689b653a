import os

import duckdb
import pytest

from cinelith.plans.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_against_sql(spark, name):
    if not os.path.isdir(SF):
        pytest.skip("no tables here")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    found = QUERIES[name](spark, SF)
    wanted = con.execute(ORACLES[name])
    names = [c[0] for c in wanted.description]
    assert sorted(names) == sorted(found.columns)
    order = lambda rows: sorted(tuple(str(x) for x in r) for r in rows)
    assert order(found.select(*names).collect()) == order(wanted.fetchall())
