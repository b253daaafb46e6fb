"""Every registered query of the panel against its SQL, on the smallest tables."""

import os

import duckdb
import pytest

from keelson.plans.oracle import ORACLE_SQL
from keelson.plans.queries import QUERIES
from keelson.plans.run import Run

DATA = "/root/testdata/sf0.001"


def rows(columns: list[str], found) -> list[tuple]:
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted((tuple(repr(round(x, 6) + 0.0) if isinstance(x, float) else str(x) for x in (r[k] for k in order)) for r in found), key=str)


@pytest.fixture(scope="module", autouse=True)
def one_run():
    """All queries of this module follow the tables of one run; else each would write its own."""
    made, customers = {}, Run.__dict__["customers"]
    plain = Run.customers
    Run.customers = classmethod(lambda cls, spark, sf_dir: made.setdefault(sf_dir, None) or made.update({sf_dir: plain(spark, sf_dir)}) or made[sf_dir])
    yield
    Run.customers = customers


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("orders", "lineitem", "customer", "nation", "region"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    said = con.execute(ORACLE_SQL[name])
    got = QUERIES[name](spark, DATA)
    assert rows(got.columns, got.collect()) == rows([c[0] for c in said.description], said.fetchall())


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE_SQL)
