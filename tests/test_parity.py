"""Every query that SQL can express gives the rows of its SQL, on the smallest tables."""

import glob
import os
import subprocess
import sys
from decimal import Decimal

import pytest

from ledgerloom.queries import engine, engine_sql, general

DATA = "/root/testdata/sf0.001"
QUERIES, ORACLE = engine.QUERIES | general.QUERIES, engine_sql.ORACLE | general.ORACLE
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


def plain(x):
    if isinstance(x, float):
        return repr(round(x, 9))
    return str(x.normalize() + 0) if isinstance(x, Decimal) else str(x)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(plain(r[i]) for i in order) for r in data)


@needs_data
@pytest.mark.parametrize("name", sorted(ORACLE))
def test_parity(spark, name):
    duckdb = pytest.importorskip("duckdb")
    db = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        db.execute(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    sql = db.execute(ORACLE[name])
    want = rows([c[0] for c in sql.description], sql.fetchall())
    df = QUERIES[name](spark, DATA)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == want


def test_every_sql_has_a_query():
    assert set(ORACLE) <= set(QUERIES)


def test_the_rest_works_without_the_subpackage():
    code = "import sys; sys.modules['ledgerloom.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert 'p1_found' in q and 'p3_found' not in q and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
