"""Every registered query of the library against its SQL oracle, on the smallest driver tables."""

import math
import os

import pytest

from lexiloom.operators import stats
from lexiloom.operators.sampling import QuotaError
from lexiloom.plans import contract

DATA = os.environ.get("LEXILOOM_TEST_DATA", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not os.path.exists(f"{DATA}/documents.parquet"), reason="no driver tables here")


#: Tables for queries whose quota the smallest ones cannot fill.
LARGER = os.path.join(os.path.dirname(DATA), "sf0.01")


def _connect(folder):
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for t in TABLES:
        path = f"{folder}/{t}.parquet"
        con.execute(f"create view {t} as select * from read_parquet('{path + '/*' if os.path.isdir(path) else path}')")
    return con


@pytest.fixture(scope="module")
def sql():
    return _connect(DATA)


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, (int, float)):
        return round(float(value), 6)
    return str(value)


@pytest.mark.parametrize("name", sorted(contract.QUERIES))
def test_query(spark, sql, name):
    try:
        got = contract.QUERIES[name](spark, DATA)
        rows = got.collect()
    except QuotaError:
        sql = _connect(LARGER)
        got = contract.QUERIES[name](spark, LARGER)
        rows = got.collect()
    assert len(set(got.columns)) == len(got.columns)
    if name not in contract.ORACLES:
        return
    found = sql.execute(contract.ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(got.columns)
    order = sorted(names)
    want = sorted((tuple(plain(r[names.index(c)]) for c in order) for r in found.fetchall()), key=str)
    assert sorted((tuple(plain(r[c]) for c in order) for r in rows), key=str) == want


def test_bootstrap_is_registered_with_all_resamples(spark):
    want = stats.bootstrap_ci(contract._deltas(spark, DATA), "id", contract.SEED, 10_000).first()
    assert tuple(contract.bootstrap_ci(spark, DATA).first()) == pytest.approx(tuple(want))
