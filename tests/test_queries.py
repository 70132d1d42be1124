import os

import duckdb
import pytest

import __spark_entry__ as entry
from ranktide.plans.queries import ORACLE, QUERIES

DATA = "/root/testdata/sf0.001"
SOME = ["rga_by_flag", "rga_weighted", "average_ranks", "rga_curves", "jackknife_values", "bootstrap_values", "test_permutation", "kendall", "one_vs_rest", "shapley", "tailswap", "outcome_gaps", "cohort_search", "monitor_daily"]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
@pytest.mark.parametrize("name", SOME)
def test_same_as_sql(spark, name):
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    want = c.sql(ORACLE[name])
    got = QUERIES[name](spark, DATA).select(*want.columns).collect()
    key = lambda r: tuple((x is None, str(x)) for x in r)
    a, b = sorted((tuple(r) for r in got), key=key), sorted(want.fetchall(), key=key)
    assert len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        assert x == pytest.approx(y, abs=2e-6) if all(isinstance(v, (int, float)) for v in x) else x == y


def test_entry_names_queries():
    assert set(ORACLE) <= set(QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
