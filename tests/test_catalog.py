import glob
import math
import os

import duckdb
import pytest

from tessella.plans.registry import FLAGSHIP, ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def value(x):
    if x is None or x != x:
        return "null"
    if isinstance(x, (list, tuple)) or hasattr(x, "tolist") and getattr(x, "ndim", 0):
        return str([value(y) for y in x])
    if isinstance(x, bool) or type(x).__name__ == "bool_":
        return str(bool(x))
    if isinstance(x, (int, float)) or hasattr(x, "dtype"):
        return "%.6g" % (float(x) + 0.0) if not math.isclose(float(x), 0, abs_tol=1e-9) else "0"
    return str(x)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_against_sql(spark, con, name):
    got, want = QUERIES[name](spark, SF), con.execute(ORACLE[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    a = sorted(tuple(value(r[c]) for c in sorted(names)) for r in got.collect())
    b = sorted(tuple(value(dict(zip(names, r))[c]) for c in sorted(names)) for r in want.fetchall())
    assert a == b


def test_flagship_is_registered():
    assert FLAGSHIP in QUERIES and set(ORACLE) <= set(QUERIES)
