"""Every named query runs, and agrees with its SQL on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as contract

ROOT = os.environ.get("CORROBORA_TEST_TABLES", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(ROOT), reason="no test tables")


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in glob.glob(f"{ROOT}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def plain(v):
    if isinstance(v, float) and math.isnan(v):
        return None
    return tuple(plain(x) for x in v) if isinstance(v, (list, tuple)) else v


def same(a, b):
    if isinstance(a, float) or isinstance(b, float):
        return (a is None and b is None) or (a is not None and b is not None and math.isclose(a, b, rel_tol=1e-6, abs_tol=2e-6))
    if isinstance(a, tuple):
        return isinstance(b, tuple) and len(a) == len(b) and all(map(same, a, b))
    return a == b


def ordered(rows):
    """Exact columns first, so that rounding noise cannot change the order."""
    exact = lambda r: [repr(v) for v in r if not isinstance(v, float)]
    return sorted(rows, key=lambda r: (exact(r), [v for v in r if isinstance(v, float)]))


@pytest.mark.parametrize("name", sorted(contract.queries()))
def test_query(spark, sql, name):
    df = contract.queries()[name](spark, ROOT)
    got = [tuple(plain(v) for v in r) for r in df.collect()]
    text = contract.oracle_sql().get(name)
    if text is None:
        assert len(got) > 0
        return
    cur = sql.execute(text)
    names = [c[0] for c in cur.description]
    assert sorted(names) == sorted(df.columns)
    want = [tuple(plain(v) for v in r) for r in cur.fetchall()]
    at = [df.columns.index(c) for c in names]
    got = [tuple(r[i] for i in at) for r in got]
    assert len(got) == len(want)
    for a, b in zip(ordered(got), ordered(want)):
        assert same(a, b), (a, b)


def test_entry(spark):
    assert contract.entry(spark).count() == 4
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_json_documents_lie_side_by_side(spark, tmp_path):
    from corrobora.session import shared_dir

    root = str(tmp_path)
    spark.createDataFrame([(i, i % 3, i / 4) for i in range(250)], "s_suppkey bigint, s_nationkey int, s_acctbal double").write.parquet(f"{root}/supplier.parquet")
    spark.createDataFrame([(i, f"N{i}") for i in range(3)], "n_nationkey int, n_name string").write.parquet(f"{root}/nation.parquet")
    trees = lambda: set(glob.glob(f"{shared_dir(spark)}/staged/{spark.sparkContext.applicationId}/files-*"))
    before = trees()
    out = contract.queries()["json_documents"](spark, root).collect()
    assert sorted(tuple(r) for r in out) == sorted((i, f"N{i % 3}", i % 3 * 10 + k, i / 4, 1) for i in range(250) for k in (1, 2, 3))
    (tree,) = trees() - before
    # a file per supplier and a folder per shelf, none per file
    assert len(glob.glob(f"{tree}/*/")) == 3
    assert len(glob.glob(f"{tree}/*/*.txt")) == 250
