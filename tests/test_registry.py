"""Every query with SQL against DuckDB, on whole tables."""

import datetime
import glob
import math
import os

import duckdb
import pytest

from quernlake.plans import memory, messages, registry  # noqa: F401  memory and messages register their queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6g}"
    if isinstance(v, (list, tuple)):
        return tuple(map(norm, v))
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return str(v)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_same_as_sql(spark, con, name):
    df = registry.QUERIES[name](spark, SF)
    if name not in registry.ORACLE:
        assert df.collect() is not None
        return
    rel = con.sql(registry.ORACLE[name])
    cols = sorted(rel.columns)
    assert sorted(df.columns) == cols
    want = sorted(tuple(norm(r[rel.columns.index(c)]) for c in cols) for r in rel.fetchall())
    got = sorted(tuple(norm(r[c]) for c in cols) for r in df.collect())
    assert got == want


def test_streamed_slots_as_the_batch_form(spark):
    from quernlake.plans import messages
    from quernlake.streaming import sessions

    got = sorted(map(tuple, messages.streamed_slots(spark, SF).collect()))
    assert got == sorted(map(tuple, sessions.rotation_of(messages.slot_events(spark, SF)).collect())) and got
