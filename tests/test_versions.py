"""Edits, conflicts, restore and purge against plain Python; ids rewritten wherever they stand."""

import pytest
from pyspark.sql import functions as F

from quernlake.operators import identity as I
from quernlake.operators.versions import VersionedTable
from quernlake.shared import scratch

SCHEMA = "id string, revision int, text string, users array<string>, importance int"


@pytest.fixture
def table(spark):
    rows = [(f"r{k}", 1, f"text {k}", ["a", "b"] if k % 2 else None, k if k % 3 else None) for k in range(40)]
    return VersionedTable.create(spark.createDataFrame(rows, SCHEMA), scratch(spark, "versioned"), buckets=8)


def as_dict(df):
    return {r.id: tuple(r)[1:] for r in df.collect()}


def test_edit_conflict_restore(spark, table):
    before = as_dict(table.rows())
    edits = spark.createDataFrame([(1, "r3", 1, "new 3", None), (2, "r3", 1, "late", 9), (3, "r4", 7, "no", None), (4, "gone", 1, "x", None), (5, "r5", None, None, 5)], "n int, id string, revision int, text string, importance int")
    folders = dict(table.folders)
    conflicts = table.edit(edits, ["text", "importance"], 100.0)
    assert sorted(map(tuple, conflicts.collect())) == [("gone", 4, "missing"), ("r3", 2, "second"), ("r4", 3, "revision")]
    assert sum(folders[b] != f for b, f in table.folders.items()) <= 4 < len(folders)
    table = VersionedTable.load(spark, table.path)
    now = as_dict(table.rows())
    assert now["r3"] == (2, "new 3", ["a", "b"], None) and now["r5"] == (2, "text 5", ["a", "b"], 5)
    assert {i: v for i, v in now.items() if i not in ("r3", "r5")} == {i: v for i, v in before.items() if i not in ("r3", "r5")}
    assert table.edit(spark.createDataFrame([(1, "r3", 2, "newer 3", 1)], edits.schema), ["text", "importance"], 101.0).count() == 0
    versions = {(r.target, r.revision): r.version for r in table.versions().collect()}
    assert set(versions) == {("r3", 1), ("r5", 1), ("r3", 2)}
    wanted = spark.createDataFrame([(1, versions["r3", 1], 3), (2, versions["r5", 1], 1), (3, "none", 1)], "n int, version string, revision int")
    assert sorted(map(str, table.restore(wanted, 102.0).collect())) == sorted(["Row(id='r5', n=2, why='revision')", "Row(id=None, n=3, why='unknown')"])
    assert as_dict(table.rows())["r3"] == (4, *before["r3"][1:])
    back = table.versions().where("target = 'r3' AND revision = 3").first().version
    table.restore(spark.createDataFrame([(1, back, None)], wanted.schema), 103.0)
    assert as_dict(table.rows())["r3"] == (5, "newer 3", ["a", "b"], 1)


def test_purge_takes_all_of_it(spark, table):
    table.edit(spark.createDataFrame([(1, "r1", 1, "x"), (2, "r2", 1, "y")], "n int, id string, revision int, text string"), ["text"], 1.0)
    vectors = spark.createDataFrame([("r1", 1.0), ("r2", 2.0)], "id string, v double")
    edges = spark.createDataFrame([("r1", "r2"), ("r2", "r3")], "parent string, child string")
    left = table.purge(spark.createDataFrame([("r1",), ("none",), (None,)], "id string"), {"vectors": (vectors, "id"), "edges": (edges, "parent")})
    assert "r1" not in as_dict(table.rows()) and table.rows().count() == 39
    assert [r.target for r in table.versions().collect()] == ["r2"]
    assert [tuple(r) for r in left["vectors"].collect()] == [("r2", 2.0)] and [tuple(r) for r in left["edges"].collect()] == [("r2", "r3")]
    assert as_dict(VersionedTable.load(spark, table.path).rows()) == as_dict(table.rows())


def test_nothing_to_do(spark, table):
    before = as_dict(table.rows())
    assert table.edit(spark.createDataFrame([], "n int, id string, revision int, text string"), ["text"], 1.0).count() == 0
    assert as_dict(table.rows()) == before and table.versions().count() == 0


def test_ids_in_nested_places(spark):
    rows = [(1, "old", ["old", "new", "x", None], [("old", "p", "y"), ("x", "p", "old")], None), (2, "x", None, None, "old"), (3, None, [], [], None), (4, "keep", ["two"], [(None, "old", "old")], "old")]
    df = spark.createDataFrame(rows, "id int, who string, users array<string>, relations array<struct<subject:string,predicate:string,object:string>>, src string")
    mapping = spark.createDataFrame([("old", "new"), ("two", "one"), ("keep", "keep"), (None, "z"), ("unused", "z")], "id string, target string")
    got = {r.id: r for r in I.rewritten(df, mapping, ["who", "users", "relations.subject", "relations.object", "src"]).collect()}
    assert got[1].who == "new" and got[1].users == ["new", "x", None] and [tuple(x) for x in got[1].relations] == [("new", "p", "y"), ("x", "p", "new")]
    assert got[2].src == "new" and got[2].users is None and got[2].relations is None
    assert [r.changed for r in sorted(got.values(), key=lambda r: r.id)] == [True, True, False, True]
    assert got[4].users == ["one"] and [tuple(x) for x in got[4].relations] == [(None, "old", "new")] and got[4].src == "new"
    assert I.rewritten(df.limit(0), mapping, ["who"]).count() == 0


def test_hot_id(spark):
    df = spark.range(3000).select(F.col("id").cast("string").alias("id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("u"), "id")).alias("who"))
    got = I.rewritten(df, spark.createDataFrame([("hot", "cold"), ("u1", "v1")], "id string, target string"), ["who"])
    assert got.where("who = 'cold'").count() == 1000 and got.where("changed").count() == 1001 and got.count() == 3000
