"""The kept index: agrees with a scan of all rows after any updates, reads only its grams' folders, survives a restart."""

import random

import pytest
from pyspark.sql import functions as F

from quernlake.functions import exprs as X
from quernlake.operators.textindex import TextIndex
from quernlake.shared import scratch

WORDS = ["喜欢猫", "iphone", "猫", "bright leaves", "wander", "的 bot", "15", "onst", "我们", "x_1"]


def frame(spark, rows):
    return spark.createDataFrame([(i, u, x) for i, (u, x) in rows.items()], "id string, updated double, text string")


def scan(rows, query, k, offset=0):
    return rows.withColumn("score", X.lexical_score(X.squeeze(F.col("text")), X.query_tokens(query))).where("score > 0").orderBy(F.desc("score"), "id").offset(offset).limit(k)


@pytest.mark.parametrize("most", [0, 10**9])
def test_as_a_scan_after_updates(spark, most):
    r = random.Random(2)
    index, rows, clock = TextIndex(spark, scratch(spark, "index"), buckets=16), {}, 0
    for step in range(4):
        for _ in range(25):
            clock += 1
            rows[f"r{r.randrange(60)}"] = (float(clock) if r.random() < 0.9 else None, r.choice(["", " ", None]) if r.random() < 0.1 else " ".join(r.choices(WORDS, k=3)))
        for i in r.sample(sorted(rows), 3):
            del rows[i]
        df = frame(spark, rows)
        if step != 2:  # one batch isn't indexed at all before the search
            index.add(df)
        if step == 3:
            index.merge(df)
            assert len(index.segments) == 1
        index = TextIndex.load(spark, index.path)
        for query in ("猫", "iphone onst", "喜欢", "我们", "zzz", "", "BRIGHT 15"):
            got = index.search(df, query, 9, ["id"], most=most, offset=1)
            want = scan(df, query, 9, 1) if X.query_tokens(query) else df.withColumn("score", F.lit(0)).limit(0)
            assert got.select("id", "score").collect() == want.select("id", "score").collect()


def test_reads_only_the_folders_of_its_grams(spark):
    index = TextIndex(spark, scratch(spark, "index"), buckets=64)
    rows = frame(spark, {f"r{k}": (float(k), f"word{k} {WORDS[k % 10]}") for k in range(300)})
    index.add(rows)
    near = index.candidates("喜欢")
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert near.select(F.input_file_name()).count() <= 300 and len(index._buckets(["喜欢"])) == 1
    assert near.count() == 30


def test_empty(spark):
    index = TextIndex(spark, scratch(spark, "index"))
    none = frame(spark, {})
    index.add(spark.createDataFrame([], none.schema))
    assert index.search(spark.createDataFrame([], none.schema), "猫", 3, ["id"]).count() == 0
    df = spark.createDataFrame([(None, 1.0, "猫"), ("a", None, "猫"), ("b", 2.0, None)], none.schema)
    index.add(df)
    assert {r.id for r in index.search(df, "猫", 9, ["id"]).collect()} == {None, "a"} - {None}
