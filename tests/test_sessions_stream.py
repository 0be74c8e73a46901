"""Streams with state against their batch forms, for several cuts of the same input."""

import random

import pytest
from pyspark.sql import functions as F

from quernlake.functions import exprs as X
from quernlake.streaming import sessions as S


def replay(spark, path, rows, schema, cuts, f, by):
    """Runs ``f`` on a stream of ``rows`` cut into batches, and gives what it wrote."""
    cuts = [0, *cuts, len(rows)]
    for k, (a, z) in enumerate(zip(cuts, cuts[1:])):
        spark.createDataFrame(rows[a:z], schema).coalesce(1).write.mode("append").parquet(f"{path}/in/b={k}")
    with S.rocks(spark):
        src = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in/b=*")
        query = f(src).writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/check").trigger(availableNow=True).start()
        query.awaitTermination()
        assert len(query.recentProgress) >= len(cuts) - 1
    return sorted(map(tuple, spark.read.parquet(f"{path}/out").select(*by).collect()))


def messages(seed, n=60):
    r, at, out = random.Random(seed), 1000.0, []
    for k in range(n):
        at += r.choice([1.0, 5.0, 5.0, 400.0])
        out.append((f"s{r.randrange(3)}", f"m{k:03}", r.choice(["user", "assistant", "assistant", None]), at))
    return out


@pytest.mark.parametrize("cuts", [[], [7, 20, 21, 50]])
def test_rounds_are_the_same_for_any_cut(spark, tmp_path, cuts):
    rows = messages(3)
    shuffled = rows[:]
    for k in range(0, len(rows) - 3, 3):  # a little out of order
        if rows[k + 2][3] - rows[k][3] < 20:
            shuffled[k], shuffled[k + 2] = shuffled[k + 2], shuffled[k]
    rows_ts = [(s, i, role, at) for s, i, role, at in shuffled]
    ts = lambda df: df.select("sid", "id", "role", F.timestamp_millis((F.col("at") * 1000).cast("long")).alias("ts"))
    got = replay(spark, str(tmp_path), rows_ts, "sid string, id string, role string, at double", cuts, lambda src: S.closed_rounds(ts(src), 300.0, "60 seconds"), ["sid", "round", "first", "last", "n", "users", "why"])
    until = max(r[3] for r in rows) - 60
    want = sorted(map(tuple, S.closed_rounds_of(ts(spark.createDataFrame(rows, "sid string, id string, role string, at double")), 300.0, until).collect()))
    assert got == want and {r[-1] for r in got} == {"next", "silent"}


def test_used_in_is_the_columns_rule(spark):
    texts = ["bright leaves fall", "number 123456 here", "我喜欢猫", "", "the and", "a"]
    for reply in ("Bright LEAVES now", "call 123456", "喜欢 猫", ""):
        got = [r[0] for r in spark.createDataFrame([(k, x) for k, x in enumerate(texts)], "k int, s string").orderBy("k").select(X.overlap_hit(F.col("s"), reply)).collect()]
        assert got == [X.used_in(x, reply) for x in texts]


EVENTS = "sid string, at double, kind string, turn long, offered array<struct<id string, text string>>, reply string"


def events(seed=5):
    r, out = random.Random(seed), []
    words = ["bright", "leaves", "wander", "station", "river", "seven"]
    memories = {f"s{s}": [(f"s{s}m{k}", " ".join(r.sample(words, 3))) for k in range(7)] + [(f"s{s}x", "[Image x]"), (None, "bright river")] for s in range(3)}
    at = 0.0
    for turn in range(14):
        for s in memories:
            for _ in range(r.choice([1, 1, 2])):  # steps of one turn
                at += 1
                out.append((s, at, "offer", turn, r.sample(memories[s], r.randint(0, 6)), None))
                at += 1
                out.append((s, at, "reply", turn, None, " ".join(r.sample(words, 3)) if r.random() < 0.6 else ""))
    return out


@pytest.mark.parametrize("cuts", [[], [3, 30, 31, 70]])
def test_slots_are_the_same_for_any_cut(spark, tmp_path, cuts):
    rows = events()
    got = replay(spark, str(tmp_path), rows, EVENTS, cuts, S.rotation, ["sid", "turn", "id", "place", "again"])
    want = sorted(map(tuple, S.rotation_of(spark.createDataFrame(rows, EVENTS)).collect()))
    assert got == want and len(got) > 60


def test_slot_step_by_step():
    state, slot = S._nothing(), S.Slot(count=1, keep=2, rest=2)
    a, b, c = ("a", "bright leaves"), ("b", "river seven"), ("c", "wander station")
    show = lambda turn, *offered: [x[0] for x in S.rotate(state, slot, "offer", turn, list(offered), "")]
    said = lambda text: S.rotate(state, slot, "reply", state["turn"], [], text)
    assert show(1) == [] and show(1, a, b) == ["a"]
    said("nothing")
    assert show(1, b) == ["a"] and state["rounds"] == 1  # a step of the same turn
    said("Bright leaves!")  # used: the next turn changes
    assert state["used"] == {"a": 1} and show(2, a, b) == ["b"]
    said("x")
    said("y")  # stayed its two replies
    assert show(3, b) == [] and show(3, a, b, c) == ["c"]
    said("x")
    said("x")
    assert show(5, a, b) == ["a"]  # both rested; a was used, b never
