"""Intake, upkeep, aliases, audits and clusters on odd rows."""

from pyspark.sql import functions as F

from quernlake.operators import facts as FA
from quernlake.operators import intake as N
from quernlake.operators import records as R
from quernlake.operators import similar as S
from quernlake.operators.components import components
from quernlake.operators.lifecycle import cold_stats, restore_cold, spill_cold, within_cap


def test_capture(spark):
    schema = "event string, n int, sid string, adapter string, notice boolean, role string, sender_id string, sender_name string, text string, tool_calls array<struct<name string, arguments string>>"
    rows = [
        ("e", 0, "s", "qq", None, "user", "5", " Ann ", "<msg><text>hi</text></msg>", None),
        ("e", 1, "s", "qq", False, "user", "unknown", None, "[Image x] ", []),
        ("e", 2, "s", "qq", True, "user", "6", "Bob", "a notice", None),
        ("e", 3, "s", "qq", False, "user", "wx:7", "", "<msg/>", None),
        ("e", 4, "s", "qq", False, "assistant", None, None, "<reasoning>r</reasoning>", [("look", "n=1")]),
        ("e", 5, "s", None, False, "assistant", "9", None, "done", [("go", None)]),
        ("z", 0, None, "qq", False, None, None, None, None, None),
    ]
    got = {(r.event, r.n): r for r in N.to_capture(spark.createDataFrame(rows, schema), ["Ann"]).collect()}
    assert set(got) == {("e", 0), ("e", 1), ("e", 4), ("e", 5)}
    assert got["e", 0][3:] == ("user", "hi", "hi", "", "Ann", "qq:5", ["9", "qq:5", "wx:7"])
    assert (got["e", 1].category, got["e", 1].speaker, got["e", 1].speaker_id) == ("media", "", "")
    assert got["e", 4].summary == "[调用工具：look(n=1)]" and got["e", 4].content.startswith('{"tool_calls"') and got["e", 4].category == "tool"
    assert got["e", 5].summary == "done\n[调用工具：go]"
    assert N.to_capture(spark.createDataFrame([], schema)).count() == 0


def test_pinned_and_labels(spark):
    e = spark.createDataFrame([("s", "x", ["a"], 1.5, 2.0, None, None), ("s", "x", ["a"], 1.5, 2.0, None, None), ("s", None, None, 0.0, 0.0, 3, "c")], "sid string, content string, users array<string>, start double, `end` double, importance int, category string")
    got = N.pinned(e, 9.0).orderBy("start").collect()
    assert [(r.content, r.importance, r.category, r.level, r.permanent) for r in got] == [("", 3, "c", 100, 1), ("x", 8, "", 100, 1)] and got[1].id.startswith("100-1500-2000-")
    ids = ["global", "legacy:global", "self", "unscoped", "unresolved:user:12", "unresolved:group:qq:9", "unresolved:odd", "legacy:user:qq:4", "legacy:group:qq:4", "legacy:user:4", "legacy:odd", "qq:4", ""]
    rows = {r.i: (r.label, r.lookup_id) for r in spark.createDataFrame([(i,) for i in ids], "i string").select("i", N.identity_info(F.col("i")).alias("x")).select("i", "x.*").collect()}
    assert rows["unresolved:user:12"] == ("待绑定 · 人物 12", "") and rows["unresolved:group:qq:9"] == ("待绑定 · 群 9", "") and rows["legacy:user:qq:4"] == ("待绑定 · 号码 4", "qq:4")
    assert rows["legacy:group:qq:4"][1] == "qq:gm:4" and rows["legacy:user:4"] == ("待绑定 · 号码 4", "") and rows["legacy:odd"] == ("未分类", "") and rows["qq:4"] == ("名称待补全", "qq:4")
    assert rows["legacy:global"] == rows["global"] == ("全局记忆", "")


def test_aliases_put_back(spark):
    aliases = spark.createDataFrame([("b", "r1", "x"), ("b", "r2", "y"), ("c", "r1", "z")], "batch string, alias string, id string")
    out = spark.createDataFrame([("b", 1, ["r2", "x", "r2"], "t"), ("b", 2, ["r1", "r9", "zz"], "t"), ("b", 3, None, "t"), ("c", 1, ["r1"], None)], "batch string, n int, source_ids array<string>, text string")
    good, wrong = N.restored_aliases(out, aliases)
    assert sorted(map(str, [tuple(r) for r in good.collect()])) == sorted(map(str, [("b", 1, ["y", "x", "y"], "t"), ("b", 3, [], "t"), ("c", 1, ["z"], None)]))
    assert [tuple(r) for r in wrong.collect()] == [("b", 2, ["r9", "zz"])]


FACT = "id string, sid string, subject string, content string, importance int, created double, sources array<string>, deleted int"


def test_audit_merges(spark):
    f = spark.createDataFrame([("a", "s", "p", "x", 5, 1.0, ["1"], 0), ("b", "s", "p", "y", 9, 1.0, ["2", "1"], 0), ("c", "s", "q", "z", 2, 1.0, ["3"], 0), ("d", "s", "p", "w", 2, 1.0, [], 0), ("e", "s", "p", "v", 2, 1.0, ["9"], 1)], FACT)
    v = spark.createDataFrame([("b", "merge", None, None, "a"), ("c", "merge", 3, None, "a"), ("d", "retract", None, None, None), ("e", "merge", None, None, "a")], "id string, action string, importance int, content string, target string")
    r = spark.createDataFrame([("1", "user")], "id string, role string")
    rows, counts = FA.audit_applied(f, v, r)
    got = {x.id: (x.importance, x.deleted, x.sources, x.merged, x.changed) for x in rows.collect()}
    assert got == {"a": (9, 0, ["1", "2"], ["b"], True), "b": (9, 1, ["2", "1"], [], True), "c": (3, 0, ["3"], [], True), "d": (2, 1, [], [], True)}
    assert {x.action: x.n for x in counts.collect()} == {"merge": 1, "refused": 1, "retract": 1}


RECORD = "id string, sid string, content string, importance int, permanent int, active int, deleted int, cold int, revision int, archived_at double, users array<string>, `end` double"


def test_within_cap_leaves_nothing_over(spark):
    rows = [(f"r{k}", "s", f"text {k % 4}" if k else "t" * 900, 9 - k % 5, 1, 1, 0, 0, 1, 0.0, ["u"], 1.0) for k in range(12)]
    records = spark.createDataFrame(rows, RECORD)
    facts = spark.createDataFrame([("f", "s", "u", "text 1", 1, 1.0, ["old"], 0)], FACT)
    for most, chars in ((3, 5000), (30, 40), (1, 1)):
        left, told = within_cap(records, facts, 5.0, most, chars)
        assert R.over_cap(left, most, chars).count() == 0
        gone = {r.id for r in left.collect() if r.permanent == 0}
        assert gone and gone == {s for r in told.collect() for s in r.sources} - {"old"}
        assert [r.importance >= 1 for r in told.where("id = 'f'").collect()] == [True]


def test_cold_store(spark):
    rows = [(f"r{k}", "s", f"body {k}" if k != 3 else " ", 5, 0, 0, 0, 1, 1, 0.0, None, float(k)) for k in range(6)]
    hot, cold = spill_cold(spark.createDataFrame(rows, RECORD), 1e9, 1)
    assert tuple(cold_stats(hot, cold).first()) == (5, 5, 30, 0)
    back, rest = restore_cold(hot, cold, spark.createDataFrame([("r1",), ("r2",), ("no",)], "id string"))
    assert {r.id for r in back.collect() if r.content} == {"r1", "r2"} and rest.count() == 3
    back, rest = restore_cold(back, rest)
    assert {r.id: r.content for r in back.collect()} == {r[0]: r[2] if r[0] != "r3" else "" for r in rows} and rest.count() == 0


def test_clusters_of_few_edges_as_of_many(spark):
    import random

    r = random.Random(4)
    rows = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(5, 5), (None, 3), (7, None)]
    e = spark.createDataFrame(rows, "a long, b long")
    assert sorted(map(tuple, components(e, 10**6).collect())) == sorted(map(tuple, components(e).collect()))
    assert components(e.limit(0), 10).count() == 0
    found = S.clusters(e)
    heads = S.first_members(found, found.select("node").distinct().withColumn("place", -F.col("node")), 2).collect()
    assert all(1 < len(h.members) + 1 and len(h.members) == 2 and h.members == sorted(h.members, reverse=True) for h in heads)


def test_refined(spark):
    rows = spark.createDataFrame([(k, s) for k, s in enumerate([0.05, None, 0.5, 0.01, 0.5])], "id int, s double")
    got = lambda *a: [(r.id, r["rank"]) for r in R.refined(rows, "s", ["id"], *a).orderBy("rank").collect()]
    assert got(0.1, 3) == [(2, 1), (4, 2), (0, 3)] and got(0.1, 1) == [(2, 1), (4, 2)] and got(0.9, 0) == [] and got(0.9, 9) == [(2, 1), (4, 2), (0, 3), (3, 4), (1, 5)]
