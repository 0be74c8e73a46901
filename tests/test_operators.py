import datetime
import json

import pytest
from pyspark.sql import functions as F

from quernlake.functions import cleaning as C
from quernlake.functions import exprs as X
from quernlake.operators import consolidate as K
from quernlake.operators import lifecycle as L
from quernlake.sources import legacy
from quernlake.streaming import capture as ST


def one(spark, f, *values):
    df = spark.createDataFrame([(v,) for v in values], "c string")
    return [r[0] for r in df.select(f(F.col("c"))).collect()]


def test_text_functions(spark):
    assert one(spark, X.normalize, "Ab, c!", None) == ["abc", None]
    assert one(spark, X.bigrams, "a", "", "Ab a", "喜欢猫") == [["a"], [], ["ab", "ba"], ["喜欢", "欢猫"]]
    assert X.query_tokens("the iPhone 15 喜欢猫, 猫 and 的") == ["15", "iphone", "喜欢", "欢猫", "猫", "的"]
    assert X.query_tokens("that and with 我们, 之前") == [] and X.query_tokens("翅 膀") == ["翅膀"] == one(spark, X.tokens_of, "翅 膀")[0]
    assert X.match_grams(["iph", "ab", " "]) == ["ip", "ph", "ab"]
    assert one(spark, lambda c: X.overlap_hit(c, "order 123456 done"), "12345", "99", "order is done", "order", None) == [True, False, True, False, False]
    assert one(spark, lambda c: C.rejection(c, 30), "\n{\"a\": 1}", "\t ok\n") == ["markup_or_serialized_output", None]
    assert one(spark, X.index_grams, "ab 喜欢", "") == ["a b ab 喜 欢 喜欢", ""]
    assert one(spark, lambda c: C.rejection(c, 30), None, "x" * 31, " ! ", "a\x01b", "<b>x</b>", "未知", "ab" * 10, "fine text") == ["invalid_text", "too_long", "empty", "control_characters", "markup_or_serialized_output", "placeholder", "repetition", None]
    assert one(spark, lambda c: C.media_only(c, ["小明"]), "[Reply ID: 3]", "[Reply x] 你好呀", "@小明！", "@他就好了", "[Image a", "[At 123] 555 hi", "@123 []", None) == [True, False, True, False, True, False, True, True]
    assert one(spark, C.without_reasoning, "a<reasoning x=1>b\nc</reasoning>d", "<reasoning>t <msg>m</msg>", "<reasoning>kept", None) == ["ad", "<msg>m</msg>", "kept", ""]
    assert one(spark, lambda c: C.recall_text(c, 12), "see [Image cat]  now", "x" * 20, None) == ["see [Image]…", "x" * 12 + "…", ""]
    assert one(spark, lambda c: X.proximity_bonus(c, ["ab", "cd"]), "ab cd", "ab" + "x" * 40 + "cd", "ab", None)[:3] == [4, 0, 0]


def test_edit_restore_purge(spark):
    rows = spark.createDataFrame([("a", "x", 0), ("b", "y", 3)], "id string, content string, revision int")
    new, versions = L.edit(rows, spark.createDataFrame([("a", 0, "z"), ("b", 2, "no")], "id string, revision int, new_content string"), ["content"])
    assert sorted(map(tuple, new.collect())) == [("a", "z", 1), ("b", "y", 3)]
    assert [json.loads(r.snapshot)["content"] for r in versions.collect()] == ["x"]
    assert sorted(map(tuple, L.restore(new, versions).collect())) == [("a", "x", 2), ("b", "y", 3)]
    left = L.purge({"rows": (rows, "id")}, spark.createDataFrame([("a",), ("a",)], "id string"))
    assert [r.id for r in left["rows"].collect()] == ["b"]


def test_cold(spark):
    schema = "id string, content string, cold int, archived_at double, deleted int"
    rows = spark.createDataFrame([("a", "old", 1, 0.0, 0), ("b", "new", 1, 9e8, 0), ("c", "gone", 0, None, 1), ("d", "hot", 0, None, 0), ("e", None, 1, 0.0, 0)], schema)
    hot, cold = L.spill_cold(rows, 1e9, days=10**4)
    assert {r.record_id: r.content for r in cold.collect()} == {"a": "old", "c": "gone"}
    assert {r.id: r.content for r in L.fill_cold(hot, cold).collect()} == {"a": "old", "b": "new", "c": "gone", "d": "hot", "e": ""}
    again = L.spill_cold(hot, 1e9, days=10**4)[1]
    assert again.count() == 0


def test_orphans_and_identities(spark):
    facts = spark.createDataFrame([("f", ["r", "s"]), ("g", ["s"]), ("h", [])], "id string, sources array<string>")
    records = spark.createDataFrame([("r", 0), ("s", 1)], "id string, deleted int")
    assert [r.id for r in L.orphans(facts, records).collect()] == ["g"]
    ids = spark.createDataFrame([("legacy:user:1",), ("legacy:user:2",), ("legacy:user:3",), ("qq:9",)], "id string")
    known = spark.createDataFrame([("qq:1",), ("qq:2",), ("tg:2",)], "id string")
    assert {r.id: r.resolved for r in L.resolve_identities(ids, known).collect()} == {"legacy:user:1": "qq:1", "legacy:user:2": "legacy:user:2", "legacy:user:3": "legacy:user:3", "qq:9": "qq:9"}


def row(sid, k, role, level=0, content="x", visibility="session"):
    return (sid, f"{sid}{k:03d}", role, level, k, visibility, content, 1, 0, 0, float(k), float(k), ["u"])


def test_fold_plan_and_fold(spark):
    schema = "sid string, id string, role string, level int, position int, visibility string, content string, active int, deleted int, permanent int, start double, end double, users array<string>"
    rows = [row("a", k, "user" if k % 2 == 0 else "assistant") for k in range(7)] + [row("b", k, "user") for k in range(9)] + [row("c", k, "assistant", 1) for k in range(4)]
    df = spark.createDataFrame(rows, schema)
    plan = K.fold_plan(df, K.FoldSettings(rounds=3))
    got = sorted((r.sid, r.ordinal, r.target_level) for r in plan.collect())
    assert got == [("a", k, 1) for k in range(6)] + [("c", k, 2) for k in range(3)]
    archives, edges = K.fold(df, plan)
    assert sorted((r.sid, r.level, r.children, r.start, r.end) for r in archives.collect()) == [("a", 1, 6, 0.0, 5.0), ("c", 2, 3, 0.0, 2.0)]
    assert edges.count() == 9
    tight = K.fold_plan(df, K.FoldSettings(rounds=3, max_chars=4))
    assert sum(r.sid == "a" for r in tight.collect()) == 4


def test_verdicts_and_take_apart(spark):
    groups = spark.createDataFrame([("1", "g", "a", 1.0), ("1", "g", "b", 2.0), ("1", "h", "c", 1.0), ("1", "h", "d", 5.0)], "batch string, grp string, id string, time double")
    verdicts = spark.createDataFrame([("1", 0, "zz", ["c", "q"]), ("1", 1, "a", ["a", "x"]), ("1", 2, "a", ["a"])], "batch string, verdict int, target_id string, source_ids array<string>")
    got = {r.verdict: (r.grp, r.target_id, r.source_ids) for r in K.pair_verdicts(groups, verdicts).collect()}
    assert got == {0: ("h", "d", ["d", "c"]), 1: ("g", "a", ["b", "a"]), 2: (None, "a", ["a"])}
    merged = spark.createDataFrame([("t", "one；two；three")], "id string, content string")
    versions = spark.createDataFrame([("t", "u", "two"), ("t", "t", "one"), ("t", "v", "decoy"), ("t", "w", "three")], "target string, id string, content string")
    assert sorted((r.ordinal, r.id) for r in K.take_apart(merged, versions).collect()) == [(0, "t"), (1, "u"), (2, "w")]
    assert K.take_apart(merged, versions.where("id <> 't'")).count() == 0


def test_sources_and_ingest(spark, tmp_path):
    (tmp_path / "core.txt").write_text("# c\nfirst entry\n\nfirst entry\nsecond\n")
    (tmp_path / "p.json").write_text('{"name": "A", "preferences": {"food": "tea"}, "other": "no", "traits": ["calm"]}')
    (tmp_path / "q.toml").write_text('[facts]\na = "b"\n')
    entries = legacy.lines(spark, f"{tmp_path}/core.txt")
    assert entries.count() == 3
    assert sorted((r.key, r.category) for r in legacy.json_profiles(spark, f"{tmp_path}/p.json").collect()) == [("name", "profile"), ("other", "unknown_section"), ("preferences.food", "preference"), ("traits.0", "profile")]
    assert [r.text for r in legacy.toml_trees(spark, f"{tmp_path}/q.toml").collect()] == ["b"]
    ledger = spark.createDataFrame([], "source string, key string, digest string")
    new, report = legacy.ingest(entries, ledger, "s")
    assert sorted(r.text for r in new.collect()) == ["first entry", "second"]
    assert {r.reason: r.n for r in report.collect()} == {"imported": 2, "duplicate": 1}
    known = entries.select(F.lit("s").alias("source"), "key", F.sha2("text", 256).alias("digest"))
    assert legacy.ingest(entries, known, "s")[0].count() == 0
    legacy.export({"entries": entries}, str(tmp_path / "out"))
    legacy.log_decisions(entries, str(tmp_path / "log"))
    assert spark.read.json(f"{tmp_path}/out/entries").count() == spark.read.json(f"{tmp_path}/log").count() == 3


def at(s):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=s)


@pytest.fixture
def stream(spark, tmp_path):
    def make(name, batches, schema):
        src = str(tmp_path / name)
        for b in batches:
            spark.createDataFrame(b, schema).coalesce(1).write.mode("append").parquet(src)
        return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)

    return make


def test_capture_stream(spark, stream, tmp_path):
    rows = [("k1", "s", at(0), "a"), ("k2", "s", at(1), "b"), ("k1", "s", at(2), "a again"), (None, "s", at(3), "no key"), ("k3", None, at(90_000), "c")]
    src = stream("m", [rows, [*rows[:1], ("k4", "s", at(5), "d"), ("k5", None, at(5), "e")]], "event_key string, sid string, ts timestamp, text string")
    for check in ("c", "c", "d"):  # a restart, and another checkpoint at the same table
        ST.capture_to(src, str(tmp_path / "t"), str(tmp_path / check)).awaitTermination()
        got = sorted((r.event_key, r.position, r.text) for r in ST.captured(spark, str(tmp_path / "t")).collect())
        assert got == [("k1", 0, "a"), ("k2", 1, "b"), ("k3", 0, "c"), ("k4", 2, "d"), ("k5", 1, "e")]


def test_a_batch_that_runs_again_files_the_same(spark, tmp_path):
    schema, path = "event_key string, sid string, ts timestamp", str(tmp_path / "t")
    one = spark.createDataFrame([("a", "s", at(0)), ("b", "s", at(1))], schema)
    two = spark.createDataFrame([("b", "s", at(1)), ("c", "s", at(2))], schema)
    ST.capture_batch(one, path, "x-0", None)
    for _ in range(2):
        ST.capture_batch(two, path, "x-1", "x-0")
    assert sorted((r.event_key, r.position) for r in ST.captured(spark, path).collect()) == [("a", 0), ("b", 1), ("c", 2)]
    plan = spark.read.option("basePath", f"{path}/rows").parquet(f"{path}/rows").where("day = '2024-01-01'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan


def test_capture_drops_what_comes_again(spark, stream):
    src = stream("m2", [[("k1", at(0), "a"), ("k2", at(1), "b"), ("k1", at(2), "a again")]], "event_key string, ts timestamp, text string")
    q = ST.capture(src).writeStream.format("memory").queryName("once").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("once").count() == 2


def test_names_and_delivery_streams(spark, stream):
    src = stream("n", [[("e", "new", at(5))], [("e", "late", at(1)), ("e", "", at(9))]], "entity string, name string, ts timestamp")
    q = ST.latest_names(src).writeStream.format("memory").outputMode("complete").queryName("names").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [(r.entity, r.name) for r in spark.table("names").collect()] == [("e", "new")]
    src = stream("d", [[("s", "a", at(0)), ("s", "b", at(0))], [("s", "a", at(60)), ("s", "a", at(4000)), ("z", "a", at(60))]], "session string, id string, ts timestamp")
    q = ST.not_delivered(src).writeStream.format("memory").outputMode("append").queryName("delivered").trigger(availableNow=True).start()
    q.awaitTermination()
    got = sorted((r.session, r.id, r.ts) for r in spark.table("delivered").collect())
    assert [x[:2] for x in got] == [("s", "a"), ("s", "a"), ("s", "b"), ("z", "a")]
