"""One search by all its paths; access, trees with loops and pages; mentions by both ways."""

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from quernlake.operators import mentions as M
from quernlake.operators import search as S
from quernlake.operators.textindex import TextIndex
from quernlake.shared import scratch

TEXTS = ["apple banana project notes", "apple orange meeting minutes", "banana project progress report", "cinnamon spice notes", "apple project review summary", "nothing to do with it", "[Image of an apple]", "apple [Reply ID: 4"]
SHAPES = [
    dict(lexical="apple"), dict(lexical="apple banana"), dict(lexical="apple banana project record content report review summary and such very long"), dict(lexical="project progress"),
    dict(lexical="quantum"), dict(lexical=""), dict(lexical="apple", users=("U1",)), dict(lexical="apple", limit=2), dict(lexical="apple", offset=1, limit=2), dict(lexical="apple", exclude_ids=("m0",), prefer_users=("U2",)),
]


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [(f"m{k}", "S1", x, 0, 1737000000.0 + k, 1737000000.0 + k, ["U1"] if k % 2 else ["U2"], "global" if k == 3 else "session", k % 3 and 1, 0, 0, 0, "chat", 0.0, float(k) if k != 4 else None) for k, x in enumerate(TEXTS)]
    rows.append(("z", "S2", "apple elsewhere", 0, 1.0, 2.0, ["U1"], "session", 1, 0, 0, 0, "chat", 0.0, 1.0))
    schema = "id string, sid string, content string, level int, start double, `end` double, users array<string>, visibility string, active int, deleted int, cold int, permanent int, category string, archived_at double, updated double"
    return spark.createDataFrame(rows, schema)


@pytest.mark.parametrize("shape", SHAPES, ids=str)
def test_indexed_and_scanned_paths_agree(spark, corpus, shape):
    index = TextIndex(spark, scratch(spark, "index"), buckets=8)
    index.add(corpus.where("updated < 5").select("id", "updated", "content"), "content")
    ask = replace(S.Ask(sid="S1"), **shape)
    slow, n = S.search(corpus, ask)
    fast, m = S.search(corpus, ask, index=index)
    assert n == m and sorted(fast.collect(), key=str) == sorted(slow.collect(), key=str)
    words = [w for w in ask.lexical.split() if w not in ("and", "the")]
    want = [k for k, x in enumerate(TEXTS) if (not words or any(w in x.lower() for w in words)) and f"m{k}" not in ask.exclude_ids]
    assert n == len(want)
    shown = [r.id for r in slow.orderBy("place").collect()]
    assert "m6" not in shown and len(shown) <= ask.limit and set(shown) <= {f"m{k}" for k in want}


def test_proximity_and_exclusions(spark, corpus):
    page, _ = S.search(corpus, S.Ask(sid="S1", lexical="banana progress", limit=1))
    assert [r.id for r in page.collect()] == ["m2"]
    page, n = S.search(corpus, S.Ask(scope="global", exclude_sid="S1"))
    assert [r.id for r in page.collect()] == ["z"] and n == 1
    page, n = S.search(corpus, S.Ask(sid="S2", strict_session=True))
    assert [r.id for r in page.collect()] == ["z"] and n == 1


def test_access(spark, corpus):
    facts = spark.createDataFrame([("f1", ["gone", "m0"], 0), ("f2", ["z", "m0"], 0), ("f3", [], 0), ("f4", ["m0"], 1)], "id string, sources array<string>, deleted int")
    ids = spark.createDataFrame([(x,) for x in ("m0", "z", "m3", "none", "f1", "f2", "f3", "f4", "m0")], "id string")
    see = lambda sid, users, scope: {r.id for r in S.accessible(ids, corpus, facts, sid, users, scope).collect() if r.allowed}
    assert see("S1", [], "session") == {"m0", "m3", "f1"}
    assert see("S3", ["U1"], "session") == {"m3"}
    assert see("S3", ["U1"], "linked") == {"m3", "z", "f2"}
    assert see("S3", [], "global") == {"m0", "m3", "z", "f1", "f2"}


def test_loops_and_pages(spark):
    rows = [("a", "b", 2), ("a", "c", 1), ("b", "d", 1), ("d", "a", 1), ("d", "e", 2), ("x", "x", 1)]
    e = spark.createDataFrame(rows, "parent string, child string, ordinal int")
    got = S.descend(e, spark.createDataFrame([("a",), ("x",), ("lost",)], "id string"), 5).collect()
    assert sorted("/".join(r.path) for r in got) == ["a", "a/b", "a/b/d", "a/b/d/e", "a/c", "lost", "x"]
    assert {r.id: r.place for r in got if r.parent == "a"} == {"c": 1, "b": 2}
    page = S.descend(e, spark.createDataFrame([("a",)], "id string"), 1, 0, 1).where("depth = 0").first()
    assert (page.kids, page.next) == (2, 1)


@pytest.mark.parametrize("most", [1 << 20, 0])
def test_mentions(spark, most):
    entities = spark.createDataFrame([("qq:1", "星 月", 5), ("qq:22", "Ann", 9), ("q:3", None, 1), ("qq:4", "B", 7)], "entity string, name string, updated int")
    former = spark.createDataFrame([("q:3", "the old Name"), ("none", "Ann"), ("qq:4", None), ("qq:4", "Bob")], "entity string, name string")
    texts = [(1, "今天星月和 Ann 来了"), (2, "the  old Name q:3"), (3, "qq:22 B"), (4, None), (5, "A"), (6, "Bob Ann qq:1 " + "x" * 500), (7, "ann bob")]
    df = spark.createDataFrame(texts, "id int, text string")
    got = lambda **k: sorted((r.id, r.entity, r.place) for r in M.mentions(df, entities, former, automaton_bytes=most, **k).collect())
    assert got() == [(1, "qq:1", 2), (1, "qq:22", 1), (2, "q:3", 1), (3, "qq:22", 1)]
    assert got(longest=None, most=2)[-2:] == [(6, "qq:22", 1), (6, "qq:4", 2)]
    may = spark.createDataFrame([(1, "qq:1"), (3, "qq:1")], "id int, entity string")
    assert got(visible=may) == [(1, "qq:1", 1)]
    assert M.mentions(df.limit(0), entities, former).count() == 0 and M.mentions(df, entities.limit(0), former, automaton_bytes=most).count() == 0


def test_fused_and_vector_paths(spark, corpus):
    """With both rankings: 0.3 of the lexical and 0.7 of the cosine score, each over its best; the total counts all filtered rows."""
    import math

    v = {f"m{k}": [math.cos(k), math.sin(k)] for k in range(0, 8, 2)}
    vectors = spark.createDataFrame([(i, "new", 1, x) for i, x in v.items()], "id string, model string, revision int, vector array<double>")
    page, n = S.search(corpus, S.Ask(sid="S1", lexical="apple project", vector=(1.0, 0.0), model="new", limit=3, skip_media=False), vectors=vectors)
    assert n == 8
    lex = {f"m{k}": 5 * ("apple" in x.lower()) + 7 * ("project" in x) for k, x in enumerate(TEXTS)}
    cos = {i: max(v[i][0], 0) if i in v else 0 for i in lex}
    fused = {i: round(0.3 * lex[i] / 12 + 0.7 * cos[i] / max(cos.values()), 6) for i in lex}
    want = sorted(fused, key=lambda i: (-fused[i], -int(i[1:])))[:3]
    got = page.orderBy("place").collect()
    assert {r.id: r.score for r in got} == {i: fused[i] for i in want}
    page, n = S.search(corpus, S.Ask(sid="S1", vector=(0.0, 1.0), model="new", limit=2), vectors=vectors)
    assert n == 8 and [r.id for r in page.orderBy("place").collect()] == ["m2", "m0"]
