"""What goes wrong only on larger tables: keys far from zero, many rows of one session, many rows of one group."""

import os
import random
import tracemalloc

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quernlake.functions import exprs as X
from quernlake.llm import toxicity
from quernlake.operators import facts, similar
from quernlake.operators import records as R
from quernlake.plans import messages, registry
from quernlake.streaming import sessions

from .test_registry import SF, norm


def _same(spark, d, name):
    con = duckdb.connect()
    for p in os.listdir(d):
        con.execute(f"CREATE VIEW {p[:-8]} AS SELECT * FROM '{d}/{p}'")
    rel = con.sql(registry.ORACLE[name])
    df = registry.QUERIES[name](spark, str(d)).select(*rel.columns)
    want = sorted(tuple(map(norm, r)) for r in rel.fetchall())
    assert want and sorted(tuple(map(norm, r)) for r in df.collect()) == want


@pytest.fixture(scope="module")
def far(tmp_path_factory):
    """The tables with conversations whose keys, and so times, are those of a large table's end and of its beginning."""
    d = tmp_path_factory.mktemp("far")
    for p in os.listdir(SF):
        os.symlink(f"{SF}/{p}", d / p)
    os.remove(d / "conversations.parquet")
    duckdb.sql(f"COPY (SELECT conv_id + CASE WHEN conv_id % 8 = 7 THEN 200000 ELSE 0 END AS conv_id, turn, role, text FROM '{SF}/conversations.parquet') TO '{d}/conversations.parquet'")
    return d


@pytest.mark.parametrize("name", ["merged_index_search", "index_postings"])
def test_index_with_late_times(spark, far, name):
    assert name in messages.__dict__
    _same(spark, far, name)


class _Handle:
    """State and timers of one key, with a count of reads of the list."""

    def __init__(self):
        self.values, self.timers, self.reads = {}, set(), 0

    def __call__(self, name):
        handle = self

        class State:
            def exists(self):
                return name in handle.values

            def get(self):
                handle.reads += name == "held"
                return handle.values[name]

            def put(self, x):
                handle.values[name] = x

            update = put

            def appendList(self, x):
                handle.values[name] = handle.values.get(name, []) + x

            def clear(self):
                handle.values.pop(name, None)

        return State()

    getListState = getValueState = lambda self, name, schema: self(name)

    def registerTimer(self, at):
        self.timers.add(at)


class _At:
    def __init__(self, at):
        self.at = at

    def getCurrentWatermarkInMs(self):
        return self.at


def test_a_round_reads_what_it_holds_once_a_batch():
    rounds, h, out = sessions._Rounds(5.0), _Handle(), []
    rounds.init(h)
    for b in range(3):
        list(rounds.handleInputRows(("s",), iter([pd.DataFrame({"at": [b * 1000.0 + k for k in range(1000)], "id": [f"{b}-{k:04}" for k in range(1000)], "role": ["user", "assistant"] * 500})]), _At(0)))
        now = (b * 1000 + 939) * 1000
        for at in sorted(x for x in h.timers if x <= now):
            h.timers.discard(at)
            out += [r for d in rounds.handleExpiredTimer(("s",), _At(now), None) for r in d.itertuples(index=False)]
    assert h.reads <= 9 and sum(r[4] for r in out) == 2938 and {r[4] for r in out} == {2}


def test_folding_meets_no_pairs(spark):
    r, top = random.Random(1), float("inf")
    spans = [(f"r{k}", r.choice(["a", "a", "b", None]), r.choice([0, 0, 1, 2, 5, None]), r.choice([0.0, 10.0, 86400.0, 2e5, 9e5, -1e5, float("nan"), top, None]), r.choice([5.0, 20.0, 3e5, 1e6, float("nan"), None]), r.randrange(2), int(r.random() < 0.1)) for k in range(400)]
    df = spark.createDataFrame(spans, "id string, sid string, level int, start double, end double, active int, deleted int")
    rows = df.where("id not like '%7'")
    df.createOrReplaceTempView("every"), rows.createOrReplaceTempView("some")
    want = spark.sql("SELECT id FROM some a WHERE active = 0 AND deleted = 0 AND EXISTS (SELECT 1 FROM some b WHERE b.active = 1 AND b.deleted = 0 AND a.sid = b.sid AND b.level > a.level AND b.start <= a.start AND b.end >= a.end)")
    found = R.folded(rows, df)
    assert sorted(found.collect()) == sorted(want.collect()) and found.count() > 20
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Join LeftSemi" in line and "<=" in line]


def test_alike_sets_in_blocks(spark, monkeypatch):
    """Blocks of a few rows, so that pairs meet within and across them; CJK, single characters, nulls, copies."""
    monkeypatch.setattr(similar, "BLOCK", 16), monkeypatch.setattr(similar, "STRIP", 5), monkeypatch.setattr(similar, "HEAVY", 60), monkeypatch.setattr(similar, "PAGE", 7)
    r = random.Random(4)
    texts = ["".join(r.choices("ab猫喜😀c", k=r.randrange(9))) for _ in range(150)] + ["same text"] * 30 + ["a", "a", "\U0001f600", None, "a\0"]
    rows = [(f"k{k}", x, r.choice(["s", "t", None]), r.choice(["u", "v", None])) for k, x in enumerate(texts)]
    df = spark.createDataFrame(rows, "id string, content string, subject string, category string")
    sets = {i: (set(g), s, c) for i, g, s, c in df.where("content IS NOT NULL").select("id", X.bigrams(F.col("content")), "subject", "category").collect()}

    def want(own, across, group, overlap):
        out = []
        for a, (x, s, c) in sets.items():
            for b, (y, t, d) in sets.items():
                if a < b and x and y and len(x & y) >= overlap and group(s, t):
                    share = round(len(x & y) / min(len(x), len(y)), 6)
                    if share >= (own if c == d is not None else across):
                        out.append((a, b, share))
        return sorted(out)

    equal = lambda s, t: s == t is not None
    assert sorted(map(tuple, similar.category_pairs(df, "id", "content", "subject", "category", 0.6, 0.75, min_overlap=2).collect())) == want(0.6, 0.75, equal, 2)
    assert sorted(map(tuple, similar.category_pairs(df, "id", "content", "subject", "category", 0.6, min_overlap=2).collect())) == want(0.6, 9, equal, 2)
    assert sorted(map(tuple, similar.session_pairs(df, "id", "content", "category", 0.7, 0.9, 2).collect())) == want(0.7, 0.9, lambda s, t: True, 2)
    pairs = want(0.8, 0.8, equal, 1)
    assert sorted(map(tuple, similar.similar_pairs(df, "id", "content", "subject", 0.8, 1).collect())) == pairs
    assert {r.id for r in similar.similar_ids(df, "id", "content", ["subject"], 0.8, 1).collect()} == {i for p in pairs for i in p[:2]}


def test_a_large_group_is_sent_a_few_times(spark, monkeypatch):
    """What one group of all pairs shuffles follows its rows."""

    def received(*_):
        def run(_, batches):
            for b in batches:
                yield pa.RecordBatch.from_arrays([b.column("id")], ["id"])

        return run

    monkeypatch.setattr(similar, "_met", received)
    sets = spark.range(140_000).selectExpr("id", "'' AS of", "'t' AS tag", "array('ab') AS grams")
    assert similar._close(sets, 0.9, 0.9, 1, ids_only=True).count() <= 12 * 140_000


def test_share_and_least_need():
    least = np.repeat(np.arange(1, 300), 300)
    both = np.minimum(np.tile(np.arange(300), 299), least)
    exact = duckdb.from_arrow(pa.table({"k": both, "m": least})).project("round(k / m, 6) AS s").fetchnumpy()["s"]
    assert (similar._share(both, least) == exact).all()
    for t in (0.1, 0.6, 0.666667, 0.75, 0.85, 1.0):
        need = similar._needed(t, 4, 299)
        assert ((both >= need[least]) == ((exact >= t) & (both >= 4))).all()
    assert (similar._needed(9.0, 1, 299)[1:] == np.arange(2, 301)).all()


@pytest.mark.parametrize("longest", [40, 700, 5000])
@pytest.mark.parametrize("bound", [False, True])
def test_counts_of_three_rows_in_one_number(monkeypatch, longest, bound):
    """Rectangles of a few rows, of one block and of two, sets of up to 254, 4094 and more members, copies, rare members."""
    for name, x in {"STRIP": 5, "WIDE": 16, "RARE": 20, "HEAVY": 400, "FIRST": 6, "SHARED": 4}.items():
        monkeypatch.setattr(similar, name, x)
    r = np.random.default_rng(3)
    words = np.minimum(longest - 1, (longest * r.random((120, longest)) ** 3).astype(int))
    sets = [np.unique(w[: r.integers(1, longest)]) for w in words]
    sets[40:50] = [np.arange(longest)] * 10
    tags = np.sort(r.integers(-1, 3, 70)), np.sort(r.integers(-1, 3, 50))

    def side(some, tag):
        return similar._Side(np.concatenate(some), np.array([len(x) for x in some]), tag)

    a, b = side(sets[:70], tags[0]), side(sets[70:], tags[1])
    own, across = (0.8, 0.95) if bound else (0.6, 0.75)
    for x, y, u, v in ((a, b, (sets[:70], tags[0]), (sets[70:], tags[1])), (a, a, (sets[:70], tags[0]), (sets[:70], tags[0]))):
        want = {}
        for i, (s, t) in enumerate(zip(*u)):
            for j, (z, w) in enumerate(zip(*v)):
                k = len(np.intersect1d(s, z))
                if (x is not y or i < j) and k >= 2 and similar._share(k, min(len(s), len(z))) >= (own if t == w >= 0 else across):
                    want[i, j] = k
        got = {}
        for k, c, counts, good in similar._alike(x, y, own, across, 2, bound):
            at = good if good.ndim == 1 else np.flatnonzero(good)
            got |= {(k + p // counts.shape[1], c + p % counts.shape[1]): int(counts.reshape(-1)[p]) for p in at.tolist()}
        assert got == want and len(want) > 40 and (good.ndim == 1) == bound


def test_pairs_leave_their_task_with_their_likeness(spark):
    """Pairs may be a share of all pairs: no number of theirs is rounded one by one."""
    df = spark.createDataFrame([("a", "same words", "s", "c"), ("b", "same word", "s", "c")], "id string, content string, subject string, category string")
    found = similar.category_pairs(df, "id", "content", "subject", "category", 0.6, 0.75)
    assert [tuple(r) for r in found.collect()] == [("a", "b", 1.0)]
    assert "round(" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_a_common_group_writes_no_pairs(spark):
    """Copies of one text and texts of common pairs: what the queue sends follows the rows."""
    df = spark.range(3000).selectExpr("concat('f', id) AS id", "'s' AS sid", "'q' AS subject", "'event' AS category", "'the same words again' AS content", "0 AS deleted", "0 AS merge_pending")
    assert facts.near_ids(df, 0.9).count() == 3000
    plan = facts.near_ids(df, 0.9)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate explode(grams" not in plan


def test_values_of_many_words_in_bounded_memory():
    r = random.Random(7)
    words = ["".join(r.choices("abcdefghij", k=8)) for _ in range(80_000)]
    machine = toxicity.Machine(np.arange(1000, 9000), np.linspace(-1, 1, 8000), 0.1, (1.0, 0.0))
    machine.words(words[:1])
    peaks = []
    for n in (20_000, 80_000):
        tracemalloc.start()
        got = machine.words(words[:n])
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert peaks[1] < 2 * peaks[0] and got[-3:] == machine.words(words[-3:])
