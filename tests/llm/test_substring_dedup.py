import hashlib
import random

import numpy as np
import pytest

from quernlake.llm import substring_dedup as S
from quernlake.llm._common import scratch


def brute(docs):
    first, out = {}, []
    words = [(i, (t or "").encode().split()) for i, t in docs]
    for i, w in words:
        for p in range(len(w) - 12 if i is not None else 0):
            k = tuple(w[p : p + 13])
            first[k] = min(first.get(k, i), i)
    for i, w in words:
        gone = [False] * len(w)
        for p in range(len(w) - 12 if i is not None else 0):
            if first[tuple(w[p : p + 13])] < i:
                gone[p : p + 13] = [True] * 13
        out.append((i, len(w), sum(gone), hashlib.sha256(b" ".join(x for x, y in zip(w, gone) if not y)).hexdigest()))
    return out


def corpus():
    r = random.Random(7)
    vocab = [f"w{k}" for k in range(300)]
    passages = [r.choices(vocab, k=n) for n in (13, 14, 30, 60)]
    docs = []
    for k in range(120):
        w = r.choices(vocab, k=r.randint(0, 80))
        for p in r.sample(passages, r.randint(0, 2)):
            at = r.randint(0, len(w))
            a = r.randint(0, 3)
            w[at:at] = p[a:] if r.random() < 0.5 else p
        docs.append((r.randrange(10**6), "\n ".join(w) if k % 3 else " ".join(w)))
    docs += [(5, docs[0][1]), (10**7, docs[0][1]), (10**7, docs[1][1]), (10**7, docs[1][1]), (8, None), (9, ""), (None, docs[2][1]), (3, "la " * 400), (4, "la " * 20), (11, "é\x0b" * 30)]
    return docs


@pytest.fixture(params=[(1 << 20, 1 << 20), (900, 700)])
def small(request, monkeypatch):
    monkeypatch.setattr(S, "CHUNK_BYTES", request.param[0])
    monkeypatch.setattr(S, "BUCKET_BYTES", request.param[1])


KEY = lambda r: tuple(map(str, r))


def test_same_as_brute_force(spark, small):
    docs = corpus()
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS chunk", "'x' AS kept").repartition(3)
    got = [tuple(r) for r in S.FingerprintIndex(spark, scratch(spark, "t")).add(df, digest=True).collect()]
    assert sorted(got, key=KEY) == sorted(brute(docs), key=KEY)
    for r in S.FingerprintIndex(spark, scratch(spark, "t")).add(df).collect():
        assert r.n_removed or r.kept == r.text


def test_batches_and_compaction(spark, monkeypatch):
    """No text of an earlier batch is given; ranges split as the index grows; compacted runs say the same."""
    monkeypatch.setattr(S, "CHUNK_BYTES", 2000)
    monkeypatch.setattr(S, "BUCKET_BYTES", 2000)
    docs = sorted((d for d in corpus() if d[0] is not None), key=lambda d: d[0])
    want = sorted(brute(docs), key=KEY)
    batches = [[d for d in docs if d[0] < 100_000], [d for d in docs if 100_000 <= d[0] < 600_000], [d for d in docs if d[0] >= 600_000]]
    for most in (1, 9):
        path, got, state, ranges = scratch(spark, "t"), [], None, []
        for b in batches:
            index = S.FingerprintIndex.load(spark, path, state) if state else S.FingerprintIndex(spark, path)
            got += [tuple(r) for r in index.add(spark.createDataFrame(b, "doc_id long, text string"), digest=True).collect()]
            index.compact(most)
            ranges.append(index._ranges())
            state = index.state()
        assert len(index.parts) == (1 if most == 1 else 3) and ranges == sorted(ranges) and ranges[0] < ranges[-1]
        assert sorted(got, key=KEY) == want


def test_second_batch_needs_no_history(spark):
    index = S.FingerprintIndex(spark, scratch(spark, "t"))
    text = " ".join(f"w{k}" for k in range(20))
    assert index.add(spark.createDataFrame([(1, text)], "doc_id long, text string")).first().n_removed == 0
    assert index.add(spark.createDataFrame([(2, text)], "doc_id long, text string")).first().n_removed == 20


def test_deduplicate_in_batches(spark, small):
    docs = corpus()
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS chunk", "'x' AS kept", "2 AS number", "3 AS N_WORDS").repartition(3)
    got = [tuple(r) for r in S.deduplicate(df, digest=True).collect()]
    assert sorted(got, key=KEY) == sorted(brute(docs), key=KEY)
    full = S.deduplicate(df)
    assert full.columns == ["doc_id", "text", "chunk", "number", "n_words", "n_removed", "kept"]
    rows = full.collect()
    assert len(rows) == len(docs) and all(r.n_removed or r.kept == r.text for r in rows)
    assert sorted(((r.doc_id, r.text) for r in rows), key=KEY) == sorted(docs, key=KEY)


def test_oracle_sql_says_the_same(spark, tmp_path):
    import duckdb

    docs = [d for d in corpus() if d[0] is not None]
    spark.createDataFrame(docs, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert sorted(con.sql(S.ORACLE).fetchall(), key=KEY) == sorted(brute(docs), key=KEY)


def test_words_that_fool_polynomial_hashes(spark):
    from .test_ngram_join import thue_morse

    x, y = thue_morse(2048, "a", "b")
    rest = " ".join(f"w{k}" for k in range(12))
    docs = [(1, f"{rest} {x}"), (2, f"{rest} {y}"), (3, f"{rest} {x}")]
    got = [tuple(r) for r in S.deduplicate(spark.createDataFrame(docs, "doc_id long, text string"), digest=True).collect()]
    assert sorted(got) == brute(docs) and [r[2] for r in sorted(got)] == [0, 0, 13]


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert S.FingerprintIndex(spark, scratch(spark, "t")).add(df).count() == 0 and S.deduplicate(df).count() == 0
    nulls = spark.createDataFrame([(None, None), (None, "a b")], "doc_id long, text string")
    assert S.deduplicate(nulls).count() == 2


def around_one_phrase(n):
    """``n`` documents of 20 words that share only a six-word run of a small hash; all their windows have one key."""
    words = lambda w: S.hashes(w)[0]
    phrases = [[f"p{k}x{j}".encode() for j in range(6)] for k in range(20_000)]
    phrase = min(phrases, key=lambda p: int(S.least_grams(words(p + [b"z"] * 7))[1][0]))
    phrase = [w.decode() for w in phrase]
    return [(k, " ".join([*(f"a{k}q{j}" for j in range(7)), *phrase, *(f"b{k}q{j}" for j in range(7))])) for k in range(n)]


def test_windows_around_one_phrase(spark, monkeypatch):
    """480,000 different windows under one key: none is taken for another, and the range that holds them is split."""
    monkeypatch.setattr(S, "BUCKET_BYTES", 1 << 18)
    monkeypatch.setattr(S, "CHUNK_BYTES", 1 << 17)
    monkeypatch.setattr(S, "HOT_WINDOWS", 1 << 14)
    docs = around_one_phrase(60_000)
    index = S.FingerprintIndex(spark, scratch(spark, "t"))
    df = spark.createDataFrame(docs + [(70_000, docs[9][1]), (-1, docs[10][1])], "doc_id long, text string").repartition(8)
    lost = {r.doc_id: r.n_removed for r in index.add(df, digest=True).where("n_removed > 0").collect()}
    assert lost == {70_000: 20, 10: 20}
    assert len(index.layout.hot) == 1 and max(index.layout.hot.values()) >= 16
    sizes = spark.read.parquet(index.parts[0][0]).where("kind = 2").selectExpr("bucket", "part", "length(v) / 8 AS n").groupBy("bucket", "part").sum("n").collect()
    assert max(r[2] for r in sizes) < 480_000 / 8
    later = index.add(spark.createDataFrame([(80_000, docs[5][1]), (80_001, docs[5][1].replace("a5q6", "new"))], "doc_id long, text string"), digest=True)
    assert {r.doc_id: r.n_removed for r in later.collect()} == {80_000: 20, 80_001: 13}
