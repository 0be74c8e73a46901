import random
from collections import Counter

import numpy as np

from quernlake.llm import ngram_join as J


def brute(docs):
    sets = []
    for _, text in docs:
        w = (text or "").split()
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    n = len(docs)
    links, texts, parent = [0] * n, [set() for _ in range(n)], list(range(n))

    def top(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in range(n):
        for b in range(a):
            i = len(sets[a] & sets[b])
            if i and 5 * i >= 4 * len(sets[a] | sets[b]):
                links[a] += 1
                links[b] += 1
                if (x := docs[a][1].split()) != (y := docs[b][1].split()):
                    texts[a].add(tuple(y))
                    texts[b].add(tuple(x))
                parent[top(a)] = top(b)
    least = {}
    for k in range(n):
        least[top(k)] = min(least.get(top(k), docs[k][0]), docs[k][0])
    return {docs[k][0]: (least[top(k)], links[k], len(texts[k])) for k in range(n)}


def corpus():
    r = random.Random(4)
    vocab = [f"w{k}" for k in range(400)]
    docs = []
    for g in range(12):
        base = r.choices(vocab, k=r.randint(6, 120))
        for c in range(r.randint(1, 9)):
            w = list(base)
            for _ in range(r.randint(0, 3)):
                w[r.randrange(len(w))] = r.choice(vocab)
            docs.append(" ".join(w))
    base = r.choices(vocab, k=100)
    for c in range(40):  # a large group of near copies
        w = list(base)
        w[r.randrange(100)] = f"x{c}"
        docs.append(" ".join(w))
    docs += ["", None, "a b", "a b", "a b c", "one", docs[0], docs[0], "rep rep rep rep rep rep rep", "rep rep rep rep rep rep"]
    return list(enumerate(docs))


def test_same_as_brute_force(spark, monkeypatch):
    docs = corpus()
    want = brute(docs)
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS n", "2 AS node").repartition(3)
    got = {r.doc_id: (r.class_id, r.n_links, r.n_text_links) for r in J.jaccard_classes(df).collect()}
    assert got == want
    got = {r.doc_id: (r.class_id, r.n_links, r.n_text_links) for r in J.jaccard_classes(df, exact=True).collect()}
    assert got == want
    monkeypatch.setattr(J, "BLOCK", 500)
    got = {r.doc_id: (r.class_id, r.n_links, r.n_text_links) for r in J.jaccard_classes(df).collect()}
    assert got == want


def test_oracle_sql_says_the_same(spark, tmp_path):
    import duckdb

    docs = corpus()
    spark.createDataFrame(docs, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert {r[0]: r[1:] for r in con.sql(J.ORACLE).fetchall()} == brute(docs)


def test_odd_rows(spark):
    t = "one two three four five six seven"
    df = spark.createDataFrame([(None, t), (3, t), (3, t), (None, "x"), (4, "long words " * 50_000)], "doc_id long, text string")
    got = Counter((r.doc_id, r.class_id, r.n_links) for r in J.jaccard_classes(df).collect())
    assert got == {(None, 3, 2): 1, (3, 3, 2): 2, (None, None, 0): 1, (4, 4, 0): 1}
    assert J.jaccard_classes(df.limit(0)).count() == 0


def test_pruning_keeps_true_pairs():
    rng = np.random.default_rng(0)
    for n, least in J.LEAST:
        assert (rng.binomial(n, 0.8, 100_000) >= least).all()


def thue_morse(n, a, b):
    """Two words that any polynomial in two's powers takes for one."""
    bits = [bin(k).count("1") % 2 for k in range(n)]
    return "".join(a if x else b for x in bits), "".join(b if x else a for x in bits)


def test_words_that_fool_polynomial_hashes(spark):
    x, y = thue_morse(2048, "a", "b")
    text = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen "
    df = spark.createDataFrame([(1, x), (2, y), (3, x + " z"), (4, text * 2 + x), (5, text * 2 + y)], "doc_id long, text string")
    got = {r.doc_id: (r.class_id, r.n_links, r.n_text_links) for r in J.jaccard_classes(df).collect()}
    assert got == brute([(r.doc_id, r.text) for r in df.collect()])
    assert got[1] == (1, 0, 0) and got[2] == (2, 0, 0)


def test_words_are_compared_where_hashes_agree(monkeypatch):
    """With a hash of eight values, sets are still those of the words."""
    monkeypatch.setattr(J, "runs", lambda h, n: J_runs(h, n) % np.uint64(8))
    docs = [t.encode().split() for t in ("a b c d e f g", "h i j k l m n", "a b c d e f g h", "a b c d e f g", "a b", "a b c", "b a")]
    rows, _ = J.word_sets(docs)
    for i, a in enumerate(docs):
        for j, b in enumerate(docs):
            s, t = ({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for w in (a, b))
            assert len(np.intersect1d(rows[i], rows[j])) == len(s & t) and len(rows[i]) == len(s)


J_runs = J.runs


def test_keep_one_names_rows_not_ids(spark):
    t = "one two three four five six seven"
    rows = [(3, t, 1), (3, "quite another text of some words", 2), (5, t, 3), (None, t, 4), (None, "alone here", 5), (7, "", 6), (7, None, 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, number int").coalesce(1)
    assert sorted(r.number for r in J.keep_one(df).collect()) == [1, 2, 5, 6, 7]
    assert J.keep_one(df).columns == df.columns and J.keep_one(df.limit(0)).count() == 0
