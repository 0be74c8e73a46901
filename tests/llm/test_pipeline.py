"""Each stage against what its operator, itself held against brute force, says of the stage's input."""

from collections import Counter

import corpus_pipeline as P
from quernlake.llm._common import scratch, table
from quernlake.llm.ngram_join import jaccard_classes
from quernlake.llm.quality import score_quality, train_quality
from quernlake.llm.toxicity import score_toxicity, train_toxicity

from .test_packing_sharding_urls import check_pieces  # noqa: F401
from .test_substring_dedup import brute

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, SF, "documents")
    labels = table(spark, SF, "labels")
    stages = dict(P.STAGES)

    def done(name, docs):
        path = scratch(spark, name)
        stages[name](spark, docs, SF).write.parquet(path)
        out = spark.read.parquet(path)
        if name != "packing":
            assert out.columns == docs.columns
        return out

    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    one = done("toxicity", docs)
    assert ids(one) == ids(score_toxicity(docs, train_toxicity(docs, labels)).where("predicted = 0"))
    two = done("quality", one)
    assert ids(two) == ids(score_quality(one, train_quality(one, labels)).where("predicted = 1"))
    three = done("near_duplicates", two)
    assert ids(three) == ids(jaccard_classes(two).where("doc_id = class_id"))
    four = done("substring_dedup", three)
    before, after = {r.doc_id: r.text for r in three.collect()}, {r.doc_id: r for r in four.collect()}
    for i, n, removed, _ in brute(list(before.items())):
        assert len(after[i].text.split()) == n - removed and after[i].n_chars == len(after[i].text)
        assert removed or after[i].text == before[i]
    five = done("packing", four)
    total = Counter()
    for r in five.collect():
        total[r.doc_id] += r.length
    assert sorted(total) == ids(four)
    key = lambda r: tuple(r)[:5]
    assert sorted(map(key, P.run(spark, SF).collect())) == sorted(map(key, five.collect()))


def test_empty_tables(spark):
    docs = table(spark, SF, "documents").limit(0)
    for _, stage in P.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0
        docs = table(spark, SF, "documents").limit(0)


def test_nulls(spark):
    rows = [(None, None, None, None, None), (1, None, "en", "s", 3), (2, "", None, None, None), (2, "", None, None, None), (3, "The quick brown fox went over there. " * 3, "en", "s", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in P.STAGES:
        assert stage(spark, docs, SF).count() >= 0, name


def test_columns_named_like_the_operators_own(spark):
    rows = [(k, " ".join(f"w{j}" for j in range(30)) + f" e{k}" * (k % 2), "a", 1, 2, "b", 3, "c") for k in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string, n_words int, n_removed int, kept_sha256 string, chunk int, number string")
    for name, stage in P.STAGES[:-1]:
        got = stage(spark, docs, SF)
        assert got.columns == docs.columns, name
        assert {tuple(r)[2:] for r in got.collect()} <= {("a", 1, 2, "b", 3, "c")}, name
    assert dict(P.STAGES)["packing"](spark, docs, SF).count() > 0


def test_packing_gives_token_ids(spark):
    docs = spark.createDataFrame([(3, "The quick brown fox went over there.", "en", "s", 36)], "doc_id long, text string, lang string, source string, n_chars long")
    got = dict(P.STAGES)["packing"](spark, docs, SF).collect()
    assert got and all(len(r.ids) == r.length for r in got)
