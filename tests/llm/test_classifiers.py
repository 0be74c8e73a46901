import zlib

import numpy as np

from quernlake.llm import quality, toxicity
from quernlake.llm._common import table

SF = "/root/testdata/sf0.01"
BAD = ["idiot", "stupid", "moron", "clown", "loser"]


def rows(n=300):
    rng = np.random.default_rng(0)
    plain = ["the", "station", "wandering", "of", "leaves", "another", "bright", "morning", "river", "stones"]
    out = []
    for k in range(n):
        words = list(rng.choice(plain, 30))
        if k % 3 == 0:
            words[int(rng.integers(30))] = BAD[k // 3 % 5]
        out.append((" ".join(words), int(k % 3 == 0)))
    return out


def test_kernel_is_the_gap_weighted_sum():
    """Brute force over all choices of four places."""
    from itertools import combinations

    word = "abcxadb"
    c, starts = toxicity.codes([word])
    got = {}
    for at, t, weight in toxicity.subsequences(c, starts):
        for i in t[t > 0].tolist():
            got[i] = got.get(i, 0) + weight
    want = {}
    letters = [toxicity.START] + [ord(x) - 96 for x in word]
    for p in combinations(range(len(letters)), 4):
        if p[3] - p[0] <= toxicity.SPAN:
            n = sum(letters[q] << s for q, s in zip(p, (15, 10, 5, 0)))
            want[n] = want.get(n, 0) + toxicity.DECAY ** (p[3] - p[0] + 1)
    assert {k: round(v, 9) for k, v in got.items()} == {(k): round(v, 9) for k, v in want.items()}


def test_gapped_insults():
    machine = toxicity.learn(rows(), landmarks=32)
    p = lambda t: float(machine.probability(toxicity.margins(machine, t.encode(), [t]))[0])
    assert all(p(f"the {w} of stones") >= 0.5 for w in BAD)
    assert p("the stu-pid river") >= 0.5 and p("an s t u p i d morning") >= 0.5 and p("a stuuuupid one") >= 0.5
    assert p("bright morning of another station") < 0.5 and p("") < 0.5


def test_marks_after_every_letter():
    machine = toxicity.learn(rows(), landmarks=32)
    p = lambda t: float(machine.probability(toxicity.margins(machine, t.encode(), [t]))[0])
    for w in BAD:
        for mark in (".", "-", "--", "*.", "---", "-.-"):
            assert p(f"the {mark.join(w)} of stones") >= 0.5, mark.join(w)
    assert p("bright mor-ning of a-n-o-t-h-e-r sta--tion") < 0.5 and p("... --- !!!") < 0.5


def test_insults_written_to_slip_through():
    """Marks, spaces and letters put in, learned from the driver's labelled sentences; clean words that look alike stay clean."""
    import duckdb

    found = duckdb.sql(f"SELECT d.doc_id, coalesce(text, ''), toxic FROM '{SF}/documents.parquet' d JOIN '{SF}/labels.parquet' l USING (doc_id) WHERE toxic IS NOT NULL ORDER BY 1").fetchall()
    machine = toxicity.learn([(t, y) for i, t, y in found if zlib.crc32(str(i).encode()) % 5])
    p = lambda w: float(machine.probability(toxicity.margins(machine, b"k", [f"the {w} of leaves"]))[0])
    for w in ("s-t-u-p-i-d", "i.d.i.o.t", "c*l*o*w*n", "w-o-r-t-h-l-e-s-s", "stuxpid", "idixot", "cloxwn", "morxon", "worxthless", "stu pid", "id iot", "st*upid", "1d10t"):
        assert p(w) >= 0.5, w
    for w in ("station", "another", "cloud", "crown", "moorland", "idiom", "stupendous", "worthy", "clover", "student", "clone", "studio", "worth less"):
        assert p(w) < 0.5, w


def test_toxicity_held_out(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    machine = toxicity.train_toxicity(docs, labels)
    got = toxicity.score_toxicity(docs, machine).join(labels, "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.toxic for r in got) >= 0.93 * len(got)
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in got)
    odd = spark.createDataFrame([(None, "x"), (1, None), (1, ""), (2, "ok " * 60_000)], "doc_id long, text string").selectExpr("*", "0.1 AS score")
    rows = toxicity.score_toxicity(odd, machine).collect()
    assert len(rows) == 4 and all(0 <= r.score <= 1 for r in rows)
    empty = toxicity.train_toxicity(docs.limit(0), labels.limit(0))
    assert toxicity.score_toxicity(docs.limit(0), empty).count() == 0


def test_quality_held_out(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    forest = quality.train_quality(docs, labels)
    got = quality.score_quality(docs, forest).join(labels, "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.quality for r in got) >= 0.93 * len(got)
    odd = spark.createDataFrame([(None, "x"), (1, None), (1, ""), (2, "ok " * 60_000)], "doc_id long, text string").selectExpr("*", "0.1 AS score")
    assert len(quality.score_quality(odd, forest).collect()) == 4
    assert quality.score_quality(docs.limit(0), quality.train_quality(docs.limit(0), labels.limit(0))).count() == 0


def test_trees_match_a_plain_walk():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(500, 5))
    y = (x[:, 0] * x[:, 1] > 0).astype(float)
    forest = quality.grow(x, y, trees=20, depth=3)
    for r in range(20):
        total = forest.base
        for t in range(20):
            k = 0
            while k < 7:
                k = 2 * k + 1 + int(x[r, forest.feature[t, k]] > forest.cut[t, k])
            total += forest.leaf[t, k - 7]
        assert np.isclose(total, forest.margin(x[r : r + 1])[0])
    assert ((forest.score(x) > 0.5) == y).mean() > 0.9
