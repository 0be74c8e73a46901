import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quernlake.llm import packing, sharding, url_filter

WORDS = public_tokenizers.path("word_bpe_49k.json")
SF = "/root/testdata/sf0.001"


def test_tokens_same_as_library():
    lib, mine = Tokenizer.from_file(WORDS), packing.WordTokens(WORDS)
    for text in ["", "  ", "Hello, World!!", "it's o'neil's.", "a\tb\x85c\n\nd", "Σίσυφος ΣΑΣ.", "é́. n̈!", "x<|endoftext|>y", "1234 567.", "中文。ok.", "don't.'s 'S'", "İstanbul, ß."]:
        assert mine(text) == np.array(lib.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), text


@pytest.fixture(scope="module")
def both():
    return Tokenizer.from_file(WORDS), packing.WordTokens(WORDS)


PARTS = ["\x01", " \x01 ", "\x01a", "é", "Ñ", "ª", "ŉ", "ﬁ", "יִ", "K", "ͅ", "<|endoftext|>", "<|startoftext|>", "<|", "|>", "İ", "ı", "ß", "Σ", "ΑΣ", "\u0301", "\u0307", "\u0338", "'", "'s", "'LL", "’", "=", "!", ".", "-", "A", "b", "the", "9", "²", "中", "😀", "\u200d", " ", "\n", "\t", "\x85", "\u00a0", "\x00"]


@settings(max_examples=3000, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=9).map("".join) | st.text(max_size=12).filter(lambda t: not any(0xD800 <= ord(c) < 0xE000 for c in t)))
def test_ids_are_the_librarys(both, text):
    """Special tokens, letters that change when lower-cased, marks and apostrophes beside punctuation."""
    lib, mine = both
    assert np.frombuffer(mine(text), "<u4").tolist() == lib.encode(text, add_special_tokens=False).ids


def test_special_tokens_and_dotted_capital(both):
    lib, mine = both
    for text in ["hello <|endoftext|> x", "İ!", "<|startoftext|>", "a <|endoftext|>.", "<|endoftext|", "İ'S.", "A<|endoftext|>B!"]:
        assert np.frombuffer(mine(text), "<u4").tolist() == lib.encode(text, add_special_tokens=False).ids, text


def check_pieces(rows, docs):
    lib = Tokenizer.from_file(WORDS)
    of, seqs = defaultdict(list), defaultdict(list)
    for r in rows:
        of[r.doc_id].append(r)
        seqs[r.sequence_id].append(r)
    for doc_id, text in docs:
        ids = lib.encode(text or "", add_special_tokens=False).ids + [2]
        at = 0
        for r in sorted(of[doc_id], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            assert r.ids == ids[at : at + r.length]
            at += r.length
        assert at == len(ids)
    for pieces in seqs.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= 4096 and at & (at - 1) == 0 and {r.tier for r in pieces} == {at}


def test_packing(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()] + [(1000, None), (1001, ""), (1002, "Long words. " * 30_000)]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS length", "'x' AS ids").repartition(3)
    rows = packing.pack_documents(df, WORDS, keep_ids=True, block_tokens=1 << 15).collect()
    check_pieces(rows, docs)
    assert packing.pack_documents(df.limit(0), WORDS).count() == 0
    load = Counter()
    for r in {(r.step_group, r.sequence_id, r.tier) for r in rows}:
        load[r[0]] += r[2]
    assert max(load.values()) <= 32_768


def test_packing_odd_rows(spark):
    rows = [(None, "a b c"), (None, None), (7, "same text"), (7, "same text"), (7, "another"), (8, "")]
    got = packing.pack_documents(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), WORDS).collect()
    lib, total = Tokenizer.from_file(WORDS), Counter()
    for r in got:
        total[r.doc_id] += r.length
    want = Counter()
    for i, text in rows:
        want[i] += len(lib.encode(text or "", add_special_tokens=False).ids) + 1
    assert total == want


def test_matrix_has_exact_sums():
    counts, sizes = [5, 0, 9, 1, 40], np.array([11, 11, 11, 11, 11])
    m = np.array([sharding.matrix_row(counts, sizes, k, 3) for k in range(5)])
    assert m.sum(1).tolist() == counts and m.sum(0).tolist() == sizes.tolist() and (m >= 0).all()


def test_draws_are_exact():
    """Against the exact law at small sizes (chi-square), against exact moments at large ones."""
    from math import comb

    rng = np.random.default_rng(2)
    for good, bad, n in ((60, 90, 70), (200, 40, 100), (45, 45, 45)):
        hits = Counter(sharding.hypergeometric(rng, good, bad, n) for _ in range(20_000))
        law = {k: comb(good, k) * comb(bad, n - k) / comb(good + bad, n) for k in range(max(0, n - bad), min(n, good) + 1)}
        assert set(hits) <= set(law)
        big = [k for k in law if law[k] * 20_000 >= 5]
        chi = sum((hits[k] - 20_000 * law[k]) ** 2 / (20_000 * law[k]) for k in big)
        assert chi < len(big) + 5 * (2 * len(big)) ** 0.5
    for good, bad, n in ((3 * 10**9, 10**10, 2 * 10**9), (10**13, 4 * 10**13, 10**13), (5, 10**14, 10**13)):
        x = np.array([sharding.hypergeometric(rng, good, bad, n) for _ in range(2000)], float)
        total = good + bad
        mean, var = n * good / total, n * good / total * bad / total * (total - n) / (total - 1)
        assert abs(x.mean() - mean) < 5 * (var / 2000) ** 0.5 and 0.85 < x.var() / var < 1.15


def test_sharding_query(spark):
    """The query's contract, on a whole table and on odd rows."""
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = sharding.op5_sharding(spark, SF)
    assert [f"{f.name} {f.dataType.simpleString()}" for f in got.schema.fields] == ["doc_id bigint", "size bigint", "text_crc32 bigint", "law string", "shard int", "slot bigint", "grown_shard int"]
    rows = got.collect()
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in docs)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == want and {(r.law, r.grown_shard) for r in rows} == {("rows", None)}
    per = defaultdict(list)
    for r in rows:
        per[r.shard].append(r.slot)
    assert set(per) == set(range(8)) and max(map(len, per.values())) - min(map(len, per.values())) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in per.values())


def test_sharding_clashing_names_and_long_texts(spark):
    rows = [(k, "y" * (2_000_000 if k == 3 else 1)) for k in range(30)]
    df = spark.createDataFrame(rows, "_id long, text string").selectExpr("*", "'a' AS _target", "'b' AS _part", "'c' AS _rank", "'d' AS number", "'e' AS Part", "'f' AS target", "'g' AS rank", "'h' AS SHARD")
    got = sharding.shuffle_into_shards(df.drop("SHARD"), 4).collect()
    assert Counter((r._id, r.text) for r in got) == Counter(rows) and {(r._target, r.number, r.Part, r["rank"]) for r in got} == {("a", "d", "e", "g")}
    assert len(sharding.shuffle_into_shards(df, 4).collect()) == 30


def test_sharding(spark):
    rows = [(i % 7 if i % 5 else None, "t" * (i % 3)) for i in range(1003)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "9 AS slot").repartition(5)
    got = sharding.shuffle_into_shards(df, 8, least_rows=20).collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter(rows)
    per = defaultdict(list)
    for r in got:
        per[r.shard].append(r.slot)
    assert sorted(map(len, per.values())) == [125] * 5 + [126] * 3
    assert all(sorted(v) == list(range(len(v))) for v in per.values())
    assert sharding.shuffle_into_shards(df.limit(0), 8).count() == 0
    few = sharding.shuffle_into_shards(df.limit(3), 8).collect()
    assert sorted((r.shard, r.slot) for r in few) == [(0, 0), (1, 0), (2, 0)]


def test_shuffle_is_uniform(spark):
    df = spark.range(0, 400, 1, 4)
    hits = Counter()
    for seed in range(30):
        hits.update(r.shard for r in sharding.shuffle_into_shards(df, 4, seed=seed).where("id < 10").collect())
    assert all(45 <= hits[s] <= 105 for s in range(4))


URLS = [None, "", "no scheme", "http://ORG", "http://org/", "https://a.Example.ORG/es/x?q", "https://example.org/en/12#f", "https://notexample.org/es/", "ftp://x.com/fr/", "ftp://x.com/de/?", "http://com/de", "http://x.net/a/b", "http://x.com?y://z/fr/", "http://é.org//", "http://org./x", "x" * 100_000 + "://a.org/" + "p" * 100_000]


def test_urls(spark):
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR)")
    rows = [(i, u) for i, u in enumerate(URLS)] + [(None, "http://a.org/"), (1, "")]
    con.executemany("INSERT INTO pages VALUES (?, ?)", rows)
    want = con.sql(url_filter.ORACLE).fetchall()
    pages = spark.createDataFrame(rows, "page_id long, url string").selectExpr("*", "'h' AS host", "1 AS rule")
    rules = spark.createDataFrame(url_filter.RULES, "host string, path string, verdict string")
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, url_filter.judge_urls(pages, rules).collect()), key=key) == sorted(want, key=key)
    assert {r.verdict for r in url_filter.judge_urls(pages, rules.limit(0), default="block").collect()} == {"block"}
    assert url_filter.judge_urls(pages.limit(0), rules).count() == 0


def test_many_listed_urls(spark, monkeypatch):
    """Whole URLs of many hosts and lengths; a filter with false hits; a list that isn't broadcast."""
    import random

    r = random.Random(1)
    listed = {(f"h{r.randrange(300)}.com", "/" + "p" * r.randrange(200)): "block" for _ in range(3000)} | {("com", "/q"): "allow"}
    urls = [(k, f"http://www.h{r.randrange(400)}.com/" + "p" * r.randrange(220) + r.choice(["", "q", "?x"])) for k in range(1500)] + [(2000, "http://x.com/qq"), (2001, None)]

    def plain(url):
        rest = url.split("://", 1)[1] if url else ""
        host = rest.split("/")[0]
        path = rest[len(host) :].split("?")[0]
        fits = [(len(h) + len(p), len(h), h + p, v) for (h, p), v in listed.items() if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return max(fits)[2:] if fits else (None, "allow")

    entries = spark.createDataFrame([(h, p, v) for (h, p), v in listed.items()], "host string, path string, verdict string")
    pages = spark.createDataFrame(urls, "page_id long, url string").selectExpr("*", "1 AS row", "2 AS hits", "3 AS keys", "4 AS cuts")
    want = {k: plain(u) for k, u in urls}
    for most, limit in ((1 << 17, 1 << 20), (3, 0)):
        monkeypatch.setattr(url_filter, "MOST_BLOCKS", most)
        monkeypatch.setattr(url_filter, "BROADCAST_BYTES", limit)
        got = {x.page_id: (x.rule, x.verdict) for x in url_filter.judge_urls(pages, entries).collect()}
        assert got == want


def test_url_query_runs_no_python(spark):
    plan = url_filter.op4_url_filter(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "RDD" not in plan.replace("ExistingRDD", "RDD")
