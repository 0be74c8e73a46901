import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quernlake.llm import token_files as t
from quernlake.llm._common import scratch

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def both():
    return Tokenizer.from_file(PATH), t.ByteTokens(PATH)


PARTS = ["\x01", "é", "Ñ", "ª", "ﬁ", "<|endoftext|>", "<|", "|>", "İ", "Σ", "́", "'", "'s", "'LL", "'ll", "’", "=", "!", ".", "-", "A", "b", "the", "9", "²", "中", "😀", "‍", " ", " ", "\n", "\t", "\x85", " ", "\x00", "\x1c", "\x1f", " ", "　", "​", "᠎", "\r", " ", "_", " the"]


@settings(max_examples=3000, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PARTS), max_size=9).map("".join) | st.text(max_size=12).filter(lambda x: not any(0xD800 <= ord(c) < 0xE000 for c in x)), max_size=3))
def test_ids_are_the_librarys(both, texts):
    lib, mine = both
    want = [lib.encode(x, add_special_tokens=False).ids for x in texts]
    assert [np.frombuffer(x, "<u2").tolist() for x in mine.many(pa.array(texts, pa.string()))] == want
    assert [np.frombuffer(mine(x), "<u2").tolist() for x in texts] == want


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1) | st.integers(0, 50), max_size=1500), st.integers(0, 10**6))
def test_elias_fano(numbers, more):
    v = np.array(sorted(numbers), "uint64")
    packed = t.EliasFano.pack(v, min(2**64 - 1, int(v[-1]) + more) if len(v) else more)
    e = t.EliasFano(memoryview(packed + b"xyz"))
    assert e.size == len(packed) and e.all().tolist() == v.tolist() and [e[k] for k in range(len(v))] == v.tolist()


def test_elias_fano_takes_little_space():
    ends = np.cumsum(np.random.default_rng(1).integers(1, 2000, 100_000)).astype("uint64")
    assert 8 * len(t.EliasFano.pack(ends, int(ends[-1]))) < 100_000 * (2 + np.log2(1000) + 0.6)


def test_one_file_by_select():
    docs = [(3, b"\x05\x00"), (3, b"\x06\x00\x07\x00"), (9, b"\x08\x00" * 700), (2**62, b"\x01\x00"), (None, b"\x02\x00")]
    f = t.TokenFile(t.TokenFile.pack([d for d, _ in docs], [b for _, b in docs], 2, 4, 77))
    assert (f.range, f.start, f.docs, f.nameless, f.tokens) == (4, 77, 5, 1, 705)
    assert [f.doc_id(k) for k in range(5)] == [d for d, _ in docs]
    assert [f.document(k).tobytes() for k in range(5)] == [b for _, b in docs]
    assert [f.find(x) for x in (3, 9, 2**62, 4, 2**63)] == [0, 2, 3, None, None]
    with pytest.raises(ValueError, match="not a file"):
        t.TokenFile(b"x" * 100)


def by_hand(docs):
    lib, at, out = Tokenizer.from_file(PATH), 0, {}
    for doc_id, text in docs:
        ids = lib.encode(text or "", add_special_tokens=False).ids + [0]
        out[doc_id] = (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    return out


@pytest.mark.parametrize("size", [(4096, 1 << 22, 1 << 18), (7, 300, 5)])
def test_query_reads_back_what_it_wrote(spark, monkeypatch, size):
    for name, n in zip(("RANGE_ROWS", "FILE_TOKENS", "FILE_DOCS"), size):
        monkeypatch.setattr(t, name, n)
    sf = "/root/testdata/sf0.001"
    rows = t.op13_token_files(spark, sf)
    assert rows.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and [x for _, x in rows.dtypes] == ["bigint"] * 4
    docs = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").select("doc_id", "text").collect()
    assert {r[0]: tuple(r)[1:] for r in rows.collect()} == by_hand(docs)


def test_odd_rows(spark, monkeypatch):
    """Null ids come last, whatever their number; equal ids stand together; repeated rows each count; texts of any length."""
    monkeypatch.setattr(t, "RANGE_ROWS", 8)
    r = random.Random(5)
    docs = [(None, f"none {k}") for k in range(40)] + [(7, f"seven {k}") for k in range(40)] + [(7, "same")] * 9 + [(-5, None), (-4, ""), (10**12, "x" * 200_000), (11, "a\n\n  b <|endoftext|>")]
    r.shuffle(docs)
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS range", "'x' AS body").repartition(5)
    files = t.TokenFiles.write(df, scratch(spark, "tokens"), PATH)
    rows = sorted(files.documents(keep_ids=True).collect(), key=lambda x: x.start)
    assert [r.start for r in rows] == [0, *np.cumsum([r.n_tokens for r in rows])[:-1]]
    names = [r.doc_id for r in rows]
    assert names == sorted([d for d, _ in docs if d is not None]) + [None] * 40
    lib = Tokenizer.from_file(PATH)
    assert sorted((str(r.doc_id), list(r.ids)) for r in rows) == sorted((str(d), lib.encode(x or "", add_special_tokens=False).ids + [0]) for d, x in docs)
    assert files.locate(rows[-1].start) == len(files.starts) - 2 or files.starts[files.locate(rows[-1].start)] <= rows[-1].start
    again = t.TokenFiles.write(df, scratch(spark, "tokens"), PATH).documents()
    assert sorted(map(str, again.collect())) == sorted(map(str, files.documents().collect()))


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert t.TokenFiles.write(empty, scratch(spark, "tokens"), PATH).documents().count() == 0


def test_random_access_through_files(spark):
    files = t.TokenFiles.write(spark.range(300).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text")), scratch(spark, "tokens"), PATH)
    lib, raw = Tokenizer.from_file(PATH), spark.read.format("binaryFile").option("pathGlobFilter", "ids-*").load(files.path).select("content").collect()
    for part in map(t.TokenFile, [r[0] for r in raw]):
        at = part.find(123)
        if at is not None:
            assert part.document(at).tolist() == lib.encode("text 123", add_special_tokens=False).ids + [0]


def test_few_units_go_to_the_library_at_once(monkeypatch):
    """Its encodings are large, so that all new words of a batch at once would take hundreds of MB of a worker."""
    monkeypatch.setattr(t, "AT_ONCE", 50)
    tokens, r = t.ByteTokens(PATH), random.Random(9)
    texts = [" ".join(f"{r.choice(['w', 'É', '中', '(', 'a!b'])}{r.randrange(10**6)}{r.choice(['', '.', '  x', chr(10)])}" for _ in range(60)) for _ in range(40)]
    sizes, encode = [], tokens._bytes
    monkeypatch.setattr(tokens, "_bytes", lambda units: sizes.append(sum(u.count("\n") + 1 for u in units)) or encode(units))
    want = [e.ids for e in tokens.lib.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(x, "<u2").tolist() for x in tokens.many(pa.array(texts, pa.string()))] == want
    assert len(sizes) > 40 and max(sizes) <= 100
