import hashlib

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quernlake.llm.sentencepiece_codec import PieceCodec, encode_documents

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def codec():
    return PieceCodec(MODEL)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("  ab\n\t▁é中😀\x00.,!'1<>sthe"), max_size=30) | st.text(max_size=20).filter(lambda t: not any(0xD800 <= ord(c) < 0xE000 for c in t)))
def test_same_as_library(codec, text):
    ids = codec.lib.encode(text)
    assert codec.encode(text) == ids
    assert codec.run(text)[1] == codec.lib.decode(ids) == codec.decode(ids)


def test_long_units_use_the_heap(codec):
    for text in ("a" * 3000, "中文字符" * 300, " " * 100, "the" * 200):
        assert codec.encode(text) == codec.lib.encode(text)


def test_decoded_text_comes_from_the_ids():
    """A wrong id shows in the decoded text, and the check against the library finds it in the middle of a word too."""
    c = PieceCodec(MODEL, verify=False)
    c.words["cat"] = c.encode_word("dog")
    assert c.run("a cat")[1] == "a dog"
    d = PieceCodec(MODEL)
    agenda = d.agenda
    d.agenda = lambda u: list(u) if u == "中" * 4 else agenda(u)  # not what the scores say
    d.split = lambda w: [w[:-4], w[-4:]]
    d.run("xqz中文字符")
    d.place["er"] = 10**6  # a pair of the wrong rank in the middle of words
    d.split = lambda w: [w[:-5], w[-5:]] if w.endswith("other") else [w]
    d.agenda = lambda u: list(u) if u == "other" else agenda(u)
    with pytest.raises(RuntimeError):
        d.run("!!other")
    with pytest.raises(RuntimeError):
        c.check("a cat", *c.run("a cat"))


def test_rows(spark):
    rows = [(1, "Hello  wörld"), (2, None), (3, ""), (None, "x"), (1, "Hello  wörld"), (4, "long " * 40_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "1 AS n_tokens", "2 AS ids")
    got = encode_documents(docs, MODEL, keep_ids=True).collect()
    assert len(got) == len(rows)
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    for (i, text), r in zip(rows, got):
        ids = lib.encode(text or "")
        assert (r.doc_id, r.n_tokens, r.ids) == (i, len(ids), ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(lib.decode(ids).encode()).hexdigest()
    assert encode_documents(docs.limit(0), MODEL).count() == 0
