"""The columns, row counts and stated rules of each opN_ query, on whole tables and with odd rows."""

import hashlib
import zlib

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quernlake.llm.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_toxicity": "doc_id bigint, held_out boolean, score double, predicted int",
    "op2_sentencepiece": "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
    "op3_packing": "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint",
    "op4_url_filter": "page_id bigint, host string, path string, rule string, verdict string",
    "op5_sharding": "doc_id bigint, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int",
    "op6_nn_descent": "query_id bigint, rank int, vec_id bigint, score double",
    "op7_substring_dedup": "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string",
    "op8_edit_fingerprint": "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double",
    "op9_quality": "doc_id bigint, held_out boolean, score double, predicted int",
    "op11_hard_negatives": "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint",
    "op12_vector_codes": "vec_id bigint, code string, error bigint, label_error bigint, codebooks_sha256 string",
    "op13_token_files": "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint",
}
PER_DOCUMENT = ("op1_toxicity", "op2_sentencepiece", "op5_sharding", "op7_substring_dedup", "op8_edit_fingerprint", "op9_quality", "op13_token_files")


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """The given tables, with a null text, an empty one, one repeated under another id and some extra columns put in."""
    path = str(tmp_path_factory.mktemp("tables"))
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    again = docs.where("doc_id = 3").select("text").first()[0]
    odd = spark.createDataFrame([(900_001, None), (900_002, ""), (900_003, again), (900_004, None)], "doc_id long, text string")
    whole = docs.unionByName(odd, allowMissingColumns=True).withColumn("score", F.lit("x")).withColumn("SHARD", F.lit(1))
    whole.repartition(3).write.parquet(f"{path}/documents.parquet")
    for name in ("labels", "embeddings", "pages"):
        spark.read.parquet(f"{SF}/{name}.parquet").withColumn("rank", F.lit("y")).write.parquet(f"{path}/{name}.parquet")
    return path


@pytest.fixture(scope="module")
def results(spark, tables):
    held = {}

    def run(name):
        if name not in held:
            held[name] = QUERIES[name](spark, tables)
            held[name] = (dict(held[name].dtypes), held[name].collect())
        return held[name]

    return run


@pytest.fixture(scope="module")
def texts(spark, tables):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{tables}/documents.parquet").collect()}


def test_every_operator_is_registered():
    assert {int(n[2:].split("_")[0]) for n in QUERIES} == set(range(1, 14)) and set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", COLUMNS)
def test_columns(results, name):
    kinds, rows = results(name)
    want = dict(x.split(" ") for x in COLUMNS[name].split(", "))
    assert {c: kinds.get(c) for c in want} == want and rows


@pytest.mark.parametrize("name", PER_DOCUMENT)
def test_a_row_for_each_document(results, texts, name):
    assert sorted(r.doc_id for r in results(name)[1]) == sorted(texts)


@pytest.mark.parametrize("name, mod, out, cut", [("op1_toxicity", 5, 0, 0.5), ("op9_quality", 4, 2, 0.7)])
def test_classifiers(results, texts, name, mod, out, cut):
    by_text = {}
    for r in results(name)[1]:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % mod == out)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= cut)
        by_text.setdefault(texts[r.doc_id], set()).add(r.score)
    assert all(len(x) == 1 for x in by_text.values())  # null as empty, equal texts alike


def test_sentencepiece(results, texts):
    lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    for r in results("op2_sentencepiece")[1]:
        ids = lib.encode(texts[r.doc_id])
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(lib.decode(ids).encode()).hexdigest()


def test_packing(results, texts):
    lib, at, sequences = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), {}, {}
    ids = {i: [*lib.encode(x, add_special_tokens=False).ids, 2] for i, x in texts.items()}
    for r in sorted(results("op3_packing")[1], key=lambda r: (r.doc_id, r.start)):
        assert r.start == at.get(r.doc_id, 0) and r.doc_tokens == len(ids[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids[r.doc_id][r.start : r.start + r.length]))
        at[r.doc_id] = r.start + r.length
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert at == {i: len(x) for i, x in ids.items()}
    for pieces in sequences.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end <= 4096 and end & (end - 1) == 0


def test_sharding(results, texts):
    rows = results("op5_sharding")[1]
    slots = {}
    for r in rows:
        raw = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32) == (len(raw) + 1, zlib.crc32(raw)) and 0 <= r.shard < 8
        slots.setdefault(r.shard, []).append(r.slot)
    assert {r.law for r in rows} == {"rows"} and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1


def test_nearest(spark, results):
    import numpy as np

    vectors = spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").collect()
    ids, x = np.array([v.vec_id for v in vectors]), np.array([v.embedding for v in vectors], "float64")
    found, hit, n = {}, 0, 0
    for r in results("op6_nn_descent")[1]:
        found.setdefault(r.query_id, []).append(r)
    assert sorted(found) == [i for i in ids.tolist() if i % 20 == 0]
    for q, rows in found.items():
        rows.sort(key=lambda r: r["rank"])
        assert [r["rank"] for r in rows] == list(range(1, 21)) and q not in {r.vec_id for r in rows}
        assert [(-r.score, r.vec_id) for r in rows] == sorted((-r.score, r.vec_id) for r in rows)
        s = x @ x[ids == q][0]
        s[ids == q] = -9
        assert all(abs(s[ids == r.vec_id][0] - r.score) < 1e-12 for r in rows)
        hit += len({r.vec_id for r in rows} & set(ids[np.argsort(-s)[:20]].tolist()))
        n += 20
    assert hit / n >= 0.9


def test_edit_fingerprints(results, texts):
    order = sorted(texts, reverse=True)
    after = dict(zip(order, [*order[1:], order[0]]))
    prints = {r.doc_id: r.fingerprint for r in results("op8_edit_fingerprint")[1]}
    for r in results("op8_edit_fingerprint")[1]:
        text, other = texts[r.doc_id], texts[after[r.doc_id]]
        half = len(text) // 2
        edited = text[: len(text) - half] + other[:half]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert prints[3] == prints[900_003] and prints[900_001] == prints[900_002]
