import hashlib
import random

import numpy as np

from quernlake.llm import edit_fingerprint as E


def plain(text):
    """The walk, step by step."""
    s, out, p, j = E.scale_of(len(text)), [], 0, 0
    while p < len(text):
        c = int(E.KIND[ord(text[p]) & 0xFFFF])
        if (j + 1) % (1 << s) == 0:
            out.append(c & 15)
        p += int(E.BITS[j % E.PERIOD, c])
        j += 1
    return s, out


def words(r, n):
    return " ".join("".join(r.choices("abcdefghij", k=r.randint(2, 8))) for _ in range(n))


def test_walk_same_as_plain():
    r = random.Random(1)
    docs = [words(r, n) for n in (1, 2, 5, 20, 60, 200, 900)] * 5 + ["", "x", "é😀" * 50, "a" * 5000]
    for text, (s, x) in zip(docs, E.walk(docs)):
        assert (s, x.tolist()) == plain(text)
        t, y = E.from_text(E.to_text((s, x)))
        assert t == s and (x == y).all()


def test_edit_distance_shows():
    r = random.Random(2)
    base = words(r, 800)
    few = base
    for _ in range(5):
        k = r.randrange(len(few))
        few = few[:k] + r.choice(["", "zz", "q"]) + few[k + 1 :]
    half = base[: len(base) // 2] + words(r, 400)
    a, b, c, d = E.walk([base, few, half, words(r, 800)])
    assert E.likeness(a, a) == 1 and E.likeness(a, b) > 0.75 > E.likeness(a, c) > 0.3 > 0.15 > E.likeness(a, d)


def test_next_and_edited(spark, monkeypatch):
    r = random.Random(3)
    rows = [(k * 7, words(r, r.randint(0, 60))) for k in range(90)] + [(631, None), (2, ""), (1000, "é😀x"), (None, "none"), (5000, words(r, 5000))]
    order = sorted(rows, key=lambda x: -(1 << 63) if x[0] is None else x[0], reverse=True)
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS part", "2 AS at").repartition(4)
    for group in (1 << 23, 900):
        monkeypatch.setattr(E, "GROUP_BYTES", group)
        monkeypatch.setattr(E, "RANGE_BYTES", 4 * group)
        got = {x.doc_id: x for x in E.with_next(df).collect()}
        assert len(got) == len(rows)
        for k, (i, t) in enumerate(order):
            t, f = t or "", order[(k + 1) % len(order)][1] or ""
            h = len(t) // 2
            edited = t[: len(t) - h] + f[:h]
            x = got[i]
            assert (x.n_chars, x.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
            fp = E.from_text(x.fingerprint)
            assert (fp[0], fp[1].tolist()) == plain(t)
            assert np.isclose(x.near_edited, E.likeness(fp, E.from_text(x.edited_fingerprint)))
            assert np.isclose(x.near_next, E.likeness(fp, E.walk([f])[0]))
    assert E.with_next(df.limit(0)).count() == 0
    one = E.with_next(spark.createDataFrame([(1, "abcd")], "doc_id long, text string")).collect()
    assert one[0].edited_sha256 == hashlib.sha256(b"abab").hexdigest() and one[0].near_next == 1


def test_equal_ids_and_repeated_rows(spark, monkeypatch):
    """A doc_id of most rows, no doc_id, repeated rows: each row is followed by one other, and ranges split such an id."""
    monkeypatch.setattr(E, "GROUP_BYTES", 300)
    monkeypatch.setattr(E, "RANGE_BYTES", 600)
    r = random.Random(9)
    rows = [(7, words(r, r.randint(1, 20))) for _ in range(60)] + [(None, words(r, 9)) for _ in range(20)] + [(9, "same text here")] * 3
    got = E.with_next(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted(str(x.doc_id) for x in got) == sorted(str(i) for i, _ in rows)
    n = {hashlib.sha256((a[: len(a) - len(a) // 2] + b[: len(a) // 2]).encode()).hexdigest() for _, a in rows for _, b in rows}
    assert all(x.edited_sha256 in n for x in got)
    assert sorted(x.fingerprint for x in got) == sorted(E.to_text(E.walk([t])[0]) for _, t in rows)
    nines = [x for x in got if x.doc_id == 9]
    assert sorted(x.near_next == 1 for x in nines) == [False, True, True]


def test_near_documents(spark):
    r = random.Random(5)
    base = [words(r, 300) for _ in range(20)]
    rows = [(k, t) for k, t in enumerate(base)] + [(100 + k, t[:900] + "Q" + t[900:]) for k, t in enumerate(base)] + [(200, base[0]), (None, base[1])]
    prints = E.fingerprint(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {(x.lead, x.doc_id) for x in E.near_documents(prints).collect()}
    assert got == {(k, 100 + k) for k in range(20)} | {(0, 200)}


def test_near_documents_finds_all_pairs(spark, monkeypatch):
    """Pairs that differ at the head, pairs near the threshold, and all pairs of a bucket, against brute force."""
    monkeypatch.setattr(E, "BLOCK", 4)
    r = random.Random(6)
    rows = []
    for k in range(12):
        base = words(r, 400)
        n = len(base)
        for part in (0.0, 0.1, 0.25, 0.35, 0.42):
            rows += [(len(rows), words(r, int(400 * part)) + base[int(n * part) :])]
        rows += [(len(rows), base[: int(n * 0.75)])]
    prints = {i: E.walk([t])[0] for i, t in rows}
    want = {(a, b): v for a in prints for b in prints if a < b and (v := E.likeness(prints[a], prints[b])) >= 0.5}
    got = {(x.lead, x.doc_id): x.likeness for x in E.near_documents(E.fingerprint(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    assert got.keys() <= want.keys() and all(np.isclose(v, want[p]) for p, v in got.items())
    assert len(want) > 40 and len(got) >= 0.97 * len(want)
