import hashlib
import math
import random

import numpy as np
import pytest

from quernlake.llm import hard_negatives as h
from quernlake.llm import vector_codes as v

NAN, INF = float("nan"), float("inf")


def finite(x):
    return x is not None and all(c is not None and math.isfinite(c) for c in x)


def negatives_by_hand(rows, every=10, n_pos=3, n_neg=4):
    good = [(i, y, [math.floor(256 * c) for c in x]) for i, y, x in rows if i is not None and y is not None and finite(x) and len(x) == 6]
    anchors, out = {}, []
    for i, y, q in sorted(r for r in good if r[0] % every == 0):
        anchors.setdefault(i, (y, q))
    for a, (y, q) in anchors.items():
        scored = sorted((-sum(b * c for b, c in zip(q, x)), i, z) for i, z, x in good if i != a)
        for s, i, _ in [r for r in scored if r[2] == y][:n_pos]:
            fits = [r for r in scored if r[2] != y and 30 * -s <= 100 * -r[0] <= 90 * -s][:n_neg]
            out += [(a, i, k, j, -s, -t) for k, (t, j, _) in enumerate(fits, 1)]
    return sorted(out)


def vectors(n, seed, spread=1.0):
    r = random.Random(seed)
    return [(k, r.choice([0, 1, 1, 2]), [r.gauss(0, spread) for _ in range(6)]) for k in range(n)]


ODD = [(1000, None, [1.0] * 6), (1010, 1, None), (1020, 1, [1.0] * 5 + [None]), (1030, 1, [NAN] * 6), (1040, 2, [INF] * 6), (1050, 0, [1.0] * 3), (None, 1, [1.0] * 6), (1060, 1, [0.0] * 6), (1070, 1, [])]


def run(spark, rows, **more):
    df = spark.createDataFrame([(*r, 5) for r in rows], "vec_id long, label int, embedding array<double>, score int").repartition(4)
    return sorted(tuple(r) for r in h.hard_negatives(df, every=10, positives=3, negatives=4, **more).collect())


@pytest.mark.parametrize("size", [(4096, 1024, 512), (16, 4, 5)])
def test_negatives_as_by_hand(spark, monkeypatch, size):
    """In blocks of any size; ties, repeated rows, one vector in a third of all rows, rows that take no part."""
    for name, n in zip(("ROWS", "ANCHORS", "STEP"), size):
        monkeypatch.setattr(h, name, n)
    rows = vectors(150, 1) + [(k, k % 3, [0.5, 0.25, 0.0, 0.0, -0.5, 1.0]) for k in range(300, 380)] + vectors(25, 1)[5:] + ODD
    assert run(spark, rows) == negatives_by_hand(rows)


def test_few_rows(spark):
    for rows in ([], ODD[:1], [(10, 1, [1.0] * 6)], [(10, 1, [1.0] * 6), (11, 1, [2.0] * 6)], [(11, 1, [1.0] * 6), (12, 2, [2.0] * 6)], [(10, 1, [0.0] * 6), (11, 1, [0.0] * 6), (12, 2, [0.0] * 6)]):
        assert run(spark, rows) == negatives_by_hand(rows)


def test_brackets_hold_and_exclude():
    """The score lies in its bracket for any norms, and clustered rows are mostly left out before any product."""
    r = np.random.default_rng(3)
    centers = r.normal(size=(12, 8)) * 400
    x = np.floor(centers[r.integers(12, size=2000)] + r.normal(size=(2000, 8)) * 8)
    most = float((x * x).sum(1).max())
    pivots = h.far_apart(x[:200], most, h.PIVOTS)
    d, q = h.distances(x, h.lifted(x, most), pivots).astype(float), x[:50]
    dq = h.distances(q, np.zeros(50), pivots).astype(float)
    least = np.abs(dq[:, None] - d[None]).max(2)
    upper = ((q * q).sum(1)[:, None] + most - np.maximum(least - 1e-6 * (np.sqrt(most) * 3), 0) ** 2) / 2 + 1e-9 * 2 * most + 1
    scores = q @ x.T
    assert (scores <= upper).all()
    assert (upper >= np.sort(scores, 1)[:, -5][:, None]).mean() < 0.5


def test_blocks_out_of_reach_are_not_compared(spark, monkeypatch):
    monkeypatch.setattr(h, "ROWS", 64)
    monkeypatch.setattr(h, "ANCHORS", 16)
    seen = []
    sweep = h.PivotTable._sweep

    def counted(self, asked, blocks, k, same):
        out = sweep(self, asked, blocks, k, same)
        seen.append((self.a * self.r, out))
        return out

    r = np.random.default_rng(4)
    centers = r.normal(size=(8, 6))
    rows = [(k, int(k % 8 + 8 * (k % 2)), (centers[k % 8] * 4 + r.normal(size=6) * 0.05).tolist()) for k in range(1500)]
    monkeypatch.setattr(h.PivotTable, "_sweep", counted)
    assert run(spark, rows) == negatives_by_hand(rows)
    assert len(seen) == 4


def codes_by_hand(rows, rounds=6, entries=16):
    dim = 10
    kept = [(i, y, [math.floor(4096 * c) for c in x] + [0] * 6) for i, y, x in rows if finite(x) and len(x) == dim]
    width = 2
    parts = lambda q: [tuple(q[p * width : (p + 1) * width]) for p in range(8)]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0))[:entries]
    books = [[parts(q)[p] for _, _, q in first] for p in range(8)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))

    def near(p, x):
        return min((far(x, y), e) for e, y in enumerate(books[p]))

    for _ in range(rounds):
        new = []
        for p in range(8):
            of = [[] for _ in books[p]]
            for _, _, q in kept:
                of[near(p, parts(q)[p])[1]].append(parts(q)[p])
            new.append([tuple(sum(c) // len(g) for c in zip(*g)) if g else books[p][e] for e, g in enumerate(of)])
        books = new
    got = [(i, y, [near(p, parts(q)[p]) for p in range(8)]) for i, y, q in kept]
    by = {}
    for _, y, n in got:
        by[y] = by.get(y, 0) + sum(d for d, _ in n)
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return sorted(((i, "".join(f"{e:02x}" for _, e in n), sum(d for d, _ in n), by[y], digest) for i, y, n in got), key=str)


def encode(spark, rows):
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, label int, embedding array<float>, code string").repartition(3)
    return sorted((tuple(r) for r in v.vector_codes(df).collect()), key=str)


def as_float(rows):
    return [(i, y, None if x is None else [None if c is None else float(np.float32(c)) for c in x]) for i, y, x in rows]


def test_codes_as_by_hand(spark):
    r = random.Random(8)
    rows = [(k * 3, r.choice([1, 2, None]), [r.choice([-0.5, 0.25, 0.3]) if k % 2 else r.gauss(0, 1) for _ in range(10)]) for k in range(90)]
    rows += [(k, 9, [0.1] * 10) for k in range(1000, 1050)] + rows[40:50] + [(7, 1, None), (8, None, [NAN] * 10), (9, 1, [0.5] * 9 + [None]), (10, 1, [0.5] * 9), (11, 1, [INF] * 10), (None, 4, [0.7] * 10)]
    rows = as_float(rows)
    assert encode(spark, rows) == codes_by_hand(rows)


def test_codes_of_few_rows(spark):
    for rows in ([], [(1, None, None)], [(5, None, [0.5] * 10)], [(5, 1, [0.5] * 10), (4, 2, [-0.5] * 10), (6, 1, [0.5] * 10)]):
        assert encode(spark, rows) == codes_by_hand(rows)
    assert encode(spark, [(1, 1, [])]) == [(1, "00" * 8, 0, 0, hashlib.sha256(b"").hexdigest())]


@pytest.mark.parametrize("n", [1, 4, 5, 16, 70])
def test_tree_finds_the_nearest_and_least(n):
    r = np.random.default_rng(n)
    for scale in (2, 50, 1 << 27):
        points, x = r.integers(-scale, scale, (n, 3)), r.integers(-scale, scale, (400, 3))
        points[n // 2] = points[0]
        x[:n] = points
        d = ((x[:, None] - points[None]) ** 2).sum(2)
        at, square = v.VantageTree(points).nearest(x)
        assert (at == d.argmin(1)).all() and (square == d.min(1)).all()


def test_tree_visits_few_of_clustered_points():
    r = np.random.default_rng(2)
    points = (r.normal(size=(16, 8)) * 3000).astype("int64")
    x = points[r.integers(16, size=2000)] + r.integers(-50, 50, (2000, 8))
    visited = []

    class Counted(v.VantageTree):
        def _visit(self, node, x, who, best, square):
            visited.append(len(who) * len(node[0]))
            super()._visit(node, x, who, best, square)

    Counted(points).nearest(x)
    assert sum(visited) < 0.7 * 16 * 2000


def test_components_out_of_range_are_refused(spark):
    df = spark.createDataFrame([(0, 1, [1e30] * 8)], "vec_id long, label int, embedding array<double>")
    for f in (v.vector_codes, h.hard_negatives):
        with pytest.raises(Exception, match="component"):
            f(df).collect()
