"""Vectors as short codes: a codebook for each part, entries found by a metric tree, all sums and distances in integers."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import hot_join, table, written

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
LEAF = 4  # entries of a leaf
BATCH = 4096  # rows assigned at once
LARGEST = 1 << 28  # of a component, so that squared distances fit 64 bits


def _root(square: np.ndarray, up: bool) -> np.ndarray:
    """Square roots of integers, rounded so that they are surely not too small, or not too large."""
    d = np.sqrt(square.astype("float64"))
    return np.nextafter(np.nextafter(d, np.inf), np.inf) if up else np.maximum(np.nextafter(np.nextafter(d, 0), 0), 0)


class VantageTree:
    """The nearest of a few integer points, by squared Euclidean distance, ties to the lower index.

    A node holds a point and splits the others by their distance to it, with the least and greatest distance on each
    side, rounded outwards. A search goes first to the side that its point lies on, and to the other unless the triangle
    inequality shows that all there is farther than the best so far; at an equal bound it goes there, so that no tie is
    missed. What is compared in the end are whole numbers. Many points are searched for at once.
    """

    def __init__(self, points: np.ndarray):
        self.points = points.astype("int64")
        self.top = self._node(np.arange(len(points)))

    def _node(self, at: np.ndarray) -> tuple:
        if len(at) <= LEAF:
            return at, None, ()
        center = self.points[at].mean(0)
        first = at[((self.points[at] - center) ** 2).sum(1).argmax()]
        rest = at[at != first]
        square = ((self.points[rest] - self.points[first]) ** 2).sum(1)
        order = np.argsort(square, kind="stable")
        half = len(order) // 2
        sides = [(rest[o], square[o]) for o in (order[:half], order[half:])]
        return np.array([first]), float(_root(square[order[half : half + 1]], False)[0]), tuple((float(_root(s.min(keepdims=True), False)[0]), float(_root(s.max(keepdims=True), True)[0]), self._node(r)) for r, s in sides)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each row of ``x`` the index of its nearest point and the squared distance."""
        x = x.astype("int64")
        best, square = np.full(len(x), len(self.points)), np.full(len(x), np.iinfo("int64").max)
        self._visit(self.top, x, np.arange(len(x)), best, square)
        return best, square

    def _visit(self, node: tuple, x: np.ndarray, who: np.ndarray, best: np.ndarray, square: np.ndarray) -> None:
        if not len(who):
            return
        at, split, sides = node
        for k in at:
            to = x[who] - self.points[k]
            d = np.einsum("ij,ij->i", to, to)
            better = (d < square[who]) | ((d == square[who]) & (k < best[who]))
            best[who[better]], square[who[better]] = k, d[better]
        if not sides:
            return
        low, high = _root(d, False), _root(d, True)
        inner = low < split
        for first in (True, False):  # the own side, then the other one
            for side, mine in ((sides[0], inner == first), (sides[1], inner != first)):
                least, most, below = side
                may = mine & (np.maximum(least - high, low - most) <= _root(square[who], True))
                self._visit(below, x, who[may], best, square)


def whole_vectors(df: DataFrame) -> DataFrame:
    """vec_id, label, q: vectors of the most frequent length without null or non-finite components, as floor(4096 * x), filled
    with zeros to a multiple of eight, little-endian 32-bit integers; written."""
    v = df.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("vec")).where("vec IS NOT NULL")
    v = v.where(~F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    size = v.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").first()
    dim = size["n"] if size else 0

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in batches:
            if len(g):
                x = np.floor(SCALE * np.stack([np.asarray(a, "float64") for a in g["vec"]]))
                if x.size and np.abs(x).max() > LARGEST:
                    raise OverflowError(f"a component of floor({SCALE} * x) is beyond {LARGEST}")
                x = np.pad(x, ((0, 0), (0, -dim % PARTS)))
                yield pd.DataFrame({"vec_id": g["vec_id"], "label": g["label"], "q": [a.tobytes() for a in x.astype("<i4")]})

    schema = f"vec_id {dict(v.dtypes)['vec_id']}, label {dict(v.dtypes)['label']}, q binary"
    return written(v.where(F.size("vec") == dim).mapInPandas(run, schema), "vectors")


def _parts(q: pd.Series) -> np.ndarray:
    """Vectors as an array by row, part and place in the part."""
    width = len(q.iloc[0]) // (4 * PARTS) if len(q) else 0
    return np.frombuffer(b"".join(q), "<i4").reshape(len(q), PARTS, width).astype("int64")


def learn(rows: DataFrame, rounds: int = ROUNDS, entries: int = ENTRIES) -> np.ndarray:
    """The codebooks, integers by part, entry and place: each begins as its part of the ``entries`` rows of least vec_id (of
    equal ids the least vector first, null ids last; all rows if there are fewer), and in each round every entry becomes
    the floor of the mean of the parts assigned to it.

    A task sends a row of sums for each entry and part; the driver holds the codebooks and the sums of a round, whose
    number doesn't grow with the table.
    """
    first = rows.select("vec_id", "q").orderBy(F.col("vec_id").asc_nulls_last(), "q").limit(entries).collect()
    books = _parts(pd.Series([bytes(r["q"]) for r in first])).transpose(1, 0, 2).copy()
    schema = "part int, entry int, n long, sums array<long>"

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trees = [VantageTree(b) for b in books]
        count, sums = np.zeros(books.shape[:2], "int64"), np.zeros(books.shape, "int64")
        for g in batches:
            for a in range(0, len(g), BATCH):
                x = _parts(g["q"].iloc[a : a + BATCH])
                for p, tree in enumerate(trees):
                    at, _ = tree.nearest(x[:, p])
                    count[p] += np.bincount(at, minlength=books.shape[1])
                    np.add.at(sums[p], at, x[:, p])
        p, e = np.nonzero(count)
        yield pd.DataFrame({"part": p.astype("int32"), "entry": e.astype("int32"), "n": count[p, e], "sums": list(sums[p, e])})

    for _ in range(rounds if books.size else 0):
        each = rows.select("q").mapInPandas(add, schema).select("part", "entry", "n", F.posexplode("sums").alias("place", "x"))
        total = each.groupBy("part", "entry", "place").agg(F.sum("n").alias("n"), F.sum(F.col("x").cast("decimal(38,0)")).alias("x")).collect()
        for r in total:
            books[r["part"], r["entry"], r["place"]] = int(r["x"]) // r["n"]
    return books


def encode(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """vec_id, label, code (two hex digits for each part), error (squared distances of the parts summed) of each row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trees = [VantageTree(b) for b in books]
        for g in batches:
            for a in range(0, len(g), BATCH):
                part = g.iloc[a : a + BATCH]
                x, codes, error = _parts(part["q"]), np.zeros((len(part), PARTS), "uint8"), np.zeros(len(part), "int64")
                for p, tree in enumerate(trees):
                    codes[:, p], square = tree.nearest(x[:, p])
                    error += square
                yield pd.DataFrame({"vec_id": part["vec_id"], "label": part["label"], "code": [c.tobytes().hex() for c in codes], "error": error})

    kinds = dict(rows.dtypes)
    return rows.mapInPandas(run, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long")


def vector_codes(df: DataFrame, rounds: int = ROUNDS, entries: int = ENTRIES) -> DataFrame:
    """vec_id, code, error, label_error (errors summed over equal labels, nulls together), codebooks_sha256 of each vector.

    ``df``: vec_id, label, embedding; other columns are left out. Rows whose vector is null, holds a null, NaN or infinite
    component or is of another length than most are left out; null ids and labels stay. Repeated rows each count. Where
    the length isn't a multiple of eight, zeros are added at the end. An empty table gives no rows.
    """
    rows = whole_vectors(df)
    books = learn(rows, rounds, entries)
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    coded = written(encode(rows, books), "codes").withColumn("none", F.col("label").isNull()).withColumn("of", F.coalesce("label", F.lit(0).cast(dict(rows.dtypes)["label"])))
    sums = written(coded.groupBy("none", "of").agg(F.sum("error").alias("label_error"), F.count("*").alias("rows")), "sums")
    found = hot_join(coded, sums, ["none", "of"], "rows", coded.count())
    return found.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op12: vector_codes() of all embeddings."""
    return vector_codes(table(spark, sf_dir, "embeddings"))


def _oracle() -> str:
    """Rounds written out one after the other; entries of a part are lists, compared with every part of every row."""
    steps = [
        f"v AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings"
        " WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"parts AS MATERIALIZED (SELECT vec_id, p, list_slice(q, p * len(q) // {PARTS} + 1, (p + 1) * len(q) // {PARTS}) AS x FROM v, unnest(range({PARTS})) AS t(p))",
        f"book0 AS MATERIALIZED (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, x AS y FROM parts QUALIFY e < {ENTRIES})",
    ]
    for k in range(ROUNDS + 1):
        steps.append(
            f"near{k} AS MATERIALIZED (SELECT vec_id, parts.p, x, arg_min(e, d * {ENTRIES} + e) AS e, min(d) AS d FROM (SELECT vec_id, parts.p, x, e, CAST(list_sum(list_transform(list_zip(x, y), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d"
            f" FROM parts JOIN book{k} USING (p)) AS parts GROUP BY ALL)"
        )
        if k < ROUNDS:
            steps.append(
                f"mean{k} AS (SELECT p, e, list(CAST(floor_x AS BIGINT) ORDER BY i) AS y FROM (SELECT p, e, i, (sum(x[i]) - ((sum(x[i]) % count(*)) + count(*)) % count(*)) // count(*) AS floor_x FROM near{k}, unnest(range(1, len(x) + 1)) AS t(i) GROUP BY p, e, i) GROUP BY p, e)"
            )
            steps.append(f"book{k + 1} AS MATERIALIZED (SELECT p, e, coalesce(mean{k}.y, book{k}.y) AS y FROM book{k} LEFT JOIN mean{k} USING (p, e))")
    last = f"near{ROUNDS}"
    steps += [
        f"books AS (SELECT sha256(string_agg(array_to_string(y, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM book{ROUNDS})",
        f"codes AS (SELECT vec_id, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM {last} GROUP BY vec_id)",
    ]
    return f"WITH {', '.join(steps)} SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM codes JOIN v USING (vec_id), books"


ORACLE = _oracle()
