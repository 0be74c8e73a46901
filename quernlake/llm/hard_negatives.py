"""Hard negatives by a pivot table: stored distances to pivots bracket inner products, survivors are checked exactly."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import table, written

PIVOTS, SAMPLE = 12, 1024  # pivots; rows of the sample that they are chosen from
ROWS, ANCHORS = 4096, 1024  # rows and anchors of a block
STEP = 512  # rows of a block compared at once
DENSE = 0.1  # share of survivors from which a step's products are made as one matrix product
FAR = 1 << 62  # beyond all scores
POSITIVES, NEGATIVES = 5, 10

TABLE = "vec_id long, label long, q binary, dist binary, cell int"
BLOCK = "j int, ids binary, labels binary, q binary, dist binary, least array<float>, most array<float>"
ASKED = "i int, ids binary, labels binary, q binary, dist binary, least array<float>, most array<float>, lo binary, hi binary, floor double, roof double, short double, long double"
FOUND = "anchor_id long, slot int, vec_id long, score long"


def usable(df: DataFrame) -> DataFrame:
    """vec_id, label, vec array<double>: rows without a null id or label, or a null, NaN or infinite component, of the most
    frequent length."""
    v = df.select("vec_id", F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("vec")).where("vec_id IS NOT NULL AND label IS NOT NULL AND vec IS NOT NULL")
    v = v.where(~F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    size = v.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return v.where(F.size("vec") == (size["n"] if size else 0))


def whole(vec: pd.Series, scale: int) -> np.ndarray:
    """Components as floor(scale * x), a row for each vector; refuses what 32 bits don't hold."""
    x = np.floor(scale * np.stack([np.asarray(v, "float64") for v in vec]))
    if x.size and np.abs(x).max() >= 1 << 31:
        raise OverflowError(f"floor({scale} * x) of a component doesn't fit 32 bits")
    return x


def lifted(x: np.ndarray, most: float) -> np.ndarray:
    """The added component that gives each row of ``x`` the squared length ``most``."""
    return np.sqrt(np.maximum(most - (x * x).sum(1), 0))


def far_apart(x: np.ndarray, most: float, n: int) -> np.ndarray:
    """At most ``n`` different rows of ``x`` with the added component, each the farthest from those before."""
    x = np.unique(np.column_stack([x, lifted(x, most)]), axis=0)
    out, gap = [], np.full(len(x), np.inf)
    at = int((x * x).sum(1).argmax()) if len(x) else 0
    while len(out) < min(n, len(x)):
        out.append(x[at])
        gap = np.minimum(gap, ((x - x[at]) ** 2).sum(1))
        at = int(gap.argmax())
        if not gap[at]:
            break
    return np.array(out)


def distances(x: np.ndarray, extra: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """The distance of each row of ``x``, with its added component ``extra``, to each pivot."""
    return np.sqrt(np.stack([((x - p[:-1]) ** 2).sum(1) + (extra - p[-1]) ** 2 for p in pivots], 1)).astype("float32")


class PivotTable:
    """Rows with their distances to a few pivots, in blocks, in the shared folder.

    An added component gives all vectors one length, and an anchor none of it: then a larger inner product is a shorter
    distance, and for each pivot the triangle inequality holds the distance between the difference and the sum of the two
    stored ones. Rows lie in the order of their nearest pivots, dealt within one by a hash, so that blocks are of near-equal
    size whatever vector or cell a third of all rows hold. A row comes to its block once; blocks of anchors go to those
    blocks of rows that may hold something for them.
    """

    def __init__(self, rows: DataFrame, scale: int):
        """``rows``: vec_id, label, vec, as usable() gives them; components become floor(scale * x)."""
        squares = F.aggregate("vec", F.lit(0.0), lambda a, x: a + F.floor(x * scale).cast("double") * F.floor(x * scale).cast("double"))
        n, most, dim = rows.agg(F.count("*"), F.max(squares), F.max(F.size("vec"))).first()
        self.n, self.most, self.dim = n, float(most or 0), int(dim or 0)
        if not n:
            return
        sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("vec").toPandas()
        pivots = self.pivots = far_apart(whole(sample["vec"], scale), self.most, PIVOTS)
        most = self.most

        def measure(batches):
            for g in batches:
                if len(g):
                    x = whole(g["vec"], scale)
                    d = distances(x, lifted(x, most), pivots)
                    yield pd.DataFrame({"vec_id": g["vec_id"], "label": g["label"], "q": [v.tobytes() for v in x.astype("<i4")], "dist": [v.tobytes() for v in d], "cell": d.argmin(1).astype("int32")})

        self.rows = written(rows.mapInPandas(measure, TABLE), "pivots")
        self.r = -(-n // ROWS)
        placed = self._placed(self.rows.withColumn("place", F.monotonically_increasing_id()), "j", self.r, "place")

        def pack(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
            d = np.frombuffer(b"".join(g["dist"]), "<f4").reshape(len(g), -1)
            order = np.lexsort((g["vec_id"], d[np.arange(len(g)), g["cell"]], g["cell"]))
            g, d = g.iloc[order], d[order]
            return pd.DataFrame([(key[0], g["vec_id"].to_numpy("<i8").tobytes(), g["label"].to_numpy("<i8").tobytes(), b"".join(g["q"]), d.tobytes(), d.min(0), d.max(0))], columns=[c.split()[0] for c in BLOCK.split(", ")])

        self.packed = written(placed.groupBy("j").applyInPandas(pack, BLOCK), "blocks")

    @staticmethod
    def _placed(rows: DataFrame, name: str, blocks: int, *by: str) -> DataFrame:
        """``rows`` with the block of each in column ``name``: along the cells, and within a cell by a hash."""
        sizes = {r["cell"]: r["count"] for r in rows.groupBy("cell").count().collect()}  # a number for each pivot
        total, cells = sum(sizes.values()), range(max(sizes, default=0) + 1)
        before = F.array(*[F.lit(sum(sizes.get(k, 0) for k in range(c))) for c in cells])
        size = F.array(*[F.lit(sizes.get(c, 0)) for c in cells])
        share = F.pmod(F.xxhash64("vec_id", *by), F.lit(1 << 20)) / F.lit(float(1 << 20))
        at = (F.get(before, F.col("cell")) + share * F.get(size, F.col("cell"))) / F.lit(float(max(total, 1)))
        return rows.withColumn(name, F.least(F.floor(at * blocks), F.lit(blocks - 1)).cast("int"))

    def anchors(self, asked: Column) -> DataFrame:
        """The rows for which ``asked`` holds, an id once (the least label and vector), with their block i; written."""
        one = self.rows.where(asked).groupBy("vec_id").agg(F.min(F.struct("label", "q", "cell")).alias("x")).select("vec_id", "x.*")
        found = written(one, "anchors")
        self.a = max(1, -(-found.count() // ANCHORS))
        return self._placed(found, "i", self.a)

    def best(self, anchors: DataFrame, k: int, same: bool) -> DataFrame:
        """For each anchor and slot the ``k`` rows of the largest scores between its bounds, ties by smaller vec_id: anchor_id,
        slot, rank from 1, vec_id, score.

        ``anchors``: vec_id, label, q, i, and the bounds lo and hi, arrays with a slot for each pair. Rows are of the
        anchor's label if ``same``, else of another, and never of its own id. A first sweep, of one near block of rows for
        each block of anchors, raises the bounds; the second leaves out all pairs of blocks that can't reach them.
        """
        top = Window.partitionBy("anchor_id", "slot").orderBy(F.desc("score"), "vec_id")
        ranked = lambda x: x.withColumn("rank", F.row_number().over(top)).where(F.col("rank") <= k)
        near = F.floor((F.col("i") + 0.5) * self.r / self.a).cast("int")
        first = written(ranked(self._sweep(self._asked(anchors), F.array(near), k, same)), "first")
        worst = first.groupBy("anchor_id", "slot").agg(F.count("*").alias("n"), F.min("score").alias("score")).where(F.col("n") >= k)
        worst = worst.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.map_from_entries(F.collect_list(F.struct("slot", "score"))).alias("worst"))
        raised = F.transform("lo", lambda x, slot: F.greatest(x, F.coalesce(F.try_element_at("worst", slot), x)))
        more = anchors.join(worst, "vec_id", "left").withColumn("lo", raised)
        rest = self._sweep(self._asked(more), F.array_except(F.sequence(F.lit(0), F.lit(self.r - 1)), F.array(near)), k, same)
        return ranked(first.drop("rank").unionByName(rest))

    def _asked(self, anchors: DataFrame) -> DataFrame:
        """Anchors in blocks, with the bounds of each slot and what the whole block may ask for; written."""
        pivots, dim = self.pivots, self.dim

        def pack(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
            g = g.sort_values("vec_id")
            q = np.frombuffer(b"".join(g["q"]), "<i4").reshape(len(g), dim).astype("float64")
            d, length = distances(q, np.zeros(len(q)), pivots), np.sqrt((q * q).sum(1))
            slots = max(map(len, g["lo"]))
            lo, hi = np.full((len(g), slots), FAR), np.full((len(g), slots), -FAR)
            for n, (a, z) in enumerate(zip(g["lo"], g["hi"])):
                lo[n, : len(a)], hi[n, : len(z)] = a, z
            open_ = lo <= hi
            row = (key[0], g["vec_id"].to_numpy("<i8").tobytes(), g["label"].to_numpy("<i8").tobytes(), q.astype("<i4").tobytes(), d.tobytes(), d.min(0), d.max(0), lo.tobytes(), hi.tobytes())
            return pd.DataFrame([(*row, float(lo[open_].min(initial=FAR)), float(hi[open_].max(initial=-FAR)), length.min(), length.max())], columns=[c.split()[0] for c in ASKED.split(", ")])

        return written(anchors.select("i", "vec_id", "label", "q", "lo", "hi").groupBy("i").applyInPandas(pack, ASKED), "asked")

    def _sweep(self, asked: DataFrame, blocks: Column, k: int, same: bool) -> DataFrame:
        """The best of each block of anchors in each of its ``blocks`` of rows that its bounds don't exclude."""
        slack = 1e-6 * (F.col("long") + 2 * F.lit(self.most**0.5))
        apart = F.zip_with(F.zip_with("least", "theirs_most", lambda a, b: a - b), F.zip_with("theirs_least", "most", lambda a, b: a - b), lambda a, b: F.greatest(a, b))
        nearest = F.greatest(F.array_max(apart) - slack, F.lit(0.0))
        farthest = F.array_min(F.zip_with("most", "theirs_most", lambda a, b: a + b)) + slack
        room = 1e-9 * (F.col("long") * F.col("long") + self.most) + 1
        upper = (F.col("long") * F.col("long") + self.most - nearest * nearest) / 2 + room
        lower = (F.col("short") * F.col("short") + self.most - farthest * farthest) / 2 - room
        boxes = self.packed.select("j", F.col("least").alias("theirs_least"), F.col("most").alias("theirs_most"))
        pairs = asked.where("floor <= roof").select("i", "least", "most", "floor", "roof", "short", "long", F.explode(blocks).alias("j")).join(boxes, "j").where((upper >= F.col("floor")) & (lower <= F.col("roof"))).select("i", "j")
        theirs = self.packed.select("j", *[F.col(c).alias(f"x_{c}") for c in ("ids", "labels", "q", "dist")])
        both = pairs.join(asked.select("i", "ids", "labels", "q", "dist", "lo", "hi").hint("merge"), "i").join(theirs.hint("merge"), "j")
        most, dim = self.most, self.dim
        return both.groupBy("j", "i").applyInPandas(lambda g: _compare(g.iloc[0], most, dim, k, same), FOUND)


def _compare(g: pd.Series, most: float, dim: int, k: int, same: bool) -> pd.DataFrame:
    """The ``k`` best of a block of rows for each anchor of a block and each of its slots."""
    ids, labels, x_ids, x_labels = (np.frombuffer(g[c], "<i8") for c in ("ids", "labels", "x_ids", "x_labels"))
    q, x = (np.frombuffer(g[c], "<i4").reshape(n, dim).astype("float64") for c, n in (("q", len(ids)), ("x_q", len(x_ids))))
    d, x_d = (np.frombuffer(g[c], "<f4").reshape(n, -1).astype("float64") for c, n in (("dist", len(ids)), ("x_dist", len(x_ids))))
    lo, hi = (np.frombuffer(g[c], "int64").reshape(len(ids), -1).copy() for c in ("lo", "hi"))
    if dim * np.abs(q).max(initial=0) * np.abs(x).max(initial=0) >= 2.0**53:  # beyond that, doubles aren't exact
        if float(dim) * np.abs(q).max(initial=0) * np.abs(x).max(initial=0) >= 2.0**62:
            raise OverflowError("inner products don't fit 64 bits")
        q, x = q.astype("int64"), x.astype("int64")
    square = (q * q).sum(1).astype("float64")
    slack, room = 1e-6 * (np.sqrt(square) + 2 * most**0.5), 1e-9 * (square + most) + 1
    found = [(np.zeros(0, "int64"), np.zeros(0, "int64"), np.zeros(0, "int64"))] * lo.shape[1]
    for a in range(0, len(x_ids), STEP):
        part = slice(a, a + STEP)
        least = np.abs(d[:, :1] - x_d[None, part, 0])
        far = d[:, :1] + x_d[None, part, 0]
        for p in range(1, d.shape[1]):
            np.maximum(least, np.abs(d[:, p, None] - x_d[None, part, p]), out=least)
            np.minimum(far, d[:, p, None] + x_d[None, part, p], out=far)
        least = np.maximum(least - slack[:, None], 0)
        upper = (square[:, None] + most - least * least) / 2 + room[:, None]
        far += slack[:, None]
        lower = (square[:, None] + most - far * far) / 2 - room[:, None]
        fits = ((labels[:, None] == x_labels[None, part]) == same) & (ids[:, None] != x_ids[None, part])
        open_ = [fits & (upper >= lo[:, s, None]) & (lower <= hi[:, s, None]) & (lo[:, s] <= hi[:, s])[:, None] for s in range(lo.shape[1])]
        mine, theirs = np.nonzero(np.logical_or.reduce(open_))
        if len(mine) > DENSE * fits.size:
            score = (q @ x[part].T)[mine, theirs]
        else:
            score = np.concatenate([(q[mine[b : b + (1 << 15)]] * x[part][theirs[b : b + (1 << 15)]]).sum(1) for b in range(0, len(mine), 1 << 15)] or [np.zeros(0)])
        score, names = score.astype("int64"), x_ids[part][theirs]
        for s, (was, scores, rows) in enumerate(found):
            good = (score >= lo[mine, s]) & (score <= hi[mine, s])
            if good.any():
                was, scores, rows = np.append(was, mine[good]), np.append(scores, score[good]), np.append(rows, names[good])
                order = np.lexsort((rows, -scores, was))
                was, scores, rows = was[order], scores[order], rows[order]
                head = np.flatnonzero(np.append(True, was[1:] != was[:-1]))
                rank = np.arange(len(was)) - np.repeat(head, np.diff(np.append(head, len(was))))
                last = rank == k - 1
                lo[was[last], s] = np.maximum(lo[was[last], s], scores[last])  # from now on only what is as good
                found[s] = (was[rank < k], scores[rank < k], rows[rank < k])
    return pd.concat([pd.DataFrame({"anchor_id": ids[was], "slot": np.int32(s), "vec_id": rows, "score": scores}) for s, (was, scores, rows) in enumerate(found)])


def hard_negatives(df: DataFrame, every: int = 100, positives: int = POSITIVES, negatives: int = NEGATIVES, share: tuple[int, int] = (30, 90), scale: int = 256) -> DataFrame:
    """For each anchor (a row whose vec_id is divisible by ``every``) and each of its ``positives`` best rows of the same
    label the ``negatives`` best rows of another label whose score lies within ``share`` percent of the positive's.

    ``df``: vec_id, label, embedding; other columns are left out. A score is the inner product of floor(scale * x). Returns
    anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score; higher scores come first, ties by
    smaller vec_id. Rows with a null id, label, vector or component, a component that isn't finite, or of another length
    than most take no part. Repeated rows are rows of their own but as anchors; an id with several rows is an anchor once,
    with the least label and vector. Where a positive's score is negative nothing lies between its bounds. An empty table
    gives no rows.
    """
    pivots = PivotTable(usable(df), scale)
    none = df.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    if not pivots.n:
        return none
    anchors = pivots.anchors(F.col("vec_id") % every == 0)
    best = pivots.best(anchors.withColumn("lo", F.array(F.lit(-FAR))).withColumn("hi", F.array(F.lit(FAR))), positives, True)
    best = written(best.select("anchor_id", (F.col("rank") - 1).cast("int").alias("slot"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    score = F.col("positive_score").cast("decimal(20,0)")
    bounds = F.struct("slot", F.ceil(score * share[0] / 100).cast("long").alias("lo"), F.floor(score * share[1] / 100).cast("long").alias("hi"))
    asked = best.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.array_sort(F.collect_list(bounds)).alias("bounds"))
    found = pivots.best(anchors.join(asked.select("vec_id", "bounds.lo", "bounds.hi"), "vec_id"), negatives, False)
    found = found.select("anchor_id", "slot", F.col("rank"), F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    return found.join(best, ["anchor_id", "slot"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op11: hard_negatives() of all embeddings; where vec_id is divisible by 7, the label first becomes (label + 1) % 10."""
    rows = table(spark, sf_dir, "embeddings")
    return hard_negatives(rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))))


ORACLE = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score QUALIFY rank <= 10
"""
