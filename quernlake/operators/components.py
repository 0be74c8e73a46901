"""Connected components by alternating stars, all in DataFrames."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import drop, hot_join, kept


def _together(g: pd.DataFrame) -> pd.DataFrame:
    """The components of few edges, by a forest whose roots are least nodes."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while up.get(x, x) != x:
            up[x] = up.get(up[x], up[x])
            x = up[x]
        return x

    for u, v in zip(g["u"].tolist(), g["v"].tolist()):
        a, b = root(u), root(v)
        up[max(a, b)] = min(a, b)
        up.setdefault(min(a, b), min(a, b))
    return pd.DataFrame([(x, root(x)) for x in up if root(x) != x], columns=["node", "root"])


def components(edges: DataFrame, few: int = 0) -> DataFrame:
    """(node, root) for each node of ``edges`` (a, b: long) but the roots, the least nodes of their components.

    Each round hooks every node's larger neighbours to its least neighbour, then its smaller ones, till nothing changes;
    rounds grow as the logarithm of the longest chain. Every round is written to the shared folder. Nodes with very many
    neighbours are joined by broadcast (hot_join), so their edges stay spread. Null ends and loops are left out. No more
    than ``few`` edges, which are counted first, go to one task instead, with the same result.
    """
    spark = edges.sparkSession
    now, path = kept(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    if few and now.count() <= few:
        return now.coalesce(1).mapInPandas(lambda batches: iter([_together(pd.concat([pd.DataFrame({"u": [], "v": []}, dtype="int64"), *batches]))]), "node long, root long")
    seen = None
    while True:
        total, sign = now.agg(F.count("*"), F.sum(F.shiftright(F.xxhash64("u", "v"), 16))).first()
        if (total, sign) == seen:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = total, sign
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least, least_path = kept(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n")), "least")
        large = hot_join(both, least, ["u"], "n", 2 * total).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large, large_path = kept(large, "large")
        low, low_path = kept(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), "low")
        small = hot_join(large, low, ["u"], "n", total).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        old, (now, path) = path, kept(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
        for done in (old, least_path, large_path, low_path):
            drop(spark, done)
