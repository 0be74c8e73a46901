"""Ranked retrieval: lexical, vector and fused top-k, lookups around them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import exprs as X
from ..shared import written


def lexical_search(df: DataFrame, text: str, tokens: list[str], tie: list, k: int | None, tier: Column | None = None, offset: int = 0) -> DataFrame:
    """Rows that contain a token, by tier, score and ``tie``; adds score and tier. A top-k without a full sort."""
    found = df.withColumn("score", X.lexical_score(F.col(text), tokens)).withColumn("tier", F.lit(0) if tier is None else tier).where("score > 0")
    found = found.orderBy("tier", F.desc("score"), *tie)
    return found.offset(offset).limit(k) if offset else found.limit(k) if k else found


def proximity_rerank(df: DataFrame, text: str, tokens: list[str], tie: list, k: int, wide: int | None = None) -> DataFrame:
    """The lexical top ``wide`` again, those whose tokens stand close together first; adds bonus and base_rank."""
    base = lexical_search(df, text, tokens, tie, wide or min(3 * k, 200))
    ranked = base.withColumn("base_rank", F.row_number().over(Window.orderBy("tier", F.desc("score"), *tie)))  # of at most 200 rows
    return ranked.withColumn("bonus", X.proximity_bonus(F.col(text), tokens)).orderBy(F.desc("bonus"), "base_rank").limit(k)


def vector_search(df: DataFrame, vector: str, query: list[float] | Column, tie: list, k: int) -> DataFrame:
    probed = df.withColumn("_probe", X.vector_of(query))
    return probed.withColumn("cosine", X.cosine(F.col(vector), F.col("_probe"))).drop("_probe").orderBy(F.desc("cosine"), *tie).limit(k)


def fused_search(df: DataFrame, key: str, text: str, vector: str, tokens: list[str], query: list[float] | Column, k: int, tier: Column | None = None, end: Column | None = None, offset: int = 0) -> DataFrame:
    """0.3 of the lexical and 0.7 of the cosine score, each over its largest in the pool of both top lists.

    Rows without a vector have a cosine of -1. By tier, fused score, then ``end`` (the latest first) and key. The rows are
    scored once and written, and the pool has three times the page's rows, at least 30, from either list.
    """
    pool, df = max(30, 3 * (offset + k)), df.withColumn("_probe", X.vector_of(query))
    scored = df.select(key, X.lexical_score(F.col(text), tokens).alias("lex"), F.coalesce(X.cosine(F.col(vector), F.col("_probe")), F.lit(-1.0)).alias("cos"), (F.lit(0) if tier is None else tier).alias("tier"), (F.lit(0.0) if end is None else end.cast("double")).alias("end"))
    scored = written(scored, "scored")
    lexical = scored.where("lex > 0").orderBy("tier", F.desc("lex"), key).limit(pool)
    near = scored.orderBy("tier", F.desc("cos"), key).limit(pool)
    whole = Window.partitionBy(F.lit(0))  # of the pool, no more than twice its size
    both = lexical.unionByName(near).distinct().withColumn("pos", F.greatest("cos", F.lit(0.0)))
    both = both.withColumn("max_lex", F.max("lex").over(whole)).withColumn("max_cos", F.max("pos").over(whole))
    part = lambda v, m: F.when(F.col(m) > 0, F.col(v) / F.col(m)).otherwise(0.0)
    fused = both.withColumn("fused", F.round(part("lex", "max_lex") * 0.3 + part("pos", "max_cos") * 0.7, 6)).orderBy("tier", F.desc("fused"), F.desc("end"), key)
    return (fused.offset(offset) if offset else fused).limit(k).select(key, "fused")


def top_per_group(df: DataFrame, group: list[str], order: list, k: int, rank: str = "rank") -> DataFrame:
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col(rank) <= k)


def latest(df: DataFrame, key: str, order: list[str], *values: str) -> DataFrame:
    """The values of each key's last row by ``order``; partial aggregation, no sort of hot keys."""
    return df.groupBy(key).agg(F.max_by(F.struct(*values), F.struct(*order)).alias("v")).select(key, *[F.col(f"v.{c}").alias(c) for c in values])


def rounds(df: DataFrame, session: str, position: str) -> DataFrame:
    """Numbers the rounds of a session: one closes before a user's row that follows another's. Adds round (from 1)."""
    w = Window.partitionBy(session).orderBy(position)
    turn = (F.col("role") == "user") & (F.coalesce(F.lag("role").over(w), F.lit("")) != "user")
    return df.withColumn("_opens", turn.cast("int")).withColumn("round", F.sum("_opens").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_opens")


def within_budget(df: DataFrame, group: str, order: list, size: Column, budget: int) -> DataFrame:
    """The first rows of each group as long as their sizes add up to ``budget`` at most; the first always."""
    w = Window.partitionBy(group).orderBy(*order)
    used = F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("used_chars", used).withColumn("rn", F.row_number().over(w)).where(f"used_chars <= {budget} OR rn = 1").drop("rn")
