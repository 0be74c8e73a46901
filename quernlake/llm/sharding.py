"""Uniform shuffle into shards of exact sizes by a hypergeometric communication matrix."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ._common import cut, free_names, table, texts

def hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """How many of ``n`` rows drawn without replacement from ``good + bad`` are good: an exact draw for any sizes.

    Each row is taken by itself with probability n / (good + bad), which makes two binomial numbers; rows that are then
    missing are drawn from those not taken, rows too many from those taken. By symmetry the rows so taken are a uniform
    choice of n, whatever the probability was, and what is to be drawn shrinks to about its square root each time.
    """
    total = good + bad
    if not 0 <= n <= total:
        raise ValueError("more rows to draw than there are")
    if 2 * n > total:
        return good - hypergeometric(rng, good, bad, total - n)
    if n <= 32:
        left = good
        for k in range(n):
            left -= int(rng.integers(total - k)) < left
        return good - left
    p = n / total
    x, y = int(rng.binomial(good, p)), int(rng.binomial(bad, p))
    if x + y < n:
        return x + hypergeometric(rng, good - x, bad - y, n - x - y)
    return x - hypergeometric(rng, x, y, x + y - n)


def matrix_row(counts: list[int], sizes: np.ndarray, part: int, seed: int) -> np.ndarray:
    """How many rows partition number ``part`` sends to each target: its row of the communication matrix.

    Row sums are ``counts`` and column sums ``sizes``. Halving the partitions again and again, each half's share of every
    target is drawn hypergeometrically from a generator of the half's own seed, so each task finds its row alone, without
    the matrix. Draws are exact at any size.
    """
    ends = np.concatenate([[0], np.cumsum(counts)])
    lo, hi, cols = 0, len(counts), np.array(sizes, dtype="int64")
    while hi - lo > 1:
        mid = (lo + hi) // 2
        rng = np.random.default_rng([seed, lo, hi])
        left, need, rest = np.zeros_like(cols), int(ends[mid] - ends[lo]), int(cols.sum())
        for k, c in enumerate(cols.tolist()):
            rest -= c
            left[k] = x = hypergeometric(rng, c, rest, need)
            need -= x
        lo, hi, cols = (lo, mid, left) if part < mid else (mid, hi, cols - left)
    return cols


def shuffle_into_shards(df: DataFrame, n_shards: int, seed: int = 17, least_rows: int = 4096, most_targets: int = 65_536) -> DataFrame:
    """``df`` in uniformly random order, dealt into ``n_shards`` shards whose row counts differ by one at most.

    Adds shard int (from 0) and slot long (gapless from 0 in each shard), in place of columns of those names. Each shard
    consists of splits of near-equal, fixed sizes; a task permutes its rows locally and sends as many to each split as its
    row of the communication matrix says; each split is permuted again. A split has about ``least_rows`` rows, more where
    there would be over ``most_targets`` splits, and is never larger than that, whatever keys the rows hold: equal
    rows spread like others. The driver holds a count for each partition. Rows are first written to the shared folder, so
    that their places stay as counted and any task can run again. Null cells and repeated rows are rows like others; an
    empty ``df`` gives no rows. Other columns may have any names and types; very long texts are only passed through.
    """
    spark, kept = df.sparkSession, [c for c in df.columns if c.lower() not in ("shard", "slot")]
    schema = df.select(kept).schema
    number, part_of, target, rank = free_names(df, "number", "part", "target", "rank")
    placed = cut(df.select(kept).withColumn(number, F.monotonically_increasing_id()))
    placed = placed.withColumn(part_of, F.shiftright(number, 33).cast("int"))
    found = sorted(map(tuple, placed.groupBy(part_of).agg(F.count("*").alias(rank)).collect()))
    counts, index = [n for _, n in found], {p: k for k, (p, _) in enumerate(found)}
    total = sum(counts)
    shards = [total // n_shards + (s < total % n_shards) for s in range(n_shards)]
    splits = max(1, min(-(-total // (n_shards * least_rows)), most_targets // n_shards))
    cuts = [[n * j // splits for j in range(splits + 1)] for n in shards]
    sizes = np.array([b - a for c in cuts for a, b in zip(c, c[1:])], dtype="int64")

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        order = None
        for batch in batches:
            if order is None and len(batch):
                part = index[int(batch[part_of].iloc[0])]
                order = np.repeat(np.arange(len(sizes), dtype="int32"), matrix_row(counts, sizes, part, seed))
                np.random.default_rng([seed, part]).shuffle(order)
            yield batch.drop(columns=part_of).assign(**{target: order[batch[number] & ((1 << 33) - 1)] if len(batch) else np.zeros(0, "int32")})

    sent = placed.mapInPandas(send, T.StructType([*schema.fields, T.StructField(number, T.LongType()), T.StructField(target, T.IntegerType())]))
    again = Window.partitionBy(target).orderBy(F.xxhash64(number, F.lit(seed + 1)), number)
    div = lambda a, b: F.call_function("div", a, F.lit(b))
    shard = div(F.col(target), splits).cast("int")
    size = F.lit(total // n_shards) + (shard < total % n_shards).cast("long")
    first = (F.col(target) % splits).cast("long")
    ranked = sent.withColumn(rank, F.row_number().over(again) - 1)
    return ranked.select(*kept, shard.alias("shard"), (div(size * first, splits) + F.col(rank)).alias("slot"))


def write_shards(df: DataFrame, path: str) -> None:
    """The rows of shuffle_into_shards() as Parquet, a folder a shard."""
    df.write.partitionBy("shard").parquet(path)


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = texts(table(spark, sf_dir, "documents")).select("doc_id", (F.octet_length("text") + 1).cast("long").alias("size"), F.crc32(F.encode("text", "UTF-8")).alias("text_crc32"))
    return shuffle_into_shards(docs, 8).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
