"""A full-text index that is kept between queries: postings by gram in pruned folders, upkept by segments, merged at times."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..shared import drop

BUCKETS = 256  # folders that grams are spread over; a search reads those of its grams
SPREAD = 4  # files of a folder that a segment may write, so that a frequent gram isn't one task's
MOST = 1200  # candidates beyond which a search reads all rows instead


class TextIndex:
    """An index of characters and adjacent pairs of the texts of rows (id, updated, text) in the folder ``path``.

    add() files what was inserted or changed since the last call, as a new segment: postings (gram, id), by folders of
    grams' hashes and sorted by gram, so that a search reads the folders and row groups of its grams alone. ``updated``
    rises with every change of a row; the index remembers the greatest it has seen, and a search unites what it finds with
    rows that are newer, or have none. What the index says of a row that was changed or deleted since is no harm, as each
    candidate's own text is scored; merge() leaves it out. State is a small JSON file for each version, the last valid.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets
        self.segments: list[str] = []
        self.seen: float | None = None
        self.version = 0

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> TextIndex:
        """The index as its last version left it."""
        states = spark.read.text(f"{path.rstrip('/')}/state").select("value").collect()  # a line for each version
        last = max((json.loads(r["value"]) for r in states), key=lambda x: x["version"])
        index = cls(spark, path, last["buckets"])
        index.segments, index.seen, index.version = last["segments"], last["seen"], last["version"]
        return index

    def _save(self, segments: list[str], seen: float | None) -> None:
        self.segments, self.seen, self.version = segments, seen, self.version + 1
        state = json.dumps({"version": self.version, "segments": segments, "seen": seen, "buckets": self.buckets})
        self.spark.createDataFrame([(state,)], "value string").coalesce(1).write.mode("append").text(f"{self.path}/state")

    def _write(self, postings: DataFrame, name: str) -> str:
        placed = postings.withColumn("bucket", F.pmod(F.xxhash64("gram"), F.lit(self.buckets)).cast("int"))
        dealt = placed.repartition("bucket", F.pmod(F.xxhash64("id"), F.lit(SPREAD))).sortWithinPartitions("bucket", "gram", "id")
        dealt.write.partitionBy("bucket").parquet(f"{self.path}/{name}")
        return name

    def fresh(self, rows: DataFrame) -> DataFrame:
        """Rows that the index hasn't seen: newer than all it has, or without a time."""
        return rows if self.seen is None else rows.where(F.col("updated").isNull() | (F.col("updated") > self.seen))

    def add(self, rows: DataFrame, text: str = "text") -> None:
        """Indexes the rows of ``rows`` (id, updated, text) that are new or changed; null ids are left out."""
        new = self.fresh(rows).where("id IS NOT NULL AND updated IS NOT NULL")
        newest = new.agg(F.max("updated")).first()[0]
        if newest is None:
            return
        new = new.where(F.col("updated") <= newest)
        grams = new.select("id", F.explode(F.array_distinct(F.split(X.search_body(F.col(text)), " "))).alias("gram"))
        segment = self._write(grams, f"segment-{self.version}")
        self._save([*self.segments, segment], newest)

    def postings(self) -> DataFrame:
        """gram, id, bucket of all segments; a pair may be there more than once."""
        schema = "gram string, id string, bucket int"
        if not self.segments:
            return self.spark.createDataFrame([], schema)
        return reduce(DataFrame.unionByName, [self.spark.read.schema(schema).parquet(f"{self.path}/{s}") for s in self.segments])

    def merge(self, rows: DataFrame, text: str = "text") -> None:
        """All segments as one, without pairs that the present texts of ``rows`` no longer have."""
        ids = rows.where("id IS NOT NULL").select("id", F.array_distinct(F.split(X.search_body(F.col(text)), " ")).alias("grams"))
        had = self.postings().groupBy("id").agg(F.collect_set("gram").alias("had"))  # a row of two arrays each, not one a posting
        live = had.join(ids, "id").select("id", F.explode(F.array_intersect("had", "grams")).alias("gram"))
        old, segment = self.segments, self._write(live, f"segment-{self.version}")
        self._save([segment], self.seen)
        for s in old:
            drop(self.spark, f"{self.path}/{s}")

    def _buckets(self, grams: list[str]) -> list[int]:
        """The folders of a query's grams."""
        named = self.spark.createDataFrame([(g,) for g in grams], "gram string")
        return sorted(r[0] for r in named.select(F.pmod(F.xxhash64("gram"), F.lit(self.buckets)).cast("int")).distinct().collect())

    def candidates(self, query: str) -> DataFrame | None:
        """id of all indexed rows that share a gram with the query; None for a query without any."""
        grams = X.match_grams(X.query_tokens(query))
        if not grams:
            return None
        return self.postings().where(F.col("bucket").isin(self._buckets(grams)) & F.col("gram").isin(grams)).select("id").distinct()

    def search(self, rows: DataFrame, query: str, k: int, order: list, most: int = MOST, text: str = "text", offset: int = 0) -> DataFrame:
        """Rows ``offset`` to ``offset + k`` of those that hold a token of the query, by score (added), then ``order``.

        Narrow rows are ranked first and the page's columns fetched afterwards. Where the index gives over ``most`` candidates
        all rows are read, with the same result. A query without tokens gives nothing.
        """
        tokens, near = X.query_tokens(query), self.candidates(query)
        if near is None:
            return rows.withColumn("score", F.lit(0)).limit(0)
        if near.limit(most + 1).count() <= most:
            found = rows.join(near, "id", "left_semi").unionByName(self.fresh(rows).join(near, "id", "left_anti"))
        else:
            found = rows
        scored = found.withColumn("score", X.lexical_score(X.squeeze(F.col(text)), tokens)).where("score > 0")
        page = scored.orderBy(F.desc("score"), *order).offset(offset).limit(k)
        return page
