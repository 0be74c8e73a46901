"""Rows kept in versions: change sets that touch few partitions, conflicts as rows, restore by version, cascading purge."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..shared import drop, written


def _version_id(target: Column, revision: Column) -> Column:
    return F.sha2(F.concat_ws("\x1f", target, revision.cast("string")), 256)


class VersionedTable:
    """A table of rows (id, revision, ...) with all their earlier states, in the folder ``path``, by buckets of id.

    A change set rewrites only the buckets that its ids fall into, as new folders; the rest stays as it is, and a small
    state file says which folder of each bucket holds. Versions (version, target, revision, at, state) are added, never
    changed: what a row was before revision r is named by the hash of its id and r.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, buckets: int = 64):
        self.spark, self.path, self.schema, self.buckets = spark, path.rstrip("/"), schema, buckets
        self.folders: dict[int, str] = {}
        self.logs: list[str] = []
        self.step = 0

    @classmethod
    def create(cls, rows: DataFrame, path: str, buckets: int = 64) -> VersionedTable:
        """``rows``: ids must be there and unique."""
        table = cls(rows.sparkSession, path, rows.schema, buckets)
        table._put(rows, list(range(buckets)))
        return table

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> VersionedTable:
        """The table as its last change set left it."""
        last = max((json.loads(r["value"]) for r in spark.read.text(f"{path.rstrip('/')}/state").collect()), key=lambda x: x["step"])
        table = cls(spark, path, T.StructType.fromJson(last["schema"]), last["buckets"])
        table.folders, table.logs, table.step = {int(k): v for k, v in last["folders"].items()}, last["logs"], last["step"]
        return table

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("id"), F.lit(self.buckets)).cast("int")

    def _put(self, rows: DataFrame, touched: list[int]) -> None:
        folder = f"rows-{self.step}"
        rows.withColumn("_bucket", self._bucket()).repartition("_bucket").write.partitionBy("_bucket").parquet(f"{self.path}/{folder}")
        there = {r[0] for r in self.spark.read.schema(T.StructType([*self.schema, T.StructField("_bucket", T.IntegerType())])).parquet(f"{self.path}/{folder}").select("_bucket").distinct().collect()}
        for b in touched:
            self.folders.pop(b, None)
        self.folders |= {b: f"{folder}/_bucket={b}" for b in there}
        self._save()

    def _save(self) -> None:
        self.step += 1
        state = {"step": self.step, "schema": self.schema.jsonValue(), "buckets": self.buckets, "folders": self.folders, "logs": self.logs}
        self.spark.createDataFrame([(json.dumps(state),)], "value string").coalesce(1).write.mode("append").text(f"{self.path}/state")

    def rows(self, of: list[int] | None = None) -> DataFrame:
        """All rows, or those of some buckets."""
        paths = [f"{self.path}/{f}" for b, f in sorted(self.folders.items()) if of is None or b in of]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def versions(self) -> DataFrame:
        schema = "version string, target string, revision int, at double, state string"
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{f}" for f in self.logs]) if self.logs else self.spark.createDataFrame([], schema)

    def _apply(self, wanted: DataFrame, fields: list[str], now: float) -> DataFrame:
        """wanted: id, revision (expected; null: any), set (struct of ``fields``), n (their order), bad (why it can't be, or null)."""
        wanted = written(wanted.withColumn("_bucket", self._bucket()), "wanted")
        touched = sorted(r[0] for r in wanted.select("_bucket").distinct().collect() if r[0] is not None)  # no more than buckets
        rows = self.rows(touched)
        first = F.row_number().over(Window.partitionBy("id").orderBy("n"))
        now_at = rows.select("id", F.col("revision").alias("_is"))
        judged = wanted.join(now_at, "id", "left").withColumn("_k", F.when(F.col("bad").isNull() & F.col("_is").isNotNull() & (F.coalesce("revision", "_is") == F.col("_is")), first))
        order = F.min("_k").over(Window.partitionBy("id"))
        why = F.coalesce("bad", F.when(F.col("_is").isNull(), "missing").when(F.col("_k").isNull(), "revision").when(F.col("_k") > order, "second"))
        judged = written(judged.withColumn("why", why), "judged")
        good = judged.where("why IS NULL").select("id", F.col("set").alias("_set"))
        both = rows.join(good, "id", "left")
        hit = F.col("_set").isNotNull()
        log = f"versions-{self.step}"
        changed = both.where(hit).select(_version_id(F.col("id"), F.col("revision")).alias("version"), F.col("id").alias("target"), "revision", F.lit(float(now)).alias("at"), F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("state"))
        changed.write.parquet(f"{self.path}/{log}")
        self.logs = [*self.logs, log]
        out = [F.when(hit, F.col(f"_set.{c}")).otherwise(F.col(c)).alias(c) if c in fields else (F.col(c) + hit.cast("int")).cast("int").alias(c) if c == "revision" else F.col(c) for c in rows.columns]
        self._put(both.select(*out).withColumn("id", F.col("id")), touched)
        return judged.where("why IS NOT NULL").select("id", "n", "why")

    def edit(self, edits: DataFrame, fields: list[str], now: float) -> DataFrame:
        """Applies edits (n, id, revision, and ``fields``, null where they stay); gives conflicts: id, n, why.

        why: missing (no such row), revision (it was changed since; a null revision never conflicts), second (an edit of
        the same row with a smaller n was applied).
        """
        old = self.rows().select("id", *[F.col(f).alias(f"_{f}") for f in fields])
        both = edits.join(old, "id", "left")
        new = F.struct(*[F.coalesce(f, f"_{f}").alias(f) for f in fields])
        return self._apply(both.select("id", "revision", new.alias("set"), "n", F.lit(None).cast("string").alias("bad")), fields, now)

    def restore(self, wanted: DataFrame, now: float) -> DataFrame:
        """Puts rows back to a version: wanted (n, version, revision expected); gives conflicts: id, n, why.

        What a row was before is a version too, so a restore can be undone. why: as for edit(), and unknown (no such
        version; its id is null).
        """
        fields = [f for f in self.schema.fieldNames() if f not in ("id", "revision")]
        old = self.versions().select("version", F.col("target").alias("id"), F.from_json("state", self.schema).alias("_old"))
        both = wanted.join(old, "version", "left")
        new = F.struct(*[F.col(f"_old.{f}").alias(f) for f in fields])
        return self._apply(both.select("id", "revision", new.alias("set"), "n", F.when(F.col("id").isNull(), "unknown").alias("bad")), fields, now)

    def purge(self, ids: DataFrame, others: dict[str, tuple[DataFrame, str]]) -> dict[str, DataFrame]:
        """Takes ``ids`` (id) out for good, versions included, and gives ``others`` (a frame and its column of ids) without them."""
        gone = written(ids.select("id").where("id IS NOT NULL").distinct().withColumn("_bucket", self._bucket()), "gone")
        touched = sorted(r[0] for r in gone.select("_bucket").distinct().collect())
        left, old = self.versions().join(gone.select(F.col("id").alias("target")), "target", "left_anti"), self.logs
        log = f"versions-{self.step}"
        left.select("version", "target", "revision", "at", "state").write.parquet(f"{self.path}/{log}")
        self.logs = [log]
        self._put(self.rows(touched).join(gone.select("id"), "id", "left_anti").select(*self.schema.fieldNames()), touched)
        for f in old:
            drop(self.spark, f"{self.path}/{f}")
        return {name: df.join(gone.select(F.col("id").alias(key)), key, "left_anti").select(*df.columns) for name, (df, key) in others.items()}
