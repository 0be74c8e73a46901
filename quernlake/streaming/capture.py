"""Streams: messages taken in once, names that keep their latest observation, windows, what was delivered lately."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.window import Window


def capture(messages: DataFrame, late: str = "1 hour") -> DataFrame:
    """Messages (event_key, ts, ...) once for each event_key; one delivered again within ``late`` is dropped."""
    return messages.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_key"])


def _there(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def capture_batch(batch: DataFrame, path: str, name: str, before: str | None) -> None:
    """Files the rows of one batch (event_key, sid, ts, ...) that the table in ``path`` doesn't have, with their position.

    The table lies by batch and day of ts: keys are looked for on the batch's own days alone, as a message that comes again
    has its time again. Positions go on from a small table of the last one of each session, written anew after each batch;
    ``before`` names the batch whose table holds. A batch that runs again writes over what it wrote, and so files the same.
    """
    spark = batch.sparkSession
    rows = batch.where("event_key IS NOT NULL").withColumn("day", F.to_date("ts"))
    first = rows.groupBy("event_key").agg(F.min_by(F.struct(*rows.columns), F.struct("ts", "sid")).alias("x")).select("x.*")
    days = [r["day"] for r in first.select("day").distinct().collect()]  # of a batch
    if _there(spark, f"{path}/rows"):
        known = spark.read.schema(T.StructType([*first.schema, T.StructField("batch", T.StringType())])).option("basePath", f"{path}/rows").parquet(f"{path}/rows")
        first = first.join(known.where((F.col("batch") != name) & F.col("day").isin(days)).select("event_key"), "event_key", "left_anti")
    last = spark.read.schema("sid string, last long").parquet(f"{path}/last/{before}") if before else spark.createDataFrame([], "sid string, last long")
    after = F.row_number().over(Window.partitionBy("sid").orderBy("ts", "event_key"))
    placed = first.join(last.withColumnRenamed("sid", "_sid"), F.col("sid").eqNullSafe(F.col("_sid")), "left").select(first["*"], (F.coalesce("last", F.lit(-1)) + after).cast("long").alias("position"))
    placed.write.mode("overwrite").partitionBy("day").parquet(f"{path}/rows/batch={name}")
    new = spark.read.schema(placed.schema).parquet(f"{path}/rows/batch={name}").groupBy("sid").agg(F.max("position").alias("last"))
    last.unionByName(new).groupBy("sid").agg(F.max("last").alias("last")).write.mode("overwrite").parquet(f"{path}/last/{name}")


def capture_to(messages: DataFrame, path: str, checkpoint: str):
    """Writes messages (event_key, sid, ts, ...) below ``path``, each event_key once for good, with gapless positions by session.

    A restart at the same checkpoint runs its open batch again, to the same effect; a new checkpoint at the same table
    files nothing twice. Rows without a key are left out. captured() reads the table.
    """
    run = hashlib.sha256(checkpoint.encode()).hexdigest()[:12]

    def write(batch: DataFrame, number: int) -> None:
        spark, order = batch.sparkSession, f"{path}/order"
        done = [r[0] for r in spark.read.text(order).collect()] if _there(spark, order) else []  # a line for each batch
        name = f"{run}-{number}"
        earlier = [x for x in sorted(done) if x.rpartition(" ")[2] != name]
        capture_batch(batch, path, name, earlier[-1].rpartition(" ")[2] if earlier else None)
        if len(earlier) == len(done):
            spark.createDataFrame([(f"{len(done):012d} {name}",)], "value string").coalesce(1).write.mode("append").text(order)

    return messages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def captured(spark: SparkSession, path: str) -> DataFrame:
    """All messages that capture_to() filed, with position, batch and day."""
    return spark.read.parquet(f"{path}/rows")


def latest_names(observations: DataFrame) -> DataFrame:
    """The name of the latest observation of each entity (entity, name, ts); older ones that come late change nothing."""
    good = observations.where((F.length("name").between(1, 500)) & ~F.col("name").rlike(r"[\x00-\x1f]"))
    return good.groupBy("entity").agg(F.max_by("name", F.struct("ts", "name")).alias("name"), F.max("ts").alias("observed"))


def event_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def event_sessions(events: DataFrame, gap: str = "6 hours", late: str = "10 minutes") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))


def not_delivered(results: DataFrame, ttl_seconds: int = 1800, most: int = 300, late: str = "1 hour") -> DataFrame:
    """Of results (session, id, ts) those not delivered to the session within the last ``ttl_seconds``.

    A session remembers its latest ``most`` ids; its state goes once the watermark is past the life of all.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        ids, times = map(list, state.get) if state.exists else ([], [])
        seen, out = dict(zip(ids, times)), []
        for batch in batches:
            for i, ts in batch.sort_values(["ts", "id"])[["id", "ts"]].itertuples(index=False):
                at = ts.timestamp()
                if at - seen.get(i, -1e18) > ttl_seconds:
                    out.append((key[0], i, ts))
                    seen.pop(i, None)
                    seen[i] = at
        kept = list(seen.items())[-most:]
        state.update(([i for i, _ in kept], [t for _, t in kept]))
        over = int((max(t for _, t in kept) + ttl_seconds) * 1000) if kept else 0
        state.setTimeoutTimestamp(max(over, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["session", "id", "ts"])

    return results.withWatermark("ts", late).groupBy("session").applyInPandasWithState(step, "session string, id string, ts timestamp", "ids array<string>, times array<double>", "append", GroupStateTimeout.EventTimeTimeout)
