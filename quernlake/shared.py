"""The folder that driver and executors share, tables written to it, and joins that spread hot keys."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MOST_HOT = 1000  # keys that hot_join() broadcasts, at most


def _at_exit(spark: SparkSession, path: str) -> None:
    """Has ``path`` removed when the application ends."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)


def shared_dir(spark: SparkSession) -> str:
    """The folder spark.checkpoint.dir; where that is unset, on a single machine, a temporary one of our own.

    On a cluster an unset folder is an error, as no folder of one machine would do.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    defined = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not root and not defined.isDefined():
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="quernlake-")
        _at_exit(spark, root)
    if not defined.isDefined():
        spark.sparkContext.setCheckpointDir(root)
        _at_exit(spark, spark.sparkContext._jsc.sc().getCheckpointDir().get())
    return root or defined.get()


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the application ends."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _at_exit(spark, path)
    return path


def drop(spark: SparkSession, path: str) -> None:
    """Removes what is no longer read."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def cut(df: DataFrame) -> DataFrame:
    """``df`` checkpointed in the shared folder: its lineage ends there, and its partitions stay as they are."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def kept(df: DataFrame, name: str = "table") -> tuple[DataFrame, str]:
    """``df`` written to the shared folder as Parquet and read again, made once and read by column; and its path."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """kept() without the path."""
    return kept(df, name)[0]


def hot_join(big: DataFrame, small: DataFrame, on: list[str], count: str, total: int) -> DataFrame:
    """The inner join of ``big`` with ``small``, which has each key once and in ``count`` how many rows of ``big`` hold it.

    Keys held by over ``total`` / 1000 of all ``total`` rows, fewer than 1000 then, are broadcast, so that a hot key's rows
    stay where they are; the rest, of no bounded size, is joined by shuffle whatever it is here. Both sides are read twice.
    """
    hot = F.col(count) > max(1, total // MOST_HOT)
    few = small.where(hot)
    spread = big.join(F.broadcast(few), on)
    return spread.unionByName(big.join(F.broadcast(few.select(*on)), on, "left_anti").join(small.where(~hot).hint("merge"), on))
