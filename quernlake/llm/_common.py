"""What the operators of this package share: tables, bounded memos, labelled rows."""

from __future__ import annotations

import ctypes
import gc

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import cut, drop, hot_join, kept, scratch, shared_dir, written  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` below ``sf_dir``; any path that Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, *more) -> DataFrame:
    """doc_id and text of ``docs``, null text as empty, all else left out but ``more``."""
    return docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"), *more)


def free_names(df: DataFrame, *names: str) -> list[str]:
    """``names``, each with as many underscores before it as no column of ``df`` has, in whatever letters."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name in taken:
            name = f"_{name}"
        out.append(name)
    return out


_stores: dict[str, dict] = {}
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # in glibc alone


def store(owner: str) -> dict:
    """What the operator ``owner`` remembers from task to task in this Python worker; what others remember goes.

    Spark's workers go on from one stage of a pipeline to the next, and would else hold the memos of all stages. Memory
    that is let go is given back to the system.
    """
    if owner not in _stores:
        _stores.clear()
        gc.collect()
        if _trim:
            _trim(0)
        _stores[owner] = {}
    return _stores[owner]


class Memo(dict):
    """Remembers at most two generations of ``limit`` entries: as one fills up, the older goes.

    ``make(keys)`` gives the values of a list of distinct keys; ``fill(keys)`` sees to it that all keys are in the dict,
    so that a plain lookup suffices afterwards.
    """

    def __init__(self, make, limit: int = 250_000):
        super().__init__()
        self.make, self.limit, self.old = make, limit, {}

    def lookup(self, keys: list) -> list:
        """The values of ``keys``, none of which may be None."""
        self.fill(keys)
        return list(map(self.__getitem__, keys))

    def fill(self, keys) -> None:
        keys = set(keys)
        need = [k for k in keys if k not in self]  # set.difference() would walk through a dict's subclass
        if not need:
            return
        if len(self) + len(need) > self.limit:
            self.old = dict(self)
            self.clear()
            need = keys
        old, new = self.old, []
        for k in need:
            if k in old:
                self[k] = old[k]
            else:
                new.append(k)
        if new:
            self.update(zip(new, self.make(new), strict=True))


def fold(mod: int):
    """crc32 of doc_id as text, modulo ``mod``; null for a null doc_id."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(mod))


def labelled(docs: DataFrame, labels: DataFrame, label: str, mod: int, held_out: int, rows: dict[int, int]) -> DataFrame:
    """At most rows[v] documents whose label is v, outside the fold ``held_out``: doc_id, y, text.

    Which ones, a hash of doc_id decides, so that every part of the table is met. Only the chosen ids, a bounded number,
    are broadcast. An id labelled twice takes its larger label, one with several texts the least; null ids and labels are
    left out.
    """
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (fold(mod) != held_out))
    known = known.groupBy("doc_id").agg(F.max(label).alias("y"))
    chosen = None
    for v, n in rows.items():
        part = known.where(F.col("y") == v).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
        chosen = part if chosen is None else chosen.unionByName(part)
    return texts(docs).join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))
