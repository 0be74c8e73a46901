"""Sources of older stores: one entry a line, TOML trees, JSON profiles; and idempotent ingest."""

from __future__ import annotations

import json
import tomllib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.cleaning import rejection

MOST_BYTES = 2 << 20
ENTRY = "path string, modified timestamp, key string, text string, category string"


def lines(spark: SparkSession, path: str) -> DataFrame:
    """An entry for each line that isn't blank; # starts a comment."""
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_modification_time").alias("modified"), F.trim("value").alias("text"))
    return rows.where("text <> '' AND NOT startswith(text, '#')").select("path", "modified", F.sha2("text", 256).alias("key"), "text", F.lit("event").alias("category"))


def _documents(spark: SparkSession, path: str, parse) -> DataFrame:
    """Entries of all files; a file that isn't of the format, or too large, is one entry without a text, whose category says
    so and which ingest() reports."""
    every = spark.read.format("binaryFile").load(path)
    files = every.where(F.col("length") <= MOST_BYTES).select("path", F.col("modificationTime").alias("modified"), "content")
    large = every.where(F.col("length") > MOST_BYTES).select("path", F.col("modificationTime").alias("modified"), F.lit("").alias("key"), F.lit(None).cast("string").alias("text"), F.lit("too_large").alias("category"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for p, m, raw in zip(batch["path"], batch["modified"], batch["content"]):
                try:
                    out += [(p, m, k, t, c) for k, t, c in parse(bytes(raw).decode())]
                except ValueError:
                    out.append((p, m, "", None, "unreadable"))
            yield pd.DataFrame(out, columns=["path", "modified", "key", "text", "category"])

    return files.mapInPandas(run, ENTRY).unionByName(large)


def _leaves(value, key: str = ""):
    if isinstance(value, dict):
        for k, v in value.items():
            yield from _leaves(v, f"{key}.{k}" if key else str(k))
    elif isinstance(value, list):
        for k, v in enumerate(value):
            yield from _leaves(v, f"{key}.{k}")
    elif isinstance(value, str):
        yield key, value


def toml_trees(spark: SparkSession, path: str) -> DataFrame:
    """An entry for each text in the tables of TOML files, keyed by its path in them."""
    return _documents(spark, path, lambda s: [(k, t, k.split(".")[0]) for k, t in _leaves(tomllib.loads(s))])


# Sections of a profile and the categories of what they hold.
SECTIONS = {"name": "profile", "traits": "profile", "aliases": "profile", "facts": "profile", "preferences": "preference", "relationships": "relationship"}


def json_profiles(spark: SparkSession, path: str) -> DataFrame:
    """Profiles flattened to entries; one of an unknown section has no text and the category unknown_section."""

    def parse(s: str):
        for k, text in _leaves(json.loads(s)):
            section = SECTIONS.get(k.split(".")[0])
            yield (k, text, section) if section else (k, None, "unknown_section")

    return _documents(spark, path, lambda s: list(parse(s)))


def newest(spark: SparkSession, path: str) -> DataFrame:
    """One row: when the newest file below ``path`` (core.txt, *.toml, profile.json) was changed, null without any."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "modificationTime")
    return files.where(F.col("path").rlike(r"(/core\.txt|\.toml|/profile\.json)$")).agg(F.max("modificationTime").alias("newest"))


def location(relative: Column, session: Column) -> Column:
    """struct<sid, visibility, subject, users> that a file's relative path and its header's session stand for."""
    p = F.split(relative, "/")
    s = F.split(session, ":", 3)
    named = (F.size(s) == 3) & ~F.exists(s, lambda x: x == "") & F.get(s, F.lit(1)).isin("dm", "gm", "pm")
    sid = F.when(named, F.concat_ws(":", s[0], F.when(s[1] == "pm", "dm").otherwise(s[1]), s[2])).otherwise("legacy:unscoped")
    folder = F.coalesce(F.get(p, F.lit(1)), F.lit(""))
    kind, entity = F.substring_index(folder, "_", 1), F.when(F.contains(folder, F.lit("_")), F.url_decode(F.regexp_replace(folder, "^[^_]*_", ""))).otherwise("")
    whole = entity.rlike(r"^[^:\s]+:[^\s]+$")
    group = F.concat_ws(":", F.substring_index(entity, ":", 1), F.lit("gm"), F.regexp_replace(entity, "^[^:]*:", ""))
    own = F.when((kind == "group") & whole, group).otherwise(sid)
    as_user, of_all = (kind == "user") & whole, p[0] == "global"
    pick = lambda a, b, c: F.when(of_all, a).when(as_user, b).otherwise(c)
    none = F.array().cast("array<string>")
    return F.struct(
        pick(F.lit("legacy:global"), F.concat(F.lit("legacy:user:"), entity), own).alias("sid"), pick(F.lit("global"), F.lit("user"), F.lit("session")).alias("visibility"),
        pick(F.when(F.array_contains(p, "self"), "legacy:self").otherwise("legacy:global"), entity, F.when(entity != "", F.concat_ws(":", F.lit("legacy"), kind, entity)).otherwise(own)).alias("subject"),
        pick(none, F.array(entity), none).alias("users"),
    )


def ingest(entries: DataFrame, ledger: DataFrame, source: str, limit: int = 4000) -> tuple[DataFrame, DataFrame]:
    """New entries, once each, and the report by reason; what the ledger (source, key, digest) knows is skipped.

    Gives (id, key, text, category) and (reason, n) with the reasons imported, duplicate and those of rejection().
    """
    told = entries.withColumn("digest", F.sha2(F.trim(F.coalesce("text", F.lit(""))), 256)).withColumn("reason", rejection(F.col("text"), limit))
    good = told.where("reason IS NULL")
    once = good.dropDuplicates(["key", "digest"])
    known = ledger.where(F.col("source") == source).select("key", "digest")
    fresh = once.join(known, ["key", "digest"], "left_anti")
    new = fresh.select(F.sha2(F.concat_ws("\x1f", F.lit(source), "key", "digest"), 256).alias("id"), "key", F.trim("text").alias("text"), "category")
    count = lambda df, reason, n: df.select(F.lit(reason).alias("reason"), F.lit(n).cast("long").alias("n"))
    counts = count(fresh, "imported", 1).unionByName(count(good, "duplicate", 1)).unionByName(count(fresh, "duplicate", -1))
    counts = counts.unionByName(told.where("reason IS NOT NULL").select("reason", F.lit(1).cast("long").alias("n")))
    return new, counts.groupBy("reason").agg(F.sum("n").alias("n"))


def export(tables: dict[str, DataFrame], path: str) -> None:
    """All tables as JSON lines, a folder each."""
    for name, df in tables.items():
        df.write.mode("overwrite").json(f"{path}/{name}")


def log_decisions(decisions: DataFrame, path: str) -> None:
    """Appends decisions as JSON lines."""
    decisions.write.mode("append").json(path)
