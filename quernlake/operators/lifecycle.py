"""Lifecycle as whole-table rewrites: versions, trash, cold bodies, rotation, audits, identities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .records import over_cap


def edit(rows: DataFrame, patches: DataFrame, fields: list[str], key: str = "id") -> tuple[DataFrame, DataFrame]:
    """Applies patches (key, revision, new_<field>...) whose revision is the row's; gives the new table and the versions.

    A field that a patch leaves null stays. Versions hold the row as it was, as JSON. One patch a key.
    """
    p = patches.select(key, F.col("revision").alias("_expected"), *[f"new_{f}" for f in fields])
    both = rows.join(p, key, "left")
    hit = F.coalesce(F.col("revision") == F.col("_expected"), F.lit(False))
    versions = both.where(hit).select(F.col(key).alias("target"), F.col("revision"), F.to_json(F.struct(*rows.columns)).alias("snapshot"))
    out = [F.when(hit, F.coalesce(f"new_{c}", c)).otherwise(F.col(c)).alias(c) if c in fields else (F.col(c) + hit.cast("int")).alias(c) if c == "revision" else F.col(c) for c in rows.columns]
    return both.select(*out), versions


def restore(rows: DataFrame, versions: DataFrame, key: str = "id") -> DataFrame:
    """Rows with a version are put back to the latest one; their revision rises by one."""
    last = versions.groupBy("target").agg(F.max_by("snapshot", "revision").alias("_snapshot"))
    old = F.from_json("_snapshot", rows.schema)
    both = rows.join(last, rows[key] == last["target"], "left").withColumn("_old", old)
    cols = [(F.col("revision") + F.col("_snapshot").isNotNull().cast("int")).alias(c) if c == "revision" else F.when(F.col("_snapshot").isNotNull(), F.col(f"_old.{c}")).otherwise(rows[c]).alias(c) for c in rows.columns]
    return both.select(*cols)


def purge(tables: dict[str, tuple[DataFrame, str]], ids: DataFrame) -> dict[str, DataFrame]:
    """Takes ``ids`` (id) out of all tables (frame, its key column): hard delete with its cascade."""
    gone = ids.select(F.col("id").alias("_gone")).distinct()
    return {name: df.join(gone, df[key] == gone["_gone"], "left_anti") for name, (df, key) in tables.items()}


def spill_cold(rows: DataFrame, now: float, days: int = 180) -> tuple[DataFrame, DataFrame]:
    """The hot table with the bodies of old cold and deleted rows blank, and those bodies (record_id, content, moved_at)."""
    old = (F.col("cold") == 1) & ((F.coalesce("archived_at", F.lit(0.0)) == 0) | (F.col("archived_at") <= now - days * 86400))
    moves = F.coalesce((old | (F.col("deleted") == 1)) & (F.trim("content") != ""), F.lit(False))
    return rows.withColumn("content", F.when(moves, "").otherwise(F.col("content"))), rows.where(moves).select(F.col("id").alias("record_id"), "content", F.lit(float(now)).alias("moved_at"))


def fill_cold(rows: DataFrame, cold: DataFrame) -> DataFrame:
    """Bodies read back where they are blank."""
    kept = cold.select(F.col("record_id"), F.col("content").alias("_cold"))
    return rows.join(kept, rows["id"] == kept["record_id"], "left").withColumn("content", F.coalesce(F.nullif(F.trim("content"), F.lit("")), "_cold", F.lit(""))).select(rows.columns)


def cold_stats(rows: DataFrame, cold: DataFrame) -> DataFrame:
    """One row: rows without a body that the cold store has (moved), bodies there in all and their bytes, and those that no row
    asks for any more (stray)."""
    blank = rows.where(F.coalesce(F.trim("content"), F.lit("")) == "").select(F.col("id").alias("record_id"), F.lit(1).alias("moved"))
    known = rows.select(F.col("id").alias("record_id"), F.lit(1).alias("known"))
    both = cold.join(blank, "record_id", "left").join(known, "record_id", "left")
    return both.agg(F.count("moved").alias("moved"), F.count("*").alias("bodies"), F.coalesce(F.sum(F.octet_length("content")), F.lit(0)).cast("long").alias("bytes"), F.count_if(F.col("known").isNull()).alias("stray"))


def restore_cold(rows: DataFrame, cold: DataFrame, ids: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Bodies of ``ids`` (id; all without) back in their rows where those are blank, and the cold store without them."""
    asked = cold if ids is None else cold.join(ids.select(F.col("id").alias("record_id")).distinct(), "record_id", "left_semi")
    back = asked.join(rows.where(F.coalesce(F.trim("content"), F.lit("")) == "").select(F.col("id").alias("record_id")), "record_id", "left_semi").select("record_id", "content")
    return fill_cold(rows, back), cold.join(back.select("record_id"), "record_id", "left_anti")


def cold_preview(rows: DataFrame, now: float, days: int = 180) -> DataFrame:
    """One row: how many bodies spill_cold() would move, their bytes, and the oldest and newest end of their rows."""
    moved = spill_cold(rows, now, days)[1].join(rows.select(F.col("id").alias("record_id"), "end"), "record_id")
    return moved.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("content")), F.lit(0)).cast("long").alias("bytes"), F.min("end").alias("oldest"), F.max("end").alias("newest"))


def within_cap(records: DataFrame, facts: DataFrame, now: float, most: int = 30, chars: int = 5000) -> tuple[DataFrame, DataFrame]:
    """Pinned rows that are over their session's caps (over_cap()) let go, and what they say kept as facts.

    Gives the records, those rows no longer pinned nor live, revision up by one; and facts (id, sid, subject, content,
    importance, created, sources): a live one of the same session and text takes the row among its sources, else there is
    a new one with the row as its source. Afterwards nothing is over the cap.
    """
    over = over_cap(records, most, chars).select("id", F.lit(True).alias("_over"))
    both = records.join(over, "id", "left")
    hit = F.coalesce("_over", F.lit(False))
    change = {"permanent": F.lit(0), "active": F.lit(0), "archived_at": F.lit(float(now)), "revision": F.col("revision") + 1}
    left = both.select(*[F.when(hit, change[c]).otherwise(F.col(c)).alias(c) if c in change else F.col(c) for c in records.columns])
    said = both.where(hit).groupBy("sid", "content").agg(F.array_sort(F.collect_set("id")).alias("more"), F.max("importance").alias("_i"), F.min(F.get("users", F.lit(0))).alias("_s"))
    same = facts.where("deleted = 0").groupBy("sid", "content").agg(F.min("id").alias("id"))
    told = said.join(same, ["sid", "content"], "left")
    kept = facts.where("deleted = 0").select("id", "sid", "subject", "content", "importance", "created", "sources").join(told.where("id IS NOT NULL").select("id", "more", "_i"), "id", "left")
    kept = kept.select("id", "sid", "subject", "content", F.greatest("importance", F.coalesce("_i", "importance")).alias("importance"), "created", F.array_distinct(F.concat("sources", F.coalesce("more", F.array().cast("array<string>")))).alias("sources"))
    new = told.where("id IS NULL").select(F.sha2(F.concat_ws("\x1f", F.lit("extracted"), "sid", "content"), 256).alias("id"), "sid", F.col("_s").alias("subject"), "content", F.col("_i").alias("importance"), F.lit(float(now)).alias("created"), F.col("more").alias("sources"))
    return left, kept.unionByName(new)


def orphans(facts: DataFrame, records: DataFrame) -> DataFrame:
    """Facts that cite records of which none is live any more."""
    cited = facts.select(F.col("id"), F.explode("sources").alias("source"))
    live = records.where("deleted = 0").select(F.col("id").alias("source"))
    return facts.join(cited.select("id").distinct(), "id", "left_semi").join(cited.join(live, "source", "left_semi").select("id").distinct(), "id", "left_anti")


def rotation_counts(events: DataFrame) -> DataFrame:
    """shown, used and the last use of each item from an append-only log (item, kind, at)."""
    return events.groupBy("item").agg(F.count_if(F.col("kind") == "shown").alias("shown"), F.count_if(F.col("kind") == "used").alias("used"), F.max(F.when(F.col("kind") == "used", F.col("at"))).alias("used_at"))


def rotation_order(items: DataFrame, counts: DataFrame, k: int) -> DataFrame:
    """The ``k`` items (item, position) whose turn it is: unseen ones, then the most used for their showings, the least
    shown, and their own order. counts: rotation_counts()."""
    both = items.join(counts.select("item", "shown", "used"), "item", "left").fillna(0, ["shown", "used"])
    ratio = F.when(F.col("shown") > 0, F.col("used") / F.col("shown")).otherwise(0.0)
    return both.orderBy(F.col("shown") > 0, F.desc(ratio), "shown", "position").limit(k)


def resolve_identities(ids: DataFrame, known: DataFrame) -> DataFrame:
    """Maps ids of the shape legacy:user:<number> to the one known adapter:<number>; ambiguous and unknown ones stay.

    ids (id), known (id): gives id, resolved.
    """
    number = F.substring_index("id", ":", -1)
    one = known.where(F.col("id").rlike(r"^[^:]+:[^:]+$")).select(number.alias("number"), "id").distinct().groupBy("number").agg(F.count("*").alias("n"), F.min("id").alias("target")).where("n = 1")
    pending = ids.withColumn("number", F.when(F.col("id").rlike("^(legacy|unresolved):user:"), number))
    return pending.join(one, "number", "left").select("id", F.coalesce("target", "id").alias("resolved"))


def route_merge(same, new, dilute):
    """keep, drop, merge or inherit by three scores: low likeness keeps, doubtful likeness is left to others."""
    return (
        F.when(same.isNull() | (same <= 0.12), "keep").when(same < 0.5, "inherit").when(new.isNull(), "keep").when(new < 0.6, "drop").when(dilute < 0.75, "merge").otherwise("keep")
    )
