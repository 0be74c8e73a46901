"""Consolidation: what to fold, folding it, verdicts to groups, taking merges apart."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SEPARATOR = "；"


@dataclass(frozen=True)
class FoldSettings:
    rounds: int = 12  # closed rounds of a session before its messages are folded
    threshold: int = 50  # messages before folding by count
    batch: int = 40
    upper_threshold: int = 4  # archives of a level before they are folded
    upper_batch: int = 3
    max_level: int = 8
    max_chars: int = 20_000
    by_rounds: bool = True
    stale_days: float = 3  # with idle_hours: how old and how quiet a session must be for a boost
    idle_hours: float = 6


def fold_plan(records: DataFrame, settings: FoldSettings = FoldSettings(), now: float | None = None) -> DataFrame:
    """Which rows of each session fold next: sid, id, ordinal, target_level.

    The lowest level that has enough rows folds, of its visibilities the one with most. Messages fold by whole closed rounds
    (one closes before a user's row that follows another's) within the character budget, the first round in any case; or by
    count, to the end of the round then open. Archives fold by count. With ``now`` a boost: sessions with an old row and
    nothing new fold from one closed round on, or their first messages if there is none. Permanent, inactive and deleted
    rows stay. Running sums over each session's level and visibility, and one aggregation; no Python.
    """
    c = settings
    live = records.where("active = 1 AND deleted = 0")
    key, order = ["sid", "level", "visibility"], [F.col("position"), F.col("id")]
    w = Window.partitionBy(*key).orderBy(*order)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    closes = (F.col("role") == "user") & (F.lag("role").over(w) != "user")
    rows = live.where(F.col("permanent") == 0).where(F.col("level") < c.max_level)
    rows = rows.select("sid", "id", "role", "level", "visibility", F.row_number().over(w).alias("n"), F.coalesce(closes, F.lit(False)).alias("closes"), F.sum(F.length("content")).over(upto).alias("chars"), F.length("content").alias("size"))
    end, before = F.when(F.col("closes"), F.col("n") - 1), F.col("chars") - F.col("size")
    parts = rows.groupBy(*key).agg(
        F.count("*").alias("rows"), F.count(end).alias("closed"), F.min(end).alias("first"), F.max(F.when(before <= c.max_chars, end)).alias("fits"),
        F.min(F.when(F.col("n") > c.batch, end)).alias("over"), F.some(F.col("role") == "assistant").alias("answered"), F.max(F.when((F.col("chars") <= c.max_chars) | (F.col("n") == 1), F.col("n"))).alias("budget"),
    )
    if now is None:
        parts = parts.withColumn("boost", F.lit(False))
    else:
        times = live.select("sid", F.coalesce("end", "start").alias("t")).groupBy("sid").agg(F.min("t").alias("oldest"), F.max("t").alias("newest"))
        stale, idle = F.col("oldest") < now - c.stale_days * 86400, F.col("newest") < now - c.idle_hours * 3600
        wake = stale & idle if c.stale_days and c.idle_hours else (stale & F.lit(c.stale_days > 0)) | (idle & F.lit(c.idle_hours > 0))
        parts = parts.join(times, "sid").withColumn("boost", F.coalesce(wake, F.lit(False)))
    leaf = F.col("level") == 0
    by_rounds = F.when(F.col("closed") >= F.when(F.col("boost"), 1).otherwise(c.rounds), F.coalesce("fits", "first")).when(F.col("boost") & (F.col("closed") == 0), F.least(F.lit(c.batch), F.col("rows"), F.col("budget")))
    by_count = F.when(F.col("rows") >= c.threshold, F.least(F.when(F.col("answered"), F.coalesce("over", "rows")).otherwise(c.batch), F.col("budget")))
    upper = F.when(F.col("rows") >= c.upper_threshold, F.least(F.lit(c.upper_batch), F.col("budget")))
    some = parts.withColumn("take", F.when(leaf, by_rounds if c.by_rounds else by_count).otherwise(upper)).where("take > 0")
    chosen = some.groupBy("sid").agg(F.min(F.struct("level", (-F.col("rows")).alias("m"), "visibility", "take")).alias("x")).select("sid", "x.level", "x.visibility", "x.take")
    return rows.join(chosen, key).where("n <= take").select("sid", "id", (F.col("n") - 1).alias("ordinal"), (F.col("level") + 1).alias("target_level"))


def fold(records: DataFrame, plan: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Archives of a plan (sid, level, start, end, position, users, children) and edges (parent, child, ordinal)."""
    rows = records.join(plan, ["sid", "id"])
    users = F.array_sort(F.array_distinct(F.flatten(F.collect_list("users"))))
    archives = rows.groupBy("sid", F.col("target_level").alias("level")).agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.min("position").alias("position"), users.alias("users"), F.count("*").alias("children"), F.array_sort(F.collect_list(F.struct("ordinal", "id"))).alias("kids"), F.first("visibility").alias("visibility")
    )
    archives = archives.withColumn("id", F.sha2(F.concat_ws("|", "sid", F.col("level").cast("string"), F.concat_ws(",", F.transform("kids", lambda k: k.id))), 256))
    edges = archives.select(F.col("id").alias("parent"), F.inline("kids").alias("ordinal", "child"))
    return archives.drop("kids"), edges


def pair_verdicts(groups: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Assigns verdicts (batch, verdict, target_id, source_ids) to groups (batch, grp, id, time) of their batch.

    A verdict may go to groups that hold its target, best of all, or one of its sources, the more the better, then by grp.
    Verdicts choose in their order and a group is given once. Of a verdict's sources those of its group stay, with the
    group's newest member before them if it isn't there; a target that isn't a member becomes the newest. Gives batch,
    verdict, grp (null: no group), target_id, source_ids. Matches come from joins on ids; only their order of choice,
    a few rows a batch, is a walk.
    """
    named = verdicts.select("batch", "verdict", F.explode(F.array_distinct(F.coalesce("source_ids", F.array().cast("array<string>")))).alias("id"))
    met = named.join(groups.select("batch", "grp", "id"), ["batch", "id"]).groupBy("batch", "verdict", "grp").agg(F.countDistinct("id").alias("shared"), F.lit(0).alias("aimed"))
    aimed = verdicts.select("batch", "verdict", F.col("target_id").alias("id")).join(groups.select("batch", "grp", "id").distinct(), ["batch", "id"]).select("batch", "verdict", "grp", F.lit(0).cast("long").alias("shared"), F.lit(1).alias("aimed"))
    matches = met.unionByName(aimed).groupBy("batch", "verdict", "grp").agg(F.max("aimed").alias("aimed"), F.max("shared").alias("shared"))
    lists = matches.groupBy("batch").agg(F.array_sort(F.collect_list(F.struct("verdict", (-F.col("aimed")).alias("a"), F.when(F.col("aimed") == 1, 0).otherwise(-F.col("shared")).alias("s"), "grp"))).alias("x"))
    start = F.struct(F.array().cast("array<int>").alias("v"), F.array().cast("array<string>").alias("g"))
    taken = F.aggregate("x", start, lambda s, m: F.when(F.array_contains(s.v, m.verdict) | F.array_contains(s.g, m.grp), s).otherwise(F.struct(F.array_append(s.v, m.verdict).alias("v"), F.array_append(s.g, m.grp).alias("g"))))
    given = lists.select("batch", taken.alias("t")).select("batch", F.explode(F.arrays_zip("t.v", "t.g")).alias("z")).select("batch", F.col("z.v").alias("verdict"), F.col("z.g").alias("grp"))
    members = groups.groupBy("batch", "grp").agg(F.collect_set("id").alias("ids"), F.array_min(F.collect_list(F.struct((-F.col("time")).alias("t"), "id"))).alias("first"))
    both = verdicts.join(given, ["batch", "verdict"], "left").join(members, ["batch", "grp"], "left")
    sources, newest = F.coalesce("source_ids", F.array().cast("array<string>")), F.col("first.id")
    own = F.filter(sources, lambda i: F.array_contains("ids", i))
    return both.select(
        "batch", "verdict", "grp",
        F.when(F.col("grp").isNull() | F.array_contains("ids", F.col("target_id")), F.col("target_id")).otherwise(newest).alias("target_id"),
        F.when(F.col("grp").isNull(), sources).when(F.array_contains(own, newest), own).otherwise(F.concat(F.array(newest), own)).alias("source_ids"),
    )


def take_apart(merged: DataFrame, versions: DataFrame) -> DataFrame:
    """The facts whose texts, joined by the separator, begin a merged text: target, id, content, ordinal.

    merged (id, content), versions (target, id, content): earlier states of facts folded into target, by the order of id.
    A fold in the JVM keeps the place reached in the merged text and what lies before it; a text fits if the merged one
    goes on with it there. Fewer than two facts, or without the target itself, give nothing; empty texts never fit.
    """
    both = versions.where("content <> ''").groupBy("target").agg(F.array_sort(F.collect_list(F.struct("id", "content"))).alias("olds"))
    both = both.join(merged.select(F.col("id").alias("target"), F.col("content").alias("whole")), "target")
    rest = lambda s, c: F.col("whole").substr(s.at, F.length(c))
    free = lambda s: F.filter(F.transform(F.col("olds"), lambda o, k: F.struct(k.alias("k"), o.id.alias("id"), o.content.alias("content"))), lambda o: ~F.array_contains(s.used, o.k) & (rest(s, o.content) == o.content))

    def lay(s, _):
        hit = F.try_element_at(free(s), F.lit(1))
        return F.when(hit.isNull(), s).otherwise(F.struct((s.at + F.length(hit.content) + len(SEPARATOR)).alias("at"), F.array_append(s.used, hit.k).alias("used")))

    laid = F.aggregate(F.sequence(F.lit(1), F.size("olds")), F.struct(F.lit(1).alias("at"), F.array().cast("array<int>").alias("used")), lay)
    picked = both.select("target", "whole", F.transform(laid.used, lambda k: F.get("olds", k)).alias("x"))
    whole = F.startswith("whole", F.array_join(F.transform("x", lambda o: o.content), SEPARATOR))
    good = picked.where((F.size(F.array_distinct(F.transform("x", lambda o: o.id))) >= 2) & F.exists("x", lambda o: o.id == F.col("target")) & whole)
    return good.select("target", F.posexplode("x").alias("ordinal", "o")).select("target", "o.id", "o.content", "ordinal")
