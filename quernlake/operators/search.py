"""One search over records with all its filters; narrow rows are ranked, bodies fetched for the page alone."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import cleaning as C
from ..functions import exprs as X
from ..shared import written
from . import records as R
from . import retrieval as V
from .textindex import TextIndex

WIDEST = 200  # rows that a page is picked from at most


@dataclass(frozen=True)
class Ask:
    """What is asked for: who asks (sid, users, scope), filters, what to rank by (lexical, vector), preference, and the page."""

    sid: str = ""
    users: tuple[str, ...] = ()
    scope: str = "session"
    strict_session: bool = False
    keyword: str = ""
    level: int | None = None
    start: float | None = None
    end: float | None = None
    subject: str = ""
    active: bool = False
    exclude_sid: str = ""
    exclude_ids: tuple[str, ...] = ()
    include_cold: bool = False
    cold_days: float = 0
    skip_media: bool = True
    include_tools: bool = False
    lexical: str = ""
    expand: bool = True
    vector: tuple[float, ...] = ()
    model: str = ""
    prefer_sid: str = ""
    prefer_users: tuple[str, ...] = ()
    limit: int = 30
    offset: int = 0


def _array(values) -> Column:
    return F.array(*map(F.lit, values)).cast("array<string>")


def matching(records: DataFrame, ask: Ask, names: DataFrame | None = None, now: float = 0.0) -> DataFrame:
    """The rows that all filters of ``ask`` but its ranking let through."""
    rows = R.recallable(records, now, ask.cold_days, ask.include_cold, media=not ask.skip_media)
    if ask.exclude_ids:
        rows = rows.where(~F.col("id").isin(*ask.exclude_ids))
    if ask.exclude_sid:
        rows = rows.where(F.col("sid") != ask.exclude_sid)
    mode = "strict" if ask.strict_session and ask.sid else ask.scope
    rows = rows.where(X.scope(mode, F.col("sid"), F.col("visibility"), F.col("users"), ask.sid, list(ask.users)))
    if ask.level is not None:
        rows = rows.where(F.col("level") == ask.level)
    if ask.start is not None:
        rows = rows.where(F.col("end") >= ask.start)
    if ask.end is not None:
        rows = rows.where(F.col("start") <= ask.end)
    if ask.active:
        rows = rows.where("active = 1")
    if ask.subject:
        rows = rows.where(F.array_contains("users", ask.subject))
    if ask.keyword:
        none = names if names is not None else records.sparkSession.createDataFrame([], "entity string, name string")
        rows = R.with_keyword(rows, none, ask.keyword)
    return rows


def tier_of(ask: Ask) -> Column:
    """The preference tier, which orders and excludes nothing."""
    if not (ask.prefer_sid or ask.prefer_users):
        return F.lit(0)
    return X.preference_tier(F.col("sid"), F.col("visibility"), F.col("users"), ask.prefer_sid, list(ask.prefer_users))


def search(records: DataFrame, ask: Ask, names: DataFrame | None = None, vectors: DataFrame | None = None, facts: DataFrame | None = None, index: TextIndex | None = None, now: float = 0.0, known: tuple[str, ...] = ()) -> tuple[DataFrame, int]:
    """The page (all columns of ``records``, and place, score) and how many rows match in all.

    Ranked by preference tier and then: with ``lexical`` by its score, live rows and the oldest end first; with ``vector``
    (of ``model``, at the row's revision) by cosine; with both by fused_search(); with neither by end. A lexical first page
    without exclusions is picked from three times its rows, those whose tokens stand close together first. Of a page, rows
    that are media but for shells and mentions of ``known`` names, and tool steps, are then left out. A query of one to
    three tokens is widened by what ``facts`` relate to entities that it names. ``index`` narrows the rows that are read and
    changes no result. Ids and scores alone are ranked; the rest is joined for the page. The total comes from the same pass.
    """
    rows = matching(records, ask, names, now).withColumn("tier", tier_of(ask))
    query = ask.lexical
    tokens = X.query_tokens(query)
    if ask.expand and facts is not None and names is not None and 0 < len(tokens) <= 3:
        more = [r["token"] for r in R.expanded(tokens, names, facts).limit(24).collect()]  # of a few entities
        query = " ".join([query, *sorted(set(more) - set(tokens))])
        tokens = X.query_tokens(query)
    lexical, pure = bool(query), not (ask.offset or ask.exclude_ids or ask.exclude_sid)
    wide = max(ask.limit, min(3 * ask.limit, WIDEST)) if lexical and pure else max(1, ask.limit)
    if lexical and not ask.vector:
        near = index.candidates(query) if index is not None else None
        if near is not None and near.limit(R_MOST + 1).count() <= R_MOST:
            fresh = records.where(F.col("updated").isNull() | (F.col("updated") > index.seen)) if index.seen is not None else records
            rows = rows.join(near.unionByName(fresh.select("id")).distinct(), "id", "left_semi")
        rows = rows.withColumn("score", X.lexical_score(F.lower(X.squeeze(F.col("content"))), X.score_tokens(query)).cast("double"))
        rows = rows.where(X.lexical_score(F.lower(X.squeeze(F.col("content"))), tokens) > 0)
        order = ["tier", F.desc("score"), F.desc("active"), "end", "id"] if not ask.active else ["tier", F.desc("score"), "end", "id"]
    elif ask.vector and vectors is not None:
        rows = R.vector_scores(rows, vectors, list(ask.vector), ask.model, 1).withColumnRenamed("cosine", "score")
        order = ["tier", F.desc("score"), "end", "id"]
    else:
        rows, order = rows.withColumn("score", F.lit(0.0)), ["tier", "end", "id"]
    seen = Observation()
    if lexical and ask.vector and vectors is not None:
        same = vectors.where((F.col("model") == ask.model) & (F.col("revision") == 1)).select("id", F.col("vector"))
        narrow = rows.drop("score").select("id", "tier", "content", "end").join(same, "id", "left").observe(seen, F.count(F.lit(1)).alias("total"))
        top = V.fused_search(narrow, "id", "content", "vector", tokens, list(ask.vector), wide, F.col("tier"), F.col("end"), ask.offset).withColumnRenamed("fused", "score")
    else:
        narrow = rows.select("id", "tier", "score", "active", "end").observe(seen, F.count(F.lit(1)).alias("total"))
        top = narrow.orderBy(*order)
        top = (top.offset(ask.offset) if ask.offset else top).limit(wide).select("id", "score")
    top = written(top.withColumn("place", F.monotonically_increasing_id()), "page")  # sorted, in one partition
    page = records.join(F.broadcast(top), "id")
    if ask.skip_media:
        page = page.where(~C.media_only(F.col("content"), list(known)))
        page = page if ask.include_tools else page.where("category <> 'tool'")
    if lexical and pure:
        page = page.withColumn("bonus", X.proximity_bonus(F.col("content"), tokens)) if len(tokens) > 1 else page.withColumn("bonus", F.lit(0))
        last = Window.orderBy(F.desc("bonus"), "place")  # of at most 200 rows
        page = page.withColumn("place", F.row_number().over(last) - 1).where(F.col("place") < ask.limit).drop("bonus")
    return page.withColumn("place", F.col("place").cast("int")), seen.get["total"]


R_MOST = 1200  # candidates beyond which an index isn't worth it


def accessible(ids: DataFrame, records: DataFrame, facts: DataFrame, sid: str, users: list[str], scope: str = "session") -> DataFrame:
    """id and allowed for each of ``ids`` (id): whether the caller may see that live record, or that fact by its first live
    source. False for what isn't there, and for facts without a live source."""
    shared = F.arrays_overlap("users", _array(users))
    open_ = (F.col("visibility") == "global") | ((F.col("visibility") == "user") & shared) | (F.col("sid") == sid) | F.lit(scope == "global") | (F.lit(scope == "linked") & shared)
    live = records.where("deleted = 0").select("id", F.coalesce(open_, F.lit(False)).alias("seen"))
    asked = ids.select("id").distinct()
    cited = facts.where("deleted = 0").join(asked, "id", "left_semi").select("id", F.posexplode("sources").alias("n", "source"))
    first = cited.join(live.select(F.col("id").alias("source"), "seen"), "source").groupBy("id").agg(F.min_by("seen", "n").alias("by_source"))
    return asked.join(live, "id", "left").join(first, "id", "left").select("id", F.coalesce("seen", "by_source", F.lit(False)).alias("allowed"))


def descend(edges: DataFrame, roots: DataFrame, depth: int = 3, offset: int = 0, count: int = 20) -> DataFrame:
    """What hangs below each of ``roots`` (id), level by level: root, depth (from 0), parent, id, place, path, kids, next.

    edges: parent, child, ordinal. Of each node the children ``offset`` to ``offset + count`` in order (ordinal, then child)
    are shown and gone into; kids is how many it has, next where its next page begins (null at the last). A child that is
    its own ancestor is shown nowhere below. A join for each level, of which there are ``depth``.
    """
    by = Window.partitionBy("parent").orderBy("ordinal", "child")
    kids = edges.groupBy(F.col("parent").alias("id")).agg(F.count("*").alias("kids"))
    shown = edges.withColumn("n", F.row_number().over(by)).where(F.col("n").between(offset + 1, offset + count)).select(F.col("parent").alias("_up"), "child", F.col("n").alias("_n"))
    level = roots.select("id").distinct().select(F.col("id").alias("root"), F.lit(0).alias("depth"), F.lit(None).cast("string").alias("parent"), "id", F.lit(0).alias("place"), F.array("id").alias("path"))
    found = level
    for k in range(1, depth + 1):
        below = level.join(shown, level["id"] == shown["_up"]).where(~F.array_contains("path", F.col("child")))
        level = below.select("root", F.lit(k).alias("depth"), F.col("id").alias("parent"), F.col("child").alias("id"), F.col("_n").alias("place"), F.array_append("path", F.col("child")).alias("path"))
        found = found.unionByName(level)
    more = found.join(kids, "id", "left").withColumn("kids", F.coalesce("kids", F.lit(0)))
    return more.withColumn("next", F.when(F.col("kids") > offset + count, offset + count)).select("root", "depth", "parent", "id", "place", "path", "kids", "next")


def archive_view(tree: DataFrame, records: DataFrame, edges: DataFrame, versions: DataFrame, ledger: DataFrame) -> DataFrame:
    """Rows of descend() with text, time, level and pinned of their record, parents in order, and how many versions (target)
    and ledger items (record_id) they have; the body of leaves alone."""
    up = edges.groupBy(F.col("child").alias("id")).agg(F.array_sort(F.collect_set("parent")).alias("parents"))
    old = versions.groupBy(F.col("target").alias("id")).agg(F.count("*").alias("versions"))
    known = ledger.groupBy(F.col("record_id").alias("id")).agg(F.count("*").alias("items"))
    own = records.select("id", "content", F.coalesce("end", "start").alias("at"), "level", "permanent")
    rows = tree.join(own, "id").join(up, "id", "left").join(old, "id", "left").join(known, "id", "left")
    none = F.array().cast("array<string>")
    return rows.select("root", "path", "id", "kids", "next", X.full_time(F.col("at")).alias("at"), "level", F.when(F.col("permanent") == 1, 1).alias("mem"), F.coalesce("parents", none).alias("parents"), F.coalesce("versions", F.lit(0)).alias("versions"), F.coalesce("items", F.lit(0)).alias("items"), F.when(F.col("kids") == 0, F.col("content")).alias("content"))
