"""Records: recall predicates, context, statistics, vectors, codes, maintenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import cleaning as C
from ..functions import exprs as X
from .facts import DAY, _array


def recallable(records: DataFrame, now: float = 0.0, cold_days: float = 0, cold: bool = False, media: bool = False) -> DataFrame:
    """Rows that a search may find: not deleted, nor media, nor cold, nor folded and archived for ``cold_days``."""
    rows = records.where("deleted = 0")
    rows = rows if media else rows.where("category <> 'media'")
    if cold:
        return rows
    rows = rows.where("cold = 0")
    return rows.where(~((F.col("active") == 0) & (F.col("archived_at") > 0) & (F.col("archived_at") <= now - cold_days * 86400))) if cold_days else rows


def context(records: DataFrame, sid: str, users: list[str], scope: str = "session") -> DataFrame:
    """What a session has in mind, in order: its own and shared live rows; pinned ones of all with scope global."""
    shared = F.arrays_overlap("users", _array(users)) & ((F.col("visibility") == "user") | F.lit(scope == "linked"))
    seen = (F.col("sid") == sid) | (F.col("visibility") == "global") | shared | (F.lit(scope == "global") & (F.col("permanent") == 1))
    return records.where("active = 1 AND deleted = 0").where(seen).orderBy(F.desc("permanent"), F.desc("level"), "position", "id")


def with_keyword(records: DataFrame, names: DataFrame, keyword: str) -> DataFrame:
    """Rows whose text holds the keyword, or whose session or users ever had a name that does (entity, name)."""
    word = F.lit(X._squeezed(keyword).lower())
    called = names.where(F.contains(F.lower(X.squeeze(F.col("name"))), word)).select("entity").distinct()
    owners = records.select("id", F.explode(F.array_distinct(F.concat("users", F.array("sid")))).alias("entity"))
    known = owners.join(called, "entity", "left_semi").select("id").distinct().withColumn("known", F.lit(True))
    return records.join(known, "id", "left").where(F.contains(F.lower(X.squeeze(F.col("content"))), word) | F.col("known")).drop("known")


def mentioned(entities: DataFrame, names: DataFrame, text: str, most: int = 20) -> DataFrame:
    """Live entities of which ``text`` holds a name (of two characters or more): entity, latest by updated."""
    said = names.where((F.length("name") >= 2) & F.contains(F.lit(text), F.col("name"))).select("entity").distinct()
    return entities.join(said, "entity", "left_semi").orderBy(F.desc("updated"), "entity").limit(most)


def expanded(tokens: list[str], names: DataFrame, facts: DataFrame) -> DataFrame:
    """The query's tokens and, of entities a token names, what their live facts relate them to: token.

    Objects of two characters or more and without a colon; the feature takes four tokens at most.
    """
    words = _array(tokens[:4])
    known = names.where(F.exists(words, lambda w: F.lower(F.col("name")) == w)).select(F.col("entity").alias("subject")).distinct()
    far = facts.where("deleted = 0").join(known, "subject", "left_semi").select("subject", F.explode("relations").alias("r")).where(F.col("r.subject") == F.col("subject")).select(F.col("r.object").alias("token"))
    far = far.where((F.length("token") >= 2) & ~F.contains("token", F.lit(":")))
    own = facts.sparkSession.range(1).select(F.explode(words).alias("token"))
    return own.unionByName(far).distinct()


def vector_scores(rows: DataFrame, vectors: DataFrame, query: list[float] | Column, model: str, revision: int) -> DataFrame:
    """Adds cosine: -1 for rows without a vector of this model and revision, or of another length."""
    same = vectors.where((F.col("model") == model) & (F.col("revision") == revision)).select("id", "vector")
    both = rows.join(same, "id", "left").withColumn("_probe", X.vector_of(query))
    return both.withColumn("cosine", F.coalesce(X.cosine(F.col("vector"), F.col("_probe")), F.lit(-1.0))).drop("vector", "_probe")


def finite_vectors(vectors: DataFrame) -> DataFrame:
    """Vectors that may be stored: not empty, all numbers finite."""
    return vectors.where((F.size("vector") > 0) & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))))


def folded(rows: DataFrame, records: DataFrame) -> DataFrame:
    """Ids of ``rows`` that needn't be shown: folded ones that a live row of a higher level of their session covers in time,
    if that row is in ``rows`` too.

    Of the covers that start no later only the latest end counts: a running maximum by start, within a day, and of the days
    before from one row a day. A cover is taken once for each lower level, of which there are few.
    """
    live = records.where("active = 1 AND deleted = 0").join(rows.select("id"), "id", "left_semi")
    old = rows.where("active = 0 AND deleted = 0 AND sid IS NOT NULL AND level IS NOT NULL").where(F.col("start").isNotNull() & F.col("end").isNotNull())
    day = F.floor(F.nanvl(F.col("start").cast("double") / DAY, F.lit(float("inf")))).alias("day")
    lower = F.broadcast(old.select(F.col("level").alias("of")).distinct())
    over = live.where("sid IS NOT NULL").where(F.col("start").isNotNull() & F.col("end").isNotNull()).select("sid", "level", "start", day, F.col("end").alias("till")).join(lower, F.col("level") > F.col("of"))
    before = Window.partitionBy("sid", "of").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    mine = old.select("sid", F.col("level").alias("of"), "start", day, "id", "end")
    days = over.groupBy("sid", "of", "day").agg(F.max("till").alias("most")).unionByName(mine.select("sid", "of", "day", F.lit(None).alias("most")).distinct())
    days = days.groupBy("sid", "of", "day").agg(F.max("most").alias("most")).select("sid", "of", "day", F.max("most").over(before).alias("earlier"))
    both = mine.withColumn("till", F.lit(None)).unionByName(over.select("sid", "of", "start", "day", F.lit(None).alias("id"), F.lit(None).alias("end"), "till"))
    told = both.withColumn("today", F.max("till").over(Window.partitionBy("sid", "of", "day").orderBy("start")))
    return told.where(F.col("end").isNotNull()).join(days, ["sid", "of", "day"]).where((F.col("today") >= F.col("end")) | (F.col("earlier") >= F.col("end"))).select("id")


def probe(records: DataFrame) -> DataFrame:
    """Of each session what a planner asks first: total and upper rows that aren't pinned, the first and last end."""
    live = records.where("active = 1 AND deleted = 0")
    return live.groupBy("sid").agg(F.count_if(F.col("permanent") == 0).alias("total"), F.count_if((F.col("permanent") == 0) & (F.col("level") > 0)).alias("upper"), F.min("end").alias("oldest"), F.max("end").alias("newest"))


def worth_planning(probed: DataFrame, now: float, rounds: int = 12, threshold: int = 50, boost: bool = False, stale_days: int = 3, idle_hours: int = 6) -> DataFrame:
    """Adds worth: whether a plan is possible at all; never false where one is."""
    enough = (F.col("upper") >= 4) | (F.col("total") >= min(rounds, threshold))
    old = (F.col("total") > 0) & (F.col("oldest") < now - stale_days * 86400) & (F.col("newest") < now - idle_hours * 3600) & F.lit(boost and stale_days > 0 and idle_hours > 0)
    return probed.withColumn("worth", F.coalesce(enough | old, F.lit(False)))


def fact_caps(records: DataFrame, per: int = 6, most: int = 12) -> DataFrame:
    """How many facts may be drawn from each session and level: sid, level, rounds, cap.

    Messages: the closed rounds, or one in ``per`` rows if that is less, 1 to ``most``; a round closes before a user's row
    that follows another's, and none is counted without an answer. Archives: their number, within the same bounds.
    """
    w = Window.partitionBy("sid", "level").orderBy("position", "id")
    closes = ((F.col("role") == "user") & (F.lag("role").over(w) != "user")).cast("int")
    counted = records.where("active = 1 AND deleted = 0").withColumn("closes", F.coalesce(closes, F.lit(0))).groupBy("sid", "level").agg(F.count("*").alias("n"), F.sum("closes").alias("closed"), F.some(F.col("role") == "assistant").alias("answered"))
    rounds = F.when(F.col("answered"), F.col("closed")).otherwise(0)
    by_rows = F.ceil(F.col("n") / per)
    cap = F.when(F.col("level") > 0, F.col("n")).when(rounds > 0, F.least(rounds, by_rows)).otherwise(by_rows)
    return counted.select("sid", "level", rounds.cast("long").alias("rounds"), F.greatest(F.lit(1), F.least(F.lit(most), cap)).cast("long").alias("cap"))


def pinned_stats(records: DataFrame) -> DataFrame:
    """Pinned rows of each session: live and archived."""
    rest = (F.col("active") == 0) | (F.col("cold") == 1)
    return records.where("permanent = 1 AND deleted = 0").groupBy("sid").agg(F.count_if(~rest).alias("live"), F.count_if(rest).alias("archived"))


def untidyable(wanted: DataFrame, records: DataFrame) -> DataFrame:
    """Asked ids (id, position) that are no live pinned row."""
    return wanted.join(records.where("permanent = 1 AND deleted = 0 AND active = 1 AND cold = 0").select("id"), "id", "left_anti")


def exists(rows: DataFrame) -> DataFrame:
    """One row: whether there is any; no more than one row is read of each task."""
    return rows.limit(1).agg((F.count("*") > 0).alias("found"))


def sessions_by_audit(facts: DataFrame, now: float, recheck: float, k: int, reserved: list[str] = (), places: int = 1) -> DataFrame:
    """Sessions whose facts wait longest for an audit: sid, place; some ``places`` are kept for ``reserved`` ones, first."""
    some = facts.where("deleted = 0 AND merge_pending = 0").where((F.col("audited") == 0) | (F.col("audited") < now - recheck)).groupBy("sid").agg(F.min("audited").alias("oldest"))
    kept = some.where(F.col("sid").isin(*reserved)).orderBy("oldest", "sid").limit(places).withColumn("band", F.lit(0))
    rest = some.orderBy("oldest", "sid").limit(k).withColumn("band", F.lit(1))
    return first_wins(kept.unionByName(rest), ["sid"], ["band", "oldest", "sid"]).orderBy("band", "oldest", "sid").limit(k).select("sid", "band")


def first_wins(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Of rows with the same key the first by ``order``."""
    return rows.groupBy(*key).agg(F.min_by(F.struct(*rows.columns), F.struct(*order)).alias("_row")).select("_row.*")


def short_codes(ids: DataFrame, known: DataFrame | None = None, lengths: tuple[int, ...] = (6, 10, 64)) -> DataFrame:
    """A short code of its own for each distinct id: id, code; those that ``known`` (id, code) has stay for good.

    A code is the beginning of the id's sha256. Where a shorter one is taken, by a known id or by a smaller new one, the id
    goes on to the next length. The same ids get the same codes however they lie; null ids get none.
    """
    old = known.select("id", "code") if known is not None else ids.sparkSession.createDataFrame([], "id string, code string")
    left = ids.select("id").where("id IS NOT NULL").distinct().join(old, "id", "left_anti")
    out = old
    for n in lengths:
        coded = left.withColumn("code", F.substring(F.sha2("id", 256), 1, n))
        won = coded.join(old.select("code"), "code", "left_anti").groupBy("code").agg(F.min("id").alias("id")).select("id", "code")
        out, left = out.unionByName(won), left.join(won.select("id"), "id", "left_anti")
    return out


def name_map(names: DataFrame, subjects: DataFrame) -> DataFrame:
    """subject, entity, name: entities by their latest name, matched to subjects (subject) without blanks and case."""
    latest = names.groupBy("entity").agg(F.max_by("name", F.struct("observed", "name")).alias("name"))
    plain = lambda c: F.lower(X.squeeze(F.col(c)))
    return subjects.select("subject").distinct().join(latest, plain("subject") == plain("name")).groupBy("subject").agg(F.min(F.struct("entity", "name")).alias("e")).select("subject", "e.entity", "e.name")


def refined(rows: DataFrame, score: str, order: list, least: float = 0.10, floor: int = 2) -> DataFrame:
    """Rows scored at least ``least`` by another model, and the best ``floor`` in any case, best first; no score counts as 0.

    For one result list: adds rank.
    """
    best = [F.desc(F.coalesce(score, F.lit(0.0))), *order]
    good = rows.where(F.coalesce(score, F.lit(0.0)) >= least)
    kept = good.unionByName(rows.orderBy(*best).limit(floor).where(F.coalesce(score, F.lit(0.0)) < least))
    return kept.withColumn("rank", F.row_number().over(Window.orderBy(*best)))  # of what is left of one result list


def wider(width: int, factor: int = 3, most: int = 60) -> int:
    """How many candidates to fetch so that ``width`` may remain."""
    return max(width, min(width * min(factor, 5), most))


def merge_pinned(records: DataFrame, merges: DataFrame) -> DataFrame:
    """Pinned rows of one session put together (target, id, content): id, content, active, cold, revision.

    The target takes the new text; the others are folded away, and out of recall. Rows of another session than the
    target's, and those not pinned, stay as they are.
    """
    pinned = records.where("permanent = 1 AND deleted = 0")
    home = pinned.select(F.col("id").alias("target"), F.col("sid").alias("home"))
    plan = merges.join(home, "target").join(pinned.select("id", "sid"), "id").where("sid = home").select("id", "target", F.col("content").alias("_text"))
    both = records.join(plan, "id", "left")
    is_target, folded_in = F.col("target") == F.col("id"), F.col("target") != F.col("id")
    hit = F.col("target").isNotNull()
    return both.select(
        "id", F.when(is_target, F.col("_text")).otherwise(F.col("content")).alias("content"), F.when(folded_in, 0).otherwise(F.col("active")).alias("active"),
        F.when(folded_in, 1).otherwise(F.col("cold")).alias("cold"), (F.col("revision") + hit.cast("int")).alias("revision"),
    )


def reactivated(records: DataFrame, ids: DataFrame, deleted: bool = False) -> DataFrame:
    """Rows of ``ids`` (id) back from the trash (``deleted``), or live and warm again; all columns, revision up by one."""
    both = records.join(ids.select("id").distinct().withColumn("_hit", F.lit(True)), "id", "left")
    hit = F.coalesce("_hit", F.lit(False)) & (F.col("deleted") == 1 if deleted else (F.col("deleted") == 0) & ((F.col("active") == 0) | (F.col("cold") == 1)))
    change = {"deleted": F.lit(0)} if deleted else {"active": F.lit(1), "cold": F.lit(0), "archived_at": F.lit(0.0)}
    change["revision"] = F.col("revision") + 1
    return both.select(*[F.when(hit, change[c]).otherwise(F.col(c)).alias(c) if c in change else F.col(c) for c in records.columns])


def prune_jobs(jobs: DataFrame, now: float, keep: int = 100, days: float = 7) -> DataFrame:
    """Jobs that are kept: unfinished ones, recent ones, and the ``keep`` last updated."""
    last = jobs.orderBy(F.desc("updated"), "id").limit(keep).select("id").withColumn("last", F.lit(True))
    return jobs.join(F.broadcast(last), "id", "left").where(~F.col("state").isin("done", "failed") | (F.col("updated") >= now - days * 86400) | F.col("last")).drop("last")


def trash(records: DataFrame) -> DataFrame:
    """Deleted rows, the latest first."""
    return records.where("deleted = 1").orderBy(F.desc(F.coalesce(F.nullif(F.col("archived_at"), F.lit(0.0)), "end")), "id")


def distilled_only(records: DataFrame, items: DataFrame, facts: DataFrame) -> DataFrame:
    """sid and only: whether all its live rows have a migration item (record_id, source_key) whose key a live fact that is no
    event has."""
    told = items.join(facts.where("deleted = 0 AND category <> 'event'").select(F.col("id").alias("source_key")), "source_key", "left_semi").select(F.col("record_id").alias("id")).distinct().withColumn("told", F.lit(1))
    return records.where("deleted = 0").join(told, "id", "left").groupBy("sid").agg((F.count("*") == F.count("told")).alias("only"))


def aliases(records: DataFrame) -> DataFrame:
    """Rows of a session as r1, r2, ... in order: sid, alias, id, who (speaker and role)."""
    w = Window.partitionBy("sid").orderBy("position", "id")
    return records.where("active = 1 AND deleted = 0").select("sid", F.concat(F.lit("r"), F.row_number().over(w).cast("string")).alias("alias"), "id", F.concat_ws("/", F.get("users", F.lit(0)), "role").alias("who"))


def packed(rows: DataFrame, group: list[str], order: list, cells: Column, budget: int) -> DataFrame:
    """Rows that fit into ``budget`` characters of JSON in each group, in order, the first always: adds used."""
    w = Window.partitionBy(*group).orderBy(*order)
    sized = rows.withColumn("used", F.sum(F.length(F.to_json(cells))).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_n", F.row_number().over(w))
    return sized.where((F.col("used") <= budget) | (F.col("_n") == 1)).drop("_n")


def gram_index(records: DataFrame, text: str = "content") -> DataFrame:
    """id and gram: what an index of characters and adjacent pairs holds of each row's text, each once."""
    return records.select("id", F.explode(F.array_distinct(F.split(X.search_body(F.col(text)), " "))).alias("gram"))


def indexed_search(records: DataFrame, index: DataFrame, query: str, k: int, most: int = 1200, text: str = "content") -> DataFrame:
    """The lexical top ``k`` of ``query``: by score, activity, age and id; adds score.

    Candidates are rows that share a gram with the query, a superset of those that score. Where they are over ``most`` the
    index isn't worth it and all rows are scored, with the same result.
    """
    tokens = X.query_tokens(query)
    near = index.where(F.col("gram").isin(*X.match_grams(tokens))).select("id").distinct()
    few = near.limit(most + 1).count() <= most
    rows = records.join(near, "id", "left_semi") if few else records
    scored = rows.withColumn("score", X.lexical_score(X.squeeze(F.col(text)), tokens)).where("score > 0")
    return scored.orderBy(F.desc("score"), F.desc("active"), "end", "id").limit(k)


def real_names(names: DataFrame) -> DataFrame:
    """The latest name of each entity that no third party made up: entity, name."""
    own = names.where(~C.synthetic_name(F.col("name")) & F.length("name").between(1, 500) & ~F.col("name").rlike(r"[\x00-\x1f]"))
    return own.groupBy("entity").agg(F.max_by("name", F.struct("observed", "name")).alias("name"))


def totals(records: DataFrame, facts: DataFrame) -> DataFrame:
    """One row: live records, pinned ones, sessions, users, groups, live facts."""
    live = records.where("deleted = 0")
    some = live.agg(F.count("*").alias("n"), F.sum("permanent").alias("pinned"), F.countDistinct("sid").alias("sessions"), F.countDistinct(F.when(F.contains("sid", F.lit(":gm:")), F.col("sid"))).alias("groups"))
    users = live.select(F.explode("users").alias("u")).agg(F.countDistinct("u").alias("users"))
    known = facts.where("deleted = 0").agg(F.count("*").alias("facts"))
    one = lambda df: df.withColumn("_one", F.lit(1))  # noqa: E731  each is a single row
    return one(some).join(one(users), "_one").join(one(known), "_one").drop("_one")


def capacity(records: DataFrame) -> DataFrame:
    """Live records by level and year (UTC) of their start: level, y, n, pinned, chars."""
    year = F.substring(X.utc_text(F.col("start")), 1, 4).cast("int")
    return records.where("deleted = 0").groupBy("level", year.alias("y")).agg(F.count("*").alias("n"), F.count_if(F.col("permanent") == 1).alias("pinned"), F.sum(F.length("content")).alias("chars"))


def by_user(records: DataFrame) -> DataFrame:
    """user and how many live rows and sessions name them."""
    return records.where("deleted = 0").select("sid", F.explode(F.array_distinct("users")).alias("user")).groupBy("user").agg(F.count("*").alias("n"), F.countDistinct("sid").alias("sessions"))


def migration_status(items: DataFrame) -> DataFrame:
    """items (source, key, reason, record_id): skips by source and reason; imported keys, each once, under the reason imported."""
    reason = F.coalesce("reason", F.lit("imported"))
    return items.groupBy("source", reason.alias("reason")).agg(F.count("*").alias("n"), F.countDistinct(F.when(F.col("reason").isNull(), F.col("key"))).alias("imported"))


def unscoped(items: DataFrame, records: DataFrame) -> DataFrame:
    """One row: how many distinct live records of the ledger belong to no session."""
    homeless = records.where("deleted = 0").where(F.col("sid").startswith("legacy:")).select("id")
    return items.select(F.col("record_id").alias("id")).join(homeless, "id").agg(F.countDistinct("id").alias("n"))


def reranked(rows: DataFrame, scores: DataFrame, order: list) -> DataFrame:
    """rows (id, ...) by another model's scores (id, score), those without one last, then by ``order``."""
    return rows.join(scores, "id", "left").orderBy(F.desc_nulls_last("score"), *order)


def over_cap(records: DataFrame, most: int = 30, chars: int = 5000) -> DataFrame:
    """Pinned rows of each session that are beyond its caps when the weightiest come first: sid, id."""
    w = Window.partitionBy("sid").orderBy(F.desc("importance"), "id")
    rows = records.where("permanent = 1 AND deleted = 0 AND active = 1").select("sid", "id", F.row_number().over(w).alias("n"), F.sum(F.length("content")).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("used"))
    return rows.where((F.col("n") > most) | ((F.col("used") > chars) & (F.col("n") > 1))).select("sid", "id")


def family(edges: DataFrame) -> DataFrame:
    """id, children (in order) and parents of each node of edges (parent, child, ordinal)."""
    kids = edges.groupBy(F.col("parent").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "child"))), lambda x: x.child).alias("children"))
    up = edges.groupBy(F.col("child").alias("id")).agg(F.array_sort(F.collect_set("parent")).alias("parents"))
    none = F.array().cast("array<string>")
    return kids.join(up, "id", "full").select("id", F.coalesce("children", none).alias("children"), F.coalesce("parents", none).alias("parents"))
