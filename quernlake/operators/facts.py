"""Facts: visibility, ranking, likeness to a text, relations, time, freshness, merging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import cleaning as C
from ..functions import exprs as X
from .similar import similar_ids

DAY = 86400.0


def _array(values: list[str]) -> Column:
    return F.array(*map(F.lit, values)).cast("array<string>")


def live(facts: DataFrame, pending: bool = False) -> DataFrame:
    """Facts that aren't deleted, nor (unless ``pending``) waiting to be merged."""
    return facts.where("deleted = 0" if pending else "deleted = 0 AND merge_pending = 0")


def shared_facts(facts: DataFrame, records: DataFrame, sid: str, users: list[str]) -> DataFrame:
    """Live facts of the session, of all, or with a live source record that all or these users may see (a semi join)."""
    seen = records.where((F.col("deleted") == 0) & ((F.col("visibility") == "global") | ((F.col("visibility") == "user") & F.arrays_overlap("users", _array(users))))).select(F.col("id").alias("source"))
    cited = facts.select("id", F.explode("sources").alias("source")).join(seen, "source", "left_semi").select("id").distinct().withColumn("cited", F.lit(True))
    return live(facts, True).join(cited, "id", "left").where((F.col("sid") == sid) | (F.col("sid") == "global") | F.col("cited")).drop("cited")


def ranked_facts(facts: DataFrame, query: str, k: int, sid: str = "", users: list[str] = (), users_first: bool = False, subjects: list[str] = (), min_score: int = 0, by_importance: bool = False) -> DataFrame:
    """Live facts by tiers (session and users, then subjects), lexical score, importance or audit age; adds tier, score."""
    mine, theirs = F.col("sid") == sid, F.col("subject").isin(*users)
    first, second = (theirs, mine) if users_first and users else (mine, theirs)
    tier = F.when(first, 0).when(second, 1).otherwise(2) if sid or users else F.lit(0)
    near = F.when(F.col("subject").isin(*subjects), 0).otherwise(1) if subjects else F.lit(0)
    scored = live(facts, True).withColumn("score", X.lexical_score(F.col("content"), X.query_tokens(query))).withColumn("tier", tier).withColumn("near", near)
    if query:
        scored = scored.where(F.col("score") >= max(1, min_score))
    rest = [F.desc("importance"), F.desc("created")] if by_importance else ["audited"]
    return scored.orderBy("tier", "near", F.desc("score"), *rest, "id").limit(k).drop("near")


def audit_candidates(facts: DataFrame, now: float, recheck: float, k: int) -> DataFrame:
    """Facts never audited or not for ``recheck`` seconds, the longest first."""
    return live(facts).where((F.col("audited") == 0) | (F.col("audited") < now - recheck)).orderBy("audited", "id").limit(k)


def with_time(facts: DataFrame, records: DataFrame) -> DataFrame:
    """Adds time, the latest start of a fact's source records (0 without any), and event_at and event_end where they are 0."""
    times = facts.select("id", F.explode("sources").alias("source")).join(records.select(F.col("id").alias("source"), F.col("start").alias("s")), "source")
    times = times.groupBy("id").agg(F.min("s").alias("_low"), F.max("s").alias("_high"))
    zero = lambda c, v: F.coalesce(F.nullif(F.col(c), F.lit(0.0)), F.col(v), F.lit(0.0))
    both = facts.join(times, "id", "left").withColumn("time", F.coalesce("_high", F.lit(0.0)))
    return both.withColumn("event_at", zero("event_at", "_low")).withColumn("event_end", zero("event_end", "_high")).drop("_low", "_high")


def similar_facts(facts: DataFrame, sid: str, subject: str, category: str, content: str, k: int = 3, least: float = 0.25, across: bool = False) -> DataFrame:
    """The live facts of the subject and category (of the session, unless ``across``) most like ``content``; adds similarity."""
    same = live(facts).where((F.col("subject") == subject) & (F.col("category") == category))
    same = same if across else same.where(F.col("sid") == sid)
    told = same.withColumn("similarity", X.containment(X.bigrams_of(content), X.bigrams(F.col("content")), 2))
    return told.where(F.col("similarity") >= least).orderBy(F.desc("similarity"), "id").limit(k)


def covering_fact(facts: DataFrame, sid: str, content: str, threshold: float = 0.4, most: int = 800) -> DataFrame:
    """The fact that covers ``content`` best, if any reaches ``threshold``: id, score.

    Of the ``most`` live facts of the session or of all, by importance, age and id, which is the feature's own limit; of
    equally good ones the first in that order. Texts of under four characters are covered by nothing; three characters in
    common are needed.
    """
    text = content.strip()
    pool = live(facts).where(F.col("sid").isin(sid, "global")).orderBy(F.desc("importance"), F.desc("created"), "id").limit(most if len(text) >= 4 else 0)
    letters = lambda c: F.array_distinct(F.split(c, ""))
    told = pool.withColumn("score", F.when(F.size(F.array_intersect(letters(F.lit(text)), letters(F.col("content")))) >= 3, X.containment(X.bigrams_of(text), X.bigrams(F.col("content")), 3)).otherwise(0.0))
    best = told.orderBy(F.desc("score"), F.desc("importance"), F.desc("created"), "id").limit(1)
    return best.where((F.col("score") > 0) & (F.col("score") >= threshold)).select("id", F.round("score", 3).alias("score"))


def relations(facts: DataFrame, only: list[str] = ()) -> DataFrame:
    """A row for each relation of live facts: all their columns, and position, r_subject, predicate, object, issue."""
    some = live(facts).where(F.col("category").isin(*only)) if only else live(facts)
    each = some.select("*", F.posexplode("relations").alias("position", "r"))
    return each.select(*facts.columns, "position", F.trim("r.subject").alias("r_subject"), F.trim("r.predicate").alias("predicate"), F.trim("r.object").alias("object"), C.relation_issue(F.col("r")).alias("issue"))


def related_facts(facts: DataFrame, entity: str, tokens: list[str], exclude: list[str] = (), k: int = 30) -> DataFrame:
    """Facts of others that a sound relation ties to one of ``tokens``: id, other, predicate, importance, created.

    Profiles and relationships only; the far end isn't the entity; a fact once for each far end. ``k`` is a limit of the
    result, taken after exact matching.
    """
    met = relations(facts, ["profile", "relationship"]).where((F.col("predicate") != "") & F.col("issue").isNull())
    met = met.where(~F.col("subject").isin(*exclude)) if exclude else met
    other = F.when(F.col("r_subject").isin(*tokens), F.col("object")).when(F.col("object").isin(*tokens), F.col("r_subject"))
    found = met.withColumn("other", other).where(F.col("other").isNotNull() & (F.col("other") != "") & (F.col("other") != entity))
    once = found.groupBy("id", "other").agg(F.min_by("predicate", "position").alias("predicate"), F.first("importance").alias("importance"), F.first("created").alias("created"))
    return once.orderBy(F.desc("importance"), F.desc("created"), "id", "other").limit(k)


def graph_edges(facts: DataFrame, most_nodes: int = 36) -> DataFrame:
    """Edges (source, target, n) of sound relations among the ``most_nodes`` entities with most of them."""
    sound = relations(facts).where(F.col("issue").isNull() & (F.col("predicate") != "")).select(F.col("r_subject").alias("source"), F.col("object").alias("target"))
    edges = sound.groupBy("source", "target").agg(F.count("*").alias("n"))
    ends = edges.select(F.col("source").alias("node"), "n").unionByName(edges.select(F.col("target").alias("node"), "n"))
    top = F.broadcast(ends.groupBy("node").agg(F.sum("n").alias("w")).orderBy(F.desc("w"), "node").limit(most_nodes).select("node"))
    return edges.join(top.withColumnRenamed("node", "source"), "source", "left_semi").join(top.withColumnRenamed("node", "target"), "target", "left_semi")


def outgoing(facts: DataFrame) -> DataFrame:
    """subject and n, how many relations of its live facts begin with it."""
    each = facts.where("deleted = 0").select("subject", F.explode("relations").alias("r"))
    return each.where(F.col("r.subject") == F.col("subject")).groupBy("subject").agg(F.count("*").alias("n"))


def entity_summaries(facts: DataFrame, k: int = 3, width: int = 24) -> DataFrame:
    """Of each subject how many live facts, when last audited, and its ``k`` weightiest texts, cut."""
    some = facts.where("deleted = 0")
    rank = F.row_number().over(Window.partitionBy("subject").orderBy(F.desc("importance"), F.desc("audited"), "id"))
    top = some.select("subject", "content", rank.alias("k")).where(F.col("k") <= k).groupBy("subject").agg(F.array_sort(F.collect_list(F.struct("k", F.substring("content", 1, width).alias("t")))).alias("x"))
    counts = some.groupBy("subject").agg(F.count("*").alias("facts"), F.max("audited").alias("seen"))
    return counts.join(top, "subject").select("subject", "facts", "seen", F.transform("x", lambda y: y.t).alias("summary"))


def with_sink(facts: DataFrame, now: float, threshold: int, bonus: int = 0) -> DataFrame:
    """Adds score and sinks: whether the fact gives way in what is always shown."""
    age = F.when(F.col("created") > 0, (F.lit(now) - F.col("created")) / DAY)
    used_age = F.when(F.col("rotate_used_at") > 0, (F.lit(now) - F.col("rotate_used_at")) / DAY)
    scored = facts.withColumn("score", X.sink_score(F.col("importance"), F.col("rotate_used"), used_age, age, F.lit(bonus)))
    return scored.withColumn("sinks", X.sinks(F.col("importance"), age, F.col("score"), threshold))


def sink_filter(facts: DataFrame, now: float, threshold: int, bonus: int = 0) -> DataFrame:
    """Facts that don't give way; all of them at a threshold of 0."""
    return with_sink(facts, now, threshold, bonus).where(~F.col("sinks")).drop("score", "sinks")


def health_page(facts: DataFrame, now: float, threshold: int, k: int, offset: int = 0) -> DataFrame:
    """A page of facts by importance and age, then by score: which are near to giving way."""
    page = live(facts, True).orderBy("importance", "created", "id").offset(offset).limit(k)
    return with_sink(page, now, threshold).orderBy("score", "id")


def self_last(facts: DataFrame, self_id: str, drop_importance: int = 0) -> DataFrame:
    """Facts whose latest source is ``self_id`` after all others (adds is_self), those up to ``drop_importance`` not at all."""
    own = F.coalesce(F.col("src_user") == self_id, F.lit(False)) if self_id else F.lit(False)
    low = own & (F.coalesce(F.col("importance"), F.lit(5)) <= drop_importance) if drop_importance else F.lit(False)
    return facts.withColumn("is_self", own).where(~low)


def merge_queue(facts: DataFrame, pairs: DataFrame) -> DataFrame:
    """Ids of facts with a near-duplicate of the same subject and category; across sessions only where that makes sense.

    pairs: a, b, similarity of similar_pairs().
    """
    side = lambda n: live(facts).select(F.col("id").alias(n), F.struct("sid", "subject", "category").alias(f"{n}_of"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").where("a_of.subject = b_of.subject AND a_of.category = b_of.category")
    both = both.where((F.col("a_of.sid") == F.col("b_of.sid")) | F.col("a_of.category").isin("profile", "preference", "relationship"))
    return both.select(F.explode(F.array("a", "b")).alias("id")).distinct()


def near_ids(facts: DataFrame, threshold: float) -> DataFrame:
    """merge_queue() of similar_pairs() at ``threshold`` without the pairs, of which a group of copies has a square."""
    wide = F.col("category").isin("profile", "preference", "relationship")
    rows = live(facts).where("content <> ''").withColumn("_home", F.when(wide, F.lit("")).otherwise(F.concat(F.lit("/"), "sid")))
    return similar_ids(rows, "id", "content", ["subject", "category", "_home"], threshold)


def dedupe_rewritten(facts: DataFrame) -> DataFrame:
    """Facts of one session, subject and fingerprint as one: the least id stays, with all sources and tags, the most importance."""
    union = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_set(c))))
    return facts.where("deleted = 0").groupBy("sid", "subject", "fingerprint").agg(F.min("id").alias("id"), union("sources").alias("sources"), union("tags").alias("tags"), F.max("importance").alias("importance"), F.count("*").alias("n"))


def fallback_text(facts: DataFrame, group: list[str], most: int = 400) -> DataFrame:
    """Of each group the distinct texts, the newest first, joined and cut: what stands in for a merge that failed."""
    newest = facts.groupBy(*group, "content").agg(F.max("created").alias("created"))
    rows = newest.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct((-F.col("created")).alias("t"), "content"))).alias("x"))
    return rows.select(*group, F.substring(F.array_join(F.transform("x", lambda y: y.content), "；"), 1, most).alias("content"))


def audited(facts: DataFrame, verdicts: DataFrame, records: DataFrame) -> DataFrame:
    """Facts after verdicts (id, action, importance, content): id, content, importance, deleted, changed.

    keep, correct (new text), retract (deleted). Importance is clamped to 1..10 and may not rise where every source is the
    assistant's own word.
    """
    own = facts.select("id", F.explode("sources").alias("source")).join(records.select(F.col("id").alias("source"), "role"), "source").groupBy("id").agg(F.every(F.col("role") == "assistant").alias("own"))
    v = verdicts.select("id", "action", F.col("importance").alias("_i"), F.col("content").alias("_c"))
    both = live(facts, True).join(v, "id").join(own, "id", "left")
    wanted = F.greatest(F.least(F.coalesce("_i", "importance"), F.lit(10)), F.lit(1))
    level = F.when(F.coalesce("own", F.lit(False)), F.least(wanted, F.col("importance"))).otherwise(wanted)
    text = F.when((F.col("action") == "correct") & (F.coalesce("_c", F.lit("")) != ""), F.col("_c")).otherwise(F.col("content"))
    gone = (F.col("action") == "retract").cast("int")
    return both.select("id", text.alias("content"), level.alias("importance"), gone.alias("deleted"), ((text != F.col("content")) | (level != F.col("importance")) | (gone == 1)).alias("changed"))


def evidence(facts: DataFrame, records: DataFrame) -> DataFrame:
    """The live records that live facts cite: fact, place (in its sources, from 0), all columns of the record, src_user."""
    cited = facts.where("deleted = 0").select(F.col("id").alias("fact"), "src_user", F.posexplode("sources").alias("place", "id"))
    return cited.join(records.where("deleted = 0"), "id")


def neighbours(facts: DataFrame, names: DataFrame, most: int = 3) -> DataFrame:
    """What live facts relate to: fact, entity (an object of its relations), its latest name (empty without one), and tops,
    the ``most`` weightiest live facts about it, by importance and id."""
    far = live(facts, True).select(F.col("id").alias("fact"), F.explode("relations").alias("r")).select("fact", F.col("r.object").alias("entity")).where("entity IS NOT NULL").distinct()
    latest = names.groupBy("entity").agg(F.max_by("name", F.struct("observed", "name")).alias("name"))
    rank = F.row_number().over(Window.partitionBy("subject").orderBy(F.desc("importance"), "id"))
    told = live(facts, True).select(F.col("subject").alias("entity"), "id", rank.alias("n")).where(F.col("n") <= most)
    tops = told.groupBy("entity").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "id"))), lambda x: x.id).alias("tops"))
    none = F.array().cast("array<string>")
    return far.join(latest, "entity", "left").join(tops, "entity", "left").select("fact", "entity", F.coalesce("name", F.lit("")).alias("name"), F.coalesce("tops", none).alias("tops"))


def audit_applied(facts: DataFrame, verdicts: DataFrame, records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Live facts after verdicts (id, action, importance, content, target), merges included, and how often each was applied.

    Gives audited()'s rows with sources and merged (the ids that came in), and action, n. merge: the fact goes, and its
    target, a live fact of the same subject that no verdict takes away, gets its sources and the greater importance; a
    merge without such a target changes nothing and counts as refused. Other facts stay out.
    """
    base = facts.where("deleted = 0")
    wants = verdicts.where("action = 'merge'").select("id", "target").where("id <> target")
    away = verdicts.where("action IN ('merge', 'retract')").select(F.col("id").alias("target"))
    side = base.select("id", "subject", "sources", "importance")
    to = base.select(F.col("id").alias("target"), F.col("subject").alias("_subject"))
    good = wants.join(away, "target", "left_anti").join(side, "id").join(to, "target").where(F.col("subject").eqNullSafe(F.col("_subject")))
    came = good.groupBy(F.col("target").alias("id")).agg(F.array_sort(F.flatten(F.collect_list("sources"))).alias("_more"), F.max("importance").alias("_most"), F.array_sort(F.collect_list("id")).alias("_merged"))
    gone = good.select("id", F.lit(1).alias("_gone"))
    silent = came.select("id").join(verdicts.select("id"), "id", "left_anti").select("id", F.lit("keep").alias("action"), F.lit(None).cast("int").alias("importance"), F.lit(None).cast("string").alias("content"))
    rows = audited(facts, verdicts.select("id", "action", "importance", "content").unionByName(silent), records).join(base.select("id", "sources"), "id").join(came, "id", "left").join(gone, "id", "left")
    none = F.array().cast("array<string>")
    out = rows.select(
        "id", "content", F.greatest("importance", F.coalesce("_most", "importance")).alias("importance"), F.greatest("deleted", F.coalesce("_gone", F.lit(0))).alias("deleted"),
        F.array_distinct(F.concat("sources", F.coalesce("_more", none))).alias("sources"), F.coalesce("_merged", none).alias("merged"), (F.col("changed") | F.col("_gone").isNotNull() | F.col("_more").isNotNull()).alias("changed"),
    )
    done = verdicts.join(base.select("id"), "id").join(gone, "id", "left").select(F.when((F.col("action") == "merge") & F.col("_gone").isNull(), "refused").otherwise(F.col("action")).alias("action"))
    return out, done.groupBy("action").agg(F.count("*").alias("n"))


def widen_sources(facts: DataFrame, records: DataFrame, keyword: str) -> DataFrame:
    """Facts whose sources don't hold ``keyword`` get one record of their session that does, the earliest: id, sources."""
    holds = records.where((F.col("deleted") == 0) & F.contains(F.lower("content"), F.lit(keyword.lower())))
    cited = facts.select("id", F.explode("sources").alias("source")).join(holds.select(F.col("id").alias("source")), "source", "left_semi").select("id").distinct().withColumn("has", F.lit(True))
    first = holds.groupBy("sid").agg(F.min_by("id", F.struct("start", "id")).alias("one"))
    both = live(facts, True).join(cited, "id", "left").join(first, "sid", "left")
    more = F.when(F.col("has").isNull() & F.col("one").isNotNull(), F.array("one")).otherwise(F.array().cast("array<string>"))
    return both.select("id", F.array_distinct(F.concat("sources", more)).alias("sources"))


def grouped_rows(facts: DataFrame) -> DataFrame:
    """A row a subject: facts in order as arrays of category code, text, importance and relations a>p>b; blanks at the end go."""
    rel = F.array_join(F.transform("relations", lambda r: F.concat_ws(">", r.subject, r.predicate, r.object)), ";")
    cells = F.array(X.category_code(F.col("category")), F.col("content"), F.col("importance").cast("string"), rel)
    last = F.array_max(F.transform(cells, lambda c, k: F.when(c != "", k + 1).otherwise(0)))
    rows = live(facts, True).withColumn("row", F.slice(cells, F.lit(1), last))
    packed = rows.groupBy("subject").agg(F.array_sort(F.collect_list(F.struct("id", "row"))).alias("x"))
    return packed.select("subject", F.transform("x", lambda y: F.array_join(y.row, "|")).alias("rows"))
