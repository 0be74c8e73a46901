"""Queries over records, facts, names and vectors made of the driver's tables, each by its operator of the library.

The tables are stated twice, as DataFrames and as DuckDB views; the SQL of each query is written from what the operator
must give, on those views.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import cleaning as C
from ..functions import exprs as X
from ..operators import consolidate as K
from ..operators import facts as FA
from ..operators import lifecycle as L
from ..operators import records as R
from ..operators import retrieval as V
from ..operators import similar as S
from .registry import query, t

NOW = 1_700_000_000.0

BASE = """records AS (SELECT *, start + CASE level WHEN 2 THEN 200000 WHEN 1 THEN 5000 ELSE 30 END AS "end" FROM (SELECT 'm' || conv_id || '-' || turn AS id, 'qq:gm:' || (conv_id % 7) AS sid, role, coalesce(text, '') AS content,
    CAST(turn % 3 AS INT) AS level, 1.7e9 + conv_id * 10000 + turn * 60 AS start, ['qq:' || (conv_id % 4), 'qq:' || (turn % 3)] AS users,
    CASE conv_id % 4 WHEN 0 THEN 'global' WHEN 1 THEN 'user' ELSE 'session' END AS visibility, CASE WHEN (conv_id + turn) % 3 = 0 THEN 0 ELSE 1 END AS active,
    CASE WHEN turn % 7 = 6 THEN 1 ELSE 0 END AS deleted, CASE WHEN conv_id % 6 = 5 THEN 1 ELSE 0 END AS cold, CASE WHEN turn % 5 = 4 THEN 1 ELSE 0 END AS permanent,
    CASE turn % 9 WHEN 8 THEN 'media' WHEN 7 THEN 'tool' ELSE 'chat' END AS category, CASE WHEN (conv_id + turn) % 3 = 0 AND conv_id % 2 = 0 THEN 1.69e9 + turn * 86400 ELSE 0e0 END AS archived_at,
    CAST((conv_id * 3 + turn) % 10 + 1 AS INT) AS importance, CAST(turn AS INT) AS position, 1 AS revision FROM conversations)),
facts AS (SELECT 'f' || doc_id AS id, CASE WHEN doc_id % 10 = 0 THEN 'global' ELSE 'qq:gm:' || (doc_id % 7) END AS sid, ['event', 'fact', 'preference', 'commitment', 'relationship', 'profile', 'resource', 'self'][doc_id % 8 + 1] AS category,
    'qq:' || (doc_id % 9) AS subject, coalesce(substr(text, 1, 160), '') AS content, CAST(doc_id % 10 + 1 AS INT) AS importance, CASE WHEN doc_id % 10 = 9 THEN 0e0 ELSE 1.7e9 - doc_id * 3600.0 END AS created,
    ['m' || (doc_id % 20) || '-' || (doc_id % 5), 'm' || (doc_id % 13) || '-' || (doc_id % 3)] AS sources, CASE WHEN doc_id % 11 = 0 THEN 1 ELSE 0 END AS deleted, CASE WHEN doc_id % 17 = 0 THEN 1 ELSE 0 END AS merge_pending,
    CASE WHEN doc_id % 4 = 0 THEN 0e0 ELSE 1.7e9 - (doc_id % 30) * 86400.0 END AS audited, CAST(doc_id % 7 AS INT) AS rotate_used, CASE WHEN doc_id % 3 = 0 THEN 0e0 ELSE 1.7e9 - (doc_id % 50) * 86400.0 END AS rotate_used_at,
    [{'subject': 'qq:' || (doc_id % 9), 'predicate': ['认为', 'colleague', 'friend', 'lives in'][doc_id % 4 + 1], 'object': CASE WHEN doc_id % 3 = 0 THEN 'qq:' || (doc_id % 5) ELSE 'town' || (doc_id % 6) END}] AS relations,
    [lang] AS tags, 'x' || (doc_id % 200) AS fingerprint, CASE WHEN doc_id % 2 = 0 THEN 0e0 ELSE 5e0 END AS event_at, 0e0 AS event_end, 'qq:' || (doc_id % 6) AS src_user FROM documents),
names AS (SELECT 'qq:' || (n_nationkey % 9) AS entity, n_name AS name, n_nationkey * 1e1 AS observed FROM nation),
entities AS (SELECT entity, max(observed) AS updated FROM names GROUP BY entity),
vectors AS (SELECT 'm' || (vec_id % 25) || '-' || (vec_id // 25) AS id, CASE WHEN vec_id % 5 = 0 THEN 'old' ELSE 'new' END AS model, 1 AS revision, CAST(embedding AS DOUBLE[]) AS vector FROM embeddings)"""


def records(spark: SparkSession, d: str) -> DataFrame:
    c = t(spark, d, "conversations").selectExpr(
        "concat('m', conv_id, '-', turn) AS id", "concat('qq:gm:', conv_id % 7) AS sid", "role", "coalesce(text, '') AS content", "int(turn % 3) AS level", "1700000000.0D + conv_id * 10000 + turn * 60 AS start",
        "array(concat('qq:', conv_id % 4), concat('qq:', turn % 3)) AS users", "CASE conv_id % 4 WHEN 0 THEN 'global' WHEN 1 THEN 'user' ELSE 'session' END AS visibility", "int((conv_id + turn) % 3 <> 0) AS active",
        "int(turn % 7 = 6) AS deleted", "int(conv_id % 6 = 5) AS cold", "int(turn % 5 = 4) AS permanent", "CASE turn % 9 WHEN 8 THEN 'media' WHEN 7 THEN 'tool' ELSE 'chat' END AS category",
        "CASE WHEN (conv_id + turn) % 3 = 0 AND conv_id % 2 = 0 THEN 1690000000.0D + turn * 86400 ELSE 0.0D END AS archived_at", "int((conv_id * 3 + turn) % 10 + 1) AS importance", "int(turn) AS position", "1 AS revision",
    )
    return c.withColumn("end", F.col("start") + F.when(F.col("level") == 2, 200000).when(F.col("level") == 1, 5000).otherwise(30))


def facts(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "documents").selectExpr(
        "concat('f', doc_id) AS id", "CASE WHEN doc_id % 10 = 0 THEN 'global' ELSE concat('qq:gm:', doc_id % 7) END AS sid", "element_at(array('event', 'fact', 'preference', 'commitment', 'relationship', 'profile', 'resource', 'self'), int(doc_id % 8 + 1)) AS category",
        "concat('qq:', doc_id % 9) AS subject", "coalesce(substr(text, 1, 160), '') AS content", "int(doc_id % 10 + 1) AS importance", "CASE WHEN doc_id % 10 = 9 THEN 0.0D ELSE 1700000000.0D - doc_id * 3600.0D END AS created",
        "array(concat('m', doc_id % 20, '-', doc_id % 5), concat('m', doc_id % 13, '-', doc_id % 3)) AS sources", "int(doc_id % 11 = 0) AS deleted", "int(doc_id % 17 = 0) AS merge_pending",
        "CASE WHEN doc_id % 4 = 0 THEN 0.0D ELSE 1700000000.0D - (doc_id % 30) * 86400.0D END AS audited", "int(doc_id % 7) AS rotate_used", "CASE WHEN doc_id % 3 = 0 THEN 0.0D ELSE 1700000000.0D - (doc_id % 50) * 86400.0D END AS rotate_used_at",
        "array(named_struct('subject', concat('qq:', doc_id % 9), 'predicate', element_at(array('认为', 'colleague', 'friend', 'lives in'), int(doc_id % 4 + 1)), 'object', CASE WHEN doc_id % 3 = 0 THEN concat('qq:', doc_id % 5) ELSE concat('town', doc_id % 6) END)) AS relations",
        "array(lang) AS tags", "concat('x', doc_id % 200) AS fingerprint", "CASE WHEN doc_id % 2 = 0 THEN 0.0D ELSE 5.0D END AS event_at", "0.0D AS event_end", "concat('qq:', doc_id % 6) AS src_user",
    )


def names(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "nation").selectExpr("concat('qq:', n_nationkey % 9) AS entity", "n_name AS name", "n_nationkey * 10.0D AS observed")


def entities(spark: SparkSession, d: str) -> DataFrame:
    return names(spark, d).groupBy("entity").agg(F.max("observed").alias("updated"))


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "embeddings").selectExpr("concat('m', vec_id % 25, '-', vec_id DIV 25) AS id", "CASE WHEN vec_id % 5 = 0 THEN 'old' ELSE 'new' END AS model", "1 AS revision", "cast(embedding AS array<double>) AS vector")


def q(sql: str):
    """A query on the views of BASE; ``sql`` begins with SELECT, or with further views."""
    return query(f"WITH {BASE} {sql}" if sql.startswith("SELECT") else f"WITH RECURSIVE {BASE}, {sql}")


RECALL = "deleted = 0 AND category <> 'media' AND cold = 0"
HITS = "list_has_any(users, ['qq:1', 'qq:2'])"


@q(f"SELECT id FROM records WHERE {RECALL} AND NOT (active = 0 AND archived_at > 0 AND archived_at <= {NOW} - 113 * 86400)")
def recallable_records(spark, d):
    return R.recallable(records(spark, d), NOW, 113).select("id")


@q(f"SELECT id, row_number() OVER (ORDER BY permanent DESC, level DESC, position, id) AS place FROM records WHERE active = 1 AND deleted = 0 AND (sid = 'qq:gm:3' OR visibility = 'global' OR (visibility = 'user' AND {HITS})) ORDER BY place LIMIT 40")
def context_order(spark, d):
    from pyspark.sql.window import Window

    rows = R.context(records(spark, d), "qq:gm:3", ["qq:1", "qq:2"]).limit(40)
    return rows.select("id", F.row_number().over(Window.orderBy(F.desc("permanent"), F.desc("level"), "position", "id")).alias("place"))


@q(f"SELECT id FROM records WHERE active = 1 AND deleted = 0 AND (sid = 'qq:gm:3' OR visibility = 'global' OR {HITS})")
def context_linked(spark, d):
    return R.context(records(spark, d), "qq:gm:3", ["qq:1", "qq:2"], "linked").select("id")


@q("SELECT id FROM records r WHERE contains(lower(content), 'nation_1') OR EXISTS (SELECT 1 FROM names n WHERE contains(lower(n.name), 'nation_1') AND (n.entity = r.sid OR list_contains(r.users, n.entity)))")
def keyword_with_names(spark, d):
    return R.with_keyword(records(spark, d), names(spark, d), "Nation_1").select("id")


@q("SELECT id FROM records WHERE level = 1 AND active = 1 AND list_contains(users, 'qq:2')")
def level_active_subject(spark, d):
    return records(spark, d).where((F.col("level") == 1) & (F.col("active") == 1) & F.array_contains("users", "qq:2")).select("id")


@q("SELECT e.entity FROM entities e WHERE EXISTS (SELECT 1 FROM names n WHERE n.entity = e.entity AND length(n.name) >= 2 AND instr('NATION_3 met NATION_12 and NATION_20', n.name) > 0) ORDER BY updated DESC, entity LIMIT 20")
def mentioned_entities(spark, d):
    return R.mentioned(entities(spark, d), names(spark, d), "NATION_3 met NATION_12 and NATION_20").select("entity")


@q("""known AS (SELECT DISTINCT entity FROM names WHERE lower(name) IN ('nation_2', 'nation_4')),
far AS (SELECT r.object AS token FROM (SELECT subject, unnest(relations) AS r FROM facts WHERE deleted = 0 AND subject IN (SELECT entity FROM known)) WHERE r.subject = subject)
SELECT token FROM far WHERE length(token) >= 2 AND NOT contains(token, ':') UNION SELECT unnest(['nation_2', 'nation_4']) AS token""")
def query_expansion_names(spark, d):
    return R.expanded(["nation_2", "nation_4"], names(spark, d), facts(spark, d))


@q("""probe AS (SELECT vector AS q FROM vectors WHERE id = 'm7-0'),
s AS (SELECT r.id, CASE WHEN v.vector IS NULL THEN -1 ELSE list_dot_product(vector, q) / (sqrt(list_dot_product(vector, vector)) * sqrt(list_dot_product(q, q))) END AS cosine FROM records r LEFT JOIN (SELECT id, vector FROM vectors WHERE model = 'new' AND revision = 1) v USING (id), probe)
SELECT id, round(cosine, 6) AS cosine FROM s""")
def vector_scores_by_model(spark, d):
    probe = vectors(spark, d).where("id = 'm7-0'").select("vector").scalar()
    return R.vector_scores(records(spark, d), vectors(spark, d), probe, "new", 1).select("id", F.round("cosine", 6).alias("cosine"))


@q("SELECT id FROM vectors WHERE len(list_filter(vector, lambda x: isfinite(x))) = len(vector) AND len(vector) > 0")
def finite_vectors(spark, d):
    return R.finite_vectors(vectors(spark, d)).select("id")


@q(f"rows_ AS (SELECT * FROM records WHERE {RECALL}), over_ AS (SELECT sid, level, start, \"end\" AS e FROM rows_ WHERE active = 1 AND deleted = 0) SELECT id FROM rows_ a WHERE active = 0 AND EXISTS (SELECT 1 FROM over_ b WHERE a.sid = b.sid AND b.level > a.level AND b.start <= a.start AND b.e >= a.\"end\")")
def folded_in_result(spark, d):
    r = records(spark, d)
    return R.folded(R.recallable(r), r)


PROBE = 'SELECT sid, count(*) FILTER (permanent = 0) AS total, count(*) FILTER (permanent = 0 AND level > 0) AS upper, min("end") AS oldest, max("end") AS newest FROM records WHERE active = 1 AND deleted = 0 GROUP BY sid'


@q(PROBE)
def compress_probe(spark, d):
    return R.probe(records(spark, d))


@q(f"p AS ({PROBE}) SELECT sid, coalesce(upper >= 4 OR total >= 12 OR (total > 0 AND oldest < {NOW + 400_000} - 3 * 86400 AND newest < {NOW + 400_000} - 6 * 3600), false) AS worth FROM p")
def planner_precheck(spark, d):
    return R.worth_planning(R.probe(records(spark, d)), NOW + 400_000, boost=True).select("sid", "worth")


@q("""x AS (SELECT *, CASE WHEN role = 'user' AND lag(role) OVER (PARTITION BY sid, level ORDER BY position, id) <> 'user' THEN 1 ELSE 0 END AS closes FROM records WHERE active = 1 AND deleted = 0),
g AS (SELECT sid, level, count(*) AS n, CASE WHEN bool_or(role = 'assistant') THEN sum(closes) ELSE 0 END AS rounds FROM x GROUP BY sid, level)
SELECT sid, level, CAST(rounds AS BIGINT) AS rounds, CAST(greatest(1, least(12, CASE WHEN level > 0 THEN n WHEN rounds > 0 THEN least(rounds, ceil(n / 6)) ELSE ceil(n / 6) END)) AS BIGINT) AS cap FROM g""")
def fact_caps(spark, d):
    return R.fact_caps(records(spark, d))


@q("SELECT sid, count(*) FILTER (active = 1 AND cold = 0) AS live, count(*) FILTER (active = 0 OR cold = 1) AS archived FROM records WHERE permanent = 1 AND deleted = 0 GROUP BY sid")
def pinned_stats(spark, d):
    return R.pinned_stats(records(spark, d))


@q("SELECT id FROM records WHERE position < 6 AND NOT (permanent = 1 AND deleted = 0 AND active = 1 AND cold = 0)")
def untidyable_ids(spark, d):
    r = records(spark, d)
    return R.untidyable(r.where("position < 6").select("id", "position"), r).select("id")


@q("SELECT EXISTS (SELECT 1 FROM records WHERE permanent = 1 AND deleted = 0 AND importance > 9) AS found")
def exists_probe(spark, d):
    return R.exists(records(spark, d).where("permanent = 1 AND deleted = 0 AND importance > 9"))


@q(f"""a AS (SELECT sid, min(audited) AS oldest FROM facts WHERE deleted = 0 AND merge_pending = 0 AND (audited = 0 OR audited < {NOW} - 864000) GROUP BY sid),
u AS ((SELECT *, 0 AS band FROM a WHERE sid IN ('global', 'qq:gm:6') ORDER BY oldest, sid LIMIT 1) UNION ALL (SELECT *, 1 FROM a ORDER BY oldest, sid LIMIT 4))
SELECT sid, min(band) AS band FROM u GROUP BY sid ORDER BY min(band), min(oldest), sid LIMIT 4""")
def sessions_by_audit_age(spark, d):
    return R.sessions_by_audit(facts(spark, d), NOW, 864000, 4, ["global", "qq:gm:6"])


@q("""latest AS (SELECT entity, max_by(name, (observed, name)) AS name FROM names GROUP BY entity), subjects AS (SELECT DISTINCT lower(n_name) AS subject FROM nation)
SELECT subject, min(entity) AS entity, min(name) AS name FROM subjects JOIN latest ON subject = lower(name) GROUP BY subject""")
def name_map(spark, d):
    return R.name_map(names(spark, d), t(spark, d, "nation").select(F.lower("n_name").alias("subject")))


@q("""known AS (SELECT id, 'k' || id AS code FROM facts WHERE deleted = 1), new AS (SELECT id FROM facts WHERE deleted = 0 UNION SELECT id FROM records),
one AS (SELECT min(id) AS id, substr(sha256(id), 1, 6) AS code FROM new GROUP BY 2), two AS (SELECT min(id) AS id, substr(sha256(id), 1, 10) AS code FROM new WHERE id NOT IN (SELECT id FROM one) GROUP BY 2)
SELECT * FROM known UNION ALL SELECT * FROM one UNION ALL SELECT * FROM two""")
def short_codes(spark, d):
    f = facts(spark, d)
    known = f.where("deleted = 1").select("id", F.concat(F.lit("k"), "id").alias("code"))
    return R.short_codes(f.select("id").unionByName(records(spark, d).select("id")), known)


@q("r AS (SELECT id, row_number() OVER (ORDER BY importance / 20 DESC, id) AS rank, importance / 20 AS s FROM (SELECT * FROM records WHERE sid = 'qq:gm:2')) SELECT id, rank FROM r WHERE s >= 0.3 OR rank <= 2")
def refine_with_floor(spark, d):
    rows = records(spark, d).where("sid = 'qq:gm:2'").withColumn("s", F.col("importance") / 20)
    return R.refined(rows, "s", ["id"], 0.3).select("id", "rank")


MERGES = "(SELECT 'm' || conv_id || '-4' AS target, 'm' || conv_id || '-' || turn AS id, 'joined ' || conv_id AS content FROM conversations WHERE turn IN (4, 9))"


@q(f"""home AS (SELECT id AS target, sid AS home FROM records WHERE permanent = 1 AND deleted = 0),
plan AS (SELECT m.* FROM {MERGES} m JOIN home USING (target) JOIN records r ON r.id = m.id AND r.permanent = 1 AND r.deleted = 0 AND r.sid = home)
SELECT r.id, CASE WHEN target = r.id THEN p.content ELSE r.content END AS content, CASE WHEN target <> r.id THEN 0 ELSE active END AS active, CASE WHEN target <> r.id THEN 1 ELSE cold END AS cold, revision + CASE WHEN target IS NULL THEN 0 ELSE 1 END AS revision FROM records r LEFT JOIN plan p ON p.id = r.id""")
def merge_pinned(spark, d):
    c = t(spark, d, "conversations").where("turn IN (4, 9)")
    return R.merge_pinned(records(spark, d), c.selectExpr("concat('m', conv_id, '-4') AS target", "concat('m', conv_id, '-', turn) AS id", "concat('joined ', conv_id) AS content"))


@q("SELECT id, 1 AS active, 0 AS cold, revision + 1 AS revision FROM records WHERE position < 4 AND deleted = 0 AND (active = 0 OR cold = 1) UNION ALL SELECT id, active, cold, revision FROM records WHERE NOT (position < 4 AND deleted = 0 AND (active = 0 OR cold = 1))")
def reactivate(spark, d):
    r = records(spark, d)
    return R.reactivated(r, r.where("position < 4").select("id")).select("id", "active", "cold", "revision")


@q("SELECT id, CASE WHEN position = 6 THEN 0 ELSE deleted END AS deleted FROM records")
def undelete(spark, d):
    r = records(spark, d)
    return R.reactivated(r, r.where("position = 6").select("id"), True).select("id", "deleted")


@q("SELECT id FROM records WHERE deleted = 1 ORDER BY coalesce(nullif(archived_at, 0), \"end\") DESC, id LIMIT 15")
def trash_listing(spark, d):
    return R.trash(records(spark, d)).limit(15).select("id")


@q("""told AS (SELECT DISTINCT r.id FROM records r JOIN facts f ON f.id = 'f' || (CAST(r.position AS BIGINT) * 7 + 1) WHERE f.deleted = 0 AND f.category <> 'event')
SELECT sid, count(*) = count(told.id) AS only FROM records r LEFT JOIN told ON told.id = r.id WHERE deleted = 0 GROUP BY sid""")
def distilled_only(spark, d):
    r = records(spark, d)
    return R.distilled_only(r, r.selectExpr("id AS record_id", "concat('f', position * 7 + 1) AS source_key"), facts(spark, d))


@q("SELECT sid, 'r' || row_number() OVER (PARTITION BY sid ORDER BY position, id) AS alias, id, users[1] || '/' || role AS who FROM records WHERE active = 1 AND deleted = 0")
def record_aliases(spark, d):
    return R.aliases(records(spark, d))


JOBS = "(SELECT event_id AS id, CASE event_type WHEN 'error' THEN 'failed' WHEN 'view' THEN 'running' ELSE 'done' END AS state, epoch(ts) AS updated FROM events)"


@q(f"last AS (SELECT id FROM {JOBS} ORDER BY updated DESC, id LIMIT 50) SELECT id, state FROM {JOBS} WHERE state = 'running' OR updated >= 1706000000 - 7 * 86400 OR id IN (SELECT id FROM last)")
def job_prune(spark, d):
    jobs = t(spark, d, "events").select(F.col("event_id").alias("id"), F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "view", "running").otherwise("done").alias("state"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("updated"))
    return R.prune_jobs(jobs, 1706000000, 50, 7).select("id", "state")


SHARED = f"deleted = 0 AND (sid = 'qq:gm:3' OR sid = 'global' OR EXISTS (SELECT 1 FROM records r WHERE list_contains(f.sources, r.id) AND r.deleted = 0 AND (r.visibility = 'global' OR (r.visibility = 'user' AND list_has_any(r.users, ['qq:1', 'qq:2'])))))"


@q(f"SELECT id FROM facts f WHERE {SHARED}")
def shared_facts(spark, d):
    return FA.shared_facts(facts(spark, d), records(spark, d), "qq:gm:3", ["qq:1", "qq:2"]).select("id")


WORDS = "CASE WHEN contains(lower(content), 'wandering') THEN 9 ELSE 0 END + CASE WHEN contains(lower(content), 'ation') THEN 5 ELSE 0 END"


@q(f"s AS (SELECT *, {WORDS} AS score, CASE WHEN sid = 'qq:gm:2' THEN 0 WHEN subject IN ('qq:1', 'qq:4') THEN 1 ELSE 2 END AS tier, CASE WHEN subject IN ('qq:5') THEN 0 ELSE 1 END AS near FROM facts WHERE deleted = 0) SELECT id, tier, score FROM s WHERE score >= 5 ORDER BY tier, near, score DESC, importance DESC, created DESC, id LIMIT 30")
def facts_ranked(spark, d):
    return FA.ranked_facts(facts(spark, d), "wandering ation", 30, "qq:gm:2", ["qq:1", "qq:4"], subjects=["qq:5"], min_score=5, by_importance=True).select("id", "tier", "score")


@q(f"SELECT id FROM facts WHERE deleted = 0 AND merge_pending = 0 AND (audited = 0 OR audited < {NOW} - 15 * 86400) ORDER BY audited, id LIMIT 25")
def audit_candidates(spark, d):
    return FA.audit_candidates(facts(spark, d), NOW, 15 * 86400, 25).select("id")


@q("""x AS (SELECT f.id, min(r.start) AS low, max(r.start) AS high FROM (SELECT id, unnest(sources) AS source FROM facts) f JOIN records r ON r.id = f.source GROUP BY f.id)
SELECT id, coalesce(high, 0) AS "time", coalesce(nullif(event_at, 0), low, 0) AS event_at, coalesce(nullif(event_end, 0), high, 0) AS event_end FROM facts LEFT JOIN x USING (id)""")
def fact_times(spark, d):
    return FA.with_time(facts(spark, d), records(spark, d)).select("id", "time", "event_at", "event_end")


CLASS = r"[\s，。、；：！？,.!?;:''\"“”‘’()（）\[\]【】<>《》\-—~～/\\]+"


def grams(c: str) -> str:
    n = f"regexp_replace(lower({c}), '{CLASS}', '', 'g')"
    return f"list_distinct(list_transform(range(1, greatest(length({n}), 2)), lambda i: substr({n}, i, 2)))"


@q(f"""p AS (SELECT {grams('content')} AS q FROM facts WHERE id = 'f21'), s AS (SELECT id, len(list_intersect({grams('content')}, q)) AS both_, least(len({grams('content')}), len(q)) AS small FROM facts, p WHERE deleted = 0 AND merge_pending = 0 AND subject = 'qq:3' AND category = 'profile')
SELECT id, round(both_ / small, 6) AS similarity FROM s WHERE both_ >= 2 AND both_ / small >= 0.25 ORDER BY both_ / small DESC, id LIMIT 3""")
def similar_facts(spark, d):
    text = facts(spark, d).where("id = 'f21'").first()["content"]
    return FA.similar_facts(facts(spark, d), "", "qq:3", "profile", text, across=True).select("id", F.round("similarity", 6).alias("similarity"))


@q(f"""p AS (SELECT content AS c, {grams('content')} AS q FROM facts WHERE id = 'f23'), pool AS (SELECT * FROM facts WHERE deleted = 0 AND merge_pending = 0 AND sid IN ('qq:gm:2', 'global') ORDER BY importance DESC, created DESC, id LIMIT 800),
s AS (SELECT id, importance, created, CASE WHEN len(list_intersect(list_distinct(string_split(content, '')), list_distinct(string_split(c, '')))) >= 3 AND len(list_intersect({grams('content')}, q)) >= 3 THEN len(list_intersect({grams('content')}, q)) / least(len({grams('content')}), len(q)) ELSE 0 END AS score FROM pool, p)
SELECT id, round(score, 3) AS score FROM (SELECT * FROM s ORDER BY score DESC, importance DESC, created DESC, id LIMIT 1) WHERE score >= 0.4""")
def covering_fact(spark, d):
    text = facts(spark, d).where("id = 'f23'").first()["content"]
    return FA.covering_fact(facts(spark, d), "qq:gm:2", text)


REL = "rel AS (SELECT f.*, r.subject AS a, r.predicate AS p, r.object AS b FROM (SELECT *, unnest(relations) AS r FROM facts WHERE deleted = 0 AND merge_pending = 0) f)"
SOUND = "p <> '认为' AND a <> b"


@q(f"{REL} SELECT id, CASE WHEN a IN ('qq:2', 'town4') THEN b ELSE a END AS other, p AS predicate FROM rel WHERE {SOUND} AND category IN ('profile', 'relationship') AND subject <> 'qq:8' AND (a IN ('qq:2', 'town4') OR b IN ('qq:2', 'town4')) AND CASE WHEN a IN ('qq:2', 'town4') THEN b ELSE a END <> 'qq:2' ORDER BY importance DESC, created DESC, id, other LIMIT 30")
def related_facts(spark, d):
    return FA.related_facts(facts(spark, d), "qq:2", ["qq:2", "town4"], ["qq:8"]).select("id", "other", "predicate")


@q(f"""{REL}, e AS (SELECT a AS source, b AS target, count(*) AS n FROM rel WHERE {SOUND} GROUP BY a, b),
top AS (SELECT node FROM (SELECT source AS node, n FROM e UNION ALL SELECT target, n FROM e) GROUP BY node ORDER BY sum(n) DESC, node LIMIT 8) SELECT * FROM e WHERE source IN (SELECT node FROM top) AND target IN (SELECT node FROM top)""")
def graph_edges(spark, d):
    return FA.graph_edges(facts(spark, d), 8).select("source", "target", "n")


@q("SELECT subject, count(*) AS n FROM (SELECT subject, unnest(relations) AS r FROM facts WHERE deleted = 0) WHERE r.subject = subject GROUP BY subject")
def outgoing_relations(spark, d):
    return FA.outgoing(facts(spark, d))


@q("""r AS (SELECT subject, content, row_number() OVER (PARTITION BY subject ORDER BY importance DESC, audited DESC, id) AS k FROM facts WHERE deleted = 0),
top AS (SELECT subject, list(substr(content, 1, 24) ORDER BY k) AS summary FROM r WHERE k <= 3 GROUP BY subject)
SELECT subject, count(*) AS facts, max(audited) AS seen, any_value(summary) AS summary FROM facts JOIN top USING (subject) WHERE deleted = 0 GROUP BY subject""")
def entity_summaries(spark, d):
    return FA.entity_summaries(facts(spark, d))


SINK = f"(SELECT *, CAST(round_even(importance * 2 + least(rotate_used, 5) * CASE WHEN rotate_used_at > 0 THEN pow(0.5, ({NOW} - rotate_used_at) / 86400 / 60) ELSE 1 END * 3 + CASE WHEN created > 0 THEN greatest(0, 10 * (1 - ({NOW} - created) / 86400 / 60)) ELSE 0 END, 0) AS INT) AS score FROM facts)"


@q(f"SELECT id, score, importance < 8 AND created > 0 AND score < 16 AS sinks FROM {SINK}")
def sink_scores(spark, d):
    return FA.with_sink(facts(spark, d), NOW, 16).select("id", "score", "sinks")


@q(f"SELECT id FROM {SINK} WHERE NOT (importance < 8 AND created > 0 AND score < 16)")
def sink_filter(spark, d):
    return FA.sink_filter(facts(spark, d), NOW, 16).select("id")


@q(f"SELECT id, score FROM (SELECT * FROM {SINK} WHERE deleted = 0 ORDER BY importance, created, id LIMIT 20 OFFSET 5)")
def fact_health_page(spark, d):
    return FA.health_page(facts(spark, d), NOW, 16, 20, 5).select("id", "score")


@q("SELECT id, src_user = 'qq:5' AS is_self FROM facts WHERE NOT (src_user = 'qq:5' AND importance <= 6)")
def low_value_self(spark, d):
    return FA.self_last(facts(spark, d), "qq:5", 6).select("id", "is_self")


@q("SELECT id, category, CASE category WHEN 'event' THEN 6 WHEN 'fact' THEN 7 WHEN 'preference' THEN 2 WHEN 'commitment' THEN 1 WHEN 'relationship' THEN 4 WHEN 'profile' THEN 3 WHEN 'resource' THEN 5 ELSE 9 END AS rank FROM facts ORDER BY rank, importance DESC, created DESC, id LIMIT 30")
def category_rank_order(spark, d):
    return facts(spark, d).withColumn("rank", X.category_rank(F.col("category"))).orderBy("rank", F.desc("importance"), F.desc("created"), "id").limit(30).select("id", "category", "rank")


@q("SELECT sid, subject, fingerprint, min(id) AS id, list_sort(list_distinct(flatten(list(sources)))) AS sources, list_sort(list_distinct(flatten(list(tags)))) AS tags, max(importance) AS importance, count(*) AS n FROM facts WHERE deleted = 0 GROUP BY sid, subject, fingerprint")
def dedupe_rewritten(spark, d):
    return FA.dedupe_rewritten(facts(spark, d))


@q("n AS (SELECT sid, subject, content, max(created) AS created FROM facts GROUP BY ALL) SELECT sid, subject, substr(string_agg(content, '；' ORDER BY -created, content), 1, 400) AS content FROM n GROUP BY sid, subject")
def fallback_text(spark, d):
    return FA.fallback_text(facts(spark, d), ["sid", "subject"])


@q("""own AS (SELECT f.id, bool_and(role = 'assistant') AS own FROM (SELECT id, unnest(sources) AS source FROM facts) f JOIN records r ON r.id = f.source GROUP BY f.id),
v AS (SELECT f.*, CASE CAST(substr(id, 2) AS BIGINT) % 3 WHEN 0 THEN 'keep' WHEN 1 THEN 'correct' ELSE 'retract' END AS action, own FROM facts f LEFT JOIN own USING (id) WHERE deleted = 0),
x AS (SELECT *, CASE WHEN coalesce(own, false) THEN least(importance, least(importance + 3, 10)) ELSE least(importance + 3, 10) END AS level, CASE WHEN action = 'correct' THEN 'new text' ELSE content END AS said FROM v)
SELECT id, said AS content, level AS importance, CASE action WHEN 'retract' THEN 1 ELSE 0 END AS deleted, said <> content OR level <> importance OR action = 'retract' AS changed FROM x""")
def audit_verdicts(spark, d):
    f = facts(spark, d)
    n = F.pmod(F.substring("id", 2, 20).cast("long"), F.lit(3))
    v = f.select("id", F.when(n == 0, "keep").when(n == 1, "correct").otherwise("retract").alias("action"), (F.col("importance") + 3).alias("importance"), F.lit("new text").alias("content"))
    return FA.audited(f, v, records(spark, d))


@q("""h AS (SELECT * FROM records WHERE deleted = 0 AND contains(lower(content), 'the')), one AS (SELECT sid, min_by(id, (start, id)) AS one FROM h GROUP BY sid),
c AS (SELECT DISTINCT f.id FROM (SELECT id, unnest(sources) AS s FROM facts) f JOIN h ON h.id = f.s)
SELECT f.id, CASE WHEN c.id IS NULL AND one IS NOT NULL AND NOT list_contains(sources, one) THEN list_append(list_distinct_(sources), one) ELSE list_distinct_(sources) END AS sources FROM facts f LEFT JOIN c ON c.id = f.id LEFT JOIN one ON one.sid = f.sid WHERE deleted = 0""".replace("list_distinct_(sources)", "CASE WHEN sources[1] = sources[2] THEN sources[1:1] ELSE sources END"))
def widen_sources(spark, d):
    return FA.widen_sources(facts(spark, d), records(spark, d), "the")


@q("""r AS (SELECT subject, id, CASE category WHEN 'event' THEN 'ev' WHEN 'fact' THEN 'fa' WHEN 'preference' THEN 'pr' WHEN 'commitment' THEN 'co' WHEN 'relationship' THEN 're' WHEN 'profile' THEN 'pf' WHEN 'resource' THEN 'rs' ELSE 'sf' END || '|' || content || '|' || importance || '|' || relations[1].subject || '>' || relations[1].predicate || '>' || relations[1].object AS line FROM facts WHERE deleted = 0)
SELECT subject, list(line ORDER BY id) AS rows FROM r GROUP BY subject""")
def grouped_facts(spark, d):
    return FA.grouped_rows(facts(spark, d))


def _values(table: dict) -> str:
    return ", ".join(f"('{a}', '{b}')" for a, b in table.items())


NAMED = [" Event", "喜好", "misc", "Custom ", "SELF", "画像", "note"]


@query(f"""WITH d AS (SELECT doc_id, [{', '.join(f"'{x}'" for x in NAMED)}][doc_id % 7 + 1] || CASE WHEN doc_id % 3 = 0 THEN ' ' ELSE '' END AS name FROM documents), a AS (SELECT * FROM (VALUES {_values(X.CATEGORY_ALIASES)}) v(alias, category))
SELECT doc_id, CASE WHEN lower(trim(name)) IN ({', '.join(f"'{x}'" for x in X.CATEGORY_CODES)}) THEN lower(trim(name)) ELSE coalesce(category, trim(name)) END AS category FROM d LEFT JOIN a ON alias = lower(trim(name))""")
def category_aliases(spark, d):
    name = F.concat(F.get(F.array(*map(F.lit, NAMED)), (F.col("doc_id") % 7).cast("int")), F.when(F.col("doc_id") % 3 == 0, " ").otherwise(""))
    return t(spark, d, "documents").select("doc_id", X.category(name).alias("category"))


@query(r"""SELECT doc_id, sha256(regexp_replace(regexp_replace(regexp_replace('  ' || replace(coalesce(text, ''), ' ', '   ') || chr(1), '[\x00-\x08\x0b\x0c\x0e-\x1f]', '', 'g'), '[ \t]{2,}', ' ', 'g'), '^\s+|\s+$', '', 'g')
|| CASE WHEN text <> '' THEN chr(10) ELSE '' END || '翅膀很美 a 文') AS squeezed FROM documents""")
def squeezed_text(spark, d):
    mangled = F.concat(F.lit("  "), F.replace(F.coalesce("text", F.lit("")), F.lit(" "), F.lit("   ")), F.lit("\x01\n翅 膀\t很 美  a 文 "))
    return t(spark, d, "documents").select("doc_id", F.sha2(X.squeeze(mangled), 256).alias("squeezed"))


WORDS_SQL = "regexp_extract_all(lower(coalesce(text, '') || ' 我喜欢猫'), '[a-z0-9_]+|[㐀-鿿]+')"
PAIRS_SQL = "list_transform(range(1, length(x)), lambda i: substr(x, i, 2))"


@query(f"""SELECT conv_id, turn, array_to_string(flatten(list_transform({WORDS_SQL}, lambda x: list_concat(list_filter(string_split(x, ''), lambda y: y <> ''), {PAIRS_SQL}))), ' ') AS body,
list_sort(list_filter(list_distinct(flatten(list_transform({WORDS_SQL}, lambda x: CASE WHEN length(x) < 2 OR regexp_matches(x, '^[a-z0-9_]') THEN [x] ELSE {PAIRS_SQL} END))), lambda x: x NOT IN ({', '.join(f"'{x}'" for x in X.STOP)}))) AS tokens FROM conversations""")
def search_bodies(spark, d):
    text = F.concat(F.coalesce("text", F.lit("")), F.lit(" 我喜欢猫"))
    return t(spark, d, "conversations").select("conv_id", "turn", X.search_body(text).alias("body"), X.tokens_of(text).alias("tokens"))


REPLY = "the wandering station 123456 bright leaves"
TOKENS_SQL = "list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9_]+'), lambda x: length(x) >= 2 AND x NOT IN ('the', 'and', 'that', 'with')))"


@query(f"SELECT doc_id, len({TOKENS_SQL}) > 0 AND (len(list_filter({TOKENS_SQL}, lambda x: contains('{REPLY}', x))) >= 2 OR len(list_filter(regexp_extract_all(text, '[0-9]{{5,}}'), lambda x: contains('{REPLY}', x))) > 0) AS hit FROM documents")
def reply_overlap(spark, d):
    return t(spark, d, "documents").select("doc_id", X.overlap_hit(F.col("text"), REPLY).alias("hit"))


@query("SELECT doc_id, CASE WHEN contains(lower(text), 'wandering') THEN 9 ELSE 0 END + CASE WHEN contains(lower(text), 'leaf') THEN 4 ELSE 0 END AS score FROM documents")
def row_relevance(spark, d):
    return t(spark, d, "documents").select("doc_id", X.relevance(F.col("text"), "the WANDERING leaf").alias("score"))


@query("SELECT event_id, CASE WHEN year(ts) = 2024 THEN strftime(ts, '%m-%d %H:%M') ELSE strftime(ts, '%Y-%m-%d %H:%M') END AS short, strftime(ts, '%Y-%m-%d %H:%M') AS \"full\" FROM events")
def event_times(spark, d):
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return t(spark, d, "events").select("event_id", X.short_time(at, 2024).alias("short"), X.full_time(at).alias("full"))


@query("""WITH s AS (SELECT event_id, event_id % 7 AS k, date_trunc('second', ts) AS ts FROM events)
SELECT event_id, CASE k WHEN 0 THEN epoch(ts) WHEN 1 THEN epoch(ts) WHEN 2 THEN epoch(ts) - 19800 WHEN 3 THEN epoch(ts) WHEN 4 THEN epoch(date_trunc('day', ts)) ELSE 9e0 END AS epoch,
CASE WHEN k IN (0, 1, 2, 4) THEN 'source.time' WHEN k = 3 THEN 'source.timestamp' ELSE 'file_mtime_estimate' END AS basis FROM s""")
def parsed_times(spark, d):
    ts, k = F.date_trunc("second", F.col("ts")).cast("timestamp_ntz").cast("string"), F.col("event_id") % 7
    seconds = F.timestamp_diff("SECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col("ts")).cast("string")
    s = F.when(k == 0, F.concat(F.replace(ts, F.lit(" "), F.lit("T")), F.lit("Z"))).when(k == 1, ts).when(k == 2, F.concat(ts, F.lit("+05:30"))).when(k == 3, seconds).when(k == 4, F.replace(F.substring(ts, 1, 10), F.lit("-"), F.lit(""))).when(k == 5, F.concat(F.lit("-"), seconds)).otherwise("soon")
    return t(spark, d, "events").withColumn("x", X.parsed_time(s, F.lit(9.0))).select("event_id", F.col("x.at").alias("epoch"), "x.basis")


@query("SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 5 WHEN 1 THEN 5 WHEN 2 THEN 1 ELSE CAST(least(greatest(round_even(o_orderkey % 27 / 2, 0), 1), 10) AS INT) END AS importance FROM orders")
def importance_clamp(spark, d):
    k = F.col("o_orderkey") % 5
    s = F.when(k == 0, "x").when(k == 1, "nan").when(k == 2, "-3.5").otherwise((F.col("o_orderkey") % 27 / 2).cast("string"))
    return t(spark, d, "orders").select("o_orderkey", X.importance_of(s).alias("importance"))


@q("SELECT DISTINCT entity || '(' || name || ')' AS pair, entity AS bare FROM names")
def named_pairs(spark, d):
    return names(spark, d).withColumn("pair", X.named_pair(F.col("entity"), F.col("name"))).select("pair", X.bare_id(F.col("pair")).alias("bare")).distinct()


SHELLS = {0: ("[图文] ", ""), 1: ("@123456 @小明！", None), 2: ("[Reply 5] ", ""), 3: ("", "[Image a"), 4: ("[Sticker2] ", ""), 5: ("[At 12] <at 3> ↩7 @小明", None), 6: ("[Reply ID: -13", None), 7: ("@他就好了 ", ""), 8: ("[photo] ", "")}


@query("SELECT conv_id, turn, CASE WHEN (conv_id + turn) % 9 IN (0, 1, 5, 6, 8) THEN true WHEN (conv_id + turn) % 9 = 7 THEN false ELSE NOT regexp_matches(coalesce(text, '') || CASE (conv_id + turn) % 9 WHEN 3 THEN '[Image a' ELSE '' END, '[0-9A-Za-z一-鿿]') END AS media FROM conversations")
def media_messages(spark, d):
    """Known names are 小明; (conv_id + turn) % 9 says which shell the message is put into."""
    k, text = (F.col("conv_id") + F.col("turn")) % 9, F.coalesce("text", F.lit(""))
    s = F.coalesce(*[F.when(k == n, F.lit(a) if z is None else F.concat(F.lit(a), text, F.lit(z))) for n, (a, z) in SHELLS.items()])
    return t(spark, d, "conversations").select("conv_id", "turn", C.media_only(s, ["小明"]).alias("media"))


@query("""SELECT conv_id, turn, (conv_id + turn) % 4 IN (0, 2) AND (conv_id + turn) % 3 <> 0 AS payload, (conv_id + turn) % 4 IN (0, 3) AS tool FROM conversations""")
def tool_texts(spark, d):
    k, body = (F.col("conv_id") + F.col("turn")) % 4, F.to_json(F.struct(F.lit(True).alias("ok"), F.coalesce("text", F.lit("")).alias("text")))
    body = F.when((F.col("conv_id") + F.col("turn")) % 3 == 0, body).otherwise(F.regexp_replace(body, r'^\{"ok":true,', '{"ok" : true, "records": [],'))
    s = F.when(k == 0, F.concat(F.lit("工具感知结果： "), body)).when(k == 1, F.concat(F.lit("said "), body)).when(k == 2, body).otherwise(F.concat(F.lit(" 工具感知结果："), F.coalesce("text", F.lit(""))))
    return t(spark, d, "conversations").select("conv_id", "turn", C.memory_payload(s, ['"records"']).alias("payload"), C.tool_result(s).alias("tool"))


@q("""s AS (SELECT id, sid, position, length(to_json({'id': id, 'position': position})) AS n FROM records WHERE deleted = 0), p AS (SELECT id, CAST(sum(n) OVER w AS BIGINT) AS used, row_number() OVER w AS k FROM s WINDOW w AS (PARTITION BY sid ORDER BY position, id))
SELECT id, used FROM p WHERE used <= 300 OR k = 1""")
def payload_budget(spark, d):
    return R.packed(records(spark, d).where("deleted = 0"), ["sid"], ["position", "id"], F.struct("id", "position"), 300).select("id", F.col("used").cast("long").alias("used"))


COLD = f"(((cold = 1 AND (archived_at = 0 OR archived_at <= {NOW} - 30 * 86400)) OR deleted = 1) AND trim(content) <> '')"


@q(f"SELECT id AS record_id, content FROM records WHERE {COLD}")
def cold_spill(spark, d):
    return L.spill_cold(records(spark, d), NOW, 30)[1].select("record_id", "content")


@q(f"SELECT id, CASE WHEN {COLD} THEN 0 ELSE length(content) END AS hot, coalesce(length(nullif(trim(content), '')), 0) > 0 AS back FROM records")
def cold_fill(spark, d):
    hot, cold = L.spill_cold(records(spark, d), NOW, 30)
    filled = L.fill_cold(hot, cold).select("id", (F.length("content") > 0).alias("back"))
    return hot.select("id", F.length("content").alias("hot")).join(filled, "id")


@q("SELECT id FROM facts f WHERE EXISTS (SELECT 1 FROM (SELECT unnest(f.sources) AS s)) AND NOT EXISTS (SELECT 1 FROM records r WHERE list_contains(f.sources, r.id) AND r.deleted = 0)")
def orphan_facts(spark, d):
    return L.orphans(facts(spark, d), records(spark, d)).select("id")


@query("""WITH known AS (SELECT 'qq:' || s_suppkey AS id, s_suppkey AS n FROM supplier UNION ALL SELECT 'wx:' || s_suppkey, s_suppkey FROM supplier WHERE s_suppkey % 7 = 0),
one AS (SELECT n, min(id) AS target FROM known GROUP BY n HAVING count(*) = 1)
SELECT CASE WHEN c_custkey % 2 = 0 THEN 'legacy:user:' ELSE 'qq:' END || c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN coalesce(target, 'legacy:user:' || c_custkey) ELSE 'qq:' || c_custkey END AS resolved FROM customer LEFT JOIN one ON n = c_custkey""")
def identity_resolution(spark, d):
    sup = t(spark, d, "supplier")
    known = sup.selectExpr("concat('qq:', s_suppkey) AS id").union(sup.where("s_suppkey % 7 = 0").selectExpr("concat('wx:', s_suppkey)"))
    ids = t(spark, d, "customer").selectExpr("concat(CASE WHEN c_custkey % 2 = 0 THEN 'legacy:user:' ELSE 'qq:' END, c_custkey) AS id")
    return L.resolve_identities(ids, known)


SHOWN = "(SELECT user_id, count(*) FILTER (event_type = 'view') AS shown, count(*) FILTER (event_type = 'click') AS used FROM events GROUP BY user_id)"


@query(f"WITH n AS (SELECT c_custkey AS item, c_custkey AS position, coalesce(shown, 0) AS shown, coalesce(used, 0) AS used FROM customer LEFT JOIN {SHOWN} ON user_id = c_custkey WHERE c_custkey % 3 = 0) SELECT item, shown, used FROM n ORDER BY shown > 0, CASE WHEN shown > 0 THEN used / shown ELSE 0 END DESC, shown, position LIMIT 400")
def rotation_order(spark, d):
    log = t(spark, d, "events").select(F.col("user_id").alias("item"), F.when(F.col("event_type") == "view", "shown").when(F.col("event_type") == "click", "used").alias("kind"), F.col("ts").alias("at"))
    items = t(spark, d, "customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("item"), F.col("c_custkey").alias("position"))
    return L.rotation_order(items, L.rotation_counts(log), 400).select("item", "shown", "used")


FOLD = "p AS (SELECT *, row_number() OVER (PARTITION BY sid ORDER BY position, id) - 1 AS ordinal FROM records WHERE active = 1 AND deleted = 0 AND level = 0 QUALIFY ordinal < 5)"


def _fold(spark, d):
    from pyspark.sql.window import Window

    r = records(spark, d)
    at = F.row_number().over(Window.partitionBy("sid").orderBy("position", "id")) - 1
    plan = r.where("active = 1 AND deleted = 0 AND level = 0").select("sid", "id", at.alias("ordinal"), F.lit(1).alias("target_level")).where("ordinal < 5")
    return K.fold(r.drop("level"), plan)


@q(f"{FOLD} SELECT sid, 1 AS level, min(start) AS start, max(\"end\") AS \"end\", min(position) AS position, list_sort(list_distinct(flatten(list(users)))) AS users, count(*) AS children FROM p GROUP BY sid")
def archive_fold(spark, d):
    return _fold(spark, d)[0].select("sid", "level", "start", "end", "position", "users", "children")


@q(f"{FOLD}, a AS (SELECT sid, sha256(sid || '|1|' || string_agg(id, ',' ORDER BY ordinal)) AS parent FROM p GROUP BY sid) SELECT parent, id AS child, CAST(ordinal AS INT) AS ordinal FROM p JOIN a USING (sid)")
def archive_edges(spark, d):
    return _fold(spark, d)[1].select("parent", "child", "ordinal")


@q("SELECT subject, category, list_sort(list_distinct(flatten(list(sources)))) AS sources, list_sort(list_distinct(flatten(list(tags)))) AS tags, len(list_distinct(flatten(list(relations)))) AS n_relations, max(importance) AS importance, min(nullif(event_at, 0)) AS event_at, max(event_end) AS event_end FROM facts WHERE deleted = 0 GROUP BY subject, category")
def fact_merges(spark, d):
    merged = S.merge_facts(facts(spark, d).where("deleted = 0"), ["subject", "category"])
    return merged.select("subject", "category", "sources", "tags", F.size("relations").alias("n_relations"), "importance", "event_at", "event_end")


REASON = r"""CASE WHEN text IS NULL THEN 'invalid_text' WHEN length(text) > 4000 THEN 'too_long' WHEN NOT regexp_matches(text, '[\p{L}\p{N}]') THEN 'empty'
WHEN regexp_matches(text, '[\x00-\x08\x0b\x0c\x0e-\x1f]') THEN 'control_characters' WHEN regexp_matches(text, '^\s*(```|\{|\[|<)|</?\w+[^>]*>') THEN 'markup_or_serialized_output'
WHEN regexp_replace(text, '^\s+|\s+$', '', 'g') IN ('None', 'null') THEN 'placeholder' WHEN length(trim(text)) > 12 AND len(list_distinct(string_split(trim(text), ''))) < 3 THEN 'repetition' END"""
ENTRIES = f"e AS (SELECT 'k' || (doc_id % 300) AS key, sha256(trim(coalesce(text, ''))) AS digest, {REASON} AS reason FROM documents), good AS (SELECT DISTINCT key, digest FROM e WHERE reason IS NULL), fresh AS (SELECT * FROM good WHERE digest NOT IN (SELECT sha256(trim(coalesce(text, ''))) FROM documents WHERE doc_id % 5 = 0) OR substr(key, 2) <> '7')"


def _ingest(spark, d):
    from ..sources.legacy import ingest

    docs = t(spark, d, "documents")
    entries = docs.selectExpr("concat('k', doc_id % 300) AS key", "text", "'fact' AS category")
    ledger = docs.where("doc_id % 5 = 0").select(F.lit("old").alias("source"), F.lit("k7").alias("key"), F.sha2(F.trim(F.coalesce("text", F.lit(""))), 256).alias("digest"))
    return ingest(entries, ledger, "old")


@query(f"WITH {ENTRIES} SELECT sha256(concat_ws(chr(31), 'old', key, digest)) AS id, key FROM fresh")
def ingest_entries(spark, d):
    return _ingest(spark, d)[0].select("id", "key")


@query(f"WITH {ENTRIES} SELECT 'imported' AS reason, (SELECT count(*) FROM fresh) AS n UNION ALL SELECT 'duplicate', (SELECT count(*) FROM e WHERE reason IS NULL) - (SELECT count(*) FROM fresh) UNION ALL SELECT reason, count(*) FROM e WHERE reason IS NOT NULL GROUP BY reason")
def ingest_report(spark, d):
    return _ingest(spark, d)[1]


def _rows(spark, schema: str, *rows: str) -> DataFrame:
    """A frame of literals."""
    return spark.sql(f"SELECT * FROM VALUES {', '.join(rows)} AS v({schema})")


@q("""n AS (SELECT sid, count(*) AS rows_, max_by(id, (start, -row_number)) AS newest FROM (SELECT *, row_number() OVER (PARTITION BY sid ORDER BY id DESC) AS row_number FROM records) GROUP BY sid),
g AS (SELECT sid, min(id) AS first, max(id) AS last FROM records GROUP BY sid)
SELECT 2 * m AS verdict, sid AS grp, CASE WHEN m % 2 = 0 THEN first ELSE newest END AS target_id, CASE WHEN newest = last THEN [last] ELSE [newest, last] END AS source_ids FROM g JOIN n USING (sid), (SELECT 0) z, LATERAL (SELECT CAST(split_part(sid, ':', 3) AS INT) AS m)
UNION ALL SELECT 2 * m + 1, NULL, 'other', [last] FROM g, LATERAL (SELECT CAST(split_part(sid, ':', 3) AS INT) AS m)""")
def merge_verdicts(spark, d):
    """Of two verdicts on a session's records the first gets it; the target of every second session isn't a member."""
    r = records(spark, d)
    groups = r.select(F.lit("1").alias("batch"), F.col("sid").alias("grp"), "id", F.col("start").alias("time"))
    ends = r.groupBy("sid").agg(F.min("id").alias("first"), F.max("id").alias("last")).withColumn("m", F.element_at(F.split("sid", ":"), 3).cast("int"))
    one = ends.select(F.lit("1").alias("batch"), (2 * F.col("m")).alias("verdict"), F.when(F.col("m") % 2 == 0, F.col("first")).otherwise("zz").alias("target_id"), F.array("last", F.lit("q")).alias("source_ids"))
    two = ends.select(F.lit("1").alias("batch"), (2 * F.col("m") + 1).alias("verdict"), F.lit("other").alias("target_id"), F.array("last").alias("source_ids"))
    return K.pair_verdicts(groups, one.unionByName(two)).drop("batch")


@query("""WITH d AS (SELECT doc_id // 4 AS g, doc_id % 4 AS k, CASE WHEN doc_id % 4 = 0 THEN 't' || (doc_id // 4) ELSE 'u' || doc_id END AS id, 'said ' || doc_id || ' in ' || lang AS content FROM documents)
SELECT 't' || g AS target, id, content, CAST(row_number() OVER (PARTITION BY g ORDER BY k) - 1 AS INT) AS ordinal FROM d WHERE k < 3 AND (g % 5 <> 0 OR k <> 1) AND g % 7 <> 3 AND g IN (SELECT g FROM d GROUP BY g HAVING count(*) = 4)""")
def unmerged_facts(spark, d):
    """Texts of three documents put together, of every fifth group without the second; a fourth is a decoy. Every seventh
    merged text was written anew, so nothing of it can be taken apart."""
    docs = t(spark, d, "documents").select(F.floor(F.col("doc_id") / 4).alias("g"), (F.col("doc_id") % 4).alias("k"), F.concat(F.lit("said "), "doc_id", F.lit(" in "), "lang").alias("content"), "doc_id")
    docs = docs.withColumn("target", F.concat(F.lit("t"), "g")).withColumn("id", F.when(F.col("k") == 0, F.col("target")).otherwise(F.concat(F.lit("u"), "doc_id")))
    put = docs.groupBy("g", F.col("target").alias("id")).agg(F.array_sort(F.collect_list(F.when((F.col("k") < 3) & ((F.col("g") % 5 != 0) | (F.col("k") != 1)), F.struct("k", "content")))).alias("x"), F.count("*").alias("n"))
    merged = put.where("n = 4").select("id", F.concat(F.when(F.col("g") % 7 == 3, "new: ").otherwise(""), F.array_join(F.transform("x", lambda y: y.content), "；")).alias("content"))
    return K.take_apart(merged, docs.select("target", "id", "content"))


@query("""WITH p AS (SELECT page_id AS n, page_id % 5 AS k FROM pages) SELECT n AS page_id, CASE k WHEN 0 THEN 'legacy:global' WHEN 1 THEN 'legacy:user:qq:' || n WHEN 2 THEN 'qq:gm:' || n WHEN 3 THEN 'qq:dm:' || n ELSE 'legacy:unscoped' END AS sid,
CASE k WHEN 0 THEN 'global' WHEN 1 THEN 'user' ELSE 'session' END AS visibility, CASE k WHEN 0 THEN CASE WHEN n % 2 = 0 THEN 'legacy:self' ELSE 'legacy:global' END WHEN 1 THEN 'qq:' || n WHEN 2 THEN 'legacy:group:qq:' || n WHEN 3 THEN 'qq:dm:' || n ELSE 'legacy:user:x' || n END AS subject,
CASE WHEN k = 1 THEN ['qq:' || n] ELSE [] END AS users FROM p""")
def file_locations(spark, d):
    from ..sources.legacy import location

    n, k = F.col("page_id").cast("string"), F.col("page_id") % 5
    path = F.when(k == 0, F.concat(F.lit("global/"), F.when(F.col("page_id") % 2 == 0, "self").otherwise("notes"), F.lit("/a.toml"))).when(k == 1, F.concat(F.lit("entities/user_qq%3A"), n, F.lit("/p.toml"))).when(k == 2, F.concat(F.lit("entities/group_qq%3A"), n, F.lit("/p.toml"))).when(k == 3, "core.txt").otherwise(F.concat(F.lit("entities/user_x"), n, F.lit("/p.toml")))
    session = F.when(k == 0, "").when(k == 4, "bad").otherwise(F.concat(F.lit("qq:pm:"), n))
    return t(spark, d, "pages").withColumn("x", location(path, session)).select("page_id", "x.*")


@query("""WITH c AS (SELECT c_custkey AS n, c_custkey % 6 AS k FROM customer) SELECT n AS c_custkey, CASE WHEN k < 3 THEN 'qq' ELSE '' END AS adapter, CASE WHEN k < 3 THEN '' || n WHEN k = 3 THEN 'qq:xx:' || n WHEN k = 4 THEN 'plain' || n ELSE 'qq::' || n END AS number,
CASE k WHEN 1 THEN 'dm' WHEN 2 THEN 'gm' ELSE '' END AS kind FROM c""")
def identity_parts(spark, d):
    k = (F.col("c_custkey") % 6).cast("int")
    i = F.concat(F.get(F.array(*map(F.lit, ["qq:", "qq:pm:", "qq:gm:", "qq:xx:", "plain", "qq::"])), k), "c_custkey")
    return t(spark, d, "customer").withColumn("x", X.adapter_parts(i)).select("c_custkey", "x.*")


@query("""WITH c AS (SELECT c_custkey AS n, c_custkey % 4 AS k FROM customer) SELECT n AS c_custkey, CASE k WHEN 0 THEN 'user' WHEN 1 THEN 'group' END AS kind, CASE k WHEN 0 THEN '' WHEN 1 THEN 'qq' END AS adapter, CASE WHEN k < 2 THEN '' || n END AS number FROM c""")
def pending_identities(spark, d):
    k = (F.col("c_custkey") % 4).cast("int")
    i = F.concat(F.get(F.array(*map(F.lit, ["legacy:user:", "legacy:group:qq:", "legacy:global", "qq:"])), k), F.when(k != 2, F.col("c_custkey").cast("string")).otherwise(""))
    return t(spark, d, "customer").withColumn("x", X.pending_parts(i, "legacy:")).select("c_custkey", "x.*")


@q(f"""r AS (SELECT *, row_number() OVER w AS n, role = 'user' AND lag(role) OVER w <> 'user' AS closes FROM records WHERE active = 1 AND deleted = 0 AND permanent = 0 AND level = 0 WINDOW w AS (PARTITION BY sid, visibility ORDER BY position, id)),
b AS (SELECT sid, visibility, count(*) AS m, count(*) FILTER (closes) AS closed, max(CASE WHEN closes THEN n - 1 END) AS last FROM r GROUP BY sid, visibility),
pick AS (SELECT sid, visibility, CASE WHEN closed > 0 THEN last ELSE least(40, m) END AS take FROM b QUALIFY row_number() OVER (PARTITION BY sid ORDER BY m DESC, visibility) = 1)
SELECT r.sid, id, CAST(n - 1 AS INT) AS ordinal, 1 AS target_level FROM r JOIN pick USING (sid, visibility) WHERE n <= take""")
def compression_plan_boosted(spark, d):
    return K.fold_plan(records(spark, d), K.FoldSettings(max_chars=10**9), now=1.9e9)


LEX = "CASE WHEN contains(lower(content), 'wandering') THEN 9 ELSE 0 END + CASE WHEN contains(lower(content), 'ation') THEN 5 ELSE 0 END"


def _indexed(name: str, most: int):
    def run(spark, d):
        r = records(spark, d)
        return R.indexed_search(r, R.gram_index(r), "wandering ation", 25, most).select("id", "score")

    run.__name__ = name
    q(f"SELECT id, {LEX} AS score FROM records WHERE {LEX} > 0 ORDER BY score DESC, active DESC, \"end\", id LIMIT 25")(run)


_indexed("indexed_search", 10**9)
_indexed("indexed_search_beyond_cap", 1)


@q("SELECT entity, max_by(name, (observed, name)) AS name FROM (SELECT * FROM names UNION ALL SELECT entity, 'system', 9e9 FROM names) WHERE name <> 'system' GROUP BY entity")
def real_names(spark, d):
    n = names(spark, d)
    return R.real_names(n.unionByName(n.withColumn("name", F.lit("system")).withColumn("observed", F.lit(9e9))))


@q("SELECT (SELECT count(*) FROM records WHERE deleted = 0) AS n, (SELECT CAST(sum(permanent) AS BIGINT) FROM records WHERE deleted = 0) AS pinned, (SELECT count(DISTINCT sid) FROM records WHERE deleted = 0) AS sessions, (SELECT count(DISTINCT sid) FROM records WHERE deleted = 0 AND contains(sid, ':gm:')) AS groups, (SELECT count(DISTINCT u) FROM (SELECT unnest(users) AS u FROM records WHERE deleted = 0)) AS users, (SELECT count(*) FROM facts WHERE deleted = 0) AS facts")
def memory_totals(spark, d):
    return R.totals(records(spark, d), facts(spark, d))


@q("SELECT u AS user, count(*) AS n, count(DISTINCT sid) AS sessions FROM (SELECT sid, unnest(list_distinct(users)) AS u FROM records WHERE deleted = 0) GROUP BY u")
def rows_by_user(spark, d):
    return R.by_user(records(spark, d))


ITEMS = "(SELECT CASE WHEN doc_id % 3 = 0 THEN 'a' ELSE 'b' END AS source, 'k' || (doc_id % 50) AS key, CASE doc_id % 4 WHEN 1 THEN 'empty' WHEN 2 THEN 'too_long' END AS reason, 'm' || (doc_id % 20) || '-' || (doc_id % 5) AS record_id FROM documents)"


def _items(spark, d):
    return t(spark, d, "documents").selectExpr("CASE WHEN doc_id % 3 = 0 THEN 'a' ELSE 'b' END AS source", "concat('k', doc_id % 50) AS key", "CASE doc_id % 4 WHEN 1 THEN 'empty' WHEN 2 THEN 'too_long' END AS reason", "concat('m', doc_id % 20, '-', doc_id % 5) AS record_id")


@query(f"SELECT source, coalesce(reason, 'imported') AS reason, count(*) AS n, count(DISTINCT CASE WHEN reason IS NULL THEN key END) AS imported FROM {ITEMS} GROUP BY 1, 2")
def migration_status(spark, d):
    return R.migration_status(_items(spark, d))


@q(f"SELECT count(DISTINCT i.record_id) AS n FROM {ITEMS} i JOIN records r ON r.id = i.record_id WHERE deleted = 0 AND position % 2 = 0")
def ledger_unscoped(spark, d):
    r = records(spark, d).withColumn("sid", F.when(F.col("position") % 2 == 0, "legacy:unscoped").otherwise(F.col("sid")))
    return R.unscoped(_items(spark, d), r)


@q("s AS (SELECT 'm' || (vec_id % 25) || '-' || (vec_id // 25) AS id, label + vec_id / 1000 AS score FROM embeddings WHERE vec_id % 3 = 0) SELECT r.id, score FROM records r LEFT JOIN s USING (id) WHERE sid = 'qq:gm:1' ORDER BY score DESC NULLS LAST, position, r.id LIMIT 30")
def external_rerank(spark, d):
    s = t(spark, d, "embeddings").where("vec_id % 3 = 0").selectExpr("concat('m', vec_id % 25, '-', vec_id DIV 25) AS id", "label + vec_id / 1000 AS score")
    return R.reranked(records(spark, d).where("sid = 'qq:gm:1'"), s, ["position", "id"]).limit(30).select("id", "score")


@q("r AS (SELECT sid, id, row_number() OVER w AS n, sum(length(content)) OVER w AS used FROM records WHERE permanent = 1 AND deleted = 0 AND active = 1 WINDOW w AS (PARTITION BY sid ORDER BY importance DESC, id)) SELECT sid, id FROM r WHERE n > 4 OR (used > 900 AND n > 1)")
def pinned_over_cap(spark, d):
    return R.over_cap(records(spark, d), 4, 900)


@q(f"{FOLD}, a AS (SELECT sid, sha256(sid || '|1|' || string_agg(id, ',' ORDER BY ordinal)) AS parent, list(id ORDER BY ordinal) AS kids FROM p GROUP BY sid) SELECT parent AS id, kids AS children, [] AS parents FROM a UNION ALL SELECT id, [], [parent] FROM p JOIN a USING (sid)")
def archive_family(spark, d):
    return R.family(_fold(spark, d)[1])


@q("u AS (SELECT id, 1 AS band, created FROM facts WHERE category = 'commitment' AND deleted = 0 UNION ALL SELECT id, 2, created FROM facts WHERE subject = 'qq:3' AND deleted = 0) SELECT id, min(band) AS band FROM u GROUP BY id")
def banded_union(spark, d):
    f = facts(spark, d).where("deleted = 0").select("id", "created", "category", "subject")
    bands = f.where("category = 'commitment'").withColumn("band", F.lit(1)).unionByName(f.where("subject = 'qq:3'").withColumn("band", F.lit(2)))
    return R.first_wins(bands, ["id"], ["band", "created"]).select("id", "band")


SIM = f"g AS (SELECT id, sid, subject, category, {grams('content')} AS g FROM facts WHERE deleted = 0 AND merge_pending = 0 AND content <> ''), p AS (SELECT a.id AS a, b.id AS b, a.sid = b.sid AS same, a.subject = b.subject AND a.category = b.category AS alike, a.category AS category, len(list_intersect(a.g, b.g)) AS n, round(len(list_intersect(a.g, b.g)) / least(len(a.g), len(b.g)), 6) AS similarity FROM g a JOIN g b ON a.id < b.id)"


@q(f"{SIM} SELECT a, b, similarity FROM p WHERE n >= 4 AND similarity >= CASE WHEN same THEN 0.85 ELSE 0.95 END")
def session_aware_pairs(spark, d):
    return S.session_pairs(FA.live(facts(spark, d)).where("content <> ''"), "id", "content", "sid", 0.85, 0.95)


@q(f"{SIM}, m AS (SELECT * FROM p WHERE n >= 2 AND similarity >= 0.9 AND alike AND (same OR category IN ('profile', 'preference', 'relationship'))) SELECT a AS id FROM m UNION SELECT b FROM m")
def merge_queue(spark, d):
    return FA.near_ids(facts(spark, d), 0.9)
