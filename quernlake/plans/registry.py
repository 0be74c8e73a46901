"""Queries by name, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import exprs as X
from ..operators import retrieval as R
from ..operators import similar as S

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
NOW = "TIMESTAMP '2024-02-01 00:00:00'"
TOKENS = ["ation", "the", "erth", "onst"]


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def facts(spark: SparkSession, d: str) -> DataFrame:
    labels = t(spark, d, "labels").select("doc_id", "quality")
    importance = F.when(F.col("quality") == 1, 7).when(F.col("quality") == 0, 3).otherwise(5)
    return t(spark, d, "documents").join(labels, "doc_id", "left").withColumn("importance", importance)


FACTS = "(SELECT d.*, CASE quality WHEN 1 THEN 7 WHEN 0 THEN 3 ELSE 5 END AS importance FROM documents d LEFT JOIN labels USING (doc_id))"
SCORE = " + ".join(f"CASE WHEN contains(lower(text), '{x}') THEN {len(x)} ELSE 0 END" for x in TOKENS)


@query(f"SELECT doc_id, source, n_chars, {SCORE} AS score FROM documents WHERE {SCORE} > 0 ORDER BY score DESC, n_chars, doc_id LIMIT 20")
def lexical_search_topk(spark, d):
    return R.lexical_search(t(spark, d, "documents"), "text", TOKENS, ["n_chars", "doc_id"], 20).select("doc_id", "source", "n_chars", "score")


def flagship(spark: SparkSession, d: str) -> DataFrame:
    return lexical_search_topk(spark, d)


@query(f"SELECT doc_id, {SCORE} AS score FROM documents WHERE {SCORE} > 0")
def lexical_filter(spark, d):
    return t(spark, d, "documents").select("doc_id", X.lexical_score(F.col("text"), TOKENS).alias("score")).where("score > 0")


@query(f"SELECT doc_id, {SCORE} AS score FROM documents WHERE {SCORE} > 0 ORDER BY score DESC, n_chars, doc_id LIMIT 20 OFFSET 20")
def lexical_search_page2(spark, d):
    return R.lexical_search(t(spark, d, "documents"), "text", TOKENS, ["n_chars", "doc_id"], 20, offset=20).select("doc_id", "score")


@query("SELECT doc_id, source FROM documents WHERE contains(lower(text), 'stupid')")
def keyword_filter(spark, d):
    return t(spark, d, "documents").where(F.contains(F.lower("text"), F.lit("stupid"))).select("doc_id", "source")


@query("SELECT o_orderkey FROM orders WHERE o_orderdate + INTERVAL 30 DAY >= TIMESTAMP '1997-01-01' AND o_orderdate <= TIMESTAMP '1997-02-01'")
def interval_overlap(spark, d):
    low, high = F.expr("TIMESTAMP_NTZ '1997-01-01'"), F.expr("TIMESTAMP_NTZ '1997-02-01'")
    start = F.col("o_orderdate")
    return t(spark, d, "orders").where(X.overlaps(start, start + F.expr("INTERVAL 30 DAY"), low, high)).select("o_orderkey")


def scoped(spark, d):
    """Customers as records: nation is the session, the market segment gives the visibility, the key is the user."""
    seen = F.when(F.col("c_mktsegment") == "BUILDING", "global").when(F.col("c_mktsegment") == "MACHINERY", "user").otherwise("session")
    return t(spark, d, "customer").select("c_custkey", "c_acctbal", F.col("c_nationkey").cast("string").alias("sid"), seen.alias("visibility"), F.array(F.pmod("c_custkey", F.lit(10)).cast("string")).alias("users"))


SCOPED = "(SELECT c_custkey, c_acctbal, CAST(c_nationkey AS VARCHAR) AS sid, CASE c_mktsegment WHEN 'BUILDING' THEN 'global' WHEN 'MACHINERY' THEN 'user' ELSE 'session' END AS visibility, CAST(c_custkey % 10 AS VARCHAR) AS u FROM customer)"
CASES = {"strict": "sid = '3'", "session": "sid = '3' OR visibility = 'global' OR (visibility = 'user' AND u IN ('1', '2'))", "linked": "sid = '3' OR visibility = 'global' OR u IN ('1', '2')", "global": "true"}


def _scope(mode):
    def run(spark, d):
        return scoped(spark, d).where(X.scope(mode, F.col("sid"), F.col("visibility"), F.col("users"), "3", ["1", "2"])).select("c_custkey")

    run.__name__ = f"scope_{mode}"
    query(f"SELECT c_custkey FROM {SCOPED} WHERE {CASES[mode]}")(run)


for _mode in CASES:
    _scope(_mode)

TIER = "CASE WHEN sid = '3' THEN 0 WHEN u IN ('1', '2') THEN 1 WHEN visibility = 'global' THEN 2 ELSE 3 END"


@query(f"SELECT c_custkey, {TIER} AS tier FROM {SCOPED} ORDER BY tier, c_acctbal DESC, c_custkey LIMIT 50")
def tiered_search(spark, d):
    tier = X.preference_tier(F.col("sid"), F.col("visibility"), F.col("users"), "3", ["1", "2"])
    return scoped(spark, d).withColumn("tier", tier).orderBy("tier", F.desc("c_acctbal"), "c_custkey").limit(50).select("c_custkey", "tier")


@query("SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def excluded_antijoin(spark, d):
    return t(spark, d, "documents").select("doc_id").join(t(spark, d, "labels").select("doc_id"), "doc_id", "left_anti")


@query("SELECT doc_id FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.quality = 1)")
def semi_join_exists(spark, d):
    return t(spark, d, "documents").select("doc_id").join(t(spark, d, "labels").where("quality = 1").select("doc_id"), "doc_id", "left_semi")


@query(f"SELECT doc_id, importance, {SCORE} AS score FROM {FACTS} WHERE {SCORE} > 0 ORDER BY score DESC, importance DESC, doc_id LIMIT 25")
def fact_rank(spark, d):
    return R.lexical_search(facts(spark, d), "text", TOKENS, [F.desc("importance"), "doc_id"], 25).select("doc_id", "importance", "score")


@query(f"""WITH b AS (SELECT doc_id, text, {SCORE} AS score, row_number() OVER (ORDER BY {SCORE} DESC, n_chars, doc_id) AS base_rank FROM documents WHERE {SCORE} > 0 QUALIFY base_rank <= 60),
p AS (SELECT *, list_filter([{", ".join(f"instr(lower(text), '{x}')" for x in TOKENS)}], lambda x: x > 0) AS places FROM b)
SELECT doc_id, score, CASE WHEN len(places) >= 2 AND list_max(places) - list_min(places) <= 30 THEN 4 ELSE 0 END AS bonus FROM p ORDER BY bonus DESC, base_rank LIMIT 20""")
def proximity_rerank(spark, d):
    return R.proximity_rerank(t(spark, d, "documents"), "text", TOKENS, ["n_chars", "doc_id"], 20).select("doc_id", "score", "bonus")


def probe_vector(spark, d):
    return t(spark, d, "embeddings").where("vec_id = 7").select(F.col("embedding").cast("array<double>")).scalar()


COS = "CASE WHEN list_dot_product(e, e) > 0 THEN list_dot_product(e, q) / (sqrt(list_dot_product(e, e)) * sqrt(list_dot_product(q, q))) ELSE -1 END"
VEC = "(SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 7) AS q FROM embeddings)"


@query(f"SELECT vec_id, round({COS}, 6) AS cosine FROM {VEC} ORDER BY {COS} DESC, vec_id LIMIT 20")
def cosine_topk(spark, d):
    return R.vector_search(t(spark, d, "embeddings"), "embedding", probe_vector(spark, d), ["vec_id"], 20).select("vec_id", F.round("cosine", 6).alias("cosine"))


@query(f"""WITH s AS (SELECT doc_id, {SCORE} AS lex, {COS} AS cos FROM documents JOIN {VEC} v ON doc_id = vec_id),
pool AS ((SELECT * FROM s WHERE lex > 0 ORDER BY lex DESC, doc_id LIMIT 60) UNION (SELECT * FROM s ORDER BY cos DESC, doc_id LIMIT 60)),
m AS (SELECT max(lex) AS ml, max(greatest(cos, 0)) AS mc FROM pool)
SELECT doc_id, round(0.3 * lex / ml + 0.7 * greatest(cos, 0) / mc, 6) AS fused FROM pool, m ORDER BY fused DESC, doc_id LIMIT 20""")
def hybrid_fusion(spark, d):
    both = t(spark, d, "documents").join(t(spark, d, "embeddings"), F.col("doc_id") == F.col("vec_id"))
    return R.fused_search(both, "doc_id", "text", "embedding", TOKENS, probe_vector(spark, d), 20)


@query("SELECT o_custkey, max_by(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey, max_by(o_orderdate, (o_orderdate, o_orderkey)) AS o_orderdate FROM orders GROUP BY o_custkey")
def evidence_latest(spark, d):
    return R.latest(t(spark, d, "orders"), "o_custkey", ["o_orderdate", "o_orderkey"], "o_orderkey", "o_orderdate")


@query("SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS rank FROM customer QUALIFY rank <= 2")
def neighbor_topk(spark, d):
    return R.top_per_group(t(spark, d, "customer"), ["c_nationkey"], [F.desc("c_acctbal"), "c_custkey"], 2).select("c_nationkey", "c_custkey", "rank")


@query("SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS rank FROM orders QUALIFY rank <= 5")
def edit_history_top5(spark, d):
    return R.top_per_group(t(spark, d, "orders"), ["o_custkey"], [F.desc("o_orderkey")], 5).select("o_custkey", "o_orderkey", "rank")


@query("SELECT user_id, max_by(event_type, (ts, event_id)) AS event_type FROM events GROUP BY user_id")
def latest_name(spark, d):
    return R.latest(t(spark, d, "events"), "user_id", ["ts", "event_id"], "event_type")


@query("SELECT o_orderstatus, count(*) AS n, count(*) FILTER (o_totalprice > 100000) AS active FROM orders GROUP BY o_orderstatus")
def status_by_level(spark, d):
    return t(spark, d, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.count_if(F.col("o_totalprice") > 100000).alias("active"))


@query("SELECT CAST(year(o_orderdate) AS INT) AS y, count(*) AS n FROM orders GROUP BY y")
def capacity_by_year(spark, d):
    return t(spark, d, "orders").groupBy(F.year("o_orderdate").alias("y")).agg(F.count("*").alias("n"))


@query("SELECT count(*) AS n, count(DISTINCT user_id) AS users, count(DISTINCT event_type) AS types, count(*) FILTER (event_type = 'purchase') AS permanent FROM events")
def totals_multi_distinct(spark, d):
    return t(spark, d, "events").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"), F.countDistinct("event_type").alias("types"), F.count_if(F.col("event_type") == "purchase").alias("permanent"))


@query("SELECT count(*) FILTER (o_orderstatus = 'F') AS deleted, count(*) FILTER (o_orderstatus = 'F' AND o_totalprice > 200000) AS large FROM orders")
def trash_counts(spark, d):
    f = F.col("o_orderstatus") == "F"
    return t(spark, d, "orders").agg(F.count_if(f).alias("deleted"), F.count_if(f & (F.col("o_totalprice") > 200000)).alias("large"))


@query("SELECT user_id, min(ts) AS oldest FROM events GROUP BY user_id ORDER BY oldest, user_id LIMIT 10")
def sessions_by_age(spark, d):
    return t(spark, d, "events").groupBy("user_id").agg(F.min("ts").alias("oldest")).orderBy("oldest", "user_id").limit(10)


@query("SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id HAVING count(*) >= 4")
def sessions_having(spark, d):
    return t(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("n")).where("n >= 4")


@query("SELECT source, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars, count(*) > 30 OR sum(n_chars) > 5000 AS over FROM documents GROUP BY source")
def permanent_pressure(spark, d):
    return t(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars")).withColumn("over", (F.col("n") > 30) | (F.col("chars") > 5000))


@query(f"SELECT source, lang, doc_id, row_number() OVER (PARTITION BY source, lang ORDER BY importance DESC, doc_id) AS rank FROM {FACTS} QUALIFY rank <= 3")
def profile_topk_per_category(spark, d):
    return R.top_per_group(facts(spark, d), ["source", "lang"], [F.desc("importance"), "doc_id"], 3).select("source", "lang", "doc_id", "rank")


GRAMS = r"""(SELECT id, list_distinct(list_transform(range(1, greatest(length(n), 2)), lambda i: substr(n, i, 2))) AS g FROM (SELECT item_id AS id, regexp_replace(lower(text), '[\s，。、；：！？,.!?;:''"“”‘’()（）\[\]【】<>《》\-—~～/\\]+', '', 'g') AS n FROM benchmark) WHERE n <> '')"""
PAIRS = f"(SELECT a.id AS a, b.id AS b, round(len(list_intersect(a.g, b.g)) / least(len(a.g), len(b.g)), 6) AS similarity FROM {GRAMS} a JOIN {GRAMS} b ON a.id < b.id WHERE len(list_intersect(a.g, b.g)) >= 2 AND round(len(list_intersect(a.g, b.g)) / least(len(a.g), len(b.g)), 6) >= 0.85)"


def benchmark_pairs(spark, d):
    return S.similar_pairs(t(spark, d, "benchmark").withColumn("subject", F.lit("s")), "item_id", "text", "subject", 0.85)


@query(f"SELECT * FROM {PAIRS}")
def similar_pairs(spark, d):
    return benchmark_pairs(spark, d)


@query(f"""WITH RECURSIVE e AS (SELECT a, b FROM {PAIRS} UNION SELECT b, a FROM {PAIRS}), r AS (SELECT a AS node, a AS root FROM e UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.node)
SELECT node, min(root) AS root FROM r GROUP BY node""")
def similarity_clusters(spark, d):
    return S.clusters(benchmark_pairs(spark, d))


@query("SELECT user_id, list_sort(list_distinct(list(event_type))) AS sources, CAST(max(value) AS DOUBLE) AS importance, min(nullif(epoch(ts), 0)) AS event_at, max(epoch(ts)) AS event_end FROM events GROUP BY user_id")
def merge_aggregate(spark, d):
    epoch = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    rows = t(spark, d, "events").select("user_id", F.array("event_type").alias("sources"), F.col("value").alias("importance"), epoch.alias("event_at"), epoch.alias("event_end"))
    return S.merge_facts(rows, ["user_id"])


@query("SELECT sha256(concat_ws(chr(31), coalesce(text, ''), coalesce(lang, ''))) AS fingerprint, min(doc_id) AS id, count(*) AS n, list_sort(list_distinct(list(source))) AS sources FROM documents GROUP BY 1")
def fingerprint_upsert(spark, d):
    docs = t(spark, d, "documents").withColumn("fingerprint", X.fingerprint(F.col("text"), F.col("lang")))
    return docs.groupBy("fingerprint").agg(F.min("doc_id").alias("id"), F.count("*").alias("n"), F.array_sort(F.collect_set("source")).alias("sources"))


@query("SELECT text, count(*) AS n FROM documents GROUP BY text HAVING count(*) > 1")
def duplicate_groups(spark, d):
    return t(spark, d, "documents").groupBy("text").agg(F.count("*").alias("n")).where("n > 1")


USE = f"(SELECT user_id, count(*) FILTER (event_type = 'view') AS shown, count(*) FILTER (event_type IN ('purchase', 'click')) AS used, (epoch({NOW}) - epoch(max(ts))) / 86400 AS last_age, (epoch({NOW}) - epoch(min(ts))) / 86400 AS first_age, max(value) AS v FROM events GROUP BY user_id)"


def use(spark, d):
    now = F.unix_micros(F.lit("2024-02-01 00:00:00").cast("timestamp"))
    age = lambda c: (now - F.unix_micros(c.cast("timestamp"))) / 86400e6
    events = t(spark, d, "events")
    kind = F.col("event_type")
    return events.groupBy("user_id").agg(F.count_if(kind == "view").alias("shown"), F.count_if(kind.isin("purchase", "click")).alias("used"), age(F.max("ts")).alias("last_age"), age(F.min("ts")).alias("first_age"), F.max("value").alias("v"))


@query(f"SELECT user_id, round_even(5.0 / 10 * 0.35 + pow(0.5, last_age / 30) * 0.25 + pow(0.5, first_age / 90) * 0.1 + least(used * 0.05, 0.3) + CASE WHEN v > 100 THEN 0.5 ELSE 0 END, 4) AS score FROM {USE}")
def retention_score(spark, d):
    u = use(spark, d)
    return u.select("user_id", X.retention_score(F.lit(5.0), F.col("last_age"), F.col("first_age"), F.col("used"), F.col("v") > 100).alias("score"))


@query(f"SELECT user_id, CAST(round_even(10.0 + least(used, 5) * pow(0.5, last_age / 60) * 3 + greatest(10 * (1 - first_age / 60), 0), 0) AS INT) AS score FROM {USE}")
def sink_score(spark, d):
    return use(spark, d).select("user_id", X.sink_score(F.lit(5.0), F.col("used"), F.col("last_age"), F.col("first_age"), F.lit(0)).alias("score"))


@query("""WITH o AS (SELECT o_orderkey, o_orderkey % 10 + 1 AS base, CASE o_orderkey % 4 WHEN 0 THEN 0 ELSE greatest(date_diff('day', o_orderdate, TIMESTAMP '2000-01-01'), 0) END AS days FROM orders)
SELECT o_orderkey, CAST(greatest(least(round_even(base / pow(2.0, days / 365), 0), 10), 1) AS INT) AS importance FROM o""")
def aged_importance(spark, d):
    """Every fourth order has no time, every second of the rest one in milliseconds; some lie ahead."""
    at = F.unix_seconds(F.col("o_orderdate").cast("timestamp")).cast("double")
    when = F.when(F.col("o_orderkey") % 4 == 0, 0.0).when(F.col("o_orderkey") % 4 == 1, at * 1000).otherwise(at)
    return t(spark, d, "orders").select("o_orderkey", X.aged_importance(F.pmod("o_orderkey", F.lit(10)) + 1, when, 946684800.0).alias("importance"))


@query("""WITH x AS (SELECT conv_id, turn, role, CASE WHEN role = 'user' AND coalesce(lag(role) OVER w, '') <> 'user' THEN 1 ELSE 0 END AS s FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, turn, CAST(sum(s) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS round FROM x""")
def round_segments(spark, d):
    return R.rounds(t(spark, d, "conversations").select("conv_id", "turn", "role"), "conv_id", "turn").select("conv_id", "turn", "round")


@query("SELECT conv_id, turn, used_chars FROM (SELECT conv_id, turn, CAST(sum(length(coalesce(text, ''))) OVER w AS BIGINT) AS used_chars, row_number() OVER w AS rn FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE used_chars <= 800 OR rn = 1")
def char_budget_cut(spark, d):
    return R.within_budget(t(spark, d, "conversations"), "conv_id", ["turn"], F.length(F.coalesce("text", F.lit(""))), 800).select("conv_id", "turn", F.col("used_chars").cast("long").alias("used_chars"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events")
def json_decode(spark, d):
    return t(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))


@query("SELECT l_orderkey, l_partkey FROM lineitem UNION SELECT o_orderkey, o_custkey FROM orders")
def distinct_union(spark, d):
    return t(spark, d, "lineitem").select("l_orderkey", "l_partkey").union(t(spark, d, "orders").select("o_orderkey", "o_custkey")).distinct()


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start_at, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def tumbling_event_counts(spark, d):
    return t(spark, d, "events").groupBy(F.window("ts", "1 hour").start.alias("start_at"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query("""WITH x AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS s FROM events),
y AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM x) SELECT user_id, min(ts) AS start_at, count(*) AS n FROM y GROUP BY user_id, g""")
def session_windows(spark, d):
    return t(spark, d, "events").groupBy("user_id", F.session_window("ts", "6 hours").alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start_at"), "n")


@query("SELECT n_regionkey, r_name, string_agg(n_name, ';' ORDER BY n_nationkey) AS members FROM nation LEFT JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2")
def tree_children(spark, d):
    j = t(spark, d, "nation").join(t(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    kids = F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda x: x.n_name)
    return j.groupBy("n_regionkey", "r_name").agg(F.concat_ws(";", kids).alias("members"))


def records(spark, d) -> DataFrame:
    """Conversations as records of one session each."""
    c = t(spark, d, "conversations")
    return c.select(
        F.concat(F.lit("web:gm:"), F.col("conv_id").cast("string")).alias("sid"), F.concat_ws(":", F.col("conv_id").cast("string"), F.lpad(F.col("turn").cast("string"), 6, "0")).alias("id"), "role", F.lit(0).alias("level"), F.col("turn").alias("position"),
        F.lit("session").alias("visibility"), F.coalesce("text", F.lit("")).alias("content"), F.lit(1).alias("active"), F.lit(0).alias("deleted"), F.lit(0).alias("permanent"),
    )


@query("""WITH r AS (SELECT *, coalesce(lag(role) OVER w, role) AS before FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
e AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM r WHERE role = 'user' AND before <> 'user'),
f AS (SELECT conv_id, max(turn) AS last FROM e GROUP BY conv_id HAVING count(*) >= 2)
SELECT 'web:gm:' || conv_id AS sid, conv_id || ':' || lpad(CAST(turn AS VARCHAR), 6, '0') AS id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INT) AS ordinal, 1 AS target_level FROM conversations JOIN f USING (conv_id) WHERE turn < last""")
def compression_plan(spark, d):
    from ..operators.consolidate import FoldSettings, fold_plan

    return fold_plan(records(spark, d), FoldSettings(rounds=2, max_chars=10**9))


@query("""SELECT doc_id, CASE WHEN text IS NULL THEN 'invalid_text' WHEN length(text) > 4000 THEN 'too_long' WHEN NOT regexp_matches(trim(text), '[\\p{L}\\p{N}]') THEN 'empty'
WHEN regexp_matches(trim(text), '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]') THEN 'control_characters' WHEN regexp_matches(trim(text), '^(```|\\{|\\[|<)|</?\\w+[^>]*>') THEN 'markup_or_serialized_output'
WHEN trim(text) IN ('None', 'null') THEN 'placeholder' WHEN length(trim(text)) > 12 AND len(list_distinct(string_split(trim(text), ''))) < 3 THEN 'repetition' END AS reason FROM documents""")
def text_rejection(spark, d):
    from ..functions.cleaning import rejection

    return t(spark, d, "documents").select("doc_id", rejection(F.col("text"), 4000).alias("reason"))


@query("SELECT page_id, CASE WHEN length(s) > 240 THEN substr(s, 1, 240) || '…' ELSE s END AS preview FROM (SELECT page_id, trim(regexp_replace(coalesce(html, ''), '\\s+', ' ', 'g')) AS s FROM pages)")
def tool_preview(spark, d):
    from ..functions.cleaning import tool_preview as preview

    return t(spark, d, "pages").select("page_id", preview(F.col("html")).alias("preview"))


@query("SELECT user_id, CASE WHEN same IS NULL OR same <= 0.12 THEN 'keep' WHEN same < 0.5 THEN 'inherit' WHEN nw < 0.6 THEN 'drop' WHEN dl < 0.75 THEN 'merge' ELSE 'keep' END AS route FROM (SELECT user_id, (user_id % 11) / 10 AS same, (user_id % 7) / 6 AS nw, (user_id % 5) / 4 AS dl FROM (SELECT DISTINCT user_id FROM events))")
def merge_routing(spark, d):
    from ..operators.lifecycle import route_merge

    u = t(spark, d, "events").select("user_id").distinct()
    part = lambda n: F.pmod("user_id", F.lit(n)) / (n - 1)
    return u.select("user_id", route_merge(part(11), part(7), part(5)).alias("route"))


