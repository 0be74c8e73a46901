"""Queries over messages: envelopes, the kept text index, mentions, versions, trees and identities, each by its operator."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import envelope as E
from ..functions import exprs as X
from ..operators import facts as FA
from ..operators import identity as I
from ..operators import intake as N
from ..operators import lifecycle as L
from ..operators import mentions as M
from ..operators import records as R
from ..operators import search as S
from ..operators import similar as SI
from ..operators.textindex import TextIndex
from ..operators.versions import VersionedTable
from ..shared import scratch
from ..streaming import capture as CA
from ..streaming import sessions as ST
from .memory import NOW, facts, names, q, records, vectors
from .registry import query, t

BODY = "coalesce(text, '')"
PLAIN = f"trim(regexp_replace(regexp_replace({BODY}, '[ \\t]{{2,}}', ' ', 'g'), '[ \\t]*\\n\\s*', chr(10), 'g'), ' ' || chr(9) || chr(10) || chr(13))"
LINE = f"CASE WHEN {PLAIN} = '' THEN '' ELSE {PLAIN} || chr(10) END"
K = "(conv_id + turn) % 6"


def wrapped(spark, d) -> DataFrame:
    """conv_id, turn, role and raw: the texts of conversations in shells of six kinds."""
    c, text = t(spark, d, "conversations"), F.coalesce("text", F.lit(""))
    k, lit = (F.col("conv_id") + F.col("turn")) % 6, F.lit
    raw = F.when(k == 0, F.concat(lit("<msg><text>"), text, lit("</text></msg>")))
    raw = raw.when(k == 1, F.concat(lit('<msg id="5">\n<reply>'), F.col("turn").cast("string"), lit("</reply>\n<text>"), text, lit("</text>\n<sticker>8</sticker>\n</msg>")))
    raw = raw.when(k == 2, F.concat(lit("said <text>so</text> and <msg_id> 3<5 "), text)).when(k == 3, F.concat(lit("<reasoning>why\n<b></reasoning><msg>"), text, lit("</msg><msg/>")))
    raw = raw.when(k == 4, F.concat(lit("<quote><forward a='1'>"), text, lit("</forward></quote> [At -39(nickname: Ann)]"))).otherwise(F.concat(lit("[Reply ID: -7 content: [Image "), F.repeat(lit("x"), 50), lit("]] [Sticker "), F.repeat(lit("y"), 40), lit(", file_path: /a] "), text))
    return c.select("conv_id", "turn", "role", raw.alias("raw"))


CLEANED = f"""CASE {K} WHEN 0 THEN {PLAIN} WHEN 1 THEN '↩' || turn || chr(10) || {LINE} || '[表情8]' WHEN 2 THEN trim('said <text>so</text> and <msg_id> 3<5 ' || {PLAIN}) WHEN 3 THEN trim('<reasoning>why' || chr(10) || '<b></reasoning>' || {PLAIN})
WHEN 4 THEN trim({PLAIN} || ' [At -39(nickname: Ann)]') ELSE trim('[Reply ID: -7 content: [Image ' || repeat('x', 50) || ']] [Sticker ' || repeat('y', 40) || ', file_path: /a] ' || {PLAIN}) END"""


@query(f"SELECT conv_id, turn, {CLEANED} AS cleaned FROM conversations")
def cleaned_messages(spark, d):
    return wrapped(spark, d).select("conv_id", "turn", E.clean_text(F.col("raw")).alias("cleaned"))


@query(f"""SELECT conv_id, turn, CASE {K} WHEN 3 THEN {PLAIN} WHEN 4 THEN trim({PLAIN} || ' @Ann') WHEN 5 THEN trim('[Reply: Image ' || repeat('x', 24) || '…] [Sticker ' || repeat('y', 30) || '…, file_path: /a] ' || {PLAIN}) ELSE {CLEANED} END AS shown FROM conversations""")
def model_messages(spark, d):
    return wrapped(spark, d).select("conv_id", "turn", E.model_text(F.col("raw")).alias("shown"))


@query(f"""SELECT conv_id, turn, CASE WHEN turn % 2 = 1 THEN CASE WHEN {K} = 3 AND role = 'assistant' THEN trim('<msg>' || {BODY} || '</msg><msg/>') ELSE NULL END WHEN {K} = 3 AND role = 'assistant' THEN {PLAIN} ELSE {CLEANED} END AS stored FROM conversations""")
def stored_messages(spark, d):
    """Of summaries (odd turns) only those that lose something are shown."""
    rows = wrapped(spark, d).withColumn("stored", E.stored_text((F.col("turn") % 2).cast("int"), F.col("role"), F.col("raw")))
    return rows.select("conv_id", "turn", F.when((F.col("turn") % 2 == 0) | (F.col("stored") != F.trim("raw")), F.col("stored")).alias("stored"))


def _after(index: TextIndex) -> float:
    """A time of change that the index hasn't seen, whatever times the table holds."""
    return (index.seen or 0.0) + 1


def _indexed(spark, d) -> tuple[TextIndex, DataFrame]:
    """An index of three fifths of the records, upkept by a later batch; some rows then change, go or are too new for it."""
    rows = records(spark, d).select("id", F.col("start").alias("updated"), F.col("content").alias("text"), "active", "end", F.col("position").alias("n"))
    index = TextIndex(spark, scratch(spark, "textindex"), buckets=32)
    old = rows.where("n % 5 < 3").withColumn("text", F.when(F.col("n") % 4 == 1, F.lit("an old text")).otherwise(F.col("text")))
    index.add(old)
    late = lambda c: F.when(c, _after(index)).otherwise(F.col("updated"))
    rows = rows.withColumn("updated", late((F.col("n") % 5 >= 3) | (F.col("n") % 4 == 1))).where("n % 11 <> 10")
    index.add(rows.where("n % 5 <> 4"))
    return index, rows.withColumn("updated", late(F.col("n") % 5 == 4))


PHRASE = "the ation onst"
INDEXED = " + ".join(f"CASE WHEN contains(lower(content), '{x}') THEN {len(x)} ELSE 0 END" for x in ("ation", "onst"))


@q(f"SELECT id, {INDEXED} AS score FROM records WHERE position % 11 <> 10 AND {INDEXED} > 0 ORDER BY score DESC, active DESC, \"end\", id LIMIT 25")
def kept_index_search(spark, d):
    index, rows = _indexed(spark, d)
    return index.search(rows, PHRASE, 25, [F.desc("active"), "end", "id"]).select("id", "score")


@q(f"SELECT id, {INDEXED} AS score FROM records WHERE position % 11 <> 10 AND {INDEXED} > 0 ORDER BY score DESC, active DESC, \"end\", id LIMIT 25 OFFSET 5")
def merged_index_search(spark, d):
    index, rows = _indexed(spark, d)
    index.merge(rows)
    return TextIndex.load(spark, index.path).search(rows, PHRASE, 25, [F.desc("active"), "end", "id"], most=1 << 30, offset=5).select("id", "score")


@q("""p AS (SELECT DISTINCT id, unnest(flatten(list_transform(regexp_extract_all(lower(content), '[a-z0-9_]+|[㐀-鿿]+'), lambda x: list_concat(list_filter(string_split(x, ''), lambda y: y <> ''), list_transform(range(1, length(x)), lambda i: substr(x, i, 2)))))) AS gram FROM records WHERE position % 11 <> 10 AND position % 5 <> 4)
SELECT gram, count(*) AS n FROM p GROUP BY gram""")
def index_postings(spark, d):
    """What a merged index holds of each gram; texts without any are under a dash."""
    index, rows = _indexed(spark, d)
    index.merge(rows)
    return index.postings().where("gram <> '-'").groupBy("gram").agg(F.count("*").alias("n"))


def _stream(spark, rows: DataFrame, files: int) -> tuple[DataFrame, str]:
    """``rows`` (at, ...) as a stream of ``files`` batches in the order of time, and a folder for what comes of it."""
    path = scratch(spark, "stream")
    cuts = rows.agg(F.percentile_approx("at", [k / files for k in range(1, files)], 1000)).first()[0]
    for k, (a, z) in enumerate(zip([None, *cuts], [*cuts, None])):
        part = rows if a is None else rows.where(F.col("at") > a)
        (part if z is None else part.where(F.col("at") <= z)).coalesce(1).write.parquet(f"{path}/in/b={k}")
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in/b=*"), path


@q("""m AS (SELECT sid, id, role, start AS z FROM records WHERE start <= (SELECT max(start) - 60 FROM records)), g AS (SELECT *, z - lag(z) OVER w AS gap, lag(role) OVER w AS before FROM m WINDOW w AS (PARTITION BY sid ORDER BY z, id)),
e AS (SELECT *, CASE WHEN gap > 600 THEN 'silent' WHEN role = 'user' AND before <> 'user' THEN 'next' END AS ended FROM g), r AS (SELECT *, count(ended) OVER (PARTITION BY sid ORDER BY z, id) + 1 AS round FROM e),
x AS (SELECT sid, round, min(z) AS first, max(z) AS last, count(*) AS n, count(*) FILTER (role = 'user') AS users, arg_min(coalesce(ended, ''), (z, id)) AS began FROM r GROUP BY sid, round)
SELECT sid, round, first, last, n, users, coalesce(after, CASE WHEN last + 600 < (SELECT max(start) - 60 FROM records) THEN 'silent' END) AS why FROM (SELECT *, lead(began) OVER (PARTITION BY sid ORDER BY round) AS after FROM x) WHERE coalesce(after, CASE WHEN last + 600 < (SELECT max(start) - 60 FROM records) THEN 'silent' END) IS NOT NULL""")
def streamed_rounds(spark, d):
    rows = records(spark, d).select("sid", "id", "role", F.col("start").alias("at"))
    src, path = _stream(spark, rows, 3)
    messages = src.withColumn("ts", F.timestamp_millis((F.col("at") * 1000).cast("long"))).drop("at")
    return ST.run_once(ST.closed_rounds(messages, 600.0, "60 seconds"), path)


def slot_events(spark, d) -> DataFrame:
    """A user's message offers the session's facts, the best by importance first; an assistant's is the reply to it."""
    told = facts(spark, d).where("deleted = 0 AND sid <> 'global'").groupBy("sid").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("importance")).alias("i"), "id", F.col("content").alias("text")))), 1, 12).alias("x"))
    rows = records(spark, d).where("role IN ('user', 'assistant')").join(told, "sid")
    users = F.sum((F.col("role") == "user").cast("long")).over(Window.partitionBy("sid").orderBy("start", "id"))
    offered = F.when(F.col("role") == "user", F.transform("x", lambda y: F.struct(y.id.alias("id"), y.text.alias("text"))))
    return rows.select("sid", F.col("start").alias("at"), F.when(F.col("role") == "user", "offer").otherwise("reply").alias("kind"), users.alias("turn"), offered.alias("offered"), F.col("content").alias("reply"))


@query(None)
def streamed_slots(spark, d):
    src, path = _stream(spark, slot_events(spark, d), 3)
    return ST.run_once(ST.rotation(src), path)


SCOPED = "deleted = 0 AND category <> 'media' AND cold = 0 AND id NOT IN ('m3-0', 'm8-1') AND sid <> 'qq:gm:6' AND (sid = 'qq:gm:2' OR visibility = 'global' OR (visibility = 'user' AND list_has_any(users, ['qq:1']))) AND \"end\" >= 1.70002e9 AND start <= 1.7045e9"
TIER = "CASE WHEN sid = 'qq:gm:2' THEN 0 WHEN list_has_any(users, ['qq:1', 'qq:3']) THEN 1 WHEN visibility = 'global' THEN 2 ELSE 3 END"
ASK = S.Ask(sid="qq:gm:2", users=("qq:1",), exclude_ids=("m3-0", "m8-1"), exclude_sid="qq:gm:6", start=1.70002e9, end=1.7045e9, prefer_sid="qq:gm:2", prefer_users=("qq:1", "qq:3"), lexical=PHRASE, limit=12, offset=2)


def _page(spark, d, ask: S.Ask, index: TextIndex | None = None, rows: DataFrame | None = None) -> DataFrame:
    rows = records(spark, d) if rows is None else rows
    page, total = S.search(rows, ask, names(spark, d), vectors(spark, d), index=index, now=NOW)
    return page.select("id", "place", F.round("score", 6).alias("score"), F.lit(total).cast("long").alias("total"))


LEXICAL = f"w AS (SELECT *, {TIER} AS tier, {INDEXED} AS score FROM records WHERE {SCOPED}), m AS (SELECT * FROM w WHERE score > 0), p AS (SELECT id, category, content, score, row_number() OVER (ORDER BY tier, score DESC, active DESC, \"end\", id) - 3 AS place FROM m)"


@q(f"{LEXICAL} SELECT id, CAST(place AS INT) AS place, CAST(score AS DOUBLE) AS score, (SELECT count(*) FROM m) AS total FROM p WHERE place BETWEEN 0 AND 11 AND category <> 'tool' AND regexp_matches(content, '[0-9A-Za-z]')")
def search_lexical_page(spark, d):
    return _page(spark, d, ASK)


@q(f"{LEXICAL} SELECT id, CAST(place AS INT) AS place, CAST(score AS DOUBLE) AS score, (SELECT count(*) FROM m) AS total FROM p WHERE place BETWEEN 0 AND 11 AND category <> 'tool' AND regexp_matches(content, '[0-9A-Za-z]')")
def search_indexed_page(spark, d):
    """As above by the kept index, with rows that it has not seen yet."""
    rows = records(spark, d).withColumn("updated", F.col("start"))
    index = TextIndex(spark, scratch(spark, "textindex"), buckets=16)
    index.add(rows.where("position % 5 <> 4").select("id", "updated", "content"), "content")
    rows = rows.withColumn("updated", F.when(F.col("position") % 5 == 4, _after(index)).otherwise(F.col("start")))
    return _page(spark, d, ASK, index, rows)


@q(f"""w AS (SELECT *, {TIER} AS tier FROM records WHERE {SCOPED}), probe AS (SELECT vector AS v FROM vectors WHERE id = 'm7-0'),
s AS (SELECT w.*, CASE WHEN v.vector IS NULL THEN -1 ELSE list_dot_product(vector, probe.v) / (sqrt(list_dot_product(vector, vector)) * sqrt(list_dot_product(probe.v, probe.v))) END AS score FROM w LEFT JOIN (SELECT id, vector FROM vectors WHERE model = 'new' AND revision = 1) v USING (id), probe),
p AS (SELECT id, category, content, score, row_number() OVER (ORDER BY tier, score DESC, \"end\", id) - 3 AS place FROM s) SELECT id, CAST(place AS INT) AS place, round(score, 6) AS score, (SELECT count(*) FROM s) AS total FROM p WHERE place BETWEEN 0 AND 11 AND category <> 'tool' AND regexp_matches(content, '[0-9A-Za-z]')""")
def search_vector_page(spark, d):
    probe = vectors(spark, d).where("id = 'm7-0'").select("vector").first()[0]
    return _page(spark, d, replace(ASK, lexical="", vector=tuple(probe), model="new"))


@q(f"""w AS (SELECT *, {TIER} AS tier FROM records r WHERE {SCOPED} AND (contains(lower(content), 'nation_1') OR EXISTS (SELECT 1 FROM names n WHERE contains(lower(n.name), 'nation_1') AND (n.entity = r.sid OR list_contains(r.users, n.entity)))) AND level = 1 AND active = 1 AND list_contains(users, 'qq:1')),
p AS (SELECT id, category, content, row_number() OVER (ORDER BY tier, \"end\", id) - 3 AS place FROM w) SELECT id, CAST(place AS INT) AS place, 0e0 AS score, (SELECT count(*) FROM w) AS total FROM p WHERE place BETWEEN 0 AND 11 AND category <> 'tool' AND regexp_matches(content, '[0-9A-Za-z]')""")
def search_keyword_page(spark, d):
    return _page(spark, d, replace(ASK, lexical="", keyword="Nation_1", level=1, active=True, subject="qq:1"))


@q("""seen AS (SELECT id, visibility = 'global' OR (visibility = 'user' AND list_contains(users, 'qq:2')) OR sid = 'qq:gm:3' OR list_contains(users, 'qq:2') AS ok FROM records WHERE deleted = 0),
src AS (SELECT f.id, arg_min(ok, n) AS ok FROM (SELECT id, unnest(sources) AS s, unnest(range(len(sources))) AS n FROM facts WHERE deleted = 0) f JOIN seen ON seen.id = f.s GROUP BY f.id)
SELECT id, coalesce(seen.ok, src.ok, false) AS allowed FROM (SELECT id FROM records UNION SELECT id FROM facts) LEFT JOIN seen USING (id) LEFT JOIN src USING (id)""")
def access_by_id(spark, d):
    r, f = records(spark, d), facts(spark, d)
    return S.accessible(r.select("id").unionByName(f.select("id")), r, f, "qq:gm:3", ["qq:2"], "linked")


EDGES = """edges AS (SELECT 'r' || n_regionkey AS parent, 'n' || n_nationkey AS child, 25 - n_nationkey AS ordinal FROM nation UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey, c_custkey FROM customer UNION ALL SELECT 'c' || o_custkey, 'o' || o_orderkey, o_orderkey % 5 FROM orders),
shown AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY parent ORDER BY ordinal, child) AS n FROM edges) WHERE n BETWEEN 3 AND 6), kids AS (SELECT parent AS id, count(*) AS kids FROM edges GROUP BY parent),
tree AS (SELECT 'r' || r_regionkey AS root, 0 AS depth, CAST(NULL AS VARCHAR) AS parent, 'r' || r_regionkey AS id, 0 AS place, ['r' || r_regionkey] AS path FROM region UNION ALL SELECT root, depth + 1, id, child, CAST(n AS INT), list_append(path, child) FROM tree JOIN shown ON shown.parent = id WHERE depth < 3)"""


def edges(spark, d) -> DataFrame:
    nation, customer, orders = (t(spark, d, x) for x in ("nation", "customer", "orders"))
    one = nation.selectExpr("concat('r', n_regionkey) AS parent", "concat('n', n_nationkey) AS child", "bigint(25 - n_nationkey) AS ordinal")
    two = customer.selectExpr("concat('n', c_nationkey) AS parent", "concat('c', c_custkey) AS child", "c_custkey AS ordinal")
    return one.unionByName(two).unionByName(orders.selectExpr("concat('c', o_custkey) AS parent", "concat('o', o_orderkey) AS child", "o_orderkey % 5 AS ordinal"))


@query(f"WITH RECURSIVE {EDGES} SELECT root, depth, parent, id, place, path, coalesce(kids, 0) AS kids, CASE WHEN kids > 6 THEN 6 END AS next FROM tree LEFT JOIN kids USING (id)")
def tree_pages(spark, d):
    """Four levels of a tree, of each node the children from the third to the sixth."""
    return S.descend(edges(spark, d), t(spark, d, "region").selectExpr("concat('r', r_regionkey) AS id"), 3, 2, 4)


CITED = "edges AS (SELECT 'm' || conv_id || '-' || (turn // 3) AS parent, 'm' || conv_id || '-' || turn AS child, turn AS ordinal FROM conversations WHERE turn > 0 AND turn // 3 <> turn)"


@q(f"""{CITED}, up AS (SELECT child AS id, list_sort(list(DISTINCT parent)) AS parents FROM edges GROUP BY child), kids AS (SELECT parent AS id, count(*) AS kids FROM edges GROUP BY parent),
tree AS (SELECT id AS root, 0 AS depth, id, [id] AS path FROM records WHERE position = 0 UNION ALL SELECT root, depth + 1, child, list_append(path, child) FROM tree JOIN edges ON edges.parent = id WHERE depth < 2),
seen AS (SELECT sources[1] AS id, count(*) AS versions FROM facts GROUP BY 1), items AS (SELECT sources[2] AS id, count(*) AS items FROM facts GROUP BY 1)
SELECT root, path, id, coalesce(kids, 0) AS kids, CAST(NULL AS INT) AS next, strftime(make_timestamp(CAST(\"end\" * 1e6 AS BIGINT)), '%Y-%m-%d %H:%M') AS \"at\", level, CASE WHEN permanent = 1 THEN 1 END AS mem, coalesce(parents, []) AS parents, coalesce(versions, 0) AS versions, coalesce(items, 0) AS items, CASE WHEN kids IS NULL THEN content END AS content
FROM tree JOIN records USING (id) LEFT JOIN up USING (id) LEFT JOIN kids USING (id) LEFT JOIN seen USING (id) LEFT JOIN items USING (id)""")
def archive_views(spark, d):
    c, f = t(spark, d, "conversations"), facts(spark, d)
    e = c.where("turn > 0 AND turn DIV 3 <> turn").selectExpr("concat('m', conv_id, '-', turn DIV 3) AS parent", "concat('m', conv_id, '-', turn) AS child", "turn AS ordinal")
    r = records(spark, d)
    tree = S.descend(e, r.where("position = 0").select("id"), 2)
    return S.archive_view(tree, r, e, f.select(F.get("sources", F.lit(0)).alias("target")), f.select(F.get("sources", F.lit(1)).alias("record_id")))


def _named(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Texts of documents with a name or an id put in, entities by nation, and two former names of each."""
    docs = t(spark, d, "documents")
    said = F.concat(F.coalesce("text", F.lit("")), F.lit(" met nation_"), (F.col("doc_id") % 40).cast("string"), F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit(" of qq:"), F.col("doc_id") % 30)).otherwise(""))
    n = t(spark, d, "nation")
    return docs.select(F.col("doc_id").alias("id"), said.alias("text")), n.selectExpr("concat('qq:', n_nationkey) AS entity", "lower(n_name) AS name", "n_nationkey % 4 AS updated"), n.selectExpr("concat('qq:', n_nationkey) AS entity", "concat('th', substr(n_name, -1), 'nd') AS name").unionByName(n.selectExpr("concat('qq:', n_nationkey) AS entity", "'x' AS name"))


MENTIONS = r"""WITH x AS (SELECT doc_id AS id, regexp_replace(regexp_replace(coalesce(text, '') || ' met nation_' || (doc_id % 40) || CASE WHEN doc_id % 3 = 0 THEN ' of qq:' || (doc_id % 30) ELSE '' END, '[\x00-\x08\x0b\x0c\x0e-\x1f]', '', 'g'), '[ \t]{2,}', ' ', 'g') AS text FROM documents),
w AS (SELECT 'qq:' || n_nationkey AS entity, n_nationkey % 4 AS updated, unnest([lower(n_name), 'th' || right(n_name, 1) || 'nd', 'qq:' || n_nationkey]) AS word FROM nation),
m AS (SELECT DISTINCT id, entity, updated FROM x JOIN w ON contains(text, word)) SELECT id, entity, CAST(row_number() OVER (PARTITION BY id ORDER BY updated DESC, entity) AS INT) AS place FROM m QUALIFY place <= 20"""


@query(MENTIONS)
def mentions_in_documents(spark, d):
    return M.mentions(*_named(spark, d), longest=None)


@query(MENTIONS)
def mentions_by_rarest_pair(spark, d):
    return M.mentions(*_named(spark, d), longest=None, automaton_bytes=0)


def _chain(spark, d) -> tuple[VersionedTable, list[DataFrame], DataFrame]:
    """Records edited, edited again with conflicts, put back in part, and purged in part; and the edges left."""
    r = records(spark, d)
    table = VersionedTable.create(r.select("id", "revision", "content", "importance"), scratch(spark, "versioned"), buckets=8)
    n = F.col("position").cast("long")
    one = r.where("position % 3 = 0").select(n.alias("n"), "id", F.lit(1).alias("revision"), F.concat(F.lit("new "), "id").alias("content"), F.lit(None).cast("int").alias("importance"))
    two = r.where("position % 2 = 0").select(n.alias("n"), "id", F.lit(1).alias("revision"), F.lit(None).cast("string").alias("content"), F.lit(10).alias("importance"))
    lost = r.where("position = 0").select(n.alias("n"), F.concat("id", F.lit("?")).alias("id"), F.lit(1).alias("revision"), F.lit("x").alias("content"), F.lit(1).alias("importance"))
    conflicts = [table.edit(one.unionByName(lost), ["content", "importance"], NOW), table.edit(two, ["content", "importance"], NOW + 1)]
    wanted = r.where("position % 6 = 0").select(n.alias("n"), F.sha2(F.concat_ws("\x1f", "id", F.lit("1")), 256).alias("version"), F.lit(2).alias("revision"))
    conflicts.append(table.restore(wanted, NOW + 2))
    e = r.where("position > 0").select(F.col("id").alias("child"), "sid")
    left = table.purge(r.where("position % 11 = 7").select("id"), {"edges": (e, "child")})
    return table, conflicts, left["edges"]


@q("""s AS (SELECT id, position, content, importance, position % 3 = 0 AS a, position % 2 = 0 AND position % 3 <> 0 AS b, position % 6 = 0 AS c FROM records WHERE position % 11 <> 7)
SELECT id, CAST(1 + CAST(a AS INT) + CAST(b AS INT) + CAST(c AS INT) AS INT) AS revision, CASE WHEN a AND NOT c THEN 'new ' || id ELSE content END AS content, CASE WHEN b THEN 10 ELSE importance END AS importance FROM s""")
def versioned_rows(spark, d):
    return _chain(spark, d)[0].rows()


@q("SELECT id || '?' AS id, 'missing' AS why, 0 AS step FROM records WHERE position = 0 UNION ALL SELECT id, 'revision', 1 FROM records WHERE position % 6 = 0")
def version_conflicts(spark, d):
    found = [c.select("id", "why", F.lit(k).alias("step")) for k, c in enumerate(_chain(spark, d)[1])]
    return found[0].unionByName(found[1]).unionByName(found[2])


@q("""SELECT sha256(id || chr(31) || '1') AS version, id AS target, 1 AS revision FROM records WHERE (position % 3 = 0 OR position % 2 = 0) AND position % 11 <> 7
UNION ALL SELECT sha256(id || chr(31) || '2'), id, 2 FROM records WHERE position % 6 = 0 AND position % 11 <> 7""")
def version_log(spark, d):
    return _chain(spark, d)[0].versions().select("version", "target", "revision")


@q("SELECT id AS child, sid FROM records WHERE position > 0 AND position % 11 <> 7")
def purge_cascade(spark, d):
    return _chain(spark, d)[2]


def _bound(spark, d):
    """Every second user of records, facts and names by a pending id; the number 3 is known twice, 8 not at all."""
    old = lambda c, n: F.when(n % 2 == 0, F.regexp_replace(c, "^qq:", "legacy:user:")).otherwise(c)
    r = records(spark, d).withColumn("users", F.transform("users", lambda u: old(u, F.col("position"))))
    n = F.substring("id", 2, 20).cast("long")
    f = facts(spark, d).where("deleted = 0").withColumn("subject", old(F.col("subject"), n)).withColumn("src_user", old(F.col("src_user"), n)).withColumn("content", F.concat(F.lit("c"), n % 40))
    f = f.withColumn("relations", F.transform("relations", lambda x: F.struct(old(x.subject, n).alias("subject"), x.predicate.alias("predicate"), old(x.object, n).alias("object"))))
    told = F.array_join(F.array_sort(F.transform("relations", lambda x: F.concat_ws("\x1e", x.subject, x.predicate, x.object))), "\x1d")
    f = f.withColumn("fingerprint", X.fingerprint(F.col("sid"), F.col("subject"), F.col("category"), F.col("content"), told))
    known = spark.range(9).select(F.concat(F.lit("qq:"), "id").alias("id")).where("id <> 'qq:8'").unionByName(spark.createDataFrame([("wx:3",)], "id string"))
    return I.bind_identities(r, f, names(spark, d).withColumn("entity", old(F.col("entity"), F.col("observed").cast("long"))), known)


BOUND = "CASE WHEN {0} IN ('qq:3', 'qq:8') AND {1} % 2 = 0 THEN replace({0}, 'qq:', 'legacy:user:') ELSE {0} END"


@q(f"SELECT id, list_distinct(list_transform(users, lambda u: {BOUND.format('u', 'position')})) AS users_ FROM records".replace("list_distinct(", "list_sort(list_distinct(").replace(") AS users_", ")) AS users"))
def identity_bound_records(spark, d):
    return _bound(spark, d)[0].select("id", F.array_sort(F.array_distinct("users")).alias("users"))


@q(f"""f AS (SELECT id, CAST(substr(id, 2) AS BIGINT) AS n, sid, category, subject, relations[1] AS r, sources, importance FROM facts WHERE deleted = 0),
g AS (SELECT id, sid, {BOUND.format('subject', 'n')} AS subject, category, sources, importance, 'c' || (n % 40) AS content, {BOUND.format("r['subject']", 'n')} AS a, r['predicate'] AS p, {BOUND.format("r['object']", 'n')} AS o FROM f),
h AS (SELECT *, sha256(concat_ws(chr(31), sid, subject, category, content, concat_ws(chr(30), a, p, o))) AS fingerprint FROM g)
SELECT min(id) AS id, sid, subject, fingerprint, list_sort(list_distinct(flatten(list(sources)))) AS sources, max(importance) AS importance, count(*) AS n FROM h GROUP BY sid, subject, fingerprint""")
def identity_bound_facts(spark, d):
    return _bound(spark, d)[1].select("id", "sid", "subject", "fingerprint", "sources", "importance", "n")


@q("SELECT id, count(*) OVER (PARTITION BY sid ORDER BY start, id) - 1 AS position FROM records")
def captured_positions(spark, d):
    """Messages in three batches, all of them delivered twice: once more in a later batch, and by another checkpoint."""
    rows = records(spark, d).select(F.col("id").alias("event_key"), "sid", F.col("start").alias("at"), F.timestamp_millis((F.col("start") * 1000).cast("long")).alias("ts"))
    src, path = _stream(spark, rows, 3)
    for k in (1, 2):
        again = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in/b=*")
        CA.capture_to(again, f"{path}/captured", f"{path}/check{k}").awaitTermination()
    return CA.captured(spark, f"{path}/captured").select(F.col("event_key").alias("id"), "position")


OVER = "p AS (SELECT *, row_number() OVER w AS k, sum(length(content)) OVER w AS used FROM records WHERE permanent = 1 AND deleted = 0 AND active = 1 WINDOW w AS (PARTITION BY sid ORDER BY importance DESC, id ROWS UNBOUNDED PRECEDING)), over_ AS (SELECT id, sid, content, importance, users FROM p WHERE k > 3 OR (used > 400 AND k > 1))"


@q(f"{OVER} SELECT id, CASE WHEN id IN (SELECT id FROM over_) THEN 0 ELSE permanent END AS permanent, CASE WHEN id IN (SELECT id FROM over_) THEN 0 ELSE active END AS active, revision + CAST(id IN (SELECT id FROM over_) AS INT) AS revision FROM records")
def capped_records(spark, d):
    return L.within_cap(records(spark, d), facts(spark, d), NOW, 3, 400)[0].select("id", "permanent", "active", "revision")


@q(f"""{OVER}, said AS (SELECT sid, content, list_sort(list(DISTINCT id)) AS more, max(importance) AS i FROM over_ GROUP BY ALL)
SELECT sha256('extracted' || chr(31) || sid || chr(31) || content) AS id, sid, i AS importance, more AS sources FROM said UNION ALL SELECT id, sid, importance, list_distinct(sources) FROM facts WHERE deleted = 0""".replace("list_distinct(sources)", "list_sort(list_distinct(sources))"))
def capped_facts(spark, d):
    return L.within_cap(records(spark, d), facts(spark, d), NOW, 3, 400)[1].select("id", "sid", "importance", F.array_sort("sources").alias("sources"))


GONE = f"(((cold = 1 AND (archived_at = 0 OR archived_at <= {NOW} - 30 * 86400)) OR deleted = 1) AND trim(content) <> '')"


@q(f"SELECT count(*) FILTER ({GONE}) AS n, CAST(coalesce(sum(strlen(content)) FILTER ({GONE}), 0) AS BIGINT) AS bytes, min(\"end\") FILTER ({GONE}) AS oldest, max(\"end\") FILTER ({GONE}) AS newest FROM records")
def cold_preview(spark, d):
    return L.cold_preview(records(spark, d), NOW, 30)


@q(f"SELECT count(*) FILTER ({GONE} AND position % 2 = 1) AS moved, count(*) FILTER ({GONE} AND position % 2 = 1) AS bodies, CAST(coalesce(sum(strlen(content)) FILTER ({GONE} AND position % 2 = 1), 0) AS BIGINT) AS bytes, 0 AS stray FROM records")
def cold_stats_after_restore(spark, d):
    """The bodies of every second row are read back; the rest stays cold."""
    hot, cold = L.spill_cold(records(spark, d), NOW, 30)
    rows, left = L.restore_cold(hot, cold, records(spark, d).where("position % 2 = 0").select("id"))
    return L.cold_stats(rows, left)


def _heard(spark, d) -> DataFrame:
    c = wrapped(spark, d)
    call = F.when((F.col("role") == "assistant") & (F.col("turn") % 3 == 0), F.array(F.struct(F.lit("look").alias("name"), F.concat(F.lit("n="), "turn").alias("arguments"))))
    media, k = F.col("turn") % 7 == 5, F.col("turn") % 4
    return c.select(
        F.concat(F.lit("e"), "conv_id").alias("event"), F.col("turn").alias("n"), F.lit("qq:gm:1").alias("sid"), F.lit("qq").alias("adapter"), (F.col("turn") % 6 == 4).alias("notice"), "role",
        F.when(k == 3, "unknown").otherwise(F.col("turn").cast("string")).alias("sender_id"), F.when(k == 1, "Ann").alias("sender_name"), F.when(media, "[Image x").when(F.col("turn") % 5 == 1, "<msg/>").otherwise(F.col("raw")).alias("text"), call.alias("tool_calls"),
    )


SAID = f"""m AS (SELECT conv_id, turn, role, turn % 6 = 4 AS notice, role = 'assistant' AND turn % 3 = 0 AS called, CASE WHEN turn % 4 = 3 THEN '' ELSE '' || turn END AS account, CASE WHEN turn % 7 = 5 THEN '[Image x' WHEN turn % 5 = 1 THEN '' WHEN {K} = 3 AND role = 'assistant' THEN {PLAIN} ELSE {CLEANED} END AS said FROM conversations),
u AS (SELECT conv_id, list_sort(list(DISTINCT 'qq:' || account) FILTER (account <> '')) AS users FROM m WHERE NOT notice GROUP BY conv_id)"""


@query(f"""WITH {SAID} SELECT 'e' || conv_id AS event, turn AS n, CASE WHEN called AND said <> '' THEN said || chr(10) ELSE said END || CASE WHEN called THEN '{{"tool_calls":[{{"name":"look","arguments":"n=' || turn || '"}}]}}' ELSE '' END AS content,
CASE WHEN called AND said <> '' THEN said || chr(10) ELSE said END || CASE WHEN called THEN '[调用工具：look(n=' || turn || ')]' ELSE '' END AS summary,
CASE WHEN called THEN 'tool' WHEN role = 'user' AND (turn % 7 = 5 OR NOT regexp_matches(said, '[0-9A-Za-z]')) THEN 'media' ELSE '' END AS category, CASE WHEN turn % 4 = 1 THEN 'Ann' ELSE account END AS speaker, CASE WHEN account = '' THEN '' ELSE 'qq:' || account END AS speaker_id, coalesce(users, []) AS users
FROM m LEFT JOIN u USING (conv_id) WHERE NOT notice AND (said <> '' OR called)""")
def capture_hygiene(spark, d):
    return N.to_capture(_heard(spark, d)).drop("sid", "role")


@q("""SELECT '100-' || CAST(floor(start * 1000) AS BIGINT) || '-' || CAST(floor("end" * 1000) AS BIGINT) || '-' || substr(sha256(concat_ws(chr(31), sid, content, array_to_string(users, ','), category)), 1, 12) AS id, sid, 100 AS level, CASE WHEN position % 2 = 0 THEN 8 ELSE importance END AS importance, 1 AS permanent FROM records""")
def pinned_records(spark, d):
    r = records(spark, d).withColumn("importance", F.when(F.col("position") % 2 == 1, F.col("importance")))
    return N.pinned(r, NOW).select("id", "sid", "level", "importance", "permanent")


@q("""s AS (SELECT id, position % 5 AS k, deleted, revision, content FROM records) SELECT id, CASE WHEN deleted = 0 AND k = 0 THEN 1 ELSE deleted END AS deleted, CAST(revision + CASE WHEN deleted = 0 AND k IN (0, 1, 2) THEN 1 ELSE 0 END AS INT) AS revision,
CASE WHEN k = 0 THEN '工具感知结果：{"ok": true, "records": 1}' WHEN k = 1 THEN CASE WHEN deleted = 0 THEN '工具感知结果：' || repeat('y', 240) || '…' ELSE '工具感知结果：' || repeat('y', 500) END WHEN k = 2 THEN CASE WHEN deleted = 0 THEN 'well [调用工具：look(a)、go]' ELSE 'well' || chr(10) || '{"tool_calls": [{"name": "look", "arguments": "a"}, {"name": "go"}]}' END
WHEN k = 3 THEN '工具感知结果：short' ELSE content END AS summary, CASE WHEN deleted = 0 THEN CASE k WHEN 0 THEN 'removed' WHEN 1 THEN 'rewritten' WHEN 2 THEN 'rewritten' END END AS done FROM s""")
def tidied_tools(spark, d):
    """Run twice, so that the second run must find nothing left to do."""
    k = F.col("position") % 5
    said = F.when(k == 0, '工具感知结果：{"ok": true, "records": 1}').when(k == 1, "工具感知结果：" + "y" * 500).when(k == 2, 'well\n{"tool_calls": [{"name": "look", "arguments": "a"}, {"name": "go"}]}').when(k == 3, "工具感知结果：short").otherwise(F.col("content"))
    r = records(spark, d).select("id", "deleted", "revision", said.alias("summary"), F.lit("").alias("content"))
    once = N.tidied_tools(r, ['"records"'])
    again = N.tidied_tools(once.drop("done"), ['"records"']).select("id", "deleted", "revision", "summary", F.col("done").alias("_again"))
    return again.join(once.select("id", "done"), "id").select("id", "deleted", "revision", "summary", F.coalesce(F.concat(F.lit("again "), "_again"), "done").alias("done"))


@query("""WITH c AS (SELECT c_custkey AS n, c_custkey % 8 AS k FROM customer) SELECT n AS c_custkey, CASE k WHEN 0 THEN '全局记忆' WHEN 1 THEN '机器人自身' WHEN 2 THEN '未分类 · 来源会话未确定' WHEN 3 THEN '待绑定 · 群 ' || n WHEN 4 THEN '待绑定 · 号码 ' || n WHEN 5 THEN '待绑定 · 号码 ' || n WHEN 6 THEN '未分类' ELSE '名称待补全' END AS label,
CASE k WHEN 4 THEN 'qq:' || n WHEN 5 THEN '' WHEN 7 THEN 'qq:' || n ELSE '' END AS lookup_id FROM c""")
def identity_labels(spark, d):
    k, n = F.col("c_custkey") % 8, F.col("c_custkey").cast("string")
    forms = [F.lit("global"), F.lit("legacy:self"), F.lit("legacy:unscoped"), F.concat(F.lit("unresolved:group:qq:"), n), F.concat(F.lit("legacy:user:qq:"), n), F.concat(F.lit("legacy:group:"), n), F.concat(F.lit("legacy:"), n), F.concat(F.lit("qq:"), n)]
    i = F.coalesce(*[F.when(k == j, f) for j, f in enumerate(forms)])
    return t(spark, d, "customer").withColumn("x", N.identity_info(i)).select("c_custkey", "x.label", "x.lookup_id")


@q("""a AS (SELECT sid, id, 'r' || row_number() OVER (PARTITION BY sid ORDER BY position, id) AS alias, row_number() OVER (PARTITION BY sid ORDER BY position, id) AS k FROM records WHERE active = 1 AND deleted = 0)
SELECT x.sid AS batch, x.k AS n, [x.id, y.id] AS source_ids FROM a x JOIN a y ON y.sid = x.sid AND y.k = 1 WHERE x.k % 3 <> 0 UNION ALL SELECT sid, k, [] FROM a WHERE k % 6 = 0""")
def restored_aliases(spark, d):
    """Facts cite their record by alias and the first one by id; every sixth cites nothing, others a stranger as well."""
    a = R.aliases(records(spark, d)).withColumn("k", F.substring("alias", 2, 9).cast("long"))
    first = a.where("k = 1").select("sid", F.col("id").alias("first"))
    said = F.when(F.col("k") % 6 == 0, F.array().cast("array<string>")).when(F.col("k") % 3 == 0, F.array("alias", F.lit("r0"))).otherwise(F.array("alias", "first"))
    out = a.join(first, "sid").select(F.col("sid").alias("batch"), F.col("k").alias("n"), said.alias("source_ids"))
    return N.restored_aliases(out, a.select(F.col("sid").alias("batch"), "alias", "id"))[0]


GRAMS = "list_distinct(list_transform(range(1, length(c)), lambda i: substr(c, i, 2)))"


@q(f"""n AS (SELECT id, subject, category, lower(regexp_replace(content, '[\\s，。、；：！？,.!?;:''"“”‘’()（）\\[\\]【】<>《》\\-—~～/\\\\]+', '', 'g')) AS c FROM facts WHERE deleted = 0), g AS (SELECT id, subject, category, {GRAMS} AS s FROM n WHERE length(c) > 1),
p AS (SELECT a.id AS a, b.id AS b, a.category = b.category AS same, len(list_intersect(a.s, b.s)) AS k, least(len(a.s), len(b.s)) AS m FROM g a JOIN g b ON a.subject = b.subject AND a.id < b.id)
SELECT a, b, round(k / m, 6) AS similarity FROM p WHERE k >= 4 AND round(k / m, 6) >= CASE WHEN same THEN 0.6 ELSE 0.75 END""")
def category_pairs(spark, d):
    return SI.category_pairs(facts(spark, d).where("deleted = 0"), "id", "content", "subject", "category", 0.6, 0.75)


@query("""WITH g AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS root, count(*) OVER (PARTITION BY text) AS c FROM documents WHERE text IS NOT NULL), k AS (SELECT *, row_number() OVER (PARTITION BY root ORDER BY doc_id % 97, doc_id) AS n FROM g WHERE c > 1)
SELECT root, list(doc_id ORDER BY n) FILTER (n <= 5) AS members FROM k GROUP BY root""")
def cluster_heads(spark, d):
    """Chains of documents with one text as clusters, of each the first five by doc_id % 97."""
    before = F.lag("doc_id").over(Window.partitionBy(F.sha2("text", 256)).orderBy("doc_id"))
    e = t(spark, d, "documents").where("text IS NOT NULL").select(F.col("doc_id").alias("a"), before.alias("b")).where("b IS NOT NULL")
    found = SI.clusters(e)
    return SI.first_members(found, found.select("node").distinct().select("node", F.struct(F.col("node") % 97, "node").alias("place")))


VERDICTS = "v AS (SELECT id, subject, CASE n % 4 WHEN 0 THEN 'keep' WHEN 1 THEN 'merge' WHEN 2 THEN 'retract' ELSE 'correct' END AS action, 'f' || (n + CASE WHEN n % 8 = 1 THEN 36 ELSE 35 END) AS target, importance + 3 AS wanted FROM (SELECT *, CAST(substr(id, 2) AS BIGINT) AS n FROM facts WHERE deleted = 0) WHERE n % 4 < 3 AND n % 16 <> 5 AND n % 16 <> 9)"


def _audit(spark, d):
    f = facts(spark, d).withColumn("n", F.substring("id", 2, 20).cast("long"))
    k = F.col("n") % 4
    v = f.where("deleted = 0 AND n % 4 < 3 AND n % 16 <> 5 AND n % 16 <> 9").select(
        "id", F.when(k == 0, "keep").when(k == 1, "merge").otherwise("retract").alias("action"), F.lit(None).cast("int").alias("importance"), F.lit(None).cast("string").alias("content"),
        F.concat(F.lit("f"), (F.col("n") + F.when(F.col("n") % 8 == 1, 36).otherwise(35)).cast("string")).alias("target"),
    )
    return FA.audit_applied(f.drop("n"), v, records(spark, d))


MERGED = f"{VERDICTS}, away AS (SELECT id FROM v WHERE action IN ('merge', 'retract')), good AS (SELECT v.id, v.target, f.sources, f.importance FROM v JOIN facts f ON f.id = v.id JOIN facts g ON g.id = v.target AND g.deleted = 0 AND g.subject = v.subject WHERE action = 'merge' AND target NOT IN (SELECT id FROM away))"


@q(f"""{MERGED} SELECT action, count(*) AS n FROM (SELECT CASE WHEN action = 'merge' AND id NOT IN (SELECT id FROM good) THEN 'refused' ELSE action END AS action FROM v) GROUP BY action""")
def audit_counts(spark, d):
    return _audit(spark, d)[1]


@q(f"""{MERGED}, came AS (SELECT target AS id, list_sort(flatten(list(sources))) AS more, max(importance) AS most, list_sort(list(id)) AS merged FROM good GROUP BY target)
SELECT f.id, greatest(f.importance, coalesce(most, 0)) AS importance, CASE WHEN f.id IN (SELECT id FROM good) OR action = 'retract' THEN 1 ELSE 0 END AS deleted, list_sort(list_distinct(list_concat(f.sources, coalesce(more, [])))) AS sources, coalesce(merged, []) AS merged
FROM facts f LEFT JOIN v ON v.id = f.id LEFT JOIN came ON came.id = f.id WHERE f.deleted = 0 AND (v.id IS NOT NULL OR came.id IS NOT NULL)""")
def audit_merges(spark, d):
    return _audit(spark, d)[0].select("id", "importance", "deleted", F.array_sort("sources").alias("sources"), "merged")


RECALLED = "deleted = 0 AND category <> 'media' AND cold = 0"


@q(f"""rows_ AS (SELECT * FROM records WHERE {RECALLED}), over_ AS (SELECT sid, level, start, "end" AS e FROM rows_ WHERE active = 1)
SELECT id FROM rows_ a WHERE NOT (active = 0 AND EXISTS (SELECT 1 FROM over_ b WHERE a.sid = b.sid AND b.level > a.level AND b.start <= a.start AND b.e >= a."end"))""")
def folded_elimination(spark, d):
    r = records(spark, d)
    found = R.recallable(r)
    return found.join(R.folded(found, r), "id", "left_anti").select("id")


@q("""s AS (SELECT id AS fact, unnest(sources) AS id, unnest(range(len(sources))) AS place, src_user FROM facts WHERE deleted = 0)
SELECT fact, CAST(place AS INT) AS place, id, role, start, src_user FROM s JOIN records USING (id) WHERE records.deleted = 0""")
def evidence_of_facts(spark, d):
    return FA.evidence(facts(spark, d), records(spark, d)).select("fact", "place", "id", "role", "start", "src_user")


@q("""far AS (SELECT DISTINCT f.id AS fact, r.object AS entity FROM (SELECT id, unnest(relations) AS r FROM facts WHERE deleted = 0) f),
one AS (SELECT entity, max_by(name, (observed, name)) AS name FROM names GROUP BY entity), told AS (SELECT subject AS entity, id, content, row_number() OVER (PARTITION BY subject ORDER BY importance DESC, id) AS n FROM facts WHERE deleted = 0)
SELECT fact, entity, coalesce(name, '') AS name, coalesce(tops, []) AS tops FROM far LEFT JOIN one USING (entity) LEFT JOIN (SELECT entity, list(id ORDER BY n) FILTER (n <= 2) AS tops FROM told GROUP BY entity) USING (entity)""")
def neighbours_of_facts(spark, d):
    return FA.neighbours(facts(spark, d), names(spark, d), 2)


@q("""SELECT level, CAST(year(make_timestamp(CAST(start * 1e6 AS BIGINT))) AS INT) AS y, count(*) AS n, count(*) FILTER (permanent = 1) AS pinned, CAST(sum(length(content)) AS BIGINT) AS chars FROM records WHERE deleted = 0 GROUP BY ALL""")
def capacity_by_level(spark, d):
    return R.capacity(records(spark, d))
