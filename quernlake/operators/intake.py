"""What messages become before they are stored, pinned rows, upkeep of tool rows, and names for model-facing ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import cleaning as C
from ..functions import envelope as E
from ..functions import exprs as X

CALLS = "struct<tool_calls: array<struct<name: string, arguments: string>>>"
# What stands for a reply without words, and for calls that can't be read.
WORDLESS, UNREAD = "（无文字回复）", "[调用工具]"
# Labels of identities and what they say of them.
LABELS = {
    "global": ("全局记忆", "跨会话共享的全局记忆，不是群聊。"),
    "self": ("机器人自身", "机器人自己的认知与经历。"),
    "unscoped": ("未分类 · 来源会话未确定", "旧数据没有可靠会话标识；保留待核对，不猜群名或归属。"),
    "pending": ("待绑定 · {} {}", "已按号码登记；出现同号码账号或在线适配器后会自动合并。"),
    "legacy": ("待绑定 · 号码 {}", "同号码账号出现后自动合并，不会单独保留为旧档案。"),
    "legacy_unknown": ("未分类", "同号码账号出现后自动合并，不会单独保留为旧档案。"),
    "shapeless": ("未分类", "身份尚未确认。"),
    "account": ("名称待补全", "使用稳定账号区分身份，昵称相同不会合并。"),
}


def _text(c: Column) -> Column:
    return F.trim(F.coalesce(c.cast("string"), F.lit("")))


def to_capture(messages: DataFrame, known: list[str] = ()) -> DataFrame:
    """The rows that messages of events become: event, n, sid, role, content, summary, category, speaker, speaker_id, users.

    messages: event, n, sid, adapter, notice, role, sender_id, sender_name, text, tool_calls (array<struct<name, arguments>>).
    Notices go, and what holds nothing once its wrappers (an assistant's reasoning too) are off, unless it calls tools;
    then the calls follow the text as JSON, and a readable line in the summary. Category: media for shells and media alone
    (mentions of ``known`` names count as shells), tool for calls. users: all accounts that speak in the event, sorted;
    a speaker is named by nickname, else account; unknown ones have no account.
    """
    account = F.when(_text(F.col("sender_id")).isin("", "unknown"), "").otherwise(_text(F.col("sender_id")))
    whole = F.when((account == "") | F.contains(account, F.lit(":")) | (_text(F.col("adapter")) == ""), account).otherwise(F.concat_ws(":", _text(F.col("adapter")), account))
    rows = messages.where(~F.coalesce("notice", F.lit(False))).withColumn("_id", whole).withColumn("_text", E.stored_text(F.lit(0), F.col("role"), F.col("text")))
    called = F.coalesce(F.size("tool_calls") > 0, F.lit(False))
    everyone = F.array_sort(F.collect_set(F.when(F.col("_id") != "", F.col("_id"))).over(Window.partitionBy("event")))
    rows = rows.withColumn("users", everyone).where((F.col("_text") != "") | called)
    line = lambda more, none: F.when(F.col("_text") == "", F.coalesce(F.nullif(more, F.lit("")), F.lit(none))).when(called, F.concat_ws("\n", "_text", more)).otherwise(F.col("_text"))
    body = F.when(called, F.to_json(F.struct("tool_calls"))).otherwise("")
    category = F.when(called, "tool").when((F.col("role") == "user") & C.media_only(F.col("_text"), list(known)), "media").otherwise("")
    return rows.select(
        "event", "n", "sid", "role", line(body, "").alias("content"), line(C.call_summary(F.col("tool_calls")), WORDLESS).alias("summary"), category.alias("category"),
        F.coalesce(F.nullif(_text(F.col("sender_name")), F.lit("")), account).alias("speaker"), F.col("_id").alias("speaker_id"), "users",
    )


def pinned(entries: DataFrame, now: float) -> DataFrame:
    """Pinned records of entries (sid, content, users, start, end, importance, category): level 100, importance 8 where none is
    given. Ids hold the span in milliseconds and a hash of all; equal entries are one row."""
    span = [F.floor(F.col(c) * 1000).cast("long").cast("string") for c in ("start", "end")]
    mark = F.substring(X.fingerprint(F.col("sid"), F.col("content"), F.array_join("users", ","), F.col("category")), 1, 12)
    body = F.coalesce("content", F.lit(""))
    return entries.select(
        F.concat_ws("-", F.lit("100"), *span, mark).alias("id"), "sid", F.lit("assistant").alias("role"), F.lit(100).alias("level"), "start", "end", body.alias("content"), "users", F.lit(1).alias("permanent"),
        F.lit(0).alias("position"), F.lit(float(now)).alias("created"), F.coalesce(F.col("importance").cast("int"), F.lit(8)).alias("importance"), F.coalesce("category", F.lit("")).alias("category"), X.search_body(body).alias("search_body"),
    ).dropDuplicates(["id"])


def tidied_tools(records: DataFrame, markers: list[str], keep: int = 400) -> DataFrame:
    """records (id, summary, content, deleted, revision, ...) after upkeep of tool rows, and done: removed, rewritten or null.

    Live rows that echo this store's own payload go to the trash. A tool's result over ``keep`` characters is cut to a
    preview; calls as JSON in a summary become one readable line. What is done twice changes nothing more.
    """
    s, calls = F.coalesce("summary", F.lit("")), F.coalesce(F.instr("summary", '{"tool_calls"'), F.lit(0))
    result = F.startswith(s, F.lit(C.TOOL_RESULT))
    at = F.instr(s, "\n{")
    said, blob = F.when(at > 0, F.trim(s.substr(F.lit(1), at - 1))).otherwise(F.trim(s)), F.when(at > 0, s.substr(at + 1, F.length(s))).otherwise("")
    read = C.call_summary(F.from_json(blob, CALLS)["tool_calls"])
    line = F.concat(F.when(said != "", F.concat(said, F.lit(" "))).otherwise(""), F.coalesce(F.nullif(read, F.lit("")), F.lit(UNREAD)))
    shorter = F.concat(F.lit(C.TOOL_RESULT), C.tool_preview(s.substr(F.lit(len(C.TOOL_RESULT) + 1), F.length(s))))
    new = F.when(result, F.when(F.length(s) > keep, shorter).otherwise(s)).when(calls > 0, line).otherwise(s)
    live = F.coalesce(F.col("deleted") == 0, F.lit(False)) & (result | (calls > 0))
    gone = live & (C.memory_payload(s, markers) | C.memory_payload(F.coalesce("content", F.lit("")), markers))
    marked = records.withColumn("_new", F.when(live, new).otherwise(F.col("summary"))).withColumn("done", F.when(gone, "removed").when(live & (new != s), "rewritten"))
    change = {"deleted": F.when(F.col("done") == "removed", 1).otherwise(F.col("deleted")), "revision": F.col("revision") + F.col("done").isNotNull().cast("int"), "summary": F.when(F.col("done") == "rewritten", F.col("_new")).otherwise(F.col("summary"))}
    return marked.select(*[change[c].alias(c) if c in change else F.col(c) for c in records.columns], "done")


def identity_info(c: Column, pending: str = "unresolved:", legacy: str = "legacy:") -> Column:
    """struct<label, note, lookup_id> of an id: of all, of the store itself, without a session, pending, legacy, or an account.

    Ids that stand for all (global), the store (self) and no session (unscoped) may be written with the legacy prefix.
    """
    lit = lambda k, label=None, lookup="": F.struct((F.lit(LABELS[k][0]) if label is None else label).alias("label"), F.lit(LABELS[k][1]).alias("note"), (F.lit(lookup) if isinstance(lookup, str) else lookup).alias("lookup_id"))
    named = lambda k: F.coalesce(c.isin(k, legacy + k), F.lit(False))
    waits, old = X.pending_parts(c, pending), X.pending_parts(c, legacy)
    kind = F.when(waits.kind == "group", "群").otherwise("人物")
    lookup = F.when(F.coalesce(old.adapter, F.lit("")) == "", "").when(old.kind == "user", F.concat_ws(":", old.adapter, old.number)).otherwise(F.concat_ws(":", old.adapter, F.lit("gm"), old.number))
    return (
        F.when(named("global"), lit("global")).when(named("self"), lit("self")).when(named("unscoped"), lit("unscoped"))
        .when(F.startswith(c, F.lit(pending)), lit("pending", F.concat(F.lit("待绑定 · "), kind, F.lit(" "), F.coalesce(waits.number, F.lit("")))))
        .when(F.startswith(c, F.lit(legacy)) & old.isNull(), lit("shapeless"))
        .when(F.startswith(c, F.lit(legacy)), lit("legacy", F.concat(F.lit("待绑定 · 号码 "), old.number), lookup))
        .otherwise(lit("account", lookup=c))
    )


def restored_aliases(outputs: DataFrame, aliases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Aliases in what a model gave put back: outputs (batch, n, source_ids), aliases (batch, alias, id) unique by either.

    Real ids of the batch pass. Gives the outputs with real source_ids in their order, and those that name something
    unknown (batch, n, unknown), which are to be asked for anew. Null or empty source_ids stay empty.
    """
    each = outputs.select("batch", "n", F.posexplode(F.coalesce("source_ids", F.array().cast("array<string>"))).alias("k", "name"))
    ways = aliases.select("batch", F.col("alias").alias("name"), "id", F.lit(0).alias("by")).unionByName(aliases.select("batch", F.col("id").alias("name"), "id", F.lit(1).alias("by")))
    ways = ways.groupBy("batch", "name").agg(F.min_by("id", "by").alias("id"))
    both = each.join(ways, ["batch", "name"], "left").groupBy("batch", "n").agg(F.array_sort(F.collect_list(F.struct("k", "id"))).alias("x"), F.array_sort(F.collect_set(F.when(F.col("id").isNull(), F.col("name")))).alias("unknown"))
    wrong = both.where(F.size("unknown") > 0).select("batch", "n", "unknown")
    own = both.where(F.size("unknown") == 0).select("batch", "n", F.transform("x", lambda y: y.id).alias("_ids"))
    good = outputs.join(wrong, ["batch", "n"], "left_anti").join(own, ["batch", "n"], "left")
    return good.select(*[F.coalesce("_ids", F.array().cast("array<string>")).alias(c) if c == "source_ids" else F.col(c) for c in outputs.columns]), wrong
