"""Text hygiene: rejection reasons, shells of replies and media, reasoning blocks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import exprs as X

# Texts that stand for nothing known.
PLACEHOLDERS = ("暂无", "暂无信息", "暂无画像信息", "无", "未知", "无有效信息", "None", "null")
# Predicates that state no relation.
VAGUE = ("认为", "觉得", "说", "提到", "表示", "评价", "是", "相关", "关系", "thinks", "says", "is", "mentions")
# Words that begin a block of media; how media, replies and mentions stand in a text.
MEDIA_WORDS = "Sticker|Image|图片|贴纸|表情|语音|视频|文件|图文|voice|video|file|photo|image|face"
MEDIA_HEAD = rf"(?iU)^\s*\[(?:{MEDIA_WORDS})(?:\s|\])"
MEDIA_INLINE = rf"(?iU)\[(?:{MEDIA_WORDS})[^\]]*\]"
MEDIA_BLOCK = r"(?iU)\[(?:表情|图片|贴纸|语音|视频|文件|Sticker|sticker|face|image|video|voice)[^\]]*\]"
MENTION_SHELL = r"(?iU)\[At\s*-?\d+[^\]]*\]"
OPEN_SHELL = r"(?iU)\[(?:Reply|At\b|CQ:at\b)[^\]]*$|<at[^>]*$"
SHELL = r"(?iU)\[Reply[^\]]*\]|\[Reply[^\]]*$|\[CQ:at[^\]]*\]|\[at[^\]]*\]|<at[^>]*>|↩\S+"
REPLY_WITH_CONTENT = r"(?iU)\[Reply(?:\s+ID)?[:\s,，]*\s*-?\d+\s*content:\s*([^\[\]]*?)\s*\]"
REPLY_SHELL = r"(?iU)\[Reply(?:[^\[\]]|\[[^\[\]]*\])*\]"
MENTION_END = r"[，。！？、,.!?~～:：;；\"'）)】\]]+$"
# How text begins, or what it holds, that is markup.
MARKUP = r"^(?:```|\{|\[|<)|</?\w+[^>]*>"


def rejection(c: Column, limit: int) -> Column:
    """Why a text isn't taken in, or null: too_long, empty, control_characters, markup, placeholder, repetition."""
    s = F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    return (
        F.when(c.isNull(), "invalid_text")
        .when(F.length(c) > limit, "too_long")
        .when(~s.rlike(r"[\p{L}\p{N}]"), "empty")
        .when(s.rlike(r"[\x00-\x08\x0b\x0c\x0e-\x1f]"), "control_characters")
        .when(s.rlike(MARKUP), "markup_or_serialized_output")
        .when(s.isin(*PLACEHOLDERS), "placeholder")
        .when((F.length(s) > 12) & (F.size(F.array_distinct(F.split(s, ""))) < 3), "repetition")
    )


def relation_issue(relation: Column) -> Column:
    """vague, same_ends or null for a struct<subject, predicate, object>."""
    return F.when(F.lower(F.trim(relation["predicate"])).isin(*VAGUE), "vague").when(relation["subject"] == relation["object"], "same_ends")


def without_reasoning(c: Column) -> Column:
    """Without reasoning blocks: pairs go whole; an open one goes up to the next <msg, or the tag alone goes."""
    paired = F.regexp_replace(F.coalesce(c, F.lit("")), r"(?is)<reasoning\b[^>/]*>.*?</reasoning\s*>", "")
    opened = F.regexp_replace(paired, r"(?is)<reasoning\b[^>/]*>.*?(?=<msg\b)", "")
    return F.regexp_replace(opened, r"(?i)</?reasoning\b[^>]*>", "")


def media_only(c: Column, names: list[str] = ()) -> Column:
    """Whether a message begins as media, or holds nothing but shells, media and mentions of known names or numbers."""
    left = F.coalesce(c, F.lit(""))
    for shell in (MENTION_SHELL, OPEN_SHELL, SHELL, MEDIA_BLOCK):
        left = F.regexp_replace(left, shell, " ")
    words = F.filter(F.split(left, r"(?U)\s+"), lambda w: w.rlike(r"[0-9A-Za-z一-鿿]"))
    who = lambda w: F.regexp_replace(w.substr(F.lit(2), F.length(w)), MENTION_END, "")
    mention = lambda w: F.startswith(w, F.lit("@")) & (who(w).rlike(r"^\d+$") | who(w).isin(*names) if names else who(w).rlike(r"^\d+$"))
    return F.coalesce(c, F.lit("")).rlike(MEDIA_HEAD) | (F.size(F.filter(words, lambda w: ~mention(w))) == 0)


def recall_text(c: Column, limit: int = 0) -> Column:
    """Media and replies as short marks, white space collapsed, cut to ``limit`` characters with an ellipsis.

    Media go first, so that a reply's shell may hold some; a reply that quotes what it answers keeps the quote.
    """
    out = F.regexp_replace(F.coalesce(c, F.lit("")), MEDIA_INLINE, " [Image] ")
    out = F.regexp_replace(out, REPLY_WITH_CONTENT, " [Reply] $1 ")
    out = F.regexp_replace(out, REPLY_SHELL, " [Reply] ")
    out = F.trim(F.regexp_replace(out, r"(?U)\s+", " "))
    return X.let(out, lambda x: F.when(F.length(x) > limit, F.concat(F.rtrim(F.substring(x, 1, limit)), F.lit("…"))).otherwise(x)) if limit else out


def tool_preview(c: Column, limit: int = 240) -> Column:
    s = F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))
    return F.when(F.length(s) > limit, F.concat(F.substring(s, 1, limit), F.lit("…"))).otherwise(s)


# How a tool's result and a memory payload begin; names that third parties write for themselves.
TOOL_RESULT = "工具感知结果："
SYNTHETIC_NAMES = ("提醒任务所有者", "Kira", "system", "system:reminder_plugin", "Web UI 用户", "Web UI 管理员", "自主意图循环", "未知")


def tool_result(c: Column) -> Column:
    """Whether a text is what a tool gave."""
    return F.startswith(F.regexp_replace(F.coalesce(c, F.lit("")), r"^\s+", ""), F.lit(TOOL_RESULT))


def memory_payload(c: Column, markers: list[str]) -> Column:
    """Whether a text is a payload of this store: {"ok":true first, blanks aside, and a marker within 4000 characters."""
    head = F.substring(F.coalesce(c, F.lit("")), 1, 4000)
    head = F.when(F.startswith(head, F.lit(TOOL_RESULT)), F.ltrim(head.substr(F.lit(len(TOOL_RESULT) + 1), F.length(head)))).otherwise(head)
    marked = F.exists(F.array(*map(F.lit, markers)), lambda m: F.contains(head, m))
    return F.startswith(F.replace(F.substring(head, 1, 200), F.lit(" "), F.lit("")), F.lit('{"ok":true')) & marked


def call_summary(calls: Column, limit: int = 60) -> Column:
    """Of array<struct<name, arguments>> one readable line, arguments cut to ``limit``; empty without calls."""
    each = F.transform(calls, lambda x: F.concat(F.coalesce(x["name"], F.lit("工具")), F.when(F.coalesce(x["arguments"], F.lit("")) != "", F.concat(F.lit("("), F.substring(x["arguments"], 1, limit), F.lit(")"))).otherwise("")))
    return F.when(F.coalesce(F.size(calls), F.lit(0)) > 0, F.concat(F.lit("[调用工具："), F.array_join(each, "、"), F.lit("]"))).otherwise("")


def synthetic_name(c: Column) -> Column:
    return F.coalesce(F.trim(c).isin(*SYNTHETIC_NAMES), F.lit(False))
