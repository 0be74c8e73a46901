"""Column expressions of text matching, similarity, decay and scope; all stay inside the JVM."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that carry no meaning in a query; characters that likeness leaves out; those that no text should hold.
STOP = ("记得", "之前", "上次", "曾经", "什么", "那个", "这个", "我们", "你们", "他们", "怎么", "是不是", "the", "and", "that", "with")
NOISE = r"[\s，。、；：！？,.!?;:'\"“”‘’()（）\[\]【】<>《》\-—~～/\\]+"
BAD = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x{fffd}]"
CJK = r"\x{3400}-\x{9fff}"


def let(c: Column, f) -> Column:
    """f(c) with ``c`` worked out once, however often ``f`` names it."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def _letters(c: Column) -> Column:
    return F.filter(F.split(c, ""), lambda x: x != "")


def _adjacent(letters: Column) -> Column:
    """Adjacent pairs of an array of characters, in one pass."""
    n = F.greatest(F.size(letters) - 1, F.lit(0))
    return F.zip_with(F.slice(letters, F.lit(1), n), F.slice(letters, F.lit(2), n), lambda a, b: F.concat(a, b))


def normalize(c: Column) -> Column:
    """Lower case, without white space and punctuation."""
    return F.regexp_replace(F.lower(c), NOISE, "")


def bigrams(c: Column) -> Column:
    """Distinct pairs of adjacent characters of the normalised text; a single character stands for itself."""
    return let(_letters(normalize(c)), lambda x: F.when(F.size(x) < 2, x).otherwise(F.array_distinct(_adjacent(x))))


def bigrams_of(text: str) -> Column:
    """bigrams() of a text that is known here, worked out once."""
    n = re.sub(NOISE, "", text.lower(), flags=re.ASCII)
    pairs = dict.fromkeys(n[k : k + 2] for k in range(len(n) - 1)) if len(n) > 1 else [n] if n else []
    return F.array(*map(F.lit, pairs)).cast("array<string>")


def vector_of(query) -> Column:
    """A query's vector: numbers, or a column such as a scalar subquery of one row."""
    return query if isinstance(query, Column) else F.array(*[F.lit(float(x)) for x in query])


def containment(a: Column, b: Column, min_overlap: int = 4) -> Column:
    """Common members of two sets over the smaller set's size; 0 below ``min_overlap`` common members."""
    sizes = F.struct(F.size(F.array_intersect(a, b)).alias("both"), F.least(F.size(a), F.size(b)).alias("least"))
    return let(sizes, lambda n: F.when(n.both >= min_overlap, n.both / n.least).otherwise(0.0))


def squeeze(c: Column) -> Column:
    """Without control characters, blanks between CJK characters, and repeated or outer blanks; null as empty."""
    out = F.regexp_replace(F.coalesce(c, F.lit("")), BAD, "")
    out = F.regexp_replace(out, f"(?<=[{CJK}])[ \\t]+(?=[{CJK}])", "")
    return F.regexp_replace(F.regexp_replace(out, r"[ \t]{2,}", " "), r"^\s+|\s+$", "")


def _squeezed(text: str) -> str:
    """squeeze() of a literal."""
    cjk = "\u3400-\u9fff"
    out = re.sub("[\x00-\x08\x0b\x0c\x0e-\x1f\ufffd]", "", text or "")
    return re.sub(r"[ \t]{2,}", " ", re.sub(f"(?<=[{cjk}])[ \\t]+(?=[{cjk}])", "", out)).strip()


def _chunks(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(squeeze(c)), F.lit(f"[a-z0-9_]+|[{CJK}]+"), 0)


def _pairs(t: Column) -> Column:
    """Adjacent pairs of characters; none of a single one."""
    return let(_letters(t), _adjacent)


def index_grams(c: Column) -> Column:
    """Of each Latin or CJK chunk all characters and all adjacent pairs, joined by spaces, in order."""
    return F.concat_ws(" ", F.flatten(F.transform(_chunks(c), lambda t: let(_letters(t), lambda x: F.concat(x, _adjacent(x))))))


def search_body(c: Column) -> Column:
    """What an index of grams holds of a text; a dash for texts without any."""
    return F.coalesce(F.nullif(index_grams(c), F.lit("")), F.lit("-"))


def tokens_of(c: Column) -> Column:
    """query_tokens() of a column: distinct, sorted."""
    each = F.transform(_chunks(c), lambda t: F.when((F.length(t) < 2) | t.rlike("^[a-z0-9_]"), F.array(t)).otherwise(_pairs(t)))
    return F.array_sort(F.array_except(F.array_distinct(F.flatten(each)), F.array(*map(F.lit, STOP))))


def query_tokens(query: str) -> list[str]:
    """Latin chunks whole, CJK chunks as adjacent pairs (a single character as it is), sorted, without stop words."""
    found: set[str] = set()
    for chunk in re.findall(r"[a-z0-9_]+|[㐀-鿿]+", _squeezed(query).casefold()):
        found.update([chunk] if chunk[0] < "㐀" or len(chunk) == 1 else [chunk[k : k + 2] for k in range(len(chunk) - 1)])
    return sorted(found - set(STOP))


def score_tokens(query: str, words=None) -> list[str]:
    """Tokens for scoring: with a word splitter ``words`` CJK words of two letters or more, else query_tokens()."""
    if words is None:
        return query_tokens(query)
    found: set[str] = set()
    for chunk in re.findall(r"[a-z0-9_]+|[㐀-鿿]+", _squeezed(query).casefold()):
        found.update([chunk] if chunk[0] < "㐀" else [w for w in words(chunk) if len(w) >= 2])
    return sorted(found - set(STOP)) or query_tokens(query)


def match_grams(tokens: list[str]) -> list[str]:
    """The grams of which a text must hold one to be a candidate: tokens of over two letters by their pairs."""
    return [g for t in (x.strip() for x in tokens) if t for g in ([t] if len(t) <= 2 else [t[k : k + 2] for k in range(len(t) - 1)])]


def relevance(c: Column, query: str) -> Column:
    """lexical_score() on the squeezed text, by the query's scoring tokens."""
    return lexical_score(squeeze(c), score_tokens(query))


def lexical_score(c: Column, tokens: list[str], most: int = 256) -> Column:
    """Sum of the lengths of the tokens that the lower-case text contains."""
    low = F.lower(c)
    return reduce(lambda a, t: a + F.when(F.contains(low, F.lit(t)), len(t)).otherwise(0), tokens[:most], F.lit(0))


def proximity_bonus(c: Column, tokens: list[str], window: int = 30, bonus: int = 4) -> Column:
    """``bonus`` if at least two tokens occur and their first places lie within ``window`` characters."""
    places = F.filter(F.array(*[F.instr(F.lower(c), t) for t in tokens]), lambda p: p > 0)
    return F.when((F.size(places) >= 2) & (F.array_max(places) - F.array_min(places) <= window), bonus).otherwise(0)


def overlap_hit(c: Column, reply: str, min_hits: int = 2) -> Column:
    """Whether ``reply`` uses the text: holds enough of its tokens of two letters or more, or a number of five digits or more.

    False for null texts and those without such tokens.
    """
    body = F.lit(_squeezed(reply).casefold())
    tokens = F.filter(tokens_of(c), lambda t: F.length(t) >= 2)
    told = F.size(F.filter(tokens, lambda t: F.contains(body, t))) >= max(1, min_hits)
    number = F.exists(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"\d{5,}"), 0), lambda d: F.contains(body, d))
    return (F.size(tokens) > 0) & (F.lit(reply) != "") & (told | number)


def used_in(text: str, reply: str, min_hits: int = 2) -> bool:
    """overlap_hit() of two strings."""
    tokens, body = [t for t in query_tokens(text) if len(t) >= 2], _squeezed(reply).casefold()
    hits = sum(t in body for t in tokens) >= max(1, min_hits)
    return bool(tokens and reply) and (hits or any(d in body for d in re.findall(r"[0-9]{5,}", text or "")))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; -1 if lengths differ, one is null or has no length."""
    parts = F.struct(F.sqrt(dot(a, a)).alias("x"), F.sqrt(dot(b, b)).alias("y"), dot(a, b).alias("xy"))
    return let(parts, lambda p: F.when((F.size(a) == F.size(b)) & (p.x * p.y > 0), p.xy / (p.x * p.y)).otherwise(-1.0))


def half_life(age_days: Column, days: float) -> Column:
    return F.pow(F.lit(0.5), age_days / days)


def retention_score(importance: Column, access_age: Column, start_age: Column, access: Column, rule: Column) -> Column:
    """Low scores are let go first."""
    used = F.least(access * 0.05, F.lit(0.3))
    total = importance / 10 * 0.35 + half_life(access_age, 30) * 0.25 + half_life(start_age, 90) * 0.1 + used + F.when(rule, 0.5).otherwise(0.0)
    return F.bround(total, 4)


def sink_score(importance: Column, used: Column, used_age: Column, age: Column, bonus: Column) -> Column:
    """Freshness and use of a fact, to a whole number.

    Use counts up to 5 and halves in 60 days, and not at all where used_age is null; without an age freshness is 0. Ages in
    days, negative ones count as 0; importance is 5 where it is null or 0.
    """
    use = F.least(F.coalesce(used, F.lit(0)), F.lit(5)) * F.coalesce(half_life(F.greatest(used_age, F.lit(0.0)), 60), F.lit(1.0))
    fresh = F.when(age.isNull(), 0.0).otherwise(F.greatest((1 - F.greatest(age, F.lit(0.0)) / 60) * 10, F.lit(0.0)))
    return F.bround(F.coalesce(F.nullif(importance, F.lit(0)), F.lit(5)) * 2 + use * 3 + fresh + bonus, 0).cast("int")


def sinks(importance: Column, age: Column, score: Column, threshold: int) -> Column:
    """Whether a fact gives way: under ``threshold`` (0: never), not at importance 8 or more, nor without an age."""
    return F.lit(threshold > 0) & (F.coalesce(F.nullif(importance, F.lit(0)), F.lit(5)) < 8) & age.isNotNull() & (score < threshold)


def importance_of(c: Column) -> Column:
    """A number from text, rounded to even, 1 to 10; 5 for what is none."""
    n = c.try_cast("double")
    return F.when(n.isNull() | F.isnan(n), 5).otherwise(F.greatest(F.least(F.bround(n, 0), F.lit(10.0)), F.lit(1.0)).cast("int"))


# Categories, their codes and ranks, and other names that stand for them.
CATEGORY_CODES = {"event": "ev", "fact": "fa", "preference": "pr", "commitment": "co", "relationship": "re", "profile": "pf", "resource": "rs", "self": "sf"}
CATEGORY_RANK = {"rule": 0, "commitment": 1, "preference": 2, "profile": 3, "relationship": 4, "resource": 5, "event": 6, "fact": 7, "note": 8}
CATEGORY_ALIASES = {
    "事件": "event", "事实": "fact", "偏好": "preference", "喜好": "preference", "习惯": "preference", "约定": "commitment", "承诺": "commitment",
    "关系": "relationship", "画像": "profile", "档案": "profile", "资料": "profile", "资源": "resource", "自我": "self", "自身": "self",
    "general": "fact", "other": "fact", "misc": "fact", "note": "fact", "info": "fact", "personal": "profile", "identity": "profile",
}


def _choice(c: Column, table: dict, default: Column) -> Column:
    found = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[c]
    return F.coalesce(found, default)


def category(c: Column) -> Column:
    """The category a name stands for; unknown names trimmed."""
    plain = F.lower(F.trim(c))
    return F.when(plain.isin(*CATEGORY_CODES), plain).otherwise(_choice(plain, CATEGORY_ALIASES, F.trim(c)))


def category_code(c: Column) -> Column:
    return _choice(c, CATEGORY_CODES, c)


def category_rank(c: Column) -> Column:
    return _choice(c, CATEGORY_RANK, F.lit(9))


def named_pair(entity: Column, name: Column) -> Column:
    """id(name); the id alone without another name, the name alone without an id."""
    i, n = F.coalesce(entity, F.lit("")), F.trim(F.coalesce(name, F.lit("")))
    return F.when(i == "", n).when((n == "") | (n == i), i).otherwise(F.concat(i, F.lit("("), n, F.lit(")")))


def bare_id(c: Column) -> Column:
    """What stands before the first bracket, trimmed."""
    return F.trim(F.substring_index(F.coalesce(c, F.lit("")), "(", 1))


def utc_text(epoch: Column) -> Column:
    """yyyy-MM-dd HH:mm:ss in UTC, whatever the session's time zone."""
    return (F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(secs=epoch.cast("decimal(18,6)"))).cast("string")


def short_time(epoch: Column, year: int, with_clock: bool = True) -> Column:
    """Month, day (and clock), with the year where it isn't ``year``; empty outside 2000 to 2100 and for null; in UTC."""
    most = 16 if with_clock else 10
    good = F.when(epoch.between(946684800, 4102444800), epoch)
    text = let(utc_text(good), lambda x: F.when(F.startswith(x, F.lit(f"{year}-")), F.substring(x, 6, most - 5)).otherwise(F.substring(x, 1, most)))
    return F.coalesce(text, F.lit(""))


def full_time(epoch: Column) -> Column:
    """Date and clock in UTC; empty where there is none."""
    return F.when(epoch > 0, F.substring(utc_text(epoch), 1, 16)).otherwise("")


def parsed_time(c: Column, fallback: Column) -> Column:
    """struct<at double, basis string> of ISO text (without a zone: UTC; eight digits: a date), or seconds since 1970, else
    of ``fallback``."""
    text = F.trim(c)
    date = F.regexp_replace(text, r"^(\d{4})(\d{2})(\d{2})$", "$1-$2-$3")
    stamp = F.when(date.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.concat(date, F.lit("T00:00:00Z"))).when(text.rlike(r"^\d{4}-\d{2}-\d{2}.*(?:[zZ]|[+-]\d{2}:?\d{2})$"), F.upper(text)).when(text.rlike(r"^\d{4}-\d{2}-\d{2}[T ]"), F.concat(text, F.lit("Z")))
    iso = F.unix_micros(F.try_to_timestamp(stamp)) / 1e6
    number = F.when(text.rlike(r"^\d+(\.\d+)?$") & ~text.rlike(r"^\d{8}$"), text.try_cast("double"))
    ok = F.when((number > 0) & (number < 32503680000), number)
    return F.struct(F.coalesce(iso, ok, fallback).alias("at"), F.when(iso.isNotNull(), "source.time").when(ok.isNotNull(), "source.timestamp").otherwise("file_mtime_estimate").alias("basis"))


def aged_importance(importance: Column, when: Column, now: float, days: float = 365) -> Column:
    """Importance halved every ``days`` since ``when``, from 1 to 10; a time to come counts as now, none as no age.

    Times are seconds; beyond 1e11 they are taken for milliseconds. No ageing where ``days`` isn't above 0; an importance
    that is none is 1.
    """
    now = now / 1000 if now > 1e11 else now
    at = F.when(when > 1e11, when / 1000).otherwise(when)
    age = F.when(at > 0, F.least(F.greatest((F.lit(now) - at) / 86400, F.lit(0.0)), F.lit(36500.0))).otherwise(0.0) if days > 0 else F.lit(0.0)
    whole = F.coalesce(importance.cast("int"), F.lit(1))
    return F.greatest(F.least(F.bround(whole / F.pow(F.lit(2.0), F.coalesce(age, F.lit(0.0)) / (days if days > 0 else 1)), 0), F.lit(10)), F.lit(1)).cast("int")


def scope(mode: str, sid: Column, visibility: Column, users: Column, own: str, people: list[str]) -> Column:
    """Whether a row may be seen from session ``own`` by ``people``: strict, session, linked or global."""
    mine, shared = sid == own, F.arrays_overlap(users, F.array(*map(F.lit, people)).cast("array<string>"))
    return {
        "strict": mine,
        "session": mine | (visibility == "global") | ((visibility == "user") & shared),
        "linked": mine | (visibility == "global") | shared,
        "global": F.lit(True),
    }[mode]


def preference_tier(sid: Column, visibility: Column, users: Column, own: str, people: list[str]) -> Column:
    """0 for the own session, 1 for shared users, 2 for what all may see, else 3."""
    shared = F.arrays_overlap(users, F.array(*map(F.lit, people)).cast("array<string>"))
    return F.when(sid == own, 0).when(shared, 1).when(visibility == "global", 2).otherwise(3)


def overlaps(start: Column, end: Column, low, high) -> Column:
    return (end >= low) & (start <= high)


def fingerprint(*cols: Column) -> Column:
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(c.cast("string"), F.lit("")) for c in cols]), 256)


def adapter_parts(c: Column) -> Column:
    """struct<adapter, number, kind> of adapter:number or adapter:kind:number (kinds dm, gm, and pm, which is dm); of other
    ids no adapter, the id as number."""
    p = F.split(F.coalesce(c, F.lit("")), ":")
    full, kind = ~F.exists(p, lambda x: x == ""), F.get(p, F.lit(1))
    two, three = (F.size(p) == 2) & full, (F.size(p) == 3) & full & kind.isin("dm", "gm", "pm")
    part = lambda a, b, other: F.when(two, a).when(three, b).otherwise(other)
    none = F.lit("")
    return F.struct(part(p[0], p[0], none).alias("adapter"), part(kind, F.get(p, F.lit(2)), F.coalesce(c, none)).alias("number"), part(none, F.when(kind == "pm", "dm").otherwise(kind), none).alias("kind"))


def pending_parts(c: Column, prefix: str) -> Column:
    """struct<kind, adapter, number> of prefix + user or group : [adapter:] number; null for other ids."""
    rest = F.regexp_extract_all(c, F.lit(f"^{prefix}(user|group):(?:([^:]*):)?([^:\\s]+)$"), F.lit(0))
    get = lambda k: F.regexp_extract(c, f"^{prefix}(user|group):(?:([^:]*):)?([^:\\s]+)$", k)
    return F.when(F.size(rest) > 0, F.struct(get(1).alias("kind"), get(2).alias("adapter"), get(3).alias("number")))
