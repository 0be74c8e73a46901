"""URL filter: a blocked Bloom filter of listed canonical URLs, then an exact hash join. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import table, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLOCK_BYTES, BITS = 64, 6  # of a block of the Bloom filter, seven bits used in a byte; bits that a key sets in its block
MOST_BLOCKS = 1 << 17  # 8 MB of filter at most; more keys only let more through to the exact join
BROADCAST_BYTES = 32 << 20  # lists up to this size are broadcast

#: Rules of the query: host, path, verdict.
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first :// up to / ? # or the end, A-Z lower-cased; path: from there up to ? # or the end."""
    rest = F.when(F.instr(url, "://") > 0, url.substr(F.instr(url, "://") + F.lit(3), F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(rest.substr(F.length(host) + F.lit(1), F.length(rest)), "^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def _places(key: list[Column], blocks: int) -> tuple[Column, list[Column]]:
    """The block of a key, and the numbers of its bits in the block."""
    h = F.xxhash64(*key, F.lit(7))
    return F.pmod(F.xxhash64(*key), F.lit(blocks)), [F.pmod(F.shiftright(h, 10 * k), F.lit(1024)) % (7 * BLOCK_BYTES) for k in range(BITS)]


def bloom(listed: DataFrame, key: list[str], count: int, bits_a_key: int = 16) -> tuple[bytes, int]:
    """The blocked Bloom filter of the keys of ``listed``, at most 8 MB, and its number of blocks.

    Bits of a byte are merged by partial aggregation; bytes become a block, and blocks the filter, in the JVM.
    """
    blocks = int(min(max(1, -(-count * bits_a_key // (7 * BLOCK_BYTES))), MOST_BLOCKS))
    block, bits = _places([F.col(k) for k in key], blocks)
    set_bits = listed.select(block.alias("block"), F.explode(F.array(*bits)).alias("bit"))
    cells = set_bits.groupBy("block", (F.col("bit") / 7).cast("int").alias("at")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1), (F.col("bit") % 7).cast("int"))).alias("v"))
    of = cells.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("at", "v"))).alias("m"))
    text = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(BLOCK_BYTES - 1)), lambda i: F.call_function("char", F.coalesce(F.col("m")[i], F.lit(0)))), "")
    rows = listed.sparkSession.range(blocks).withColumnRenamed("id", "block").join(of.select("block", text.alias("t")), "block", "left")
    rows = rows.select("block", F.coalesce("t", F.lit("\0" * BLOCK_BYTES)).alias("t"))
    whole = rows.agg(F.encode(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "t"))), lambda x: x.t), ""), "US-ASCII").alias("f"))
    return bytes(whole.first()[0]), blocks


def _may_be(filter_: tuple[bytes, int], key: list[Column]) -> Column:
    """Whether the filter, a literal of the plan, holds all bits of ``key``: probed where the row is, before any shuffle."""
    block, bits = _places(key, filter_[1])
    own = F.substring(F.lit(filter_[0]), block.cast("int") * BLOCK_BYTES + 1, BLOCK_BYTES)
    hit = F.lit(True)
    for bit in bits:
        hit = hit & (F.call_function("getbit", F.ascii(F.substring(own, (bit / 7).cast("int") + 1, 1).cast("string")), (bit % 7).cast("int")) == 1)
    return hit


def judge_urls(pages: DataFrame, listed: DataFrame, default: str = "allow") -> DataFrame:
    """Judges each url by the listed entries (host, path, verdict); the longest that fits wins, else ``default``.

    An entry fits its host and all subdomains, if the url's path starts with the entry's; a whole canonical URL without
    its query is the narrowest entry. In its row, each url's host and the domains above it are probed in a blocked Bloom
    filter of listed hosts; those that may be listed, with the url's path cut to each length that listed paths have, in
    one of (host, path). Both filters are literals of at most 8 MB. Only possible hits go on, by number of the row, into
    the exact join on host and path, which drops false ones; other rows are shuffled nowhere. Lists of up to 32 MB are
    broadcast, larger ones joined by shuffle. Equal entries: block wins over allow; of entries as long, that of the longer
    host.

    Returns page_id, host, path, rule (host and path of the entry, else null), verdict. Null urls and those without ://:
    empty host and path, judged alike. Repeated rows and null page_id: a row each. Other columns are left out, whatever
    their names; very long urls are judged whole. Entries with a null host or path are left out.
    """
    listed = listed.where("host IS NOT NULL AND path IS NOT NULL").groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    size = listed.agg(F.count("*"), F.sum(F.octet_length("host") + F.octet_length("path") + 16), F.array_join(F.array_sort(F.collect_set(F.length("path"))), ",")).first()
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    if not size[0]:
        return rows.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    hosts = listed.select("host").distinct()
    by_host, by_both = bloom(hosts, ["host"], hosts.count()), bloom(listed, ["host", "path"], size[0])
    lengths = F.split(F.lit(size[2]), ",").cast("array<int>")
    parts = F.split("host", r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "."))
    domains = F.filter(domains, lambda h: _may_be(by_host, [h]))
    cuts = F.transform(F.filter(lengths, lambda n: n <= F.length("path")), lambda n: F.col("path").substr(F.lit(1), n))
    keys = F.flatten(F.transform("domains", lambda h: F.transform("cuts", lambda p: F.struct(h.alias("h"), p.alias("p")))))
    hits = F.filter("keys", lambda k: _may_be(by_both, [k.h, k.p]))
    found = rows.withColumn("domains", domains).withColumn("cuts", F.when(F.size("domains") > 0, cuts).otherwise(F.array().cast("array<string>"))).withColumn("keys", keys)
    found = written(found.select("page_id", "host", "path", F.monotonically_increasing_id().alias("row"), hits.alias("hits")), "probed")
    small = F.broadcast if size[1] <= BROADCAST_BYTES else lambda x: x
    exact = small(listed.select(F.col("host").alias("h"), F.col("path").alias("p"), F.col("verdict").alias("v")))
    fit = F.struct((F.length("h") + F.length("p")).alias("n"), F.length("h").alias("m"), F.concat("h", "p").alias("rule"), F.col("v").alias("verdict"))
    some = found.where(F.size("hits") > 0).select("page_id", "host", "path", "row", F.explode("hits").alias("x")).select("page_id", "host", "path", "row", "x.h", "x.p")
    best = some.join(exact, ["h", "p"], "left").groupBy("row").agg(F.first("page_id").alias("page_id"), F.first("host").alias("host"), F.first("path").alias("path"), F.max(F.when(F.col("v").isNotNull(), fit)).alias("best"))
    judged = best.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
    others = found.where(F.size("hits") == 0).select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    return others.unionByName(judged)


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = F.array(*[F.struct(F.lit(h).alias("host"), F.lit(p).alias("path"), F.lit(v).alias("verdict")) for h, p, v in RULES])
    return judge_urls(table(spark, sf_dir, "pages"), spark.range(1).select(F.inline(rules)))


ORACLE = f"""
WITH cut AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host,
    regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM cut),
ruled AS (SELECT *, CASE
    WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/en/1') THEN 'example.org/en/1'
    WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/es/') THEN 'example.org/es/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/fr/') THEN 'com/fr/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/de/') THEN 'com/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/') THEN 'org/' END AS rule FROM parts)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('example.org/en/1', 'example.org/es/', 'com/de/') THEN 'block' ELSE 'allow' END AS verdict FROM ruled
"""
