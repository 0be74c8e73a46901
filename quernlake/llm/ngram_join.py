"""N-gram Jaccard join with Bayesian pruning of candidate pairs."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b
from math import comb

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.components import components
from ._common import free_names, hot_join, store, table, texts, written
from ._words import Vocabulary, mix, runs

WORDS, PERCENT = 5, 80  # shingle length; pairs of at least this Jaccard similarity are links
BANDS, ROWS = 40, 6  # a pair at the threshold shares no band with probability (1 - 0.8^6)^40 < 6e-6
STEP, TOLERANCE = 24, 1e-9
BLOCK = 500_000  # shingles of a block of a large group

_rng = np.random.default_rng(20)
XOR = _rng.integers(0, 1 << 32, BANDS * ROWS, dtype="uint32")[:, None]
ODD = (_rng.integers(0, 1 << 32, BANDS * ROWS, dtype="uint32") | np.uint32(1))[:, None]
ROW_FACTOR = _rng.integers(0, 1 << 63, (BANDS, ROWS), dtype="uint64") * np.uint64(2) + np.uint64(1)


def shingles(words: list[bytes]) -> np.ndarray:
    """Sorted distinct hashes of the runs of five words; of texts with fewer words, of all of them."""
    mine = store("ngrams")
    if not mine:
        mine["words"] = Vocabulary()
    return np.unique(runs(mine["words"](words)[0], min(WORDS, len(words)))) if words else np.zeros(0, "uint64")


def signature(s: np.ndarray) -> np.ndarray:
    """MinHash values of a set that isn't empty."""
    low = (s >> np.uint64(32)).astype("uint32")
    out = np.full(BANDS * ROWS, 0xFFFFFFFF, "uint32")
    for k in range(0, len(low), 2048):
        np.minimum(out, ((low[None, k : k + 2048] ^ XOR) * ODD).min(1), out=out)
    return out


def least_matches(n: int, percent: int = PERCENT, tolerance: float = TOLERANCE) -> int:
    """Fewest equal values of ``n`` with which the posterior probability of reaching the threshold is ``tolerance``.

    With a uniform prior that posterior after m matches is P(Bin(n + 1, t) <= m).
    """
    t, total = percent / 100, 0.0
    for m in range(n + 1):
        total += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        if total >= tolerance:
            return m
    return n


LEAST = [(n, least_matches(n)) for n in range(STEP, BANDS * ROWS + 1, STEP)]


def word_sets(docs: list[list[bytes]]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For each text the numbers of its shingles, equal if and only if their words are, and the shingles' hashes.

    Where hashes agree the words are compared; a shingle whose words aren't those of the first one of its hash gets a
    number of its own.
    """
    sets = [shingles(w) for w in docs]  # hashes, for MinHash
    place: dict[bytes, int] = {}
    mine, hashes = store("ngrams")["words"], []
    rows = np.full((sum(max(1, len(w) - WORDS + 1) for w in docs), WORDS), -1, "int32")
    at = 0
    for words in docs:
        ids = np.fromiter((place.setdefault(w, len(place)) for w in words), "int32", len(words))
        n = min(WORDS, len(ids))
        m = len(ids) - n + 1
        for k in range(n):
            rows[at : at + m, k] = ids[k : k + m]
        hashes.append(runs(mine(words)[0], n))
        at += m
    values, first, number = np.unique(np.concatenate(hashes), return_index=True, return_inverse=True)
    other = np.flatnonzero((rows != rows[first[number]]).any(1))
    more: dict[bytes, int] = {}
    for k in other.tolist():
        number[k] = len(values) + more.setdefault(rows[k].tobytes(), len(more))
    ends = np.cumsum([len(h) for h in hashes])
    return [np.unique(number[e - len(h) : e]) for e, h in zip(ends, hashes)], sets


def linked_pairs(docs: list[list[bytes]], left: np.ndarray, right: np.ndarray | None = None, prune: bool = True) -> Iterator[tuple[int, np.ndarray]]:
    """For each place in ``left``, the places in ``right`` (or later in ``left``) whose sets reach the threshold.

    Lengths that can't reach it go first; MinHash values are then compared STEP by STEP and pairs dropped as soon as the
    posterior falls below TOLERANCE (unless ``prune`` is off); the rest is decided by the exact sizes of intersection and
    union of the sets of word runs.
    """
    rows, hashed = word_sets(docs)
    sizes = np.array([len(r) for r in rows])
    signs = np.stack([signature(s) for s in hashed]) if prune else None
    mark = np.zeros(max(int(r[-1]) for r in rows) + 1, bool)
    for at, i in enumerate(left):
        js = left[at + 1 :] if right is None else right
        js = js[(100 * np.minimum(sizes[js], sizes[i]) >= PERCENT * np.maximum(sizes[js], sizes[i]))]
        same = np.zeros(len(js), "int32")
        for n, least in LEAST if prune else ():
            if not len(js):
                break
            same += (signs[js, n - STEP : n] == signs[i, n - STEP : n]).sum(1, dtype="int32")
            keep = same >= least
            js, same = js[keep], same[keep]
        if len(js):
            mark[rows[i]] = True
            cuts = np.cumsum([0] + [sizes[j] for j in js[:-1]])
            both = np.add.reduceat(mark[np.concatenate([rows[j] for j in js])].astype("int64"), cuts)
            mark[rows[i]] = False
            js = js[100 * both >= PERCENT * (sizes[js] + sizes[i] - both)]
            if len(js):
                yield i, js


def _join_group(lead: int, i: int, j: int, g: pd.DataFrame, prune: bool = True) -> pd.DataFrame:
    """Links between the members of one lead (of its blocks i and j); each pair counts under the least lead it shares."""
    store("ngrams")
    g = g.drop_duplicates("node").sort_values("node", ignore_index=True)
    open_ = zstandard.ZstdDecompressor().decompress
    docs = [open_(x).split() for x in g["body"]]
    block, nodes, copies = g["block"].to_numpy(), g["node"].to_numpy(), g["copies"].to_numpy()
    leads = [set(x) for x in g["leads"]]
    parent = list(range(len(g)))

    def top(k: int) -> int:
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    n, n_texts = np.zeros(len(g), "int64"), np.zeros(len(g), "int64")
    left, right = np.flatnonzero(block == i), None if i == j else np.flatnonzero(block == j)
    for a, bs in linked_pairs(docs, left, right, prune) if len(g) > 1 and len(left) and (right is None or len(right)) else ():
        for b in bs.tolist():
            x, y = sorted((top(a), top(b)))
            parent[y] = x
            if min(leads[a] & leads[b]) == lead:
                n[a] += copies[b]
                n[b] += copies[a]
                n_texts[a] += 1
                n_texts[b] += 1
    roots = np.array([nodes[top(k)] for k in range(len(g))], "int64")
    out = pd.DataFrame({"node": nodes, "root": roots, "links": n, "text_links": n_texts})
    return out[(out["links"] > 0) | (out["node"] != out["root"])]


def _signed(exact: bool):
    """For batches of doc_id and text: number of shingles, digest of the words, keys by which pairs meet, compressed words."""

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        press = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            out = []
            for text in batch["text"]:
                words = text.encode("utf-8", "surrogatepass").split()
                s = shingles(words)
                if not words:
                    out.append((0, None, None, None))
                    continue
                body = b" ".join(words)
                if exact:  # a prefix of each set in a common order; two sets at the threshold share one of these
                    keys = s[: len(s) - -(-PERCENT * len(s) // 100) + 1]
                else:
                    with np.errstate(over="ignore"):
                        keys = mix((signature(s).reshape(BANDS, ROWS).astype("uint64") * ROW_FACTOR).sum(1, dtype="uint64") + np.arange(BANDS, dtype="uint64"))
                out.append((len(s), blake2b(body, digest_size=32).digest(), keys.astype("int64"), press(body)))
            frame = pd.DataFrame(out, columns=["n", "digest", "keys", "body"])
            yield frame.assign(doc_id=batch["doc_id"].astype("Int64").to_numpy(), rid=batch["rid"].to_numpy())[["rid", "doc_id", "n", "digest", "keys", "body"]]

    return sign


def jaccard_classes(docs: DataFrame, exact: bool = False) -> DataFrame:
    """Links all documents whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

    Returns a row for each row of ``docs``: doc_id; class_id, the least doc_id of its connected component; n_links, the
    number of other rows linked to it; n_text_links, that of different texts (sequences of words) linked to it. Words are
    [^\\x20\\x09-\\x0D]+, unchanged; texts of one to four words have one shingle, of all of them. Texts without words
    (null, empty) have no links and are a class each. Repeated rows and equal texts link like others. Null doc_id: a row
    like others; class_id is null where all of a class are. Other columns are left out.

    Rows with equal words (by a 256-bit BLAKE2b digest) are one node. Nodes that share a band of six MinHash values meet
    under the least node of that bucket, its lead; each member's words go once, compressed, to each of its leads (not once
    for every bucket), and there pairs are pruned and verified by their words in memory, emitting only sums and a spanning
    forest. Groups of over BLOCK shingles are cut into blocks and each pair of blocks is a task, so no group must fit into
    one. Bands miss a pair at the threshold with probability under 6e-6, pruning with 1e-9; with ``exact`` pairs meet by
    prefixes of their ordered sets instead and none is pruned, which finds every link, at a cost that grows with common
    shingles. Keys that over a thousandth of the rows share are broadcast, so no task gets them all.
    """
    return _classes(texts(docs).withColumn("rid", F.monotonically_increasing_id()), exact).drop("rid", "head")


def _classes(docs: DataFrame, exact: bool = False) -> DataFrame:
    """jaccard_classes() of doc_id, text and rid, a number of the row; also rid, and head: the rid of the class's first row,
    by doc_id (null last), then rid."""
    rows = written(docs.mapInPandas(_signed(exact), "rid long, doc_id long, n int, digest binary, keys array<long>, body binary"), "signed")
    some = rows.where("n > 0")
    total = some.count()
    sets = written(some.groupBy("digest").agg(F.min("rid").alias("node"), F.count("*").alias("copies")), "sets")
    of = written(hot_join(some.select("doc_id", "rid", "digest"), sets, ["digest"], "copies", total).select("doc_id", "rid", "node", "copies"), "nodes")
    heads = written(rows.select("rid", "n", "keys").join(of.where("rid = node").select("rid", "copies").hint("merge"), "rid").withColumnRenamed("rid", "node"), "heads")
    bands = heads.select("node", F.explode("keys").alias("key"))
    shared = bands.groupBy("key").agg(F.min("node").alias("lead"), F.max("node").alias("last"), F.count("*").alias("count")).where("lead < last")
    shared = written(shared.select("key", "lead", "count"), "shared")
    met = shared.agg(F.sum("count")).first()[0] or 0
    led = hot_join(bands, shared, ["key"], "count", met).groupBy("node").agg(F.array_sort(F.collect_set("lead")).alias("leads"))
    led = written(led.join(heads.select("node", "n", "copies"), "node"), "leads")
    places = led.select("node", "n", F.explode("leads").alias("lead"))
    loads = written(places.groupBy("lead").agg(F.ceil(F.sum("n") / F.lit(BLOCK)).cast("int").alias("blocks"), F.count("*").alias("count")), "loads")
    large = loads.where("blocks > 1").select("lead", "blocks", "count")
    cut_up = hot_join(places.select("node", "lead"), large, ["lead"], "count", large.agg(F.sum("count")).first()[0] or 0)
    cut_up = cut_up.groupBy("node").agg(F.map_from_entries(F.collect_list(F.struct("lead", "blocks"))).alias("cut_up"))
    dealt = led.select("node", "copies", "leads").join(cut_up, "node", "left")
    dealt = rows.select(F.col("rid").alias("node"), "body").hint("merge").join(dealt, "node")
    dealt = dealt.withColumn("lead", F.explode("leads")).withColumn("blocks", F.coalesce(F.try_element_at("cut_up", F.col("lead")), F.lit(1)))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))

    def join(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        return _join_group(int(key[0]), int(key[1]), int(key[2]), g, not exact)

    found = dealt.select("lead", "i", "j", "block", "node", "copies", "leads", "body").groupBy("lead", "i", "j").applyInPandas(join, "node long, root long, links long, text_links long")
    found = written(found, "found")
    sums = found.groupBy("node").agg(F.sum("links").alias("links"), F.sum("text_links").alias("text_links"))
    roots = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    per_node = of.where("rid = node").select("node", "copies").join(sums, "node", "left").join(roots, "node", "left")
    per_node = per_node.select("node", "copies", F.coalesce("root", "node").alias("root"), F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("text_links", F.lit(0)).alias("text_links"))
    full = written(hot_join(of.select("doc_id", "rid", "node"), written(per_node, "linked"), ["node"], "copies", total), "full")
    least = written(full.groupBy("root").agg(F.min("doc_id").alias("class_id"), F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid")).alias("head"), F.count("*").alias("count")), "classes")
    linked = hot_join(full, least, ["root"], "count", total)
    linked = linked.select("doc_id", "class_id", (F.col("copies") - 1 + F.col("links")).alias("n_links"), F.col("text_links").alias("n_text_links"), "rid", F.col("head.rid").alias("head"))
    alone = rows.where("n = 0").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(0).cast("long").alias("n_text_links"), "rid", F.col("rid").alias("head"))
    return linked.unionByName(alone)


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(table(spark, sf_dir, "documents"))


def keep_one(docs: DataFrame) -> DataFrame:
    """Of each class of jaccard_classes() the row with the least doc_id, all columns as they are.

    Of rows with equal doc_id the first as stored; rows without doc_id come after all others. Two different texts with the
    same doc_id are judged each by itself. Rows are first written to the shared folder, so that their numbers hold.
    """
    (number,) = free_names(docs, "number")
    placed = written(docs.withColumn(number, F.monotonically_increasing_id()), "placed")
    first = _classes(texts(placed, F.col(number).alias("rid"))).where("rid = head").select(F.col("rid").alias(number))
    return placed.join(first, number, "left_semi").select(*docs.columns)


#: Every pair that shares a shingle is compared; components by recursion.
ORACLE = """
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\\x20\\\x09-\\\x0D]+'), lambda x: x <> '') AS w FROM documents),
texts AS (SELECT w, min(rid) AS node, count(*) AS copies FROM d WHERE len(w) > 0 GROUP BY w),
shingles AS (SELECT DISTINCT node, unnest(CASE WHEN len(w) < 5 THEN [array_to_string(w, chr(32))] ELSE list_transform(range(1, len(w) - 3), lambda p: array_to_string(list_slice(w, p, p + 4), chr(32))) END) AS s FROM texts),
sizes AS (SELECT node, count(*) AS n FROM shingles GROUP BY node),
both_in AS (SELECT a.node AS a, b.node AS b, count(*) AS common FROM shingles a JOIN shingles b USING (s) WHERE a.node < b.node GROUP BY ALL),
links AS (SELECT a, b FROM both_in JOIN sizes x ON x.node = a JOIN sizes y ON y.node = b WHERE 100 * common >= 80 * (x.n + y.n - common)),
ways AS (SELECT a AS u, b AS v FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT node AS u, node AS v FROM texts UNION SELECT reach.u, ways.v FROM reach JOIN ways ON reach.v = ways.u),
roots AS (SELECT u AS node, min(v) AS root FROM reach GROUP BY u),
counted AS (SELECT u AS node, sum(copies) AS more, count(*) AS n_texts FROM ways JOIN texts ON v = node GROUP BY u),
full_ AS (SELECT d.doc_id, t.copies, root, coalesce(more, 0) AS more, coalesce(n_texts, 0) AS n_texts FROM d JOIN texts t USING (w) JOIN roots USING (node) LEFT JOIN counted USING (node)),
least AS (SELECT root, min(doc_id) AS class_id FROM full_ GROUP BY root)
SELECT doc_id, class_id, CAST(copies - 1 + more AS BIGINT) AS n_links, CAST(n_texts AS BIGINT) AS n_text_links FROM full_ JOIN least USING (root)
UNION ALL SELECT doc_id, doc_id, 0, 0 FROM d WHERE len(w) = 0
"""
