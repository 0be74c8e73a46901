"""Approximate nearest neighbours: a neighbour graph by NN-descent, queries by greedy search of the graph."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import drop, kept, table, written

BASE = 50_000  # nodes for which these hold; effort() says how they follow the table's size:
NEIGHBOURS, SAMPLE, BEAM = 40, 16, 112  # links of a node; of them offered a round, by kind; nodes of a query's beam
TREES, LEAF = 4, 64  # of the first guess: random trees, vectors of a leaf
SETTLED = 0.02  # descent ends when no more than this share of all links is new
BACK = 24  # ways back to nodes that a node is a neighbour of
BUCKET, SEARCH_BUCKET = 4096, 16384  # nodes of a bucket, at most: of the descent, of searches
PART = 128  # queries of a part, where one row in 20 is one
EXPAND = 32  # nodes of a beam asked for in a hop
PAIRS = 1 << 19  # pairs held at once before the best of them are picked

GRAPH = "b int, node long, half binary, norm float, near array<long>, sim array<float>, fresh array<boolean>"  # links by falling similarity
COLUMNS = [c.split()[0] for c in GRAPH.split(", ")]
LINKS = "b int, node binary, near binary, sim binary"
LINKS_ARROW = pa.schema([("b", pa.int32()), ("node", pa.binary()), ("near", pa.binary()), ("sim", pa.binary())])


def clean_vectors(df: DataFrame) -> DataFrame:
    """vec_id, vec array<double>: vectors of the most frequent length without null or non-finite components, not all zero."""
    v = df.select("vec_id", F.col("embedding").cast("array<double>").alias("vec")).where("vec_id IS NOT NULL AND vec IS NOT NULL")
    bad = F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    v = v.where(~F.coalesce(bad, F.lit(True)) & F.exists("vec", lambda x: x != 0))
    size = v.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return v.where(F.size("vec") == (size["n"] if size else 0))


def distinct_vectors(v: DataFrame, most: int) -> DataFrame:
    """Equal vectors as one node: node (the least vec_id), vec, and ids, its ``most`` least vec_ids.

    More of them can't be among the nearest ``most`` of any query. Ids are ranked in salted parts first, so that a vector
    which a third of all rows hold is no single task's.
    """
    part = Window.partitionBy("vec", "salt").orderBy("vec_id")
    few = v.distinct().withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(64))).withColumn("k", F.row_number().over(part)).where(F.col("k") <= most)
    ranked = few.select("vec_id", "vec").withColumn("k", F.row_number().over(Window.partitionBy("vec").orderBy("vec_id"))).where(F.col("k") <= most)
    return ranked.groupBy("vec").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")).select(F.col("ids")[0].alias("node"), "vec", "ids")


def _mixed(*keys: np.ndarray | int) -> np.ndarray:
    """A hash of each row of ``keys``."""
    h = np.uint64(0)
    with np.errstate(over="ignore"):
        for k in keys:
            h = (h ^ np.asarray(k).astype("int64").view("uint64")) * np.uint64(0x9E3779B97F4A7C15)
            h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
            h = h ^ (h >> np.uint64(29))
    return h


def _dealt(node: np.ndarray, n: int) -> np.ndarray:
    """The bucket of each node, of ``n``."""
    return (_mixed(node) % np.uint64(n)).astype("int32")


def _buckets(count: int, most: int) -> int:
    """Buckets of ``count`` nodes: of ``most`` each, smaller where that leaves few tasks."""
    return max(1, -(-count // min(most, max(512, count // 24))))


def _packed(b: np.ndarray, **columns: np.ndarray) -> pa.RecordBatch:
    """One row for each bucket that occurs in ``b``, with its part of each column as bytes."""
    order = np.argsort(b, kind="stable")
    starts = np.flatnonzero(np.diff(b[order], prepend=-1))
    ends = np.append(starts[1:], len(b))
    out = {"b": pa.array(b[order][starts].astype("int32"), pa.int32())}
    for name, x in columns.items():
        x = x[order]
        out[name] = pa.array([x[i:j].tobytes() for i, j in zip(starts, ends)], pa.binary())
    return pa.RecordBatch.from_pydict(out)


def _unpacked(t: pa.Table, name: str, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(t.column(name).to_pylist()), kind)


def _lists(t: pa.Table, name: str) -> tuple[np.ndarray, np.ndarray]:
    """All values of a list column, and how many each row has."""
    x = t.column(name).combine_chunks()
    x = x if isinstance(x, pa.ListArray) else pa.concat_arrays(x.chunks)
    return x.flatten().to_numpy(zero_copy_only=False), np.diff(x.offsets.to_numpy())


def _array(values: np.ndarray, sizes: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype("int32")), pa.array(values, kind))


def _rank(group: np.ndarray) -> np.ndarray:
    """The place of each entry within its group, from 0; equal ones stand together."""
    starts = np.flatnonzero(np.append(True, group[1:] != group[:-1])) if len(group) else np.zeros(0, "int64")
    return np.arange(len(group)) - np.repeat(starts, np.diff(np.append(starts, len(group))))


def _best(row: np.ndarray, code: np.ndarray, sim: np.ndarray, old: np.ndarray | None, k: int) -> np.ndarray:
    """Places of the ``k`` nearest of each row, each once, in order; of equal ones that which was there before.

    Rows and codes of nodes are numbers under 2^31, so that two 64-bit keys say it all.
    """
    pair = (row.astype("int64") << 32) | code
    at = np.argsort(pair, kind="stable" if old is not None else None)
    at = at[np.append(True, pair[at][1:] != pair[at][:-1])] if len(at) else at  # what was there before comes first
    bits = np.ascontiguousarray(sim[at], "float32").view("int32").astype("int64")
    falling = np.where(bits < 0, bits & 0x7FFFFFFF, -bits) + (1 << 31)  # falls as the similarity rises
    at = at[np.argsort((row[at].astype("int64") << 33) | falling, kind="stable")]
    return at[_rank(row[at]) < k]


def _half(vec: np.ndarray) -> list[bytes]:
    return [x.tobytes() for x in vec.astype("<f2")]


def effort(count: int) -> tuple[int, int, int]:
    """Neighbours, offered links and beam for ``count`` nodes: the first two follow the logarithm, the beam the square root."""
    more = float(np.log2(max(count, 1) / BASE))
    return int(max(16, NEIGHBOURS + 4 * more)), int(max(8, SAMPLE + 2 * more)), int(max(40, BEAM * 2 ** (more / 2)))


def build_graph(nodes: DataFrame, count: int) -> DataFrame:
    """The neighbour graph of ``nodes`` (node, vec): kind, node, near array<long>, sim array<float>.

    Kind 0 are the nearest by angle. Where norms differ, kind 1 are those of the largest inner product besides: short
    vectors are then near each other but the answer of no query. descent() says how each is made.
    """
    length = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x))
    longest, shortest, dim = nodes.agg(F.max(length), F.min(length), F.max(F.size("vec"))).first()
    placed = place(nodes, count, float(longest or 1), int(dim or 1))
    kinds = [0] if float(shortest or 1) > 0.999 * float(longest or 1) else [0, 1]
    graphs = []
    for k in kinds:
        path = None
        for graph, at in descent(placed.withColumn("norm", F.lit(1.0).cast("float")) if k == 0 else placed, count):
            if path:
                drop(nodes.sparkSession, path)
            path = at
        graphs.append(graph.select(F.lit(k).alias("kind"), "node", "near", "sim"))
    return graphs[0] if len(graphs) == 1 else graphs[0].unionByName(graphs[1])


def place(nodes: DataFrame, count: int, longest: float, dim: int) -> DataFrame:
    """node, half (the unit vector in half precision), norm (its length over the longest), leaf (one of each random tree)."""
    depth = max(0, int(np.ceil(np.log2(max(1, count / LEAF)))))
    planes = np.random.default_rng(6).normal(size=(TREES, dim, max(depth, 1)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                x = np.stack(batch["vec"].to_list())
                norm = np.linalg.norm(x, axis=1)
                x = x / norm[:, None]
                leaf = [((x @ p > 0) @ (1 << np.arange(p.shape[1])) if depth else np.zeros(len(x), "int64")) + (t << 40) for t, p in enumerate(planes)]
                yield pd.DataFrame({"node": batch["node"], "half": _half(x), "norm": (norm / longest).astype("float32"), "leaf": list(np.stack(leaf, 1))})

    return written(nodes.select("node", "vec").mapInPandas(run, "node long, half binary, norm float, leaf array<long>"), "placed")


def descent(placed: DataFrame, count: int) -> Iterator[tuple[DataFrame, str]]:
    """The graph of unit vectors ``placed`` after the first guess and after each round of NN-descent, and where it is written.

    y is as near to x as their product times y's norm. The first guess, a poor one, is the best in small leaves of a few
    random trees (leaves of over twice LEAF vectors are split at random). Then, round by round, each node's neighbours and
    those it is a neighbour of, some of them and at least one of a pair new, are joined with their vectors and compared
    with each other: neighbours of neighbours. Only pairs that beat the worst neighbour so far go on. Rounds end when
    nearly no link is new.

    Nodes are dealt to buckets. What one bucket has for another goes as one row of packed arrays, and a vector goes once to
    a bucket, however many of its hubs have it as a member.
    """
    neighbours, sample, _ = effort(count)
    buckets = _buckets(count, BUCKET)
    leaves = placed.select("node", "half", "norm", F.explode("leaf").alias("leaf"))
    sizes = leaves.groupBy("leaf").agg(F.ceil(F.count("*") / F.lit(2 * LEAF)).alias("n")).where("n > 1")
    dealt = leaves.join(sizes, "leaf", "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64("node", "leaf"), F.col("n")), F.lit(0)))
    dealt = dealt.withColumn("b", F.pmod(F.xxhash64("leaf", "salt"), F.lit(buckets * TREES)))

    def guess(key: tuple, g: pa.Table) -> pa.Table:
        leaf, salt, ids, norm = (g.column(c).to_numpy() for c in ("leaf", "salt", "node", "norm"))
        order = np.lexsort((ids, salt, leaf))
        x = np.frombuffer(b"".join(g.column("half").to_pylist()), "<f2").reshape(len(ids), -1)[order].astype("float32")
        leaf, salt, ids, norm = leaf[order], salt[order], ids[order], norm[order]
        starts = np.flatnonzero(np.append(True, (leaf[1:] != leaf[:-1]) | (salt[1:] != salt[:-1])))
        out: list[tuple] = [(np.zeros(0, "int64"), np.zeros(0, "int64"), np.zeros(0, "float32"))]
        for a, z in zip(starts, np.append(starts[1:], len(ids))):
            k = min(neighbours, z - a - 1)
            if k:
                s = (x[a:z] @ x[a:z].T) * norm[a:z]
                np.fill_diagonal(s, -np.inf)
                at = np.argpartition(-s, k - 1, 1)[:, :k]
                out.append((np.repeat(ids[a:z], k), ids[a + at].ravel(), np.take_along_axis(s, at, 1).ravel()))
        return pa.Table.from_batches([_links(*map(np.concatenate, zip(*out)), buckets)], LINKS_ARROW)

    first = dealt.select("b", "leaf", "salt", "node", "half", "norm").groupBy("b").applyInArrow(guess, LINKS)
    start = placed.mapInArrow(lambda batches: (_empty(t, buckets) for t in batches), GRAPH)
    graph, path = kept(_merged(start, first, neighbours), "graph")
    yield graph, path
    seed = 0
    while _unsettled(graph):
        (graph, path), members = _descend(graph, buckets, neighbours, sample, seed)
        drop(placed.sparkSession, members)
        yield graph, path
        seed += 1


def _links(node: np.ndarray, near: np.ndarray, sim: np.ndarray, buckets: int) -> pa.RecordBatch:
    """Offered links, packed for the bucket of ``node``."""
    return _packed(_dealt(node, buckets), node=node, near=near, sim=sim.astype("float32"))


def _empty(t: pa.RecordBatch, buckets: int) -> pa.RecordBatch:
    """Nodes without neighbours so far."""
    none = np.zeros(t.num_rows, "int64")
    lists = [_array(np.zeros(0, k), none, x) for k, x in (("int64", pa.int64()), ("float32", pa.float32()), ("bool", pa.bool_()))]
    return pa.RecordBatch.from_arrays([pa.array(_dealt(t.column("node").to_numpy(), buckets)), t.column("node"), t.column("half"), t.column("norm"), *lists], names=COLUMNS)


def _merged(graph: DataFrame, links: DataFrame, neighbours: int) -> DataFrame:
    """``graph`` with the best of its links and those offered; what comes in is fresh."""

    def merge(key: tuple, old: pa.Table, new: pa.Table) -> pa.Table:
        ids = old.column("node").to_numpy()
        order = np.argsort(ids)
        old, ids = old.take(pa.array(order)), ids[order]
        (near, sizes), (sim, _) = _lists(old, "near"), _lists(old, "sim")
        row = np.concatenate([np.repeat(np.arange(len(ids)), sizes), np.searchsorted(ids, _unpacked(new, "node", "<i8"))])
        before = len(near)
        near, sim = np.concatenate([near, _unpacked(new, "near", "<i8")]), np.concatenate([sim, _unpacked(new, "sim", "<f4")])
        at = _best(row, np.unique(near, return_inverse=True)[1], sim, np.arange(len(row)) < before, neighbours)
        sizes = np.bincount(row[at], minlength=len(ids))
        lists = [_array(near[at], sizes, pa.int64()), _array(sim[at], sizes, pa.float32()), _array(at >= before, sizes, pa.bool_())]
        return pa.Table.from_arrays([*(old.column(c) for c in COLUMNS[:4]), *lists], names=COLUMNS)

    return graph.groupBy("b").cogroup(links.groupBy("b")).applyInArrow(merge, GRAPH)


def _unsettled(graph: DataFrame) -> bool:
    new, links = graph.agg(F.sum(F.size(F.filter("fresh", lambda x: x))), F.sum(F.size("fresh"))).first()
    return (new or 0) > SETTLED * (links or 0)


def _descend(graph: DataFrame, buckets: int, neighbours: int, sample: int, seed: int) -> tuple[tuple[DataFrame, str], str]:
    """One round: neighbours of neighbours; the graph and where it is, and where its members are.

    A node offers all its new links, which then are new no more, and some others.
    """

    def few(hub: np.ndarray, node: np.ndarray, fresh: np.ndarray) -> np.ndarray:
        """Places of ``sample`` links of each hub, new ones and others apart; a pure limit of a hash's rank."""
        order = np.lexsort((_mixed(node, hub, seed), fresh, hub))
        group = np.cumsum((np.diff(hub[order], prepend=0) != 0) | np.diff(fresh[order].astype("int8"), prepend=0).astype(bool))
        return order[_rank(group) < sample]

    def back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t = pa.Table.from_batches([batch])
            (hub, sizes), (fresh, _) = _lists(t, "near"), _lists(t, "fresh")
            node = np.repeat(t.column("node").to_numpy(), sizes)
            at = few(hub, node, fresh)
            yield _packed(_dealt(hub[at], buckets), hub=hub[at], node=node[at], fresh=fresh[at])

    def gather(key: tuple, g: pa.Table, more: pa.Table) -> pa.Table:
        (near, sizes), (fresh, _) = _lists(g, "near"), _lists(g, "fresh")
        hub = np.repeat(g.column("node").to_numpy(), sizes)
        olds = np.flatnonzero(~fresh)
        own = np.concatenate([np.flatnonzero(fresh), olds[few(hub[olds], near[olds], fresh[olds])]])
        hubs, nodes, news = (_unpacked(more, c, k) for c, k in (("hub", "<i8"), ("node", "<i8"), ("fresh", "?")))
        at = few(hubs, nodes, news)
        hub, node, fresh = np.concatenate([hub[own], hubs[at]]), np.concatenate([near[own], nodes[at]]), np.concatenate([fresh[own], news[at]])
        order = np.lexsort((~fresh, node, hub))
        hub, node, fresh = hub[order], node[order], fresh[order]
        once = np.append(True, (hub[1:] != hub[:-1]) | (node[1:] != node[:-1])) if len(hub) else np.zeros(0, bool)
        return pa.table({"b": pa.array([key[0].as_py()], pa.int32()), **{c: pa.array([x[once].tobytes()], pa.binary()) for c, x in (("hub", hub), ("node", node), ("fresh", fresh))}})

    packed = "b int, hub binary, node binary, fresh binary"
    links = graph.select("node", "near", "fresh").mapInArrow(back, packed)
    members, path = kept(graph.select("b", "node", "near", "fresh").groupBy("b").cogroup(links.groupBy("b")).applyInArrow(gather, packed), "members")

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b, nodes in zip(batch.column("b").to_pylist(), batch.column("node").to_pylist()):
                node = np.unique(np.frombuffer(nodes, "<i8"))
                rows = _packed(_dealt(node, buckets), node=node)
                yield rows.append_column("to", pa.array(np.full(rows.num_rows, b, "int32")))

    def answer(key: tuple, g: pa.Table, asked: pa.Table) -> pa.Table:
        ids = g.column("node").to_numpy()
        order = np.argsort(ids)
        half, norm = np.array(g.column("half").to_pylist(), object), g.column("norm").to_numpy()
        sim, sizes = _lists(g, "sim")
        ends = np.cumsum(sizes)
        worst = np.full(len(ids), -9.0, "float32")
        full = sizes >= neighbours
        worst[full] = sim[ends[full] - 1]  # links stand by falling similarity
        out = {c: [] for c in ("b", "node", "half", "norm", "worst")}
        for to, nodes in zip(asked.column("to").to_pylist(), asked.column("node").to_pylist()):
            at = order[np.searchsorted(ids, np.frombuffer(nodes, "<i8"), sorter=order)]
            for c, x in (("b", to), ("node", nodes), ("half", b"".join(half[at])), ("norm", norm[at].tobytes()), ("worst", worst[at].tobytes())):
                out[c].append(x)
        return pa.table({c: pa.array(x, pa.int32() if c == "b" else pa.binary()) for c, x in out.items()})

    wanted = members.select("b", "node").mapInArrow(ask, "b int, node binary, to int")
    known = graph.select("b", "node", "half", "norm", "sim").groupBy("b").cogroup(wanted.groupBy("b")).applyInArrow(answer, "b int, node binary, half binary, norm binary, worst binary")

    def local(key: tuple, m: pa.Table, v: pa.Table) -> pa.Table:
        hub, node, fresh = (_unpacked(m, c, k) for c, k in (("hub", "<i8"), ("node", "<i8"), ("fresh", "?")))
        ids, norms, worst = (_unpacked(v, c, k) for c, k in (("node", "<i8"), ("norm", "<f4"), ("worst", "<f4")))
        x = np.frombuffer(b"".join(v.column("half").to_pylist()), "<f2").reshape(len(ids), -1) if len(ids) else np.zeros((0, 1), "<f2")
        order = np.argsort(ids)  # answers come in any order
        ids, norms, worst, x = ids[order], norms[order], worst[order], x[order]
        place = np.searchsorted(ids, node)
        starts = np.flatnonzero(np.append(True, hub[1:] != hub[:-1])) if len(hub) else np.zeros(0, "int64")
        held: list[tuple] = []
        picked: list[tuple] = [(np.zeros(0, "int64"), np.zeros(0, "int64"), np.zeros(0, "float32"))]
        n = 0

        def pick() -> None:
            if held:
                a, b, s = (np.concatenate(c) for c in zip(*held))
                at = _best(a, b, s, None, neighbours)
                picked.append((a[at], b[at], s[at]))
                held.clear()

        for a, z in zip(starts, np.append(starts[1:], len(hub))):
            f = fresh[a:z]
            if not f.any():
                continue
            at = place[a:z]
            y = x[at].astype("float32")
            s = (y @ y.T) * norms[at]
            good = s > worst[at][:, None]
            good &= f[:, None] | f
            np.fill_diagonal(good, False)
            i, j = np.nonzero(good)
            held.append((at[i], at[j], s[i, j]))
            n += len(i)
            if n > PAIRS:
                pick()
                n = 0
        pick()
        a, b, s = (np.concatenate(c) for c in zip(*picked))
        at = _best(a, b, s, None, neighbours)
        return pa.Table.from_batches([_links(ids[a[at]], ids[b[at]], s[at], buckets)], LINKS_ARROW)

    found = members.groupBy("b").cogroup(known.groupBy("b")).applyInArrow(local, LINKS)
    return kept(_merged(graph, found, neighbours), "graph"), path


STATE = "p int, q long, qvec binary, beam array<long>, sim array<double>, done array<boolean>, worst double, visits long"  # beams by falling similarity
STATE_COLUMNS = [c.split()[0] for c in STATE.split(", ")]
ASKED, SCORED = "p int, q binary, n binary, node binary", "p int, q binary, n binary, good binary, got binary, sims binary"
ASKED_ARROW, SCORED_ARROW = (pa.schema([(c.split()[0], pa.int32() if c == "p int" else pa.binary()) for c in x.split(", ")]) for x in (ASKED, SCORED))


def _ways(nodes: DataFrame, graph: DataFrame, buckets: int) -> DataFrame:
    """b, node, vec binary, ways array<long>: the graph's links both ways, of all kinds, the BACK nearest of those back."""

    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t = pa.Table.from_batches([batch])
            (near, sizes), (sim, _) = _lists(t, "near"), _lists(t, "sim")
            node, kind = (np.repeat(t.column(c).to_numpy(), sizes) for c in ("node", "kind"))
            at = back(near, node, kind, sim)
            yield _packed(_dealt(node, buckets), node=node, x=near, kind=np.full(len(node), -1, "int32"), sim=sim)
            yield _packed(_dealt(near[at], buckets), node=near[at], x=node[at], kind=kind[at].astype("int32"), sim=sim[at])

    def back(node: np.ndarray, x: np.ndarray, kind: np.ndarray, sim: np.ndarray) -> np.ndarray:
        order = np.lexsort((x, -sim, kind, node))
        group = np.cumsum((np.diff(node[order], prepend=0) != 0) | (np.diff(kind[order], prepend=0) != 0))
        return order[_rank(group) < BACK]

    def place(key: tuple, v: pa.Table, links: pa.Table) -> pa.Table:
        ids, (vec, sizes) = v.column("node").to_numpy(), _lists(v, "vec")
        node, x, kind, sim = (_unpacked(links, c, k) for c, k in (("node", "<i8"), ("x", "<i8"), ("kind", "<i4"), ("sim", "<f4")))
        ahead, behind = np.flatnonzero(kind < 0), np.flatnonzero(kind >= 0)
        at = np.append(ahead, behind[back(node[behind], x[behind], kind[behind], sim[behind])])
        order = np.argsort(ids)
        row, x = order[np.searchsorted(ids, node[at], sorter=order)], x[at]
        at = np.lexsort((x, row))
        at = at[np.append(True, (row[at][1:] != row[at][:-1]) | (x[at][1:] != x[at][:-1]))] if len(at) else at
        vecs = [c.tobytes() for c in np.split(vec.astype("<f8"), np.cumsum(sizes)[:-1])] if len(ids) else []
        ways = _array(x[at], np.bincount(row[at], minlength=len(ids)), pa.int64())
        return pa.table({"b": pa.array(np.full(len(ids), key[0].as_py(), "int32")), "node": pa.array(ids), "vec": pa.array(vecs, pa.binary()), "ways": ways})

    links = graph.select("kind", "node", "near", "sim").mapInArrow(both, "b int, node binary, x binary, kind binary, sim binary")

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.append_column("b", pa.array(_dealt(batch.column("node").to_numpy(), buckets)))

    dealt = nodes.select("node", "vec").mapInArrow(deal, "node long, vec array<double>, b int")
    return written(dealt.groupBy("b").cogroup(links.groupBy("b")).applyInArrow(place, "b int, node long, vec binary, ways array<long>"), "ways")


def _runs(q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each run of equal ``q`` starts, and its length."""
    starts = np.flatnonzero(np.append(True, q[1:] != q[:-1])) if len(q) else np.zeros(0, "int64")
    return starts, np.diff(np.append(starts, len(q)))


def _pairs(q: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs in order, each once."""
    order = np.lexsort((node, q))
    q, node = q[order], node[order]
    once = np.append(True, (q[1:] != q[:-1]) | (node[1:] != node[:-1])) if len(q) else np.zeros(0, bool)
    return q[once], node[once]


def _for_beams(q: np.ndarray, node: np.ndarray, parts: int) -> Iterator[pa.RecordBatch]:
    """Nodes for queries (sorted by q), packed for the parts that hold their beams."""
    to = _dealt(q, parts)
    for p in np.unique(to):
        mine = to == p
        starts, n = _runs(q[mine])
        yield pa.RecordBatch.from_pydict({"p": pa.array([p], pa.int32()), **{c: pa.array([x.tobytes()], pa.binary()) for c, x in (("q", q[mine][starts]), ("n", n.astype("<i4")), ("node", node[mine]))}})


def search_graph(nodes: DataFrame, graph: DataFrame, queries: DataFrame, count: int, k: int, beam: int | None = None, expand: int = EXPAND) -> DataFrame:
    """Greedy search from each query (q, qvec, near array<long>: where to begin): q, beam array<long>, sim array<double>,
    visits (vectors compared; one that fell out of the beam and is met again in another hop counts again).

    A hop takes each query's ``expand`` best nodes whose neighbours it hasn't asked for, has the buckets of these name them
    (both ways, all kinds), and has the inner products found in the buckets that hold the vectors: a query's vector goes
    once to a bucket, with the list of nodes asked for, and those better than its beam's worst come back. The best ``beam``
    nodes are kept. Hops go on until all nodes of all beams were asked for. Beams are dealt to parts; between a part and a
    bucket all goes as one row of packed arrays.
    """
    buckets, beam = _buckets(count, SEARCH_BUCKET), max(beam or effort(count)[2], k + 1)
    parts = max(1, -(-count // (20 * PART)))
    spark = nodes.sparkSession
    placed = _ways(nodes, graph, buckets)

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            g = pa.Table.from_batches([batch])
            q, (vec, sizes), n = g.column("q").to_numpy(), _lists(g, "qvec"), g.num_rows
            vecs = [c.tobytes() for c in np.split(vec.astype("<f8"), np.cumsum(sizes)[:-1])] if n else []
            none = np.zeros(n, "int64")
            lists = [_array(np.zeros(0, x), none, t) for x, t in (("int64", pa.int64()), ("float64", pa.float64()), ("bool", pa.bool_()))]
            yield pa.RecordBatch.from_arrays([pa.array(_dealt(q, parts)), g.column("q").combine_chunks(), pa.array(vecs, pa.binary()), *lists, pa.array(np.full(n, -np.inf)), pa.array(none)], names=STATE_COLUMNS)

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            g = pa.Table.from_batches([batch])
            near, sizes = _lists(g, "near")
            yield from _for_beams(*_pairs(np.repeat(g.column("q").to_numpy(), sizes), near), parts)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            g = pa.Table.from_batches([batch])
            (node, sizes), (done, _) = _lists(g, "beam"), _lists(g, "done")
            row = np.repeat(np.arange(g.num_rows), sizes)[~done]
            next_ = _rank(row) < expand
            q, node = g.column("q").to_numpy()[row[next_]], node[~done][next_]
            yield _packed(_dealt(node, buckets), q=q, node=node)

    def name(key: tuple, v: pa.Table, asked: pa.Table) -> Iterator[pa.RecordBatch]:
        ids, (ways, sizes) = v.column("node").to_numpy(), _lists(v, "ways")
        q, node = _unpacked(asked, "q", "<i8"), _unpacked(asked, "node", "<i8")
        order, starts = np.argsort(ids), np.append(0, np.cumsum(sizes))
        at = order[np.searchsorted(ids, node, sorter=order)] if len(node) else np.zeros(0, "int64")
        n = sizes[at]
        flat = np.repeat(starts[at] - np.append(0, np.cumsum(n))[:-1], n) + np.arange(n.sum())
        return _for_beams(*_pairs(np.repeat(q, n), ways[flat]), parts)

    def ask(key: tuple, s: pa.Table, named: pa.Table) -> pa.Table:
        """What isn't in a query's beam goes to the bucket that holds it."""
        ids = s.column("q").to_numpy()
        order = np.argsort(ids)
        q, node = np.repeat(_unpacked(named, "q", "<i8"), _unpacked(named, "n", "<i4")), _unpacked(named, "node", "<i8")
        row, (held, sizes) = order[np.searchsorted(ids, q, sorter=order)] if len(q) else np.zeros(0, "int64"), _lists(s, "beam")
        row, node = np.append(np.repeat(np.arange(len(ids)), sizes), row), np.append(held, node)
        order = np.lexsort((node, row))  # what the beam holds comes first
        first = np.append(True, (row[order][1:] != row[order][:-1]) | (node[order][1:] != node[order][:-1])) if len(order) else np.zeros(0, bool)
        at = order[first]
        at = at[at >= len(held)]
        row, node = row[at], node[at]
        to, vecs, worst = _dealt(node, buckets), np.array(s.column("qvec").to_pylist(), object), s.column("worst").to_numpy()
        out = {c: [] for c in ("b", "q", "n", "node", "qvec", "worst")}
        for b in np.unique(to):
            mine = to == b
            starts, n = _runs(row[mine])
            rows = row[mine][starts]
            for c, x in (("b", b), ("q", ids[rows].tobytes()), ("n", n.astype("<i4").tobytes()), ("node", node[mine].tobytes()), ("qvec", b"".join(vecs[rows])), ("worst", worst[rows].tobytes())):
                out[c].append(x)
        return pa.table({c: pa.array(x, pa.int32() if c == "b" else pa.binary()) for c, x in out.items()})

    def score(key: tuple, v: pa.Table, asked: pa.Table) -> pa.Table:
        ids = v.column("node").to_numpy()
        order = np.argsort(ids)
        x = np.frombuffer(b"".join(v.column("vec").to_pylist()), "<f8").reshape(len(ids), -1) if len(ids) else np.zeros((0, 1))
        out: list[pa.RecordBatch] = []
        for r in asked.to_pylist():
            q, n, node, worst = (np.frombuffer(r[c], t) for c, t in (("q", "<i8"), ("n", "<i4"), ("node", "<i8"), ("worst", "<f8")))
            qvec = np.frombuffer(r["qvec"], "<f8").reshape(len(q), -1)
            at, of = order[np.searchsorted(ids, node, sorter=order)], np.repeat(np.arange(len(q)), n)
            s = np.concatenate([(x[at[a : a + 4096]] * qvec[of[a : a + 4096]]).sum(1) for a in range(0, len(at), 4096)])  # the same to the last bit in each hop
            good = s >= worst[of]
            # All of a row come from one part.
            out.append(pa.RecordBatch.from_pydict({"p": pa.array(_dealt(q[:1], parts)), **{c: pa.array([y.tobytes()], pa.binary()) for c, y in (("q", q), ("n", n), ("good", np.add.reduceat(good, np.append(0, np.cumsum(n))[:-1], dtype="<i4")), ("got", node[good]), ("sims", s[good]))}}))
        return pa.Table.from_batches(out, SCORED_ARROW)

    def step(key: tuple, s: pa.Table, r: pa.Table) -> pa.Table:
        ids = s.column("q").to_numpy()
        order = np.argsort(ids)
        q, n, good, got, sims = (_unpacked(r, c, t) for c, t in (("q", "<i8"), ("n", "<i4"), ("good", "<i4"), ("got", "<i8"), ("sims", "<f8")))
        row = order[np.searchsorted(ids, q, sorter=order)] if len(q) else np.zeros(0, "int64")
        visits = s.column("visits").to_numpy() + np.bincount(row, n, len(ids)).astype("int64")
        (held, sizes), (sim, _), (done, _) = (_lists(s, c) for c in ("beam", "sim", "done"))
        of = np.repeat(np.arange(len(ids)), sizes)
        asked = done.copy()
        asked[np.flatnonzero(~done)[_rank(of[~done]) < expand]] = True  # what was asked for with this hop
        row, node, val = np.append(of, np.repeat(row, good)), np.append(held, got), np.append(sim, sims)
        asked = np.append(asked, np.zeros(len(got), bool))
        at = np.lexsort((node, -val, row))
        at = at[_rank(row[at]) < beam]
        sizes = np.bincount(row[at], minlength=len(ids))
        last = np.cumsum(sizes) - 1
        worst = np.where(sizes == beam, val[at][last], -np.inf) if len(at) else np.full(len(ids), -np.inf)
        lists = [_array(node[at], sizes, pa.int64()), _array(val[at], sizes, pa.float64()), _array(asked[at], sizes, pa.bool_())]
        return pa.Table.from_arrays([s.column("p"), s.column("q"), s.column("qvec"), *lists, pa.array(worst), pa.array(visits)], names=STATE_COLUMNS)

    state, path = kept(queries.select("q", "qvec").mapInArrow(begin, STATE), "beams")
    named = queries.select("q", "near").mapInArrow(start, ASKED)
    while True:
        asked = state.select("p", "q", "qvec", "beam", "worst").groupBy("p").cogroup(named.groupBy("p")).applyInArrow(ask, "b int, q binary, n binary, node binary, qvec binary, worst binary")
        scored = placed.select("b", "node", "vec").groupBy("b").cogroup(asked.groupBy("b")).applyInArrow(score, SCORED)
        old, (state, path) = path, kept(state.groupBy("p").cogroup(scored.groupBy("p")).applyInArrow(step, STATE), "beams")
        drop(spark, old)
        if not state.agg(F.max(F.exists("done", lambda x: ~x))).first()[0]:
            return state.select("q", "beam", "sim", "visits")
        wanted = state.select("q", "beam", "done").mapInArrow(spread, "b int, q binary, node binary")
        named = placed.select("b", "node", "ways").groupBy("b").cogroup(wanted.groupBy("b")).applyInArrow(lambda key, v, w: pa.Table.from_batches(name(key, v, w), ASKED_ARROW), ASKED)


def nearest(df: DataFrame, k: int = 20, query_every: int = 20) -> DataFrame:
    """The ``k`` nearest by inner product of each query, a row whose vec_id is divisible by ``query_every``.

    Candidates are all rows but the query's own. Returns query_id, rank (from 1; ties to the smaller vec_id), vec_id,
    score (inner product of the original vectors in double precision). Vectors that are null, zero, of another length
    than most, or hold null or non-finite components take no part, nor do null ids; of rows repeated whole, one counts.
    Equal vectors are one node of the graph, searched for once. Other columns are left out.
    """
    v = written(clean_vectors(df), "vectors")
    nodes = written(distinct_vectors(v, k + 1), "nodes")
    count = nodes.count()
    graph = build_graph(nodes, count)
    asked = v.where(F.col("vec_id") % query_every == 0).join(nodes.select("node", "vec"), "vec").select(F.col("vec_id").alias("query_id"), "node").distinct()
    entry = F.concat(F.array("node"), F.coalesce("near", F.array().cast("array<long>")))
    own = graph.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))
    starts = asked.select("node").distinct().join(nodes.select("node", "vec"), "node").join(own, "node", "left")
    found = search_graph(nodes, graph, starts.select(F.col("node").alias("q"), F.col("vec").alias("qvec"), entry.alias("near")), count, k)

    @F.pandas_udf("double")
    def product(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series((np.stack(a.to_list()) * np.stack(b.to_list())).sum(1) if len(a) else [], dtype="float64")

    top = found.select("q", F.explode(F.slice("beam", 1, k + 1)).alias("node")).join(nodes, "node").withColumnRenamed("vec", "v")
    top = top.join(nodes.select(F.col("node").alias("q"), F.col("vec").alias("qvec")), "q").select("q", product("v", "qvec").alias("score"), F.explode("ids").alias("vec_id"))
    few = top.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "vec_id"))).where(F.col("r") <= k + 1)
    listed = few.groupBy("q").agg(F.collect_list(F.struct(F.col("r"), "vec_id", "score")).alias("found"))
    per_query = asked.join(listed, asked["node"] == listed["q"]).select("query_id", F.array_sort(F.filter("found", lambda x: x.vec_id != F.col("query_id"))).alias("found"))
    return per_query.select("query_id", F.posexplode(F.slice("found", 1, k)).alias("rank", "x")).select("query_id", (F.col("rank") + 1).alias("rank"), "x.vec_id", "x.score")


def op6_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))
