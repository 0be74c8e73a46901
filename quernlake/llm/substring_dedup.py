"""Substring deduplication over a log-structured index of fingerprints."""

from __future__ import annotations

import gc
import hashlib
import json
import uuid
from collections.abc import Iterator
from functools import reduce
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import drop, free_names, scratch, store, table
from ._words import mix, runs

WINDOW, GRAM = 13, 6  # words of a window; of the runs that windows are filed under
CHUNK_BYTES, BUCKET_BYTES = 4 << 20, 4 << 20  # text of a chunk of documents; text whose windows fill a range of hashes
HOT_WINDOWS = 1 << 20  # windows of a range before it is looked at as a hot one
RUNS = 4  # sorted runs of an index, beyond which they are compacted
SHARES = (0.25, 0.25, 0.5)  # of the rows: the batches in which deduplicate() adds a table

PROBE = 16  # of so many chunks, one is looked at to see which ranges are hot

#: Windows of a chunk or a run in a part of a range of hashes. For each stretch of one key and one least doc_id: the key (k),
#: how many windows (c), the doc_id (d); for each window its other hash (v). Kind 0 comes from a chunk, 1 is a reply to one
#: (bits in k), 2 belongs to a run of the index. Counts and doc_ids are compressed. A hot range has several parts.
BLOCK = "kind int, chunk long, bucket int, part int, k binary, c binary, v binary, d binary"
NAMES = [x.split()[0] for x in BLOCK.split(", ")]


class Layout:
    """``buckets`` ranges of keys, a power of two, and of hot ones in how many parts, another, the other hash splits them.

    All windows around one common run of words have one key, so a range alone could grow without bound.
    """

    def __init__(self, buckets: int = 1, hot: dict[int, int] | None = None):
        self.buckets, self.hot = buckets, hot or {}

    def __eq__(self, other) -> bool:
        return (self.buckets, self.hot) == (other.buckets, other.hot)

    def finer(self, buckets: int) -> Layout:
        """The same with more ranges, no fewer than before; parts of a hot range go on in each of its halves."""
        more = buckets // self.buckets
        return Layout(buckets, {b * more + k: n for b, n in self.hot.items() for k in range(more)})

    def cuts(self, key: np.ndarray, other: np.ndarray) -> Iterator[tuple[int, int, np.ndarray | slice]]:
        """Range, part, and which of the sorted windows lie there, in their order."""
        bucket = _bucket(key, self.buckets)
        turn = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(bucket) else bucket
        for a, z in zip(turn.tolist(), [*turn[1:].tolist(), len(bucket)]):
            b = int(bucket[a])
            parts = self.hot.get(b, 1)
            if parts == 1:
                yield b, 0, slice(a, z)
            else:
                of = _bucket(other[a:z], parts)
                for p in np.unique(of).tolist():
                    yield b, p, a + np.flatnonzero(of == p)


def _bucket(k: np.ndarray, n: int) -> np.ndarray:
    """Buckets are ranges of keys, so that sorted keys have sorted buckets; ``n`` is a power of two."""
    return (k >> np.uint64(65 - n.bit_length())).astype("int64") if n > 1 else np.zeros(len(k), "int64")


def _frame(rows) -> pd.DataFrame:
    return pd.DataFrame(list(rows), columns=NAMES)


class Windows:
    """Windows sorted by key: of each its key, other hash and least doc_id. One key files at most a few windows of a text."""

    def __init__(self, key: np.ndarray, other: np.ndarray, doc: np.ndarray):
        self.key, self.other, self.doc = key, other, doc

    @classmethod
    def read(cls, k: bytes, c: bytes, v: bytes, d: bytes) -> Windows:
        open_ = zstandard.ZstdDecompressor().decompress
        n = np.frombuffer(open_(c), "uint32")
        return cls(np.repeat(np.frombuffer(k, "uint64"), n), np.frombuffer(v, "uint64"), np.repeat(np.frombuffer(open_(d), "int64"), n))

    def blocks(self, kind: int, chunk: int, layout: Layout) -> Iterator[tuple]:
        press = zstandard.ZstdCompressor(level=1).compress
        for bucket, part, at in layout.cuts(self.key, self.other):
            key, doc = self.key[at], self.doc[at]
            head = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])))
            count = np.diff(np.append(head, len(key))).astype("uint32")
            yield kind, chunk, bucket, part, key[head].tobytes(), press(count.tobytes()), self.other[at].tobytes(), press(doc[head].tobytes())


def merge(parts: list[Windows]) -> tuple[Windows, np.ndarray]:
    """All windows of sorted parts in one, each once with its least doc_id; for each given window its place there.

    Keys that only one part has pass through; only where several have a key are its windows compared.
    """
    key, other, doc = (np.concatenate([getattr(p, x) for p in parts]) for x in ("key", "other", "doc"))
    order = np.argsort(key, kind="stable")  # a merge: numpy's stable sort takes sorted stretches as they are
    key, other, doc = key[order], other[order], doc[order]
    part = np.repeat(np.arange(len(parts), dtype="int32"), [len(p.key) for p in parts])[order]
    head = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, "int64")
    sizes = np.diff(np.append(head, len(key)))
    mixed = np.minimum.reduceat(part, head) != np.maximum.reduceat(part, head) if len(head) else np.zeros(0, bool)
    several = np.flatnonzero(np.repeat(mixed, sizes))
    by = several[np.lexsort((doc[several], other[several], key[several]))]
    place = np.arange(len(key))
    place[several] = by  # windows of one key stand by their other hash, then by doc_id
    key, other, doc, order = key[place], other[place], doc[place], order[place]
    first = np.append(True, (key[1:] != key[:-1]) | (other[1:] != other[:-1])) if len(key) else np.zeros(0, bool)
    where = np.empty(len(key), "int64")
    where[order] = np.cumsum(first) - 1
    return Windows(key[first], other[first], doc[first]), where


def hashes(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each word's bytes, from different families: XXH3 and BLAKE2b."""
    second = b"".join([blake2b(w, digest_size=8).digest() for w in words])
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), "uint64", len(words)), np.frombuffer(second, "uint64")


def least_grams(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the least of each window's six-word hashes stands; the hashes of all six-word runs."""
    g = mix(runs(h, GRAM))
    if len(h) < WINDOW:
        return np.zeros(0, "int64"), g
    view = np.lib.stride_tricks.sliding_window_view(g, WINDOW - GRAM + 1)
    return view.argmin(1) + np.arange(len(view)), g


class Chunk:
    """The windows of a chunk of documents (ids, and their texts as an Arrow array), the same whatever the order of its rows.

    A window is filed under the least hash of its six-word runs (XXH3 of the words), and told apart by a hash of all its
    words from another family (BLAKE2b of the words): 64 bits each, which are independent of each other.
    """

    def __init__(self, ids: list, texts: pa.Array):
        words = pc.ascii_split_whitespace(texts)
        ends, flat = words.offsets.to_numpy().astype("int64"), words.flatten()
        coded = pc.dictionary_encode(flat)
        codes, distinct = coded.indices.to_numpy(), coded.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist()
        ends = ends - ends[0]
        if b"" in distinct:  # before the first word and after the last
            full = codes != distinct.index(b"")
            ends = np.append(0, np.cumsum(full))[ends]
            codes = codes[full]
        self.lengths = np.diff(ends)
        first, second = (h[codes] for h in hashes(distinct))
        at, g = least_grams(first)
        row = np.repeat(np.arange(len(ids)), self.lengths)
        inside = row[: len(at)] == row[len(row) - len(at) :] if len(at) else np.zeros(0, bool)
        named = np.array([i is not None for i in ids], bool)
        if not named.all():
            inside &= named[row[: len(at)]]
        place = np.flatnonzero(inside)
        key, other = mix(g[at[place]]), mix(runs(second, WINDOW))[place]
        self.row = row[place]
        self.place = place - ends[:-1][self.row]
        self.doc = np.array([0 if i is None else i for i in ids], "int64")[self.row]
        # Windows of one place in a text that share their least run stand together; a key met once more is sorted out.
        turn = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (self.row[1:] != self.row[:-1]) | (self.place[1:] != self.place[:-1] + 1))) if len(key) else np.zeros(0, "int64")
        size = np.diff(np.append(turn, len(key)))
        by = np.argsort(key[turn], kind="stable")
        starts = np.repeat(turn[by] - np.append(0, np.cumsum(size[by])[:-1]), size[by]) if len(by) else np.zeros(0, "int64")
        order = starts + np.arange(len(key))
        k = key[turn[by]]
        again = np.append(False, k[1:] == k[:-1]) if len(k) else np.zeros(0, bool)
        again |= np.append(again[1:], False)
        several = np.flatnonzero(np.repeat(again, size[by]))
        mixed = order[several]
        order[several] = mixed[np.lexsort((self.doc[mixed], other[mixed], key[mixed]))]
        ks, vs = key[order], other[order]
        first = np.append(True, (ks[1:] != ks[:-1]) | (vs[1:] != vs[:-1])) if len(ks) else np.zeros(0, bool)
        self.entry = np.empty(len(key), "int64")
        self.entry[order] = np.cumsum(first) - 1
        self.windows = Windows(ks[first], vs[first], self.doc[order][first])

    def removed(self, layout: Layout, replies: list[dict]) -> list[np.ndarray]:
        """For each row which words go, by the replies of kind 1."""
        earlier = np.zeros(len(self.windows.key), bool)
        got = {(r["bucket"], r["part"]): r["k"] for r in replies}
        for bucket, part, at in layout.cuts(self.windows.key, self.windows.other):
            if bits := got.get((bucket, part)):
                n = len(earlier[at])
                earlier[at] = np.unpackbits(np.frombuffer(bits, "uint8"), count=n).astype(bool)
        goes = earlier[self.entry] | (self.doc > self.windows.doc[self.entry])
        out = [np.zeros(n, bool) for n in self.lengths]
        rows, places = self.row[goes], self.place[goes]
        ends = np.flatnonzero(np.append(rows[1:] != rows[:-1], True)) + 1 if len(rows) else []
        for a, z in zip([0, *ends[:-1]], ends):
            turn = np.zeros(len(out[rows[a]]) + 1, "int32")
            np.add.at(turn, places[a:z], 1)
            np.add.at(turn, places[a:z] + WINDOW, -1)
            out[rows[a]] = np.cumsum(turn)[:-1] > 0
        return out


def _match(key: tuple, g: pd.DataFrame, run: bool = True) -> pd.DataFrame:
    """Merges a part's windows of the index (kind 2) with those of a batch's chunks (kind 0).

    Replies to each chunk which of its windows have a smaller doc_id elsewhere; and, with ``run``, gives the batch's own
    sorted run: its windows, but those that the index has under a doc_id as small.
    """
    g = g.sort_values(["kind", "chunk"], kind="stable", ignore_index=True)
    parts = [Windows.read(*x) for x in zip(g["k"], g["c"], g["v"], g["d"])]
    whole, where = merge(parts)
    known = np.zeros(len(whole.key), bool)
    out, at = [], 0
    for kind, chunk, p in zip(g["kind"], g["chunk"], parts):
        mine = where[at : at + len(p.key)]
        at += len(p.key)
        if kind == 0:
            bits = p.doc > whole.doc[mine]
            if bits.any():
                out.append((1, chunk, *key, np.packbits(bits).tobytes(), None, None, None))
        else:
            known[mine[p.doc <= whole.doc[mine]]] = True
    if run and not known.all():
        fresh = Windows(whole.key[~known], whole.other[~known], whole.doc[~known])
        out += [(2, -1, *key, *x[4:]) for x in fresh.blocks(2, -1, Layout())]
    return _frame(out)


def _merge_runs(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
    whole, _ = merge([Windows.read(*x) for x in zip(g["k"], g["c"], g["v"], g["d"])])
    return _frame((2, -1, *key, *x[4:]) for x in whole.blocks(2, -1, Layout()))


def _together(parts: list[DataFrame], f) -> DataFrame:
    """f(key, rows) of the blocks of each part of a range. Two tables that lie by ranges are read side by side, not shuffled."""
    by = [p.groupBy("bucket", "part") for p in parts]
    if len(by) == 2:
        return by[0].cogroup(by[1]).applyInPandas(lambda key, a, b: f(key, pd.concat([a, b], ignore_index=True)), BLOCK)
    return reduce(DataFrame.unionByName, parts).groupBy("bucket", "part").applyInPandas(f, BLOCK)


#: A chunk of documents: a compressed Arrow stream of their rows, and the bytes of their texts.
CHUNK = "batch int, chunk long, bytes long, body binary"


def _chunks(docs: DataFrame, batch: str) -> DataFrame:
    """``docs`` in chunks of about CHUNK_BYTES of text, each of one batch; made in one pass, with no shuffle."""
    most = CHUNK_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        size: dict[int, int] = {}
        number = TaskContext.get().partitionId() << 32
        options = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=3))

        def put(k: int) -> pa.RecordBatch:
            nonlocal number
            rows = pa.Table.from_batches(held.pop(k)).combine_chunks()
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, rows.schema, options=options) as out:
                out.write_table(rows)
            number += 1
            return pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([number]), pa.array([size.pop(k)]), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["batch", "chunk", "bytes", "body"])

        for rows in batches:
            of = rows.column(batch).to_numpy()
            for k in np.unique(of).tolist():
                mine = rows.filter(pa.array(of == k))
                ends = np.cumsum(pc.fill_null(pc.binary_length(mine.column("text")), 0).to_numpy(zero_copy_only=False), dtype="int64")
                at = 0
                while at < len(ends):
                    before = int(ends[at - 1]) if at else 0
                    to = min(len(ends), int(np.searchsorted(ends, before + most - size.get(k, 0), "left")) + 1)
                    held.setdefault(k, []).append(mine.slice(at, to - at))
                    size[k] = size.get(k, 0) + int(ends[to - 1]) - before
                    at = to
                    if size[k] >= most:
                        yield put(k)
        for k in sorted(held):
            yield put(k)

    return docs.mapInArrow(run, CHUNK)


def _opened(body: bytes) -> tuple[pa.Table, Chunk, list[bytes]]:
    """The rows of a chunk, its windows and its texts; what other operators left in this worker goes, and unused memory."""
    store("substrings")
    pa.default_memory_pool().release_unused()
    rows = pa.ipc.open_stream(body).read_all()
    texts = pc.fill_null(rows.column("text").combine_chunks(), "")
    return rows, Chunk(rows.column("doc_id").to_pylist(), texts), texts.cast(pa.binary()).to_pylist()


def _let_go(spark: SparkSession) -> None:
    """Has the driver notice that the shuffles of what is written aren't needed any more, so that their files go."""
    gc.collect()
    spark._jvm.System.gc()


def _write(blocks: DataFrame, path: str, files: int) -> str:
    """Blocks as a table below ``path``, by kind and in ``files`` files by ranges; its name in the session's catalog.

    Blocks are large cells of random bytes: no dictionary, and pages and row groups end by size after each row.
    """
    options = {"parquet.enable.dictionary": "false", "parquet.block.size": 16 << 20, "parquet.page.size.row.check.min": 1, "parquet.block.size.row.check.min": 1}
    name = f"run_{uuid.uuid4().hex}"
    blocks.write.options(**options).option("path", path).partitionBy("kind").bucketBy(files, "bucket", "part").saveAsTable(name)
    return name


class FingerprintIndex:
    """A log-structured index in the folder ``path``: a sorted, immutable run of window hashes for each batch added.

    add() gives each document of a batch without the words that windows cover which start in a document with a smaller
    doc_id, of the batch or of an earlier one. A run holds, for each range of keys, the batch's distinct windows of 13
    words, sorted, each with its least doc_id, and nothing that the index had before; so a later batch needs neither the
    earlier texts nor to be told of them. The sorted runs of a range are merged with the sorted windows of the batch's
    chunks; a window is filed under the least hash of its six-word runs, and windows of one key are told apart by 64 bits
    more, a hash of all their words from another family. compact() merges runs into one. Ranges are split as the index
    grows, and hot ones into parts by that other hash; a run's blocks are cut at the new bounds as they are read. Which
    ranges are hot, the windows of some chunks say; it decides nothing but who compares.

    A chunk sends a window once, however many of its documents hold it, so a passage in a third of all documents weighs as
    many entries as there are chunks. Judging is by doc_id, and a document is judged when it is added, so batches should
    come in the order of doc_id.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.bytes, self.batches, self.parts, self.layout = 0, 0, [], Layout()  # text added; batches; [folder, ranges, hot, table] of each run
        self.files = int(spark.conf.get("spark.sql.shuffle.partitions"))  # of a run, so that another table is dealt to meet it

    def _ranges(self) -> int:
        return 1 << max(0, (-(-self.bytes // BUCKET_BYTES) - 1).bit_length())

    def add(self, docs: DataFrame, digest: bool = False) -> DataFrame:
        """All columns of ``docs``, and n_words, n_removed, and kept: the text without its removed words.

        A text that loses nothing stays as it is in ``kept``; else its kept words are joined by one space. With
        ``digest`` instead: doc_id, n_words, n_removed, kept_sha256 of the kept words joined by one space. Null and empty
        texts have no words; null doc_id: the row neither loses words nor takes them from others. Rows of equal doc_id
        don't take words from each other. Other columns come back as they are, but those named like added ones are
        replaced.
        """
        (batch,) = free_names(docs, "batch")
        rows = (docs.select("doc_id", "text") if digest else docs).withColumn(batch, F.lit(0))
        return self.add_chunks(written_chunks(rows, batch), rows.drop(batch), digest)

    def add_chunks(self, chunks: DataFrame, docs: DataFrame, digest: bool = False, last: bool = False) -> DataFrame:
        """add() for what _chunks() made of ``docs``, whose columns alone are looked at; after the ``last`` batch no run is
        written, and those there are go."""
        spark, own = self.spark, ["n_words", "n_removed", "kept_sha256" if digest else "kept"]
        rest = ["doc_id"] if digest else [c for c in docs.columns if c.lower() not in own]
        part = f"{self.path}/run-{self.batches}"
        added = chunks.agg(F.sum("bytes")).first()[0] or 0
        self.bytes, self.batches = self.bytes + added, self.batches + 1
        if self._ranges() > self.layout.buckets or not self.parts and not self.layout.hot:
            self.layout = self.looked_at(chunks, self.layout.finer(max(self._ranges(), self.layout.buckets)))
        layout = self.layout

        def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for g in batches:
                for chunk, body in zip(g["chunk"], g["body"]):
                    yield _frame(_opened(body)[1].windows.blocks(0, chunk, layout))

        sent = chunks.select("chunk", "body").mapInPandas(send, BLOCK)
        name = _write(_together([sent, *self.runs()], lambda key, g: _match(key, g, not last)), part, self.files)
        _let_go(spark)
        self.parts.append([part, layout.buckets, layout.hot, name])
        if last:
            self._forget()
        replies = spark.read.schema(BLOCK).parquet(part).where("kind = 1").select("chunk", "bucket", "part", "k")
        fields = [f for f in docs.schema.fields if f.name in rest]
        out = T.StructType([*fields, T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField(own[2], T.StringType())])

        def finish(g: pa.Table, r: pa.Table) -> pa.Table:
            found = [_finished(*_opened(body), layout, r.to_pylist(), rest, digest) for body in g.column("body").to_pylist()]
            return pa.concat_tables(found) if found else _finished(pa.table({c: pa.nulls(0) for c in rest} | {"text": pa.nulls(0)}), None, [], layout, [], rest, digest)

        return chunks.select("chunk", "body").groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(finish, out)

    def looked_at(self, chunks: DataFrame, layout: Layout) -> Layout:
        """``layout`` with parts for ranges that some of the chunks show to be far larger than the rest."""
        ask, old = F.pmod(F.xxhash64("chunk"), F.lit(PROBE)) == 0, Layout(layout.buckets)

        def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for g in batches:
                for body in g["body"]:
                    sizes = [(b, len(w.key[at])) for w in [_opened(body)[1].windows] for b, _, at in old.cuts(w.key, w.other)]
                    yield pd.DataFrame(sizes, columns=["bucket", "n"])

        looked, total = chunks.agg(F.sum(ask.cast("long")), F.count("*")).first()
        if layout.buckets == 1 or not looked:
            return layout
        sizes = chunks.where(ask).select("body").mapInPandas(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
        usual = sizes.agg(F.sum("n")).first()[0] or 0
        most = max(4 * usual / layout.buckets, HOT_WINDOWS * looked / total)  # such a range has four times the usual windows, and many
        hot = {r["bucket"]: 1 << int(np.ceil(np.log2(r["n"] / most))) + 1 for r in sizes.where(F.col("n") > most).collect()}
        return Layout(layout.buckets, layout.hot | {b: max(n, layout.hot.get(b, 1)) for b, n in hot.items()})

    def runs(self) -> list[DataFrame]:
        """All runs, cut at the bounds of the layout, whose ranges are no fewer than any run's."""
        layout = self.layout

        def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for x in zip(batch["k"], batch["c"], batch["v"], batch["d"]):
                    yield _frame(Windows.read(*x).blocks(2, -1, layout))

        found = []
        for part, buckets, hot, name in self.parts:
            known = self.spark.catalog.tableExists(name)  # else another session's; its files are read as they are
            run = (self.spark.table(name) if known else self.spark.read.schema(BLOCK).parquet(part)).where("kind = 2").select(*NAMES)
            found.append(run if Layout(buckets, hot) == layout else run.mapInPandas(split, BLOCK))
        return found

    def compact(self, most: int = RUNS) -> None:
        """Merges all runs into one if there are more than ``most``; merged runs are removed."""
        if len(self.parts) > most:
            part = f"{self.path}/merged-{self.batches}"
            name = _write(_together(self.runs(), _merge_runs), part, self.files)
            self._forget()
            self.parts = [[part, self.layout.buckets, self.layout.hot, name]]

    def _forget(self) -> None:
        """Removes all runs; replies of kind 1 are for results not yet read."""
        for part, _, _, name in self.parts:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            drop(self.spark, f"{part}/kind=2")
        self.parts = []
        _let_go(self.spark)

    def state(self) -> str:
        parts = [[p, n, list(hot.items()), name] for p, n, hot, name in self.parts]
        return json.dumps({"bytes": self.bytes, "files": self.files, "batches": self.batches, "parts": parts, "layout": [self.layout.buckets, list(self.layout.hot.items())]})

    @classmethod
    def load(cls, spark: SparkSession, path: str, state: str) -> FingerprintIndex:
        index, was = cls(spark, path), json.loads(state)
        index.bytes, index.batches, index.files = was["bytes"], was["batches"], was["files"]
        index.parts = [[p, n, dict(map(tuple, hot)), name] for p, n, hot, name in was["parts"]]
        index.layout = Layout(was["layout"][0], dict(map(tuple, was["layout"][1])))
        return index


def _finished(rows: pa.Table, chunk: Chunk | None, docs: list[bytes], layout: Layout, replies: list[dict], rest: list[str], digest: bool) -> pa.Table:
    """The columns ``rest`` of a chunk's rows, n_words, n_removed, and what is kept of each text or its digest."""
    gone, texts, kept_ = chunk.removed(layout, replies) if chunk else [], rows.column("text"), []
    for k, (d, x) in enumerate(zip(docs, gone)):
        if x.any():
            left = b" ".join([w for w, y in zip(d.split(), x.tolist()) if not y])
        elif digest:
            left = b" ".join(d.split())
        kept_.append(hashlib.sha256(left).hexdigest() if digest else left.decode("utf-8", "surrogatepass") if x.any() else texts[k].as_py())
    out = {"n_words": pa.array([len(x) for x in gone], pa.int64()), "n_removed": pa.array([int(x.sum()) for x in gone], pa.int64()), "kept": pa.array(kept_, pa.string())}
    return pa.table([rows.column(c) for c in rest] + list(out.values()), names=[*rest, "n_words", "n_removed", "kept_sha256" if digest else "kept"])


def written_chunks(docs: DataFrame, batch: str) -> DataFrame:
    """_chunks() kept in the shared folder, by batch."""
    path = scratch(docs.sparkSession, "chunks")
    options = {"parquet.enable.dictionary": "false", "parquet.page.size.row.check.min": 1, "parquet.block.size.row.check.min": 1, "parquet.block.size": 16 << 20}
    _chunks(docs, batch).write.options(**options).partitionBy("batch").parquet(path)
    return docs.sparkSession.read.schema(CHUNK).parquet(path)


def batch_of(docs: DataFrame, shares: tuple[float, ...]) -> Column:
    """The number of a row's batch by rising doc_id, of about these shares of rows; equal doc_id together, null in the first."""
    cuts = [sum(shares[: k + 1]) for k in range(len(shares) - 1)]
    found = docs.agg(F.percentile_approx("doc_id", cuts, 10_000)).first()[0] or [] if cuts else []
    return F.coalesce(sum([(F.col("doc_id") > c).cast("int") for c in found], F.lit(0)), F.lit(0))


def deduplicate(docs: DataFrame, digest: bool = False, shares: tuple[float, ...] = SHARES) -> DataFrame:
    """``docs`` added to a new index in batches by rising doc_id, compacted after each but the last; as add().

    Documents are read once, and written in chunks by batch; ranges are laid out for all batches at once, so that a run
    stays as it lies until it is merged.
    """
    spark = docs.sparkSession
    (batch,) = free_names(docs, "batch")
    docs = docs.select("doc_id", "text") if digest else docs
    chunks = written_chunks(docs.withColumn(batch, batch_of(docs, shares)), batch)
    index, found = FingerprintIndex(spark, scratch(spark, "fingerprints")), None
    index.bytes = chunks.agg(F.sum("bytes")).first()[0] or 0
    index.layout, index.bytes = index.looked_at(chunks, Layout(index._ranges())), 0
    for k in range(len(shares)):
        part = index.add_chunks(chunks.where(F.col("batch") == k), docs, digest, last=k == len(shares) - 1)
        found = part if found is None else found.unionByName(part)
        if k < len(shares) - 1:
            index.compact(1)
    return found


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicate(table(spark, sf_dir, "documents"), digest=True)


ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
windows AS (SELECT rid, doc_id, p, array_to_string(list_slice(w, p, p + {WINDOW - 1}), ' ') AS k
    FROM (SELECT rid, doc_id, w, unnest(range(1, len(w) - {WINDOW - 2})) AS p FROM d WHERE doc_id IS NOT NULL AND len(w) >= {WINDOW})),
first AS (SELECT k, min(doc_id) AS least FROM windows GROUP BY k),
gone AS (SELECT DISTINCT rid, unnest(range(p, p + {WINDOW})) AS spot FROM windows JOIN first USING (k) WHERE least < doc_id),
words AS (SELECT rid, unnest(range(1, len(w) + 1)) AS spot, unnest(w) AS word FROM d),
kept AS (SELECT rid, count(*) AS n, string_agg(word, ' ' ORDER BY spot) AS left_over FROM words ANTI JOIN gone USING (rid, spot) GROUP BY rid)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(left_over, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (rid)
"""
