"""Token ids in binary files: one array of ids, and Elias-Fano encoded bounds and ids of its documents."""

from __future__ import annotations

import os
import re
import struct
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import Memo, drop, kept, scratch, store, table, texts

RANGE_ROWS = 4096  # documents of a range of doc_id, which one task sorts and writes
MOST_RANGES = 10_000  # ranges at most; beyond, a task writes more files
SLICE = 3000  # documents whose words are looked up at once
AT_ONCE = 4096  # units that the library encodes at once
FILE_TOKENS, FILE_DOCS = 1 << 22, 1 << 18  # a file ends once it holds so many
SAMPLE = 512  # every so many ones' places are kept for select
MAGIC = b"QTOKENS1"
HEAD = struct.Struct("<8sBBHIQQQqQ")  # magic, bytes of an id, 0, 0, range, start within the range, documents, of them without id, least doc_id, ids
SPAN = struct.Struct("<QQBQQ")  # numbers, their bound, low bits, bytes of the high part, bytes of the samples
BLANK = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"  # what the tokenizer's \s matches
TAIL = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~'"


class EliasFano:
    """Numbers that never fall, in about 2 + log2(bound / count) bits each.

    The low bits of each number are packed; the high ones are counted out in a row of bits, a one for each number after
    as many zeros as its high part. select() finds the place of the k-th one from samples of every 512th, 32 bits each.
    """

    def __init__(self, raw: memoryview):
        self.n, self.bound, self.low, high, samples = SPAN.unpack_from(raw)
        at = SPAN.size
        self.highs, at = raw[at : at + high], at + high
        self.samples, at = np.frombuffer(raw[at : at + samples], "<u4"), at + samples
        self.size = at + (self.n * self.low + 7) // 8
        self.lows = raw[at : self.size]

    @staticmethod
    def pack(numbers: np.ndarray, bound: int) -> bytes:
        """``numbers`` (uint64, none over ``bound``, never falling) in the form that the constructor reads."""
        n = len(numbers)
        low = max(0, (bound // n).bit_length() - 1) if n else 0
        places = (numbers >> np.uint64(low)).astype("int64") + np.arange(n)
        bits = np.zeros(int(places[-1]) + 1 if n else 0, "uint8")
        bits[places] = 1
        high, samples = np.packbits(bits, bitorder="little").tobytes(), places[::SAMPLE].astype("<u4").tobytes()
        rest = ((numbers[:, None] >> np.arange(low, dtype="uint64")) & np.uint64(1)).astype("uint8")
        return SPAN.pack(n, bound, low, len(high), len(samples)) + high + samples + np.packbits(rest, bitorder="little").tobytes()

    def select(self, k: int) -> int:
        """The place of the ``k``-th one, from 0, among the high bits."""
        at = int(self.samples[k // SAMPLE])
        want, byte = k % SAMPLE + int.from_bytes(self.highs[at >> 3 : (at >> 3) + 1]).__and__((1 << (at & 7)) - 1).bit_count(), at >> 3
        while True:  # a stretch of bytes, by its count of ones
            part = np.unpackbits(np.frombuffer(self.highs[byte : byte + 256], "uint8"), bitorder="little")
            ones = np.flatnonzero(part)
            if want < len(ones):
                return 8 * byte + int(ones[want])
            want, byte = want - len(ones), byte + 256

    def __getitem__(self, k: int) -> int:
        at = k * self.low
        low = int.from_bytes(self.lows[at >> 3 : (at + self.low + 7) >> 3], "little") >> (at & 7) & ((1 << self.low) - 1)
        return (self.select(k) - k) << self.low | low

    def __len__(self) -> int:
        return self.n

    def all(self) -> np.ndarray:
        """All numbers at once."""
        places = np.flatnonzero(np.unpackbits(np.frombuffer(self.highs, "uint8"), bitorder="little"))
        low = np.zeros(self.n, "uint64")
        bits = np.unpackbits(np.frombuffer(self.lows, "uint8"), bitorder="little")[: self.n * self.low].reshape(self.n, self.low)
        for k in range(self.low):
            low |= bits[:, k].astype("uint64") << np.uint64(k)
        return (places - np.arange(self.n)).astype("uint64") << np.uint64(self.low) | low


class TokenFile:
    """A file of documents by rising doc_id (those without one last): ``ids`` of all, ``bounds``, ``doc_ids``.

    Laid out as a header, the doc_ids less the least, the documents' starts within the file and its end, both Elias-Fano
    encoded, and the ids as little-endian unsigned numbers of 2 or 4 bytes. Nothing but what is asked for is decoded.
    """

    def __init__(self, raw: bytes | memoryview):
        raw = memoryview(raw)
        magic, width, _, _, self.range, self.start, self.docs, self.nameless, self.least, self.tokens = HEAD.unpack_from(raw)
        if magic != MAGIC:
            raise ValueError("not a file of token ids")
        self.names = EliasFano(raw[HEAD.size :])
        self.bounds = EliasFano(raw[HEAD.size + self.names.size :])
        at = HEAD.size + self.names.size + self.bounds.size
        self.ids = np.frombuffer(raw[at : at + width * self.tokens], f"<u{width}")

    @staticmethod
    def pack(doc_ids: list[int | None], bodies: list[bytes], width: int, of_range: int, start: int) -> bytes:
        """``doc_ids`` never fall and have their nulls last; ``bodies`` hold ids of ``width`` bytes."""
        named = [d for d in doc_ids if d is not None]
        least = named[0] if named else 0
        names = np.array([d - least for d in named], "uint64")
        ends = np.cumsum([0, *map(len, bodies)], dtype="uint64") // np.uint64(width)
        head = HEAD.pack(MAGIC, width, 0, 0, of_range, start, len(bodies), len(bodies) - len(named), least, int(ends[-1]))
        return b"".join([head, EliasFano.pack(names, int(names[-1]) if named else 0), EliasFano.pack(ends, int(ends[-1])), *bodies])

    def doc_id(self, k: int) -> int | None:
        return self.least + self.names[k] if k < len(self.names) else None

    def document(self, k: int) -> np.ndarray:
        """The ids of the ``k``-th document, from 0, by two selects."""
        return self.ids[self.bounds[k] : self.bounds[k + 1]]

    def find(self, doc_id: int) -> int | None:
        """The place of the first document of this id, by bisection."""
        a, z = 0, len(self.names)
        while a < z:
            mid = (a + z) // 2
            a, z = (mid + 1, z) if self.least + self.names[mid] < doc_id else (a, mid)
        return a if a < len(self.names) and self.least + self.names[a] == doc_id else None


class ByteTokens:
    """Ids of the tokenizers library for texts, little-endian, of ``width`` bytes each; for byte-level vocabularies.

    Such a tokenizer never joins what stands before white space with what follows, and never a letter with ASCII
    punctuation after it. So texts are cut before white space and words before their closing punctuation, and each part is
    encoded by the library once and remembered. A text that holds an added token is handed over whole.
    """

    def __init__(self, path: str, memo: int = 400_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.width = 2 if self.lib.get_vocab_size() <= 1 << 16 else 4
        added = [re.escape(t.content) for t in self.lib.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(added))
        self.part = re.compile(f"[{BLANK}]*[^{BLANK}]+|[{BLANK}]+")
        (self.line,) = self._bytes(["\n"])
        self.units = Memo(self._encode, memo)

    def _bytes(self, units: list[str]) -> list[bytes]:
        return [np.array(e.ids, f"<u{self.width}").tobytes() for e in self.lib.encode_batch_fast(units, add_special_tokens=False)]

    def _encode(self, units: list[str]) -> list[bytes]:
        """Units without white space but for a first blank go in one text, a line end between, whose id stands alone."""
        plain = [u for u in units if u.split() == [u.removeprefix(" ")]]
        found = {}
        for k in range(0, len(plain), AT_ONCE):  # the library's encodings take far more memory than the ids
            part = plain[k : k + AT_ONCE]
            (raw,) = self._bytes(["\n".join(part)])
            ends, at = [*(self.width * np.flatnonzero(np.frombuffer(raw, f"<u{self.width}") == np.frombuffer(self.line, f"<u{self.width}")[0])).tolist(), len(raw)], 0
            for u, end in zip(part, ends, strict=True):
                found[u] = raw[at:end]
                at = end + self.width
        if len(plain) < len(units):
            rest = [u for u in units if u not in found]
            for k in range(0, len(rest), AT_ONCE):
                found |= dict(zip(rest[k : k + AT_ONCE], self._bytes(rest[k : k + AT_ONCE]), strict=True))
        return [found[u] for u in units]

    def parts(self, parts: list[str]) -> list[bytes]:
        """Ids of each of ``parts``, which end before white space or with the text."""
        line = [w[:1] == "\n" and len(w) > 1 and not w[1].isspace() for w in parts]
        words = [w[1:] if x else w for x, w in zip(line, parts)]
        stems = [w.rstrip(TAIL) for w in words]
        stems = [s if s[-1:].isalpha() else w for s, w in zip(stems, words)]
        tails = [w[len(s) :] for s, w in zip(stems, words)]
        units, before = self.units, {True: self.line, False: b""}
        units.fill({*stems, *tails} - {""})
        units[""] = b""
        return [before[x] + units[s] + units[t] for x, s, t in zip(line, stems, tails)]

    def __call__(self, text: str) -> bytes:
        return self._bytes([text])[0] if self.added.pattern and self.added.search(text) else b"".join(self.parts(self.part.findall(text)))

    def many(self, texts: pa.Array) -> Iterator[bytes]:
        """Ids of each of ``texts`` (strings, none null); each distinct word of the batch is looked up once."""
        words = pc.split_pattern(pc.replace_substring(texts, "\n", " \n"), " ")
        coded, ends = pc.dictionary_encode(words.flatten()), words.offsets.to_numpy()
        codes, ends = coded.indices.to_numpy(), ends - ends[0]
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        # Where white space meets white space, or a text begins or ends with it, the text is cut with more care.
        odd = np.array([w.split() != [w.removeprefix("\n")] for w in distinct], bool)[codes]
        odd = {*np.searchsorted(ends, np.flatnonzero(odd), "right").tolist()}
        odd |= {k + 1 for k in np.flatnonzero(pc.match_substring_regex(texts, self.added.pattern).to_numpy(zero_copy_only=False)).tolist()} if self.added.pattern else set()
        heads = codes[ends[:-1]]
        first, again = np.unique(heads, return_inverse=True)
        codes = codes.copy()
        codes[ends[:-1]] = len(distinct) + again
        ids = []
        for part in (distinct[k : k + 8 * AT_ONCE] for k in range(0, len(distinct), 8 * AT_ONCE)):
            ids += self.parts([w if w[:1] == "\n" else " " + w for w in part])
        ids += self.parts([distinct[k] for k in first.tolist()])
        sizes = np.fromiter(map(len, ids), "int64", len(ids)) // self.width
        flat, starts = np.frombuffer(b"".join(ids), f"<u{self.width}"), np.append(0, np.cumsum(sizes)[:-1])
        count = sizes[codes].astype("int32")
        before = np.append(0, np.cumsum(count, dtype="int64"))
        for a in range(0, len(ends) - 1, 256):
            z = min(a + 256, len(ends) - 1)
            part = slice(ends[a], ends[z])
            at = np.repeat(starts[codes[part]] - before[part], count[part]) + np.arange(before[ends[a]], before[ends[z]])
            body, cuts = flat[at].tobytes(), ((before[ends[a : z + 1]] - before[ends[a]]) * self.width).tolist()
            for k in range(a, z):
                yield self(texts[k].as_py()) if k + 1 in odd else body[cuts[k - a] : cuts[k - a + 1]]


def byte_tokens(path: str) -> ByteTokens:
    mine = store("token_files")
    if path not in mine:
        mine[path] = ByteTokens(path)
    return mine[path]


def _bounds(docs: DataFrame, ranges: int) -> list[int]:
    """Where ranges of doc_id end, by quantiles of doc_id alone; one id held by many rows ends several."""
    cuts = [k / ranges for k in range(1, ranges)]
    return sorted(docs.agg(F.percentile_approx("doc_id", cuts, 10 * MOST_RANGES)).first()[0] or []) if cuts else []


class TokenFiles:
    """Token files of a table in the folder ``path``; ``starts``: the ids before each range of doc_id."""

    def __init__(self, spark: SparkSession, path: str, starts: list[int]):
        self.spark, self.path, self.starts = spark, path, starts

    @classmethod
    def write(cls, docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 0) -> TokenFiles:
        """Tokenises all documents, ``end_id`` after each, and writes them by rising doc_id, those without one last.

        Rows are tokenised where they lie; their ids, not their texts, are dealt to ranges of doc_id and sorted, and each
        task writes its range to files as it goes. A range of one id, or of none, is split by a hash of the text and the
        task it came from, which also orders rows of equal doc_id. Null and empty texts: ``end_id`` alone. Repeated rows
        are documents of their own; other columns are left out; an empty table has no files. A file gets its name when it
        is whole, and a task that runs again writes the same files.
        """
        spark = docs.sparkSession
        rows, named = docs.agg(F.count("*"), F.count("doc_id")).first()
        ranges, nameless = (min(MOST_RANGES, max(1, -(-n // RANGE_ROWS))) for n in (named, rows - named))
        bounds = np.array(_bounds(docs.where("doc_id IS NOT NULL"), ranges), "int64")

        def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tokens, task = byte_tokens(tokenizer_path), zlib.crc32(str(TaskContext.get().partitionId()).encode())
            end = np.array([end_id], f"<u{tokens.width}").tobytes()
            for batch in (b.slice(k, SLICE) for b in batches for k in range(0, b.num_rows, SLICE)):
                doc_id, bodies = batch.column("doc_id"), [x + end for x in tokens.many(batch.column("text"))]
                tie = np.array([zlib.crc32(x, task) for x in bodies], "uint32")
                d, none = doc_id.fill_null(0).to_numpy(), doc_id.is_null().to_numpy(zero_copy_only=False)
                a, z = np.searchsorted(bounds, d, "left"), np.searchsorted(bounds, d, "right")
                a, z = np.where(none, ranges, a), np.where(none, ranges + nameless - 1, z)
                to = a + ((z - a + 1) * tie.astype("int64") >> 32)
                yield pa.RecordBatch.from_arrays([pa.array(to.astype("int32")), doc_id, pa.array(tie.astype("int64")), pa.array(bodies, pa.binary())], names=["range", "doc_id", "tie", "body"])
                pa.default_memory_pool().release_unused()

        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder = re.sub("^file:/+", "file:///", place.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(place).toString())

        def store_range(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            tokens = byte_tokens(tokenizer_path)
            system, at = fs.FileSystem.from_uri(folder)
            doc_ids: list[int | None] = []
            bodies: list[bytes] = []
            number, size, n, start = 0, 0, 0, 0

            def put() -> pd.DataFrame:
                whole, part = f"{at}/ids-{number:06d}-{n:05d}", f"{at}/_{number:06d}-{n:05d}-{TaskContext.get().taskAttemptId()}"
                with system.open_output_stream(part) as out:
                    out.write(TokenFile.pack(doc_ids, bodies, tokens.width, number, start))
                system.move(part, whole)
                return pd.DataFrame({"range": [number], "file": [n], "docs": [len(bodies)], "tokens": [size]})

            system.create_dir(at, recursive=True)
            for g in batches:
                for r, doc_id, body in zip(g["range"], g["doc_id"].astype("Int64"), g["body"]):
                    if bodies and (r != number or size >= FILE_TOKENS or len(bodies) >= FILE_DOCS):
                        yield put()
                        n, start = (n + 1, start + size) if r == number else (0, 0)
                        doc_ids, bodies, size = [], [], 0
                    number = r
                    doc_ids.append(None if doc_id is pd.NA else int(doc_id))
                    bodies.append(body)
                    size += len(body) // tokens.width
            if bodies:
                yield put()

        coded = texts(docs.withColumn("doc_id", F.col("doc_id").cast("long"))).mapInArrow(encode, "range int, doc_id long, tie long, body binary")
        dealt = coded.repartitionById(ranges + nameless, F.col("range")).sortWithinPartitions("range", F.col("doc_id").asc_nulls_last(), "tie")
        files, listed = kept(dealt.mapInPandas(store_range, "range int, file int, docs long, tokens long"), "files")
        tokens = {r["range"]: r["n"] for r in files.groupBy("range").agg(F.sum("tokens").alias("n")).collect()}  # a number for each range, of which there are few
        drop(spark, listed)
        return cls(spark, path, [0, *accumulate(tokens.get(k, 0) for k in range(ranges + nameless))])

    def documents(self, keep_ids: bool = False) -> DataFrame:
        """From the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 (of its ids as unsigned 32-bit
        numbers), with ``keep_ids`` also ids array<int>."""
        starts, schema = self.starts, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * keep_ids
        if not starts[-1]:
            return self.spark.createDataFrame([], schema)

        def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for raw in batch["content"]:
                    f = TokenFile(raw)
                    ends = f.bounds.all().astype("int64")
                    ids, at = memoryview(f.ids.astype("<u4").tobytes()), (4 * ends).tolist()
                    names = pd.array(f.least + f.names.all().astype("int64"), "Int64")
                    out = {"doc_id": np.append(names, [pd.NA] * f.nameless) if f.nameless else names, "start": starts[f.range] + f.start + ends[:-1], "n_tokens": np.diff(ends), "ids_crc32": [zlib.crc32(ids[a:z]) for a, z in zip(at, at[1:])]}
                    frame = pd.DataFrame(out | ({"ids": [f.ids[a:z].astype("int32") for a, z in zip(ends, ends[1:])]} if keep_ids else {}))
                    yield frame.assign(doc_id=frame["doc_id"].astype("Int64"))

        files = self.spark.read.format("binaryFile").option("pathGlobFilter", "ids-*").load(self.path)
        return files.select("content").mapInPandas(read, schema)

    def locate(self, start: int) -> int:
        """The range of doc_id that holds the ``start``-th id of all."""
        return bisect_right(self.starts, start) - 1


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op13: doc_id, start, n_tokens, ids_crc32 of every document, read back from its token files; odd rows as in write()."""
    import public_tokenizers

    return TokenFiles.write(table(spark, sf_dir, "documents"), scratch(spark, "tokens"), public_tokenizers.path("byte_bpe_50k.json")).documents()
