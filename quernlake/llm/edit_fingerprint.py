"""Document fingerprints by a randomised edit embedding, bit-sampled banding and verification."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import cut, table, texts, written
from ._words import mix

PERIOD, SAMPLES, END = 4096, 256, 255  # steps after which walks use the same bits again; most samples looked for; past the end
CHANCE = 0.125  # about the share of samples in which unrelated texts agree
GROUP_BYTES, RANGE_BYTES = 2 << 20, 16 << 20  # text walked at once; text of a range
BLOCK = 256  # fingerprints of a block of a large bucket

_rng = np.random.default_rng(8)
BITS = _rng.integers(0, 2, (PERIOD, 256), dtype="uint8")  # whether a walk moves on from a character of a class at a step
BITS[:, END] = 0
KIND = _rng.integers(0, END, 0x10000, dtype="uint8")  # class of a code point
ROWS = [r.tobytes() for r in BITS]


def scale_of(n: int) -> int:
    """Every 2^scale-th step is sampled, so that the some 2n steps give 128 to 256 samples."""
    return max(0, (2 * n - 1).bit_length() - 8) if n else 0


def walk(docs: list[str]) -> list[tuple[int, np.ndarray]]:
    """For each text its scale and the sampled characters of its embedding, four bits each.

    All texts walk by the same random bits: at each step the character under the pointer is put out, and a bit of step
    and character says whether the pointer moves on. After an edit two walks soon meet again, so that few places of the
    outputs differ (edit distance becomes Hamming distance). The texts of a call step together in numpy, the longest
    first; the last few go on one by one.
    """
    lengths = np.array([len(t) for t in docs], "int64")
    order = np.argsort(-lengths, kind="stable")
    flat = np.frombuffer("\0".join([docs[k] for k in order] + [""]).encode("utf-32-le", "surrogatepass"), "<u4")
    data = KIND[flat & 0xFFFF] if len(flat) else np.zeros(0, "uint8")
    ends = np.cumsum(lengths[order] + 1) - 1
    data = data.copy()
    data[ends] = END
    scale = np.array([scale_of(n) for n in lengths[order].tolist()], "int64")
    who, at = np.arange(len(docs)), ends - lengths[order]
    who, at = who[lengths[order] > 0], at[lengths[order] > 0]
    out = np.full((len(docs), 2 * SAMPLES), END, "uint8")
    taken = np.zeros(64, "int64")
    step = 0
    while len(who) > 24:
        c = data[at]
        level = ((step + 1) & -(step + 1)).bit_length() - 1
        first = int(np.searchsorted(-scale[who], -level))  # scales fall along the order
        if first < len(who):
            mine = who[first:]
            k = taken[scale[mine]]
            fits = k < 2 * SAMPLES
            out[mine[fits], k[fits]] = np.where(c[first:] == END, END, c[first:] & 15)[fits]
            taken[: level + 1] += 1
        else:
            taken[: level + 1] += 1
        at += BITS[step & (PERIOD - 1)][c]
        step += 1
        if step & 63 == 0:
            live = data[at] != END
            who, at = who[live], at[live]
    raw = data.tobytes()
    for w, p in zip(who.tolist(), at.tolist()):
        s, k, j, row = int(scale[w]), int(taken[scale[w]]), step, out[w]
        mask = (1 << s) - 1
        while (c := raw[p]) != END and k < 2 * SAMPLES:
            if (j + 1) & mask == 0:
                row[k] = c & 15
                k += 1
            p += ROWS[j & (PERIOD - 1)][c]
            j += 1
    found: list = [None] * len(docs)
    for place, k in enumerate(order.tolist()):
        row = out[place]
        n = int((row != END).argmin()) if (row == END).any() else len(row)
        found[k] = (int(scale[place]), row[:n])
    return found


def likeness(a: tuple[int, np.ndarray], b: tuple[int, np.ndarray]) -> float:
    """Share of equal samples at the coarser scale, 0 for what unrelated texts reach by chance, 1 for equal texts."""
    s = max(a[0], b[0])
    x, y = ((f[1][(1 << (s - f[0])) - 1 :: 1 << (s - f[0])]) for f in (a, b))
    n = min(len(x), len(y))
    most = max(len(x), len(y))
    share = float((x[:n] == y[:n]).sum()) / most if most else 1.0
    return max(0.0, (share - CHANCE) / (1 - CHANCE))


def to_text(f: tuple[int, np.ndarray]) -> str:
    """The fingerprint as text: its scale, and a hexadecimal digit a sample."""
    return f"{f[0]:02x}:" + f[1].tobytes().hex()[1::2]


def from_text(f: str) -> tuple[int, np.ndarray]:
    return int(f[:2], 16), np.frombuffer(bytes.fromhex("".join("0" + x for x in f[3:])), "uint8")


def fingerprint(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint of each whole text; null text as empty. No shuffle; rows are as given."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "fingerprint": [to_text(f) for f in walk(batch["text"].tolist())]})

    return texts(docs).mapInPandas(run, "doc_id long, fingerprint string")


def bands_for(share: float, rows: int, miss: float) -> int:
    """Bands of ``rows`` places that a pair with this share of equal samples misses with probability ``miss`` at most."""
    hit = share**rows
    return 1 if hit >= 1 - miss else int(np.ceil(np.log(miss) / np.log1p(-hit)))


def near_documents(prints: DataFrame, threshold: float = 0.5, bands: int | None = None, rows: int = 6, miss: float = 0.01) -> DataFrame:
    """Near fingerprints of ``prints`` (doc_id, fingerprint): pairs lead < doc_id with their likeness.

    Equal fingerprints are one, led by the least doc_id, with likeness 1. Bands of sampled places of the whole embedding,
    at a text's own scale and the next coarser ones, bring the others together. A place is that of least random rank
    among a text's samples, so that two texts take the same one, and agree there, with the share of equal samples as
    probability; there are as many bands as keep the chance of missing a pair at the threshold under ``miss``. All members
    of a bucket are compared with each other by the whole fingerprint, large buckets in pairs of blocks.
    """
    share = min(1.0, threshold * (1 - CHANCE) + CHANCE)
    bands, coarser = bands or bands_for(share, rows, miss), int(np.ceil(1 - np.log2(share)))
    prints = prints.where("doc_id IS NOT NULL AND fingerprint IS NOT NULL")
    same = cut(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("lead")))
    rng = np.random.default_rng(3)
    order = np.argsort(rng.random((bands * rows, 2 * SAMPLES)), 1).argsort(1)
    place = np.where(order == np.minimum.accumulate(order, 1), np.arange(2 * SAMPLES), 0)
    place = np.maximum.accumulate(place, 1).astype("int16").T.copy()  # the place of least rank among the first n + 1
    factor = rng.integers(0, 1 << 63, (bands, rows), dtype="uint64") * np.uint64(2) + np.uint64(1)

    def at_scale(f: tuple[int, np.ndarray], t: int) -> np.ndarray:
        return f[1][(1 << (t - f[0])) - 1 :: 1 << (t - f[0])]

    def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for text in batch["fingerprint"]:
                f, mine = from_text(text), []
                for t in range(f[0], f[0] + coarser + 1):
                    y = at_scale(f, t)
                    if len(y):
                        at = place[len(y) - 1].astype("int64")
                        value = (y[at].astype("uint64") + (at.astype("uint64") << np.uint64(8)) + np.uint64(1)).reshape(bands, rows)
                        mine.append(mix((value * factor).sum(1, dtype="uint64") + np.arange(bands, dtype="uint64") * np.uint64(64) + np.uint64(t)) >> np.uint64(6) << np.uint64(6) | np.uint64(t))
                out.append(np.concatenate(mine).astype("int64") if mine else np.zeros(0, "int64"))
            yield pd.DataFrame({"doc_id": batch["lead"], "keys": out})

    def compare(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        t, i, j = int(key[0]) & 63, int(key[1]), int(key[2])
        g = g.drop_duplicates("doc_id").sort_values("doc_id")
        f = [from_text(x) for x in g["fingerprint"]]
        scale, ids, block = np.array([x[0] for x in f]), g["doc_id"].to_numpy(), g["block"].to_numpy()
        ok = scale <= t  # a key of another scale can look the same
        f, scale, ids, block = [x for x, o in zip(f, ok) if o], scale[ok], ids[ok], block[ok]
        x = np.full((len(f), 2 * SAMPLES), END, "uint8")
        size = np.zeros(len(f), "int64")
        for k, y in enumerate(f):
            y = at_scale(y, t)
            x[k, : len(y)], size[k] = y, len(y)
        out = []
        for a in np.flatnonzero(block == i):
            others = np.flatnonzero((block == j) & ((scale == t) | (scale[a] == t)))
            others = others[others > a] if i == j else others
            if len(others):
                equal = ((x[others] == x[a]) & (x[a] != END)).sum(1)
                value = (equal / np.maximum(size[others], size[a]) - CHANCE) / (1 - CHANCE)
                near = value >= threshold
                out += [(min(ids[a], b), max(ids[a], b), max(0.0, v)) for b, v in zip(ids[others[near]], value[near])]
        return pd.DataFrame(out, columns=["lead", "doc_id", "likeness"])

    keyed = cut(same.mapInPandas(keys, "doc_id long, keys array<long>").select("doc_id", F.explode("keys").alias("key")))
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key", F.ceil(F.col("n") / F.lit(BLOCK)).cast("int").alias("blocks"))
    dealt = keyed.join(sizes, "key").withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
    dealt = dealt.join(same.select(F.col("lead").alias("doc_id"), "fingerprint"), "doc_id").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other")).select("key", "i", "j", "block", "doc_id", "fingerprint")
    found = dealt.groupBy("key", "i", "j").applyInPandas(compare, "lead long, doc_id long, likeness double").distinct()
    copies = prints.join(same, "fingerprint").where("doc_id > lead").select("lead", "doc_id", F.lit(1.0).alias("likeness"))
    return found.unionByName(copies)


SAMPLE_TEXTS, DICTIONARY_BYTES = 400, 112_640  # from whose beginnings a dictionary is trained, and its size


def dictionary(docs: DataFrame) -> bytes:
    """A dictionary for pressing texts, of some texts as they come; empty where there are too few. Results don't depend on it."""
    some = [r[0].encode("utf-8", "surrogatepass") for r in texts(docs).limit(SAMPLE_TEXTS).select(F.substring("text", 1, 4000)).collect()]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, some).as_bytes() if len(some) > 50 else b""
    except zstandard.ZstdError:  # texts too short or too alike
        return b""


def _press(words: bytes):
    """Compresses bytes by a dictionary."""
    return zstandard.ZstdCompressor(level=9, dict_data=zstandard.ZstdCompressionDict(words) if words else None).compress


def _open(words: bytes):
    return zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(words) if words else None).decompress


OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
#: What a range gives: kind 0 are results; 1 is its first row's text, 2 its last row, for which the next range's first is needed.
RANGE = f"kind int, part int, text binary, {OUT}"


def _compared(ids: list, text: list[str], follow: list[str], chained: bool = False) -> pd.DataFrame:
    """Results of rows, each with the text that follows it; ``chained``: that of the next row."""
    edited = [t[: len(t) - len(t) // 2] + f[: len(t) // 2] for t, f in zip(text, follow)]
    m = len(text)
    found = walk(text + edited + (follow[-1:] if chained else follow))
    a, b, c = found[:m], found[m : 2 * m], found[1:m] + found[-1:] if chained else found[2 * m :]
    return pd.DataFrame({
        "doc_id": pd.array(ids, "Int64"), "n_chars": [len(t) for t in text], "edited_sha256": [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in edited],
        "fingerprint": [to_text(f) for f in a], "edited_fingerprint": [to_text(f) for f in b],
        "near_edited": [likeness(x, y) for x, y in zip(a, b)], "near_next": [likeness(x, y) for x, y in zip(a, c)],
    })


def with_next(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of its edited text, and their likeness.

    Documents follow one another by falling doc_id, null last, equal ones by a hash of the text; after the last comes the
    first. The edited text has, in place of its last floor(n_chars / 2) code points, as many of the first of the next
    document, or all it has. Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited (to
    the edited text's), near_next (to the next document's), a row for each row; null text is empty.

    Texts are compressed, dealt once into sorted ranges of doc_id and hash (so rows of one doc_id, or without any, don't
    fall to one task), and each range is walked through in batches of bounded size. A range's last row waits for the first
    of the next range; these two rows a range are joined afterwards. Nothing comes to the driver. Other columns are left out.
    """
    words = dictionary(docs)

    def press(batch: pd.Series) -> pd.Series:
        z = _press(words)
        return pd.Series([z(t.encode("utf-8", "surrogatepass")) for t in batch])

    pressed = texts(docs).select("doc_id", F.xxhash64("text").alias("tie"), F.octet_length("text").cast("long").alias("size"), F.pandas_udf(press, "binary")("text").alias("text"))
    stored = written(pressed, "pressed")
    ranges = max(1, -(-(stored.agg(F.sum("size")).first()[0] or 0) // RANGE_BYTES))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        open_, z, part = _open(words), _press(words), TaskContext.get().partitionId()
        held: list[tuple] = []  # rows whose next one may not be known yet
        size, first = 0, None

        def done(last: bool) -> Iterator[pd.DataFrame]:
            ids, text = [i for i, _ in held], [t for _, t in held]
            if len(ids) > 1:
                out = _compared(ids[:-1], text[:-1], text[1:], True)
                out.insert(0, "kind", 0)
                out.insert(1, "part", part)
                out.insert(2, "text", [None] * len(out))
                yield out
            if last:
                ends = [(1, part, z(first.encode("utf-8", "surrogatepass")), None), (2, part, z(text[-1].encode("utf-8", "surrogatepass")), ids[-1])]
                yield pd.DataFrame([(*x, *[None] * 6) for x in ends], columns=[c.split()[0] for c in RANGE.split(", ")], dtype=object)

        for batch in batches:
            for i, raw in zip(batch["doc_id"].astype("Int64"), batch["text"]):
                text = open_(raw).decode("utf-8", "surrogatepass")
                first = text if first is None else first
                held.append((None if pd.isna(i) else int(i), text))
                size += len(text)
                if size > GROUP_BYTES and len(held) > 1:
                    yield from done(False)
                    held, size = held[-1:], len(text)
        if held:
            yield from done(True)

    by = [F.desc_nulls_last("doc_id"), F.desc("tie")]
    found = written(stored.select("doc_id", "tie", "text").repartitionByRange(ranges, *by).sortWithinPartitions(*by).select("doc_id", "text").mapInPandas(run, RANGE), "ranges")
    heads = found.where("kind = 1").select("part", F.col("text").alias("head"))
    order = Window.orderBy("part")  # a row a range
    turn = heads.select("part", F.lead("part").over(order).alias("next"), F.min("part").over(Window.partitionBy(F.lit(0))).alias("least"))
    turn = turn.select("part", F.coalesce("next", "least").alias("next"))
    tails = found.where("kind = 2").select("part", "doc_id", "text").join(turn, "part").join(heads.withColumnRenamed("part", "next"), "next")

    def last(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        open_ = _open(words)
        for batch in batches:
            text, head = ([open_(x).decode("utf-8", "surrogatepass") for x in batch[c]] for c in ("text", "head"))
            yield _compared([None if pd.isna(i) else int(i) for i in batch["doc_id"].astype("Int64")], text, head)

    return found.where("kind = 0").select(*[c.split()[0] for c in OUT.split(", ")]).unionByName(tails.select("doc_id", "text", "head").mapInPandas(last, OUT))


def op8_edit_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_next(table(spark, sf_dir, "documents"))
