"""Hierarchical multi-length packing of tokenised documents."""

from __future__ import annotations

import os
import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from ._common import Memo, store, table, texts

TIERS = (512, 1024, 2048, 4096)
MARK = "\x01"  # stands between units that are encoded together; a byte of its own, which has an id of its own
TAIL = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


class WordTokens:
    """Ids of the tokenizers library for texts, as little-endian unsigned 32-bit bytes.

    For tokenizers that drop white space: what stands between spaces is encoded by the library once and remembered. A
    Latin letter that lower-casing leaves a letter and ASCII punctuation after it (but an apostrophe) never share a token
    there, so words are cut at such a place too; other words, and those that may hold a special token, are handed over whole.
    """

    def __init__(self, path: str, memo: int = 300_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        (self.mark,) = self.lib.encode(MARK, add_special_tokens=False).ids
        self.units = Memo(self._encode, memo // 2)
        self.words = Memo(self._split, memo)

    def _encode(self, units: list[str]) -> list[bytes]:
        """Units with white space around them are encoded as if alone, so that many go in one text, with a mark between."""
        plain = [u for u in units if MARK not in u]
        (whole,) = self.lib.encode_batch_fast([f" {MARK} ".join(plain)], add_special_tokens=False)
        ids = np.array(whole.ids, "<u4")
        ends = [*np.flatnonzero(ids == self.mark).tolist(), len(ids)] if plain else []
        raw, at, found = ids.tobytes(), 0, {}
        for u, end in zip(plain, ends, strict=True):
            found[u] = raw[4 * at : 4 * end]
            at = end + 1
        if len(plain) < len(units):
            rest = [u for u in units if MARK in u]
            found |= {u: np.array(e.ids, "<u4").tobytes() for u, e in zip(rest, self.lib.encode_batch_fast(rest, add_special_tokens=False))}
        return [found[u] for u in units]

    def _split(self, words: list[str]) -> list[bytes]:
        parts = []
        for w in words:
            stem = w.rstrip(TAIL) if "<|" not in w else ""
            last = stem[-1:]
            cut = last.isalpha() and last < "\u0250" and last != "\u0130"
            parts.append((stem.lower() if stem.isascii() else stem, w[len(stem) :]) if cut else (w, ""))
        self.units.fill([u for p in parts for u in p if u])
        units = self.units
        return [units[a] + units[b] if b else units[a] if a else b"" for a, b in parts]

    def __call__(self, text: str) -> bytes:
        if text.isascii() and "<|" not in text:  # special tokens are found before letters are made small
            text = text.lower()
        return b"".join(self.words.lookup(text.replace("\n", " ").split(" ")))


def word_tokens(path: str) -> WordTokens:
    mine = store("packing")
    if path not in mine:
        mine[path] = WordTokens(path)
    return mine[path]


def pack_tiers(pool: list[tuple[int, int, int]], tiers: tuple[int, ...]) -> Iterator[tuple[int, list[tuple[int, int, int]]]]:
    """Takes full windows out of ``pool``, a sorted list of (length, document, start) no longer than the longest tier.

    A piece belongs to the least tier that holds it. Tiers are packed from the longest: a window opens with the longest
    piece of its tier, its gap takes the longest whole pieces that fit, from this tier or shorter ones, and what gap is
    left takes the head of the shortest piece, whose rest goes back to the pool. Yields (tier, pieces); what is left in
    the pool doesn't fill a window of its tier.
    """
    for tier, below in zip(tiers[::-1], (*tiers[-2::-1], 0)):
        fits = sum(x[0] for x in pool if x[0] <= tier)
        while fits >= tier:
            at = bisect_right(pool, (tier, float("inf"), 0))
            if not at or pool[at - 1][0] <= below:
                break
            piece = pool.pop(at - 1)
            window, gap = [piece], tier - piece[0]
            while gap:
                at = bisect_right(pool, (gap, float("inf"), 0))
                if at:
                    piece = pool.pop(at - 1)
                else:
                    n, doc, start = pool.pop(0)
                    piece = (gap, doc, start)
                    insort(pool, (n - gap, doc, start + gap))
                window.append(piece)
                gap -= piece[0]
            fits -= tier
            yield tier, window


def step_groups(windows: list[tuple[int, list]], tokens: int) -> list[int]:
    """A group for each window, of at most ``tokens`` tokens each, with near-equal attention cost (sum of squared lengths)."""
    if not windows:
        return []
    n = -(-sum(t for t, _ in windows) // tokens)
    cost, room, of = [0] * n, [tokens] * n, [0] * len(windows)
    order = sorted(range(len(windows)), key=lambda k: (-windows[k][0], -sum(p[0] ** 2 for p in windows[k][1])))
    for k in order:  # longest windows first, so that tiers of powers of two leave no hole
        size, pieces = windows[k]
        free = [g for g in range(len(cost)) if room[g] >= size]
        if not free:
            cost.append(0)
            room.append(tokens)
            free = [len(cost) - 1]
        g = min(free, key=lambda g: (cost[g], g))
        of[k] = g
        room[g] -= size
        cost[g] += sum(p[0] ** 2 for p in pieces)
    return of


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_group long"


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int = 2, tiers: tuple[int, ...] = TIERS, step_tokens: int = 32_768, block_tokens: int = 1 << 19, keep_ids: bool = False) -> DataFrame:
    """Packs all documents into sequences of the lengths ``tiers`` (powers of two), in one pass and with no shuffle.

    Each task tokenises its rows (ids, then ``end_id``), cuts whole windows of the longest tier from long documents, and
    packs the rest by pack_tiers() in blocks of about ``block_tokens``; what fills no window goes on to the next block.
    What is left at the task's end, under the sum of the tiers, falls into windows of powers of two, so no sequence holds
    padding. Returns a row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, tier (the
    sequence's length), step_group, with ``keep_ids`` also ids array<int>. Ids of sequences and groups hold the task's
    number, and a task that runs again gives the same rows.

    Null and empty texts: a document of ``end_id`` alone. Repeated rows and null doc_id: packed one by one. Other columns
    of ``docs`` are left out. Memory: a block and one document.
    """
    if list(tiers) != sorted(set(tiers)) or any(t & (t - 1) for t in tiers):
        raise ValueError("tiers: rising powers of two")
    longest = tiers[-1]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, end = word_tokens(tokenizer_path), np.array([end_id], "<u4").tobytes()
        task = TaskContext.get().partitionId() << 36
        held: dict[int, tuple] = {}
        pool: list[tuple[int, int, int]] = []
        ready: list[tuple[int, list]] = []
        n_seq = n_group = number = fresh = 0

        def rows() -> pd.DataFrame:
            nonlocal n_seq, n_group
            of, out = step_groups(ready, step_tokens), []
            for (tier, window), g in zip(ready, of):
                offset = 0
                for n, k, start in window:
                    doc_id, ids = held[k]
                    part = ids[4 * start : 4 * (start + n)]
                    out.append((doc_id, start, n, zlib.crc32(part), len(ids) // 4, task + n_seq, offset, tier, task + n_group + g) + ((np.frombuffer(part, "<u4").astype("int32"),) if keep_ids else ()))
                    offset += n
                n_seq += 1
            n_group += max(of, default=-1) + 1
            ready.clear()
            left = {k for _, k, _ in pool}
            for k in [k for k in held if k not in left]:
                del held[k]
            frame = pd.DataFrame(out, columns=[c.split()[0] for c in SCHEMA.split(", ")] + ["ids"] * keep_ids)
            return frame.assign(doc_id=frame["doc_id"].astype("Int64"))

        for batch in batches:
            for doc_id, text in zip(batch["doc_id"].astype("Int64"), batch["text"]):
                ids = encode(text) + end
                held[number] = (doc_id, ids)
                n = len(ids) // 4
                for start in range(0, n - longest + 1, longest):
                    ready.append((longest, [(longest, number, start)]))
                if rest := n % longest:
                    insort(pool, (rest, number, n - rest))
                number += 1
                fresh += n
                if fresh >= block_tokens:
                    ready.extend(pack_tiers(pool, tiers))
                    yield rows()
                    fresh = 0
        ready.extend(pack_tiers(pool, tiers))
        rest = sum(p[0] for p in pool)
        while rest:
            tier = gap = min(longest, 1 << (rest.bit_length() - 1))
            window = []
            while gap:
                n, k, start = pool.pop()
                window.append((min(n, gap), k, start))
                if n > gap:
                    pool.append((n - gap, k, start + gap))
                gap -= window[-1][0]
            ready.append((tier, window))
            rest -= tier
        yield rows()

    return texts(docs).mapInPandas(run, SCHEMA + ", ids array<int>" * keep_ids)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
