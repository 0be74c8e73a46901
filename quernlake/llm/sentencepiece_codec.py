"""SentencePiece encoding and decoding by a score-ordered agenda of adjacent symbol pairs (merge-type vocabularies)."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import chain

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from ._common import Memo, store, table, texts

SPACE, APART = "▁", "\uf8ff"


class PieceCodec:
    """A merge-type SentencePiece model with identity normalisation.

    encode() keeps an agenda of adjacent symbol pairs whose concatenation is a piece, takes the pair of the best score
    (the leftmost among equals), merges it and adds the two pairs that arise, till the agenda is empty. A boundary that no
    piece of the vocabulary crosses can't be merged over, so a text falls into units there, which are encoded one by one
    and remembered. Each unit, without exception, is held against the sentencepiece library's encode() and decode() when
    first met, and so is a whole text of each batch (check()); a difference raises. Texts are decoded from their ids.
    """

    def __init__(self, model_path: str, verify: bool = True, memo: int = 250_000):
        import sentencepiece

        self.lib = sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
        n = range(sp.get_piece_size())
        self.pieces = [sp.id_to_piece(i) for i in n]
        plain = [i for i in n if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        if any(sp.is_unused(i) for i in n):
            raise ValueError("vocabularies with unused pieces aren't supported")
        self.ids = {self.pieces[i]: i for i in plain}
        # Place in the order in which pairs are taken; pieces of equal score share one.
        places = {s: k for k, s in enumerate(sorted({sp.get_score(i) for i in plain}, reverse=True))}
        self.place = {self.pieces[i]: places[sp.get_score(i)] for i in plain}
        self.bytes = {b: i for i in n if sp.is_byte(i) for b in [int(self.pieces[i][3:-1], 16)]}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.unk, self.verify, self.none = sp.unk_id(), verify, len(places)
        self.joined = {p[k : k + 2] for p in self.ids for k in range(len(p) - 1)}
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError("pieces with inner spaces aren't supported")
        self.units = Memo(self._encode_units, memo)
        self.words = Memo(self._encode_words, memo)
        text_ids = set(self.ids.values())
        self.shown = [self.pieces[i] if i in text_ids else "" for i in n]
        self.shown[self.unk] = " ⁇ "
        self.apart = sp.encode(APART)
        if any(APART in p for p in self.pieces):
            raise ValueError("vocabularies with pieces of the private character U+F8FF aren't supported")

    def agenda(self, unit: str) -> list[str]:
        """The pieces into which ``unit`` merges, by score, then from the left: a flat agenda for short units, else a heap."""
        place = self.place
        sym = list(unit)
        n = len(sym)
        if n <= 64:
            get, none = place.get, self.none
            agenda = [get(a + b, none) for a, b in zip(sym, sym[1:])]
            while agenda and (best := min(agenda)) < none:
                i = agenda.index(best)
                sym[i : i + 2] = [merged := sym[i] + sym[i + 1]]
                del agenda[i]
                if i < len(agenda):
                    agenda[i] = get(merged + sym[i + 1], none)
                if i:
                    agenda[i - 1] = get(sym[i - 1] + merged, none)
            return sym
        heap = [(p, i, 2) for i in range(n - 1) if (p := place.get(sym[i] + sym[i + 1])) is not None]
        if not heap:
            return sym
        heapify(heap)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while heap:
            _, i, size = heappop(heap)
            left, j = sym[i], after[i]
            if not left or j >= n or len(left) + len(sym[j]) != size:
                continue  # one of the two has merged with another meanwhile
            sym[i] = left = left + sym[j]
            sym[j] = ""
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (p := place.get(left + sym[k])) is not None:
                    heappush(heap, (p, i, len(left) + len(sym[k])))
            if (h := before[i]) >= 0 and (p := place.get(sym[h] + left)) is not None:
                heappush(heap, (p, h, len(sym[h]) + len(left)))
        return [s for s in sym if s]

    def _ids(self, symbols: list[str]) -> Iterator[int]:
        for s in symbols:
            if (i := self.ids.get(s)) is not None:
                yield i
            elif self.bytes:
                yield from (self.bytes[b] for b in s.encode())
            else:
                yield self.unk

    def _encode_units(self, units: list[str]) -> list[tuple[str, str]]:
        """The ids of each unit, decimal and joined by commas, and what these ids decode to; units end with whole characters."""
        out = []
        for u in units:
            symbols = self.agenda(u)
            got = [self.ids.get(x) for x in symbols]
            if None in got:
                got = list(self._ids(symbols))
                out.append((",".join(map(str, got)), self.decode_ids(got)))
            else:
                out.append((",".join(map(str, got)), "".join([self.shown[i] for i in got]).replace(SPACE, " ")))
        if self.verify:
            self._check_units(units, out)
        return out

    def _check_units(self, units: list[str], found: list[tuple[str, str]]) -> None:
        """Units stand behind a character of no piece, over which nothing merges, so that the library sees each as in its word."""
        n, k = len(self.apart), len(APART)
        theirs = self.lib.encode([APART + u.replace(SPACE, " ") for u in units], num_threads=1)
        back = self.lib.decode(theirs, num_threads=1)
        for u, (ids, mine), want, text in zip(units, found, theirs, back, strict=True):
            if ids != ",".join(map(str, want[n:])) or text[k:] != mine:
                raise RuntimeError(f"the agenda and the library differ on {u!r}: {ids}; {want[n:]}; {text[k:]!r}")

    def split(self, word: str) -> list[str]:
        """``word`` cut where no piece crosses."""
        joined, at, out = self.joined, 0, []
        for k in range(1, len(word)):
            if word[k - 1 : k + 1] not in joined:
                out.append(word[at:k])
                at = k
        out.append(word[at:])
        return out

    def _encode_words(self, words: list[str]) -> list[tuple[str, str]]:
        """words: without the space mark that comes first."""
        parts = [self.split(SPACE + w) for w in words]
        self.units.fill(chain.from_iterable(parts))
        units, out = self.units, []
        for ps in parts:
            if len(ps) == 1:
                out.append(units[ps[0]])
            else:
                found = [units[p] for p in ps]
                out.append((",".join([i for i, _ in found]), "".join([t for _, t in found])))
        return out

    def check(self, text: str, ids: str, back: str) -> None:
        """Holds a whole text, its ids and what they decode to against the library."""
        want = self.lib.encode(text)
        if ids != ",".join(map(str, want)) or back != self.lib.decode(want):
            raise RuntimeError(f"the agenda and the library differ on a text that begins with {text[:80]!r}")

    def decode_ids(self, ids) -> str:
        """The text of ``ids`` with the space that stands first, each id by its piece; broken bytes become U+FFFD one by one."""
        out, run = [], bytearray()
        for i in ids:
            if (b := self.byte_of.get(i)) is not None:
                run.append(b)
                continue
            if run:
                out.append(_text(run))
                run.clear()
            out.append(self.shown[i])
        if run:
            out.append(_text(run))
        return "".join(out).replace(SPACE, " ")

    def decode(self, ids) -> str:
        return self.decode_ids(ids).removeprefix(" ")

    def run(self, text: str) -> tuple[str, str]:
        """Decimal ids joined by commas, and what they decode to."""
        if not text:
            return "", ""
        text = text.replace(SPACE, " ")
        words = text.split(" ") if "  " not in text and text[0] != " " else _words(text)
        self.words.fill(words)
        found = list(map(self.words.__getitem__, words))
        return ",".join([i for i, _ in found]), "".join([t for _, t in found]).removeprefix(" ")

    def encode_word(self, word: str) -> tuple[str, str]:
        """Decimal ids of a word and the space mark before it, joined by commas, and what they decode to."""
        return self.words.lookup([word])[0]

    def encode(self, text: str) -> list[int]:
        ids = self.run(text)[0]
        return [int(x) for x in ids.split(",")] if ids else []


def _words(text: str) -> list[str]:
    """What stands after each run of spaces, with all but the first space of its run."""
    return [m[0][1:] for m in re.finditer(f"{SPACE}+[^{SPACE}]*", (SPACE + text).replace(" ", SPACE))]


def _text(run: bytearray) -> str:
    """UTF-8 text; each byte that belongs to no character becomes U+FFFD."""
    try:
        return run.decode()
    except UnicodeDecodeError:
        out, k = [], 0
        while k < len(run):
            for n in (1, 2, 3, 4):
                try:
                    out.append(run[k : k + n].decode())
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("�")
                n = 1
            k += n
        return "".join(out)


def codec(model_path: str, verify: bool = True) -> PieceCodec:
    """One codec a Python worker, so that what it remembers serves all its tasks."""
    mine = store("sentencepiece")
    if (model_path, verify) not in mine:
        mine[model_path, verify] = PieceCodec(model_path, verify)
    return mine[model_path, verify]


def encode_documents(docs: DataFrame, model_path: str, keep_ids: bool = False, verify: bool = True) -> DataFrame:
    """Encodes the text of each row and decodes the ids again, batch by batch, with no shuffle.

    With ``verify`` every word that a worker first meets, and the first whole text of each Arrow batch, are held against
    the sentencepiece library, both ways; a difference raises.

    Returns doc_id, n_tokens long, ids_sha256 and decoded_sha256 (lowercase hex), with ``keep_ids`` also ids array<int> and
    decoded string. Null and empty texts: no ids and an empty decoded text. Repeated rows, null and equal doc_id: a row
    each, as given. Other columns of ``docs`` are left out, whatever their names. Memory: an Arrow batch and the memo.
    """
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * keep_ids

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c, sha = codec(model_path, verify), hashlib.sha256
        for batch in batches:
            n, ids_sha, back_sha, ids_all, back_all = [], [], [], [], []
            for k, text in enumerate(batch["text"]):
                ids, back = c.run(text)
                if verify and not k:
                    c.check(text, ids, back)
                n.append(ids.count(",") + 1 if ids else 0)
                ids_sha.append(sha(ids.encode()).hexdigest())
                back_sha.append(sha(back.encode()).hexdigest())
                if keep_ids:
                    ids_all.append([int(x) for x in ids.split(",")] if ids else [])
                    back_all.append(back)
            out = pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "n_tokens": n, "ids_sha256": ids_sha, "decoded_sha256": back_sha})
            yield out.assign(ids=ids_all, decoded=back_all) if keep_ids else out

    return texts(docs).mapInPandas(run, schema)


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
