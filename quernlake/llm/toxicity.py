"""Toxicity: a support vector machine on a gap-weighted subsequence string kernel with Nystroem landmarks."""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from sys import intern

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import Memo, fold, labelled, store, table, texts

LEARN_TOXIC, LEARN_CLEAN = 1500, 2500  # labelled rows to learn from, at most
SPAN, DECAY, LETTERS, START = 7, 0.85, 32, 27
BLAMED, GUILTY, INNOCENT, BENT, HARD = 8, 1500, 6000, 400, 2000  # words: of a toxic text, to learn from, of clean texts, with gaps, looked at again
SHORT, PAIR = 4, 1.4  # letters of words that may be parts of one; how much more guilty the whole must look
MARGIN = 0.1  # where between the clean texts and the toxic ones the border lies; low, for words with letters put in
SIZE = LETTERS**4  # numbers of letter quadruples
STRIP, MANY = 250, 20_000  # words taken at once: against the landmarks, and for their values
SPACED = re.compile(r"(?<!\S)(?:\S ){3,}\S(?!\S)")  # letters spaced out
AGAIN = re.compile(r"([^\n]{2,6}?)\1+")
LIKE = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}


def _lut() -> np.ndarray:
    """Letter classes: 1-26 for a-z with or without accents, digits that stand for letters, 28-31 other letters, else 0."""
    lut = np.zeros(0x10000, "uint8")
    for c in range(len(lut)):
        s = LIKE.get(chr(c)) or unicodedata.normalize("NFKD", chr(c).lower())[:1]
        lut[c] = ord(s) - 96 if "a" <= s <= "z" else 28 + c % 4 if s.isalpha() else 0
    return lut


LUT = _lut()


def codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Letter classes of all words, one after the other, each behind a start mark; the places of the marks.

    Marks between letters, however many, are left out, so that gaps are counted over letters only. Of a run of one
    character, two are left, of a syllable said again and again, one: else repeats would add up to guilt.
    """
    raw = np.frombuffer("\n".join(["", *words]).encode("utf-32-le", "surrogatepass"), "<u4")
    raw = raw[(LUT[np.minimum(raw, 0xFFFF)] > 0) | (raw == 10)]
    raw = np.frombuffer(AGAIN.sub(r"\1", raw.tobytes().decode("utf-32-le", "surrogatepass")).encode("utf-32-le", "surrogatepass"), "<u4")
    if len(raw) > 2:
        raw = raw[np.append([True, True], (raw[2:] != raw[1:-1]) | (raw[1:-1] != raw[:-2]) | (raw[2:] == 10))]
    out = LUT[np.minimum(raw, 0xFFFF)]
    starts = np.flatnonzero(raw == 10)
    out[starts] = START
    return out, starts


def subsequences(c: np.ndarray, starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """For each choice of gaps: places and numbers of the four-letter subsequences within a word, and their weight.

    The weight is DECAY to the power of the stretch spanned, SPAN + 1 places at most, as in the gap-weighted subsequence
    kernel; letters put in between lower it and don't break it. Numbers are 0 where a place holds no letter.
    """
    n = len(c)
    ends = np.repeat(np.append(starts[1:], n), np.diff(np.append(starts, n)))
    wide = c.astype("int32")
    room = ends - np.arange(n)
    for d in range(3, SPAN + 1):
        ok = np.flatnonzero((room > d) & (c > 0))
        ok = ok[c[ok + d] > 0]
        outer = (wide[ok] << 15) | wide[ok + d]
        for b in range(2, d):
            third = wide[ok + b]
            at = ok[third > 0]
            part = (outer | (third << 5))[third > 0]
            for a in range(1, b):
                second = wide[at + a]
                yield at, np.where(second > 0, part | (second << 10), 0), DECAY ** (d + 1)


def norms(c: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The norm that each word's row has with all its subsequences distinct."""
    out = np.zeros(len(c))
    for at, t, weight in subsequences(c, starts):
        out[at] += weight**2 * (t > 0)
    return np.sqrt(np.add.reduceat(out, starts) + 1e-12)


class Landmarks:
    """Explicit rows of the landmark words, over the subsequences that occur in them."""

    def __init__(self, words: list[str]):
        c, starts = codes(words)
        word = np.repeat(np.arange(len(words)), np.diff(np.append(starts, len(c))))
        found = [(word[at[t > 0]], t[t > 0], weight) for at, t, weight in subsequences(c, starts)]
        self.numbers = np.unique(np.concatenate([t for _, t, _ in found]))
        self.column = np.full(SIZE, -1, "int32")
        self.column[self.numbers] = np.arange(len(self.numbers))
        self.rows = np.zeros((len(words), len(self.numbers)))
        for w, t, weight in found:
            np.add.at(self.rows, (w, self.column[t]), weight)
        self.rows /= norms(c, starts)[:, None]

    def kernel(self, words: list[str]) -> np.ndarray:
        """k(word, landmark) for each word and landmark."""
        out = np.zeros((len(words), len(self.rows)))
        table = np.ascontiguousarray(self.rows.T, "float32")
        for k in range(0, len(words), STRIP):
            c, starts = codes(words[k : k + STRIP])
            word = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(c))))
            dense = np.zeros((len(starts), len(self.numbers)), "float32")
            for at, t, weight in subsequences(c, starts):
                col = self.column[t]
                hit = col >= 0
                np.add.at(dense, (word[at[hit]], col[hit]), weight)
            out[k : k + STRIP] = (dense @ table) / norms(c, starts)[:, None]
        return out


class Machine:
    """Decision values of words: sum of V over a word's subsequences, scaled, plus the offset.

    The Nystroem features of x are K^-1/2 k(landmarks, x), and k is an inner product of explicit rows, so a linear machine
    with weights w on these features is V = landmarks' K^-1/2 w on subsequences: one table to look up, whatever the number
    of landmarks. Only its cells that aren't 0 travel to the executors.
    """

    def __init__(self, numbers: np.ndarray, values: np.ndarray, offset: float, scale: tuple[float, float]):
        self.numbers, self.values, self.offset, self.scale = numbers, values.astype("float32"), offset, scale
        self._table: np.ndarray | None = None

    def __getstate__(self):
        return self.__dict__ | {"_table": None}

    def words(self, words: list[str]) -> list[float]:
        if not words:
            return []
        if len(words) > MANY:
            return [v for k in range(0, len(words), MANY) for v in self.words(words[k : k + MANY])]
        if self._table is None:
            self._table = np.zeros(SIZE, "float32")
            self._table[self.numbers] = self.values
        c, starts = codes(words)
        total, norm = np.zeros(len(c)), np.zeros(len(c))
        for at, t, weight in subsequences(c, starts):
            total[at] += weight * self._table[t]
            norm[at] += weight**2 * (t > 0)
        total, norm = np.add.reduceat(total, starts), np.add.reduceat(norm, starts)
        return (total / np.sqrt(norm + 1e-12) + self.offset).tolist()

    def key(self) -> bytes:
        return hashlib.sha256(self.values.tobytes() + self.numbers.tobytes() + repr((self.offset, self.scale)).encode()).digest()

    def probability(self, margin: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale[0] * margin + self.scale[1], -30, 30)))


def constant(p: float) -> Machine:
    return Machine(np.zeros(0, "int64"), np.zeros(0), 0.0, (0.0, float(np.log(p / (1 - p)))))


def units(text: str) -> list[str]:
    """The words of a text, and runs of letters that are spaced out, put together."""
    words = text.split()
    if len(text) > 6 and (found := SPACED.findall(text)):
        words += [x.replace(" ", "") for x in found]
    return words


def pairs(text: str) -> list[str]:
    """Neighbours of two to four letters, put together: they may be one word with a space in it."""
    words = text.split()
    short = [2 <= len(w) <= SHORT for w in words]
    return [a + b for a, b, x, y in zip(words, words[1:], short, short[1:]) if x and y]


def worst(machine: Machine, text: str, value=None) -> float:
    """The largest decision value of a text's words, and of its pairs less PAIR, which must look the more guilty."""
    value = value or (lambda words: machine.words(words))
    words = value(units(text) or [""])
    return max(max(words), max(value(pairs(text)), default=-9.0) - PAIR)


def _svm(z: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.1, rounds: int = 30) -> tuple[np.ndarray, float]:
    """Squared-hinge linear machine by finite Newton steps."""
    x = np.hstack([z, np.ones((len(z), 1))])
    w, held = np.zeros(x.shape[1]), None
    reg = np.eye(x.shape[1]) * ridge
    reg[-1, -1] = 1e-6
    for _ in range(rounds):
        active = y * (x @ w) < 1
        if held is not None and (active == held).all():
            break
        held = active
        xa = x[active] * weight[active, None]
        w = np.linalg.solve(xa.T @ x[active] + reg, xa.T @ y[active])
    return w[:-1], float(w[-1])


def _gapped(word: str, rng: np.random.Generator, n: int = 6) -> list[str]:
    """The word with marks between its letters, and ``n`` times with a letter put in somewhere, as insults are written to slip
    through."""
    if len(word) < 4:
        return []
    bent = ["-".join(word[:8]) + word[8:], word[:2] + "*" + word[2:]]
    for _ in range(n):
        at = int(rng.integers(1, len(word)))
        bent.append(word[:at] + "abcdefghijklmnopqrstuvwxyz"[int(rng.integers(26))] + word[at:])
    return bent


def learn(rows: list[tuple[str, int]], landmarks: int = 256, seed: int = 5, rounds: int = 3) -> Machine:
    """Learns from texts labelled toxic (1) or not (0); which words of a toxic text are to blame isn't labelled.

    At first the words with 4-letter pieces that stand in many toxic and few other texts are; then, as in multiple-instance
    learning, those of some such evidence that the machine holds guilty are, and it is trained again on them, on copies
    with gaps and inserted characters, and on the other texts' words, the most guilty looking included.
    """
    rng = np.random.default_rng(seed)
    once = lambda t: sorted({intern(w) for w in units(t)})  # noqa: E731  a word is kept once, however many texts have it
    toxic, clean = [once(t) for t, y in rows if y], [once(t) for t, y in rows if not y]
    if not toxic or not clean:
        p = (len(toxic) + 0.5) / (len(toxic) + len(clean) + 1)
        return constant(p)
    grams = lambda w: {x[i : i + 4] for x in ["^" + w.lower()] for i in range(max(1, len(x) - 3))}
    tox, non = Counter(), Counter()
    for words, count in ((toxic, tox), (clean, non)):
        for ws in words:
            count.update(set().union(*map(grams, ws)) if ws else ())
    strength = {g: np.log((n + 0.5) / (len(toxic) + 1)) - np.log((non[g] + 0.5) / (len(clean) + 1)) + min(0, n - 3) for g, n in tox.items()}
    guilt = lambda w: max((strength.get(g, -9.0) for g in grams(w)), default=-9.0)
    blamed = []
    for ws in toxic:
        rated = sorted(((guilt(w), w) for w in ws), reverse=True)
        blamed.append([w for s, w in rated if s > 3.5][:BLAMED])
    innocent = sorted({w for ws in clean for w in ws})
    known = set(innocent)
    pick = [innocent[k] for k in rng.permutation(len(innocent))[:INNOCENT]]
    hard: list[str] = []
    machine = None
    for _ in range(rounds):
        count = Counter(w for ws in blamed for w in ws if w not in known)
        guilty = [w for w, _ in count.most_common(GUILTY)]
        if not guilty:
            return machine or constant(0.01)
        marks = guilty[: landmarks // 2] + pick[: landmarks - landmarks // 2]
        lm = Landmarks(marks)
        val, vec = np.linalg.eigh(lm.rows @ lm.rows.T)
        root = vec / np.sqrt(np.maximum(val, 1e-3)) @ vec.T
        bent = [g for w in guilty[:BENT] for g in _gapped(w, rng)]
        instances = guilty + bent + pick + hard
        y = np.array([1.0] * (len(guilty) + len(bent)) + [-1.0] * (len(pick) + len(hard)))
        z = lm.kernel(instances) @ root
        many = np.array([min(count[w], 20) for w in guilty], float)
        share = np.concatenate([many, np.full(len(bent), 2 * many.sum() / max(len(bent), 1)), np.ones(len(pick) + len(hard))])
        weight = np.where(y > 0, share / share[y > 0].sum(), 2 * share / (y < 0).sum()) * 2000
        w, offset = _svm(z, y, weight)
        machine = Machine(lm.numbers, lm.rows.T @ (root @ w), offset, (1.0, 0.0))
        del lm, z
        value = np.array(machine.words(innocent))
        hard = sorted({innocent[k] for k in np.argsort(-value)[:HARD]})
        rated = [sorted(zip(machine.words(ws), ws), reverse=True) for ws in toxic]
        blamed = [[w for s, w in r if s > 0 and w not in known and guilt(w) > 2][:BLAMED] for r in rated]
    texts_ = [t for t, y in rows if y] + [t for t, y in rows if not y]
    found = np.array([worst(machine, t) for t in texts_])
    y = np.array([1] * len(toxic) + [0] * len(clean))
    order = np.sort(np.unique(found))
    cuts = (order[1:] + order[:-1]) / 2 if len(order) > 1 else order
    wrong = [int((found[y == 1] < c).sum() + 4 * (found[y == 0] >= c).sum()) for c in cuts]
    best = [c for c, n in zip(cuts, wrong) if n == min(wrong)]
    low, high = order[order < best[0]], order[order >= best[-1]]
    border = float(low[-1] + MARGIN * (high[0] - low[-1])) if len(low) and len(high) else float(best[0])
    machine.scale = (4.0, float(-4.0 * border))
    return machine


def margins(machine: Machine, key: bytes, docs: list[str]) -> np.ndarray:
    """The largest decision value in each text; for texts without words, that of an empty word."""
    mine = store("toxicity")
    if key not in mine:
        mine.clear()
        mine[key] = Memo(machine.words)
    memo, out = mine[key], []
    for k in range(0, len(docs), 64):
        parts, twos = [units(t) or [""] for t in docs[k : k + 64]], list(map(pairs, docs[k : k + 64]))
        memo.fill([w for ws in (*parts, *twos) for w in ws])
        get = memo.__getitem__
        out += [max(max(map(get, ws)), max(map(get, ps), default=-9.0) - PAIR) for ws, ps in zip(parts, twos)]
    return np.array(out)


def train_toxicity(docs: DataFrame, labels: DataFrame, toxic: int = LEARN_TOXIC, clean: int = LEARN_CLEAN) -> Machine:
    """Learns from at most ``toxic`` and ``clean`` labelled documents outside the fold crc32(doc_id) mod 5 = 0.

    The texts of that bounded sample come to the driver. Without rows of both classes all scores are alike.
    """
    got = labelled(docs, labels, "toxic", 5, 0, {1: toxic, 0: clean}).select("doc_id", "y", "text").collect()
    return learn([(r.text, r.y) for r in sorted(got, key=lambda r: r.doc_id)])


def score_toxicity(docs: DataFrame, machine: Machine) -> DataFrame:
    """Scores every whole text: doc_id, held_out, score, predicted (1 if score >= 0.5). No shuffle.

    A text is as toxic as its worst word. Null and empty texts are scored as a word without letters; null doc_id:
    held_out is false. Repeated rows: a row each. Other columns of ``docs`` are left out.
    """
    key = machine.key()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            score = machine.probability(margins(machine, key, batch["text"].tolist()))
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "score": score, "predicted": (score >= 0.5).astype("int32")})

    scored = texts(docs).mapInPandas(run, "doc_id long, score double, predicted int")
    return scored.select("doc_id", F.coalesce(fold(5) == 0, F.lit(False)).alias("held_out"), "score", "predicted")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_toxicity(docs, train_toxicity(docs, table(spark, sf_dir, "labels")))


def keep_clean(docs: DataFrame, machine: Machine) -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose whole text scores under 0.5."""
    key = machine.key()

    @F.pandas_udf("double")
    def score(text: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in text:
            yield pd.Series(machine.probability(margins(machine, key, batch.tolist())), dtype="float64")

    return docs.where(score(F.coalesce(F.col("text"), F.lit(""))) < 0.5)
