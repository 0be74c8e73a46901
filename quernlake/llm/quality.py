"""Quality classifier: histogram gradient-boosted trees over document statistics."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import fold, labelled, store, table, texts

LEARN_ROWS = 8000  # labelled rows of each class to learn from, at most
CLASSES = "other lower upper digit space newline period comma bang bar symbol".split()
FEATURES = (
    [f"share_{c}" for c in CLASSES]
    + "log_chars log_words mean_word longest_word distinct_words top_word caps_words title_words short_words distinct_lines log_lines".split()
    + "line_upper line_symbol line_bang line_bar line_digit entropy repeated_pairs".split()
)


def _lut() -> np.ndarray:
    lut = np.zeros(0x3000, "uint8")
    for c in range(len(lut)):
        s = chr(c)
        lut[c] = 1 if s.islower() else 2 if s.isupper() else 3 if s.isdigit() else 5 if s == "\n" else 4 if s.isspace() else 0
    for s, k in ((".", 6), (",", 7), ("!", 8), ("|", 9)):
        lut[ord(s)] = k
    for s in "#$%&*+<>=@[]\\^_`{}~/":
        lut[ord(s)] = 10
    return lut


LUT = _lut()


def statistics(text: str) -> np.ndarray:
    """The features of a whole text; zeros for an empty one."""
    store("quality")
    out = np.zeros(len(FEATURES), "float32")
    if not text:
        return out
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    kinds = LUT[np.minimum(codes, len(LUT) - 1)]
    n, k = len(codes), len(CLASSES)
    counts = np.bincount(kinds, minlength=k)
    out[:k] = counts / n
    words, lines = text.split(), text.split("\n")
    m = max(len(words), 1)
    seen = Counter(words)
    out[k : k + 11] = (
        np.log1p(n), np.log1p(len(words)), (n - counts[4] - counts[5]) / m, max(map(len, words), default=0), len(seen) / m, max(seen.values(), default=0) / m,
        sum(map(str.isupper, words)) / m, sum(map(str.istitle, words)) / m, sum(c for w, c in seen.items() if len(w) <= 3) / m, len(set(lines)) / len(lines), np.log1p(len(lines)),
    )
    ends = np.flatnonzero(kinds == 5)
    starts = np.concatenate([[0], ends[ends < n - 1] + 1])
    length = np.diff(np.concatenate([starts, [n]]))
    long = length >= 20
    for at, kind in enumerate((2, 10, 8, 9, 3)):
        share = np.add.reduceat((kinds == kind).astype("float32"), starts) / length
        out[k + 11 + at] = share[long].max() if long.any() else 0
    p = np.bincount(np.minimum(codes, 511)) / n
    p = p[p > 0]
    out[k + 16] = -(p * np.log(p)).sum()
    out[k + 17] = 1 - len(set(zip(words, words[1:]))) / max(len(words) - 1, 1)
    return out


class Forest:
    """Trees of equal depth in flat arrays: feature and cut of node k, children 2k+1 and 2k+2; leaves by their place."""

    def __init__(self, base: float, feature: np.ndarray, cut: np.ndarray, leaf: np.ndarray):
        self.base, self.feature, self.cut, self.leaf = base, feature, cut, leaf

    def margin(self, x: np.ndarray) -> np.ndarray:
        """All rows and trees step down together, a level at a time."""
        total = np.full(len(x), self.base)
        if not len(self.leaf) or not len(x):
            return total
        inner = self.feature.shape[1]
        tree, row = np.arange(len(self.leaf))[None, :], np.arange(len(x))[:, None]
        at = np.zeros((len(x), len(self.leaf)), "int64")
        for _ in range(int(np.log2(inner + 1))):
            at = 2 * at + 1 + (x[row, self.feature[tree, at]] > self.cut[tree, at])
        return total + self.leaf[tree, at - inner].sum(1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def grow(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 64, ridge: float = 2.0, least: float = 2.0) -> Forest:
    """Boosts ``trees`` trees on the logistic loss; splits are sought in histograms of gradients over quantile bins."""
    n, d = x.shape if x.ndim == 2 else (0, len(FEATURES))
    if not n or y.min() == y.max():
        p = (y.sum() + 0.5) / (n + 1) if n else 0.5
        return Forest(float(np.log(p / (1 - p))), np.zeros((0, 2**depth - 1), "int64"), np.zeros((0, 2**depth - 1)), np.zeros((0, 2**depth)))
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(d)]
    binned = np.stack([np.searchsorted(edges[j], x[:, j], "left") for j in range(d)], 1)
    base = float(np.log(y.mean() / (1 - y.mean())))
    f = np.full(n, base)
    inner = 2**depth - 1
    feature, cut, leaf = np.zeros((trees, inner), "int64"), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1))
    flat = binned + np.arange(d) * bins
    for t in range(trees):
        p = 1 / (1 + np.exp(-f))
        g, h = p - y, p * (1 - p)
        node = np.zeros(n, "int64")
        for level in range(depth):
            width = 2**level
            key = (node[:, None] * (d * bins) + flat).ravel()
            hist = [np.bincount(key, np.repeat(v, d), width * d * bins).reshape(width, d, bins).cumsum(2) for v in (g, h)]
            gl, hl = hist
            gt, ht = gl[:, :, -1:], hl[:, :, -1:]
            gain = gl**2 / (hl + ridge) + (gt - gl) ** 2 / (ht - hl + ridge) - gt**2 / (ht + ridge)
            gain[(hl < least) | (ht - hl < least)] = -1
            for j in range(d):
                gain[:, j, len(edges[j]) :] = -1
            best = gain.reshape(width, -1).argmax(1)
            right = np.zeros(n, "int64")
            for k in range(width):
                j, b = divmod(int(best[k]), bins)
                if gain[k, j, b] > 1e-6:
                    feature[t, width - 1 + k], cut[t, width - 1 + k] = j, edges[j][b]
                    mine = node == k
                    right[mine] = binned[mine, j] > b
            node = 2 * node + right
        gs, hs = np.bincount(node, g, inner + 1), np.bincount(node, h, inner + 1)
        leaf[t] = -rate * gs / (hs + ridge)
        f += leaf[t][node]
    return Forest(base, feature, cut, leaf)


def features(docs: DataFrame) -> DataFrame:
    """doc_id, y (if there is one) and the statistics of each whole text as x array<float>."""
    more = ["y"] if "y" in docs.columns else []

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = batch.drop(columns="text").assign(x=[statistics(t) for t in batch["text"]])
            yield out.assign(doc_id=out["doc_id"].astype("Int64"))

    return texts(docs, *more).mapInPandas(run, "doc_id long, " + "y int, " * len(more) + "x array<float>")


def train_quality(docs: DataFrame, labels: DataFrame, rows: int = LEARN_ROWS) -> Forest:
    """Learns from at most ``rows`` labelled documents of either class, outside the fold crc32(doc_id) mod 4 = 2.

    Only their statistics come to the driver. Without labels all scores are 0.5; with one class they are near it.
    """
    got = features(labelled(docs, labels, "quality", 4, 2, {0: rows, 1: rows})).toPandas().sort_values("doc_id")
    y = got["y"].to_numpy("float64")
    return grow(np.stack(got["x"].to_list()).astype("float64") if len(got) else np.zeros((0, len(FEATURES))), y)


def score_quality(docs: DataFrame, forest: Forest, threshold: float = 0.7) -> DataFrame:
    """Scores every whole text: doc_id, held_out, score, predicted (1 if score >= ``threshold``). No shuffle.

    Null and empty texts are scored by the statistics of an empty text; null doc_id: held_out is false. Repeated rows: a
    row each. Other columns of ``docs`` are left out.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = np.stack([statistics(t) for t in batch["text"]]).astype("float64") if len(batch) else np.zeros((0, len(FEATURES)))
            score = np.concatenate([forest.score(x[k : k + 1024]) for k in range(0, len(x), 1024)]) if len(x) else np.zeros(0)
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "score": score, "predicted": (score >= threshold).astype("int32")})

    scored = texts(docs).mapInPandas(run, "doc_id long, score double, predicted int")
    return scored.select("doc_id", F.coalesce(fold(4) == 2, F.lit(False)).alias("held_out"), "score", "predicted")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_quality(docs, train_quality(docs, table(spark, sf_dir, "labels")))


def keep_good(docs: DataFrame, forest: Forest, threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose whole text scores at least ``threshold``."""

    @F.pandas_udf("double")
    def score(text: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in text:
            x = [forest.score(np.stack([statistics(t) for t in batch.iloc[k : k + 1024]]).astype("float64")) for k in range(0, len(batch), 1024)]
            yield pd.Series(np.concatenate(x) if x else [], dtype="float64")

    return docs.where(score(F.coalesce(F.col("text"), F.lit(""))) >= threshold)
