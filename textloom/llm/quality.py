"""Quality classifier: a generalised additive model with pairwise interactions.

Text statistics are cut into quantile bins. Cyclic boosting gives every feature a lookup table over its bins:
round after round, each feature in turn gets a shallow tree fitted to the gradient's histogram, added to its
table at a small rate. Then the pairs of features that explain most of what is left get two-dimensional
tables in the same way. A document's score is a sum of table entries.

The model is trained on at most ``max_train`` labelled documents, those whose identifiers have the smallest
hashes; every document is scored, whole.

Defined results: null text counts as empty, and empty or blank text is rejected with score 0; of several labels
for a document the mean decides; without labels, or with labels of one class, all other text is kept with that
class's share as its score; repeated rows are scored alike; other columns pass through untouched.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import ID, TEXT, WORD, chunks, flat, grams, narrow, tokens

MAX_TRAIN = 20_000
THRESHOLD = 0.5

# byte classes: 0 other, 1 lower, 2 upper, 3 digit, 4 blank, 5 newline, 6 sentence marks, 7 symbols, 8 beyond ASCII
_CLASS = np.zeros(256, np.uint8)
for _k, _s in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t", b"\n\r", b".,;:'\"?()-", b"!#$%&*+/<=>@[\\]^_`{|}~"), 1):
    _CLASS[list(_s)] = _k
_CLASS[128:] = 8
_LINE = np.ones(256, bool)
_LINE[10] = False
NAMES = ["words", "word_len", "long_word", "short_words", "upper", "digits", "marks", "symbols", "foreign", "blanks", "lines", "line_distinct", "word_distinct", "top_word", "trigram_distinct", "bare_marks"]


def _spread(h: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each text, the number of different hashes and the count of the most frequent."""
    distinct, top = np.zeros(n), np.zeros(n)
    if len(h):
        code = np.sort((doc.astype(np.uint64) << np.uint64(40)) | (h >> np.uint64(24)))
        at = np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1])))
        run = np.diff(np.append(at, len(code)))
        own = (code[at] >> np.uint64(40)).astype(np.int64)
        distinct = np.bincount(own, minlength=n).astype(float)
        head = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
        top[own[head]] = np.maximum.reduceat(run, head)
    return distinct, top


def _features(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    n = len(offsets) - 1
    size = np.diff(offsets)
    row = np.repeat(np.arange(n), size)
    c = np.bincount(row * 9 + _CLASS[values], minlength=9 * n).reshape(n, 9).astype(float)
    h, first, start, end = tokens(values, offsets, WORD)
    words = np.diff(first)
    own = np.repeat(np.arange(n), words)
    w = np.maximum(words, 1)
    b = np.maximum(size, 1)
    wl = end - start
    distinct, top = _spread(h, own, n)
    g, gd = grams(h, first, 3)
    tri, _ = _spread(g, gd, n)
    lh, lf, _, _ = tokens(values, offsets, _LINE)
    lines = np.diff(lf)
    ld, _ = _spread(lh, np.repeat(np.arange(n), lines), n)
    # words without a letter or digit
    text = np.isin(_CLASS, (1, 2, 3, 8))[values]
    have = np.concatenate(([0], np.cumsum(text)))
    bare = np.bincount(own, weights=(have[end] == have[start]) if len(h) else None, minlength=n) if len(h) else np.zeros(n)
    letters = np.maximum(c[:, 1] + c[:, 2] + c[:, 8], 1)
    mean = lambda x: np.bincount(own, weights=x, minlength=n) / w if len(h) else np.zeros(n)
    return np.column_stack([np.log1p(words), mean(wl), mean(wl > 20), mean(wl <= 3), c[:, 2] / letters, c[:, 3] / b, c[:, 6] / b, c[:, 7] / b, c[:, 8] / b, (c[:, 4] + c[:, 5]) / b, lines / w, ld / np.maximum(lines, 1), distinct / w, top / w, tri / np.maximum(np.maximum(words - 2, 0), 1), bare / w])


def features(texts: pa.Array) -> np.ndarray:
    """One row of statistics (``NAMES``) per text, over the whole text."""
    parts = [np.zeros((0, len(NAMES)))]
    for i, j in chunks(texts):
        parts.append(_features(*flat(texts.slice(i, j - i))))
    return np.concatenate(parts)


@dataclass
class Model:
    edges: list[np.ndarray] = field(default_factory=list)
    base: float = 0.0
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(e, x[:, j], "right") for j, e in enumerate(self.edges)]) if self.edges else np.zeros((len(x), 0), int)

    def margin(self, x: np.ndarray) -> np.ndarray:
        b = self.bins(x)
        out = np.full(len(x), self.base)
        for j, t in enumerate(self.tables):
            out += t[b[:, j]]
        for i, j, t in self.pairs:
            out += t[b[:, i], b[:, j]]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def _split(g: np.ndarray, h: np.ndarray, lam: float) -> tuple[float, int]:
    """Best cut of a histogram in two: (gain, first bin of the right part), 0 if there is none."""
    G, H = np.cumsum(g), np.cumsum(h)
    if len(g) < 2:
        return 0.0, 0
    gain = G[:-1] ** 2 / (H[:-1] + lam) + (G[-1] - G[:-1]) ** 2 / (H[-1] - H[:-1] + lam) - G[-1] ** 2 / (H[-1] + lam)
    k = int(np.argmax(gain))
    return float(gain[k]), k + 1


def _tree(g: np.ndarray, h: np.ndarray, depth: int, lam: float) -> np.ndarray:
    """Leaf values, over the bins, of a tree that cuts the histogram ``depth`` levels deep."""
    gain, k = _split(g, h, lam) if depth else (0.0, 0)
    if gain <= 1e-12:
        return np.full(len(g), -g.sum() / (h.sum() + lam))
    return np.concatenate([_tree(g[:k], h[:k], depth - 1, lam), _tree(g[k:], h[k:], depth - 1, lam)])


def _tree2(g: np.ndarray, h: np.ndarray, lam: float) -> tuple[np.ndarray, float]:
    """The same over a grid: the best of all trees with one cut on each axis (their four leaves), and its gain. Both cuts are
    sought together, since a pure interaction shows in neither axis alone."""
    n, m = g.shape
    if n < 2 or m < 2:
        return np.full(g.shape, -g.sum() / (h.sum() + lam)), g.sum() ** 2 / (h.sum() + lam)

    def quarters(x):
        c = x.cumsum(0).cumsum(1)
        a = c[:-1, :-1]
        left, top = c[:-1, -1:] - a, c[-1:, :-1] - a
        return np.stack([a, left, top, c[-1, -1] - a - left - top])

    G, H = quarters(g), quarters(h)
    gain = (G**2 / (H + lam)).sum(0)
    i, j = np.unravel_index(int(np.argmax(gain)), gain.shape)
    leaf = -G[:, i, j] / (H[:, i, j] + lam)
    out = np.empty(g.shape)
    out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = leaf
    return out, float(gain[i, j])


def fit(x: np.ndarray, y: np.ndarray, bins: int = 32, rounds: int = 60, rate: float = 0.2, depth: int = 2, n_pairs: int = 6, pair_rounds: int = 20, lam: float = 1.0) -> Model:
    """Boost the tables of all features, then of the ``n_pairs`` strongest pairs, on the logistic loss."""
    share = float(y.mean()) if len(y) else 1.0
    m = Model(base=float(np.log(max(share, 1e-4) / max(1 - share, 1e-4))))
    if len(y) == 0 or share in (0.0, 1.0):
        return m
    m.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    b = m.bins(x)
    size = [len(e) + 1 for e in m.edges]
    m.tables = [np.zeros(s) for s in size]
    f = np.full(len(y), m.base)

    def loss():
        p = 1 / (1 + np.exp(-f))
        return p - y, p * (1 - p)

    for _ in range(rounds):
        for j, s in enumerate(size):
            g, h = loss()
            t = rate * _tree(np.bincount(b[:, j], g, s), np.bincount(b[:, j], h, s), depth, lam)
            m.tables[j] += t
            f += t[b[:, j]]

    def grid(i, j):
        g, h = loss()
        code, n = b[:, i] * size[j] + b[:, j], size[i] * size[j]
        return np.bincount(code, g, n).reshape(size[i], size[j]), np.bincount(code, h, n).reshape(size[i], size[j]), code

    gains = sorted(((_tree2(*grid(i, j)[:2], lam)[1], i, j) for i in range(len(size)) for j in range(i)), reverse=True)
    m.pairs = [(i, j, np.zeros((size[i], size[j]))) for _, i, j in gains[:n_pairs]]
    for _ in range(pair_rounds):
        for i, j, table in m.pairs:
            g, h, code = grid(i, j)
            t = rate * _tree2(g, h, lam)[0]
            table += t
            f += t.ravel()[code]
    return m


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_train: int = MAX_TRAIN) -> Model:
    """Fit the model on at most ``max_train`` labelled documents."""
    lab = labels.select(F.col(f"`{id_col}`").cast("long").alias("k"), F.col(f"`{label_col}`").cast("double").alias("y")).dropna()
    lab = lab.groupBy("k").agg(F.round(F.avg("y")).alias("y")).orderBy(F.xxhash64("k"), "k").limit(max_train)
    # bounded by max_train rows of 16 bytes
    got = narrow(docs, id_col, text_col).where(F.col(TEXT).isNotNull()).join(F.broadcast(lab), F.col(ID) == F.col("k"))

    def run(batches):
        for b in batches:
            x = features(b.column(0))
            yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float64())), b.column(1), b.column(2)], names=["x", "y", "o"])

    rows = got.select(TEXT, "y", F.xxhash64(TEXT, ID).alias("o")).mapInArrow(run, "x array<double>, y double, o long").toArrow()
    order = np.argsort(rows["o"].to_numpy(), kind="stable")[:max_train]
    x = np.array(rows["x"].to_pylist(), float).reshape(-1, len(NAMES))
    return fit(x[order], rows["y"].to_numpy()[order])


def scorer(model: Model):
    """Column function: text -> the model's probability that it is good."""

    @F.arrow_udf("double")
    def score(text: pa.Array) -> pa.Array:
        x = features(text)
        return pa.array(np.where(x[:, 0] > 0, model.score(x), 0.0))

    return score


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, max_train: int = MAX_TRAIN) -> DataFrame:
    """(doc_id, score, keep) of every document."""
    score = scorer(train(docs, labels, id_col, text_col, max_train=max_train))
    d = narrow(docs, id_col, text_col).select(F.col(ID).alias("doc_id"), score(F.col(TEXT)).alias("score"))
    return d.select("doc_id", F.round("score", 6).alias("score"), (F.col("score") >= threshold).alias("keep"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, max_train: int = MAX_TRAIN) -> DataFrame:
    """``docs`` without those the classifier rejects; the columns stay as they are."""
    score: Column = scorer(train(docs, labels, id_col, text_col, max_train=max_train))(F.col(f"`{text_col}`").cast("string"))
    return docs.where(score >= threshold)
