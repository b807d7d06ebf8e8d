"""Quality classifier: an additive model with pairwise interactions.

Shallow trees, boosted over one feature (or one pair of features) after the
other, add up to one lookup table per feature and per pair.  A document's
score is the sum of the table cells that its features fall into.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as K
from .common import cut, map_arrow

#: Most labelled rows that the model is fitted on; those with the least hash of doc_id are taken.
MAX_TRAIN = 20_000
BINS, PAIR_BINS, PAIRS, ROUNDS, PAIR_ROUNDS, RATE = 32, 8, 6, 120, 40, 0.15
#: A word tells of toxicity if so many training documents have it and its odds among toxic ones are so much higher.
WORD_SUPPORT, WORD_LOG_ODDS = 5, 2.0
QUALITY_AT_LEAST, TOXIC_BELOW = 0.5, 0.5

_U = np.uint64
_ROW_BITS = 20
FEATURES = ["words", "word_length", "symbols", "shouts", "digits", "upper", "blank", "distinct", "again", "bigrams", "per_line", "stops", "bars", "other", "toxic_most", "toxic_sum"]


def _class(chars: str | bytes) -> np.ndarray:
    t = np.zeros(256, bool)
    t[list(chars.encode() if isinstance(chars, str) else chars)] = True
    return t


_SYMBOL, _SHOUT, _DIGIT, _UPPER = _class("#$%&*@^~<>{}=+_\\/[]"), _class("!?"), _class("0123456789"), _class(bytes(range(65, 91)))
_STOP, _BAR, _OTHER, _LINE = _class("."), _class("|"), _class(bytes(range(128, 192))), _class("\n")


def _word_keys(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each folded word, the row it is in, and the words' total bytes per row."""
    low = K.fold(buf)
    s, e = K.words(low, offs)
    counts = K.counts_per_row(s, offs)
    row = np.repeat(np.arange(len(offs) - 1), counts)
    return K.span_hashes(low, s, e), row, np.bincount(row, e - s, minlength=len(offs) - 1)


def _distinct(keys: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, key) pairs as the row of each and the 44 bits of its key."""
    keep = _U(64 - _ROW_BITS)
    x = np.sort((row.astype(_U) << keep) | (keys >> _U(_ROW_BITS)))
    if len(x):
        x = x[np.concatenate(([True], x[1:] != x[:-1]))]
    return (x >> keep).astype(np.int64), x & _U((1 << (64 - _ROW_BITS)) - 1)


def _rows(buf: np.ndarray, offs: np.ndarray):
    """Slices of a batch: (first row, end row, its bytes, its offsets)."""
    for lo, hi in K.slices(offs):
        for a in range(lo, hi, 1 << _ROW_BITS):
            b = min(hi, a + (1 << _ROW_BITS))
            yield a, b, buf[offs[a] : offs[b]], offs[a : b + 1] - offs[a]


def features(texts: pa.Array, words: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """One row of FEATURES for each text; words: sorted 44-bit keys of telling words."""
    buf, offs = K.raw(texts)
    out = np.zeros((len(offs) - 1, len(FEATURES)))
    for a, b, part, o in _rows(buf, offs):
        n = b - a
        size = np.maximum(np.diff(o), 1)
        share = lambda t: K.segment_sum(t[part].astype(np.int32), o) / size
        keys, row, word_bytes = _word_keys(part, o)
        m = np.bincount(row, minlength=n)
        m1 = np.maximum(m, 1)
        same = row[1:] == row[:-1]
        drow, dkey = _distinct(keys, row, n)
        pair = K.mix(keys[:-1] * _U(0x9E3779B97F4A7C15) + keys[1:])[same] if len(keys) > 1 else keys[:0]
        prow = row[1:][same] if len(keys) > 1 else row[:0]
        brow, _ = _distinct(pair, prow, n)
        f = out[a:b]
        f[:, 0] = np.log1p(m)
        f[:, 1] = word_bytes / m1
        for j, t in ((2, _SYMBOL), (3, _SHOUT), (4, _DIGIT), (5, _UPPER), (6, K.BLANK), (11, _STOP), (12, _BAR), (13, _OTHER)):
            f[:, j] = share(t)
        f[:, 7] = np.bincount(drow, minlength=n) / np.sqrt(m1)
        if len(keys) > 1:
            f[:, 8] = np.bincount(row[1:][same & (keys[1:] == keys[:-1])], minlength=n) / m1
        f[:, 9] = np.bincount(brow, minlength=n) / np.maximum(np.bincount(prow, minlength=n), 1)
        f[:, 10] = np.log1p(m / (share(_LINE) * size + 1))
        if len(words):
            at = np.minimum(np.searchsorted(words, dkey), len(words) - 1)
            hit = words[at] == dkey
            np.maximum.at(f[:, 14], drow[hit], weights[at[hit]])
            f[:, 15] = np.bincount(drow[hit], weights[at[hit]], minlength=n)
    return out


@dataclass
class Model:
    """Bin edges, and the tables that the bins index."""

    base: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log odds of each row."""
        total = np.full(len(x), self.base)
        for j, (edge, table) in enumerate(zip(self.edges, self.tables)):
            total += table[np.searchsorted(edge, x[:, j], side="right")]
        for i, j, ei, ej, table in self.pairs:
            total += table[np.searchsorted(ei, x[:, i], side="right"), np.searchsorted(ej, x[:, j], side="right")]
        return total

    def probability(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.score(x))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))


def _edges(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1], method="higher"))


def _cut_gain(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """Best cut of ordered bins in two: its gain, and the first bin of the right part."""
    if len(g) < 2:
        return 0.0, 0
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gt, ht = g.sum(), h.sum()
    gain = gl**2 / (hl + 1) + (gt - gl) ** 2 / (ht - hl + 1) - gt**2 / (ht + 1)
    at = int(np.argmax(gain))
    return float(gain[at]), at + 1


def _tree(g: np.ndarray, h: np.ndarray, leaves: int = 4) -> np.ndarray:
    """Leaf value of each bin in a tree that is grown by its best cuts."""
    parts = [(0, len(g))]
    while len(parts) < leaves:
        gains = [(*_cut_gain(g[a:b], h[a:b]), a, b) for a, b in parts]
        gain, at, a, b = max(gains)
        if gain <= 1e-9:
            break
        parts.remove((a, b))
        parts += [(a, a + at), (a + at, b)]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + 1)
    return out


def _pair_tree(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Tree of depth two on a grid of bins, a cut of one feature and then of the other in either part."""
    best = (0.0, np.zeros_like(g))
    for turn in (False, True):
        gg, hh = (g.T, h.T) if turn else (g, h)
        whole = gg.sum() ** 2 / (hh.sum() + 1)
        for at in range(1, len(gg)):
            parts = [(rows, gg[rows].sum(0), hh[rows].sum(0)) for rows in (slice(0, at), slice(at, None))]
            cuts = [_cut_gain(gs, hs) for _, gs, hs in parts]
            gain = sum(c + gs.sum() ** 2 / (hs.sum() + 1) for (c, _), (_, gs, hs) in zip(cuts, parts)) - whole
            if gain > best[0]:
                out = np.zeros_like(gg)
                for (_, c), (rows, gs, hs) in zip(cuts, parts):
                    for cols in (slice(0, c), slice(c, None)):
                        if len(gs[cols]):
                            out[rows, cols] = gs[cols].sum() / (hs[cols].sum() + 1)
                best = (gain, out.T if turn else out)
    return best


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """Boost the tables; without rows of both classes the score is constant."""
    n, k = x.shape
    none = np.zeros(0)
    if n == 0 or y.min() == y.max():
        return Model(40.0 * (1 if n and y[0] else -1), [none] * k, [np.zeros(1)] * k, [])
    base = float(np.log(y.mean() / (1 - y.mean())))
    edges = [_edges(x[:, j], BINS) for j in range(k)]
    bins = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(edges)]
    tables = [np.zeros(len(e) + 1) for e in edges]
    z = np.full(n, base)
    for _ in range(ROUNDS):
        for j in range(k):
            p = _sigmoid(z)
            step = RATE * _tree(np.bincount(bins[j], y - p, len(tables[j])), np.bincount(bins[j], p * (1 - p), len(tables[j])))
            tables[j] += step
            z += step[bins[j]]
    coarse = [_edges(x[:, j], PAIR_BINS) for j in range(k)]
    cells = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(coarse)]

    def grid(i: int, j: int, v: np.ndarray) -> np.ndarray:
        a, b = len(coarse[i]) + 1, len(coarse[j]) + 1
        return np.bincount(cells[i] * b + cells[j], v, a * b).reshape(a, b)

    p = _sigmoid(z)
    gains = sorted(((_pair_tree(grid(i, j, y - p), grid(i, j, p * (1 - p)))[0], i, j) for i in range(k) for j in range(i)), reverse=True)[:PAIRS]
    pairs = [(i, j, coarse[i], coarse[j], np.zeros((len(coarse[i]) + 1, len(coarse[j]) + 1))) for gain, i, j in gains if gain > 0]
    for _ in range(PAIR_ROUNDS):
        for i, j, _, _, table in pairs:
            p = _sigmoid(z)
            step = RATE * _pair_tree(grid(i, j, y - p), grid(i, j, p * (1 - p)))[1]
            table += step
            z += step[cells[i], cells[j]]
    return Model(base, edges, tables, pairs)


@dataclass
class Classifier:
    words: np.ndarray
    weights: np.ndarray
    quality: Model
    toxic: Model

    def judge(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Probability of quality, of toxicity, and whether the text is accepted."""
        x = features(texts, self.words, self.weights)
        q, t = self.quality.probability(x), self.toxic.probability(x)
        return q, t, (q >= QUALITY_AT_LEAST) & (t < TOXIC_BELOW)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_train: int = MAX_TRAIN) -> Classifier:
    """Fit on at most max_train labelled documents.

    Labels without doc_id, quality or toxic are left out; of rows that repeat
    a doc_id each counts.  Without any labels everything is accepted.
    """
    some = labels.select(F.col("doc_id").alias("i"), F.col("quality").cast("int").alias("q"), F.col("toxic").cast("int").alias("t")).na.drop()
    some = some.orderBy(F.xxhash64("i"), "i", "q", "t").limit(max_train)
    d = docs.select(F.col(id_col).alias("i"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    # at most max_train narrow rows
    sample = cut(d.join(F.broadcast(some), "i").select("text", "q", "t"), "quality-sample")

    def count(b: pa.RecordBatch) -> pa.RecordBatch:
        buf, offs = K.raw(b.column("text"))
        toxic = b.column("t").to_numpy() > 0
        keys, pos = [], []
        for a, z, part, o in _rows(buf, offs):
            h, row, _ = _word_keys(part, o)
            drow, dkey = _distinct(h, row, z - a)
            keys.append(dkey)
            pos.append(toxic[a:z][drow])
        key, at = np.unique(np.concatenate(keys), return_inverse=True)
        p = np.bincount(at, np.concatenate(pos), len(key)).astype(np.int64)
        m = np.bincount(at, minlength=len(key)).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(p), pa.array(m)], ["w", "pos", "n"])

    n, n_pos = (int(v or 0) for v in sample.agg(F.count("*"), F.sum((F.col("t") > 0).cast("long"))).first())
    words, weights = np.zeros(0, _U), np.zeros(0)
    if 0 < n_pos < n:
        c = map_arrow(sample, count, "w long, pos long, n long").groupBy("w").agg(F.sum("pos").alias("pos"), F.sum("n").alias("n"))
        odds = F.log(((F.col("pos") + 0.5) / (n_pos + 1)) / ((F.col("n") - F.col("pos") + 0.5) / (n - n_pos + 1)))
        told = c.where(F.col("pos") >= WORD_SUPPORT).select("w", odds.alias("o")).where(F.col("o") >= WORD_LOG_ODDS).orderBy("w").toPandas()
        words, weights = told["w"].to_numpy().astype(np.int64).view(_U), told["o"].to_numpy(float)

    def shape(b: pa.RecordBatch) -> pa.RecordBatch:
        x = features(b.column("text"), words, weights)
        flat = pa.array(x.ravel())
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), flat)
        return pa.RecordBatch.from_arrays([lists, b.column("q"), b.column("t")], ["x", "q", "t"])

    got = map_arrow(sample, shape, "x array<double>, q int, t int").toPandas()
    x = np.stack(got["x"].to_list()) if len(got) else np.zeros((0, len(FEATURES)))
    order = np.lexsort((*x.T, got["q"], got["t"])) if len(got) else np.zeros(0, int)
    x, q, t = x[order], got["q"].to_numpy(float)[order] > 0, got["t"].to_numpy(float)[order] > 0
    quality = fit(x, q.astype(float))
    if not len(x):
        quality.base = 40.0
    return Classifier(words, weights, quality, fit(x, t.astype(float)))


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_train: int = MAX_TRAIN) -> DataFrame:
    """doc_id, quality and toxic (probabilities) and keep, a row for each row of docs.

    A document is kept if quality >= 0.5 and toxic < 0.5.  The features read
    the whole text.  Null text counts as empty; empty texts get the score of
    their features like any other; null and repeated ids are scored row by row.
    """
    model = train(docs, labels, id_col, text_col, max_train)

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        q, t, keep = model.judge(b.column("text"))
        return pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(q), pa.array(t), pa.array(keep)], ["doc_id", "quality", "toxic", "keep"])

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return map_arrow(src, run, "doc_id long, quality double, toxic double, keep boolean")


def accept(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_train: int = MAX_TRAIN) -> DataFrame:
    """The rows of docs that the classifier keeps, with all their columns."""
    model = train(docs, labels, id_col, text_col, max_train)
    at = docs.columns.index(text_col)

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        return b.filter(pa.array(model.judge(b.column(at).cast(pa.string()))[2]))

    return map_arrow(docs, run, docs.schema)
