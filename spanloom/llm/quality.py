"""Quality by a generalised additive model with pairwise interactions.

Each feature is cut into bins and has a table of one value per bin; chosen pairs of features have a coarse table of their own.
The tables are learned by cyclic boosting: in turn, each feature gets a shallow tree fitted to the current gradient, scaled and
added to its table. A score is the sigmoid of a sum of table entries. Fitted in numpy on at most ``ROWS`` labelled rows;
scoring is a map without shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import Spans, Words, by_batch, fold, labelled, scored, sigmoid, steps

ROWS = 20_000
BINS, GRID = 32, 8
ROUNDS, PAIR_ROUNDS, RATE, PAIRS = 150, 60, 0.1, 6
LEAVES, LEAST = 4, 10.0

FEATURES = ("bytes", "word_length", "words", "blanks", "stops", "symbols", "digits", "upper", "lines", "sentence", "distinct",
            "stutter", "short", "long", "pairs", "top", "wide", "same_lines", "symbol_runs")


def _class(chars: str | bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars.encode() if isinstance(chars, str) else chars)] = True
    return out


STOPS, DIGITS, UPPER, BLANKS = _class(".,;:!?'\"()-"), _class("0123456789"), _class(bytes(range(65, 91))), _class(" \t\n\r\x0b\x0c")
SYMBOLS = _class(bytes(b for b in range(33, 127) if not chr(b).isalnum())) & ~STOPS


def _each(mask: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Number of set entries in each stretch."""
    total = np.concatenate([[0], np.cumsum(mask)])
    return (total[offs[1:]] - total[offs[:-1]]).astype(float)


def _repeats(owner: np.ndarray, key: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each owner: number of distinct keys, count of the most frequent one."""
    order = np.lexsort((key, owner))
    o, k = owner[order], key[order]
    head = np.flatnonzero(np.r_[True, (o[1:] != o[:-1]) | (k[1:] != k[:-1])]) if len(o) else np.zeros(0, int)
    top = np.zeros(n)
    np.maximum.at(top, o[head], np.diff(np.r_[head, len(o)]))
    return np.bincount(o[head], minlength=n).astype(float), top


def features(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """One row of ``FEATURES`` per text."""
    n, size = len(offs) - 1, np.diff(offs).astype(float)
    w = Words(buf, offs)
    words, owner, length = np.diff(w.bounds).astype(float), w.owner(), w.end - w.start
    some, any_word = np.maximum(size, 1), np.maximum(words, 1)
    symbol = SYMBOLS[buf]
    distinct, top = _repeats(owner, w.hash, n)
    two = w.windows(2)
    pairs, _ = _repeats(owner[two], Spans(w.hash, 1).hash(two, two + 2), n)
    line = buf == 10
    heads = np.unique(np.concatenate([offs[:-1][size > 0], np.flatnonzero(line) + 1]))
    heads = heads[heads < len(buf)]
    ends = np.r_[heads[1:], len(buf)][: len(heads)]
    line_owner = np.searchsorted(offs, heads, "right") - 1
    lines = np.bincount(line_owner, minlength=n).astype(float)
    kinds, _ = _repeats(line_owner, Spans(buf.astype(np.uint64) + np.uint64(1)).hash(heads, ends), n)
    run = symbol.copy()
    run[1:] &= symbol[:-1]
    run[:1] = False
    by_word = lambda mask: np.bincount(owner, mask, minlength=n) / any_word
    return np.stack([
        np.log1p(size), np.bincount(owner, length, minlength=n) / any_word, _each(w.low != 0, offs) / some, _each(BLANKS[buf], offs) / some,
        _each(STOPS[buf], offs) / some, _each(symbol, offs) / some, _each(DIGITS[buf], offs) / some, _each(UPPER[buf], offs) / some,
        _each(line, offs) / some, words / (_each(_class(".!?")[buf], offs) + 1), distinct / any_word,
        np.bincount(owner[two], w.hash[two] == w.hash[two + 1], minlength=n) / any_word, by_word(length <= 3), by_word(length > 12),
        pairs / np.maximum(words - 1, 1), top / any_word, _each(buf >= 128, offs) / some, kinds / np.maximum(lines, 1), _each(run, offs) / some,
    ], 1)


@dataclass
class Model:
    bias: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: np.ndarray | None = None
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], "right") for j, e in enumerate(self.edges)], 1)

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.bias)
        if self.tables is None:
            return out
        b = self.bins(x)
        for j in range(b.shape[1]):
            out += self.tables[j, b[:, j]]
        for i, j, t in self.pairs:
            out += t[coarse(b[:, i]), coarse(b[:, j])]
        return out

    def score(self, texts: pa.Array) -> np.ndarray:
        out = np.zeros(len(texts))
        for lo, hi, buf, offs in steps(texts):
            out[lo:hi] = sigmoid(self.raw(features(buf, offs)))
        return out


def coarse(b: np.ndarray) -> np.ndarray:
    return b * GRID // BINS


def tree(g: np.ndarray, h: np.ndarray, leaves: int = LEAVES) -> np.ndarray:
    """Values of a greedy regression tree of few leaves over ordered bins, from the sums of gradients and weights in each."""
    cg, ch = np.r_[0, np.cumsum(g)], np.r_[0, np.cumsum(h)]
    parts = [(0, len(g))]
    worth = lambda a, z: (cg[z] - cg[a]) ** 2 / (ch[z] - ch[a] + 1)
    while len(parts) < leaves:
        best = (1e-9, None, None)
        for p, (a, z) in enumerate(parts):
            at = np.arange(a + 1, z)
            if len(at):
                gain = worth(a, at) + worth(at, z) - worth(a, z)
                gain[(ch[at] - ch[a] < LEAST / 4) | (ch[z] - ch[at] < LEAST / 4)] = 0
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (gain[k], p, int(at[k]))
        if best[1] is None:
            break
        a, z = parts.pop(best[1])
        parts += [(a, best[2]), (best[2], z)]
    out = np.zeros(len(g))
    for a, z in parts:
        out[a:z] = (cg[z] - cg[a]) / (ch[z] - ch[a] + 1)
    return out


def pair_tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The best tree of depth two over a grid: a cut of one axis, then a cut of the other on each side."""
    best, out = -1.0, np.zeros_like(g)
    for flip in (False, True):
        gg, hh = (g.T, h.T) if flip else (g, h)
        for c in range(1, len(gg)):
            sides = [tree(gg[a:z].sum(0), hh[a:z].sum(0), 2) for a, z in ((0, c), (c, len(gg)))]
            t = np.vstack([np.tile(sides[0], (c, 1)), np.tile(sides[1], (len(gg) - c, 1))])
            gain = 2 * (t * gg).sum() - (t * t * hh).sum()
            if gain > best:
                best, out = gain, t.T if flip else t
    return out


def train(x: np.ndarray, y: np.ndarray) -> Model:
    n, k = x.shape
    prior = (y.sum() + 1) / (n + 2)
    m = Model(float(np.log(prior / (1 - prior))))
    m.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(k)]
    m.tables = np.zeros((k, BINS))
    b = m.bins(x)
    raw = np.full(n, m.bias)
    for _ in range(ROUNDS):
        for j in range(k):
            p = sigmoid(raw)
            step = RATE * tree(np.bincount(b[:, j], y - p, minlength=BINS), np.bincount(b[:, j], p * (1 - p), minlength=BINS))
            m.tables[j] += step
            raw += step[b[:, j]]
    c = coarse(b)
    sums = lambda i, j, v: np.bincount(c[:, i] * GRID + c[:, j], v, minlength=GRID * GRID).reshape(GRID, GRID)
    p = sigmoid(raw)
    worth = []
    for i in range(k):
        for j in range(i + 1, k):
            g, h = sums(i, j, y - p), sums(i, j, p * (1 - p))
            t = pair_tree(g, h)
            worth.append((2 * (t * g).sum() - (t * t * h).sum(), i, j))
    chosen = [(i, j, np.zeros((GRID, GRID))) for _, i, j in sorted(worth, reverse=True)[:PAIRS]]
    for _ in range(PAIR_ROUNDS):
        for i, j, t in chosen:
            p = sigmoid(raw)
            step = RATE * pair_tree(sums(i, j, y - p), sums(i, j, p * (1 - p)))
            t += step
            raw += step[c[:, i], c[:, j]]
    m.pairs = chosen
    return m


def fit(docs: DataFrame, labels: DataFrame, use, label: str = "quality", doc_id: str = "doc_id", text: str = "text", rows: int = ROWS) -> Model:
    """Model of the labels of rows for which ``use`` (on column ``id``) holds. Without labels every score is 0.5."""

    def extract(b: pa.RecordBatch) -> dict[str, list]:
        x = [features(buf, offs) for _, _, buf, offs in steps(b.column(1))]
        return {"label": b.column(2), "x": list(np.concatenate(x))}

    schema = pa.schema([("label", pa.int32()), ("x", pa.list_(pa.float64()))])
    sample = labelled(docs, labels, label, use, rows, doc_id, text).orderBy("id").mapInArrow(by_batch(extract, schema), "label int, x array<double>").toPandas()
    return train(np.stack(sample["x"]), sample["label"].to_numpy(np.float64)) if len(sample) else Model()


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: its id and ``score``.

    Null and empty texts get the score of an empty text. Repeated rows are scored alike. Other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return scored(docs, lambda texts: shared.value.score(texts), doc_id, text).withColumnRenamed("id", doc_id)


#: Rows of this fold are not learned from.
FOLDS, HELD = 4, 2


def learnable():
    return fold(F.col("id"), FOLDS) != HELD
