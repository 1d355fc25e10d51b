"""Toxicity by a factorization machine over hashed terms.

score = sigmoid(w0 + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j), where x_i is 1 if term i occurs. The factors v give a
weight to every pair of terms, so a word may count only in company of another, which additive weights cannot say. Terms are
words and beginnings of words (``STEMS`` bytes), hashed to ``BUCKETS``. Weights go to terms that tell alone (their occurrence depends on the label, chi-square
over ``CHI``) and to pairs that tell only together: with one of them the other means something else than without it (difference of
its correlations with the label, squared and over its variance, above ``PAIR_CHI``; all pairs of such terms in ``PAIR_LEAST`` rows or more are tried). Fitted by
stochastic gradient steps in numpy on at most ``ROWS`` labelled rows of at most ``BYTES`` in all; scoring is a map without shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import BYTE_VALUES, Spans, Words, by_batch, fold, labelled, mix, scored, sigmoid, steps, stretches
from spanloom.session import materialize

BUCKETS = 1 << 20
ROWS = 20_000
STEMS = (4, 6)
BYTES = 1 << 28
CHI, LEAST = 15.0, 5
PAIR_CHI, PAIR_LEAST = 200.0, 50  # fewer rows cannot give so much evidence
RANK, EPOCHS, BATCH, RATE = 8, 40, 128, 0.02
SHRINK = 1e-4


def terms(texts: pa.Array, keep: np.ndarray | None = None):
    """For consecutive rows: first row, text of each distinct term, its bucket (or its place in the table ``keep``)."""
    for lo, hi, buf, offs in steps(texts):
        w = Words(buf, offs)
        byte = Spans(BYTE_VALUES[w.low])
        hashes, owners, owner = [w.hash], [w.owner()], w.owner()
        for size in STEMS:
            long = np.flatnonzero(w.end - w.start > size)
            hashes.append(mix(byte.hash(w.start[long], w.start[long] + size) + np.uint64(size)))
            owners.append(owner[long])
        term, owner = (np.concatenate(hashes) % np.uint64(BUCKETS)).astype(np.int64), np.concatenate(owners)
        if keep is not None:
            term = keep[term].astype(np.int64)
            owner, term = owner[term >= 0], term[term >= 0]
        both = np.unique(owner * BUCKETS + term)
        yield lo, hi, both // BUCKETS, both % BUCKETS


@dataclass
class Model:
    keep: np.ndarray  # bucket -> term or -1
    bias: float
    weight: np.ndarray
    factor: np.ndarray

    def raw(self, row: np.ndarray, term: np.ndarray, n: int) -> np.ndarray:
        """Value before the sigmoid of ``n`` rows; (row, term) are distinct and sorted by row."""
        out = np.full(n, self.bias)
        if len(row):
            at = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
            v = self.factor[term]
            s = np.add.reduceat(v, at)
            out[row[at]] += np.add.reduceat(self.weight[term], at) + 0.5 * ((s * s) - np.add.reduceat(v * v, at)).sum(1)
        return out

    def score(self, texts: pa.Array) -> np.ndarray:
        out = np.zeros(len(texts))
        for lo, hi, row, term in terms(texts, self.keep):
            out[lo:hi] = sigmoid(self.raw(row, term, hi - lo))
        return out if np.isfinite(self.bias) else np.zeros(len(texts))


def fit(docs: DataFrame, labels: DataFrame, use, label: str = "toxic", doc_id: str = "doc_id", text: str = "text", rows: int = ROWS) -> Model:
    """Model of the labels of rows for which ``use`` (on column ``id``) holds. Without labels nothing is known to be toxic and every score is 0."""

    def extract(b: pa.RecordBatch) -> dict[str, list]:
        out = {"label": b.column(2), "terms": []}
        for lo, hi, row, term in terms(b.column(1)):
            out["terms"] += np.split(term.astype(np.int32), np.searchsorted(row, np.arange(1, hi - lo)))
        return out

    schema = pa.schema([("label", pa.int32()), ("terms", pa.list_(pa.int32()))])
    sample = materialize(labelled(docs, labels, label, use, rows, doc_id, text, BYTES).orderBy("id").mapInArrow(by_batch(extract, schema), "label int, terms array<int>"))
    n, p = sample.agg(F.count("label"), F.sum("label")).first()
    if not n:
        return Model(np.full(BUCKETS, -1, np.int32), -np.inf, np.zeros(1), np.zeros((1, RANK)))
    known = sample.select("label", F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).cast("double").alias("df"), F.sum("label").cast("double").alias("pos"))
    known = known.filter(F.col("df") >= LEAST).toPandas().sort_values("term", ignore_index=True)  # at most BUCKETS rows
    alone = telling(known["df"].to_numpy(), known["pos"].to_numpy(), n, p or 0)
    often = known["df"].to_numpy() >= PAIR_LEAST
    some, silent = known["term"].to_numpy()[alone | often], (often & ~alone)[alone | often]
    row, term, y = _gathered(sample, some)
    good = np.union1d(known["term"].to_numpy()[alone], some[_pairs(docs.sparkSession, row, term, y, silent)])
    keep = np.full(BUCKETS, -1, np.int32)
    keep[good] = np.arange(len(good))
    place = keep[some][term]
    return train(keep, row[place >= 0].astype(np.int64), place[place >= 0].astype(np.int64), y)


def _gathered(sample: DataFrame, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row and place in ``wanted`` of each occurrence of these terms, and the labels of all rows, on the driver."""
    place = np.full(BUCKETS, -1, np.int32)
    place[wanted] = np.arange(len(wanted))
    shared = sample.sparkSession.sparkContext.broadcast(place)

    def pick(b: pa.RecordBatch) -> pa.RecordBatch:
        ends, flat = b.column(1).offsets.to_numpy(), shared.value[b.column(1).values.to_numpy()]
        parts = [x[x >= 0].astype(np.int32).tobytes() for x in np.split(flat[ends[0] : ends[-1]], ends[1:-1] - ends[0])]
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(parts, pa.binary())], names=["label", "terms"])

    got = sample.mapInArrow(by_batch(pick), "label int, terms binary").collect()
    size = np.fromiter((len(r["terms"]) // 4 for r in got), np.int64, len(got))
    y = np.fromiter((r["label"] for r in got), np.float64, len(got))
    term = np.frombuffer(b"".join(r["terms"] for r in got), np.int32)
    return np.repeat(np.arange(len(got), dtype=np.int32), size), term, y


def telling(df: np.ndarray, pos: np.ndarray, n: int, p: int) -> np.ndarray:
    """Terms whose presence and the label depend on each other. ``n`` rows, ``p`` of them with label 1."""
    if not 0 < p < n:
        return np.zeros(len(df), bool)
    return (df < n) & (n * (pos * n - df * p) ** 2 >= CHI * df * np.maximum(n - df, 1) * p * (n - p))


def interaction(n: np.ndarray, p: np.ndarray, m: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Evidence that a term goes with the label otherwise in one set of rows than in another: squared difference of the correlations over its variance.

    ``n`` rows with the term, ``p`` of them positive, ``m`` without, ``q`` positive; shape (2, terms).
    """
    spread = n * m * (p + q) * (n + m - p - q)
    phi = np.where(spread > 0, (p * m - q * n) / np.sqrt(np.maximum(spread, 1)), 0.0)
    return (phi[0] - phi[1]) ** 2 / (1 / np.maximum(n + m, 1)).sum(0)


def _pairs(spark, row: np.ndarray, term: np.ndarray, y: np.ndarray, silent: np.ndarray) -> np.ndarray:
    """Terms of pairs of ``silent`` terms that tell together. Each task counts the companions of some terms in the bounded sample."""
    keep, k = silent[term], int(silent.sum())
    term, size = (np.cumsum(silent, dtype=np.int32) - np.int32(1))[term[keep]], np.bincount(row[keep], minlength=len(y))
    if not len(term) or not 0 < y.sum() < len(y):
        return np.zeros(0, np.int64)
    shared = spark.sparkContext.broadcast((term, size, y > 0.5))

    def search(batches):
        term, size, label = shared.value
        start = np.r_[0, np.cumsum(size)]
        df, pos = np.bincount(term, minlength=k).astype(float), np.bincount(term[np.repeat(label, size)], minlength=k)
        n, p = len(label), int(label.sum())

        def counted(rows: np.ndarray) -> np.ndarray:  # in steps of about a million occurrences
            parts = np.array_split(rows, 1 + int(size[rows].sum()) // (1 << 20))
            return sum(np.bincount(term[stretches(start[x], size[x])], minlength=k) for x in parts)

        for b in batches:
            found: set[int] = set()
            first, last = (int(b.column(0)[i].as_py()) for i in (0, -1))  # a stretch of terms
            places = np.flatnonzero((term >= first) & (term <= last))
            places = places[np.argsort(term[places], kind="stable")]
            holders, ends = np.searchsorted(start, places, "right") - 1, np.r_[0, np.cumsum(np.bincount(term[places] - first, minlength=last - first + 1))]
            for a in range(first, last + 1):
                rows = holders[ends[a - first] : ends[a - first + 1]]
                good = rows[label[rows]]
                here, hit = counted(rows), counted(good)
                b_ = np.flatnonzero(here >= LEAST)
                x, h = here[b_], hit[b_]
                z = interaction(np.stack([x, df[b_] - x]), np.stack([h, pos[b_] - h]), np.stack([len(rows) - x, n - len(rows) - df[b_] + x]), np.stack([len(good) - h, p - len(good) - pos[b_] + h]))
                z[b_ == a] = 0
                both = b_[z >= PAIR_CHI]
                found.update(both.tolist(), [int(a)] if len(both) else [])
            yield pa.RecordBatch.from_pydict({"term": pa.array(sorted(found), pa.int32())})

    tasks = max(1, min(64, int(len(term) // 100_000)))
    got = spark.range(0, k, 1, tasks).mapInArrow(search, "term int").distinct().toPandas()  # at most k rows
    return np.flatnonzero(silent)[np.sort(got["term"].to_numpy(np.int64))]


def train(keep: np.ndarray, row: np.ndarray, term: np.ndarray, y: np.ndarray, seed: int = 7) -> Model:
    rng, k, n = np.random.default_rng(seed), max(1, int(keep.max()) + 1), len(y)
    prior = (y.sum() + 1) / (n + 2)
    m = Model(keep, float(np.log(prior / (1 - prior))), np.zeros(k), rng.normal(0, 0.02, (k, RANK)))
    starts = np.searchsorted(row, np.arange(n + 1))
    gw, gv = np.full(k, 1e-6), np.full((k, RANK), 1e-6)  # sums of squared gradients (Adagrad)
    for epoch in range(EPOCHS):
        order = rng.permutation(n)
        for b in range(0, n, BATCH):
            some = np.sort(order[b : b + BATCH])
            sizes = starts[some + 1] - starts[some]
            r = np.repeat(np.arange(len(some)), sizes)
            t = term[np.repeat(starts[some] - np.r_[0, np.cumsum(sizes)[:-1]], sizes) + np.arange(sizes.sum())]
            err = sigmoid(m.raw(r, t, len(some))) - y[some]
            m.bias -= RATE * err.mean()
            if not len(t):
                continue
            v = m.factor[t]
            s = np.zeros((len(some), RANK))
            np.add.at(s, r, v)
            dv = err[r, None] * (s[r] - v)
            sw, sv = np.zeros(k), np.zeros((k, RANK))
            np.add.at(sw, t, err[r])
            np.add.at(sv, t, dv)
            sw, sv = sw / len(some) + SHRINK * m.weight, sv / len(some) + SHRINK * m.factor
            gw += sw * sw
            gv += sv * sv
            m.weight -= 20 * RATE * sw / np.sqrt(gw)
            m.factor -= RATE * sv / np.sqrt(gv)
    return m


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: its id and ``score``.

    Null and empty texts get the score of no term. Repeated rows are scored alike. Other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return scored(docs, lambda texts: shared.value.score(texts), doc_id, text).withColumnRenamed("id", doc_id)


def drop_toxic(docs: DataFrame, model: Model, limit: float = 0.5, text: str = "text") -> DataFrame:
    """The rows that score under ``limit``, all columns as they are."""
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text)
    return docs.mapInArrow(by_batch(lambda b: b.filter(pa.array(shared.value.score(b.column(at)) < limit))), docs.schema)


#: Rows of this fold are not learned from.
FOLDS, HELD = 5, 0


def learnable():
    return fold(F.col("id"), FOLDS) != HELD
