"""Language identification by averaged hashed subword embeddings and a linear softmax.

Subwords are the 1 to 4 byte strings of the lower-cased text, with one blank for whatever is no word, hashed to ``BUCKETS``.
A text is the mean of its subwords' vectors; a linear layer and a softmax give the probabilities. Trained by stochastic
gradient descent in numpy on at most ``ROWS`` rows of each language and ``TOTAL`` rows in all. A part of these rows is kept
out to calibrate: a temperature for the probabilities, and the least probability at which a prediction is not rejected.

The mean is linear, so for prediction vectors and layer are multiplied beforehand into one table of a value per bucket and
language. Prediction is a map without shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from spanloom.llm.common import WORD_BYTE, by_batch, fold, steps

BUCKETS, WIDTH, SIZES = 1 << 16, 16, (1, 2, 3, 4)
ROWS, TOTAL = 400, 20_000
EPOCHS, BATCH, RATE = 12, 16, 2.0
UNKNOWN = "und"
#: Share of kept-out rows that may be predicted wrongly after rejection.
ERROR = 0.01
#: Kept-out share for calibration: one row in this many.
KEPT_OUT = 5


def subwords(buf: np.ndarray, offs: np.ndarray):
    """For each size: bucket of each subword, and the range of subwords of each text."""
    low = WORD_BYTE[buf]
    blank = low == 0
    low = np.where(blank, 32, low).astype(np.uint32)
    squeeze = ~blank
    squeeze[1:] |= ~blank[:-1]  # one blank stands for a run
    squeeze[:1] = True
    kept = np.concatenate([[0], np.cumsum(squeeze)])
    low, offs = low[squeeze], kept[offs]
    for size in SIZES:
        n = max(0, len(low) - size + 1)
        code = np.zeros(n, np.uint32)
        for k in range(size):
            code |= low[k : k + n] << np.uint32(8 * k)
        h = code * np.uint32(0x9E3779B1) + np.uint32(size * 0x85EBCA6B & 0xFFFFFFFF)
        h ^= h >> np.uint32(15)
        yield (h * np.uint32(0x2C1B3C6D) >> np.uint32(16)).astype(np.int64) & (BUCKETS - 1), np.minimum(offs[:-1], n), np.minimum(np.maximum(offs[1:] - size + 1, offs[:-1]), n)


@dataclass
class Model:
    languages: list[str] = field(default_factory=list)
    table: np.ndarray | None = None  # bucket, language
    bias: np.ndarray | None = None
    temperature: float = 1.0
    least: float = 0.0

    def logits(self, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
        n = len(offs) - 1
        total, count = np.zeros((n, len(self.languages))), np.zeros(n)
        for code, a, z in subwords(buf, offs):
            some = np.flatnonzero(z > a)
            count += z - a
            if len(some):
                edges = np.stack([a[some], z[some]], 1).ravel()
                for j in range(len(self.languages)):
                    values = np.r_[self.table[code, j], np.float32(0)]
                    total[some, j] += np.add.reduceat(values, edges, dtype=np.float64)[::2]
        return total / np.maximum(count, 1)[:, None] + self.bias

    def probabilities(self, texts: pa.Array) -> np.ndarray:
        out = [softmax(self.logits(buf, offs) / self.temperature) for _, _, buf, offs in steps(texts)]
        return np.concatenate(out)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def fit(docs: DataFrame, use, lang: str = "lang", doc_id: str = "doc_id", text: str = "text", rows: int = ROWS, total: int = TOTAL) -> Model:
    """Model of the languages of rows for which ``use`` (on column ``id``) holds; texts without letter and null languages teach nothing.

    The rows are those of smallest hash of the id in each language. A language's count first gives a bound of the hash that
    leaves about twice as many, so the ranked rows do not grow with the table. The counts are broadcast: there are as many as
    the fitted model has languages, and it holds a value per bucket for each. Of an empty table the model knows no language.
    """
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id"))
    known = docs.select(F.col(doc_id).alias("id"), F.col(lang).alias("lang")).filter("id is not null and lang is not null").filter(use)
    bound = known.groupBy("lang").agg(F.greatest(F.lit(1.0), F.count(F.lit(1)) / F.lit(2.0 * rows)).alias("times"))
    known = known.join(F.broadcast(bound), "lang").filter(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) * F.col("times") < 1 << 30)
    chosen = known.withColumn("rank", rank).filter(F.col("rank") <= rows).orderBy("rank", "lang").limit(total).select("id", F.col("lang").alias("known"))
    texts = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"), F.col(lang).alias("known")).join(F.broadcast(chosen), ["id", "known"])

    def extract(b: pa.RecordBatch) -> dict[str, list]:
        out = {"id": b.column(0).cast(pa.string()), "lang": b.column(1), "code": [], "share": []}
        for _, _, buf, offs in steps(b.column(2)):
            parts = list(subwords(buf, offs))
            for k in range(len(offs) - 1):
                every = np.concatenate([code[a[k] : z[k]] for code, a, z in parts])
                code, n = np.unique(every, return_counts=True)
                out["code"].append(code.astype(np.int32))
                out["share"].append((n / max(1, len(every))).astype(np.float32))
        return out

    schema = pa.schema([("id", pa.string()), ("lang", pa.string()), ("code", pa.list_(pa.int32())), ("share", pa.list_(pa.float32()))])
    sample = texts.dropDuplicates(["id", "known"]).filter(F.col("text").rlike(r"\p{L}")).select("id", F.col("known").cast("string"), "text")
    got = sample.mapInArrow(by_batch(extract, schema), "id string, lang string, code array<int>, share array<float>").toPandas().sort_values(["lang", "id"])
    if not len(got):
        return Model()
    names = sorted(set(got["lang"]))
    y = np.searchsorted(np.array(names, object), got["lang"].to_numpy(object))
    return train(names, [np.asarray(c, np.int64) for c in got["code"]], [np.asarray(s, np.float32) for s in got["share"]], y)


def train(names: list[str], codes: list[np.ndarray], shares: list[np.ndarray], y: np.ndarray, seed: int = 11) -> Model:
    rng, k = np.random.default_rng(seed), len(names)
    out_of = rng.permutation(len(y)) % KEPT_OUT == 0
    learn = np.flatnonzero(~out_of) if (~out_of).any() else np.arange(len(y))
    vectors, layer, bias = rng.normal(0, 1 / WIDTH, (BUCKETS, WIDTH)).astype(np.float32), rng.normal(0, 1, (WIDTH, k)).astype(np.float32), np.zeros(k, np.float32)
    rounds = EPOCHS * ((len(learn) + BATCH - 1) // BATCH)
    step = 0
    for _ in range(EPOCHS):
        order = rng.permutation(learn)
        for b in range(0, len(order), BATCH):
            some = order[b : b + BATCH]
            rate = RATE * (1 - step / rounds)
            step += 1
            sizes = [len(codes[i]) for i in some]
            code, share, row = np.concatenate([codes[i] for i in some]), np.concatenate([shares[i] for i in some]), np.repeat(np.arange(len(some)), sizes)
            starts = np.r_[0, np.cumsum(sizes)[:-1]]
            mean = np.add.reduceat(vectors[code] * share[:, None], starts)
            err = softmax(mean @ layer + bias)
            err[np.arange(len(some)), y[some]] -= 1
            back = (err @ layer.T).astype(np.float32)
            layer -= rate / len(some) * (mean.T @ err).astype(np.float32)
            bias -= rate / len(some) * err.sum(0).astype(np.float32)
            np.subtract.at(vectors, code, np.float32(rate * WIDTH / len(some)) * share[:, None] * back[row])
    m = Model(names, (vectors @ layer).astype(np.float32), bias.astype(np.float64))
    held = np.flatnonzero(out_of)
    logits = np.stack([(m.table[codes[i]] * shares[i][:, None]).sum(0) + bias for i in held]) if len(held) else np.zeros((0, k))
    calibrate(m, logits.astype(np.float64), y[held])
    return m


def calibrate(m: Model, logits: np.ndarray, y: np.ndarray) -> None:
    """Temperature of least loss on kept-out rows; least probability above which at most ``ERROR`` of them are wrong."""
    if not len(y):
        return
    grid = np.geomspace(0.05, 20, 121)
    loss = [-np.log(np.maximum(softmax(logits / t)[np.arange(len(y)), y], 1e-12)).mean() + 1e-3 * abs(np.log(t)) for t in grid]
    m.temperature = float(grid[int(np.argmin(loss))])
    p = softmax(logits / m.temperature)
    best, right = p.max(1), p.argmax(1) == y
    order = np.argsort(-best)
    fine = np.flatnonzero(np.cumsum(~right[order]) / np.arange(1, len(y) + 1) <= ERROR)
    m.least = float(best[order][fine[-1]]) if len(fine) and fine[-1] < len(y) - 1 else 1 / len(m.languages) if len(fine) else 1.0


def predict(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: its id, ``lang_pred``, ``score`` (calibrated probability) and ``rejected``.

    Texts that are null or have no letter, and all texts if the model knows no language, are ``und`` with score 0 and
    rejected. Other texts name the likeliest language; ``rejected`` tells that its probability is below the calibrated
    least. Repeated rows are predicted alike. Only id and text are read.
    """
    shared, kind = docs.sparkSession.sparkContext.broadcast(model), docs.schema[doc_id].dataType
    schema = pa.schema([("id", to_arrow_type(kind)), ("lang_pred", pa.string()), ("score", pa.float64()), ("rejected", pa.bool_())])

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        m = shared.value
        letters = np.array(b.column(2).to_pylist(), bool)
        names, score = np.full(b.num_rows, UNKNOWN, object), np.zeros(b.num_rows)
        if m.languages and letters.any():
            p = m.probabilities(b.column(1))
            names[letters] = np.array(m.languages, object)[p.argmax(1)][letters]
            score[letters] = p.max(1)[letters]
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(names, pa.string()), pa.array(score), pa.array(~letters | (score < m.least))], schema=schema)

    letter = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)).alias("letter")
    out = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"), letter).mapInArrow(by_batch(run), f"id {kind.simpleString()}, lang_pred string, score double, rejected boolean")
    return out.withColumnRenamed("id", doc_id)


#: Rows of this fold are not learned from.
FOLDS, HELD = 5, 0


def learnable():
    return fold(F.col("id"), FOLDS) != HELD
