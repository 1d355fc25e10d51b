"""Benchmark decontamination: a broadcast hash set of benchmark n-grams, scanned over the word windows of documents.

The benchmark is cut into windows by Spark. Their number is checked: at most ``max_windows`` are broadcast at a time; a
larger benchmark is split by hash into that many passes, each a narrow map over the documents, so no benchmark is too
large and none is cut. A window found by its hash is verified by its words.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from spanloom.llm.common import Spans, Words, by_batch, steps
from spanloom.session import materialize

WINDOW = 10
MAX_WINDOWS = 1_000_000
HITS = "id {id}, text string, n_words bigint, spans array<struct<start:int,size:int>>, items array<string>"


def _cut(window: int):
    def cut(b: pa.RecordBatch) -> dict[str, list]:
        ids, out = b.column(0).to_pylist(), {"item": [], "size": [], "hash": [], "words": []}
        for lo, hi, buf, offs in steps(b.column(1)):
            w = Words(buf, offs)
            spans = Spans(w.hash, 1)
            for k in range(lo, hi):
                a, z = w.bounds[k - lo], w.bounds[k - lo + 1]
                size = min(window, z - a)
                for i in range(a, z - size + 1) if size else ():
                    out["item"].append(ids[k])
                    out["size"].append(int(size))
                    out["hash"].append(int(spans.hash(np.array([i]), np.array([i + size])).view(np.int64)[0]))
                    out["words"].append(_words(w, i, size))
        return out

    return by_batch(cut, pa.schema([("item", pa.string()), ("size", pa.int32()), ("hash", pa.int64()), ("words", pa.binary())]))


def _words(w: Words, first: int, size: int) -> bytes:
    return b" ".join(w.low[w.start[i] : w.end[i]].tobytes() for i in range(first, first + size))


def benchmark_windows(benchmark: DataFrame, item_id: str = "item_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """Distinct windows of every item. An item of fewer words is one window, an item without words has none."""
    cut = benchmark.select(F.col(item_id).cast("string").alias("item"), F.col(text).alias("text")).mapInArrow(_cut(window), "item string, size int, hash bigint, words binary")
    return cut.distinct()


def _index(rows: list) -> dict:
    """hash -> [(words, items)], and the sorted hashes of each window size."""
    found: dict[int, dict[bytes, set]] = {}
    sizes: dict[int, set] = {}
    for item, size, h, words in rows:
        found.setdefault(h, {}).setdefault(bytes(words), set()).add(item)
        sizes.setdefault(size, set()).add(h)
    return {"found": found, "sizes": {k: np.sort(np.array(list(v), np.int64)) for k, v in sizes.items()}}


def _found(index: dict, texts: pa.Array, n_words: np.ndarray | None = None):
    """Verified hits: row, (first word in its text, words of the window), ids of the items that hold it."""
    for lo, hi, buf, offs in steps(texts):
        w = Words(buf, offs)
        if n_words is not None:
            n_words[lo:hi] = np.diff(w.bounds)
        sums, owner = Spans(w.hash, 1), w.owner()
        for size, hashes in index["sizes"].items():
            at = w.windows(size)
            h = sums.hash(at, at + size).view(np.int64)
            place = np.searchsorted(hashes, h)
            place[place == len(hashes)] = 0
            hit = np.flatnonzero(hashes[place] == h)
            for i, code in zip(at[hit].tolist(), h[hit].tolist()):
                if (of := index["found"][code].get(_words(w, i, size))) is not None:
                    k = int(owner[i])
                    yield lo + k, (i - int(w.bounds[k]), size), of


def _scan(shared, type_: pa.DataType, last: bool):
    schema = pa.schema([("id", type_), ("text", pa.string()), ("n_words", pa.int64()),
                        ("spans", pa.list_(pa.struct([("start", pa.int32()), ("size", pa.int32())]))), ("items", pa.list_(pa.string()))])

    def scan(b: pa.RecordBatch) -> pa.RecordBatch:
        spans, n_words = b.column(3).to_pylist(), np.zeros(b.num_rows, np.int64)
        items = [set(x) for x in b.column(4).to_pylist()]
        for k, (start, size), of in _found(shared.value, b.column(1), n_words):
            spans[k].append({"start": start, "size": size})
            items[k].update(x for x in of if x is not None)
        items = [sorted(x) for x in items]
        text = pa.nulls(b.num_rows, pa.string()) if last else b.column(1)
        return pa.RecordBatch.from_arrays([b.column(0), text, pa.array(n_words), pa.array(spans, schema.field(3).type), pa.array(items, schema.field(4).type)], schema=schema)

    return by_batch(scan)


def _passes(benchmark: DataFrame, item_id: str, item_text: str, window: int, max_windows: int):
    """Broadcast indexes of the benchmark's windows, each of about ``max_windows`` rows, and whether it is the last; one for an empty benchmark.

    An index is built when it is asked for, so that only one is held at a time.
    """
    cut = materialize(benchmark_windows(benchmark, item_id, item_text, window))
    n = max(1, math.ceil(cut.count() / max_windows))
    for k in range(n):
        part = cut.filter(F.pmod(F.col("hash"), F.lit(n)) == k).collect()
        yield benchmark.sparkSession.sparkContext.broadcast(_index([(r["item"], r["size"], r["hash"], r["words"]) for r in part])), k == n - 1


def matches(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
            item_text: str = "text", window: int = WINDOW, max_windows: int = MAX_WINDOWS) -> DataFrame:
    """One row per document: id, ``n_words``, ``spans`` (first word and length of each found window), ``items``.

    Null and empty texts have no words and no hits. Repeated rows are judged alike. An item without id hits words but
    is not listed. An empty benchmark hits nothing. Other columns of either table are not read.
    """
    kind = docs.schema[doc_id].dataType
    schema = HITS.format(id=kind.simpleString())
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"), F.lit(0).cast("bigint").alias("n_words"),
                       F.array().cast("array<struct<start:int,size:int>>").alias("spans"), F.array().cast("array<string>").alias("items"))
    for shared, last in _passes(benchmark, item_id, item_text, window, max_windows):
        rows = rows.mapInArrow(_scan(shared, to_arrow_type(kind), last), schema)
        if not last:  # run, so that its index can go before the next one comes
            rows = materialize(rows)
            shared.unpersist()
    return rows.select(F.col("id").alias(doc_id), "n_words", "spans", "items")


def report(found: DataFrame) -> DataFrame:
    """Counts and digest of the found windows: ``n_hit`` words inside any of them, items, ``contaminated``."""
    hit = F.size(F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["start"], s["start"] + s["size"] - 1)))))
    return found.select("*", hit.cast("bigint").alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
                        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


def _sieve(shared, at: int):
    def sieve(b: pa.RecordBatch) -> pa.RecordBatch:
        keep = np.ones(b.num_rows, bool)
        for k, _, _ in _found(shared.value, b.column(at)):
            keep[k] = False
        return b.filter(pa.array(keep))

    return by_batch(sieve)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
                      window: int = WINDOW, max_windows: int = MAX_WINDOWS) -> DataFrame:
    """The documents without any benchmark window, all columns as they are; a narrow map, without join or shuffle.

    Null and empty texts are kept, repeated rows stay or go alike; an empty benchmark drops nothing. Of a benchmark of several passes all but
    the last are stored in between.
    """
    for shared, last in _passes(benchmark, item_id, item_text, window, max_windows):
        docs = docs.mapInArrow(_sieve(shared, docs.columns.index(text)), docs.schema)
        if not last:
            docs = materialize(docs)
            shared.unpersist()
    return docs
