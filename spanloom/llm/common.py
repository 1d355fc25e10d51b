"""Shared helpers: byte batches from Arrow, word hashes, tables in the shared folder."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bytes of text that one numpy step works on; a longer single text is a step of its own.
STEP_BYTES = 1 << 20
U = np.uint64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(col: Column, mod: int) -> Column:
    """crc32 of the id's text, modulo ``mod``; a null id falls into fold -1."""
    return F.coalesce(F.crc32(F.encode(col.cast("string"), "UTF-8")) % mod, F.lit(-1)).cast("int")


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads 64-bit values (splitmix64)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def stretches(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start, start + 1, … of each stretch of ``size`` numbers, one stretch after the other."""
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


class Powers:
    """Powers of an odd base modulo 2**64 and of its inverse, grown as needed."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up, self.down = np.ones(1, U), np.ones(1, U)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) <= n:
            size = max(n + 1, STEP_BYTES + 2)
            grow = lambda b: np.concatenate([np.ones(1, U), np.multiply.accumulate(np.full(size - 1, b, U))])
            self.up, self.down = grow(self.base), grow(self.inverse)
        return self.up, self.down


_BASES = [Powers(0x9E3779B97F4A7C15), Powers(0xC2B2AE3D27D4EB4F)]


class Spans:
    """Hash of any span of ``values`` in constant time, by prefix sums of a polynomial modulo 2**64."""

    def __init__(self, values: np.ndarray, base: int = 0):
        up, self.down = _BASES[base].get(len(values))
        self.sums = np.zeros(len(values) + 1, U)
        np.cumsum(values * up[: len(values)], out=self.sums[1:])

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(U))


BYTE_VALUES = mix(np.arange(1, 257, dtype=U))
#: Lower-cased ASCII letters, digits and all bytes of non-ASCII characters; 0 elsewhere.
WORD_BYTE = np.array([b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 0 for b in range(256)], np.uint8)


def steps(texts: pa.Array, limit: int = STEP_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Consecutive rows of a string column: first row, last row + 1, their bytes, row offsets in them. Null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    n = len(texts)
    if not n:
        return
    texts = texts.fill_null("") if texts.null_count else texts
    big = texts.cast(pa.binary() if pa.types.is_string(texts.type) else pa.large_binary()).cast(pa.large_binary())
    offs = np.frombuffer(big.buffers()[1], np.int64, n + 1, big.offset * 8)
    data = np.frombuffer(big.buffers()[2] or b"", np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1)
        yield lo, hi, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


class Words:
    """Words of several texts at once: lower-cased bytes, start and end of each word, first word of each text."""

    def __init__(self, buf: np.ndarray, offs: np.ndarray):
        self.low = WORD_BYTE[buf]
        inside = self.low != 0
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        heads = offs[:-1][offs[:-1] < offs[1:]]
        first[heads] = inside[heads]
        last = inside.copy()
        last[:-1] &= ~inside[1:]
        tails = offs[1:][offs[:-1] < offs[1:]] - 1
        last[tails] = inside[tails]
        self.start, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.bounds = np.searchsorted(self.start, offs)
        self._hash: np.ndarray | None = None

    @property
    def hash(self) -> np.ndarray:
        if self._hash is None:
            self._hash = Spans(BYTE_VALUES[self.low]).hash(self.start, self.end)
        return self._hash

    def owner(self) -> np.ndarray:
        """Text that each word belongs to."""
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))

    def windows(self, size: int) -> np.ndarray:
        """First words of the windows of ``size`` words that lie in one text."""
        n = np.diff(self.bounds)
        has = np.maximum(n - size + 1, 0)
        return np.repeat(self.bounds[:-1] - np.concatenate([[0], np.cumsum(has)[:-1]]), has) + np.arange(has.sum())


#: Slots of ``sift``; they bound what it broadcasts.
SLOTS = 1 << 20


def sift(rows: DataFrame, wanted: DataFrame, *keys: str) -> DataFrame:
    """``rows`` without most of those whose keys are not in ``wanted``, before a join shuffles them.

    Keys are hashed to ``SLOTS``; the slots in use, never more, are broadcast. Rows of wanted keys always pass; a large
    ``wanted`` fills the slots and lets all rows pass, so only the join itself decides.
    """
    slot = F.pmod(F.xxhash64(*keys), F.lit(SLOTS)).cast("int")
    used = wanted.select(slot.alias("_llm_slot")).distinct()
    return rows.withColumn("_llm_slot", slot).join(F.broadcast(used), "_llm_slot", "left_semi").drop("_llm_slot")


def by_batch(fn: Callable[[pa.RecordBatch], dict[str, list] | pa.RecordBatch | None], schema: pa.Schema | None = None):
    """An iterator function for mapInArrow from a function of one batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows and (out := fn(b)) is not None:
                yield out if isinstance(out, pa.RecordBatch) else pa.RecordBatch.from_pydict(out, schema)

    return run


def labelled(docs: DataFrame, labels: DataFrame, label: str, fit: Column, limit: int, doc_id: str = "doc_id", text: str = "text",
             most: int | None = None) -> DataFrame:
    """Text and label (0 or 1) of at most ``limit`` labelled rows for which ``fit`` (on column ``id``) holds.

    The rows are those of smallest hash of the id, the same on every run. ``limit`` bounds what is broadcast and collected;
    with ``most``, rows end where their texts would exceed so many bytes in all.
    A null label counts as none; of repeated labels of one id the larger counts, of repeated documents one row.
    """
    known = labels.select(F.col(doc_id).alias("id"), F.col(label).cast("int").alias("label")).filter("id is not null and label is not null")
    known = known.filter(fit).groupBy("id").agg(F.max("label").alias("label"))
    chosen = known.orderBy(F.xxhash64("id"), "id").limit(limit)
    if most is not None:  # narrow rows, at most ``limit`` of them
        sizes = docs.select(F.col(doc_id).alias("id"), F.octet_length(text).alias("size")).join(F.broadcast(chosen), "id").groupBy("id", "label").agg(F.max("size").alias("size"))
        so_far = F.sum(F.coalesce("size", F.lit(0)).cast("bigint")).over(Window.orderBy(F.xxhash64("id"), "id").rowsBetween(Window.unboundedPreceding, 0))
        chosen = sizes.withColumn("so_far", so_far).filter(F.col("so_far") <= most).select("id", "label")
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).join(F.broadcast(chosen), "id")
    return rows.dropDuplicates(["id"]).select("id", "text", "label")


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def scored(docs: DataFrame, score: Callable[[pa.Array], np.ndarray], doc_id: str, text: str) -> DataFrame:
    """Columns ``id`` and ``score`` by a function of the text column; other columns are not read."""
    kind = docs.schema[doc_id].dataType

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(score(b.column(1)).astype(np.float64))], names=["id", "score"])

    return docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).mapInArrow(by_batch(run), f"id {kind.simpleString()}, score double")
