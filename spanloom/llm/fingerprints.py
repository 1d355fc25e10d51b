"""Document fingerprints by a randomised edit embedding.

1. Walks. A text is read by a walk shared by all texts: at step j on a character c it writes c and moves on if a random bit of (j, c) says so.
   Two texts that differ by few edits are soon read in step again, so their edit distance becomes a Hamming distance of what is written.
   Bits depend on one of ``CLASSES`` classes of the character and repeat every ``PERIOD`` steps.
2. Samples. Each of ``BITS`` bits of a fingerprint looks at one step: of all steps of the text the one of least random weight, which
   walks of any length share as far as they reach. The bit is a hash of the character written there, the step and the bit's number, so
   the share of equal samples is the share of equal steps, and different samples agree half the time.
3. Bands of sampled bits collect candidates among distinct fingerprints; whole fingerprints verify them.
"""

from __future__ import annotations

import hashlib
import math
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from spanloom.llm.common import U, mix
from spanloom.llm.graphs import components
from spanloom.session import materialize

BITS, CLASSES, PERIOD = 512, 64, 4096
#: Characters of texts that one numpy step works on, and the number of texts below which walks go one by one.
STEP_CHARS, FEW = 1 << 22, 64
BANDS, BAND_BITS, GROUP = 64, 20, 4096
_SEED = U(0xD1B54A32D192ED03)


@cache
def _jumps() -> np.ndarray:
    """Steps that a character of a class takes from a step on, (CLASSES, PERIOD): up to the first set bit."""
    bits = mix(np.arange(CLASSES * PERIOD, dtype=U) ^ _SEED).reshape(CLASSES, PERIOD) & U(1)
    out = np.zeros((CLASSES, PERIOD), np.uint8)
    for c in range(CLASSES):
        one = np.flatnonzero(bits[c])
        at = np.arange(PERIOD)
        k = np.searchsorted(one, at)
        out[c] = np.where(k < len(one), one[k % len(one)], one[0] + PERIOD) - at + 1
    return out


@cache
def _samples() -> list[np.ndarray]:
    """For each bit the steps at which the least random weight so far is met, up to 2**40; the last one within a walk is its sample."""
    out = []
    for bit in range(BITS):
        draw = iter(((mix(np.arange(1 << 9, dtype=U) + U(bit << 9) + _SEED) >> U(11)).astype(float) + 0.5) / 2.0**53)
        at, weight, steps = 0, next(draw), []
        while at < 1 << 40:
            steps.append(at)
            gap = math.log(next(draw)) / math.log1p(-weight)
            at += 1 + int(min(gap, 1 << 41))
            weight *= next(draw)
        out.append(np.array(steps))
    return out


def _walk(kind: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Steps spent on each character of texts that start at ``first`` in ``kind``, all texts in step while there are many."""
    jumps, out, mask = _jumps(), np.zeros(len(kind), np.uint8), PERIOD - 1
    order = np.argsort(-size, kind="stable")
    size, at, flat = size[order], first[order].copy(), jumps.reshape(-1)
    row = kind.astype(np.int32) * PERIOD
    step, i, m = np.zeros(len(size), np.int32), 0, len(size)
    while True:
        m = int(np.searchsorted(-size, -i, "left"))  # texts of more than i characters
        if m < FEW:
            break
        place = at[:m]
        g = flat[row[place] + step[:m]]
        out[place] = g
        step[:m] = (step[:m] + g) & mask
        at[:m] += 1
        i += 1
    rows = [r.tobytes() for r in jumps]
    for k in range(m):
        j, got = int(step[k]), bytearray()
        for c in kind[at[k] : at[k] + size[k] - i].tobytes():
            g = rows[c][j]
            got.append(g)
            j = (j + g) & mask
        out[at[k] : at[k] + len(got)] = np.frombuffer(got, np.uint8)
    return out


def _some(texts: list[str]) -> np.ndarray:
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    chars = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    first = np.cumsum(size) - size
    ends = np.cumsum(_walk(((chars * np.uint32(0x9E3779B1)) >> np.uint32(26)).astype(np.uint8), first, size), dtype=np.int64)
    steps = np.r_[0, ends]
    base, length = steps[first], steps[first + size] - steps[first]
    bits = np.zeros((len(texts), BITS), np.uint8)
    some = np.flatnonzero(length > 0)
    for b, samples in enumerate(_samples()):
        at = samples[np.searchsorted(samples, length[some], "left") - 1]
        seen = chars[np.searchsorted(ends, base[some] + at, "right")].astype(U)
        bits[some, b] = mix(mix(seen + (U(b) << U(32))) ^ (at.astype(U) * _SEED)) & U(1)
        bits[length == 0, b] = mix(np.array([b], U) ^ _SEED)[0] & U(1)
    return np.packbits(bits, axis=1)


def fingerprints(texts: list[str]) -> np.ndarray:
    """Fingerprints (texts, BITS / 8) of whole texts; the empty text has one of its own."""
    out, lo, size = [np.zeros((0, BITS // 8), np.uint8)], 0, 0
    for hi, t in enumerate(texts, 1):
        size += len(t)
        if size >= STEP_CHARS or hi == len(texts):
            out.append(_some(texts[lo:hi]))
            lo, size = hi, 0
    return np.concatenate(out)


_ONES = np.array([bin(i).count("1") for i in range(256)], np.uint8)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated share of equal steps of two walks from their fingerprints, 0 to 1; 1 for equal fingerprints."""
    return np.maximum(0.0, 1 - 2 * _ONES[a ^ b].sum(-1, dtype=np.int64) / BITS)


def _binary(codes: np.ndarray) -> pa.Array:
    return pa.array([c.tobytes() for c in codes], pa.binary())


def fingerprint(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: id and ``fingerprint`` (binary) of its whole text.

    Null is the empty text. Equal texts have equal fingerprints, repeated rows one each. Other columns are not read.
    """
    kind = docs.schema[doc_id].dataType

    def run(batches):
        for b in batches:
            codes = fingerprints([t or "" for t in b.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column(0), _binary(codes)], names=["id", "fingerprint"])

    out = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).mapInArrow(run, f"id {kind.simpleString()}, fingerprint binary")
    return out.withColumnRenamed("id", doc_id)


# ---------------------------------------------------------------- edited texts


def edited(text: str, after: str) -> str:
    """``text`` with its last floor(n / 2) characters replaced by the first as many, or all, of ``after``."""
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


_RING = "n_chars bigint, edited_sha256 string, code binary, edited_code binary, near_edited double, near_next double, part int, first boolean, last boolean, text string"


def _compare(ids: pa.Array, texts: list[str], codes: np.ndarray, after: list[str], after_codes: np.ndarray) -> list[pa.Array]:
    new = [edited(t, a) for t, a in zip(texts, after)]
    new_codes = fingerprints(new)
    return [ids, pa.array([len(t) for t in texts], pa.int64()), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in new]), _binary(codes), _binary(new_codes),
            pa.array(likeness(codes, new_codes)), pa.array(likeness(codes, after_codes))]


def _ring(kind: pa.DataType):
    """Rows of a sorted partition against the next one; the last waits for the partition after, the first keeps its text for the one before."""
    schema = pa.schema([("id", kind), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("code", pa.binary()), ("edited_code", pa.binary()),
                        ("near_edited", pa.float64()), ("near_next", pa.float64()), ("part", pa.int32()), ("first", pa.bool_()), ("last", pa.bool_()), ("text", pa.string())])

    def run(batches):
        part, start, held = TaskContext.get().partitionId(), True, None
        for b in batches:
            if not b.num_rows:
                continue
            ids, texts = b.column(0), [t or "" for t in b.column(1).to_pylist()]
            codes = fingerprints(texts)
            if held is not None:
                ids, texts, codes = pa.concat_arrays([held[0], ids]), [held[1], *texts], np.concatenate([held[2], codes])
            n = len(texts) - 1
            held = ids.slice(n), texts[n], codes[n:]
            if n:
                done = _compare(ids.slice(0, n), texts[:n], codes[:n], texts[1:], codes[1:])
                first = [start] + [False] * (n - 1)
                yield pa.RecordBatch.from_arrays([*done, pa.array([part] * n, pa.int32()), pa.array(first), pa.array([False] * n), pa.array([t if f else None for t, f in zip(texts, first)], pa.string())], schema=schema)
                start = False
        if held is not None:
            yield pa.RecordBatch.from_arrays([held[0], pa.array([len(held[1])], pa.int64()), pa.nulls(1, pa.string()), _binary(held[2]), pa.nulls(1, pa.binary()), pa.nulls(1, pa.float64()), pa.nulls(1, pa.float64()),
                                              pa.array([part], pa.int32()), pa.array([start]), pa.array([True]), pa.array([held[1]])], schema=schema)

    return run


def _closed(batches):
    names = ["id", "n_chars", "edited_sha256", "code", "edited_code", "near_edited", "near_next"]
    for b in batches:
        if b.num_rows:
            texts, after = b.column(1).to_pylist(), b.column(3).to_pylist()
            codes, after_codes = (np.frombuffer(b"".join(b.column(k).to_pylist()), np.uint8).reshape(-1, BITS // 8) for k in (2, 4))
            yield pa.RecordBatch.from_arrays(_compare(b.column(0), texts, codes, after, after_codes), names=names)


def against_edited(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Each document against its edited text and against the next document.

    One row per document: id, ``n_chars``, ``edited_sha256``, ``fingerprint`` and ``edited_fingerprint`` (hex), ``near_edited`` and ``near_next``. The
    edited text is :func:`edited` with the document of the next id; after the last comes the first, a lone document follows itself. Null ids
    come last, equal ids follow each other by a hash of their texts. Null is the empty text. An empty table gives none. Other columns
    are not read.

    Rows are range-partitioned by id once, so a document's next one is its neighbour. Only the first and last row of a partition
    keep their text, for the neighbours across partitions, which are joined by partition number.
    """
    kind = docs.schema[doc_id].dataType
    rows = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    order = [F.asc_nulls_last("id"), F.xxhash64("text"), F.col("tie")]
    placed = rows.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    ring = materialize(placed.select("id", "text").mapInArrow(_ring(to_arrow_type(kind)), f"id {kind.simpleString()}, {_RING}"))
    ends = ring.filter("text is not null")
    heads = ends.filter("first").select("part", F.col("text").alias("after"), F.col("code").alias("after_code"))
    # one narrow row per partition
    across = heads.select("part", F.coalesce(F.lead("part").over(Window.orderBy("part")), F.min("part").over(Window.partitionBy())).alias("to"))
    tails = ends.filter("last").join(across, "part").select("id", "text", "code", F.col("to").alias("part"))
    closed = tails.join(heads, "part").select("id", "text", "code", "after", "after_code")
    columns = ["id", "n_chars", "edited_sha256", "code", "edited_code", "near_edited", "near_next"]
    closed = closed.mapInArrow(_closed, ", ".join([f"id {kind.simpleString()}", *_RING.split(", ")[:6]]))
    out = ring.filter("not last").select(*columns).unionByName(closed)
    hexed = lambda c, name: F.lower(F.hex(c)).alias(name)
    return out.select(F.col("id").alias(doc_id), "n_chars", "edited_sha256", hexed("code", "fingerprint"), hexed("edited_code", "edited_fingerprint"), "near_edited", "near_next")


# ---------------------------------------------------------------- near documents


@cache
def _band_bits() -> np.ndarray:
    """Bits of each band, (BANDS, BAND_BITS)."""
    weights = mix(np.arange(BANDS * BITS, dtype=U) + (_SEED >> U(1))).reshape(BANDS, BITS)
    return np.argsort(weights, axis=1)[:, :BAND_BITS]


def _bands(batches):
    for b in batches:
        if b.num_rows:
            bits = np.unpackbits(np.frombuffer(b"".join(b.column(0).to_pylist()), np.uint8).reshape(b.num_rows, -1), axis=1)
            keys = (bits[:, _band_bits()].astype(np.int64) << np.arange(BAND_BITS)).sum(2) * BANDS + np.arange(BANDS)
            at = pa.array(np.repeat(np.arange(b.num_rows), BANDS))
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), pa.array(keys.reshape(-1))], names=["code", "band"])


def _links(least: float):
    """Verified links of a group, as few as connect what is linked; between two blocks of a large group, or inside one."""

    def run(table: pa.Table) -> pa.Table:
        names = table.column("code").to_pylist()
        codes, side = np.frombuffer(b"".join(names), np.uint8).reshape(len(names), -1), table.column("side").to_numpy()
        out: list[tuple] = []
        root = np.arange(len(names))
        for i in range(len(names)):
            other = np.flatnonzero((side[:i] != side[i]) if side.max() else np.ones(i, bool))
            near = other[likeness(codes[other], codes[i]) >= least]
            for j in near[np.unique(root[near], return_index=True)[1]]:
                if root[j] != root[i]:
                    root[root == root[j]] = root[i]
                    out.append((names[j], names[i]))
        return pa.table({"a": pa.array([x for x, _ in out], pa.binary()), "b": pa.array([y for _, y in out], pa.binary())})

    return run


def classes(docs: DataFrame, least: float = 0.8, doc_id: str = "doc_id", text: str = "text", group: int = GROUP) -> DataFrame:
    """One row per document: id, ``class_id`` (smallest id of those connected to it by likenesses of ``least`` or more), ``fingerprint``.

    Fingerprints are compared once each. Those that agree in all bits of a band are candidates; at a likeness of 0.8 a pair shares no band with
    probability 4e-4. A band's group above ``group`` fingerprints is dealt to blocks, and pairs of blocks are compared apart, so no task holds
    more than two; only links that connect what was apart leave a task. Null ids join classes but name none, unless all of a class are null.
    Null is the empty text; empty texts are one class. An empty table gives none.
    """
    rows = materialize(fingerprint(docs, doc_id, text).withColumnRenamed(doc_id, "id").withColumnRenamed("fingerprint", "code"))
    banded = materialize(rows.select("code").distinct().mapInArrow(_bands, "code binary, band bigint"))
    sizes = banded.groupBy("band").count().filter("count > 1").withColumn("blocks", F.ceil(F.col("count") / group).cast("int"))
    wanted = banded.join(materialize(sizes.select("band", "blocks")), "band")
    own = F.pmod(F.xxhash64("code"), F.col("blocks")).cast("int")
    pairs = F.explode(F.when(F.col("blocks") == 1, F.array(F.struct(F.lit(0).alias("x"), F.lit(0).alias("y")))).otherwise(
        F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least(o, own).alias("x"), F.greatest(o, own).alias("y")))))
    placed = wanted.select("code", "band", own.alias("own"), pairs.alias("p")).select("code", "band", "p.x", "p.y", F.when(F.col("p.x") == F.col("p.y"), 0).when(F.col("own") == F.col("p.x"), 1).otherwise(2).alias("side"))
    links = placed.groupBy("band", "x", "y").applyInArrow(_links(least), "a binary, b binary")
    linked = components(links)
    named = materialize(rows.join(linked.withColumnRenamed("node", "code"), "code", "left").select("id", "code", F.coalesce("root", "code").alias("root")))
    least_id = materialize(named.groupBy("root").agg(F.min("id").alias("class_id")))
    return named.join(least_id, "root").select(F.col("id").alias(doc_id), "class_id", F.lower(F.hex("code")).alias("fingerprint"))
