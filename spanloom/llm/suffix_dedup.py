"""Removal of repeated byte strings by merging Burrows-Wheeler transforms of shards.

A byte goes if a string of ``LENGTH`` bytes that covers it starts anywhere else, in the same text or another.

1. Windows. Every window of ``LENGTH`` bytes is assigned to an anchor in it: the string of ``ANCHOR`` bytes with the least hash.
   Equal windows have equal anchors, so windows whose anchor occurs once in the corpus are unique. Neighbouring windows of one
   anchor make a run; equal runs are counted, and a run that occurs twice is repeated as a whole.
2. Runs that share an anchor but differ can still share windows. One context of each is gathered by anchor. The contexts of a
   task are cut into shards; each shard's suffixes are sorted by their first ``LEAD`` bytes, giving its transform, and the shards
   are interleaved by that lead. The interleave is then refined, never re-sorted by comparing suffixes: taken in the order of depth
   d, the suffixes s steps earlier (s steps of the LF mapping) are dealt to the blocks they stand in, which orders them to depth
   d + s. Block borders are the places where the common prefix is shorter than the depth. Blocks of one suffix are settled and
   leave. Blocks of two or more at depth ``LENGTH`` are the repeated intervals.
3. An anchor whose contexts exceed ``HOT`` bytes would fill a task. Its windows are counted by two hashes in a group-by instead.

Texts are named by SHA-256; copies of a text count as other places and are cut once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import BYTE_VALUES, Spans, U, by_batch, sift, steps
from spanloom.session import materialize

LENGTH, ANCHOR, LEAD = 400, 128, 8
SHARD, CHUNK, HOT = 1 << 18, 1 << 21, 1 << 25
_HIGH, _LOW = U(0xFFFFFFFF00000000), U(0xFFFFFFFF)


def _name(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))


def runs(buf: np.ndarray, offs: np.ndarray, length: int, anchor: int) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor: text, first and last start, anchor hash, two hashes of the run's bytes."""
    n, span = len(buf) - anchor + 1, length - anchor + 1
    empty = np.zeros(0, np.int64)
    if n < span:
        return empty, empty, empty, empty, empty, empty
    sums = Spans(BYTE_VALUES[buf])
    at = np.arange(n)
    h = sums.hash(at, at + anchor)
    least, width = (h & _HIGH) | at.astype(U), 1  # ties go to the first place
    while 2 * width <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if span > width:
        least = np.minimum(least[: width - span], least[span - width :])
    start = np.arange(len(least))
    owner = np.searchsorted(offs, start, "right") - 1
    inside = start + length <= offs[owner + 1]
    start, owner, place = start[inside], owner[inside], (least[inside] & _LOW).astype(np.int64)
    if not len(start):
        return empty, empty, empty, empty, empty, empty
    head = np.flatnonzero(np.r_[True, (place[1:] != place[:-1]) | (owner[1:] != owner[:-1])])
    lo, hi = start[head], start[np.r_[head[1:], len(start)] - 1]
    other = Spans(BYTE_VALUES[buf], 1)
    code = [h[place[head]], sums.hash(lo, hi + length), other.hash(lo, hi + length)]
    return owner[head], lo, hi, *(c.view(np.int64) for c in code)


def _runs(length: int, anchor: int):
    schema = pa.schema([("name", pa.binary()), ("key", pa.int64()), ("c1", pa.int64()), ("c2", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32())])

    def run(b: pa.RecordBatch):
        parts: list[list] = [[] for _ in schema]
        for first, _, buf, offs in steps(b.column(1)):
            owner, lo, hi, key, c1, c2 = runs(buf, offs, length, anchor)
            for p, v in zip(parts, (owner + first, key, c1, c2, lo - offs[owner], hi - offs[owner])):
                p.append(v)
        row, *rest = (np.concatenate(p).astype(np.int64) for p in parts)
        return pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), *(pa.array(v).cast(f.type) for v, f in zip(rest, list(schema)[1:]))], schema=schema)

    return by_batch(run)


class Interleave:
    """Suffixes of several shards in one order, refined in depth; ``rank`` names the block of a suffix, settled ones are dropped.

    ``left``: bytes from each place to the end of its context; a suffix that ends before the depth is dropped too.
    """

    def __init__(self, shards: list[np.ndarray], left: np.ndarray):
        buf = np.concatenate(shards)
        self.n, self.depth, self.left = len(buf), LEAD, left
        padded = np.concatenate([buf, np.zeros(LEAD, np.uint8)])
        lead = np.zeros(self.n, U)
        for k in range(LEAD):
            lead = lead << U(8) | padded[k : k + self.n].astype(U)
        at, sorted_ = 0, []
        for s in shards:  # each shard's own transform
            sorted_.append(at + np.argsort(lead[at : at + len(s)], kind="stable"))
            at += len(s)
        order = np.concatenate(sorted_)
        order = order[np.argsort(lead[order], kind="stable")]  # merges the sorted runs
        self.rank, self.order = np.full(self.n + 1, -1, np.int32), order[:0]  # -1: settled
        order = order[left[order] >= LEAD]
        lead = lead[order]
        self._border(order, np.r_[True, lead[1:] != lead[:-1]])

    def _border(self, order: np.ndarray, new: np.ndarray) -> None:
        """Rank by block; suffixes alone in their block are settled."""
        self.rank[self.order] = -1
        alone = new & np.r_[new[1:], True] if len(new) else new
        self.order = order[~alone]
        self.rank[self.order] = np.cumsum(new, dtype=np.int32)[~alone]

    def refine(self, step: int) -> None:
        """From depth d to d + step, for a step of at most d."""
        before = self.order - step
        before = before[before >= 0]
        before = before[self.left[before] >= self.depth + step]
        block = self.rank[before]
        before, block = before[block >= 0], block[block >= 0]
        before = before[np.argsort(block, kind="stable")]
        if len(before):
            a, z = self.rank[before], self.rank[before + step]
            self._border(before, np.r_[True, (a[1:] != a[:-1]) | (z[1:] != z[:-1])])
        else:
            self._border(before, np.zeros(0, bool))
        self.depth += step

    def repeated(self, length: int) -> np.ndarray:
        """Whether the string of ``length`` bytes from each place starts at another place too."""
        while self.depth < length:
            self.refine(min(self.depth, length - self.depth))
        return self.rank[: self.n] >= 0


def shared_windows(contexts: list[bytes], length: int) -> list[np.ndarray]:
    """For each context: which of its windows occur elsewhere in the contexts."""
    sizes = np.array([len(c) for c in contexts])
    ends = np.cumsum(sizes)
    flat, cuts = np.frombuffer(b"".join(contexts), np.uint8), [0]
    for e in ends:
        if e - cuts[-1] >= SHARD or e == ends[-1]:
            cuts.append(int(e))
    left = np.repeat(ends, sizes) - np.arange(len(flat))
    found = Interleave([flat[a:z] for a, z in zip(cuts, cuts[1:])], left).repeated(length)
    return [found[e - s : e - length + 1] for s, e in zip(sizes, ends)]


def _stretches(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.flatnonzero(np.diff(np.r_[False, mask, False].astype(np.int8)))
    return edge[::2], edge[1::2] - 1


_SPANS = "name binary, lo int, hi int"


def _merge(length: int):
    """For contexts sorted by anchor: runs of repeated windows in those that are known once."""
    schema = pa.schema([("name", pa.binary()), ("lo", pa.int32()), ("hi", pa.int32())])

    def found(rows: list) -> pa.RecordBatch:
        out: list[list] = [[], [], []]
        for (name, lo, n, _), mask in zip(rows, shared_windows([r[3] for r in rows], length)):
            if n == 1:
                for a, z in zip(*_stretches(mask)):
                    for column, v in zip(out, (name, lo + int(a), lo + int(z))):
                        column.append(v)
        return pa.RecordBatch.from_pydict(dict(zip(schema.names, out)), schema)

    def run(batches):
        rows, size, last = [], 0, None
        for b in batches:
            for key, name, lo, n, context in zip(*(c.to_pylist() for c in b.columns)):
                if size >= CHUNK and key != last:
                    yield found(rows)
                    rows, size = [], 0
                rows.append((name, lo, n, context))
                size, last = size + len(context), key
        if rows:
            yield found(rows)

    return run


def _contexts(length: int):
    schema = pa.schema([("key", pa.int64()), ("name", pa.binary()), ("lo", pa.int32()), ("n", pa.int64()), ("hot", pa.bool_()), ("context", pa.binary())])

    def run(b: pa.RecordBatch) -> dict[str, list]:
        out: dict[str, list] = {c: [] for c in schema.names}
        for name, text, wanted in zip(*(c.to_pylist() for c in b.columns)):
            raw = text.encode()
            for w in wanted:
                for c, v in zip(schema.names, (w["key"], name, w["lo"], w["n"], w["hot"], raw[w["lo"] : w["hi"] + length])):
                    out[c].append(v)
        return out

    return by_batch(run, schema)


def _windows(length: int):
    schema = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("name", pa.binary()), ("start", pa.int32()), ("n", pa.int64())])

    def run(b: pa.RecordBatch):
        for name, lo, n, context in zip(*(c.to_pylist() for c in b.columns)):
            values = BYTE_VALUES[np.frombuffer(context, np.uint8)]
            at = np.arange(len(context) - length + 1)
            yield pa.RecordBatch.from_arrays([*(pa.array(Spans(values, k).hash(at, at + length).view(np.int64)) for k in (0, 1)), pa.array([name] * len(at), pa.binary()),
                                              pa.array((at + lo).astype(np.int32)), pa.array(np.full(len(at), n))], schema=schema)

    return lambda batches: (out for b in batches if b.num_rows for out in run(b))


def _texts(rows: DataFrame, names: DataFrame) -> DataFrame:
    """One row per distinct text among ``names``, and some others."""
    return sift(rows, names, "name").groupBy("name").agg(F.first("text").alias("text"))


def repeats(docs: DataFrame, text: str = "text", length: int = LENGTH, anchor: int = ANCHOR, hot: int = HOT) -> DataFrame:
    """Distinct runs of repeated windows: ``name`` of the text, ``lo`` and ``hi``, first and last start in bytes."""
    rows = docs.select(_name(F.col(text)).alias("name"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    every = materialize(rows.mapInArrow(_runs(length, anchor), "name binary, key bigint, c1 bigint, c2 bigint, lo int, hi int"))
    # what is joined back to hot keys is stored first: Spark splits a skewed join only if no aggregate shares its stage
    twice = materialize(every.groupBy("key").agg(F.count(F.lit(1)).alias("times")).filter("times > 1").select("key"))
    known = materialize(every.join(twice, "key", "left_semi"))
    run = known.groupBy("key", "c1", "c2").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("name", "lo", "hi")).alias("at"))
    run = materialize(run)
    size = F.sum(F.col("at.hi") - F.col("at.lo") + length)
    sharing = materialize(run.groupBy("key").agg(F.count(F.lit(1)).alias("kinds"), size.alias("size")).filter("kinds > 1").select("key", (F.col("size") > hot).alias("hot")))
    whole = known.join(run.filter("n > 1").select("key", "c1", "c2"), ["key", "c1", "c2"], "left_semi").select("name", "lo", "hi").distinct()
    wanted = run.join(sharing, "key").select("at.name", F.struct("key", "at.lo", "at.hi", "n", "hot").alias("w")).groupBy("name").agg(F.collect_list("w").alias("wanted"))
    wanted = materialize(wanted)
    contexts = _texts(rows, wanted).join(wanted, "name").select("name", "text", "wanted").mapInArrow(_contexts(length), "key bigint, name binary, lo int, n bigint, hot boolean, context binary")
    contexts = materialize(contexts)
    cold = contexts.filter("not hot").repartition("key").sortWithinPartitions("key", "name", "lo").select("key", "name", "lo", "n", "context")
    spans = whole.union(cold.mapInArrow(_merge(length), _SPANS))
    busy = contexts.filter("hot")
    if not busy.isEmpty():
        windows = busy.select("name", "lo", "n", "context").mapInArrow(_windows(length), "h1 bigint, h2 bigint, name binary, start int, n bigint")
        often = materialize(windows.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("times")).filter("times > 1"))
        spans = spans.union(windows.filter("n = 1").join(often, ["h1", "h2"], "left_semi").select("name", F.col("start"), F.col("start")))
    return materialize(spans)


def _cut(length: int):
    schema = pa.schema([("name", pa.binary()), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), ("kept", pa.binary())])

    def run(b: pa.RecordBatch) -> dict[str, list]:
        out: dict[str, list] = {c: [] for c in schema.names}
        for name, text, starts in zip(*(c.to_pylist() for c in b.columns)):
            raw, spans, kept, at = text.encode(), [], [], 0
            for s in sorted((s["lo"], s["hi"] + length) for s in starts):
                if spans and s[0] <= spans[-1]["end"]:
                    spans[-1]["end"] = max(spans[-1]["end"], s[1])
                else:
                    spans.append({"start": s[0], "end": s[1]})
            for s in spans:
                kept.append(raw[at : s["start"]])
                at = s["end"]
            for c, v in zip(schema.names, (name, spans, b"".join([*kept, raw[at:]]))):
                out[c].append(v)
        return out

    return by_batch(run, schema)


def cut(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, anchor: int = ANCHOR, hot: int = HOT) -> DataFrame:
    """One row per document: id, ``n_bytes``, ``spans`` (maximal removed runs of bytes), ``kept`` (bytes left; null if all are), ``sha256`` of the whole text.

    Null is the empty text; texts shorter than ``length`` lose nothing. Repeated rows are copies of each other. A cut may part
    a multi-byte character, so what is left is bytes. Other columns are not read.
    """
    rows = docs.select(_name(F.col(text)).alias("name"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    spans = repeats(docs, text, length, anchor, hot)
    by_text = materialize(spans.groupBy("name").agg(F.collect_set(F.struct("lo", "hi")).alias("starts")))
    changed = _texts(rows, by_text).join(by_text, "name").select("name", "text", "starts").mapInArrow(_cut(length), "name binary, spans array<struct<start:int,end:int>>, kept binary")
    changed = materialize(changed)
    base = docs.select(F.col(doc_id).alias("id"), _name(F.col(text)).alias("name"), F.octet_length(F.coalesce(F.col(text), F.lit(""))).cast("bigint").alias("n_bytes"))
    none = F.array().cast("array<struct<start:int,end:int>>")
    return base.join(changed, "name", "left").select(F.col("id").alias(doc_id), "n_bytes", F.coalesce("spans", none).alias("spans"), "kept", F.lower(F.hex("name")).alias("sha256"))


def report(result: DataFrame) -> DataFrame:
    """Counts of the removed bytes and digest of the bytes left."""
    removed = F.aggregate("spans", F.lit(0).cast("bigint"), lambda a, s: a + s["end"] - s["start"])
    return result.select("*", removed.alias("n_removed"), F.size("spans").cast("bigint").alias("n_spans"), F.coalesce(F.sha2("kept", 256), F.col("sha256")).alias("kept_sha256"))
