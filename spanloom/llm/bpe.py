"""Byte-level BPE encoding and decoding with two tiers of lookup.

First tier: a minimal perfect hash over the vocabulary (hash and displace, as many slots as tokens) resolves, for a batch
of distinct pre-tokens at once, those that are tokens as a whole; the bytes in the slot are compared. Second tier: other
pre-tokens are merged over linked bytes with a queue of ranked pairs: long ones with a binary heap, in O(n log n) for any
length, short ones many at a time, where the queue of each is a column whose lowest entry is popped.

The vocabulary is read on the driver and broadcast; its size is checked. Tasks are independent of each other: a map without
shuffle. Each Python worker keeps recent pre-tokens in two generations of bounded size, their ids as bytes, and the younger
one from task to task: the worker lives on through later stages, and what it keeps counts there.
"""

from __future__ import annotations

import base64
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from spanloom.llm.common import BYTE_VALUES, STEP_BYTES, Spans, mix

#: A vocabulary is broadcast up to this many tokens; real ones have far fewer.
MAX_TOKENS = 4_000_000
#: Distinct pre-tokens in one generation of a worker's cache.
CACHE = 150_000
KEYS_A_BUCKET = 4


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a ``.tiktoken`` file."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    if len(ranks) > MAX_TOKENS:
        raise ValueError(f"{path} has {len(ranks)} tokens, over the {MAX_TOKENS} that are broadcast")
    return ranks


def hashes(keys: list[bytes]) -> np.ndarray:
    offs = np.zeros(len(keys) + 1, np.int64)
    np.cumsum([len(k) for k in keys], out=offs[1:])
    return Spans(BYTE_VALUES[np.frombuffer(b"".join(keys), np.uint8)]).hash(offs[:-1], offs[1:])


class PerfectHash:
    """Minimal perfect hash of byte strings: each key has a slot of its own in 0..n-1, found from a displacement per bucket."""

    def __init__(self, keys: list[bytes]):
        h, n = hashes(keys), len(keys)
        self.n, self.buckets = n, max(1, n // KEYS_A_BUCKET)
        self.shift = np.zeros(self.buckets, np.uint64)
        bucket = (h % np.uint64(self.buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        ends = np.cumsum(np.bincount(bucket, minlength=self.buckets))
        sizes = np.diff(ends, prepend=0)
        free, self.keys = np.ones(n, bool), [b""] * n
        trials = np.arange(256, dtype=np.uint64)
        for b in np.argsort(-sizes, kind="stable"):
            if not sizes[b]:
                break
            own = order[ends[b] - sizes[b] : ends[b]]
            base = 0
            while True:
                slots = self._slot(h[own][None, :], (trials + np.uint64(base))[:, None])
                good = free[slots].all(1)
                if len(own) > 1:
                    ranked = np.sort(slots, 1)
                    good &= (ranked[:, 1:] != ranked[:, :-1]).all(1)
                if good.any():
                    k = int(good.argmax())
                    self.shift[b] = base + k
                    free[slots[k]] = False
                    for i, s in zip(own, slots[k]):
                        self.keys[s] = keys[i]
                    break
                base += 256

    def _slot(self, h: np.ndarray, shift: np.ndarray) -> np.ndarray:
        return (mix(h + shift * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(self.n)).astype(np.int64)

    def find(self, keys: list[bytes]) -> list[int]:
        """Slot of each key, -1 for a key that is not in the table."""
        if not keys or not self.n:
            return [-1] * len(keys)
        h = hashes(keys)
        slots = self._slot(h, self.shift[(h % np.uint64(self.buckets)).astype(np.int64)]).tolist()
        own = self.keys
        return [s if own[s] == k else -1 for s, k in zip(slots, keys)]


def merge(word: bytes, ranks: dict[bytes, int]) -> tuple[int, ...]:
    """Ids of ``word``: always the pair of lowest rank, leftmost first, is merged next."""
    n, get = len(word), ranks.get
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    rank = [-1] * n
    heap = []
    for i in range(n - 1):
        r = get(word[i : i + 2])
        if r is not None:
            rank[i] = r
            heap.append(r << 32 | i)
    heapify(heap)
    while heap:
        top = heappop(heap)
        i = top & 0xFFFFFFFF
        if rank[i] != top >> 32:
            continue  # one of the two has been merged since
        j = after[i]
        end = after[i] = after[j]
        rank[i] = rank[j] = -1
        if end < n:
            before[end] = i
            r = get(word[i : after[end]])
            if r is not None:
                rank[i] = r
                heappush(heap, r << 32 | i)
        left = before[i]
        if left >= 0:
            r = get(word[left:end])
            if r is None:
                rank[left] = -1
            else:
                rank[left] = r
                heappush(heap, r << 32 | left)
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : after[i]]])
        i = after[i]
    return tuple(out)


class Pairs:
    """Ranks of all pairs of tokens that are a token when joined, and merging of many short words at once.

    Each word has its parts as linked positions and a queue of ranks, one for each pair. In every round the lowest rank of
    each queue is popped, leftmost first, its parts are linked together and the two new pairs are queued; words step together.
    """

    NONE = np.int32(2**31 - 1)

    def __init__(self, ranks: dict[bytes, int]):
        pairs = ((ranks[k[:i]] << 32 | ranks[k[i:]], r) for k, r in ranks.items() for i in range(1, len(k)) if k[:i] in ranks and k[i:] in ranks)
        found = np.fromiter(chain.from_iterable(pairs), np.int64).reshape(-1, 2)
        found = found[np.argsort(found[:, 0], kind="stable")] if len(found) else np.array([[-1, 0]])
        self.key, self.rank = found[:, 0].copy(), found[:, 1].astype(np.int32)
        self.byte = np.array([ranks.get(bytes([b]), -1) for b in range(256)], np.int64)
        both = (self.byte[:, None] << 32 | self.byte[None, :]).ravel()
        self.first = self.find(both >> 32, both & 0xFFFFFFFF).reshape(256, 256)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 32 | right
        at = np.searchsorted(self.key, key)
        at[at == len(self.key)] = 0
        return np.where(self.key[at] == key, self.rank[at], self.NONE)

    def merge(self, words: list[bytes], size: int) -> list[tuple[int, ...]]:
        """Ids of words of ``size`` bytes each."""
        flat, ends = self.merged(words, size)
        return [tuple(flat[a:z].tolist()) for a, z in zip(np.r_[0, ends], ends)]

    def merged(self, words: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words of ``size`` bytes each in a row, and the end of each word in them."""
        n = len(words)
        raw = np.frombuffer(b"".join(words), np.uint8).reshape(n, size).T
        ids = self.byte[raw]
        queue = np.full((size, n), self.NONE, np.int32)
        queue[:-1] = self.first[raw[:-1], raw[1:]]
        after = np.repeat(np.arange(1, size + 1)[:, None], n, 1)
        before = after - 2
        alive = np.ones((size, n), bool)
        live = np.arange(n)
        while True:
            top = queue[:, live]
            at = top.argmin(0)
            rank = top[at, np.arange(len(live))]
            some = rank != self.NONE
            if not some.any():
                break
            live, at, rank = live[some], at[some], rank[some]
            gone = after[at, live]
            end = after[gone, live]
            ids[at, live], alive[gone, live], after[at, live] = rank, False, end
            queue[at, live] = queue[gone, live] = self.NONE
            more = np.flatnonzero(end < size)
            w, i, e = live[more], at[more], end[more]
            before[e, w] = i
            queue[i, w] = self.find(ids[i, w], ids[e, w])
            left = before[at, live]
            more = np.flatnonzero(left >= 0)
            w, i, e = live[more], left[more], at[more]
            queue[i, w] = self.find(ids[i, w], ids[e, w])
        return ids.T[alive.T], np.cumsum(alive.sum(0))


#: Words of up to so many bytes are merged together; longer ones each with a heap.
SHORT = 40


class Codec:
    """Encoder and decoder of one worker."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.pairs = Pairs(ranks)
        self.ranks, self.cut = ranks, regex.compile(pattern).findall
        self.whole = PerfectHash(list(ranks))
        self.slot_ids = [np.int32(ranks[k]).tobytes() for k in self.whole.keys]
        size = max(ranks.values(), default=-1) + 1
        tokens = [b""] * size
        for k, i in ranks.items():
            tokens[i] = k
        self.raw, self.size = np.frombuffer(b"".join(tokens), np.uint8), np.array([len(t) for t in tokens], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.recent: dict[str, bytes] = {}  # ids of 4 bytes each
        self.older: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and the end of each text in them."""
        cut = [self.cut(t) for t in texts]
        if len(self.recent) > CACHE:
            self.recent, self.older = {}, self.recent
        recent, older = self.recent, self.older
        new, distinct = [], set().union(*cut)
        for t in distinct.difference(recent):
            if (ids := older.get(t)) is None:
                new.append(t)
            else:
                recent[t] = ids
        raw = [t.encode() for t in new]
        by_size: dict[int, list[int]] = {}
        for k, slot in enumerate(self.whole.find(raw)):
            if slot >= 0:
                recent[new[k]] = self.slot_ids[slot]
            elif len(raw[k]) > SHORT:
                recent[new[k]] = np.array(merge(raw[k], self.ranks), np.int32).tobytes()
            else:
                by_size.setdefault(len(raw[k]), []).append(k)
        for size, some in by_size.items():
            flat, ends = self.pairs.merged([raw[k] for k in some], size)
            flat, ends = flat.astype(np.int32).tobytes(), (4 * ends).tolist()
            for k, a, z in zip(some, [0, *ends], ends):
                recent[new[k]] = flat[a:z]
        rows, place = [recent[t] for t in distinct], dict(zip(distinct, range(len(distinct))))
        size = np.fromiter(map(len, rows), np.int64, len(rows)) // 4
        ids = np.frombuffer(b"".join(rows), np.int32)
        ends = np.cumsum([len(c) for c in cut])
        at = np.fromiter(map(place.__getitem__, chain.from_iterable(cut)), np.int64, int(ends[-1]))
        return ids[_places((np.cumsum(size) - size)[at], size[at])], np.r_[0, np.cumsum(size[at])][ends]

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all ids in a row, and the end of each text in them."""
        size = self.size[ids]
        return self.raw[_places(self.start[ids], size)], np.r_[0, np.cumsum(size)][ends]


def _places(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start, start + 1, … of each stretch, one stretch after the other."""
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())


_CODECS: dict[int, Codec] = {}


def _codec(shared) -> Codec:
    if (key := shared.id) not in _CODECS:
        _CODECS.clear()  # a worker serves one vocabulary at a time
        _CODECS[key] = Codec(*shared.value)
    return _CODECS[key]


class _Shared:
    """A broadcast and a name for it that tasks can compare."""

    def __init__(self, broadcast):
        self.broadcast, self.id = broadcast, broadcast.id if hasattr(broadcast, "id") else broadcast._jbroadcast.id()

    @property
    def value(self):
        return self.broadcast.value


def share(spark, path: str | None = None, pattern: str | None = None) -> _Shared:
    """Broadcast a vocabulary; by default the public one of 50k tokens with its pattern."""
    import public_tokenizers

    return _Shared(spark.sparkContext.broadcast((read_ranks(path or public_tokenizers.path("byte_bpe_50k.tiktoken")), pattern or public_tokenizers.PATTERN)))


def _groups(texts: list[str | None]):
    lo = size = 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= STEP_BYTES:
            yield lo, i + 1
            lo, size = i + 1, 0
    if lo < len(texts):
        yield lo, len(texts)


def encode(docs: DataFrame, shared: _Shared, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: its id, ``ids`` and ``decoded``, the bytes that decoding these ids gives.

    Null and empty texts have no ids and decode to no bytes. Repeated rows are encoded alike. Special tokens are ordinary
    text. Other columns are not read.
    """
    kind = docs.schema[doc_id].dataType
    schema = pa.schema([("id", to_arrow_type(kind)), ("ids", pa.list_(pa.int32())), ("decoded", pa.binary())])

    def run(batches):
        codec = _codec(shared)
        for b in batches:
            texts = b.column(1).to_pylist()
            for lo, hi in _groups(texts):
                ids, ends = codec.encode([t or "" for t in texts[lo:hi]])
                raw, stops = codec.decode(ids, ends)
                column = pa.ListArray.from_arrays(pa.array(np.r_[0, ends].astype(np.int32)), pa.array(ids))
                decoded = pa.Array.from_buffers(pa.binary(), hi - lo, [None, pa.py_buffer(np.r_[0, stops].astype(np.int32)), pa.py_buffer(raw)])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), column, decoded], schema=schema)
        codec.older = {}

    out = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).mapInArrow(run, f"id {kind.simpleString()}, ids array<int>, decoded binary")
    return out.withColumnRenamed("id", doc_id)


def report(encoded: DataFrame) -> DataFrame:
    """Counts and digests of the ids and of the decoded bytes."""
    return encoded.select("*", F.size("ids").cast("bigint").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
                          F.sha2("decoded", 256).alias("decoded_sha256")).drop("ids", "decoded")
