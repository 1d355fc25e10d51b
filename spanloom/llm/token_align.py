"""Alignment of two tokenizers' segmentations of one text, by divide and conquer at shared cuts.

A is a byte-level BPE (``tokenizers`` file), B a piece model with byte fallback (``sentencepiece`` file). Both encode space + text;
each token stands for bytes, so each has an end in the bytes of the text. Places where tokens of both end are shared cuts.

1. Cuts. An interval of A tokens between two shared cuts is searched from its middle outwards: the end of a token is looked up among
   the ends of B by bisection. The nearest common end splits the interval, and both halves are searched likewise; an interval without
   one is a leaf group. All intervals of one depth, of all texts of a block, are searched in one numpy step.
2. Links. A and B tokens whose bytes overlap are linked. Rows of one block of texts (``BLOCK`` bytes) share a list of distinct id pairs with
   the number of texts that hold each, and every row refers to that list, so what is counted over the corpus is one row per
   block and pair rather than per document and pair.
3. Counts are summed per pair, compared per A id, joined to the lists and brought back to the rows of each block.

Texts are encoded by pieces between white space where the vocabularies show that no token spans such a place (checked on
loading); pieces that a worker met before are not encoded again.
"""

from __future__ import annotations

import hashlib
import os
import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from spanloom.llm.common import STEP_BYTES, stretches
from spanloom.session import materialize

#: Bytes of text in a block, and bytes of remembered pieces of a worker.
BLOCK, MEMO, LONG = 8 * STEP_BYTES, 1 << 26, 64
#: Runs of white space that start with a space or a line break begin a new piece.
PIECE = re.compile(r"\s*\S+(?:[^\S \n]\s*\S*)*|\s+")


def byte_alphabet() -> dict[str, int]:
    """Characters that byte-level vocabularies write for bytes: printable ones stand for themselves, others follow U+0100."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Pair:
    """Both tokenizers of a worker: ids of texts, bytes of ids."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        letters = byte_alphabet()
        names = {i: t for t, i in self.a.get_vocab(with_added_tokens=True).items()}
        self.bytes_a = [bytes(letters[c] for c in t) if all(c in letters for c in t) else t.encode() for t in (names.get(i, "") for i in range(max(names) + 1))]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        plain = [p.replace("▁", " ") for i, p in enumerate(pieces) if not self.b.is_byte(i)]
        self.free = not any(re.search(r"\S[ \n]| \n", p) for p in plain)
        self.size_a, self.size_b = np.array([len(t) for t in self.bytes_a]), np.array([len(t) for t in self.bytes_b])
        decimal = lambda n, end: np.array([f"{i}{end}" for i in range(n)], object)
        self.text_a = np.stack([decimal(len(self.bytes_a), e) for e in ",|"])
        self.text_b = np.stack([decimal(len(self.bytes_b), e) for e in (",", ";", "")])
        self.blank = self.b.piece_to_id("▁")
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.ids = [np.zeros(0, np.int64), np.zeros(0, np.int64)]  # of all pieces in a row
        self.sizes = [np.zeros(0, np.int64), np.zeros(0, np.int64)]
        self.held = 0

    def _add(self, new: list[str]) -> None:
        """Ids of pieces of space + text that start with a space or a line break; none where their bytes differ from the piece."""
        ids_a = [e.ids for e in self.a.encode_batch_fast(new, add_special_tokens=False)]
        ids_b = self.b.encode([p[p[0] == " " :] for p in new], num_threads=1)  # B adds a space, but not before nothing
        ids_b = [[self.blank] if p == " " else b if p[0] == " " else b[1:] for p, b in zip(new, ids_b)]
        raw = [p.encode() for p in new]
        length = np.fromiter(map(len, raw), np.int64, len(raw))
        flat, sizes = [], []
        for ids, size in ((ids_a, self.size_a), (ids_b, self.size_b)):
            n = np.fromiter(map(len, ids), np.int64, len(ids))
            flat.append(np.fromiter(chain.from_iterable(ids), np.int64, int(n.sum())))
            sizes.append(n)
            total = np.r_[0, np.cumsum(size[flat[-1]])]
            ends = np.cumsum(n)
            length = np.where(total[ends] - total[ends - n] == length, length, -1)
        joined = [b"".join(map(table.__getitem__, ids.tolist())) for table, ids in zip((self.bytes_a, self.bytes_b), flat)]
        if (length < 0).any() or any(j != b"".join(raw) for j in joined):  # some piece differs: look at each
            good = [b"".join(map(self.bytes_a.__getitem__, a)) == r == b"".join(map(self.bytes_b.__getitem__, b)) for a, b, r in zip(ids_a, ids_b, raw)]
            flat, sizes = [ids[np.repeat(good, n)] for ids, n in zip(flat, sizes)], [n * good for n in sizes]
        self.ids = [np.concatenate(x) for x in zip(self.ids, flat)]
        self.sizes = [np.concatenate(x) for x in zip(self.sizes, sizes)]
        self.held += sum(map(len, new)) + 200 * len(new)

    def encode(self, texts: list[str | None]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """For A and B: ids of all texts in a row and the number of each text's ids; texts without tokens have none."""
        if self.held > MEMO:
            self.forget()
        at, count, new, known, long = [], [], [], self.known, []
        for t in texts:
            pieces = (PIECE.findall(f" {t}") if self.free else [f" {t}"]) if t else []
            count.append(len(pieces))
            for p in pieces:
                if (k := known.get(p)) is None:
                    k = known[p] = len(self.sizes[0]) + len(new)
                    new.append(p)
                    if len(p) > LONG:
                        long.append(p)
                at.append(k)
        if new:
            self._add(new)
        for p in long:
            known.pop(p, None)
        at, owner, n = np.array(at, np.int64), np.repeat(np.arange(len(texts)), count), len(texts)
        good = np.bincount(owner[self.sizes[0][at] == 0], minlength=n) == 0  # a piece has tokens, unless their bytes differ
        at, owner = at[good[owner]], owner[good[owner]]
        flat, sizes = [], []
        for ids, size in zip(self.ids, self.sizes):
            flat.append(ids[stretches((np.cumsum(size) - size)[at], size[at])])
            sizes.append(np.bincount(owner, weights=size[at], minlength=n).astype(np.int64))
        return flat, sizes


def shared_cuts(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of the increasing ends ``a`` are ends of ``b`` too. The last ends of both are equal.

    Intervals are split at the common end nearest to their middle; distances from the middle are probed in doubling rings.
    """
    cut = np.zeros(len(a), bool)
    if not len(a):
        return cut
    cut[-1] = True
    common = lambda at: b[np.searchsorted(b, a[at])] == a[at]
    lo, hi = np.array([0]), np.array([len(a) - 1])  # ends lo .. hi - 1 may be cuts
    lo, hi = lo[lo < hi], hi[lo < hi]
    while len(lo):
        found = (lo + hi) // 2
        still = np.flatnonzero(~common(found))
        mid, near = found.copy(), 1
        found[still] = -1
        while len(still):  # ends at distance near .. 2 near - 1 from the middle
            m, low, high = mid[still], lo[still], hi[still]
            right, left = np.minimum(m + near, high), np.maximum(m - 2 * near + 1, low)
            n_right, n_left = np.minimum(m + 2 * near, high) - right, np.maximum(m - near + 1 - left, 0)
            least = np.full(len(still), np.iinfo(np.int64).max)
            for at, n in ((stretches(right, n_right), n_right), (stretches(left, n_left), n_left)):
                who = np.repeat(np.arange(len(still)), n)
                hit = common(at)
                np.minimum.at(least, who[hit], 2 * np.abs(at[hit] - m[who[hit]]) + (at[hit] < m[who[hit]]))
            got = least < np.iinfo(np.int64).max
            far = least[got] >> 1
            found[still[got]] = m[got] + np.where(least[got] & 1, -far, far)
            near *= 2
            still = still[~got & ((m + near < high) | (m - near >= low))]
        split = found >= 0
        lo, hi, found = lo[split], hi[split], found[split]
        cut[found] = True
        lo, hi = np.stack([lo, found + 1], 1).ravel(), np.stack([found, hi], 1).ravel()  # in order, which bisects faster
        lo, hi = lo[lo < hi], hi[lo < hi]
    return cut


class Aligned:
    """Groups and links of a block of texts: ids in a row, number of ids of each text."""

    def __init__(self, pair: Pair, ids: list[np.ndarray], sizes: list[np.ndarray]):
        self.pair, (self.a, self.b), (self.n_a, self.n_b) = pair, ids, sizes
        self.ends_a, self.ends_b = np.cumsum(pair.size_a[self.a]), np.cumsum(pair.size_b[self.b])
        self.cut = shared_cuts(self.ends_a, self.ends_b)
        self.cut_b = np.zeros(len(self.b), bool)
        self.cut_b[np.searchsorted(self.ends_b, self.ends_a[self.cut])] = True
        self.owner_a = np.repeat(np.arange(len(self.n_a)), self.n_a)
        self.n_groups = np.bincount(self.owner_a[self.cut], minlength=len(self.n_a))

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """Text and pair code (A id times size of B's vocabulary + B id) of each overlap; one for each stretch between cuts of either side."""
        ends = np.sort(np.concatenate([self.ends_a, self.ends_b[~self.cut_b]]), kind="stable")
        at = np.searchsorted(self.ends_a, ends)
        return self.owner_a[at], self.a[at] * len(self.pair.bytes_b) + self.b[np.searchsorted(self.ends_b, ends)]

    def texts(self) -> list[str]:
        """``a1,a2|b1;a3|b2`` of each text."""
        group_a, group_b = np.cumsum(self.cut) - self.cut, np.cumsum(self.cut_b) - self.cut_b
        words = np.empty(len(self.a) + len(self.b), object)
        last = np.zeros(len(self.b), np.int64)
        last[(np.cumsum(self.n_b) - 1)[self.n_b > 0]] = 1
        words[np.arange(len(self.a)) + np.searchsorted(group_b, group_a, "left")] = self.pair.text_a[self.cut.astype(int), self.a]
        words[np.arange(len(self.b)) + np.searchsorted(group_a, group_b, "right")] = self.pair.text_b[self.cut_b + last, self.b]
        stop = np.cumsum(self.n_a + self.n_b)
        return ["".join(words[e - n : e].tolist()) for e, n in zip(stop.tolist(), (self.n_a + self.n_b).tolist())]


_PAIRS: dict[tuple[str, str], Pair] = {}


def _pair(paths: tuple[str, str]) -> Pair:
    if paths not in _PAIRS:
        _PAIRS.clear()
        _PAIRS[paths] = Pair(*paths)
    return _PAIRS[paths]


_COUNTS = ["n_a", "n_b", "n_groups", "n_links"]


def _align(paths: tuple[str, str], kind: pa.DataType, keep: bool, limit: int):
    schema = pa.schema([("block", pa.string()), ("id", kind), *((c, pa.int64()) for c in _COUNTS), ("sha", pa.string()), ("groups", pa.string()),
                        ("at", pa.binary()), ("times", pa.binary()), ("pairs", pa.binary()), ("docs", pa.binary())])

    def block(name: str, ids: list, parts: list[tuple]):
        owner, code, base = [], [], 0
        numbers, shas, texts = [[] for _ in _COUNTS], [], []
        for aligned in parts:
            who, pair = aligned.links()
            owner.append(who + base)
            code.append(pair)
            base += len(aligned.n_a)
            for held, v in zip(numbers, (aligned.n_a, aligned.n_b, aligned.n_groups, np.bincount(who, minlength=len(aligned.n_a)))):
                held.append(v)
            own = aligned.texts()
            shas += [hashlib.sha256(t.encode()).hexdigest() if t else "" for t in own]
            texts += own if keep else [None] * len(own)
        pairs, at = np.unique(np.concatenate(code), return_inverse=True)
        key, times = np.unique(np.concatenate(owner) * max(len(pairs), 1) + at, return_counts=True)
        row, at = np.divmod(key, max(len(pairs), 1))
        docs, ends = np.bincount(at, minlength=len(pairs)), np.searchsorted(row, np.arange(base + 1))
        cut = lambda x: [x[i:j].astype(np.int32).tobytes() for i, j in zip(ends, ends[1:])]
        rows = [pa.array([name] * base), pa.concat_arrays(ids), *(pa.array(np.concatenate(n).astype(np.int64)) for n in numbers), pa.array(shas), pa.array(texts, pa.string()),
                pa.array(cut(at), pa.binary()), pa.array(cut(times), pa.binary()), pa.nulls(base, pa.binary()), pa.nulls(base, pa.binary())]
        yield pa.RecordBatch.from_arrays(rows, schema=schema)
        if len(pairs):
            none = {f.name: [None] for f in schema}
            yield pa.RecordBatch.from_pydict(none | {"block": [name], "pairs": [pairs.astype(np.int64).tobytes()], "docs": [docs.astype(np.int64).tobytes()]}, schema)

    def run(batches):
        pair, part, n = _pair(paths), TaskContext.get().partitionId(), 0
        ids, parts, size = [], [], 0
        for b in batches:
            texts, lo = b.column(1).to_pylist(), 0
            while lo < len(texts):
                hi, step = lo, 0
                while hi < len(texts) and (hi == lo or step + len(texts[hi] or "") <= STEP_BYTES):
                    step += len(texts[hi] or "")
                    hi += 1
                parts.append(Aligned(pair, *pair.encode(texts[lo:hi])))
                ids.append(b.column(0).slice(lo, hi - lo))
                lo, size = hi, size + step
                if size >= limit:
                    yield from block(f"{part}-{n}", ids, parts)
                    ids, parts, size, n = [], [], 0, n + 1
        if parts:
            yield from block(f"{part}-{n}", ids, parts)

    return run


def _listed(batches):
    """One row per block and pair."""
    for b in batches:
        for name, pairs, docs in zip(*(c.to_pylist() for c in b.columns)):
            code, n = np.frombuffer(pairs, np.int64), np.frombuffer(docs, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(code)), pa.array(np.arange(len(code), dtype=np.int32)), pa.array(code), pa.array(n)], names=["block", "at", "pair", "docs"])


def _score(rows: pa.Table, counts: pa.Table) -> pa.Table:
    """``n_best`` and ``count_sum`` of the rows of a block from the counts of its pairs."""
    count, best = np.zeros(counts.num_rows, np.int64), np.zeros(counts.num_rows, np.int64)
    at = counts.column("at").to_numpy()
    count[at], best[at] = counts.column("n").to_numpy(), counts.column("best").to_numpy()
    sums: list[list[int]] = [[], []]
    for where, times in zip(rows.column("at").to_pylist(), rows.column("times").to_pylist()):
        i, n = np.frombuffer(where, np.int32), np.frombuffer(times, np.int32).astype(np.int64)
        sums[0].append(int(n @ best[i]))
        sums[1].append(int(n @ count[i]))
    out = rows.drop_columns(["block", "at", "times"])
    return out.append_column("n_best", pa.array(sums[0], pa.int64())).append_column("count_sum", pa.array(sums[1], pa.int64()))


def align(docs: DataFrame, path_a: str | None = None, path_b: str | None = None, doc_id: str = "doc_id", text: str = "text", keep_groups: bool = False, block: int = BLOCK) -> DataFrame:
    """One row per document: id, ``n_a`` and ``n_b`` tokens, ``n_groups``, ``n_links``, ``n_best``, ``count_sum``, ``groups_sha256``.

    A link's count is the number of documents that hold its pair of ids linked. ``n_best`` are the links whose count is the highest of their
    A id, all of a tie; ``count_sum`` adds the counts of all links. With ``keep_groups`` the column ``groups`` holds ``a1,a2|b1;a3|b2,b3``.
    Null and empty texts, and those whose tokens do not give back space + text, have no tokens: zeros and ''. Repeated rows
    count as documents of their own. An empty table gives none. Other columns are not read. The paths, by default two public
    vocabularies, must be present on all executors. ``block``: bytes of text that share a list of pairs.
    """
    import public_tokenizers

    paths = (path_a or public_tokenizers.path("byte_bpe_50k.json"), path_b or public_tokenizers.path("piece_bpe_32k.model"))
    kind = docs.schema[doc_id].dataType
    numbers = ", ".join(f"{c} bigint" for c in _COUNTS)
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).mapInArrow(
        _align(paths, to_arrow_type(kind), keep_groups, block), f"block string, id {kind.simpleString()}, {numbers}, sha string, groups string, at binary, times binary, pairs binary, docs binary")
    rows = materialize(rows)
    listed = rows.filter("pairs is not null").select("block", "pairs", "docs").mapInArrow(_listed, "block string, at int, pair bigint, docs bigint")
    size_b = _vocabulary(paths[1])
    counts = listed.groupBy("pair").agg(F.sum("docs").alias("n")).withColumn("a", F.floor(F.col("pair") / size_b))
    # an A id has at most as many pairs as B has ids
    counts = counts.withColumn("best", (F.col("n") == F.max("n").over(Window.partitionBy("a"))).cast("bigint")).drop("a")
    looked = listed.drop("docs").join(materialize(counts), "pair").select("block", "at", "n", "best")
    done = rows.filter("at is not null").drop("pairs", "docs")
    out = done.groupBy("block").cogroup(looked.groupBy("block")).applyInArrow(_score, f"id {kind.simpleString()}, {numbers}, sha string, groups string, n_best bigint, count_sum bigint")
    out = out.select(F.col("id").alias(doc_id), *_COUNTS, "n_best", "count_sum", F.col("sha").alias("groups_sha256"), "groups")
    return out if keep_groups else out.drop("groups")


def _vocabulary(path: str) -> int:
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path).vocab_size()
