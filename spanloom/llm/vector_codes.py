"""Product codes of vectors: codebooks of sub-vectors learnt by dual-tree Lloyd rounds in whole numbers.

Components become integers floor(``SCALE`` * x); a vector is cut into ``PARTS`` equal consecutive parts, each with a codebook of ``ENTRIES``.

1. Blocks of ``BLOCK`` vectors are stored once as trees, one a part: median splits down to leaves of ``LEAF`` sub-vectors, every node with its
   box, its count and the sum of its sub-vectors.
2. A round builds a small tree over the entries of each codebook and walks pairs (node of parts, node of entries) from both roots. An
   entry node is pruned for a node of parts if its least possible distance exceeds the greatest of another; single entries also by the least
   difference of their distances over the box. Where one entry is left, the node goes to it as a whole with its cached sum. Leaves
   with several are decided by integer distances, ties to the lower index.
3. Sums and counts are added per task and then by Spark; the driver sees one row per part, entry and component.

Rows or entries beyond ``SAFE`` do not fit the 64-bit bounds; they are compared one by one in Python integers.
"""

from __future__ import annotations

import hashlib
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from spanloom.llm.common import stretches
from spanloom.session import materialize

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
BLOCK, LEAF, SAFE, LIMB = 8192, 16, 1 << 26, 40


class Tree:
    """Balanced trees over batches of points (batch, n, d), n being a leaf size times a power of two; nodes in heap order."""

    def __init__(self, points: np.ndarray, weight: np.ndarray, leaf: int):
        batch, n, d = points.shape
        order = np.broadcast_to(np.arange(n), (batch, n)).copy()
        low, high = [points.min(1)[:, None]], [points.max(1)[:, None]]
        size = n
        while size > leaf:
            x = points.reshape(batch, n // size, size, d)
            axis = (high[-1] - low[-1]).argmax(2)
            by = np.argsort(np.take_along_axis(x, axis[:, :, None, None], 3)[..., 0], axis=2, kind="stable")
            points = np.take_along_axis(x, by[..., None], 2).reshape(batch, n, d)
            order = np.take_along_axis(order.reshape(batch, n // size, size), by, 2).reshape(batch, n)
            size //= 2
            x = points.reshape(batch, n // size, size, d)
            low.append(x.min(2))
            high.append(x.max(2))
        self.points, self.order, self.leaf, self.depth = points, order, size, len(low) - 1
        self.low, self.high = np.concatenate(low, 1), np.concatenate(high, 1)
        w = weight[order]
        sums, counts = [(points * w[..., None]).reshape(batch, n // size, size, d).sum(2)], [w.reshape(batch, n // size, size).sum(2)]
        for _ in range(self.depth):
            sums.insert(0, sums[0][:, ::2] + sums[0][:, 1::2])
            counts.insert(0, counts[0][:, ::2] + counts[0][:, 1::2])
        self.sums, self.counts = np.concatenate(sums, 1), np.concatenate(counts, 1)

    @classmethod
    def stored(cls, points: bytes, order: bytes, boxes: bytes, sums: bytes, counts: bytes, parts: int) -> Tree:
        self = cls.__new__(cls)
        self.order = np.frombuffer(order, np.int32).reshape(parts, -1)
        n = self.order.shape[1]
        self.points = np.frombuffer(points, np.int32).astype(np.int64).reshape(parts, n, -1)
        self.counts = np.frombuffer(counts, np.int64).reshape(parts, -1)
        nodes, d = self.counts.shape[1], self.points.shape[2]
        self.low, self.high = np.frombuffer(boxes, np.int32).astype(np.int64).reshape(2, parts, nodes, d)
        self.sums = np.frombuffer(sums, np.int64).reshape(parts, nodes, d)
        self.depth = (nodes + 1).bit_length() - 2
        self.leaf = n >> self.depth
        return self

    def blobs(self) -> list[bytes]:
        small = lambda x: np.ascontiguousarray(x, np.int32).tobytes()
        return [small(self.points), small(self.order), small(np.stack([self.low, self.high])), self.sums.tobytes(), self.counts.tobytes()]


def _groups(part: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start of each stretch of equal (part, node) and the stretch of each pair."""
    head = np.r_[True, (part[1:] != part[:-1]) | (node[1:] != node[:-1])]
    return np.flatnonzero(head), np.cumsum(head) - 1


def walk(tree: Tree, book: np.ndarray, stats: dict | None = None) -> np.ndarray:
    """Nearest entry of every point of the trees, in tree order: (parts, n). ``book``: (parts, entries, d).

    With ``stats``, ``sums`` and ``counts`` of each entry are added to it, whole nodes by their cached sums.
    """
    parts, k, d = book.shape
    full = 1 << (k - 1).bit_length()
    padded = np.concatenate([book, np.repeat(book[:, -1:], full - k, 1)], 1)  # copies of the last entry lose every tie
    entries = Tree(padded, np.ones(full, np.int64), 1)
    inner, leaves = (1 << tree.depth) - 1, full - 1
    n = tree.points.shape[1]
    out = np.zeros((parts, n), np.int64)
    p, u, e = np.arange(parts), np.zeros(parts, np.int64), np.zeros(parts, np.int64)
    while len(p):
        gap = np.maximum(np.maximum(tree.low[p, u] - entries.high[p, e], entries.low[p, e] - tree.high[p, u]), 0)
        far = np.maximum(tree.high[p, u] - entries.low[p, e], entries.high[p, e] - tree.low[p, u])
        least, most = (gap * gap).sum(1), (far * far).sum(1)
        head, group = _groups(p, u)
        keep = least <= np.minimum.reduceat(most, head)[group]
        p, u, e, most = p[keep], u[keep], e[keep], most[keep]
        single = e >= leaves
        if single.all():  # all are at one level
            head, group = _groups(p, u)
            index = entries.order[p, e - leaves]
            best = np.lexsort((index, most, group))[head][group]  # the entry that is least far at most, of each node
            mine, other = padded[p, index], padded[p, index[best]]
            corner = np.where(mine > other, tree.high[p, u], tree.low[p, u])
            ahead = ((mine - other) * (mine + other - 2 * corner)).sum(1)  # least d(x, mine) - d(x, other) over the box
            keep = (ahead < 0) | ((ahead == 0) & (index <= index[best]))
            p, u, e, index = p[keep], u[keep], e[keep], index[keep]
            head, group = _groups(p, u)
            alone = np.bincount(group) == 1
            done = head[alone]
            _assign(tree, out, p[done], u[done], index[done], stats, k)
            if len(p) and u[0] >= inner:
                _decide(tree, padded, out, p, u, index, group, alone, stats, k)
                break
            keep = ~alone[group]
            p, u, e = p[keep], u[keep], e[keep]
            p, u, e = np.repeat(p, 2), np.repeat(2 * u + 1, 2), np.repeat(e, 2)
            u[1::2] += 1
        else:
            grow = 2 if u[0] < inner else 1  # parts that are leaves wait for the entries
            p, u, e = np.repeat(p, 2 * grow), np.repeat(u, 2 * grow), np.repeat(2 * e + 1, 2 * grow)
            e[1::2] += 1
            if grow == 2:
                u = 2 * u + 1
                u[2::4] += 1
                u[3::4] += 1
        order = np.lexsort((e, u, p))
        p, u, e = p[order], u[order], e[order]
    return out


def _range(tree: Tree, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First point and number of points of nodes."""
    level = np.floor(np.log2(u + 1)).astype(np.int64)
    size = (tree.leaf << tree.depth) >> level
    return (u + 1 - (1 << level)) * size, size


def _assign(tree: Tree, out: np.ndarray, p: np.ndarray, u: np.ndarray, index: np.ndarray, stats: dict | None, k: int) -> None:
    first, size = _range(tree, u)
    out.reshape(-1)[stretches(p * out.shape[1] + first, size)] = np.repeat(index, size)
    if stats is not None:
        np.add.at(stats["sums"], (p, index), tree.sums[p, u])
        np.add.at(stats["counts"], (p, index), tree.counts[p, u])
        stats["whole"] = stats.get("whole", 0) + int(size.sum())


def _decide(tree: Tree, padded: np.ndarray, out: np.ndarray, p, u, index, group, alone, stats: dict | None, k: int) -> None:
    """Uncertain leaves, point by point."""
    keep = ~alone[group]
    p, u, index = p[keep], u[keep], index[keep]
    if not len(p):
        return
    at = (u - ((1 << tree.depth) - 1))[:, None] * tree.leaf + np.arange(tree.leaf)
    x = tree.points[p[:, None], at] - padded[p, index][:, None]
    key = (x * x).sum(2) * 2 * ENTRIES + index[:, None]
    head, _ = _groups(p, u)
    nearest = np.minimum.reduceat(key, head, axis=0) % (2 * ENTRIES)
    p, at = p[head][:, None], at[head]
    out[p, at] = nearest
    if stats is not None:
        w = stats["weight"][tree.order[p, at]]
        flat = (p * k + nearest).reshape(-1)
        n = out.shape[0] * k
        stats["counts"] += np.bincount(flat, w.reshape(-1), n).astype(np.int64).reshape(-1, k)
        x = (tree.points[p, at] * w[..., None]).reshape(len(flat), -1)
        stats["sums"] += np.stack([np.bincount(flat, c, n).astype(np.int64) for c in x.T], 1).reshape(out.shape[0], k, -1)  # exact: under 2**53


def nearest_exact(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Nearest entries (rows, parts) by Python integers, for rows (rows, parts, d) and books of any size."""
    diff = x[:, :, None] - book[None]
    return (diff * diff).sum(3).argmin(2).astype(np.int64) if len(x) else np.zeros(x.shape[:2], np.int64)


def whole(value: float, scale: int) -> int:
    """floor(scale * value), exactly."""
    n, d = float(value).as_integer_ratio()
    return n * scale // d


_BLOBS = ["points", "tree_order", "boxes", "sums", "counts"]


def _build(parts: int, scale: int, block: int, id_type: pa.DataType, label_type: pa.DataType):
    schema = pa.schema([("ids", pa.list_(id_type)), ("labels", pa.list_(label_type)), *((c, pa.binary()) for c in _BLOBS), ("wide", pa.string())])

    def row(ids: pa.Array, labels: pa.Array, blobs: list, wide: str | None) -> pa.RecordBatch:
        one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
        return pa.RecordBatch.from_arrays([one(ids), one(labels), *(pa.array([v], pa.binary()) for v in blobs), pa.array([wide], pa.string())], schema=schema)

    def emit(ids, labels, x: np.ndarray):
        n = LEAF
        while n < len(x):
            n *= 2
        x = np.concatenate([x, np.repeat(x[-1:], n - len(x), 0)]).reshape(n, parts, -1).transpose(1, 0, 2)
        weight = np.arange(n) < len(ids)
        return row(ids, labels, Tree(np.ascontiguousarray(x), weight.astype(np.int64), LEAF).blobs(), None)

    def run(batches):
        held: list[tuple] = []
        for b in batches:
            if not b.num_rows:
                continue
            x = b.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(b.num_rows, -1)
            big = (np.abs(x) >= SAFE / scale - 1).any(1)
            for lo in range(0, int(big.sum()), 256):
                at = pa.array(np.flatnonzero(big)[lo : lo + 256])
                own = [[whole(v, scale) for v in r] for r in x[at.to_numpy()].tolist()]
                yield row(b.column(0).take(at), b.column(1).take(at), [None] * len(_BLOBS), json.dumps(own))
            at = pa.array(np.flatnonzero(~big))
            held.append((b.column(0).take(at), b.column(1).take(at), np.floor(x[~big] * scale).astype(np.int64)))
            while sum(len(h[2]) for h in held) >= block:
                ids, labels, v = pa.concat_arrays([h[0] for h in held]), pa.concat_arrays([h[1] for h in held]), np.concatenate([h[2] for h in held])
                yield emit(ids.slice(0, block), labels.slice(0, block), v[:block])
                held = [(ids.slice(block), labels.slice(block), v[block:])]
        if held and sum(len(h[2]) for h in held):
            yield emit(pa.concat_arrays([h[0] for h in held]), pa.concat_arrays([h[1] for h in held]), np.concatenate([h[2] for h in held]))

    return run


def _assigned(record: dict, book: np.ndarray, small: bool, stats: dict | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a block (rows, parts, d) and their entries (rows, parts); with ``stats``, sums and counts only."""
    parts, n = len(book), len(record["ids"])
    if record["wide"] is not None:
        x = np.array(json.loads(record["wide"]), object).reshape(n, parts, -1)
        return x, nearest_exact(x, book)
    tree = Tree.stored(*(record[c] for c in _BLOBS), parts)
    if small:
        if stats is not None:
            stats["weight"] = (np.arange(tree.order.shape[1]) < n).astype(np.int64)
        code = walk(tree, book.astype(np.int64), stats)
        if stats is not None:
            return tree.points, code
    x, entries = np.zeros(tree.points.shape, np.int64), np.zeros(tree.order.shape, np.int64)
    np.put_along_axis(x, tree.order[..., None].astype(np.int64), tree.points, 1)
    x = x[:, :n].transpose(1, 0, 2)
    if not small:
        x = x.astype(object)
        return x, nearest_exact(x, book)
    np.put_along_axis(entries, tree.order.astype(np.int64), code, 1)
    return x, entries[:, :n].T


def _records(batches):
    for b in batches:
        for i in range(b.num_rows):
            yield {f.name: b.column(j)[i].values if pa.types.is_list(f.type) else b.column(j)[i].as_py() for j, f in enumerate(b.schema)}


def _is_small(book: np.ndarray) -> bool:
    return max(abs(int(v)) for v in book.reshape(-1)) <= SAFE


_SUMS = "part int, entry int, at int, limb int, value bigint"


def _sum(book: list):
    """Counts (``at`` -1) and component sums of every entry, in limbs of ``LIMB`` bits; one set of rows a task."""
    book = np.array(book, object)

    def run(batches):
        small, (parts, k, d) = _is_small(book), book.shape
        total, n = np.zeros((parts, k, d), object), np.zeros((parts, k), object)
        for r in _records(batches):
            stats = {"sums": np.zeros((parts, k, d), np.int64), "counts": np.zeros((parts, k), np.int64)} if small and r["wide"] is None else None
            x, code = _assigned(r, book, small, stats)
            if stats is not None:
                total += stats["sums"].astype(object)
                n += stats["counts"].astype(object)
                continue
            for own, entry in zip(x, code):
                total[np.arange(parts), entry] += own
                n[np.arange(parts), entry] += 1
        rows = []
        for p in range(parts):
            for e in range(k):
                for at, v in enumerate([n[p, e], *total[p, e]], -1):
                    v, sign, limb = abs(int(v)), 1 if v >= 0 else -1, 0
                    while v:
                        rows.append((p, e, at, limb, sign * (v & ((1 << LIMB) - 1))))
                        v, limb = v >> LIMB, limb + 1
        if rows:
            part, entry, at, limb, value = zip(*rows)
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int32()) for c in (part, entry, at, limb)), pa.array(value, pa.int64())], names=["part", "entry", "at", "limb", "value"])

    return run


def _code(book: list, id_type: pa.DataType, label_type: pa.DataType):
    book = np.array(book, object)
    pairs = np.array([f"{i:02x}" for i in range(256)], "S2")

    def run(batches):
        small, parts = _is_small(book), len(book)
        for r in _records(batches):
            x, code = _assigned(r, book, small)
            diff = x - book[np.arange(parts), code].astype(x.dtype)
            error = [str(v) for v in (diff * diff).sum((1, 2)).tolist()]
            text = np.ascontiguousarray(pairs[code]).view(f"S{2 * parts}")[:, 0].astype(str)
            yield pa.RecordBatch.from_arrays([r["ids"].cast(id_type), r["labels"].cast(label_type), pa.array(text.tolist()), pa.array(error)], names=["id", "label", "code", "error"])

    return run


def usable(vector: str, parts: int = PARTS) -> Column:
    """Whether a vector can be coded: not null, no null or non-finite component, at least one component a part."""
    v = F.col(vector)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return v.isNotNull() & ~F.coalesce(bad, F.lit(True)) & (F.size(v) >= parts) & (F.size(v) % parts == 0)


def fit(blocks: DataFrame, seeds: list, rounds: int) -> list:
    """Codebooks (part, entry, component) after ``rounds`` rounds over the stored blocks."""
    book = seeds
    for _ in range(rounds):
        sums = blocks.mapInArrow(_sum(book), _SUMS).groupBy("part", "entry", "at", "limb").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value"))
        got: dict[tuple, int] = {}
        for r in sums.collect():  # at most parts x entries x (components + 1) x limbs rows
            at = (r["part"], r["entry"], r["at"])
            got[at] = got.get(at, 0) + (int(r["value"]) << (LIMB * r["limb"]))
        book = [[[got.get((p, e, j), 0) // n for j in range(len(old))] if (n := got.get((p, e, -1), 0)) else old for e, old in enumerate(part)] for p, part in enumerate(book)]
    return book


def encode(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES,
           rounds: int = ROUNDS, scale: int = SCALE, block: int = BLOCK) -> tuple[DataFrame, list]:
    """Codes of all usable vectors, and the codebooks they refer to.

    One row per vector: id, ``code`` (hex digits of the entry of each part), ``error`` (squared distance to them) and ``label_error``, the sum over all
    rows of the label, null being a label. Vectors that are null or hold a null or non-finite component are dropped, as are those whose length is
    not the most frequent one (ties: the shortest) or no multiple of ``parts``. Codebooks start from the rows of smallest id, nulls last,
    equal ids by their vectors; with fewer rows than ``entries`` they are smaller. Repeated rows count as often as they occur. An error
    beyond 64 bits is stated as the largest of them. An empty table gives no rows. Other columns are not read.
    """
    id_kind, label_kind = vectors.schema[vec_id].dataType, vectors.schema[label].dataType
    kept = vectors.filter(usable(vector, parts)).select(F.col(vec_id).alias("id"), F.col(label).alias("label"), F.col(vector).alias("vector"))
    lengths = kept.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    kept = kept.filter(F.size("vector") == (lengths["n"] if lengths else 0))
    first = kept.orderBy(F.asc_nulls_last("id"), "vector").limit(entries).select("vector").collect()
    out_schema = f"id {id_kind.simpleString()}, label {label_kind.simpleString()}, code string, error string"
    if not first:
        return kept.select(F.col("id").alias(vec_id), F.lit("").alias("code"), F.lit(0).cast("bigint").alias("error"), F.lit(0).cast("bigint").alias("label_error")), []
    rows = [[whole(v, scale) for v in r["vector"]] for r in first]
    d = len(rows[0]) // parts
    seeds = [[r[p * d : (p + 1) * d] for r in rows] for p in range(parts)]
    types = to_arrow_type(id_kind), to_arrow_type(label_kind)
    blocks = materialize(kept.mapInArrow(_build(parts, scale, block, *types), f"ids array<{id_kind.simpleString()}>, labels array<{label_kind.simpleString()}>, "
                                         + ", ".join(f"{c} binary" for c in _BLOBS) + ", wide string"))
    book = fit(blocks, seeds, rounds)
    # stored before the labels are joined back, so that Spark splits the join of a hot label
    coded = materialize(blocks.mapInArrow(_code(book, *types), out_schema))
    limit = F.lit((1 << 63) - 1).cast("decimal(38,0)")
    wide = F.coalesce(F.expr("try_cast(error AS decimal(38,0))"), limit)
    sums = materialize(coded.groupBy("label").agg(F.least(F.sum(F.least(wide, limit)).cast("decimal(38,0)"), limit).cast("bigint").alias("label_error")).withColumnRenamed("label", "of"))
    out = coded.join(sums, F.col("label").eqNullSafe(F.col("of")))
    return out.select(F.col("id").alias(vec_id), "code", F.least(wide, limit).cast("bigint").alias("error"), "label_error"), book


def digest(book: list) -> str:
    """SHA-256 of all components of the codebooks, in order."""
    return hashlib.sha256(",".join(str(v) for part in book for entry in part for v in entry).encode()).hexdigest()
