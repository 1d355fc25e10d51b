"""Near-duplicate documents by ProbMinHash signatures, banding and exact verification.

A document is its set of word shingles, each weighted 1 + ln(count). ProbMinHash: every shingle is a Poisson process with its
weight as rate, whose arrivals fall into random slots; a slot keeps its earliest arrival. A shingle stops as soon as its next
arrival is later than all slots' earliest. Two slots agree with the probability Jaccard similarity of the weighted sets. That
may be far below the Jaccard similarity of the plain sets, by which links are verified, where a shingle is repeated often. So
every document has the bands of its plain set too, all weights 1, where both are equal: a pair of similarity s shares none of
them with probability (1 - s ** ``DEPTH``) ** ``BANDS``, whatever its counts. Without repeated shingles both kinds are the same bands.

Documents with the same shingle set are one node, so copies are never compared. Nodes that share a band become candidates;
their components are only a superset, found on ids. Then the sets of candidates are read once and the components of links with
Jaccard similarity >= ``SIMILARITY`` are found exactly, component by component: a breadth-first search compares a visited node with
all unvisited ones through an inverted index and ends when none is left. Candidate components too large for a task are
searched by band and by pairs of blocks of a band, first a few bands, and later bands only where they hold nodes not yet
connected. No pair that shares a band is left out, at any size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from spanloom.llm.common import Spans, Words, by_batch, mix, sift, steps
from spanloom.llm.graphs import components
from spanloom.session import materialize

SHINGLE, SIMILARITY = 5, 0.8
BANDS, DEPTH = 32, 4
SLOTS = BANDS * DEPTH
#: Shingles of one search; larger groups are searched in blocks.
GROUP = 4_000_000
#: Bands searched together in large groups.
TURNS = ((0, 1), (1, 4), (4, BANDS))
_C1, _C2, _C3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)


def shingles(buf: np.ndarray, offs: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text: text, hash, count; sorted by text, then hash. A text of fewer words is one shingle."""
    w = Words(buf, offs)
    sums, n = Spans(w.hash, 1), np.diff(w.bounds)
    at = w.windows(size)
    short = np.flatnonzero((n > 0) & (n < size))
    start = np.concatenate([at, w.bounds[short]])
    key = sums.hash(start, np.concatenate([at + size, w.bounds[short + 1]]))
    owner = np.concatenate([w.owner()[at], short])
    order = np.lexsort((key, owner))
    owner, key = owner[order], key[order]
    head = np.flatnonzero(np.r_[True, (owner[1:] != owner[:-1]) | (key[1:] != key[:-1])]) if len(key) else np.zeros(0, np.int64)
    return owner[head], key[head], np.diff(np.r_[head, len(key)])


def signatures(owner: np.ndarray, key: np.ndarray, weight: np.ndarray, n: int, slots: int = SLOTS) -> np.ndarray:
    """ProbMinHash signature of each of ``n`` weighted sets: the shingle that arrives first in each slot."""
    time, first = np.full(n * slots, np.inf), np.zeros(n * slots, np.uint64)
    last = np.full(n, np.inf)
    t, alive = np.zeros(len(key)), np.arange(len(key))
    step = 0
    while len(alive):
        step += 1
        salt, pick = (np.uint64(step * int(c) & 0xFFFFFFFFFFFFFFFF) for c in (_C1, _C3))
        k = key[alive]
        u = ((mix(k + salt) >> np.uint64(11)).astype(np.float64) + 1) * 2.0**-53
        t[alive] -= np.log(u) / weight[alive]
        alive = alive[t[alive] < last[owner[alive]]]
        k = key[alive]
        slot = owner[alive] * slots + (mix((k ^ _C2) + pick) % np.uint64(slots)).astype(np.int64)
        now = t[alive]
        won = np.flatnonzero(now < time[slot])
        won = won[np.argsort(-now[won], kind="stable")]  # of one slot's arrivals the earliest is written last
        time[slot[won]], first[slot[won]] = now[won], k[won]
        touched = np.unique(owner[alive[won]])
        last[touched] = time.reshape(n, slots)[touched].max(1)
        alive = alive[t[alive] < last[owner[alive]]]
    return first.reshape(n, slots)


def _names(owner: np.ndarray, key: np.ndarray, n: int) -> list[bytes]:
    """128-bit name of each set, whatever the order of its members."""
    both = np.zeros((n, 2), np.uint64)
    np.add.at(both[:, 0], owner, mix(key ^ _C2))
    np.add.at(both[:, 1], owner, mix(key + _C3))
    raw = both.astype(">u8").tobytes()
    return [raw[16 * i : 16 * i + 16] for i in range(n)]


def _bands(sig: np.ndarray) -> np.ndarray:
    """Key of each band of signatures; bands of one number and equal slots have one key."""
    code = np.zeros((len(sig), BANDS), np.uint64) + np.arange(BANDS, dtype=np.uint64)
    for d in range(DEPTH):
        code = mix(code * _C1 + sig.reshape(-1, BANDS, DEPTH)[:, :, d])
    return code.view(np.int64)


def _sketch(type_: pa.DataType, size: int):
    def sketch(b: pa.RecordBatch) -> dict[str, list]:
        names, n_words, bands = [], [], []
        for lo, hi, buf, offs in steps(b.column(1)):
            n = hi - lo
            owner, key, count = shingles(buf, offs, size)
            names += _names(owner, key, n)
            n_words += np.bincount(owner, minlength=n).tolist()
            own = list(_bands(signatures(owner, key, np.ones(len(key)), n)))
            again = np.unique(owner[count > 1])  # texts that repeat a shingle
            at = np.isin(owner, again)
            more = _bands(signatures(np.searchsorted(again, owner[at]), key[at], 1 + np.log(count[at]), len(again)))
            for i, other in zip(again.tolist(), more):
                own[i] = np.concatenate([own[i], other])
            bands += own
        return {"id": b.column(0), "node": names, "n": n_words, "bands": bands}

    return by_batch(sketch, pa.schema([("id", type_), ("node", pa.binary()), ("n", pa.int32()), ("bands", pa.list_(pa.int64()))]))


def _sets(size: int):
    schema = pa.schema([("comp", pa.binary()), ("node", pa.binary()), ("n", pa.int32()), ("keys", pa.binary())])

    def sets(b: pa.RecordBatch) -> pa.RecordBatch | None:
        out: dict[str, list] = {"comp": [], "node": [], "n": [], "keys": []}
        comp, node = b.column(0).to_pylist(), b.column(1).to_pylist()
        for lo, hi, buf, offs in steps(b.column(2)):
            owner, key, _ = shingles(buf, offs, size)
            bounds = np.searchsorted(owner, np.arange(hi - lo + 1))
            for i, name in enumerate(_names(owner, key, hi - lo)):
                if name == node[lo + i]:
                    out["comp"].append(comp[lo + i])
                    out["node"].append(name)
                    out["n"].append(int(bounds[i + 1] - bounds[i]))
                    out["keys"].append(key[bounds[i] : bounds[i + 1]].tobytes())
        return pa.RecordBatch.from_pydict(out, schema)

    return by_batch(sets)


def linked(sets: list[np.ndarray], similarity: float) -> np.ndarray:
    """Component of each set under links of at least ``similarity``: the least place in the list."""
    n, sizes = len(sets), np.array([len(s) for s in sets])
    _, code = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    owner = np.repeat(np.arange(n), sizes)
    order = np.argsort(code, kind="stable")
    post, ends = owner[order], np.concatenate([[0], np.cumsum(np.bincount(code))])
    root, todo = np.full(n, -1), np.arange(n)
    while len(todo):
        head = todo[0]
        root[head], queue, todo = head, [head], todo[1:]
        while queue and len(todo):
            y = queue.pop()
            own = code[starts[y] : starts[y + 1]]
            size = ends[own + 1] - ends[own]
            at = np.repeat(ends[own] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
            both = np.bincount(post[at], minlength=n)[todo]
            hit = both >= similarity * (sizes[todo] + sizes[y] - both) - 1e-9
            root[todo[hit]] = head
            queue += todo[hit].tolist()
            todo = todo[~hit]
    return root


def _search(similarity: float):
    """For rows (group, node, keys) sorted by group: links from each node to the least of its component in the group."""
    schema = pa.schema([("a", pa.binary()), ("b", pa.binary())])

    def found(rows: list[tuple[bytes, bytes]]) -> pa.RecordBatch | None:
        rows = list(dict(rows).items())
        root = linked([np.frombuffer(k, np.uint64) for _, k in rows], similarity) if len(rows) > 1 else []
        links = [(rows[i][0], rows[r][0]) for i, r in enumerate(root) if i != r]
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.binary()) for k in (0, 1)], schema=schema) if links else None

    def run(batches):
        group, rows = None, []
        for b in batches:
            for g, node, keys in zip(*(c.to_pylist() for c in b.columns)):
                if g != group:
                    if (out := found(rows)) is not None:
                        yield out
                    group, rows = g, []
                rows.append((node, keys))
        if (out := found(rows)) is not None:
            yield out

    return run


def _searched(rows: DataFrame, similarity: float) -> DataFrame:
    """Links within each group of ``rows`` (group, node, keys)."""
    return rows.repartition("group").sortWithinPartitions("group", "node").select("group", "node", "keys").mapInArrow(_search(similarity), "a binary, b binary")


def _large(sets: DataFrame, bands: DataFrame, similarity: float, group: int) -> DataFrame | None:
    """Links in components too large for one search. ``bands``: key, band, node of their nodes."""
    links = None
    for first, last in TURNS:
        own = bands.filter((F.col("band") >= first) & (F.col("band") < last))
        roots = components(links) if links is not None else None
        if roots is not None:
            own = own.join(roots, "node", "left").select("key", "band", "node", F.coalesce("root", "node").alias("root"))
        else:
            own = own.withColumn("root", F.col("node"))
        own = own.join(sets.select("node", "n"), "node")
        open_ = (own.groupBy("key", "band").agg(F.sum("n").alias("size"), F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi")
                 .select("key", "band", F.greatest(F.lit(1), F.ceil(2 * F.col("size") / group)).cast("int").alias("blocks")))
        own = own.join(materialize(open_), ["key", "band"])
        block = F.pmod(F.xxhash64("node"), "blocks").cast("int")
        other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
        own = own.select("key", "band", "node", block.alias("block"), other)
        own = own.select("node", F.xxhash64("key", "band", F.least("block", "other"), F.greatest("block", "other")).alias("group"))
        found = materialize(_searched(own.join(sets.select("node", "keys"), "node"), similarity))
        links = found if links is None else materialize(links.union(found))
    return links


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SHINGLE, similarity: float = SIMILARITY, group: int = GROUP) -> DataFrame:
    """One row per document: its id, ``class_id`` (least id of its class), ``class_size``, ``n_shingles``.

    A class is a component of links of Jaccard similarity >= ``similarity`` between sets of ``size``-word shingles. A text of
    fewer words is one shingle. Null and empty texts, and texts without words, are a class of their own each. Repeated rows
    and equal sets are one class. Null ids lose against any id; a class of null ids alone has a null id. Other columns are not read.
    """
    out = _classed(docs, doc_id, text, size, similarity, group)
    return out.select(F.col("id").alias(doc_id), "class_id", "class_size", F.col("n").cast("bigint").alias("n_shingles"))


def _classed(docs: DataFrame, doc_id: str, text: str, size: int = SHINGLE, similarity: float = SIMILARITY, group: int = GROUP) -> DataFrame:
    kind = docs.schema[doc_id].dataType
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    every = materialize(rows.mapInArrow(_sketch(to_arrow_type(kind), size), f"id {kind.simpleString()}, node binary, n int, bands array<bigint>"))
    some = every.filter("n > 0")
    nodes = materialize(some.groupBy("node").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies"), F.min("n").alias("n"), F.min("bands").alias("bands")))
    # plain bands, and after them weighted ones that differ; members of a node share the plain ones
    places = F.filter(F.sequence(F.lit(0), F.size("bands") - 1), lambda i: (i < BANDS) | (F.get("bands", i) != F.get("bands", F.pmod(i, F.lit(BANDS)))))
    bands = nodes.select("node", F.inline(F.transform(places, lambda i: F.struct(F.pmod(i, F.lit(BANDS)).alias("band"), F.get("bands", i).alias("key")))))
    shared = materialize(bands.groupBy("key", "band").agg(F.min("node").alias("hub"), F.max("node").alias("far"), F.count(F.lit(1)).alias("size")).filter("hub <> far"))
    pair = shared.filter("size = 2").select(F.explode(F.array("hub", "far")).alias("a"), F.col("hub").alias("b"), "key", "band")
    more = shared.filter("size > 2").select("key", "band", "hub")
    more = sift(bands, more, "key", "band").join(more, ["key", "band"]).select(F.col("node").alias("a"), F.col("hub").alias("b"), "key", "band")
    stars = materialize(pair.union(more))
    comps = components(stars.select("a", "b").filter("a <> b")).withColumnsRenamed({"root": "comp"})
    comps = materialize(comps.join(nodes.select("node", "id", "n"), "node"))
    some_rows = sift(rows, comps, "id")
    texts = comps.select("id", "comp", "node").join(some_rows, comps["id"].eqNullSafe(some_rows["id"])).select("comp", "node", "text")
    sets = materialize(texts.mapInArrow(_sets(size), "comp binary, node binary, n int, keys binary"))
    # what is joined back to hot keys is stored first: Spark splits a skewed join only if no aggregate shares its stage
    weight = materialize(comps.groupBy("comp").agg(F.sum("n").alias("weight")))
    sized = sets.join(weight, "comp")
    links = materialize(_searched(sized.filter(F.col("weight") <= group).withColumn("group", F.col("comp")), similarity))
    large = materialize(sized.filter(F.col("weight") > group).select("node", "n", "keys").dropDuplicates(["node"]))
    if not large.isEmpty():
        more = _large(large, stars.select("key", "band", F.col("a").alias("node")).join(large.select("node"), "node", "left_semi"), similarity, group)
        links = links.union(more)
    roots = components(links)
    named = materialize(nodes.select("node", "id", "copies").join(roots, "node", "left").select("node", "id", "copies", F.coalesce("root", "node").alias("root")))
    total = materialize(named.groupBy("root").agg(F.min("id").alias("class_id"), F.sum("copies").alias("class_size")))
    of = named.select("node", "root").join(total, "root").select("node", "class_id", "class_size")
    alone = every.filter("n = 0").select("id", "node", F.col("id").alias("class_id"), F.lit(1).cast("bigint").alias("class_size"), "n")
    return some.select("id", "node", "n").join(of, "node").select("id", "node", "class_id", "class_size", "n").unionByName(alone)


def _name(size: int):
    """Column function: the node of a text."""

    @F.arrow_udf("binary")
    def name(texts: pa.Array) -> pa.Array:
        out = []
        for lo, hi, buf, offs in steps(texts):
            owner, key, _ = shingles(buf, offs, size)
            out += _names(owner, key, hi - lo)
        return pa.array(out, pa.binary())

    return name


def keep(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that stay: of every class the row of its least id, all columns as they are.

    Rows without id, and repeated rows of the id that stays, are kept: they carry no id to tell them apart. If an id has
    different texts, each row goes or stays by the class of its own text.
    """
    of = _classed(docs, doc_id, text, **options).filter("id is not null").select("id", "node", (F.col("id") != F.col("class_id")).alias("goes"))
    of = materialize(of.withColumnRenamed("id", "_llm_id"))
    gone = materialize(of.groupBy("_llm_id").agg(F.max("goes").alias("some"), F.min("goes").alias("every")).filter("some"))
    left = docs.join(gone, docs[doc_id] == gone["_llm_id"], "left_anti")
    mixed = gone.filter("not every").select("_llm_id")
    if mixed.isEmpty():
        return left
    goes = materialize(of.filter("goes").join(mixed, "_llm_id", "left_semi").select("_llm_id", "node").distinct())
    tag = "_llm_node_of_row"
    again = docs.join(mixed, docs[doc_id] == mixed["_llm_id"], "left_semi").withColumn(tag, _name(options.get("size", SHINGLE))(F.col(text)))
    return left.unionByName(again.join(goes, (again[doc_id] == goes["_llm_id"]) & (again[tag] == goes["node"]), "left_anti").drop(tag))
