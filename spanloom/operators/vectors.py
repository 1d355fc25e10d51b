"""Vector search and batch scoring."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.operators.ordered import top_rows
from spanloom.session import materialize

#: Cells of the coarse quantiser at most, and base vectors that a cell should hold; rows of a block of base vectors and of queries; values of a similarity matrix; queries sent, and worked, at a time.
CELLS, CELL_ROWS, BLOCK, QUERY_BLOCK, STEP, ROUTED = 64, 2048, 65_536, 16_384, 1 << 21, 4096


def _unit(vectors: pa.Array, spare: int) -> np.ndarray:
    """Rows of length 1 with two further axes; a zero vector becomes axis ``spare``, which no other kind of row has, so its cosines are 0."""
    x = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), -1)
    length = np.linalg.norm(x, axis=1)
    out = np.zeros((len(x), x.shape[1] + 2))
    some = length > 0
    out[some, :-2] = x[some] / length[some, None]
    out[~some, spare - 2] = 1.0
    return out


def _distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, (x * x).sum(1)[:, None] + (centres * centres).sum(1) - 2 * x @ centres.T))


def _rows(x: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in x], pa.binary())


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    parts = []
    for c in column.chunks:     # vectors of one length lie one after the other
        if len(c):
            offsets = np.frombuffer(c.buffers()[1], np.int64 if pa.types.is_large_binary(c.type) else np.int32)
            start, end = offsets[[c.offset, c.offset + len(c)]]
            parts.append(np.frombuffer(c.buffers()[2], np.uint8)[start:end].view(np.float64).reshape(len(c), -1))
    return parts[0] if len(parts) == 1 else np.concatenate(parts)


def _usable(vector: str) -> Column:
    """Neither null nor empty, no null component; 4-byte and 8-byte floats alike."""
    return F.col(vector).isNotNull() & (F.size(vector) > 0) & ~F.exists(vector, lambda v: v.isNull() | F.isnan(v))


def _routed(base, queries, k, id, vector, query_id, query_vector, extra, block, query_block, cells):
    """Base vectors with cell and block, queries with every block that may hold one of their ``k`` nearest and its cells in question; counts.

    A block holds as many whole cells as fit, or a part of one cell. A query is sent once a block, not once a cell.
    """
    known = base.filter(_usable(vector))
    asked = queries.filter(_usable(query_vector))
    if cells is None:
        cells = max(1, min(CELLS, known.count() // CELL_ROWS))
    chosen = known.orderBy(F.xxhash64(id), id).limit(cells).select(vector).collect()
    if not chosen:
        return None
    width = len(chosen[0][0])
    for side, name, column in ((known, "base", vector), (asked, "queries", query_vector)):
        if not side.filter(F.size(column) != width).isEmpty():
            raise ValueError(f"{name} hold vectors of different lengths")
    centres = np.unique(_unit(pa.array([list(map(float, r[0])) for r in chosen]), 0), axis=0)
    spare = 0

    def place(batches):
        for b in batches:
            if b.num_rows:
                x = _unit(b.column(1), spare)
                far = _distances(x, centres)
                cell = far.argmin(1)
                yield pa.RecordBatch.from_arrays([b.column(0), *b.columns[2:], _rows(x), pa.array(cell.astype(np.int32)), pa.array(far[np.arange(len(x)), cell])],
                                                 names=["id", *extra, "unit", "cell", "far"])

    kinds = [f"id {base.schema[id].dataType.simpleString()}", *(f"`{c}` {base.schema[c].dataType.simpleString()}" for c in extra)]
    placed = materialize(known.select(F.col(id).alias("id"), vector, *extra).mapInArrow(place, ", ".join([*kinds, "unit binary, cell int, far double"])))
    stats = {r["cell"]: (r["n"], r["far"]) for r in placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("far")).collect()}  # one row a cell
    used = np.array(sorted(stats))
    count, radius = np.array([stats[c][0] for c in used]), np.array([stats[c][1] for c in used])
    parts = np.maximum(1, -(-count // block))
    # blocks of each cell: [first, first + parts); small neighbouring cells share one
    first, filled, block_no = np.zeros(len(used), np.int64), 0, -1
    for c in range(len(used)):
        if block_no < 0 or parts[c] > 1 or filled + count[c] > block:
            block_no, filled = block_no + 1, 0
        first[c] = block_no
        filled = filled + count[c] if parts[c] == 1 else block
        block_no += parts[c] - 1

    def route(batches):
        for b in batches:
            if b.num_rows:
                x = _unit(b.column(1), spare + 1)
                far = _distances(x, centres)[:, used]
                # the k nearest lie within the least distance inside which k vectors lie for certain
                reach = far + radius
                order = np.argsort(reach, axis=1)
                enough = (np.cumsum(count[order], axis=1) >= k).argmax(1)
                sure = np.take_along_axis(reach, order, 1)[np.arange(len(x)), enough] if count.sum() >= k else np.full(len(x), np.inf)
                may = far - radius <= sure[:, None] + 1e-9
                units, step = _rows(x), max(1, ROUTED // (block_no + 1))
                for lo in range(0, len(x), step):
                    row, at = np.nonzero(may[lo : lo + step])
                    row, at = np.repeat(row + lo, parts[at]), np.repeat(at, parts[at])
                    head = np.r_[True, (row[1:] != row[:-1]) | (at[1:] != at[:-1])] if len(row) else np.zeros(0, bool)
                    part = first[at] + np.arange(len(row)) - np.maximum.accumulate(np.where(head, np.arange(len(row)), 0))
                    # cells ascend with their blocks, so those of one query and block are neighbours
                    new = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (part[1:] != part[:-1])]) if len(row) else np.zeros(0, np.int64)
                    take = pa.array(row[new])
                    asks = pa.ListArray.from_arrays(np.r_[new, len(row)].astype(np.int32), pa.array(used[at].astype(np.int32)))
                    yield pa.RecordBatch.from_arrays([b.column(0).take(take), units.take(take), pa.array(part[new].astype(np.int32)), asks], names=["query", "unit", "part", "cells"])

    n = asked.count()
    slices = max(1, -(-n // query_block))
    routed = asked.select(F.col(query_id).alias("query"), query_vector).mapInArrow(route, f"query {queries.schema[query_id].dataType.simpleString()}, unit binary, part int, cells array<int>")
    routed = routed.withColumn("slice", F.pmod(F.xxhash64("query"), F.lit(slices)).cast("int"))
    where = F.create_map(*[v for c, f, m in zip(used.tolist(), first.tolist(), parts.tolist()) for v in (F.lit(c), F.struct(F.lit(f).alias("first"), F.lit(m).alias("parts")))])
    dealt = placed.withColumn("_at", F.element_at(where, F.col("cell")))
    dealt = dealt.withColumn("part", (F.col("_at.first") + F.pmod(F.xxhash64("id"), F.col("_at.parts"))).cast("int")).drop("_at")
    dealt = dealt.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))) if slices > 1 else F.lit(0))
    return dealt, routed, n * int(count.sum()), dict(zip(used.tolist(), (count / parts).tolist()))


def vector_topk(base: DataFrame, queries: DataFrame, k: int = 16, *, id="id", vector="vector", query_id="query_id", query_vector="query_vector",
                block: int = BLOCK, query_block: int = QUERY_BLOCK, cells: int | None = None, order_time: str | None = None) -> DataFrame:
    """The ``k`` most similar vectors (cosine) per query, exact.

    A coarse quantiser deals the base vectors to cells around at most ``cells`` of them (by default 64, fewer for a small table). A query is sent to a cell only if, by the triangle
    inequality, the cell may hold one of its ``k`` nearest: cells that are nearer for certain and hold ``k`` vectors rule the others out.
    Cells share blocks of ``block`` rows, larger ones are split, as are more than ``query_block`` queries, and every pair of a block of each is worked
    in one task, cell by cell as matrix products; it returns at most ``k`` rows per query, which Spark ranks. Neither side passes through the driver.

    Similarities are compared to 12 decimals; ties go to the lower id. A zero vector has similarity 0 to all. Rows whose vector is null,
    empty or holds a null or NaN are left out; vectors of different lengths are an error. ``order_time`` names a column of ``base`` carried
    along for display order. Query ids are distinct.
    """
    extra = [order_time] if order_time else []
    kinds = [f"`{query_id}` {queries.schema[query_id].dataType.simpleString()}", f"`{id}` {base.schema[id].dataType.simpleString()}",
             *(f"`{c}` {base.schema[c].dataType.simpleString()}" for c in extra), "similarity double"]
    found = _routed(base, queries, k, id, vector, query_id, query_vector, extra, block, query_block, cells)
    if found is None:
        out = base.sparkSession.createDataFrame([], ", ".join(kinds))
    else:
        dealt, routed, _, _ = found
        out = routed.groupBy("part", "slice").cogroup(dealt.groupBy("part", "slice")).applyInArrow(_nearest(k, id, query_id, extra), ", ".join(kinds))
    return top_rows(out, by=query_id, order=[F.col("similarity").desc(), F.col(id)], k=k, rank="rank")


def vector_topk_work(base: DataFrame, queries: DataFrame, k: int = 16, *, id="id", vector="vector", query_id="query_id", query_vector="query_vector",
                     cells: int | None = None) -> DataFrame:
    """One row: ``pairs`` of a query and a base vector, and how many of them :func:`vector_topk` compares (``compared``)."""
    found = _routed(base, queries, k, id, vector, query_id, query_vector, [], 1 << 62, QUERY_BLOCK, cells)
    if found is None:
        return base.sparkSession.createDataFrame([(0, 0)], "pairs bigint, compared bigint")
    _, routed, pairs, sizes = found
    of = F.create_map(*[F.lit(v) for c, n in sizes.items() for v in (c, int(n))]).cast("map<int,bigint>")
    compared = F.aggregate("cells", F.lit(0).cast("bigint"), lambda n, c: n + F.element_at(of, c))
    return routed.agg(F.lit(pairs).cast("bigint").alias("pairs"), F.coalesce(F.sum(compared), F.lit(0)).cast("bigint").alias("compared"))


def _first(k: int, row: np.ndarray, at: np.ndarray, value: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, ...]:
    """The ``k`` largest values of each row; of ties with the k-th the lower ids stay."""
    order = np.lexsort((rank[at], -value, row))
    row, at, value = row[order], at[order], value[order]
    keep = np.arange(len(row)) - np.searchsorted(row, row, "left") < k
    return row[keep], at[keep], value[keep]


def _nearest(k: int, id: str, query_id: str, extra: list[str]) -> Callable:
    def run(asked: pa.Table, held: pa.Table) -> pa.Table:
        names = [query_id, id, *extra, "similarity"]
        ids = held.column("id").to_numpy()
        rank = np.argsort(np.argsort(ids, kind="stable"), kind="stable")
        parts = []
        if asked.num_rows and held.num_rows:
            q, cell = _matrix(asked.column("unit")), held.column("cell").to_numpy()
            order = np.argsort(cell, kind="stable")
            x, known = _matrix(held.column("unit"))[order], np.append(np.flatnonzero(np.r_[True, np.diff(cell[order]) != 0]), len(order))
            spans = {int(cell[order[a]]): (a, z) for a, z in zip(known[:-1], known[1:])}
            wanted = asked.column("cells").combine_chunks()
            of, want = wanted.value_parent_indices().to_numpy(), wanted.flatten().to_numpy()
            for some in range(0, len(q), ROUTED):       # what these queries find in all cells is cut to k before the next
                here = slice(*np.searchsorted(of, [some, some + ROUTED]))
                found = []
                for c in np.unique(want[here]):
                    if int(c) not in spans:
                        continue
                    a, z = spans[int(c)]
                    rows, n = of[here][want[here] == c], min(k, z - a)
                    step = max(1, STEP // (z - a))
                    for lo in range(0, len(rows), step):
                        near = np.round(q[rows[lo : lo + step]] @ x[a:z].T, 12)
                        edge = np.partition(near, -n, axis=1)[:, -n]
                        row, at = np.nonzero(near >= edge[:, None])
                        found.append(_first(k, rows[row + lo], order[at + a], near[row, at], rank))
                if found:
                    parts.append(_first(k, *(np.concatenate(f) for f in zip(*found)), rank))
        row, at, value = (np.concatenate(c) for c in zip(*parts)) if parts else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        take = pa.array(at)
        return pa.Table.from_arrays([asked.column("query").take(pa.array(row)), *(held.column(c).take(take) for c in ("id", *extra)), pa.array(value)], names=names)

    return run


def batch_score(df: DataFrame, fn: Callable[[Sequence], Sequence], *, column: str, schema: str, name: str = "score",
                batch: int = 128, retries: int = 3, store: str | None = None) -> DataFrame:
    """Score a column with a user-supplied batch function. Distinct inputs are scored once; a failing call or a
    wrong number of results is retried; the result type is given by ``schema``, e.g. ``array<float>``.

    With ``store``, a folder that all executors share, scores are kept across runs: inputs that it holds are not scored
    again, new ones are appended to it by one job, before the result is read from there.
    """
    dt = dict(df.dtypes)[column]
    spark, kept = df.sparkSession, f"`{column}` {dt}, `{name}` {schema}"

    def call(items):
        error: Exception | None = None
        for _ in range(retries):
            try:
                got = list(fn(items))
                if len(got) == len(items):
                    return got
                error = ValueError(f"{len(got)} results for {len(items)} inputs")
            except Exception as e:
                error = e
        raise ValueError(f"no result after {retries} attempts") from error

    def run(batches):
        for pdf in batches:
            items = pdf[column].tolist()
            got = []
            for i in range(0, len(items), batch):
                got.extend(call(items[i:i + batch]))
            yield pd.DataFrame({column: items, name: got})

    inputs = df.select(column).filter(F.col(column).isNotNull()).distinct()
    if store is None:
        return df.join(inputs.mapInPandas(run, kept), column, "left")
    try:
        inputs = inputs.join(spark.read.schema(kept).parquet(store), column, "left_anti")
    except AnalysisException as e:      # the first run
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
    inputs.mapInPandas(run, kept).write.mode("append").parquet(store)
    return df.join(spark.read.schema(kept).parquet(store).dropDuplicates([column]), column, "left")


def timeline_end(df: DataFrame, *, by="timeline_id", key: Column | str = "key") -> DataFrame:
    """Largest end over the clip keys of a timeline."""
    from spanloom.functions.timecode import clip_key_times
    keys = [by] if isinstance(by, str) else list(by)
    return df.groupBy(*keys).agg(F.max(clip_key_times(key)["end"]).alias("timeline_end"))
