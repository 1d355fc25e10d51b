"""Ordered operators over timelines of any length.

A window partitioned by timeline alone sorts a whole timeline in one task. When one timeline holds a
third of all rows that task never ends. Everything here therefore works in two levels: rows are
partitioned by ``(timeline, cell)``, where a cell is a fixed stretch of the time axis, and each cell is
reduced to one summary row. Only the summaries are ordered per timeline; the carried values are joined
back on ``(timeline, cell)``, the partitioning the rows already have.

``cell`` is the stretch length in units of ``t``. ``fit_cell`` measures a length that keeps every cell
below a row target. Timelines of few rows need no cells: with ``WHOLE`` as the length each is one, and nothing is
summarised or joined back. ``by_size`` tells them from the others.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.session import materialize

DAY = 86_400.0
CELL = "_cell"
#: Length with which a timeline is one cell.
WHOLE = float("inf")
#: Rows of a timeline up to which ``by_size`` gives it to one task.
SMALL = 100_000


def as_list(by: str | Sequence[str]) -> list[str]:
    return [by] if isinstance(by, str) else list(by)


def cell_of(t: str | Column, cell: float) -> Column:
    col = F.col(t) if isinstance(t, str) else t
    return F.floor(col / F.lit(float(cell))).cast("bigint")


def fit_cell(df: DataFrame, *, by="timeline_id", t="t", max_rows: int = 1_000_000, start: float = DAY,
             floor: float = 1e-3) -> float:
    """Largest halving of ``start`` for which no ``(timeline, cell)`` holds more than ``max_rows`` rows.

    One aggregate per halving over two columns; a single number reaches the driver.
    """
    cell = float(start)
    while cell > floor:
        busiest = (df.groupBy(*as_list(by), cell_of(t, cell).alias(CELL)).count()
                   .agg(F.max("count")).first()[0])
        if busiest is None or busiest <= max_rows:
            break
        cell /= 2.0
    return cell


def by_size(sizes: DataFrame, tables: Sequence[DataFrame], *, by="timeline_id", cell: float, limit: int | None = None) -> list[tuple[float, list[DataFrame]]]:
    """The tables cut into those of timelines of at most ``limit`` rows (``SMALL``), to be taken with cells of length ``WHOLE``, and those of
    the larger ones, with ``cell``. ``sizes`` has any number of rows a timeline; their ``rows`` are added up. Without larger timelines
    there is one entry and the tables are as given.
    """
    keys = as_list(by)
    big = sizes.groupBy(*keys).agg(F.sum("rows").alias("rows")).filter(F.col("rows") > (SMALL if limit is None else limit)).select(*keys)
    big = materialize(big)
    if big.isEmpty():
        return [(WHOLE, list(tables))]
    return [(WHOLE, [x.join(big, keys, "left_anti") for x in tables]), (cell, [x.join(big, keys, "left_semi") for x in tables])]


def scan(df: DataFrame, *, by="timeline_id", t="t", tie: Sequence[str] = (), cell: float = DAY,
         prev: Mapping[str, Column | str] | None = None,
         next: Mapping[str, Column | str] | None = None,
         run: Mapping[str, tuple[str, Column | str]] | None = None,
         island: Callable[[Callable[[str], Column], Callable[[str], Column]], Column] | None = None,
         island_on: Mapping[str, Column | str] | None = None,
         island_name: str = "island") -> DataFrame:
    """Previous/next values, running aggregates and islands along each timeline, in one pass.

    ``prev``/``next``: output name -> expression read from the row before/after.
    ``run``: output name -> (``sum`` | ``max`` | ``min`` | ``last`` | ``upcoming``, expression), inclusive
    of the row; ``last`` is the latest non-null value, ``upcoming`` the earliest one at or after the row.
    ``island``: given ``p`` and ``c``, where ``p(name)`` and ``c(name)`` are the ``island_on`` values of the
    previous and the current row, returns the condition that the current row starts a new island. The
    first row always starts one. Islands are numbered from 1 along the timeline.
    """
    keys = as_list(by)
    cols = list(df.columns)
    prev, next, run, island_on = (dict(x or {}) for x in (prev, next, run, island_on))
    run_names = list(run)

    def col(e):
        return F.col(e) if isinstance(e, str) else e

    order = [F.col(t), *[F.col(c) for c in tie]]
    order_key = F.struct(*order)
    whole = cell == WHOLE
    part = keys if whole else [*keys, CELL]
    inside = Window.partitionBy(*part).orderBy(*order)
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)

    # expressions are evaluated once per row, before any window
    base = df if whole else df.withColumn(CELL, cell_of(t, cell))
    if prev:
        base = base.withColumn("_pv", F.struct(*[col(e).alias(n) for n, e in prev.items()]))
    if next:
        base = base.withColumn("_nv", F.struct(*[col(e).alias(n) for n, e in next.items()]))
    if island:
        base = base.withColumn("_iv", F.struct(*[col(e).alias(n) for n, e in island_on.items()]))
    for n, (_, e) in run.items():
        base = base.withColumn(f"_r_{n}", col(e))

    fold = {"sum": F.sum, "max": F.max, "min": F.min}
    backwards = (Window.partitionBy(*part).orderBy(*[c.desc() for c in order])
                 .rowsBetween(Window.unboundedPreceding, Window.currentRow))

    def running(kind, name, forward, backward):
        if kind == "upcoming":
            return F.last(name, ignorenulls=True).over(backward)
        return (F.last(name, ignorenulls=True) if kind == "last" else fold[kind](name)).over(forward)

    def starts(before_name, here_name):
        cond = island(lambda n: F.col(f"{before_name}.{n}"), lambda n: F.col(f"{here_name}.{n}"))
        return F.coalesce(cond, F.lit(False)).cast("int")

    rows = base
    if prev:
        rows = rows.withColumn("_p0", F.lag("_pv").over(inside))
    if next:
        rows = rows.withColumn("_n0", F.lead("_nv").over(inside))
    for n, (kind, _) in run.items():
        rows = rows.withColumn(f"_w_{n}", running(kind, f"_r_{n}", upto, backwards))
    if island:
        rows = rows.withColumn("_i0", F.lag("_iv").over(inside))
        rows = rows.withColumn("_head", F.row_number().over(inside) == 1)
        rows = rows.withColumn("_s", F.when(F.col("_head"), 0).otherwise(starts("_i0", "_iv")))
        rows = rows.withColumn("_k0", F.sum("_s").over(upto))

    if whole:       # nothing comes from other cells
        out = [F.col(c) for c in cols]
        out += [F.col(f"_p0.{n}").alias(n) for n in prev] + [F.col(f"_n0.{n}").alias(n) for n in next]
        out += [F.col(f"_w_{n}").alias(n) for n in run_names]
        if island:
            out.append((F.col("_k0") + 1).cast("bigint").alias(island_name))
        return rows.select(*out)

    # one summary row per cell; islands need the in-cell start flags, the rest reads the bare rows
    aggs = []
    if prev:
        aggs.append(F.max_by("_pv", order_key).alias("_p1"))
    if next:
        aggs.append(F.min_by("_nv", order_key).alias("_n1"))
    for n, (kind, _) in run.items():
        known = F.when(F.col(f"_r_{n}").isNotNull(), order_key)
        picked = {"last": F.max_by(f"_r_{n}", known), "upcoming": F.min_by(f"_r_{n}", known)}
        aggs.append((picked[kind] if kind in picked else fold[kind](f"_r_{n}")).alias(f"_c_{n}"))
    source = base
    if island:
        source = rows
        aggs += [F.sum("_s").alias("_isum"), F.min_by("_iv", order_key).alias("_if"),
                 F.max_by("_iv", order_key).alias("_il")]
    cells = source.groupBy(*part).agg(*aggs)
    across = Window.partitionBy(*keys).orderBy(CELL)
    before = across.rowsBetween(Window.unboundedPreceding, -1)
    after = (Window.partitionBy(*keys).orderBy(F.col(CELL).desc())
             .rowsBetween(Window.unboundedPreceding, -1))
    carry = []
    if prev:
        carry.append(F.lag("_p1").over(across).alias("_p2"))
    if next:
        carry.append(F.lead("_n1").over(across).alias("_n2"))
    for n, (kind, _) in run.items():
        carry.append(running(kind, f"_c_{n}", before, after).alias(f"_b_{n}"))
    if island:
        # the first row of a cell is judged against the last row of the cell before it
        cells = cells.withColumn("_ib", F.lag("_il").over(across))
        cells = cells.withColumn("_h", F.when(F.col("_ib").isNull(), 1).otherwise(starts("_ib", "_if")))
        carry.append((F.coalesce(F.sum(F.col("_h") + F.col("_isum")).over(before), F.lit(0)) + F.col("_h"))
                     .alias("_kb"))
    cells = cells.select(*part, *carry)

    joined = rows.join(cells, part, "left")
    out = [F.col(c) for c in cols]
    for n in prev:
        out.append(F.when(F.col("_p0").isNotNull(), F.col(f"_p0.{n}")).otherwise(F.col(f"_p2.{n}")).alias(n))
    for n in next:
        out.append(F.when(F.col("_n0").isNotNull(), F.col(f"_n0.{n}")).otherwise(F.col(f"_n2.{n}")).alias(n))
    for n in run_names:
        kind = run[n][0]
        here, carried = F.col(f"_w_{n}"), F.col(f"_b_{n}")
        if kind == "sum":
            both = F.when(carried.isNull(), here).when(here.isNull(), carried).otherwise(carried + here)
        elif kind in ("last", "upcoming"):
            both = F.coalesce(here, carried)
        else:
            both = (F.greatest if kind == "max" else F.least)(here, carried)
        out.append(both.alias(n))
    if island:
        out.append((F.col("_kb") + F.col("_k0")).cast("bigint").alias(island_name))
    return joined.select(*out)


def grouped_stream(df: DataFrame, keys: Sequence[str], order: Sequence[str],
                   fn: Callable[[pd.DataFrame, np.ndarray], pd.DataFrame], schema: str) -> DataFrame:
    """Apply ``fn`` to many whole groups at a time.

    ``applyInPandas`` starts Python work once per group, which dominates when groups are small. Here the
    rows are hash-partitioned on ``keys`` and sorted; each call gets a pandas frame holding several
    complete groups and the array of group start offsets (with the end appended).
    """
    keys = list(keys)
    placed = df.repartition(*keys).sortWithinPartitions(*keys, *order)

    def bounds(pdf: pd.DataFrame) -> np.ndarray:
        change = np.zeros(len(pdf), dtype=bool)
        change[0] = True
        for k in keys:
            v = pdf[k].to_numpy()
            change[1:] |= v[1:] != v[:-1]
        return np.append(np.flatnonzero(change), len(pdf))

    def run(batches):
        held = []
        for pdf in batches:
            if not len(pdf):
                continue
            if held and all(held[-1][k].iat[-1] == pdf[k].iat[-1] for k in keys):
                held.append(pdf)        # still inside one group
                continue
            whole = pd.concat([*held, pdf], ignore_index=True) if held else pdf.reset_index(drop=True)
            b = bounds(whole)
            cut = b[-2]
            if cut:
                yield fn(whole.iloc[:cut].reset_index(drop=True), b[:-1])
            held = [whole.iloc[cut:]]
        if held:
            whole = pd.concat(held, ignore_index=True)
            yield fn(whole, bounds(whole))

    return placed.mapInPandas(run, schema)


def _enter(te: np.ndarray, top: np.ndarray, t0: np.ndarray, v0: np.ndarray, d: float, scored: bool) -> np.ndarray:
    """First entry row for each arriving state: ``te - t0 >= d`` or, scored, a value above ``v0``; ``top`` are running maxima."""
    at = np.searchsorted(te, t0 + d, side="left")
    n = len(te)
    while True:     # guard against rounding: the rule is te - t0 >= d
        back = (at > 0) & (te[np.maximum(at - 1, 0)] - t0 >= d)
        on = (at < n) & (te[np.minimum(at, n - 1)] - t0 < d)
        if not (back.any() or on.any()):
            break
        at = at - back + on
    return np.minimum(at, np.searchsorted(top, v0, side="right")) if scored else at


def _merged(te, ve, tx, vx) -> tuple[np.ndarray, ...]:
    """Neighbouring entries that leave in one state as one entry."""
    head = np.flatnonzero(np.r_[True, (tx[1:] != tx[:-1]) | (vx[1:] != vx[:-1])])
    last = np.r_[head[1:], len(te)] - 1
    return te[last], np.maximum.reduceat(ve, head), tx[head], vx[head]


_TABLE = "_i bigint, _te double, _ve double, _tx double, _vx double, _d double, _o double"
_ENTRY = ["_te", "_ve", "_tx", "_vx"]


def _tables(pdf: pd.DataFrame, keys: list[str], parts: list[tuple]) -> pd.DataFrame:
    """Entries of several tables as one frame; each comes with a row that holds its key."""
    size = np.array([len(e[0]) for _, e in parts])
    at = np.repeat([a for a, _ in parts], size)
    out = {c: pdf[c].to_numpy()[at] for c in (*keys, CELL)}
    out["_i"] = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    out |= {c: np.concatenate([e[n] for _, e in parts]) for n, c in enumerate(_ENTRY)}
    return pd.DataFrame(out | {c: pdf[c].to_numpy()[at] for c in ("_d", "_o")})


def _join_tables(keys: list[str], scored: bool):
    """Tables of neighbouring cells composed into the table of their stretch; composition is associative."""

    def run(pdf, b):
        out = []
        cell = pdf["_at"].to_numpy()
        cols = [pdf[c].to_numpy() for c in _ENTRY]
        for a, z in zip(b[:-1], b[1:]):
            d, begin = pdf["_d"].iat[a], cols[0][a]
            cuts = a + np.flatnonzero(np.r_[True, cell[a + 1:z] != cell[a:z - 1], True])
            te, ve, state_t, state_v, of = (np.zeros(0) for _ in range(5))      # entries so far; states they lead to; state of each entry
            of = of.astype(np.int64)
            open_ = True        # may an arriving state pass all entries so far
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                own_te, own_ve, own_tx, own_vx = (c[lo:hi] for c in cols)
                if len(state_t):
                    r = _enter(own_te, np.maximum.accumulate(own_ve), state_t, state_v, d, scored)
                    hit = r < len(own_te)
                    state_t, state_v = state_t.copy(), state_v.copy()
                    state_t[hit], state_v[hit] = own_tx[r[hit]], own_vx[r[hit]]
                if open_:
                    far = np.flatnonzero(own_te - begin >= d)
                    n = far[0] + 1 if len(far) else len(own_te)
                    of = np.concatenate([of, len(state_t) + np.arange(n)])
                    te, ve = np.concatenate([te, own_te[:n]]), np.concatenate([ve, own_ve[:n]])
                    state_t, state_v = np.concatenate([state_t, own_tx[:n]]), np.concatenate([state_v, own_vx[:n]])
                    open_ = not len(far)
                # states that have met go on as one; a chain point is a row, so its time names it
                state_t, first, back = np.unique(state_t, return_index=True, return_inverse=True)
                state_v, of = state_v[first], back[of]
            out.append((a, _merged(te, ve, state_t[of], state_v[of])))
        return _tables(pdf, keys, out)

    return run


def chain(df: DataFrame, *, by="timeline_id", t="t", dist: str, score: str | None = None,
          origin: str | None = None, cell: float = DAY, fan: int = 64) -> DataFrame:
    """Follow a sequential chain along each timeline without putting a timeline in one task.

    From chain point ``p`` the next chain point is the first later row whose ``t`` is at least
    ``dist`` after ``p`` or, with ``score``, whose score exceeds that of ``p``. The chain starts at
    the first row, or, with ``origin``, from a virtual point at that time. ``t`` must be distinct
    within a timeline, ``dist`` the same on all its rows.

    A parallel prefix over transition functions. Each cell, at least sixteen times ``dist`` long, is summarised as a table
    "arriving state -> leaving state"; its entries lie in the first ``dist`` of the cell, and those that lead to one
    state are merged. Tables of ``fan`` neighbouring cells are composed into one, again and again until a timeline has
    at most ``fan``; from there the arriving states are handed down level by level, and a last pass marks the rows. A task
    holds one cell or ``fan`` tables. With ``WHOLE`` as ``cell`` the last pass is the only one. Adds ``hit`` (row is a chain point), ``at`` (time of the latest chain point at or
    before the row, null before the first).
    """
    keys = as_list(by)
    length = F.greatest(F.lit(float(cell)), F.lit(16.0) * F.col(dist).cast("double"))
    base = df.withColumn(CELL, F.floor(F.col(t) / length))
    dt = dict(df.dtypes)
    key_schema = ", ".join(f"`{k}` {dt[k]}" for k in keys)
    slim = base.select(*keys, CELL, F.col(t).alias("_t"), F.col(dist).cast("double").alias("_d"),
                       (F.col(score) if score else F.lit(0.0)).cast("double").alias("_v"),
                       (F.col(origin) if origin else F.lit(None)).cast("double").alias("_o"))
    scored = score is not None

    def next_in_cell(ts, vs, d):
        n = len(ts)
        nxt = np.searchsorted(ts, ts + d, side="left").tolist()
        ts, vs, d = ts.tolist(), vs.tolist(), float(d)      # single values are read faster from lists
        # guard against rounding: the rule is t[q] - t[p] >= d
        for i in range(n):
            j = max(nxt[i], i + 1)
            while j > i + 1 and ts[j - 1] - ts[i] >= d:
                j -= 1
            while j < n and ts[j] - ts[i] < d:
                j += 1
            nxt[i] = j
        if scored:
            stack = []
            for i in range(n):
                while stack and vs[i] > vs[stack[-1]]:
                    k = stack.pop()
                    nxt[k] = min(nxt[k], i)
                stack.append(i)
        return nxt

    def summarise(pdf, b):
        out = []
        T, V, D = (pdf[c].to_numpy() for c in ("_t", "_v", "_d"))
        for a, z in zip(b[:-1], b[1:]):
            ts, vs, d = T[a:z], V[a:z], D[a]
            n = z - a
            nxt = next_in_cell(ts, vs, d)
            leave = np.arange(n)
            for i in range(n - 1, -1, -1):
                if nxt[i] < n:
                    leave[i] = leave[nxt[i]]
            # the arriving state is at or before the cell, so the entry is within the first d (or just past it)
            last = min(int(np.searchsorted(ts, ts[0] + d, side="left")) + 1, n - 1) + 1
            out.append((a, _merged(ts[:last], vs[:last], ts[leave[:last]], vs[leave[:last]])))
        return _tables(pdf, keys, out)

    def mark(pdf, b):
        hit = np.zeros(len(pdf), dtype=bool)
        at = np.full(len(pdf), np.nan)
        T, V, D, T0, V0 = (pdf[c].to_numpy() for c in ("_t", "_v", "_d", "_t0", "_v0"))
        for a, z in zip(b[:-1], b[1:]):
            ts, vs, d = T[a:z], V[a:z], D[a]
            t0, v0 = T0[a], V0[a]
            nxt = next_in_cell(ts, vs, d)
            n, i = z - a, 0
            if not np.isnan(t0):
                while i < n and not (ts[i] - t0 >= d or (scored and vs[i] > v0)):
                    i += 1
            at[a:a + i] = t0
            while i < n:
                hit[a + i] = True
                j = nxt[i]
                at[a + i:a + j] = ts[i]
                i = j
        out = pdf[[*keys, "_t"]].copy()
        out["hit"], out["at"] = hit, at
        return out

    def marked_rows(placed, groups):
        marked = grouped_stream(placed, groups, ["_t"], mark, f"{key_schema}, _t double, hit boolean, at double")
        marked = marked.withColumn("at", F.when(~F.isnan("at"), F.col("at")))
        return df.join(marked.withColumnRenamed("_t", t), [*keys, t])

    if cell == WHOLE:       # the state that arrives is the origin
        return marked_rows(slim.drop(CELL).withColumn("_t0", F.col("_o")).withColumn("_v0", F.lit(float("inf"))), keys)

    table_schema = f"{key_schema}, {CELL} bigint, {_TABLE}"
    table = grouped_stream(slim, [*keys, CELL], ["_t"], summarise, table_schema)

    def compose(pdf, b):
        """Arriving state of each cell, from the state (``_t0``, ``_v0``) ahead of the first; none where that is null."""
        out = []
        ks = [pdf[k].to_numpy() for k in keys]
        C, TE, VE, TX, VX, D, T0, V0 = (pdf[c].to_numpy() for c in (CELL, *_ENTRY, "_d", "_t0", "_v0"))
        for a, z in zip(b[:-1], b[1:]):
            key = [k[a] for k in ks]
            t0, v0 = T0[a], V0[a]
            has = not np.isnan(t0)
            i = a
            while i < z:
                out.append((*key, C[i], t0, v0))
                j = i
                while j < z and C[j] == C[i]:
                    j += 1
                for r in range(i, j):
                    if not has or TE[r] - t0 >= D[r] or (scored and VE[r] > v0):
                        t0, v0, has = TX[r], VX[r], True
                        break
                i = j
        return pd.DataFrame(out, columns=[*keys, CELL, "_t0", "_v0"])

    arrive_schema = f"{key_schema}, {CELL} bigint, _t0 double, _v0 double"
    tables = [table]
    fan = max(fan, 2)
    cells = slim.groupBy(*keys).agg((F.max(CELL) - F.min(CELL) + 1).alias("n")).agg(F.max("n")).first()[0] or 1
    while cells > fan:      # every level is read on the way up and on the way down
        tables[-1] = materialize(tables[-1])
        up = tables[-1].withColumn("_at", F.col(CELL)).withColumn(CELL, F.floor(F.col(CELL) / fan))
        tables.append(grouped_stream(up, [*keys, CELL], ["_at", "_i"], _join_tables(keys, scored), table_schema))
        cells = (cells + fan - 2) // fan + 1      # so many stretches can hold them
    start = tables[-1].withColumn("_t0", F.col("_o")).withColumn("_v0", F.lit(float("inf")))
    arrive = grouped_stream(start, keys, [CELL, "_i"], compose, arrive_schema)
    for below in reversed(tables[:-1]):
        state = arrive.withColumnRenamed(CELL, "_up")
        placed = below.withColumn("_up", F.floor(F.col(CELL) / fan)).join(state, [*keys, "_up"])
        arrive = grouped_stream(placed, [*keys, "_up"], [CELL, "_i"], compose, arrive_schema)

    # the carried state rides along the rows: one small row per cell, joined on the rows' own partitioning
    return marked_rows(slim.join(arrive, [*keys, CELL]), [*keys, CELL])


def distinct_instants(df: DataFrame, *, by="timeline_id", t="t", score: str, tie: Sequence[str] = (), cell: float = DAY) -> DataFrame:
    """Best row per instant: highest score, then lowest tie-break. Combines map-side before any shuffle, but for ``WHOLE``."""
    keys = [*as_list(by), t]
    if cell == WHOLE:
        return top_rows(df, by=keys, order=[-F.col(score), *[F.col(c) for c in tie]], k=1).drop("_rank").select(*df.columns)
    rest = [c for c in df.columns if c not in keys]
    best = F.min_by(F.struct(*rest), F.struct(-F.col(score), *[F.col(c) for c in tie]))
    return df.groupBy(*keys).agg(best.alias("_b")).select(*keys, "_b.*").select(*df.columns)


def top_rows(df: DataFrame, *, by, order: Sequence[Column], k: int | Column, t: str = "t",
             cell: float = DAY, rank: str = "_rank") -> DataFrame:
    """First ``k`` rows per key in ``order``; ``k`` may differ per row of the key.

    A small constant ``k`` is limited before the shuffle by Spark itself. Otherwise rows are ranked per
    ``(key, cell)`` first, so the final ranking sees at most ``k`` rows of each cell.
    """
    keys = as_list(by)
    whole = Window.partitionBy(*keys).orderBy(*order)
    limit = F.lit(k) if isinstance(k, int) else k
    if cell == WHOLE or (isinstance(k, int) and k <= 1000):
        return df.withColumn(rank, F.row_number().over(whole)).filter(F.col(rank) <= limit)
    local = Window.partitionBy(*keys, CELL).orderBy(*order)
    few = (df.withColumn(CELL, cell_of(t, cell)).withColumn(rank, F.row_number().over(local))
           .filter(F.col(rank) <= limit).drop(CELL))
    return few.withColumn(rank, F.row_number().over(whole)).filter(F.col(rank) <= limit)


def exact_percentile(df: DataFrame, *, by="timeline_id", value: str, p: float, value_cell: float = 1 / 1024,
                     name: str = "threshold") -> DataFrame:
    """Linear-interpolation percentile per key, exact, with no key in one task.

    Equal values are counted map-side; running counts over the value axis locate the two neighbouring
    ranks. ``value_cell`` is the cell length on that axis.
    """
    keys = as_list(by)
    counts = (df.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_v"))
              .agg(F.count(F.lit(1)).alias("_n")))
    cum = scan(counts, by=keys, t="_v", cell=value_cell, run={"_cum": ("sum", "_n")})
    total = counts.groupBy(*keys).agg(F.sum("_n").alias("_all"))
    pos = F.lit(float(p)) / 100.0 * (F.col("_all") - 1)
    at = cum.join(total, keys).withColumn("_pos", pos)
    lo = F.floor("_pos")
    hi = F.least(lo + 1, F.col("_all") - 1)

    def holds(rank):
        return (F.col("_cum") - F.col("_n") <= rank) & (rank < F.col("_cum"))

    pair = at.groupBy(*keys).agg(F.max(F.when(holds(lo), F.col("_v"))).alias("_lo"),
                                 F.max(F.when(holds(hi), F.col("_v"))).alias("_hi"),
                                 F.max(F.col("_pos") - lo).alias("_frac"))
    return pair.select(*keys, (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("_frac")).alias(name))
