"""Operators on instants: scoring, thinning, allocation over sections.

Default columns: ``timeline_id, id, t, type, intensity, activation`` with ``normalized_intensity``,
``composite_score`` and ``section`` added along the way. Ties go to the earlier instant, then the lower id.
"""

from __future__ import annotations

import bisect
import math
from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.operators.intervals import point_in_disjoint, point_in_interval
from spanloom.operators.ordered import (CELL, DAY, SMALL, WHOLE, as_list, cell_of, chain, distinct_instants, exact_percentile,
                                        grouped_stream, scan, top_rows)
from spanloom.session import materialize

# Weights of the known detector types and their names.
DETECTOR_WEIGHTS = {"Downbeat": 1.0, "Pitch": 1.0, "MelEnergy": 1.0}


def union_detectors(*detections: DataFrame) -> DataFrame:
    """All detectors in one table; columns a detector lacks are null."""
    out = detections[0]
    for d in detections[1:]:
        out = out.unionByName(d, allowMissingColumns=True)
    return out


def downbeats(beats: DataFrame, activations: DataFrame, *, by="timeline_id", t="t", position="beat",
              frame="frame_idx", activation="activation", fps: float = 100.0) -> DataFrame:
    """Beats on bar position 1 with the activation of their frame as intensity; unknown or not finite is 0.5."""
    keys = as_list(by)
    last = activations.groupBy(*keys).agg(F.max(frame).alias("_last"))
    hits = beats.filter(F.col(position) == 1).join(last, keys, "left")
    idx = F.greatest(F.lit(0), F.least((F.col(t) * fps).cast("bigint"), F.col("_last")))
    act = activations.select(*keys, F.col(frame).cast("bigint").alias("_frame"), F.col(activation).alias("_a"))
    finite = ~F.isnan("_a") & (F.abs("_a") != F.lit(float("inf")))
    return (hits.withColumn("_frame", idx).join(act, [*keys, "_frame"], "left")
            .withColumn("activation", F.when(F.col("_a").isNotNull() & finite, F.col("_a")).otherwise(0.5))
            .withColumn("intensity", F.col("activation")).withColumn("type", F.lit("Downbeat"))
            .drop("_last", "_frame", "_a"))


# ---------------------------------------------------------------- scoring


def normalize_by_type(df: DataFrame, *, by="timeline_id", type="type") -> DataFrame:
    """Min-max per type of the activation, else the intensity, else 0.5; a flat type becomes 0.5.

    ``intensity`` is overwritten by the value used. The statistics come from a group-by, not a window, so a
    type holding most rows is still reduced map-side; AQE broadcasts them or splits the skewed join.
    """
    keys = [*as_list(by), type]
    parts = [F.col("activation")] if "activation" in df.columns else []
    used = df.withColumn("intensity", F.coalesce(*parts, F.col("intensity"), F.lit(0.5)))
    stats = used.groupBy(*keys).agg(F.min("intensity").alias("_lo"), F.max("intensity").alias("_hi"))
    span = F.col("_hi") - F.col("_lo")
    return (used.join(stats, keys)
            .withColumn("normalized_intensity",
                        F.when(span > 1e-6, (F.col("intensity") - F.col("_lo")) / span).otherwise(0.5))
            .drop("_lo", "_hi"))


def composite_score(df: DataFrame, weights: Mapping[str, float] | None = None, *, type="type") -> DataFrame:
    """Weight of the type times the normalised intensity; an unknown type gets the mean weight."""
    weights = dict(weights or DETECTOR_WEIGHTS)
    total = 0.0
    for w in weights.values():      # plain additions: sum() compensates and would round differently
        total += w
    mean = total / len(weights)
    table = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])
    return df.withColumn("composite_score", F.coalesce(F.try_element_at(table, F.col(type)), F.lit(mean))
                         * F.coalesce("normalized_intensity", F.lit(0.5)))


def type_stats(df: DataFrame, *, by="timeline_id", type="type", score="composite_score") -> DataFrame:
    return df.groupBy(*as_list(by), type).agg(F.count(F.lit(1)).alias("points"), F.avg(score).alias("mean_score"))


# ---------------------------------------------------------------- filters


def _matches(type: str, types: Sequence[str]) -> Column:
    hit = F.lit(False)
    for x in types:
        hit = hit | F.lower(type).contains(x.lower())
    return hit


def filter_types(df: DataFrame, mode: str, types: Sequence[str], boost: float = 1.5, *, type="type") -> DataFrame:
    """``only`` / ``exclude`` / ``boost`` the types containing any of the given texts, ignoring case."""
    if not types:
        return df
    hit = _matches(type, types)
    if mode == "only":
        return df.filter(hit)
    if mode == "exclude":
        return df.filter(~hit)
    if mode != "boost":
        return df
    out = df
    if "normalized_intensity" in df.columns:
        out = out.withColumn("normalized_intensity", F.when(
            hit, F.least(F.lit(1.0), F.col("normalized_intensity") * boost)).otherwise(F.col("normalized_intensity")))
    if "intensity" in df.columns:
        out = out.withColumn("intensity", F.when(hit, F.col("intensity") * boost).otherwise(F.col("intensity")))
    return out.withColumn("type_boosted", hit)


def select_types(df: DataFrame, types: Sequence[str], *, type="type") -> DataFrame:
    """Exact match on the trimmed type; no types, no rows."""
    wanted = [x.strip() for x in types]
    return df.filter(F.trim(type).isin(wanted)) if wanted else df.filter(F.lit(False))


def percentile_filter(df: DataFrame, p: float, *, by="timeline_id", value="normalized_intensity",
                      value_cell: float = 1 / 1024) -> DataFrame:
    """Keep values at or above the percentile of the whole timeline, all types together."""
    keys = as_list(by)
    thr = exact_percentile(df, by=keys, value=value, p=p, value_cell=value_cell, name="_thr")
    return df.join(thr, keys).filter(F.col(value) >= F.col("_thr")).drop("_thr")


def time_slice(df: DataFrame, start: float, end: float, *, t="t") -> DataFrame:
    return df.filter(F.col(t).between(start, end))


# ---------------------------------------------------------------- non-maximum suppression


def _greedy(ts: np.ndarray, order: np.ndarray, dist: float) -> np.ndarray:
    """Keep instants in the given order that are at least ``dist`` from every kept one."""
    kept: list[float] = []
    keep = np.zeros(len(ts), dtype=bool)
    for i in order:
        x = ts[i]
        k = bisect.bisect_left(kept, x)
        if (k == 0 or abs(x - kept[k - 1]) >= dist) and (k == len(kept) or abs(kept[k] - x) >= dist):
            keep[i] = True
            kept.insert(k, x)
    return keep


def nms_time(df: DataFrame, min_dist: float, threshold: float | Column | None = None, max_n: int | None = None, *,
             by="timeline_id", t="t", value="intensity", order_by: str | None = None, tie: Sequence[str] = ("id",),
             cell: float = DAY, max_component: int = 1_000_000) -> DataFrame:
    """Greedy suppression: strongest first, each kept instant clears everything nearer than ``min_dist``.

    Instants separated by gaps of at least ``min_dist`` cannot influence each other, so the timeline is cut
    there and each component is folded on its own. A component above ``max_component`` rows is not folded in
    one task but decided in rounds over bounded cells (:func:`_nms_rounds`). ``max_n`` keeps the first
    survivors in order of strength, which equals stopping the greedy pass early.
    """
    keys, score = as_list(by), order_by or value
    if threshold is not None:
        df = df.filter(F.col(value) >= threshold)
    best = distinct_instants(df, by=keys, t=t, score=score, tie=tie)   # of equal instants only the best can survive
    # stored once: the size check, the fold and the final join all read it
    comp = materialize(scan(best, by=keys, t=t, cell=cell, island_on={"t": t}, island_name="_comp",
                            island=lambda p, c: c("t") - p("t") >= min_dist))
    sizes = comp.groupBy(*keys, "_comp").count().filter(F.col("count") > max_component)
    if (cell == WHOLE and max_component >= SMALL) or sizes.isEmpty():
        small, big = comp, None
    else:
        small = comp.join(sizes, [*keys, "_comp"], "left_anti")
        big = comp.join(sizes, [*keys, "_comp"], "left_semi").drop("_comp")

    dt = dict(df.dtypes)
    schema = ", ".join(f"`{k}` {dt[k]}" for k in (*keys, t))

    def fold(pdf: pd.DataFrame, b: np.ndarray) -> pd.DataFrame:
        ts, vs = pdf[t].to_numpy(), pdf[score].to_numpy()
        keep = np.zeros(len(pdf), dtype=bool)
        for a, z in zip(b[:-1], b[1:]):
            keep[a:z] = _greedy(ts[a:z], np.lexsort((ts[a:z], -vs[a:z])), min_dist)
        return pdf.loc[keep, [*keys, t]]

    kept = grouped_stream(small.select(*keys, "_comp", t, score), [*keys, "_comp"], [t], fold, schema)
    if big is not None:
        kept = kept.unionByName(_nms_rounds(big.select(*keys, t, score), keys, t, score, min_dist, cell))
    out = comp.drop("_comp").join(kept, [*keys, t], "left_semi")
    if max_n is not None:
        out = top_rows(out, by=keys, order=[F.col(score).desc(), F.col(t)], k=max_n, t=t, cell=cell).drop("_rank")
    return out


def _nms_rounds(df: DataFrame, keys: list[str], t: str, score: str, dist: float, cell: float) -> DataFrame:
    """Suppression for one huge component. Each round decides, per bounded cell plus a margin of ``dist`` on
    both sides, every instant whose stronger neighbours are all decided; the rest waits for the next round.
    The strongest undecided instant is always decided, so the rounds end; state between rounds is stored.

    What rounds alone would decide one cell at a time are ramps, where every instant waits for a stronger one on the same side. There
    the survivors are a chain of instants ``dist`` apart from the top down, which :func:`_ramps` follows at once.
    """
    cell = max(cell, 4 * dist)
    dt = dict(df.dtypes)
    schema = ", ".join(f"`{k}` {dt[k]}" for k in (*keys, t, score)) + ", kept boolean, side int"

    def decide(pdf, b):
        T, V, K, core = (pdf[c].to_numpy() for c in (t, score, "kept", "_core"))
        state = np.where(K.astype(bool), 1, 0)           # 1 kept, 0 open, -1 dropped
        side = np.zeros(len(pdf), dtype=np.int32)        # 1 waits for later instants only, 2 for earlier ones only
        for a, z in zip(b[:-1], b[1:]):
            ts, st, vs = T[a:z], state[a:z], V[a:z]
            kept = sorted(ts[st == 1].tolist())
            waiting: list[float] = []

            def near(xs, x):
                k = bisect.bisect_left(xs, x)
                return (k > 0 and x - xs[k - 1] < dist) or (k < len(xs) and xs[k] - x < dist)

            for i in np.lexsort((ts, -vs)):
                if st[i] != 0:
                    continue
                if near(kept, ts[i]):
                    st[i] = -1
                elif not core[a + i] or near(waiting, ts[i]):
                    k = bisect.bisect_left(waiting, ts[i])
                    if core[a + i]:     # all that waits so far is stronger
                        before, after = k > 0 and ts[i] - waiting[k - 1] < dist, k < len(waiting) and waiting[k] - ts[i] < dist
                        side[a + i] = 1 if after and not before else 2 if before and not after else 0
                    waiting.insert(k, ts[i])
                else:
                    st[i] = 1
                    bisect.insort(kept, ts[i])
        take = core.astype(bool) & (state >= 0)
        out = pdf.loc[take, [*keys, t, score]].copy()
        out["kept"], out["side"] = state[take] == 1, side[take]
        return out

    rows = df.withColumn("kept", F.lit(False))
    while True:
        home = cell_of(t, cell)
        reach = F.array_distinct(F.array(home, cell_of(F.col(t) - dist, cell), cell_of(F.col(t) + dist, cell)))
        placed = (rows.withColumn("_home", home).withColumn(CELL, F.explode(reach))
                  .withColumn("_core", F.col(CELL) == F.col("_home")).drop("_home", "side"))
        rows = materialize(grouped_stream(placed, [*keys, CELL], [t], decide, schema))
        for side in (1, 2):
            if not rows.filter(~F.col("kept") & (F.col("side") == side)).isEmpty():
                rows = _ramps(rows, side, keys, t, dist, cell)
        if rows.filter(~F.col("kept")).isEmpty():
            return rows.select(*keys, t)


def _ramps(rows: DataFrame, side: int, keys: list[str], t: str, dist: float, cell: float) -> DataFrame:
    """Decide the stretches of neighbouring open instants that wait for one side only, if nothing open lies ahead of them within ``dist``.

    Of any two instants of a stretch nearer than ``dist`` the one ahead is stronger, so the survivors are the chain that starts ``dist`` from
    the nearest kept instant ahead. Time is turned so that ahead comes first.
    """
    ahead = rows.withColumn("_m", F.col(t) * (-1.0 if side == 1 else 1.0))
    seen = scan(ahead, by=keys, t="_m", cell=cell, run={"_origin": ("last", F.when(F.col("kept"), F.col("_m")))}).filter("not kept")
    open_ = scan(seen, by=keys, t="_m", cell=cell, prev={"_pm": "_m"}, island_on={"s": "side", "m": "_m"}, island_name="_stretch",
                 island=lambda p, c: (p("s") != c("s")) | (c("m") - p("m") >= dist))
    open_ = materialize(open_)
    tops = open_.filter(F.col("side") == side).groupBy(*keys, "_stretch").agg(F.min_by(F.struct("_m", "_pm", "_origin"), "_m").alias("_top"))
    free = tops.filter(F.col("_top._pm").isNull() | (F.col("_top._m") - F.col("_top._pm") >= dist)).select(*keys, "_stretch", F.col("_top._origin").alias("_from"))
    ramp = open_.join(free, [*keys, "_stretch"]).select(*rows.columns, "_m", "_stretch", "_from").withColumn("_dist", F.lit(float(dist)))
    ramp = materialize(ramp)
    hits = chain(ramp, by=[*keys, "_stretch"], t="_m", dist="_dist", origin="_from", cell=cell).filter("hit")
    decided = ramp.select(*keys, t)
    kept = hits.select(*rows.columns).withColumn("kept", F.lit(True))
    return materialize(rows.join(decided, [*keys, t], "left_anti").select(*rows.columns).unionByName(kept))


def nms_adaptive(df: DataFrame, min_dist: float, ratio: float = 0.5, *, by="timeline_id", t="t", value="intensity",
                 **kw) -> DataFrame:
    """Suppression with a threshold relative to the strongest value of the timeline."""
    keys = as_list(by)
    top = df.groupBy(*keys).agg((F.max(value) * ratio).alias("_thr"))
    return nms_time(df.join(top, keys).filter(F.col(value) >= F.col("_thr")).drop("_thr"), min_dist, by=by, t=t,
                    value=value, **kw)


def nms_window(df: DataFrame, size: float = 1.0, k: int = 1, *, by="timeline_id", t="t", value="intensity",
               tie: Sequence[str] = ("id",)) -> DataFrame:
    """Top-k per fixed window, windows anchored at the first instant."""
    keys = as_list(by)
    first = df.groupBy(*keys).agg(F.min(t).alias("_t0"))
    win = df.join(first, keys).withColumn("_win", F.floor((F.col(t) - F.col("_t0")) / size))
    return top_rows(win, by=[*keys, "_win"], order=[F.col(value).desc(), F.col(t), *[F.col(c) for c in tie]], k=k,
                    t=t).drop("_t0", "_win", "_rank")


def _by_method(df, method, *, min_dist, threshold, ratio, max_n, order_by, value, by, t, **kw):
    if method == "adaptive":
        return nms_adaptive(df, min_dist, ratio, by=by, t=t, value=value, **kw)
    if method == "window":
        return nms_window(df, 1.0, 1, by=by, t=t, value=value)
    return nms_time(df, min_dist, threshold, max_n, by=by, t=t, value=value, order_by=order_by, **kw)


def peaks_mel(frames: DataFrame, ratio: float = 0.5, min_dist: float = 1.0, max_n: int | None = None,
              method: str = "basic", *, by="timeline_id", t="t", energy="energy", **kw) -> DataFrame:
    """Energy peaks: threshold relative to the maximum, suppression, intensity = energy / maximum."""
    keys = as_list(by)
    top = frames.groupBy(*keys).agg(F.max(energy).alias("_top"))
    f = frames.join(top, keys)
    picked = _by_method(f, method, min_dist=min_dist, threshold=F.col("_top") * ratio, ratio=ratio, max_n=max_n,
                        order_by=None, value=energy, by=by, t=t, **kw)
    return (picked.withColumn("type", F.lit("MelEnergy")).withColumn("intensity", F.col(energy) / F.col("_top"))
            .withColumn("relative_intensity", F.col(energy) / F.col("_top") * 100).drop("_top"))


def peaks_pitch(frames: DataFrame, threshold: float = 0.5, min_dist: float = 1.0, max_n: int | None = None,
                method: str = "basic", *, by="timeline_id", t="t", pitch="pitch", confidence="confidence",
                **kw) -> DataFrame:
    """Pitch peaks: confidence threshold, suppression in order of pitch, intensity = confidence."""
    picked = _by_method(frames, method, min_dist=min_dist, threshold=threshold, ratio=threshold, max_n=max_n,
                        order_by=pitch, value=confidence, by=by, t=t, **kw)
    return picked.withColumn("type", F.lit("Pitch")).withColumn("intensity", F.col(confidence))


# ---------------------------------------------------------------- spacing


def min_interval_best(df: DataFrame, d: float, *, by="timeline_id", t="t", score="normalized_intensity",
                      tie: Sequence[str] = ("id",), cell: float = DAY) -> DataFrame:
    """Anchor at the first instant; keep the strongest within ``d`` of the anchor; re-anchor at the next one."""
    if d <= 0:
        return df
    keys = as_list(by)
    best = materialize(distinct_instants(df, by=keys, t=t, score=score, tie=tie, cell=cell).withColumn("_dist", F.lit(float(d))))
    marked = chain(best, by=keys, t=t, dist="_dist", cell=cell)
    if cell == WHOLE:
        return top_rows(marked, by=[*keys, "at"], order=[-F.col(score), F.col(t)], k=1).select(*df.columns)
    cols = [c for c in df.columns if c not in keys]
    win = F.min_by(F.struct(*cols), F.struct(-F.col(score), F.col(t)))
    return marked.groupBy(*keys, "at").agg(win.alias("_w")).select(*keys, "_w.*").select(*df.columns)


def enforce_spacing(df: DataFrame, min_gap: float, duration: str | float | None = None, *, by="timeline_id", t="t",
                    score="composite_score", tie: Sequence[str] = ("id",), cell: float = DAY) -> DataFrame:
    """Neighbours closer than ``min_gap`` leave only the higher score; with ``duration`` an edge instant too
    near the start or the end is dropped first."""
    if min_gap <= 0:
        return df
    keys = as_list(by)
    src = df
    if duration is not None:
        dur = F.col(duration) if isinstance(duration, str) else F.lit(float(duration))
        cols = [F.col(t), *[F.col(c) for c in tie]]
        me = F.struct(*cols)
        if cell == WHOLE:
            line = Window.partitionBy(*keys)
            both = df.withColumn("_first", F.min(me).over(line)).withColumn("_last", F.max(me).over(line))
        else:
            both = df.join(df.groupBy(*keys).agg(F.min(me).alias("_first"), F.max(me).alias("_last")), keys)
        early = (me == F.col("_first")) & (F.col(t) < min_gap)
        late = (me == F.col("_last")) & (dur - F.col(t) < min_gap)
        src = both.filter(~(early | late) | (dur <= 0)).select(*df.columns)
    best = materialize(distinct_instants(src, by=keys, t=t, score=score, tie=tie, cell=cell).withColumn("_dist", F.lit(float(min_gap))))
    hits = chain(best, by=keys, t=t, dist="_dist", score=score, cell=cell).filter("hit").select(*df.columns)
    if cell != WHOLE:       # the scan reads them twice
        hits = materialize(hits)
    # a chain point stays unless the next one replaced it from within the gap
    after = scan(hits, by=keys, t=t, cell=cell, next={"_nt": t})
    return after.filter(F.col("_nt").isNull() | (F.col("_nt") - F.col(t) >= min_gap)).select(*df.columns)


def topk_per_type(df: DataFrame, k: int, *, by="timeline_id", type="type", t="t", score="normalized_intensity",
                  tie: Sequence[str] = ("id",)) -> DataFrame:
    return top_rows(df, by=[*as_list(by), type], k=k, t=t,
                    order=[F.col(score).desc(), F.col(t), *[F.col(c) for c in tie]]).drop("_rank")


# ---------------------------------------------------------------- allocation over sections


def allocate_slots(points: DataFrame, sections: DataFrame, total: int = 20, *, by="timeline_id", t="t", ord="ord",
                   cols=("start_time", "end_time"), cell: float = DAY) -> DataFrame:
    """Slots per section in proportion to its instants, at least one, rounded half to even; the largest section
    (first on a tie) takes the remainder, never below zero. Timelines without instants in sections get none."""
    keys = as_list(by)
    inside = point_in_interval(points.select(*keys, t), sections.select(*keys, ord, *cols), by=keys, t=t, cols=cols)
    counts = inside.groupBy(*keys, ord).agg(F.count(F.lit(1)).alias("points"))
    s = sections.join(counts, [*keys, ord], "left").withColumn("points", F.coalesce("points", F.lit(0)))

    def totals(df, **aggs):
        """Sums of each timeline on all its sections."""
        if cell == WHOLE:
            return df.select("*", *[a.over(Window.partitionBy(*keys)).alias(n) for n, a in aggs.items()])
        return df.join(df.groupBy(*keys).agg(*[a.alias(n) for n, a in aggs.items()]), keys)

    s = totals(s, _all=F.sum("points"), _big=F.max_by(ord, F.struct("points", -F.col(ord)))).filter("_all > 0")
    share = F.greatest(F.lit(1), F.bround(F.lit(total) * (F.col("points") / F.col("_all"))).cast("bigint"))
    s = s.withColumn("slots", share)
    return (totals(s, _given=F.sum("slots"))
            .withColumn("slots", F.when(F.col(ord) == F.col("_big"),
                                        F.greatest(F.lit(0), F.col("slots") + total - F.col("_given")))
                        .otherwise(F.col("slots")).cast("bigint"))
            .drop("_all", "_big", "_given"))


def topk_per_section(points: DataFrame, allocation: DataFrame, *, by="timeline_id", t="t", ord="ord",
                     score="composite_score", slots="slots", name="name", cols=("start_time", "end_time"),
                     tie: Sequence[str] = ("id",), cell: float = DAY) -> DataFrame:
    """Best instants of each section, as many as it was given; rows carry the section name and ordinal."""
    keys = as_list(by)
    inside = point_in_interval(points, allocation.select(*keys, ord, slots, F.col(name).alias("section"), *cols),
                               by=keys, t=t, cols=cols)
    best = top_rows(inside, by=[*keys, ord], k=F.col(slots), t=t, cell=cell,
                    order=[F.col(score).desc(), F.col(t), *[F.col(c) for c in tie]])
    return best.select(*points.columns, "section", ord)


def reachable(cands: DataFrame, group: list[str], ideals: Column, x: str, near: str, cell: float,
              tie: Sequence[str], fits: Column | None = None) -> DataFrame:
    """Candidates that a no-reuse matching of evenly spaced ideal positions can reach; adds ``_need``.

    ``near`` is the ordinal of the nearest ideal, so the candidates of one ordinal form its zone. An ideal leaves its
    zone only when the zone has nothing left. Follow each leaving ideal back to one that took from its zone before:
    these paths never share an ideal and each starts at an ideal whose zone was empty from the outset. Hence a zone
    gives at most as many candidates to others as there are empty zones in the group, plus one to its own ideal.
    Others take from the borders of a zone, its own ideal from the middle, so on each side of the ideal the
    ``_need`` innermost and outermost candidates suffice (one more for candidates on a border).

    Where zones are filled, that is a handful per ideal however many candidates there are. ``fits`` tells for which
    groups the argument holds; the others keep as many candidates as there are ideals.
    """
    filled = (cands.groupBy(*group, near).agg(F.max(ideals).alias("_ideals")).groupBy(*group)
              .agg((F.max("_ideals") - F.count(F.lit(1)) + 2).alias("_need")))
    c = cands.join(filled, group)
    if fits is not None:
        c = c.withColumn("_need", F.when(fits, F.col("_need")).otherwise(F.greatest("_need", ideals)))
    g, ties = [*group, near, "_side"], [F.col(x) for x in tie]      # equal times: the lower tie-break goes first
    c = c.withColumn("_side", F.col("_d") >= 0).withColumn("_a", F.abs("_d"))

    def ends(rows, part):
        """Rows among the ``_need`` innermost or outermost ones; both ranks come from one shuffle."""
        inner, outer = (Window.partitionBy(*part).orderBy(a, *ties) for a in (F.col("_a"), F.col("_a").desc()))
        ranked = rows.withColumn("_in", F.row_number().over(inner)).withColumn("_out", F.row_number().over(outer))
        return ranked.filter((F.col("_in") <= F.col("_need")) | (F.col("_out") <= F.col("_need"))).drop("_in", "_out")

    if cell != WHOLE:       # few rows of each cell go on to the ranks of the whole zone
        c = ends(c.withColumn(CELL, cell_of(x, cell)), [*g, CELL]).drop(CELL)
    return ends(c, g).distinct().drop("_side", "_a")


def fill_long_gaps(kept: DataFrame, raw: DataFrame, max_gap: float, *, by="timeline_id", t="t",
                   tie: Sequence[str] = ("id",), cell: float = DAY) -> DataFrame:
    """Between kept instants more than ``max_gap`` apart, add the unused raw instant nearest each evenly spaced
    ideal time, never the same one twice (earlier on a tie). Added rows have a null section."""
    keys = as_list(by)
    if max_gap <= 0:
        return kept
    kept = materialize(kept)        # read for the gaps and for the result
    gaps = (scan(kept.select(*keys, t).distinct(), by=keys, t=t, cell=cell, next={"_g1": t})
            .withColumnRenamed(t, "_g0").filter(F.col("_g1") - F.col("_g0") > max_gap)
            .withColumn("_k", (F.ceil((F.col("_g1") - F.col("_g0")) / max_gap) - 1).cast("bigint")))
    inside = point_in_disjoint(raw.select(*keys, t, *tie), gaps, by=keys, t=t, cols=("_g0", "_g1"), mode="open", cell=cell)
    step = (F.col("_g1") - F.col("_g0")) / (F.col("_k") + 1)
    j = F.least(F.greatest(F.round((F.col(t) - F.col("_g0")) / step), F.lit(1)), F.col("_k")).cast("bigint")
    near = inside.withColumn("_j", j).withColumn("_d", F.col(t) - (F.col("_g0") + step * F.col("_j")))
    # a gap of a small timeline is matched with all its instants
    reach = near if cell == WHOLE else reachable(materialize(near), [*keys, "_g0"], F.col("_k"), t, "_j", cell, tie)
    reach = reach.select(*keys, t, *tie, "_g0", "_g1", "_k")
    dt = dict(raw.dtypes)
    schema = ", ".join(f"`{c}` {dt[c]}" for c in (*keys, t, *tie))

    def match(pdf, b):
        T, G0, G1, K = (pdf[c].to_numpy() for c in (t, "_g0", "_g1", "_k"))
        take = np.zeros(len(pdf), dtype=bool)
        again = pdf.duplicated([*keys, "_g0", t, *tie]).to_numpy()      # a row given twice is one candidate
        for a, z in zip(b[:-1], b[1:]):
            g0, gap, k = G0[a], G1[a] - G0[a], int(K[a])
            free = (a + np.flatnonzero(~again[a:z])).tolist()
            times = T[free].tolist()
            for i in range(1, k + 1):
                if not free:
                    break
                ideal = g0 + (gap * i / (k + 1))
                q = bisect.bisect_left(times, ideal)
                # nearest on the right is the first row of its time; on the left the first row of its time too
                best = q if q < len(times) else None
                if q > 0:
                    left = bisect.bisect_left(times, times[q - 1])
                    if best is None or abs(times[left] - ideal) <= abs(times[best] - ideal):
                        best = left
                take[free.pop(best)] = True
                times.pop(best)
        return pdf.loc[take, [*keys, t, *tie]]

    chosen = grouped_stream(reach, [*keys, "_g0"], [t, *tie], match, schema)
    added = raw.join(chosen, [*keys, t, *tie], "left_semi")
    return kept.unionByName(added, allowMissingColumns=True)


def edit_points(df: DataFrame, added: DataFrame | None = None, delete: DataFrame | None = None, *, by="timeline_id",
                t="t", tie: Sequence[str] = ("id",), types: Sequence[str] = (), position="position",
                cell: float = DAY) -> DataFrame:
    """Delete instants by their ordinal (from 0, in time order) within a view filtered to ``types``, then add
    manual instants with intensity 1.0."""
    keys = as_list(by)
    out = df
    if delete is not None:
        view = select_types(df, types) if types else df
        ranked = scan(view, by=keys, t=t, tie=tie, cell=cell, run={"_n": ("sum", F.lit(1))})
        gone = ranked.withColumn(position, F.col("_n") - 1).join(delete.select(*keys, position), [*keys, position],
                                                                "left_semi")
        out = df.join(gone.select(*keys, t, *tie), [*keys, t, *tie], "left_anti")
    if added is not None:
        out = out.unionByName(added.withColumn("intensity", F.lit(1.0)), allowMissingColumns=True)
    return out
