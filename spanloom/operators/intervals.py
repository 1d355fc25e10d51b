"""Joins between instants and intervals.

An overlap predicate alone plans as a nested loop. Intervals are therefore covered by nodes of a time tree whose node lengths are
powers of 8: an interval takes the nodes of its own level, on which it touches three at most however long it is. Instants, and
intervals shorter than their partner, probe the node above them on every level that the other side uses (at most 26, asked for once
per join in a scalar subquery). A pair of intervals meets on the level of the longer one, in the node of the later start, so the
join is one equi-join on ``(timeline, level, node)`` without ``distinct``. ``spread`` splits every node of the left side over that many
keys (the right side is repeated), for nodes that hold a large share of all rows.

The joins ask for a sort-merge join. Spark judges sizes by the compressed files and does not count the rows that covering adds, so left to
itself it collects on the driver, for a broadcast, what is many times its limit.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.operators.ordered import DAY, as_list, scan
from spanloom.session import materialize

#: Levels of the tree: nodes of 8**LOWEST to 8**HIGHEST units of time.
LOWEST, HIGHEST = -5, 20
#: Nodes of its level that an interval is long, at most. Fewer mean fewer rows to shuffle, and more that meet without overlap.
WIDTH = 2.0
NODE = ["_level", "_node"]


def _salted(left: DataFrame, right: DataFrame, spread: int):
    if spread <= 1:
        return left, right, []
    left = left.withColumn("_salt", F.pmod(F.xxhash64(*left.columns), F.lit(spread)).cast("int"))
    right = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(spread - 1))))
    return left, right, ["_salt"]


def _level(s: str, e: str) -> Column:
    """Level on which an interval touches three nodes at most: it is at most ``WIDTH`` nodes long; ends that are not finite count as 2**62."""
    length = F.least(F.col(e) - F.col(s), F.lit(2.0**62))
    fit = F.ceil(F.log2(length / WIDTH) / 3).cast("int")
    return F.when(length > 0, F.greatest(F.lit(LOWEST), F.least(F.lit(HIGHEST), fit))).otherwise(LOWEST)


def _node(x: str | Column, level: str | Column) -> Column:
    """Node of a time; times beyond 2**62 share the outermost nodes."""
    at = F.greatest(F.lit(-(2.0**62)), F.least(F.col(x) if isinstance(x, str) else x, F.lit(2.0**62)))
    return F.floor(at / F.pow(F.lit(8.0), level))


def _timed(df: DataFrame, s: str, e: str, low: str, high: str) -> tuple[DataFrame, str, str]:
    """Times as doubles and the names of their columns; columns that are doubles already are not carried twice."""
    out = []
    for c, name in ((s, low), (e, high)):
        if df.schema[c].dataType.simpleString() != "double":
            df, c = df.withColumn(name, F.col(c).cast("double")), name
        out.append(c)
    return (df, *out)


def _levels(df: DataFrame, s: str, e: str) -> Column:
    """Levels that the intervals of ``df`` use, as a scalar subquery."""
    return df.select(_level(s, e).alias("_level")).agg(F.collect_set("_level")).scalar()


def _covered(df: DataFrame, s: str, e: str, others: Column | None = None) -> DataFrame:
    """One row per node on the interval's own level and, of ``others``, on all levels above it."""
    own = F.array(F.col("_own"))
    out = df.withColumn("_own", _level(s, e))
    if others is not None:
        out = out.withColumn("_others", others)
        own = F.concat(own, F.filter("_others", lambda x: x > F.col("_own")))
    out = out.withColumn("_level", F.explode(own)).drop("_others")
    first = _node(s, "_level")
    return out.withColumn("_node", F.explode(F.sequence(first, F.greatest(first, _node(e, "_level")))))


def overlap_join(a: DataFrame, b: DataFrame, *, by="timeline_id", a_cols=("a_start", "a_end"),
                 b_cols=("b_start", "b_end"), mode: str = "half_open", how: str = "inner", spread: int = 1) -> DataFrame:
    """Overlapping interval pairs. ``mode``:

    * ``closed``: ``a.s <= b.e and a.e >= b.s``
    * ``half_open``: ``a.s < b.e and a.e > b.s``
    * ``int_ceil``: ``a`` widened to whole seconds (floor start, ceil end, at least one second), ``b``
      truncated to whole seconds, then half-open

    ``how`` is ``inner``, ``left`` or ``left_semi``. Column names of both sides must differ except ``by``. Rows with a null
    time have no partner.
    """
    keys = as_list(by)
    (s, e), (S, E) = a_cols, b_cols
    if how == "left":     # both are stored: the rows to tell apart what has a partner, the pairs to join once
        named = materialize(a.withColumn("_row", F.monotonically_increasing_id()))
        hit = materialize(overlap_join(named, b, by=keys, a_cols=a_cols, b_cols=b_cols, mode=mode, spread=spread))
        bare = named.join(hit.select("_row").distinct().hint("merge"), "_row", "left_anti")
        return hit.unionByName(bare, allowMissingColumns=True).drop("_row")
    a2 = a.withColumn("_row", F.monotonically_increasing_id()) if how == "left_semi" else a
    if mode == "int_ceil":
        a2 = a2.withColumn("_as", F.floor(s).cast("double")).withColumn("_ae", F.greatest(F.ceil(e).cast("double"), F.col("_as") + 1))
        b2 = b.withColumn("_bs", F.floor(S).cast("double")).withColumn("_be", F.floor(E).cast("double"))
        (x, y), (X, Y) = ("_as", "_ae"), ("_bs", "_be")
    else:
        a2, x, y = _timed(a2, s, e, "_as", "_ae")
        b2, X, Y = _timed(b, S, E, "_bs", "_be")
    a3 = _covered(a2, x, y, _levels(b2, X, Y))
    # the right side is renamed, so that both sides may stem from one table
    b3 = _covered(b2, X, Y, _levels(a2, x, y))
    a3, b3, salt = _salted(a3, b3, spread)
    b3 = b3.select(*[F.col(c).alias(f"_r_{c}") for c in b3.columns]).hint("merge")
    X, Y = f"_r_{X}", f"_r_{Y}"
    if mode == "closed":
        hit = (F.col(x) <= F.col(Y)) & (F.col(y) >= F.col(X))
    else:
        hit = (F.col(x) < F.col(Y)) & (F.col(y) > F.col(X))
    longer = F.col("_level") == F.greatest("_own", "_r__own")
    owner = F.col("_node") == _node(F.greatest(x, X), "_level")
    cond = [F.col(k) == F.col(f"_r_{k}") for k in (*keys, *NODE, *salt)]
    if how == "left_semi":
        return a3.join(b3, [*cond, hit, longer, owner], how).dropDuplicates(["_row"]).select(*a.columns)
    pairs = a3.join(b3, [*cond, hit, longer, owner])
    return pairs.select(*a.columns, *[F.col(f"_r_{c}").alias(c) for c in b.columns if c not in keys])


def point_in_interval(points: DataFrame, spans: DataFrame, *, by="timeline_id", t="t",
                      cols=("start_time", "end_time"), mode: str = "half_open", how: str = "inner", spread: int = 1) -> DataFrame:
    """Instants inside intervals; ``mode`` is ``half_open``, ``closed`` or ``open``.

    ``how="left_semi"`` keeps each instant once if any interval holds it. Rows with a null time have no partner.
    """
    keys = as_list(by)
    S, E = cols
    p = points.withColumn("_row", F.monotonically_increasing_id()) if how == "left_semi" else points
    timed = spans.withColumn("_s", F.col(S).cast("double")).withColumn("_e", F.col(E).cast("double"))
    p = p.withColumn("_level", F.explode(_levels(timed, "_s", "_e"))).withColumn("_node", _node(F.col(t).cast("double"), "_level"))
    q = _covered(timed, "_s", "_e")
    p, q, salt = _salted(p, q, spread)
    q = q.select(*[F.col(c).alias(f"_r_{c}") for c in q.columns]).hint("merge")
    lo, hi = F.col(f"_r_{S}"), F.col(f"_r_{E}")
    low = F.col(t) > lo if mode == "open" else F.col(t) >= lo
    high = F.col(t) <= hi if mode == "closed" else F.col(t) < hi
    j = p.join(q, [*[F.col(k) == F.col(f"_r_{k}") for k in (*keys, *NODE, *salt)], low, high], how)
    if how == "left_semi":      # an instant may be held on several levels
        return j.dropDuplicates(["_row"]).select(*points.columns)
    return j.select(*points.columns, *[F.col(f"_r_{c}").alias(c) for c in spans.columns if c not in keys])


def point_in_disjoint(points: DataFrame, spans: DataFrame, *, by="timeline_id", t="t", cols=("start_time", "end_time"),
                      mode: str = "half_open", cell: float = DAY) -> DataFrame:
    """:func:`point_in_interval` for intervals longer than 0 of which no two of a timeline overlap (``half_open`` or ``open``).

    Only the interval of the latest start can hold an instant, so one scan over both tables finds it and no row is repeated.
    """
    keys, (S, E) = as_list(by), cols
    own, rest = ([c for c in x.columns if c not in keys] for x in (points, spans))
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    p = points.filter(known).select(*keys, F.col(t).cast("double").alias("_at"), F.lit(1).alias("_side"), F.struct(*own).alias("_point"))
    q = spans.filter(known).select(*keys, F.col(S).cast("double").alias("_at"), F.lit(0).alias("_side"), F.struct(*rest).alias("_span"))
    both = p.unionByName(q, allowMissingColumns=True)
    found = scan(both, by=keys, t="_at", tie=["_side"], cell=cell, run={"_in": ("last", "_span")}).filter("_side = 1")
    at, lo, hi = F.col(f"_point.{t}"), F.col(f"_in.{S}"), F.col(f"_in.{E}")
    found = found.filter(((at > lo) if mode == "open" else (at >= lo)) & (at < hi))
    return found.select(*keys, "_point.*", "_in.*").select(*points.columns, *rest)


def gate_by_intervals(points: DataFrame, spans: DataFrame, *, by="timeline_id", t="t",
                      cols=("start_time", "end_time")) -> DataFrame:
    """Keep instants inside any interval (closed ends); timelines without intervals keep everything."""
    inside = point_in_interval(points, spans, by=by, t=t, cols=cols, mode="closed", how="left_semi")
    bare = points.join(spans.select(*as_list(by)).distinct(), as_list(by), "left_anti")
    return inside.unionByName(bare)


def dominant_label(segments: DataFrame, turns: DataFrame, *, by="timeline_id", seg_id="seg_id",
                   seg=("start", "end"), turn=("turn_start", "turn_end"), label="speaker", order="turn_ord", default: str = "UNKNOWN") -> DataFrame:
    """Label with the largest total overlap per segment; ties go to the label seen first."""
    keys = [*as_list(by), seg_id]
    pairs = overlap_join(segments.select(*keys, *seg), turns.select(*as_list(by), *turn, label, order), by=by,
                         a_cols=seg, b_cols=turn)
    shared = F.least(seg[1], turn[1]) - F.greatest(seg[0], turn[0])
    per_label = pairs.groupBy(*keys, label).agg(F.sum(shared).alias("_o"), F.min(order).alias("_f"))
    best = per_label.groupBy(*keys).agg(
        F.max_by(label, F.struct(F.col("_o"), -F.col("_f"))).alias("_label"))
    return segments.join(best, keys, "left").withColumn(label, F.coalesce("_label", F.lit(default))).drop("_label")


def attach_text(clips: DataFrame, cues: DataFrame, *, by="timeline_id", clip_id="clip_id",
                clip=("clip_start", "clip_end"), cue=("start_sec", "end_sec"), order="index", text="text",
                mode: str = "closed", default: str = "No transcript.",
                name: str = "transcript", max_chars: int | None = None) -> DataFrame:
    """Ordered text of the cues overlapping each clip, joined by a space."""
    from spanloom.functions.text import squash_truncate

    keys = [*as_list(by), clip_id]
    pairs = overlap_join(clips.select(*keys, *clip), cues.select(*as_list(by), *cue, order, text), by=by,
                         a_cols=clip, b_cols=cue, mode=mode)
    parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("x"))))
    joined = F.trim(F.array_join(F.transform(parts, lambda p: p["x"]), " "))
    per_clip = pairs.groupBy(*keys).agg(joined.alias("_txt"))
    full = F.when(F.col("_txt") != "", F.col("_txt"))
    if max_chars is not None:
        full = squash_truncate(full, max_chars)
    return (clips.join(per_clip, keys, "left")
            .withColumn(name, F.coalesce(full, F.lit(default))).drop("_txt"))


def scene_dialogue(scenes: DataFrame, cues: DataFrame, *, by="timeline_id", scene_id="scene_id",
                   scene=("scene_start", "scene_end"), cue=("start_sec", "end_sec"), order="index",
                   speaker="speaker", text="text",
                   default: str = "No dialogue.") -> DataFrame:
    """``[Speaker]: "text"`` lines of the cues overlapping each scene; cues without text are left out."""
    keys = [*as_list(by), scene_id]
    said = cues.filter(F.length(text) > 0).select(*as_list(by), *cue, order, speaker, text)
    pairs = overlap_join(scenes.select(*keys, *scene), said, by=by, a_cols=scene, b_cols=cue, mode="closed")
    line = F.concat(F.lit("["), F.coalesce(F.col(speaker), F.lit("None")), F.lit(']: "'), F.col(text), F.lit('"'))
    parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("x"))))
    per = pairs.groupBy(*keys).agg(F.array_join(F.transform(parts, lambda p: p["x"]), "\n").alias("_d"))
    return scenes.join(per, keys, "left").withColumn("dialogue", F.coalesce("_d", F.lit(default))).drop("_d")


def frames_in_clips(frames: DataFrame, clips: DataFrame, *, by="timeline_id", frame="frame_idx",
                    cols=("start_frame", "end_frame"), mode: str = "half_open") -> DataFrame:
    """Frames of each clip; half-open on frame numbers, closed on times in fixed windows."""
    return point_in_interval(frames, clips, by=by, t=frame, cols=cols, mode=mode)


def conflicts(proposals: DataFrame, used: DataFrame, *, by="timeline_id", proposal=("start", "end"),
              taken=("used_start", "used_end")) -> DataFrame:
    """Each used range a proposal overlaps, with the shared part."""
    return (overlap_join(proposals, used, by=by, a_cols=proposal, b_cols=taken)
            .withColumn("overlap_start", F.greatest(proposal[0], taken[0]))
            .withColumn("overlap_end", F.least(proposal[1], taken[1])))


def clip_intervals(spans: DataFrame, start: float | str, end: float | str, *,
                   cols=("start_time", "end_time")) -> DataFrame:
    """Spans cut to a range and re-based to its start; spans outside are dropped."""
    lo = F.col(start) if isinstance(start, str) else F.lit(float(start))
    hi = F.col(end) if isinstance(end, str) else F.lit(float(end))
    S, E = cols
    return (spans.filter((F.col(S) < hi) & (F.col(E) > lo))
            .withColumn(E, F.least(F.col(E), hi) - lo)
            .withColumn(S, F.greatest(F.col(S), lo) - lo))


def rebase(children: DataFrame, parents: DataFrame | None = None, *, on: Sequence[str] = (),
           offset: Column | float | str = "parent_start", cols=("start_time", "end_time")) -> DataFrame:
    """Times relative to a parent made absolute; with no parents, ``offset`` is a constant or a column."""
    out = children
    if parents is not None:
        out = children.join(parents.select(*on, F.col(offset).alias("_off")), list(on))
        off = F.col("_off")
    else:
        off = F.col(offset) if isinstance(offset, str) else (F.lit(offset) if not isinstance(offset, Column) else offset)
    for c in cols:
        out = out.withColumn(c, F.col(c) + off)
    return out.drop("_off")


def snap_clip_to_cut(clips: DataFrame, cuts: DataFrame, *, by="timeline_id", clip_id="clip_id",
                     cols=("start", "end"), cut="cut", tol: float = 0.5) -> DataFrame:
    """A clip with a cut strictly inside (by ``tol``) starts at the first such cut and keeps its length."""
    keys = [*as_list(by), clip_id]
    S, E = cols
    inner = clips.select(*keys, (F.col(S) + tol).alias("_lo"), (F.col(E) - tol).alias("_hi")).filter("_hi > _lo")
    first = (point_in_interval(cuts.select(*as_list(by), cut), inner, by=by, t=cut, cols=("_lo", "_hi"),
                               mode="open")
             .groupBy(*keys).agg(F.min(cut).alias("_cut")))
    out = clips.join(first, keys, "left")
    return (out.withColumn("original_start", F.col(S)).withColumn("original_end", F.col(E))
            .withColumn(E, F.when(F.col("_cut").isNull(), F.col(E)).otherwise(F.col("_cut") + (F.col(E) - F.col(S))))
            .withColumn(S, F.coalesce("_cut", S))
            .withColumn("adjusted", (F.col(S) != F.col("original_start")) | (F.col(E) != F.col("original_end")))
            .drop("_cut"))


def nearest_boundary(probes: DataFrame, marks: DataFrame, *, by="timeline_id", t="t", mark="mark",
                     cell: float = 86_400.0, name: str = "nearest") -> DataFrame:
    """Nearest mark by absolute distance; ties go to the earlier mark, null where there is none."""
    keys = as_list(by)
    rest = [c for c in probes.columns if c not in (*keys, t)]
    m = marks.select(*keys, F.col(mark).cast("double").alias("_x"), F.lit(0).alias("_side"),
                     F.col(mark).cast("double").alias("_mark"), F.lit(None).cast(_struct_type(probes, rest)).alias("_row"))
    p = probes.select(*keys, F.col(t).cast("double").alias("_x"), F.lit(1).alias("_side"),
                      F.lit(None).cast("double").alias("_mark"), F.struct(*rest).alias("_row"))
    both = m.unionByName(p)
    found = scan(both, by=keys, t="_x", tie=["_side"], cell=cell,
                 run={"_left": ("last", "_mark"), "_right": ("upcoming", "_mark")})
    near = F.when(F.col("_left").isNull(), F.col("_right")).when(F.col("_right").isNull(), F.col("_left")).when(
        F.col("_x") - F.col("_left") <= F.col("_right") - F.col("_x"), F.col("_left")).otherwise(F.col("_right"))
    return (found.filter("_side = 1").withColumn(name, near)
            .select(*keys, F.col("_x").alias(t), *[F.col(f"_row.{c}").alias(c) for c in rest], name))


def _struct_type(df: DataFrame, names: Sequence[str]):
    from pyspark.sql import types as T
    return T.StructType([df.schema[n] for n in names])


def map_labels(df: DataFrame, mapping: DataFrame, *, by=(), label="speaker", name="name",
               confidence="confidence", out: str = "character") -> DataFrame:
    """Replace labels by names. A low-confidence ``Unknown`` and an unmapped label keep the label."""
    keys = [*as_list(by), label]
    m = mapping.select(*keys, F.when((F.col(name) == "Unknown") & (F.col(confidence) == "low"), F.lit(None))
                       .otherwise(F.when(F.length(name) > 0, F.col(name))).alias("_name"))
    return df.join(m, keys, "left").withColumn(out, F.coalesce("_name", label)).drop("_name")


def resolve_entities(shots: DataFrame, mapping: DataFrame, *, by="timeline_id", source="source_filename",
                     characters="characters", key="key", name="name") -> DataFrame:
    """One row per shot and character, named through the ``<source>_<visual_id>`` key or by its id."""
    keys = as_list(by)
    ids = (shots.select(*keys, source, F.posexplode(characters).alias("pos", "visual_id"))
           .withColumn(key, F.concat_ws("_", source, "visual_id")))
    return (ids.join(mapping.select(*keys, key, F.col(name).alias("_n")), [*keys, key], "left")
            .withColumn("resolved", F.coalesce("_n", "visual_id")).drop("_n"))


def allowed_neighbors(recommended: DataFrame, requested: DataFrame | None = None, *, by="timeline_id",
                      scene="scene_id", max_scene="max_scene", n: int = 3) -> DataFrame:
    """Scene ids within ``n`` of a recommendation and inside ``[0, max_scene]``.

    With ``requested`` the result is the requests, flagged ``allowed``. A ``max_scene`` of 0 means
    "not known" and sets no upper bound.
    """
    keys = as_list(by)
    around = F.explode(F.sequence(F.col(scene) - n, F.col(scene) + n))
    ok = (recommended.select(*keys, max_scene, around.alias("_s"))
          .filter((F.col("_s") >= 0) & ((F.col(max_scene) == 0) | (F.col("_s") <= F.col(max_scene))))
          .select(*keys, F.col("_s").alias(scene)).distinct())
    if requested is None:
        return ok
    return (requested.join(ok.withColumn("_ok", F.lit(True)), [*keys, scene], "left")
            .withColumn("allowed", F.coalesce("_ok", F.lit(False))).drop("_ok"))


def scene_shots(slots: DataFrame, shots: DataFrame, *, by="timeline_id", scenes="scenes", scene="scene_id") -> DataFrame:
    """Shots of each scene named by a slot; a scene without shots stays as a row with ``missing`` set."""
    keys = as_list(by)
    wanted = slots.withColumn(scene, F.explode(scenes)).drop(scenes)
    extra = [c for c in shots.columns if c not in (*keys, scene)]
    found = shots.withColumn("_f", F.lit(1))
    return (wanted.join(found, [*keys, scene], "left").withColumn("missing", F.col("_f").isNull())
            .select(*wanted.columns, *extra, "missing"))


def align_slots(plan: DataFrame, music: DataFrame, *, by="timeline_id", section="section_idx",
                slots="slots", segments="segments", caption: str = "caption") -> DataFrame:
    """Slot i of a section paired with music segment i of the same section; none leaves a null caption."""
    keys = [*as_list(by), section]
    s = plan.select(*keys, F.posexplode(slots).alias("pos", "slot"))
    m = music.select(*keys, F.posexplode(segments).alias("pos", caption))
    return s.join(m, [*keys, "pos"], "left")
