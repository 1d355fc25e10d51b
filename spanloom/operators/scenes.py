"""Shots into scenes: similarity of neighbours, cuts, absorption, splitting, roll-up.

A shot row has ``timeline_id, ord, start, end``; ``ord`` numbers the shots of a timeline.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions.media import PLACE_SIMILARITY, TIME_SIMILARITY, cosine_normed, soft_match, with_norm
from spanloom.operators.ordered import DAY, as_list, chain, scan

ORD_CELL = 4096

# Labels that make a shot a bridge between two others.
BRIDGE_FUNCTIONS = ["Insert", "Cut-away", "Reaction", "Transition"]
BRIDGE_SCALES = ["Extreme Close-up", "Close-up"]
# Shares of place, time, tags and picture in the similarity of two shots.
W_PLACE, W_TIME, W_TAGS, W_PICTURE = 0.30, 0.15, 0.35, 0.20


def attach_tag_vectors(shots: DataFrame, tag_vectors: DataFrame, *, by="timeline_id", ord="ord", tags="tags",
                       tag="tag", vector="vector", name: str = "tag_vectors") -> DataFrame:
    """Vectors of a shot's tags as one array; a tag without a vector is left out."""
    keys = [*as_list(by), ord]
    each = shots.select(*keys, F.explode(tags).alias(tag)).join(tag_vectors.select(tag, vector), tag)
    per = each.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct(tag, vector))), lambda x: x[vector]).alias(name))
    return shots.join(per, keys, "left")


def tagset_similarity(a, b) -> Column:
    """Mean of the two directed best-match means of two vector sets; empty or null is 0."""
    x, y = (F.col(c) if isinstance(c, str) else c for c in (a, b))
    return _tagset(F.transform(x, with_norm), F.transform(y, with_norm))


def _tagset(x: Column, y: Column) -> Column:
    def mean(arr):
        return F.aggregate(arr, F.lit(0.0), lambda acc, s: acc + s) / F.size(arr)

    def both(m):
        # rows are best matches of x, columns those of y
        columns = F.transform(F.sequence(F.lit(0), F.size(y) - 1), lambda j: F.array_max(F.transform(m, lambda r: F.get(r, j))))
        return (mean(F.transform(m, lambda r: F.array_max(r))) + mean(columns)) / 2.0

    matrix = F.transform(x, lambda u: F.transform(y, lambda v: cosine_normed(u, v)))
    once = F.get(F.transform(F.array(matrix), both), F.lit(0))       # the matrix is evaluated once and read twice
    return F.when((F.size(x) > 0) & (F.size(y) > 0), once).otherwise(0.0)


def shot_similarity(a, b) -> Column:
    """Similarity of two shot structs with fields place, time and, with their lengths, tag_vectors and picture."""
    def g(s, f):
        return s[f]
    return (F.lit(W_PLACE) * soft_match(g(a, "place"), g(b, "place"), PLACE_SIMILARITY)
            + F.lit(W_TIME) * soft_match(g(a, "time"), g(b, "time"), TIME_SIMILARITY)
            + F.lit(W_TAGS) * _tagset(g(a, "tag_vectors"), g(b, "tag_vectors"))
            + F.lit(W_PICTURE) * F.greatest(F.lit(0.0), cosine_normed(g(a, "picture"), g(b, "picture"))))


def adjacent_similarity(shots: DataFrame, *, by="timeline_id", ord="ord", place="place", time="time",
                        tag_vectors="tag_vectors", picture="picture", cell: float = ORD_CELL) -> DataFrame:
    """``sim_prev`` to the shot before, and ``sim_skip`` of the shots before and after each other."""
    me = F.struct(F.col(place).alias("place"), F.col(time).alias("time"), F.transform(tag_vectors, with_norm).alias("tag_vectors"),
                  with_norm(picture).alias("picture"))
    s = scan(shots.withColumn("_me", me), by=by, t=ord, cell=cell, prev={"_before": "_me"}, next={"_after": "_me"})
    return (s.withColumn("sim_prev", F.when(F.col("_before").isNotNull(), shot_similarity(F.col("_before"), F.col("_me"))))
            .withColumn("sim_skip", F.when(F.col("_before").isNotNull() & F.col("_after").isNotNull(),
                                           shot_similarity(F.col("_before"), F.col("_after"))))
            .drop("_me", "_before", "_after"))


def scene_cuts(shots: DataFrame, threshold: float = 0.5, *, by="timeline_id", ord="ord", function="function",
               scale="scale", cell: float = ORD_CELL) -> DataFrame:
    """Scene number per shot: a new scene where ``sim_prev`` is below the threshold, unless the shot is a bridge
    whose two neighbours are similar enough."""
    bridge = F.coalesce(F.col(function).isin(BRIDGE_FUNCTIONS), F.lit(False)) | F.coalesce(F.col(scale).isin(BRIDGE_SCALES), F.lit(False))
    spared = bridge & F.coalesce(F.col("sim_skip") >= threshold, F.lit(False))
    cut = F.coalesce(F.col("sim_prev") < threshold, F.lit(False)) & ~spared
    return scan(shots.withColumn("is_cut", cut), by=by, t=ord, cell=cell, run={"scene_id": ("sum", F.col("is_cut").cast("bigint"))})


def absorb_scenes(shots: DataFrame, *, by="timeline_id", ord="ord", scene="scene_id", function="function",
                  lead_max: int = 3, tail_max: int = 5, cell: float = ORD_CELL) -> DataFrame:
    """Short establishing scenes join the next scene, then short, mostly progressing scenes join the one before.

    Both passes are running counts of the scenes that stand on their own. Scenes that lead into the next share the
    count of hosts *before* them; at the end of a timeline that also keeps the last scene with its lead-in.
    """
    keys = as_list(by)
    sc = shots.groupBy(*keys, scene).agg(F.count(F.lit(1)).alias("_n"),
                                         F.max((F.coalesce(F.col(function), F.lit("")) == "Establishment").cast("int")).alias("_est"),
                                         F.sum((F.coalesce(F.col(function), F.lit("")) == "Progression").cast("int")).alias("_pro"))
    host = (~((F.col("_n") <= lead_max) & (F.col("_est") == 1))).cast("bigint")
    first = (scan(sc.withColumn("_h", host), by=keys, t=scene, cell=cell, run={"_c": ("sum", "_h")})
             .withColumn("_g1", F.col("_c") - F.col("_h")))
    grouped = first.groupBy(*keys, "_g1").agg(F.sum("_n").alias("_n"), F.sum("_pro").alias("_pro"))
    stands = (~((F.col("_n") <= tail_max) & (F.col("_pro") / F.col("_n") >= 0.5))).cast("bigint")
    # leading scenes that do not stand share count 0 with the first one, which always stands
    second = scan(grouped, by=keys, t="_g1", cell=cell, run={"_c2": ("sum", stands)})
    lead = second.groupBy(*keys).agg(F.min("_c2").alias("_c0"))
    ids = (first.select(*keys, scene, "_g1").join(second.select(*keys, "_g1", "_c2"), [*keys, "_g1"]).join(lead, keys)
           .select(*keys, scene, (F.col("_c2") - F.col("_c0")).alias("_new")))
    return (shots.join(ids, [*keys, scene]).withColumn(scene, F.col("_new")).drop("_new").select(*shots.columns))


def split_long_scenes(shots: DataFrame, max_sec: float = 300.0, *, by="timeline_id", ord="ord", scene="scene_id",
                      cols=("start", "end"), tail_max: int = 2, cell: float = DAY) -> DataFrame:
    """Scenes above ``max_sec`` are cut whenever the time since the last cut reaches the even share; a tail of at
    most ``tail_max`` shots stays with the piece before. Adds ``piece`` (0 for a whole scene)."""
    keys, (S, E) = [*as_list(by), scene], cols
    span = shots.groupBy(*keys).agg(F.min_by(S, ord).alias("_s"), F.max_by(E, ord).alias("_e"))
    length = F.col("_e") - F.col("_s")
    long = (span.filter(length > max_sec)
            .withColumn("_target", length / F.ceil(length / max_sec)).select(*keys, "_s", "_target"))
    inside = shots.select(*keys, ord, F.col(E).cast("double").alias("_t")).join(long, keys)
    ends = inside.groupBy(*keys, "_t").agg(F.min(ord).alias(ord), F.first("_s").alias("_s"), F.first("_target").alias("_target"))
    hits = (chain(ends, by=keys, t="_t", dist="_target", origin="_s", cell=cell).filter("hit")
            .select(*keys, ord, F.lit(1).alias("_hit")))
    marked = inside.select(*keys, ord).join(hits, [*keys, ord], "left").withColumn("_hit", F.coalesce("_hit", F.lit(0)))
    run = (scan(marked, by=keys, t=ord, cell=ORD_CELL, run={"_c": ("sum", "_hit")})
           .withColumn("piece", F.col("_c") - F.col("_hit")))
    sizes = run.groupBy(*keys, "piece").agg(F.count(F.lit(1)).alias("_n"))
    total = run.groupBy(*keys).agg(F.sum("_hit").alias("_all"))
    tail = (sizes.join(total, keys).filter((F.col("piece") == F.col("_all")) & (F.col("_n") <= tail_max) & (F.col("_all") > 0))
            .select(*keys, F.col("piece").alias("_tail")))
    pieces = (run.join(tail, keys, "left")
              .select(*keys, ord, F.when(F.col("piece") == F.col("_tail"), F.col("piece") - 1).otherwise(F.col("piece")).alias("piece")))
    return shots.join(pieces, [*keys, ord], "left").withColumn("piece", F.coalesce("piece", F.lit(0)).cast("bigint"))


def number_scenes(shots: DataFrame, *, by="timeline_id", ord="ord", parts=("scene_id", "piece"),
                  cell: float = ORD_CELL) -> DataFrame:
    """Consecutive scene numbers from 0 after splitting."""
    out = scan(shots, by=by, t=ord, cell=cell, island_name="_g", island_on={p: p for p in parts},
               island=lambda p, c: ~(p(parts[0]).eqNullSafe(c(parts[0])) & p(parts[1]).eqNullSafe(c(parts[1]))))
    return out.withColumn("scene_id", F.col("_g") - 1).drop("_g", *[p for p in parts if p != "scene_id"])


def scene_rollup(shots: DataFrame, *, by="timeline_id", ord="ord", scene="scene_id", cols=("start", "end"),
                 frames=("start_frame", "end_frame"), source="source_filename") -> DataFrame:
    """One row per scene: shot count, first start, last end, frame range and the ordered members."""
    keys, (S, E) = [*as_list(by), scene], cols
    members = F.transform(F.array_sort(F.collect_list(F.struct(F.col(ord).alias("o"), F.col(source).alias("f")))), lambda x: x["f"])
    return shots.groupBy(*keys).agg(F.count(F.lit(1)).alias("shot_count"), F.min_by(S, ord).alias("start_seconds"),
                                    F.max_by(E, ord).alias("end_seconds"), F.min_by(frames[0], ord).alias("start_frame"),
                                    F.max_by(frames[1], ord).alias("end_frame"), members.alias("shot_list"))


def known_characters(shots: DataFrame, *, by="timeline_id", scene="scene_id", ord="ord", characters="characters",
                     visual_id="visual_id", appearance="appearance") -> DataFrame:
    """First appearance text per visual id of a scene, in shot order."""
    keys = [*as_list(by), scene]
    each = shots.select(*keys, ord, F.posexplode(characters).alias("_p", "_c"))
    vid = F.coalesce(F.col(f"_c.{visual_id}"), F.lit("Unknown"))
    text = F.coalesce(F.col(f"_c.{appearance}"), F.lit("No description"))
    return (each.withColumn(visual_id, vid).groupBy(*keys, visual_id)
            .agg(F.min_by(text, F.struct(ord, "_p")).alias(appearance), F.min(ord).alias("first_ord")))


# ---------------------------------------------------------------- scene filters and importance

# Scene types that carry no usable content.
UNUSABLE_TYPES = {
    "film": ["studio_logo", "title_card", "credits", "transition"],
    "vlog": ["transition", "technical_issue"],
}


def default_importance(scenes: DataFrame, kind: str = "film", *, scene_type="scene_type", score="importance_score",
                       usable="is_usable") -> DataFrame:
    """Missing importance imputed by scene type, with the usable flag set along; a score of 0 is never usable."""
    typ = F.coalesce(F.col(scene_type), F.lit("content"))
    bad = typ.isin(UNUSABLE_TYPES["vlog" if kind == "vlog" else "film"])
    missing = F.col(score).isNull()
    new = F.when(~missing, F.col(score)).when(bad, 0).when(typ == "mixed", 2).otherwise(3)
    flag = F.when(missing, ~bad).otherwise(F.col(usable))
    return (scenes.withColumn("_score", new).withColumn(usable, F.when(F.col("_score") == 0, F.lit(False)).otherwise(flag))
            .withColumn(score, F.col("_score")).drop("_score"))


def usable_scenes(scenes: DataFrame, min_importance: int = 3, strict: bool = True, *, usable="is_usable",
                  score="importance_score", summary="summary") -> DataFrame:
    """Usable scenes of sufficient importance that have a summary. ``strict`` drops the threshold itself too."""
    s = F.coalesce(F.col(score), F.lit(5))
    keep = s > min_importance if strict else s >= min_importance
    return scenes.filter(F.coalesce(F.col(usable), F.lit(True)) & keep & (F.length(F.coalesce(F.col(summary), F.lit(""))) > 0))
