"""Pipeline from described shots to scenes."""

from __future__ import annotations

from pyspark.sql import DataFrame

from spanloom.operators.scenes import absorb_scenes, adjacent_similarity, number_scenes, scene_cuts, split_long_scenes
from spanloom.session import materialize


def segment_scenes(shots: DataFrame, threshold: float = 0.5, max_sec: float = 300.0, *, by="timeline_id") -> DataFrame:
    """Shots with the final scene number: cut by similarity, short scenes absorbed, long ones split.

    Needs the columns of :mod:`spanloom.operators.scenes`, with ``tag_vectors`` and ``picture`` attached. The vectors
    are dropped after the first step; only slim rows are stored between steps.
    """
    cut = scene_cuts(adjacent_similarity(shots, by=by), threshold, by=by).drop("tag_vectors", "picture", "sim_prev", "sim_skip", "is_cut")
    joined = materialize(absorb_scenes(materialize(cut), by=by))
    if max_sec <= 0:
        return joined
    return number_scenes(split_long_scenes(joined, max_sec, by=by), by=by)
