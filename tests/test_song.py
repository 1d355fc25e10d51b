"""The two pipelines of plans/song.py give the same rows whether timelines are taken whole, by cells or both."""

import random

import pytest
from pyspark.sql import functions as F

from spanloom.operators import ordered
from spanloom.operators import points as P
from spanloom.plans import song


def tables(spark):
    rng = random.Random(5)
    pts = [(tl, n, round(rng.uniform(0, 300), 1), rng.choice(["Downbeat", "Pitch"]), float(rng.randint(0, 9))) for n, tl in enumerate([0] * 150 + [1] * 40 + [2] * 9 + [3] * 3)]
    pts += [*pts[:20], (1, 900, None, "Pitch", 1.0), (None, 901, 5.0, "Pitch", 1.0), (4, 902, 5.0, "Pitch", 1.0)]
    sec = [(tl, o, f"s{o}", o * 100.0, o * 100.0 + 100.0, 300.0) for tl in (0, 1, 2, 3, 5) for o in range(3)] + [(None, 0, "n", 0.0, 9.0, 9.0), (2, None, "n", None, None, 300.0)]
    return (spark.createDataFrame(pts, "timeline_id long, id long, t double, type string, intensity double"),
            spark.createDataFrame(sec, "timeline_id long, ord long, name string, start_time double, end_time double, duration double"))


def results(spark):
    pts, sec = tables(spark)
    kept = song.filter_by_sections(pts, sec, min_interval=3.0, max_segment=20.0, min_segment=5.0, total=12, duration="duration", cell=40.0)
    plain = song.filter_by_sections(pts, sec, max_segment=0, min_segment=4.0, total=6, duration=300.0, cell=40.0)
    raw = P.normalize_by_type(pts)
    cut = song.two_level_segments(sec, raw.filter(F.col("id") % 7 == 0).select("timeline_id", "t"), raw, min_len=4.0, max_len=15.0, cell=40.0)
    return [sorted(map(str, x.collect())) for x in (kept, plain, cut)]


@pytest.mark.parametrize("limit", [0, 45])
def test_rows_do_not_depend_on_the_size_of_a_timeline(spark, monkeypatch, limit):
    whole = results(spark)
    assert all(len(x) > 20 for x in whole)
    monkeypatch.setattr(ordered, "SMALL", limit)
    assert results(spark) == whole


def test_small_timelines_pass_python_once_a_fold(spark, monkeypatch):
    """Two chains and one matching; by cells each chain takes three passes."""
    calls, plain = [], ordered.grouped_stream

    def counted(*a, **kw):
        calls.append(a[1])
        return plain(*a, **kw)

    for module in (ordered, P):
        monkeypatch.setattr(module, "grouped_stream", counted)
    pts, sec = tables(spark)
    song.filter_by_sections(pts, sec, min_interval=3.0, max_segment=20.0, min_segment=5.0, total=12, duration="duration")
    assert len(calls) == 3
