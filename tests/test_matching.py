"""The pruning of candidates for the two no-reuse matchings, on layouts made to break it: clusters, empty stretches,
equal times, candidates on the border between two ideal positions."""

import math
import random

from conftest import rows
from pyspark.sql import functions as F

from spanloom.operators.points import fill_long_gaps
from spanloom.operators.segments import split_near_midpoints


def layouts(n):
    out = {}
    for tl in range(n):
        rng = random.Random(tl)
        times = []
        for _ in range(rng.randint(0, 5)):
            c, w = rng.uniform(2, 98), rng.choice([0.0, 1.0, 6.0, 20.0])
            times += [float(min(99.5, max(0.5, rng.choice([round(c + rng.uniform(-w, w)), c + rng.uniform(-w, w), c])))) for _ in range(rng.randint(1, 14))]
        out[tl] = [(i, t, float(rng.randint(0, 5))) for i, t in enumerate(times)]
    return out


def take_nearest(cand, ideal):
    return min(range(len(cand)), key=lambda i: (abs(cand[i][1] - ideal), i))


def test_gap_filling_on_hard_layouts(spark):
    data = layouts(150)
    raw = spark.createDataFrame([(tl, i, t) for tl, c in data.items() for i, t, _ in c], "timeline_id int, id int, t double")
    ends = spark.createDataFrame([(tl, -1 - int(x), x) for tl in data for x in (0.0, 100.0)], "timeline_id int, id int, t double")
    got = rows(fill_long_gaps(ends, raw, 10.0, cell=30.0).filter("id >= 0"), "timeline_id", "id")
    want = []
    for tl, c in data.items():
        cand = sorted(c, key=lambda p: (p[1], p[0]))
        for j in range(1, 10):
            if cand:
                want.append((tl, cand.pop(take_nearest(cand, 100.0 * j / 10))[0]))
    assert got == sorted(want)


def test_midpoint_cuts_on_hard_layouts(spark):
    data = layouts(150)
    pts = spark.createDataFrame([(tl, i, t, v) for tl, c in data.items() for i, t, v in c], "timeline_id int, id int, t double, normalized_intensity double")
    seg = spark.createDataFrame([(tl, 0.0, 100.0, 100.0) for tl in data], "timeline_id int, start_time double, end_time double, duration double")
    for max_len, radius in ((10.0, 3.0), (4.0, 3.0)):        # the second radius reaches into the neighbouring zones
        got = rows(split_near_midpoints(seg, pts, max_len, radius, cell=30.0), "timeline_id", "start_time", "end_time")
        want = []
        n = math.ceil(100.0 / max_len)
        for tl, c in data.items():
            cand, cuts = sorted(c, key=lambda p: (p[1], p[0])), set()
            for j in range(1, n):
                mid = j * (100.0 / n)
                near = [i for i, p in enumerate(cand) if mid - radius <= p[1] <= mid + radius]
                if near:
                    cuts.add(cand.pop(max(near, key=lambda i: (cand[i][2], -i)))[1])
                elif cand:
                    cuts.add(cand.pop(take_nearest(cand, mid))[1])
                else:
                    cuts.add(mid)
            marks = [0.0, *sorted(cuts), 100.0]
            want += [(tl, a, b) for a, b in zip(marks, marks[1:]) if b - a >= 0]
        assert got == sorted(want)
