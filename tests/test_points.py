import random

import pandas as pd
import pytest
from conftest import rows
from pyspark.sql import functions as F

from spanloom.operators import points as P
from spanloom.plans import song


def sample(seed, lines=12, most=50, span=200.0):
    rng = random.Random(seed)
    out = []
    for tl in range(lines):
        for _ in range(most * 5 if tl == 0 else rng.randint(0, most)):
            out.append((tl, len(out), round(rng.uniform(0, span), rng.choice([0, 2])), rng.choice(["Downbeat", "Pitch", "MelEnergy"]), float(rng.randint(0, 12)) / 10))
    return pd.DataFrame(out, columns=["timeline_id", "id", "t", "type", "intensity"])


def greedy(g, dist, key="intensity"):
    kept = []
    for r in sorted(g.to_dict("records"), key=lambda r: (-r[key], r["t"], r["id"])):
        if all(abs(r["t"] - k["t"]) >= dist for k in kept):
            kept.append(r)
    return kept


@pytest.mark.parametrize("limit,cell", [(1_000_000, 86_400.0), (5, 20.0)])
def test_suppression_matches_the_greedy_pass(spark, limit, cell):
    """With a tiny limit every component of more than five rows is decided in rounds over cells."""
    pdf = sample(1)
    got = rows(P.nms_time(spark.createDataFrame(pdf), 4.0, 0.2, max_component=limit, cell=cell), "timeline_id", "id")
    want = sorted((tl, r["id"]) for tl, g in pdf[pdf.intensity >= 0.2].groupby("timeline_id") for r in greedy(g, 4.0))
    assert got == want


@pytest.mark.parametrize("shape", ["rising", "falling", "saw"])
def test_suppression_of_ramps_in_rounds(spark, monkeypatch, shape):
    """The worst case for rounds: each row waits for its neighbour. 10^5 rows in cells of 50 end after a few rounds."""
    rounds, plain = [], P.grouped_stream
    monkeypatch.setattr(P, "grouped_stream", lambda *a: rounds.append("kept boolean, side int" in a[4]) or plain(*a))
    n = 100_000 if shape == "rising" else 3_000
    value = {"rising": lambda i: i, "falling": lambda i: -i, "saw": lambda i: (i % 700 if i % 1400 < 700 else 1400 - i % 1400) + i / 1e6}[shape]
    pdf = pd.DataFrame({"timeline_id": 0, "id": range(n), "t": [i * 1.0 for i in range(n)], "intensity": [float(value(i)) for i in range(n)]})
    got = rows(P.nms_time(spark.createDataFrame(pdf), 2.5, max_component=10, cell=50.0), "id")
    kept, ts = [], []
    import bisect
    for i in sorted(range(n), key=lambda i: (-pdf.intensity[i], i)):
        k = bisect.bisect_left(ts, i)
        if (k == 0 or i - ts[k - 1] >= 2.5) and (k == len(ts) or ts[k] - i >= 2.5):
            ts.insert(k, i)
            kept.append((i,))
    assert got == sorted(kept)
    assert sum(rounds) <= 8, sum(rounds)


def test_suppression_cap_equals_early_stop(spark):
    pdf = sample(2)
    got = rows(P.nms_time(spark.createDataFrame(pdf), 3.0, max_n=4), "timeline_id", "id")
    assert got == sorted((tl, r["id"]) for tl, g in pdf.groupby("timeline_id") for r in greedy(g, 3.0)[:4])


@pytest.mark.parametrize("cell", [5.0, 1e5])
def test_min_interval_matches_a_loop(spark, cell):
    pdf = sample(3)
    got = rows(P.min_interval_best(spark.createDataFrame(pdf), 6.0, score="intensity", cell=cell), "timeline_id", "id")
    want = []
    for tl, g in pdf.sort_values(["t", "id"]).groupby("timeline_id"):
        anchor = best = None
        for r in g.to_dict("records"):
            if anchor is None or r["t"] - anchor >= 6.0:
                if best:
                    want.append((tl, best["id"]))
                anchor, best = r["t"], r
            elif r["intensity"] > best["intensity"]:
                best = r
        want.append((tl, best["id"]))
    assert got == sorted(want)


@pytest.mark.parametrize("duration", [None, 200.0])
@pytest.mark.parametrize("cell", [5.0, 1e5])
def test_spacing_matches_a_loop(spark, duration, cell):
    pdf = sample(4)
    got = rows(P.enforce_spacing(spark.createDataFrame(pdf), 5.0, duration, score="intensity", cell=cell), "timeline_id", "id")
    want = []
    for tl, g in pdf.sort_values(["t", "id"]).groupby("timeline_id"):
        r, kept = g.to_dict("records"), []
        for i, x in enumerate(r):
            if duration and ((i == 0 and x["t"] < 5.0) or (i == len(r) - 1 and duration - x["t"] < 5.0)):
                continue
            if kept and x["t"] - kept[-1]["t"] < 5.0:
                if x["intensity"] > kept[-1]["intensity"]:
                    kept[-1] = x
                continue
            kept.append(x)
        want += [(tl, k["id"]) for k in kept]
    assert got == sorted(want)


def test_gap_filling_matches_a_loop(spark):
    pdf = sample(5, span=900.0)
    kept = pdf[pdf["id"] % 11 == 0]
    got = rows(P.fill_long_gaps(spark.createDataFrame(kept), spark.createDataFrame(pdf), 15.0, cell=100.0), "timeline_id", "id")
    want = [(r.timeline_id, r.id) for r in kept.itertuples()]
    for tl, g in kept.sort_values("t").groupby("timeline_id"):
        ts = g["t"].tolist()
        raw = pdf[pdf.timeline_id == tl].sort_values(["t", "id"]).to_dict("records")
        for a, b in zip(ts, ts[1:]):
            if b - a > 15.0:
                k = -int(-(b - a) // 15.0) - 1
                cand = [r for r in raw if a < r["t"] < b]
                for j in range(1, k + 1):
                    if cand:
                        ideal = a + (b - a) * j / (k + 1)
                        best = min(range(len(cand)), key=lambda i: (abs(cand[i]["t"] - ideal), i))
                        want.append((tl, cand.pop(best)["id"]))
    assert got == sorted(want)


def test_normalisation_edges(spark):
    df = spark.createDataFrame([(1, 1, "a", 2.0, None), (1, 2, "a", 9.0, 4.0), (1, 3, "flat", 7.0, None), (1, 4, "flat", 7.0, None), (1, 5, "none", None, None)],
                               "timeline_id int, id int, type string, intensity double, activation double")
    got = rows(P.normalize_by_type(df), "id", "intensity", "normalized_intensity")
    assert got == [(1, 2.0, 0.0), (2, 4.0, 1.0), (3, 7.0, 0.5), (4, 7.0, 0.5), (5, 0.5, 0.5)]


def test_allocation_sums_to_the_total_and_never_goes_negative(spark):
    pts = spark.createDataFrame([(1, float(t)) for t in [1] * 1 + [11] * 50 + [21] * 49] + [(2, 5.0)], "timeline_id int, t double")
    sec = spark.createDataFrame([(tl, o, f"s{o}", o * 10.0, o * 10.0 + 10) for tl in (1, 2, 3) for o in range(3)], "timeline_id int, ord long, name string, start_time double, end_time double")
    a = P.allocate_slots(pts, sec, 20)
    assert rows(a.groupBy("timeline_id").agg(F.sum("slots").alias("n")), "timeline_id", "n") == [(1, 20), (2, 20)]
    assert rows(P.allocate_slots(pts, sec, 2).filter("timeline_id = 1"), "ord", "slots") == [(0, 1), (1, 0), (2, 1)]


def test_timelines_without_sections_pass_through(spark):
    pdf = sample(6)
    pts = spark.createDataFrame(pdf)
    sec = spark.createDataFrame([(0, 0, "s", 0.0, 100.0)], "timeline_id long, ord long, name string, start_time double, end_time double")
    got = song.filter_by_sections(pts, sec, total=5)
    assert got.filter("timeline_id <> 0").count() == (pdf.timeline_id != 0).sum()
    assert 0 < got.filter("timeline_id = 0").count()


def test_empty_selection_and_empty_input(spark):
    df = spark.createDataFrame(sample(7))
    assert P.select_types(df, []).count() == 0
    assert P.nms_time(df.limit(0), 2.0).count() == 0
    assert P.min_interval_best(df.limit(0), 2.0, score="intensity").count() == 0
    assert P.filter_types(df, "only", []).count() == df.count()


def test_frame_lookup_is_clamped_and_defaults(spark):
    beats = spark.createDataFrame([(1, 0.004, 1), (1, 99.0, 1), (1, 0.5, 2), (2, 1.0, 1)], "timeline_id int, t double, beat int")
    act = spark.createDataFrame([(1, 0, 0.9), (1, 1, float("nan"))], "timeline_id int, frame_idx int, activation double")
    assert rows(P.downbeats(beats, act), "timeline_id", "t", "intensity") == [(1, 0.004, 0.9), (1, 99.0, 0.5), (2, 1.0, 0.5)]
