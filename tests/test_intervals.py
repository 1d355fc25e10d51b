import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from spanloom.operators import intervals as I


def spans(seed, n=150):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        s = rng.choice([float(rng.randint(0, 60)), round(rng.uniform(0, 60), 2)])
        out.append((rng.randint(0, 2), i, s, s + rng.choice([0.0, 1.0, 5.0, round(rng.uniform(0, 8), 2), 55.0, 1e-4, 8.0, 64.0, 1e12, -3.0])))
    return out


@pytest.mark.parametrize("mode", ["closed", "half_open", "int_ceil"])
@pytest.mark.parametrize("spread", [1, 3])
def test_join_equals_nested_loop(spark, mode, spread):
    import math
    a, b = spans(1), spans(2)
    A = spark.createDataFrame(a, "timeline_id int, a_id int, a_start double, a_end double")
    B = spark.createDataFrame(b, "timeline_id int, b_id int, b_start double, b_end double")

    def hit(x, y):
        s, e, S, E = x[2], x[3], y[2], y[3]
        if mode == "closed":
            return s <= E and e >= S
        if mode == "half_open":
            return s < E and e > S
        s, e, S, E = math.floor(s), max(math.ceil(e), math.floor(s) + 1), math.floor(S), math.floor(E)
        return s < E and e > S

    want = sorted((x[1], y[1]) for x in a for y in b if x[0] == y[0] and hit(x, y))
    assert rows(I.overlap_join(A, B, mode=mode, spread=spread), "a_id", "b_id") == want
    semi = rows(I.overlap_join(A, B, mode=mode, how="left_semi"), "a_id")
    assert semi == sorted({(i,) for i, _ in want})
    left = I.overlap_join(A, B, mode=mode, how="left")
    assert left.filter("b_id is null").count() == len(a) - len(semi) and left.filter("b_id is not null").count() == len(want)


def test_duplicate_rows_survive_outer_and_semi(spark):
    A = spark.createDataFrame([(1, 0.0, 1.0)] * 2 + [(1, 50.0, 51.0)] * 2, "timeline_id int, a_start double, a_end double")
    B = spark.createDataFrame([(1, 0.5, 0.7)], "timeline_id int, b_start double, b_end double")
    assert I.overlap_join(A, B, how="left").count() == 4
    assert I.overlap_join(A, B, how="left_semi").count() == 2


def test_plans_hold_no_nested_loop(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        A = spark.createDataFrame(spans(1), "timeline_id int, a_id int, a_start double, a_end double")
        B = spark.createDataFrame(spans(2), "timeline_id int, b_id int, b_start double, b_end double")
        for df in (I.overlap_join(A, B), I.point_in_interval(A, B, t="a_start", cols=("b_start", "b_end")), I.overlap_join(A, B, how="left")):
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert "CartesianProduct" not in plan and "NestedLoop" not in plan and "Join" in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("mode", ["half_open", "closed", "open"])
def test_points_at_interval_ends(spark, mode):
    p = spark.createDataFrame([(1, float(t)) for t in range(12)], "timeline_id int, t double")
    s = spark.createDataFrame([(1, 2.0, 5.0), (1, 5.0, 5.0), (1, 5.0, 8.0)], "timeline_id int, start_time double, end_time double")
    ok = {"half_open": lambda t, a, b: a <= t < b, "closed": lambda t, a, b: a <= t <= b, "open": lambda t, a, b: a < t < b}[mode]
    want = sorted((float(t), a, b) for t in range(12) for a, b in ((2, 5), (5, 5), (5, 8)) if ok(t, a, b))
    assert rows(I.point_in_interval(p, s, mode=mode), "t", "start_time", "end_time") == want


@pytest.mark.parametrize("cell", [3.0, float("inf")])
@pytest.mark.parametrize("mode", ["half_open", "open"])
def test_points_in_disjoint_intervals(spark, mode, cell):
    p = spark.createDataFrame([(k, float(t)) for k in (1, 2, None) for t in range(-1, 12)] + [(1, 3.0), (1, None)], "timeline_id int, t double")
    s = spark.createDataFrame([(1, 5.0, 8.0, "b"), (1, 2.0, 5.0, "a"), (1, 9.0, 9.5, "c"), (None, 0.0, 9.0, "d"), (2, None, 4.0, "e"), (2, 6.0, None, "f")],
                              "timeline_id int, start_time double, end_time double, name string")
    want = I.point_in_interval(p, s, mode=mode)
    got = I.point_in_disjoint(p, s, mode=mode, cell=cell)
    assert got.columns == want.columns and rows(got, *got.columns) == rows(want, *got.columns)


def test_points_of_all_levels(spark):
    a = spans(3, 200)
    pts = [(i % 3, i, x) for i, x in enumerate([r[2] for r in spans(4, 100)] + [-1e9, 1e11, 5e11, 1e12 + 50, 2e12, float("inf")])] + [(1, -1, None)]
    S = spark.createDataFrame([(*r[:1], r[1], r[2], r[3]) for r in a] + [(0, 900, 5.0, float("inf")), (1, 901, None, 4.0)], "timeline_id int, s_id int, start_time double, end_time double")
    P = spark.createDataFrame(pts, "timeline_id int, p_id int, t double")
    want = sorted((p[1], r[1]) for p in pts for r in [*a, (0, 900, 5.0, float("inf"))] if p[2] is not None and p[0] == r[0] and r[2] <= p[2] < r[3])
    assert rows(I.point_in_interval(P, S), "p_id", "s_id") == want
    assert rows(I.point_in_interval(P, S, how="left_semi"), "p_id") == sorted({(i,) for i, _ in want})


def test_rows_of_an_interval_are_few_however_long(spark):
    ends = [0.0, 1e-9, 0.5, 1.0, 7.99, 8.0, 8.01, 1e9, 1e12, 1e300, float("inf")]
    df = spark.createDataFrame([(i, -3.3, -3.3 + e) for i, e in enumerate(ends)], "i int, s double, e double")
    assert I._covered(df, "s", "e").groupBy("i").count().agg(F.max("count")).first()[0] <= 18
    every = F.array(*[F.lit(x) for x in range(I.LOWEST, I.HIGHEST + 1)])
    assert I._covered(df, "s", "e", every).groupBy("i").count().agg(F.max("count")).first()[0] <= 70


def test_gate_without_intervals_keeps_everything(spark):
    p = spark.createDataFrame([(1, 1.0), (1, 9.0), (2, 1.0)], "timeline_id int, t double")
    s = spark.createDataFrame([(1, 0.0, 1.0)], "timeline_id int, start_time double, end_time double")
    assert rows(I.gate_by_intervals(p, s), "timeline_id", "t") == [(1, 1.0), (2, 1.0)]


def test_label_ties_go_to_the_first_seen_and_none_is_unknown(spark):
    seg = spark.createDataFrame([(1, 1, 0.0, 10.0), (1, 2, 90.0, 95.0)], "timeline_id int, seg_id int, start double, end double")
    turns = spark.createDataFrame([(1, 0.0, 4.0, "b", 1), (1, 4.0, 8.0, "a", 2), (1, 95.0, 99.0, "a", 3)], "timeline_id int, turn_start double, turn_end double, speaker string, turn_ord int")
    assert rows(I.dominant_label(seg, turns), "seg_id", "speaker") == [(1, "b"), (2, "UNKNOWN")]


def test_nearest_prefers_the_earlier_mark(spark):
    p = spark.createDataFrame([(1, 5.0), (1, 5.1), (1, 0.0), (2, 1.0)], "timeline_id int, t double").withColumn("id", F.lit(1))
    m = spark.createDataFrame([(1, 3.0), (1, 7.0)], "timeline_id int, mark double")
    got = sorted(((r.timeline_id, r.t, r.nearest) for r in I.nearest_boundary(p, m, cell=2.0).collect()), key=str)
    assert got == [(1, 0.0, 3.0), (1, 5.0, 3.0), (1, 5.1, 7.0), (2, 1.0, None)]


def test_neighbours_without_a_known_limit(spark):
    rec = spark.createDataFrame([(1, 1, 0)], "timeline_id int, scene_id int, max_scene int")
    assert rows(I.allowed_neighbors(rec, n=2), "scene_id") == [(0,), (1,), (2,), (3,)]


def test_joins_broadcast_nothing_and_cover_few_nodes(spark):
    A = spark.createDataFrame(spans(1), "timeline_id int, a_id int, a_start double, a_end double")
    B = spark.createDataFrame(spans(2), "timeline_id int, b_id int, b_start double, b_end double")
    for df in (I.overlap_join(A, B), I.overlap_join(A, B, how="left_semi"), I.overlap_join(A, B, how="left"),
               I.point_in_interval(A, B, t="a_start", cols=("b_start", "b_end"))):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan, plan
    long = spark.createDataFrame([(1, 0.3, 0.3 + 1.7**n) for n in range(-20, 80)], "timeline_id int, s double, e double")
    assert I._covered(long, "s", "e").groupBy("s", "e").count().agg({"count": "max"}).first()[0] <= 3
