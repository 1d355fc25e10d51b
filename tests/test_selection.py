import random

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from spanloom.operators import selection as C
from spanloom.operators import validate as V
from spanloom.operators import vectors as X


@pytest.mark.parametrize("text,target,status,end", [
    ("[shot: 00:00:10 to 00:00:15]", 5.0, "ok", None),
    ("shot 1: 00:00:10 to 00:00:15.5", 5.0, "auto_trim", 15.0),
    ("[shot: 00:00:10 to 00:00:15]", 9.0, "mismatch", None),
    ("[shot 1: 00:10 to 00:12] [shot 2: 00:14 to 00:17]", 5.0, "ok", None),
    ("[shot 1: 00:10 to 00:12] [shot 2: 00:14.5 to 00:17]", 4.5, "gap", None),
    ("[shot 1: 00:10 to 00:12] [shot 2: 00:11 to 00:14]", 5.0, "overlap", None),
    ("[shot: 00:10 to 00:10]", 1.0, "bad_duration", None),
    ("[shot: 00:1.2.3 to 00:10]", 1.0, "bad_time", None),
    (" ".join(["[shot: 00:10 to 00:12]"] * 4), 8.0, "too_many", None),
    ("nothing", 8.0, "no_range", None),
])
def test_selection_states(spark, text, target, status, end):
    r = C.selection_check(spark.createDataFrame([(text, target)], "answer string, target double")).first()
    assert (r.status, r.new_end) == (status, end)


@pytest.mark.parametrize("limit", [1_000_000, 3])
def test_admission_in_slot_order(spark, limit):
    rng = random.Random(9)
    data = [(tl, i, rng.randint(0, 9), s, s + rng.choice([1.0, 4.0, 12.0])) for tl in range(4) for i, s in ((j, float(rng.randint(0, 80))) for j in range(40))]
    df = spark.createDataFrame(data, "timeline_id int, id int, slot int, start double, end double")
    got = rows(C.admit_clips(df, max_component=limit, cell=10.0).filter("accepted"), "timeline_id", "id")
    want = []
    for tl in range(4):
        ok = []
        for r in sorted((r for r in data if r[0] == tl), key=lambda r: (r[2], r[1])):
            if all(not (r[3] < o[4] and r[4] > o[3]) for o in ok):
                ok.append(r)
        want += [(tl, r[1]) for r in ok]
    assert got == sorted(want)


def test_a_chain_of_overlaps_is_decided_by_doubling(spark, monkeypatch):
    """Each proposal overlaps the one before it only, in slot order: every second one is accepted."""
    written, plain = [], C.materialize
    monkeypatch.setattr(C, "materialize", lambda df: written.append(1) or plain(df))
    df = spark.range(10_000).select(F.lit(1).alias("timeline_id"), "id", F.col("id").alias("slot"), (F.col("id") * 2.0).alias("start"), (F.col("id") * 2.0 + 3).alias("end"))
    got = C.admit_clips(df, max_component=100, cell=1000.0).filter("accepted")
    assert got.count() == 5_000 and got.filter("id % 2 = 1").isEmpty()
    assert len(written) < 30       # about 14 doublings in one round


def test_unreadable_score_passes(spark):
    df = spark.createDataFrame([(1, "cannot {"), (2, '{"overall_aesthetic_score": 2.9}'), (3, 'x {"overall_aesthetic_score": 3.0} y')], "id int, response string")
    assert rows(C.aesthetic_gate(df), "id", "passed") == [(1, True), (2, False), (3, True)]


def test_integer_list_violation(spark):
    df = spark.createDataFrame([('{"a": 1, "ids": [1, 2]}',), ('{"a": 1, "ids": [1, "x"]}',), ('{"ids": 5}',)], "body string")
    got = [r.violations for r in V.validate_docs(df, required=["a", "ids"], int_list="ids").collect()]
    assert got == [[], ["ids holds a non-integer"], ["missing a", "ids is not a list"]]


def _vectors(spark, n=300, dim=6):
    rng = random.Random(5)
    heart = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(8)]
    rows = [(i, [x + rng.gauss(0, 0.1) for x in heart[i % 8]], float(i)) for i in range(n)]
    rows += [(n, [0.0] * dim, 0.0), (n + 1, rows[3][1], 1.0), (n + 2, [5 * x for x in rows[3][1]], 2.0)] + [(n + 10 + i, rows[7][1], 3.0) for i in range(40)]
    return rows, spark.createDataFrame([*rows, (900, None, 0.0), (901, [1.0, None] + [0.0] * (dim - 2), 0.0)], "id bigint, vector array<double>, t double")


@pytest.mark.parametrize("block,query_block,cells", [(65_536, 16_384, 64), (7, 50, 9), (1000, 1000, 1)])
def test_nearest_vectors_equal_brute_force(spark, block, query_block, cells):
    """Ties by id (forty copies of one vector), a zero vector, null vectors; blocks of both sides, one cell and many."""
    import numpy as np

    rows_, base = _vectors(spark)
    q = base.select(F.col("id").alias("query_id"), F.col("vector").alias("query_vector"))
    got = X.vector_topk(base, q, 5, block=block, query_block=query_block, cells=cells, order_time="t").collect()
    x = np.array([r[1] for r in rows_])
    u = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    near, ids = np.round(u @ u.T, 12), np.array([r[0] for r in rows_])
    want = {}
    for i, row in zip(ids.tolist(), near):
        order = np.lexsort((ids, -row))[:5]
        for n, j in enumerate(order.tolist(), 1):
            want[i, n] = (ids[j], row[j], rows_[j][2])
    assert len(got) == len(want)
    for r in got:
        i, v, t = want[r.query_id, r["rank"]]
        assert (r.id, r.t) == (i, t) and abs(r.similarity - v) < 1e-11


def test_cells_rule_out_most_pairs(spark):
    _, base = _vectors(spark, 2000)
    q = base.select(F.col("id").alias("query_id"), F.col("vector").alias("query_vector"))
    w = X.vector_topk_work(base, q, 5, cells=64).first()
    assert w.pairs == 2043 ** 2 and 0 < w.compared < 0.6 * w.pairs


def test_vectors_of_no_rows_and_of_two_lengths(spark):
    base = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0])], "id int, vector array<float>")
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id int, query_vector array<float>")
    assert X.vector_topk(base.filter("id = 3"), q).count() == 0 and X.vector_topk(base.filter("id = 1"), q.limit(0)).count() == 0
    with pytest.raises(ValueError):
        X.vector_topk(base, q)


def test_batch_scores_distinct_inputs_once_and_retries(spark, tmp_path):
    log = str(tmp_path / "calls")

    def fn(items):
        with open(log, "a") as f:
            f.write("\n".join(items) + "\n")
        if open(log).read().count("b") == 1:
            raise RuntimeError("first try fails")
        return [len(i) for i in items]

    df = spark.createDataFrame([("aa",), ("b",), ("aa",), (None,)], "x string").repartition(1)
    got = sorted(((r.x, r.score) for r in X.batch_score(df, fn, column="x", schema="int", batch=8).collect()), key=str)
    assert got == [("aa", 2), ("aa", 2), ("b", 1), (None, None)]


def test_stored_scores_are_not_asked_for_again(spark, tmp_path):
    log = tmp_path / "calls"

    def fn(items):
        with open(str(log), "a") as f:
            f.write("".join(f"{i}\n" for i in items))
        return [len(i) for i in items]

    store = str(tmp_path / "store")
    one = spark.createDataFrame([("a",), ("bb",), (None,)], "x string")
    two = spark.createDataFrame([("bb",), ("ccc",), ("a",), ("a",)], "x string")
    for df, want in ((one, [("a", 1), ("bb", 2), (None, None)]), (two, [("a", 1), ("a", 1), ("bb", 2), ("ccc", 3)]), (two, [("a", 1), ("a", 1), ("bb", 2), ("ccc", 3)])):
        got = X.batch_score(df, fn, column="x", schema="int", store=store).collect()
        assert sorted(((r.x, r.score) for r in got), key=str) == want
    assert sorted(log.read_text().split()) == ["a", "bb", "ccc"]


def test_queries_go_once_to_a_block(spark):
    rng = np.random.default_rng(5)
    base = spark.createDataFrame([(i, rng.normal(size=8).tolist()) for i in range(600)], "id bigint, vector array<double>")
    q = base.select(F.col("id").alias("query_id"), F.col("vector").alias("query_vector"))
    for block, most in ((1000, 1), (100, 22)):
        dealt, routed, _, _ = X._routed(base, q, 5, "id", "vector", "query_id", "query_vector", [], block, 1000, 16)
        sent = routed.groupBy("query").count()
        assert sent.agg(F.max("count")).first()[0] <= most
        assert routed.groupBy("query", "part").count().filter("count > 1").isEmpty()
        assert dealt.groupBy("part").count().agg(F.max("count")).first()[0] <= block * 1.5
    got = X.vector_topk(base, q, 5, block=100, cells=16)
    want = X.vector_topk(base, q, 5, cells=1)
    assert sorted(map(tuple, got.select("query_id", "id", "rank").collect())) == sorted(map(tuple, want.select("query_id", "id", "rank").collect()))


def test_review_parses_each_text_once(spark):
    one = "[shot: 00:00:10 to 00:00:13]"
    said = [("a", 1, one, 3.0), ("a", 2, "no range", 3.0), ("b", 3, one, 9.0), (None, 4, one, 3.0), ("a", None, one, 3.0)]
    proposals = spark.createDataFrame(said, "timeline_id string, proposal_id int, answer string, target double")
    used = spark.createDataFrame([("a", 12.0, 20.0), ("a", 0.0, 11.0), ("a", 13.0, 14.0), (None, 0.0, 99.0)], "timeline_id string, used_start double, used_end double")
    out = C.review_selections(proposals, used)
    assert "regexp_extract_all" not in out._jdf.queryExecution().toString()
    got = {(r.timeline_id, r.proposal_id): (r.approved, r.overlaps, r.issues, r.suggestions) for r in out.collect()}
    assert got == {("a", 1): (False, 2, ["used_overlap"], ["adjust_selection", "choose_free_range"]), ("a", 2): (False, 0, ["no_range"], ["adjust_selection"]),
                   ("b", 3): (False, 0, ["mismatch"], ["adjust_selection", "adjust_range_to_target"]), (None, 4): (True, 0, [], []), ("a", None): (True, 0, [], [])}
