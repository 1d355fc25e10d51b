"""The two-level operators give the same result for every cell length, and the same as plain loops."""

import random

import numpy as np
import pandas as pd
import pytest
from conftest import rows
from pyspark.sql import functions as F

from spanloom.operators import ordered as O
from spanloom.operators.ordered import chain, exact_percentile, fit_cell, grouped_stream, scan, top_rows


def timeline_frame(seed, lines=20, most=60, span=500.0):
    rng = random.Random(seed)
    out, n = [], 0
    for tl in range(lines):
        # a third of all rows on one timeline
        size = most * lines // 2 if tl == 0 else rng.randint(1, most)
        for _ in range(size):
            t = rng.choice([round(rng.uniform(0, span), 2), float(rng.randint(0, 40))])
            out.append((tl, n, t, rng.choice(["a", "b", "c", None]), rng.choice([None, float(rng.randint(0, 9))])))
            n += 1
    return pd.DataFrame(out, columns=["timeline_id", "id", "t", "label", "v"]).astype({"v": "float64"})


@pytest.mark.parametrize("cell", [0.5, 37.0, 1e6])
def test_scan_matches_a_loop(spark, cell):
    pdf = timeline_frame(1)
    df = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), "timeline_id long, id long, t double, label string, v double")
    got = scan(df, t="t", tie=["id"], cell=cell, prev={"pl": "label", "pi": "id"}, next={"ni": "id"},
               run={"total": ("sum", "v"), "top": ("max", "v"), "low": ("min", "v"), "known": ("last", "v"), "soon": ("upcoming", "v"), "n": ("sum", F.lit(1))},
               island_on={"l": "label", "t": "t"}, island=lambda p, c: ~p("l").eqNullSafe(c("l")) | (c("t") - p("t") > 5))
    want = []
    for tl, g in pdf.sort_values(["t", "id"]).groupby("timeline_id"):
        r = g.to_dict("records")
        island, total, seen = 0, None, []
        last = None
        for i, x in enumerate(r):
            v = None if pd.isna(x["v"]) else x["v"]
            p = r[i - 1] if i else None
            if p is None or p["label"] != x["label"] or x["t"] - p["t"] > 5:
                island += 1
            if v is not None:
                seen.append(v)
                total = (total or 0.0) + v
                last = v
            soon = next((y["v"] for y in r[i:] if not pd.isna(y["v"])), None)
            want.append((tl, x["id"], p["label"] if p else None, p["id"] if p else None, r[i + 1]["id"] if i + 1 < len(r) else None, total,
                         max(seen, default=None), min(seen, default=None), last, soon, i + 1, island))
    cols = ["timeline_id", "id", "pl", "pi", "ni", "total", "top", "low", "known", "soon", "n", "island"]
    key = lambda x: (x[0], x[1])
    assert sorted((tuple(r[c] for c in cols) for r in got.collect()), key=key) == sorted(want, key=key)


def naive_chain(ts, vs, d, scored, origin):
    hits, cur = [], (origin, float("inf")) if origin is not None else None
    at = []
    for t, v in zip(ts, vs):
        if cur is None or t - cur[0] >= d or (scored and v > cur[1]):
            cur = (t, v)
            hits.append(True)
        else:
            hits.append(False)
        at.append(cur[0])
    return hits, at


@pytest.mark.parametrize("scored,with_origin", [(False, False), (True, False), (False, True)])
@pytest.mark.parametrize("cell,d,fan", [(3.0, 7.0, 64), (1e6, 7.0, 64), (0.1, 0.3, 4), (2.0, 2.0, 2)])
def test_chain_matches_a_loop(spark, scored, with_origin, cell, d, fan):
    """Few rows per table and a small fan, so that several levels of tables are composed."""
    pdf = timeline_frame(2).drop_duplicates(["timeline_id", "t"]).drop(columns=["label"])
    pdf["v"] = pdf["v"].fillna(0.0)
    pdf["d"], pdf["o"] = d * (1 + pdf["timeline_id"] % 5 / 7), -3.0
    got = chain(spark.createDataFrame(pdf), dist="d", score="v" if scored else None, origin="o" if with_origin else None, cell=cell, fan=fan)
    want = []
    for tl, g in pdf.sort_values("t").groupby("timeline_id"):
        h, a = naive_chain(g["t"].tolist(), g["v"].tolist(), g["d"].iat[0], scored, -3.0 if with_origin else None)
        want += list(zip([tl] * len(g), g["id"], h, a))
    assert rows(got, "timeline_id", "id", "hit", "at") == sorted(want)


def test_top_rows_with_large_and_varying_k(spark):
    pdf = timeline_frame(3, lines=6, most=900).fillna({"v": 0.0})
    pdf["k"] = 5 + pdf["timeline_id"] * 300
    df = spark.createDataFrame(pdf.drop(columns="label"))
    got = rows(top_rows(df, by="timeline_id", order=[F.col("v").desc(), F.col("id")], k=F.col("k"), cell=20.0), "id")
    want = pdf.sort_values(["v", "id"], ascending=[False, True]).groupby("timeline_id", group_keys=False)[["id", "k"]].apply(lambda g: g.head(g["k"].iat[0]))
    assert got == sorted((int(i),) for i in want["id"])
    big = rows(top_rows(df, by="timeline_id", order=[F.col("v").desc(), F.col("id")], k=1500, cell=20.0), "id")
    assert big == sorted((int(i),) for i in pdf.sort_values(["v", "id"], ascending=[False, True]).groupby("timeline_id").head(1500)["id"])


@pytest.mark.parametrize("p", [0, 33.3, 75, 100])
def test_percentile_is_numpys(spark, p):
    pdf = timeline_frame(4)
    pdf["x"] = (pdf["t"] * 7.3) % 1.0
    got = dict(rows(exact_percentile(spark.createDataFrame(pdf[["timeline_id", "x"]]), value="x", p=p, value_cell=0.01), "timeline_id", "threshold"))
    for tl, g in pdf.groupby("timeline_id"):
        assert got[tl] == pytest.approx(np.percentile(g["x"], p), abs=1e-12)


def test_grouped_stream_keeps_groups_whole_across_arrow_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        df = spark.range(1000).select((F.col("id") % 9).alias("g"), F.col("id").alias("x"))

        def total(pdf, b):
            return pd.DataFrame({"g": pdf["g"].to_numpy()[b[:-1]], "n": np.diff(b), "s": [pdf["x"].to_numpy()[a:z].sum() for a, z in zip(b[:-1], b[1:])]})

        got = rows(grouped_stream(df, ["g"], ["x"], total, "g long, n long, s long"), "g", "n", "s")
        assert got == [(g, len(range(g, 1000, 9)), sum(range(g, 1000, 9))) for g in range(9)]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_fit_cell_bounds_the_busiest_cell(spark):
    df = spark.range(4096).select(F.lit(1).alias("timeline_id"), (F.col("id") / 4.0).alias("t"))
    cell = fit_cell(df, max_rows=100, start=1024.0)
    assert cell == 16.0     # 64 rows; the next longer one would hold 128


@pytest.mark.parametrize("d", [3_600.0, 43_200.0, 86_400.0])
def test_no_task_of_a_chain_holds_a_timeline(spark, d, monkeypatch):
    """100,000 rows on one timeline of a year, ``dist`` up to the cell: rows that reach a composing task, whatever the level."""
    from spanloom.operators import ordered

    seen, plain = [], ordered.grouped_stream

    def counting(df, keys, order, fn, schema):
        if "_i" in order:       # a task that composes tables
            seen.append(df.groupBy(*keys).count().agg(F.max("count")).first()[0])
        return plain(df, keys, order, fn, schema)

    monkeypatch.setattr(ordered, "grouped_stream", counting)
    df = spark.range(100_000).select(F.lit(1).alias("timeline_id"), (F.col("id") * 315.36 + F.rand(3) * 300).alias("t"), F.rand(4).alias("v"), F.lit(d).alias("d"))
    chain(df, dist="d", score="v", fan=8).count()
    assert max(seen) < 8_000, seen


def test_whole_timelines_give_what_cells_give(spark):
    """One cell a timeline: the same rows, from one pass in Python and without a join of summaries."""
    df = spark.createDataFrame(timeline_frame(7, lines=6)).withColumn("v", F.pmod(F.xxhash64("id"), F.lit(10)).cast("double")).withColumn("d", F.lit(9.0))

    def scanned(cell):
        return O.scan(df, tie=["id"], cell=cell, prev={"p": "id"}, next={"n": "id"}, run={"s": ("sum", "id"), "l": ("last", F.when(F.col("id") % 3 == 0, F.col("id")))},
                      island_on={"t": "t"}, island=lambda p, c: c("t") - p("t") > 2)

    assert sorted(map(str, scanned(O.WHOLE).collect())) == sorted(map(str, scanned(5.0).collect()))
    assert "Join" not in scanned(O.WHOLE)._jdf.queryExecution().executedPlan().toString()
    one = O.distinct_instants(df, score="v", tie=["id"])
    assert rows(O.distinct_instants(df, score="v", tie=["id"], cell=O.WHOLE), "id") == rows(one, "id")
    for score in (None, "v"):
        cells, whole = (O.chain(one, dist="d", score=score, cell=c) for c in (5.0, O.WHOLE))
        assert rows(whole, "id", "hit", "at") == rows(cells, "id", "hit", "at")
        assert whole._jdf.queryExecution().optimizedPlan().toString().count("MapInPandas") == 1


def test_timelines_are_told_apart_by_size(spark):
    df = spark.createDataFrame([(1, x) for x in range(5)] + [(2, x) for x in range(3)] + [(None, 0)], "timeline_id int, x int")
    sizes = df.withColumn("rows", F.lit(1))
    (a, (small,)), (b, (large,)) = O.by_size(sizes, [df], cell=7.0, limit=4)
    assert (a, b) == (O.WHOLE, 7.0) and small.count() == 4 and rows(large, "timeline_id", "x") == [(1, x) for x in range(5)]
    assert [c for c, _ in O.by_size(sizes, [df], cell=7.0)] == [O.WHOLE]
