"""Streams fed file by file, with rows out of order inside the watermark and rows behind it."""

import datetime as dt

import pytest
from conftest import rows
from pyspark.sql import functions as F

from spanloom.streaming import forms

START = dt.datetime(2024, 1, 1)
SCHEMA = "timeline_id int, id long, ts timestamp, intensity double"


@pytest.fixture
def feed(spark, tmp_path):
    def write(batches):
        src = str(tmp_path / "src")
        for n, b in enumerate(batches):
            data = [(tl, i, START + dt.timedelta(seconds=s), v) for tl, i, s, v in b]
            spark.createDataFrame(data, SCHEMA).coalesce(1).write.mode("append").parquet(f"{src}/{n:03d}")
        return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(src)
    return write


def test_min_interval_out_of_order_and_late(spark, feed, tmp_path):
    s = feed([[(1, 1, 0, 1.0), (1, 3, 12, 5.0)], [(1, 2, 6, 9.0), (2, 9, 0, 1.0)], [(1, 4, 100, 1.0)], [(2, 8, 101, 1.0)], [(1, 5, 8, 99.0), (1, 6, 200, 1.0), (2, 7, 190, 2.0)]])
    out = forms.run_available(forms.stream_min_interval(s, 10.0, "20 seconds"), str(tmp_path / "out"))
    # row 2 comes late but inside the watermark; row 5 is behind that of the batch before and is dropped;
    # rows 6 and 7 are still open
    assert rows(out, "timeline_id", "id") == [(1, 2), (1, 3), (1, 4), (2, 8), (2, 9)]


def test_window_top_two(spark, feed, tmp_path):
    s = feed([[(1, 1, 0, 1.0), (1, 2, 5, 3.0)], [(1, 3, 9, 3.0), (1, 4, 15, 1.0)], [(1, 5, 100, 1.0)]])
    out = forms.run_available(forms.stream_window_topk(s, 10, 2, "20 seconds"), str(tmp_path / "out"))
    t0 = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc).timestamp()
    assert rows(out, "window_start", "rank", "id") == [(t0, 1, 2), (t0, 2, 3), (t0 + 10, 1, 4)]


def test_merged_turns(spark, feed, tmp_path):
    s = feed([[(1, 1, 0, 2.0), (1, 3, 5, 6.0)], [(1, 2, 2, 4.5), (1, 4, 60, 61.0)], [(1, 5, 200, 201.0)]])
    base = F.unix_timestamp("ts") - F.second("ts") - 60 * F.minute("ts")
    x = s.select("timeline_id", "ts", (base + F.col("intensity")).alias("end"), F.lit("a").alias("label"), F.col("id").cast("string").alias("text"))
    out = forms.run_available(forms.stream_merge_turns(x, 1.0, "20 seconds"), str(tmp_path / "out"))
    assert rows(out, "text", "turns") == [("1 2 3", 3), ("4", 1)]


def test_sessions(spark, feed, tmp_path):
    s = feed([[(1, 1, 0, 1.0), (1, 2, 8, 1.0)], [(1, 3, 4, 1.0), (2, 4, 5, 1.0)], [(1, 5, 19, 1.0), (1, 6, 200, 1.0)], [(1, 7, 201, 1.0)]])
    out = forms.run_available(forms.stream_sessions(s.withColumn("label", F.lit("a")), 10.0, "20 seconds"), str(tmp_path / "out"))
    t0 = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc).timestamp()
    assert rows(out, "timeline_id", "start", "end", "rows") == [(1, t0, t0 + 8, 3), (1, t0 + 19, t0 + 19, 1), (2, t0 + 5, t0 + 5, 1)]


def test_state_is_typed(spark, feed):
    """No text holds the state; a batch appends rows, and only the timer reads them."""
    s = feed([[(1, 1, 0, 1.0)]])
    plan = forms.stream_min_interval(s, 10.0)._jdf.queryExecution().analyzed().toString()
    assert "TransformWithState" in plan and "InPandasWithState" not in plan.replace("TransformWithStateInPandas", "")


class _Handle:
    """State of one key in memory, counting the calls that would be round trips to the JVM."""

    def __init__(self):
        self.calls, self.timers, self.states = 0, set(), {}

    def _state(self, name, schema):
        handle = self

        class State:
            held = None

            def get(self):
                handle.calls += 1
                return self.held

            def update(self, value):
                handle.calls += 1
                self.held = value

            def clear(self):
                handle.calls += 1
                self.held = None

        return self.states.setdefault(name, State())

    getValueState = getListState = getMapState = _state

    def registerTimer(self, at):
        self.calls += 1
        self.timers.add(at)

    def deleteTimer(self, at):
        self.calls += 1
        self.timers.discard(at)


def test_topk_state_is_one_value_a_key():
    from types import SimpleNamespace as N
    h, best = _Handle(), forms._Best(["k", "window_start", "rank", "id", "score"], 10.0, 2, "bigint")
    best.init(h)
    given = [(w * 10.0 + j, w * 10 + j, float(j % 3) if j else None) for w in range(50) for j in range(4)]
    mark = N(getCurrentWatermarkInMs=lambda: 250_000)
    assert list(best.handleInputRows((7,), iter([N(_t=t, _i=i, _s=s) for t, i, s in given]), mark)) == []
    assert h.calls <= 3 and h.timers == {10_000}        # 50 windows
    out = [tuple(r) for r in best.handleExpiredTimer((7,), mark, None)]
    assert out == [(7, w * 10.0, n, w * 10 + j, s) for w in range(25) for n, j, s in ((1, 2, 2.0), (2, 1, 1.0))]
    assert h.calls <= 6 and max(h.timers) == 260_000
    late = [N(_t=300.0, _i=1, _s=9.0)]
    list(best.handleInputRows((7,), iter(late), mark))
    done = N(getCurrentWatermarkInMs=lambda: 10**9)
    out = [tuple(r) for r in best.handleExpiredTimer((7,), done, None)]
    assert len(out) == 50 and (7, 300.0, 1, 1, 9.0) in out and h.states["best"].held is None


def test_null_keys_and_scores_lose_no_timeline(spark, feed, tmp_path):
    some = [(k, 10 * k + j, 2 * j, None if j == 1 else float(j)) for k in range(1, 30) for j in range(3)]
    s = feed([[*some, (None, 900, 1, 4.0), (None, 901, 2, None)], [(1, 999, 500, 1.0)]])
    out = forms.run_available(forms.stream_window_topk(s, 10, 3, "20 seconds"), str(tmp_path / "out"))
    got = {tuple(r) for r in out.select("timeline_id", "rank", "id", "intensity").collect()}
    want = {(k, n, 10 * k + j, v) for k in range(1, 30) for n, j, v in ((1, 2, 2.0), (2, 0, 0.0), (3, 1, None))}
    assert got == want | {(None, 1, 900, 4.0), (None, 2, 901, None)}
