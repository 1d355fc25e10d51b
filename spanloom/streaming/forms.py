"""Streaming forms of three batch operators.

They are derived work: windows are aligned to the epoch (a stream has no first row), rows behind the
watermark of the batch before are dropped by Spark, and a result is emitted once the watermark shows that nothing can change it. State per
key is bounded: the best ``k`` rows of a window, or the rows newer than the watermark plus one open group.

State is typed and kept by ``transformWithState``: a list of waiting rows, one open group, one event-time timer. A batch appends its
rows without reading what waits; that is read when the watermark passes the timer. Such queries need the RocksDB state store
(``STATE_STORE``), which :func:`run_available` sets for its query.

A key has few rows in a batch, so what a query costs is work per key: rows come as rows, not as a data frame a key, and a key's small
state is one value with one timer, since every call to the state is a round trip between Python and the JVM.
"""

from __future__ import annotations

import bisect
import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def _seconds(ts: str) -> Column:
    """A null time is the least there is."""
    return F.coalesce(F.unix_micros(F.col(ts).cast("timestamp")), F.lit(-(2**63))) / 1e6


def _number(c: str, kind: str) -> Column:
    """Null among doubles as NaN, so that steps can compare; :func:`_result` turns it back."""
    return F.coalesce(F.col(c), F.lit(math.nan)).alias(c) if kind == "double" else F.col(c)


def _result(values) -> list:
    return [None if isinstance(x, float) and math.isnan(x) else x for x in values]


def _nulls_last(row) -> list[tuple]:
    return [(x is None, 0 if x is None else x) for x in row]


class _Ordered(StatefulProcessor):
    """Rows of a key in time order, as far as the watermark has come.

    ``step(open, row)`` returns (open, finished or None); ``close(open, now)`` says whether the open group is
    final at watermark ``now``; ``wake(open)`` is the time that can make it final. ``row[0]`` is the time.
    """

    def __init__(self, columns: list[str], row: str, group: str, names: list[str], step: Callable, close: Callable, wake: Callable):
        self.columns, self.row, self.group, self.out = columns, row, group, Row(*names)
        self.step, self.close_group, self.wake, self.width = step, close, wake, len(names)

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.row)
        self.open = handle.getValueState("open", self.group)
        self.timer = handle.getValueState("timer", "at bigint")

    def _wake_at(self, seconds: float, now: int, held: int | None) -> None:
        """One timer a key: the earliest time that matters, just after the watermark at least."""
        at = max(math.floor(seconds * 1000) + 1, now + 1)
        if held is None or at < held or held <= now:
            if held is not None and held > now:
                self.handle.deleteTimer(held)
            self.handle.registerTimer(at)
            self.timer.update((at,))

    def handleInputRows(self, key, rows, timerValues):
        new = [tuple(r[c] for c in self.columns) for r in rows]
        if new:
            self.waiting.appendList(new)
            held = self.timer.get()
            self._wake_at(min(r[0] for r in new), timerValues.getCurrentWatermarkInMs(), held[0] if held else None)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        mark = timerValues.getCurrentWatermarkInMs()
        now, done = mark / 1000.0, []
        rows = sorted((tuple(r) for r in self.waiting.get()), key=_nulls_last)
        held = self.open.get()
        open_ = list(held) if held else None
        ready = sum(r[0] <= now for r in rows)
        for r in rows[:ready]:
            open_, finished = self.step(open_, r)
            if finished is not None:
                done.append(finished)
        rows = rows[ready:]
        if open_ is not None and self.close_group(open_, now):
            done.append(open_)
            open_ = None
        if ready:
            self.waiting.put(rows) if rows else self.waiting.clear()
        if open_ is not None:
            self.open.update(tuple(open_))
        elif held:
            self.open.clear()
        times = ([self.wake(open_)] if open_ is not None else []) + ([rows[0][0]] if rows else [])
        if times:
            self._wake_at(min(times), mark, None)
        else:
            self.timer.clear()
        for g in done:
            yield self.out(*key, *_result(g[:self.width - len(key)]))

    def close(self) -> None:
        pass


def _ordered(df: DataFrame, keys: list[str], ts: str, columns: list[str], out: str, group: str, step: Callable, close: Callable,
             wake: Callable) -> DataFrame:
    types = dict(df.dtypes)
    names = [c.split()[0] for c in out.split(", ")]
    row = ", ".join(["t double", *(f"c{n} {types[c]}" for n, c in enumerate(columns))])
    processor = _Ordered(["_t", *columns], row, group, names, step, close, wake)
    # the time itself stays for the watermark
    return (df.select(*keys, ts, _seconds(ts).alias("_t"), *[_number(c, types[c]) for c in columns]).groupBy(*keys)
            .transformWithState(statefulProcessor=processor, outputStructType=out, outputMode="append", timeMode="EventTime"))


def stream_min_interval(df: DataFrame, d: float, delay: str = "10 minutes", *, key="timeline_id", ts="ts", id="id",
                        score="intensity") -> DataFrame:
    """The strongest instant within ``d`` seconds of each anchor; columns key, t, id, score."""
    types = dict(df.dtypes)
    out = f"{key} {types[key]}, t double, id {types[id]}, {score} double"

    # open group: [t of best, id of best, score of best, anchor]
    def step(open_, r):
        t, i, v = r
        if open_ is None:
            return [t, i, v, t], None
        if t - open_[3] < d:
            return ([t, i, v, open_[3]] if v > open_[2] else open_), None
        return [t, i, v, t], open_

    group = f"t double, id {types[id]}, v double, anchor double"
    return _ordered(df.withWatermark(ts, delay), [key], ts, [id, score], out, group, step,
                    lambda g, now: now - g[3] >= d, lambda g: g[3] + d)


def stream_merge_turns(df: DataFrame, gap: float = 1.0, delay: str = "10 minutes", *, key="timeline_id", ts="ts",
                       end="end", label="label", text="text") -> DataFrame:
    """Consecutive turns of one label joined; columns key, start, end, label, text, turns. ``end`` is in seconds."""
    types = dict(df.dtypes)
    out = f"{key} {types[key]}, start double, end double, label string, text string, turns bigint"

    def step(open_, r):
        t, e, who, said = r
        if open_ is not None and open_[2] == who and t - open_[1] <= gap:
            return [open_[0], e, who, open_[3] + " " + said, open_[4] + 1], None
        return [t, e, who, said, 1], open_

    group = "start double, end double, label string, text string, turns bigint"
    return _ordered(df.withWatermark(ts, delay), [key], ts, [end, label, text], out, group, step,
                    lambda g, now: now - g[1] > gap, lambda g: g[1] + gap)


def stream_window_topk(df: DataFrame, size: float, k: int = 1, delay: str = "10 minutes", *, key="timeline_id", ts="ts",
                       id="id", score="intensity") -> DataFrame:
    """Top-k per fixed window; columns key, window_start (seconds), rank, id, score.

    One row per window is a built-in aggregate with partial sums on the map side; more rows keep the best ``k`` as state.
    """
    types = dict(df.dtypes)
    marked = df.withWatermark(ts, delay)
    if k == 1:
        best = F.min_by(F.struct(F.col(id).alias("id"), F.col(score).alias("v")), F.struct(-F.col(score), F.col(ts), F.col(id)))
        win = F.window(ts, f"{int(size)} seconds")
        agg = marked.groupBy(win, key).agg(best.alias("_b"))
        start = F.unix_micros(F.col("window.start").cast("timestamp")) / 1e6
        return agg.select(key, start.alias("window_start"), F.lit(1).cast("bigint").alias("rank"), F.col("_b.id").alias(id), F.col("_b.v").alias(score))
    out = f"{key} {types[key]}, window_start double, rank bigint, {id} {types[id]}, {score} double"
    names = [key, "window_start", "rank", id, score]
    return (marked.select(key, ts, _seconds(ts).alias("_t"), F.col(id).alias("_i"), F.col(score).cast("double").alias("_s")).groupBy(key)
            .transformWithState(statefulProcessor=_Best(names, float(size), k, types[id]), outputStructType=out, outputMode="append", timeMode="EventTime"))


def _strongest(r: tuple) -> tuple:
    """Order inside a window: highest score (kept negated), then earliest time, then lowest id; no score comes last."""
    return (math.isnan(r[0]), 0.0 if math.isnan(r[0]) else r[0], *_nulls_last(r[1:]))


class _Best(StatefulProcessor):
    """Best ``k`` rows of each open window of a key: one value that holds them all, ordered, and a timer at the end of the earliest window."""

    def __init__(self, names: list[str], size: float, k: int, kind: str):
        self.out, self.size, self.k, self.kind = Row(*names), size, k, kind

    def init(self, handle) -> None:
        self.handle = handle
        self.best = handle.getValueState("best", f"at bigint, w array<bigint>, v array<double>, t array<double>, i array<{self.kind}>")

    def _end(self, w: int) -> int:
        return int((w + 1) * self.size * 1000)

    def _keep(self, windows: dict[int, list], at: int) -> None:
        flat = [(w, *r) for w in sorted(windows) for r in windows[w]]
        self.best.update((at, *([r[c] for r in flat] for c in range(4))))

    def handleInputRows(self, key, rows, timerValues):
        held = self.best.get()
        windows: dict[int, list] = {}
        for w, *r in zip(*held[1:]) if held else ():
            windows.setdefault(w, []).append(tuple(r))
        for r in rows:
            mine = windows.setdefault(int(r._t // self.size), [])
            # a row without a score comes last
            bisect.insort(mine, (math.nan if r._s is None else -r._s, r._t, r._i), key=_strongest)
            del mine[self.k:]
        if windows:
            at = self._end(min(windows))
            if held is None or at < held[0]:
                if held is not None:
                    self.handle.deleteTimer(held[0])
                self.handle.registerTimer(at)
            else:
                at = held[0]
            self._keep(windows, at)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        held, mark = self.best.get(), timerValues.getCurrentWatermarkInMs()
        windows: dict[int, list] = {}
        for w, *r in zip(*held[1:]):
            windows.setdefault(w, []).append(tuple(r))
        for w in sorted(windows):
            if self._end(w) > mark:
                break
            for n, (v, _, i) in enumerate(windows.pop(w), 1):
                yield self.out(key[0], w * self.size, n, i, None if math.isnan(v) else -v)
        if windows:
            at = self._end(min(windows))
            self.handle.registerTimer(at)
            self._keep(windows, at)
        else:
            self.best.clear()

    def close(self) -> None:
        pass


def stream_sessions(df: DataFrame, gap: float = 1.0, delay: str = "10 minutes", *, key="timeline_id", ts="ts", label="label") -> DataFrame:
    """Turns without ends: instants of one key and label at most ``gap`` seconds apart are one turn; columns key, label, start, end, rows.

    The built-in session window: partial sessions merge map-side, and Spark keeps one row of state per open session. ``end`` is the last instant.
    """
    seconds = lambda c: F.unix_micros(c.cast("timestamp")) / 1e6
    marked = df.withWatermark(ts, delay)
    session = F.session_window(ts, f"{round(gap * 1e6)} microseconds")
    out = marked.groupBy(session, key, label).agg(F.min(ts).alias("_first"), F.max(ts).alias("_last"), F.count(F.lit(1)).alias("rows"))
    return out.select(key, label, seconds(F.col("_first")).alias("start"), seconds(F.col("_last")).alias("end"), "rows")


def run_available(stream: DataFrame, folder: str) -> DataFrame:
    """Drive a streaming query over everything available into Parquet files below ``folder`` and read them back."""
    conf = stream.sparkSession.conf
    before = {k: conf.get(k, None) for k in STATE_STORE}
    for k, v in STATE_STORE.items():
        conf.set(k, v)
    try:
        return _run(stream, folder)
    finally:
        for k, v in before.items():
            conf.set(k, v) if v is not None else conf.unset(k)


def _run(stream: DataFrame, folder: str) -> DataFrame:
    q = (stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state")
         .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/out")
